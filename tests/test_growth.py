"""Queries of the index and its evaluation: as many rows as there are results, not as there are pairs; the same results in slices and blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import evaluation, vector_index
from quarry.plans import QUERIES

SF = "/root/testdata/sf0.001"


def most_rows(df) -> int:
    """The most rows that a step of the plan, as it ran, gave to the next."""
    df.collect()

    def walk(p):
        kind = p.getClass().getSimpleName()
        for name in ("numOutputRows", "pythonNumRowsReceived"):
            if (m := p.metrics().get(name)).isDefined():
                yield m.get().value()
        below = [p.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [p.plan()] if kind.endswith("QueryStageExec") else [p.children().apply(i) for i in range(p.children().size())]
        for x in below:
            yield from walk(x)

    return max(walk(df._jdf.queryExecution().executedPlan()))


@pytest.mark.parametrize("name", ["vec_ivf_search", "evl_folds", "evl_recall_mrr_median", "evl_hit_rate"])
def test_rows(spark, name):
    """500 vectors with 20 results each."""
    assert most_rows(QUERIES[name](spark, SF)) <= 500 * 20


def brute(v, q, k, reads=None, exclude_self=False):
    """{query: [(id, score)]}; v: [(id, cluster, vector)], q: [(id, vector)]."""
    out = {}
    for i, x in q:
        found = [(-int(np.dot(x, y)), j) for j, c, y in v if (reads is None or c in reads[i]) and not (exclude_self and i == j)]
        out[i] = [(j, -s) for s, j in sorted(found)[:k]]
    return out


@pytest.mark.parametrize("sent,rows,columns,pairs", [(1 << 26, 512, 2048, 1 << 28), (1200, 7, 5, 4000)])
def test_search_in_parts(spark, monkeypatch, sent, rows, columns, pairs):
    """Few different components, so many ties; whole, and with several slices, blocks and tasks."""
    for name, x in (("SENT_BYTES", sent), ("ROWS", rows), ("COLUMNS", columns), ("TASK_PAIRS", pairs)):
        monkeypatch.setattr(vector_index, name, x)
    rng = np.random.default_rng(5)
    v = [(int(i), int(rng.integers(5)), rng.integers(-1, 2, 6).tolist()) for i in rng.permutation(120)]
    many, few = [(i, x) for i, _, x in v], [(1000 + i, rng.integers(-1, 2, 6).tolist()) for i in range(9)]
    centres = [(c, rng.integers(-1, 2, 6).tolist()) for c in range(5)]
    table = lambda r: spark.createDataFrame(r, "id long, q array<tinyint>")
    vectors = spark.createDataFrame(v, "id long, cluster_id long, q array<tinyint>")

    def same(found, want):
        got = {i: [] for i in want}
        for r in found.orderBy("query_id", "rank").collect():
            got[r.query_id].append((r.id, r.score))
        assert got == want

    for q in (many, few):
        for alone in (False, True):
            same(vector_index.exact_topk(vectors, table(q), 10, alone), brute(v, q, 10, exclude_self=alone))
        reads = {i: {c for c, _ in found} for i, found in brute([(c, c, y) for c, y in centres], q, 3).items()}
        same(vector_index.ivf_search(vectors, table(q), table(centres), 3, 8), brute(v, q, 8, reads))
    assert vector_index.exact_topk(vectors, table(few), 0).count() == vector_index.ivf_search(vectors.where(F.lit(False)), table(few), table(centres), 3, 8).count() == 0
    assert vector_index.exact_topk(vectors, table(few), 500).count() == 9 * 120


def test_relevance_by_sets(spark):
    """As with all pairs: queries in several sets, in none, or in sets without documents; repeated documents; unranked ones."""
    rng = np.random.default_rng(2)
    asked = spark.createDataFrame([(int(q), None if s == 9 else int(s)) for q, s in rng.integers(0, (40, 10), (70, 2))], "query_id long, set_id int")
    members = spark.createDataFrame([(int(s), int(d)) for s, d in rng.integers(0, (7, 30), (60, 2))], "set_id int, doc_id long")
    ranked = spark.createDataFrame([(int(q), int(d), int(p)) for q, d, p in rng.integers((0, 0, 1), (45, 30, 21), (400, 3))], "query_id long, doc_id long, place int")
    pairs = asked.join(members, "set_id").select("query_id", "doc_id").distinct()
    got, want = evaluation.per_query_of_sets(ranked, asked, members), evaluation.per_query(ranked, pairs)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []
