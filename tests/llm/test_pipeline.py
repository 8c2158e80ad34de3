"""run() of the pipeline against a brute-force version, and the queries with SQL."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from compare import differences
from quarry.llm import curriculum, quality, token_store
from quarry.llm.queries import ORACLE, QUERIES
from test_filters import DOCS, brute_groups, brute_matches, labelled, prose


def test_run_equals_brute_force(spark, tmp_path):
    rng = random.Random(11)
    rows = [(i, t, g) for i, (t, g) in enumerate(labelled(rng, 240))]
    items = [(k, prose(rng, 30)) for k in range(4)]
    n = len(rows)
    for k in range(12):
        rows.append((n + k, rows[2 + 4 * k][1] + " tail", True))  # near copies
    for k in range(8):
        rows.append((n + 20 + k, prose(rng, 40) + " " + items[k % 4][1] + " " + prose(rng, 40), True))
    docs = spark.createDataFrame([(i, t, "en", "abbc"[i % 4], len(t)) for i, t, _ in rows] + [(900, None, None, None, None), (901, "", "en", "a", 0)], DOCS)
    labels = spark.createDataFrame([(i, int(g), 0) for i, _, g in rows[:n]], "doc_id long, quality int, toxic int")
    tests = spark.createDataFrame(items, "item_id long, text string")
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", tests)):
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    got = Counter((r.doc_id, r.n_tokens, tuple(r.token_ids)) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())

    model = quality.fit(docs, labels)
    left = [(i, t) for i, t, _ in rows if model.score(t) >= model.threshold]
    assert len(left) < len(rows) - 80
    gone = {d[0] for d, kept in brute_groups(left).items() if d != kept}
    assert len(gone) >= 8
    left = [(i, t) for i, t in left if i not in gone]
    leaks = {m[0] for m in brute_matches(left, items)}
    assert len(leaks) == 8
    by = defaultdict(list)
    for i, t in left:
        if i not in leaks:
            by["abbc"[i % 4]].append((hashlib.md5(f"{i} {t}".encode()).hexdigest(), i, t))
    size = lambda t: sum(t.count(c) for c in " \n\t") + 1
    supply = {s: sum(size(t) for _, _, t in d) for s, d in by.items()}
    whole = sum(supply.values())
    flat = {s: (x / whole) ** curriculum.ALPHA for s, x in supply.items()}
    area = {s: (supply[s] / whole + flat[s] / sum(flat.values())) / 2 for s in supply}
    budget, enc, want = max(supply[s] / area[s] for s in supply), token_store.encoding(), Counter()
    for s, d in by.items():
        start = 0
        for _, i, t in sorted(d):
            ids = tuple(enc.encode_ordinary(t))
            want[(i, len(ids), ids)] += math.ceil((budget * area[s] - 0.5 - start) / supply[s])
            start += size(t)
    assert got == +want and sum(want.values()) > len(want)


def test_run_of_defined_cases(spark, tmp_path):
    rng = random.Random(31)
    good = [t for t, g in labelled(rng, 60) if g][:8]
    rows = [(1, good[0]), (1, good[0]), (1, good[1]), (2, None), (3, ""), (None, good[2]), (4, good[3]), (5, good[3]), (6, prose(rng, 30_000)), (7, "\n ")]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)
    clash = ["mix_source", "text_key", "token_ids", "n_tokens", "row_of_text", "score", "item_id", "Kept_Id"]
    for name in clash:
        docs = docs.withColumn(name, F.lit("x"))
    for name, df in (("documents", docs), ("labels", spark.createDataFrame([], "doc_id long, quality int, toxic int")), ("benchmark", spark.createDataFrame([(1, None), (None, "x")], "item_id long, text string"))):
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    enc = token_store.encoding()
    texts = Counter((r.doc_id, enc.decode(r.token_ids)) for r in got.collect())
    assert set(texts) == {(1, good[0]), (1, good[1]), (None, good[2]), (4, good[3]), (6, rows[8][1])} and got.columns == ["doc_id", "n_tokens", "token_ids"]
    docs.limit(0).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_files_are_in_training_order(spark, tmp_path, monkeypatch):
    rng = random.Random(12)
    docs = spark.createDataFrame([(i, prose(rng, rng.choice([5, 40, 900])), "en", "aaab"[i % 4], 0) for i in range(200)], DOCS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(corpus_pipeline, "STAGES", corpus_pipeline.STAGES[-2:])
    files = sorted(f.removeprefix("file://") for f in corpus_pipeline.run(spark, str(tmp_path)).inputFiles())
    got = [i for f in files for i in pq.read_table(f, columns=["doc_id"])["doc_id"].to_pylist()]
    position = {(r.doc_id, r.copy): r.position for r in curriculum.query(spark, str(tmp_path)).collect()}
    seen, order = Counter(), []
    for i in got:
        order.append(position.pop((i, seen[i])))
        seen[i] += 1
    assert not position and order == sorted(order) and len(files) > 1


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, con, name):
    assert differences(QUERIES[name](spark, "/root/testdata/sf0.01"), ORACLE[name], con) is None


def test_the_first_stage_is_fitted_on_all_labels(spark, tmp_path):
    """A sign that only the last 1,000 of 7,000 labelled documents have, in the order of the hash that samples were drawn by."""
    rng = random.Random(29)
    ids = [r.id for r in spark.range(7000).orderBy(F.xxhash64("id"), "id").collect()]
    rows = [(i, prose(rng, 12) + (" $$$" if at < 6000 else " vilest") * (at % 3 == 0), int(at % 3 > 0)) for at, i in enumerate(ids)]
    spark.createDataFrame([(i, g, 0) for i, _, g in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t, _ in rows], DOCS)
    name, first = corpus_pipeline.STAGES[0]
    kept = {r.doc_id for r in first(spark, docs, str(tmp_path)).select("doc_id").collect()}
    assert name == "quality_classifier"
    assert not kept & {i for i, t, _ in rows if "vilest" in t}
    assert len(kept) > 0.95 * sum(g for _, _, g in rows)
