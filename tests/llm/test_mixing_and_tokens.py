"""Curriculum, ORC tokens, language-model scores."""

import math
import random

import duckdb
import numpy as np
import pyarrow.orc as paorc
import pytest
from pyspark.sql import functions as F

from quarry.llm import curriculum, mixlm, token_store

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], DOCS)


def some(rng, n=120):
    return [(i, " ".join("w" * rng.randint(1, 6) for _ in range(rng.choice([1, 5, 40, 300]))), rng.choice(["a", "a", "a", "b", "c"])) for i in range(n)]


# -- mixing


def test_positions_solve_the_demand(spark):
    rows = some(random.Random(1))
    docs = docs_of(spark, rows)
    sched = spark.createDataFrame([(s, t, w) for s, ws in {"a": (8, 1, 1), "b": (1, 1, 6), "c": (1, 8, 3)}.items() for t, w in zip((0.0, 0.4, 1.0), ws)], "source string, t double, weight int").withColumn("weight", F.col("weight").cast("double"))
    placed, (src, n, copy, pos, _) = curriculum.place(docs, sched, carry=False)
    out = placed.toPandas()
    knots = {s: np.array(w, float) for s, w in {"a": (8, 1, 1), "b": (1, 1, 6), "c": (1, 8, 3)}.items()}
    whole = sum(knots.values())
    ts = np.array([0, 0.4, 1.0])
    share = {s: w / whole for s, w in knots.items()}
    area = {s: sum((ts[k + 1] - ts[k]) * (w[k] + w[k + 1]) / 2 for k in range(2)) for s, w in share.items()}
    supply = {s: sum(len(t.split()) for _, t, x in rows if x == s) for s in share}
    budget = max(supply[s] / area[s] for s in share)

    def demand(s, t):
        w, total = share[s], 0.0
        for k in range(2):
            end = min(t, ts[k + 1])
            if end > ts[k]:
                at = w[k] + (w[k + 1] - w[k]) * (end - ts[k]) / (ts[k + 1] - ts[k])
                total += (end - ts[k]) * (w[k] + at) / 2
        return total * budget

    for s, g in out.groupby(src):
        g = g.sort_values(pos)
        start = np.concatenate([[0], np.cumsum(g[n])[:-1]])
        assert all(abs(demand(s, t) - c) < 1e-3 for t, c in zip(g[pos], start))
        assert abs(g[n].sum() - demand(s, 1.0)) <= g[n].max()
    assert set(out[out[copy] == 0].doc_id) == {i for i, _, _ in rows}


def test_budget_cuts_or_repeats(spark):
    docs = docs_of(spark, some(random.Random(2)))
    total = docs.select(F.sum(curriculum.tokens(F.col("text")))).first()[0]
    for factor in (0.3, 2.7):
        placed, (_, n, copy, _, _) = curriculum.place(docs, budget=factor * total, carry=False)
        used = placed.agg(F.sum(n)).first()[0]
        assert abs(used / (factor * total) - 1) < 0.25
        assert (placed.agg(F.max(copy)).first()[0] > 0) == (factor > 1)


@pytest.mark.parametrize("most", [1 << 20, 300, 3])
def test_order_in_files_and_sql(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(curriculum, "RANGE_TOKENS", most)  # 1, 2 and more hex digits than are summed at first
    docs = docs_of(spark, some(random.Random(3)) + [(7, "same id, other text " * k, "a") for k in range(5)] + [(None, f"no id {k}", "a") for k in range(9)])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = curriculum.query(spark, str(tmp_path)).toPandas()
    assert got.position.is_monotonic_increasing
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(curriculum.SQL).df()
    rows = lambda t: sorted(map(str, t[sorted(t.columns)].astype({"doc_id": "Int64"}).itertuples(index=False)))
    assert rows(got) == rows(want)


def test_mixing_defined_cases(spark):
    rows = [(1, "a b", "x"), (1, "a b", "x"), (2, None, "x"), (3, "", "x"), (None, "c d e", None), (4, "f", ""), (5, "word " * 50_000, "y"), (6, None, "only nulls")]
    docs = docs_of(spark, rows)
    docs = docs.withColumn("mix_source", docs.lang).withColumn("copy", docs.lang).withColumn("position", docs.lang)
    out = curriculum.stage(spark, docs, "")
    assert out.columns == docs.columns
    ids = [r.doc_id for r in out.collect()]
    assert ids.count(1) >= 2 and None in ids and 4 in ids and 5 in ids and not {2, 3, 6} & set(ids)
    assert curriculum.stage(spark, docs.limit(0), "").count() == 0
    assert curriculum.stage(spark, docs.where("text is null"), "").count() == 0


# -- tokens


def test_tokens_round_trip_and_pruning(spark, tmp_path):
    texts = ["Plain text, twice.  Spaces\n\nand lines", "Ünïcödé ñ 漢字 🙂", "", None, "<|endoftext|> is text", "x" * 300_000, "Plain text, twice.  Spaces\n\nand lines"]
    docs = docs_of(spark, [(i, t, "s") for i, t in enumerate(texts)] + [(None, "no id", "s"), (0, "again", "s")])
    docs = docs.withColumn("token_ids", docs.lang).withColumn("n_tokens", docs.lang)
    out = token_store.write(docs, str(tmp_path / "t"))
    rows = token_store.read(spark, out).collect()
    enc = token_store.encoding()
    got = sorted(((r.doc_id, None if r.token_ids is None else enc.decode(r.token_ids), r.n_tokens) for r in rows), key=str)
    want = sorted(((i, t, 0 if t is None else len(enc.encode_ordinary(t))) for i, t in [*enumerate(texts), (None, "no id"), (0, "again")]), key=str)
    assert got == want
    assert [r.doc_id for r in token_store.read_ids(spark, out, [4]).collect()] == [4]
    plan = token_store.read_ids(spark, out, [4])._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,4)]" in plan or "PushedFilters: [In(doc_id" in plan
    assert sum(r.rows for r in token_store.stripes(spark, out).collect()) == len(rows)
    empty = token_store.write(docs.limit(0), str(tmp_path / "e"))
    assert token_store.read(spark, empty).count() == 0


def test_stripes_and_row_groups_are_skipped(spark, tmp_path, monkeypatch):
    monkeypatch.setitem(token_store.ORC, "orc.stripe.size", str(1 << 14))
    rng = random.Random(21)
    docs = docs_of(spark, [(i, " ".join(str(rng.random()) for _ in range(10)), "s") for i in range(30_000)]).coalesce(1)
    out = token_store.write(docs, str(tmp_path / "t"))
    (path,) = (tmp_path / "t").glob("*.orc")
    f = paorc.ORCFile(str(path))
    told = token_store.stripes(spark, out).orderBy("stripe").collect()
    assert f.row_index_stride == 1000 and f.nstripes > 2
    assert [r.rows for r in told] == [f.read_stripe(i, ["doc_id"]).num_rows for i in range(f.nstripes)] and sum(r.rows for r in told) == 30_000
    assert [(r.low, r.high) for r in told] == [(min(v), max(v)) for v in (f.read_stripe(i, ["doc_id"])["doc_id"].to_pylist() for i in range(f.nstripes))]
    for ids in ([123], [123, 29_999], [40_000]):
        assert sorted(r.doc_id for r in token_store.read_ids(spark, out, ids).collect()) == [i for i in ids if i < 30_000]
    assert token_store.rows_read(spark, str(path), [123]) == 1000  # one row group of its stripe
    assert token_store.rows_read(spark, str(path), [40_000]) == 0
    assert token_store.rows_read(spark, str(path), None) == 30_000


def test_bloom_filters_skip_what_minima_and_maxima_cannot(spark, tmp_path):
    ids = list(range(0, 20_000, 2))
    random.Random(22).shuffle(ids)
    docs = docs_of(spark, [(i, f"text {i}", "s") for i in ids]).coalesce(1)
    out = token_store.write(docs, str(tmp_path / "t"), by_id=False)
    (path,) = (tmp_path / "t").glob("*.orc")
    assert token_store.rows_read(spark, str(path), [ids[10]]) in (1000, 2000)
    odd = [token_store.rows_read(spark, str(path), [i]) for i in range(1001, 2001, 20)]
    assert sum(odd) < 0.2 * 10_000 * len(odd) and odd.count(0) > 30


# -- language-model scores


def brute_scores(texts, total):
    """The same model, position by position and bit by bit, without grouping equal grams."""
    raw = [(t or "").encode() for t in texts]
    data = b"".join(b"\0" * 4 + r for r in raw)
    owner = [None if k < 4 else d for d, r in enumerate(raw) for k in range(4 + len(r))]
    n = np.zeros(2 * mixlm.SLOTS) if total is None else total.astype(float).copy()

    def bits_at(p):
        gram = np.uint64(int.from_bytes(data[max(0, p - 4) : p + 1].rjust(5, b"\0"), "big"))
        at, bit = mixlm.slots(np.array([gram]))
        return [a[0] for a in at], bit[0], int(gram >> np.uint64(8)) & 0xFF

    if total is not None:
        for p in range(len(data)):
            if owner[p] is not None:
                at, bit, _ = bits_at(p)
                for a in at:
                    for k in range(8):
                        n[2 * a[k] + bit[k]] -= 1
    w, seen = np.full((32, 6), 0.25), np.zeros((256, 25, 2))
    cost = np.zeros(len(raw))
    for lo, hi in mixlm.blocks(len(data)):
        up, down, later, later_seen = np.zeros((32, 6)), np.zeros((32, 6)), [], []
        for p in range(lo, hi):
            if owner[p] is None:
                continue
            at, bit, last = bits_at(p)
            for k in range(8):
                s = np.array([math.log((n[2 * a[k] + 1] + 0.4) / (n[2 * a[k]] + 0.4)) for a in at])
                gate = sum(n[2 * at[i][k]] + n[2 * at[i][k] + 1] > 0 for i in (2, 3, 4)) * 8 + k
                z = min(14, max(-14, float(w[gate] @ s)))
                q = 1 / (1 + math.exp(-z))
                place = int(np.rint((min(6, max(-6, z)) + 6) * 2))
                c = seen[last, place]
                final = (q + (c[1] + 40 * q) / (c.sum() + 40)) / 2
                cost[owner[p]] -= math.log2(max(1e-6, final if bit[k] else 1 - final))
                up[gate] += (bit[k] - q) * s
                down[gate] += q * (1 - q) * s * s
                later.append([2 * a[k] + bit[k] for a in at])
                later_seen.append((last, place, bit[k]))
        w += up / (down + 50) / 6
        for x in later:
            for i in x:
                n[i] += 1
        for x in later_seen:
            seen[x] += 1
    return cost


@pytest.mark.parametrize("with_total", [False, True])
def test_scores_equal_brute_force(with_total, monkeypatch):
    monkeypatch.setattr(mixlm, "BLOCK", 700)
    rng = random.Random(4)
    words = ["the", "cat", "sät", "on", "mat", "and", "ran", "12", "é"]
    texts = [" ".join(rng.choice(words) for _ in range(n)) for n in (30, 0, 80, 200, 1, 150)] + [None]
    total = mixlm.corpus_counts(texts + [" ".join(rng.choice(words) for _ in range(500))]) if with_total else None
    bits, size = mixlm.score_shard(texts, total)
    assert list(size) == [len((t or "").encode()) for t in texts]
    assert np.allclose(bits, brute_scores(texts, total), rtol=1e-4, atol=1e-2)


def test_large_counts_still_move():
    n = np.array([1 << 40, 3 << 40, 5, 7, 0, 0])
    got = mixlm.scaled(n)
    assert got.tolist() == [mixlm.COUNT / 4, 3 * mixlm.COUNT / 4, 5, 7, 0, 0] and got[0] + np.float32(1) > got[0]


def test_scores_tell_language_from_noise(spark):
    rng = random.Random(5)
    words = [a + b for a in ("ba", "ke", "lo") for b in ("dan", "fer", "gol")]
    rows = [(i, " ".join(rng.choice(words) for _ in range(200)), "s") for i in range(60)]
    noise = [(100 + i, "".join(chr(rng.randint(33, 126)) for _ in range(1000)), "s") for i in range(3)]
    docs = docs_of(spark, rows + noise + [(200, None, "s"), (201, "", "s"), (None, rows[0][1], "s"), (0, rows[0][1], "s")])
    docs = docs.withColumn("bits", docs.lang).withColumn("shard", docs.lang)
    got = mixlm.score(docs, shard=20_000).toPandas().set_index("doc_id")
    assert len(got) == 67
    assert got.loc[[100, 101, 102]].bits_per_byte.min() > 2 * got.loc[[i for i in range(1, 60)]].bits_per_byte.max()
    assert math.isnan(got.loc[200].bits_per_byte) and got.loc[201].bits == 0
    assert mixlm.score(docs.limit(0)).count() == 0


def test_gathered_counts_are_exact(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice("abc d") for _ in range(rng.randint(0, 300))) for _ in range(50)] + [None]
    docs = docs_of(spark, [(i, t, "s") for i, t in enumerate(texts)]).repartition(7)
    assert (mixlm.gather(docs) == mixlm.corpus_counts(texts)).all()
    fan = mixlm.FAN_IN
    try:
        mixlm.FAN_IN = 2
        assert (mixlm.gather(docs) == mixlm.corpus_counts(texts)).all()
    finally:
        mixlm.FAN_IN = fan
