"""Quality, near-dedup, decontamination: brute force, and the defined cases."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from quarry.llm import bottomk, positional, quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in "ba ke lo mi nu ra si to vu ze".split() for b in "dan fer gol hin jus kam lop mer".split()]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS)


# -- quality


def labelled(rng, n):
    rows = []
    for i in range(n):
        t, kind = prose(rng, rng.randint(30, 300)), i % 4
        if kind == 0:
            t = re.sub(" ", "$$$ ", t)
        if kind == 1:
            t += " vilest " + prose(rng, 5)
        rows.append((t, kind > 1))
    return rows


def test_quality_held_out_accuracy():
    rng = random.Random(1)
    model = quality.fit_rows(labelled(rng, 600))
    fresh = labelled(rng, 300)
    right = [(model.score(t) >= model.threshold) == good for t, good in fresh]
    assert np.mean(right) > 0.97
    assert model.holdout_accuracy > 0.97
    assert quality.term("vilest") in model.terms


def test_quality_learns_only_from_differences():
    good = quality._bradley_terry(np.array([[1.0, 5], [0, 5]], np.float32), np.array([True, False]), 200, 1)
    assert good[0] > 0.5 and abs(good[1]) < 1e-6


def test_quality_defined_cases(spark):
    rng = random.Random(2)
    rows = labelled(rng, 400)
    docs = docs_of(spark, [(i, t) for i, (t, _) in enumerate(rows)] + [(1000, None), (1001, ""), (1002, "  \n"), (None, prose(rng, 100)), (2, rows[2][0]), (1003, prose(rng, 40_000))])
    docs = docs.withColumn("score", docs.doc_id).withColumn("kept", docs.lang)
    labels = spark.createDataFrame([(i, int(g), 0) for i, (_, g) in enumerate(rows)] + [(3, None, None), (9999, 0, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    got = quality.keep(docs, model)
    assert got.columns == docs.columns
    ids = [r.doc_id for r in got.collect()]
    assert not {1000, 1001, 1002} & set(ids) and None in ids and 1003 in ids and ids.count(2) == 2
    scores = {r.doc_id: r for r in quality.score_documents(docs, model).collect()}
    assert scores[1000].score is None and not scores[1000].kept
    assert quality.keep(docs.limit(0), model).count() == 0
    none = quality.fit(docs, labels.limit(0))
    assert quality.keep(docs, none).count() == docs.count() - 3


def plain_score(model, text):
    """The score of one text, in plain Python."""
    raw = text.encode()
    kind = [sum(quality._CLASS[b] == k for b in raw) / max(1, len(raw)) for k in range(8)]
    words = re.findall(rb"[A-Za-z0-9_\x80-\xff]+", text.lower().encode())
    lines, kinds, n = text.split("\n"), set(words), max(1, len(words))
    lines = lines[:-1] if lines[-1] == "" else lines
    x = [
        min(1, 4 * kind[2]), min(1, 8 * kind[3]), min(1, 20 * kind[5]), min(1, 10 * kind[6]), min(1, 8 * kind[7]), kind[0], len(kinds) / n if n > 20 else 1,
        1 - len(set(lines)) / len(lines) if lines else 0, min(2, sum(map(len, words)) / n / 8), n < 20, min(1, n / 4000),
    ]
    terms = {quality.term(w.decode()) for w in kinds} | {quality.term(w[:k].decode(), True) for w in kinds for k in quality.BEGINNINGS if len(w) >= k and w.isascii()}
    at = {int(t): i for i, t in enumerate(model.terms)}
    return sum(a * b for a, b in zip(x, model.weights)) + sum(model.weights[len(quality.SHAPE) + at[t]] for t in terms if t in at)


def test_scores_equal_plain_python(monkeypatch):
    rng = random.Random(17)
    model = quality.fit_rows(labelled(rng, 400))
    texts = [t for t, _ in labelled(rng, 60)] + ["one", "A b C, d.\n\nA b C, d.\nend", "$$$ ### 123", prose(rng, 3000), "Ünïcode wörds " * 9]
    want = [plain_score(model, t) for t in texts]
    assert np.allclose(model.scores(texts), want)
    monkeypatch.setattr(quality, "CHUNK", 50)
    assert np.allclose(model.scores(texts), want)


def test_pairwise_loss_falls_to_that_of_plain_descent():
    rng = np.random.default_rng(18)
    good = np.arange(80) % 2 == 0
    x = rng.normal(size=(80, 3)).astype(np.float32)
    x[:, 0] += good * 1.5
    loss = lambda w: np.mean([np.log1p(np.exp(-(x[i] - x[j]) @ w)) for i in np.flatnonzero(good) for j in np.flatnonzero(~good)])
    w = np.zeros(3)
    for _ in range(400):  # the gradient over all pairs
        g = np.zeros(3)
        for i in np.flatnonzero(good):
            d = x[i] - x[~good]
            g -= (d / (1 + np.exp(d @ w))[:, None]).sum(0) / (good.sum() * (~good).sum())
        w -= 0.5 * g
    assert loss(quality._bradley_terry(x, good, 3000, 1)) < loss(w) + 0.01


def test_the_query_keeps_what_scores_at_the_threshold(spark, tmp_path):
    rng = random.Random(19)
    rows = labelled(rng, 240)
    docs_of(spark, [(i, t) for i, (t, _) in enumerate(rows)]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(g), 0) for i, (_, g) in enumerate(rows[:200])], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    model = quality.fit(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    got = {r.doc_id: r.score for r in quality.query(spark, str(tmp_path)).collect()}
    want = {i: plain_score(model, t) for i, (t, _) in enumerate(rows)}
    want = {i: v for i, v in want.items() if v >= model.threshold}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-5 for i in got) and len(got) > 80


def test_quality_sample_is_bounded(spark):
    rng = random.Random(3)
    rows = labelled(rng, 80)
    docs = docs_of(spark, [(i, t) for i, (t, _) in enumerate(rows)])
    labels = spark.createDataFrame([(i, int(g), 0) for i, (_, g) in enumerate(rows)], "doc_id long, quality int, toxic int")
    assert isinstance(quality.fit(docs, labels, max_labelled=40), quality.Model)
    assert isinstance(quality.fit(docs, labels, max_chars=500), quality.Model)


def test_quality_is_fitted_on_all_labels(spark, monkeypatch):
    """A sign that only the last 1,000 of 7,000 labelled documents have, in the order of the hash that samples were drawn by; the same model wherever the sums are made."""
    rng = random.Random(23)
    ids = [r.id for r in spark.range(7000).orderBy(F.xxhash64("id"), "id").collect()]
    rows = [(i, prose(rng, 12) + (" $$$" if at < 6000 else " vilest") * (at % 3 == 0), int(at % 3 > 0)) for at, i in enumerate(ids)]
    docs = docs_of(spark, [(i, t) for i, t, _ in rows] + [(ids[0], rows[0][1]), (9999, "\u2003 ")])
    labels = spark.createDataFrame([(i, g, 0) for i, _, g in rows] + [(9999, 0, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    assert quality.term("vilest") in model.terms and model.holdout_accuracy > 0.99
    assert model.score(prose(rng, 12) + " vilest") < model.threshold <= model.score(prose(rng, 12))
    monkeypatch.setattr(quality, "LOCAL_BYTES", -1)
    apart = quality.fit(docs.repartition(5), labels)
    assert (apart.terms == model.terms).all() and apart.holdout_accuracy == model.holdout_accuracy
    assert np.allclose(apart.weights, model.weights, atol=0.05) and abs(apart.threshold - model.threshold) < 0.05


# -- near-dedup


def altered(rng, text, share):
    return " ".join(rng.choice(WORDS) if rng.random() < share else w for w in text.split())


def brute_groups(rows, threshold=bottomk.THRESHOLD):
    """{(id, text): (id, text) that stays} of every document in a group of two or more."""
    sets = {}
    for i, t in rows:
        w = re.findall(r"\w+", (t or "").lower())
        if i is not None and w:
            sets[i, t] = {tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))}
    hashed = lambda d: (d[0], np.uint64(xxhash.xxh64_intdigest(d[1], seed=42)).astype(np.int64))
    docs = sorted(sets, key=hashed)
    root = {d: d for d in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, a in enumerate(docs):
        for b in docs[k + 1 :]:
            if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)), key=hashed)
                root[y] = x
    group = {d: find(d) for d in docs}
    size = Counter(group.values())
    return {d: g for d, g in group.items() if size[g] > 1}


def found_groups(spark, rows, **options):
    docs = docs_of(spark, rows)
    texts = {(r.doc_id, r.k): r.text for r in docs.select("doc_id", "text", F.xxhash64("text").alias("k")).collect()}
    got = bottomk.groups(docs, **options).collect()
    assert len(got) == len({(r.doc_id, r.text_key) for r in got})
    return {(r.doc_id, texts[r.doc_id, r.text_key]): (r.kept_id, texts[r.kept_id, r.kept_key]) for r in got}


def corpus(rng):
    rows = [(i, prose(rng, rng.choice([3, 8, 30, 100, 400]))) for i in range(60)]
    i = 60
    for base in (5, 12, 20, 33):
        for _ in range(12):
            rows.append((i, altered(rng, rows[base][1], rng.choice([0, 0.01, 0.04, 0.2]))))
            i += 1
    passage = prose(rng, 60)
    for _ in range(30):
        rows.append((i, prose(rng, 80) + " " + passage + " " + prose(rng, 90)))
        i += 1
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_near_groups_equal_brute_force(spark, seed):
    rows = corpus(random.Random(seed))
    assert found_groups(spark, rows) == brute_groups(rows)


def test_near_groups_with_repeated_ids_equal_brute_force(spark):
    rng = random.Random(3)
    rows = corpus(rng)
    rows = [(rng.choice([i, i // 3, i // 3]), t) for i, t in rows]
    want = brute_groups(rows)
    assert found_groups(spark, rows) == want
    left = Counter((r.doc_id, r.text) for r in bottomk.drop_duplicates(docs_of(spark, rows)).collect())
    assert left == Counter({d: 1 for d in rows if want.get(d, d) == d})


def test_repeated_ids_lose_no_text(spark):
    x, z, other = "one two three four", "five six seven eight", "nine ten eleven twelve"
    out = bottomk.drop_duplicates(docs_of(spark, [(1, x), (1, z), (2, z), (3, other)])).collect()
    assert sorted((r.doc_id, r.text) for r in out) == sorted([(1, x), (1, z), (3, other)])


def test_blocks_of_long_lists_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(bottomk, "BLOCK", 5)
    rng = random.Random(12)
    passage, base = prose(rng, 40), prose(rng, 120)
    rows = [(i, prose(rng, rng.randint(15, 60)) + " " + passage) for i in range(40)]
    rows += [(100 + i, altered(rng, base, 0.1) + " " + passage) for i in range(30)]
    rows += [(200 + i, altered(rng, rows[i][1], 0.15)) for i in range(0, 40, 2)]
    assert found_groups(spark, rows) == brute_groups(rows)


def test_estimates_equal_sets():
    rng = np.random.default_rng(4)
    a, b = ([np.sort(rng.choice(300, rng.integers(1, bottomk.K + 1), replace=False)).astype(np.int64) for _ in range(200)] for _ in range(2))
    got = bottomk.estimates(*bottomk._padded(a), *bottomk._padded(b))
    for x, y, e in zip(a, b, got):
        union = sorted({*x} | {*y})[: bottomk.K]
        assert e == len([v for v in union if v in x and v in y]) / len(union)
    assert bottomk.needed(20) == 10 and bottomk.needed(32) == 16 and bottomk.needed(10**9) == 17 and bottomk.needed(1) == 1


def test_copies_with_a_tenth_of_the_words_changed_are_found(spark):
    rng = random.Random(9)
    rows = [(i, prose(rng, 400)) for i in range(40)]
    for i, text in rows[:40]:
        w = text.split()
        for k in rng.sample(range(len(w)), (20, 28, 34, 40)[i % 4]):
            w[k] = "changed" + w[k]
        rows.append((100 + i, " ".join(w)))
    got = {d[0]: k[0] for d, k in found_groups(spark, rows).items()}
    assert got == {i: i for i in range(40)} | {100 + i: i for i in range(40)}


def test_many_copies_of_a_copy(spark):
    rng = random.Random(4)
    base = prose(rng, 200)
    rows = [(i, base if i % 2 else altered(rng, base, 0.02)) for i in range(300)]
    assert {k[0] for k in found_groups(spark, rows).values()} == {0}
    assert bottomk.drop_duplicates(docs_of(spark, rows)).count() == 1


def test_dedup_defined_cases(spark):
    rng = random.Random(5)
    t, long = prose(rng, 50), prose(rng, 30_000)
    rows = [(1, t), (2, t), (3, None), (4, None), (5, ""), (6, ""), (6, ""), (7, "..."), (None, t), (None, t), (8, long), (9, long + " end"), (10, "one"), (11, "ONE!"), (12, "x y"), (12, "x y"), (13, "p q r"), (13, "a b c")]
    docs = docs_of(spark, rows)
    docs = docs.withColumn("id", docs.n_chars).withColumn("root", docs.lang).withColumn("row_of_text", docs.lang).withColumn("text_key", docs.doc_id).withColumn("kept_id", docs.doc_id)
    out = bottomk.drop_duplicates(docs)
    assert out.columns == docs.columns
    ids = sorted([r.doc_id for r in out.collect()], key=lambda x: (x is None, x))
    assert ids == [1, 3, 4, 5, 6, 6, 7, 8, 10, 12, 13, 13, None, None]
    assert bottomk.drop_duplicates(docs.limit(0)).count() == 0
    assert bottomk.groups(docs.limit(0)).count() == 0


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r.row: r.root for r in bottomk.components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


# -- decontamination


def brute_matches(docs, tests, window=13, near=11, slop=2):
    found = {}
    tok = lambda s: re.findall(r"\w+", (s or "").lower())
    for d, text in docs:
        w = tok(text)
        for item, t in set(tests):
            q = tok(t)
            if item is None or not q or not w:
                continue
            n = min(window, len(q))
            free = n * (window - near) // window
            for j in range(len(q) - n + 1):
                part = q[j : j + n]
                exact = any(w[s : s + n] == part for s in range(len(w) - n + 1))
                close = exact
                if free and not close:
                    close = any(sum(any(0 <= p < len(w) and w[p] == x for p in range(s + k - slop, s + k + slop + 1)) for k, x in enumerate(part)) >= n - free for s in range(-slop - 2, len(w)))
                if exact or close:
                    f = found.setdefault((d, item), [0, 0])
                    f[0] += exact
                    f[1] += close
    return {(d, i, *f) for (d, i), f in found.items()}


def test_matches_equal_brute_force(spark):
    rng = random.Random(6)
    tests = [(i, prose(rng, rng.choice([1, 3, 6, 7, 10, 13, 25, 40]))) for i in range(16)] + [(3, None), (None, prose(rng, 20)), (20, "")]
    docs = [(i, prose(rng, rng.randint(5, 200))) for i in range(60)]
    for i in range(60, 100):
        t = rng.choice([t for _, t in tests if t])
        w = t.split()
        how = rng.choice(["whole", "part", "changed", "moved", "upper"])
        if how == "part":
            w = w[rng.randint(0, 5) :]
        if how == "changed":
            w = [x if rng.random() > 0.07 else "other" for x in w]
        if how == "moved" and len(w) > 8:
            w.insert(rng.randint(1, len(w) - 1), "extra")
        t = " ".join(w).upper() if how == "upper" else " ".join(w)
        docs.append((i, rng.choice(["", prose(rng, 30) + ". "]) + t + rng.choice(["", "! " + prose(rng, 20)])))
    d, b = docs_of(spark, docs), spark.createDataFrame(tests, "item_id long, text string")
    want = brute_matches(docs, tests)
    for options in ({}, {"segment": 400}, {"test_chars": 300}, {"piece": 40}):
        got = {(r.doc_id, r.item_id, r.phrase_windows, r.near_windows) for r in positional.matches(d, b, **options).collect()}
        assert got == want
    assert len(want) > 20


def test_a_document_in_pieces_counts_as_one(spark):
    rng = random.Random(16)
    items = [(i, prose(rng, 30)) for i in range(6)]
    w = prose(rng, 500).split()
    for k, (_, t) in zip((0, 83, 188, 275, 360, 480), items):
        w[k : k + 30] = t.split()
    docs = [(1, " ".join(w)), (1, " ".join(w)), (2, " ".join(w[:100])), (3, " ".join(w + w))]
    tests = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(map(tuple, positional.matches(docs_of(spark, docs), tests).collect()))
    got = sorted(map(tuple, positional.matches(docs_of(spark, docs), tests, piece=90).collect()))
    assert got == want and len(got) == 6 * 3 + 2


def test_parts_of_a_text_cut_no_word(monkeypatch):
    from quarry.llm import common

    monkeypatch.setattr(common, "PART_CHARS", 10)
    text = "one twothreefourfive six, seven" + " x" * 30 + "y" * 40
    assert "".join(common.parts_of(text)) == text
    assert [w for p in common.parts_of(text) for w in re.findall(r"\w+", p)] == re.findall(r"\w+", text)
    assert list(common.parts_of("")) == []


def test_first_token(spark):
    item = "alpha beta gamma delta epsilon zeta eta"
    docs = docs_of(spark, [(1, item + " tail"), (2, "one two " + item)])
    got = {r.doc_id: r.first_token for r in positional.matches(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got == {1: 0, 2: 2}


def test_neighbours_in_the_index_do_not_join(spark):
    w = prose(random.Random(7), 40).split()
    docs = docs_of(spark, [(1, " ".join(w[:20])), (2, " ".join(w[20:]))])
    got = positional.matches(docs, spark.createDataFrame([(1, " ".join(w[14:27]))], "item_id long, text string"))
    assert got.count() == 0


def test_clean_defined_cases(spark):
    rng = random.Random(8)
    item = prose(rng, 30)
    rows = [(1, prose(rng, 50)), (2, "so " + item), (2, "so " + item), (None, item), (3, None), (4, ""), (5, "?!"), (6, prose(rng, 60_000) + " " + item), (7, prose(rng, 5))]
    docs = docs_of(spark, rows)
    docs = docs.withColumn("item_id", docs.doc_id).withColumn("text_key", docs.lang)
    tests = spark.createDataFrame([(1, item), (1, item), (2, None)], "item_id long, text string")
    out = positional.clean(docs, tests)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == [1, 3, 4, 5, 7]
    assert positional.clean(docs, tests.limit(0)).count() == len(rows)
    assert positional.clean(docs.limit(0), tests).count() == 0


def test_index_round_trip():
    rng = np.random.default_rng(1)
    for kind in (np.uint32, np.uint64):
        a = rng.integers(0, 1 << 31, 1000).astype(kind)
        assert (positional._unpack(positional._pack(a), kind) == a).all()


@pytest.mark.parametrize("own, merged, edges", [(9, 0, 0), (4, 79 * 80 // 2, 79)])
def test_near_dedup_a_shared_line_is_no_work(monkeypatch, own, merged, edges):
    """80 short texts share a line of 11 shingles: below the threshold their sketches aren't looked at, above it they give no more pairs than join them; batches cut the list anywhere."""
    rng, seen, real = np.random.default_rng(3), [], bottomk.estimates
    monkeypatch.setattr(bottomk, "estimates", lambda a, *rest: seen.append(len(a)) or real(a, *rest))
    line = rng.integers(1, 1 << 60, 11)
    rows = [{"value": v, "row": 100 * v + i, "g": 100 * v + i, "n": 11 + own, "left": 11, "sketch": np.sort(np.concatenate([line, rng.integers(1, 1 << 60, own)])), "part": 0, "p": 0, "q": 0} for v in (1, 2) for i in range(80)]
    table = pa.Table.from_pylist(rows)
    out = [b.to_pylist() for b in bottomk._compare(0.5, 4.0)(iter(table.to_batches(max_chunksize=33)))]
    assert sum(seen) == 2 * merged
    assert sum(map(len, out)) == 2 * edges
    assert len({e["a"] for b in out for e in b} | {e["b"] for b in out for e in b}) == (160 if edges else 0)
