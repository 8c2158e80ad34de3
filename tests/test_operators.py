"""Operators that SQL doesn't reach: fixtures of the survey, and brute force."""

import json
import random

import numpy as np
import pytest

from quarry.functions import vectors as V
from quarry.operators import checks, chunker, clustering, embedding, graph, incremental, lexical, vector_index
from quarry.sources import metadata, snapshots, texts, vector_files


# -- lexical


def test_words_and_numbers():
    known = {9111}.__contains__
    assert lexical.plan_words(["dns", "9111"], known) == (9111, [])
    assert lexical.plan_words(["9111", "zzz"], known) == (9111, ["zzz"])
    assert lexical.plan_words(["dns", "9112"], known) == (None, ["dns", "9112"])
    assert lexical.plan_words(["ip"], known) == (None, ["ip"]) and lexical.plan_words(["ip", "foo"], known) == (None, ["foo"])


def test_request_round_trip():
    r = lexical.Request.parse("?search=red+bolt&level=std,exp&ft=")
    assert r.words == ["red", "bolt"] and r.tags == {"level": "exp"} and r.full_text and not r.obsolete
    assert lexical.Request.parse(r.unparse()) == r
    assert r.toggle("level", "exp").tags == {} and r.toggle("level", "std").tags == {"level": "std"}
    assert lexical.Request(["5g"]).active() and not lexical.Request(["ip"]).active() and not lexical.Request().active()


def test_prefix_rules(spark):
    docs = spark.createDataFrame([(1, "IP over Foo", ["key exchange"]), (2, None, None), (3, "(Food) tables", [])], "doc_num int, title string, keywords array<string>").withColumn("doc_id", __import__("pyspark").sql.functions.col("doc_num"))
    find = lambda *w: sorted(r.doc_id for r in lexical.search(docs, list(w), lambda n: n in (1, 2, 3)).collect())
    assert find("ip") == [] and find("foo") == [1, 3] and find("exchange") == [] and find("key") == [1] and find("key ex") == [1]
    index = lexical.postings(docs)
    assert {r.doc_id: r.by_title for r in lexical.lookup(index, "Foo").collect()} == {1: 1, 3: 1}


# -- graph


def test_diamond_counts_paths(spark):
    docs = spark.createDataFrame([("A",), ("B",), ("C",), ("D",), ("E",)], "doc_id string")
    edges = spark.createDataFrame([(f"s{i}", d, True) for d, n in zip("ABCD", (1, 2, 4, 8)) for i in range(n)], "src string, dst string, normative boolean")
    old = spark.createDataFrame([("A", "B"), ("A", "C"), ("B", "D"), ("C", "D")], "doc_id string, old string")
    got = {r.doc_id: r.refs for r in graph.inherited_counts(docs, edges, old).collect()}
    assert got == {"A": 23, "B": 10, "C": 12, "D": 8, "E": 0}
    assert graph.inherited_list(docs, edges, old).where("doc_id = 'A'").count() == 23
    with pytest.raises(graph.Cycle):
        graph.walk(docs, spark.createDataFrame([("A", "B"), ("B", "A")], "doc_id string, old string"))


# -- chunker


def test_headings():
    assert chunker.skipped("Author's Address") and chunker.skipped("Normative References") and not chunker.skipped("URI References")
    assert chunker.number("1.0") == chunker.number("1")
    assert chunker.follows((2,), (3,)) and not chunker.follows((2,), (23,)) and chunker.follows((2,), (2, 1)) and not chunker.follows((2,), (2, 1, 1))


def test_packing():
    assert chunker.pack([700, 700, 300]) == [[0, 1], [2]]
    assert chunker.pack([700, 400, 300, 200]) == [[0, 1, 2], [2, 3]]
    assert chunker.pack([]) == [] and chunker.pack([5]) == [[0]]


@pytest.mark.parametrize("seed", range(20))
def test_chunks_are_bytes_of_the_source(seed):
    rng = random.Random(seed)
    lines = []
    for _ in range(rng.randint(1, 80)):
        kind = rng.random()
        if kind < 0.15:
            lines += ["", f"{rng.randint(1, 4)}. {rng.choice(['Größe', 'Scope', 'References', 'Terms'])}", ""]
        elif kind < 0.3:
            lines.append("")
        else:
            lines.append(rng.choice(["", "   "]) + " ".join(rng.choice(["über", "the", "value.", "A", "naïve", "token", "e.g.", "日本"]) for _ in range(rng.randint(1, 400))))
    text = "\n".join(lines)
    raw = text.encode()
    for _, _, at, n, body in chunker.chunk_text(text):
        assert len(body) <= chunker.CAP and len(body.strip()) >= chunker.SHORTEST
        piece = raw[at : at + n].decode()  # whole characters
        assert body.split()[0] in piece and body.split()[-1] in piece


def test_documents_are_isolated(spark):
    docs = spark.createDataFrame([("1", b"Introduction\n\n" + "Größe ist wichtig, sagt man hier.".encode()), ("2", b"\xff\xfe caf\xe9 is latin text here, all of it"), ("3", None), ("4", b"")], "doc_id string, content binary")
    chunks, rejects = chunker.chunk_documents(docs)
    assert {r.doc_id for r in chunks.collect()} == {"1", "2"} and rejects.count() == 0


# -- vectors


def test_top_indices():
    top = lambda s, n: vector_index.best(np.array(s, float), n).tolist()
    assert sorted(top([3, 9, 1, 7, 5], 3)) == [1, 3, 4] and top([5, 5, 5], 2) == [0, 1] and top([1], 0) == [] and top([1], -1) == [] and top([1, 2], 9) == [1, 0]


def test_quantise_half_even(spark):
    df = spark.createDataFrame([([0.5, 1.5, 200.0, -200.0],)], "v array<double>").select(V.quantise(__import__("pyspark").sql.functions.col("v"), 1.0).alias("q"))
    assert df.first().q == [0, 2, 127, -127]


def test_two_cluster_search(spark):
    vec = spark.createDataFrame([(9111, 0, [127, 0, 0, 0]), (9110, 0, [90, 90, 0, 0]), (2616, 1, [0, 127, 0, 0])], "id long, cluster_id long, q array<tinyint>")
    cen = spark.createDataFrame([(0, [100, 0, 0, 0]), (1, [0, 100, 0, 0])], "id long, q array<tinyint>")
    find = lambda q, n: [r.id for r in vector_index.ivf_search(vec, spark.createDataFrame([(1, q)], "id long, q array<tinyint>"), cen, n).orderBy("rank").collect()]
    assert find([1, 0, 0, 0], 2) == [9111, 9110, 2616] and find([1, 0, 0, 0], 1) == [9111, 9110] and find([0, 1, 0, 0], 1) == [2616]


def test_kmeans_invariants(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(400, 8)) + np.array([[6] + [0] * 7])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    cen = clustering.split_oversized(df, clustering.kmeans(df, 6), 0.01)
    q = lambda d: d.select("id", V.quantise(d.v, 0.01).alias("q"))
    owner = vector_index.assign(q(df), q(cen))
    assert checks.coverage(df, owner).first().ok
    c = {r.id: np.array(r.q, float) for r in q(cen).collect()}
    for r in owner.join(q(df), "id").collect():
        s = {k: x @ np.array(r.q, float) for k, x in c.items()}
        assert s[r.cluster_id] == max(s.values())


def test_pooling():
    h = np.array([[[3.0, 4], [0, 2], [9, 9]]])
    assert np.allclose(embedding.pool(h, np.array([[1.0, 1, 0]]), "cls"), [[0.6, 0.8]])
    assert np.allclose(embedding.pool(h, np.array([[1.0, 1, 0]]), "mean"), [[1.5 / np.hypot(1.5, 3), 3 / np.hypot(1.5, 3)]])


# -- incremental builds, checks


def test_cache_is_reused(spark):
    chunks = spark.createDataFrame([(i, f"text {i % 4}") for i in range(12)], "doc_id long, text string")
    run = lambda d: embedding.embed(d, embedding.HashingEncoder())
    empty = spark.createDataFrame([], "content_hash string, v array<float>")
    with pytest.raises(ValueError):
        incremental.update_cache(chunks, empty, run)
    cache = incremental.update_cache(chunks, empty, run, None)
    assert cache.count() == 4 and incremental.todo(chunks, cache).count() == 0 and incremental.attach(chunks, cache).count() == 12
    a, b = incremental.fingerprint("x = 1", {"cap": 1}), incremental.fingerprint("x  =\n1", {"cap": 2})
    assert incremental.reuse_forbidden(a, a) is None and "opts" in incremental.reuse_forbidden(a, b) and incremental.reuse_forbidden(None, a)


def test_build_rules():
    checks.check_build(10, 0.1, 5, 5)
    for bad in ((10_000, 0.1, 5, 5), (10, 0, 5, 5), (10, 0.1, 6, 5), (10, 0.1, 4, 5)):
        with pytest.raises(ValueError):
            checks.check_build(*bad)
    checks.check_build(10, 0.1, 4, 5, allow_partial=True)


# -- sources and sinks


def test_xml_index(spark, tmp_path):
    (tmp_path / "i.xml").write_text(
        "<rfc-index><rfc-entry><doc-id>RFC0007</doc-id><title>Host &amp; IMP</title><keywords><kw> a b </kw></keywords><obsoletes><doc-id>RFC0003</doc-id></obsoletes><current-status>UNKNOWN</current-status><stream>Legacy</stream></rfc-entry>"
        "<rfc-not-issued-entry><doc-id>RFC0014</doc-id></rfc-not-issued-entry>"
        "<rfc-entry><doc-id>RFC0003</doc-id><title>Old</title><obsoleted-by><doc-id>RFC0007</doc-id></obsoleted-by><current-status>PROPOSED STANDARD</current-status><stream>IETF</stream><wg_acronym>NON WORKING GROUP</wg_acronym></rfc-entry></rfc-index>"
    )
    got = {r.doc_id: r for r in metadata.read_index(spark, str(tmp_path / "i.xml")).collect()}
    assert set(got) == {"RFC7", "RFC3"}
    assert got["RFC7"].obsoletes == ["RFC3"] and got["RFC7"].level == "unkn" and got["RFC7"].keywords == ["a b"] and got["RFC7"].status == "current"
    assert got["RFC3"].status == "obsoleted" and got["RFC3"].wg is None and got["RFC3"].stream == "ietf" and got["RFC3"].level == "std"


def test_repeated_element_is_an_error(spark, tmp_path):
    (tmp_path / "i.xml").write_text("<i><rfc-entry><doc-id>RFC1</doc-id><title>a</title><title>b</title><current-status>UNKNOWN</current-status><stream>x</stream></rfc-entry></i>")
    with pytest.raises(Exception, match="repeated element"):
        metadata.read_index(spark, str(tmp_path / "i.xml")).collect()


def test_tag_files(spark, tmp_path):
    (tmp_path / "a").write_text("name: April 1\ncolour #ABC\ncolour #def\nRFC0748 randomly lose\nrfc748 again\nRFCx bad\nother line\n")
    (tmp_path / "b").write_text("RFC12 x\n")
    tags, members, rejects = metadata.read_tag_files(spark, str(tmp_path))
    assert {(r.tag_name, r.colour) for r in tags.collect()} == {("April 1", "#abc"), ("b", None)}
    assert {(r.tag_name, r.doc_id) for r in members.collect()} == {("April 1", "RFC748"), ("b", "RFC12")}
    assert [r.line for r in rejects.collect()] == ["RFCx bad"]


def test_references_and_texts(spark, tmp_path):
    (tmp_path / "refs.json").write_text(json.dumps({"7": {"normative": ["3", "RFC12"], "informative": []}}))
    assert {(r.src, r.dst, r.normative) for r in metadata.read_references(spark, str(tmp_path / "refs.json")).collect()} == {("RFC7", "RFC3", True), ("RFC7", "RFC12", True)}
    (tmp_path / "rfc10.txt").write_bytes("Größe".encode())
    (tmp_path / "rfc9.txt").write_bytes(b"caf\xe9")
    got = texts.read_texts(spark, str(tmp_path)).collect()
    assert [(r.doc_id, r.text, r.latin) for r in got] == [("9", "café", True), ("10", "Größe", False)]


def test_vector_files(spark, tmp_path):
    rows = [("9111", 0, 5, "3", "Storing"), ("x", 5, 7, None, "Abstract")]
    raw = vector_files.write_cluster(4, np.array([[1, -2], [3, 4]]), rows)
    assert [(r[2], r[5], r[6], r[7]) for r in vector_files.read_cluster(raw, 2, 4)] == [("9111", "3", "Storing", [1, -2]), ("x", None, "Abstract", [3, 4])]
    head = vector_files.pack_header(b"RFCC", 2, 2, 4, 9)
    bad = [raw[:10], b"XXXX" + raw[4:], raw[:4] + b"\2\0" + raw[6:], raw[:-1], head + raw[24:28] + b"not json!"]
    for b in bad:
        with pytest.raises(vector_files.Corrupt):
            list(vector_files.read_cluster(b, 2, 4))
    for dims, ident in ((3, 4), (2, 5)):
        with pytest.raises(vector_files.Corrupt):
            list(vector_files.read_cluster(raw, dims, ident))
    df = spark.createDataFrame([(4, 2, *rows[1], [3, 4]), (4, 1, *rows[0], [1, -2])], "cluster_id int, id long, doc_id string, offset long, length long, section string, title string, q array<tinyint>")
    vector_files.write_clusters(df, str(tmp_path / "c"))
    assert (tmp_path / "c" / "0004.bin").read_bytes() == raw
    assert [r.doc_id for r in vector_files.read_clusters(spark, str(tmp_path / "c"), 2).orderBy("row").collect()] == ["9111", "x"]
    assert vector_files.path_of("{id:04d}", 7) == "0007" and vector_files.path_of("{id:02d}", 12345) == "12345"


def test_snapshots(spark, tmp_path):
    root, t = str(tmp_path / "s"), spark.range(3)
    for b in ("20240101T000000Z", "20240102T000000Z", "20240103T000000Z"):
        snapshots.publish(root, b, {"t": t}, {"quant": {"scale": 0.1}})
    assert snapshots.current(root) == "20240103T000000Z" and snapshots.check(root) == []
    with pytest.raises(ValueError):
        snapshots.publish(root, "20230101T000000Z", {"t": t}, {})
    with pytest.raises(Exception):  # nothing stays of a failed build
        snapshots.publish(root, "20240104T000000Z", {"t": t, "u": spark.sql("SELECT raise_error('no') AS x")}, {})
    assert snapshots.current(root) == "20240103T000000Z"
    manifest, table = snapshots.open_build(spark, root)
    assert manifest["build"] == "20240103T000000Z" and table("t").count() == 3
    assert snapshots.vacuum(root, 2, {"20240101T000000Z"}) == [] and snapshots.vacuum(root) == ["20240101T000000Z"]


def test_streamed_texts_are_added_once(spark, tmp_path):
    from quarry.streaming import ingest

    come, table, at = (str(tmp_path / x) for x in ("in", "table", "at"))
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id long, text string")
    for _ in range(2):
        rows.write.mode("append").parquet(come)
        ingest.upsert_texts(spark, come, table, at).awaitTermination()
    assert spark.read.parquet(table).count() == 2


def test_windowed_counts(spark):
    from quarry.streaming import ingest

    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert ingest.windowed_counts(ev).agg({"n": "sum"}).first()[0] == ev.count()


def test_hashing_encoder(monkeypatch):
    """As each word and triple alone, with words kept or forgotten; a word that recurs is hashed once."""
    import zlib

    def plain(t):
        row = np.zeros(64, np.float32)
        for w in t.lower().split():
            for part in [w, *(w[i : i + 3] for i in range(len(w) - 2))]:
                h = zlib.crc32(part.encode())
                row[h % 64] += 1 if h & 0x10000 else -1
        return row / max(np.linalg.norm(row), 1e-12)

    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcXYZ09-_é√ü日İ" if rng.random() < 0.3 else "abcde") for _ in range(rng.choice([1, 2, 3, 4, 9, 150])))
    words = [word() for _ in range(300)]
    texts_ = ["", " \n", "a", "ab abc"] + [" ".join(rng.choices(words, k=rng.randrange(400))) for _ in range(40)]
    want = np.array([plain(t) for t in texts_])
    encoder = embedding.HashingEncoder()
    assert np.array_equal(encoder(texts_), want) and np.array_equal(encoder(texts_), want)
    monkeypatch.setattr(embedding.HashingEncoder, "KEPT", 60)
    monkeypatch.setattr(embedding.HashingEncoder, "AT_ONCE", 50)
    small = embedding.HashingEncoder()
    assert np.array_equal(small(texts_), want) and len(small._places) <= 60 and np.array_equal(small([None, "a"]), [want[0], want[2]]) and small([]).shape == (0, 64)
    calls, real = [], zlib.crc32
    monkeypatch.setattr(zlib, "crc32", lambda x: calls.append(x) or real(x))
    embedding.HashingEncoder()(["größer weit größer"] * 50)
    assert len(calls) == 2
