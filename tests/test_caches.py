"""Clustering, the vector cache, published builds and their checks, the serving cache, reports."""

import json
import os
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import cluster_cache, clustering, embedding, evaluation, vector_index
from quarry.sources import snapshots, vector_cache


def points(n=400, dims=8, seed=1):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dims)) + np.array([[6] + [0] * (dims - 1)])
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def vectors(spark, v):
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")


# -- clustering


def test_seeds_are_spread_and_distinct():
    v = np.concatenate([points(200, 4, s) + off for s, off in ((1, 0), (2, -9))])
    v = clustering.unit(v)
    got = clustering.seeds(v, 2, np.random.default_rng(3))
    assert got[0] @ got[1] < 0  # one on each side
    assert len(np.unique(clustering.seeds(np.eye(5, dtype=np.float32), 9, np.random.default_rng(1)), axis=0)) == 5
    assert len(clustering.seeds(np.tile([[1.0, 0]], (6, 1)).astype(np.float32), 3, np.random.default_rng(1))) == 3


def test_passes_equal_plain_lloyd(spark):
    v = points(300, 6).astype(np.float32)
    start = clustering.seeds(v, 5, np.random.default_rng(2))
    want = start
    for _ in range(3):
        own = np.argmax(v @ want.T, axis=1)
        want = clustering.unit(np.array([v[own == k].sum(0) if (own == k).any() else want[k] for k in range(5)]))
    assert np.allclose(clustering.lloyd(vectors(spark, v), start, 3), want, atol=1e-5)


def test_a_dead_centre_begins_again(spark):
    v = points(100, 4)
    far = np.array([[-1.0, 0, 0, 0]], np.float32)
    got = clustering.lloyd(vectors(spark, v), np.concatenate([clustering.unit(v[:2]), far]), 2)
    assert got[2] @ far[0] < 0 and np.allclose(np.linalg.norm(got, axis=1), 1, atol=1e-5)


def test_builds_assign_to_the_nearest_and_keep_their_centres(spark):
    v = np.concatenate([points(300, 8), points(60, 8, 5) * np.array([-1] + [1] * 7)])
    df = vectors(spark, v)
    owner, centres, told = clustering.build(df, 6)
    scale = told["quant"]["scale"]
    c = {r.id: np.clip(np.rint(np.array(r.v) / scale), -127, 127) * scale for r in centres.collect()}
    keys = sorted(c)
    best = np.argmax(v @ np.array([c[k] for k in keys]).T, axis=1)
    got = {r.id: r.cluster_id for r in owner.collect()}
    assert np.mean([got[i] == keys[b] for i, b in enumerate(best)]) > 0.99 and told["vectors"] == 360 and told["clusters"]["over_cap"] == 0
    new = vectors(spark, points(50, 8, 9))
    owner2, centres2, told2 = clustering.rebuild(new, centres, told)
    assert told2["quant"] == told["quant"] and told2["fidelity_chain"] == [told["fidelity"]] and told2["reused_centres"] and centres2 is centres
    assert clustering.rebuild(new, centres, told2)[2]["fidelity_chain"] == [told["fidelity"], told2["fidelity"]] and owner2.count() == 50


def test_large_clusters_are_split(spark):
    v = np.concatenate([points(500, 6), np.eye(6)[1:] * -1])
    df = vectors(spark, clustering.unit(v).astype(float))
    start = clustering.table(df, clustering.unit(np.concatenate([np.eye(6)[:1], -np.eye(6)[1:]])))
    got = clustering.split_oversized(df, start, 0.01)
    sizes = [r["count"] for r in clustering.assign(df, got, 0.01).groupBy("cluster_id").count().collect()]
    assert got.count() > 6 and max(sizes) <= 3 * 505 / 6


def test_recall_report(spark):
    t = spark.createDataFrame([(1, 5), (1, 6), (2, 5), (2, 6)], "query_id long, id long")
    f = spark.createDataFrame([(1, 5), (1, 6), (2, 9)], "query_id long, id long")
    r = vector_index.recall_report(f, t, spark.createDataFrame([(1, 10), (2, 30)], "query_id long, n long"), 100).first()
    assert tuple(r) == (2, 0.5, 0.0, 20.0, 0.2)


# -- the vector cache


def test_an_interrupted_run_goes_on(spark, tmp_path):
    folder, calls = str(tmp_path / "cache"), []
    texts = spark.createDataFrame([(f"h{i:03d}", f"text {i}") for i in range(90)], "content_hash string, text string")

    def encode(df):
        calls.append(df.count())
        if len(calls) == 3:
            raise RuntimeError("cut off")
        return df.select("content_hash", F.array(F.length("text").cast("float")).alias("v"))

    with pytest.raises(RuntimeError):
        vector_cache.resume(texts, folder, encode, batches=6)
    done = vector_cache.load(spark, folder).count()
    assert 0 < done == sum(calls[:2]) < 90
    assert vector_cache.resume(texts, folder, encode, batches=6) == 4 and vector_cache.load(spark, folder).count() == 90
    assert sum(calls) == 90 + calls[2] and vector_cache.resume(texts, folder, encode, batches=6) == 0

    order = vector_cache.places(texts)
    assert [tuple(r) for r in order.orderBy("row_id").collect()] == [(i, f"h{i:03d}") for i in range(90)]
    rows = vector_cache.finish(order, folder, str(tmp_path / "done"), rows_per_file=20)
    assert len(rows.inputFiles()) == 5 and rows.count() == 90
    rows = vector_cache.finish(order.where("row_id < 30"), folder, str(tmp_path / "done"), rows_per_file=20)
    assert len(rows.inputFiles()) == 2  # none is left of the longer one
    with pytest.raises(ValueError, match="1 contents"):
        vector_cache.finish(order.limit(3).union(spark.createDataFrame([(7, "none")], "row_id long, content_hash string")), folder, str(tmp_path / "x"))


def test_blocks_and_gathers(spark):
    rows = spark.createDataFrame([(i, f"h{i}", [float(i), 1.0]) for i in range(50)], "row_id long, content_hash string, v array<float>")
    assert [r.row_id for r in vector_cache.block(rows, 10, 13).collect()] == [10, 11, 12] and vector_cache.block(rows, 50, 60).count() == 0
    want = spark.createDataFrame(list(enumerate([7, 3, 7, 49])), "place int, row_id long")
    assert [r.v[0] for r in vector_cache.take(rows, want).collect()] == [7, 3, 7, 49]
    with pytest.raises(Exception, match="no such row: 99"):
        vector_cache.take(rows, spark.createDataFrame([(0, 99)], "place int, row_id long")).collect()
    assert vector_cache.check_dims(rows, 2).count() == 50
    with pytest.raises(Exception, match="wrong dimensions"):
        vector_cache.check_dims(rows, 3).collect()


# -- builds


def build(spark, root, name="20260101T000000Z", **more):
    v = spark.createDataFrame([(i, i % 3, [1.0]) for i in range(30)], "id long, cluster_id long, v array<double>")
    return snapshots.publish(root, name, {"vectors": v}, {"clusters": {"count": 3, "empty": 0}, "quant": {"scale": 0.1}} | more, {"vectors": "cluster_id"}, required=("vectors",))


def test_manifests_tell_files_and_bytes(spark, tmp_path):
    root = str(tmp_path)
    folder = build(spark, root)
    told = snapshots.previous_manifest(root)
    assert snapshots.check(root) == [] and told["files"] == {"vectors": 3} and told["bytes"]["vectors"] > 0
    os.remove(next(os.path.join(d, f) for d, _, fs in os.walk(folder) for f in fs if f.endswith(".parquet")))
    assert any("2 files" in x for x in snapshots.check(root))
    os.makedirs(tmp_path / "20260102T000000Z")
    assert any("without a manifest" in x for x in snapshots.check(root))
    with pytest.raises(ValueError, match="is empty"):
        snapshots.publish(root, "20260103T000000Z", {"vectors": spark.range(0)}, {}, required=("vectors",))
    assert snapshots.current(root) == "20260101T000000Z"
    assert snapshots.previous_manifest(str(tmp_path / "none")) == {}


@pytest.mark.parametrize("more,fault", [({"clusters": {"count": 5}}, "3 clusters have files"), ({"dims": 4, "centroid_bytes": 13}, "centroids' size"), ({"needs_sources": True}, "sources.json"), ({"quant": {"scale": 0}}, "scale")])
def test_faults_of_a_build(spark, tmp_path, more, fault):
    build(spark, str(tmp_path), **more)
    assert [x for x in snapshots.check(str(tmp_path)) if fault in x]


def test_preload_is_all_or_nothing(spark, tmp_path):
    build(spark, str(tmp_path))
    held = snapshots.preload(spark, str(tmp_path), ["vectors"])
    assert held["vectors"].is_cached
    held["vectors"].unpersist()
    with pytest.raises(Exception):
        snapshots.preload(spark, str(tmp_path), ["vectors", "absent"])
    assert not spark.read.parquet(os.path.join(snapshots.resolve(str(tmp_path)), "vectors")).is_cached


def test_small_json_files(spark, tmp_path):
    df = spark.createDataFrame([("B", "b", None), ("A", "a", [1, 2])], "doc_id string, title string, n array<int>")
    assert snapshots.write_documents_json(df, str(tmp_path / "d.json")) == 2
    assert (tmp_path / "d.json").read_text() == '{"A": {"n": [1, 2], "title": "a"}, "B": {"title": "b"}}'
    assert snapshots.read_json_file(str(tmp_path / "none.json"), []) == []
    with pytest.raises(FileNotFoundError):
        snapshots.read_json_file(str(tmp_path / "none.json"))
    (tmp_path / "q.json").write_text(json.dumps([{"query": "x", "relevant": [5]}, {"query": "y"}]))
    assert [tuple(r) for r in snapshots.read_queries(spark, str(tmp_path / "q.json")).collect()] == [(0, "x", ["5"]), (1, "y", [])]
    entries = {"/i/20260101T000000Z/a": 1, "/i/20260102T000000Z/a": 2, "/i/_CURRENT": 3}
    assert snapshots.prune_cache(entries, "20260102T000000Z") == ["/i/20260101T000000Z/a"] and len(entries) == 2
    (tmp_path / "app.js").write_text("v=r7")
    (tmp_path / "empty.js").write_text("")
    assert snapshots.check_assets(str(tmp_path), ["app.js", "empty.js", "no.js"], "r7") == ["empty.js is empty", "no.js is missing"]
    assert snapshots.check_assets(str(tmp_path), ["app.js"], "r8") == ["app.js isn't stamped r8"]
    assert len(snapshots.commit_of(os.path.dirname(os.path.dirname(__file__))) or "x" * 40) == 40 and snapshots.commit_of(str(tmp_path / "none")) is None


# -- the serving cache


def test_a_cluster_is_fetched_once_and_the_oldest_go():
    started, go, asked = threading.Barrier(5), threading.Event(), []

    def load(c):
        asked.append(c)
        go.wait(5)
        return f"cluster {c}", 10

    cache = cluster_cache.ClusterCache(load, most=2)
    out = []
    threads = [threading.Thread(target=lambda: (started.wait(), out.append(cache.get(1)))) for _ in range(4)]
    for t in threads:
        t.start()
    started.wait()
    go.set()
    for t in threads:
        t.join()
    assert out == ["cluster 1"] * 4 and asked == [1] and cache.stats() == {"fetches": 1, "hits": 3, "bytes": 10, "held": 1}
    for c in (2, 1, 3, 1, 2):
        cache.get(c)
    assert asked == [1, 2, 3, 2] and cache.stats()["held"] == 2


def test_a_failed_fetch_is_not_kept():
    fail = [True]

    def load(c):
        if fail[0]:
            raise OSError("gone")
        return c, 1

    cache = cluster_cache.ClusterCache(load)
    with pytest.raises(OSError):
        cache.get(5)
    fail[0] = False
    assert cache.get(5) == 5 and cache.stats()["fetches"] == 2


def test_counters_of_a_search(spark):
    probes = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "query_id long, cluster_id long")
    df, seen = cluster_cache.observed(probes, spark.createDataFrame([(0, 100), (1, 50)], "cluster_id long, bytes long"))
    assert df.count() == 3 and seen.get == {"probes": 3, "clusters": 2, "bytes": 250}


# -- encoders and reports


def test_onnx_encoder_with_a_session_of_its_own(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    t = Tokenizer(models.WordLevel({"[UNK]": 0, "a": 1, "b": 2, "c": 3}, unk_token="[UNK]"))
    t.pre_tokenizer = pre_tokenizers.Whitespace()
    t.save(str(tmp_path / "t.json"))
    fed = []

    class Session:
        def __init__(self, path):
            assert path == "model"

        def get_inputs(self):
            return [type("I", (), {"name": n}) for n in ("input_ids", "attention_mask")]

        def run(self, _, feed):
            fed.append(feed)
            return [np.eye(4)[feed["input_ids"]] + feed["attention_mask"][..., None] * 0.0]

    for pooling, want in (("cls", [[0, 1, 0, 0], [0, 0, 1, 0]]), ("mean", [[0, 2, 1, 0], [0, 0, 1, 0]])):
        e = embedding.OnnxEncoder("model", str(tmp_path / "t.json"), embedding.ModelSpec("x", pooling, "", 3, 4), Session)
        got, want = e(["a a b c c", "b"]), np.array(want, float)
        assert np.allclose(got, want / np.linalg.norm(want, axis=1, keepdims=True)) and e.truncated == 1
    assert fed[0].keys() == {"input_ids", "attention_mask"} and fed[0]["input_ids"].shape == (2, 3) and fed[0]["attention_mask"].tolist() == [[1, 1, 1], [1, 0, 0]]
    assert embedding.variant("minilm-l6", "q4")[1] == "model_q4.onnx"
    for bad in (("none", "q4"), ("minilm-l6", "q3")):
        with pytest.raises(KeyError, match="there are"):
            embedding.variant(*bad)


def test_reports(spark):
    one, worst = evaluation.separation_report(spark.createDataFrame([(i, i / 10) for i in range(8)], "pair_id long, separation double"), 2)
    assert one.first().least == 0 and [r.pair_id for r in worst.collect()] == [0, 1]
    docs = spark.createDataFrame([("a",), ("b",), ("c",)], "doc_id string")
    chunks = spark.createDataFrame([("a", "x" * 10), ("a", "x" * 50), ("b", "x" * 20)], "doc_id string, text string")
    r = evaluation.chunk_report(chunks, docs, docs.limit(1), budget=10).first()
    assert (r.files, r.chunks, r.mean, r.median, r.most, r.without, r.longest, r.errors) == (3, 3, 1.0, 1.0, 2, 1, 50, 1) and abs(r.over_budget - 1 / 3) < 1e-9
    t = evaluation.token_report(spark.createDataFrame([(1,), (5,), (8,)], "n int"), 5).first()
    assert (t.texts, t.truncated, t.most) == (3, 2, 8)


def test_chunks_from_the_command_line(spark, tmp_path, capsys, monkeypatch):
    from quarry import chunks
    from quarry.operators import chunker

    monkeypatch.setattr(chunks, "session", lambda *a: spark)
    (tmp_path / "in").mkdir()
    body = "\n\n".join("   " + " ".join(f"word{i}" for i in range(k, k + 60)) + "." for k in range(0, 900, 60))
    (tmp_path / "in/rfc1.txt").write_text("1.  Introduction\n\n" + body)
    (tmp_path / "in/rfc2.txt").write_text("\n")
    assert chunks.main([str(tmp_path / "in"), "--out", str(tmp_path / "out"), "--sources", str(tmp_path / "src"), "--stats", "--token-budget", "150", "--chars-per-token", "4", "--no-overlap"]) == 0
    told = json.loads(capsys.readouterr().out.strip().split("\n")[-1])
    assert told["files"] == 2 and told["without"] == 1 and told["longest"] <= 600 and told["over_budget"] == 0 and told["chunks"] > 5
    assert spark.read.json(str(tmp_path / "src")).count() == 2
    o = chunks.options_of(chunks.parser().parse_args(["x", "--keep-acks", "--target", "900"]))
    assert o == chunker.Options(target=900, keep_thanks=True) and o.fitted() is o
