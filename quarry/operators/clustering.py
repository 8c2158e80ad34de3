"""Spherical k-means for the vector index: seeds, minibatches, passes over all vectors, splits, and builds that keep their centres.

Seeds and minibatches work on a sample of bounded size on the driver; passes, sizes and assignment work
on all vectors, and bring one row for each centre to the driver. vectors: (id, v); centres: an array (k, dims).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vectors as V
from ..storage import kept
from . import vector_index

#: Rows of the sample for seeds, and of one for a cluster that is split; minibatches and rows of each.
SEED_ROWS, BATCHES, BATCH = 10_000, 300, 8192
#: A cluster above CAP times the mean is split into parts of AIM of that at most.
CAP, AIM, ROUNDS, PASSES = 3.0, 0.75, 6, 8


def unit(m: np.ndarray) -> np.ndarray:
    return (m / np.maximum(np.linalg.norm(m, axis=-1, keepdims=True), 1e-12)).astype(np.float32)


def _rows(df: DataFrame, column: str = "v") -> np.ndarray:
    t = df.select(F.col(column).cast("array<float>").alias("v")).toArrow()["v"].combine_chunks()
    return np.asarray(t.flatten()).reshape(len(t), -1) if len(t) else np.zeros((0, 0), np.float32)


def sample(vectors: DataFrame, rows: int, salt: int = 0) -> np.ndarray:
    """The vectors with the least hash of their id: bounded, and the same on every run."""
    return _rows(vectors.where("v is not null").orderBy(F.xxhash64("id", F.lit(salt)), "id").limit(rows))


def seeds(points: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k of the points, each drawn with a chance in proportion to its squared distance from those drawn before; fewer if there are fewer points."""
    k = min(k, len(points))
    chosen = [int(rng.integers(len(points)))] if k else []
    gap = np.full(len(points), np.inf)
    while len(chosen) < k:
        gap = np.minimum(gap, np.clip(2 - 2 * (points @ points[chosen[-1]]).astype(np.float64), 0, None))
        gap[chosen] = 0
        left = np.setdiff1d(np.arange(len(points)), chosen)
        chosen.append(int(rng.choice(len(points), p=gap / gap.sum())) if gap.sum() > 0 else int(rng.choice(left)))
    return unit(points[chosen])


def group_sums(points: np.ndarray, owner: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(sum, number) of the points of each owner."""
    n = np.bincount(owner, minlength=k)
    total = np.zeros((k, points.shape[1]), np.float64)
    order = np.argsort(owner, kind="stable")
    there = np.flatnonzero(n)
    if len(there):
        total[there] = np.add.reduceat(points[order].astype(np.float64), (np.cumsum(n) - n)[there])
    return total, n


def minibatches(points: np.ndarray, centres: np.ndarray, batches: int, size: int, rng: np.random.Generator) -> np.ndarray:
    """Centres moved towards the means of random batches, each at the rate of the batch's share in all it has seen."""
    centres, seen = centres.copy(), np.ones(len(centres))
    for _ in range(batches):
        some = points[rng.integers(0, len(points), min(size, len(points)))]
        total, n = group_sums(some, np.argmax(some @ centres.T, axis=1), len(centres))
        hit = n > 0
        seen += n
        rate = (n[hit] / seen[hit])[:, None]
        centres[hit] = unit(centres[hit] * (1 - rate) + total[hit] / n[hit, None] * rate)
    return centres


def full_pass(vectors: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sum, number) of the vectors nearest to each centre, over all vectors; a task returns one row for each centre it met."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(centres.shape, np.float64), np.zeros(len(centres), np.int64)
        for b in batches:
            block = vector_index._matrix(b.column(0))
            if len(block):
                t, m = group_sums(block, np.argmax(block @ centres.T, axis=1), len(centres))
                total, n = total + t, n + m
        hit = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(n[hit]), pa.array(list(total[hit]), pa.list_(pa.float64()))], names=["centre", "n", "total"])

    parts = vectors.where("v is not null").select(F.col("v").cast("array<float>").alias("v")).mapInArrow(sums, "centre long, n long, total array<double>")
    dims = centres.shape[1]
    one = parts.groupBy("centre").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[d]) for d in range(dims)]).alias("total"))
    total, n = np.zeros(centres.shape, np.float64), np.zeros(len(centres), np.int64)
    for r in one.toLocalIterator():
        total[r.centre], n[r.centre] = r.total, r.n
    return total, n


def lloyd(vectors: DataFrame, centres: np.ndarray, passes: int = PASSES, seed: int = 1) -> np.ndarray:
    """Passes over all vectors; a centre without any begins again at a vector of the table."""
    for k in range(passes):
        total, n = full_pass(vectors, centres)
        dead = np.flatnonzero(n == 0)
        centres = unit(np.where(n[:, None] > 0, total, centres))
        if len(dead):
            fresh = sample(vectors, len(dead), salt=seed * 1000 + k)
            centres[dead[: len(fresh)]] = unit(fresh)
    return centres


def kmeans(vectors: DataFrame, k: int, passes: int = PASSES, seed: int = 1, seed_rows: int = SEED_ROWS, batches: int = BATCHES, batch: int = BATCH) -> DataFrame:
    """(id, v): unit centres by seeds on a sample, minibatches on it, then passes over all vectors."""
    rng = np.random.default_rng(seed)
    points = sample(vectors, seed_rows, salt=seed)
    if not len(points):
        return table(vectors, np.zeros((0, 1)))
    centres = minibatches(points, seeds(points, k, rng), batches, batch, rng)
    return table(vectors, lloyd(vectors, centres, passes, seed))


def table(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    return vectors.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)], "id long, v array<double>")


def quantised(centres: DataFrame, scale: float) -> DataFrame:
    return centres.select("id", V.quantise(F.col("v"), scale).alias("q"))


def assign(vectors: DataFrame, centres: DataFrame, scale: float) -> DataFrame:
    """(id, cluster_id) of the vectors as they are, against the centres as a reader sees them: quantised and scaled back; the lowest cluster on ties."""
    seen = quantised(centres, scale).select("id", F.transform("q", lambda x: x.cast("float") * F.lit(scale).cast("float")).alias("q"))
    return vector_index.assign(vectors.where("v is not null").select("id", F.col("v").cast("array<float>").alias("q")), seen)


def split_oversized(vectors: DataFrame, centres: DataFrame, scale: float, cap_factor: float = CAP, rounds: int = ROUNDS, seed: int = 1) -> DataFrame:
    """Centres (id, v) after clusters above cap_factor times the mean were clustered again, all of a round in one job, each on a sample of SEED_ROWS; ids are dense.

    What is still above after the last round stays so: the nearest centre must be a vector's own."""
    n = vectors.where("v is not null").count()
    cap = cap_factor * n / max(1, centres.count())
    for k in range(rounds):
        owner = kept(assign(vectors, centres, scale), "owner")
        large = owner.groupBy("cluster_id").agg(F.count("*").alias("n")).where(F.col("n") > cap)
        if large.isEmpty():
            break
        order = Window.partitionBy("cluster_id").orderBy(F.xxhash64("id", F.lit(seed + k)), "id")
        some = owner.join(F.broadcast(large), "cluster_id").withColumn("place", F.row_number().over(order)).where(F.col("place") <= SEED_ROWS)

        def again(t: pa.Table) -> pa.Table:
            points, rng = vector_index._matrix(t["v"].combine_chunks()), np.random.default_rng(seed)
            parts = seeds(points, max(2, math.ceil(t["n"][0].as_py() / (AIM * cap))), rng)
            for _ in range(10):
                total, m = group_sums(points, np.argmax(points @ parts.T, axis=1), len(parts))
                parts = unit(np.where(m[:, None] > 0, total, parts))
            return pa.table({"old": pa.array([t["cluster_id"][0].as_py()] * len(parts), pa.int64()), "v": pa.array([c.astype(float) for c in parts], pa.list_(pa.float64()))})

        fresh = some.join(vectors.select("id", F.col("v").cast("array<float>").alias("v")), "id").groupBy("cluster_id").applyInArrow(again, "old long, v array<double>")
        left = centres.join(F.broadcast(large), F.col("id") == F.col("cluster_id"), "left_anti").select(F.col("id").alias("old"), "v")
        rows = left.unionByName(fresh).orderBy("old", "v").collect()  # one row a centre
        centres = table(vectors, np.array([r.v for r in rows]))
    return centres


def build(vectors: DataFrame, k: int, scale: float | None = None, seed: int = 1) -> tuple[DataFrame, DataFrame, dict]:
    """(assignment, centres, manifest) of a full build."""
    scale = scale or vector_index.choose_scale(vectors, "v")
    centres = split_oversized(vectors, kmeans(vectors, k, seed=seed), scale, seed=seed)
    return _finish(vectors, centres, scale, {})


def rebuild(vectors: DataFrame, centres: DataFrame, previous: dict) -> tuple[DataFrame, DataFrame, dict]:
    """(assignment, centres, manifest) of a build that keeps the centres and the scale of the last one; its fidelity stays in the chain."""
    scale = previous["quant"]["scale"]
    return _finish(vectors, centres, scale, previous)


def _finish(vectors: DataFrame, centres: DataFrame, scale: float, previous: dict) -> tuple[DataFrame, DataFrame, dict]:
    owner = kept(assign(vectors, centres, scale), "owner")
    count = centres.count()
    sizes = owner.groupBy("cluster_id").agg(F.count("*").alias("n"))
    s = sizes.agg(F.count("*").alias("used"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.max("n").alias("most")).first()
    fidelity = vectors.where("v is not null").agg(F.avg(V.cosine(F.col("v"), V.quantise(F.col("v"), scale)))).first()[0]
    chain = previous.get("fidelity_chain", []) + ([previous["fidelity"]] if "fidelity" in previous else [])
    over = sizes.where(F.col("n") > CAP * s.n / max(1, count)).count()
    return owner, centres, {"quant": {"scale": scale}, "clusters": {"count": count, "empty": count - s.used, "largest": s.most, "over_cap": over}, "vectors": s.n, "fidelity": fidelity, "fidelity_chain": chain, "reused_centres": bool(previous)}
