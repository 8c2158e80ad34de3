"""Near-duplicate groups from bottom-k sketches of one hash function.

A document is the set of its shingles (SHINGLE words in a row, lower case, signs dropped). One hash
function orders the shingles; the K smallest hashes are its sketch. Inverted lists of the retained
values give pairs that overlap, the sketch of the union estimates their Jaccard similarity, and the
shingle sets themselves verify it. Verified pairs are joined to groups; one document of each stays.

Candidates are complete for the estimate: a sketch must share need(n) values at least with that of any
partner whose similarity reaches THRESHOLD, so two such sketches share one of the (size - need + 1)
rarest values of each, and only those are listed (a prefix filter with values ordered by frequency).
need() allows SIGMAS deviations of the estimate. It is drawn without replacement from the union, so the
deviation falls with the union's size, and is 0 for a union of at most K shingles: the sketches of
short documents are their sets. Passages that many documents share are frequent, hence at the end of
the order, and hardly ever listed.

Texts with equal words are grouped by a 128-bit hash first, so any number of copies is one document
afterwards. Every list is then paired with its hub alone, the document of which most can be in common. Lists
that still hold more than one group are compared in blocks of BLOCK documents, each within one task, which
returns the pairs that pass the estimate only; lists of the same documents are compared once. Two sketches
share no more than what each has from their first common value on, so most pairs that share a passage
and little else are left out by numbers alone (a positional filter), without a look at the sketches. The
result is the same as comparing all with all.

A document is a row's doc_id and text. Defined cases
* null or blank text, or text without words: in no group, stays.
* null doc_id: cannot be named, in no group, stays.
* repeated doc_id with different texts: documents of their own, grouped by their texts.
* rows with the same doc_id and text: one stays, that with the least hash of its columns.
* fewer than SHINGLE words: the one shingle is all of its words. Very long texts: whole.
* nulls in other columns and extra columns: passed through. Empty table: no groups, no rows.
* ties: of a group the document with the smallest doc_id stays; of several with that, the one with the least text hash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from .common import distinct, forget, lean, parts_of, read_table, small_side, stored, trim, unused

WORD = re.compile(r"\w+")
SHINGLE, K = 3, 64
#: The near copies of the given tables lie above 0.5 and unrelated texts far below.
THRESHOLD, SIGMAS = 0.5, 4.0
#: Documents of a list that are compared with as many others at a time, pairs of them whose numbers are compared at once, and whose sketches are merged at once.
BLOCK, NUMBERS, PAIRS = 512, 1 << 17, 4_096
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xBF58476D1CE4E5B9)


class _Words(dict):
    """Word -> 64-bit hash; emptied now and then, since rare words never end."""

    def __missing__(self, w: str) -> int:
        if len(self) > 100_000:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w)
        return h


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(29)
    h *= _M3
    h ^= h >> np.uint64(32)
    return h


def word_hashes(text: str, cache: _Words) -> np.ndarray:
    out = []
    for part in parts_of(text):
        words = WORD.findall(part.lower())
        out.append(np.fromiter(map(cache.__getitem__, words), np.uint64, len(words)))
    return out[0] if len(out) == 1 else np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingles(w: np.ndarray) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a document's word hashes."""
    if len(w) == 0:
        return w
    n = max(1, len(w) - SHINGLE + 1)
    h = np.zeros(n, np.uint64)
    for i in range(SHINGLE):
        part = w[i : i + n]
        h[: len(part)] = h[: len(part)] * _M1 + (part ^ (part >> np.uint64(31))) * _M2
    return distinct(_mix(h))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 0.0


def deviation(union: float | np.ndarray, threshold: float = THRESHOLD):
    """The standard deviation of the estimate at the threshold, for a union of this size."""
    return np.sqrt(threshold * (1 - threshold) / K * np.maximum(0, union - K) / np.maximum(1, union - 1))


def needed(n: int | np.ndarray, threshold: float = THRESHOLD, sigmas: float = SIGMAS):
    """Values that the sketch of n shingles shares with that of any document whose similarity reaches the threshold; their union is n / threshold at most."""
    far = (threshold - sigmas * deviation(n / threshold, threshold)) * K
    return np.maximum(1, np.ceil(np.minimum(threshold * n, far) - 1e-9)).astype(np.int64)


def _needed(n: Column, threshold: float, sigmas: float) -> Column:
    union = n / F.lit(threshold)
    share = F.greatest(F.lit(0.0), union - K) / F.greatest(F.lit(1.0), union - 1)
    far = (F.lit(threshold) - sigmas * F.sqrt(F.lit(threshold * (1 - threshold) / K) * share)) * K
    return F.greatest(F.lit(1), F.ceil(F.least(F.lit(threshold) * n, far) - 1e-9))


def _signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = _Words()
    for b in batches:
        on, hi, lo, flat, sizes, total = [], [], [], [], [], []
        for i, t in enumerate(b.column(3)):
            w = word_hashes(t.as_py(), cache)
            if not len(w):
                continue
            whole = xxhash.xxh3_128_intdigest(w.tobytes())
            s = shingles(w)
            on.append(i)
            hi.append((whole >> 64) - (1 << 63))
            lo.append((whole & ((1 << 64) - 1)) - (1 << 63))
            flat.append(s[:K].copy())  # a view would keep all of s
            sizes.append(min(K, len(s)))
            total.append(len(s))
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        values = np.concatenate(flat) if flat else np.zeros(0, np.uint64)
        kept = [b.column(c).take(pa.array(on, pa.int64())) for c in range(3)]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(total, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(_signed(values)))], names=["row", "doc_id", "text_key", "hi", "lo", "n", "sketch"])


def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = _Words()
    for b in batches:
        sets = [shingles(word_hashes(t.as_py(), cache)).tobytes() for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], names=["row", "shingles"])


def _padded(sketches: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(a row of K values for each sketch, the largest number behind its own; the sizes)."""
    size = np.array([len(x) for x in sketches], np.int64)
    out = np.full((len(sketches), K), np.uint64(0xFFFFFFFFFFFFFFFF))
    out[np.arange(K)[None, :] < size[:, None]] = np.concatenate([*sketches, np.zeros(0, np.int64)]).astype(np.int64).view(np.uint64)
    return out, size


def estimates(a: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_size: np.ndarray) -> np.ndarray:
    """For each row the share of the union's bottom K that both sketches hold; a sketch below K is the whole set."""
    if not len(a):
        return np.zeros(0)
    both = np.concatenate([a[:, : a_size.max()], b[:, : b_size.max()]], 1)
    both.sort(1)
    twice = both[:, 1:] == both[:, :-1]
    twice &= np.arange(1, both.shape[1])[None, :] < (a_size + b_size)[:, None]
    so_far = np.cumsum(twice, 1, dtype=np.int16)
    shared = (twice & (np.arange(2, both.shape[1] + 1, dtype=np.int16)[None, :] - so_far <= K)).sum(1)
    return shared / np.maximum(1, np.minimum(K, a_size + b_size - so_far[:, -1]))


def _may(estimate: np.ndarray, na: np.ndarray, nb: np.ndarray, threshold: float, sigmas: float) -> np.ndarray:
    """Do the estimate and the sizes leave room for the threshold?"""
    cut = threshold - sigmas * deviation((na + nb) / (1 + threshold), threshold)
    return (estimate >= cut - 1e-9) & (np.minimum(na, nb) >= threshold * np.maximum(na, nb) - 1e-9)


def _likely(threshold: float, sigmas: float):
    @F.pandas_udf("boolean")
    def likely(a: pd.Series, b: pd.Series, na: pd.Series, nb: pd.Series) -> pd.Series:
        out = np.zeros(len(a), bool)
        for lo in range(0, len(a), PAIRS):
            some = slice(lo, lo + PAIRS)
            out[some] = _may(estimates(*_padded(list(a[some])), *_padded(list(b[some]))), na[some].to_numpy(), nb[some].to_numpy(), threshold, sigmas)
        trim()
        return pd.Series(out)

    return likely


@F.pandas_udf(DoubleType())
def _exact(a: pd.Series, b: pd.Series) -> pd.Series:
    out = pd.Series([jaccard(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(a, b)], dtype="float64")
    trim()
    return out


def components(edges: DataFrame) -> DataFrame:
    """(row, root): the least row reachable over the edges (a, b). Large-star and small-star rounds until nothing changes; each round is stored."""
    both = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    now, last = stored(both, "cc"), None
    while True:
        total = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if total == last:
            break
        last = total
        near = now.union(now.select("v", "u")).toDF("u", "v")
        least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = near.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        m = F.min("v").over(Window.partitionBy("u"))
        small = large.withColumn("m", m)
        star = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        after = stored(star, "cc")
        forget(now)
        now = after
    roots = now.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "row")
    out = stored(roots.union(roots.select(F.col("root").alias("row"), "root").distinct()), "roots")
    forget(now)
    return out


def _verified(likely: DataFrame, names: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets reach the threshold, with their similarity. names: row, doc_id, text_key."""
    ids = stored(likely.select(F.col("a").alias("row")).union(likely.select("b")).distinct().join(names, "row"), "ids")
    mine = _texts(docs).join(small_side(ids, 32), ["doc_id", "text_key"]).select("row", "text")
    sets = stored(mine.mapInArrow(lean(_shingle_sets), "row long, shingles binary"), "sets")
    out = likely.join(sets.toDF("a", "xa"), "a").join(sets.toDF("b", "xb"), "b").select("a", "b", _exact("xa", "xb").alias("jaccard"))
    out = stored(out.where(F.col("jaccard") >= threshold), "pairs")
    forget(ids, sets)
    return out


def _texts(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")


def _possible(left: np.ndarray, size: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float, sigmas: float) -> np.ndarray:
    """Could the pairs (a, b) pass _may(), if the list is that of their first common value? left: the values that each has in common with any document, from the list's on."""
    shared = np.minimum(left[a], left[b])
    most = shared / np.maximum(1, np.minimum(K, size[a] + size[b] - shared))
    return _may(most, n[a], n[b], threshold, sigmas)


def _compare(threshold: float, sigmas: float):
    def units(t: pa.Table, groups: dict[int, int]) -> pa.RecordBatch:
        """The likely pairs of different groups of each unit: one block of a list, or two blocks. groups: those joined so far by pairs that are sure."""

        def top(g: int) -> int:
            while (up := groups.get(g, g)) != g:
                groups[g] = g = groups.get(up, up)
            return g

        row, g, n, left, part, p, q, start = (t.column(c).to_numpy() for c in ("row", "g", "n", "left", "part", "p", "q", "start"))
        sketch, size = _padded([x.values.to_numpy() for x in t.column("sketch")])
        two, at = p != q, np.arange(len(row))
        first = np.flatnonzero(start)
        partners = np.repeat(np.append(first[1:], len(row)), np.diff(np.append(first, len(row)))) - at - 1
        done, lo, found = np.concatenate([[0], np.cumsum(partners)]), 0, [np.zeros((2, 0), np.int64)]
        while lo < len(row):
            hi = max(lo + 1, int(np.searchsorted(done, done[lo] + NUMBERS, side="right")) - 1)
            a = np.repeat(at[lo:hi], partners[lo:hi])
            b = a + 1 + np.arange(len(a)) - (done[a] - done[lo])
            on = (g[a] != g[b]) & (~two[a] | (part[a] != part[b]))
            a, b = a[on], b[on]
            on = _possible(left, size, n, a, b, threshold, sigmas)
            a, b = a[on], b[on]
            for k in range(0, len(a), PAIRS):
                x, y = a[k : k + PAIRS], b[k : k + PAIRS]
                e = estimates(sketch[x], size[x], sketch[y], size[y])
                on = _may(e, n[x], n[y], threshold, sigmas)
                for i in np.flatnonzero(on & (n[x] + n[y] <= K)):  # the estimate is the similarity: what joins groups that are joined adds nothing
                    u, v = top(int(g[x[i]])), top(int(g[y[i]]))
                    groups[u], on[i] = v, u != v
                found.append(np.stack([x[on], y[on]]))
            lo = hi
        a, b = np.concatenate(found, 1)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(row[a], row[b])), pa.array(np.maximum(row[a], row[b]))], names=["a", "b"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come unit by unit; one that the batch may not end waits for the next."""
        waiting: pa.Table | None = None
        groups: dict[int, int] = {}
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([waiting, t]).combine_chunks() if waiting is not None else t
            key = np.stack([t.column(c).to_numpy().astype(np.int64) for c in ("value", "p", "q")])
            start = np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(0)])[: len(t)]
            last = int(np.flatnonzero(start)[-1]) if len(t) else 0
            waiting = t.slice(last)
            if last:
                yield units(t.slice(0, last).append_column("start", pa.array(start[:last])), groups)
        if waiting is not None and len(waiting):
            yield units(waiting.append_column("start", pa.array(np.arange(len(waiting)) == 0)), groups)

    return compare


def _across(listed: DataFrame, near: DataFrame, sketches: DataFrame, threshold: float, sigmas: float) -> DataFrame:
    """The likely pairs of documents that share a list but no group.

    Of lists of the same documents the one that comes first in the order of values stands for all. A long list is cut into blocks of its largest group and blocks of the others; those of the largest group aren't compared with each other."""
    placed = stored(listed.drop("n").join(near, "row", "left").select("value", "row", "df", "left", F.coalesce("root", "row").alias("g")), "placed")
    parts = placed.groupBy("value", "g").agg(F.count("*").alias("m"), F.sum(F.xxhash64("row").cast("decimal(38,0)")).alias("s"), F.min("row").alias("r"), F.min("df").alias("df"))
    whole = parts.groupBy("value").agg(F.sum("m").alias("m"), F.max(F.struct("m", "g")).alias("big"), F.sum("s").alias("s"), F.min("r").alias("r"), F.min("df").alias("df")).where("big.m < m")
    lists = whole.groupBy("m", "s", "r").agg(F.min(F.struct("df", "value", "big")).alias("l")).select("l.value", "l.big.g", F.col("l.big.m").alias("n"), "m").toDF("value", "large", "in_large", "m")
    blocks = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
    small = F.col("m") <= BLOCK
    lists = stored(lists.select("value", "large", F.when(small, 0).otherwise(blocks(F.col("in_large"))).alias("x"), F.when(small, 1).otherwise(blocks(F.col("m") - F.col("in_large"))).alias("y")), "lists")
    at, large = F.xxhash64("row", "value"), (F.col("g") == F.col("large")) & (F.col("x") > 0)
    members = placed.join(small_side(lists, 32), "value").withColumn("part", F.when(large, F.pmod(at, F.col("x"))).otherwise(F.col("x") + F.pmod(at, F.col("y"))).cast("int"))
    other = F.explode(F.sequence(F.when(large, F.col("x")).otherwise(F.lit(0)), F.col("x") + F.col("y") - 1))
    members = members.join(sketches.select("row", "n", "sketch"), "row").select("value", "row", "g", "n", "left", "sketch", "part", other.alias("other"))
    units = members.withColumns({"p": F.least("part", "other"), "q": F.greatest("part", "other")}).drop("other")
    spread = units.repartition(int(units.sparkSession.conf.get("spark.sql.shuffle.partitions")), "value", "p", "q")  # work follows pairs, not bytes, so adaptive execution may not merge these
    pairs = spread.sortWithinPartitions("value", "p", "q").mapInArrow(lean(_compare(threshold, sigmas)), "a long, b long").distinct()
    out = stored(pairs, "late")
    forget(placed, lists)
    return out


def groups(docs: DataFrame, threshold: float = THRESHOLD, sigmas: float = SIGMAS) -> DataFrame:
    """doc_id, text_key (of each document in a group of two or more), kept_id, kept_key (of the one that stays). Stored."""
    texts = _texts(docs).withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "text_key", "text")  # fixed once it's stored
    sketches = stored(texts.mapInArrow(lean(_sketches), "row long, doc_id long, text_key long, hi long, lo long, n int, sketch array<long>"), "sketches")
    names = sketches.select("row", "doc_id", "text_key")
    copies = sketches.groupBy("hi", "lo").agg(F.min(F.struct("doc_id", "text_key", "row")).alias("first"), F.count("*").alias("m")).where("m > 1")
    same = sketches.select("row", "hi", "lo").join(copies, ["hi", "lo"]).where("row <> first.row").select("row", F.col("first.row").alias("first"))
    same = stored(same, "same")
    one = sketches.join(small_side(same.select("row"), 16), "row", "left_anti")

    posting = one.select("row", "n", F.explode("sketch").alias("value"))
    often = posting.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    shared = posting.join(often, "value")
    by_doc = Window.partitionBy("row")
    shared = shared.withColumn("c", F.count("*").over(by_doc)).withColumn("place", F.row_number().over(by_doc.orderBy("df", "value"))).withColumn("need", _needed(F.col("n"), threshold, sigmas))
    shared = shared.withColumn("left", F.expr("c - place + 1"))  # what the document can share if this is the first common value
    listed = stored(shared.where("c >= need and left >= need").select("value", "row", "n", "df", "left"), "listed")

    share = F.col("left") / F.least(F.col("n"), F.lit(K))
    hubs = listed.groupBy("value").agg(F.max_by("row", F.struct(share, -F.col("row"))).alias("hub"), F.count("*").alias("m")).where("m > 1")
    first = listed.join(hubs, "value").where("row <> hub").select(F.least("row", "hub").alias("a"), F.greatest("row", "hub").alias("b")).distinct()
    first = stored(first, "first")
    used = stored(first.select(F.col("a").alias("row")).union(first.select("b")).distinct(), "used")
    s = one.join(small_side(used, 16), "row", "left_semi").select("row", "sketch", "n")
    pairs = first.join(s.toDF("a", "sa", "na"), "a").join(s.toDF("b", "sb", "nb"), "b")
    likely = stored(pairs.where(_likely(threshold, sigmas)("sa", "sb", "na", "nb")).select("a", "b"), "likely")
    edges = _verified(likely, names, docs, threshold)
    near = components(edges.select("a", "b"))
    forget(first, used, likely)

    late = _across(listed, near, one, threshold, sigmas)
    more = _verified(late, names, docs, threshold)
    root = near.select(F.col("row").alias("a"), F.col("root").alias("ra"))
    apart = more.join(root, "a", "left").join(root.toDF("b", "rb"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).where("a <> b")
    tops = components(apart)  # of whole groups
    joined = tops.toDF("root", "top")
    merged = near.join(joined, "root", "left").select("row", F.coalesce("top", "root").alias("root"))
    merged = stored(merged.union(joined.join(near.select(F.col("row").alias("root")), "root", "left_anti")), "merged")  # with those that had no group before

    of_copies = same.join(merged.toDF("first", "root"), "first", "left").select("row", F.coalesce("root", "first").alias("root"))
    alone = same.select(F.col("first").alias("row")).distinct().join(merged, "row", "left_anti").withColumn("root", F.col("row"))
    named = stored(merged.union(of_copies).union(alone).join(names, "row"), "named")
    kept = stored(named.groupBy("root").agg(F.min(F.struct("doc_id", "text_key")).alias("k")), "kept")
    out = named.join(small_side(kept, 40), "root").select("doc_id", "text_key", F.col("k.doc_id").alias("kept_id"), F.col("k.text_key").alias("kept_key")).distinct()
    out = stored(out, "groups")
    forget(sketches, same, listed, edges, near, late, more, tops, merged, named, kept)
    return out


_GONE = "doc_id <> kept_id or text_key <> kept_key"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: every document that has copies or near copies before it, and the one of its group that stays."""
    return groups(read_table(spark, sf_dir, "documents")).where(_GONE).select("doc_id", "kept_id")


def drop_duplicates(docs: DataFrame, **options) -> DataFrame:
    """docs with one document of each group, and of rows with the same doc_id and text one."""
    found = groups(docs, **options)
    k, r, d = unused(docs, "text_key", "row_of_text", "id_of_text")
    keyed = docs.withColumn(k, F.xxhash64("text")).withColumn(d, F.col("doc_id").cast("long"))
    gone = small_side(found.where(_GONE), 16).select(F.col("doc_id").alias(d), F.col("text_key").alias(k))
    left = keyed.join(gone, [d, k], "left_anti")
    twice = stored(keyed.where("doc_id is not null and text is not null").groupBy(d, k).agg(F.count("*").alias(r)).where(F.col(r) > 1).select(d, k), "twice")
    if twice.isEmpty():
        return left.select(*docs.columns)
    worded = found.select(F.col("doc_id").alias(d), F.col("text_key").alias(k))  # rows of a text without words are in no group, and all stay
    twice = small_side(stored(twice.join(worded, [d, k], "left_semi"), "twice"), 16)
    order = Window.partitionBy(d, k).orderBy(F.xxhash64(*docs.columns), *[F.col(f"`{c}`") for c, t in docs.dtypes if "map" not in t])
    kept = left.join(twice, [d, k], "left_semi").withColumn(r, F.row_number().over(order)).where(F.col(r) == 1)
    return left.join(twice, [d, k], "left_anti").select(*docs.columns).unionByName(kept.select(*docs.columns))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_duplicates(docs)
