"""Clusters of a published index for one process that serves searches: a bounded cache with counters, and the same counters of a search in Spark."""

from __future__ import annotations

import threading
from collections import OrderedDict
from collections.abc import Callable
from concurrent.futures import Future
from typing import Any

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

MOST = 400


class ClusterCache:
    """load(cluster) -> (value, bytes), called once for a cluster however many ask at a time. The least recently used go beyond `most`; a failed load isn't kept."""

    def __init__(self, load: Callable[[int], tuple[Any, int]], most: int = MOST) -> None:
        self.load, self.most, self.lock = load, max(1, most), threading.Lock()
        self.held: OrderedDict[int, Future] = OrderedDict()
        self.fetches = self.hits = self.bytes = 0

    def get(self, cluster: int) -> Any:
        with self.lock:
            waiting = self.held.get(cluster)
            if waiting is None:
                mine = self.held[cluster] = Future()
                self.fetches += 1
                while len(self.held) > self.most:
                    self.held.popitem(last=False)
            else:
                self.hits += 1
                self.held.move_to_end(cluster)
        if waiting is not None:
            return waiting.result()
        try:
            value, size = self.load(cluster)
        except BaseException as e:
            with self.lock:
                if self.held.get(cluster) is mine:
                    del self.held[cluster]
            mine.set_exception(e)
            raise
        with self.lock:
            self.bytes += size
        mine.set_result(value)
        return value

    def stats(self) -> dict[str, int]:
        with self.lock:
            return {"fetches": self.fetches, "hits": self.hits, "bytes": self.bytes, "held": len(self.held)}


def observed(probes: DataFrame, sizes: DataFrame) -> tuple[DataFrame, Observation]:
    """(probes with the bytes of their cluster, counters of the run: probes, clusters read, bytes by probe). The counters are there once an action has run. sizes: (cluster_id, bytes)."""
    seen = Observation("probes")
    joined = probes.join(sizes, "cluster_id", "left").withColumn("bytes", F.coalesce("bytes", F.lit(0)))
    return joined.observe(seen, F.count(F.lit(1)).alias("probes"), F.approx_count_distinct("cluster_id").alias("clusters"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")), seen
