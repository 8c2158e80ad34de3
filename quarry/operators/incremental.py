"""Incremental builds: content hashes, what has changed, vectors reused from the cache or the last build."""

from __future__ import annotations

import ast
import hashlib
import json
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MAX_NEW_SHARE = 0.25


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """doc_ids whose digest differs or that one side lacks. Both: (doc_id, digest)."""
    o, n = old.select("doc_id", F.col("digest").alias("was")), new.select("doc_id", F.col("digest").alias("is"))
    return o.join(n, "doc_id", "full_outer").where(~F.col("was").eqNullSafe(F.col("is"))).select("doc_id")


def distinct_contents(chunks: DataFrame) -> DataFrame:
    """(content_hash, text): each text once, so that it is embedded once."""
    return chunks.select(content_hash(F.col("text")).alias("content_hash"), "text").dropDuplicates(["content_hash"])


def todo(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    """Contents without a vector in the cache (content_hash, ...)."""
    return distinct_contents(chunks).join(cache.select("content_hash"), "content_hash", "left_anti")


def attach(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    """chunks with their cached vectors; equal texts share one."""
    return chunks.withColumn("content_hash", content_hash(F.col("text"))).join(cache.dropDuplicates(["content_hash"]), "content_hash")


def hydrate(chunks: DataFrame, previous: DataFrame, changed_docs: DataFrame, cache: DataFrame) -> DataFrame:
    """(content_hash, v) taken over from the last build by place (doc_id, offset, length), from unchanged documents, where the cache lacks them."""
    key = ["doc_id", "offset", "length"]
    same = chunks.withColumn("content_hash", content_hash(F.col("text"))).join(changed_docs.select("doc_id"), "doc_id", "left_anti")
    found = same.join(previous.select(*key, "v"), key).select("content_hash", "v").dropDuplicates(["content_hash"])
    return found.join(cache.select("content_hash"), "content_hash", "left_anti")


def update_cache(chunks: DataFrame, cache: DataFrame, embed: Callable[[DataFrame], DataFrame], limit: float | None = MAX_NEW_SHARE) -> DataFrame:
    """The new cache rows (content_hash, v); more than limit of new contents is an error, so that a wrong cache doesn't start a full run unseen."""
    new = todo(chunks, cache)
    if limit is not None:
        n, total = new.count(), distinct_contents(chunks).count()
        if total and n / total > limit:
            raise ValueError(f"{n} of {total} contents are new, above the limit of {limit:.0%}")
    return embed(new)


def _shape(code: str) -> str:
    """Python code without what doesn't change its work: comments, layout, documentation strings. Other text with its white space squeezed."""
    try:
        tree = ast.parse(code)
    except SyntaxError:
        return re.sub(r"\s+", " ", code)
    for node in ast.walk(tree):
        body = getattr(node, "body", None)
        if isinstance(body, list) and body and isinstance(body[0], ast.Expr) and isinstance(body[0].value, ast.Constant) and isinstance(body[0].value.value, str):
            node.body = body[1:] or [ast.Pass()]
    return ast.dump(tree)


def fingerprint(code: str, options: dict) -> dict:
    """What the output of a step depends on besides its input."""
    return {"code": hashlib.sha256(_shape(code).encode()).hexdigest(), "opts": json.dumps(options, sort_keys=True)}


def reuse_forbidden(old: dict | None, new: dict) -> str | None:
    """Why an older build can't be reused, or None."""
    if not old:
        return "the older build has no fingerprint"
    differ = [k for k in ("code", "opts") if old.get(k) != new.get(k)]
    return f"changed: {', '.join(differ)}" if differ else None


def retained(builds: DataFrame, keep: int = 2) -> DataFrame:
    """builds (build, complete) with their place from the newest, and whether they stay: the newest complete ones."""
    w = Window.orderBy(F.col("build").desc())
    placed = builds.where("complete").withColumn("place", F.row_number().over(w))
    return placed.withColumn("kept", F.col("place") <= keep)
