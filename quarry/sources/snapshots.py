"""Builds as folders under one root, named by a pointer that is replaced at once: publish, resolve, retain, check."""

from __future__ import annotations

import hashlib
import json
import os
import re
import shutil
import subprocess
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

POINTER, MANIFEST, KEEP = "_CURRENT", "manifest.json", 2
BUILD = re.compile(r"\d{8}T\d{6}Z")


def build_name(iso: str) -> str:
    s = re.sub(r"[^0-9TZ]", "", re.sub(r"\.\d+", "", iso))
    if not BUILD.fullmatch(s):
        raise ValueError(f"not a build time: {iso}")
    return s


def digest(folder: str) -> str:
    """12 hex digits over names and bytes of the files, in order of name."""
    h = hashlib.sha256()
    for d, _, files in sorted(os.walk(folder)):
        for n in sorted(files):
            path = os.path.join(d, n)
            h.update(os.path.relpath(path, folder).encode() + b"\0")
            with open(path, "rb") as f:
                while part := f.read(1 << 20):
                    h.update(part)
    return h.hexdigest()[:12]


def current(root: str) -> str | None:
    try:
        with open(os.path.join(root, POINTER)) as f:
            build = json.load(f)["build"]
    except FileNotFoundError:
        return None
    if not BUILD.fullmatch(build):
        raise ValueError(f"not a build: {build!r}")
    return build


def resolve(root: str) -> str:
    """The folder of the current build. One more look if the build named has just gone."""
    for _ in range(2):
        build = current(root)
        if build and os.path.exists(os.path.join(root, build, MANIFEST)):
            return os.path.join(root, build)
    raise FileNotFoundError(f"no complete build in {root}")


def complete(root: str) -> list[str]:
    return sorted(b for b in os.listdir(root) if BUILD.fullmatch(b) and os.path.exists(os.path.join(root, b, MANIFEST)))


def _files(folder: str) -> dict[str, int]:
    """Bytes of the data files below a folder, by name."""
    return {os.path.relpath(os.path.join(d, n), folder): os.path.getsize(os.path.join(d, n)) for d, _, files in os.walk(folder) for n in sorted(files) if not n.startswith((".", "_"))}


def commit_of(folder: str) -> str | None:
    """The commit that is checked out in a folder of code, or None."""
    try:
        return subprocess.run(["git", "-C", folder, "rev-parse", "HEAD"], capture_output=True, text=True, check=True, timeout=20).stdout.strip()
    except (OSError, subprocess.SubprocessError):
        return None


def publish(root: str, build: str, tables: dict[str, DataFrame], manifest: dict, partition_by: dict[str, str] | None = None, code: str | None = None, required: tuple[str, ...] = ()) -> str:
    """Write all tables and the manifest aside, move them in place, then replace the pointer. A failure leaves nothing; an older build than the current is refused.

    The manifest also gets the files and bytes of each table and the commit of the code. Required tables that have no row are a failure."""
    if not BUILD.fullmatch(build):
        raise ValueError(f"not a build: {build!r}")
    now = current(root) if os.path.exists(root) else None
    if now and build <= now:
        raise ValueError(f"{build} isn't newer than {now}")
    aside = os.path.join(root, f".{build}-{uuid.uuid4().hex}")
    try:
        for name, df in tables.items():
            key = (partition_by or {}).get(name)
            w = df.repartition(key).sortWithinPartitions(key).write.partitionBy(key) if key else df.write
            w.parquet(os.path.join(aside, name))
            if name in required and df.sparkSession.read.schema(df.schema).parquet(os.path.join(aside, name)).isEmpty():
                raise ValueError(f"{name} is empty")
        os.makedirs(aside, exist_ok=True)
        files = {name: _files(os.path.join(aside, name)) for name in tables}
        told = {"build": build, "tables": sorted(tables), "files": {n: len(f) for n, f in files.items()}, "bytes": {n: sum(f.values()) for n, f in files.items()}, "commit": commit_of(code) if code else None}
        write_json(os.path.join(aside, MANIFEST), manifest | told)
        os.replace(aside, os.path.join(root, build))
    except BaseException:
        shutil.rmtree(aside, ignore_errors=True)
        raise
    point(root, build)
    return os.path.join(root, build)


def write_json(path: str, value: dict | list) -> None:
    """With sorted keys, so that equal values are equal files; replaced at once."""
    with open(f"{path}.tmp", "w", encoding="utf-8") as f:
        json.dump(value, f, sort_keys=True, ensure_ascii=False)
    os.replace(f"{path}.tmp", path)


def write_documents_json(docs: DataFrame, path: str) -> int:
    """The table as one JSON object by doc_id, keys sorted; it must fit the driver. The number of documents."""
    rows = {r.doc_id: {k: v for k, v in r.asDict(recursive=True).items() if k != "doc_id" and v is not None} for r in docs.toLocalIterator()}
    write_json(path, rows)
    return len(rows)


def read_json_file(path: str, default: dict | list | None = None) -> dict | list:
    """A small JSON file (manifest, sources, queries); default, if there is one, where the file is missing."""
    try:
        with open(path, encoding="utf-8") as f:
            return json.load(f)
    except FileNotFoundError:
        if default is None:
            raise
        return default


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, query, relevant) of a JSON list of {query, relevant}; an entry without a query is an error."""
    rows = [(i, q["query"], [str(x) for x in q.get("relevant", [])]) for i, q in enumerate(read_json_file(path))]
    return spark.createDataFrame(rows, "query_id long, query string, relevant array<string>")


def previous_manifest(root: str) -> dict:
    """The manifest of the current build; empty where there is none."""
    try:
        return read_json_file(os.path.join(resolve(root), MANIFEST))
    except FileNotFoundError:
        return {}


def preload(spark: SparkSession, root: str, names: list[str]) -> dict[str, DataFrame]:
    """All the tables of the current build, read once and cached; if one can't be, none stays cached."""
    folder, held = resolve(root), {}
    try:
        for name in names:
            held[name] = spark.read.parquet(os.path.join(folder, name)).persist()
            held[name].count()
    except BaseException:
        for df in held.values():
            df.unpersist()
        raise
    return held


def prune_cache(entries: dict[str, object], build: str) -> list[str]:
    """Drop the entries (by path) of other builds than this one from a reader's cache, in place; the pointer and what belongs to no build stay. What went."""
    gone = [k for k in entries if (named := [p for p in k.split("/") if BUILD.fullmatch(p)]) and build not in named]
    for k in gone:
        del entries[k]
    return gone


def point(root: str, build: str) -> None:
    tmp = os.path.join(root, f"{POINTER}.tmp")
    with open(tmp, "w") as f:
        json.dump({"build": build}, f)
    os.replace(tmp, os.path.join(root, POINTER))


def open_build(spark: SparkSession, root: str) -> tuple[dict, Callable[[str], DataFrame]]:
    """(manifest, table by name), pinned to one build however long the session lasts."""
    folder = resolve(root)
    with open(os.path.join(folder, MANIFEST)) as f:
        manifest = json.load(f)
    return manifest, lambda name: spark.read.parquet(os.path.join(folder, name))


def vacuum(root: str, keep: int = KEEP, in_use: set[str] = frozenset()) -> list[str]:
    """Delete complete builds beyond the newest keep, but none in use, nor the current; and what was left aside. Without a pointer nothing is deleted."""
    now = current(root)
    if now is None:
        return []
    builds = complete(root)
    stay = {*builds[-keep:], now, *in_use}
    gone = [b for b in builds if b not in stay]
    for b in gone + [b for b in os.listdir(root) if b.startswith(".") and os.path.isdir(os.path.join(root, b))]:
        shutil.rmtree(os.path.join(root, b))
    return gone


def check(root: str) -> list[str]:
    """What is wrong with the published state; nothing if all agrees."""
    out = []
    build = current(root)
    if build is None:
        return ["no pointer"]
    folder = os.path.join(root, build)
    if not os.path.exists(os.path.join(folder, MANIFEST)):
        return [f"{build} has no manifest"]
    with open(os.path.join(folder, MANIFEST)) as f:
        manifest = json.load(f)
    if manifest.get("build") != build:
        out.append("pointer and manifest name different builds")
    tables = manifest.get("tables", [])
    out += [f"{t} is missing" for t in tables if not os.path.exists(os.path.join(folder, t, "_SUCCESS"))]
    for t in tables:
        files = _files(os.path.join(folder, t)) if os.path.exists(os.path.join(folder, t)) else {}
        if "files" in manifest and manifest["files"].get(t) != len(files):
            out.append(f"{t} has {len(files)} files, the manifest says {manifest['files'].get(t)}")
        if "bytes" in manifest and manifest["bytes"].get(t) != sum(files.values()):
            out.append(f"{t} has {sum(files.values())} bytes, the manifest says {manifest['bytes'].get(t)}")
    clusters = manifest.get("clusters", {})
    if clusters.get("count", 0) > 9999:
        out.append("too many clusters")
    if "vectors" in tables and clusters and os.path.exists(os.path.join(folder, "vectors")):
        there = sum(n.startswith("cluster_id=") for n in os.listdir(os.path.join(folder, "vectors")))
        if there + clusters.get("empty", 0) != clusters.get("count"):
            out.append(f"{there} clusters have files, the manifest says {clusters.get('count')} with {clusters.get('empty', 0)} empty")
    if "centroid_bytes" in manifest and manifest["centroid_bytes"] != clusters.get("count", 0) * manifest.get("dims", 0):
        out.append("the centroids' size isn't clusters times dimensions")
    if "quant" in manifest and not manifest["quant"].get("scale", 0) > 0:
        out.append("the scale isn't positive")
    if manifest.get("needs_sources") and not os.path.exists(os.path.join(root, "sources.json")):
        out.append("sources.json is missing")
    out += [f"{b} is a build without a manifest" for b in sorted(os.listdir(root)) if BUILD.fullmatch(b) and not os.path.exists(os.path.join(root, b, MANIFEST))]
    return out


def check_assets(site: str, paths: list[str], stamp: str | None = None) -> list[str]:
    """What is wrong with the files that a site must have: missing, empty, or without the stamp of the release in them."""
    out = []
    for p in paths:
        file = os.path.join(site, p)
        if not os.path.isfile(file):
            out.append(f"{p} is missing")
            continue
        with open(file, "rb") as f:
            body = f.read()
        if not body:
            out.append(f"{p} is empty")
        elif stamp and stamp.encode() not in body:
            out.append(f"{p} isn't stamped {stamp}")
    return out
