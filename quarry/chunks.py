"""Chunks from the command line: python -m quarry.chunks FOLDER --out FOLDER [options]."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import functions as F

from .operators import chunker, evaluation
from .session import session
from .sources import texts


def options_of(args: argparse.Namespace) -> chunker.Options:
    return chunker.Options(args.target, args.cap, not args.no_overlap, args.keep_acks, args.token_budget, args.chars_per_token)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__)
    d = chunker.Options()
    p.add_argument("paths", nargs="+", help="texts, or folders of them")
    p.add_argument("--out", help="folder for the chunks, as JSON lines")
    p.add_argument("--target", type=int, default=d.target, help="characters that a chunk should have")
    p.add_argument("--cap", type=int, default=d.cap, help="characters that it may have")
    p.add_argument("--no-overlap", action="store_true", help="don't repeat the last paragraph of a chunk in the next")
    p.add_argument("--keep-acks", action="store_true", help="keep acknowledgements and contributors")
    p.add_argument("--token-budget", type=int, help="tokens that a chunk may have")
    p.add_argument("--chars-per-token", type=float, default=d.chars_per_token)
    p.add_argument("--stats", action="store_true", help="print a report")
    p.add_argument("--sources", help="write a digest of each text here, as JSON lines")
    p.add_argument("-j", "--jobs", type=int, help="tasks at a time, on this machine; without it the session's master decides")
    return p


def main(argv: list[str] | None = None) -> int:
    """1 if any text was rejected."""
    args = parser().parse_args(argv)
    spark = session(f"local[{args.jobs}]" if args.jobs else None)
    docs = texts.read_texts(spark, *args.paths)
    chunks, rejects = chunker.chunk_documents(docs, options_of(args))
    if args.out:
        texts.write_chunks(chunks, args.out)
        chunks = texts.read_chunks(spark, args.out)
    if args.sources:
        docs.select("doc_id", F.sha2("content", 256).alias("digest")).write.mode("overwrite").json(args.sources)
    if args.stats:
        budget = args.token_budget or int(args.cap / args.chars_per_token)
        print(json.dumps(evaluation.chunk_report(chunks, docs, rejects, budget, args.chars_per_token).first().asDict()))
    return int(not rejects.isEmpty())


if __name__ == "__main__":
    raise SystemExit(main())
