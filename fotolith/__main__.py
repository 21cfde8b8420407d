"""python -m fotolith CATALOG COMMAND: index, stats, faces, clip, tags and diagnose over a catalog."""

from __future__ import annotations

import argparse
import importlib
import json
import time

from pyspark.sql import SparkSession

from fotolith.plans.catalog import Catalog
from fotolith.plans.library import Library


def _named(name: str):
    """An object as module:attribute, for models that a user brings."""
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="fotolith", description=__doc__)
    p.add_argument("catalog", help="folder of the catalog's tables")
    p.add_argument("root", help="folder of the library")
    sub = p.add_subparsers(dest="command", required=True)
    index = sub.add_parser("index", help="scan, reconcile, measure and score")
    index.add_argument("--rescore", action="store_true", help="measure everything again")
    index.add_argument("--preset", default="Balanced")
    faces = sub.add_parser("faces", help="detect, embed and group faces")
    faces.add_argument("--detector", required=True, help="module:Detector")
    faces.add_argument("--embedder", required=True, help="module:Embedder")
    tags = sub.add_parser("tags", help="ask an endpoint for tags")
    tags.add_argument("--client", required=True, help="module:function")
    tags.add_argument("--model", required=True)
    tags.add_argument("--limit", type=int, default=200)
    clip = sub.add_parser("clip", help="tag by the nearest phrases")
    clip.add_argument("--embedder", required=True, help="module:Embedder")
    clip.add_argument("--vocabulary", required=True, help="Parquet of phrase and vector")
    clip.add_argument("--keep", type=int, default=5)
    clip.add_argument("--min-similarity", type=float, default=0.2)
    diagnose = sub.add_parser("diagnose", help="how an endpoint did, from its stored replies")
    diagnose.add_argument("--replies", required=True, help="Parquet of tags, completion_tokens and seconds")
    diagnose.add_argument("--vocabulary", nargs="*", default=[])
    sub.add_parser("stats", help="totals of the catalog")
    return p


def run(spark: SparkSession, argv: list[str], now: int | None = None) -> dict:
    args = parser().parse_args(argv)
    now = int(time.time()) if now is None else now
    library = Library(Catalog(spark, args.catalog), args.root, preset=getattr(args, "preset", "Balanced"))
    if args.command == "index":
        return library.index(now, "full" if args.rescore else "incremental")
    if args.command == "faces":
        return library.faces(_named(args.detector), _named(args.embedder), now)
    if args.command == "tags":
        return library.tags(_named(args.client), args.model, now, args.limit)
    if args.command == "clip":
        return library.clip(_named(args.embedder), spark.read.parquet(args.vocabulary), now, args.keep, args.min_similarity)
    if args.command == "diagnose":
        from fotolith.operators.tables import endpoint_usage

        return endpoint_usage(spark.read.parquet(args.replies), args.vocabulary).first().asDict()
    return library.totals().first().asDict()


if __name__ == "__main__":
    import sys

    print(json.dumps(run(SparkSession.builder.getOrCreate(), sys.argv[1:])))
