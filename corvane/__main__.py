"""Command line: ``spark-submit`` or ``python -m corvane ROOT [--rebuild | --incremental | --search TEXT | --stats]``."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession

from corvane.embedding import create_embedder
from corvane.plans.search import SearchMode
from corvane.service import RetrievalService


class NoEmbedder:
    """For what needs no vectors."""

    dimension = 0

    def embed(self, text: str) -> list[float]:
        raise RuntimeError("no embedding model was given")

    def embed_batch(self, texts: Sequence[str]) -> list[list[float]]:
        raise RuntimeError("no embedding model was given")


def preview(text: str, size: int = 200) -> str:
    return text[:size] + "..." if len(text) > size else text


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="corvane", description="Index and search a folder of documents.")
    p.add_argument("root")
    p.add_argument("--store")
    p.add_argument("--rebuild", action="store_true")
    p.add_argument("--incremental", action="store_true")
    p.add_argument("--search", metavar="TEXT")
    p.add_argument("--stats", action="store_true")
    p.add_argument("--top-k", type=int, default=5)
    p.add_argument("--mode", default="hybrid", choices=[m.value for m in SearchMode])
    p.add_argument("--model", help="name of the embedding model, needed but for --stats and --mode fts_only searches")
    p.add_argument("--models", action="append", default=[], help="folder with exported models")
    a = p.parse_args(args)
    if not (a.rebuild or a.incremental or a.search or a.stats):
        p.print_help()
        return 0
    by_text = a.mode == SearchMode.FTS_ONLY.value and not (a.rebuild or a.incremental)
    if not a.model and not a.stats and not by_text:
        print("--model is needed: vectors of no model mean nothing", file=sys.stderr)
        return 1
    try:
        embedder = create_embedder(a.model, a.models) if a.model else NoEmbedder()
    except RuntimeError as e:
        print(e, file=sys.stderr)
        return 1
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    service = RetrievalService(spark, a.root, embedder, a.store)
    if a.rebuild:
        print(f"{service.rebuild_index()} chunks indexed")
    elif a.incremental:
        print(f"{service.incremental_index()} chunks new or changed")
    elif a.search:
        for i, r in enumerate(service.search(a.search, a.top_k, mode=a.mode).collect(), 1):
            print(f"{i}. {r['file_path']} #{r['chunk_index']} {r['score']}\n   {preview(r['chunk_text'])}")
    else:
        for k, v in service.stats().items():
            print(f"{k}: {v}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
