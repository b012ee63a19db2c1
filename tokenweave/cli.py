"""Command line: ``python -m tokenweave.cli build ...`` and ``... search ...``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .index import MultiVectorIndex
from .operators.evaluate import evaluate
from .options import SearchOptions
from .sources import ground_truth, mvbin


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="tokenweave", exit_on_error=False)
    parser.error = _raise
    sub = parser.add_subparsers(dest="command")
    build = sub.add_parser("build")
    build.add_argument("--index", "-i", required=True)
    build.add_argument("--doclens", "-d", required=True)
    build.add_argument("--data", required=True)
    build.add_argument("--n-clusters", type=int, required=True)
    build.add_argument("--ex-bits", type=int, required=True)
    search = sub.add_parser("search")
    search.add_argument("--query", "-q", required=True)
    search.add_argument("--gt", "-g", required=True)
    search.add_argument("--index", "-i", required=True)
    search.add_argument("--k", type=int, default=100)
    search.add_argument("--nq", type=int, default=-1)
    search.add_argument("--warmup", type=int, default=5)
    base = SearchOptions()
    for name in ("nprobe", "k_refine", "k_full_bit", "cagra_itopk_size", "num_chunks"):
        search.add_argument(f"--{name.replace('_', '-')}", type=int, default=getattr(base, name))
    for p in (build, search):
        p.error = _raise
    return parser


def _raise(message: str) -> None:
    raise ValueError(message)


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    parser = _parser()
    if not argv:
        parser.print_help()
        return 0
    try:
        args = parser.parse_args(argv)
        options = SearchOptions(args.nprobe, args.k_refine, args.k_full_bit, args.cagra_itopk_size, args.num_chunks) if args.command == "search" else None
        if args.command == "search" and args.k <= 0:
            raise ValueError("k must be positive")
    except (ValueError, argparse.ArgumentError) as e:
        print(e, file=sys.stderr)
        parser.print_help(sys.stderr)
        return 1
    spark = SparkSession.builder.getOrCreate()
    if args.command == "build":
        tokens, lens = mvbin.read(spark, args.data, "embeddings"), mvbin.read(spark, args.doclens, "doclens")
        MultiVectorIndex.build(tokens, lens, args.n_clusters, args.ex_bits).save(args.index)
        return 0
    queries = mvbin.read(spark, args.query, "queries").cache()
    index = MultiVectorIndex.load(spark, args.index, options)
    n = queries.select("query_id").distinct().count()
    truth = ground_truth.read(spark, args.gt, 1000, n)
    recalls, latency = evaluate(index, queries, truth, args.k, args.nq, args.warmup)
    for row in recalls.collect():
        print(f"recall@{row['k']}: {row['recall']:.6f}")
    for name, value in latency.head().asDict().items():
        print(f"latency {name} ms: {value:.3f}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
