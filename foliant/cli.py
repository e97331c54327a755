"""Command line: index a folder, search it, or collect exact matches from it."""

from __future__ import annotations

import argparse
import os
import sys

from foliant.config import Settings, configure_logging


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="foliant", description="Search and curate a folder of documents.")
    p.add_argument("--index", metavar="DIR", help="folder to index")
    p.add_argument("--force", action="store_true", help="read every file again")
    p.add_argument("--workers", type=int, default=0, help="partitions for extraction")
    p.add_argument("--collect", action="store_true", help="copy exact matches to --dest")
    p.add_argument("--dest", metavar="DIR")
    p.add_argument("--keywords", default="", help="words or phrases, comma-separated; all must match")
    p.add_argument("--match-case", action="store_true")
    p.add_argument("--query", help="search terms")
    p.add_argument("--years", help='"2024", "2020-2025", "2020-", "-2019"')
    p.add_argument("--top", type=int, default=30)
    return p


def shown(done: int, total: int) -> None:
    print(f"\r{done} of {total} tasks", end="", file=sys.stderr, flush=True)


def main(argv: list[str] | None = None, spark=None) -> int:
    """Exit code: 0 well, 1 errors on the way, 2 wrong arguments."""
    p = parser()
    args = p.parse_args(argv)
    if args.collect and not (args.index and args.dest):
        p.error("--collect needs --index and --dest")
    if not args.index:
        p.error("--index is needed")
    settings = Settings.from_environment()
    if args.workers:
        settings = Settings(**{**settings.__dict__, "workers": args.workers})
    configure_logging(settings)
    if not os.path.isdir(args.index):
        print(f"no folder: {args.index}", file=sys.stderr)
        return 2
    from foliant.functions.querytext import parse_keywords
    from foliant.plans.library import Library

    if args.collect and not parse_keywords(args.keywords):
        print("no keywords", file=sys.stderr)
        return 2
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("foliant").getOrCreate()
    library = Library.beside(spark, os.path.abspath(args.index), settings)
    if args.collect:
        try:
            done = library.collect(args.index, args.dest, args.keywords, args.match_case)
        except ValueError as error:
            print(error, file=sys.stderr)
            return 2
        print(f"matched {done.matched}, copied {done.copied}, already there {done.skipped_existing}, no papers {done.skipped_nonpaper}, errors {done.errors}")
        return int(done.errors > 0)
    stats = library.update_from_files(os.path.abspath(args.index), args.force, progress=shown if sys.stderr.isatty() else None)
    for sample in stats.error_samples:
        print(f"not indexed: {sample}", file=sys.stderr)
    print(f"total {stats.total}, indexed {stats.indexed}, cached {stats.skipped}, errors {stats.errors}, no papers {library.count_nonscholarly()}")
    if args.query:
        for row in library.search(args.query, args.years, args.top).toLocalIterator():
            print(f"{row['relevance']:3d}  {row['title'] or row['filename']}  [{row['path']}]")
    return int(stats.errors > 0)


if __name__ == "__main__":
    sys.exit(main())
