"""Collecting the documents that hold every keyword as whole words, without duplicates of what is there."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.querytext import keyword_pattern
from foliant.functions.text import blank_if_null
from foliant.operators.incremental import ranked
from foliant.shared import small_or_shuffled

MATCH_FIELDS = ("title", "authors", "abstract", "keywords", "fulltext")


@dataclass(frozen=True)
class AggregateStats:
    total_indexed: int = 0
    candidates: int = 0
    matched: int = 0
    copied: int = 0
    skipped_existing: int = 0
    skipped_nonpaper: int = 0
    errors: int = 0
    cancelled: bool = False
    dest_dir: str = ""


def match_text(fields=MATCH_FIELDS) -> Column:
    return F.concat_ws(" ", *[blank_if_null(F.col(f)) for f in fields])


def matches_all(text: Column, keywords: list[str], match_case: bool = False) -> Column:
    """Whether a text holds every keyword; blank keywords are ignored, none at all matches everything."""
    patterns = [p for p in (keyword_pattern(k, match_case) for k in keywords) if p]
    return reduce(lambda a, b: a & b, [text.rlike(p) for p in patterns], F.lit(True))


def outside(path: Column, folder: str) -> Column:
    """Not below ``folder``."""
    return ~F.startswith(path, F.lit(folder.rstrip("/") + "/"))


def split_matches(papers: DataFrame, keywords: list[str], dest: str = "", match_case: bool = False, require_scholarly: bool = True) -> DataFrame:
    """Matching documents outside ``dest``, with verdict "matched" or "nonpaper"."""
    rows = papers.where(outside(F.col("path"), dest)) if dest else papers
    rows = rows.where(matches_all(match_text(), keywords, match_case))
    verdict = F.when((F.col("is_scholarly") == 1) | F.lit(not require_scholarly), "matched").otherwise("nonpaper")
    return rows.withColumn("verdict", verdict)


def first_copies(rows: DataFrame, size: str = "size", digest: str = "digest", order: str = "path") -> DataFrame:
    """The first row, by ``order``, of each content; a minimum by partial aggregation, no window over a hot content."""
    return rows.groupBy(size, digest).agg(F.min(order).alias(order), F.count("*").alias("copies"))


def content_duplicates(rows: DataFrame) -> DataFrame:
    """Rows whose content an earlier path has."""
    first = first_copies(rows).select(F.col("size").alias("_s"), F.col("digest").alias("_d"), F.col("path").alias("_p"))
    joined = rows.join(first, (F.col("size") == F.col("_s")) & (F.col("digest") == F.col("_d")) & (F.col("path") != F.col("_p")), "left_semi")
    return joined


def size_bucket(sources: DataFrame, destination: DataFrame) -> DataFrame:
    """Sources whose size some destination file has: only these need the destination's digests."""
    return sources.join(destination.select("size").distinct(), "size", "left_semi")


def met_sizes(sources: DataFrame, destination: DataFrame) -> DataFrame:
    """(size) of the sources that share it with another source or a destination file: only files of these are opened."""
    every = sources.select("size", F.lit(1).alias("own")).unionByName(destination.select("size", F.lit(0).alias("own")))
    return every.groupBy("size").agg(F.count("*").alias("n"), F.sum("own").alias("own")).where("n > 1 and own > 0").select("size")


def digested(files: DataFrame, sizes: DataFrame, digest) -> DataFrame:
    """Files (path, size) with digest and error: ``digest`` adds both where the size is in ``sizes``, else both are null."""
    sizes = small_or_shuffled(sizes.withColumnRenamed("size", "_size"))
    same = F.col("size") == F.col("_size")
    rest = files.join(sizes, same, "left_anti").select("path", "size", F.lit(None).cast("string").alias("digest"), F.lit(None).cast("string").alias("error"))
    return digest(files.join(sizes, same, "left_semi").select("path", "size")).unionByName(rest)


def copy_plan(sources: DataFrame, destination: DataFrame) -> DataFrame:
    """What to do with each source (path, size, digest): "copy", or "skip" if its content is there or comes before.

    A null digest says that no other file has the size: such a source is copied.
    """
    there = destination.where("digest is not null").join(sources.select("size").distinct(), "size", "left_semi").select("size", "digest").distinct().withColumn("_there", F.lit(True))
    known = sources.where("digest is not null")
    first = first_copies(known).select("size", "digest", F.col("path").alias("_first"))
    rows = known.join(there, ["size", "digest"], "left").join(first, ["size", "digest"])
    skip = F.coalesce(F.col("_there"), F.lit(False)) | (F.col("path") != F.col("_first"))
    rows = rows.select("path", "size", "digest", F.when(skip, "skip").otherwise("copy").alias("action"))
    return rows.unionByName(sources.where("digest is null").select("path", "size", "digest", F.lit("copy").alias("action")))


def _split_name(name: Column) -> tuple[Column, Column]:
    """(stem, extension with its dot) of a file name; a name that only begins with a dot has no extension."""
    dot = F.length(name) - F.locate(".", F.reverse(name))
    stem = F.when(F.contains(name, F.lit(".")) & (dot > 0), F.left(name, dot)).otherwise(name)
    return stem, F.substring(name, F.length(stem) + 1, F.length(name))


def name_plan(rows: DataFrame, path: str = "path", taken: DataFrame | None = None) -> DataFrame:
    """(path, name): names for files that share one, "a.pdf", "a (1).pdf", ... in the order of paths, none ``taken`` (name).

    A file's place among those of its name is found by ranges (``ranked``), so one name that very many files have is no
    single task's. Numbered forms that are taken, or are the own name of another file, are passed over: with o(1) < o(2) < ...
    the numbers taken, the k-th file gets k plus the number of j with o(j) - j <= k, both counted from 0.
    """
    base = F.element_at(F.split(F.col(path), "/"), -1)
    narrow = rows.select(F.col(path).alias("path"), base.alias("base"))
    placed = ranked(narrow, "path", "base").withColumnRenamed("_rank", "k")
    names = narrow.select(F.col("base").alias("name"), F.lit(0).alias("held"))
    if taken is not None:
        names = names.unionByName(taken.select("name", F.lit(1).alias("held")))
    names = names.groupBy("name").agg(F.max("held").alias("held"))
    stem, ext = _split_name(F.col("name"))
    number = F.regexp_extract(stem, r"^.+ \(([1-9][0-9]{0,8})\)$", 1)
    of = F.concat(F.regexp_extract(stem, r"^(.+) \([1-9][0-9]{0,8}\)$", 1), ext)
    held = names.where(number != "").select(of.alias("base"), number.cast("long").alias("o")).unionByName(names.where("held = 1").select(F.col("name").alias("base"), F.lit(0).cast("long").alias("o")))
    held = held.join(narrow.select("base").distinct(), "base", "left_semi")
    # runs of numbers that follow each other have one o - j: a name has as many pairs as it has gaps
    runs = ranked(held, "o", "base").select("base", (F.col("o") - F.col("_rank")).alias("g")).groupBy("base", "g").count()
    runs = runs.groupBy("base").agg(F.collect_list(F.struct("g", "count")).alias("runs"))
    out = placed.join(runs, "base", "left")
    passed = F.aggregate(F.filter("runs", lambda r: r["g"] <= F.col("k")), F.lit(0).cast("long"), lambda s, r: s + r["count"])
    out = out.withColumn("n", F.col("k") + F.coalesce(passed, F.lit(0)))
    stem, ext = _split_name(F.col("base"))
    name = F.when(F.col("n") == 0, F.col("base")).otherwise(F.concat(stem, F.lit(" ("), F.col("n").cast("string"), F.lit(")"), ext))
    return out.select(F.col("path").alias(path), name.alias("name"))


def aggregate_counts(split: DataFrame, plan: DataFrame, total: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """One row of counters over what matched and what is to be copied; ``candidates``: the documents that were tried."""
    a = split.agg(F.count_if(F.col("verdict") == "matched").alias("matched"), F.count_if(F.col("verdict") == "nonpaper").alias("skipped_nonpaper"))
    b = plan.agg(F.count_if(F.col("action") == "copy").alias("copied"), F.count_if(F.col("action") == "skip").alias("skipped_existing"))
    out = total.agg(F.count("*").alias("total_indexed")).crossJoin(F.broadcast(a)).crossJoin(F.broadcast(b))  # one row each
    return out if candidates is None else out.crossJoin(F.broadcast(candidates.agg(F.count("*").alias("candidates"))))
