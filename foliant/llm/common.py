"""What the operators of this subpackage share: shipping code, shared tables, checked broadcasts, components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.shared import forget, path_of, send_code, settled, shared_dir, small_or_shuffled, spread

#: Rows of text to an Arrow batch; bounds a Python worker's memory when rows are long.
TEXT_BATCH = 400


def prepare(spark: SparkSession, batch: int = TEXT_BATCH) -> None:
    """Send this library to the executors and set the rows of an Arrow batch: few where rows are texts."""
    send_code(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))


def boxed(docs: DataFrame, **columns: Column) -> DataFrame:
    """``docs`` as one struct column _row beside ``columns``, so that no name of an extra column can clash."""
    whole = F.struct(*[F.col(f"`{c}`").alias(c) for c in docs.columns]).alias("_row")
    return docs.select(whole, *[c.alias(k) for k, c in columns.items()])


def unboxed(rows: DataFrame, *more: str) -> DataFrame:
    return rows.select("_row.*", *more)


def bucket_of(key: Column, mod: int) -> Column:
    """CRC-32 of a key written as text, modulo ``mod``; null keys count as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % mod


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver's; texts are dealt over all cores where the file has few parts."""
    scan = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(scan) if name in ("documents", "pages") else scan


def sampled(rows: DataFrame, key: Column, most: int) -> DataFrame:
    """All rows if they are ``most`` at most, else those whose key has a hash below a threshold: about 4 % less than ``most``.

    ``key`` should differ between rows. Every executor filters its own rows, so none sends more than its share.
    """
    n = rows.count()
    share = F.shiftrightunsigned(F.xxhash64(F.lit(77), key), 12).cast("double") / F.lit(float(1 << 52))
    return rows if n <= most else rows.where(share < F.lit(0.96 * most / n))


def met(big: DataFrame, small: DataFrame, on: list[str], count: str) -> DataFrame:
    """``big`` joined with ``small`` on ``on`` (not null), where a row of ``small`` says in ``count`` how many rows it meets.

    Keys that hold over 1/200 of all rows, 200 at most, are broadcast; the others are shuffled.
    """
    total = small.agg(F.sum(count)).first()[0] or 0
    hot = small.where(F.col(count) * 200 > total)
    if hot.isEmpty():
        return big.join(small, on)
    keys = F.broadcast(hot.select(*on))
    cold = small.where(F.col(count) * 200 <= total)
    return big.join(F.broadcast(hot), on).unionByName(big.join(keys, on, "left_anti").join(cold, on))


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links u-v reduced to one link from each node to the smallest node of its component among these links."""
    if not len(u):
        return u, v
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label = jumped
        if np.array_equal(before, label):
            break
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def _starred(batches, schema):
    """A task's links, reduced to stars block by block: memory stays bounded and no connection is lost."""
    held_u, held_v, n = [], [], 0

    def flush():
        u, v = stars(np.concatenate(held_u), np.concatenate(held_v))
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    for batch in batches:
        held_u.append(batch.column(0).to_numpy())
        held_v.append(batch.column(1).to_numpy())
        n += batch.num_rows
        if n >= 2_000_000:
            yield flush()
            held_u, held_v, n = [], [], 0
    if n:
        yield flush()


def components(links: DataFrame, name: str = "components", many_links: int = 1_000_000) -> DataFrame:
    """Connected components of links (u, v: long, not null): rows (node, root), root the smallest node reachable.

    Alternating large-star and small-star rounds on distinct links; each round is two aggregations and one join on the
    node, and is written to the shared folder. A task first joins the links it holds, so chains shrink before any
    shuffle. Where links are many, nodes of very many links are met by broadcast (``met``), so no task gets a star whole.
    Rounds go on until nothing changes. Empty input: no rows.
    """
    spark = links.sparkSession
    prepare(spark)
    local = links.select("u", "v").mapInArrow(lambda it: _starred(it, None), "u long, v long")
    now = settled(local.where("u <> v").distinct(), name)
    total, many = None, now.count() > many_links

    def lows(rows):
        """(u, m, n): the least neighbour and the number of links of each node of ``rows``."""
        found = rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        return settled(found, f"{name}-lows") if many else found

    def joined(rows, low):
        return met(rows, low, ["u"], "n") if many else rows.join(low, "u")

    while True:
        # large star: each neighbour larger than u points to the least neighbour of u
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = lows(both)
        large = joined(both.where("v > u"), least).select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        large = settled(large.where("u <> v").distinct(), name)
        # small star: links point down; u and its smaller neighbours point to the least of them
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = lows(down)
        small = joined(down, low).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        after = settled(small, name, drop=[path_of(now), path_of(large), *([path_of(least)] if many else [])])
        if many:
            forget(spark, path_of(low))
        # links only ever move to smaller ends: equal counts and sums mean that nothing moved
        print_ = after.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        mark = (print_["n"], print_["s"])
        if mark == total:
            return after.select(F.col("u").alias("node"), F.col("v").alias("root"))
        total, now = mark, after


__all__ = [
    "TEXT_BATCH", "boxed", "bucket_of", "components", "forget", "met", "path_of", "prepare", "sampled", "settled", "shared_dir", "small_or_shuffled", "stars", "table",
    "unboxed",
]
