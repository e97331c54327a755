"""Exact top-k by inner product over vectors taken in descending length, with SVD-rotated partial sums.

All vectors are rotated by the right singular vectors of the collection, so their first coordinates hold most of
their length. A query q meets a block of candidates only if |q| times the block's largest length can reach the query's
threshold. Within a block, the product of the first ``HEAD`` coordinates plus the product of the lengths of the
residuals (Cauchy-Schwarz) bounds each score. Where many candidates are left, the next coordinates are added, twice as
many each time, and the residuals shrink; what is left in the end is scored in exact integers. Thresholds start from the
``FIRST`` longest vectors and rise as blocks, longest first, are read.

Queries are cut into groups and candidates into blocks of like length, each as large as ``BYTES`` allow; a task holds one
block and reads its visitors. Work grows with queries times the candidates that pass the length bound.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import path_of, prepare, settled, small_or_shuffled
from foliant.llm.embedding_dedup import matrix

SCALE, TOP = 64, 20
FIRST, HEAD = 2048, 16
#: Doubles of a block or of a group of queries; and rows that one has at least, where the collection is small.
BYTES, LEAST_BLOCK = 16 << 20, 4096
#: Share of candidates left from which the next coordinates are added rather than rows picked.
MANY = 0.02
#: Largest length of a vector of integers; any product of two then fits a long.
LONGEST = float(1 << 31)


def quantised(vec: Column) -> Column:
    """floor(64 * x) of each component x, as double; null for vectors that take no part.

    Those are null or hold null or non-finite components, or are longer than ``LONGEST`` once quantised: their scores need
    not fit a long.
    """
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    large = F.exists(vec, lambda x: F.abs(x.cast("double")) * SCALE > LONGEST)
    whole = F.transform(vec, lambda x: F.floor(x.cast("double") * F.lit(float(SCALE))).cast("double"))
    return F.when(vec.isNotNull() & ~bad & ~large & (length_of(whole) <= LONGEST), whole)


def length_of(vec: Column) -> Column:
    return F.sqrt(F.aggregate(vec, F.lit(0.0), lambda s, x: s + x * x))


class Rotation:
    """An orthogonal map from the collection's second moments, and the ends of the partial sums."""

    def __init__(self, moments: np.ndarray):
        _, vectors = np.linalg.eigh(moments)
        self.vectors, dim = vectors[:, ::-1].copy(), len(moments)
        self.ends = [min(dim, HEAD << k) for k in range(64) if k == 0 or HEAD << (k - 1) < dim]

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """(rotated rows, the length of what lies beyond each end)."""
        turned = x @ self.vectors
        total = (x * x).sum(1)
        # what rounding may take is added by the caller in proportion to whole lengths
        return turned, [np.sqrt(np.maximum(total - (turned[:, :e] ** 2).sum(1), 0.0)) for e in self.ends]


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products of integer-valued doubles, in 64-bit integers: no product of two vectors is larger."""
    return (a.astype(np.int64) * b.astype(np.int64)).sum(1)


def best(query: np.ndarray, other: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best rows of each query: highest score, ties to the smaller id."""
    order = np.lexsort((other, -score, query))
    q = query[order]
    start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
    rank = np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)]))
    return order[rank < k]


def _moments(batches, dim: int):
    total = np.zeros((dim, dim))
    for batch in batches:
        x = matrix(batch.column(0), dim)
        total += x.T @ x
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim * dim)), pa.array(total.ravel())], names=["cell", "part"])


def _first_thresholds(batches, ids: np.ndarray, x: np.ndarray, k: int, dim: int):
    """Adds to each query the k-th best score among the longest vectors, its own left out (null if they are too few)."""
    for batch in batches:
        own, q = batch.column("row").to_numpy(), matrix(batch.column("vec"), dim)
        s = q @ x.T if len(x) else np.zeros((len(q), 0))
        s[own[:, None] == ids[None, :]] = -np.inf
        low = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] >= k else np.full(len(q), -np.inf)
        floor = np.where(np.isfinite(low), low - np.abs(low) * 1e-9 - 0.5, -np.inf)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(floor, pa.float64())], names=[*batch.schema.names, "floor"])


def _searched(batches, rotation: Rotation, k: int, dim: int):
    """The k best of each query in each block: rows sorted by bucket, candidates (role 0) before queries (role 1)."""
    now, parts, block = None, [], None
    for batch in batches:
        bucket, role = batch.column("bucket").to_numpy(), batch.column("role").to_numpy()
        row, ids = batch.column("row").to_numpy(), batch.column("id").to_numpy()
        floor, x = batch.column("floor").to_numpy(), matrix(batch.column("vec"), dim)
        cuts = np.flatnonzero((bucket[1:] != bucket[:-1]) | (role[1:] != role[:-1])) + 1
        for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(bucket)]):
            if bucket[a] != now:
                now, parts, block = bucket[a], [], None
            if role[a] == 0:
                parts.append((row[a:b], ids[a:b], x[a:b]))
                continue
            if not parts:
                continue
            if block is None:
                crow, cid, cx = (np.concatenate(z) for z in zip(*parts))
                order = np.argsort(-(cx * cx).sum(1), kind="stable")  # longest first
                cx = cx[order]
                block = (crow[order], cid[order], cx, rotation(cx), np.sqrt((cx * cx).sum(1)))
            yield from _against(block, row[a:b], ids[a:b], x[a:b], floor[a:b].copy(), rotation, k)


def _against(block, row, ids, q, floor, rotation, k):
    crow, cid, cx, (cturned, crest), clength = block
    qturned, qrest = rotation(q)
    qlength = np.sqrt((q * q).sum(1))
    kept = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))
    for at in range(0, len(cx), 512):
        to = min(len(cx), at + 512)
        able = np.flatnonzero(qlength * clength[at] * (1 + 1e-9) + 1e-6 >= floor)  # the longest that is left
        if not len(able):
            break
        slack = np.outer(qlength[able], clength[at:to]) * 1e-9 + 1e-6
        partial, begin = np.zeros((len(able), to - at)), 0
        for step, end in enumerate(rotation.ends):
            partial += qturned[able, begin:end] @ cturned[at:to, begin:end].T
            bound = partial + slack if end == len(rotation.vectors) else partial + np.outer(qrest[step][able], crest[step][at:to]) + slack
            left, begin = bound >= floor[able][:, None], end
            if left.mean() <= MANY:
                break
        i, j = np.nonzero(left)
        i, j = able[i], j + at
        ok = row[i] != crow[j]
        i, j = i[ok], j[ok]
        for part in range(0, len(i), 1 << 16):  # bounded memory
            u, v = i[part : part + (1 << 16)], j[part : part + (1 << 16)]
            score = exact_scores(q[u], cx[v])
            good = score >= floor[u]
            kept = tuple(np.concatenate(z) for z in zip(kept, (u[good], v[good], score[good])))
            keep = best(kept[0], cid[kept[1]], kept[2], k)
            kept = tuple(z[keep] for z in kept)
            full = np.bincount(kept[0], minlength=len(q)) >= k
            low = np.full(len(q), np.inf)
            np.minimum.at(low, kept[0], kept[2].astype(float))
            floor = np.where(full, np.maximum(floor, low), floor)
    if len(kept[0]):
        names = ["query_row", "query_id", "vec_id", "score"]
        yield pa.RecordBatch.from_arrays([pa.array(row[kept[0]]), pa.array(ids[kept[0]]), pa.array(cid[kept[1]]), pa.array(kept[2])], names=names)


def _dealt(n: int, dim: int, spark) -> int:
    """In how many parts n vectors are dealt: as few as memory allows, but some for each core where they are many."""
    return max(1, -(-n * dim * 8 // BYTES), min(-(-n // LEAST_BLOCK), 2 * spark.sparkContext.defaultParallelism))


def search(vectors: DataFrame, queries: Column, key: str = "vec_id", vec: str = "embedding", k: int = TOP) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k best candidates of each row for which ``queries`` holds.

    Candidates are all rows but the query's own. Vectors that are null, hold null or non-finite components or are longer
    than ``LONGEST`` once quantised take no part; shorter ones count as padded with zeros; empty ones are zero. Rows
    without a key take no part, as results name keys. Repeated rows are candidates of their own and queries of their own.
    Ties go to the smaller id. Extra columns are not read, but ``queries`` may. Empty tables give no rows.
    """
    spark = vectors.sparkSession
    prepare(spark, 1024)
    rows = vectors.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), quantised(F.col(vec)).alias("vec"), F.coalesce(queries, F.lit(False)).alias("asks"))
    rows = rows.where("vec is not null").withColumn("length", length_of(F.col("vec")))
    rows = settled(rows.withColumn("row", F.monotonically_increasing_id()), "topk-rows")
    about = rows.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("dim"), F.count_if("asks").alias("asked")).first()
    dim, n = max(1, about["dim"] or 1), about["n"]
    found = rows.select("vec").mapInArrow(lambda it: _moments(it, dim), "cell long, part double").groupBy("cell").agg(F.sum("part").alias("part")).toArrow()
    moments = np.zeros(dim * dim)  # dim * dim numbers come to the driver
    moments[found["cell"].to_numpy()] = found["part"].to_numpy()
    rotation = Rotation(moments.reshape(dim, dim))

    # blocks of like length; a length that many vectors share is spread over several blocks
    placed = rows.select("row", "id", "vec", "length").repartitionByRange(_dealt(n, dim, spark), F.col("length").desc(), F.col("row"))
    placed = settled(placed.withColumn("block", F.spark_partition_id()), "topk-blocks")
    extent = settled(placed.groupBy("block").agg(F.max("length").alias("most"), F.count("*").alias("rows")), "topk-extent")
    # thresholds start from the first blocks, which hold the longest: FIRST vectors of them
    begun, total = [], 0
    for r in extent.orderBy("block").limit(FIRST).collect():
        begun.append(r["block"])
        total += r["rows"]
        if total >= FIRST:
            break
    longest = placed.where(F.col("block").isin(begun)).select("row", "vec", "length").orderBy(F.col("length").desc(), "row").limit(FIRST).toArrow().combine_chunks()
    first, firsts = longest["row"].to_numpy(), matrix(longest["vec"].combine_chunks(), dim) if longest.num_rows else np.zeros((0, dim))

    asked = rows.where("asks").select("row", "id", "vec", "length")
    asked = asked.mapInArrow(lambda it: _first_thresholds(it, first, firsts, k, dim), "row long, id long, vec array<double>, length double, floor double")
    parts = max(1, -(-about["asked"] * dim * 8 // BYTES))
    groups = settled(asked.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(parts))), "topk-queries", drop=[path_of(rows)])
    extent = small_or_shuffled(extent)
    visits = groups.join(extent, F.col("length") * F.col("most") * (1 + 1e-9) + 1e-6 >= F.col("floor"))
    met = visits.select("block", "group").distinct()
    own = F.xxhash64("block", "group").alias("bucket")
    asking = visits.select(own, F.lit(1).alias("role"), "row", "id", "vec", "floor")
    asked_of = placed.join(small_or_shuffled(settled(met, "topk-met")), "block").select(own, F.lit(0).alias("role"), "row", "id", "vec", F.lit(0.0).alias("floor"))
    both = asked_of.unionByName(asking).repartition("bucket").sortWithinPartitions("bucket", "role")
    out = both.mapInArrow(lambda it: _searched(it, rotation, k, dim), "query_row long, query_id long, vec_id long, score long")
    w = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
