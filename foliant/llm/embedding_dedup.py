"""Embedding near-duplicates by an inverted multi-index: product cells, multi-sequence traversal, exact verification.

Vectors are cut into halves with a codebook each; a pair of codewords is a cell. A vector visits its nearest cells in
the order of the multi-sequence algorithm (Babenko and Lempitsky), as many as the target recall asks for; the number is
measured on pairs of exactly the threshold's cosine, made from the sample, and on real pairs within the sample. All
members of a visited cell are verified by cosine in double precision. A link found from either side counts for both.
With a recall of 1 a vector visits every cell that can hold a vector within the threshold: by the triangle inequality a
vector of another codeword lies beyond the plane half-way, and the distances of both halves add up.

Equal vectors of one label are one class: found by two 64-bit hashes, compared once, counted with their number. The
codebooks are fitted on at most ``SAMPLE`` classes (those with a low hash); every vector is indexed. Cells of more
than ``CELL_ROWS`` members are split into parts by both sides, so no task holds more than that many members.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import components, forget, met, path_of, prepare, sampled, settled, small_or_shuffled, stars

COSINE, TARGET = 0.93, 0.995
SAMPLE, CELL_ROWS, CELL_AIM = 20_000, 4096, 64
#: Codewords a half: as many as cells of the size aimed at ask for, and no more than the sample can place (20 vectors each).
LEAST_WORDS, MOST_WORDS = 4, SAMPLE // 20
BATCH = 4096


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """An Arrow list column without nulls as a matrix of doubles, short rows padded with zeros."""
    flat = np.asarray(column.flatten(), np.float64)
    sizes = np.diff(np.asarray(column.offsets))
    if len(sizes) and (sizes == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(sizes), dim))
    ends = np.cumsum(sizes)
    for i, (n, e) in enumerate(zip(sizes, ends)):
        out[i, :n] = flat[e - n : e]
    return out


def unit(x: np.ndarray) -> np.ndarray:
    scale = np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)  # no overflow in the squares
    x = x / scale
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def kmeans(x: np.ndarray, k: int, rng, rounds: int = 12) -> np.ndarray:
    words = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = squared(x, words).argmin(axis=1)
        for j in range(len(words)):
            own = x[near == j]
            words[j] = own.mean(axis=0) if len(own) else x[rng.integers(len(x))]
    return words


def squared(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ words.T + (words * words).sum(1)


class MultiIndex:
    """Codebooks of both halves and the number of cells that a vector visits; 0: all that can hold a near one."""

    def __init__(self, first: np.ndarray, second: np.ndarray, visits: int = 1):
        self.first, self.second, self.visits = first, second, visits
        self.grid = None
        self.apart = [np.sqrt(np.maximum(squared(w, w), 1e-300)) for w in (first, second)]

    @property
    def half(self) -> int:
        return self.first.shape[1]

    def cells(self, x: np.ndarray) -> np.ndarray:
        """The cell of each unit vector."""
        return squared(x[:, : self.half], self.first).argmin(1) * len(self.second) + squared(x[:, self.half :], self.second).argmin(1)

    def nearest(self, x: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` nearest cells of each vector in multi-sequence order, nearest first."""
        d1, d2 = squared(x[:, : self.half], self.first), squared(x[:, self.half :], self.second)
        o1, o2 = d1.argsort(1), d2.argsort(1)
        n = min(n, len(self.first) * len(self.second))
        if self.grid is None or self.grid[0] != n:
            # a cell of ranks (i, j) has (i + 1)(j + 1) - 1 cells at least as near before it
            i, j = np.meshgrid(np.arange(len(self.first)), np.arange(len(self.second)), indexing="ij")
            able = (i + 1) * (j + 1) <= n
            self.grid = n, i[able], j[able]
        _, i, j = self.grid
        total = np.take_along_axis(d1, o1, 1)[:, i] + np.take_along_axis(d2, o2, 1)[:, j]
        order = total.argsort(1, kind="stable")[:, :n]
        return np.take_along_axis(o1[:, i], order, 1) * len(self.second) + np.take_along_axis(o2[:, j], order, 1)

    def ranks(self, x: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """The place, 1 first, of a cell in each vector's multi-sequence order."""
        d1, d2 = squared(x[:, : self.half], self.first), squared(x[:, self.half :], self.second)
        row = np.arange(len(x))
        total = d1[row, cells // len(self.second)] + d2[row, cells % len(self.second)]
        d2, near = np.sort(d2, axis=1), 1e-12  # less than rounding does not count as nearer
        return np.array([1 + np.searchsorted(d2[i], total[i] - near - d1[i], "left").sum() for i in row])

    def within(self, x: np.ndarray, radius: float) -> list[np.ndarray]:
        """For each vector every cell that can hold a vector at most ``radius`` away."""
        bounds = []
        for part, words, apart in ((x[:, : self.half], self.first, self.apart[0]), (x[:, self.half :], self.second, self.apart[1])):
            d = squared(part, words)
            own = d.argmin(1)
            # half-way planes between the own codeword and each other
            bounds.append(np.maximum(d - d[np.arange(len(d)), own][:, None], 0) ** 2 / (4 * apart[own] ** 2))
        most = radius * radius * (1 + 1e-9) + 1e-12
        return [np.flatnonzero((a[:, None] + b[None, :] <= most).ravel()) for a, b in zip(*bounds)]


def fit(x: np.ndarray, label: np.ndarray, rows_per_label: float, seed: int = 9, recall: float = TARGET) -> MultiIndex:
    """Codebooks from unit vectors, sized for about ``CELL_AIM`` members a cell, and the visits the recall asks for."""
    rng = np.random.default_rng(seed)
    words = int(min(MOST_WORDS, max(LEAST_WORDS, 2 ** round(math.log2(max(1.0, math.sqrt(rows_per_label / CELL_AIM)))))))
    half = x.shape[1] // 2
    index = MultiIndex(kmeans(x[:, :half], words, rng), kmeans(x[:, half:], words, rng))
    if recall >= 1:
        index.visits = 0
        return index
    # worst pairs: a random step from a sampled vector to the threshold's cosine
    a = x[rng.choice(len(x), min(len(x), 2000), replace=False)]
    step = rng.standard_normal(a.shape)
    step -= (step * a).sum(1, keepdims=True) * a
    b = unit(COSINE * a + math.sqrt(1 - COSINE**2) * unit(step))
    pairs = [(a, b)]
    for k in np.unique(label)[:50]:  # real pairs
        own = x[label == k][:1500]
        u, v = np.nonzero(np.triu(own @ own.T >= COSINE, 1))
        pick = rng.choice(len(u), min(len(u), 200), replace=False) if len(u) else []
        pairs.append((own[u[pick]], own[v[pick]]) if len(u) else (own[:0], own[:0]))
    a, b = (np.concatenate(z) for z in zip(*pairs))
    found = np.minimum(index.ranks(a, index.cells(b)), index.ranks(b, index.cells(a)))  # either side may find the other
    index.visits = int(np.quantile(found, recall, method="higher"))
    return index


def _placed(batches, index: MultiIndex, dim: int):
    for batch in batches:
        x = unit(matrix(batch.column("vec"), dim))
        # a few rows at a time: a row's cells may be many
        visits = [v for at in range(0, len(x), 64) for v in (index.nearest(x[at : at + 64], index.visits) if index.visits else index.within(x[at : at + 64], math.sqrt(2 - 2 * COSINE)))]
        columns = [*batch.columns, pa.array(index.cells(x), pa.int32()), pa.array([v.astype(np.int32) for v in visits], pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "cell", "visits"])


def _verified(batches, dim: int, exact: bool):
    """Counts and links of a task's buckets: rows sorted by bucket, members (role 0) before visitors (role 1).

    If ``exact``, each of two near vectors visits the other's cell, and every link is met twice.
    """
    now, parts, members = None, [], None
    counts: dict[int, int] = {}
    links, pending = [], 0

    def flush():
        nonlocal counts, links, pending
        ids = np.fromiter(counts.keys(), np.int64, len(counts))
        n = np.fromiter(counts.values(), np.int64, len(counts))
        u, v = stars(np.concatenate([a for a, _ in links]), np.concatenate([b for _, b in links])) if links else (ids[:0], ids[:0])
        counts, links, pending = {}, [], 0
        return pa.RecordBatch.from_arrays(
            [pa.array(np.r_[ids, u]), pa.array(np.r_[n, v]), pa.array(np.r_[np.zeros(len(ids), bool), np.ones(len(u), bool)])], names=["id", "other", "link"]
        )

    for batch in batches:
        bucket, role = batch.column("bucket").to_numpy(), batch.column("role").to_numpy()
        ids, size, cell = (batch.column(c).to_numpy() for c in ("id", "n", "cell"))
        x = unit(matrix(batch.column("vec"), dim))
        visits = batch.column("visits")
        cuts = np.flatnonzero((bucket[1:] != bucket[:-1]) | (role[1:] != role[:-1])) + 1
        for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(bucket)]):
            if bucket[a] != now:
                now, parts, members = bucket[a], [], None
            if role[a] == 0:
                own = visits.slice(a, b - a)
                parts.append((ids[a:b], size[a:b], x[a:b], np.zeros((b - a, 0)) if exact else np.asarray(own.flatten()).reshape(b - a, -1)))
                continue
            if not parts:
                continue
            if members is None:
                members = [np.concatenate(z) for z in zip(*parts)]
            mid, msize, mx, mvisits = members
            for at in range(a, b, 512):
                to = min(b, at + 512)
                q, m = np.nonzero(x[at:to] @ mx.T >= COSINE)
                ok = ids[at:to][q] != mid[m]
                q, m = q[ok], m[ok]
                if not len(q):
                    continue
                links.append(stars(ids[at:to][q], mid[m]))
                pending += len(links[-1][0])
                found, back = np.unique(ids[at:to][q], return_inverse=True)
                for k, v in zip(found.tolist(), np.bincount(back, weights=msize[m]).astype(np.int64).tolist()):
                    counts[k] = counts.get(k, 0) + v
                lone = np.zeros(len(m), bool) if exact else ~(mvisits[m] == cell[at:to][q][:, None]).any(1)  # the member does not visit the visitor's cell
                if lone.any():
                    found, back = np.unique(mid[m[lone]], return_inverse=True)
                    for k, v in zip(found.tolist(), np.bincount(back, weights=size[at:to][q[lone]]).astype(np.int64).tolist()):
                        counts[k] = counts.get(k, 0) + v
                if len(counts) + pending > 500_000:
                    yield flush()
    if counts or links:
        yield flush()


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vec: str = "embedding", label: str = "label", recall: float = TARGET) -> DataFrame:
    """A row per row of ``vectors``: key, n_links, component, kept.

    Linked are vectors of equal, not null labels and equal length with a cosine of at least ``COSINE``: all of them with a
    ``recall`` of 1, else a share of about ``recall`` at least. Vectors that are null, empty, zero or hold null or
    non-finite parts link with nothing, not even their copies; nor do rows without a label. Rows without a key link like
    others; a component's id is its smallest key, null if it has none. Repeated rows stay and link with each other. Extra
    columns are not read. Empty tables give no rows.
    """
    spark = vectors.sparkSession
    prepare(spark)
    v = F.col(vec)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(float("inf"))))
    some = F.exists(v, lambda x: x != 0)
    able = F.coalesce(F.col(label).isNotNull() & v.isNotNull() & ~bad & some, F.lit(False))
    named = vectors.select(F.col(key).alias("key"), F.col(label).alias("label"), F.transform(v, lambda x: x.cast("double") + 0.0).alias("vec"), able.alias("able"))
    named = named.withColumn("h1", F.when(F.col("able"), F.xxhash64("label", "vec"))).withColumn("h2", F.when(F.col("able"), F.xxhash64(F.lit(17), "vec", "label")))
    rows = settled(named.select("key", "able", "h1", "h2"), "embedding-rows")
    classes = named.where("able").groupBy("h1", "h2").agg(F.min("key").alias("low"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("vec").alias("vec"))
    classes = settled(classes.withColumn("id", F.monotonically_increasing_id()), "embedding-classes")
    about = classes.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("dim"), F.approx_count_distinct("label").alias("labels")).first()
    if not about["n"]:
        return _alone(rows)
    dim = max(2, about["dim"] + about["dim"] % 2)
    drawn = sampled(classes, F.struct("h1", "h2"), SAMPLE).select("h1", F.xxhash64("label").alias("l"), "vec").toArrow().combine_chunks().sort_by("h1")  # SAMPLE vectors at most
    x = matrix(drawn["vec"].combine_chunks(), dim)
    index = fit(unit(x), drawn["l"].to_numpy(), about["n"] / max(1, about["labels"]), recall=recall)
    exact = not index.visits

    group = F.xxhash64("label", F.size("vec"))
    placed = classes.select("id", "n", group.alias("group"), "vec").mapInArrow(lambda it: _placed(it, index, dim), "id long, n long, group long, vec array<double>, cell int, visits array<int>")
    placed = settled(placed, "embedding-cells")
    hot = placed.groupBy("group", "cell").count().where(F.col("count") > CELL_ROWS)
    hot = settled(hot.select("group", F.col("cell").alias("at"), F.ceil(F.col("count") / CELL_ROWS).cast("int").alias("parts")), "embedding-hot")
    hot = small_or_shuffled(hot)
    # a part (s, g) of a cell holds the members with hash s and is visited by the visitors with hash g
    members = placed.withColumn("at", F.col("cell")).withColumn("role", F.lit(0))
    visitors = placed.withColumn("at", F.explode("visits")).withColumn("role", F.lit(1)).withColumn("visits", F.array().cast("array<int>"))
    both = members.unionByName(visitors).join(hot, ["group", "at"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("id"), F.col("parts"))
    both = both.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    s, g = F.when(F.col("role") == 0, F.col("own")).otherwise(F.col("other")), F.when(F.col("role") == 0, F.col("other")).otherwise(F.col("own"))
    both = both.select(F.xxhash64("group", "at", s, g).alias("bucket"), "role", "id", "n", "cell", "vec", "visits")
    both = both.repartition("bucket").sortWithinPartitions("bucket", "role")
    found = settled(both.mapInArrow(lambda it: _verified(it, dim, exact), "id long, other long, link boolean"), "embedding-links")

    counts = found.where("not link").groupBy("id").agg(F.sum("other").alias("more"))
    joined = components(found.where("link").select(F.col("id").alias("u"), F.col("other").alias("v")), "embedding-components")
    nodes = classes.select("h1", "h2", "low", "n", "id").join(counts, "id", "left").join(joined, F.col("id") == F.col("node"), "left")
    nodes = first = settled(nodes.select("h1", "h2", "low", "n", "more", F.coalesce("root", "id").alias("root")), "embedding-nodes")
    lows = settled(nodes.groupBy("root").agg(F.min("low").alias("component"), F.count("*").alias("classes")), "embedding-lows")
    nodes = met(nodes, lows, ["root"], "classes").select("h1", "h2", "n", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), "component")
    nodes = settled(nodes, "embedding-nodes", drop=[path_of(first), path_of(lows)])
    for done in (classes, placed, found):
        forget(spark, path_of(done))
    linked = met(rows.where("able"), nodes, ["h1", "h2"], "n").select("key", "n_links", "component", F.col("key").eqNullSafe(F.col("component")).alias("kept"))
    return linked.unionByName(_alone(rows.where(~F.col("able"))))


def _alone(rows: DataFrame) -> DataFrame:
    return rows.select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component"), F.lit(True).alias("kept"))
