"""SimHash near-duplicates by covering locality-sensitive hashing: no pair within the radius is missed.

Bits i = 0..63 get vectors a(i) in {0,1}^(r+1); for each non-zero v in {0,1}^(r+1), a table hashes a fingerprint
reduced to the bits with <a(i), v> odd. Any r bits leave some v orthogonal to all their vectors, so two fingerprints
that differ in at most r bits agree on the whole mask of that v and meet in its table. With r = 3 that is 15 tables of
about 34 bits each (R. Pagh, CoveringLSH, 2016).

Copies share a fingerprint and are one node. A bucket's pairs are verified in blocks inside one task and only links
that join something new leave it. Buckets of more than ``HOT_BUCKET`` fingerprints are covered anew by further families
of masks on top of the first, which stays exact, as long as that splits them; then their pairs are verified.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import boxed, components, forget, met, path_of, prepare, settled, stars, unboxed

BITS, RADIUS, SEED, SHINGLE = 64, 3, 42, 3
HOT_BUCKET = 4096
#: Rows that a task gathers before it compares them.
HELD = 100_000
BLOCK = 1024


def _spread_table() -> np.ndarray:
    """For each byte, its eight bits in eight byte lanes of a 64-bit word, lowest bit lowest."""
    byte = np.arange(256, dtype=np.uint64)
    return sum(((byte >> np.uint64(k)) & np.uint64(1)) << np.uint64(8 * k) for k in range(8)).astype(np.uint64)


SPREAD = _spread_table()


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of a whole text, unsigned: bit set if set in over half of the shingles' XXH64; no words: 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    digest = xxhash.xxh64_intdigest
    n = len(words) - SHINGLE + 1
    hashes = np.fromiter((digest(b"%b %b %b" % w, SEED) for w in zip(words, words[1:], words[2:])), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):  # bounded memory for very long texts
        part = SPREAD[hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)]
        sums = np.add.reduceat(part, np.arange(0, len(part), 255), axis=0)  # up to 255 ones to a lane
        counts += sums.view(np.uint8).reshape(len(sums), 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * counts > n).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches):
    for batch in batches:
        names = batch.schema.names
        texts = batch.column(names.index("_text")).to_pylist()
        found = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
        keep = [batch.column(i) for i, n in enumerate(names) if n != "_text"]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(found)], names=[*[n for n in names if n != "_text"], "fp"])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", mark: Column | None = None) -> DataFrame:
    """Rows (key, fp), and mark if one is given, a row per row of ``docs``; fp holds the 64 bits as a signed long.

    Null and empty texts, and those of white space alone, have fingerprint 0. Repeated rows stay; extra columns are not
    read. ``mark`` is an expression over ``docs``, of type long.
    """
    prepare(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), *([] if mark is None else [mark.alias("mark")]), F.col(text).alias("_text"))
    return rows.mapInArrow(_fingerprints, f"key {kind}, {'' if mark is None else 'mark long, '}fp long")


def masks(level: int = 0, bits: int = BITS, radius: int = RADIUS) -> list[int]:
    """The covering masks: 2**(radius + 1) - 1 of them, some pairwise disjoint complement for any ``radius`` bits.

    The vectors a(i) run through all non-zero values in turn, in an order that differs by level, so masks hold about
    half of the bits each and families are independent of one another.
    """
    width = (1 << (radius + 1)) - 1
    turn = np.arange(bits) % width
    if level:
        turn = np.random.default_rng(level).permutation(turn)
    vectors = [int(t) + 1 for t in turn]
    return [sum(1 << i for i, a in enumerate(vectors) if (a & v).bit_count() & 1) for v in range(1, width + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _cover(rows: DataFrame, level: int) -> DataFrame:
    """Rows (bucket, fp), one for each mask of the level's family; a bucket's name also holds the bucket it came from."""
    family = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(_signed(m)).alias("m")) for k, m in enumerate(masks(level))])
    before = F.col("bucket") if "bucket" in rows.columns else F.lit(0).cast("long")
    return rows.select("fp", before.alias("before"), F.explode(family).alias("t")).select(
        F.xxhash64("before", F.lit(level), "t.k", F.col("fp").bitwiseAND(F.col("t.m"))).alias("bucket"), "fp"
    )


def _near(x: np.ndarray, radius: int):
    """Index pairs within the radius among ``x``, block by block."""
    for i in range(0, len(x), BLOCK):
        for j in range(i, len(x), BLOCK):
            a, b = np.nonzero(np.bitwise_count(x[i : i + BLOCK, None] ^ x[None, j : j + BLOCK]) <= radius)
            a, b = a + i, b + j
            ok = a < b
            yield a[ok], b[ok]


def _verified(batches, radius: int):
    """Links (u, v) among rows sorted by bucket. Short buckets are compared by shifted arrays, long ones in blocks."""
    held, n = [], 0

    def links(bucket, fp):
        x = fp.view(np.uint64)
        starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        sizes = np.diff(np.r_[starts, len(bucket)])
        us, vs = [], []
        run = np.repeat(sizes, sizes)
        short = np.flatnonzero((run > 1) & (run <= 64))
        d = 1
        while len(short):
            short = short[short + d < len(bucket)]
            short = short[bucket[short] == bucket[short + d]]
            ok = short[np.bitwise_count(x[short] ^ x[short + d]) <= radius]
            us.append(fp[ok])
            vs.append(fp[ok + d])
            d += 1
        for s, n in zip(starts[sizes > 64], sizes[sizes > 64]):
            part = x[s : s + n]
            for a, b in _near(part, radius):
                u, v = stars(part[a].view(np.int64), part[b].view(np.int64))
                us.append(u)
                vs.append(v)
        if not us:
            return None
        u, v = stars(np.concatenate(us), np.concatenate(vs))
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    for batch in batches:
        if not batch.num_rows:
            continue
        bucket, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        # compare what is held once it is much, but only whole buckets: up to where the last one of this batch begins
        if n >= HELD and (held[-1][0][-1] != bucket[0] or bucket[0] != bucket[-1]):
            cut = 0 if held[-1][0][-1] != bucket[0] else int(np.searchsorted(bucket, bucket[-1]))
            held.append((bucket[:cut], fp[:cut]))
            if (out := links(*(np.concatenate(z) for z in zip(*held)))) is not None:
                yield out
            held, n, bucket, fp = [], 0, bucket[cut:], fp[cut:]
        held.append((bucket, fp))
        n += len(bucket)
    if held and (out := links(*(np.concatenate(z) for z in zip(*held)))) is not None:
        yield out


def near_links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (u, v) that connect what the pairs within the radius connect. ``fps``: distinct fingerprints (fp), settled."""
    rows, found, level, before = _cover(fps, 0), [], 0, None
    while True:
        hot = settled(rows.groupBy("bucket").count().where(F.col("count") > HOT_BUCKET), "simhash-hot")
        most = hot.agg(F.max("count")).first()[0]
        if most is None or (before is not None and most > 0.9 * before):  # none is hot, or families split them no more
            found.append(rows)
            break
        found.append(rows.join(hot.select("bucket"), "bucket", "left_anti"))
        level, before = level + 1, most
        rows = _cover(rows.join(hot.select("bucket"), "bucket", "left_semi"), level)
    out = None
    for part in found:
        part = part.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lambda it: _verified(it, radius), "u long, v long")
        out = part if out is None else out.unionByName(part)
    return out


def _grouped(rows: DataFrame, radius: int) -> DataFrame:
    """Adds root (the component's fingerprint) and component (its smallest key) to settled rows (key, fp, ...)."""
    nodes = first = settled(rows.groupBy("fp").agg(F.min("key").alias("low"), F.count("*").alias("copies")), "simhash-nodes")
    joined = components(near_links(nodes.select("fp"), radius), "simhash-links")
    nodes = nodes.join(joined, nodes["fp"] == joined["node"], "left").select("fp", "low", "copies", F.coalesce("root", "fp").alias("root"))
    nodes = second = settled(nodes, "simhash-nodes", drop=[path_of(first)])
    lows = settled(nodes.groupBy("root").agg(F.min("low").alias("component"), F.count("*").alias("fps")), "simhash-lows")
    nodes = settled(met(nodes, lows, ["root"], "fps").select("fp", "root", "component", "copies"), "simhash-nodes", drop=[path_of(second), path_of(lows)])
    return met(rows, nodes, ["fp"], "copies").drop("copies")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """A row per row of ``docs``: key, fp (long), root (the component's fingerprint), component (its smallest key).

    Null keys keep their rows and take the smallest other key of their component, null if there is none. Repeated
    rows stay. Texts are read whole, however long; one is held in memory at a time beside its batch. Extra columns are
    not read, whatever their names. Empty tables give no rows.
    """
    return _grouped(settled(fingerprints(docs, key, text), "simhash-fps"), radius).select("key", "fp", "root", "component")


def _identity(docs: DataFrame) -> Column:
    """A hash of a whole row; columns that hold maps do not count."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()])


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each group of near-duplicate rows, whatever keys they share.

    It is the row with the smallest key, rows without a key last; among rows of one key that with the smallest hash of
    the whole row, so reruns and other partitions keep the same. A key whose rows lie in several groups may stay several
    times. Texts that are null, empty or white space are one group. Empty tables give no rows; extra columns stay.
    """
    prepare(docs.sparkSession)
    rows = settled(fingerprints(docs, key, text, _identity(docs)), "simhash-rows")
    order = F.struct(F.col("key").isNull().alias("n"), F.col("key").alias("key"), F.col("mark").alias("mark"))
    kept = settled(_grouped(rows, radius).groupBy("root").agg(F.min(order).alias("k")).select("k.key", "k.mark"), "simhash-kept")
    mine = settled(rows.join(kept, rows["key"].eqNullSafe(kept["key"]) & (rows["mark"] == kept["mark"]), "left_semi").groupBy("key", "mark").count(), "simhash-mine")
    forget(docs.sparkSession, path_of(kept))
    forget(docs.sparkSession, path_of(rows))
    mine = mine.select(F.col("key").alias("_kept"), F.col("mark").alias("_mark"), "count")
    named = boxed(docs, key=F.col(key), mark=_identity(docs))
    same = F.col("key").eqNullSafe(F.col("_kept")) & (F.col("mark") == F.col("_mark"))
    out = unboxed(named.join(mine.where("count = 1"), same, "left_semi"))
    again = mine.where("count > 1")
    if not again.isEmpty():  # rows repeated whole: one of each
        out = out.unionByName(unboxed(named.join(again, same, "left_semi").dropDuplicates(["key", "mark"])))
    return out
