"""The incremental catalogue of documents: what to read again, ids, and append-only segments behind an atomic pointer."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.shared import forget, path_of, settled, small_or_shuffled

MTIME_TOLERANCE = 0.01
#: Bits of ``monotonically_increasing_id`` that number the rows of a partition.
_PLACE_BITS = 33


def needs_indexing(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files (path, mtime, size, ...) without a manifest row of equal size and nearly equal time."""
    m = manifest.select(F.col("path").alias("_path"), F.col("mtime").alias("_mtime"), F.col("size").alias("_size"))
    same = (F.col("path") == F.col("_path")) & (F.abs(F.col("mtime") - F.col("_mtime")) <= MTIME_TOLERANCE) & (F.col("size") == F.col("_size"))
    return files.join(m, same, "left_anti")


def vanished(manifest: DataFrame, files: DataFrame) -> DataFrame:
    return manifest.join(files.select("path"), "path", "left_anti")


def ranked(rows: DataFrame, order: str, group: str | None = None) -> DataFrame:
    """``rows`` (narrow, few columns) with _rank, 0 first: a row's place by ``order``, within its ``group`` if one is given.

    Rows are ranged over a stated number of partitions, sorted within them and written once; so both uses of them, to count
    what lies before a partition and to number its rows, see the same places. No task holds more than its range.
    """
    spark = rows.sparkSession
    keys = [group, order] if group else [order]
    ranged = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys)
    written = settled(ranged.withColumn("_m", F.monotonically_increasing_id()), "ranked")
    part, place = F.shiftright("_m", _PLACE_BITS), F.col("_m").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    of = [F.col(group)] if group else []
    # a row for each partition, and for each group within it
    sizes = written.groupBy(part.alias("_part"), *of).agg(F.count("*").alias("_n"), F.min(place).alias("_first"))
    by_part = Window.partitionBy(*of).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(by_part), F.lit(0))).drop("_n")
    named = written.withColumn("_part", part)
    out = named.join(F.broadcast(sizes), "_part") if not group else named.join(small_or_shuffled(sizes), ["_part", group])
    return out.withColumn("_rank", F.col("_before") + place - F.col("_first")).select(*rows.columns, "_rank")


def assigned(known: DataFrame, paths: DataFrame) -> DataFrame:
    """(path, id) of the distinct ``paths``: the id in ``known`` (path, id), or one above the largest, in the order of paths."""
    wanted = paths.select("path").distinct()
    old = wanted.join(known.select("path", "id"), "path")
    fresh = ranked(wanted.join(known.select("path"), "path", "left_anti"), "path")
    top = known.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))  # one row
    fresh = fresh.crossJoin(F.broadcast(top)).select("path", (F.col("_top") + F.col("_rank") + 1).alias("id"))
    return old.select("path", "id").unionByName(fresh)


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` rows in place of ``old`` rows of the same path, ids kept; new paths get ids above the largest, in path order.

    ``new`` has the columns of ``old`` but id; its paths are distinct (rows that share a path would share an id). Ids are
    made on paths alone, so wide rows are moved by the joins only, and stream there past a table of a task's paths: none are
    sorted, so a task holds its paths and not its rows.
    """
    ids = assigned(old, new)
    kept = old.join(new.select("path").hint("shuffle_hash"), "path", "left_anti")
    return kept.unionByName(new.join(ids.hint("shuffle_hash"), "path").select(kept.columns))


def live(parts: list[DataFrame], dead: list[DataFrame], key: str) -> DataFrame:
    """The rows of ``parts``, oldest first, that no later part replaces: ``dead[i]`` (id) lists what part i makes void."""
    rows = reduce(DataFrame.unionByName, [p.withColumn("_seq", F.lit(i)) for i, p in enumerate(parts)])
    later = [d.select(F.col("id").alias("_dead"), F.lit(i).alias("_at")) for i, d in enumerate(dead) if i]
    if not later:
        return rows.drop("_seq")
    void = small_or_shuffled(reduce(DataFrame.unionByName, later))
    return rows.join(void, (F.col(key) == F.col("_dead")) & (F.col("_seq") < F.col("_at")), "left_anti").drop("_seq")


@dataclass(frozen=True)
class IndexStats:
    total: int = 0
    indexed: int = 0
    skipped: int = 0
    errors: int = 0
    cancelled: bool = False
    error_samples: list[str] = field(default_factory=list)
    n_empty: int = 0


def index_stats(files: DataFrame, todo: DataFrame) -> DataFrame:
    """One row: total, indexed, skipped, errors, cancelled, error_samples; an unreadable file has a text in ``error``."""
    total = files.agg(F.count("*").alias("total"))
    done = todo.agg(
        F.count_if(F.col("error").isNull()).alias("indexed"), F.count_if(F.col("error").isNotNull()).alias("errors"),
        F.slice(F.sort_array(F.collect_set("sample")), 1, 5).alias("error_samples"),
    )
    out = total.crossJoin(F.broadcast(done))  # one row each
    return out.select("total", "indexed", (F.col("total") - F.col("indexed") - F.col("errors")).alias("skipped"), "errors", F.lit(False).alias("cancelled"), "error_samples")


class Segments:
    """Append-only tables in a folder. A pointer lists the segments that count; it is written whole, then renamed.

    Pointers are numbered. Readers take the highest that can be read, so a crash at any step leaves the state before or
    after, and of two writers that began from one state the second fails. A segment holds the tables of one update and a
    table ``dead`` (id): the documents whose rows in earlier segments it makes void. Segments of like size are merged, so
    a document is written again about as often as the number of segments doubles, and there are few to read.
    """

    #: Pointers that stay, for readers that began with them; newest segments that are merged; how much larger an older
    #: segment may be than the newer ones together to be merged with them.
    KEPT, MERGED, RATIO = 3, 4, 4

    def __init__(self, spark: SparkSession, folder: str, version: int):
        self.spark, self.folder, self.version = spark, folder.rstrip("/"), version
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._path(self.folder).getFileSystem(self._conf)

    def _pointers(self) -> list[dict]:
        """Readable pointers, the newest first."""
        found = []
        for status in self._fs.globStatus(self._path(f"{self.folder}/pointer-*.json")) or []:
            try:
                stream = self._fs.open(status.getPath())
                text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
                stream.close()
                found.append(json.loads(text))
            except ValueError:  # a damaged pointer does not count
                continue
        return sorted(found, key=lambda p: -p["n"])

    def current(self) -> list[dict] | None:
        """The segments (name, rows) of the newest state; none if there is none or it has another format version."""
        newest = next(iter(self._pointers()), None)
        return newest["segments"] if newest and newest["version"] == self.version else None

    def where(self, segment: dict, table: str) -> str:
        return f"{self.folder}/{segment['name']}/{table}"

    def read(self, table: str, key: str, segments: list[dict] | None = None) -> DataFrame | None:
        """The live rows of a table; None without segments."""
        segments = self.current() if segments is None else segments
        if not segments:
            return None
        get = lambda name: [self.spark.read.parquet(self.where(s, name)) for s in segments]
        return live(get(table), get("dead"), key)

    def new(self) -> str:
        """The folder of a segment that is to be written."""
        return f"{self.folder}/segment-{uuid.uuid4().hex}"

    def commit(self, segments: list[dict], base: list[dict] | None) -> None:
        """Make ``segments`` the newest state, which must follow the state ``base``."""
        before = self._pointers()
        if before and before[0]["version"] == self.version and base is not None and before[0]["segments"] != base:
            raise RuntimeError(f"{self.folder} was changed by another writer")
        n = before[0]["n"] + 1 if before else 1
        draft = self._path(f"{self.folder}/_draft-{uuid.uuid4().hex}.json")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps({"n": n, "version": self.version, "segments": segments}), "utf-8"))
        out.close()
        self._rename(draft, self._path(f"{self.folder}/pointer-{n:012d}.json"))
        self._sweep()

    def _rename(self, source, target) -> None:
        """Fails if the target exists."""
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self._conf)
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        context.rename(self._fs.makeQualified(source), self._fs.makeQualified(target), gateway.new_array(kind, 0))

    def _sweep(self) -> None:
        """Delete pointers beyond the last few, and segments that only they name."""
        pointers = self._pointers()
        keep = {s["name"] for p in pointers[: self.KEPT] for s in p["segments"]}
        for p in pointers[self.KEPT :]:
            self._fs.delete(self._path(f"{self.folder}/pointer-{p['n']:012d}.json"), False)
            for s in p["segments"]:
                if s["name"] not in keep:
                    self._fs.delete(self._path(f"{self.folder}/{s['name']}"), True)

    def to_merge(self, segments: list[dict]) -> int:
        """The first of the newest segments that are to become one; the number of segments if none are."""
        at, total = len(segments) - 1, segments[-1]["rows"]
        while at > 0 and segments[at - 1]["rows"] <= self.RATIO * max(1, total):
            at -= 1
            total += segments[at]["rows"]
        return at if len(segments) - at >= self.MERGED else len(segments)


__all__ = ["IndexStats", "Segments", "assigned", "forget", "index_stats", "live", "needs_indexing", "path_of", "ranked", "upsert", "vanished"]
