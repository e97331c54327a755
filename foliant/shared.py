"""Tables in the folder that driver and executors share, and broadcasts behind a check of their size."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a few numbers that a side may have to be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000
#: Bytes that the texts among them may have.
BROADCAST_BYTES = 32 << 20


def send_code(spark: SparkSession) -> None:
    """Send this library to the executors, once a session: their Python workers import it."""
    if getattr(spark.sparkContext, "_foliant_sent", None) is None:
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        archive = os.path.join(tempfile.mkdtemp(), "foliant_code.zip")
        with zipfile.ZipFile(archive, "w") as out:
            for folder, _, names in os.walk(os.path.join(root, "foliant")):
                for name in sorted(names):
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        out.write(full, os.path.relpath(full, root))
        spark.sparkContext.addPyFile(archive)
        spark.sparkContext._foliant_sent = archive


def spread(scan: DataFrame) -> DataFrame:
    """A scan of files dealt over all cores where it has fewer parts than there are cores, as small tables do; else as it is.

    Costly work on rows follows. Large inputs have many parts and are never shuffled for this.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


def shared_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder (spark.checkpoint.dir, or a local one where that is unset, as in tests).

    What is left in it is deleted when the driver ends.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.gettempdir()}/foliant-shared"
    folder = f"{found.rstrip('/')}/{spark.sparkContext.applicationId}"
    if getattr(spark.sparkContext, "_foliant_folder", None) != folder:
        where = spark._jvm.org.apache.hadoop.fs.Path(folder)
        system = where.getFileSystem(spark._jsc.hadoopConfiguration())
        system.mkdirs(where)
        system.deleteOnExit(where)
        spark.sparkContext._foliant_folder = folder
    return folder


def settled(df: DataFrame, name: str, drop: list[str] | None = None) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: lineage ends, and a lost executor costs nothing.

    ``drop`` lists paths of earlier tables that this one replaces; they are deleted once it is written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    for old in drop or []:
        forget(spark, old)
    out = spark.read.schema(schema).parquet(path)
    out._foliant_path = path
    return out


def path_of(df: DataFrame) -> str:
    return df._foliant_path


def forget(spark: SparkSession, path: str) -> None:
    """Delete a table that ``settled`` wrote and nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def small_or_shuffled(df: DataFrame, limit: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if it is small, else as it is (the join then shuffles; AQE splits skew).

    Small is at most ``limit`` rows whose texts have at most ``most_bytes`` bytes together.
    """
    texts = [F.octet_length(F.col(f"`{f.name}`")) for f in df.schema.fields if f.dataType.simpleString() in ("string", "binary")]
    size = F.coalesce(F.sum(reduce(lambda a, b: a + b, [F.coalesce(t, F.lit(0)) for t in texts], F.lit(0))), F.lit(0))
    about = df.limit(limit + 1).agg(F.count("*").alias("n"), size.alias("bytes")).first()
    return F.broadcast(df) if about["n"] <= limit and about["bytes"] <= most_bytes else df
