"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a one-column id table that may be broadcast (16 bytes each once hashed, so 32 MB).
BROADCAST_ROWS = 2_000_000

#: The same for tables with a digest and a few numbers (about 100 bytes a row, so 50 MB).
BROADCAST_WIDE = 500_000
#: A key with over this share of all rows, and over HEAVY_ROWS of them, is heavy; there are at most HEAVY such keys.
HEAVY, HEAVY_ROWS = 1000, 256
#: Bytes of an Arrow batch on its way to a Python worker, and at most one row more.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

_written: list[tuple[SparkSession, str]] = []
_own: list[str] = []


def ship(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver did; elsewhere it must be installed or sent by --py-files."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of this session end at BATCH_BYTES, unless it names a bound itself.

    Without, they end at 10,000 rows: a partition of texts is one batch, of which executor and worker hold copies.
    """
    if _BATCH not in spark.conf.getAll:
        spark.conf.set(_BATCH, BATCH_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, or a temporary one where none is set (local tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="lamina-"))
        spark.sparkContext.setCheckpointDir(_own[0])
    return _own[0]


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/lamina/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def release() -> None:
    """Delete every intermediate table that this process wrote; results that still read them fail afterwards."""
    while _written:
        spark, path = _written.pop()
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001  the session has ended and took its folder along
            return


def by_ids(df: DataFrame, ids: DataFrame, key: str, how: str, rows: int) -> DataFrame:
    """df semi-, anti- or left-joined with a slim table on key; broadcast only if its counted rows stay small."""
    if rows <= BROADCAST_ROWS:
        return df.join(F.broadcast(ids), key, how)
    return df.join(ids.hint("shuffle_hash"), key, how)


def by_groups(df: DataFrame, slim: DataFrame, on: list[str], size: str, rows: int, total: int, how: str = "inner") -> DataFrame:
    """df joined (inner or left) with slim, one row for each group of df's rows; size counts the group's rows in df.

    Few groups are broadcast. Of more, heavy ones are still broadcast, at most HEAVY rows; the others, none of them with
    many rows, are joined by a shuffle. So no task gets more than its share of a group that holds much of df.
    """
    if rows <= BROADCAST_WIDE:
        return df.join(F.broadcast(slim.drop(size)), on, how)
    heavy = (F.col(size) * HEAVY > total) & (F.col(size) > HEAVY_ROWS)
    large, small = slim.where(heavy).drop(size), slim.where(~heavy).drop(size)
    of_large = df.join(F.broadcast(large), on)
    others = df.join(F.broadcast(large.select(*on)), on, "left_anti").join(small.hint("shuffle_hash"), on, how)
    return of_large.unionByName(others)


def spread_join(df: DataFrame, wide: DataFrame, key: str, other: str, total: int) -> DataFrame:
    """df joined with wide on key, which is unique in wide; a heavy key's rows are dealt by other over copies of its row.

    The copies of all keys together are at most twice HEAVY more than there are keys.
    """
    counts = df.groupBy(key).agg(F.count("*").alias("_n")).where((F.col("_n") * HEAVY > total) & (F.col("_n") > HEAVY_ROWS))
    heavy = counts.select(key, F.ceil(F.col("_n") * HEAVY / F.lit(max(total, 1))).cast("int").alias("_copies"))
    copies = F.coalesce("_copies", F.lit(1))
    dealt = df.join(F.broadcast(heavy), key, "left").withColumn("_salt", F.pmod(F.xxhash64(other), copies).cast("int")).drop("_copies")
    every = wide.join(F.broadcast(heavy), key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), copies - 1))).drop("_copies")
    return dealt.join(every, [key, "_salt"]).drop("_salt")


def spread(df: DataFrame) -> DataFrame:
    """df dealt anew if its files give work to fewer than half of the cores, as one file of one row group does."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
