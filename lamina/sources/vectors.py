"""Vector and label files: headered binary, fvecs, ivecs and bvecs, label text, ground truth, index directories.

The binary formats have fixed-size records, so a file is read in parallel by ranges of records through Spark's binary
file source (one row each file) or, for large files, by the partitioned data source below, whose readers seek.
"""

from __future__ import annotations

import json
import os
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Component kinds of the formats and the bytes before each record or before all.
KINDS = {"bin": ("<f4", 8, 0), "fvecs": ("<f4", 0, 4), "ivecs": ("<i4", 0, 4), "bvecs": ("u1", 0, 4)}


def _open(path: str):
    return open(path.removeprefix("file://"), "rb")


class _Range(InputPartition):
    def __init__(self, path: str, first: int, count: int):
        self.path, self.first, self.count = path, first, count


class _Reader(DataSourceReader):
    def __init__(self, kind: str, path: str, records: int):
        self.kind, self.path, self.records = kind, path, records
        code, head, lead = KINDS[kind]
        with _open(path) as f:
            self.dim = struct.unpack("<I", f.read(8)[4:])[0] if head else struct.unpack("<i", f.read(4) or b"\0\0\0\0")[0]
            f.seek(0, 2)
            self.size = lead + self.dim * np.dtype(code).itemsize
            self.n = (f.tell() - head) // self.size if self.dim else 0

    def partitions(self):
        return [_Range(self.path, i, min(self.records, self.n - i)) for i in range(0, self.n, self.records)] or [_Range(self.path, 0, 0)]

    def read(self, part):
        code, head, lead = KINDS[self.kind]
        with _open(part.path) as f:
            for lo in range(part.first, part.first + part.count, 4096):
                n = min(4096, part.first + part.count - lo)
                f.seek(head + lo * self.size)
                raw = np.frombuffer(f.read(n * self.size), np.uint8).reshape(n, self.size)[:, lead:]
                x = np.ascontiguousarray(raw).view(code).astype(np.float32)
                flat = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * self.dim, pa.array(x.ravel()))
                yield pa.record_batch([pa.array(np.arange(lo, lo + n)), flat], ["vec_id", "embedding"])


class VectorFile(DataSource):
    """spark.read.format("vectors").option("kind", ...).load(path): vec_id (row number) and embedding."""

    @classmethod
    def name(cls) -> str:
        return "vectors"

    def schema(self) -> str:
        return "vec_id long, embedding array<float>"

    def reader(self, schema):
        kind = self.options.get("kind", "bin")
        if kind not in KINDS:
            raise ValueError(f"unknown kind {kind!r}")
        return _Reader(kind, self.options["path"], int(self.options.get("records", 65536)))


def read_vectors(spark: SparkSession, path: str, kind: str = "bin", most: int | None = None) -> DataFrame:
    """vec_id and embedding of a file that all executors can open; most: only ids below it."""
    spark.dataSource.register(VectorFile)
    df = spark.read.format("vectors").option("kind", kind).load(path)
    return df if most is None else df.where(F.col("vec_id") < most)


def read_vector_folder(spark: SparkSession, path: str, kind: str = "fvecs") -> DataFrame:
    """The same of any store that Spark reads: one row group for each file of a folder; path, vec_id in the file."""
    code, head, lead = KINDS[kind]

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                dim = struct.unpack("<I", content[4:8])[0] if head else struct.unpack("<i", content[:4])[0]
                size = lead + dim * np.dtype(code).itemsize
                n = (len(content) - head) // size
                raw = np.frombuffer(content, np.uint8, n * size, head).reshape(n, size)[:, lead:]
                x = np.ascontiguousarray(raw).view(code).astype(np.float32)
                yield pa.record_batch([pa.array([name] * n), pa.array(np.arange(n)), pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * dim, pa.array(x.ravel()))], ["path", "vec_id", "embedding"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, vec_id long, embedding array<float>")


def _created(path: str, head: bytes, size: int) -> str:
    """An empty file of its final size, for tasks to write their records into."""
    name = path.removeprefix("file://")
    with open(name, "wb") as f:
        f.write(head)
        f.truncate(len(head) + size)
    return name


def _put(name: str, head: int, at: np.ndarray, records: np.ndarray) -> None:
    """Records into their places, each run of neighbours at once; a repeated task writes the same bytes again."""
    order = np.argsort(at, kind="stable")
    at, records = at[order], records[order]
    with open(name, "r+b") as f:
        for run in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at) != 1) + 1):
            if len(run):
                f.seek(head + int(at[run[0]]) * records.shape[1])
                f.write(records[run].tobytes())


def write_vectors(df: DataFrame, path: str, kind: str = "fvecs") -> None:
    """df(vec_id, embedding) in id order as one file in a folder that all executors can open.

    Records have one size, so each row's place is known from its number and the tasks write side by side; vectors of
    another length than the longest are an error.
    """
    from ..operators.groups import numbered

    code, head, lead = KINDS[kind]
    shape = df.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("d"), F.min(F.size("embedding")).alias("least")).first()
    n, dim = shape["n"], shape["d"] or 0
    if shape["least"] != shape["d"]:
        raise ValueError("vectors of different lengths")
    name = _created(path, struct.pack("<II", n, dim) if head else b"", n * (lead + dim * np.dtype(code).itemsize))
    if not n:
        return

    def write(batches):
        for batch in batches:
            x = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(code).reshape(len(batch), dim)
            raw = np.frombuffer(np.ascontiguousarray(x).tobytes(), np.uint8).reshape(len(batch), -1)
            front = np.tile(np.frombuffer(struct.pack("<i", dim), np.uint8), (len(batch), 1)) if lead else raw[:, :0]
            _put(name, head, batch.column("_at").to_numpy(), np.concatenate([front, raw], 1))
            yield pa.record_batch([pa.array([len(batch)], pa.int64())], ["n"])

    numbered(df.select("vec_id", "embedding"), "vec_id", "_at", 0).select("_at", "embedding").mapInArrow(write, "n long").agg(F.sum("n")).first()


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """vec_id (line number) and labels, sorted and distinct; an empty line is an empty set.

    Lines are numbered by file order, so the folder should hold one file, or files written in order.
    """
    lines = spark.read.text(path).select(F.col("value"), F.monotonically_increasing_id().alias("place"))
    from ..operators.groups import numbered

    sets = F.when(F.length(F.trim("value")) == 0, F.array().cast("array<int>")).otherwise(F.transform(F.split("value", ","), lambda x: F.trim(x).cast("int")))
    return numbered(lines, "place", "vec_id", 0).select("vec_id", F.array_sort(F.array_distinct(sets)).alias("labels"))


def write_labels(df: DataFrame, path: str) -> None:
    """One line for each row in id order, an empty one for an empty set."""
    df.orderBy("vec_id").coalesce(1).select(F.concat_ws(",", F.transform("labels", lambda x: x.cast("string"))).alias("value")).write.mode("overwrite").text(path)


def label_or_default(df: DataFrame) -> DataFrame:
    return df.withColumn("labels", F.coalesce("labels", F.array(F.lit(1))))


_ANSWER = [("id", "<u4"), ("d", "<f4")]


def write_ground_truth(found: DataFrame, path: str, k: int) -> None:
    """k pairs (u32 id, f32 distance) for each query in id order; missing ones have id and distance -1. Written by tasks
    side by side, as vectors are."""
    from ..operators.groups import numbered

    rows = found.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rk", "vec_id", "dist"))).alias("r"))
    name = _created(path, b"", rows.count() * k * 8)

    def write(batches):
        for batch in batches:
            out = np.zeros((len(batch), k), _ANSWER)
            out["id"], out["d"] = 0xFFFFFFFF, -1
            for i, row in enumerate(batch.column("r").to_pylist()):
                for x in row:
                    if x["rk"] <= k:
                        out[i, x["rk"] - 1] = (x["vec_id"], x["dist"])
            _put(name, 0, batch.column("_at").to_numpy(), out.view(np.uint8).reshape(len(batch), -1))
            yield pa.record_batch([pa.array([len(batch)], pa.int64())], ["n"])

    numbered(rows, "qid", "_at", 0).select("_at", "r").mapInArrow(write, "n long").agg(F.sum("n")).first()


def read_ground_truth(spark: SparkSession, path: str, k: int) -> DataFrame:
    """query (row number), rk, vec_id (-1: none), dist; tasks read their ranges of queries."""
    name = path.removeprefix("file://")
    n = os.path.getsize(name) // (8 * k)

    def read(batches):
        for batch in batches:
            query = np.sort(batch.column("id").to_numpy())
            for run in np.split(query, np.flatnonzero(np.diff(query) != 1) + 1):
                x = np.fromfile(name, _ANSWER, len(run) * k, offset=int(run[0]) * k * 8) if len(run) else np.zeros(0, _ANSWER)
                ids = np.where(x["id"] == 0xFFFFFFFF, -1, x["id"].astype(np.int64))
                yield pa.record_batch([pa.array(np.repeat(run, k)), pa.array(np.tile(np.arange(1, k + 1), len(run))), pa.array(ids), pa.array(x["d"].astype(np.float64))], ["query", "rk", "vec_id", "dist"])

    return spark.range(n).mapInArrow(read, "query long, rk long, vec_id long, dist double")


def save_index(tables: dict[str, DataFrame], path: str, meta: dict) -> None:
    """Each table as Parquet in a folder of its name, and meta as one JSON row; version is added."""
    some = next(iter(tables.values()))
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    some.sparkSession.createDataFrame([(json.dumps(meta | {"version": 1, "tables": sorted(tables)}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_index(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict]:
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    if meta.get("version") != 1:
        raise ValueError(f"unknown version {meta.get('version')}")
    return {name: spark.read.parquet(f"{path}/{name}") for name in meta["tables"]}, meta


def write_inverted(df: DataFrame, path: str) -> None:
    """(label, vec_id) in folders by label, so that a label's rows are read alone."""
    df.select(F.explode("labels").alias("label"), "vec_id").distinct().repartition("label").write.mode("overwrite").partitionBy("label").parquet(path)


def read_key_values(spark: SparkSession, path: str) -> dict[str, str]:
    """key=value lines of a small file."""
    return dict(r[0].split("=", 1) for r in spark.read.text(path).where(F.col("value").contains("=")).collect())
