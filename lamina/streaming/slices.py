"""A sliding window of slices over a stream of vectors, and a running top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.search import knn, merge


class SlidingWindow:
    """The newest slices of an index. step adds one and can drop the oldest."""

    def __init__(self, length: int):
        if length < 1:
            raise ValueError("a window holds at least one slice")
        self.length, self.slices = length, []

    def step(self, newest: DataFrame | None, remove_oldest: bool) -> SlidingWindow:
        if remove_oldest and not self.slices:
            raise ValueError("there is no slice to remove")
        if newest is not None:
            self.slices.append(newest)
        if remove_oldest:
            self.slices.pop(0)
        return self

    def rows(self) -> DataFrame:
        out = self.slices[-self.length :]
        df = out[0]
        for other in out[1:]:
            df = df.unionByName(other)
        return df


def window_of(df: DataFrame, slice_col: str, last: int, length: int) -> DataFrame:
    """Rows of the `length` slices up to `last`."""
    return df.where((F.col(slice_col) > last - length) & (F.col(slice_col) <= last))


def slice_counts(stream: DataFrame, time_col: str, size: str, slide: str, delay: str) -> DataFrame:
    """Rows in each sliding time window; windows close once the watermark passes them."""
    return stream.withWatermark(time_col, delay).groupBy(F.window(time_col, size, slide)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("begin"), F.col("window.end").alias("end"), "n")


def running_knn(stream: DataFrame, queries: DataFrame, k: int, path: str, checkpoint: str):
    """A streaming query that keeps at path/<batch> the k nearest of all vectors seen up to that batch.

    Each batch is merged with the table that the one before wrote, so a rerun of a batch gives the same table.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        found = knn(batch, queries, k)
        if number:
            found = merge([found, spark.read.parquet(f"{path}/{number - 1}")], k)
        found.write.mode("overwrite").parquet(f"{path}/{number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True)
