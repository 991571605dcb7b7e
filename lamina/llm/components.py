"""Connected components of a link table, without collecting it."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import settle

#: Links that one task joins up, about: 200 bytes each while it does.
LINKS_AT_ONCE = 500_000


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(v, root): the least vertex that each one reaches by the links of this partition."""
    parent: dict[int, int] = {}

    def find(v: int) -> int:
        root = v
        while parent[root] != root:
            root = parent[root]
        while parent[v] != root:
            parent[v], v = root, parent[v]
        return root

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            x, y = find(a), find(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
    vertices = list(parent)
    yield pa.record_batch([pa.array(vertices, pa.int64()), pa.array([find(v) for v in vertices], pa.int64())], ["v", "root"])


def components(links: DataFrame) -> DataFrame:
    """(key, label) for every end of links(a, b): label is the least key of its component.

    Each task joins up the links of its own partition; a vertex that got several roots this way links these. Such links
    are the next round's, on ever fewer vertices, until none is left. What a vertex led to is then followed through the
    rounds. Every round is written to the shared folder. Links within one partition take one round.
    """
    rounds: list[DataFrame] = []
    while True:
        parts = math.ceil((links.count() + 1) / LINKS_AT_ONCE)
        roots = links.select("a", "b").coalesce(parts).mapInArrow(_local, "v long, root long").groupBy("v").agg(F.min("root").alias("m"), F.collect_set("root").alias("roots"))
        step = settle(roots, "roots")
        rounds.append(step)
        links = step.where(F.size("roots") > 1).select(F.col("m").alias("a"), F.explode("roots").alias("b")).where("a <> b")
        if links.isEmpty():
            break
        links = settle(links.distinct(), "links")
    out = rounds.pop().select(F.col("v").alias("key"), F.col("m").alias("label"))
    for step in reversed(rounds):
        beyond = out.select(F.col("key").alias("m"), "label")
        out = step.select("v", "m").join(beyond, "m", "left").select(F.col("v").alias("key"), F.coalesce("label", "m").alias("label"))
    return out
