"""Sharding by sampled splitters: size-weighted key samples, quantile boundaries, range partitions, overfull ranges split.

The key is the hash of the text, so copies lie side by side. Law "bytes": the shards' sizes are near equal. A group of
equal texts stays in one shard if it fits one beside the larger groups; only a group that fits none is cut. Small
groups lie in ranges of the key, which are laid end to end into what the large groups leave of each shard. Built of
DataFrame functions only.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import settle

#: Rows for each range at most, on average; more rows get more ranges.
ROWS_PER_RANGE = 4_000_000
#: A group of equal texts with over this part of a shard's bytes is placed by itself; at most so many for each shard.
FINE = 128
_PREFIX_BITS = 12


def _pack(groups: list[tuple[int, int]], n_shards: int, most: float) -> list[list[tuple[int, int]]]:
    """For each group (bytes, rows), largest first: its runs of rows as (rows, shard). Whole in the emptiest shard if it
    fits there, else cut along what the shards have left."""
    load = [0.0] * n_shards
    out: list[list[tuple[int, int]]] = []
    for size, rows in groups:
        at = min(range(n_shards), key=load.__getitem__)
        if load[at] + size <= most:
            load[at] += size
            out.append([(rows, at)])
            continue
        each, left, runs = size / rows, rows, []
        for s in sorted(range(n_shards), key=load.__getitem__):
            n = min(left, max(0, int((most - load[s]) / each)))
            if n:
                runs.append([n, s])
                load[s] += n * each
                left -= n
        while left:
            at = min(range(n_shards), key=load.__getitem__)
            runs.append([1, at])
            load[at] += each
            left -= 1
        out.append([(n, s) for n, s in runs])
    return out


def _table(rows: list, kind: str) -> F.Column:
    return F.from_json(F.lit(json.dumps(rows)), f"array<{kind}>")


def shard(
    docs: DataFrame,
    n_shards: int = 8,
    *,
    text: str = "text",
    carry: tuple[str, ...] = ("doc_id",),
    order: str = "doc_id",
    ranges_per_shard: int = 32,
    samples_per_range: int = 64,
    seed: int = 17,
) -> DataFrame:
    """One row per row of docs: the carried columns, size, text_crc32, law, shard, slot, grown_shard.

    size is the text's UTF-8 bytes plus 1 (null text: 1, crc32 0). slot runs gaplessly from 0 in each shard, by text
    hash and order column. Rows of a group that is cut fall by their place in the table, so repeated rows and null ids
    are rows like any other; an empty table gives an empty result; other columns are ignored, also those named like the
    result's. grown_shard is null under this law.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    slim = settle(
        docs.select(
            *[F.col(c).alias(f"_c_{c}") for c in carry],
            F.xxhash64(F.col(order), F.monotonically_increasing_id(), F.lit(seed)).alias("_tie"),
            F.col(order).alias("_order"),
            (F.octet_length(body).cast("long") + 1).alias("size"),
            F.crc32(body).alias("text_crc32"),
            F.xxhash64(body).alias("_key"),
        ),
        "shard-slim",
    )
    total = slim.agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).first()
    all_bytes, rows = total["bytes"] or 0, total["rows"]
    n_ranges = max(n_shards * ranges_per_shard, rows // ROWS_PER_RANGE)
    wanted = n_ranges * samples_per_range
    ideal = max(all_bytes / n_ranges, 1)

    # large groups of equal texts, at most FINE for each shard, are placed by themselves
    groups = slim.groupBy("_key").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).where((F.col("bytes") * (FINE * n_shards) > all_bytes) & (F.col("rows") > 1))
    large = groups.orderBy(F.col("bytes").desc(), "_key").collect()
    most = all_bytes / n_shards
    runs = _pack([(g["bytes"], g["rows"]) for g in large], n_shards, most)
    left = [most] * n_shards
    for g, placed in zip(large, runs):
        for n, s in placed:
            left[s] -= n * g["bytes"] / g["rows"]
    left = [max(x, 0.0) for x in left]
    named = docs.sparkSession.range(1).select(F.posexplode(_table([g["_key"] for g in large], "bigint")).alias("_large", "_key"))
    dealt = slim.join(F.broadcast(named), "_key", "left")
    light = dealt.where("_large is null")

    # a size-weighted sample: each row's expected number of copies is size * wanted / all_bytes
    draw = F.shiftrightunsigned(F.xxhash64("_tie", "_key", F.lit(seed + 1)), 11) * F.lit(2.0**-53)
    copies = F.floor(F.col("size") * F.lit(wanted / max(all_bytes, 1)) + draw).cast("int")
    quantiles = F.array(*[F.lit(i / n_ranges) for i in range(1, n_ranges)]) if n_ranges <= 1024 else F.transform(F.sequence(F.lit(1), F.lit(n_ranges - 1)), lambda i: i / F.lit(float(n_ranges)))
    drawn = (
        light.select("_key", copies.alias("n"))
        .where("n > 0")
        .select("_key", F.explode(F.array_repeat(F.lit(0), F.col("n"))).alias("_"))
        .agg(F.percentile_approx("_key", quantiles, F.lit(4 * wanted)).alias("cuts"))
        .first()["cuts"]
    )
    cuts = sorted(set(drawn or []))

    # range of a row: cuts are looked up by the key's leading bits, then counted among the few that share them
    half = 1 << (_PREFIX_BITS - 1)
    table, at = [], 0
    for p in range(-half, half):
        own = []
        base = at
        while at < len(cuts) and cuts[at] >> (64 - _PREFIX_BITS) == p:
            own.append(cuts[at])
            at += 1
        table.append({"b": base, "k": own})
    entry = F.element_at(_table(table, "struct<b:int,k:array<bigint>>"), F.shiftright("_key", 64 - _PREFIX_BITS).cast("int") + F.lit(half + 1))
    ranged = dealt.withColumn("_range", F.coalesce(F.col("_large") + F.lit(len(cuts) + 1), entry["b"] + F.size(F.filter(entry["k"], lambda c: c <= F.col("_key")))))

    # overfull ranges are subdivided: by the hash of the text, so that groups hold together; large groups by rows
    filled = {r["_range"]: r["bytes"] for r in light.withColumn("_range", entry["b"] + F.size(F.filter(entry["k"], lambda c: c <= F.col("_key")))).groupBy("_range").agg(F.sum("size").alias("bytes")).collect()}
    pieces = [max(1, round(filled.get(i, 0) / (1.5 * ideal))) for i in range(len(cuts) + 1)]
    pieces += [max(1, math.ceil(g["bytes"] / (1.5 * ideal))) for g in large]
    piece_of = F.element_at(_table(pieces, "bigint"), F.col("_range") + 1)
    by = F.when(F.col("_large").isNull(), F.xxhash64("_key", F.lit(seed + 2))).otherwise(F.col("_tie"))
    units = ranged.withColumn("_piece", F.pmod(by, piece_of))

    unit = ["_range", "_piece"]
    sums = units.groupBy(*unit).agg(F.sum("size").alias("_b"), F.count("*").alias("_n"), F.max("_large").alias("_l"))
    before = Window.partitionBy("_l").orderBy(*unit).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*unit, F.coalesce(F.sum("_b").over(before), F.lit(0)).alias("_b0"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"))

    # light groups go where their middle falls among the shards' room, rows of a large group where their number falls
    light_bytes, room = max(sum(filled.values()), 1), max(sum(left), 1e-9)
    ends = [int(2 * light_bytes * sum(left[: s + 1]) / room) for s in range(n_shards - 1)]
    steps = []
    for placed in runs:
        upto, step = 0, []
        for n, s in placed:
            upto += n
            step.append({"u": upto, "s": s})
        steps.append(step)
    ordered = Window.partitionBy(*unit).orderBy("_key", "_order", "size", "_tie")
    group = Window.partitionBy(*unit, "_key").orderBy("_order", "size", "_tie").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = ordered.rowsBetween(Window.unboundedPreceding, 0)
    middle = 2 * F.min("_start").over(group) + F.sum("size").over(group)
    of_light = F.size(F.filter(F.array(*[F.lit(e) for e in ends]).cast("array<bigint>"), lambda e: e <= F.col("_twice")))
    of_large = F.element_at(F.filter(F.element_at(_table(steps, "array<struct<u:bigint,s:int>>"), F.col("_large") + 1), lambda x: x["u"] > F.col("_at")), 1)["s"]
    inside = Window.partitionBy(*unit, "shard").orderBy("_key", "_order", "size", "_tie")
    placed = (
        units.join(F.broadcast(sums), unit)
        .withColumn("_start", F.col("_b0") + F.sum("size").over(upto) - F.col("size"))
        .withColumn("_at", F.col("_n0") + F.row_number().over(ordered) - 1)
        .withColumn("_twice", middle)
        .withColumn("shard", F.when(F.col("_large").isNull(), of_light).otherwise(of_large).cast("int"))
        .withColumn("_place", F.row_number().over(inside) - 1)
        .select(*[f"_c_{c}" for c in carry], *unit, "size", "text_crc32", "shard", "_place")
    )
    placed = settle(placed, "shard-placed")
    counts = placed.groupBy("shard", *unit).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("shard").orderBy(*unit).rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("shard", *unit, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_first"))
    return placed.join(F.broadcast(firsts), ["shard", *unit]).select(
        *[F.col(f"_c_{c}").alias(c) for c in carry],
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("_first") + F.col("_place")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
