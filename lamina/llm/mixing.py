"""Mixing sources to target weights by capped water-filling, then seeded whole and fractional repetitions.

Built of DataFrame functions only. What is kept per source is a few numbers, so the rows themselves are not shuffled
but for a slim table of sizes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import settle

WORD = "[^\\x20\\x09-\\x0D]+"
#: Sources up to this many are broadcast (under 200 bytes each); more are joined by a shuffle.
BROADCAST_SOURCES = 100_000
_BUCKET_DIGITS = 3


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _draw(id_col: str, seed: int) -> F.Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")))


def water_fill(sources: DataFrame, weights: tuple[float, ...], share: float, max_epochs: float) -> DataFrame:
    """Adds target to (source, source_size): weights repeat over the sources by code point, null last.

    A source is clamped at max_epochs times its size; the excess goes to the others by weight until none is above.
    With all clamped (share above max_epochs, or nothing to share) every target is its clamp.
    """
    everything = Window.partitionBy()
    ranked = sources.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("_rank") - 1) % len(weights) + 1).cast("int"))
    ranked = ranked.select("source", "source_size", "_rank", w.alias("_w"), (F.col("source_size") * float(max_epochs)).alias("_cap"))
    by_level = Window.orderBy(F.col("_cap") / F.col("_w"), "_rank")
    upto = by_level.rowsBetween(Window.unboundedPreceding, 0)
    budget = F.sum("source_size").over(everything) * F.lit(float(share))
    filled = ranked.select(
        "*",
        budget.alias("_budget"),
        (F.sum("_cap").over(upto) - F.col("_cap")).alias("_cap_before"),
        (F.sum("_w").over(everything) - F.sum("_w").over(upto) + F.col("_w")).alias("_w_rest"),
    ).withColumn("_clamped", F.col("_cap") * F.col("_w_rest") <= (F.col("_budget") - F.col("_cap_before")) * F.col("_w"))
    taken = F.sum(F.when(F.col("_clamped"), F.col("_cap")).otherwise(0.0)).over(everything)
    open_w = F.sum(F.when(F.col("_clamped"), F.lit(0.0)).otherwise(F.col("_w"))).over(everything)
    return filled.select("source", "source_size", F.when(F.col("_clamped"), F.col("_cap")).otherwise(F.col("_w") * (F.col("_budget") - taken) / open_w).alias("target"))


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    max_epochs: float = 2.0,
    *,
    carry: tuple[str, ...] = ("doc_id",),
    seed: int = 11,
) -> DataFrame:
    """The carried columns of docs, size, source_size, target, epochs and taken for every row.

    size: words of the text (null: 0). Each row of a source is taken floor(target / source_size) times, and the rows
    first in a seeded order of ids once more, up to the whole row nearest to the target. Rows with equal source and id
    are taken alike. A source without words has target 0 and epochs 0. Empty tables give an empty result; null sources
    are one source; other columns are ignored, also those named like the result's.
    """
    sized = docs.select(*[F.col(c).alias(f"_c_{c}") for c in carry], F.col("source").alias("source"), word_count(F.col("text")).alias("size"), _draw("doc_id", seed).alias("_key"))
    carried_text = "text" in carry
    slim = settle(sized.select("source", "size", "_key") if carried_text else sized, "mix-slim")
    rows = sized if carried_text else slim

    sources = settle(slim.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    n_sources = sources.count()
    near = (lambda d: F.broadcast(d)) if n_sources <= BROADCAST_SOURCES else (lambda d: d)
    plan = water_fill(sources, weights, share, max_epochs)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = settle(plan.select("source", "source_size", "target", F.floor(rate).cast("long").alias("_whole")), "mix-plan")
    plan = plan.withColumn("_part", F.col("target") - F.col("source_size") * F.col("_whole"))

    # where the fractional repetition ends: first the bucket of draws, then the row within that bucket
    bucket = F.substring("_key", 1, _BUCKET_DIGITS)
    sums = slim.groupBy("source", bucket.alias("_bucket")).agg(F.sum("size").alias("_b"))
    running = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_b").over(running), F.lit(0)))
    ends = sums.alias("s").join(near(plan.alias("p")), F.col("s.source").eqNullSafe(F.col("p.source"))).where("_before < _part and _before + _b >= _part")
    ends = ends.select(F.col("s.source").alias("_s"), "_bucket", "_before", "_part")
    inside = slim.join(near(ends), F.col("source").eqNullSafe(F.col("_s")) & (bucket == F.col("_bucket")))
    upto = Window.partitionBy("_s").orderBy("_key").rangeBetween(Window.unboundedPreceding, 0)
    alike = Window.partitionBy("_s", "_key")
    inside = inside.select("_s", "_key", "_bucket", (2 * (F.col("_before") + F.sum("size").over(upto)) - F.sum("size").over(alike) <= 2 * F.col("_part")).alias("_in"))
    last = inside.groupBy("_s").agg(F.max(F.when(F.col("_in"), F.col("_key"))).alias("_last"), F.first("_bucket").alias("_bucket"))
    # no row of the bucket taken: everything before the bucket still is
    last = last.select("_s", F.coalesce("_last", "_bucket").alias("_last"))
    plan = settle(plan.join(near(last), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s", "_part"), "mix-ends")

    plan = plan.withColumnRenamed("source", "_source")
    extra = F.when(F.col("_key") <= F.col("_last"), 1).otherwise(0)
    return (
        rows.join(near(plan), F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("epochs", F.when(F.col("size") > 0, F.col("_whole") + extra).otherwise(F.lit(0)).cast("long"))
        .select(*[F.col(f"_c_{c}").alias(c) for c in carry], "size", "source_size", "target", "epochs", (F.col("size") * F.col("epochs")).alias("taken"))
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: docs with each row repeated as often as it is taken, in docs' columns."""
    out = mix(docs, carry=tuple(docs.columns), **options)
    out = out.toDF(*[f"_{i}" for i in range(len(out.columns))])
    n = len(docs.columns)
    repeated = out.select("*", F.explode(F.array_repeat(F.lit(0), F.col(f"_{n + 3}").cast("int"))).alias("_again"))
    return repeated.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns)])


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('11:' || doc_id::VARCHAR) AS k
  FROM documents),
ranked AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY source IS NULL, source) AS rk
  FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE (rk - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w,
         source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE AS budget
  FROM ranked),
levels AS (
  SELECT *, sum(cap) OVER (ORDER BY cap / w, rk ROWS UNBOUNDED PRECEDING) - cap AS cap_before,
         sum(w) OVER () - sum(w) OVER (ORDER BY cap / w, rk ROWS UNBOUNDED PRECEDING) + w AS w_rest
  FROM weighed),
clamped AS (SELECT *, cap * w_rest <= (budget - cap_before) * w AS is_clamped FROM levels),
targets AS (
  SELECT source, source_size,
         CASE WHEN is_clamped THEN cap
              ELSE w * (budget - sum(CASE WHEN is_clamped THEN cap ELSE 0 END) OVER ())
                   / sum(CASE WHEN is_clamped THEN 0 ELSE w END) OVER () END AS target
  FROM clamped),
rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM targets),
placed AS (
  SELECT s.doc_id, s.size, r.source_size, r.target, r.whole, r.target - r.source_size * r.whole AS part,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.doc_id ROWS UNBOUNDED PRECEDING) AS upto
  FROM sized s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN 2 * upto - size <= 2 * part THEN 1 ELSE 0 END))::BIGINT AS taken
FROM placed
"""
