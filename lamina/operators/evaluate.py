"""Recall, precision and operating points as relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RECALL_MODES = ("gt", "k", "least", "ties")


def recall(truth: DataFrame, found: DataFrame, k: int, mode: str = "gt") -> DataFrame:
    """(qid, recall) of found against truth, both (qid, vec_id, dist, rk).

    gt: hits over the number of true rows, null without any; k: over k; least: over min(k, true rows, found rows);
    ties: a result also hits if it ties with a true distance not yet matched, in percent.
    """
    if mode not in RECALL_MODES:
        raise ValueError(f"unknown mode {mode!r}")
    t, r = truth.where(F.col("rk") <= k), found.where(F.col("rk") <= k)
    sizes = t.groupBy("qid").agg(F.count("*").alias("n")).join(r.groupBy("qid").agg(F.count("*").alias("m")), "qid", "full")
    if mode == "ties":
        limit = t.groupBy("qid").agg(F.max(F.round("dist", 9)).alias("limit"))
        hits = r.join(limit, "qid").where(F.round("dist", 9) <= F.col("limit")).groupBy("qid").agg(F.count("*").alias("hits"))
    else:
        hits = r.join(t.select("qid", "vec_id"), ["qid", "vec_id"], "left_semi").groupBy("qid").agg(F.count("*").alias("hits"))
    below = {"gt": F.col("n"), "ties": F.col("n"), "k": F.lit(k), "least": F.least(F.lit(k), F.coalesce("n", F.lit(0)), F.coalesce("m", F.lit(0)))}[mode]
    share = F.try_divide(F.coalesce("hits", F.lit(0)).cast("double"), below)
    return sizes.join(hits, "qid", "left").select("qid", (share * (100.0 if mode == "ties" else 1.0)).alias("recall"))


def intersection(truth: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """Common rows within the first k over queries * k."""
    hits = found.where(F.col("rk") <= k).join(truth.where(F.col("rk") <= k), ["qid", "vec_id"], "left_semi")
    return hits.agg(F.count("*").alias("hits")).crossJoin(truth.agg(F.count_distinct("qid").alias("q"))).select((F.col("hits") / (F.col("q") * k)).alias("intersection"))


def one_recall(truth: DataFrame, found: DataFrame, at: int) -> DataFrame:
    """Share of queries whose nearest true row is among the first `at` found."""
    best = truth.where("rk = 1").select("qid", "vec_id")
    met = best.join(found.where(F.col("rk") <= at).select("qid", "vec_id", F.lit(1).alias("hit")), ["qid", "vec_id"], "left")
    return met.agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))


def range_counts(truth: DataFrame, found: DataFrame) -> DataFrame:
    """(qid, ngt, nres, hits) of radius results (qid, vec_id); queries in either."""
    t = truth.select("qid", "vec_id", F.lit(1).alias("t"))
    r = found.select("qid", "vec_id", F.lit(1).alias("r"))
    both = t.join(r, ["qid", "vec_id"], "full")
    return both.groupBy("qid").agg(F.count("t").alias("ngt"), F.count("r").alias("nres"), F.count_if(F.col("t").isNotNull() & F.col("r").isNotNull()).alias("hits"))


def precision_recall(counts: DataFrame) -> DataFrame:
    """counts with precision (1 without results) and recall (without true rows: 1 if there are no results, else 0)."""
    p = F.when(F.col("nres") == 0, 1.0).otherwise(F.try_divide(F.col("hits").cast("double"), F.col("nres")))
    r = F.when(F.col("ngt") == 0, F.when(F.col("nres") == 0, 1.0).otherwise(0.0)).otherwise(F.try_divide(F.col("hits").cast("double"), F.col("ngt")))
    return counts.withColumn("precision", p).withColumn("recall", r)


def pareto(points: DataFrame) -> DataFrame:
    """Points (name, perf, t) with perf above 0 and none of at least that perf that is faster, or as fast and better."""
    p = points.where("perf > 0").groupBy("perf").agg(F.min(F.struct("t", "name")).alias("b")).select("perf", F.col("b.t").alias("t"), F.col("b.name").alias("name"))
    above = Window.orderBy(F.col("perf").desc()).rowsBetween(Window.unboundedPreceding, -1)
    return p.withColumn("best", F.min("t").over(above)).where("best is null or t < best").select("name", "perf", "t")


def ratio(df: DataFrame, numerator: str, denominator: str) -> DataFrame:
    return df.agg(F.try_divide(F.sum(numerator), F.sum(denominator)).alias("ratio"))


def imbalance(df: DataFrame, key: str) -> DataFrame:
    """k * sum of squared sizes over the square of their sum."""
    return df.groupBy(key).agg(F.count("*").alias("h")).agg((F.count("*") * F.sum(F.col("h") * F.col("h")) / (F.sum("h") * F.sum("h"))).alias("imbalance"))
