"""Seeded generators of labels, queries and vectors: every draw is a hash of (id, label, seed), so reruns agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

def draw(seed: int, *keys: Column) -> Column:
    """A number from 0 up to 1 that depends on the keys and the seed alone: 48 bits of a digest that other systems have too."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys]))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))


def draw_sql(seed: int, *keys: str) -> str:
    """The same in DuckDB."""
    return f"(('0x' || left(md5(concat_ws(':', {seed}, {', '.join(keys)})), 12))::BIGINT / {1 << 48}.0::DOUBLE)"


def labels(spark: SparkSession, n: int, kind: str, count: int, seed: int = 1) -> DataFrame:
    """(vec_id, labels) for ids below n. zipf: label i with chance 0.7 / i; uniform: each with chance 0.5; poisson: with
    chance e^-1 (i-th power of 1/2 beyond); one_per_point: exactly one; multi_normal: two draws about the middle."""
    ids = spark.range(n).withColumnRenamed("id", "vec_id")
    if kind == "one_per_point":
        return ids.select("vec_id", F.array((F.floor(draw(seed, F.col("vec_id")) * count) + 1).cast("int")).alias("labels"))
    if kind == "multi_normal":
        middle = lambda s: (F.floor((draw(s, F.col("vec_id")) + draw(s + 1, F.col("vec_id")) + draw(s + 2, F.col("vec_id"))) / 3 * count) + 1).cast("int")
        return ids.select("vec_id", F.array_sort(F.array_distinct(F.array(middle(seed), middle(seed + 3)))).alias("labels"))
    chance = {"zipf": lambda i: F.lit(0.7) / i, "uniform": lambda i: F.lit(0.5), "poisson": lambda i: F.exp(F.lit(-1.0)) * F.pow(F.lit(0.5), i - 1)}
    if kind not in chance:
        raise ValueError(f"unknown kind {kind!r}")
    return _bernoulli(ids, count, chance[kind], seed)


def _bernoulli(ids: DataFrame, count: int, chance, seed: int) -> DataFrame:
    every = F.sequence(F.lit(1), F.lit(count))
    has = F.filter(every, lambda i: draw(seed, F.col("vec_id"), i) < chance(i))
    one = F.array((F.floor(draw(seed + 7, F.col("vec_id")) * count) + 1).cast("int"))
    return ids.select("vec_id", F.when(F.size(has) > 0, has).otherwise(one).alias("labels"))


def power_zipf(spark: SparkSession, n: int, count: int = 30, most: float = 0.9, scale: float = 0.75, power: float = 0.85, seed: int = 20260519) -> DataFrame:
    """Label i has chance min(most, scale / (i + 1)^power); a vector without any gets one."""
    return _bernoulli(spark.range(n).withColumnRenamed("id", "vec_id"), count, lambda i: F.least(F.lit(most), F.lit(scale) / F.pow(i + F.lit(1), F.lit(power))), seed)


def subset_queries(grouped: DataFrame, per_group: int, least: int, most: int, seed: int = 1, hottest: bool = False, children: int = 0) -> DataFrame:
    """(qid, qlabels): seeded subsets of groups' label sets that between least and most vectors match.

    hottest: only of the smallest labels, as many as three times the wanted length; children: at least so many groups
    must strictly contain the query.
    """
    from .groups import query_coverage, super_groups

    pool = F.slice(F.array_sort("labels"), 1, 3) if hottest else F.col("labels")
    tries = grouped.select("group_id", pool.alias("pool"), F.explode(F.sequence(F.lit(1), F.lit(per_group))).alias("t"))
    picked = F.filter("pool", lambda x: draw(seed, F.col("group_id"), F.col("t"), x) < 0.5)
    made = tries.select(picked.alias("qlabels")).where(F.size("qlabels") > 0).distinct().withColumn("qid", F.xxhash64("qlabels"))
    kept = query_coverage(grouped, made).where(F.col("matched_points").between(least, most))
    if children:
        more = super_groups(grouped, made).groupBy("qid").count().where(F.col("count") > children)
        kept = kept.join(more, "qid", "left_semi")
    return made.join(kept, "qid").select("qid", "qlabels", "matched_points")


def coverage_profiles(covered: DataFrame) -> DataFrame:
    """qid, matched_groups and profile: narrow 2 to 8 groups, medium to 64, broad beyond; others none."""
    g = F.col("matched_groups")
    return covered.select("qid", "matched_groups", F.when(g.between(2, 8), "narrow").when(g.between(9, 64), "medium").when(g >= 65, "broad").alias("profile"))


def vectors(spark: SparkSession, n: int, d: int, kind: str = "normal", seed: int = 1338, exact: bool = False) -> DataFrame:
    """(vec_id, embedding) of seeded numbers, as floats, or doubles if exact. normal, uniform, ints, or smooth: sines of
    sums of a few normals."""
    ids = spark.range(n).withColumnRenamed("id", "vec_id")
    u = lambda i, s: F.greatest(draw(seed + s, F.col("vec_id"), i), F.lit(1e-9))
    normal = lambda i, s=0: F.sqrt(-2 * F.ln(u(i, s))) * F.cos(2 * 3.141592653589793 * u(i, s + 1))
    every = F.sequence(F.lit(1), F.lit(d))
    make = {
        "normal": lambda i: normal(i),
        "uniform": lambda i: u(i, 0),
        "ints": lambda i: F.floor(u(i, 0) * 256).cast("double"),
        "smooth": lambda i: F.sin(sum((normal(F.lit(k), 10) * F.sin(i * (k + 1)) for k in range(4)), F.lit(0.0))),
    }
    if kind not in make:
        raise ValueError(f"unknown kind {kind!r}")
    return ids.select("vec_id", F.transform(every, make[kind]).cast("array<double>" if exact else "array<float>").alias("embedding"))
