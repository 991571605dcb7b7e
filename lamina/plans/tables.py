"""Views over the driver's tables that the registered queries share, in Spark and as DuckDB text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vector as V

K = 10


def embeddings(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet")


def _labels(nested: bool) -> F.Column:
    one, two, three = F.col("label"), (F.lit(100) + F.col("vec_id") % 3).cast("int"), (F.lit(200) + F.col("vec_id") % 5).cast("int")
    full = F.array_sort(F.array_distinct(F.array(one, two, three)))
    if not nested:
        return full
    return F.when(F.col("vec_id") % 4 == 0, F.array(one)).when(F.col("vec_id") % 4 == 1, F.array(one, two)).otherwise(full)


def base(spark: SparkSession, d: str, nested: bool = False) -> DataFrame:
    """vec_id, embedding, label, labels: flat sets of three labels, or nested ones of one to three."""
    return embeddings(spark, d).select("vec_id", "embedding", "label", _labels(nested).alias("labels"))


def queries(spark: SparkSession, d: str) -> DataFrame:
    """qid, qvec, qlabels: the stated query set, every id divisible by 100, against all rows."""
    rows = embeddings(spark, d).where("vec_id % 100 = 0")
    return rows.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"), F.array("label", (F.lit(200) + F.col("vec_id") % 5).cast("int")).alias("qlabels"))


def bits(df: DataFrame, vector: str = "embedding", name: str = "bits") -> DataFrame:
    return df.withColumn(name, V.sign_bits(F.col(vector)))


BASE = "base AS (SELECT vec_id, embedding, label, [label, (100 + vec_id % 3)::INT, (200 + vec_id % 5)::INT] AS labels FROM embeddings)"
NESTED = (
    "base AS (SELECT vec_id, embedding, label, CASE WHEN vec_id % 4 = 0 THEN [label] WHEN vec_id % 4 = 1 THEN [label, (100 + vec_id % 3)::INT]"
    " ELSE [label, (100 + vec_id % 3)::INT, (200 + vec_id % 5)::INT] END AS labels FROM embeddings)"
)
QUERIES = "queries AS (SELECT vec_id AS qid, embedding AS qvec, [label, (200 + vec_id % 5)::INT] AS qlabels FROM embeddings WHERE vec_id % 100 = 0)"
GROUPS = (
    "groups AS (SELECT row_number() OVER (ORDER BY first_vec_id) AS group_id, labels, group_size, first_vec_id FROM"
    " (SELECT labels, count(*) AS group_size, min(vec_id) AS first_vec_id FROM base GROUP BY labels))"
)
STRICT = "strict AS (SELECT p.group_id AS p, c.group_id AS c FROM groups p JOIN groups c ON list_has_all(c.labels, p.labels) AND len(c.labels) > len(p.labels))"
EDGES = (
    "edges AS (SELECT p AS parent, c AS child FROM strict s WHERE NOT EXISTS"
    " (SELECT 1 FROM strict a JOIN strict b ON a.c = b.p WHERE a.p = s.p AND b.c = s.c))"
)


def zipped(a: str, b: str, term: str) -> str:
    """DuckDB: the sum of term over components x and y of two lists, in double."""
    body = term.replace("{x}", "p[1]::DOUBLE").replace("{y}", "p[2]::DOUBLE")
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda p: {body}))"


def l2(a: str, b: str) -> str:
    return zipped(a, b, "({x} - {y}) * ({x} - {y})")


def ip(a: str, b: str) -> str:
    return zipped(a, b, "{x} * {y}")


def packed(v: str) -> str:
    """DuckDB: sign bits of a list as a 64-character bit string."""
    return f"(SELECT string_agg(CASE WHEN {v}[i] > 0 THEN '1' ELSE '0' END, '' ORDER BY i) FROM range(1, 65) t(i))::BIT"
