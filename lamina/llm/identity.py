"""A long key for each document, ordered as doc_id is."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import settle, ship

_WHOLE_NUMBERS = ("tinyint", "smallint", "int", "bigint")


@dataclass
class Keyed:
    texts: DataFrame  # every row of docs as doc_id, text, key; null texts are empty
    once: DataFrame  # one of these for each key
    names: DataFrame  # the distinct doc_id, digest, key
    plain: bool  # whether the key is the id


def keyed(docs: DataFrame) -> Keyed:
    """Docs by key.

    Where ids are integers, unique and not null the key is the id. Otherwise documents are ordered by id, nulls last,
    then by the text's digest; rows with equal id and text share a key, so they get the same result.
    """
    ship(docs.sparkSession)
    body = F.coalesce(F.col("text"), F.lit(""))
    plain = docs.select("doc_id", body.alias("text"), F.unhex(F.sha2(body, 256)).alias("digest"))
    if dict(docs.dtypes)["doc_id"] in _WHOLE_NUMBERS:
        slim = settle(plain.select("doc_id", "digest"), "ids")
        if unique(slim):
            key = F.col("doc_id").cast("long").alias("key")
            texts = plain.select("doc_id", "text", key)
            return Keyed(texts, texts, slim.select("doc_id", "digest", key), True)
    else:
        slim = plain.select("doc_id", "digest")
    ordered = slim.distinct().orderBy(F.col("doc_id").asc_nulls_last(), "digest")
    names = settle(ordered.withColumn("key", F.monotonically_increasing_id()), "keys")
    right = names.toDF("_id", "_digest", "key")
    joined = plain.join(right, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")))
    texts = joined.select("doc_id", "text", "key")
    return Keyed(texts, texts.dropDuplicates(["key"]), names, False)


def unique(slim: DataFrame) -> bool:
    """Whether doc_id is never null and never repeated."""
    found = slim.groupBy("doc_id").count().agg(F.max("count").alias("most"), F.max(F.col("doc_id").isNull()).alias("nulls")).first()
    return (found["most"] or 0) <= 1 and not found["nulls"]


def rows_as_documents(docs: DataFrame) -> tuple[DataFrame, bool]:
    """(docs with a column _row that tells rows apart, whether that is the id).

    Where ids are not unique integers, the table is written to the shared folder with numbers of its rows.
    """
    if dict(docs.dtypes)["doc_id"] in _WHOLE_NUMBERS and unique(docs.select("doc_id")):
        return docs.withColumn("_row", F.col("doc_id").cast("long")), True
    return settle(docs.withColumn("_row", F.monotonically_increasing_id()), "rows"), False
