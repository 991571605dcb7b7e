"""Label predicates, metadata predicates and id selectors as Columns or joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical(labels: Column) -> Column:
    """A label set sorted and without repeats; a missing one is {1}."""
    return F.coalesce(F.array_sort(F.array_distinct(labels)), F.array(F.lit(1)))


def equality(base: Column, query: Column) -> Column:
    return base == query


def containment(base: Column, query: Column) -> Column:
    """All query labels are in base; an empty query is contained in everything."""
    return F.forall(query, lambda x: F.array_contains(base, x))


def overlap(base: Column, query: Column) -> Column:
    """Some label is common; an empty query overlaps with nothing."""
    return F.arrays_overlap(base, query)


def everything(base: Column, query: Column) -> Column:
    return F.lit(True)


SCENARIOS = {"equality": equality, "containment": containment, "overlap": overlap, "nofilter": everything}


def scenario(name: str, legacy_nofilter: bool = False):
    """The predicate of a scenario. legacy_nofilter: "nofilter" compares for equality, as unlabelled data all have {1}."""
    if name not in SCENARIOS:
        raise ValueError(f"unknown scenario {name!r}")
    return equality if name == "nofilter" and legacy_nofilter else SCENARIOS[name]


def metadata(op: str, column: Column, value) -> Column:
    """EQUAL: the value; OR: a common bit; REGEX: a match anywhere."""
    if op == "EQUAL":
        return column == F.lit(value)
    if op == "OR":
        return column.bitwiseAND(F.lit(value)) != 0
    if op == "REGEX":
        return column.rlike(value)
    raise ValueError(f"unknown operation {op!r}")


def id_range(ids: Column, low: int, high: int) -> Column:
    return (ids >= low) & (ids < high)


def id_bitmap(ids: Column, bitmap: Column) -> Column:
    """Whether bit id % 8 of byte id / 8 of a binary is set; ids beyond it are not."""
    byte = F.conv(F.hex(F.substring(bitmap, (F.floor(ids / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.call_function("shiftright", byte, (ids % 8).cast("int")).bitwiseAND(1) == 1, F.lit(False))


def id_in(df: DataFrame, ids: DataFrame, key: str = "vec_id") -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_semi")


def id_not_in(df: DataFrame, ids: DataFrame, key: str = "vec_id") -> DataFrame:
    return df.join(ids.select(key), key, "left_anti")


def relational_division(base: DataFrame, queries: DataFrame, empty_matches: bool = False) -> DataFrame:
    """(qid, vec_id) with all query labels among the base's: postings joined by label, counted per pair.

    base(vec_id, labels), queries(qid, qlabels). Only rows that share a label meet. empty_matches: whether a query
    without labels matches everything or nothing.
    """
    postings = base.select("vec_id", F.explode("labels").alias("label")).distinct()
    wanted = queries.select("qid", F.array_distinct("qlabels").alias("ql")).withColumn("n", F.size("ql"))
    asked = wanted.select("qid", "n", F.explode("ql").alias("label"))
    found = asked.join(postings, "label").groupBy("qid", "vec_id").agg(F.count("*").alias("c"), F.first("n").alias("n")).where("c = n").select("qid", "vec_id")
    if empty_matches:
        found = found.unionByName(wanted.where("n = 0").select("qid").crossJoin(base.select("vec_id").distinct()))
    return found


def rare_label_containment(base: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, key) with the query's labels contained in key's: an equi-join on the query's rarest label, then a check.

    base(key, labels), queries(qid, qlabels). A query without labels meets everything; one with a label that the base
    lacks meets nothing.
    """
    postings = base.select("key", "labels", F.explode("labels").alias("label")).distinct()
    often = postings.groupBy("label").agg(F.count("*").alias("n"))
    each = queries.select("qid", F.explode("qlabels").alias("label")).distinct()
    rated = each.join(often, "label", "left").groupBy("qid").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "label")).alias("r"))
    keyed = queries.join(rated, "qid").select("qid", "qlabels", F.col("r.label").alias("label"))
    met = keyed.join(postings, "label").where(containment(F.col("labels"), F.col("qlabels"))).select("qid", "key")
    free = queries.where(F.size("qlabels") == 0).select("qid")
    return met.unionByName(free.crossJoin(base.select("key")))
