"""Edges between and inside groups, and graph diagnostics, as relations; beam-search kernels are in kernels.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vector import l2
from .durable import settled


def cross_edges(member: DataFrame, edges: DataFrame, c: int) -> DataFrame:
    """(src, dst, dist): for each vector its c nearest vectors over all child groups of its group, ties by id.

    member(vec_id, embedding, group_id), edges(parent, child). Each child group gives at most its c nearest first.
    """
    src = member.select(F.col("vec_id").alias("src"), F.col("embedding").alias("x"), F.col("group_id").alias("parent"))
    dst = member.select(F.col("vec_id").alias("dst"), F.col("embedding").alias("y"), F.col("group_id").alias("child"))
    met = src.join(edges, "parent").join(dst, "child").select("src", "dst", "parent", "child", l2(F.col("x"), F.col("y")).alias("dist"))
    best = Window.partitionBy("src").orderBy("dist", "dst")
    return met.withColumn("rk", F.row_number().over(best)).where(F.col("rk") <= c).select("src", "dst", "parent", "child", "dist")


def guarantee_edges(member: DataFrame, edges: DataFrame, kept: DataFrame, c: int) -> DataFrame:
    """(src, dst): for edges between groups that no kept cross edge realises, c edges from the parent's first vectors.

    The vectors are taken by id; each gives its c // 2 nearest of the child group, until c edges are there.
    """
    missing = edges.join(kept.select("parent", "child").distinct(), ["parent", "child"], "left_anti")
    half = max(c // 2, 1)
    order = Window.partitionBy("group_id").orderBy("vec_id")
    first = member.withColumn("place", F.row_number().over(order)).select(F.col("vec_id").alias("src"), F.col("embedding").alias("x"), F.col("group_id").alias("parent"), "place")
    sizes = member.groupBy(F.col("group_id").alias("child")).agg(F.count("*").alias("n"))
    # vector number i starts while (i - 1) * min(c // 2, size of the child) edges are fewer than c
    starting = missing.join(sizes, "child").join(first, "parent").where((F.col("place") - 1) * F.least(F.lit(half), F.col("n")) < c)
    dst = member.select(F.col("vec_id").alias("dst"), F.col("embedding").alias("y"), F.col("group_id").alias("child"))
    met = starting.join(dst, "child").select("src", "dst", "parent", "child", l2(F.col("x"), F.col("y")).alias("dist"))
    best = Window.partitionBy("src", "child").orderBy("dist", "dst")
    return met.withColumn("rk", F.row_number().over(best)).where(F.col("rk") <= half).select("src", "dst", "parent", "child", "dist")


def complete_edges(member: DataFrame, most: int) -> DataFrame:
    """(src, dst) between all vectors of each group of at most `most` vectors, so a group gives a bounded number."""
    small = member.groupBy("group_id").count().where(F.col("count") <= most).select("group_id")
    inside = member.join(small, "group_id", "left_semi")
    other = inside.select("group_id", F.col("vec_id").alias("dst"))
    return inside.select("group_id", F.col("vec_id").alias("src")).join(other, "group_id").where("src <> dst").select("src", "dst")


def ring_edges(member: DataFrame, degree: int) -> DataFrame:
    """(src, dst): each vector to the next `degree` of its group in id order, around; never to itself."""
    place = F.row_number().over(Window.partitionBy("group_id").orderBy("vec_id")) - 1
    placed = member.select("group_id", "vec_id", place.alias("i")).join(member.groupBy("group_id").agg(F.count("*").alias("n")), "group_id")
    to = placed.where("n > 1").select("group_id", F.col("vec_id").alias("src"), "i", "n", F.explode(F.sequence(F.lit(1), F.least(F.lit(degree), F.col("n") - 1).cast("int"))).alias("step"))
    to = to.select("group_id", "src", ((F.col("i") + F.col("step")) % F.col("n")).alias("i"))
    return to.join(placed.select("group_id", "i", F.col("vec_id").alias("dst")), ["group_id", "i"]).select("src", "dst")


def nearest_edges(member: DataFrame, degree: int) -> DataFrame:
    """(src, dst): each vector to its nearest `degree` others of its group."""
    src = member.select("group_id", F.col("vec_id").alias("src"), F.col("embedding").alias("x"))
    dst = member.select("group_id", F.col("vec_id").alias("dst"), F.col("embedding").alias("y"))
    met = src.join(dst, "group_id").where("src <> dst").select("src", "dst", l2(F.col("x"), F.col("y")).alias("dist"))
    return met.withColumn("rk", F.row_number().over(Window.partitionBy("src").orderBy("dist", "dst"))).where(F.col("rk") <= degree).select("src", "dst")


def adjacency(edges: DataFrame) -> DataFrame:
    """(src, neighbours): sorted lists, the CSR form of a graph."""
    return edges.groupBy("src").agg(F.sort_array(F.collect_set("dst")).alias("neighbours"))


def degree_stats(edges: DataFrame) -> DataFrame:
    out = edges.groupBy("src").agg(F.count("*").alias("n"))
    return out.agg(F.sum("n").alias("edges"), F.count("*").alias("sources"), F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("n"), 6).alias("mean"))


def reciprocity(edges: DataFrame) -> DataFrame:
    """Edges whose reverse is an edge too, and all edges."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1).alias("back")).distinct()
    return edges.join(back, ["src", "dst"], "left").agg(F.count("back").alias("mutual"), F.count("*").alias("edges"))


def weak_components(edges: DataFrame) -> DataFrame:
    """(vec_id, component): the least id that edges reach in either direction, by propagation with label jumping until
    nothing changes. Each round is written to the shared folder."""
    both = settled(edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).union(edges.select("dst", "src")).distinct(), "links")
    labels = both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("c"))
    while True:
        near = both.join(labels.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.min("c").alias("m"))
        moved = labels.join(near, "u").select("u", F.least("c", "m").alias("c"), (F.col("m") < F.col("c")).alias("changed"))
        jump = labels.select(F.col("u").alias("c"), F.col("c").alias("to"))
        moved = settled(moved.join(jump, "c", "left").select("u", F.least("c", F.coalesce("to", "c")).alias("c"), "changed"), "labels")
        labels = moved.select("u", "c")
        if not moved.agg(F.max("changed")).first()[0]:
            return labels.select(F.col("u").alias("vec_id"), F.col("c").alias("component"))


def graph_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Edges that only one of two graphs has."""
    return a.select("src", "dst").exceptAll(b.select("src", "dst")).withColumn("only", F.lit("a")).unionByName(b.select("src", "dst").exceptAll(a.select("src", "dst")).withColumn("only", F.lit("b")))


def special_edges(member: DataFrame, blocks: DataFrame, tree: DataFrame, degree: int, c: int) -> DataFrame:
    """(src, dst): inside each block every vector's nearest `degree` others, and from each its c nearest in every child block.

    blocks(group_id, prefix), tree(parent, child) of prefixes.
    """
    inside = member.join(blocks.select("group_id", "prefix"), "group_id").select("vec_id", "embedding", "prefix")
    own = nearest_edges(inside.withColumnRenamed("prefix", "group_id"), degree)
    src = inside.select(F.col("vec_id").alias("src"), F.col("embedding").alias("x"), F.col("prefix").alias("parent"))
    dst = inside.select(F.col("vec_id").alias("dst"), F.col("embedding").alias("y"), F.col("prefix").alias("child"))
    met = src.join(tree, "parent").join(dst, "child").select("src", "dst", "child", l2(F.col("x"), F.col("y")).alias("dist"))
    best = Window.partitionBy("src", "child").orderBy("dist", "dst")
    down = met.withColumn("rk", F.row_number().over(best)).where(F.col("rk") <= c).select("src", "dst")
    return own.unionByName(down).distinct()
