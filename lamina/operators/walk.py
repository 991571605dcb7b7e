"""Filtered search over one graph of all groups, as joins of a frontier with edges.

Edges inside groups and from groups to their minimal supersets lead from a query's entry groups to rows that contain its
labels and to no others, so the walk needs no filter. All queries walk together: a round expands whatever in a query's
beam is not expanded yet, so rounds are few (about the graph's depth) and a round shuffles at most the beams' neighbours.
Vectors, edges and places seen stay tables; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vector import l2
from .durable import settled
from .graph import adjacency, cross_edges, guarantee_edges
from .kernels import ENOUGH, SEARCHED, TRIED
from .search import few, knn, ranked


def unified_edges(member: DataFrame, tree: DataFrame, inside: DataFrame, c: int) -> DataFrame:
    """(src, dst): edges inside groups, cross edges to child groups and those that guarantee every pair of tree(parent, child)."""
    cross = settled(cross_edges(member, tree, c), "cross")
    more = guarantee_edges(member, tree, cross, c)
    return inside.select("src", "dst").unionByName(cross.select("src", "dst")).unionByName(more.select("src", "dst")).distinct()


def entry_points(member: DataFrame, entries: DataFrame, most: int = 16) -> DataFrame:
    """(qid, vec_id): of each entry group (qid, c) its first vectors by id, at most so many."""
    place = F.row_number().over(Window.partitionBy("group_id").orderBy("vec_id"))
    first = member.select("vec_id", "group_id", place.alias("place")).where(F.col("place") <= most)
    return entries.select("qid", F.col("c").alias("group_id")).join(first, "group_id").select("qid", "vec_id").distinct()


def walk(member: DataFrame, edges: DataFrame, queries: DataFrame, starts: DataFrame, k: int, width: int = 64, blocks: DataFrame | None = None, special: DataFrame | None = None) -> DataFrame:
    """qid, vec_id, dist, rk, and hops: the k nearest places that walks from starts(qid, vec_id) meet, width at a time.

    blocks(group_id, prefix) and special(src, dst): a walk that steps on the root group of a block whose prefix contains
    the query's labels becomes free; a free place is left by special edges only, and may be met in both states.
    """
    vectors = settled(member.select("vec_id", "embedding", "group_id"), "vectors")
    asked = few(settled(queries.select("qid", "qvec", *(["qlabels"] if blocks is not None else [])), "asked"))
    steps = adjacency(edges).withColumn("free", F.lit(False))
    if blocks is not None:
        steps = steps.unionByName(adjacency(special).withColumn("free", F.lit(True)))
    steps = settled(steps.select(F.col("src").alias("vec_id"), "free", "neighbours"), "steps")

    def laid(places: DataFrame) -> DataFrame:
        """places(qid, vec_id, free) with distances; those on roots of covered blocks become free."""
        met = places.join(vectors, "vec_id").join(asked, "qid").withColumn("dist", l2(F.col("embedding"), F.col("qvec")))
        if blocks is not None:
            met = met.join(blocks, "group_id", "left")
            met = met.withColumn("free", F.col("free") | F.coalesce(F.forall("qlabels", lambda x: F.array_contains(F.col("prefix"), x)), F.lit(False)))
        return met.select("qid", "vec_id", "free", "dist").distinct()

    seen = settled(laid(starts.select("qid", "vec_id", F.lit(False).alias("free"))), "seen")
    beam = seen.withColumn("expanded", F.lit(False)).withColumn("hops", F.lit(0))
    hop = 0
    while True:
        order = Window.partitionBy("qid").orderBy("dist", "vec_id", "free")
        beam = settled(beam.withColumn("_p", F.row_number().over(order)).where(F.col("_p") <= width).drop("_p"), "beam")
        frontier = beam.where(~F.col("expanded")).select("qid", "vec_id", "free")
        if frontier.isEmpty():
            break
        hop += 1
        reached = frontier.join(steps, ["vec_id", "free"]).select("qid", F.explode("neighbours").alias("vec_id"), "free").distinct()
        fresh = settled(laid(reached.join(seen, ["qid", "vec_id", "free"], "left_anti")).join(seen.select("qid", "vec_id", "free"), ["qid", "vec_id", "free"], "left_anti"), "fresh")
        seen = seen.unionByName(fresh)
        beam = beam.withColumn("expanded", F.lit(True)).unionByName(fresh.withColumn("expanded", F.lit(False)).withColumn("hops", F.lit(hop)))
    best = beam.groupBy("qid", "vec_id").agg(F.min("dist").alias("dist"), F.min("hops").alias("hops"))
    return ranked(best, k)


def fitted_walk(member: DataFrame, edges: DataFrame, queries: DataFrame, k: int, width: int = 64, starts: int = 16) -> DataFrame:
    """walk from the same few places for all queries, as wide as finds ENOUGH of the k nearest to TRIED of the queries.

    Width and number of starting places, drawn by a hash of the id, are doubled until it is enough; a walk that starts
    from all places is exact, so this ends. The first width is `width` for each SEARCHED vectors.
    """
    edges, n = settled(edges, "edges"), member.count()
    width *= -(-n // SEARCHED)
    tried = settled(queries.orderBy(F.xxhash64("qid"), "qid").limit(TRIED), "tried")
    wanted = settled(knn(member, tried, k).select("qid", "vec_id"), "wanted")
    most = wanted.count()

    def walked(asked: DataFrame) -> DataFrame:
        first = member.select("vec_id").orderBy(F.xxhash64("vec_id"), "vec_id").limit(starts)
        return walk(member, edges, asked, asked.select("qid").crossJoin(few(first)), k, width)

    while starts < 2 * n and wanted.join(walked(tried), ["qid", "vec_id"], "left_semi").count() < ENOUGH * most:
        width, starts = 2 * width, 2 * starts
    return walked(queries)
