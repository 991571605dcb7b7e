"""Label-set groups, the containment graph over them, coverage, entry groups and special blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .durable import settled
from .predicates import rare_label_containment


def numbered(df: DataFrame, order: str, name: str, start: int = 1, buckets: int = 256) -> DataFrame:
    """df with consecutive numbers by a numeric column of distinct values, without one task seeing all rows.

    Rows are dealt to buckets between quantiles of the column, so outliers don't crowd the others into one.
    """
    parts = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    cuts = df.agg(F.percentile_approx(order, parts, 20_000).alias("cuts")).first()["cuts"]
    bounds = F.array(*[F.lit(c) for c in sorted(set(cuts or []))])
    dealt = df.withColumn("_b", F.size(F.filter(bounds, lambda c: c <= F.col(order))) if cuts else F.lit(0))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("_b").agg(F.count("*").alias("_n")).withColumn("_o", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("_b").orderBy(order))
    return dealt.join(F.broadcast(offsets.select("_b", "_o")), "_b").withColumn(name, (inside + F.col("_o") + (start - 1)).cast("long")).drop("_b", "_o")


def groups(base: DataFrame) -> DataFrame:
    """group_id (from 1, by first appearance), labels, group_size, first_vec_id of base(vec_id, labels).

    The table is written to the shared folder: whatever is made of the groups reads the base no more.
    """
    found = settled(base.groupBy("labels").agg(F.count("*").alias("group_size"), F.min("vec_id").alias("first_vec_id")), "label-sets")
    return numbered(found, "first_vec_id", "group_id").select("group_id", "labels", "group_size", "first_vec_id")


def members(base: DataFrame, grouped: DataFrame) -> DataFrame:
    """vec_id, group_id and the row's other columns."""
    return base.join(grouped.select("labels", "group_id"), "labels")


def reordered(base: DataFrame, grouped: DataFrame) -> DataFrame:
    """vec_id, group_id, new_id: rows numbered from 0 so that groups are contiguous."""
    sizes = grouped.select("group_id", "group_size")
    before = Window.orderBy("group_id").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_o", F.coalesce(F.sum("group_size").over(before), F.lit(0))).select("group_id", "_o")
    inside = F.row_number().over(Window.partitionBy("group_id").orderBy("vec_id"))
    return members(base, grouped).join(starts, "group_id").select("vec_id", "group_id", (F.col("_o") + inside - 1).cast("long").alias("new_id"))


def supersets(grouped: DataFrame) -> DataFrame:
    """(p, c): the labels of group c strictly contain those of p. Equals the descendants in the containment graph."""
    met = rare_label_containment(grouped.select(F.col("group_id").alias("key"), "labels"), grouped.select(F.col("group_id").alias("qid"), F.col("labels").alias("qlabels")))
    return met.where("qid <> key").select(F.col("qid").alias("p"), F.col("key").alias("c"))


def _minimal(candidates: DataFrame, strict: DataFrame) -> DataFrame:
    """(qid, c) without those that strictly contain another candidate of the same qid."""
    inner = candidates.select("qid", F.col("c").alias("p"))
    dominated = inner.join(strict, "p").select("qid", "c").join(candidates, ["qid", "c"]).distinct()
    return candidates.join(dominated, ["qid", "c"], "left_anti")


def lng_edges(grouped: DataFrame, strict: DataFrame | None = None) -> DataFrame:
    """(parent, child) from each group to its minimal strict supersets."""
    strict = strict if strict is not None else supersets(grouped)
    return _minimal(strict.select(F.col("p").alias("qid"), "c"), strict).select(F.col("qid").alias("parent"), F.col("c").alias("child"))


def super_groups(grouped: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, c): all groups whose labels contain the query's."""
    met = rare_label_containment(grouped.select(F.col("group_id").alias("key"), "labels"), queries.select("qid", "qlabels"))
    return met.select("qid", F.col("key").alias("c"))


def min_super_sets(grouped: DataFrame, queries: DataFrame, avoid_self: bool = False) -> DataFrame:
    """(qid, c): the minimal groups that contain the query; without avoid_self an equal group stands alone."""
    found = super_groups(grouped, queries)
    if avoid_self:
        same = queries.join(grouped, F.col("qlabels") == F.col("labels")).select("qid", F.col("group_id").alias("c"))
        found = found.join(same, ["qid", "c"], "left_anti")
    # only the groups that some query found can be in each other's way
    met = grouped.join(found.select(F.col("c").alias("group_id")).distinct(), "group_id", "left_semi")
    return _minimal(found, supersets(met))


def coverage(grouped: DataFrame, strict: DataFrame | None = None) -> DataFrame:
    """group_id, descendants (without itself), covered vectors (with its own) and their share of all."""
    strict = strict if strict is not None else supersets(grouped)
    below = strict.join(grouped.select(F.col("group_id").alias("c"), "group_size"), "c").groupBy("p").agg(F.count("*").alias("d"), F.sum("group_size").alias("s"))
    all_rows = grouped.agg(F.sum("group_size").alias("n"))
    joined = grouped.join(below, F.col("group_id") == F.col("p"), "left").crossJoin(F.broadcast(all_rows))
    covered = F.col("group_size") + F.coalesce("s", F.lit(0))
    return joined.select("group_id", F.coalesce("d", F.lit(0)).alias("descendants"), covered.alias("coverage"), (covered / F.col("n")).alias("coverage_ratio"))


def query_coverage(grouped: DataFrame, queries: DataFrame) -> DataFrame:
    """qid, matched groups and vectors; a query without labels counts nothing."""
    found = super_groups(grouped, queries.where(F.size("qlabels") > 0)).join(grouped.select(F.col("group_id").alias("c"), "group_size"), "c")
    sums = found.groupBy("qid").agg(F.count("*").alias("g"), F.sum("group_size").alias("v"))
    return queries.select("qid").join(sums, "qid", "left").select("qid", F.coalesce("g", F.lit(0)).alias("matched_groups"), F.coalesce("v", F.lit(0)).alias("matched_points"))


def route_stats(grouped: DataFrame, entries: DataFrame) -> DataFrame:
    """For entry groups (qid, c): how many, their distinct descendants, the vectors they cover and the share of all."""
    strict = supersets(grouped)
    down = entries.join(strict.withColumnRenamed("c", "x").withColumnRenamed("p", "c"), "c").select("qid", F.col("x").alias("c")).distinct()
    sizes = grouped.select(F.col("group_id").alias("c"), "group_size")
    covered = entries.select("qid", "c").union(down).distinct().join(sizes, "c").groupBy("qid").agg(F.sum("group_size").alias("matched_points"))
    counts = entries.groupBy("qid").agg(F.count("*").alias("num_entries")).join(down.groupBy("qid").agg(F.count("*").alias("nd")), "qid", "left")
    n = grouped.agg(F.sum("group_size").alias("n"))
    return counts.join(covered, "qid").crossJoin(F.broadcast(n)).select("qid", "num_entries", F.coalesce("nd", F.lit(0)).alias("num_descendants"), "matched_points", (F.col("matched_points") / F.col("n")).alias("total_coverage"))


def cover_frontier(grouped: DataFrame, queries: DataFrame, delta: int = 2, cap: int = 8192) -> DataFrame:
    """(qid, c, kind): containing groups of at most delta more labels (at most cap, by id), and those that none covers."""
    found = super_groups(grouped, queries).join(grouped.select(F.col("group_id").alias("c"), F.size("labels").alias("n")), "c").join(queries.select("qid", F.size("qlabels").alias("qn")), "qid")
    near = found.where(F.col("n") <= F.col("qn") + delta).withColumn("_r", F.row_number().over(Window.partitionBy("qid").orderBy("c"))).where(F.col("_r") <= cap).select("qid", "c")
    covered = near.withColumnRenamed("c", "p").join(supersets(grouped), "p").select("qid", "c").distinct()
    rest = found.select("qid", "c").join(near, ["qid", "c"], "left_anti").join(covered, ["qid", "c"], "left_anti")
    return near.withColumn("kind", F.lit("frontier")).unionByName(rest.withColumn("kind", F.lit("uncovered")))


def hops(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """(qid, c, hop): shortest distance from the entry groups along edges(parent, child), level by level until no group
    is new. Each level is written to the shared folder, so plans stay short whatever the depth."""
    edges = settled(edges.select("parent", "child"), "edges")
    reached = level = settled(entries.select("qid", "c").distinct().withColumn("hop", F.lit(0).cast("long")), "level")
    hop = 0
    while not level.isEmpty():
        hop += 1
        step = level.join(edges, F.col("c") == F.col("parent")).select("qid", F.col("child").alias("c")).distinct()
        level = settled(step.join(reached, ["qid", "c"], "left_anti").withColumn("hop", F.lit(hop).cast("long")), "level")
        reached = reached.unionByName(level)
    return reached


def select_entry_groups(grouped: DataFrame, edges: DataFrame, entries: DataFrame, size_and_distance: bool = True) -> DataFrame:
    """(qid, c): the entries and, best first, a fifth as many of the groups reached from them."""
    n = grouped.agg(F.sum("group_size")).first()[0] or 0
    score = (F.col("hop") * n if size_and_distance else F.lit(0)) + F.col("group_size")
    scored = hops(edges, entries).where("hop > 0").join(grouped.select(F.col("group_id").alias("c"), "group_size"), "c").withColumn("score", score)
    extra = entries.groupBy("qid").agg(F.floor(F.count("*") / 5).alias("k"))
    window = Window.partitionBy("qid").orderBy(F.col("score").desc(), "c")
    best = scored.withColumn("r", F.row_number().over(window)).join(extra, "qid").where("r <= k").select("qid", "c")
    return entries.select("qid", "c").unionByName(best)


# --- the prefix tree of label sets ---------------------------------------------------------------------------------


def prefixes(grouped: DataFrame) -> DataFrame:
    """(group_id, group_size, prefix, depth): every non-empty prefix of each group's labels."""
    lengths = F.when(F.size("labels") > 0, F.sequence(F.lit(1), F.size("labels"))).otherwise(F.array().cast("array<int>"))
    return grouped.select("group_id", "group_size", "labels", F.explode(lengths).alias("depth")).select("group_id", "group_size", F.expr("slice(labels, 1, depth)").alias("prefix"), "depth", (F.col("depth") == F.size("labels")).alias("terminal"))


def trie_nodes(grouped: DataFrame) -> DataFrame:
    """One row for each node but the root: prefix, label, depth, groups and vectors below."""
    return prefixes(grouped).groupBy("prefix", "depth").agg(F.count("*").alias("groups_below"), F.sum("group_size").alias("points_below"), F.max("terminal").alias("terminal")).withColumn("label", F.element_at("prefix", -1))


def trie_metrics(grouped: DataFrame) -> DataFrame:
    """total_nodes with the root, avg_path_length, avg_branching over nodes with children, label_cardinality."""
    nodes = trie_nodes(grouped)
    inner = nodes.select(F.expr("slice(prefix, 1, depth - 1)").alias("parent")).groupBy("parent").count()
    a = nodes.agg((F.count("*") + 1).alias("total_nodes"), (F.max("label") + 1).cast("long").alias("label_cardinality"))
    b = grouped.agg(F.avg(F.size("labels")).alias("avg_path_length"))
    c = inner.agg(F.avg("count").alias("avg_branching"))
    return a.crossJoin(b).crossJoin(c)


def special_blocks(grouped: DataFrame, threshold: int) -> DataFrame:
    """Blocks cut bottom-up where more than threshold vectors below are in no block yet.

    prefix (the block's root), group_id (its own members), points (without nested blocks). One pass for each depth,
    each written to the shared folder.
    """
    deepest = grouped.agg(F.max(F.size("labels"))).first()[0] or 0
    open_ = settled(grouped.select("group_id", "group_size", "labels", F.size("labels").alias("depth")), "open")
    done = grouped.sparkSession.createDataFrame([], "prefix array<int>, group_id long, group_size long, points long")
    for depth in range(deepest, 0, -1):
        here = open_.where(F.col("depth") >= depth).withColumn("prefix", F.expr(f"slice(labels, 1, {depth})"))
        full = here.groupBy("prefix").agg(F.sum("group_size").alias("points")).where(F.col("points") > threshold)
        cut = settled(here.join(full, "prefix").select("prefix", "group_id", "group_size", "points"), "blocks")
        done = done.unionByName(cut)
        open_ = settled(open_.join(cut.select("group_id"), "group_id", "left_anti"), "open")
    return done


def block_tree(blocks: DataFrame) -> DataFrame:
    """(parent, child) prefixes: each block and the nearest block above it."""
    roots = blocks.select("prefix").distinct()
    above = roots.select(F.col("prefix").alias("child"), F.explode(F.sequence(F.lit(0), F.size("prefix") - 1)).alias("n"))
    above = above.select("child", F.expr("slice(child, 1, n)").alias("parent"), "n").join(roots.withColumnRenamed("prefix", "parent"), "parent")
    return above.groupBy("child").agg(F.max(F.struct("n", "parent"))["parent"].alias("parent")).select("parent", "child")
