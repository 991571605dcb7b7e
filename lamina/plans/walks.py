"""Graph searches, with and without label filters, and further indexes: each is held against the exact relation.

An approximate search has no rows to compare one by one. Its query gives the number of queries with an answer, whether
the mean recall of ten reaches LEAST against the exact operator and, for filtered searches, whether every row found
contains its query's labels; the twin states the same row with both true.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import graph as R
from ..operators import groups as G
from ..operators import index as I
from ..operators import kernels as W
from ..operators import predicates as P
from ..operators import quantize as Z
from ..operators import search as S
from ..operators import walk as U
from ..operators.durable import settled
from .graphs import _GS, _MIN, broad, entries, grouped, member
from .registry import register
from .tables import BASE, K, NESTED, QUERIES, STRICT, base, embeddings, l2, queries

LEAST = 0.9


def measured(find, truth, nested: bool | None = None, least: float = LEAST):
    """queries, recall_ok and, with nested given (which base), filter_ok of a search against the exact one."""

    def run(s, d):
        found = settled(find(s, d).select("qid", "vec_id").distinct(), "found")
        each = truth(s, d).select("qid", "vec_id").join(found.withColumn("hit", F.lit(1)), ["qid", "vec_id"], "left").groupBy("qid").agg((F.count("hit") / F.count("*")).alias("recall"))
        out = each.agg(F.count("*").alias("queries"), (F.avg("recall") >= least).alias("recall_ok"))
        if nested is None:
            return out
        labels, asked = base(s, d, nested).select("vec_id", "labels"), queries(s, d).select("qid", "qlabels")
        wrong = found.join(labels, "vec_id").join(asked, "qid").agg(F.coalesce(F.every(P.containment(F.col("labels"), F.col("qlabels"))), F.lit(False)).alias("filter_ok"))
        return out.crossJoin(wrong)

    return run


MET = f"WITH {QUERIES} SELECT count(*) AS queries, true AS recall_ok FROM queries"


def _met(tables: str) -> str:
    return f"WITH {tables}, {QUERIES} SELECT count(*) AS queries, true AS recall_ok, true AS filter_ok FROM queries q WHERE EXISTS (SELECT 1 FROM base b WHERE list_has_all(b.labels, q.qlabels))"


def nearest(s, d):
    return S.knn(base(s, d), queries(s, d), K)


def contained(nested: bool):
    return lambda s, d: S.filtered_knn(base(s, d, nested), queries(s, d), K, "containment")


def whole(s, d):
    """All vectors as one group."""
    return base(s, d).select(F.lit(1).cast("long").alias("group_id"), "vec_id", "embedding", "label", "labels")


# --- unfiltered ------------------------------------------------------------------------------------------------------

for _id, _kind in (("grf11_vamana_search", "vamana"), ("grf28_hnsw_search", "hnsw"), ("grf30_nsg_search", "nsg"), ("grf25_dense_graph_search", "dense"), ("idx06_hnsw", "hnsw"), ("idx08_nsg", "nsg")):
    register(_id, measured(lambda s, d, k=_kind: W.graph_search(whole(s, d), queries(s, d), K, 64, k), nearest), MET)


def _one_walk(s, d):
    """A best-first walk with the graph given as a table: the beam search apart from any build."""
    edges = W.vamana_graphs(whole(s, d).select("group_id", "vec_id", "embedding"), 32)
    return U.fitted_walk(whole(s, d), edges, queries(s, d), K)


register("grf08_beam_search", measured(_one_walk, nearest), MET)

# --- one graph of all groups, entered by minimal supersets -----------------------------------------------------------

CROSS = 6


def _unified(s, d):
    g = settled(grouped(s, d), "groups")
    m = settled(member(s, d), "member")
    tree = settled(G.lng_edges(g), "tree")
    return g, m, tree, U.unified_edges(m, tree, W.group_graphs(m, W.vamana), CROSS)


def _unified_search(s, d):
    g, m, _, edges = _unified(s, d)
    return U.walk(m, edges, queries(s, d), U.entry_points(m, G.min_super_sets(g, queries(s, d))), K)


register("grf12_unified_search", measured(_unified_search, contained(True), True), _met(NESTED))


def _executor(s, d):
    """For each query: entry groups, entry points and rows found; a query that nothing contains has no entry."""
    g, m, _, edges = _unified(s, d)
    entered = settled(G.min_super_sets(g, queries(s, d)), "entered")
    points = settled(U.entry_points(m, entered), "points")
    found = U.walk(m, edges, queries(s, d), points, K).groupBy("qid").agg(F.count("*").alias("found"))
    out = queries(s, d).select("qid")
    for part in (entered.groupBy("qid").agg(F.count("*").alias("entry_groups")), points.groupBy("qid").agg(F.count("*").alias("entry_points")), found):
        out = out.join(part, "qid", "left")
    return out.select("qid", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("entry_groups", "entry_points", "found")])


register(
    "grf13_query_executor",
    _executor,
    f"{_GS}, {QUERIES}, cand AS (SELECT qid, group_id AS c FROM queries q JOIN groups g ON list_has_all(g.labels, q.qlabels)), entries AS (SELECT qid, c FROM cand x WHERE NOT EXISTS (SELECT 1 FROM cand y JOIN strict s ON y.c = s.p WHERE y.qid = x.qid AND s.c = x.c))"
    f" SELECT q.qid, (SELECT count(*) FROM entries e WHERE e.qid = q.qid) AS entry_groups, coalesce((SELECT sum(least(group_size, 16)) FROM entries e JOIN groups ON group_id = c WHERE e.qid = q.qid), 0)::BIGINT AS entry_points, least({K}, (SELECT count(*) FROM base b WHERE list_has_all(b.labels, q.qlabels))) AS found FROM queries q",
)

# --- built graphs ----------------------------------------------------------------------------------------------------


def facts(make, degree: int, connected: bool = False):
    """Of a graph over all vectors: how many have edges, and whether no edge is a loop, leads nowhere or comes twice, no
    vector has more edges than allowed and, if asked, all are joined up."""

    def run(s, d):
        edges = settled(make(s, d).select("src", "dst"), "edges")
        ids = embeddings(s, d).select(F.col("vec_id").alias("dst"))
        each = edges.groupBy("src").agg(F.count("*").alias("n"), F.count_distinct("dst").alias("m"), F.max(F.col("src") == F.col("dst")).alias("loop"))
        out = each.agg(F.count("*").alias("vectors"), F.every((F.col("n") == F.col("m")) & (F.col("n") <= degree) & ~F.col("loop")).alias("edges_ok"))
        out = out.crossJoin(edges.join(ids, "dst", "left_anti").agg((F.count("*") == 0).alias("ends_ok")))
        return out.crossJoin(R.weak_components(edges).agg((F.count_distinct("component") == 1).alias("joined_ok"))) if connected else out

    return run


def _facts_sql(connected: bool = False, where: str = "") -> str:
    return f"SELECT count(*) AS vectors, true AS edges_ok, true AS ends_ok{', true AS joined_ok' if connected else ''} FROM embeddings{where}"


def _built(build):
    return lambda s, d: W.group_graphs(whole(s, d).select("group_id", "vec_id", "embedding"), build)


for _id in ("grf07_vamana_build", "grf10_reverse_edges"):
    register(_id, facts(lambda s, d: W.vamana_graphs(whole(s, d).select("group_id", "vec_id", "embedding"), 16), 16, True), _facts_sql(True))
for _id in ("grf23_compressed_graph", "grf24_dense_insertion"):
    register(_id, facts(_built(W.dense_graph), 32), _facts_sql())
register("grf09_robust_prune", facts(lambda s, d: W.pruned_graphs(whole(s, d).select("group_id", "vec_id", "embedding"), 16), 16, True), _facts_sql(True))
register("grf29_diversity_prune", facts(_built(lambda x: [W.robust_prune(x, i, near, 8, 1.0) for i, near in enumerate(W._nearest(x, 32))]), 8), _facts_sql())
register("grf03_group_graphs", facts(lambda s, d: W.group_graphs(member(s, d), W.vamana), 16), f"WITH {NESTED}, sized AS (SELECT vec_id, count(*) OVER (PARTITION BY labels) AS n FROM base) SELECT count(*) AS vectors, true AS edges_ok, true AS ends_ok FROM sized WHERE n > 1")


def _descended(s, d):
    """The share of exact nearest neighbours among the links of the approximate graph."""
    found = W.knn_graph(whole(s, d).select("group_id", "vec_id", "embedding"), K)
    exact = S.nearest_others(embeddings(s, d), embeddings(s, d).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec")), K).select("src", "dst")
    return exact.join(found.withColumn("hit", F.lit(1)), ["src", "dst"], "left").agg(F.count("*").alias("links"), (F.count("hit") >= LEAST * F.count("*")).alias("recall_ok"))


for _id in ("grf31_nn_descent", "idx09_nn_descent"):
    register(_id, _descended, f"SELECT count(*) * {K} AS links, true AS recall_ok FROM embeddings")

# --- special blocks --------------------------------------------------------------------------------------------------

T = 20


def blocks_sql(threshold: int) -> str:
    """Special blocks over groups of at most three labels, as WITH clauses that end in blocks(prefix, group_id, group_size, points)."""
    out, before = [], "groups"
    for n in (3, 2, 1):
        out.append(f"f{n} AS (SELECT labels[1:{n}] AS prefix, sum(group_size)::BIGINT AS points FROM {before} WHERE len(labels) >= {n} GROUP BY 1 HAVING sum(group_size) > {threshold})")
        out.append(f"c{n} AS (SELECT prefix, group_id, group_size, points FROM {before} JOIN f{n} ON len(labels) >= {n} AND labels[1:{n}] = prefix)")
        out.append(f"o{n} AS (SELECT * FROM {before} WHERE group_id NOT IN (SELECT group_id FROM c{n}))")
        before = f"o{n}"
    return ", ".join(out) + ", blocks AS (SELECT * FROM c3 UNION ALL SELECT * FROM c2 UNION ALL SELECT * FROM c1)"


def special(s, d, threshold=T):
    return G.special_blocks(grouped(s, d), threshold)


_B = f"{_GS}, {blocks_sql(T)}"
register("agg16_special_blocks", special, f"{_B} SELECT prefix, group_id, group_size, points FROM blocks")
register("agg17_block_summary", lambda s, d: special(s, d).groupBy("prefix").agg(F.count("*").alias("groups"), F.max("points").alias("points"), F.max("group_size").alias("largest")), f"{_B} SELECT prefix, count(*) AS groups, max(points) AS points, max(group_size) AS largest FROM blocks GROUP BY prefix")
register(
    "flt27_query_covers_block",
    lambda s, d: special(s, d).select("prefix").distinct().join(S.few(broad(s, d).withColumnRenamed("qlabels", "ql")), P.containment(F.col("prefix"), F.col("ql"))).select("qid", "prefix"),
    f"{_B}, {QUERIES} SELECT qid, prefix FROM queries JOIN (SELECT DISTINCT prefix FROM blocks) ON list_has_all(prefix, qlabels[1:1])",
)


def _swept(s, d, thresholds):
    out = None
    for t in thresholds:
        part = special(s, d, t).agg(F.count_distinct("prefix").alias("blocks"), F.coalesce(F.sum("group_size"), F.lit(0)).alias("points")).withColumn("threshold", F.lit(t))
        out = part if out is None else out.unionByName(part)
    return out


for _id, _t in (("gen11_threshold_sweep", (5, 20, 60)), ("agg55_sweep_summary", (10, 40))):
    _parts = " UNION ALL ".join(f"(WITH {blocks_sql(t)} SELECT count(DISTINCT prefix) AS blocks, coalesce(sum(group_size), 0)::BIGINT AS points, {t} AS threshold FROM blocks)" for t in _t)
    register(_id, lambda s, d, t=_t: _swept(s, d, t), f"{_GS} SELECT * FROM ({_parts})")


def _block_stats(s, d):
    found = G.super_groups(grouped(s, d), broad(s, d)).join(grouped(s, d).select(F.col("group_id").alias("c"), "group_size"), "c").join(special(s, d).select(F.col("group_id").alias("c"), "prefix"), "c", "left")
    inside = F.when(F.col("prefix").isNotNull(), F.col("group_size")).otherwise(0)
    return found.groupBy("qid").agg(F.count_distinct("prefix").alias("blocks"), F.sum(inside).alias("covered_points"), F.sum("group_size").alias("points"), F.round(F.sum(inside) / F.sum("group_size"), 6).alias("ratio"))


register(
    "agg15_block_query_stats",
    _block_stats,
    f"{_B}, {QUERIES}, met AS (SELECT qid, g.group_size, prefix FROM queries q JOIN groups g ON list_has_all(g.labels, q.qlabels[1:1]) LEFT JOIN blocks b ON b.group_id = g.group_id)"
    " SELECT qid, count(DISTINCT prefix) AS blocks, sum(CASE WHEN prefix IS NULL THEN 0 ELSE group_size END)::BIGINT AS covered_points, sum(group_size)::BIGINT AS points, round(sum(CASE WHEN prefix IS NULL THEN 0 ELSE group_size END) / sum(group_size), 6) AS ratio FROM met GROUP BY qid",
)


def _special_edges(s, d):
    blocks = settled(special(s, d), "special")
    return blocks, R.special_edges(member(s, d), blocks, G.block_tree(blocks), 5, 3)


register(
    "grf17_special_edges",
    lambda s, d: _special_edges(s, d)[1],
    f"{_B}, m AS (SELECT vec_id, embedding, prefix FROM base JOIN groups USING (labels) JOIN blocks USING (group_id)), roots AS (SELECT DISTINCT prefix FROM blocks),"
    " tree AS (SELECT c.prefix AS child, arg_max(p.prefix, len(p.prefix)) AS parent FROM roots c JOIN roots p ON len(p.prefix) < len(c.prefix) AND c.prefix[1:len(p.prefix)] = p.prefix GROUP BY c.prefix),"
    f" own AS (SELECT x.vec_id AS src, y.vec_id AS dst FROM m x JOIN m y USING (prefix) WHERE x.vec_id <> y.vec_id QUALIFY row_number() OVER (PARTITION BY x.vec_id ORDER BY {l2('x.embedding', 'y.embedding')}, y.vec_id) <= 5),"
    f" down AS (SELECT x.vec_id AS src, y.vec_id AS dst FROM m x JOIN tree ON parent = x.prefix JOIN m y ON y.prefix = child QUALIFY row_number() OVER (PARTITION BY x.vec_id, child ORDER BY {l2('x.embedding', 'y.embedding')}, y.vec_id) <= 3)"
    " SELECT src, dst FROM own UNION SELECT src, dst FROM down",
)


def _free_search(s, d):
    g, m, _, edges = _unified(s, d)
    blocks, extra = _special_edges(s, d)
    roots = blocks.join(g.select("group_id", "labels"), "group_id").where(F.col("labels") == F.col("prefix")).select("group_id", "prefix")
    return U.walk(m, edges, queries(s, d), U.entry_points(m, G.min_super_sets(g, queries(s, d))), K, blocks=roots, special=extra)


register("grf16_free_state_search", measured(_free_search, contained(True), True), _met(NESTED))

# --- filtered walks over a graph that knows no filter ----------------------------------------------------------------


def _filtered(kind="dense", width=64, keep=W.by_labels, also=("labels",), fit=True):
    return lambda s, d: W.graph_search(whole(s, d), queries(s, d), K, width, kind, keep, also, fit)


def _by_map(s, d):
    """The filter as a table of (query, row), made beforehand."""
    allowed = P.relational_division(base(s, d), queries(s, d)).groupBy("vec_id").agg(F.collect_list("qid").alias("allowed"))
    rows = whole(s, d).join(allowed, "vec_id", "left").withColumn("allowed", F.coalesce("allowed", F.array().cast("array<bigint>")))
    return W.graph_search(rows, queries(s, d), K, 64, "dense", W.by_map, ("allowed",))


_F = _met(BASE)
register("grf20_filtered_graph_search", measured(_filtered(), contained(False), False), _F)
register("grf21_base_level_walk", measured(_filtered("base"), contained(False), False), _F)
register("grf26_filter_map_search", measured(_by_map, contained(False), False), _F)
register("grf27_filter_in_search", measured(_filtered("dense", 96), contained(False), False), _F)
register("idx05_filter_graph", measured(_filtered("hnsw"), contained(False), False), _F)


def _executed(s, d):
    """Walks at the widths that the schedule gives for several search widths, with their recall."""
    exact = settled(contained(False)(s, d).select("qid", "vec_id"), "exact")
    out = None
    for wide in (20, 60, 100, 200):
        found = _filtered("dense", W.efs(wide), fit=False)(s, d).select("qid", "vec_id").withColumn("hit", F.lit(1))
        part = exact.join(found, ["qid", "vec_id"], "left").agg((F.count("hit") / F.count("*") >= LEAST).alias("recall_ok")).select(F.lit(wide).alias("lsearch"), F.lit(W.efs(wide)).alias("efs"), "recall_ok")
        out = part if out is None else out.unionByName(part)
    return out


register("grf19_filter_graph_executor", _executed, "SELECT * FROM (VALUES (20, 50, true), (60, 90, true), (100, 130, true), (200, 630, true)) t(lsearch, efs, recall_ok)")


def _hybrid(s, d):
    """A layered graph under a predicate on metadata: equality, a common bit, or a pattern."""

    def keeps(op):
        tests = {"EQUAL": lambda x: x == 3, "OR": lambda x: ((1 << (x % 8)) & 6) != 0, "REGEX": lambda x: np.isin(x, [1, 4])}

        def keep(table):
            mask = tests[op](table["label"].to_numpy())
            return lambda qid, asked: mask

        return keep

    columns = {"EQUAL": P.metadata("EQUAL", F.col("label"), 3), "OR": P.metadata("OR", F.call_function("shiftleft", F.lit(1), F.col("label") % 8), 6), "REGEX": P.metadata("REGEX", F.concat(F.lit("L"), F.col("label")), "^L[14]$")}
    out = None
    for op, where in columns.items():
        truth = S.knn(base(s, d), queries(s, d), K, where=where).select("qid", "vec_id")
        found = W.graph_search(whole(s, d), queries(s, d), K, 64, "hnsw", keeps(op), ("label",)).select("qid", "vec_id").withColumn("hit", F.lit(1))
        part = truth.join(found, ["qid", "vec_id"], "full").agg((F.count("hit") >= LEAST * F.count("*")).alias("recall_ok")).withColumn("operation", F.lit(op))
        out = part if out is None else out.unionByName(part)
    return out


register("idx07_hybrid_graph", _hybrid, "SELECT * FROM (VALUES ('EQUAL', true), ('OR', true), ('REGEX', true)) t(operation, recall_ok)")


def _descent(s, d):
    """Every query descends in every block, with the filter and without; without, it ends no farther off than it began."""
    return W.descents(whole(s, d), queries(s, d), W.by_labels, ("labels",)).agg(F.count_distinct("qid").alias("queries"), F.coalesce(F.every(F.col("free") <= F.col("begin")), F.lit(False)).alias("ends"))


register("grf22_upper_level_descent", _descent, f"WITH {QUERIES} SELECT count(*) AS queries, true AS ends FROM queries")

# --- codes -----------------------------------------------------------------------------------------------------------


def _tuned(rows, s, d):
    """Search of decoded rows with a shortlist measured on the table; vectors decide within it."""
    index = I.Index("Flat,RFlat")
    index.rows, index.raw = rows, embeddings(s, d).select("vec_id", "embedding")
    return index.search(queries(s, d), K, *index.tuned(K))


def _two_layer(s, d):
    x = Z.sample(embeddings(s, d))
    model = Z.TwoLayer.fit(x, 16, 8, 16)
    return _tuned(settled(Z.decoded(Z.coded(embeddings(s, d), model), model), "decoded"), s, d)


register("idx23_two_layer", measured(_two_layer, nearest), MET)


def _multi_index(s, d, lists: int = 8, share: float = 0.98):
    """Cells are pairs of codes; a query reads its nearest cells, as many as the rows' own neighbours need."""
    model = Z.ProductQuantizer.fit(Z.sample(embeddings(s, d)), 2, lists)
    rows = Z.coded(embeddings(s, d), model).join(embeddings(s, d).select("vec_id", "embedding"), "vec_id")
    rows = settled(rows.select("vec_id", "embedding", (F.col("codes")[0] * lists + F.col("codes")[1]).cast("int").alias("list_no")), "cells")

    def ranks(q: np.ndarray) -> list[np.ndarray]:
        tables = model.tables(q)
        return [W.adc_sums(np.stack([t[i] for t in tables]), lists * lists)[0] @ np.array([lists, 1]) for i in range(len(q))]

    drawn = embeddings(s, d).orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id").limit(I.TRIALS).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    near = S.knn(embeddings(s, d), drawn, K + 1).where("vec_id <> qid").join(rows.select("vec_id", "list_no"), "vec_id").join(drawn, "qid").select("qvec", "list_no").collect()  # TRIALS * K rows
    needed = np.sort([int(np.flatnonzero(order == r["list_no"])[0]) for r, order in zip(near, ranks(np.array([r["qvec"] for r in near])))]) + 1
    nprobe = int(needed[int(np.ceil(share * len(needed))) - 1])
    asked = queries(s, d).select("qid", "qvec").collect()  # the stated query set
    probe = [(r["qid"], [float(v) for v in r["qvec"]], int(c), i) for r, order in zip(asked, ranks(np.array([r["qvec"] for r in asked]))) for i, c in enumerate(order[:nprobe])]
    return S.ranked(I.probed(rows, s.createDataFrame(probe, "qid long, qvec array<double>, list_no int, place int")), K)


register("idx20_multi_index", measured(_multi_index, nearest), MET)


def _pq(s, d):
    model = Z.ProductQuantizer.fit(Z.sample(embeddings(s, d)), 16, 16)
    return model, Z.coded(embeddings(s, d), model)


def _tables(s, d):
    """Distances by tables equal those to the decoded vectors."""
    model, codes = _pq(s, d)
    by_table = Z.adc_pairs(codes, queries(s, d), model, 10**9)
    plain = S.pairs(Z.decoded(codes, model), queries(s, d)).select("qid", "vec_id", F.col("dist").alias("plain"))
    return by_table.join(plain, ["qid", "vec_id"]).select("qid", "vec_id", (F.round(F.abs(F.col("dist") - F.col("plain")), 6) + 0.0).alias("error"))


register("qnt27_pq_tables", _tables, f"WITH {BASE}, {QUERIES} SELECT qid, vec_id, 0.0::DOUBLE AS error FROM queries, base")


def _code_search(s, d):
    """The ten nearest by codes alone are the ten nearest decoded vectors, whatever these miss of the true ones."""
    model, codes = _pq(s, d)
    by_codes = S.ranked(Z.adc_pairs(codes, queries(s, d), model, K), K).select("qid", "rk", F.round("dist", 6).alias("dist"))
    plain = S.knn(Z.decoded(codes, model), queries(s, d), K).select("qid", "rk", F.round("dist", 6).alias("plain"))
    return by_codes.join(plain, ["qid", "rk"], "full").groupBy("qid").agg(F.every(F.abs(F.col("dist") - F.col("plain")) < 1e-5).alias("same"), F.count("*").alias("n"))


register("qnt28_pq_search", _code_search, f"WITH {QUERIES} SELECT qid, true AS same, {K}::BIGINT AS n FROM queries")

# --- routes ----------------------------------------------------------------------------------------------------------

register(
    "rte05_route_features",
    lambda s, d: G.route_stats(grouped(s, d), entries(s, d)).select("qid", F.round(F.col("total_coverage") * F.col("total_coverage"), 8).alias("f1"), F.round(F.col("num_descendants") * F.col("total_coverage"), 8).alias("f2"), F.round(F.log1p("num_descendants"), 8).alias("f3"), (F.col("num_entries") * F.col("num_descendants")).alias("f4")),
    f"{_MIN}, down AS (SELECT DISTINCT qid, s.c FROM entries e JOIN strict s ON s.p = e.c), every AS (SELECT qid, c FROM entries UNION SELECT qid, c FROM down),"
    " st AS (SELECT qid, (SELECT count(*) FROM entries e WHERE e.qid = x.qid) AS e, (SELECT count(*) FROM down e WHERE e.qid = x.qid) AS n, sum(group_size) / (SELECT count(*) FROM base) AS cov FROM every x JOIN groups ON group_id = c GROUP BY qid)"
    " SELECT qid, round(cov * cov, 8) AS f1, round(n * cov, 8) AS f2, round(ln(1 + n), 8) AS f3, e * n AS f4 FROM st",
)
_ = (STRICT,)
