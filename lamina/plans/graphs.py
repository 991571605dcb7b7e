"""Groups, containment graph, entry groups, edges and routes (AGG01-18, JON19-30, GRF, RTE, TOP18)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as R
from ..operators import groups as G
from .registry import register
from .tables import BASE, EDGES, GROUPS, NESTED, QUERIES, STRICT, base, l2, queries

C = 4
_GS = f"WITH {NESTED}, {GROUPS}, {STRICT}"


def grouped(s, d):
    return G.groups(base(s, d, True))


def member(s, d):
    return G.members(base(s, d, True), grouped(s, d)).select("vec_id", "embedding", "group_id")


register("agg01_groups", lambda s, d: grouped(s, d), f"WITH {NESTED}, {GROUPS} SELECT * FROM groups")
register("agg01_group_members", lambda s, d: G.members(base(s, d, True), grouped(s, d)).groupBy("group_id").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), f"WITH {NESTED}, {GROUPS} SELECT group_id, list(vec_id ORDER BY vec_id) AS ids FROM base JOIN groups USING (labels) GROUP BY group_id")
register("agg02_trie_insert", lambda s, d: G.groups(base(s, d)).select("labels", "group_size"), f"WITH {BASE} SELECT labels, count(*) AS group_size FROM base GROUP BY labels")
_NODES = "nodes AS (SELECT labels[1:n] AS prefix, n, count(*) AS groups_below, sum(group_size)::BIGINT AS points_below FROM groups, range(1, 4) r(n) WHERE n <= len(labels) GROUP BY ALL)"
register(
    "agg03_trie_metrics",
    lambda s, d: G.trie_metrics(grouped(s, d)).select("total_nodes", "label_cardinality", F.round("avg_path_length", 6).alias("avg_path_length"), F.round("avg_branching", 6).alias("avg_branching")),
    f"WITH {NESTED}, {GROUPS}, {_NODES} SELECT (SELECT count(*) + 1 FROM nodes) AS total_nodes, (SELECT max(prefix[n]) + 1 FROM nodes)::BIGINT AS label_cardinality,"
    " (SELECT round(avg(len(labels)), 6) FROM groups) AS avg_path_length, (SELECT round(avg(k), 6) FROM (SELECT count(*) AS k FROM nodes GROUP BY prefix[1:n-1])) AS avg_branching",
)
register("agg03_label_frequency", lambda s, d: G.trie_nodes(grouped(s, d)).groupBy("label").agg(F.count("*").alias("nodes")), f"WITH {NESTED}, {GROUPS}, {_NODES} SELECT prefix[n] AS label, count(*) AS nodes FROM nodes GROUP BY ALL")
register(
    "agg04_candidate_count",
    lambda s, d: queries(s, d).select("qid", F.element_at("qlabels", -1).alias("label")).join(G.trie_nodes(grouped(s, d)), "label", "left").groupBy("qid").agg(F.count("prefix").alias("candidates")),
    f"WITH {NESTED}, {GROUPS}, {_NODES}, {QUERIES} SELECT qid, count(prefix) AS candidates FROM queries LEFT JOIN nodes ON prefix[n] = qlabels[-1] GROUP BY qid",
)
register("agg06_descendants", lambda s, d: G.supersets(grouped(s, d)), f"{_GS} SELECT p, c FROM strict")
register(
    "agg07_descendant_counts",
    lambda s, d: G.coverage(grouped(s, d)).select("group_id", "descendants"),
    f"{_GS} SELECT group_id, (SELECT count(*) FROM strict WHERE p = group_id) AS descendants FROM groups",
)
register(
    "agg08_coverage",
    lambda s, d: G.coverage(grouped(s, d)).select("group_id", "coverage", F.round("coverage_ratio", 8).alias("coverage_ratio")),
    f"{_GS}, cov AS (SELECT g.group_id, (g.group_size + coalesce(sum(x.group_size), 0))::BIGINT AS coverage FROM groups g LEFT JOIN strict s ON s.p = g.group_id LEFT JOIN groups x ON x.group_id = s.c GROUP BY g.group_id, g.group_size)"
    " SELECT group_id, coverage, round(coverage / (SELECT count(*) FROM base), 8) AS coverage_ratio FROM cov",
)
_QC = f"WITH {NESTED}, {GROUPS}, {QUERIES} SELECT qid, count(group_id) AS matched_groups, coalesce(sum(group_size), 0)::BIGINT AS matched_points FROM queries q LEFT JOIN groups g ON list_has_all(g.labels, q.qlabels) GROUP BY qid"
for _id in ("agg10_query_coverage", "gen06_analyze_queries"):
    register(_id, lambda s, d: G.query_coverage(grouped(s, d), queries(s, d)), _QC)
register("agg11_superset_counts", lambda s, d: G.supersets(grouped(s, d)).groupBy("p").agg(F.count("*").alias("n")), f"{_GS} SELECT p, count(*) AS n FROM strict GROUP BY p")
register("agg12_subtree_sums", lambda s, d: G.trie_nodes(grouped(s, d)).select("prefix", "groups_below", "points_below"), f"WITH {NESTED}, {GROUPS}, {_NODES} SELECT prefix, groups_below, points_below FROM nodes")
register("agg13_k_answers", lambda s, d: G.query_coverage(grouped(s, d), queries(s, d)).where("matched_points >= 8").select("qid"), f"SELECT qid FROM ({_QC}) WHERE matched_points >= 8")
_MIN = (
    f"{_GS}, {QUERIES}, cand AS (SELECT qid, group_id AS c FROM queries q JOIN groups g ON list_has_all(g.labels, q.qlabels[1:1])),"
    " entries AS (SELECT qid, c FROM cand x WHERE NOT EXISTS (SELECT 1 FROM cand y JOIN strict s ON y.c = s.p WHERE y.qid = x.qid AND s.c = x.c))"
)


def broad(s, d):
    return queries(s, d).select("qid", F.slice("qlabels", 1, 1).alias("qlabels"))


def entries(s, d):
    return G.min_super_sets(grouped(s, d), broad(s, d))


register(
    "agg14_route_stats",
    lambda s, d: G.route_stats(grouped(s, d), entries(s, d)).withColumn("total_coverage", F.round("total_coverage", 8)),
    f"{_MIN}, down AS (SELECT DISTINCT qid, s.c FROM entries e JOIN strict s ON s.p = e.c), every AS (SELECT qid, c FROM entries UNION SELECT qid, c FROM down)"
    " SELECT qid, (SELECT count(*) FROM entries e WHERE e.qid = x.qid) AS num_entries, (SELECT count(*) FROM down e WHERE e.qid = x.qid) AS num_descendants, sum(group_size)::BIGINT AS matched_points,"
    " round(sum(group_size) / (SELECT count(*) FROM base), 8) AS total_coverage FROM every x JOIN groups ON group_id = c GROUP BY qid",
)
register(
    "agg18_medoids",
    lambda s, d: _medoids(s, d),
    f"WITH {NESTED}, {GROUPS}, m AS (SELECT group_id, vec_id, embedding FROM base JOIN groups USING (labels)), c AS (SELECT group_id, list(x ORDER BY i) AS centre FROM (SELECT group_id, i, avg(embedding[i]::DOUBLE) AS x FROM m, range(1, 65) t(i) GROUP BY group_id, i) GROUP BY group_id)"
    f" SELECT group_id, vec_id AS medoid FROM m JOIN c USING (group_id) QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY round({l2('embedding', 'centre')}, 9), vec_id) = 1",
)


def _medoids(s, d):
    from ..functions.vector import l2 as dist

    m = member(s, d)
    each = m.select("group_id", F.posexplode("embedding").alias("i", "x")).groupBy("group_id", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    centre = each.groupBy("group_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda t: t["m"]).alias("centre"))
    return m.join(centre, "group_id").groupBy("group_id").agg(F.min(F.struct(F.round(dist(F.col("embedding"), F.col("centre")), 9).alias("dist"), "vec_id")).alias("b")).select("group_id", F.col("b.vec_id").alias("medoid"))


_MS = f"{_MIN} SELECT qid, c FROM entries"
for _id in ("jon19_min_super_sets", "jon20_min_super_sets_sort", "jon21_min_super_sets_buckets", "rte08_entry_groups_minimal", "grf15_entry_groups"):
    register(_id, entries, _MS)
register(
    "jon22_min_super_set_counts",
    lambda s, d: entries(s, d).groupBy("qid").agg(F.count("*").alias("entrances")),
    f"{_MIN} SELECT qid, count(*) AS entrances FROM entries GROUP BY qid",
)
for _id in ("jon23_containment_graph", "grf35_containment_graph_variants"):
    register(_id, lambda s, d: G.lng_edges(grouped(s, d)), f"{_GS}, {EDGES} SELECT parent, child FROM edges")

_CROSS = (
    f"{_GS}, {EDGES}, m AS (SELECT group_id, vec_id, embedding FROM base JOIN groups USING (labels)), met AS (SELECT x.vec_id AS src, y.vec_id AS dst, parent, child, {l2('x.embedding', 'y.embedding')} AS dist"
    f" FROM edges JOIN m x ON x.group_id = parent JOIN m y ON y.group_id = child), kept AS (SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY src ORDER BY dist, dst) <= {C})"
)


def _cross(s, d):
    return R.cross_edges(member(s, d), G.lng_edges(grouped(s, d)), C)


for _id in ("jon24_cross_edges", "jon26_cross_edges_exact_scan"):
    register(_id, lambda s, d: _cross(s, d).select("src", "dst", F.round("dist", 6).alias("dist")), f"{_CROSS} SELECT src, dst, round(dist, 6) AS dist FROM kept")
register(
    "jon25_cross_edges_to_listed",
    lambda s, d: R.cross_edges(member(s, d), G.lng_edges(grouped(s, d)).where("child % 2 = 0"), C).select("src", "dst"),
    f"{_CROSS.replace('ON y.group_id = child)', 'ON y.group_id = child WHERE child % 2 = 0)')} SELECT src, dst FROM kept",
)
_GUAR = (
    f"{_CROSS}, missing AS (SELECT parent, child FROM edges EXCEPT SELECT parent, child FROM kept), f AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY vec_id) AS place FROM m),"
    f" g AS (SELECT src, dst, parent, child, dist FROM met JOIN missing USING (parent, child) JOIN f ON f.vec_id = src WHERE (place - 1) * least({C // 2}, (SELECT count(*) FROM m z WHERE z.group_id = child)) < {C}),"
    f" more AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY src, child ORDER BY dist, dst) <= {C // 2})"
)


def _guaranteed(s, d):
    return R.guarantee_edges(member(s, d), G.lng_edges(grouped(s, d)), _cross(s, d), C)


for _id in ("jon29_guarantee_edges", "grf37_guarantee_edges_merged"):
    register(_id, lambda s, d: _guaranteed(s, d).select("src", "dst"), f"{_GUAR} SELECT src, dst FROM more")
for _id in ("jon30_cross_edge_pipeline", "grf36_cross_edges_merged"):
    register(_id, lambda s, d: _cross(s, d).select("src", "dst").unionByName(_guaranteed(s, d).select("src", "dst")).distinct(), f"{_GUAR} SELECT src, dst FROM kept UNION SELECT src, dst FROM more")

register("grf02_reorder", lambda s, d: G.reordered(base(s, d, True), grouped(s, d)), f"WITH {NESTED}, {GROUPS} SELECT vec_id, group_id, row_number() OVER (ORDER BY group_id, vec_id) - 1 AS new_id FROM base JOIN groups USING (labels)")
register(
    "grf02_group_ranges",
    lambda s, d: G.reordered(base(s, d, True), grouped(s, d)).groupBy("group_id").agg(F.min("new_id").alias("first"), F.max("new_id").alias("last")),
    f"WITH {NESTED}, {GROUPS}, r AS (SELECT group_id, row_number() OVER (ORDER BY group_id, vec_id) - 1 AS new_id FROM base JOIN groups USING (labels)) SELECT group_id, min(new_id) AS first, max(new_id) AS last FROM r GROUP BY group_id",
)
_M = f"WITH {NESTED}, {GROUPS}, m AS (SELECT group_id, vec_id, embedding FROM base JOIN groups USING (labels)), sized AS (SELECT *, count(*) OVER (PARTITION BY group_id) AS n, row_number() OVER (PARTITION BY group_id ORDER BY vec_id) - 1 AS i FROM m)"
register("grf04_complete_groups", lambda s, d: R.complete_edges(member(s, d), 8), f"{_M} SELECT x.vec_id AS src, y.vec_id AS dst FROM sized x JOIN sized y USING (group_id) WHERE x.n <= 8 AND x.vec_id <> y.vec_id")
register("grf05_ring", lambda s, d: R.ring_edges(member(s, d), 3), f"{_M} SELECT x.vec_id AS src, y.vec_id AS dst FROM sized x, range(1, 4) t(k), sized y WHERE y.group_id = x.group_id AND k <= x.n - 1 AND y.i = (x.i + k) % x.n")
register("grf06_nearest_in_group", lambda s, d: R.nearest_edges(member(s, d), 5), f"{_M} SELECT x.vec_id AS src, y.vec_id AS dst FROM m x JOIN m y USING (group_id) WHERE x.vec_id <> y.vec_id QUALIFY row_number() OVER (PARTITION BY x.vec_id ORDER BY {l2('x.embedding', 'y.embedding')}, y.vec_id) <= 5")
register(
    "grf14_entry_points",
    lambda s, d: _entry_points(s, d),
    f"{_M} SELECT group_id, vec_id FROM sized WHERE i < 3",
)


def _entry_points(s, d):
    return G.reordered(base(s, d, True), grouped(s, d)).join(G.reordered(base(s, d, True), grouped(s, d)).groupBy("group_id").agg(F.min("new_id").alias("first")), "group_id").where("new_id - first < 3").select("group_id", "vec_id")


_RING = f"{_M}, e AS (SELECT x.vec_id AS src, y.vec_id AS dst FROM sized x, range(1, 4) t(k), sized y WHERE y.group_id = x.group_id AND k <= x.n - 1 AND y.i = (x.i + k) % x.n)"
register("grf18_adjacency", lambda s, d: R.adjacency(R.ring_edges(member(s, d), 3)), f"{_RING} SELECT src, list(DISTINCT dst ORDER BY dst) AS neighbours FROM e GROUP BY src")
register("grf33_graph_difference", lambda s, d: R.graph_difference(R.ring_edges(member(s, d), 3), R.ring_edges(member(s, d), 2)), f"{_RING}, e2 AS (SELECT x.vec_id AS src, y.vec_id AS dst FROM sized x, range(1, 3) t(k), sized y WHERE y.group_id = x.group_id AND k <= x.n - 1 AND y.i = (x.i + k) % x.n) SELECT *, 'a' AS only FROM (SELECT * FROM e EXCEPT ALL SELECT * FROM e2) UNION ALL SELECT *, 'b' FROM (SELECT * FROM e2 EXCEPT ALL SELECT * FROM e)")
register("grf34_bipartite_graph", lambda s, d: base(s, d, True).select(F.explode("labels").alias("label"), "vec_id"), f"WITH {NESTED} SELECT unnest(labels) AS label, vec_id FROM base")
register("grf38_local_to_global", lambda s, d: G.reordered(base(s, d, True), grouped(s, d)).select("new_id", "vec_id"), f"WITH {NESTED}, {GROUPS} SELECT row_number() OVER (ORDER BY group_id, vec_id) - 1 AS new_id, vec_id FROM base JOIN groups USING (labels)")

_STATS = "SELECT sum(n)::BIGINT AS edges, count(*) AS sources, min(n) AS least, max(n) AS most, round(avg(n), 6) AS mean FROM (SELECT src, count(*) AS n FROM e GROUP BY src)"
for _id in ("agg42_degree_stats", "agg51_graph_stats", "agg54_neighbour_stats"):
    register(_id, lambda s, d: R.degree_stats(R.ring_edges(member(s, d), 3)), f"{_RING} {_STATS}")
register("agg42_reciprocity", lambda s, d: R.reciprocity(R.ring_edges(member(s, d), 3)), f"{_RING} SELECT count(*) FILTER (EXISTS (SELECT 1 FROM e b WHERE b.src = e.dst AND b.dst = e.src)) AS mutual, count(*) AS edges FROM e")
register("agg42_weak_components", lambda s, d: R.weak_components(R.ring_edges(member(s, d), 3)).groupBy("component").agg(F.count("*").alias("n")), f"{_M} SELECT min(vec_id) AS component, count(*) AS n FROM sized WHERE n > 1 GROUP BY group_id")
register(
    "agg42_intra_cross_ratio",
    lambda s, d: _intra(s, d),
    f"{_CROSS}, e AS (SELECT src, dst FROM kept UNION ALL SELECT x.vec_id, y.vec_id FROM m x JOIN m y USING (group_id) WHERE x.vec_id <> y.vec_id), t AS (SELECT x.group_id = y.group_id AS same FROM e JOIN m x ON x.vec_id = src JOIN m y ON y.vec_id = dst) SELECT count_if(same)::BIGINT AS intra, count_if(NOT same)::BIGINT AS cross_group FROM t",
)


def _intra(s, d):
    m = member(s, d)
    e = _cross(s, d).select("src", "dst").unionAll(R.complete_edges(m, 1_000_000))
    t = e.join(m.select(F.col("vec_id").alias("src"), F.col("group_id").alias("a")), "src").join(m.select(F.col("vec_id").alias("dst"), F.col("group_id").alias("b")), "dst")
    return t.agg(F.count_if(F.col("a") == F.col("b")).alias("intra"), F.count_if(F.col("a") != F.col("b")).alias("cross_group"))


register(
    "agg43_group_graph_quality",
    lambda s, d: R.nearest_edges(member(s, d), 5).join(R.ring_edges(member(s, d), 5), ["src", "dst"], "left_semi").agg(F.count("*").alias("hits")).crossJoin(R.nearest_edges(member(s, d), 5).agg(F.count("*").alias("wanted"))),
    f"{_M}, t AS (SELECT x.vec_id AS src, y.vec_id AS dst FROM m x JOIN m y USING (group_id) WHERE x.vec_id <> y.vec_id QUALIFY row_number() OVER (PARTITION BY x.vec_id ORDER BY {l2('x.embedding', 'y.embedding')}, y.vec_id) <= 5),"
    " e AS (SELECT x.vec_id AS src, y.vec_id AS dst FROM sized x, range(1, 6) r(k), sized y WHERE y.group_id = x.group_id AND k <= x.n - 1 AND y.i = (x.i + k) % x.n) SELECT (SELECT count(*) FROM t JOIN e USING (src, dst)) AS hits, (SELECT count(*) FROM t) AS wanted",
)
register("agg52_index_stats", lambda s, d: grouped(s, d).agg(F.count("*").alias("groups"), F.sum("group_size").alias("vectors")).crossJoin(G.lng_edges(grouped(s, d)).agg(F.count("*").alias("edges"))), f"{_GS}, {EDGES} SELECT (SELECT count(*) FROM groups) AS groups, (SELECT sum(group_size) FROM groups)::BIGINT AS vectors, (SELECT count(*) FROM edges) AS edges")
for _id in ("agg53_edge_checksum", "agg37_checksum"):
    register(_id, lambda s, d: R.ring_edges(member(s, d), 3).agg(F.count("*").alias("n"), F.bit_xor(F.col("src") * 1_000_003 + F.col("dst")).alias("checksum")), f"{_RING} SELECT count(*) AS n, bit_xor(src * 1000003 + dst)::BIGINT AS checksum FROM e")
register("agg58_graph_comparison", lambda s, d: _compare(s, d), f"{_RING}, e2 AS (SELECT src, dst FROM e WHERE dst > src) SELECT src, n, m, n - m AS delta FROM (SELECT src, count(*) AS n FROM e GROUP BY src) LEFT JOIN (SELECT src, count(*) AS m FROM e2 GROUP BY src) USING (src)")


def _compare(s, d):
    a = R.ring_edges(member(s, d), 3)
    b = a.where("dst > src").groupBy("src").agg(F.count("*").alias("m"))
    return a.groupBy("src").agg(F.count("*").alias("n")).join(b, "src", "left").withColumn("delta", F.col("n") - F.col("m"))


_FRONT = (
    f"{_GS}, {QUERIES}, cand AS (SELECT qid, group_id AS c, len(labels) AS n FROM queries q JOIN groups g ON list_has_all(g.labels, q.qlabels[1:1])),"
    " near AS (SELECT qid, c FROM cand WHERE n <= 1 + 1), cov AS (SELECT DISTINCT qid, s.c FROM near JOIN strict s ON s.p = near.c)"
)


def _frontier(s, d):
    return G.cover_frontier(grouped(s, d), broad(s, d), 1)


register("rte09_cover_frontier", lambda s, d: _frontier(s, d).select("qid", "c"), f"{_FRONT} SELECT qid, c FROM near UNION SELECT qid, c FROM cand WHERE (qid, c) NOT IN (SELECT qid, c FROM cov)")
register("rte10_frontier_candidates", lambda s, d: _frontier(s, d).where("kind = 'frontier'").select("qid", "c"), f"{_FRONT} SELECT qid, c FROM near")
register("rte11_frontier_capped", lambda s, d: G.cover_frontier(grouped(s, d), broad(s, d), 1, 3).where("kind = 'frontier'").select("qid", "c"), f"{_FRONT} SELECT qid, c FROM near QUALIFY row_number() OVER (PARTITION BY qid ORDER BY c) <= 3")
register("rte12_frontier_descendants", lambda s, d: _frontier(s, d).where("kind = 'frontier'").select("qid", F.col("c").alias("p")).join(G.supersets(grouped(s, d)), "p").select("qid", "c").distinct(), f"{_FRONT} SELECT qid, c FROM cov")
register("rte13_frontier_uncovered", lambda s, d: _frontier(s, d).where("kind = 'uncovered'").select("qid", "c"), f"{_FRONT} SELECT qid, c FROM cand WHERE (qid, c) NOT IN (SELECT qid, c FROM cov) AND (qid, c) NOT IN (SELECT qid, c FROM near)")
register(
    "top18_entry_expansion",
    lambda s, d: G.select_entry_groups(grouped(s, d), G.lng_edges(grouped(s, d)), _frontier(s, d).select("qid", "c")),
    f"{_FRONT}, {EDGES}, e AS (SELECT qid, c FROM near UNION SELECT qid, c FROM cand WHERE (qid, c) NOT IN (SELECT qid, c FROM cov)),"
    " walk AS (SELECT qid, c, 0 AS hop FROM e UNION ALL SELECT qid, child, hop + 1 FROM RECWALK JOIN edges ON parent = RECWALK.c), hop AS (SELECT qid, c, min(hop) AS hop FROM walk GROUP BY qid, c),"
    " scored AS (SELECT qid, c, row_number() OVER (PARTITION BY qid ORDER BY hop * (SELECT sum(group_size) FROM groups) + group_size DESC, c) AS r FROM hop JOIN groups ON group_id = c WHERE hop > 0),"
    " k AS (SELECT qid, count(*) // 5 AS k FROM e GROUP BY qid) SELECT qid, c FROM e UNION ALL SELECT qid, c FROM scored JOIN k USING (qid) WHERE r <= k".replace("WITH base", "WITH RECURSIVE base", 1).replace("RECWALK", "walk"),
)
register("top18_hops", lambda s, d: G.hops(G.lng_edges(grouped(s, d)), entries(s, d)), f"{_MIN}, {EDGES}, walk AS (SELECT qid, c, 0 AS hop FROM entries UNION ALL SELECT qid, child, hop + 1 FROM RECWALK JOIN edges ON parent = RECWALK.c) SELECT qid, c, min(hop)::BIGINT AS hop FROM walk GROUP BY qid, c".replace("WITH base", "WITH RECURSIVE base", 1).replace("RECWALK", "walk"))

_ROUTE = "CASE WHEN len(qlabels) <= 1 THEN 2 WHEN matched_points < 8 THEN 1 ELSE 0 END"


def _routed(s, d):
    return queries(s, d).join(G.query_coverage(grouped(s, d), queries(s, d)), "qid")


register(
    "rte01_route",
    lambda s, d: _routed(s, d).select("qid", F.when(F.size("qlabels") <= 1, 2).when(F.col("matched_points") < 8, 1).otherwise(0).alias("route")),
    f"SELECT qid, {_ROUTE} AS route FROM ({_QC}) JOIN (WITH {QUERIES} SELECT qid, qlabels FROM queries) USING (qid)",
)
register("rte02_forced_route", lambda s, d: queries(s, d).select("qid", F.when((F.col("qid") / 100 % 4 + 1) <= 2, F.lit("group graph")).otherwise(F.lit("filter graph")).alias("route")), f"WITH {QUERIES} SELECT qid, CASE WHEN qid / 100 % 4 + 1 <= 2 THEN 'group graph' ELSE 'filter graph' END AS route FROM queries")
register("rte03_length_rule", lambda s, d: queries(s, d).select("qid", (F.size("qlabels") <= 1).alias("filter_graph")), f"WITH {QUERIES} SELECT qid, len(qlabels) <= 1 AS filter_graph FROM queries")
register(
    "rte04_selector_features",
    lambda s, d: _routed(s, d).select("qid", F.round(F.log1p("matched_groups") * F.log1p(F.size("qlabels")), 6).alias("f1"), (F.col("matched_groups") * F.size("qlabels")).alias("f2"), F.round(F.size("qlabels") / (F.col("matched_groups") + 1e-9), 6).alias("f3")),
    f"SELECT qid, round(ln(1 + matched_groups) * ln(1 + len(qlabels)), 6) AS f1, matched_groups * len(qlabels) AS f2, round(len(qlabels) / (matched_groups + 1e-9::DOUBLE), 6) AS f3 FROM ({_QC}) JOIN (WITH {QUERIES} SELECT qid, qlabels FROM queries) USING (qid)",
)
