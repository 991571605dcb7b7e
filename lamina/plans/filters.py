"""Label predicates, set lookups and selectors (FLT)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import groups as G
from ..operators import predicates as P
from .registry import register
from .tables import BASE, GROUPS, NESTED, QUERIES, STRICT, base, bits, embeddings, packed, queries


def _pairs(name: str):
    def run(spark, d):
        met = base(spark, d).join(F.broadcast(queries(spark, d)), P.scenario(name)(F.col("labels"), F.col("qlabels")))
        return met.select("qid", "vec_id")

    return run


_ON = {"equality": "b.labels = q.qlabels", "containment": "list_has_all(b.labels, q.qlabels)", "overlap": "list_has_any(b.labels, q.qlabels)", "nofilter": "true"}
for _n, _id in (("equality", "flt01"), ("containment", "flt02"), ("overlap", "flt03"), ("nofilter", "flt04")):
    register(f"{_id}_{_n}", _pairs(_n), f"WITH {BASE}, {QUERIES} SELECT qid, vec_id FROM queries q JOIN base b ON {_ON[_n]}")

register(
    "flt04_nofilter_legacy",
    lambda s, d: base(s, d, True).join(F.broadcast(queries(s, d)), P.scenario("nofilter", True)(F.col("labels"), F.array("label"))).select("qid", "vec_id"),
    f"WITH {NESTED}, {QUERIES} SELECT qid, vec_id FROM queries q JOIN base b ON b.labels = [b.label]",
)


def _grouped(s, d):
    return G.groups(base(s, d, True))


_MIN = (
    f"WITH {NESTED}, {GROUPS}, {STRICT}, {QUERIES}, cand AS (SELECT qid, group_id AS c FROM queries q JOIN groups g ON list_has_all(g.labels, q.qlabels) {{avoid}})"
    " SELECT qid, c FROM cand x WHERE NOT EXISTS (SELECT 1 FROM cand y JOIN strict s ON y.c = s.p WHERE y.qid = x.qid AND s.c = x.c)"
)
register("flt05_min_super_sets", lambda s, d: G.min_super_sets(_grouped(s, d), queries(s, d)), _MIN.format(avoid=""))
register("flt05_min_super_sets_avoid_self", lambda s, d: G.min_super_sets(_grouped(s, d), queries(s, d), True), _MIN.format(avoid="AND g.labels <> q.qlabels"))
register(
    "flt06_super_set_lookup_metrics",
    lambda s, d: G.super_groups(_grouped(s, d), queries(s, d)).groupBy("qid").agg(F.count("*").alias("candidates")).join(G.min_super_sets(_grouped(s, d), queries(s, d)).groupBy("qid").agg(F.count("*").alias("entrances")), "qid"),
    f"WITH {NESTED}, {GROUPS}, {STRICT}, {QUERIES}, cand AS (SELECT qid, group_id AS c FROM queries q JOIN groups g ON list_has_all(g.labels, q.qlabels)),"
    " m AS (SELECT qid, c FROM cand x WHERE NOT EXISTS (SELECT 1 FROM cand y JOIN strict s ON y.c = s.p WHERE y.qid = x.qid AND s.c = x.c))"
    " SELECT qid, (SELECT count(*) FROM cand k WHERE k.qid = m.qid) AS candidates, count(*) AS entrances FROM m GROUP BY qid",
)
register(
    "flt08_super_sets_of_nonempty_queries",
    lambda s, d: G.super_groups(_grouped(s, d), queries(s, d).where(F.size("qlabels") > 0)),
    f"WITH {NESTED}, {GROUPS}, {QUERIES} SELECT qid, group_id AS c FROM queries q JOIN groups g ON len(qlabels) > 0 AND list_has_all(g.labels, q.qlabels)",
)
register(
    "flt11_terminals_under_prefix",
    lambda s, d: G.prefixes(_grouped(s, d)).select("prefix", "group_id"),
    f"WITH {NESTED}, {GROUPS} SELECT labels[1:n] AS prefix, group_id FROM groups, range(1, 4) r(n) WHERE n <= len(labels)",
)
register("flt12_base_super_sets", lambda s, d: G.super_groups(_grouped(s, d), queries(s, d)), f"WITH {NESTED}, {GROUPS}, {QUERIES} SELECT qid, group_id AS c FROM queries q JOIN groups g ON list_has_all(g.labels, q.qlabels)")
for _id, _n in (("flt13", "attribute_bitmap"), ("flt14", "filter_map")):
    register(f"{_id}_{_n}", lambda s, d, e=_id == "flt13": P.relational_division(base(s, d), queries(s, d), e), f"WITH {BASE}, {QUERIES} SELECT qid, vec_id FROM queries q JOIN base b ON list_has_all(b.labels, q.qlabels)")
register(
    "flt15_single_filter_map",
    lambda s, d: P.relational_division(base(s, d), s.range(1).select(F.lit(0).cast("long").alias("qid"), F.array(F.lit(3), F.lit(101)).alias("qlabels"))).select("vec_id"),
    f"WITH {BASE} SELECT vec_id FROM base WHERE list_has_all(labels, [3, 101])",
)


def _group_bitmap(s, d):
    grouped = _grouped(s, d)
    found = G.min_super_sets(grouped, queries(s, d))
    down = found.join(G.supersets(grouped).select(F.col("p").alias("c"), F.col("c").alias("x")), "c").select("qid", F.col("x").alias("c"))
    return found.union(down).distinct().join(G.members(base(s, d, True), grouped), F.col("c") == F.col("group_id")).select("qid", "vec_id")


_CONTAINED = f"WITH {NESTED}, {QUERIES} SELECT qid, vec_id FROM queries q JOIN base b ON list_has_all(b.labels, q.qlabels)"
register("flt16_bitmap_from_groups", _group_bitmap, _CONTAINED)
register("flt17_batch_bitmaps", lambda s, d: G.super_groups(_grouped(s, d), queries(s, d)).join(G.members(base(s, d, True), _grouped(s, d)), F.col("c") == F.col("group_id")).select("qid", "vec_id"), _CONTAINED)

register("flt18_metadata_equal", lambda s, d: embeddings(s, d).where(P.metadata("EQUAL", F.col("label"), 3)).select("vec_id"), "SELECT vec_id FROM embeddings WHERE label = 3")
register(
    "flt18_metadata_or",
    lambda s, d: embeddings(s, d).where(P.metadata("OR", F.call_function("shiftleft", F.lit(1), F.col("label") % 8), 6)).select("vec_id"),
    "SELECT vec_id FROM embeddings WHERE ((1 << (label % 8)) & 6) <> 0",
)
register("flt18_metadata_regex", lambda s, d: embeddings(s, d).where(P.metadata("REGEX", F.concat(F.lit("L"), F.col("label")), "^L[1-3]$")).select("vec_id"), "SELECT vec_id FROM embeddings WHERE regexp_matches('L' || label, '^L[1-3]$')")

register("flt20_selector", lambda s, d: embeddings(s, d).where((F.col("label") > 2) & (F.col("vec_id") > 7)).select("vec_id"), "SELECT vec_id FROM embeddings WHERE label > 2 AND vec_id > 7")
register("flt21_id_range", lambda s, d: embeddings(s, d).where(P.id_range(F.col("vec_id"), 30, 80)).select("vec_id", "label"), "SELECT vec_id, label FROM embeddings WHERE vec_id >= 30 AND vec_id < 80")


def _chosen(s, d):
    return s.range(1000).select((F.col("id") * 7 % 1000).alias("vec_id")).where("vec_id < 400")


_IDS = "(SELECT (i * 7) % 1000 AS vec_id FROM range(1000) t(i) WHERE (i * 7) % 1000 < 400)"
register("flt22_id_array", lambda s, d: P.id_in(embeddings(s, d), _chosen(s, d)).select("vec_id"), f"SELECT vec_id FROM embeddings WHERE vec_id IN {_IDS}")
register("flt23_id_batch", lambda s, d: embeddings(s, d).join(F.broadcast(_chosen(s, d)), "vec_id", "left_semi").select("vec_id", "label"), f"SELECT vec_id, label FROM embeddings WHERE vec_id IN {_IDS}")
register("flt24_id_bitmap", lambda s, d: embeddings(s, d).where(P.id_bitmap(F.col("vec_id"), F.unhex(F.lit("0F" * 20)))).select("vec_id"), "SELECT vec_id FROM embeddings WHERE vec_id < 160 AND vec_id % 8 < 4")
register("flt25_not", lambda s, d: P.id_not_in(embeddings(s, d), _chosen(s, d)).select("vec_id"), f"SELECT vec_id FROM embeddings WHERE vec_id NOT IN {_IDS}")
register("flt26_all", lambda s, d: embeddings(s, d).where(F.lit(True)).select("vec_id"), "SELECT vec_id FROM embeddings")
register(
    "flt29_masked_lists",
    lambda s, d: _masked(s, d),
    "WITH a AS (SELECT label AS list_no, vec_id FROM embeddings WHERE label % 2 = 0), b AS (SELECT label AS list_no, vec_id FROM embeddings)"
    " SELECT list_no, vec_id FROM a UNION ALL SELECT list_no, vec_id FROM b WHERE list_no NOT IN (SELECT list_no FROM a)",
)
register(
    "flt30_stop_lists",
    lambda s, d: embeddings(s, d).join(embeddings(s, d).groupBy("label").count().where("count <= 60").select("label"), "label", "left_semi").select("label", "vec_id"),
    "SELECT label, vec_id FROM embeddings WHERE label IN (SELECT label FROM embeddings GROUP BY label HAVING count(*) <= 60)",
)


def _masked(s, d):
    lists = embeddings(s, d).select(F.col("label").alias("list_no"), "vec_id")
    first = lists.where("list_no % 2 = 0")
    return first.unionByName(lists.join(first.select("list_no").distinct(), "list_no", "left_anti"))


register("dst33_sign_bits", lambda s, d: bits(embeddings(s, d)).select("vec_id", F.bit_count("bits").cast("long").alias("ones")), "SELECT vec_id, len(list_filter(embedding, lambda x: x > 0))::BIGINT AS ones FROM embeddings")
_ = packed
