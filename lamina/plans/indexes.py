"""Indexes, quantizers, maintenance, streams, generators and graph kernels over the driver's tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import vector as V
from ..operators import generate as N
from ..operators import groups as G
from ..operators import index as I
from ..operators import kernels as W
from ..operators import quantize as Z
from ..operators import search as S
from ..operators.durable import settled
from ..streaming.slices import window_of
from .distances import CENTROIDS, centroids
from .registry import register
from .tables import BASE, K, NESTED, QUERIES, base, embeddings, ip, l2, queries
from .walks import MET, measured, nearest

# --- inverted lists over the labels' mean vectors, exact in SQL ------------------------------------------------------

_NEAR = f"round({l2('centroid', 'q.qvec')}, 9)"
_LISTED = (
    f"{CENTROIDS}, listed AS (SELECT vec_id, embedding, list_no FROM embeddings, cent QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round({l2('embedding', 'centroid')}, 9), list_no) = 1)"
)
_PROBE = "probe AS (SELECT qid, qvec, list_no, row_number() OVER (PARTITION BY qid ORDER BY {near}, list_no) AS place FROM queries q, cent QUALIFY place <= {n})"


def _ivf(nprobe):
    return f"WITH {QUERIES}, {_LISTED}, {_PROBE.format(near=_NEAR, n=nprobe)}, met AS (SELECT qid, vec_id, list_no, {l2('embedding', 'qvec')} AS dist FROM probe JOIN listed USING (list_no))"


def listed(s, d):
    return I.lists_of(embeddings(s, d), centroids(s, d))


def _search(nprobe, **options):
    return lambda s, d: I.ivf_search(listed(s, d), queries(s, d), centroids(s, d), K, nprobe, **options)


_RANK = f"row_number() OVER (PARTITION BY qid ORDER BY dist, vec_id) AS rk FROM met QUALIFY rk <= {K}"
for _id, _n in (("idx10_ivf", 3), ("idx11_ivf_flat", 1), ("str07_ivf_search", 2), ("str11_ivf_search_parameters", 5)):
    register(_id, lambda s, d, n=_n: _search(n)(s, d).select("qid", "vec_id", "rk", F.round("dist", 6).alias("dist")), f"{_ivf(_n)} SELECT qid, vec_id, round(dist, 6) AS dist, {_RANK}")
register("idx10_ivf_all_lists_is_exact", lambda s, d: _search(1_000)(s, d).select("qid", "vec_id", "rk"), f"WITH {BASE}, {QUERIES} SELECT qid, vec_id, row_number() OVER (PARTITION BY qid ORDER BY {l2('b.embedding', 'q.qvec')}, vec_id) AS rk FROM queries q, base b QUALIFY rk <= {K}")
register("str06_search_with_lists", lambda s, d: _search(2)(s, d).select("qid", "vec_id", "list_no", "rk"), f"{_ivf(2)} SELECT qid, vec_id, list_no, {_RANK}")
for _id in ("str08_ivf_range", "str12_ivf_range_parameters", "str15_ivf_range_preassigned"):
    register(_id, lambda s, d: I.ivf_range(listed(s, d), queries(s, d), centroids(s, d), 1.2, 3).select("qid", "vec_id"), f"{_ivf(3)} SELECT qid, vec_id FROM met WHERE dist < 1.2")
for _id in ("str13_nearest_centroid", "qnt08_assign", "qnt41_assign_dense", "jon33_assign_blocked"):
    register(_id, lambda s, d: listed(s, d).select("vec_id", "list_no"), f"WITH {_LISTED} SELECT vec_id, list_no FROM listed")
register("str05_preassigned_add", lambda s, d: embeddings(s, d).select("vec_id", F.col("label").alias("list_no")).unionByName(listed(s, d).select("vec_id", "list_no")).distinct(), f"WITH {_LISTED} SELECT vec_id, label AS list_no FROM embeddings UNION SELECT vec_id, list_no FROM listed")
for _id in ("str14_ivf_add_preassigned", "str17_ivf_add"):
    register(_id, lambda s, d: listed(s, d).where("vec_id % 2 = 0").unionByName(listed(s, d).where("vec_id % 2 = 1")).groupBy("list_no").agg(F.count("*").alias("n")), f"WITH {_LISTED} SELECT list_no, count(*) AS n FROM listed GROUP BY list_no")
register(
    "str16_preassigned_max_codes",
    lambda s, d: I.probed(listed(s, d), I.probes(queries(s, d), centroids(s, d), 5), max_codes=80).select("qid", "vec_id"),
    f"{_ivf(5)}, sizes AS (SELECT list_no, count(*) AS n FROM listed GROUP BY list_no), cut AS (SELECT qid, list_no, coalesce(sum(n) OVER (PARTITION BY qid ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM probe JOIN sizes USING (list_no)) SELECT qid, vec_id FROM met JOIN cut USING (qid, list_no) WHERE b < 80",
)
register("set10_list_range", lambda s, d: listed(s, d).where(F.col("list_no").between(2, 4)).select("vec_id", "list_no"), f"WITH {_LISTED} SELECT vec_id, list_no FROM listed WHERE list_no BETWEEN 2 AND 4")
register("idx41_direct_map", lambda s, d: listed(s, d).select("vec_id", "list_no").join(queries(s, d).select(F.col("qid").alias("vec_id")), "vec_id"), f"WITH {_LISTED}, {QUERIES} SELECT vec_id, list_no FROM listed JOIN queries ON qid = vec_id")
register("idx42_stacked_lists", lambda s, d: listed(s, d).select("vec_id", "list_no").unionByName(listed(s, d).select("vec_id", (F.col("list_no") + 10).alias("list_no"))), f"WITH {_LISTED} SELECT vec_id, list_no FROM listed UNION ALL SELECT vec_id, list_no + 10 FROM listed")
register("idx29_refined", lambda s, d: S.refine(_search(3)(s, d), base(s, d), queries(s, d), 5).select("qid", "vec_id", "rk"), f"{_ivf(3)} SELECT qid, vec_id, row_number() OVER (PARTITION BY qid ORDER BY dist, vec_id) AS rk FROM met QUALIFY rk <= 5")

_EXACT = f"WITH {BASE}, {QUERIES}, x AS (SELECT qid, vec_id, {{sql}} AS dist FROM queries q, base b) SELECT qid, vec_id, row_number() OVER (PARTITION BY qid ORDER BY dist {{order}}, vec_id) AS rk FROM x QUALIFY rk <= {K}"
for _id, _m in (("idx02_flat_l2", "l2"), ("idx02_flat_ip", "ip"), ("idx50_search_contract", "l2"), ("idx30_shards", "l2")):
    register(_id, lambda s, d, m=_m: I.Index("Flat", m).train(embeddings(s, d)).add(embeddings(s, d)).search(queries(s, d), K).select("qid", "vec_id", "rk"), _EXACT.format(sql=(l2 if _m == "l2" else ip)("b.embedding", "q.qvec"), order="" if _m == "l2" else "DESC"))
register("idx51_range_contract", lambda s, d: I.Index("Flat").train(embeddings(s, d)).add(embeddings(s, d)).range_search(queries(s, d), 1.2).select("qid", "vec_id"), f"WITH {BASE}, {QUERIES} SELECT qid, vec_id FROM queries q, base b WHERE {l2('b.embedding', 'q.qvec')} < 1.2")
register("idx27_id_map", lambda s, d: S.knn(embeddings(s, d).select((F.col("vec_id") + 1000).alias("vec_id"), "embedding"), queries(s, d), K).select("qid", "vec_id", "rk"), f"WITH {BASE}, {QUERIES} SELECT qid, vec_id + 1000 AS vec_id, row_number() OVER (PARTITION BY qid ORDER BY {l2('b.embedding', 'q.qvec')}, vec_id) AS rk FROM queries q, base b QUALIFY rk <= {K}")
register(
    "idx26_rowwise_min_max",
    lambda s, d: embeddings(s, d).select("vec_id", I.row_codes(F.col("embedding")).alias("r")).select("vec_id", F.round("r.lo", 6).alias("lo"), F.round("r.hi", 6).alias("hi"), F.aggregate("r.codes", F.lit(0).cast("long"), lambda a, x: a + x).alias("sum")),
    "SELECT vec_id, round(lo, 6) AS lo, round(hi, 6) AS hi, list_sum(list_transform(embedding, lambda x: round((x::DOUBLE - lo) / (hi - lo) * 255)::BIGINT))::BIGINT AS sum FROM (SELECT *, list_min(embedding)::DOUBLE AS lo, list_max(embedding)::DOUBLE AS hi FROM embeddings)",
)
_SQ = "WITH r AS (SELECT i, min(embedding[i]::DOUBLE) AS lo, max(embedding[i]::DOUBLE) AS hi FROM embeddings, range(1, 65) t(i) GROUP BY i), c AS (SELECT vec_id, i, lo, hi, least(greatest(floor((embedding[i]::DOUBLE - lo) / (hi - lo) * {top}), 0), {top})::INT AS code FROM embeddings, r)"


def _sq(s, d, bits):
    return embeddings(s, d).join(F.broadcast(Z.ranges(embeddings(s, d)))).withColumn("codes", Z.scalar_codes(F.col("embedding"), F.col("lo"), F.col("hi"), bits))


for _id, _b in (("qnt18_scalar_8bit", 8), ("qnt18_scalar_6bit", 6), ("qnt18_scalar_4bit", 4), ("qnt31_scalar_encode", 8), ("idx04_flat_codes", 8)):
    register(_id, lambda s, d, b=_b: _sq(s, d, b).select("vec_id", "codes"), f"{_SQ.format(top=2**_b - 1)} SELECT vec_id, list(code ORDER BY i) AS codes FROM c GROUP BY vec_id")
register("qnt32_scalar_decode", lambda s, d: _sq(s, d, 8).select("vec_id", F.transform(Z.scalar_values(F.col("codes"), F.col("lo"), F.col("hi"), 8), lambda x: F.round(x, 5) + 0.0).alias("v")), f"{_SQ.format(top=255)} SELECT vec_id, list(round(lo + (code + 0.5) / 255.0::DOUBLE * (hi - lo), 5) + 0.0::DOUBLE ORDER BY i) AS v FROM c GROUP BY vec_id")
register("idx14_scalar_quantizer_index", measured(lambda s, d: I.Index("SQ8").train(embeddings(s, d)).add(embeddings(s, d)).search(queries(s, d), K), nearest), MET)
for _id in ("qnt15_l2_normalisation",):
    register(_id, lambda s, d: embeddings(s, d).select("vec_id", F.round(V.norm(V.normalized(F.col("embedding"))), 6).alias("norm")), "SELECT vec_id, 1.0::DOUBLE AS norm FROM embeddings")
register("qnt14_remap_dimensions", lambda s, d: embeddings(s, d).select("vec_id", F.transform(V.remap(F.col("embedding"), [3, -1, 0, 63]), lambda x: F.round(x, 5) + 0.0).alias("v")), "SELECT vec_id, list_transform([embedding[4]::DOUBLE, 0.0::DOUBLE, embedding[1]::DOUBLE, embedding[64]::DOUBLE], lambda x: round(x, 5) + 0.0::DOUBLE) AS v FROM embeddings")
for _id in ("qnt09_linear_transform", "qnt35_transform_chain"):
    register(_id, lambda s, d: embeddings(s, d).select("vec_id", F.transform(V.linear(F.slice("embedding", 1, 2), [[1.0, 2.0], [-1.0, 0.5]], [0.5, 0.0]), lambda x: F.round(x, 5) + 0.0).alias("v")), "SELECT vec_id, [round(embedding[1]::DOUBLE + 2 * embedding[2]::DOUBLE + 0.5, 5) + 0.0::DOUBLE, round(-embedding[1]::DOUBLE + 0.5 * embedding[2]::DOUBLE, 5) + 0.0::DOUBLE] AS v FROM embeddings")
_MEAN = "m AS (SELECT i, avg(embedding[i]::DOUBLE) AS x FROM embeddings, range(1, 65) t(i) GROUP BY i)"
register(
    "qnt16_centering",
    lambda s, d: embeddings(s, d).select("vec_id", F.posexplode("embedding").alias("i", "x")).join(embeddings(s, d).select(F.posexplode("embedding").alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("m")), "i").select("vec_id", "i", (F.round(F.col("x").cast("double") - F.col("m"), 5) + 0.0).alias("v")),
    f"WITH {_MEAN} SELECT vec_id, (i - 1)::INT AS i, round(embedding[i]::DOUBLE - x, 5) + 0.0::DOUBLE AS v FROM embeddings, m",
)
register("qnt36_centroids_spherical", lambda s, d: centroids(s, d).select("list_no", F.round(V.norm(V.normalized(F.col("centroid"))), 6).alias("norm")), f"WITH {CENTROIDS} SELECT list_no, 1.0::DOUBLE AS norm FROM cent")
register(
    "qnt37_weighted_centroids",
    lambda s, d: embeddings(s, d).select("label", (F.col("vec_id") % 3 + 1).alias("w"), F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.round(F.sum(F.col("x").cast("double") * F.col("w")) / F.sum("w"), 6).alias("m")),
    "SELECT label, (i - 1)::INT AS i, round(sum(embedding[i]::DOUBLE * (vec_id % 3 + 1)) / sum(vec_id % 3 + 1), 6) AS m FROM embeddings, range(1, 65) t(i) GROUP BY label, i",
)

# --- binary ----------------------------------------------------------------------------------------------------------

_HAM = "len(list_filter(list_zip(b.embedding, q.qvec), lambda p: (p[1] > 0) <> (p[2] > 0)))::BIGINT"
_HW = f"WITH {BASE}, {QUERIES}, ham AS (SELECT qid, vec_id, label, {_HAM} AS dist FROM queries q, base b)"


def binary(s, d, where=None):
    b = base(s, d).withColumn("bits", V.sign_bits(F.col("embedding")))
    q = queries(s, d).withColumn("qbits", V.sign_bits(F.col("qvec")))
    return b.join(F.broadcast(q), where if where is not None else F.lit(True)).select("qid", "vec_id", "bits", "qbits", V.hamming(F.col("bits"), F.col("qbits")).alias("dist"))


for _id in ("idx35_binary_flat", "idx34_binary_contract", "idx40_binary_from_float"):
    register(_id, lambda s, d: S.ranked(binary(s, d).select("qid", "vec_id", "dist"), K), f"{_HW} SELECT qid, vec_id, dist, row_number() OVER (PARTITION BY qid ORDER BY dist, vec_id) AS rk FROM ham QUALIFY rk <= {K}")
register("idx36_binary_ivf", lambda s, d: S.ranked(binary(s, d, F.col("label") == F.element_at("qlabels", 1)).select("qid", "vec_id", "dist"), K), f"{_HW} SELECT h.qid, vec_id, dist, row_number() OVER (PARTITION BY h.qid ORDER BY dist, vec_id) AS rk FROM ham h JOIN queries q ON q.qid = h.qid AND h.label = qlabels[1] QUALIFY rk <= {K}")


def _hashed(s, d, maps):
    """Candidates whose 8-bit key differs in at most one bit, in any of the maps; flipped keys meet by an equi-join."""
    b = base(s, d).withColumn("bits", V.sign_bits(F.col("embedding")))
    q = queries(s, d).withColumn("qbits", V.sign_bits(F.col("qvec")))
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i).cast("long") for i in range(8)])
    out = None
    for m in maps:
        key = lambda c: F.shiftrightunsigned(c, 8 * m).bitwiseAND(F.lit(255).cast("long"))
        asked = q.select("qid", "qbits", F.explode(F.transform(flips, lambda f: key(F.col("qbits")).bitwiseXOR(f))).alias("key"))
        part = b.select("vec_id", "bits", key(F.col("bits")).alias("key")).join(asked, "key").select("qid", "vec_id", V.hamming(F.col("bits"), F.col("qbits")).alias("dist"))
        out = part if out is None else out.unionByName(part)
    return S.ranked(out.distinct(), K)


def _hash_sql(maps):
    near = " OR ".join(f"len(list_filter(list_zip(b.embedding[{8 * m + 1}:{8 * m + 8}], q.qvec[{8 * m + 1}:{8 * m + 8}]), lambda p: (p[1] > 0) <> (p[2] > 0))) <= 1" for m in maps)
    return f"WITH {BASE}, {QUERIES}, ham AS (SELECT qid, vec_id, {_HAM} AS dist FROM queries q JOIN base b ON {near}) SELECT qid, vec_id, dist, row_number() OVER (PARTITION BY qid ORDER BY dist, vec_id) AS rk FROM ham QUALIFY rk <= {K}"


register("idx38_binary_hash", lambda s, d: _hashed(s, d, [0]), _hash_sql([0]))
register("idx39_binary_multi_hash", lambda s, d: _hashed(s, d, [0, 3, 6]), _hash_sql([0, 3, 6]))

# --- maintenance -----------------------------------------------------------------------------------------------------

E_ = "SELECT vec_id, label FROM embeddings"
for _id in ("set01_merge", "set02_merge_lists", "set13_id_map_merge", "src33_merge_shards"):
    register(_id, lambda s, d: I.merged(embeddings(s, d).select("vec_id", "label"), embeddings(s, d).select("vec_id", "label"), 10_000), f"{E_} UNION ALL SELECT vec_id + 10000, label FROM embeddings")
for _kind, _a, _b, _w in (("range", 50, 200, "vec_id >= 50 AND vec_id < 200"), ("modulo", 7, 3, "vec_id % 7 = 3")):
    register(f"set03_subset_{_kind}", lambda s, d, k=_kind, a=_a, b=_b: I.subset(embeddings(s, d).select("vec_id", "label"), k, a, b), f"{E_} WHERE {_w}")


def _gone(s, d):
    return embeddings(s, d).where("label = 2").select("vec_id")


for _id in ("set04_remove_ids", "set11_remove_from_lists"):
    register(_id, lambda s, d: I.removed(embeddings(s, d).select("vec_id", "label"), _gone(s, d)), f"{E_} WHERE label <> 2")
register("set04_remove_and_renumber", lambda s, d: I.renumbered(I.removed(embeddings(s, d).select("vec_id", "label"), _gone(s, d))), "SELECT row_number() OVER (ORDER BY vec_id) - 1 AS vec_id, label FROM embeddings WHERE label <> 2")
register("set05_update", lambda s, d: I.updated(embeddings(s, d).select("vec_id", "label"), _gone(s, d).withColumn("label", F.lit(77))), "SELECT vec_id, CASE WHEN label = 2 THEN 77 ELSE label END AS label FROM embeddings")
register("set06_add_with_ids", lambda s, d: embeddings(s, d).select("vec_id", "label").unionByName(_gone(s, d).select((F.col("vec_id") + 5000).alias("vec_id"), F.lit(2).alias("label"))), f"{E_} UNION ALL SELECT vec_id + 5000, 2 FROM embeddings WHERE label = 2")
register("set07_reconstruct", lambda s, d: I.Index("Flat").train(embeddings(s, d)).add(embeddings(s, d)).reconstruct(_gone(s, d)).select("vec_id", F.round(V.norm_squared(F.col("embedding")), 5).alias("n")), f"SELECT vec_id, round({ip('embedding', 'embedding')}, 5) AS n FROM embeddings WHERE label = 2")
register(
    "set08_search_and_reconstruct",
    lambda s, d: S.knn(base(s, d), queries(s, d), 3).join(base(s, d), "vec_id").select("qid", "vec_id", "rk", F.round(V.norm_squared(F.col("embedding")), 5).alias("n")),
    f"WITH {BASE}, {QUERIES} SELECT qid, vec_id, row_number() OVER (PARTITION BY qid ORDER BY {l2('b.embedding', 'q.qvec')}, vec_id) AS rk, round({ip('b.embedding', 'b.embedding')}, 5) AS n FROM queries q, base b QUALIFY rk <= 3",
)
register("src34_stride_sample", lambda s, d: embeddings(s, d).where("vec_id % 5 = 0").select("vec_id", "label"), f"{E_} WHERE vec_id % 5 = 0")
register("src02_default_labels", lambda s, d: base(s, d).select("vec_id", F.when(F.col("label") > 4, F.col("labels")).alias("labels")).select("vec_id", F.coalesce("labels", F.array(F.lit(1))).alias("labels")), f"WITH {BASE} SELECT vec_id, CASE WHEN label > 4 THEN labels ELSE [1] END AS labels FROM base")
register("src03_label_text", lambda s, d: base(s, d).select("vec_id", F.concat_ws(",", F.transform("labels", lambda x: x.cast("string"))).alias("line")), f"WITH {BASE} SELECT vec_id, array_to_string(labels, ',') AS line FROM base")
for _id in ("src14_inverted_index", "src23_inverted_label_index"):
    register(_id, lambda s, d: base(s, d).select(F.explode("labels").alias("label"), "vec_id").distinct(), f"WITH {BASE} SELECT DISTINCT unnest(labels) AS label, vec_id FROM base")
for _id in ("str01_sliding_window",):
    register(_id, lambda s, d: window_of(embeddings(s, d).withColumn("slice", F.col("vec_id") % 8), "slice", 6, 3).select("vec_id", "slice"), "SELECT vec_id, vec_id % 8 AS slice FROM embeddings WHERE vec_id % 8 BETWEEN 4 AND 6")
register(
    "str01_event_windows",
    lambda s, d: s.read.parquet(f"{d}/events.parquet").groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour")).agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("windows")),
    "SELECT n, count(*) AS windows FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts::TIMESTAMP) AS w, count(*) AS n FROM events GROUP BY w) GROUP BY n",
)

# --- generated -------------------------------------------------------------------------------------------------------

_D = N.draw_sql
_IDS_2000 = "ids AS (SELECT range AS vec_id FROM range(2000))"


def _bernoulli_sql(count, chance, seed=1):
    """Labels i of 1 to count with draw < chance(i); a vector without any gets one."""
    return f"WITH {_IDS_2000}, has AS (SELECT vec_id, list_filter(range(1, {count + 1}), lambda i: {_D(seed, 'vec_id', 'i')} < {chance}) AS l FROM ids) SELECT vec_id, (CASE WHEN len(l) > 0 THEN l ELSE [(floor({_D(seed + 7, 'vec_id')} * {count}) + 1)::BIGINT] END)::INT[] AS labels FROM has"


def _middle_sql(seed):
    return f"(floor(({_D(seed, 'vec_id')} + {_D(seed + 1, 'vec_id')} + {_D(seed + 2, 'vec_id')}) / 3 * 12) + 1)::INT"


_GEN = {
    "zipf": _bernoulli_sql(12, "0.7::DOUBLE / i"), "uniform": _bernoulli_sql(12, "0.5::DOUBLE"), "poisson": _bernoulli_sql(12, "exp(-1.0::DOUBLE) * pow(0.5::DOUBLE, i - 1)"),
    "one_per_point": f"WITH {_IDS_2000} SELECT vec_id, [(floor({_D(1, 'vec_id')} * 12) + 1)::INT] AS labels FROM ids", "multi_normal": f"WITH {_IDS_2000} SELECT vec_id, list_sort(list_distinct([{_middle_sql(1)}, {_middle_sql(4)}])) AS labels FROM ids",
}
for _kind, _sql in _GEN.items():
    register(f"gen01_labels_{_kind}", lambda s, d, k=_kind: N.labels(s, 2000, k, 12), _sql)
register("gen02_zipf_quota", lambda s, d: N.labels(s, 2000, "zipf", 12).select("vec_id", F.explode("labels").alias("label")).groupBy("label").agg(F.count("*").alias("n")), f"SELECT label, count(*) AS n FROM (SELECT unnest(labels) AS label FROM ({_GEN['zipf']})) GROUP BY label")
register("gen03_power_zipf", lambda s, d: N.power_zipf(s, 2000), _bernoulli_sql(30, "least(0.9::DOUBLE, 0.75::DOUBLE / pow(i + 1, 0.85::DOUBLE))", 20260519))
_STRICT_G = f"WITH {NESTED}, g AS (SELECT row_number() OVER (ORDER BY min(vec_id)) AS group_id, labels, count(*) AS group_size FROM base GROUP BY labels)"


def _subsets_sql(hottest=False, children=0):
    pool = "list_sort(labels)[1:3]" if hottest else "labels"
    more = f" WHERE (SELECT count(*) FROM g WHERE list_has_all(labels, qlabels)) > {children}" if children else ""
    return (
        f"{_STRICT_G}, made AS (SELECT DISTINCT list_filter({pool}, lambda x: {_D(1, 'group_id', 't', 'x')} < 0.5) AS qlabels FROM g, range(1, 5) r(t)),"
        f" m AS (SELECT qlabels, sum(group_size)::BIGINT AS matched_points FROM made JOIN g ON list_has_all(labels, qlabels) WHERE len(qlabels) > 0 GROUP BY qlabels HAVING sum(group_size) BETWEEN 10 AND 400) SELECT qlabels, matched_points FROM m{more}"
    )


for _id, _o in (("gen04_queries_with_answers", {}), ("gen05_mixed_queries", {}), ("gen07_subset_queries", {"children": 1}), ("gen08_weighted_subset_queries", {"hottest": True})):
    register(_id, lambda s, d, o=_o: N.subset_queries(G.groups(base(s, d, True)), 4, 10, 400, **o).select("qlabels", "matched_points"), _subsets_sql(**_o))
_COVER = f"WITH {NESTED}, {QUERIES}, g AS (SELECT labels FROM base GROUP BY labels), c AS (SELECT qid, count(labels) AS matched_groups FROM queries LEFT JOIN g ON list_has_all(labels, qlabels[1:1]) GROUP BY qid)"
for _id in ("gen09_coverage_profiles", "gen18_coverage_from_index"):
    register(
        _id,
        lambda s, d: N.coverage_profiles(G.query_coverage(G.groups(base(s, d, True)), queries(s, d).withColumn("qlabels", F.slice("qlabels", 1, 1)))),
        f"{_COVER} SELECT qid, matched_groups, CASE WHEN matched_groups BETWEEN 2 AND 8 THEN 'narrow' WHEN matched_groups BETWEEN 9 AND 64 THEN 'medium' WHEN matched_groups >= 65 THEN 'broad' END AS profile FROM c",
    )
register("gen10_group_matching", lambda s, d: G.super_groups(G.groups(base(s, d, True)), queries(s, d)).groupBy("qid").agg(F.count("*").alias("n")), f"WITH {NESTED}, {QUERIES}, g AS (SELECT labels FROM base GROUP BY labels) SELECT qid, count(*) AS n FROM queries JOIN g ON list_has_all(labels, qlabels) GROUP BY qid")
def _vectors_sql(n, dims, kind):
    u = lambda i, k: f"greatest({_D(1338 + k, 'vec_id', i)}, 1e-9::DOUBLE)"
    normal = lambda i, k=0: f"sqrt(-2 * ln({u(i, k)})) * cos(2 * 3.141592653589793::DOUBLE * {u(i, k + 1)})"
    value = {"normal": normal("i"), "uniform": u("i", 0), "ints": f"floor({u('i', 0)} * 256)", "smooth": f"sin({' + '.join(f'{normal(str(k), 10)} * sin(i * ({k} + 1))' for k in range(4))})"}[kind]
    return f"SELECT vec_id, round(list_sum(list_transform(range(1, {dims + 1}), lambda i: {value})), 4) AS total FROM (SELECT range AS vec_id FROM range({n}))"


def _totals(n, dims, kind):
    """Sums of the generated vectors, over float components, rounded."""
    total = lambda v: F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double")), 4)
    return lambda s, d: N.vectors(s, n, dims, kind, exact=True).select("vec_id", total(F.col("embedding")).alias("total"))


for _kind in ("normal", "uniform", "ints", "smooth"):
    register(f"gen14_vectors_{_kind}", _totals(500, 16, _kind), _vectors_sql(500, 16, _kind))
register("src36_synthetic_vectors", _totals(1000, 32, "smooth"), _vectors_sql(1000, 32, "smooth"))

# --- trained ---------------------------------------------------------------------------------------------------------


def _recalled(make):
    """Per query, the share of the exact ten that an approximate search finds."""

    def run(s, d):
        found = make(s, d).select("qid", "vec_id")
        truth = S.knn(base(s, d), queries(s, d), K).select("qid", "vec_id")
        return truth.join(found.withColumn("hit", F.lit(1)), ["qid", "vec_id"], "left").groupBy("qid").agg((F.count("hit") / K).alias("recall"))

    return run


def _index(text):
    """A search whose lists and shortlist are measured on the table; codes choose the shortlist, vectors decide."""

    def run(s, d):
        index = I.Index(text).train(embeddings(s, d)).add(embeddings(s, d))
        return index.search(queries(s, d), K, *index.tuned(K))

    return run


for _id, _text in (
    ("idx12_ivf_pq", "IVF8,PQ8x4,RFlat"), ("idx13_ivf_pq_refined", "IVF8,PQ16x4,RFlat"), ("idx16_ivf_residual", "IVF8,RQ4x4,RFlat"), ("idx19_pq", "PQ16x4,RFlat"), ("idx21_residual", "RQ6x4,RFlat"), ("idx21_local_search", "LSQ4x4,RFlat"),
    ("idx21_product_residual", "PRQ4x2x4,RFlat"), ("idx21_product_local_search", "PLSQ4x2x4,RFlat"), ("idx28_pre_transform", "PCA32,Flat,RFlat"), ("idx28_opq", "OPQ8,PQ8x4,RFlat"), ("idx44_factory", "PCA32,IVF8,SQ8,RFlat"), ("idx52_train_add", "IVF8,Flat"),
):
    register(_id, measured(_index(_text), nearest), MET)


def _member(s, d):
    return embeddings(s, d).select(F.lit(1).cast("long").alias("group_id"), "vec_id", "embedding", "label")


def _means(s, d, c):
    return I.as_frame(s, c)


def _spread(s, d, at="embedding"):
    """The sum of all rows' squared distances to their mean."""
    each = embeddings(s, d).select(F.posexplode(at).alias("i", "x")).groupBy("i").agg((F.var_pop(F.col("x").cast("double")) * F.count("*")).alias("v"))
    return each.agg(F.sum("v").alias("spread"))


def _clusters(make, converged=False):
    """Number of centroids, and whether all rows together are nearer to them than to the mean of all; converged: also
    whether one more step of means over all rows would gain less than 2 percent."""

    def run(s, d):
        c = make(s, d)
        placed = settled(Z.assign(embeddings(s, d), c), "placed")
        good = F.col("left") < F.col("spread")
        out = placed.agg(F.sum("dist").alias("left")).crossJoin(_spread(s, d))
        if converged:
            each = placed.join(embeddings(s, d), "vec_id").select("list_no", F.posexplode("embedding").alias("i", "x")).groupBy("list_no", "i").agg((F.var_pop(F.col("x").cast("double")) * F.count("*")).alias("v"))
            out = out.crossJoin(each.agg(F.sum("v").alias("next")))
            good = good & (F.col("next") > 0.98 * F.col("left"))
        return out.select(F.lit(len(c)).alias("centroids"), good.alias("error_ok"))

    return run


def _clusters_sql(n):
    return f"SELECT {n} AS centroids, true AS error_ok"


for _id, _o in (("qnt01_kmeans", {}), ("qnt07_kmeans_more", {"rounds": 15})):
    register(_id, _clusters(lambda s, d, o=_o: Z.kmeans(embeddings(s, d), 8, **o), True), _clusters_sql(8))
register("qnt05_kmeans_spherical", lambda s, d: s.createDataFrame([(8, bool(np.allclose(np.linalg.norm(Z.kmeans(embeddings(s, d), 8, spherical=True), axis=1), 1)))], "centroids int, unit_ok boolean"), "SELECT 8 AS centroids, true AS unit_ok")
register("qnt06_two_level", _clusters(lambda s, d: np.concatenate([Z.kmeans_local(p, 3, 8) for p in _parts(s, d)])), _clusters_sql(12))
register("qnt40_two_level_lists", lambda s, d: Z.assign(embeddings(s, d), np.concatenate([Z.kmeans_local(p, 3, 8) for p in _parts(s, d)])).agg(F.count_distinct("list_no").alias("lists"), F.count("*").alias("vectors")), "SELECT 12::BIGINT AS lists, count(*) AS vectors FROM embeddings")


def _parts(s, d):
    x = Z.sample(embeddings(s, d))
    at = Z.squared(x, Z.kmeans_local(x, 4, 8)).argmin(1)
    return [x[at == i] for i in range(4) if (at == i).any()]


def _kmeans_1d(s, d, k):
    """Of the first component of all rows: distinct values and their counts go to the driver, 16 bytes each."""
    counted = embeddings(s, d).groupBy(F.element_at("embedding", 1).cast("double").alias("x")).agg(F.count("*").alias("n")).toArrow()
    return Z.kmeans_1d(counted["x"].to_numpy(), k, counted["n"].to_numpy())


def _centres(s, d):
    """Each centre is the mean of the values that are nearest to it, all of the table's rows taken."""
    centres = s.createDataFrame([(i, float(c)) for i, c in enumerate(_kmeans_1d(s, d, 5))], "k int, centre double").agg(F.collect_list(F.struct("k", "centre")).alias("c"))
    x = F.element_at("embedding", 1).cast("double")
    near = F.array_min(F.transform("c", lambda c: F.struct(F.abs(x - c["centre"]).alias("d"), c["k"].alias("k"), c["centre"].alias("centre"))))
    each = embeddings(s, d).crossJoin(F.broadcast(centres)).select(x.alias("x"), near.alias("n")).groupBy(F.col("n.k").alias("k")).agg(F.avg("x").alias("m"), F.first("n.centre").alias("centre"))
    return each.select("k", (F.abs(F.col("m") - F.col("centre")) < 1e-6).alias("is_mean"))


for _id in ("qnt03_kmeans_1d", "qnt42_kmeans_1d_helper"):
    register(_id, _centres, "SELECT range::INT AS k, true AS is_mean FROM range(5)")
register("qnt38_training_sample", lambda s, d: s.createDataFrame([(len(Z.sample(embeddings(s, d), 256)),)], "n long").select(F.col("n").between(180, 340).alias("size_ok")), "SELECT true AS size_ok")


def _turned(make, dims, flat=False):
    """Rows and components out, and whether the transform keeps lengths or, flat, no component is wider than another."""

    def run(s, d):
        model = make(Z.sample(embeddings(s, d)))
        rows = Z.transformed(embeddings(s, d), [model])
        a = model.a @ model.a.T
        fine = bool(np.allclose(a, np.eye(len(a)), atol=1e-6))
        if flat:
            each = rows.select(F.posexplode("embedding").alias("i", "x")).groupBy("i").agg(F.var_pop(F.col("x").cast("double")).alias("v")).agg((F.max("v") <= 1.2 * F.min("v")).alias("ok")).first()
            fine = each["ok"]
        return rows.agg(F.count("*").alias("vectors"), F.max(F.size("embedding")).alias("components")).withColumn("shape_ok", F.lit(fine))

    return run


for _id, _make, _dims, _flat in (
    ("qnt10_random_rotation", lambda x: Z.Linear(Z.rotation(x.shape[1]), np.zeros(x.shape[1])), 64, False), ("qnt11_pca", lambda x: Z.pca(x, 16), 16, False), ("qnt11_pca_whitened", lambda x: Z.pca(x, 16, -0.5, True), 16, True),
    ("qnt12_itq", lambda x: Z.itq(x, 16), 16, False), ("qnt13_opq", lambda x: Z.opq(x, 8), 64, False), ("qnt33_itq_rotation", lambda x: Z.itq(x, 32), 32, False),
):
    register(_id, _turned(_make, _dims, _flat), f"SELECT count(*) AS vectors, {_dims} AS components, true AS shape_ok FROM embeddings")
register("qnt34_inverse_transform", lambda s, d: _there_and_back(s, d), "SELECT vec_id, 0.0::DOUBLE AS error FROM embeddings")


def _there_and_back(s, d):
    chain = [Z.Linear(Z.rotation(64), np.zeros(64))]
    back = Z.transformed(Z.transformed(embeddings(s, d), chain), chain, reverse=True).withColumnRenamed("embedding", "back")
    return embeddings(s, d).join(back, "vec_id").select("vec_id", (F.round(V.l2(F.col("embedding"), F.col("back")), 6) + 0.0).alias("error"))


_CODERS = {
    "qnt17_product": lambda x: Z.ProductQuantizer.fit(x, 8, 16), "qnt25_pq_encode": lambda x: Z.ProductQuantizer.fit(x, 16, 16), "qnt20_residual": lambda x: Z.ResidualQuantizer.fit(x, 4), "qnt21_local_search": lambda x: Z.LocalSearchQuantizer.fit(x, 4),
    "qnt22_product_residual": lambda x: Z.Stacked.fit(Z.ResidualQuantizer, x, 4, m=2), "qnt23_lattice": lambda x: Z.Lattice(4, 14), "idx25_lattice": lambda x: Z.Lattice(8, 10), "idx53_encode": lambda x: Z.ProductQuantizer.fit(x, 4, 16), "qnt19_additive": lambda x: Z.ResidualQuantizer.fit(x, 3, 8),
}


def _coder(make, share, direction=False):
    """Rows, and whether codes keep so much of the table: squared errors at most that share of the spread about the mean;
    direction: whether decoded vectors point the same way, by a mean cosine of at least that share."""

    def run(s, d):
        model = make(Z.sample(embeddings(s, d)))
        back = Z.decoded(Z.coded(embeddings(s, d), model), model).select("vec_id", F.col("embedding").alias("back"))
        met = embeddings(s, d).join(back, "vec_id")
        if direction:
            return met.agg(F.count("*").alias("vectors"), (F.avg(V.metric("cosine")(F.col("embedding"), F.col("back"))) >= share).alias("error_ok"))
        left = met.agg(F.count("*").alias("vectors"), F.sum(V.l2(F.col("embedding"), F.col("back"))).alias("left"))
        return left.crossJoin(_spread(s, d)).select("vectors", (F.col("left") <= share * F.col("spread")).alias("error_ok"))

    return run


_CODED = "SELECT count(*) AS vectors, true AS error_ok FROM embeddings"
for _id, _make in _CODERS.items():
    register(_id, _coder(_make, 0.9, "lattice" in _id), _CODED)
for _id in ("qnt26_pq_decode", "idx54_decode"):
    register(_id, _coder(lambda x: Z.ProductQuantizer.fit(x, 8, 16), 0.9), _CODED)


def _symmetric(s, d):
    tables = Z.ProductQuantizer.fit(Z.sample(embeddings(s, d)), 4, 8).symmetric()
    rows = [(i, bool(np.allclose(t, t.T) and np.allclose(np.diag(t), 0) and (t >= 0).all()), len(t)) for i, t in enumerate(tables)]
    return s.createDataFrame(rows, "slice int, symmetric boolean, codes int")


register("qnt29_pq_symmetric", _symmetric, "SELECT range::INT AS slice, true AS symmetric, 8 AS codes FROM range(4)")
for _id, _dim in (("idx24_lsh", 64), ("idx15_spectral_hash", 32)):
    register(_id, lambda s, d, n=_dim: Z.hash_bits(Z.Linear(Z.rotation(64)[:n], np.zeros(n)) if n == 64 else Z.pca(Z.sample(embeddings(s, d)), n), embeddings(s, d)))
register("dst35_householder", lambda s, d: Z.transformed(embeddings(s, d), [Z.Linear(np.eye(64) - 2 * np.full((64, 64), 1 / 64), np.zeros(64))]).select("vec_id", F.round(V.norm_squared(F.col("embedding")), 5).alias("n")), f"SELECT vec_id, round({ip('embedding', 'embedding')}, 5) AS n FROM embeddings")
register("dst36_orthonormal", lambda s, d: s.createDataFrame([(round(float(np.abs(Z.rotation(64) @ Z.rotation(64).T - np.eye(64)).max()), 9),)], "error double"), "SELECT 0.0::DOUBLE AS error")
register("idx47_code_sizes", lambda s, d: s.createDataFrame([(t, I.parse(t).code_size(64)) for t in ("Flat", "SQ8", "SQ4", "PQ8", "PQ16x4", "IVF8,PQ8", "PCA32,SQ8", "LSH")], "recipe string, bytes long"), "SELECT * FROM (VALUES ('Flat', 256::BIGINT), ('SQ8', 64), ('SQ4', 32), ('PQ8', 8), ('PQ16x4', 8), ('IVF8,PQ8', 16), ('PCA32,SQ8', 32), ('LSH', 8)) t(recipe, bytes)")
register("idx46_index_strings", lambda s, d: s.createDataFrame([(t, str(I.parse(t))) for t in ("IDMap,Flat", "PCA32,IVF10_HNSW32,PQ8+16,RFlat", "IVF4,SQ8")], "recipe string, back string"), "SELECT x AS recipe, x AS back FROM (VALUES ('IDMap,Flat'), ('PCA32,IVF10_HNSW32,PQ8+16,RFlat'), ('IVF4,SQ8')) t(x)")
register("idx45_binary_strings", lambda s, d: s.createDataFrame([(t, *I.parse_binary(t)) for t in ("BFlat", "BIVF16", "BHNSW32", "BHash8")], "recipe string, kind string, n long"), "SELECT * FROM (VALUES ('BFlat', 'Flat', 0::BIGINT), ('BIVF16', 'IVF', 16), ('BHNSW32', 'HNSW', 32), ('BHash8', 'Hash', 8)) t(recipe, kind, n)")
register("idx01_index_contract", lambda s, d: I.Index("Flat").train(embeddings(s, d)).add(embeddings(s, d)).remove_ids(_gone(s, d)).search(queries(s, d), 3).select("qid", "vec_id", "rk"), f"WITH {BASE}, {QUERIES} SELECT qid, vec_id, row_number() OVER (PARTITION BY qid ORDER BY {l2('b.embedding', 'q.qvec')}, vec_id) AS rk FROM queries q, base b WHERE label <> 2 QUALIFY rk <= 3")
