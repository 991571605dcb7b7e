"""Distances and vector arithmetic (DST) and exact joins by distance (JON, TOP)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import vector as V
from ..operators import search as S
from .registry import register
from .tables import BASE, K, NESTED, QUERIES, base, bits, embeddings, ip, l2, queries, zipped


def A():
    return F.col("embedding")


def Q():
    return F.col("qvec")


def _all(name, argument=None):
    return lambda s, d: S.pairs(base(s, d), queries(s, d), name, argument).select("qid", "vec_id", F.round("dist", 6).alias("dist"))


_X = "b.embedding"
_SQL = {
    "l2": l2(_X, "q.qvec"),
    "ip": ip(_X, "q.qvec"),
    "l1": zipped(_X, "q.qvec", "abs({x} - {y})"),
    "linf": "list_max(list_transform(list_zip(b.embedding, q.qvec), lambda p: abs(p[1]::DOUBLE - p[2]::DOUBLE)))",
    "lp": zipped(_X, "q.qvec", "pow(abs({x} - {y}), 3)"),
    "canberra": zipped(_X, "q.qvec", "abs({x} - {y}) / (abs({x}) + abs({y}))"),
    "braycurtis": f"{zipped(_X, 'q.qvec', 'abs({x} - {y})')} / {zipped(_X, 'q.qvec', 'abs({x} + {y})')}",
}
for _id, _n, _arg in (("dst03", "l2", None), ("dst04", "ip", None), ("dst05", "l1", None), ("dst06", "linf", None), ("dst07", "lp", 3.0), ("dst08", "canberra", None), ("dst09", "braycurtis", None)):
    register(f"{_id}_{_n}", _all(_n, _arg), f"WITH {BASE}, {QUERIES} SELECT qid, vec_id, round({_SQL[_n]}, 6) AS dist FROM queries q, base b")

_ABS = "list_transform({}, lambda x: abs(x::DOUBLE) + 0.001)"
register(
    "dst10_jensen_shannon",
    lambda s, d: base(s, d).crossJoin(F.broadcast(queries(s, d))).select("qid", "vec_id", F.round(V.jensen_shannon(F.transform(A(), lambda x: F.abs(x.cast("double")) + 0.001), F.transform(Q(), lambda x: F.abs(x.cast("double")) + 0.001)), 6).alias("dist")),
    f"WITH {BASE}, {QUERIES} SELECT qid, vec_id, round(0.5 * "
    + zipped(_ABS.format(_X), _ABS.format("q.qvec"), "(-{x} * ln((({x} + {y}) * 0.5) / {x}) - {y} * ln((({x} + {y}) * 0.5) / {y}))")
    + ", 6) AS dist FROM queries q, base b",
)
register("dst11_pairwise_l2", _all("l2"), f"WITH {BASE}, {QUERIES} SELECT qid, vec_id, round({_SQL['l2']}, 6) AS dist FROM queries q, base b")
register(
    "dst15_one_to_many",
    lambda s, d: S.pairs(base(s, d), queries(s, d).where("qid = 0")).select("vec_id", F.round("dist", 6).alias("dist")),
    f"WITH {BASE}, {QUERIES} SELECT vec_id, round({_SQL['l2']}, 6) AS dist FROM queries q, base b WHERE qid = 0",
)
register(
    "dst14_one_to_many_ip",
    lambda s, d: S.pairs(base(s, d), queries(s, d).where("qid = 0"), "ip").select("vec_id", F.round("dist", 6).alias("dist")),
    f"WITH {BASE}, {QUERIES} SELECT vec_id, round({_SQL['ip']}, 6) AS dist FROM queries q, base b WHERE qid = 0",
)
register(
    "dst16_nearest_other",
    lambda s, d: S.pairs(base(s, d), queries(s, d), where=F.col("vec_id") != F.col("qid")).groupBy("qid").agg(F.min(F.struct("dist", "vec_id")).alias("m")).select("qid", F.col("m.vec_id").alias("vec_id")),
    f"WITH {BASE}, {QUERIES}, x AS (SELECT qid, vec_id, {_SQL['l2']} AS dist FROM queries q, base b WHERE vec_id <> qid) SELECT qid, vec_id FROM x QUALIFY row_number() OVER (PARTITION BY qid ORDER BY dist, vec_id) = 1",
)
register("dst17_norms", lambda s, d: embeddings(s, d).select("vec_id", F.round(V.norm(A()), 6).alias("norm"), F.round(V.norm_squared(A()), 6).alias("norm2")), f"SELECT vec_id, round(sqrt({ip('embedding', 'embedding')}), 6) AS norm, round({ip('embedding', 'embedding')}, 6) AS norm2 FROM embeddings")


def _rounded(column, name="v"):
    return F.transform(column, lambda x: F.round(x, 5) + 0.0).alias(name)


register("dst18_renormalise", lambda s, d: embeddings(s, d).select("vec_id", _rounded(V.normalized(A()))), f"SELECT vec_id, list_transform(embedding, lambda x: round(x::DOUBLE / n, 5) + 0.0::DOUBLE) AS v FROM (SELECT *, sqrt({ip('embedding', 'embedding')}) AS n FROM embeddings)")
register(
    "dst19_ip_to_l2",
    lambda s, d: S.pairs(base(s, d), queries(s, d), "ip").select("qid", "vec_id", F.round(V.ip_to_l2(F.col("dist"), V.norm_squared(A()), V.norm_squared(Q())), 5).alias("dist")),
    f"WITH {BASE}, {QUERIES} SELECT qid, vec_id, round({ip(_X, _X)} + {ip('q.qvec', 'q.qvec')} - 2 * {_SQL['ip']}, 5) AS dist FROM queries q, base b",
)
for _n, _f, _t in (("add", V.add, "p[1]::DOUBLE + p[2]::DOUBLE"), ("subtract", V.subtract, "p[1]::DOUBLE - p[2]::DOUBLE")):
    register(f"dst20_{_n}", lambda s, d, f=_f: embeddings(s, d).select("vec_id", _rounded(f(A(), F.reverse(A())))), f"SELECT vec_id, list_transform(list_zip(embedding, list_reverse(embedding)), lambda p: round({_t}, 5) + 0.0::DOUBLE) AS v FROM embeddings")
register("dst20_add_scalar", lambda s, d: embeddings(s, d).select("vec_id", _rounded(V.add_scalar(A(), 1.5))), "SELECT vec_id, list_transform(embedding, lambda x: round(x::DOUBLE + 1.5, 5) + 0.0::DOUBLE) AS v FROM embeddings")
register("dst21_multiply_add", lambda s, d: embeddings(s, d).select("vec_id", _rounded(V.multiply_add(A(), 0.5, F.reverse(A())))), "SELECT vec_id, list_transform(list_zip(embedding, list_reverse(embedding)), lambda p: round(p[1]::DOUBLE + 0.5 * p[2]::DOUBLE, 5) + 0.0::DOUBLE) AS v FROM embeddings")


def _lists(s, d):
    return queries(s, d).select("qid", F.sequence("qid", F.col("qid") + 20).alias("ids"))


for _id, _n in (("dst22", "ip"), ("dst23", "l2"), ("dst25", "l2")):
    register(
        f"{_id}_{_n}_among_ids",
        lambda s, d, n=_n: S.among(_lists(s, d), base(s, d), queries(s, d), n).select("qid", "vec_id", F.round("dist", 6).alias("dist")),
        f"WITH {BASE}, {QUERIES} SELECT qid, vec_id, round({_SQL[_n]}, 6) AS dist FROM queries q JOIN base b ON vec_id BETWEEN qid AND qid + 20",
    )
register(
    "dst24_indexed_pairs",
    lambda s, d: embeddings(s, d).select((F.col("vec_id") + 1).alias("other"), F.col("embedding").alias("left"), F.col("vec_id").alias("a")).join(embeddings(s, d), F.col("other") == F.col("vec_id")).select("a", F.col("vec_id").alias("b"), F.round(V.l2(F.col("left"), A()), 6).alias("dist")),
    f"SELECT x.vec_id AS a, y.vec_id AS b, round({l2('x.embedding', 'y.embedding')}, 6) AS dist FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1",
)


def centroids(s, d):
    """The mean vector of each label: (list_no, centroid)."""
    each = embeddings(s, d).select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return each.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda t: t["m"]).alias("centroid")).withColumnRenamed("label", "list_no")


CENTROIDS = (
    "cent AS (SELECT list_no, list(m ORDER BY i) AS centroid FROM (SELECT label AS list_no, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) t(i) GROUP BY label, i) GROUP BY list_no)"
)
for _id in ("dst27_residual", "idx55_residual"):
    register(
        _id,
        lambda s, d: embeddings(s, d).join(centroids(s, d), F.col("label") == F.col("list_no")).select("vec_id", F.transform(V.subtract(A(), F.col("centroid")), lambda x: F.round(x, 4) + 0.0).alias("v")),
        f"WITH {CENTROIDS} SELECT vec_id, list_transform(list_zip(embedding, centroid), lambda p: round(p[1]::DOUBLE - p[2], 4) + 0.0::DOUBLE) AS v FROM embeddings JOIN cent ON label = list_no",
    )

_HAM = "len(list_filter(list_zip(b.embedding, q.qvec), lambda p: (p[1] > 0) <> (p[2] > 0)))::BIGINT"


def _hamming(s, d):
    return bits(base(s, d)).join(F.broadcast(bits(queries(s, d), "qvec", "qbits"))).select("qid", "vec_id", V.hamming(F.col("bits"), F.col("qbits")).alias("dist"))


_H = f"WITH {BASE}, {QUERIES}, ham AS (SELECT qid, vec_id, {_HAM} AS dist FROM queries q, base b)"
register("dst28_hamming", _hamming, f"{_H} SELECT * FROM ham")
register("dst29_hamming_all_pairs", _hamming, f"{_H} SELECT * FROM ham")
register("dst30_hamming_count", lambda s, d: _hamming(s, d).groupBy("qid").agg(F.count_if(F.col("dist") <= 28).alias("n")), f"{_H} SELECT qid, count_if(dist <= 28)::BIGINT AS n FROM ham GROUP BY qid")
register("dst31_hamming_matches", lambda s, d: _hamming(s, d).where("dist <= 28"), f"{_H} SELECT * FROM ham WHERE dist <= 28")
register("dst32_hamming_self_count", lambda s, d: _hamming(s, d).where("dist <= 28 and vec_id > qid").agg(F.count("*").alias("n")), f"{_H} SELECT count(*) AS n FROM ham WHERE dist <= 28 AND vec_id > qid")
register("dst34_permute", lambda s, d: embeddings(s, d).select("vec_id", _rounded(V.remap(A(), list(range(63, -1, -1))))), "SELECT vec_id, list_transform(list_reverse(embedding), lambda x: round(x::DOUBLE, 5) + 0.0::DOUBLE) AS v FROM embeddings")
register("jon16_hamming_knn", lambda s, d: S.ranked(_hamming(s, d), K), f"{_H} SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, vec_id) AS rk FROM ham QUALIFY rk <= {K}")
register("jon17_hamming_knn_counting", lambda s, d: S.ranked(_hamming(s, d), 25), f"{_H} SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, vec_id) AS rk FROM ham QUALIFY rk <= 25")
for _id in ("jon18_hamming_range", "idx57_binary_range"):
    register(_id, lambda s, d: _hamming(s, d).where("dist < 26"), f"{_H} SELECT * FROM ham WHERE dist < 26")


def _out(found):
    return found.select("qid", "vec_id", F.col("rk"), F.round("dist", 6).alias("dist"))


def _top(sql, order="dist", k=K, extra="", pre=BASE, where="true"):
    return f"WITH {pre}, {QUERIES}{extra}, x AS (SELECT qid, vec_id, {sql} AS dist FROM queries q JOIN base b ON {where}) SELECT qid, vec_id, row_number() OVER (PARTITION BY qid ORDER BY {order}, vec_id) AS rk, round(dist, 6) AS dist FROM x QUALIFY rk <= {k}"


for _sc, _on in (("containment", "list_has_all(b.labels, q.qlabels)"), ("overlap", "list_has_any(b.labels, q.qlabels)"), ("equality", "b.labels = q.qlabels"), ("nofilter", "true")):
    register(f"jon01_filtered_knn_{_sc}", lambda s, d, sc=_sc: _out(S.filtered_knn(base(s, d), queries(s, d), K, sc)), _top(_SQL["l2"], where=_on))
register("jon02_filtered_knn_by_label_set", lambda s, d: _out(S.filtered_knn(base(s, d, True), queries(s, d), K, "containment")), _top(_SQL["l2"], pre=NESTED, where="list_has_all(b.labels, q.qlabels)"))
register(
    "jon03_padded_scan",
    lambda s, d: S.pad(S.filtered_knn(base(s, d), queries(s, d), 60, "containment"), queries(s, d), 60).select("qid", "rk", "vec_id", F.round("dist", 6).alias("dist")),
    f"WITH {BASE}, {QUERIES}, x AS (SELECT qid, vec_id, {_SQL['l2']} AS dist FROM queries q JOIN base b ON list_has_all(b.labels, q.qlabels)), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, vec_id) AS rk FROM x)"
    " SELECT q.qid, t.rk, coalesce(vec_id, -1) AS vec_id, coalesce(round(dist, 6), -1.0::DOUBLE) AS dist FROM queries q CROSS JOIN range(1, 61) t(rk) LEFT JOIN r ON r.qid = q.qid AND r.rk = t.rk",
)
register("jon04_knn_l2", lambda s, d: _out(S.knn(base(s, d), queries(s, d), K)), _top(_SQL["l2"]))
register("jon04_knn_l2_selector", lambda s, d: _out(S.knn(base(s, d), queries(s, d), K, where=(F.col("vec_id") >= 30) & (F.col("vec_id") < 300))), _top(_SQL["l2"], where="vec_id >= 30 AND vec_id < 300"))
register("jon05_knn_ip", lambda s, d: _out(S.knn(base(s, d), queries(s, d), K, "ip")), _top(_SQL["ip"], "dist DESC"))
for _n, _arg in (("l1", None), ("linf", None), ("lp", 3.0), ("canberra", None), ("braycurtis", None)):
    register(f"jon06_knn_{_n}", lambda s, d, n=_n, a=_arg: _out(S.knn(base(s, d), queries(s, d), K, n, a)), _top(_SQL[_n]))
register("jon06_knn_cosine", lambda s, d: _out(S.knn(base(s, d), queries(s, d), K, "cosine")), _top(f"{_SQL['ip']} / (sqrt({ip(_X, _X)}) * sqrt({ip('q.qvec', 'q.qvec')}))", "dist DESC"))
register("jon07_knn_among_lists", lambda s, d: _out(S.ranked(S.among(_lists(s, d), base(s, d), queries(s, d)), 5)), _top(_SQL["l2"], k=5, where="vec_id BETWEEN qid AND qid + 20"))
register("jon08_knn_python", lambda s, d: _out(S.knn(base(s, d), queries(s, d), 3, "l1")), _top(_SQL["l1"], k=3))
register(
    "jon09_blocked_knn",
    lambda s, d: _out(S.merge([S.knn(base(s, d).where(F.col("vec_id") % 4 == i), queries(s, d), K) for i in range(4)], K)),
    _top(_SQL["l2"]),
)
register("jon10_range_l2", lambda s, d: S.within(base(s, d), queries(s, d), 1.2).select("qid", "vec_id", F.round("dist", 6).alias("dist")), f"WITH {BASE}, {QUERIES}, x AS (SELECT qid, vec_id, {_SQL['l2']} AS dist FROM queries q, base b) SELECT qid, vec_id, round(dist, 6) AS dist FROM x WHERE dist < 1.2")
register("jon11_range_ip", lambda s, d: S.within(base(s, d), queries(s, d), 0.4, "ip").select("qid", "vec_id", F.round("dist", 6).alias("dist")), f"WITH {BASE}, {QUERIES}, x AS (SELECT qid, vec_id, {_SQL['ip']} AS dist FROM queries q, base b) SELECT qid, vec_id, round(dist, 6) AS dist FROM x WHERE dist > 0.4")
register("jon12_range_l1", lambda s, d: S.within(base(s, d), queries(s, d), 8.0, "l1").select("qid", "vec_id", F.round("dist", 6).alias("dist")), f"WITH {BASE}, {QUERIES}, x AS (SELECT qid, vec_id, {_SQL['l1']} AS dist FROM queries q, base b) SELECT qid, vec_id, round(dist, 6) AS dist FROM x WHERE dist < 8")
for _id in ("jon13_range_capped", "jon14_range_cut"):
    register(
        _id,
        lambda s, d: S.capped_radius(S.within(base(s, d), queries(s, d), 1.6), 40).select("qid", "vec_id", F.round("dist", 6).alias("dist")),
        f"WITH {BASE}, {QUERIES}, x AS (SELECT qid, vec_id, {_SQL['l2']} AS dist FROM queries q, base b), r AS (SELECT * FROM x WHERE dist < 1.6), c AS (SELECT dist AS cut FROM r ORDER BY dist LIMIT 1 OFFSET 40) SELECT qid, vec_id, round(dist, 6) AS dist FROM r LEFT JOIN c ON true WHERE cut IS NULL OR dist < cut",
    )
for _id in ("jon15_range_restrict", "set09_filter_range"):
    register(_id, lambda s, d: S.within(base(s, d), queries(s, d), 1.6).where("dist < 1.1").select("qid", "vec_id"), f"WITH {BASE}, {QUERIES} SELECT qid, vec_id FROM queries q, base b WHERE {_SQL['l2']} < 1.1")
register(
    "jon31_sparse_assign",
    lambda s, d: _sparse(s, d),
    f"WITH {CENTROIDS}, x AS (SELECT vec_id, c.list_no, sum(CASE WHEN i % 3 = 1 THEN embedding[i]::DOUBLE ELSE 0 END * centroid[i]) AS ip FROM embeddings, cent c, range(1, 65) t(i) GROUP BY ALL) SELECT vec_id, list_no FROM x QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(ip, 6) DESC, list_no) = 1",
)


def _sparse(s, d):
    sparse = embeddings(s, d).select("vec_id", F.posexplode("embedding").alias("i", "x")).where("i % 3 = 0")
    parts = centroids(s, d).select("list_no", F.posexplode("centroid").alias("i", "m"))
    found = sparse.join(F.broadcast(parts), "i").groupBy("vec_id", "list_no").agg(F.round(F.sum(F.col("x").cast("double") * F.col("m")), 6).alias("dist"))
    return S.ranked(found, 1, by="vec_id", id_col="list_no", similarity=True).select("vec_id", "list_no")


register("top01_ordered_queue", lambda s, d: S.ranked(S.pairs(base(s, d), queries(s, d)).select("qid", "vec_id", "dist").unionAll(S.pairs(base(s, d), queries(s, d)).select("qid", "vec_id", "dist")).dropDuplicates(["qid", "vec_id"]), 20).select("qid", "vec_id", "rk"), f"WITH {BASE}, {QUERIES} SELECT qid, vec_id, row_number() OVER (PARTITION BY qid ORDER BY {_SQL['l2']}, vec_id) AS rk FROM queries q, base b QUALIFY rk <= 20")
for _id, _big in (("top05_k_smallest", False), ("top06_k_largest", True)):
    register(
        _id,
        lambda s, d, b=_big: embeddings(s, d).select("vec_id", F.transform(S.smallest(A(), 5, b), lambda t: t["pos"].cast("long")).alias("pos")),
        f"SELECT vec_id, list(i - 1 ORDER BY r) AS pos FROM (SELECT vec_id, i, row_number() OVER (PARTITION BY vec_id ORDER BY embedding[i] {'DESC' if _big else 'ASC'}, i) AS r FROM embeddings, range(1, 65) t(i) QUALIFY r <= 5) GROUP BY vec_id",
    )
register("top08_merge_results", lambda s, d: _out(S.merge([S.knn(base(s, d).where("vec_id % 2 = 0"), queries(s, d), K), S.knn(base(s, d).where("vec_id % 2 = 1"), queries(s, d), K)], K)), _top(_SQL["l2"]))
register("top11_nth_element", lambda s, d: embeddings(s, d).groupBy("label").agg(F.round(F.percentile(F.element_at("embedding", 1).cast("double"), 0.5), 6).alias("median")), "SELECT label, round(quantile_cont(embedding[1]::DOUBLE, 0.5), 6) AS median FROM embeddings GROUP BY label")
register(
    "top12_argsort",
    lambda s, d: embeddings(s, d).select("label", "vec_id", F.row_number().over(Window.partitionBy("label").orderBy(F.element_at("embedding", 1), "vec_id")).cast("long").alias("place")),
    "SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY embedding[1], vec_id) AS place FROM embeddings",
)
register("top13_bucket_sort", lambda s, d: embeddings(s, d).groupBy("label").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "SELECT label, list(vec_id ORDER BY vec_id) AS ids FROM embeddings GROUP BY label")
register("top14_matrix_bucket_sort", lambda s, d: base(s, d).select(F.explode("labels").alias("label"), "vec_id").groupBy("label").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), f"WITH {BASE} SELECT l AS label, list(vec_id ORDER BY vec_id) AS ids FROM (SELECT unnest(labels) AS l, vec_id FROM base) GROUP BY l")
register(
    "top15_canonical_ties",
    lambda s, d: S.ranked(_hamming(s, d).withColumn("dist", F.floor(F.col("dist") / 4)), K),
    f"{_H}, t AS (SELECT qid, vec_id, (dist // 4)::BIGINT AS dist FROM ham) SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, vec_id) AS rk FROM t QUALIFY rk <= {K}",
)
register(
    "top16_sorted_filtered",
    lambda s, d: _out(S.filtered_knn(base(s, d), queries(s, d), 1_000_000_000, "containment")),
    _top(_SQL["l2"], k=1_000_000_000, where="list_has_all(b.labels, q.qlabels)"),
)
register(
    "top17_sorted_range",
    lambda s, d: S.within(base(s, d), queries(s, d), 1.2).select("qid", "vec_id", F.row_number().over(Window.partitionBy("qid").orderBy("vec_id")).cast("long").alias("place")),
    f"WITH {BASE}, {QUERIES} SELECT qid, vec_id, row_number() OVER (PARTITION BY qid ORDER BY vec_id) AS place FROM queries q, base b WHERE {_SQL['l2']} < 1.2",
)
register("top20_refine", lambda s, d: _out(S.refine(S.ranked(_hamming(s, d), 40), base(s, d), queries(s, d), K)), f"{_H}, c AS (SELECT qid, vec_id FROM ham QUALIFY row_number() OVER (PARTITION BY qid ORDER BY dist, vec_id) <= 40), x AS (SELECT q.qid, b.vec_id, {_SQL['l2']} AS dist FROM c JOIN queries q USING (qid) JOIN base b ON b.vec_id = c.vec_id) SELECT qid, vec_id, row_number() OVER (PARTITION BY qid ORDER BY dist, vec_id) AS rk, round(dist, 6) AS dist FROM x QUALIFY rk <= {K}")
for _id in ("top21_one_dimensional", "idx03_flat_1d"):
    register(_id, lambda s, d: _out(S.ranked(S.pairs(base(s, d), queries(s, d)).select("qid", "vec_id", F.abs(F.element_at(A(), 1).cast("double") - F.element_at(Q(), 1).cast("double")).alias("dist")), K)), _top("abs(b.embedding[1]::DOUBLE - q.qvec[1]::DOUBLE)"))
for _id in ("top22_split_vectors", "idx32_split_vectors"):
    register(
        _id,
        lambda s, d: _out(S.ranked(S.pairs(base(s, d), queries(s, d)).select("qid", "vec_id", (V.l2(F.slice(A(), 1, 32), F.slice(Q(), 1, 32)) + V.l2(F.slice(A(), 33, 32), F.slice(Q(), 33, 32))).alias("dist")), K)),
        _top(_SQL["l2"]),
    )
