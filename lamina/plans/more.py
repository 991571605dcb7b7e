"""File round trips, further forms of earlier operators, and the remaining kernels."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import vector as V
from ..operators import generate as N
from ..operators import graph as R
from ..operators import groups as G
from ..operators import index as I
from ..operators import kernels as W
from ..operators import predicates as P
from ..operators import quantize as Z
from ..operators import search as S
from ..sources import vectors as X
from .graphs import _CROSS, _cross, grouped, member
from .indexes import _clusters, _clusters_sql, _member, _recalled, _totals, _vectors_sql
from .registry import QUERIES, register
from .tables import BASE, GROUPS, K, NESTED, QUERIES as ASKED, base, embeddings, ip, l2, queries


def _folder(spark) -> str:
    """A new folder where driver and executors share files, or a temporary one in local runs."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    path = f"{shared.removeprefix('file:').replace('//', '/')}/lamina-files/{uuid.uuid4().hex}" if shared else tempfile.mkdtemp(prefix="lamina-")
    if not shared or "://" not in shared.removeprefix("file://"):
        os.makedirs(path, exist_ok=True)
    return path


def _vectors(kind):
    def run(s, d):
        rows = embeddings(s, d)
        if kind in ("ivecs", "bvecs"):
            rows = rows.select("vec_id", F.transform("embedding", lambda x: F.floor(F.abs(x) * F.lit(100).cast("float")).cast("float")).alias("embedding"))
        path = f"{_folder(s)}/v.{kind}"
        X.write_vectors(rows, path, kind)
        return X.read_vectors(s, path, kind).select("vec_id", F.round(V.norm_squared(F.col("embedding")), 5).alias("n"))

    return run


_WHOLE = "list_transform(embedding, lambda x: floor(abs(x) * 100))"
for _id, _kind in (("src01_headered_vectors", "bin"), ("src04_fvecs_to_bin", "fvecs"), ("src05_ivecs", "ivecs"), ("src05_bvecs", "bvecs"), ("src06_fvecs_writer", "fvecs"), ("src07_fvecs_writer_streamed", "fvecs")):
    _v = _WHOLE if _kind in ("ivecs", "bvecs") else "embedding"
    register(_id, _vectors(_kind), f"SELECT vec_id, round({ip(_v, _v)}, 5) AS n FROM embeddings ORDER BY vec_id")


def _labels(s, d):
    path = f"{_folder(s)}/labels"
    X.write_labels(base(s, d, True).select("vec_id", "labels"), path)
    return X.read_labels(s, path)


for _id in ("src08_label_text", "src26_multi_label_text"):
    register(_id, _labels, f"WITH {NESTED} SELECT vec_id, labels FROM base")


def _truth(s, d):
    path = f"{_folder(s)}/gt.bin"
    X.write_ground_truth(S.knn(base(s, d), queries(s, d), 5), path, 5)
    return X.read_ground_truth(s, path, 5).select("query", "rk", "vec_id")


for _id in ("src09_ground_truth_writer", "src10_ground_truth_reader"):
    register(_id, _truth, f"WITH {BASE}, {ASKED} SELECT qid // 100 AS query, row_number() OVER (PARTITION BY qid ORDER BY {l2('b.embedding', 'q.qvec')}, vec_id) AS rk, vec_id FROM queries q, base b QUALIFY rk <= 5")


def _saved(table, *columns):
    def run(s, d):
        path = f"{_folder(s)}/index"
        g = grouped(s, d)
        X.save_index({"groups": g, "edges": G.lng_edges(g), "vectors": base(s, d, True), "postings": base(s, d, True).select(F.explode("labels").alias("label"), "vec_id")}, path, {"metric": "l2"})
        return X.load_index(s, path)[0][table].select(*columns)

    return run


_G = f"WITH {NESTED}, {GROUPS} SELECT group_id, group_size FROM groups"
for _id in ("src16_save_index", "src17_load_index", "src28_write_index", "src29_read_index", "src30_transform_tables"):
    register(_id, _saved("groups", "group_id", "group_size"), _G)
for _id in ("src15_bipartite_graph_load", "src24_inverted_index_load"):
    register(_id, _saved("postings", "label", "vec_id"), f"WITH {NESTED} SELECT unnest(labels) AS label, vec_id FROM base")
for _id in ("src22_graph_tables",):
    register(_id, _saved("edges", "parent", "child"), dict(QUERIES)["jon23_containment_graph"][1])


def _blocks(s, d):
    path = f"{_folder(s)}/blocks"
    X.save_index({"blocks": G.special_blocks(grouped(s, d), 20)}, path, {"threshold": 20})
    return X.load_index(s, path)[0]["blocks"]


for _id in ("src20_save_blocks", "src21_load_blocks"):
    register(_id, _blocks, QUERIES["agg16_special_blocks"][1])


def _settings(s, d):
    path = f"{_folder(s)}/kv"
    s.createDataFrame([("vectors=500",), ("metric=l2",)], "value string").coalesce(1).write.text(path)
    return s.createDataFrame(sorted(X.read_key_values(s, path).items()), "k string, v string")


register("src11_key_values", _settings, "SELECT * FROM (VALUES ('vectors', '500'), ('metric', 'l2')) t(k, v)")
register("src25_json_vectors", lambda s, d: embeddings(s, d).select("vec_id", F.from_json(F.to_json("embedding"), "array<double>").alias("v")).select("vec_id", F.size("v").cast("long").alias("n")), "SELECT vec_id, len(embedding) AS n FROM embeddings")


def _csv(make, schema):
    def run(s, d):
        path = f"{_folder(s)}/csv"
        make(s, d).write.csv(path, header=True)
        return s.read.csv(path, header=True, schema=schema)

    return run


register("src27_distance_dump", _csv(lambda s, d: S.pairs(base(s, d), queries(s, d)).select("qid", "vec_id", F.round("dist", 6).alias("dist")), "qid long, vec_id long, dist double"), f"WITH {BASE}, {ASKED} SELECT qid, vec_id, round({l2('b.embedding', 'q.qvec')}, 6) AS dist FROM queries q, base b")
for _id, _of, _schema in (("src38_result_csv", "agg40_run_summary", "lsearch int, mean double, p50 double, p95 double, p99 double, recall double"), ("src39_feature_csv", "rte04_selector_features", "qid long, f1 double, f2 long, f3 double")):
    register(_id, _csv(QUERIES[_of][0], _schema), QUERIES[_of][1])
register("src35_dataset", lambda s, d: embeddings(s, d).agg(F.count("*").alias("database")).crossJoin(queries(s, d).agg(F.count("*").alias("queries"))), f"WITH {ASKED} SELECT (SELECT count(*) FROM embeddings) AS database, (SELECT count(*) FROM queries) AS queries")

# --- further forms ----------------------------------------------------------------------------------------------------

for _id, _of in (
    ("flt07_recursive_lookup", "flt05_min_super_sets"), ("flt28_selector_pushdown", "jon04_knn_l2_selector"), ("dst01_squared_l2", "dst03_l2"), ("dst12_pairwise_l1", "dst05_l1"), ("dst13_pairwise_python", "dst06_linf"), ("dst26_all_distances", "dst11_pairwise_l2"),
    ("top07_incremental_heap", "jon09_blocked_knn"), ):
    register(_id, *QUERIES[_of])
register("flt19_predicate_search", lambda s, d: S.knn(base(s, d), queries(s, d), K, where=P.metadata("OR", F.call_function("shiftleft", F.lit(1), F.col("label") % 8), 6)).select("qid", "vec_id", "rk"), f"WITH {BASE}, {ASKED} SELECT qid, vec_id, row_number() OVER (PARTITION BY qid ORDER BY {l2('b.embedding', 'q.qvec')}, vec_id) AS rk FROM queries q, base b WHERE ((1 << (label % 8)) & 6) <> 0 QUALIFY rk <= {K}")


def _supported(s, d):
    rows = []
    for name in (*V.METRICS, "chebyshev"):
        try:
            V.metric(name, 2.0 if name == "lp" else None)
            rows.append((name, True))
        except ValueError:
            rows.append((name, False))
    return s.createDataFrame(rows, "metric string, supported boolean")


register("dst02_supported_metrics", _supported, "SELECT m AS metric, m <> 'chebyshev' AS supported FROM (VALUES ('l2'), ('ip'), ('cosine'), ('l1'), ('linf'), ('lp'), ('canberra'), ('braycurtis'), ('jensenshannon'), ('chebyshev')) t(m)")
register("grf01_build", lambda s, d: grouped(s, d).agg(F.count("*").alias("groups")).crossJoin(_cross(s, d).agg(F.count("*").alias("cross_edges"))), f"{_CROSS} SELECT (SELECT count(*) FROM groups) AS groups, (SELECT count(*) FROM kept) AS cross_edges")


def _sweep(s, d):
    out = None
    for width, least in ((10, 0.5), (20, 0.8), (40, 0.9)):
        part = _recalled(lambda s_, d_, w=width: W.graph_search(_member(s_, d_), queries(s_, d_), K, w))(s, d).agg((F.avg("recall") >= least).alias("recall_ok")).withColumn("width", F.lit(width))
        out = part if out is None else out.unionByName(part)
    return out


for _id in ("rte14_parameter_sweep", "gen13_parameter_space"):
    register(_id, _sweep, "SELECT * FROM (VALUES (10, true), (20, true), (40, true)) t(width, recall_ok)")


def _batched(s, d):
    def count(frames):
        for frame in frames:
            yield pd.DataFrame({"n": [len(frame)], "total": [int(frame["vec_id"].sum())]})

    return embeddings(s, d).select("vec_id").mapInPandas(count, "n long, total long").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


register("str02_block_iterator", _batched, "SELECT count(*) AS n, sum(vec_id)::BIGINT AS total FROM embeddings")


def _compatible(s, d):
    rows = []
    for a, b in (("IVF8,Flat", "IVF8,Flat"), ("IVF8,Flat", "IVF4,Flat")):
        try:
            x, y = (I.Index(t) for t in (a, b))
            x.rows = x.raw = y.rows = y.raw = embeddings(s, d)
            x.merge_from(y)
            rows.append((a, b, True))
        except ValueError:
            rows.append((a, b, False))
    return s.createDataFrame(rows, "a string, b string, fits boolean")


register("set12_merge_compatibility", _compatible, "SELECT * FROM (VALUES ('IVF8,Flat', 'IVF8,Flat', true), ('IVF8,Flat', 'IVF4,Flat', false)) t(a, b, fits)")
register("set03_subset_fraction", lambda s, d: I.subset(embeddings(s, d), "fraction", 1, 2).select("vec_id"), f"SELECT vec_id FROM embeddings WHERE {N.draw_sql(0, 'vec_id')} * 2 < 1")

# --- kernels and training ----------------------------------------------------------------------------------------------

register("jon27_cross_edges_exact", lambda s, d: _cross(s, d).select("src", "dst"), f"{_CROSS} SELECT src, dst FROM kept")


def _augmented(s, d):
    """Edges to the nearest of a seeded tenth of all vectors, at most 8 into each."""
    some = embeddings(s, d).where(N.draw(3, F.col("vec_id")) < 0.1).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    near = S.nearest_others(embeddings(s, d), some, 2)
    return near.withColumn("place", F.row_number().over(Window.partitionBy("dst").orderBy("dist", "src"))).where("place <= 8").select("src", "dst")


register(
    "grf32_augmenting_edges",
    _augmented,
    f"WITH s AS (SELECT vec_id AS qid, embedding AS qvec FROM embeddings WHERE {N.draw_sql(3, 'vec_id')} < 0.1), n AS (SELECT vec_id AS src, qid AS dst, {l2('embedding', 'qvec')} AS dist FROM embeddings, s WHERE vec_id <> qid QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY dist, qid) <= 2)"
    " SELECT src, dst FROM n QUALIFY row_number() OVER (PARTITION BY dst ORDER BY dist, src) <= 8",
)


def _levels(s, d):
    rate = 1 / np.log(8)
    level = F.floor(-F.ln(F.greatest(N.draw(1, F.col("vec_id")), F.lit(1e-9))) * F.lit(float(rate))).cast("int")
    return embeddings(s, d).select("vec_id", level.alias("level"))


_LEVEL = f"SELECT vec_id, floor(-ln(greatest({N.draw_sql(1, 'vec_id')}, 1e-9::DOUBLE)) * {float(1 / np.log(8))!r}::DOUBLE)::INT AS level FROM embeddings"
register("grf40_levels", _levels, _LEVEL)
register("grf41_level_sizes", lambda s, d: _levels(s, d).groupBy("level").agg(F.count("*").alias("n")).withColumn("degree", F.when(F.col("level") == 0, 16 + 12).otherwise(8 * 4)), f"SELECT level, count(*) AS n, (CASE WHEN level = 0 THEN 28 ELSE 32 END)::INT AS degree FROM ({_LEVEL}) GROUP BY level")
register("gen19_bench_vectors", _totals(1000, 256, "normal"), _vectors_sql(1000, 256, "normal"))


def _decoded_means(s, d):
    model = Z.ProductQuantizer.fit(Z.sample(embeddings(s, d)), 8, 16)
    return Z.kmeans(Z.decoded(Z.coded(embeddings(s, d), model), model), 8)


register("qnt02_kmeans_on_codes", _clusters(_decoded_means), _clusters_sql(8))


def _progressive(s, d):
    """Clusters found in ever more principal components, each start taken from the one before; then refined over all rows."""
    x = Z.sample(embeddings(s, d))
    turn = Z.pca(x, x.shape[1])
    y = turn.apply(x)
    at = None
    for dims in (8, 32, x.shape[1]):
        z = np.pad(y[:, :dims], ((0, 0), (0, x.shape[1] - dims)))
        c = Z.kmeans_local(z, 8, 6) if at is None else np.stack([z[at == i].mean(0) if (at == i).any() else z[i] for i in range(8)])
        for _ in range(4):
            at = Z.squared(z, c).argmin(1)
            c = np.stack([z[at == i].mean(0) if (at == i).any() else c[i] for i in range(8)])
    return turn.reverse(c)


register("qnt04_progressive_clusters", _clusters(_progressive, True), _clusters_sql(8))
register("qnt39_collapsed_centroids", _clusters(lambda s, d: Z._split_empty(np.concatenate([Z.kmeans_local(Z.sample(embeddings(s, d)), 7, 5), np.zeros((1, 64))]), np.array([80.0] * 7 + [0.0]))), _clusters_sql(8))
register("qnt30_quantizer_contract", *QUERIES["qnt26_pq_decode"])


def _coarse(s, d):
    """Lists by a residual code: two steps of eight."""
    codes = Z.coded(embeddings(s, d), Z.ResidualQuantizer.fit(Z.sample(embeddings(s, d)), 2, 8)).select("vec_id", (F.col("codes")[0] * 8 + F.col("codes")[1]).alias("list_no"))
    return codes.agg(F.count("*").alias("vectors"), F.every(F.col("list_no").between(0, 63)).alias("lists_ok"), (F.count_distinct("list_no") > 16).alias("spread_ok"))


register("idx22_residual_coarse", _coarse, "SELECT count(*) AS vectors, true AS lists_ok, true AS spread_ok FROM embeddings")


def _binary_graph(s, d):
    signs = _member(s, d).withColumn("embedding", F.transform("embedding", lambda x: F.when(x > 0, 1.0).otherwise(0.0).cast("float")))
    asked = queries(s, d).withColumn("qvec", F.transform("qvec", lambda x: F.when(x > 0, 1.0).otherwise(0.0).cast("float")))
    found = W.graph_search(signs, asked, K, 64, "hnsw").groupBy("qid").agg(F.sum("dist").alias("met"))
    exact = S.knn(signs, asked, K).groupBy("qid").agg(F.sum("dist").alias("least"))
    return exact.join(found, "qid", "left").agg(F.count("*").alias("queries"), (F.sum("met") <= 1.05 * F.sum("least")).alias("near_ok"))


register("idx37_binary_graph", _binary_graph, f"WITH {ASKED} SELECT count(*) AS queries, true AS near_ok FROM queries")
