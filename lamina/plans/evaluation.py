"""Evaluation and statistics (AGG19-AGG62)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as E
from ..operators import search as S
from .registry import register
from .tables import BASE, K, QUERIES, base, embeddings, l2, queries

_T = f"truth AS (SELECT qid, vec_id, dist, row_number() OVER (PARTITION BY qid ORDER BY dist, vec_id) AS rk FROM (SELECT qid, vec_id, {l2('b.embedding', 'q.qvec')} AS dist FROM queries q, base b) QUALIFY rk <= {K})"
_R = f"found AS (SELECT qid, vec_id, dist, row_number() OVER (PARTITION BY qid ORDER BY dist, vec_id) AS rk FROM (SELECT qid, vec_id, {l2('b.embedding', 'q.qvec')} AS dist FROM queries q, base b WHERE label % 3 <> 0) QUALIFY rk <= {K})"
_W = f"WITH {BASE}, {QUERIES}, {_T}, {_R}, hit AS (SELECT f.qid, count(t.vec_id) AS hits, count(*) AS m FROM found f LEFT JOIN truth t ON t.qid = f.qid AND t.vec_id = f.vec_id GROUP BY f.qid)"


def truth(s, d):
    return S.knn(base(s, d), queries(s, d), K)


def found(s, d):
    return S.knn(base(s, d), queries(s, d), K, where=F.col("label") % 3 != 0)


def _recall(mode):
    return lambda s, d: E.recall(truth(s, d), found(s, d), K, mode).select("qid", F.round("recall", 6).alias("recall"))


register("agg19_recall_ties", _recall("ties"), f"{_W} SELECT qid, round(100.0::DOUBLE * count_if(round(f.dist, 9) <= lim) / {K}, 6) AS recall FROM found f JOIN (SELECT qid, max(round(dist, 9)) AS lim FROM truth GROUP BY qid) USING (qid) GROUP BY qid")
register("agg20_recall_over_k", _recall("k"), f"{_W} SELECT qid, round(hits / {K}.0::DOUBLE, 6) AS recall FROM hit")
register("agg21_recall_over_truth", _recall("gt"), f"{_W} SELECT qid, round(hits / {K}.0::DOUBLE, 6) AS recall FROM hit")
register("agg22_recall_over_least", _recall("least"), f"{_W} SELECT qid, round(hits / least({K}, m)::DOUBLE, 6) AS recall FROM hit")
register("agg23_mean_and_std", lambda s, d: _recall("gt")(s, d).agg(F.round(F.avg("recall"), 6).alias("mean"), F.round(F.stddev("recall"), 6).alias("std")), f"{_W} SELECT round(avg(r), 6) AS mean, round(stddev(r), 6) AS std FROM (SELECT round(hits / {K}.0::DOUBLE, 6) AS r FROM hit)")
for _id in ("agg24_intersection_measure", "agg31_intersection_at_k"):
    register(_id, lambda s, d: E.intersection(truth(s, d), found(s, d), K).select(F.round("intersection", 6).alias("intersection")), f"{_W} SELECT round(sum(hits) / (count(*) * {K})::DOUBLE, 6) AS intersection FROM hit")
_PAIR = "SELECT x.vec_id, len(list_intersect(x.labels, y.labels))::BIGINT AS n FROM base x JOIN base y ON y.vec_id = x.vec_id + 1"


def _common(s, d):
    nxt = base(s, d).select((F.col("vec_id") - 1).alias("vec_id"), F.col("labels").alias("other"))
    return base(s, d).join(nxt, "vec_id").select("vec_id", F.size(F.array_intersect("labels", "other")).cast("long").alias("n"))


register("agg25_sum_of_intersections", lambda s, d: _common(s, d).agg(F.sum("n").alias("n")), f"WITH {BASE} SELECT sum(n)::BIGINT AS n FROM ({_PAIR})")
register("agg26_list_intersections", _common, f"WITH {BASE} {_PAIR}")


def _ranges(s, d):
    t = S.within(base(s, d), queries(s, d), 1.2)
    r = S.within(base(s, d), queries(s, d), 1.3).where("vec_id % 2 = 0")
    return E.range_counts(t, r)


_RC = (
    f"WITH {BASE}, {QUERIES}, x AS (SELECT qid, vec_id, {l2('b.embedding', 'q.qvec')} AS dist FROM queries q, base b), rc AS (SELECT qid, count_if(dist < 1.2)::BIGINT AS ngt, count_if(dist < 1.3 AND vec_id % 2 = 0)::BIGINT AS nres,"
    " count_if(dist < 1.2 AND vec_id % 2 = 0)::BIGINT AS hits FROM x WHERE dist < 1.2 OR (dist < 1.3 AND vec_id % 2 = 0) GROUP BY qid)"
)
_PR = "round(CASE WHEN nres = 0 THEN 1 ELSE hits::DOUBLE / nres END, 6) AS precision, round(CASE WHEN ngt = 0 THEN (CASE WHEN nres = 0 THEN 1 ELSE 0 END) ELSE hits::DOUBLE / ngt END, 6) AS recall"
register("agg27_range_counts", _ranges, f"{_RC} SELECT * FROM rc")
register("agg27_range_pr_overall", lambda s, d: E.precision_recall(_ranges(s, d).agg(F.sum("ngt").alias("ngt"), F.sum("nres").alias("nres"), F.sum("hits").alias("hits"))).select(F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall")), f"{_RC} SELECT {_PR} FROM (SELECT sum(ngt) AS ngt, sum(nres) AS nres, sum(hits) AS hits FROM rc)")
register("agg28_range_pr", lambda s, d: E.precision_recall(_ranges(s, d)).select("qid", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall")), f"{_RC} SELECT qid, {_PR} FROM rc")


def _thresholds(s, d):
    out = None
    near = S.within(base(s, d), queries(s, d), 1.5)
    for t in (1.0, 1.2, 1.4):
        part = E.precision_recall(E.range_counts(near.where("dist < 1.2"), near.where(F.col("dist") < t)).agg(F.sum("ngt").alias("ngt"), F.sum("nres").alias("nres"), F.sum("hits").alias("hits"))).select(F.lit(t).alias("threshold"), F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))
        out = part if out is None else out.unionByName(part)
    return out


register("agg29_range_pr_thresholds", _thresholds, f"{_RC} SELECT threshold, {_PR} FROM (SELECT t::DOUBLE AS threshold, count_if(dist < 1.2) AS ngt, count_if(dist < t) AS nres, count_if(dist < t AND dist < 1.2) AS hits FROM x, (VALUES (1.0), (1.2), (1.4)) v(t) GROUP BY t)")
register("agg30_one_recall", lambda s, d: E.one_recall(truth(s, d), found(s, d), K), f"{_W} SELECT avg(CASE WHEN f.vec_id IS NULL THEN 0 ELSE 1 END)::DOUBLE AS recall FROM truth t LEFT JOIN found f USING (qid, vec_id) WHERE t.rk = 1")


def points(s, d):
    return embeddings(s, d).select(F.concat(F.lit("p"), "vec_id").alias("name"), F.round(F.abs(F.element_at("embedding", 1).cast("double")), 3).alias("perf"), F.round(F.abs(F.element_at("embedding", 2).cast("double")), 3).alias("t"))


_P = "points AS (SELECT 'p' || vec_id AS name, round(abs(embedding[1]::DOUBLE), 3) AS perf, round(abs(embedding[2]::DOUBLE), 3) AS t FROM embeddings)"
_PAR = "SELECT name, perf, t FROM points a WHERE perf > 0 AND NOT EXISTS (SELECT 1 FROM points b WHERE (b.perf > a.perf AND b.t <= a.t) OR (b.perf = a.perf AND (b.t, b.name) < (a.t, a.name)))"
for _id in ("agg32_pareto", "agg45_merged_operating_points", "gen12_pareto_filter"):
    register(_id, lambda s, d: E.pareto(points(s, d)), f"WITH {_P} {_PAR}")
register("agg33_best_time", lambda s, d: points(s, d).where("perf >= 0.1").agg(F.min("t").alias("t")), f"WITH {_P} SELECT min(t) AS t FROM points WHERE perf >= 0.1")
register("agg34_imbalance", lambda s, d: E.imbalance(embeddings(s, d), "label").select(F.round("imbalance", 8).alias("imbalance")), "SELECT round(count(*) * sum(h * h) / (sum(h) * sum(h))::DOUBLE, 8) AS imbalance FROM (SELECT count(*) AS h FROM embeddings GROUP BY label)")
for _id in ("agg35_histogram", "agg48_list_sizes"):
    register(_id, lambda s, d: embeddings(s, d).groupBy("label").agg(F.count("*").alias("n")), "SELECT label, count(*) AS n FROM embeddings GROUP BY label")
register("agg36_bit_histogram", lambda s, d: embeddings(s, d).select(F.posexplode("embedding").alias("i", "x")).groupBy("i").agg(F.count_if(F.col("x") > 0).alias("n")), "SELECT (i - 1)::INT AS i, count_if(embedding[i] > 0)::BIGINT AS n FROM embeddings, range(1, 65) t(i) GROUP BY i")
register(
    "agg38_matrix_stats",
    lambda s, d: embeddings(s, d).select(F.posexplode("embedding").alias("i", "x")).select("i", F.col("x").cast("double").alias("x")).groupBy("i").agg(F.round(F.min("x"), 6).alias("least"), F.round(F.max("x"), 6).alias("most"), F.round(F.avg("x"), 6).alias("mean"), F.round(F.stddev("x"), 6).alias("std"), F.count_if(F.col("x") == 0).alias("zeros"), F.count_if(F.isnan("x")).alias("nans")),
    "SELECT (i - 1)::INT AS i, round(min(x), 6) AS least, round(max(x), 6) AS most, round(avg(x), 6) AS mean, round(stddev(x), 6) AS std, count_if(x = 0)::BIGINT AS zeros, count_if(isnan(x))::BIGINT AS nans FROM (SELECT i, embedding[i]::DOUBLE AS x FROM embeddings, range(1, 65) t(i)) GROUP BY i",
)
register("agg38_duplicate_vectors", lambda s, d: embeddings(s, d).groupBy("embedding").agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("repeated")), "SELECT count(*) AS repeated FROM (SELECT embedding FROM embeddings GROUP BY embedding HAVING count(*) > 1)")
register("agg39_percentiles", lambda s, d: embeddings(s, d).agg(*[F.round(F.percentile(F.element_at("embedding", 1).cast("double"), p), 6).alias(f"p{int(p * 100)}") for p in (0.5, 0.95, 0.99)]), "SELECT round(quantile_cont(x, 0.5), 6) AS p50, round(quantile_cont(x, 0.95), 6) AS p95, round(quantile_cont(x, 0.99), 6) AS p99 FROM (SELECT embedding[1]::DOUBLE AS x FROM embeddings)")
_RUN = "(SELECT label AS lsearch, abs(embedding[1]::DOUBLE) AS ms, abs(embedding[2]::DOUBLE) AS recall FROM embeddings)"
for _id in ("agg40_run_summary", "agg59_case_summary", "agg60_query_detail_summary", "agg62_build_summary"):
    register(
        _id,
        lambda s, d: embeddings(s, d).select(F.col("label").alias("lsearch"), F.abs(F.element_at("embedding", 1).cast("double")).alias("ms"), F.abs(F.element_at("embedding", 2).cast("double")).alias("recall")).groupBy("lsearch").agg(F.round(F.avg("ms"), 6).alias("mean"), F.round(F.percentile("ms", 0.5), 6).alias("p50"), F.round(F.percentile("ms", 0.95), 6).alias("p95"), F.round(F.percentile("ms", 0.99), 6).alias("p99"), F.round(F.avg("recall"), 6).alias("recall")),
        f"SELECT lsearch, round(avg(ms), 6) AS mean, round(quantile_cont(ms, 0.5), 6) AS p50, round(quantile_cont(ms, 0.95), 6) AS p95, round(quantile_cont(ms, 0.99), 6) AS p99, round(avg(recall), 6) AS recall FROM {_RUN} GROUP BY lsearch",
    )
register(
    "agg41_bucketed_summary",
    lambda s, d: embeddings(s, d).withColumn("bucket", F.when(F.col("label") <= 2, "narrow").when(F.col("label") <= 6, "medium").otherwise("broad")).groupBy("bucket").agg(F.count("*").alias("n"), F.min("vec_id").alias("first")),
    "SELECT CASE WHEN label <= 2 THEN 'narrow' WHEN label <= 6 THEN 'medium' ELSE 'broad' END AS bucket, count(*) AS n, min(vec_id) AS first FROM embeddings GROUP BY ALL",
)
register("agg44_collapse_duplicates", lambda s, d: embeddings(s, d).groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select("ids"), "SELECT list(vec_id ORDER BY vec_id) AS ids FROM embeddings GROUP BY embedding")
register(
    "agg46_compare_knn",
    lambda s, d: truth(s, d).groupBy("qid", F.round("dist", 6).alias("dist")).agg(F.sort_array(F.collect_set("vec_id")).alias("a")).join(found(s, d).groupBy("qid", F.round("dist", 6).alias("dist")).agg(F.sort_array(F.collect_set("vec_id")).alias("b")), ["qid", "dist"], "full").groupBy("qid").agg(F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("different")),
    f"{_W}, a AS (SELECT qid, round(dist, 6) AS dist, list(vec_id ORDER BY vec_id) AS a FROM truth GROUP BY ALL), b AS (SELECT qid, round(dist, 6) AS dist, list(vec_id ORDER BY vec_id) AS b FROM found GROUP BY ALL) SELECT qid, count_if(a IS DISTINCT FROM b)::BIGINT AS different FROM a FULL JOIN b USING (qid, dist) GROUP BY qid",
)
register("agg47_compare_ranges", lambda s, d: S.within(base(s, d), queries(s, d), 1.3).select("qid", "vec_id").exceptAll(S.within(base(s, d), queries(s, d), 1.2).select("qid", "vec_id")), f"{_RC} SELECT qid, vec_id FROM x WHERE dist < 1.3 EXCEPT ALL SELECT qid, vec_id FROM x WHERE dist < 1.2")
register("agg49_one_list", lambda s, d: embeddings(s, d).where("label = 4").select("vec_id"), "SELECT vec_id FROM embeddings WHERE label = 4")
register(
    "agg56_baseline_speedups",
    lambda s, d: embeddings(s, d).withColumn("kind", F.when(F.col("vec_id") % 2 == 0, "new").otherwise("old")).groupBy("label").pivot("kind", ["old", "new"]).agg(F.sum(F.abs(F.element_at("embedding", 1).cast("double")))).select("label", F.round(F.col("old") / F.col("new"), 6).alias("speedup")),
    "SELECT label, round(sum(x) FILTER (vec_id % 2 = 1) / sum(x) FILTER (vec_id % 2 = 0), 6) AS speedup FROM (SELECT label, vec_id, abs(embedding[1]::DOUBLE) AS x FROM embeddings) GROUP BY label",
)
register(
    "agg57_deltas_to_baseline",
    lambda s, d: embeddings(s, d).groupBy("label", (F.col("vec_id") % 3).alias("run")).agg(F.count("*").alias("n")).join(embeddings(s, d).where("vec_id % 3 = 0").groupBy("label").agg(F.count("*").alias("b")), "label").select("label", "run", (F.col("n") - F.col("b")).alias("delta")),
    "SELECT label, run, n - b AS delta FROM (SELECT label, vec_id % 3 AS run, count(*) AS n FROM embeddings GROUP BY ALL) JOIN (SELECT label, count(*) AS b FROM embeddings WHERE vec_id % 3 = 0 GROUP BY label) USING (label)",
)
register("agg61_weighted_ratio", lambda s, d: E.ratio(points(s, d), "perf", "t").select(F.round("ratio", 6).alias("ratio")), f"WITH {_P} SELECT round(sum(perf) / sum(t), 6) AS ratio FROM points")
