"""Exact nearest-neighbour, radius and top-k operators.

Queries are few and base vectors many: queries are taken in blocks of a checked size, each block goes to all tasks, and
a numpy kernel reduces every batch of base vectors to its k best for each query before anything is shuffled. A final
window ranks what is left, so at most tasks * k rows for each query move.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vector import SIMILARITIES, metric

#: Components of query vectors that are sent to all tasks at a time (8 bytes each).
BLOCK_VALUES = 4_000_000
#: Pairs of a label set and a query that are sent to all tasks at most (about 100 bytes each); beyond, rows with one label
#: set are dealt over SALTS tasks.
MOST_SETS, SALTS = 200_000, 16


def ranked(pairs: DataFrame, k: int, *, by: str = "qid", id_col: str = "vec_id", dist: str = "dist", similarity: bool = False) -> DataFrame:
    """The k best of each query by (distance, id), with their rank rk from 1."""
    order = F.col(dist).desc() if similarity else F.col(dist).asc()
    window = Window.partitionBy(by).orderBy(order, F.col(id_col))
    return pairs.withColumn("rk", F.row_number().over(window).cast("long")).where(F.col("rk") <= k)


def pad(results: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """qid, rk, vec_id, dist with exactly k rows for each query; missing ones have id and distance -1."""
    slots = queries.select("qid", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("n")).select("qid", F.col("n").cast("long").alias("rk"))
    return slots.join(results, ["qid", "rk"], "left").select("qid", "rk", F.coalesce("vec_id", F.lit(-1)).alias("vec_id"), F.coalesce("dist", F.lit(-1.0)).alias("dist"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _distances(x: np.ndarray, q: np.ndarray, name: str) -> np.ndarray:
    """len(x) by len(q), by direct differences in double."""
    if name == "ip":
        return x @ q.T
    out = np.empty((len(x), len(q)))
    for j in range(len(q)):
        diff = x - q[j]
        out[:, j] = np.einsum("nd,nd->n", diff, diff) if name == "l2" else np.abs(diff).sum(1)
    return out


def _best_of_batch(shared, name: str, k: int | None, radius: float | None):
    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, q = shared.value
        similar = name in SIMILARITIES
        for batch in batches:
            x, ids = _matrix(batch.column("embedding")), batch.column("vec_id").to_numpy()
            if not len(x):
                continue
            d = _distances(x, q, name)
            if radius is not None:
                i, j = np.nonzero(d > radius if similar else d < radius)
            else:
                n = min(k, len(x))
                key = -d if similar else d
                # all that tie with the k-th stay, so that ids decide among them later
                limit = np.partition(key, n - 1, axis=0)[n - 1]
                i, j = np.nonzero(key <= limit)
            yield pa.record_batch([pa.array(qids[j]), pa.array(ids[i]), pa.array(d[i, j])], ["qid", "vec_id", "dist"])

    return kernel


def _blocks(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of the queries, block after block of at most BLOCK_VALUES components."""
    for part in parted(queries):
        table = part.select("qid", "qvec").toArrow()
        if len(table):
            yield table["qid"].to_numpy(), _matrix(table["qvec"].combine_chunks())


def few(df: DataFrame, most: int = 200_000) -> DataFrame:
    """df marked for broadcast if its counted rows are few enough; else left to a shuffle."""
    return F.broadcast(df) if df.count() <= most else df


def parted(queries: DataFrame) -> Iterator[DataFrame]:
    """The queries in parts of at most BLOCK_VALUES components, each small enough to be sent to all tasks."""
    size = queries.agg(F.count("*").alias("n"), F.max(F.size("qvec")).alias("d")).first()
    parts = max(1, math.ceil((size["n"] or 0) * (size["d"] or 0) / BLOCK_VALUES))
    for b in range(parts):
        yield queries if parts == 1 else queries.where(F.pmod(F.xxhash64("qid"), F.lit(parts)) == b)


def _kernel_pairs(base: DataFrame, queries: DataFrame, name: str, k: int | None, radius: float | None) -> DataFrame:
    spark = base.sparkSession
    out = None
    for block in _blocks(queries):
        part = base.select("vec_id", "embedding").mapInArrow(_best_of_batch(spark.sparkContext.broadcast(block), name, k, radius), "qid long, vec_id long, dist double")
        out = part if out is None else out.unionAll(part)
    return out if out is not None else spark.createDataFrame([], "qid long, vec_id long, dist double")


def pairs(base: DataFrame, queries: DataFrame, name: str = "l2", argument: float | None = None, where: Column | None = None) -> DataFrame:
    """Distance of every query to every base row that the condition allows; queries are replicated part by part."""
    out = None
    for part in parted(queries):
        met = base.join(F.broadcast(part), where if where is not None else F.lit(True))
        out = met if out is None else out.unionAll(met)
    return out.withColumn("dist", metric(name, argument)(F.col("embedding"), F.col("qvec")))


def knn(base: DataFrame, queries: DataFrame, k: int, name: str = "l2", argument: float | None = None, where: Column | None = None) -> DataFrame:
    """qid, vec_id, dist, rk of the k nearest base(vec_id, embedding) to each of queries(qid, qvec), ties by id.

    where: a condition on both sides' columns, applied before any distance. Fewer rows come if fewer qualify.
    """
    if where is None and argument is None and name in ("l2", "ip", "l1"):
        found = _kernel_pairs(base, queries, name, k, None)
    else:
        found = pairs(base, queries, name, argument, where).select("qid", "vec_id", "dist")
    return ranked(found, k, similarity=name in SIMILARITIES)


def _nearest_of(x: np.ndarray, ids: np.ndarray, y: np.ndarray, others: np.ndarray, k: int, values: int = 4_000_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in x, place in y, distance) of the k nearest y of another id to each x, ties by id.

    A product of matrices finds who can be among them, all ties included; these are measured by direct differences.
    So many products are held at a time.
    """
    out = []
    norms, size = np.einsum("nd,nd->n", y, y), max(1, values // max(len(y), 1))
    for lo in range(0, len(x), size):
        part = x[lo : lo + size]
        own = np.einsum("nd,nd->n", part, part)
        d = norms[None] - 2 * (part @ y.T)
        d[ids[lo : lo + size, None] == others[None]] = np.inf
        n = min(k, len(y))
        # rounding of the product is far below this share of the norms
        limit = np.partition(d, n - 1, axis=1)[:, n - 1] + 1e-12 * (own + norms.max() + 1)
        i, j = np.nonzero((d <= limit[:, None]) & np.isfinite(d))
        exact = np.empty(len(i))
        for a in range(0, len(i), 65536):
            diff = part[i[a : a + 65536]] - y[j[a : a + 65536]]
            exact[a : a + 65536] = np.einsum("nd,nd->n", diff, diff)
        order = np.lexsort((others[j], exact, i))
        i, j, exact = i[order], j[order], exact[order]
        best = np.arange(len(i)) - np.searchsorted(i, i) < k
        out.append((i[best] + lo, j[best], exact[best]))
    return tuple(np.concatenate(c) for c in zip(*out))


def nearest_others(base: DataFrame, some: DataFrame, k: int) -> DataFrame:
    """src, dst, dist, rk: for each base(vec_id, embedding) the k nearest by L2 of some(qid, qvec) that have another id.

    Here the rows are many on both sides: base is dealt over tasks, which meet the others part by part and keep k each.
    """
    spark = base.sparkSession
    dealt = base.select("vec_id", "embedding").repartition(4 * spark.sparkContext.defaultParallelism, "vec_id")
    out = None
    for block in _blocks(some):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            others, y = shared.value
            for batch in batches:
                ids = batch.column("vec_id").to_numpy()
                if len(ids):
                    i, j, d = _nearest_of(_matrix(batch.column("embedding")), ids, y, others, k)
                    yield pa.record_batch([pa.array(ids[i]), pa.array(others[j]), pa.array(d)], ["src", "dst", "dist"])

        part = dealt.mapInArrow(run, "src long, dst long, dist double")
        out = part if out is None else out.unionAll(part)
    if out is None:
        out = spark.createDataFrame([], "src long, dst long, dist double")
    return ranked(out, k, by="src", id_col="dst")


def nearer(base: DataFrame, bounds: list[tuple], name: str = "l2") -> np.ndarray:
    """For each of a few (qid, qvec, dist): how many base rows are at most so far (similarities: at least so near)."""
    if name not in ("l2", "ip", "l1"):
        raise ValueError(f"no kernel for {name!r}")
    qids = sorted({b[0] for b in bounds})
    vectors = {b[0]: b[1] for b in bounds}
    groups = [np.array([i for i, b in enumerate(bounds) if b[0] == qid]) for qid in qids]
    limits = np.array([b[2] for b in bounds], float)
    shared = base.sparkSession.sparkContext.broadcast((np.array([vectors[qid] for qid in qids], float), groups, -limits if name in SIMILARITIES else limits))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, at, most = shared.value
        n = np.zeros(len(most), np.int64)
        slack = 1e-9 * np.maximum(np.abs(most), 1)  # so that rounding does not part a row from itself
        for batch in batches:
            x = _matrix(batch.column("embedding"))
            if len(x):
                d = np.sort(_distances(x, q, name) * (-1 if name in SIMILARITIES else 1), axis=0)
                for j, i in enumerate(at):
                    n[i] += np.searchsorted(d[:, j], (most + slack)[i], "right")
        yield pa.record_batch([pa.array(np.arange(len(n))), pa.array(n)], ["i", "n"])

    found = base.select("embedding").mapInArrow(count, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(bounds), np.int64)
    out[found["i"].to_numpy()] = found["n"].to_numpy()
    return out


def within(base: DataFrame, queries: DataFrame, radius: float, name: str = "l2", argument: float | None = None, where: Column | None = None) -> DataFrame:
    """qid, vec_id, dist of all base rows nearer than the radius (similarities: above it); strict."""
    if where is None and argument is None and name in ("l2", "ip", "l1"):
        return _kernel_pairs(base, queries, name, None, radius)
    found = pairs(base, queries, name, argument, where).select("qid", "vec_id", "dist")
    return found.where(F.col("dist") > radius if name in SIMILARITIES else F.col("dist") < radius)


def _best_of_sets(shared, name: str, k: int):
    """Of each batch the k nearest rows to each query among the rows with its label sets."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, q, queries_of = shared.value
        similar = name in SIMILARITIES
        for batch in batches:
            x, ids = _matrix(batch.column("embedding")), batch.column("vec_id").to_numpy()
            rows_of: dict[int, list[int]] = {}
            for i, labels in enumerate(batch.column("labels").to_pylist()):
                for j in queries_of.get(tuple(labels or ()), ()):
                    rows_of.setdefault(j, []).append(i)
            out = []
            for j, rows in rows_of.items():
                at = np.array(rows)
                d = _distances(x[at], q[j : j + 1], name)[:, 0]
                key = -d if similar else d
                limit = np.partition(key, min(k, len(at)) - 1)[min(k, len(at)) - 1]  # ties with the k-th stay
                best = key <= limit
                out.append((np.full(best.sum(), j), at[best], d[best]))
            if out:
                j, i, d = (np.concatenate(c) for c in zip(*out))
                yield pa.record_batch([pa.array(qids[j]), pa.array(ids[i]), pa.array(d)], ["qid", "vec_id", "dist"])

    return kernel


def filtered_knn(base: DataFrame, queries: DataFrame, k: int, scenario: str, name: str = "l2") -> DataFrame:
    """knn among the rows whose label set satisfies the scenario, decided once for each pair of distinct label sets.

    base also has labels, queries qlabels. Label sets are matched by an equi-join (equality), on the query's rarest
    label (containment) or on any common label (overlap). Where the matched sets and queries are few enough to be sent
    to all tasks, the base is read once and not shuffled; else rows meet queries by their label sets, dealt over SALTS.
    """
    from .predicates import rare_label_containment

    if scenario == "nofilter":
        return knn(base, queries, k, name)
    base_sets = base.select("labels").distinct()
    query_sets = queries.select("qlabels").distinct()
    if scenario == "equality":
        met = query_sets.join(base_sets, F.col("qlabels") == F.col("labels")).select("qlabels", F.col("labels").alias("set"))
    elif scenario == "containment":
        met = rare_label_containment(base_sets.select(F.col("labels").alias("key"), "labels"), query_sets.select(F.col("qlabels").alias("qid"), "qlabels")).select(F.col("qid").alias("qlabels"), F.col("key").alias("set"))
    elif scenario == "overlap":
        met = query_sets.select("qlabels", F.explode("qlabels").alias("l")).join(base_sets.select(F.col("labels").alias("set"), F.explode("labels").alias("l")), "l").select("qlabels", "set").distinct()
    else:
        raise ValueError(f"unknown scenario {scenario!r}")
    wanted = met.join(queries.select("qid", "qlabels"), "qlabels").select("set", "qid")
    asked = queries.agg(F.count("*").alias("n"), F.max(F.size("qvec")).alias("d")).first()
    if name in ("l2", "ip", "l1") and (asked["n"] or 0) * (asked["d"] or 0) <= BLOCK_VALUES:
        pairs_of = wanted.limit(MOST_SETS + 1).toArrow()
        if len(pairs_of) <= MOST_SETS:
            table = queries.select("qid", "qvec").toArrow()
            qids = table["qid"].to_numpy()
            place = {qid: j for j, qid in enumerate(qids.tolist())}
            queries_of: dict[tuple, list[int]] = {}
            for labels, qid in zip(pairs_of["set"].to_pylist(), pairs_of["qid"].to_pylist()):
                queries_of.setdefault(tuple(labels), []).append(place[qid])
            shared = base.sparkSession.sparkContext.broadcast((qids, _matrix(table["qvec"].combine_chunks()), queries_of))
            found = base.select("vec_id", "embedding", "labels").mapInArrow(_best_of_sets(shared, name, k), "qid long, vec_id long, dist double")
            return ranked(found, k, similarity=name in SIMILARITIES)
    dealt = base.withColumn("_salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).cast("int"))
    every = wanted.join(queries.select("qid", "qvec"), "qid").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    pairs_ = dealt.join(every.withColumnRenamed("set", "labels"), ["labels", "_salt"])
    return ranked(pairs_.select("qid", "vec_id", metric(name)(F.col("embedding"), F.col("qvec")).alias("dist")), k, similarity=name in SIMILARITIES)


def merge(results: list[DataFrame], k: int, similarity: bool = False) -> DataFrame:
    """One ranking from several of the same queries; a vector found twice counts once, with its best distance."""
    every = results[0].select("qid", "vec_id", "dist")
    for r in results[1:]:
        every = every.unionByName(r.select("qid", "vec_id", "dist"))
    best = F.max("dist") if similarity else F.min("dist")
    return ranked(every.groupBy("qid", "vec_id").agg(best.alias("dist")), k, similarity=similarity)


def capped_radius(found: DataFrame, most: int) -> DataFrame:
    """Radius results cut to fewer than most + 1: those strictly below the (most + 1)-th smallest distance."""
    cut = found.orderBy("dist").limit(most + 1).agg(F.when(F.count("*") > most, F.max("dist")).alias("cut"))
    return found.crossJoin(F.broadcast(cut)).where("cut is null or dist < cut").drop("cut")


def smallest(values: Column, k: int, largest: bool = False) -> Column:
    """The k least (or greatest) of an array as (value, position), ties by position."""
    sign = -1 if largest else 1
    keyed = F.transform(values, lambda x, i: F.struct((F.lit(sign) * x).alias("key"), i.alias("pos"), x.alias("value")))
    return F.transform(F.slice(F.array_sort(keyed), 1, k), lambda s: F.struct(s["value"], s["pos"]))


def refine(candidates: DataFrame, base: DataFrame, queries: DataFrame, k: int, name: str = "l2") -> DataFrame:
    """Candidates (qid, vec_id) ranked anew by exact distances."""
    met = candidates.select("qid", "vec_id").distinct().join(base, "vec_id").join(F.broadcast(queries), "qid")
    return ranked(met.select("qid", "vec_id", metric(name)(F.col("embedding"), F.col("qvec")).alias("dist")), k, similarity=name in SIMILARITIES)


def among(candidates: DataFrame, base: DataFrame, queries: DataFrame, name: str = "l2") -> DataFrame:
    """Distances to candidate lists: candidates(qid, ids)."""
    listed = candidates.select("qid", F.explode("ids").alias("vec_id"))
    return listed.join(base, "vec_id").join(F.broadcast(queries), "qid").select("qid", "vec_id", metric(name)(F.col("embedding"), F.col("qvec")).alias("dist"))
