"""Edge rows and small brute-force checks of the library's own operators."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.functions import vector as V
from lamina.operators import evaluate as E
from lamina.operators import generate as N
from lamina.operators import graph as R
from lamina.operators import groups as G
from lamina.operators import index as I
from lamina.operators import kernels as W
from lamina.operators import predicates as P
from lamina.operators import quantize as Z
from lamina.operators import search as S

BASE = "vec_id long, embedding array<float>, labels array<int>"


def _base(spark, rows):
    return spark.createDataFrame(rows, BASE)


EDGE = [(1, [0.0, 0.0], []), (2, [1.0, 0.0], [5]), (3, [1.0, 0.0], [5]), (4, [0.0, 2.0], [5, 7]), (5, [3.0, 3.0], [5, 7, 9]), (6, [1.0, 1.0], [7]), (7, [9.0, 9.0], [9, 11])]


def _queries(spark, rows):
    return spark.createDataFrame(rows, "qid long, qvec array<float>, qlabels array<int>")


def test_distances_of_edge_vectors(spark):
    row = spark.range(1).select(
        V.l2(F.array(F.lit(0.0), F.lit(3.0)), F.array(F.lit(4.0), F.lit(0.0))).alias("l2"),
        V.canberra(F.array(F.lit(0.0)), F.array(F.lit(0.0))).alias("canberra"),
        V.jensen_shannon(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("js"),
        V.normalized(F.array(F.lit(0.0), F.lit(0.0))).alias("zero"),
        V.hamming(F.lit(5).cast("long"), F.lit(-1).cast("long")).alias("ham"),
        V.permute_bits(F.lit(1).cast("long"), [1, 0]).alias("perm"),
    ).first()
    assert row["l2"] == 25.0 and row["canberra"] is None and row["js"] is None and row["zero"] == [0.0, 0.0] and row["ham"] == 62 and row["perm"] == 2
    with pytest.raises(ValueError):
        V.metric("chebyshev")
    with pytest.raises(ValueError):
        V.metric("lp")


@pytest.mark.parametrize("scenario", ["equality", "containment", "overlap", "nofilter"])
def test_filtered_knn(spark, scenario):
    queries = [(1, [0.0, 0.0], [5]), (2, [1.0, 1.0], [7, 5][::-1]), (3, [0.0, 0.0], [404]), (4, [0.0, 0.0], [])]
    met = {"equality": lambda b, q: b == q, "containment": lambda b, q: set(q) <= set(b), "overlap": lambda b, q: bool(set(q) & set(b)), "nofilter": lambda b, q: True}[scenario]
    expected = set()
    for qid, q, ql in queries:
        near = sorted((sum((a - b) ** 2 for a, b in zip(v, q)), i) for i, v, ls in EDGE if met(ls, ql))
        expected |= {(qid, i, r + 1) for r, (_, i) in enumerate(near[:3])}
    got = S.filtered_knn(_base(spark, EDGE), _queries(spark, queries), 3, scenario)
    assert {(r["qid"], r["vec_id"], r["rk"]) for r in got.collect()} == expected


def test_knn_larger_than_table_and_padding(spark):
    q = _queries(spark, [(1, [0.0, 0.0], [])])
    found = S.knn(_base(spark, EDGE), q, 50)
    assert [r["vec_id"] for r in found.orderBy("rk").collect()] == [1, 2, 3, 6, 4, 5, 7]
    assert S.pad(found, q, 10).where("vec_id = -1").count() == 3
    assert S.knn(_base(spark, []), q, 3).count() == 0 and S.within(_base(spark, EDGE), q, 1.0).count() == 1


def test_queries_in_blocks(spark, monkeypatch):
    q = _queries(spark, [(i, [float(i), 1.0], []) for i in range(20)])
    whole = sorted(map(tuple, S.knn(_base(spark, EDGE), q, 2).collect()))
    monkeypatch.setattr(S, "BLOCK_VALUES", 6)
    assert sorted(map(tuple, S.knn(_base(spark, EDGE), q, 2).collect())) == whole


def test_relational_division_and_empty_queries(spark):
    base, q = _base(spark, EDGE), _queries(spark, [(1, [0.0], [5, 7]), (2, [0.0], []), (3, [0.0], [8])])
    assert {(r[0], r[1]) for r in P.relational_division(base, q).collect()} == {(1, 4), (1, 5)}
    assert P.relational_division(base, q, True).where("qid = 2").count() == 7


def _labels(seed, n=60):
    r = random.Random(seed)
    return [(i, [0.0], sorted(r.sample(range(6), r.randint(0, 4)))) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_containment_graph(spark, seed):
    base = _base(spark, _labels(seed))
    grouped = G.groups(base).persist()
    sets = {r["group_id"]: frozenset(r["labels"]) for r in grouped.collect()}
    assert sorted(sets) == list(range(1, len(sets) + 1))
    strict = {(p, c) for p in sets for c in sets if sets[p] < sets[c]}
    assert {tuple(r) for r in G.supersets(grouped).collect()} == strict
    hasse = {(p, c) for p, c in strict if not any((p, m) in strict and (m, c) in strict for m in sets)}
    assert {tuple(r) for r in G.lng_edges(grouped).collect()} == hasse
    sizes = {r["group_id"]: r["group_size"] for r in grouped.collect()}
    for r in G.coverage(grouped).collect():
        below = [c for p, c in strict if p == r["group_id"]]
        assert r["descendants"] == len(below) and r["coverage"] == sizes[r["group_id"]] + sum(sizes[c] for c in below)
    hop = {(r["qid"], r["c"]): r["hop"] for r in G.hops(G.lng_edges(grouped), spark.createDataFrame([(1, 1)], "qid long, c long")).collect()}
    reach, level = {1: 0}, {1}
    while level:
        level = {c for p, c in hasse if p in level} - set(reach)
        reach |= {c: max(reach.values()) + 1 for c in level}
    assert {c: h for (_, c), h in hop.items()} == reach


def test_special_blocks(spark):
    grouped = G.groups(_base(spark, _labels(4, 200))).persist()
    rows = grouped.collect()
    blocks, left = {}, {r["group_id"]: (tuple(r["labels"]), r["group_size"]) for r in rows}
    for depth in range(max(len(r["labels"]) for r in rows), 0, -1):
        by = {}
        for g, (labels, n) in left.items():
            if len(labels) >= depth:
                by.setdefault(labels[:depth], []).append((g, n))
        for prefix, inside in by.items():
            if sum(n for _, n in inside) > 12:
                blocks[prefix] = {g for g, _ in inside}
                for g, _ in inside:
                    del left[g]
    got = {}
    for r in G.special_blocks(grouped, 12).collect():
        got.setdefault(tuple(r["prefix"]), set()).add(r["group_id"])
    assert got == blocks


def test_numbering_without_one_task(spark):
    df = spark.createDataFrame([(i * i,) for i in range(500)], "x long")
    assert [r["n"] for r in G.numbered(df, "x", "n", 5).orderBy("x").collect()] == list(range(5, 505))
    assert G.numbered(df.limit(0), "x", "n").count() == 0


def test_weak_components(spark):
    r = random.Random(7)
    edges = [(r.randrange(80), r.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 130)]
    root = {i: i for e in edges for i in e}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {x["vec_id"]: x["component"] for x in R.weak_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == root


def test_recall_modes(spark):
    truth = spark.createDataFrame([(1, 10, 1.0, 1), (1, 11, 2.0, 2), (2, 10, 1.0, 1)], "qid long, vec_id long, dist double, rk long")
    found = spark.createDataFrame([(1, 11, 2.0, 1), (1, 12, 2.0, 2), (3, 9, 1.0, 1)], "qid long, vec_id long, dist double, rk long")
    modes = {m: {r["qid"]: r["recall"] for r in E.recall(truth, found, 2, m).collect()} for m in E.RECALL_MODES}
    assert modes["gt"] == {1: 0.5, 2: 0.0, 3: None} and modes["k"] == {1: 0.5, 2: 0.0, 3: 0.0} and modes["ties"][1] == 100.0
    with pytest.raises(ValueError):
        E.recall(truth, found, 2, "best")


def test_pareto(spark):
    r = random.Random(2)
    points = [(f"p{i}", r.randint(0, 9) / 10, r.randint(1, 9) / 10) for i in range(60)]
    got = {(x["perf"], x["t"]) for x in E.pareto(spark.createDataFrame(points, "name string, perf double, t double")).collect()}
    assert got == {(p, t) for _, p, t in points if p > 0 and not any(q > p and u <= t or q == p and u < t for _, q, u in points)}


def test_kernels_recall_and_filter():
    x = np.random.default_rng(3).normal(size=(400, 8))
    q = np.random.default_rng(4).normal(size=(20, 8))
    truth = [set(np.argsort(((x - v) ** 2).sum(1))[:10].tolist()) for v in q]
    for build in (W.vamana, W.nsg, W.dense_graph):
        nbrs = build(x)
        hits = sum(len(t & set(W.beam(x, nbrs, v, [W.medoid(x)], 60)[0][:10].tolist())) for t, v in zip(truth, q))
        assert hits >= 185, build.__name__
    keep = np.arange(400) % 3 == 0
    for v in q:
        places, _, _ = W.beam(x, W.dense_graph(x), v, [0, 3, 6], 60, keep, True)
        assert keep[places].all() and len(set(places.tolist())) == len(places)
    pruned = W.robust_prune(x, 0, np.arange(400), 8)
    assert len(pruned) <= 8 and 0 not in pruned and pruned[0] == np.argsort(((x - x[0]) ** 2).sum(1))[1]
    near = W.nn_descent(x, 10)
    exact = np.argsort(((x[:, None] - x[None]) ** 2).sum(2) + np.diag(np.full(400, np.inf)), 1)[:, :10]
    assert np.mean([len(set(a) & set(b)) for a, b in zip(near.tolist(), exact.tolist())]) > 9


def test_quantizers_lose_little():
    x = np.random.default_rng(5).normal(size=(600, 16))
    spread = (x**2).sum(1).mean()
    for model, most in ((Z.ProductQuantizer.fit(x, 8, 16), 0.35), (Z.ResidualQuantizer.fit(x, 6), 0.6), (Z.LocalSearchQuantizer.fit(x, 4), 0.7), (Z.Stacked.fit(Z.ResidualQuantizer, x, 4, m=2), 0.4)):
        assert ((x - model.decode(model.encode(x))) ** 2).sum(1).mean() < most * spread
    pq = Z.ProductQuantizer.fit(x, 4, 16)
    codes = pq.encode(x)
    assert np.allclose(pq.distances(codes, x[:3]), ((pq.decode(codes)[:, None] - x[None, :3]) ** 2).sum(2))
    for step in (Z.itq(x, 16), Z.opq(x, 4), Z.Linear(Z.rotation(16), np.zeros(16))):
        assert np.allclose(step.reverse(step.apply(x)), x)
    lattice = Z.Lattice(4, 6).encode(x)
    assert (lattice == np.rint(lattice)).all() and np.mean([(p**2).sum(1) == 6 for p in np.split(lattice, 4, 1)]) > 0.9
    with pytest.raises(ValueError):
        Z.ProductQuantizer.fit(x, 5)


def test_kmeans_1d_is_exact():
    r = np.random.default_rng(6)
    for _ in range(20):
        v = np.round(r.normal(size=9), 2)
        best = math.inf
        s = np.sort(v)
        for cuts in itertools.combinations(range(1, 9), 2):
            parts = np.split(s, cuts)
            best = min(best, sum(((p - p.mean()) ** 2).sum() for p in parts))
        c = Z.kmeans_1d(v, 3)
        assert ((v[:, None] - c[None]) ** 2).min(1).sum() == pytest.approx(best, abs=1e-9)


def test_kmeans_over_rows_equals_local_loss(spark):
    x = np.concatenate([np.random.default_rng(i).normal(i * 5, 1, (60, 3)) for i in range(4)])
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    c = Z.kmeans(df, 4)
    assert Z.squared(x, c).min(1).sum() <= 1.2 * Z.squared(x, Z.kmeans_local(x, 4)).min(1).sum()


def test_index_strings():
    for text in ("Flat", "IDMap,Flat", "PCA32,IVF10_HNSW32,PQ8+16,RFlat", "OPQ8,PQ8x4", "IVF4,SQ8", "PRQ4x2x4", "ITQ32,LSH"):
        assert str(I.parse(text)) == text
    for text in ("Nope", "IVF", "PQ8,PQ8", "Flat,IVFx"):
        with pytest.raises(ValueError):
            I.parse(text)
    with pytest.raises(ValueError):
        I.parse_binary("BTree")


def test_maintenance(spark):
    df = spark.createDataFrame([(i, i * 10) for i in range(6)], "vec_id long, v long")
    gone = spark.createDataFrame([(1,), (4,), (99,)], "vec_id long")
    assert [tuple(r) for r in I.renumbered(I.removed(df, gone)).orderBy("vec_id").collect()] == [(0, 0), (1, 20), (2, 30), (3, 50)]
    assert {tuple(r) for r in I.updated(df, gone.withColumn("v", F.lit(-1).cast("long"))).collect()} == {(0, 0), (1, -1), (2, 20), (3, 30), (4, -1), (5, 50)}
    with pytest.raises(ValueError):
        I.merged(df, gone)


def test_generators_agree_with_themselves(spark):
    for kind in ("zipf", "uniform", "poisson", "one_per_point", "multi_normal"):
        a = N.labels(spark, 3000, kind, 10).orderBy("vec_id").collect()
        assert a == N.labels(spark, 3000, kind, 10).orderBy("vec_id").collect() and all(r["labels"] == sorted(set(r["labels"])) and r["labels"] for r in a)
    often = N.labels(spark, 3000, "zipf", 10).select(F.explode("labels").alias("l")).groupBy("l").count().orderBy("l").collect()
    assert abs(often[0]["count"] / 3000 - 0.7) < 0.05 and abs(often[4]["count"] / 3000 - 0.14) < 0.05
    m = N.vectors(spark, 3000, 4).select(F.avg(F.col("embedding")[0]), F.stddev(F.col("embedding")[0])).first()
    assert abs(m[0]) < 0.1 and abs(m[1] - 1) < 0.1


def test_kmeans_1d_takes_all_rows(spark, tmp_path):
    """More rows than any sample had; the same centres as the plain program over every row, and as weighted values."""
    from lamina.plans.indexes import _kmeans_1d

    r = np.random.default_rng(3)
    x = np.append(r.integers(0, 60, 6000) / 4, 1000.0)  # one row far away is a cluster of its own
    frame = spark.createDataFrame([(i, [float(v), 0.0]) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    frame.write.parquet(str(tmp_path / "embeddings.parquet"))
    got = sorted(_kmeans_1d(spark, str(tmp_path), 5).tolist())
    assert got[-1] == 1000.0 and len(got) == 5
    v, n = np.unique(x, return_counts=True)
    best = min(sum(((v[a:b] - np.average(v[a:b], weights=n[a:b])) ** 2 * n[a:b]).sum() for a, b in zip((0, *c), (*c, len(v)))) for c in itertools.combinations(range(1, len(v)), 4) if c[3] == len(v) - 1)
    assert abs((np.abs(x[:, None] - np.array(got)).min(1) ** 2).sum() - best) < 1e-6 * best
    for _ in range(30):
        y = r.integers(0, 12, 25).astype(float)
        k = int(r.integers(1, 5))
        u, c = np.unique(y, return_counts=True)
        centres = Z.kmeans_1d(u, k, c)
        least = min(sum(((p - p.mean()) ** 2).sum() for p in (y[(y >= lo) & (y < hi)] for lo, hi in zip((-1, *cuts), (*cuts, 99)))) for cuts in itertools.combinations(u[1:], min(k, len(u)) - 1))
        assert abs((np.abs(y[:, None] - centres).min(1) ** 2).sum() - least) < 1e-9
