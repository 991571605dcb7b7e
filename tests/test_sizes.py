"""What shows only beyond the smallest tables: more rows than a block holds, copies, values at the edge of rounding."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina import catalog
from lamina.operators import kernels as W
from lamina.operators import search as S
from lamina.plans import walks

VECTORS = "vec_id long, embedding array<float>, label int"


def _sphere(n, d=64, seed=5):
    x = np.random.default_rng(seed).normal(size=(n, d))
    return (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)


def _frame(spark, x):
    return spark.createDataFrame([(i, v, i % 10) for i, v in enumerate(x.tolist())], VECTORS)


def _same(spark, folder, name):
    got = catalog.queries()[name](spark, str(folder)).toPandas()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet/*.parquet'")
    want = con.sql(catalog.oracle_sql()[name]).df()[list(got.columns)]
    keys = list(got.columns)
    assert got.sort_values(keys).to_numpy().tolist() == want.sort_values(keys).to_numpy().tolist()


def test_nearest_others_against_brute_force(spark, monkeypatch):
    """Copies tie and are told apart by id; the others come in several parts; no row of theirs meets all rows as a pair."""
    x = _sphere(300, 8)
    x[40:80] = x[7]
    base = _frame(spark, x).drop("label")
    some = base.where("vec_id % 3 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    monkeypatch.setattr(S, "BLOCK_VALUES", 250)
    got = {}
    for r in S.nearest_others(base, some, 4).collect():
        got.setdefault(r["src"], {})[r["rk"]] = r["dst"]
    x = x.astype(float)
    for i in range(len(x)):
        order = sorted((((x[j] - x[i]) ** 2).sum(), j) for j in range(0, 300, 3) if j != i)
        assert [got[i][k] for k in (1, 2, 3, 4)] == [j for _, j in order[:4]]


def test_augmenting_edges_make_no_table_of_pairs(spark, tmp_path):
    _frame(spark, _sphere(400)).write.parquet(f"{tmp_path}/embeddings.parquet")
    plan = catalog.queries()["grf32_augmenting_edges"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    _same(spark, tmp_path, "grf32_augmenting_edges")


@pytest.mark.parametrize("kind", ["ivecs", "bvecs"])
def test_whole_numbers_are_made_in_single_precision(spark, tmp_path, kind):
    """A hundred times 0.29 is 29 in single precision and a little less in double."""
    _frame(spark, np.array([[0.29, 0.5], [-0.29, 0.07], [0.57, 0.58]], np.float32)).write.parquet(f"{tmp_path}/embeddings.parquet")
    _same(spark, tmp_path, f"src05_{kind}")


@pytest.fixture
def small_blocks(monkeypatch):
    for name in ("MOST", "SEARCHED"):
        monkeypatch.setattr(W, name, 100, raising=False)


@pytest.mark.parametrize("name", ["grf07_vamana_build", "grf10_reverse_edges", "grf09_robust_prune"])
def test_blocks_of_one_graph_are_joined_up(spark, tmp_path, small_blocks, name):
    """Also with a group of near copies, which fills its vectors' edges by itself."""
    x = _sphere(450, 16)
    x[:60] = x[0] + 1e-4 * x[60:120]
    _frame(spark, x).write.parquet(f"{tmp_path}/embeddings.parquet")
    _same(spark, tmp_path, name)


def test_linked_parts():
    x = np.array([[float(i), 0.0] for i in range(12)])
    nbrs = [np.array([j for j in range(i // 4 * 4, i // 4 * 4 + 4) if j != i]) for i in range(12)]
    out = W.linked(x, nbrs, 3)
    reached, todo = {0}, [0]
    while todo:
        i = todo.pop()
        for j in {*out[i].tolist(), *[j for j in range(12) if i in out[j]]} - reached:
            reached.add(j)
            todo.append(j)
    assert len(reached) == 12 and max(len(v) for v in out) <= 3


@pytest.mark.parametrize("name", ["grf22_upper_level_descent"])
def test_descents_count_queries_not_blocks(spark, tmp_path, small_blocks, name):
    _frame(spark, _sphere(450, 16)).write.parquet(f"{tmp_path}/embeddings.parquet")
    _same(spark, tmp_path, name)


@pytest.mark.parametrize("name", ["grf08_beam_search", "grf11_vamana_search", "grf25_dense_graph_search", "grf28_hnsw_search", "grf30_nsg_search", "idx05_filter_graph", "idx06_hnsw", "idx08_nsg"])
def test_walks_are_as_wide_as_they_need(spark, tmp_path, name):
    """Near copies hold the walk among themselves, and directions at random make near ones hard to find."""
    x = _sphere(1800)
    x[100:500] = x[100] + 1e-3 * x[500:900]
    _frame(spark, x).write.parquet(f"{tmp_path}/embeddings.parquet")
    _same(spark, tmp_path, name)


def test_nn_descent_meets_neighbours_of_other_blocks(spark, tmp_path, small_blocks):
    """And the exact side makes no table of pairs."""
    _frame(spark, _sphere(450, 16)).write.parquet(f"{tmp_path}/embeddings.parquet")
    plan = catalog.queries()["grf31_nn_descent"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "zip_with" not in plan and "aggregate(" not in plan
    _same(spark, tmp_path, "grf31_nn_descent")


def test_pruning_looks_at_what_it_may_take():
    """Few of all places are compared with those taken, and the same are taken as if all were."""

    class Counted(np.ndarray):
        compared = 0

        def __sub__(self, other):
            if self.ndim == 2 and np.ndim(other) == 1:
                Counted.compared += len(self)
            return np.asarray(self) - np.asarray(other)

    x = _sphere(600).astype(float)
    x[200:260] = x[5]
    for p in (0, 5, 230):
        taken, factor, d = [], 1.0, ((x - x[p]) ** 2).sum(1)
        order = [i for i in np.lexsort((np.arange(600), d)).tolist() if i != p]
        while factor <= 1.2 and len(taken) < 14:
            for i in order:
                if len(taken) < 14 and i not in taken and all(d[i] <= factor * ((x[i] - x[t]) ** 2).sum() and (x[i] != x[t]).any() for t in taken):
                    taken.append(i)
            factor *= 1.2
        assert W.robust_prune(x, p, np.arange(600), 14).tolist() == taken
    Counted.compared = 0
    W.robust_prune(x.view(Counted), 0, np.arange(600), 14)
    assert Counted.compared < 4000


def test_descents_with_and_without_filter_share_their_graphs(spark, tmp_path, small_blocks):
    """Blocks are built once for both, and the free one is what descents without a filter give."""
    _frame(spark, _sphere(450, 16)).write.parquet(f"{tmp_path}/embeddings.parquet")
    plan = catalog.queries()["grf22_upper_level_descent"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") == 1
    rows, asked = walks.whole(spark, str(tmp_path)), walks.queries(spark, str(tmp_path))
    key = ["qid", "block"]
    both = W.descents(rows, asked, W.by_labels, ("labels",)).select(*key, "free", "begin").orderBy(*key).collect()
    plain = W.descents(rows, asked).select(*key, F.col("dist").alias("free"), "begin").orderBy(*key).collect()
    assert both == plain and len({r["block"] for r in both}) == 5


def test_nn_descent_tries_each_place_about_once():
    """And ends where trying all neighbours of neighbours in every round does."""

    class Counted(np.ndarray):
        compared = 0

        def __sub__(self, other):
            if self.ndim == 2 and np.ndim(other) == 1:
                Counted.compared += len(self)
            return np.asarray(self) - np.asarray(other)

    n, k = 600, 10
    x = _sphere(n, 16).astype(float)
    x[100:140] = x[3]
    rng = np.random.default_rng(3)
    near = [rng.permutation(np.delete(np.arange(n), i))[: 2 * k].tolist() for i in range(n)]
    for _ in range(16):
        back = [set() for _ in range(n)]
        for i, row in enumerate(near):
            for j in row:
                back[j].add(i)
        near, before = [], near
        for i, row in enumerate(before):
            some = np.array(sorted({*row, *back[i], *[j for r in row for j in before[r]]} - {i}))
            near.append(some[np.lexsort((some, ((x[some] - x[i]) ** 2).sum(1)))[: 2 * k]].tolist())
        if near == before:
            break
    found = W.nn_descent(x.view(Counted), k)
    assert found.tolist() == [row[:k] for row in near]
    assert Counted.compared < 1.5 * n * n


def _edges_of(spark, folder, name, monkeypatch):
    """The edges of which the query gives facts."""
    seen, settled = {}, walks.settled
    with monkeypatch.context() as m:
        m.setattr(walks, "settled", lambda df, what: seen.setdefault(what, settled(df, what)))
        catalog.queries()[name](spark, str(folder))
    return sorted((r["src"], r["dst"]) for r in seen["edges"].collect())


def test_whole_vamana_graph_has_no_blocks(spark, tmp_path, monkeypatch):
    """Blocks' sizes and the split of rounds between driver and tasks change no edge, and walks from the medoid find their way."""
    x = _sphere(700, 16)
    _frame(spark, x).repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    want = _edges_of(spark, tmp_path, "grf07_vamana_build", monkeypatch)
    for sizes in ({"MOST": 100, "SEARCHED": 100}, {"TOGETHER": 16}):
        for name, n in sizes.items():
            monkeypatch.setattr(W, name, n, raising=False)
        assert _edges_of(spark, tmp_path, "grf07_vamana_build", monkeypatch) == want
    nbrs = [np.zeros(0, int)] * len(x)
    for src, dst in want:
        nbrs[src] = np.append(nbrs[src], dst)
    x, hits = x.astype(float), 0
    for i in range(0, 700, 10):
        near = np.argsort(((x - x[i]) ** 2).sum(1), kind="stable")[:10]
        hits += len(set(near.tolist()) & set(W.beam(x, nbrs, x[i], [W.medoid(x)], 40)[0][:10].tolist()))
    assert hits >= 0.95 * 700


def test_vamana_graphs_of_odd_groups(spark):
    """One vector, copies only, copies beside others, far clusters: all of a group are joined up, and no two groups."""
    far = np.concatenate([_sphere(60, 8, i) * 0.01 + 100 * i for i in range(3)])
    mixed = _sphere(120, 8)
    mixed[:50] = mixed[0]
    groups = [np.ones((1, 8)), np.zeros((90, 8)), mixed, far]
    rows = [(g, 1000 * g + i, [float(a) for a in v]) for g, x in enumerate(groups) for i, v in enumerate(x)]
    got = [(r["src"], r["dst"]) for r in W.vamana_graphs(spark.createDataFrame(rows, "group_id long, vec_id long, embedding array<float>"), 8).collect()]
    part = {i: i for _, i, _ in rows}
    for _ in rows:
        before = dict(part)
        for a, b in got:
            part[a] = part[b] = min(part[a], part[b])
        if part == before:
            break
    assert len(set(got)) == len(got) and all(a != b for a, b in got)
    assert all(part[i] == 1000 * g for g, i, _ in rows)
    assert max(sum(a == i for a, _ in got) for _, i, _ in rows) <= 8
    assert {a for a, _ in got} == {i for g, i, _ in rows if g}


def test_walks_side_by_side_are_those_of_beam():
    """The nearest that many walks at a time meet are those that one after the other meet."""
    x = _sphere(400, 8).astype(float)
    nbrs = W.vamana(x, 8)
    rows = np.array([[*v, *[-1] * (8 - len(v))] for v in nbrs])
    places = np.arange(0, 400, 7)
    found = W.beams(x, rows, places, np.full(len(places), 3), 12)
    for i, row in zip(places.tolist(), found.tolist()):
        assert row == W.beam(x, nbrs, x[i], [3], 12)[0].tolist()


def test_whole_pruning_has_no_blocks(spark, tmp_path, monkeypatch, small_blocks):
    """Each vector's edges are pruned from its nearest among all; one leads to the nearest of those with smaller ids."""
    x = _sphere(450, 16)
    x[200:230] = x[5]
    _frame(spark, x).repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {}
    for src, dst in _edges_of(spark, tmp_path, "grf09_robust_prune", monkeypatch):
        got.setdefault(src, set()).add(dst)
    x = x.astype(float)
    for i in range(len(x)):
        want = W.robust_prune(x, i, np.arange(len(x)), 16).tolist()
        if i:
            parent = int(((x[:i] - x[i]) ** 2).sum(1).argmin())
            want = [parent] + [j for j in want if j != parent][:15]
        assert got[i] == set(want)


def test_pruning_takes_no_more_than_its_nearest(spark):
    """Of more vectors than a pruning looks at, ties at the last one go by id; groups stay apart."""
    x = np.repeat(_sphere(40, 8), 5, 0).astype(float)
    rows = [(i % 2, i, v) for i, v in enumerate(x.tolist())] + [(2, 999, [1.0] * 8)]
    got = {}
    for r in W.pruned_graphs(spark.createDataFrame(rows, "group_id long, vec_id long, embedding array<double>"), 6, 12).collect():
        got.setdefault(r["src"], set()).add(r["dst"])
    for g in (0, 1):
        ids = np.arange(g, 200, 2)
        y = x[ids]
        for p, i in enumerate(ids.tolist()):
            want = W.robust_prune(y, p, np.arange(len(y)), 6, most=12).tolist()
            if p:
                parent = int(((y[:p] - y[p]) ** 2).sum(1).argmin())
                want = [parent] + [j for j in want if j != parent][:5]
            assert got.pop(i) == set(ids[want].tolist())
    assert not got
