"""Every registered query with a DuckDB twin gives the same rows on the smallest tables; the others give some."""

import math
import numbers
import os

import duckdb
import pandas as pd
import pytest

from lamina import catalog

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


def _plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if v is None or v is pd.NA:
        return None
    if isinstance(v, bool) or not isinstance(v, numbers.Real):
        return v
    return None if math.isnan(v) else round(float(v), 5) + 0.0


def _rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted((tuple(_plain(v) for v in r) for r in frame[columns].itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_twin(spark, con, name):
    got = _rows(catalog.queries()[name](spark, D).toPandas().astype(object))
    expected = _rows(con.sql(catalog.oracle_sql()[name]).df().astype(object))
    assert got[0] == expected[0]
    assert len(got[1]) == len(expected[1])
    assert got[1] == expected[1]


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, D).count() > 0


INDEXES = "idx12_ivf_pq idx13_ivf_pq_refined idx16_ivf_residual idx19_pq idx21_residual idx21_local_search idx21_product_residual idx21_product_local_search idx23_two_layer idx28_opq idx28_pre_transform idx44_factory idx52_train_add idx20_multi_index idx14_scalar_quantizer_index grf11_vamana_search grf28_hnsw_search grf30_nsg_search grf25_dense_graph_search grf12_unified_search grf16_free_state_search grf20_filtered_graph_search grf21_base_level_walk grf26_filter_map_search".split()


@pytest.mark.parametrize("name", INDEXES)
def test_recall_on_the_largest_tables(spark, name):
    """Mean recall of ten is at least 0.9, and filtered searches find nothing that fails the filter."""
    row = catalog.queries()[name](spark, "/root/testdata/sf0.1").first().asDict()
    assert row["recall_ok"] and row.get("filter_ok", True), row


def test_entry_points(spark):
    import __spark_entry__

    assert set(catalog.queries()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0


def test_entry_points_import_without_llm(tmp_path):
    """In a copy without the folders that may be deleted, the entry point still offers every other query."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/lamina", tmp_path / "lamina", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), sum(n.startswith('op') or n == 'pipeline' for n in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert out.stdout.split() == [str(len(catalog.queries())), "0"], out.stderr
