import os

import duckdb
import pytest

from lamina.llm import queries

from .fixtures import words

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="the driver's tables are not here")


def test_ten_queries_and_pipeline_run_whole(spark):
    import corpus_pipeline

    n = spark.read.parquet(f"{D}/documents.parquet").count()
    for name, run in queries.queries().items():
        rows = run(spark, D).count()
        whole = {"op2": None, "op6": spark.read.parquet(f"{D}/pages.parquet").count()}.get(name.split("_")[0], n)
        assert whole is None or rows == whole, name
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.run(spark, D).count() > 0


def test_pipeline_against_stages_by_hand(spark):
    """Decisions of each stage on its own input, by the operators' reports."""
    import corpus_pipeline as P
    from lamina.llm import decontamination, jaccard, mixing, quality
    from lamina.llm.storage import settle

    docs = spark.read.parquet(f"{D}/documents.parquet")
    bench = spark.read.parquet(f"{D}/benchmark.parquet")
    stage = dict(P.STAGES)
    a = settle(stage["quality rules"](spark, docs, D), "a")
    assert {r[0] for r in a.select("doc_id").collect()} == {r[0] for r in quality.judge(docs).where("kept").select("doc_id").collect()}
    b = settle(stage["n-gram Jaccard join"](spark, a, D), "b")
    assert {r[0] for r in b.select("doc_id").collect()} == {r[0] for r in jaccard.near_duplicates(a).select("component_id").collect()}
    c = settle(stage["benchmark decontamination"](spark, b, D), "c")
    assert {r[0] for r in b.select("doc_id").collect()} - {r[0] for r in c.select("doc_id").collect()} == {r[0] for r in decontamination.contaminated(b, bench).select("doc_id").collect()}
    e = settle(stage["mixing sources"](spark, c, D), "e")
    assert e.columns == docs.columns and e.count() == mixing.mix(c).agg({"epochs": "sum"}).first()[0]
    assert stage["sharding"](spark, e, D).count() == e.count()


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{D}/documents.parquet'")
    expected = con.sql(queries.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, D).toPandas()
    columns = sorted(expected.columns)
    assert columns == sorted(got.columns)
    got, expected = (x.sort_values("doc_id")[columns].reset_index(drop=True) for x in (got, expected))
    for c in columns:
        if c == "target":
            assert abs(got[c].values - expected[c].values).max() < 1e-6
        else:
            assert got[c].tolist() == expected[c].tolist(), c


def test_base_columns_in_sql(spark):
    """What the contracts fix of op5, op8 and op10, by SQL over the whole texts."""
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{D}/documents.parquet'")
    run = lambda name, *columns: [tuple(r) for r in queries.queries()[name](spark, D).select("doc_id", *columns).orderBy("doc_id").collect()]
    word = "[^\\x20\\x09-\\x0D]+"
    assert run("op10_token_counts", "n_bytes") == con.sql("SELECT doc_id, coalesce(strlen(text), 0) FROM documents ORDER BY doc_id").fetchall()
    assert run("op5_pii", "n_email") == con.sql("SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+')) FROM documents ORDER BY doc_id").fetchall()
    assert run("op8_quality", "n_words", "word_chars", "n_symbols") == con.sql(f"SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '{word}')), coalesce(length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')), 0), len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) FROM documents ORDER BY doc_id").fetchall()


def test_stages_with_null_and_repeated_ids(spark):
    """Every stage decides by row: null ids, repeated ids and repeated rows neither stay nor go by their ids."""
    import corpus_pipeline as P

    good = [f"{i} " + ". ".join(words(i, 80).split()) for i in range(40)]
    bench = " ".join(spark.read.parquet(f"{D}/benchmark.parquet").where("length(text) > 100").orderBy("item_id").first()["text"].split())
    data = [(i if i % 4 else None, t) for i, t in enumerate(good)] + [(None, good[3]), (5, good[3]), (7, good[7]), (7, good[7]), (7, "### $$$ %%% " * 40), (None, "### $$$ %%% " * 40), (None, good[1] + " " + bench), (9, good[2] + " " + bench), (9, None)]
    docs = spark.createDataFrame([(i, t, "en", "ab"[len(t or "") % 2], 1) for i, t in data], "doc_id long, text string, lang string, source string, n_chars int")
    stage = dict(P.STAGES)
    a = stage["quality rules"](spark, docs, D)
    kept = sorted(r["text"] for r in a.collect())
    assert kept == sorted(t for _, t in data if t and "###" not in t)
    b = stage["n-gram Jaccard join"](spark, a, D)
    assert sorted(r["text"] for r in b.collect()) == sorted({t for _, t in data if t and "###" not in t})
    c = stage["benchmark decontamination"](spark, b, D)
    assert sorted(r["text"] for r in c.collect()) == sorted(good) and c.columns == docs.columns
    e = stage["mixing sources"](spark, c, D)
    out = stage["sharding"](spark, e, D)
    assert out.count() == e.count() > 0


def test_pipeline_bounds_arrow_batches_by_bytes(spark):
    """A partition of texts reaches a worker in batches of bounded bytes and at most one text more, whole; a session's own bound stays."""
    import corpus_pipeline as P
    import pyarrow as pa
    from lamina.llm.storage import BATCH_BYTES

    def sizes(batches):
        for b in batches:
            yield pa.record_batch([pa.array([len(b)]), pa.array([b.nbytes])], ["n", "bytes"])

    long = ". ".join(words(3, 700_000).split())
    data = [(i, f"{i} " + ". ".join(words(i, 600).split())) for i in range(2500)] + [(2500, long), (2501, None)]
    for _, stage in P.STAGES[:3]:
        counts = []
        for bound in (None, 1 << 30):
            own = spark.newSession()
            if bound:
                own.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", bound)
            docs = own.createDataFrame([(i, t, "en", "a", 1) for i, t in data], "doc_id long, text string, lang string, source string, n_chars int").coalesce(1)
            counts.append(stage(own, docs, D).count())
            got = [tuple(r) for r in docs.select("text").mapInArrow(sizes, "n long, bytes long").collect()]
            assert sum(n for n, _ in got) == len(data)
            assert (len(got) == 1) if bound else max(x for _, x in got) <= 1.1 * BATCH_BYTES + len(long)
        assert counts[0] == counts[1]
