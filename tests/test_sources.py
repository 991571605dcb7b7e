import pytest

from lamina.sources import vectors as X
from lamina.streaming.slices import SlidingWindow, running_knn, slice_counts, window_of

ROWS = [(i, [float(i), float(i) / 2, -1.0]) for i in range(1000)]


@pytest.fixture
def df(spark):
    return spark.createDataFrame(ROWS, "vec_id long, embedding array<float>")


@pytest.mark.parametrize("kind", ["bin", "fvecs", "ivecs", "bvecs"])
def test_round_trip(spark, df, tmp_path, kind):
    if kind != "bin" and kind != "fvecs":
        df = df.selectExpr("vec_id", "array(cast(vec_id % 200 as float), cast(7 as float)) as embedding")
    path = f"{tmp_path}/x.{kind}"
    X.write_vectors(df, path, kind)
    back = X.read_vectors(spark, path, kind)
    assert [tuple(r) for r in back.orderBy("vec_id").collect()] == [tuple(r) for r in df.orderBy("vec_id").collect()]
    assert X.read_vectors(spark, path, kind, 10).count() == 10
    assert X.read_vector_folder(spark, path, kind).count() == 1000


def test_empty_file_and_unknown_kind(spark, df, tmp_path):
    X.write_vectors(df.limit(0), f"{tmp_path}/e.fvecs")
    assert X.read_vectors(spark, f"{tmp_path}/e.fvecs", "fvecs").count() == 0
    with pytest.raises(Exception):
        X.read_vectors(spark, f"{tmp_path}/e.fvecs", "hvecs").count()


def test_labels(spark, tmp_path):
    sets = [(0, [3, 1]), (1, []), (2, [7]), (3, [2, 9])]
    df = spark.createDataFrame(sets, "vec_id long, labels array<int>")
    X.write_labels(df, f"{tmp_path}/l")
    assert [tuple(r) for r in X.read_labels(spark, f"{tmp_path}/l").orderBy("vec_id").collect()] == [(i, sorted(s)) for i, s in sets]
    X.write_inverted(df, f"{tmp_path}/inv")
    assert spark.read.parquet(f"{tmp_path}/inv").where("label = 9").count() == 1


def test_ground_truth(spark, tmp_path):
    found = spark.createDataFrame([(0, 1, 5, 0.5), (0, 2, 6, 1.5), (1, 1, 7, 2.0)], "qid long, rk long, vec_id long, dist double")
    X.write_ground_truth(found, f"{tmp_path}/gt.bin", 2)
    assert [tuple(r) for r in X.read_ground_truth(spark, f"{tmp_path}/gt.bin", 2).orderBy("query", "rk").collect()] == [(0, 1, 5, 0.5), (0, 2, 6, 1.5), (1, 1, 7, 2.0), (1, 2, -1, -1.0)]


def test_index_directory(spark, df, tmp_path):
    X.save_index({"vectors": df, "groups": df.select("vec_id")}, f"{tmp_path}/i", {"metric": "l2"})
    tables, meta = X.load_index(spark, f"{tmp_path}/i")
    assert meta["metric"] == "l2" and tables["groups"].count() == 1000 and tables["vectors"].columns == df.columns
    spark.createDataFrame([("a=1",), ("b=x=y",), ("no",)], "value string").coalesce(1).write.text(f"{tmp_path}/kv")
    assert X.read_key_values(spark, f"{tmp_path}/kv") == {"a": "1", "b": "x=y"}


def test_sliding_window(spark, df):
    parts = [df.where(f"vec_id % 4 = {i}") for i in range(4)]
    w = SlidingWindow(3)
    for p in parts[:3]:
        w.step(p, False)
    assert w.step(parts[3], True).rows().count() == 750
    with pytest.raises(ValueError):
        SlidingWindow(2).step(None, True)
    assert window_of(df.selectExpr("*", "vec_id % 8 as s"), "s", 6, 3).count() == 375


def test_streams(spark, df, tmp_path):
    for i in range(3):
        df.where(f"vec_id % 3 = {i}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    q = spark.createDataFrame([(1, [0.0, 0.0, -1.0])], "qid long, qvec array<float>")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    running_knn(stream, q, 4, f"{tmp_path}/out", f"{tmp_path}/cp").start().awaitTermination(120)
    last = max(int(p.name) for p in tmp_path.joinpath("out").iterdir() if p.name.isdigit())
    assert sorted(r["vec_id"] for r in spark.read.parquet(f"{tmp_path}/out/{last}").collect()) == [0, 1, 2, 3]
    spark.range(120).selectExpr("timestamp_seconds(id * 60) as ts").write.parquet(f"{tmp_path}/times")
    counted = slice_counts(spark.readStream.schema("ts timestamp").parquet(f"{tmp_path}/times"), "ts", "60 minutes", "30 minutes", "1 minute")
    counted.writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start().awaitTermination(120)
    assert spark.table("counted").where("n = 60").count() >= 3
