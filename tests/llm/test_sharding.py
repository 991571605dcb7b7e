import zlib
from collections import Counter, defaultdict

from lamina.llm import sharding

from .fixtures import SCHEMA, rows, words


def _check(out, docs, n):
    assert len(out) == len(docs)
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(n))
    got = Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out)
    assert got == Counter((d[0], len((d[1] or "").encode()) + 1, zlib.crc32((d[1] or "").encode())) for d in docs)


def test_edge_rows(spark):
    _check(sharding.shard(spark.createDataFrame(rows(), SCHEMA), 8).collect(), rows(), 8)


def test_empty(spark):
    out = sharding.shard(spark.createDataFrame([], SCHEMA), 8)
    assert out.count() == 0 and {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"} <= set(out.columns)


def test_near_equal_and_hot_group_cut(spark):
    hot = words(1, 80)
    docs = [(i, hot if i % 3 == 0 else words(i + 10, 20 + i % 90), None, None, None, None, None, None, None, None) for i in range(3000)]
    out = sharding.shard(spark.createDataFrame(docs, SCHEMA), 8).collect()
    _check(out, docs, 8)
    sizes = Counter()
    for r in out:
        sizes[r["shard"]] += r["size"]
    mean = sum(sizes.values()) / 8
    assert max(sizes.values()) < 1.03 * mean and min(sizes.values()) > 0.97 * mean
    text = {d[0]: d[1] for d in docs}
    where = defaultdict(set)
    for r in out:
        where[text[r["doc_id"]]].add(r["shard"])
    assert all(len(s) == 1 for t, s in where.items() if t != hot) and len(where[hot]) > 1
    again = sharding.shard(spark.createDataFrame(docs, SCHEMA), 8).collect()
    assert sorted((r["doc_id"], r["shard"], r["slot"]) for r in again) == sorted((r["doc_id"], r["shard"], r["slot"]) for r in out)


def test_only_groups_that_fit_no_shard_are_cut(spark):
    """A hot text of over a shard, one of a third of a shard, many small groups beside them, repeated rows."""
    hot, large = words(1, 40), words(2, 60)
    docs = [(i, hot) for i in range(3000)] + [(5, hot)] * 600 + [(4000 + i, large) for i in range(250)] + [(10_000 + i, words(100 + i // 3, 12)) for i in range(6000)] + [(None, hot)] * 300
    docs = [(*d, *[None] * 8) for d in docs]
    out = sharding.shard(spark.createDataFrame(docs, SCHEMA).repartition(7), 8).collect()
    _check(out, docs, 8)
    text, where, sizes = {zlib.crc32(d[1].encode()): d[1] for d in docs}, defaultdict(set), Counter()
    for r in out:
        where[text[r["text_crc32"]]].add(r["shard"])
        sizes[r["shard"]] += r["size"]
    assert len(where[hot]) > 1 and all(len(s) == 1 for t, s in where.items() if t != hot)
    mean = sum(sizes.values()) / 8
    assert max(sizes.values()) < 1.02 * mean and min(sizes.values()) > 0.98 * mean


def test_pack_keeps_whole_what_fits():
    runs = sharding._pack([(70, 7), (50, 5), (40, 4), (30, 3), (5, 1)], 2, 100)
    assert [sum(n for n, _ in r) for r in runs] == [7, 5, 4, 3, 1]
    assert [len(r) for r in runs] == [1, 1, 1, 1, 1]
    assert len(sharding._pack([(500, 50)], 4, 130)[0]) == 4
