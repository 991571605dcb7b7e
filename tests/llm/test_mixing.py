from collections import Counter

import pytest

from lamina.llm import mixing

from .fixtures import SCHEMA, rows, words


def _targets(sizes: dict, weights=(5, 2, 1), share=1.5, most=2.0) -> dict:
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    budget, out, left = share * sum(sizes.values()), {}, set(order)
    while True:
        rest = budget - sum(out.values())
        total = sum(w[s] for s in left)
        over = [s for s in left if rest * w[s] / total >= most * sizes[s]] if left else []
        if not over:
            return out | {s: rest * w[s] / total for s in left}
        for s in over:
            out[s] = most * sizes[s]
            left.discard(s)


def test_water_filling_and_taken(spark):
    docs = [(i, words(i, 1 + i * 7 % 60), None, None if i % 10 == 0 else f"s{i % 7 if i % 2 else 1}", *[None] * 6) for i in range(2000)]
    out = mixing.mix(spark.createDataFrame(docs, SCHEMA), carry=("doc_id", "source")).collect()
    sizes, taken, target = Counter(), Counter(), {}
    for r in out:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["size"] * r["epochs"]
    expected = _targets(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(expected[s])
        assert abs(taken[s] - target[s]) <= 60
    mixed = mixing.mixed(spark.createDataFrame(docs, SCHEMA))
    assert mixed.columns == spark.createDataFrame([], SCHEMA).columns
    epochs = {r["doc_id"]: r["epochs"] for r in out}
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter({k: v for k, v in epochs.items() if v})


def test_edge_rows_and_empty(spark):
    out = mixing.mix(spark.createDataFrame(rows(), SCHEMA)).collect()
    assert len(out) == len(rows()) and all(r["taken"] <= 2 * r["size"] for r in out)
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    blank = [(i, " ", None, "a", *[None] * 6) for i in range(3)]
    assert [r["taken"] for r in mixing.mix(spark.createDataFrame(blank, SCHEMA)).collect()] == [0, 0, 0]
