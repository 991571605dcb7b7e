import random

from lamina.llm.components import components


def test_components_over_many_partitions(spark, monkeypatch):
    monkeypatch.setattr("lamina.llm.components.LINKS_AT_ONCE", 30)
    r = random.Random(1)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1200)] + [(7, 7)]
    root = {v: v for e in edges for v in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(root[a], root[b])
            changed |= root[a] != m or root[b] != m
            root[a] = root[b] = m
    for parts in (1, 5, 40):
        got = components(spark.createDataFrame(edges, "a long, b long").repartition(parts))
        assert {x["key"]: x["label"] for x in got.collect()} == root
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
