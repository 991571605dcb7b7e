import random
from collections import defaultdict

from lamina.llm import jaccard

from .fixtures import SCHEMA, rows, unique_rows, words

_LOW = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def brute(docs):
    sets = {}
    for key, text in docs:
        w = (text or "").encode().translate(_LOW).split()
        sets[key] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in keys}


def _near(seed, count, size):
    r, base = random.Random(seed), words(seed, size).split()
    for _ in range(count):
        w = base[:]
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = f"x{r.randrange(1000)}"
        if r.random() < 0.4:
            w = w[: len(w) - r.randint(0, size // 6)]
        yield " ".join(w)


def test_against_brute_force(spark):
    texts = [t for seed, size in enumerate((5, 6, 8, 9, 12, 20, 33, 60, 120, 300)) for t in _near(seed, 25, size)]
    random.Random(3).shuffle(texts)
    docs = [(i, t, *[None] * 8) for i, t in enumerate(texts)] + [(d[0] + 5000, *d[1:]) for d in unique_rows()]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(spark.createDataFrame(docs, SCHEMA)).collect()}
    assert got == brute([(d[0], d[1]) for d in docs])


def test_deletion_neighbourhoods_lose_no_link():
    """The allowances hold in both modes, also where the cost estimate would not choose them."""
    import numpy as np

    r = random.Random(5)
    for deletes in (False, True):
        for _ in range(300):
            size = r.randint(4, 60)
            a = {r.getrandbits(63) for _ in range(size)}
            b = set(a)
            for _ in range(r.randint(0, max(1, size // 8))):
                b.discard(r.choice(sorted(b))) if r.random() < 0.5 and len(b) > 1 else b.add(r.getrandbits(63))
            if 100 * len(a & b) < 80 * len(a | b):
                continue
            plan = jaccard.Plan(80, 100, 100)
            for k in range(len(plan.segments)):
                top = plan.floor[k + 1] - 1
                need = plan.differ(top, top * 100 // 80) + 1
                plan.deletes[k] = deletes
                plan.segments[k] = -(-need * 23 // 20) if not deletes else -(-(-(-need // 2)) * 23 // 20)
            rows_ = [np.sort(np.array(list(s), np.uint64)) for s in (a, b)]
            sig, own = jaccard._signatures(plan, np.concatenate(rows_), np.array([0, len(a), len(a) + len(b)]))
            buckets = defaultdict(list)
            for s, o in zip(sig.tolist(), own.tolist()):
                buckets[s & ~3].append((o, s & 1, s & 2))
            assert any(x[0] != y[0] and (x[1] or y[1]) and not (x[2] and y[2]) for v in buckets.values() for x in v for y in v)


def test_large_near_group(spark):
    docs = [(i, t, *[None] * 8) for i, t in enumerate(_near(11, 400, 100))]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(spark.createDataFrame(docs, SCHEMA)).collect()}
    assert got == brute([(d[0], d[1]) for d in docs])


def test_null_repeated_and_empty(spark):
    out = jaccard.near_duplicates(spark.createDataFrame(rows(), SCHEMA)).collect()
    assert len(out) == len(rows())
    assert {r["component_id"] for r in out if r["doc_id"] in (6, 7, 8, 50)} == {6}
    assert jaccard.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    kept = jaccard.one_of_each(spark.createDataFrame(rows(), SCHEMA))
    assert {r["doc_id"] for r in kept.collect()}.isdisjoint({7, 8, 50, 10})


def test_unrelated_sets_share_no_large_bucket():
    """Sets of one size without a common shingle: no bucket of the index grows with their number, and none has empties."""
    import numpy as np

    rng = np.random.default_rng(1)
    for size in (1, 2, 3, 5, 8, 12, 20, 40, 100):
        n = 4000
        hashes = np.sort(rng.integers(0, 1 << 63, (n, size)).astype(np.uint64), 1).ravel()
        plan = jaccard.Plan(80, 100, size, {jaccard.Plan(80, 100, size).band(size): n})
        sig, own = jaccard._signatures(plan, hashes, np.arange(0, n * size + 1, size))
        _, times = np.unique(sig & ~jaccard.FLAGS, return_counts=True)
        assert times.max() <= 3, (size, times.max())
        assert len(np.unique(own)) == n


def test_hot_buckets_in_chunks(spark, monkeypatch):
    """Texts that share much and link in part, with small packs, chunks and bounds, so that every way is taken."""
    monkeypatch.setattr(jaccard, "CHUNK", 7)
    monkeypatch.setattr(jaccard, "LOCAL", 3)
    monkeypatch.setattr("lamina.llm.storage.BROADCAST_WIDE", 5)
    monkeypatch.setattr("lamina.llm.storage.HEAVY_ROWS", 4)
    r = random.Random(8)
    shared = words(50, 40).split()
    texts = []
    for i in range(150):
        own = words(600 + i % 25, 14).split()
        w = shared + own
        for _ in range(r.randint(0, 2)):
            w[r.randrange(len(w))] = f"y{r.randrange(500)}"
        texts.append(" ".join(w))
    texts += texts[:40] + ["same short text"] * 30
    docs = [(i, t, *[None] * 8) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(docs, SCHEMA).repartition(3)
    monkeypatch.setattr(jaccard, "ROWS_PER_PART", 2000)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard.near_duplicates(frame).collect()}
    assert got == brute([(d[0], d[1]) for d in docs])
