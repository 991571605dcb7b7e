import hashlib
import random

import pytest

from lamina.llm import substrings

from .fixtures import SCHEMA, rows, unique_rows, words


def brute(docs, window):
    seen, out = set(), {}
    for key, text in docs:
        w, gone = (text or "").encode().split(), set()
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            if g in seen:
                gone |= set(range(k, k + window))
            seen.add(g)
        out[key] = (len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest())
    return out


@pytest.mark.parametrize("window", [2, 5, 20])
def test_against_brute_force(spark, window):
    r = random.Random(window)
    passages = [words(i, 45, 60) for i in range(5)]
    docs = [(i, " ".join(r.choice([words(i * 7 + k, 15, 300), r.choice(passages)]) for k in range(r.randint(0, 6))), *[None] * 8) for i in range(150)]
    docs = [*docs, *[(d[0] + 1000, *d[1:]) for d in unique_rows()]]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.remove_repeats(spark.createDataFrame(docs, SCHEMA), window).collect()}
    assert got == brute([(d[0], d[1]) for d in sorted(docs)], window)


def test_null_and_repeated_ids(spark):
    out = substrings.remove_repeats(spark.createDataFrame(rows(), SCHEMA)).collect()
    assert len(out) == len(rows())
    copies = [r for r in out if r["doc_id"] == 6]
    assert len(copies) == 3 and all(r["n_removed"] == 0 for r in copies)
    assert next(r for r in out if r["doc_id"] == 7)["n_removed"] == 120
    assert substrings.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_longest_repeats_until_none_survive(spark):
    r = random.Random(4)
    passage = words(1, 170)
    docs = [(i, f"{words(100 + i, 10)} {passage if i in (3, 9) else ''} {' '.join(passage.split()[:45]) if i in (5, 6) else ''} {words(200 + i, 10)}") for i in range(12)] + [(20, words(300, 30)), (21, words(300, 30)), (22, None), (None, "x y")]
    got = {x["doc_id"]: (x["longest"], x["n_starts"]) for x in substrings.longest_repeats(spark.createDataFrame([(*d, "clash", r.random()) for d in docs], "doc_id long, text string, longest string, hits double"), 10).collect()}
    seen = {}
    for length in (10, 20, 40, 80, 160, 320):
        grams = [(k, tuple((t or "").split()[i : i + length])) for k, t in docs for i in range(len((t or "").split()) - length + 1)]
        times = {}
        for _, g in grams:
            times[g] = times.get(g, 0) + 1
        for k, g in grams:
            if times[g] > 1:
                seen.setdefault(k, {}).setdefault(length, []).append(g)
    assert got == {k: (max(seen[k]), len(seen[k][max(seen[k])])) if k in seen else (0, 0) for k, _ in docs}
    assert got[3][0] == 160 and got[5][0] == 40
    assert substrings.longest_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
