import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lamina.llm.words import minimizers, whole, windows, word_chunks


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab é\t\n\x0b\xa0", max_size=40)), max_size=12))
def test_words_equal_bytes_split(texts):
    for lo, hi, w in word_chunks(pa.array(texts, pa.string())):
        for row in range(lo, hi):
            at = slice(w.ptr[row - lo], w.ptr[row - lo + 1])
            assert [bytes(w.data[a:b]) for a, b in zip(w.starts[at], w.ends[at])] == (texts[row] or "").encode().split()


def test_window_hashes_follow_content():
    r = random.Random(1)
    texts = [" ".join(r.choice("abc") for _ in range(r.randint(0, 40))) for _ in range(60)]
    for _, _, w in word_chunks(pa.array(texts)):
        plain = [bytes(w.data[a:b]) for a, b in zip(w.starts, w.ends)]
        for size in (1, 2, 3, 5, 7, 20):
            seen = defaultdict(set)
            for i, h in enumerate(windows(w.hashes, size)):
                seen[tuple(plain[i : i + size])].add(h)
            assert all(len(v) == 1 for v in seen.values()) and len({next(iter(v)) for v in seen.values()}) == len(seen)
            fits = [any(w.ptr[k] <= i and i + size <= w.ptr[k + 1] for k in range(len(texts))) for i in range(len(plain))]
            assert whole(w.ptr, size).tolist() == fits


def test_minimizers():
    h = np.random.default_rng(2).integers(0, 9, 100).astype(np.uint64)
    starts = np.arange(90)
    assert minimizers(h, starts, 11).tolist() == [s + int(np.argmin(h[s : s + 11])) for s in starts]
