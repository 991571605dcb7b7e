"""Rows that every operator meets: nulls, empty and long texts, ties, repeated rows, extra columns that clash."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, kept boolean, key string, digest string"


def words(seed: int, n: int, vocabulary: int = 4000) -> str:
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def texts() -> list[str | None]:
    copy, near = words(1, 120), words(2, 200).split()
    changed = near[:50] + ["other"] + near[51:]
    long = words(3, 30_000)
    passage = words(4, 60)
    return [
        None, "", " \t\n", "one", "One two", "one two three four", copy, copy, copy.upper(), " ".join(near), " ".join(changed), long, f"{words(5, 40)} {passage} {words(6, 40)}",
        f"{words(7, 70)} {passage}", "a b " * 200, "é ü 😀 " * 30, "### $$$ %%% " * 40, "line of words here\n" * 30, words(8, 80), words(8, 80) + " tail", "\x1c a\x0bb\x0cc\xa0d",
    ]


def rows() -> list[tuple]:
    out = [(i, t, "en", ["b", "a", None][i % 3], 1, 9, 9, True, "k", "d") for i, t in enumerate(texts())]
    return [*out, out[6], out[6], (None, "null id", None, None, None, None, None, None, None, None), (None, words(9, 60), None, "a", None, None, None, None, None, None), (50, out[6][1], "en", "z", 1, 1, 1, True, "k", "d")]


def unique_rows() -> list[tuple]:
    return [r for i, r in enumerate(rows()) if r[0] is not None and r not in rows()[:i]]
