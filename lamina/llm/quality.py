"""Quality rules as weak supervision.

Each rule votes good, bad or abstains on a document. Expectation-maximisation over the counts of vote patterns (at most
3 to the number of rules, however many documents there are) estimates how accurate each rule is, and a document is kept
by its posterior probability of quality. Two hard floors hold besides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import settle, ship
from .words import hash_spans, pair64, whole, windows, word_chunks

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_digits", "n_distinct_words", "n_symbol_words")
#: Symbols counted by n_symbols.
SYMBOLS = b"#*$%&|<>"

#: A rule: name, statistic as (numerator, denominator), good if at most, bad if at least; between: abstain.
RULES = (
    ("symbols", "n_symbols / greatest(word_chars, 1)", 0.02, 0.06),
    ("symbol_words", "n_symbol_words / greatest(n_words, 1)", 0.05, 0.25),
    ("symbol_run", "n_symbols / greatest(n_words, 1)", 0.10, 0.40),
    ("repeated_words", "n_repeat_words / greatest(n_words, 1)", 0.30, 0.50),
    ("repeated_lines", "n_dup_lines / greatest(n_lines, 1)", 0.25, 0.50),
    ("upper_case", "n_upper / greatest(n_letters, 1)", 0.20, 0.60),
    ("digits", "n_digits / greatest(word_chars, 1)", 0.10, 0.30),
    ("word_length", "abs(word_chars / greatest(n_words, 1) - 6)", 3.0, 6.0),
    ("vocabulary", "1 - n_distinct_words / sqrt(greatest(n_words, 1) * 30.0)", 0.75, 0.95),
)
MIN_WORDS = 50

_is = np.zeros((5, 256), bool)
_is[0, list(SYMBOLS)] = True
_is[1, 0x80:0xC0] = True
_is[2, 65:91] = True
_is[3, 65:91] = _is[3, 97:123] = True
_is[4, 48:58] = True


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    upto = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=upto[1:])
    return upto[offsets[1:]] - upto[offsets[:-1]]


def _distinct_per_row(rows: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    _, first = np.unique(pair64(hashes, rows.astype(np.uint64)), return_index=True)
    return np.bincount(rows[first], minlength=n)


def statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS of each text; null texts count as empty."""
    out = {k: np.zeros(len(texts), np.int64) for k in COUNTS}
    for lo, hi, w in word_chunks(texts):
        n = hi - lo
        in_word = np.zeros(len(w.data) + 1, np.int8)
        np.add.at(in_word, w.starts, 1)
        np.add.at(in_word, w.ends, -1)
        in_word = np.cumsum(in_word[:-1], dtype=np.int8) > 0
        out["n_words"][lo:hi] = np.diff(w.ptr)
        out["word_chars"][lo:hi] = _per_row(in_word & ~_is[1][w.data], w.offsets)
        for name, k in (("n_symbols", 0), ("n_upper", 2), ("n_letters", 3), ("n_digits", 4)):
            out[name][lo:hi] = _per_row(_is[k][w.data], w.offsets)

        upto = np.zeros(len(w.data) + 1, np.int64)
        np.cumsum(_is[0][w.data], out=upto[1:])
        out["n_symbol_words"][lo:hi] = np.bincount(w.row_of[upto[w.ends] > upto[w.starts]], minlength=n)

        # lines with a word
        edge = np.zeros(len(w.data) + 1, bool)
        edge[w.offsets] = True
        edge[1:] |= np.append(w.data == 10, False)[: len(w.data)]
        begins = np.flatnonzero(edge[:-1]) if len(w.data) else np.zeros(0, np.int64)
        stops = np.append(begins[1:], len(w.data))
        worded = np.searchsorted(w.starts, stops) > np.searchsorted(w.starts, begins)
        begins, stops = begins[worded], stops[worded]
        if len(begins):
            cut = stops - (w.data[stops - 1] == 10)
            row = np.searchsorted(w.offsets, begins, "right") - 1
            lines = np.bincount(row, minlength=n)
            out["n_lines"][lo:hi] = lines
            out["n_dup_lines"][lo:hi] = lines - _distinct_per_row(row, hash_spans(w.data, begins, cut), n)

        row = w.row_of
        out["n_distinct_words"][lo:hi] = _distinct_per_row(row, w.hashes, n)
        if len(w.hashes) >= 3:
            at = np.flatnonzero(whole(w.ptr, 3))
            key = pair64(windows(w.hashes, 3)[at], row[at].astype(np.uint64))
            _, back, times = np.unique(key, return_inverse=True, return_counts=True)
            at = at[times[back] > 1]
            covered = np.zeros(len(w.hashes) + 3, bool)
            for k in range(3):
                covered[at + k] = True
            out["n_repeat_words"][lo:hi] = np.bincount(row[covered[: len(row)]], minlength=n)
    return out


def _measure(text_at: int):
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = statistics(batch.column(text_at))
            carried = [(n, c) for n, c in zip(batch.schema.names, batch.columns) if n != "_text"]
            yield pa.record_batch([*[c for _, c in carried], *[pa.array(stats[k]) for k in COUNTS]], [*[n for n, _ in carried], *COUNTS])

    return measure


def measure(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns, named c0, c1 and so on, and COUNTS for every row of docs."""
    ship(docs.sparkSession)
    kinds = dict(docs.dtypes)
    sent = [F.col(c).alias(f"c{i}") for i, c in enumerate(carry)]
    text_at = carry.index("text") if "text" in carry else len(carry)
    if text_at == len(carry):
        sent.append(F.col("text").alias("_text"))
    return docs.select(*sent).mapInArrow(_measure(text_at), ", ".join([*(f"c{i} {kinds[c]}" for i, c in enumerate(carry)), *(f"{k} long" for k in COUNTS)]))


def _votes() -> list[F.Column]:
    return [F.when(F.expr(f"{stat} <= {good}"), F.lit(1)).when(F.expr(f"{stat} >= {bad}"), F.lit(-1)).otherwise(F.lit(0)).cast("int").alias(f"vote_{name}") for name, stat, good, bad in RULES]


#: Prior belief about a rule, as pseudo-votes for each vote counted: that it calls a good document good and a bad one bad.
TRUST_GOOD, TRUST_BAD, WEIGHT_GOOD, WEIGHT_BAD = 0.995, 0.40, 0.20, 0.05
#: Prior share of good documents and its weight as pseudo-documents for each document.
GOOD_SHARE, WEIGHT_SHARE = 0.85, 0.10
#: A rule is never taken for worse than chance on good documents, nor its calls of bad ones for rarer than false alarms.
LEAST_GOOD, LEAST_BAD = 0.5, 0.02


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 100) -> tuple[float, np.ndarray, np.ndarray]:
    """(share of good documents, each rule's chance to call a good document good, and a bad one bad).

    Expectation-maximisation over pattern counts; abstentions are no evidence. The priors keep a rule from being taken
    for worse than chance, so good and bad can't change places.
    """
    votes = np.array([p for p, _ in patterns], int).reshape(len(patterns), -1)
    count = np.array([n for _, n in patterns], float)
    up, down = (votes > 0).astype(float), (votes < 0).astype(float)
    cast = count @ (up + down)
    prior, good, bad = GOOD_SHARE, np.full(votes.shape[1], TRUST_GOOD), np.full(votes.shape[1], TRUST_BAD)
    for _ in range(rounds):
        p = _posterior(up, down, prior, good, bad)
        prior = float((count @ p + GOOD_SHARE * WEIGHT_SHARE * count.sum()) / (count.sum() * (1 + WEIGHT_SHARE)))
        extra = WEIGHT_GOOD * cast + 1
        good = ((count * p) @ up + TRUST_GOOD * extra) / ((count * p) @ (up + down) + extra)
        extra = WEIGHT_BAD * cast + 1
        bad = ((count * (1 - p)) @ down + TRUST_BAD * extra) / ((count * (1 - p)) @ (up + down) + extra)
        good, bad = np.clip(good, LEAST_GOOD, 0.999), np.clip(bad, LEAST_BAD, 0.999)
    return prior, good, bad


def _posterior(up: np.ndarray, down: np.ndarray, prior: float, good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    lift = np.log(prior / (1 - prior)) + up @ np.log(good / (1 - bad)) + down @ np.log((1 - good) / bad)
    return 1 / (1 + np.exp(-lift))


def _judged(stats: DataFrame, threshold: float) -> DataFrame:
    """stats with the rules' votes, p_quality, base_failed and kept; the fit is over all of its rows."""
    voted = stats.select("*", *_votes())
    names = [f"vote_{r[0]}" for r in RULES]
    counted = voted.groupBy(*names).count().collect()  # at most 3^len(RULES) rows
    failed = F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > 50 * n_words")
    if not counted:
        return voted.select("*", F.lit(None).cast("double").alias("p_quality"), failed.alias("base_failed"), F.lit(False).alias("kept"))
    prior, good, bad = fit([(tuple(r[n] for n in names), r["count"]) for r in counted])
    lift = F.lit(float(np.log(prior / (1 - prior))))
    for i, name in enumerate(names):
        up, down = float(np.log(good[i] / (1 - bad[i]))), float(np.log((1 - good[i]) / bad[i]))
        lift = lift + F.when(F.col(name) > 0, up).when(F.col(name) < 0, down).otherwise(0.0)
    scored = voted.withColumn("p_quality", 1 / (1 + F.exp(-lift))).withColumn("base_failed", failed)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("p_quality") >= threshold))


def judge(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, COUNTS, the rules' votes, p_quality, base_failed and kept for every row of docs.

    Null texts count as empty and fail, as does any text under MIN_WORDS words or with over half its words in repeated
    3-word windows. Repeated rows and null ids are judged like any other row; an empty table gives an empty result.
    """
    return _judged(settle(measure(docs), "quality").withColumnRenamed("c0", "doc_id"), threshold)


def keep_good(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that judge() keeps, in docs' columns; every row by its own text, whatever its id.

    The rows are written once, beside their counts, so that none has to be found again.
    """
    columns = tuple(docs.columns)
    kept = _judged(settle(measure(docs, columns), "quality"), threshold).where("kept")
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)])
