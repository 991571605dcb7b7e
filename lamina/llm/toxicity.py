"""Toxicity by a factorization machine over hashed terms.

The score is a logistic function of a linear weight for each term present and of the dot products of the factors of all
pairs of terms present, so that a pair can count where neither term does. Terms are lower-cased runs of letters, digits
and non-ASCII characters, hashed to buckets. The model is fitted on a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import ship
from .words import TERM, word_chunks

BITS = 18
#: Labelled rows to fit on at most (about), drawn by a hash of the id.
MAX_LABELLED = 20_000
FACTORS, ROUNDS, BATCH, RATE, SHRINK_LINEAR, SHRINK_FACTORS = 8, 60, 64, 0.2, 1e-5, 1e-4
#: A term takes part if so many documents have it and its share of toxic ones is so many standard errors off.
MIN_DOCS, MIN_ERRORS = 4, 4.5
#: Two terms take part too if so many documents have both and, among those with either, the share of toxic ones with both is
#: so many standard errors off: a pair can tell what neither term does.
PAIR_DOCS, PAIR_ERRORS = 16, 6.0
#: Labelled rows in which such pairs are looked for at most; of more, every n-th of the sorted rows, so both labels keep their share.
MAX_PAIRED = 5_000


def term_chunks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, sorted distinct buckets row after row, their ptr)."""
    for lo, hi, w in word_chunks(texts, table=TERM):
        codes = np.unique((w.row_of.astype(np.int64) << BITS) | (w.hashes >> np.uint64(64 - BITS)).astype(np.int64))
        yield lo, hi, codes & ((1 << BITS) - 1), np.searchsorted(codes, np.arange(hi - lo + 1, dtype=np.int64) << BITS)


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, terms, ptr in term_chunks(batch.column("text")):
            packed = [terms[a:b].astype(np.int32).tobytes() for a, b in zip(ptr[:-1], ptr[1:])]
            yield pa.record_batch([batch.column("label").slice(lo, hi - lo), pa.array(packed, pa.binary())], ["label", "terms"])


class Machine:
    """bias + sum of w over the terms present + sum over their pairs of v.v, scaled down for long texts' many terms."""

    def __init__(self, slot: np.ndarray, bias: float, w: np.ndarray, v: np.ndarray):
        self.slot, self.bias, self.w, self.v = slot, bias, w, v

    def raw(self, terms: np.ndarray, ptr: np.ndarray) -> np.ndarray:
        n = len(ptr) - 1
        at = self.slot[terms]
        known = at >= 0
        row = np.repeat(np.arange(n), np.diff(ptr))[known]
        at = at[known]
        out = self.bias + np.bincount(row, self.w[at], n)
        for k in range(self.v.shape[1]):
            x = self.v[at, k]
            out += 0.5 * (np.bincount(row, x, n) ** 2 - np.bincount(row, x * x, n))
        return out

    def score(self, terms: np.ndarray, ptr: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(terms, ptr), -30, 30)))


def telling_pairs(docs: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Terms of pairs that tell more than their terms: for each term, counts of all later ones in its documents."""
    step = -(-len(docs) // MAX_PAIRED)
    docs, y = docs[::step], y[::step]
    sizes = [len(d) for d in docs]
    often = np.bincount(np.concatenate(docs), minlength=1 << BITS)
    toxic = np.bincount(np.concatenate(docs), np.repeat(y, sizes), 1 << BITS)
    test = np.flatnonzero(often >= PAIR_DOCS)
    slot = np.full(len(often), -1, np.int64)
    slot[test] = np.arange(len(test))
    terms, row = slot[np.concatenate(docs)], np.repeat(np.arange(len(docs)), sizes)
    terms, row = terms[terms >= 0], row[terms >= 0]
    ptr = np.searchsorted(row, np.arange(len(docs) + 1))
    by_term = np.argsort(terms, kind="stable")
    begin = np.searchsorted(terms[by_term], np.arange(len(test) + 1))
    share = np.clip((toxic[test] + y.mean()) / (often[test] + 1), 1e-3, 1 - 1e-3)
    found = np.zeros(len(test), bool)
    for a in range(len(test)):
        place = by_term[begin[a] : begin[a + 1]]
        n = ptr[row[place] + 1] - place - 1  # a document's terms are in order
        at = terms[np.repeat(place + 1 - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())]
        both, hits = np.bincount(at, minlength=len(test)), np.bincount(at, np.repeat(y[row[place]], n), len(test))
        off = [np.abs(hits - both * p) / np.sqrt(both * p * (1 - p) + 1e-9) for p in (share[a], share)]
        good = (both >= PAIR_DOCS) & (off[0] >= PAIR_ERRORS) & (off[1] >= PAIR_ERRORS)
        found |= good
        found[a] |= good.any()
    return test[found]


def fit(docs: list[np.ndarray], labels: np.ndarray, seed: int = 5) -> Machine:
    """By adaptive gradient descent on the logistic loss. Without both labels the machine is a constant."""
    y = labels.astype(np.float64)
    slot = np.full(1 << BITS, -1, np.int32)
    share = (y.sum() + 1) / (len(y) + 2)
    bias = float(np.log(share / (1 - share)))
    if not len(y) or y.min() == y.max():
        return Machine(slot, bias, np.zeros(0), np.zeros((0, FACTORS)))
    rng = np.random.default_rng(seed)
    terms = np.concatenate(docs)
    often = np.bincount(terms, minlength=1 << BITS)
    toxic = np.bincount(terms, np.repeat(y, [len(d) for d in docs]), 1 << BITS)
    errors = (toxic - often * share) / np.sqrt(np.maximum(often, 1) * share * (1 - share))
    used = np.union1d(np.flatnonzero((often >= MIN_DOCS) & (np.abs(errors) >= MIN_ERRORS)), telling_pairs(docs, y))
    slot[used] = np.arange(len(used))
    kept = [s[s >= 0] for s in (slot[d] for d in docs)]
    w, v = np.zeros(len(used)), rng.normal(0, 0.01, (len(used), FACTORS))
    gw, gv, gb = np.full(len(used), 1e-3), np.full((len(used), FACTORS), 1e-3), 1e-3
    for _ in range(ROUNDS):
        order = rng.permutation(len(y))
        for lo in range(0, len(order), BATCH):
            rows = order[lo : lo + BATCH]
            sizes = np.array([len(kept[i]) for i in rows])
            at = np.concatenate([kept[i] for i in rows])
            row = np.repeat(np.arange(len(rows)), sizes)
            x = v[at]
            sums = np.stack([np.bincount(row, x[:, k], len(rows)) for k in range(FACTORS)], 1)
            squares = np.bincount(row, (x * x).sum(1), len(rows))
            raw = bias + np.bincount(row, w[at], len(rows)) + 0.5 * ((sums**2).sum(1) - squares)
            err = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[rows]) / len(rows)
            terms, back = np.unique(at, return_inverse=True)
            dw = np.bincount(back, err[row], len(terms)) + SHRINK_LINEAR * w[terms]
            each = err[row][:, None] * (sums[row] - x)
            dv = np.stack([np.bincount(back, each[:, k], len(terms)) for k in range(FACTORS)], 1) + SHRINK_FACTORS * v[terms]
            gw[terms] += dw**2
            gv[terms] += dv**2
            gb += err.sum() ** 2
            w[terms] -= RATE * dw / np.sqrt(gw[terms])
            v[terms] -= 0.2 * RATE * dv / np.sqrt(gv[terms])
            bias -= RATE * err.sum() / gb**0.5
    return Machine(slot, bias, w, v)


def held_out() -> F.Column:
    """Whether a row's label is kept from fitting: crc32 of the id as text is divisible by 5. A null id counts as ''."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Machine:
    """Fit on labelled rows that are not held out; about max_labelled of them if there are more."""
    ship(docs.sparkSession)
    known = labels.where(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label")).where(~held_out())
    total = known.count()
    share = min(1.0, max_labelled / max(total, 1))
    drawn = known.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 20)) < int(share * (1 << 20)))
    found = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("label", "text").mapInArrow(_terms, "label int, terms binary")
    once = found.groupBy("terms").agg(F.max("label").alias("label"))  # copies count once
    rows = once.orderBy("label", "terms").toArrow()  # bounded by max_labelled; sorted, so that the fit is the same each time
    return fit([np.frombuffer(x, np.int32) for x in rows["terms"].to_pylist()], np.array(rows["label"].to_pylist(), np.int64))


def _scorer(shared):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        for batch in batches:
            out = np.zeros(len(batch))
            for lo, hi, terms, ptr in term_chunks(batch.column("text")):
                out[lo:hi] = machine.score(terms, ptr)
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(out), pa.array((out >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return score


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs.

    Null and empty texts get the score of no terms. Repeated rows and null ids are scored like any other; labels of ids
    that docs lacks are ignored, several labels of one id count as toxic if any is. Without labels every score is the
    smoothed share of toxic rows.
    """
    machine = train(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # at most 2^BITS terms, about 20 MB
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(_scorer(shared), f"doc_id {kind}, held_out boolean, score double, predicted int")
