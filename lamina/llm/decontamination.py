"""Benchmark decontamination by spaced seeds.

Each fixed mask keeps some of the positions of a short run of words and ignores the others, so a run still hits when
words at ignored positions were replaced. Hashes of the masked runs of test items and documents are joined; around each
hit the two texts are laid side by side and the overlap is verified word by word, tolerating substitutions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .identity import rows_as_documents
from .storage import by_ids, settle, ship, spread_join
from .words import TERM, mix64, whole, word_chunks

#: An overlap of so many words, or of the whole item if that is shorter, with this share of them equal.
OVERLAP, EQUAL = 13, 0.8
#: 1: the word counts; 0: it is ignored. In OVERLAP words, every choice of tolerated substitutions leaves a placement of a mask unhurt.
MASKS = ("10100101111", "11011100011", "11111011")
#: The same for items of fewer words, by their number of words; under 5 words all must be equal.
SHORT = {
    12: ("110001100011", "1101001011", "11011011"), 11: ("11000111", "111011"), 10: ("11001011", "11111", "110111"), 9: ("1111",), 8: ("1111",), 7: ("1111", "110011"), 6: ("1111", "110011"),
    5: ("1111", "10111", "11011", "11101"), 4: ("1111",), 3: ("111",), 2: ("11",), 1: ("1",), 0: (),
}
#: Bytes of a benchmark whose indexed items are broadcast (about 80 bytes a word, so 40 MB); a larger one is joined by a shuffle.
BROADCAST_BYTES = 3_000_000
#: Bits of the map of test seeds that documents are first held against, at most.
MAP_BITS = 27
#: Hits that are laid out at a time.
AT_ONCE = 1_000_000

_FACTORS = mix64(np.arange(1, OVERLAP + 1, dtype=np.uint64)) | np.uint64(1)


def masks_of(n: int) -> tuple[str, ...]:
    """The masks for items of n words."""
    return SHORT.get(n, MASKS)


def _masked(hashes: np.ndarray, mask: str) -> np.ndarray:
    m = max(len(hashes) - len(mask) + 1, 0)
    total = np.full(m, int(mask, 2), np.uint64)
    for k, bit in enumerate(mask):
        if bit == "1":
            total += hashes[k : k + m] * _FACTORS[k]
    return mix64(total)


def _seeds(hashes: np.ndarray, ptr: np.ndarray, masks: tuple[str, ...]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(mask, word positions, hash of the masked run there) for each of the masks."""
    for mask in masks:
        at = np.flatnonzero(whole(ptr, len(mask)))
        yield mask, at, _masked(hashes, mask)[at]


def _masks_for(lengths: Iterator[int]) -> dict[str, list[int]]:
    """Each mask and the item lengths (at most OVERLAP) that use it."""
    out: dict[str, list[int]] = {}
    for n in lengths:
        for mask in masks_of(n):
            out.setdefault(mask, []).append(n)
    return out


def _item_seeds(hashes: np.ndarray, ptr: np.ndarray) -> tuple[dict[str, list[int]], np.ndarray, np.ndarray, np.ndarray]:
    """(masks in use, word position, item and seed of every masked run of the items, by the masks for their lengths)."""
    sizes = np.minimum(np.diff(ptr), OVERLAP)
    masks = _masks_for(np.unique(sizes).tolist())
    row = np.repeat(np.arange(len(sizes)), np.diff(ptr))
    at, seed = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for mask, where, found in _seeds(hashes, ptr, tuple(masks)):
        meant = np.isin(sizes[row[where]], masks[mask])
        at.append(where[meant])
        seed.append(found[meant])
    at = np.concatenate(at)
    return masks, at, row[at], np.concatenate(seed)


def overlap(words: np.ndarray, test: np.ndarray, shift: int) -> tuple[int, int, int] | None:
    """(equal words, begin, end) of the verified overlap where the item's word 0 lies at the row's word shift."""
    begin, end = max(shift, 0), min(len(words), shift + len(test))
    width = min(OVERLAP, len(test))
    if end - begin < width:
        return None
    equal = np.append(0, np.cumsum(words[begin:end] == test[begin - shift : end - shift]))
    good = np.flatnonzero(equal[width:] - equal[:-width] >= math.ceil(EQUAL * width))
    if not len(good):
        return None
    first, last = int(good[0]), int(good[-1]) + width
    return int(equal[last] - equal[first]), begin + first, begin + last


class Items:
    """The test items, indexed by their seeds."""

    def __init__(self, ids: list, texts: list[str | None]):
        hashes, ptr = [np.zeros(0, np.uint64)], [0]
        for _, _, w in word_chunks(pa.array(texts, pa.string()), table=TERM):
            hashes.append(w.hashes)
            ptr += (ptr[-1] + w.ptr[1:]).tolist()
        self.ids, self.hashes, self.ptr = ids, np.concatenate(hashes), np.array(ptr)
        masks, at, row, seed = _item_seeds(self.hashes, self.ptr)
        self.masks = tuple(masks)
        order = np.argsort(seed, kind="stable")
        self.seeds, self.row, self.pos = seed[order], row[order], (at - self.ptr[row])[order]
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(self.seeds >> np.uint64(42)).astype(np.int64)] = True

    def overlaps(self, hashes: np.ndarray, ptr: np.ndarray) -> dict[tuple[int, int], tuple[int, int, int]]:
        """(row, item) to (equal words, begin, end) of the best verified overlap, by words of the row."""
        row_of = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
        hits = []
        for _, at, seed in _seeds(hashes, ptr, self.masks):
            some = self.maybe[(seed >> np.uint64(42)).astype(np.int64)]
            at, seed = at[some], seed[some]
            lo, hi = np.searchsorted(self.seeds, seed, "left"), np.searchsorted(self.seeds, seed, "right")
            upto = np.append(0, np.cumsum(hi - lo))
            while upto[-1]:  # a passage of many items is laid out bit by bit
                stop = max(1, int(np.searchsorted(upto, AT_ONCE, "right")) - 1)
                n = hi[:stop] - lo[:stop]
                place, entry = np.repeat(at[:stop], n), np.repeat(lo[:stop] - upto[:stop], n) + np.arange(n.sum())
                row = row_of[place]
                hits.append(np.unique(np.stack([row, self.row[entry], place - ptr[row] - self.pos[entry]], 1), axis=0))
                at, lo, hi, upto = at[stop:], lo[stop:], hi[stop:], upto[stop:] - upto[stop]
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for row, item, shift in np.unique(np.concatenate(hits), axis=0).tolist() if hits else []:
            found = overlap(hashes[ptr[row] : ptr[row + 1]], self.hashes[self.ptr[item] : self.ptr[item + 1]], shift)
            if found:
                best[row, item] = max(best.get((row, item), found), found)
        return best


def _scan(shared):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = shared.value
        for batch in batches:
            rows, found, spans = [], [], []
            for lo, _, w in word_chunks(batch.column("text"), table=TERM):
                for (row, item), span in items.overlaps(w.hashes, w.ptr).items():
                    rows.append(lo + row)
                    found.append(item)
                    spans.append(span)
            if rows:
                equal, begin, end = zip(*spans)
                ids = pa.array([items.ids[i] for i in found])
                yield pa.record_batch([batch.column("doc_id").take(pa.array(rows)), ids, *[pa.array(x, pa.int64()) for x in (equal, begin, end)]], ["doc_id", "item_id", "n_equal", "begin", "end"])

    return scan


def _without(shared, text_at: int):
    """The rows of docs that overlap with no item."""

    def without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = shared.value
        for batch in batches:
            keep = np.ones(len(batch), bool)
            for lo, _, w in word_chunks(batch.column(text_at), table=TERM):
                keep[[lo + row for row, _ in items.overlaps(w.hashes, w.ptr)]] = False
            yield batch.filter(pa.array(keep))

    return without


def _indexed(spark: SparkSession, benchmark: DataFrame):
    """The broadcast index of a benchmark that is small enough; else None."""
    if (benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0) > BROADCAST_BYTES:
        return None
    rows = benchmark.select("item_id", "text").where("text is not null").collect()  # BROADCAST_BYTES at most
    return spark.sparkContext.broadcast(Items([r[0] for r in rows], [r[1] for r in rows]))


# --- the join by a shuffle ---------------------------------------------------------------------------------------------


def _words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, w in word_chunks(batch.column("text"), table=TERM):
            words = [w.hashes[a:b].tobytes() for a, b in zip(w.ptr[:-1], w.ptr[1:])]
            yield pa.record_batch([*[batch.column(c).slice(lo, hi - lo) for c in ("item", "item_id")], pa.array(words, pa.binary()), pa.array(np.diff(w.ptr), pa.int64())], ["item", "item_id", "test", "n"])


def _seeds_of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, len(batch), 256):
            part = batch.slice(lo, 256)
            words = [np.frombuffer(x, np.uint64) for x in part.column("test").to_pylist()]
            ptr = np.append(0, np.cumsum([len(x) for x in words]))
            _, at, row, seed = _item_seeds(np.concatenate(words), ptr)
            yield pa.record_batch([pa.array(seed.view(np.int64)), pa.array(part.column("item").to_numpy()[row]), pa.array(at - ptr[row])], ["seed", "item", "pos"])


def _bitmap(bits: int):
    def bitmap(table: pa.Table) -> pa.Table:
        """Of seeds with the same six leading bits: which of the next bits occur."""
        flags = np.zeros(1 << (bits - 6), bool)
        flags[((table["seed"].to_numpy().view(np.uint64) << np.uint64(6)) >> np.uint64(70 - bits)).astype(np.int64)] = True
        return pa.table({"part": pa.array([table["part"][0].as_py()], pa.int32()), "bits": pa.array([np.packbits(flags).tobytes()], pa.binary())})

    return bitmap


def _suspects(shared, masks: tuple[str, ...], bits: int):
    """Rows with seeds that may be a test item's: their words, and places and seeds."""

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.unpackbits(np.frombuffer(shared.value, np.uint8)).view(bool)
        for batch in batches:
            for lo, hi, w in word_chunks(batch.column("text"), table=TERM):
                at, seed = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
                for _, place, found in _seeds(w.hashes, w.ptr, masks):
                    some = flags[(found >> np.uint64(64 - bits)).astype(np.int64)]
                    at.append(place[some])
                    seed.append(found[some])
                at, seed = np.concatenate(at), np.concatenate(seed)
                order = np.argsort(at, kind="stable")
                at, seed = at[order], seed[order]
                row = w.row_of[at]
                rows, first = np.unique(row, return_index=True)
                ends = np.append(first, len(row)).astype(np.int32)
                words = [w.hashes[w.ptr[r] : w.ptr[r + 1]].tobytes() for r in rows]
                own = [batch.column(c).slice(lo, hi - lo).take(pa.array(rows)) for c in ("row", "doc_id")]
                lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in ((at - w.ptr[row]).astype(np.int32), seed.view(np.int64))]
                yield pa.record_batch([*own, pa.array(words, pa.binary()), *lists], ["row", "doc_id", "words", "places", "seeds"])

    return suspects


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep, spans = [], []
        for i, shift in enumerate(batch.column("shift").to_pylist()):
            words, test = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint64) for c in ("words", "test"))
            found = overlap(words, test, shift)
            if found:
                keep.append(i)
                spans.append(found)
        if keep:
            columns = [pa.array(x, pa.int64()) for x in zip(*spans)]
            yield pa.record_batch([*[batch.column(c).take(pa.array(keep)) for c in ("row", "item", "doc_id", "item_id")], *columns], ["row", "item", "doc_id", "item_id", "n_equal", "begin", "end"])


def _joined(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """As contaminated(), by a join of seeds. Documents send only seeds that a map of the test seeds doesn't rule out; a
    seed, document or item with many rows is dealt over several tasks."""
    spark = docs.sparkSession
    ids, items = dict(docs.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"]
    named = benchmark.where("text is not null").select(F.monotonically_increasing_id().alias("item"), "item_id", "text")
    tests = settle(named.mapInArrow(_words_of, f"item long, item_id {items}, test binary, n long"), "tests")
    seeds = settle(tests.select("item", "test").mapInArrow(_seeds_of_items, "seed long, item long, pos long"), "test-seeds")
    lengths = [r[0] for r in tests.select(F.least("n", F.lit(OVERLAP)).cast("int")).distinct().collect()]  # OVERLAP + 1 at most
    bits = min(MAP_BITS, max(16, (16 * seeds.count()).bit_length()))
    parts = seeds.select("seed", F.shiftrightunsigned("seed", 58).cast("int").alias("part")).groupBy("part").applyInArrow(_bitmap(bits), "part int, bits binary").collect()  # 2^MAP_BITS bits
    filled = {r["part"]: bytes(r["bits"]) for r in parts}
    shared = spark.sparkContext.broadcast(b"".join(filled.get(k, bytes(1 << (bits - 9))) for k in range(64)))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    suspects = settle(rows.mapInArrow(_suspects(shared, tuple(_masks_for(iter(lengths))), bits), f"row long, doc_id {ids}, words binary, places array<int>, seeds array<long>"), "suspects")
    places = suspects.select("row", F.explode(F.arrays_zip("places", "seeds")).alias("x")).select("row", F.col("x.seeds").alias("seed"), F.col("x.places").alias("at"))
    hits = spread_join(places, seeds, "seed", "row", places.count()).select("row", "item", (F.col("at") - F.col("pos")).cast("long").alias("shift"))
    hits = settle(hits.distinct(), "hits")
    total = hits.count()
    laid = spread_join(spread_join(hits, suspects.select("row", "doc_id", "words"), "row", "item", total), tests.drop("n"), "item", "row", total)
    found = laid.select("row", "item", "doc_id", "item_id", "shift", "words", "test").mapInArrow(_verify, f"row long, item long, doc_id {ids}, item_id {items}, n_equal long, begin long, end long")
    best = found.groupBy("row", "item").agg(F.max(F.struct("n_equal", "begin", "end")).alias("b"), F.first("doc_id").alias("doc_id"), F.first("item_id").alias("item_id"))
    return best.select("doc_id", "item_id", "b.n_equal", "b.begin", "b.end")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_equal, begin and end (words) of each document's best overlap with each item that it contains.

    Words are lower-cased runs of letters, digits and non-ASCII characters. Null and empty texts overlap with nothing;
    items of fewer than 5 words must be met whole. Repeated rows and rows with null ids give results like any other;
    repeated items too. Clean documents give no row; with either table empty the result is empty. A benchmark of up to
    BROADCAST_BYTES is indexed and broadcast, a larger one joined by a shuffle, with the same result.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = _indexed(spark, benchmark)
    if shared is None:
        return _joined(docs, benchmark)
    ids, items = dict(docs.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"]
    return docs.select("doc_id", "text").mapInArrow(_scan(shared), f"doc_id {ids}, item_id {items}, n_equal long, begin long, end long")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that overlap with no item, in docs' columns; every row by its own text, whatever its id."""
    spark = docs.sparkSession
    ship(spark)
    shared = _indexed(spark, benchmark)
    if shared is None:
        rows, _ = rows_as_documents(docs)
        gone = settle(_joined(rows.select(F.col("_row").alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias("_row")).distinct(), "leaks")
        return by_ids(rows, gone, "_row", "left_anti", gone.count()).select(*docs.columns)
    kinds = dict(docs.dtypes)
    sent = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)])
    kept = sent.mapInArrow(_without(shared, docs.columns.index("text")), ", ".join(f"c{i} {kinds[c]}" for i, c in enumerate(docs.columns)))
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
