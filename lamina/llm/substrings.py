"""Removal of repeated word windows, found level by level.

Windows of a quarter of the length are looked at first; those found repeated alone are extended to twice that length,
and so on up to the full length; longest_repeats goes on until no candidates survive. Below the full length one
sub-window stands for all windows it is the minimizer of: it depends on the words alone, so a repeated window has a
repeated minimizer, and only about 2 of 17 positions are shuffled. Every level covers all rows; nothing is capped.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .identity import keyed
from .storage import by_groups, by_ids, settle
from .words import minimizers, whole, windows, word_chunks

_REGIONS = "key long, begins array<int>, sizes array<int>, hashes binary"
_EXCHANGE = "part int, hits binary, h binary, h2 binary, keys binary, counts binary, pos binary"
#: Points for each part of an exchange, and points that are sorted out at once before they are sent.
PER_PART, AT_ONCE = 400_000, 500_000


def _levels(window: int) -> list[int]:
    """Lengths below the full one: from about a quarter, doubling."""
    first = max(window // 4, 1)
    return [n for n in (first, 2 * first) if n < window]


def _chosen(hashes: np.ndarray, ptr: np.ndarray, length: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts of the whole windows, the minimizer of length words of each)."""
    starts = np.flatnonzero(whole(ptr, window))
    return starts, minimizers(windows(hashes, length), starts, window - length + 1)


@dataclass
class Points:
    """Windows by hash and place."""

    h: np.ndarray
    h2: np.ndarray
    keys: np.ndarray
    pos: np.ndarray

    def take(self, at: np.ndarray) -> Points:
        return Points(self.h[at], self.h2[at], self.keys[at], self.pos[at])


def _points(hashes: np.ndarray, at: np.ndarray, keys: np.ndarray, positions: np.ndarray, length: int) -> Points:
    return Points(windows(hashes, length)[at], (windows(hashes, length, 1)[at] >> np.uint64(32)).astype(np.uint32), keys[at], positions[at].astype(np.int32))


def _in_groups(p: Points) -> tuple[Points, np.ndarray, np.ndarray]:
    """(points by hash and place, begin of each group of equal hashes, group of each point)."""
    p = p.take(np.lexsort((p.pos, p.keys, p.h2, p.h)))
    fresh = np.ones(len(p.h), bool)
    fresh[1:] = (p.h[1:] != p.h[:-1]) | (p.h2[1:] != p.h2[:-1])
    return p, np.flatnonzero(fresh), np.cumsum(fresh) - 1


def _by_key(p: Points) -> tuple[Points, np.ndarray]:
    """(points by place, begin of each key)."""
    p = p.take(np.lexsort((p.pos, p.keys)))
    return p, np.flatnonzero(np.append(True, p.keys[1:] != p.keys[:-1]))[: len(p.keys)]


def _sender(points, parts: int, all_of_group: bool):
    """An exchange's first half: points gives Points for a batch. What is repeated within AT_ONCE points is settled here,
    and each hash goes on once, so a hash of a third of all rows does not flood its part.

    all_of_group: every point of a repeated hash is a hit; else all but the first by key and position.
    """

    def pack(held: list[Points]) -> Iterator[pa.RecordBatch]:
        p, begin, group = _in_groups(Points(*(np.concatenate([getattr(x, c) for x in held]) for c in ("h", "h2", "keys", "pos"))))
        size = np.diff(np.append(begin, len(p.h)))
        hit = size[group] > 1
        if not all_of_group:
            hit[begin] = False
        done, key_begin = _by_key(p.take(np.flatnonzero(hit)))
        p, twice = p.take(begin), size > 1
        if all_of_group:  # the lowest bit says that the hash is known to repeat and the point known to be a hit
            p.h2 = (p.h2 & ~np.uint32(1)) | twice.astype(np.uint32)
        part = ((p.h >> np.uint64(20)) % np.uint64(parts)).astype(np.int32)
        order = np.lexsort((p.pos, p.keys, part))
        p, part = p.take(order), part[order]
        columns: list[list] = [[] for _ in range(7)]
        cuts = np.flatnonzero(np.diff(part)) + 1
        for at in np.split(np.arange(len(part)), cuts):
            keys = p.keys[at]
            runs = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            row = (int(part[at[0]]), None, p.h[at].tobytes(), p.h2[at].tobytes(), keys[runs].tobytes(), np.diff(np.append(runs, len(at))).astype(np.uint32).tobytes(), p.pos[at].tobytes())
            for c, x in zip(columns, row):
                c.append(x)
        for lo in range(0, len(key_begin), 4096):  # hits found here travel along
            runs = key_begin[lo : lo + 4096]
            stop = key_begin[lo + 4096] if lo + 4096 < len(key_begin) else len(done.keys)
            row = (int(done.keys[runs[0]]) % parts, b"", b"", b"", done.keys[runs].tobytes(), np.diff(np.append(runs, stop)).astype(np.uint32).tobytes(), done.pos[runs[0] : stop].tobytes())
            for c, x in zip(columns, row):
                c.append(x)
        yield pa.record_batch([pa.array(columns[0], pa.int32()), *[pa.array(c, pa.binary()) for c in columns[1:]]], [c.split()[0] for c in _EXCHANGE.split(", ")])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for p in points(batch):
                held.append(p)
                n += len(p.h)
                if n >= AT_ONCE:
                    yield from pack(held)
                    held, n = [], 0
        if n:
            yield from pack(held)

    return send


def _blob(column: pa.ChunkedArray, kind) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _receiver(parts: int, all_of_group: bool):
    """An exchange's second half: the hits of one part, packed for the parts that their keys go to."""

    def receive(table: pa.Table) -> pa.Table:
        known = pc.is_valid(table["hits"])
        out = []
        for rows, settled in ((table.filter(known), True), (table.filter(pc.invert(known)), False)):
            keys = np.repeat(_blob(rows["keys"], np.int64), _blob(rows["counts"], np.uint32))
            pos = _blob(rows["pos"], np.int32)
            if settled:
                none = np.zeros(len(keys), np.uint8)
                out.append(Points(none, none, keys, pos))
                continue
            h2 = _blob(rows["h2"], np.uint32)
            twice = h2 & np.uint32(all_of_group)
            flagged = Points(_blob(rows["h"], np.uint64), h2 & ~np.uint32(all_of_group), keys, pos)
            order = np.lexsort((pos, keys, flagged.h2, flagged.h))
            p, twice = flagged.take(order), twice[order]
            fresh = np.ones(len(p.h), bool)
            fresh[1:] = (p.h[1:] != p.h[:-1]) | (p.h2[1:] != p.h2[:-1])
            begin, group = np.flatnonzero(fresh), np.cumsum(fresh) - 1
            if all_of_group:
                size = np.diff(np.append(begin, len(p.h)))
                repeated = (size > 1) | (np.maximum.reduceat(twice, begin) > 0) if len(begin) else size > 1
                hit = repeated[group] & (twice == 0) if len(group) else np.zeros(0, bool)
            else:
                hit = ~fresh
            p = p.take(np.flatnonzero(hit))
            out.append(Points(np.zeros(len(p.keys), np.uint8), np.zeros(len(p.keys), np.uint8), p.keys, p.pos))
        p = Points(*(np.concatenate([getattr(x, c) for x in out]) for c in ("h", "h2", "keys", "pos")))
        dest = (p.keys % parts).astype(np.int32)
        order = np.lexsort((p.pos, p.keys, dest))
        p, dest = p.take(order), dest[order]
        rows = []
        for at in np.split(np.arange(len(dest)), np.flatnonzero(np.diff(dest)) + 1) if len(dest) else []:
            rows.append((int(dest[at[0]]), p.keys[at].tobytes(), p.pos[at].tobytes()))
        return pa.table({"dest": pa.array([r[0] for r in rows], pa.int32()), "keys": pa.array([r[1] for r in rows], pa.binary()), "pos": pa.array([r[2] for r in rows], pa.binary())})

    return receive


def _gather(table: pa.Table) -> pa.Table:
    """The hits of each key that one destination got from all parts."""
    keys, pos = _blob(table["keys"], np.int64), _blob(table["pos"], np.int32)
    order = np.lexsort((pos, keys))
    keys, pos = keys[order], pos[order]
    begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))[: len(keys)]
    return pa.table({"key": pa.array(keys[begin], pa.int64()), "hits": pa.ListArray.from_arrays(np.append(begin, len(keys)).astype(np.int32), pa.array(pos, pa.int32()))})


def _exchange(df: DataFrame, points, expected: float, all_of_group: bool) -> DataFrame:
    """key and the positions of its hits."""
    parts = max(1, math.ceil(expected / PER_PART))
    sent = df.mapInArrow(_sender(points, parts, all_of_group), _EXCHANGE)
    found = sent.groupBy("part").applyInArrow(_receiver(parts, all_of_group), "dest int, keys binary, pos binary")
    return found.groupBy("dest").applyInArrow(_gather, "key long, hits array<int>")


def _text_points(length: int, window: int):
    def points(batch: pa.RecordBatch) -> Iterator[Points]:
        keys = batch.column("key").to_numpy(zero_copy_only=False)
        for lo, _, w in word_chunks(batch.column("text")):
            _, at = _chosen(w.hashes, w.ptr, length, window)
            if len(at):
                row = w.row_of
                yield _points(w.hashes, np.unique(at), keys[lo + row], np.arange(len(row)) - w.ptr[row], length)

    return points


def _hits(batch: pa.RecordBatch, rows: slice, n: int, ptr: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Flags of the word positions listed in column hits; ptr: first word of each row, base: position of that word."""
    hits = batch.column("hits").slice(rows.start, rows.stop - rows.start)
    flat = hits.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(hits)), hits.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    flags = np.zeros(n + 1, bool)
    flags[ptr[row] + flat - base[row]] = True
    return flags


def _cut(keep: np.ndarray, window: int, n: int, ptr: np.ndarray, keys: np.ndarray, hashes: np.ndarray, base: np.ndarray) -> pa.RecordBatch | None:
    """The parts of rows that the kept windows cover; base: word position of each row's first word."""
    if not len(keep):
        return None
    cover = np.zeros(n + 1, np.int32)
    np.add.at(cover, keep, 1)
    np.add.at(cover, keep + window, -1)
    covered = np.cumsum(cover[:n]) > 0
    row = np.repeat(np.arange(len(ptr) - 1), np.diff(ptr))
    edge = np.ones(n, bool)
    edge[1:] = ~covered[:-1] | (row[1:] != row[:-1])
    begin = np.flatnonzero(covered & edge)
    size = np.diff(np.append(np.cumsum(covered)[begin] - 1, covered.sum()))
    of = row[begin]
    some, first = np.unique(of, return_index=True)
    offsets = np.append(first, len(begin)).astype(np.int32)
    parts = [hashes[row_lo:row_hi][covered[row_lo:row_hi]].tobytes() for row_lo, row_hi in zip(ptr[some], ptr[some + 1])]
    local = (begin - ptr[of] + base[of]).astype(np.int32)
    return pa.record_batch(
        [pa.array(keys[some], pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(local)), pa.ListArray.from_arrays(offsets, pa.array(size.astype(np.int32))), pa.array(parts, pa.binary())],
        ["key", "begins", "sizes", "hashes"],
    )


def _text_regions(length: int, window: int):
    def regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            for lo, hi, w in word_chunks(batch.column("text")):
                n = len(w.hashes)
                flags = _hits(batch, slice(lo, hi), n, w.ptr[:-1], np.zeros(hi - lo, np.int64))
                starts, at = _chosen(w.hashes, w.ptr, length, window)
                out = _cut(starts[flags[at]], window, n, w.ptr, keys[lo:hi], w.hashes, np.zeros(hi - lo, np.int64))
                if out:
                    yield out

    return regions


def _unpack(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, ptr of the regions, row of each region, key of each region, its first word's position)."""
    sizes = batch.column("sizes")
    row = np.repeat(np.arange(len(batch)), sizes.value_lengths().to_numpy())
    size = sizes.flatten().to_numpy().astype(np.int64)
    hashes = np.frombuffer(b"".join(batch.column("hashes").to_pylist()), np.uint64)
    return hashes, np.append(0, np.cumsum(size)), row, batch.column("key").to_numpy()[row], batch.column("begins").flatten().to_numpy().astype(np.int64)


def _pieces(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    for lo in range(0, len(batch), rows):
        yield batch.slice(lo, rows)


def _region_points(length: int, window: int):
    def points(batch: pa.RecordBatch) -> Iterator[Points]:
        for piece in _pieces(batch):
            hashes, ptr, _, keys, begins = _unpack(piece)
            _, at = _chosen(hashes, ptr, length, window)
            if len(at):
                region = np.repeat(np.arange(len(begins)), np.diff(ptr))
                yield _points(hashes, np.unique(at), keys[region], np.arange(len(hashes)) - ptr[region] + begins[region], length)

    return points


def _full_windows(length: int, window: int):
    """The windows whose minimizer of length words was found repeated; length 0: all windows of the regions."""

    def full(batch: pa.RecordBatch) -> Iterator[Points]:
        for piece in _pieces(batch):
            hashes, ptr, row, keys, begins = _unpack(piece)
            region = np.repeat(np.arange(len(begins)), np.diff(ptr))
            position = np.arange(len(hashes)) - ptr[region] + begins[region]
            starts = np.flatnonzero(whole(ptr, window))
            if length:
                at = minimizers(windows(hashes, length), starts, window - length + 1)
                hits = piece.column("hits")
                hit_row = np.repeat(np.arange(len(piece)), hits.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
                listed = (hit_row << 40) | hits.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                starts = starts[np.isin((row[region[at]] << 40) | position[at], listed)]
            if len(starts):
                yield _points(hashes, starts, keys[region], position, window)

    return full


def _finish(window: int):
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, hits, copies = batch.column("text"), batch.column("hits"), batch.column("copy").to_pylist()
            out: dict[str, list] = {"n_words": [], "n_removed": [], "kept_sha256": [], "spans": []}
            for text, positions, copy in zip(texts, hits, copies):
                words = text.as_buffer().to_pybytes().split()
                n = len(words)
                spans: list[list[int]] = []
                if copy and n >= window:
                    spans = [[0, n]]
                elif positions.is_valid:
                    for p in np.sort(positions.values.to_numpy()).tolist():
                        if spans and p <= spans[-1][1]:
                            spans[-1][1] = p + window
                        else:
                            spans.append([p, p + window])
                kept, last = [], 0
                for a, b in spans:
                    kept += words[last:a]
                    last = b
                kept += words[last:]
                out["n_words"].append(n)
                out["n_removed"].append(n - len(kept))
                out["kept_sha256"].append(hashlib.sha256(b" ".join(kept)).hexdigest())
                out["spans"].append([{"begin": a, "end": b} for a, b in spans])
            span = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
            yield pa.record_batch([batch.column("doc_id"), pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["kept_sha256"], pa.string()), pa.array(out["spans"], span)], ["doc_id", "n_words", "n_removed", "kept_sha256", "spans"])

    return finish


def _first_of_texts(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(keyed docs, those with the first key of their text, keys of the others)."""
    found = keyed(docs)
    firsts = settle(found.names.groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1"), "firsts")
    copies = settle(by_groups(found.names, firsts, ["digest"], "n", firsts.count(), found.names.count()).where("key > first").select("key"), "copies")
    return found.texts, by_ids(found.once, copies, "key", "left_anti", copies.count()), copies


def _later(singles: DataFrame, window: int, all_of_group: bool = False) -> DataFrame:
    """key and the starts of its windows whose words also start earlier (or, all_of_group, anywhere else), level after level."""
    first, *rest = _levels(window)
    slim = singles.select("key", "text")
    words = (slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / 6
    hits = _exchange(slim, _text_points(first, window), words * 2 / (window - first + 2), True)
    regions = slim.join(hits.hint("shuffle_hash"), "key").mapInArrow(_text_regions(first, window), _REGIONS)
    regions = settle(regions, "regions")
    words = (regions.agg(F.sum(F.octet_length("hashes"))).first()[0] or 0) / 8
    found, length = regions, 0
    for length in rest:
        hits = _exchange(regions, _region_points(length, window), words * 2 / (window - length + 2), True)
        found = regions.join(hits.hint("shuffle_hash"), "key")
    return _exchange(found, _full_windows(length, window), words, all_of_group)


def _longer_windows(length: int):
    """Windows of twice the length whose two halves were both found repeated."""

    def points(batch: pa.RecordBatch) -> Iterator[Points]:
        keys = batch.column("key").to_numpy(zero_copy_only=False)
        for lo, hi, w in word_chunks(batch.column("text")):
            flags = _hits(batch, slice(lo, hi), len(w.hashes), w.ptr[:-1], np.zeros(hi - lo, np.int64))
            starts = np.flatnonzero(whole(w.ptr, 2 * length))
            starts = starts[flags[starts] & flags[starts + length]]
            if len(starts):
                row = w.row_of
                yield _points(w.hashes, starts, keys[lo + row], np.arange(len(row)) - w.ptr[row], 2 * length)

    return points


def longest_repeats(docs: DataFrame, window: int = 20) -> DataFrame:
    """doc_id, longest and n_starts for every row of docs: the longest of window, 2 * window, 4 * window and so on for which
    so many consecutive words of the document occur twice or more in the table, and how many such windows it has.

    Windows repeated at one length alone are extended to twice that length, until none is left. Documents without a
    repeated window get 0 and 0; rows with equal id and text are one document; an empty table gives an empty result.
    """
    found = keyed(docs)
    slim = found.once.select("key", "text")
    hits = settle(_later(found.once, window, True), "repeats")
    out, length = hits.select("key", F.lit(window).alias("longest"), F.size("hits").alias("n_starts")), window
    while total := hits.agg(F.sum(F.size("hits"))).first()[0]:
        hits = settle(_exchange(slim.join(hits.hint("shuffle_hash"), "key"), _longer_windows(length), total, True), "repeats")
        length *= 2
        out = out.unionByName(hits.select("key", F.lit(length).alias("longest"), F.size("hits").alias("n_starts")))
    best = out.groupBy("key").agg(F.max(F.struct("longest", "n_starts")).alias("b"))
    named = found.texts.select("doc_id", "key").join(best, "key", "left")
    return named.select("doc_id", F.coalesce("b.longest", F.lit(0)).cast("long").alias("longest"), F.coalesce("b.n_starts", F.lit(0)).cast("long").alias("n_starts"))


def remove_repeats(docs: DataFrame, window: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and the removed spans of words for every row of docs.

    A word goes if a window of so many consecutive words covers it whose words also start earlier: in a document with a
    smaller id, or earlier in its own. Texts with fewer words keep all; null texts have no words. Rows with equal id
    and text are one document and get one result each; null ids come last; an empty table gives an empty result.
    Windows are compared by 96-bit hashes. window must be at least 2.
    """
    texts, singles, copies = _first_of_texts(docs)
    hits = _later(singles, window).select("key", "hits", F.lit(False).alias("copy"))
    marks = hits.unionByName(copies.select("key", F.lit(None).cast("array<int>").alias("hits"), F.lit(True).alias("copy")))
    kind = dict(docs.dtypes)["doc_id"]
    marked = texts.join(marks.hint("shuffle_hash"), "key", "left").select("doc_id", "text", "hits", F.coalesce("copy", F.lit(False)).alias("copy"))
    return marked.mapInArrow(_finish(window), f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, spans array<struct<begin:int,end:int>>")


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
starts AS (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 19)) AS i FROM w WHERE len(ws) >= 20),
later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS g FROM starts)
  QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM later, range(20) t(k)),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(generate_series(1, len(ws))) AS i FROM w),
marked AS (SELECT words.doc_id, word, words.i, gone.i IS NOT NULL AS removed FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.i = words.i),
done AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (removed) AS n_removed,
         coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT removed), '') AS kept
  FROM marked GROUP BY doc_id)
SELECT w.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN done USING (doc_id)
"""
