"""Exact N-gram Jaccard join by a universe-partition pigeonhole.

Documents are sets of hashed word shingles. Sizes fall into bands, each 1.25 times as large as the one before, so that
a set's partners lie in its own band or a neighbouring one. In each band a hash deals all possible shingles to m
segments. Two sets over the threshold differ in at most H shingles, so among any choice of segments whose allowances sum
to H + 1 one differs by less than its allowance: by nothing (allowance 1, the segments are equal) or by one shingle
(allowance 2, one is the other or the other's one-deletion neighbour). A set offers its segments to its band and probes
with those whose allowances cost least; empty ones are never indexed. Whether a band offers one-deletion neighbours is
decided by cost too. All candidates are verified on the whole sets; equal sets are collapsed first.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .identity import Keyed, keyed, rows_as_documents
from .storage import by_groups, by_ids, settle, spread_join
from .words import mix64, whole, windows, word_chunks

STRONG, DELETED, MARKED, FLAGS = np.uint64(1), np.uint64(2), np.uint64(4), np.uint64(7)
#: For the cost estimate: shingles that unrelated sets are taken to share (set phrases), and a candidate's cost in index rows.
SHARED, CANDIDATE = 8, 4.0
#: Index rows for each part of the index.
ROWS_PER_PART = 1_000_000
#: Sets of one signature that a pack of ROWS_PER_PART sends to the signature's part one by one at most.
LOCAL = 64
#: Sets of a bucket that one task compares with as many others.
CHUNK = 1024


def _salt(x: int) -> np.uint64:
    return np.uint64((x * 0x9E3779B97F4A7C15 + 0x7F4A7C15) & 0xFFFFFFFFFFFFFFFF)


# --- sets ---------------------------------------------------------------------------------------------------------


def shingle_sets(texts: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, sorted distinct shingle hashes row after row, their ptr), chunk after chunk."""
    for lo, hi, w in word_chunks(texts, lower=True):
        n, row = hi - lo, w.row_of
        at = np.flatnonzero(whole(w.ptr, size))
        hashes, rows = windows(w.hashes, size)[at] if len(at) else np.zeros(0, np.uint64), row[at]
        counts = np.diff(w.ptr)
        for short in range(1, size):  # fewer words: the whole sequence
            some = np.flatnonzero(counts == short)
            if len(some):
                hashes = np.append(hashes, mix64(windows(w.hashes, short)[w.ptr[some]] + _salt(short)))
                rows = np.append(rows, some)
        order = np.lexsort((hashes, rows))
        hashes, rows = hashes[order], rows[order]
        fresh = np.ones(len(rows), bool)
        fresh[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
        hashes, rows = hashes[fresh], rows[fresh]
        yield lo, hi, hashes, np.searchsorted(rows, np.arange(n + 1))


def _sums(values: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    upto = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=upto[1:])
    return upto[ptr[1:]] - upto[ptr[:-1]]


def _describe(size: int):
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, hashes, ptr in shingle_sets(batch.column("text"), size):
                digests = [pa.array(_sums(mix64(hashes + _salt(k)), ptr).view(np.int64)) for k in (1, 2)]
                yield pa.record_batch([batch.column("key").slice(lo, hi - lo), pa.array(np.diff(ptr)), *digests], ["key", "n", "d1", "d2"])

    return describe


def _parities(hashes: np.ndarray, ptr: np.ndarray) -> list[bytes]:
    """A bitmap for each set: the parity of the members in each of its buckets, at least two buckets for each member.

    Every member that two sets don't share flips at most one bit, so the bits in which their bitmaps differ are no more
    than the members in which the sets do. Numbers of buckets are powers of two; halves are folded by exclusive or.
    """
    out = []
    for a, b in zip(ptr[:-1], ptr[1:]):
        bits = 64 << max(0, int(2 * (b - a) - 1).bit_length() - 6)
        count = np.bincount((hashes[a:b] >> np.uint64(20)).astype(np.int64) & (bits - 1), minlength=bits) & 1
        out.append(np.packbits(count.astype(np.uint8)).tobytes())
    return out


def _fold(bitmap: bytes, size: int) -> np.ndarray:
    x = np.frombuffer(bitmap, np.uint64)
    while len(x) * 8 > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


_SETS = "key long, n long, parity binary, members binary"


def _sets(size: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, hashes, ptr in shingle_sets(batch.column("text"), size):
                members = [hashes[a:b].tobytes() for a, b in zip(ptr[:-1], ptr[1:])]
                yield pa.record_batch([batch.column("key").slice(lo, hi - lo), pa.array(np.diff(ptr)), pa.array(_parities(hashes, ptr), pa.binary()), pa.array(members, pa.binary())], ["key", "n", "parity", "members"])

    return sets


# --- bands and signatures -----------------------------------------------------------------------------------------


class Plan:
    """Bands of set sizes for a threshold of numerator / denominator, and how each is segmented."""

    def __init__(self, num: int, den: int, largest: int, counts: dict[int, int] | None = None):
        self.num, self.den = num, den
        self.floor = [1]
        while self.floor[-1] <= largest:
            self.floor.append(max(self.floor[-1] + 1, -(-self.floor[-1] * den // num)))
        self.segments, self.deletes, self.unlike = [], [], []
        for k in range(len(self.floor) - 1):
            top = self.floor[k + 1] - 1
            need = self.differ(top, top * den // num) + 1
            n = (counts or {}).get(k, 0)
            half = -(-need // 2)
            exact_m, del_m = math.ceil(1.15 * need), math.ceil(1.15 * half)
            alike = min(SHARED / top, 0.9)
            exact = exact_m + need + CANDIDATE * n * need * alike ** (top / exact_m)
            near = 2 * (del_m + top) + CANDIDATE * n * half * (1 + top / del_m) * alike ** max(top / del_m - 1, 0)
            self.deletes.append(near < exact)
            self.segments.append(del_m if near < exact else exact_m)
            self.unlike.append((n, alike))

    def differ(self, a: int, b: int) -> int:
        """How many members sets of sizes a and b over the threshold differ in at most."""
        return (a + b) * (self.den - self.num) // (self.den + self.num)

    def band(self, size: int) -> int:
        return bisect_right(self.floor, size) - 1

    def probes(self, size: int) -> Iterator[tuple[int, int, bool]]:
        """(band, allowance needed, whether all segments are offered): the own band, then the one below if it matters.

        In its own band a set needs enough for any partner up to the band above, so that it finds one of these that
        has too few segments with members to probe itself.
        """
        k = self.band(size)
        yield k, self.differ(size, size * self.den // self.num) + 1, True
        below = self.floor[k] - 1
        if k and below * self.den >= size * self.num:
            yield k - 1, self.differ(size, below) + 1, False

    def allowances(self, band: int, filled: np.ndarray, need: np.ndarray) -> np.ndarray:
        """For each set (row) and segment 0, 1 or 2, from the number of members: the cheapest choice that sums to need.

        An empty segment gets 0, one with a single member at most 1, so all index entries have members. The second step
        of a segment costs more than its first, so the least steps are the cheapest choice. Where all steps are too
        few, every allowance is 0.
        """
        n, alike = self.unlike[band]
        rows, m = filled.shape
        cost = -filled  # first steps: the larger the segment, the fewer unrelated sets share it
        if self.deletes[band]:
            size = np.arange(int(filled.max(initial=0)) + 1)
            first = 1 + CANDIDATE * n * alike**size
            second = np.where(size > 1, size * (1 + CANDIDATE * n * alike ** np.maximum(size - 1, 0)), np.inf)
            cost = np.concatenate([first[filled], second[filled]], 1)
        most = int(need.max(initial=0))
        order = np.argsort(cost, axis=1, kind="stable")[:, :most]
        taken = np.zeros(cost.size, np.int8)
        chosen = np.arange(order.shape[1]) < need[:, None]
        taken[(order + np.arange(rows)[:, None] * cost.shape[1])[chosen]] = 1
        taken = taken.reshape(rows, -1)
        out = taken[:, :m] * (filled > 0)
        if self.deletes[band]:
            out += taken[:, m:] * (filled > 1)
        out[out.sum(1) < need] = 0
        return out


def _signatures(plan: Plan, hashes: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signature with its flag bits, row) of everything that the sets offer and probe.

    A set with too few segments with members can't probe; it offers all it has, also to the band below, and is dealt
    anew with another hash, among sets of its kind, until it can. Of two linked sets, take the first dealing in which
    one can probe: the other one is dealt so too and finds or is found.
    """
    out, owners = [], []
    sizes = np.diff(ptr)
    tasks: dict[tuple[int, bool], list[tuple[int, int]]] = {}
    for size in np.unique(sizes[sizes > 0]).tolist():
        for band, need, offer in plan.probes(size):
            tasks.setdefault((band, offer), []).append((size, need))
    row_of = np.repeat(np.arange(len(sizes)), sizes)
    for (band, offer), wanted in tasks.items():
        m, deletes = plan.segments[band], plan.deletes[band]
        need_of = np.zeros(max(size for size, _ in wanted) + 1, np.int64)
        for size, need in wanted:
            need_of[size] = need
        need = np.where(sizes < len(need_of), need_of[np.minimum(sizes, len(need_of) - 1)], 0)
        rest, turn = np.flatnonzero(need), 0
        while len(rest):
            local = np.full(len(sizes), -1)
            local[rest] = np.arange(len(rest))
            some = local[row_of] >= 0
            dealt = mix64(hashes[some] + _salt(1000 + band + 100_000 * turn))
            flat = (dealt >> np.uint64(33)).astype(np.int64) % m + local[row_of[some]] * m
            weights = mix64(dealt + _salt(7))
            sums = np.zeros(len(rest) * m, np.uint64)
            np.add.at(sums, flat, weights)
            filled = np.bincount(flat, minlength=len(rest) * m).reshape(-1, m)
            allowed = plan.allowances(band, filled, need[rest])
            probing = allowed.any(1)
            allowed, filled = allowed.ravel(), filled.ravel()
            every = np.repeat(~probing | offer, m)
            salt = mix64(np.arange(m, dtype=np.uint64) + _salt(5000 + band + 100_000 * turn))
            mine = np.flatnonzero((filled > 0) & (every | (allowed > 0)))
            out.append((mix64(sums[mine] + salt[mine % m]) & ~FLAGS) | np.where(allowed[mine] > 0, STRONG, np.uint64(0)))
            owners.append(rest[mine // m])
            if deletes:
                inside = (filled[flat] > 1) & (every[flat] | (allowed[flat] > 1))
                at, w = flat[inside], weights[inside]
                out.append((mix64(sums[at] - w + salt[at % m]) & ~FLAGS) | DELETED | np.where(allowed[at] > 1, STRONG, np.uint64(0)))
                owners.append(rest[at // m])
            rest, turn = rest[~probing], turn + 1
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(owners)


_INDEX = "part int, signatures binary, keys binary, counts binary"


def _leading(keys: np.ndarray, flags: np.ndarray, *before: np.ndarray) -> np.ndarray:
    """Order by `before`, then the leader of a bucket first: a whole segment, a probe, then the least scrambled key."""
    return np.lexsort((mix64(keys.view(np.uint64)), ~flags & 1, flags & 2, *before))


def _index(size: int, plan: Plan, parts: int):
    """Packs of signatures and keys for each part. What is in over LOCAL sets of a pack is a list of its own, sent to one
    of as many further parts; only its leader, marked, goes to the signature's part. So no part gets a hot bucket."""

    def pack(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        signatures, owners = (np.concatenate(x) for x in zip(*held))
        part = ((signatures >> np.uint64(34)) % np.uint64(parts)).astype(np.int32)
        body = signatures & ~FLAGS
        names, of, times = np.unique(body, return_inverse=True, return_counts=True)
        hot = times[of] > LOCAL
        columns: list[list] = [[], [], [], []]
        if hot.any():
            at = np.flatnonzero(hot)
            at = at[_leading(owners[at], signatures[at].astype(np.int64), of[at])]
            begin = np.flatnonzero(np.append(True, of[at][1:] != of[at][:-1]))
            for group in np.split(at, begin[1:]):
                own = np.append(np.flatnonzero(np.append(True, owners[group][1:] != owners[group][:-1])), len(group))
                dest = parts + int(mix64(body[group[:1]] ^ owners[group[:1]].astype(np.uint64))[0] % np.uint64(parts))
                for c, x in zip(columns, (dest, signatures[group].tobytes(), owners[group][own[:-1]].tobytes(), np.diff(own).astype(np.uint32).tobytes())):
                    c.append(x)
            lead = at[begin]
            stay = ~hot
            signatures = np.concatenate([signatures[stay], signatures[lead] | MARKED])
            owners, part = np.concatenate([owners[stay], owners[lead]]), np.concatenate([part[stay], part[lead]])
        order = np.lexsort((owners, part))
        signatures, owners, part = signatures[order], owners[order], part[order]
        cuts = np.flatnonzero(np.diff(part)) + 1
        for sig, own, p in zip(np.split(signatures, cuts), np.split(owners, cuts), part[np.append(0, cuts)]):
            at = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            for c, x in zip(columns, (int(p), sig.tobytes(), own[at].tobytes(), np.diff(np.append(at, len(own))).astype(np.uint32).tobytes())):
                c.append(x)
        yield pa.record_batch([pa.array(columns[0], pa.int32()), *[pa.array(c, pa.binary()) for c in columns[1:]]], ["part", "signatures", "keys", "counts"])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            keys = batch.column("key").to_numpy()
            for lo, _, hashes, ptr in shingle_sets(batch.column("text"), size):
                signatures, owners = _signatures(plan, hashes, ptr)
                if len(signatures):
                    held.append((signatures, keys[lo + owners]))
                    rows += len(signatures)
                if rows > ROWS_PER_PART:
                    yield from pack(held)
                    held, rows = [], 0
        if rows:
            yield from pack(held)

    return index


_PAIRS = "a long, b long"
_BUCKETS = "a long, b long, list long, members array<long>, flags array<int>"


def _stars(bucket: np.ndarray, keys: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """The valid pairs of each bucket's leader with its others; all is ordered as by _leading."""
    begin = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))[: len(bucket)]
    size = np.diff(np.append(begin, len(bucket)))
    lead, lead_flags = np.repeat(keys[begin], size), np.repeat(flags[begin], size)
    valid = (keys != lead) & (((flags | lead_flags) & 1) == 1) & ((flags & lead_flags & 2) == 0)
    return np.stack([np.minimum(lead, keys), np.maximum(lead, keys)], 1)[valid]


def _lists_of_packs(table: pa.Table) -> tuple[np.ndarray, list[tuple]]:
    """Stars and lists of hot buckets, one row of the table each."""
    pairs, lists = [], []
    for sig, key, count in zip(*(table.column(c).to_pylist() for c in ("signatures", "keys", "counts"))):
        sig = np.frombuffer(sig, np.uint64)
        keys, flags = np.repeat(np.frombuffer(key, np.int64), np.frombuffer(count, np.uint32)), (sig & np.uint64(3)).astype(np.int64)
        pairs.append(_stars(np.zeros(len(keys), np.int64), keys, flags))
        lists.append((int((sig[:1] & ~FLAGS).view(np.int64)[0]), keys, flags))
    return np.concatenate(pairs), lists


def _buckets(parts: int):
    def buckets(table: pa.Table) -> pa.Table:
        """Of one part of the index: leader and member of each bucket as (a, b); buckets of over two sets as lists besides."""
        if table.column("part")[0].as_py() >= parts:
            pairs, lists = _lists_of_packs(table)
            return _as_table(pairs, lists)
        blobs = [np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("signatures", np.uint64), ("keys", np.int64), ("counts", np.uint32))]
        signatures, keys = blobs[0], np.repeat(blobs[1], blobs[2])
        body = signatures & ~FLAGS
        order = np.argsort(body, kind="stable")
        body = body[order]
        begin = np.flatnonzero(np.append(True, body[1:] != body[:-1]))
        size = np.diff(np.append(begin, len(body)))
        inside = np.repeat(size > 1, size)
        order, bucket, body = order[inside], np.repeat(np.arange(len(begin)), size)[inside], body[inside]
        keys, flags = keys[order], (signatures[order] & FLAGS).astype(np.int64)
        # one row for each key of a bucket; a whole segment counts before a deletion, a probe before an offer
        order = np.lexsort((flags & 3 ^ 1, keys, bucket))
        bucket, keys, flags, body = bucket[order], keys[order], flags[order], body[order]
        fresh = np.append(True, (bucket[1:] != bucket[:-1]) | (keys[1:] != keys[:-1]))[: len(keys)]
        first = np.flatnonzero(fresh)
        either = np.bitwise_or.reduceat(flags & 5, first) if len(first) else flags
        bucket, keys, flags, body = bucket[fresh], keys[fresh], (flags[fresh] & 2) | either, body[fresh]
        begin = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))[: len(bucket)]
        size = np.diff(np.append(begin, len(bucket)))
        if len(begin):
            marked = np.bitwise_or.reduceat(flags & 4, begin) > 0
            live = (size > 1) & (marked | (np.maximum.reduceat(flags & 1, begin) == 1) & (np.minimum.reduceat(flags & 2, begin) == 0))
        else:
            marked = live = np.zeros(0, bool)
        inside = np.repeat(live, size)
        marked = np.repeat(marked, size)[inside]
        bucket, keys, flags, body = np.repeat(np.arange(len(begin)), size)[inside], keys[inside], flags[inside], body[inside]
        order = _leading(keys, flags, bucket)
        bucket, keys, flags, body, marked = bucket[order], keys[order], flags[order] & 3, body[order], marked[order]
        begin = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))[: len(bucket)]
        size = np.diff(np.append(begin, len(bucket)))
        lists: dict[tuple, tuple] = {}
        for a, n in zip(begin, size):
            if n > 2 or marked[a]:
                by_key = np.argsort(keys[a : a + n], kind="stable")
                name = int(body[a : a + 1].view(np.int64)[0]) if marked[a] else None
                entry = name, keys[a : a + n][by_key], flags[a : a + n][by_key]
                lists.setdefault((name, entry[1].tobytes(), entry[2].tobytes()), entry)
        return _as_table(np.unique(_stars(bucket, keys, flags), axis=0), list(lists.values()))

    return buckets


def _as_table(pairs: np.ndarray, lists: list[tuple]) -> pa.Table:
    none, no_list = [None] * len(lists), [None] * len(pairs)
    return pa.table(
        {
            "a": pa.array([*pairs[:, 0].tolist(), *none], pa.int64()),
            "b": pa.array([*pairs[:, 1].tolist(), *none], pa.int64()),
            "list": pa.array([*no_list, *[name for name, _, _ in lists]], pa.int64()),
            "members": pa.array([*no_list, *[x.tolist() for _, x, _ in lists]], pa.list_(pa.int64())),
            "flags": pa.array([*no_list, *[x.tolist() for _, _, x in lists]], pa.list_(pa.int32())),
        }
    )


# --- the join -----------------------------------------------------------------------------------------------------


def _verify(num: int, den: int):
    """Pairs (a, b) whose sets' intersection is at least num / den of their union."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("left"), batch.column("right")
            keep = []
            for i in range(len(batch)):
                x, y = (np.frombuffer(c[i].as_buffer(), np.uint64) for c in (left, right))
                n = len(x) + len(y)
                if min(len(x), len(y)) * den < max(len(x), len(y)) * num:
                    continue
                at = np.searchsorted(x, y)
                at[at == len(x)] = 0
                shared = int((x[at] == y).sum())
                if shared * den >= num * (n - shared):
                    keep.append(i)
            if keep:
                yield batch.select(["a", "b"]).take(pa.array(keep))

    return verify


def _near(num: int, den: int):
    """Pairs (a, b) whose bitmaps don't rule them out."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, q, n, m = (batch.column(c).to_pylist() for c in ("p", "q", "n", "m"))
            keep = []
            for i in range(len(batch)):
                size = min(len(p[i]), len(q[i]))
                differ = int(np.bitwise_count(_fold(p[i], size) ^ _fold(q[i], size)).sum())
                if differ <= (n[i] + m[i]) * (den - num) // (den + num) and min(n[i], m[i]) * den >= max(n[i], m[i]) * num:
                    keep.append(i)
            if keep:
                yield batch.select(["a", "b"]).take(pa.array(keep))

    return near


def _across(num: int, den: int, closest: bool):
    """Of one chunk of a bucket against another: the pairs of sets in different components whose bitmaps don't rule them
    out. Sets marked left meet those marked right; a pair whose ends are both outside the bucket's largest component
    comes up twice and counts where the lesser key is on the left.

    closest: for each set only the pair whose bitmaps differ least with each other component.
    """

    def across(table: pa.Table) -> pa.Table:
        flags, label, n, keys = (table[c].to_numpy() for c in ("flag", "label", "n", "key"))
        rest, left, right = (table[c].to_numpy(zero_copy_only=False) for c in ("rest", "left", "right"))
        parity = table["parity"].to_pylist()
        size = min(map(len, parity))
        maps = np.stack([_fold(x, size) for x in parity])
        out: list[np.ndarray] = []
        mine, other = np.flatnonzero(left), np.flatnonzero(right)
        step = max(1, 4_000_000 // (maps[other].size + 1))
        for lo in range(0, len(mine), step):
            i = mine[lo : lo + step]
            differ = np.bitwise_count(maps[i][:, None, :] ^ maps[other][None]).sum(2, dtype=np.int64)
            both = n[i][:, None] + n[other][None]
            fits = (differ <= both * (den - num) // (den + num)) & (np.minimum(n[i][:, None], n[other][None]) * den >= np.maximum(n[i][:, None], n[other][None]) * num)
            fits &= label[i][:, None] != label[other][None]
            fits &= ((flags[i][:, None] | flags[other][None]) & 1 == 1) & ((flags[i][:, None] & flags[other][None]) & 2 == 0)
            fits &= ~rest[other][None] | (keys[i][:, None] < keys[other][None])
            x, y = np.nonzero(fits)
            if closest and len(x):
                order = np.lexsort((differ[x, y], label[other[y]], x))
                x, y = x[order], y[order]
                first = np.append(True, (x[1:] != x[:-1]) | (label[other[y[1:]]] != label[other[y[:-1]]]))
                x, y = x[first], y[first]
            a, b = keys[i[x]], keys[other[y]]
            out.append(np.stack([np.minimum(a, b), np.maximum(a, b)], 1))
        pairs = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return across


def _still_apart(lists: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame | None:
    """Chunks to compare, or None if there are none: list, i, j, key, flag, label, rest, left, right, n, parity.

    Only buckets with sets of several components count. In these, the sets outside the largest component are dealt to
    chunks i, all sets to chunks j, and each i meets each j; a set goes on once for every chunk that it meets.
    """
    slim = settle(lists.join(labels, "key", "left").select("list", "key", "flag", F.coalesce("label", "key").alias("label")), "labelled")
    by_label = slim.groupBy("list", "label").agg(F.count("*").alias("n"))
    top = by_label.groupBy("list").agg(F.sum("n").alias("size"), F.max(F.struct("n", "label")).alias("top")).where(F.col("size") > F.col("top.n"))
    chunks = lambda n: F.ceil(n / F.lit(CHUNK)).cast("int")
    top = settle(top.select("list", "size", F.col("top.label").alias("largest"), chunks(F.col("size")).alias("nj"), chunks(F.col("size") - F.col("top.n")).alias("ni")), "apart")
    n_apart = top.count()
    if not n_apart:
        return None
    rows = by_groups(slim, top, ["list"], "size", n_apart, slim.count())
    rows = rows.withColumn("rest", F.col("label") != F.col("largest"))
    i0, j0 = F.pmod(F.xxhash64("key", F.lit(1)), F.col("ni")).cast("int"), F.pmod(F.xxhash64("key", F.lit(2)), F.col("nj")).cast("int")
    rows = rows.withColumn("i0", i0).withColumn("j0", j0)
    met = lambda i, j, left, right: F.struct(i.alias("i"), j.alias("j"), left.alias("left"), right.alias("right"))
    as_left = F.transform(F.sequence(F.lit(0), F.col("nj") - 1), lambda j: met(F.col("i0"), j, F.lit(True), j == F.col("j0")))
    as_right = F.transform(F.sequence(F.lit(0), F.col("ni") - 1), lambda i: met(i, F.col("j0"), F.lit(False), F.lit(True)))
    both = F.concat(as_left, F.filter(as_right, lambda x: x["i"] != F.col("i0")))
    dealt = rows.join(sets.select("key", "n", "parity"), "key").withColumn("m", F.explode(F.when(F.col("rest"), both).otherwise(as_right)))
    return dealt.select("list", "m.i", "m.j", "key", "flag", "label", "rest", "m.left", "m.right", "n", "parity")


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    left = sets.select(F.col("key").alias("a"), F.col("members").alias("left"))
    right = sets.select(F.col("key").alias("b"), F.col("members").alias("right"))
    total = pairs.count()
    return spread_join(spread_join(pairs, left, "a", "b", total), right, "b", "a", total).select("a", "b", "left", "right").mapInArrow(_verify(num, den), _PAIRS)


def describe(docs: DataFrame, size: int = 5) -> tuple[Keyed, DataFrame]:
    """(docs by key, key with set size n, class rep: the least key with an equal set, and the class's number of sets)."""
    found = keyed(docs)
    sets = settle(found.once.select("key", "text").mapInArrow(_describe(size), "key long, n long, d1 long, d2 long"), "sets")
    firsts = settle(sets.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("key").alias("rep"), F.count("*").alias("c")).where("c > 1").withColumn("members", F.col("c")), "firsts")
    classes = by_groups(sets, firsts, ["n", "d1", "d2"], "c", firsts.count(), sets.count(), "left")
    return found, settle(classes.select("key", "n", F.coalesce("rep", "key").alias("rep"), F.coalesce("members", F.lit(1)).alias("members")), "classes")


def candidates(texts: DataFrame, classes: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """The live buckets of the index over class representatives, as _BUCKETS."""
    reps = classes.where("key = rep and n > 0")
    sizes = reps.groupBy("n").count().collect()  # one row for each set size
    largest = max((r["n"] for r in sizes), default=1)
    plan = Plan(num, den, largest)
    per_band: dict[int, int] = {}
    for r in sizes:
        k = plan.band(r["n"])
        per_band[k] = per_band.get(k, 0) + r["count"]
    plan = Plan(num, den, largest, per_band)
    rows = 0
    for r in sizes:
        for band, need, offer in plan.probes(r["n"]):
            m = plan.segments[band]
            rows += r["count"] * ((m if offer else min(m, need)) + (r["n"] if plan.deletes[band] else 0))
    parts = max(1, math.ceil(rows / ROWS_PER_PART))
    others = settle(classes.where("key <> rep or n = 0").select("key"), "not-reps")
    singles = by_ids(texts, others, "key", "left_anti", others.count())
    index = singles.select("key", "text").mapInArrow(_index(size, plan, parts), _INDEX)
    return settle(index.groupBy("part").applyInArrow(_buckets(parts), _BUCKETS), "buckets")


def links(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> tuple[Keyed, DataFrame, DataFrame]:
    """(docs by key, classes, links between class representatives that connect all linked ones).

    Two documents link when den * intersection >= num * union. Every candidate pair of an index bucket is verified,
    unless both are known to be connected already: first each set with its bucket's leader, then, in buckets that still
    hold several components, across these.
    """
    found, classes = describe(docs, size)
    buckets = candidates(found.once, classes, size, num, den)
    stars = settle(buckets.where("a is not null").select("a", "b").distinct(), "stars")
    lists = buckets.where("members is not null").select(F.coalesce("list", F.xxhash64("members", "flags")).alias("list"), F.explode(F.arrays_zip("members", "flags")).alias("m"))
    lists = settle(lists.select("list", F.col("m.members").alias("key"), F.col("m.flags").alias("flag")).distinct(), "lists")
    involved = settle(stars.select(F.col("a").alias("key")).union(stars.select("b")).union(lists.select("key")).distinct(), "involved")
    sets = settle(by_ids(found.once, involved, "key", "left_semi", involved.count()).select("key", "text").mapInArrow(_sets(size), _SETS), "members")
    left = sets.select(F.col("key").alias("a"), "n", F.col("parity").alias("p"))
    right = sets.select(F.col("key").alias("b"), F.col("n").alias("m"), F.col("parity").alias("q"))
    total = stars.count()
    close = spread_join(spread_join(stars, left, "a", "b", total), right, "b", "a", total).select("a", "b", "n", "m", "p", "q")
    linked = settle(_verified(settle(close.mapInArrow(_near(num, den), _PAIRS), "close"), sets, num, den), "links")
    for closest in (True, False):  # first what links most likely, then all that is still apart
        apart = _still_apart(lists, components(linked), sets)
        if apart is None:
            break
        across = settle(apart.groupBy("list", "i", "j").applyInArrow(_across(num, den, closest), _PAIRS).distinct(), "across")
        linked = settle(linked.union(_verified(across, sets, num, den)), "links")
    return found, classes, linked


def near_duplicates(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id reachable by links) for every row of docs.

    A-Z count as a-z. Fewer words than a shingle: the whole sequence is the one shingle. Null texts and texts without
    words have no shingles and link with nothing. Rows with equal id and text are one document and get one result each;
    null ids come last in the order; an empty table gives an empty result.
    """
    found, classes, linked = links(docs, size, num, den)
    labels = components(linked).select(F.col("key").alias("rep"), "label")
    # the class representatives that do not stand for themselves alone, with their components and numbers of documents
    reps = settle(classes.where("key = rep").join(labels, "rep", "left").where("members > 1 or label is not null").select("rep", "members", F.coalesce("label", "rep").alias("label")), "reps")
    by_key = by_groups(classes.drop("members"), reps, ["rep"], "members", reps.count(), classes.count(), "left").select("key", F.col("n").alias("n_shingles"), F.coalesce("label", "key").alias("label"))
    if found.plain:
        kind = dict(docs.dtypes)["doc_id"]
        return by_key.select(F.col("key").cast(kind).alias("doc_id"), "n_shingles", F.col("label").cast(kind).alias("component_id"))
    by_key = settle(by_key, "labels")
    sizes = by_key.groupBy("label").agg(F.count("*").alias("c"))
    ids = settle(sizes.join(found.names.select(F.col("key").alias("label"), F.col("doc_id").alias("component_id")), "label"), "ids")
    named = by_groups(by_key, ids, ["label"], "c", ids.count(), by_key.count()).join(found.names, "key")
    marked = named.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), "n_shingles", "component_id")
    body = F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
    rows = docs.select("doc_id", body.alias("digest"))
    return rows.join(marked, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_digest") == F.col("digest"))).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row of docs for each component, the one with the least id, in docs' columns.

    Rows without shingles are components of their own and stay. Of repeated rows, and of linked texts under one id or
    under null ids, one stays too; null ids come last.
    """
    rows, plain = rows_as_documents(docs)
    found = near_duplicates(rows.select(F.col("_row").alias("doc_id"), "text"), size, num, den)
    if plain:
        gone = found.where("component_id <> doc_id").select(F.col("doc_id").alias("_row"))
    else:
        ids = rows.select(F.col("_row"), F.struct(F.col("doc_id").isNull(), "doc_id", "_row").alias("_order"))
        placed = settle(found.select(F.col("doc_id").alias("_row"), "component_id").join(ids, "_row"), "placed")
        first = placed.groupBy("component_id").agg(F.min("_order")["_row"].alias("_row"))
        gone = placed.select("_row").join(first.select("_row"), "_row", "left_anti")
    gone = settle(gone, "gone")
    return by_ids(rows, gone, "_row", "left_anti", gone.count()).select(*docs.columns)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(generate_series(1, len(ws) - 4), lambda i: array_to_string(ws[i:i + 4], ' '))
                                      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g
  FROM w),
sets AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS d FROM shingles GROUP BY doc_id),
classes AS (SELECT d, min(doc_id) AS rep, any_value(n) AS n FROM sets GROUP BY d),
of_reps AS (SELECT rep, g FROM shingles JOIN classes ON doc_id = rep),
shared AS (SELECT x.rep AS a, y.rep AS b, count(*) AS k FROM of_reps x JOIN of_reps y USING (g) WHERE x.rep < y.rep GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN classes x ON x.rep = a JOIN classes y ON y.rep = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
steps AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached(a, b) AS (SELECT rep, rep FROM classes UNION SELECT r.a, e.b FROM reached r JOIN steps e ON e.a = r.b),
least_of AS (SELECT a AS rep, min(b) AS component_id FROM reached GROUP BY a)
SELECT w.doc_id, coalesce(sets.n, 0) AS n_shingles, coalesce(component_id, w.doc_id) AS component_id
FROM w LEFT JOIN sets USING (doc_id) LEFT JOIN classes USING (d) LEFT JOIN least_of USING (rep)
"""
