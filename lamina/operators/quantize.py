"""Clustering, transforms and quantizers: fitted on the driver from a bounded sample or from aggregates, applied by tasks.

Every random choice is seeded. A fitted model is a small numpy object that goes to the tasks as a broadcast; its size
depends on its parameters only, never on the number of vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Vectors that a quantizer is fitted on at most (about), drawn by a hash of the id.
SAMPLE = 65_536


def matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def lists(x: np.ndarray, kind: pa.DataType = pa.float64()) -> pa.ListArray:
    n, d = x.shape
    return pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * d, pa.array(np.ascontiguousarray(x).ravel(), kind))


def sample(df: DataFrame, most: int = SAMPLE, seed: int = 1) -> np.ndarray:
    """About `most` vectors, or all if there are fewer, in id order."""
    n = df.count()
    drawn = df if n <= most else df.where(F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1 << 30)) < int(most / n * (1 << 30)))
    return matrix(drawn.orderBy("vec_id").select("embedding").toArrow()["embedding"])


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] + (c**2).sum(1)[None] - 2 * x @ c.T, 0)


def _split_empty(c: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """An empty cluster takes half of the largest, moved apart by 1/1024."""
    for i in np.flatnonzero(counts == 0):
        j = int(counts.argmax())
        c[i], c[j] = c[j] * (1 + 1 / 1024), c[j] * (1 - 1 / 1024)
        counts[i] = counts[j] // 2
        counts[j] -= counts[i]
    return c


def kmeans_local(x: np.ndarray, k: int, rounds: int = 25, seed: int = 1234, weights: np.ndarray | None = None, spherical: bool = False) -> np.ndarray:
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    c = x[rng.permutation(len(x))[:k]].copy()
    w = np.ones(len(x)) if weights is None else weights
    for _ in range(rounds):
        at = squared(x, c).argmin(1)
        counts = np.bincount(at, w, k)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x * w[:, None])
        c = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1e-300)[:, None], c)
        c = _split_empty(c, counts.copy())
        if spherical:
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-300)
    return c


def _sums(shared):
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        total, count = np.zeros_like(c), np.zeros(len(c))
        for batch in batches:
            x = matrix(batch.column("embedding"))
            if len(x):
                at = squared(x, c).argmin(1)
                np.add.at(total, at, x)
                count += np.bincount(at, minlength=len(c))
        yield pa.record_batch([pa.array(np.arange(len(c))), pa.array(count), lists(total)], ["k", "n", "total"])

    return sums


def kmeans(df: DataFrame, k: int, rounds: int = 10, seed: int = 1234, spherical: bool = False) -> np.ndarray:
    """k-means over all rows: each task adds up its own rows, so k rows leave a task whatever its size."""
    spark = df.sparkSession
    c = kmeans_local(sample(df, max(256 * k, 1024), seed), k, 3, seed)
    for _ in range(rounds):
        part = df.select("embedding").mapInArrow(_sums(spark.sparkContext.broadcast(c)), "k long, n double, total array<double>")
        each = part.select("k", "n", F.posexplode("total").alias("i", "x")).groupBy("k", "i").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).collect()
        total, n = np.zeros_like(c), np.zeros(len(c))
        for r in each:  # k * dimension numbers
            total[r["k"], r["i"]] = r["x"]
            n[r["k"]] = r["n"]
        c = _split_empty(np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c), n)
        if spherical:
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-300)
    return c


def kmeans_1d(values: np.ndarray, k: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Exact one-dimensional k-means by dynamic programming over the distinct values, each with its weight.

    The best last cut never moves left as values are added, so a level halves its range of cuts at each middle: k * n *
    log n steps, taken side by side, and k * n numbers of memory.
    """
    x, at = np.unique(values.astype(float), return_inverse=True)
    w = np.bincount(at, weights, len(x)).astype(float)
    n, k = len(x), min(k, len(x))
    middle = float((x * w).sum() / w.sum()) if n else 0.0  # sums of squares lose less about the mean
    y = x - middle
    total, a, b = (np.append(0, np.cumsum(z)) for z in (w, w * y, w * y * y))

    def within(m: np.ndarray, i: np.ndarray) -> np.ndarray:
        return (b[i] - b[m]) - (a[i] - a[m]) ** 2 / (total[i] - total[m])

    cost = np.append(0, np.full(n, np.inf))
    cut = np.zeros((k + 1, n + 1), np.int64)
    for j in range(1, k + 1):
        new = np.full(n + 1, np.inf)
        first, last, low, high = (np.array([v]) for v in (j, n, j - 1, n - 1))  # ends to settle, and where their cuts lie
        while len(first):
            mid = (first + last) // 2
            lo, hi = np.maximum(low, j - 1), np.minimum(high, mid - 1)
            count = hi - lo + 1
            start = np.cumsum(count) - count
            m = np.repeat(lo - start, count) + np.arange(count.sum())
            c = cost[m] + within(m, np.repeat(mid, count))
            new[mid] = np.minimum.reduceat(c, start)
            hit = np.flatnonzero(c == np.repeat(new[mid], count))
            best = m[hit[np.searchsorted(hit, start)]]
            cut[j, mid] = best
            first, last, low, high = np.append(first, mid + 1), np.append(mid - 1, last), np.append(low, best), np.append(best, high)
            some = first <= last
            first, last, low, high = first[some], last[some], low[some], high[some]
        cost = new
    out, i = [], n
    for j in range(k, 0, -1):
        m = int(cut[j, i])
        out.append(middle + (a[i] - a[m]) / (total[i] - total[m]))
        i = m
    return np.array(out[::-1])


def assign(df: DataFrame, centroids: np.ndarray, nprobe: int = 1) -> DataFrame:
    """vec_id, list_no, place, dist of the nprobe nearest centroids of each row."""
    shared = df.sparkSession.sparkContext.broadcast(centroids)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            x = matrix(batch.column("embedding"))
            if not len(x):
                continue
            d = squared(x, c)
            best = np.argsort(d, axis=1, kind="stable")[:, :nprobe]
            row = np.repeat(np.arange(len(x)), best.shape[1])
            yield pa.record_batch([batch.column("vec_id").take(pa.array(row)), pa.array(best.ravel().astype(np.int32)), pa.array(np.tile(np.arange(best.shape[1]), len(x)).astype(np.int32)), pa.array(d[row, best.ravel()])], ["vec_id", "list_no", "place", "dist"])

    return df.select("vec_id", "embedding").mapInArrow(near, "vec_id long, list_no int, place int, dist double")


# --- transforms ---------------------------------------------------------------------------------------------------


@dataclass
class Linear:
    """y = A x + b."""

    a: np.ndarray
    b: np.ndarray

    def apply(self, x: np.ndarray) -> np.ndarray:
        return x @ self.a.T + self.b

    def reverse(self, y: np.ndarray) -> np.ndarray:
        """The transpose applied: exact for orthonormal rows."""
        return (y - self.b) @ self.a


def rotation(d: int, seed: int = 12345) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


def householder(x: np.ndarray, v: np.ndarray) -> np.ndarray:
    """x reflected in the hyperplane normal to v."""
    v = v / np.linalg.norm(v)
    return x - 2 * np.outer(x @ v, v)


def pca(x: np.ndarray, d: int, eigen_power: float = 0.0, rotate: bool = False, seed: int = 5) -> Linear:
    mean = x.mean(0)
    values, vectors = np.linalg.eigh(np.cov((x - mean).T, bias=True))
    order = np.argsort(-values)[:d]
    a = vectors[:, order].T
    if eigen_power:
        a = a * (np.maximum(values[order], 1e-12) ** eigen_power)[:, None]
    if rotate:
        a = rotation(d, seed) @ a
    return Linear(a, -a @ mean)


def itq(x: np.ndarray, d: int, rounds: int = 50, seed: int = 7) -> Linear:
    """PCA followed by the rotation that brings the components nearest to their signs."""
    first = pca(x, d)
    y = first.apply(x)
    r = rotation(d, seed)
    for _ in range(rounds):
        u, _, v = np.linalg.svd(y.T @ np.sign(y @ r.T))
        r = (u @ v).T
    return Linear(r @ first.a, r @ first.b)


def opq(x: np.ndarray, m: int, k: int = 16, rounds: int = 8, seed: int = 9) -> Linear:
    """The rotation under which a product quantizer of m parts loses least."""
    r = rotation(x.shape[1], seed)
    for _ in range(rounds):
        y = x @ r.T
        quantizer = ProductQuantizer.fit(y, m, k, 4, seed)
        u, _, v = np.linalg.svd(x.T @ quantizer.decode(quantizer.encode(y)))
        r = (u @ v).T
    return Linear(r, np.zeros(x.shape[1]))


def transformed(df: DataFrame, chain: list[Linear], reverse: bool = False) -> DataFrame:
    """df with embedding taken through the chain, or back."""
    shared = df.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("embedding"))
            if not len(x):
                continue
            for step in reversed(shared.value) if reverse else shared.value:
                x = step.reverse(x) if reverse else step.apply(x)
            yield pa.record_batch([batch.column("vec_id"), lists(x)], ["vec_id", "embedding"])

    return df.select("vec_id", "embedding").mapInArrow(run, "vec_id long, embedding array<double>")


# --- quantizers ---------------------------------------------------------------------------------------------------


@dataclass
class ProductQuantizer:
    """Each of m slices of a vector is coded by its nearest of k centroids."""

    centroids: list[np.ndarray]

    @classmethod
    def fit(cls, x: np.ndarray, m: int, k: int = 256, rounds: int = 15, seed: int = 1234) -> ProductQuantizer:
        if x.shape[1] % m:
            raise ValueError(f"{x.shape[1]} dimensions don't part into {m}")
        return cls([kmeans_local(part, k, rounds, seed + i) for i, part in enumerate(np.split(x, m, 1))])

    def _parts(self, x: np.ndarray) -> list[np.ndarray]:
        return np.split(x, len(self.centroids), 1)

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.stack([squared(p, c).argmin(1) for p, c in zip(self._parts(x), self.centroids)], 1)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([c[codes[:, i]] for i, c in enumerate(self.centroids)], 1)

    def tables(self, q: np.ndarray) -> list[np.ndarray]:
        """For each slice, squared distances of each query to each centroid (asymmetric)."""
        return [squared(p, c) for p, c in zip(self._parts(q), self.centroids)]

    def symmetric(self) -> list[np.ndarray]:
        """For each slice, squared distances between centroids."""
        return [squared(c, c) for c in self.centroids]

    def distances(self, codes: np.ndarray, q: np.ndarray) -> np.ndarray:
        return sum(t[:, codes[:, i]].T for i, t in enumerate(self.tables(q)))


@dataclass
class TwoLayer:
    """A first code for the nearest of some centroids, then a product code of what that leaves."""

    centroids: np.ndarray
    inner: ProductQuantizer

    @classmethod
    def fit(cls, x: np.ndarray, lists: int, m: int, k: int, seed: int = 1234) -> TwoLayer:
        c = kmeans_local(x, lists, 15, seed)
        return cls(c, ProductQuantizer.fit(x - c[squared(x, c).argmin(1)], m, k, seed=seed))

    def encode(self, x: np.ndarray) -> np.ndarray:
        at = squared(x, self.centroids).argmin(1)
        return np.concatenate([at[:, None], self.inner.encode(x - self.centroids[at])], 1)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return self.centroids[codes[:, 0]] + self.inner.decode(codes[:, 1:])


@dataclass
class ResidualQuantizer:
    """A sum of one codeword from each of several books; each book is fitted on what the ones before leave."""

    books: list[np.ndarray]
    beam: int = 4

    @classmethod
    def fit(cls, x: np.ndarray, m: int, k: int = 16, rounds: int = 10, seed: int = 1234, beam: int = 4) -> ResidualQuantizer:
        books, rest = [], x.copy()
        for i in range(m):
            book = kmeans_local(rest, k, rounds, seed + i)
            rest = rest - book[squared(rest, book).argmin(1)]
            books.append(book)
        return cls(books, beam)

    def encode(self, x: np.ndarray) -> np.ndarray:
        """By beam search over the books."""
        codes, rest = np.zeros((len(x), 1, 0), int), x[:, None, :]
        for book in self.books:
            d = ((rest[:, :, None, :] - book[None, None]) ** 2).sum(3)
            flat = d.reshape(len(x), -1)
            best = np.argsort(flat, 1, kind="stable")[:, : self.beam]
            row = np.arange(len(x))[:, None]
            parent, word = best // len(book), best % len(book)
            codes = np.concatenate([codes[row, parent], word[:, :, None]], 2)
            rest = rest[row, parent] - book[word]
        return codes[:, 0]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(book[codes[:, i]] for i, book in enumerate(self.books))


@dataclass
class LocalSearchQuantizer(ResidualQuantizer):
    """Codes improved one at a time given the others, books by least squares given the codes."""

    @classmethod
    def fit(cls, x: np.ndarray, m: int, k: int = 16, rounds: int = 6, seed: int = 1234, beam: int = 4) -> LocalSearchQuantizer:
        out = cls(ResidualQuantizer.fit(x, m, k, 8, seed).books, beam)
        for _ in range(rounds):
            codes = out.encode(x)
            hot = np.zeros((len(x), m * k))
            for i in range(m):
                hot[np.arange(len(x)), i * k + codes[:, i]] = 1
            solved = np.linalg.solve(hot.T @ hot + 1e-3 * np.eye(m * k), hot.T @ x)
            out.books = [solved[i * k : (i + 1) * k] for i in range(m)]
        return out

    def encode(self, x: np.ndarray) -> np.ndarray:
        codes = super().encode(x)
        for _ in range(3):
            for i, book in enumerate(self.books):
                rest = x - self.decode(codes) + book[codes[:, i]]
                codes[:, i] = squared(rest, book).argmin(1)
        return codes


@dataclass
class Stacked:
    """A quantizer for each of several slices (product-residual, product-local-search)."""

    parts: list = field(default_factory=list)

    @classmethod
    def fit(cls, kind, x: np.ndarray, slices: int, **options) -> Stacked:
        return cls([kind.fit(p, **options) for p in np.split(x, slices, 1)])

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([q.encode(p) for q, p in zip(self.parts, np.split(x, len(self.parts), 1))], 1)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([q.decode(c) for q, c in zip(self.parts, np.split(codes, len(self.parts), 1))], 1)


@dataclass
class Lattice:
    """The integer point with squared norm r2 nearest in direction, for each of several slices scaled to its norm."""

    slices: int
    r2: int

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._nearest(p) for p in np.split(x, self.slices, 1)], 1)

    def _nearest(self, x: np.ndarray) -> np.ndarray:
        scaled = x * np.sqrt(self.r2) / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        out = np.zeros_like(scaled)
        for i, row in enumerate(scaled):
            v = np.rint(row)
            for _ in range(4 * self.r2 + 4):  # steps of one component until the norm fits, at the least loss
                gap = self.r2 - int((v**2).sum())
                if gap == 0:
                    break
                up = np.where(row >= 0, 1.0, -1.0)
                step = v + np.eye(len(v)) * (up if gap > 0 else -np.sign(v))
                norms = (step**2).sum(1)
                fits = np.abs(self.r2 - norms) < abs(gap)
                if not fits.any():
                    break
                v = step[np.argmax(np.where(fits, step @ row, -np.inf))]
            out[i] = v
        return out

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return codes / np.sqrt(self.r2)


def coded(df: DataFrame, model) -> DataFrame:
    """vec_id and codes of every row."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("embedding"))
            if len(x):
                yield pa.record_batch([batch.column("vec_id"), lists(shared.value.encode(x).astype(np.int32), pa.int32())], ["vec_id", "codes"])

    return df.select("vec_id", "embedding").mapInArrow(run, "vec_id long, codes array<int>")


def decoded(codes: DataFrame, model) -> DataFrame:
    """vec_id and the vector that its codes stand for."""
    shared = codes.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = matrix(batch.column("codes")).astype(int)
            if len(c):
                yield pa.record_batch([batch.column("vec_id"), lists(shared.value.decode(c))], ["vec_id", "embedding"])

    return codes.select("vec_id", "codes").mapInArrow(run, "vec_id long, embedding array<double>")


def adc_pairs(codes: DataFrame, queries: DataFrame, model: ProductQuantizer, k: int) -> DataFrame:
    """qid, vec_id, dist by table lookups; each batch keeps its k best for each query."""
    q = queries.select("qid", "qvec").toArrow()
    shared = codes.sparkSession.sparkContext.broadcast((model, q["qid"].to_numpy(), matrix(q["qvec"])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quantizer, qids, qvecs = shared.value
        for batch in batches:
            c = matrix(batch.column("codes")).astype(int)
            if not len(c):
                continue
            d = quantizer.distances(c, qvecs)
            n = min(k, len(c))
            i, j = np.nonzero(d <= np.partition(d, n - 1, axis=0)[n - 1])
            yield pa.record_batch([pa.array(qids[j]), batch.column("vec_id").take(pa.array(i)), pa.array(d[i, j])], ["qid", "vec_id", "dist"])

    return codes.select("vec_id", "codes").mapInArrow(run, "qid long, vec_id long, dist double")


def scalar_codes(v: Column, least: Column, most: Column, bits: int) -> Column:
    """Codes 0 to 2^bits - 1 of each component by its dimension's range; a constant dimension codes as 0."""
    levels = float(2**bits - 1)
    ranges = F.arrays_zip(least.alias("lo"), most.alias("hi"))
    return F.zip_with(v, ranges, lambda x, r: F.least(F.greatest(F.coalesce(F.floor(F.try_divide(x.cast("double") - r["lo"], r["hi"] - r["lo"]) * levels), F.lit(0)), F.lit(0)), F.lit(int(levels))).cast("int"))


def scalar_values(codes: Column, least: Column, most: Column, bits: int) -> Column:
    """The middles of the codes' intervals."""
    levels = float(2**bits - 1)
    ranges = F.arrays_zip(least.alias("lo"), most.alias("hi"))
    return F.zip_with(codes, ranges, lambda c, r: r["lo"] + (c + 0.5) / levels * (r["hi"] - r["lo"]))


def ranges(df: DataFrame) -> DataFrame:
    """One row: the least and the greatest value of each dimension."""
    each = df.select(F.posexplode("embedding").alias("i", "x")).groupBy("i").agg(F.min(F.col("x").cast("double")).alias("lo"), F.max(F.col("x").cast("double")).alias("hi"))
    rows = each.agg(F.array_sort(F.collect_list(F.struct("i", "lo", "hi"))).alias("r"))
    return rows.select(F.transform("r", lambda t: t["lo"]).alias("lo"), F.transform("r", lambda t: t["hi"]).alias("hi"))


def hash_bits(model: Linear, df: DataFrame) -> DataFrame:
    """vec_id and the signs of up to 64 transformed components as one long."""
    from ..functions.vector import sign_bits

    return transformed(df, [model]).select("vec_id", sign_bits(F.col("embedding")).alias("bits"))
