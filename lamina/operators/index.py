"""Inverted-list indexes, their maintenance, and the index string grammar."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vector import SIMILARITIES, metric
from . import quantize as Z
from .generate import draw
from .search import ranked

#: Rows that Index.tuned takes as queries.
TRIALS = 100


def lists_of(base: DataFrame, centroids: DataFrame) -> DataFrame:
    """base with list_no, the nearest of centroids(list_no, centroid), ties by number.

    Centroids are few: they travel as one array beside every row, so no vector is shuffled or repeated.
    """
    every = centroids.agg(F.collect_list(F.struct("list_no", "centroid")).alias("_c"))
    near = F.array_min(F.transform("_c", lambda c: F.struct(F.round(metric("l2")(F.col("embedding"), c["centroid"]), 9).alias("d"), c["list_no"].alias("list_no"))))
    return base.crossJoin(F.broadcast(every)).select("vec_id", "embedding", near["list_no"].alias("list_no"))


def probes(queries: DataFrame, centroids: DataFrame, nprobe: int) -> DataFrame:
    """(qid, qvec, list_no, place): the nprobe nearest lists of each query."""
    met = queries.join(F.broadcast(centroids)).select("qid", "qvec", "list_no", F.round(metric("l2")(F.col("centroid"), F.col("qvec")), 9).alias("_d"))
    place = F.row_number().over(Window.partitionBy("qid").orderBy("_d", "list_no"))
    return met.withColumn("place", place).where(F.col("place") <= nprobe).drop("_d")


def probed(listed: DataFrame, probe: DataFrame, name: str = "l2", max_codes: int | None = None) -> DataFrame:
    """(qid, vec_id, list_no, dist) of the rows in each query's lists.

    max_codes: lists are read in order of nearness until so many rows were seen; the list that passes it is whole.
    """
    if max_codes is not None:
        sizes = listed.groupBy("list_no").agg(F.count("*").alias("_n"))
        before = F.sum("_n").over(Window.partitionBy("qid").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
        probe = probe.join(F.broadcast(sizes), "list_no").withColumn("_b", F.coalesce(before, F.lit(0))).where(F.col("_b") < max_codes).drop("_n", "_b")
    met = listed.join(F.broadcast(probe), "list_no")
    return met.select("qid", "vec_id", "list_no", metric(name)(F.col("embedding"), F.col("qvec")).alias("dist"))


def ivf_search(listed: DataFrame, queries: DataFrame, centroids: DataFrame, k: int, nprobe: int, name: str = "l2", max_codes: int | None = None) -> DataFrame:
    return ranked(probed(listed, probes(queries, centroids, nprobe), name, max_codes), k, similarity=name in SIMILARITIES)


def ivf_range(listed: DataFrame, queries: DataFrame, centroids: DataFrame, radius: float, nprobe: int) -> DataFrame:
    return probed(listed, probes(queries, centroids, nprobe)).where(F.col("dist") < radius)


def as_frame(spark, centroids: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centroids)], "list_no int, centroid array<double>")


# --- maintenance --------------------------------------------------------------------------------------------------


def merged(a: DataFrame, b: DataFrame, add_id: int = 0) -> DataFrame:
    """a and b, whose ids are moved by add_id; the same columns and kinds are needed."""
    if dict(a.dtypes) != dict(b.dtypes):
        raise ValueError(f"can't merge {a.dtypes} with {b.dtypes}")
    return a.unionByName(b.withColumn("vec_id", F.col("vec_id") + add_id))


def removed(df: DataFrame, ids: DataFrame) -> DataFrame:
    return df.join(ids.select("vec_id"), "vec_id", "left_anti")


def renumbered(df: DataFrame) -> DataFrame:
    """df with ids 0, 1, ... in the order of the old ones, as a flat index keeps them after a removal."""
    from .groups import numbered

    return numbered(df, "vec_id", "_new", 0).withColumn("vec_id", F.col("_new")).drop("_new")


def updated(df: DataFrame, rows: DataFrame) -> DataFrame:
    """df with the rows of these ids replaced; ids that df lacks are not added."""
    known = rows.join(df.select("vec_id"), "vec_id", "left_semi")
    return removed(df, rows).unionByName(known.select(*df.columns))


def subset(df: DataFrame, kind: str, a: int, b: int) -> DataFrame:
    """range: a <= id < b; modulo: id % a == b; fraction: about a in b of each list, by hash."""
    if kind == "range":
        return df.where((F.col("vec_id") >= a) & (F.col("vec_id") < b))
    if kind == "modulo":
        return df.where(F.col("vec_id") % a == b)
    if kind == "fraction":
        return df.where(draw(0, F.col("vec_id")) * b < a)
    raise ValueError(f"unknown subset {kind!r}")


def row_codes(v, bits: int = 8):
    """A vector's own range and its components' codes in it."""
    lo, hi = F.array_min(v).cast("double"), F.array_max(v).cast("double")
    levels = float(2**bits - 1)
    return F.struct(lo.alias("lo"), hi.alias("hi"), F.transform(v, lambda x: F.coalesce(F.round(F.try_divide(x.cast("double") - lo, hi - lo) * levels), F.lit(0.0)).cast("int")).alias("codes"))


# --- index strings ------------------------------------------------------------------------------------------------


@dataclass
class Recipe:
    """What an index string asks for."""

    transforms: list[tuple[str, int]] = field(default_factory=list)
    lists: int | None = None
    coarse: str = "Flat"
    codec: str = "Flat"
    refine: str | None = None
    id_map: bool = False

    def __str__(self) -> str:
        parts = (["IDMap"] if self.id_map else []) + [f"{n}{d}" if d else n for n, d in self.transforms]
        if self.lists:
            parts.append(f"IVF{self.lists}" + ("" if self.coarse == "Flat" else f"_{self.coarse}"))
        return ",".join([*parts, self.codec] + ([self.refine] if self.refine else []))

    def code_size(self, d: int) -> int:
        """Bytes of a stored vector, with 8 for its id where there are lists."""
        for name, out in self.transforms:
            d = out if out and name in ("PCA", "PCAR", "PCAW", "OPQ", "ITQ", "RR", "Pad") and "_" not in name else d
        return codec_size(self.codec, d) + (8 if self.lists else 0)


_CODEC = re.compile(r"Flat|SQ(?:8|6|4|fp16)|PQ\d+(?:x\d+)?(?:\+\d+)?|RQ\d+x\d+|LSQ\d+x\d+|PRQ\d+x\d+x\d+|PLSQ\d+x\d+x\d+|LSHr?t?|HNSW\d+|NSG\d+|ZnLattice\d+x\d+")
_TRANSFORM = re.compile(r"(PCAWR|PCAR|PCAW|PCA|OPQ|ITQ|RR|Pad|L2norm|L2Norm)(\d*)")


def codec_size(codec: str, d: int) -> int:
    if codec == "Flat" or codec.startswith(("HNSW", "NSG")):
        return 4 * d
    if codec.startswith("SQ"):
        return {"8": d, "6": (6 * d + 7) // 8, "4": (d + 1) // 2, "fp16": 2 * d}[codec[2:]]
    if codec.startswith("LSH"):
        return (d + 7) // 8
    numbers = [int(x) for x in re.findall(r"\d+", codec)]
    if codec.startswith("PQ"):
        bits = numbers[1] if "x" in codec else 8
        return (numbers[0] * bits + 7) // 8 + (numbers[-1] if "+" in codec else 0)
    if codec.startswith(("PRQ", "PLSQ")):
        return (numbers[0] * numbers[1] * numbers[2] + 7) // 8
    return (numbers[0] * numbers[1] + 7) // 8


def parse(text: str) -> Recipe:
    """A recipe from a string such as "PCA32,IVF10,PQ8,RFlat"; ValueError if any part isn't known."""
    out = Recipe(codec="")
    for part in text.split(","):
        if part in ("IDMap", "IDMap2"):
            out.id_map = True
        elif m := re.fullmatch(r"IVF(\d+)(?:_(HNSW\d*|NSG\d*))?", part):
            out.lists, out.coarse = int(m[1]), m[2] or "Flat"
        elif part == "RFlat" or re.fullmatch(r"Refine\(\w+\)", part):
            out.refine = part
        elif not out.codec and _CODEC.fullmatch(part):
            out.codec = part
        elif not out.codec and (m := _TRANSFORM.fullmatch(part)):
            out.transforms.append((m[1], int(m[2] or 0)))
        else:
            raise ValueError(f"{part!r} in {text!r} is not known")
    out.codec = out.codec or "Flat"
    return out


def parse_binary(text: str) -> tuple[str, int]:
    """(kind, parameter) of a binary index string."""
    m = re.fullmatch(r"B(Flat|IVF|HNSW|Hash)(\d*)", text)
    if not m:
        raise ValueError(f"{text!r} is not known")
    return m[1], int(m[2] or 0)


class Index:
    """train, add, search, range_search, remove_ids, reconstruct and merge over DataFrames, by an index string."""

    def __init__(self, recipe: str | Recipe, name: str = "l2"):
        self.recipe = parse(recipe) if isinstance(recipe, str) else recipe
        self.name = name
        self.chain: list[Z.Linear] = []
        self.centroids = self.model = None
        self.rows: DataFrame | None = None
        self.raw: DataFrame | None = None

    def _through(self, df: DataFrame) -> DataFrame:
        return Z.transformed(df, self.chain) if self.chain else df.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))

    def train(self, df: DataFrame) -> Index:
        x = Z.sample(df)
        for name, out in self.recipe.transforms:
            d = out or x.shape[1]
            if name.startswith("PCA"):
                step = Z.pca(x, d, -0.5 if "W" in name else 0.0, name.endswith("R"))
            elif name == "ITQ":
                step = Z.itq(x, d)
            elif name == "OPQ":
                step = Z.opq(x, d)
            elif name == "RR":
                step = Z.Linear(Z.rotation(max(d, x.shape[1]))[:d, : x.shape[1]], np.zeros(d))
            elif name == "Pad":
                step = Z.Linear(np.eye(d, x.shape[1]), np.zeros(d))
            else:
                raise ValueError(f"{name} is not a linear transform")
            self.chain.append(step)
            x = step.apply(x)
        if self.recipe.lists:
            self.centroids = Z.kmeans(self._through(df), self.recipe.lists)
        codec = self.recipe.codec
        numbers = [int(n) for n in re.findall(r"\d+", codec)]
        if codec.startswith("PQ"):
            self.model = Z.ProductQuantizer.fit(x, numbers[0], min(2 ** (numbers[1] if "x" in codec else 8), max(len(x) // 4, 2)))
        elif codec.startswith("RQ"):
            self.model = Z.ResidualQuantizer.fit(x, numbers[0], 2 ** numbers[1])
        elif codec.startswith("LSQ"):
            self.model = Z.LocalSearchQuantizer.fit(x, numbers[0], 2 ** numbers[1])
        elif codec.startswith("PRQ"):
            self.model = Z.Stacked.fit(Z.ResidualQuantizer, x, numbers[0], m=numbers[1], k=2 ** numbers[2])
        elif codec.startswith("PLSQ"):
            self.model = Z.Stacked.fit(Z.LocalSearchQuantizer, x, numbers[0], m=numbers[1], k=2 ** numbers[2])
        return self

    def add(self, df: DataFrame) -> Index:
        rows = self._through(df)
        if self.model is not None:
            rows = Z.decoded(Z.coded(rows, self.model), self.model)
        elif self.recipe.codec.startswith("SQ") and self.recipe.codec != "SQfp16":
            bits = int(self.recipe.codec[2:])
            spread = F.broadcast(Z.ranges(rows))
            rows = rows.join(spread).select("vec_id", Z.scalar_values(Z.scalar_codes(F.col("embedding"), F.col("lo"), F.col("hi"), bits), F.col("lo"), F.col("hi"), bits).alias("embedding"))
        if self.centroids is not None:
            rows = rows.join(Z.assign(rows, self.centroids).select("vec_id", "list_no"), "vec_id")
        self.rows = rows if self.rows is None else self.rows.unionByName(rows)
        raw = df.select("vec_id", "embedding")
        self.raw = raw if self.raw is None else self.raw.unionByName(raw)
        return self

    def search(self, queries: DataFrame, k: int, nprobe: int = 1, k_factor: int = 4) -> DataFrame:
        from . import search as S

        wide = k * k_factor if self.recipe.refine else k
        asked = self._through(queries.select(F.col("qid").alias("vec_id"), F.col("qvec").alias("embedding"))).toDF("qid", "qvec")
        if self.centroids is None:
            found = S.knn(self.rows, asked, wide, self.name)
        else:
            found = ivf_search(self.rows, asked, as_frame(self.rows.sparkSession, self.centroids), wide, nprobe, self.name)
        return S.refine(found, self.raw, queries, k, self.name) if self.recipe.refine else found

    def tuned(self, k: int, least: float = 0.98) -> tuple[int, int]:
        """nprobe and k_factor by which search meets at least that share of true neighbours in each of its two steps.

        Measured with TRIALS of the rows as queries, themselves left out, against their exact neighbours among all rows:
        how many lists are nearer than a neighbour's list, and how many rows are nearer by their codes. A search of one
        list set needs the first, one with RFlat both; without RFlat the codes alone decide and k_factor has no effect.
        """
        from . import search as S

        drawn = self.raw.orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id").limit(TRIALS).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
        asked = self._through(drawn.toDF("vec_id", "embedding")).toDF("qid", "qvec")
        truth = S.knn(self.raw, drawn, k + 1, self.name).where("vec_id <> qid").select("qid", "vec_id")
        own = ["list_no"] if self.centroids is not None else []
        met = truth.join(self.rows.select("vec_id", *own, "embedding"), "vec_id").join(F.broadcast(asked), "qid")
        pairs = met.select("qid", "qvec", *own, metric(self.name)(F.col("embedding"), F.col("qvec")).alias("dist")).collect()  # TRIALS * k rows
        if not pairs:
            return 1, 1
        at = lambda counts: int(np.sort(counts)[math.ceil(least * len(counts)) - 1])
        nprobe = 1
        if own:
            near = np.argsort(Z.squared(np.array([r["qvec"] for r in pairs]), self.centroids), 1, kind="stable")
            nprobe = at((near == np.array([[r["list_no"]] for r in pairs])).argmax(1) + 1)
        if not self.recipe.refine:
            return nprobe, 1
        return nprobe, max(1, math.ceil(at(S.nearer(self.rows, [(r["qid"], r["qvec"], r["dist"]) for r in pairs], self.name)) / k))

    def range_search(self, queries: DataFrame, radius: float) -> DataFrame:
        from . import search as S

        asked = self._through(queries.select(F.col("qid").alias("vec_id"), F.col("qvec").alias("embedding"))).toDF("qid", "qvec")
        return S.within(self.rows, asked, radius, self.name)

    def remove_ids(self, ids: DataFrame) -> Index:
        self.rows, self.raw = removed(self.rows, ids), removed(self.raw, ids)
        return self

    def reconstruct(self, ids: DataFrame) -> DataFrame:
        found = self.rows.join(ids.select("vec_id"), "vec_id", "left_semi").select("vec_id", "embedding")
        return Z.transformed(found, self.chain, reverse=True) if self.chain else found

    def merge_from(self, other: Index, add_id: int = 0) -> Index:
        if str(self.recipe) != str(other.recipe) or self.name != other.name:
            raise ValueError("indexes of different kinds can't be merged")
        self.rows, self.raw = merged(self.rows, other.rows, add_id), merged(self.raw, other.raw, add_id)
        return self
