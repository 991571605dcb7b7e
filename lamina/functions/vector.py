"""Distances and vector arithmetic as Column expressions, accumulated in double.

All stay in the JVM. Squared L2 is not rooted. Where a formula divides by zero the result is null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _d(x: Column) -> Column:
    return x.cast("double")


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def l2(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (_d(x) - _d(y)) * (_d(x) - _d(y))))


def inner_product(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: _d(x) * _d(y)))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(inner_product(a, b), norm(a) * norm(b))


def l1(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.abs(_d(x) - _d(y))))


def linf(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(_d(x) - _d(y))))


def lp(a: Column, b: Column, p: float) -> Column:
    """Sum of the p-th powers, not rooted."""
    return total(F.zip_with(a, b, lambda x, y: F.pow(F.abs(_d(x) - _d(y)), F.lit(float(p)))))


def canberra(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.try_divide(F.abs(_d(x) - _d(y)), F.abs(_d(x)) + F.abs(_d(y)))))


def bray_curtis(a: Column, b: Column) -> Column:
    return F.try_divide(l1(a, b), total(F.zip_with(a, b, lambda x, y: F.abs(_d(x) + _d(y)))))


def jensen_shannon(a: Column, b: Column) -> Column:
    """Of positive components; null if any is zero or negative."""

    def term(x: Column, y: Column) -> Column:
        middle = (_d(x) + _d(y)) * 0.5
        return -_d(x) * F.ln(F.try_divide(middle, _d(x))) - _d(y) * F.ln(F.try_divide(middle, _d(y)))

    positive = F.forall(a, lambda x: x > 0) & F.forall(b, lambda x: x > 0)
    return F.when(positive, total(F.zip_with(a, b, term)) * 0.5)


METRICS: dict[str, Callable[..., Column]] = {
    "l2": l2,
    "ip": inner_product,
    "cosine": cosine,
    "l1": l1,
    "linf": linf,
    "lp": lp,
    "canberra": canberra,
    "braycurtis": bray_curtis,
    "jensenshannon": jensen_shannon,
}
#: Metrics of which more is nearer.
SIMILARITIES = frozenset({"ip", "cosine"})


def metric(name: str, argument: float | None = None) -> Callable[[Column, Column], Column]:
    """The named metric; ValueError for names and arguments that are not supported."""
    if name not in METRICS:
        raise ValueError(f"unsupported metric {name!r}; known: {', '.join(METRICS)}")
    if name == "lp":
        if argument is None or argument <= 0:
            raise ValueError("lp needs a positive argument")
        return lambda a, b: lp(a, b, argument)
    if argument is not None:
        raise ValueError(f"{name} takes no argument")
    return METRICS[name]


def norm_squared(a: Column) -> Column:
    return total(F.transform(a, lambda x: _d(x) * _d(x)))


def norm(a: Column) -> Column:
    return F.sqrt(norm_squared(a))


def normalized(a: Column) -> Column:
    """To unit length; zero vectors are left as they are. The norm is computed once for each vector."""
    scaled = F.transform(F.array(norm(a)), lambda n: F.transform(a, lambda x: F.when(n > 0, _d(x) / n).otherwise(_d(x))))
    return F.element_at(scaled, 1)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: _d(x) + _d(y))


def add_scalar(a: Column, s: float) -> Column:
    return F.transform(a, lambda x: _d(x) + F.lit(float(s)))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: _d(x) - _d(y))


def multiply_add(a: Column, factor: float, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: _d(x) + F.lit(float(factor)) * _d(y))


def ip_to_l2(ip: Column, norm2_a: Column, norm2_b: Column) -> Column:
    return norm2_a + norm2_b - 2 * ip


def remap(a: Column, dims: list[int]) -> Column:
    """Components in the given order; -1 stands for zero."""
    return F.array(*[F.lit(0.0) if d < 0 else _d(F.get(a, F.lit(d))) for d in dims])


def linear(a: Column, rows: list[list[float]], offset: list[float] | None = None) -> Column:
    """Matrix times vector plus offset."""
    offset = offset or [0.0] * len(rows)
    return F.array(*[inner_product(a, F.array(*[F.lit(float(x)) for x in row])) + F.lit(float(o)) for row, o in zip(rows, offset)])


def sign_bits(a: Column) -> Column:
    """The signs (positive: 1) of up to 64 components packed into a long, first component lowest."""
    indexed = F.transform(a, lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(indexed, F.lit(0).cast("long"), lambda s, b: s.bitwiseOR(b))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two longs."""
    return F.bit_count(a.bitwiseXOR(b)).cast("long")


def hamming_words(a: Column, b: Column) -> Column:
    """Differing bits of two arrays of longs."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("long")), F.lit(0).cast("long"), lambda s, n: s + n)


def permute_bits(a: Column, order: list[int]) -> Column:
    """The long whose bit i is bit order[i] of a."""
    out = F.lit(0).cast("long")
    for i, source in enumerate(order):
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(a, source).bitwiseAND(F.lit(1).cast("long")), i))
    return out
