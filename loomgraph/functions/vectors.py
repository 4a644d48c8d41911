"""Arithmetic on arrays of doubles, and element-wise aggregation of arrays.

Arrays of a table have one length.  Aggregates are generated as one scalar aggregate for each slot, so Spark
pre-aggregates them before the shuffle and nothing is collected into lists.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package


def width_of(df: DataFrame, column: str) -> int:
    """The common length of the arrays in a column (0 for an empty table)."""
    return int(df.agg(F.max(F.size(column))).first()[0] or 0)


def slots(column: str | Column, width: int) -> list[Column]:
    c = F.col(column) if isinstance(column, str) else column
    return [c[i] for i in range(width)]


def aggregated(how: Callable[[Column], Column], column: str | Column, width: int) -> Column:
    """An array of one aggregate for each slot."""
    return F.array(*map(how, slots(column, width))) if width else F.array().cast("array<double>")


def constant(values: list[float]) -> Column:
    """A constant array as one literal, however long."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>") if values else F.array().cast("array<double>")


def rank(values: list[float], x: Column, inclusive: bool = False) -> Column:
    """How many of the sorted values are less than x (or at most x), by halving."""
    q, steps = constant(values), [1 << i for i in reversed(range(len(values).bit_length()))] or [1]
    met = (lambda v: v <= x) if inclusive else (lambda v: v < x)
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda n, step: F.when(met(F.get(q, n + step - 1)), n + step).otherwise(n))


def zeros(width: int) -> Column:
    return F.array_repeat(F.lit(0.0), width)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def scaled(a: Column, by: Column) -> Column:
    return F.transform(a, lambda x: x * by)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def leaky(x: Column, slope: float) -> Column:
    return F.when(x > 0, x).otherwise(x * slope)


def head(a: Column, h: int, width: int) -> Column:
    """Slice h of an array that holds heads of one width after each other."""
    return F.slice(a, h * width + 1, width)


def matrix_of(rows: pa.Array, *shape: int) -> np.ndarray:
    """The arrays of an Arrow column, each of one shape, without a Python object a row."""
    return rows.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(-1, *shape)


def lists_of(values: np.ndarray) -> pa.Array:
    """The rows of a matrix as an Arrow column of arrays."""
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(np.ascontiguousarray(values).ravel()))


def by_head(a: Column, b: Column, heads: int, d: int, score: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Column:
    """An array of one number a head from two flat arrays; ``score`` sees (rows, heads, d) of an Arrow batch at once.

    For wide heads: at 64 slots loops over arrays take 0.3 microseconds a slot, and code written out is too long to be compiled.
    """
    ship_package(SparkSession.active())

    @F.arrow_udf("array<double>")
    def scores(x: pa.Array, y: pa.Array) -> pa.Array:
        return lists_of(score(matrix_of(x, heads, d), matrix_of(y, heads, d)))

    return scores(a, b)


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once: what stands in the body of a lambda is worked out for each element again."""
    return F.transform(F.array(value), then)[0]


def softmax(a: Column) -> Column:
    shifted = lambda top: bound(F.transform(a, lambda x: F.exp(x - top)), lambda e: bound(total(e), lambda z: F.transform(e, lambda x: x / z)))
    return bound(F.array_max(a), shifted)


def argmax(a: Column) -> Column:
    """The first position of the largest value, from 0."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("long")


#: The coefficients of Acklam's rational approximation of the inverse normal distribution.
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)


def _horner(x: Column, values: tuple[float, ...]) -> Column:
    out = F.lit(values[0])
    for v in values[1:]:
        out = out * x + v
    return out


def normal_quantile(p: Column) -> Column:
    """Inverse of the normal distribution function, relative error about 1e-9; p in (0, 1)."""
    q, low = p - 0.5, F.sqrt(-2 * F.ln(F.least(p, 1 - p)))
    middle = _horner(q * q, _A) * q / _horner(q * q, _B)
    tail = _horner(low, _C) / _horner(low, _D)
    return F.when((p >= 0.02425) & (p <= 0.97575), middle).when(p < 0.5, tail).otherwise(-tail)


def erf(x: Column) -> Column:
    """Error function by a rational approximation with absolute error below 1.5e-7."""
    #: Abramowitz and Stegun 7.1.26.
    t = 1 / (1 + 0.3275911 * F.abs(x))
    y = 1 - _horner(t, (1.061405429, -1.453152027, 1.421413741, -0.284496736, 0.254829592)) * t * F.exp(-x * x)
    return F.when(x < 0, -y).otherwise(y)


SQRT2 = math.sqrt(2.0)
