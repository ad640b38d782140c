"""Exact and half-up arithmetic."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EXACT = "decimal(38,0)"

#: Minor units by which amounts may differ and still agree, both ends included.
TOLERANCE = 2


def exact(x: Column) -> Column:
    return x.cast(EXACT)


def exact_sum(x: Column) -> Column:
    """A sum that cannot overflow 64 bits."""
    return F.sum(exact(x))


def truncated_quotient(a: Column, b: Column) -> Column:
    """Integer division toward zero on wide decimals, where ``div`` would wrap to 64 bits."""
    a, b = exact(a), exact(b)
    return ((a - a % b) / b).cast(EXACT)


def within_tolerance(difference: Column, tolerance: int = TOLERANCE) -> Column:
    return F.abs(difference) <= tolerance


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def rounded3(x: Column) -> Column:
    return F.floor(x * 1000 + 0.5) / 1000


def minor_of(x: Column) -> Column:
    """Minor units of a double that was printed with two decimals."""
    return F.round(x * 100).cast("bigint")


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def milliseconds(profiled: Column, wall_ms: Column) -> Column:
    """struct<ms, source>: profiled seconds as ms where they agree with the wall clock, else the wall clock."""
    ms = half_up(profiled * 1000)
    trusted = F.coalesce(F.abs(ms - wall_ms) < wall_ms * 0.5 + 250, F.lit(False))
    return F.struct(
        F.when(trusted, ms).otherwise(half_up(wall_ms)).cast("bigint").alias("ms"), F.when(trusted, "profiler-raw").otherwise("wall-clock").alias("source")
    )


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once: written out, its uses would each compute it anew and outgrow compiled code.

    A fold over nothing, which starts from the value and ends with its use: an element of a transformed array would look up its type,
    through all that is nested in it, for every row.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda kept, _: kept, use)


def _product_error(a: Column, b: float) -> Column:
    """a * b - round(a * b), exactly, from the upper 26 bits and the rest of both factors."""
    top = b * 134217729.0 - (b * 134217729.0 - b)
    rest = b - top
    high = a * 134217729.0 - (a * 134217729.0 - a)
    return once(F.struct(high.alias("h"), (a - high).alias("l")), lambda x: ((x["h"] * top - a * b) + x["h"] * rest + x["l"] * top) + x["l"] * rest)


def to_fixed(x: Column, places: int) -> Column:
    """A double with so many decimals, rounded half away from zero from its exact binary value, where a decimal cast starts from the shortest
    digits that print it. From 1e21 on, as ``1e+21``; without a decimal expansion, its name.

    The fraction times ten to the places is a double and a known error, which decides where the double lies on the edge.
    """
    scale = 10.0**places

    def small(size: Column) -> Column:
        def rounded(v: Column) -> Column:
            product = v["part"] * scale
            up = (product - F.floor(product) - 0.5) + _product_error(v["part"], scale) >= 0
            return once(F.floor(product) + F.when(up, 1).otherwise(0), lambda n: _shown(v["whole"], n))

        return once(F.struct(F.floor(size).alias("whole"), (size - F.floor(size)).alias("part")), rounded)

    def _shown(whole: Column, n: Column) -> Column:
        carried = F.when(n >= scale, 1).otherwise(0)
        digits = (whole + carried).cast("string")
        return F.concat(digits, F.lit("."), F.lpad((n - carried * int(scale)).cast("string"), places, "0")) if places else digits

    def wide(size: Column) -> Column:  # no fraction: two parts, each exact in 64 bits
        high = F.floor(size / 4294967296.0)
        whole = high.cast(EXACT) * F.lit(4294967296).cast(EXACT) + (size - high.cast("double") * 4294967296.0).cast("bigint").cast(EXACT)
        return F.concat(whole.cast(EXACT).cast("string"), F.lit("." + "0" * places if places else ""))

    def named(size: Column) -> Column:
        return F.when(size == float("inf"), "Infinity").otherwise(F.regexp_replace(F.regexp_replace(size.cast("string"), r"\.0E", "E"), "E", "e+"))

    shown = once(F.abs(x.cast("double")), lambda size: F.when(size < 2.0**53, small(size)).when(size < 1e21, wide(size)).otherwise(named(size)))
    return F.when(F.isnan(x), "NaN").otherwise(F.concat(F.when(x < 0, "-").otherwise(""), shown))
