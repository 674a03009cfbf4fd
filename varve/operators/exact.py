"""Correctly rounded sums of doubles: integer limbs by exponent, added as longs."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varve.functions.numeric import is_finite

# bits of a limb: four limbs hold the 53 bits of any double whose first limb is not empty, and a long
# has room for 2^42 limbs of one group
BITS, LIMBS = 20, 4
BASE = 1 << BITS


def _power(exponent: Column) -> tuple[Column, Column]:
    """2 ** exponent as two factors, each an ordinary double."""
    half = F.floor(exponent / 2)
    return F.pow(F.lit(2.0), half), F.pow(F.lit(2.0), exponent - half)


def _limbs(rows: DataFrame) -> DataFrame:
    """Cut ``_x`` (finite or null) into signed integers ``_d0`` to ``_d3``: x = sum of d_i * BASE ** (_k - i).

    Every step scales by a power of two or takes off an integer part, so nothing is rounded. A
    logarithm that is off by a step only moves a bit between limbs.
    """
    rows = rows.withColumn("_k", F.coalesce(F.floor(F.log2(F.abs("_x")) / BITS), F.lit(0)).cast("int"))
    first, second = _power(-F.col("_k") * BITS)
    rows = rows.withColumn("_r", F.col("_x") * first * second)
    for i in range(LIMBS):
        rows = rows.withColumn(f"_d{i}", F.col("_r").cast("long")).withColumn("_r", (F.col("_r") - F.col(f"_d{i}")) * F.lit(float(BASE)))
    return rows


def _with(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often it is used."""
    return F.transform(F.array(value), body)[0]


def _carried(limbs: Column, places: Column, sign: int) -> Column:
    """Digits 0 to BASE - 1 from the lowest place up, and what is left to carry: -1 if the sum is negative."""
    none = F.lit(0).cast("long")
    start = F.struct(none.alias("carry"), F.array().cast("array<long>").alias("digits"))

    def step(acc: Column, place: Column) -> Column:
        v = sign * F.coalesce(F.try_element_at(limbs, place), none) + acc["carry"]
        # an arithmetic shift is the quotient rounded down, so the digit is never negative
        return F.struct(F.shiftright(v, BITS).alias("carry"), F.concat(acc["digits"], F.array(v.bitwiseAND(F.lit(BASE - 1).cast("long")))).alias("digits"))

    return F.aggregate(places, start, step)


def _nearest(tops: Column, top: Column) -> Column:
    """Double nearest to the digits ``tops`` (highest first, at place ``top``), ties to even."""
    def value(first: Column) -> Column:
        at = lambda i: F.coalesce(F.get(tops, first + (i - 1)), F.lit(0).cast("long"))
        # four digits decide, of the others only whether one is left
        rest = F.exists(F.slice(tops, first + LIMBS, F.size(tops)), lambda d: d > 0)
        high = (at(0) * BASE + at(1)).cast("double") * F.lit(2.0 ** (2 * BITS + 1))
        low = ((at(2) * BASE + at(3)) * 2 + F.when(rest, F.lit(1)).otherwise(F.lit(0))).cast("double")
        # both parts are exact and the bit of the rest lies below every rounding position: one rounding
        one, two = _power((top - (first - 1) - (LIMBS - 1)) * BITS - 1)
        return F.when(first == 0, F.lit(0.0)).otherwise((high + low) * one * two)

    return _with(F.array_position(F.transform(tops, lambda d: d > 0), True).cast("int"), value)


def _rounded(limbs: Column) -> Column:
    """Double nearest to the sum of ``limbs`` (map: place -> long), infinite beyond the range."""
    def signed(places: Column) -> Column:
        top = F.element_at(places, -1)
        plus = lambda up: F.when(up["carry"] < 0, -_with(F.reverse(_carried(limbs, places, -1)["digits"]), lambda t: _nearest(t, top))).otherwise(
            _with(F.reverse(up["digits"]), lambda t: _nearest(t, top)))
        return _with(_carried(limbs, places, 1), plus)

    # a sum of longs carries over at most three places and its sign
    return _with(F.sequence(F.array_min(F.map_keys(limbs)), F.array_max(F.map_keys(limbs)) + LIMBS), signed)


def exact_sums(df: DataFrame, by: Sequence[str], values: dict[str, Column], *aggs: Column) -> DataFrame:
    """Group by ``by`` (nulls are a group) with the plain ``aggs`` and the exact sum of each of ``values``.

    A sum is that of the doubles as they are, rounded once at the end, whatever their order and
    magnitude. It is null if a value is null, NaN or infinite, or if the total is. An empty table
    without ``by`` gives one row of null sums.

    Values are combined by (group, exponent) before the first shuffle; a group has at most some 110
    exponents, so the tables after it are small however large the groups are.
    """
    by = list(by)
    pairs = F.array(*[F.struct(F.lit(name).alias("_name"), x.cast("double").alias("_x")) for name, x in values.items()])
    rows = df.select(*by, F.inline(pairs)).withColumn("_bad", ~is_finite(F.col("_x")))
    rows = _limbs(rows.withColumn("_x", F.when(~F.col("_bad"), F.col("_x"))))
    cells = rows.groupBy(*by, "_name", "_k").agg(*[F.sum(f"_d{i}").alias(f"_d{i}") for i in range(LIMBS)], F.count_if("_bad").alias("_bad"))
    parts = F.array(*[F.struct((F.col("_k") - i).alias("_place"), F.coalesce(F.col(f"_d{i}"), F.lit(0).cast("long")).alias("_v"), (F.col("_bad") if i == 0 else F.lit(0).cast("long")).alias("_bad")) for i in range(LIMBS)])
    places = cells.select(*by, "_name", F.inline(parts)).groupBy(*by, "_name", "_place").agg(F.sum("_v").alias("_v"), F.sum("_bad").alias("_bad"))
    total = places.groupBy(*by, "_name").agg(F.map_from_entries(F.collect_list(F.struct("_place", "_v"))).alias("_limbs"), F.sum("_bad").alias("_bad"))
    total = total.withColumn("_t", _rounded(F.col("_limbs")))
    total = total.withColumn("_t", F.when((F.col("_bad") == 0) & is_finite(F.col("_t")), F.col("_t")))
    wide = total.groupBy(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.lit(0).alias("_one")).agg(*[F.max(F.when(F.col("_name") == n, F.col("_t"))).alias(n) for n in values])
    plain = df.groupBy(*by).agg(*(aggs or (F.count(F.lit(1)).alias("_n"),))).withColumn("_key", F.lit(0))
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)], F.col("_key") == F.col("_one"))
    out = plain.join(wide, on, "left").drop("_key", "_one", "_n", *[f"_by{i}" for i in range(len(by))])
    return out
