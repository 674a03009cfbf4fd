"""Small Column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_finite(x: Column) -> Column:
    """True for an ordinary number; false for null, NaN and both infinities."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), F.lit(False))


def safe_div(num: Column, den: Column) -> Column:
    """Quotient, null where the denominator is zero."""
    return num / F.nullif(den, F.lit(0.0))


def reasons(checks: dict[str, Column]) -> Column:
    """Array of the names whose condition holds; an undefined condition counts as holding."""
    flags = F.array(*[F.when(F.coalesce(cond, F.lit(True)), F.lit(name)) for name, cond in checks.items()])
    return F.filter(flags, lambda v: v.isNotNull())


def status(failures: Column) -> Column:
    return F.when(F.size(failures) == 0, F.lit("PASS")).otherwise(F.lit("FAIL"))


def wilson(k: Column, n: Column, z: float) -> tuple[Column, Column]:
    """Wilson interval for k of n, clipped to [0, 1]; null for zero trials."""
    n = F.nullif(n.cast("double"), F.lit(0.0))
    p = k / n
    z2 = F.lit(z * z)
    den = F.lit(1.0) + z2 / n
    centre = (p + z2 / (F.lit(2.0) * n)) / den
    half = F.lit(z) * F.sqrt(p * (F.lit(1.0) - p) / n + z2 / (F.lit(4.0) * n * n)) / den
    low = F.when(n.isNotNull(), F.greatest(F.lit(0.0), centre - half))
    high = F.when(n.isNotNull(), F.least(F.lit(1.0), centre + half))
    return low, high
