"""Leakage-free features: only rows at or before the cutoff enter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varve.operators import linear

SUMMARY = ["log_age", "endpoint", "level", "slope", "resid_sd"]
GRID = 30


def recent_rows(prefix: DataFrame, window: int) -> DataFrame:
    """Last min(window, C) cycles of each prefix; cycles are dense, so a filter is enough."""
    return prefix.filter((F.col("cycle") <= F.col("cutoff")) & (F.col("cycle") > F.col("cutoff") - F.lit(window)))


def log_age(cutoff: Column) -> Column:
    return F.log(cutoff / F.lit(100.0))


def log_remaining(lifetime: Column, cutoff: Column) -> Column:
    """Log of the remaining life; null unless positive."""
    left = lifetime - cutoff
    return F.when(left > 0, F.log(left.cast("double")))


def sequences(scored: DataFrame, keys: Sequence[str] = ("entity_id",), keep: Sequence[str] = ("role", "cutoff", "lifetime")) -> DataFrame:
    """Cycle-ordered score array per entity; its length is at most the window."""
    pairs = F.sort_array(F.collect_list(F.struct("cycle", "z")))
    return scored.groupBy(*keys, *keep).agg(F.transform(pairs, lambda s: s["z"]).alias("z"), F.count(F.lit(1)).alias("w"))


def trend(scored: DataFrame, keys: Sequence[str] = ("entity_id",), keep: Sequence[str] = ("role", "cutoff", "lifetime"), unit: float = 30.0) -> DataFrame:
    """Least-squares line of the score on time before the cutoff in units of 30 cycles.

    Gives level at the cutoff, slope and residual SD with w - 2 degrees of freedom; a single point
    is its own level with slope and SD 0, two points have SD 0.
    """
    t = (F.col("cycle") - F.col("cutoff")) / F.lit(unit)
    s = scored.withColumn("_t", t)
    g = s.groupBy(*keys, *keep).agg(
        F.count(F.lit(1)).alias("w"),
        F.max_by("z", "cycle").alias("endpoint"),
        F.regr_intercept("z", "_t").alias("_b0"),
        F.regr_slope("z", "_t").alias("_b1"),
        F.regr_syy("z", "_t").alias("_syy"),
        F.regr_sxx("z", "_t").alias("_sxx"),
    )
    ssr = F.greatest(F.lit(0.0), F.col("_syy") - F.col("_b1") * F.col("_b1") * F.col("_sxx"))
    return g.select(
        *keys, *keep, "w", log_age(F.col("cutoff")).alias("log_age"), "endpoint",
        F.when(F.col("w") == 1, F.col("endpoint")).otherwise(F.col("_b0")).alias("level"),
        F.when(F.col("w") == 1, F.lit(0.0)).otherwise(F.col("_b1")).alias("slope"),
        F.when(F.col("w") < 3, F.lit(0.0)).otherwise(F.sqrt(ssr / (F.col("w") - 2))).alias("resid_sd"),
    )


def resampled(z: Column, points: int = GRID) -> Column:
    """``points`` values linearly interpolated over the observed span; one value is repeated."""
    w = F.size(z)

    def at(k: Column) -> Column:
        pos = k.cast("double") * (w - 1) / F.lit(float(points - 1))
        lo = F.least(F.floor(pos).cast("int"), w - 1)
        hi = F.least(lo + 1, w - 1)
        low, high = F.element_at(z, lo + 1), F.element_at(z, hi + 1)
        return low + (pos - lo) * (high - low)

    return F.transform(F.sequence(F.lit(0), F.lit(points - 1)), at)


def feature_gate(summary: DataFrame, full: DataFrame, tolerance: float = 1e-12, id_col: str = "entity_id") -> DataFrame:
    """Both feature sets must cover the same entities and share their log age."""
    l = summary.select(id_col, F.col("log_age").alias("_a"))
    r = full.select(id_col, F.col("log_age").alias("_b"))
    j = l.join(r, id_col, "full_outer")
    apart = F.col("_a").isNull() | F.col("_b").isNull()
    off = ~apart & (F.abs(F.col("_a") - F.col("_b")) > tolerance)
    return j.agg(F.count(F.lit(1)).alias("n_entities"), F.count_if(apart).alias("n_unmatched"), F.count_if(off).alias("n_misaligned"))


def fit_linear_scaler(vectors: DataFrame, column: str = "x", by: Sequence[str] = ("stage",)) -> DataFrame:
    """Mean and population SD per coordinate of the fitting rows; a zero SD becomes 1."""
    long = vectors.select(*by, F.posexplode(column).alias("k", "_v"))
    sd = F.stddev_pop("_v")
    return long.groupBy(*by, "k").agg(F.avg("_v").alias("mean"), F.when(sd > 0, sd).otherwise(F.lit(1.0)).alias("sd"))


def fit_and_project(prefix: DataFrame, channels: Sequence[str], fit_roles: Sequence[str] = ("fit",), window: int = 30) -> tuple[DataFrame, DataFrame]:
    """Fit the preprocessor on the prefixes of ``fit_roles`` and score everyone's last ``window`` cycles."""
    staged = prefix.withColumn("stage", F.lit("fit"))
    weighted = linear.entity_weights(staged.filter(F.col("role").isin(*fit_roles)))
    pre = linear.principal_component(linear.weighted_moments(weighted, channels), channels)
    scored = linear.project(recent_rows(staged, window), pre, channels)
    return pre, scored
