"""Monte Carlo precision by non-overlapping batch means."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varve.functions.numeric import is_finite, reasons, safe_div, status
from varve.functions.special import chi2_ppf_column, norm_cdf, norm_pdf
from varve.operators.stats import wilson_columns

# Precision gate thresholds and the acceptance range of the MCSE validation.
WEIGHT_ESS_LIMIT, INFLUENCE_ESS_LIMIT, UPPER_MCSE_LIMIT, RESIDUAL_LIMIT = 1000.0, 400.0, 0.5, 1e-10
RATIO_RANGE, COVERAGE_FLOOR, COVERAGE_Z = (0.75, 1.33), 0.90, 1.96

# Salts a hot key is split into; every join against prepared terms copies its small side that often.
SALTS = 8


def default_batch_sizes(draws: Column) -> Column:
    """Cube-root and square-root batch sizes, distinct, each leaving at least two batches; null below four draws."""
    n = draws.cast("double")
    first = F.greatest(F.lit(1).cast("long"), F.floor(F.pow(n, F.lit(1.0 / 3.0))))
    second = F.least(F.greatest(first + 1, F.floor(F.sqrt(n))), F.floor(n / 2))
    return F.when(draws >= 4, F.array(F.least(first, second - 1), second))


def chain_sizes(terms: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Draw counts per key and the default batch sizes from its shortest chain."""
    per = terms.groupBy(*keys, "chain").agg(F.count(F.lit(1)).alias("_c"))
    g = per.groupBy(*keys).agg(F.min("_c").alias("draws_per_chain"), F.max("_c").alias("longest_chain"), F.count(F.lit(1)).alias("chains"), F.sum("_c").alias("n_total"))
    return g.withColumn("sizes", default_batch_sizes(F.col("draws_per_chain")))


def batch_means(series: DataFrame, keys: Sequence[str], value: str, sizes: Column) -> DataFrame:
    """Long-run variance of each chain for each batch size (an array column), tail dropped.

    Both sizes come from one pass; the batch number is part of the first grouping key, so a long
    chain is spread over its batches. Below two complete batches the variance is null. Plain and
    squared sums of the whole chain ride along for the marginal variance.
    """
    s = series.withColumn("b", F.explode(sizes)).withColumn("_batch", F.floor(F.col("draw") / F.col("b")))
    v = F.col(value)
    per = s.groupBy(*keys, "b", "chain", "_batch").agg(F.sum(v).alias("_s"), F.sum(v * v).alias("_s2"), F.count(F.lit(1)).alias("_n"))
    whole = F.col("_n") == F.col("b")
    g = per.groupBy(*keys, "b", "chain").agg(
        F.sum("_n").alias("n_chain"), F.count_if(whole).alias("n_batches"), F.var_samp(F.when(whole, F.col("_s") / F.col("b"))).alias("_v"),
        F.sum("_s").alias("total"), F.sum("_s2").alias("total_sq"),
    )
    lrv = F.when(F.col("n_batches") >= 2, F.col("b") * F.col("_v"))
    return g.withColumn("lrv", lrv).withColumn("dof", F.col("n_batches") - 1).withColumn("dropped", F.col("n_chain") - F.col("n_batches") * F.col("b")).drop("_v")


def pool_chains(lrv: DataFrame, keys: Sequence[str], tail: float) -> DataFrame:
    """Variance of the pooled mean, Satterthwaite degrees of freedom and the chi-square upper MCSE.

    A chain contributes n_c LRV_c / N^2; chains with zero variance do not enter the degrees of freedom.
    """
    part = F.col("n_chain") * F.col("lrv")
    n = F.sum("n_chain").cast("double")
    g = lrv.groupBy(*keys, "b").agg(
        F.count(F.lit(1)).alias("chains"),
        n.alias("n_total"),
        F.when(F.count("lrv") == F.count(F.lit(1)), F.sum(part) / (n * n)).alias("variance"),
        (F.sum(F.when(part > 0, part * part / F.col("dof"))) / (n * n) / (n * n)).alias("_den"),
        ((F.sum("total_sq") - F.sum("total") * F.sum("total") / n) / (n - 1)).alias("marginal_variance"),
    )
    g = g.withColumn("mcse", F.sqrt(F.greatest(F.col("variance"), F.lit(0.0))))
    g = g.withColumn("dof", F.when(F.col("variance") > 0, safe_div(F.col("variance") * F.col("variance"), F.col("_den")))).drop("_den")
    g = g.withColumn("chi2_lower", chi2_ppf_column(F.lit(tail), F.col("dof")))
    return g.withColumn("upper_mcse", F.sqrt(safe_div(F.col("variance") * F.col("dof"), F.col("chi2_lower"))))


def influence(prepared: DataFrame, quantiles: DataFrame, keys: Sequence[str], sizes: DataFrame | None = None, error: str = "normal") -> DataFrame:
    """h = w (F(q) - p) and the score-scale influence x = -Q h / (mean(w) f) per draw, for every p.

    ``prepared`` carries the scaled weight ``w``; quantile rows are copied over the salts so a hot
    entity stays split. Batch ``sizes`` (one row per key) ride along on the quantile rows.
    """
    q = quantiles.select(*keys, "p", "q", "density", "mean_w")
    if sizes is not None:
        q = q.join(sizes.select(*[c for c in sizes.columns if c in keys or c == "sizes"]), [c for c in keys if c in sizes.columns])
    j = at_roots(prepared, q, keys, error)
    h = F.col("w") * (F.col("cdf") - F.col("p"))
    x = -F.exp("q") * h / (F.col("mean_w") * F.col("density"))
    extra = ["sizes"] if sizes is not None else []
    return j.select(*keys, "p", "chain", "draw", h.alias("h"), x.alias("x"), "w", "cdf", *extra)


def at_roots(prepared: DataFrame, roots: DataFrame, keys: Sequence[str], error: str = "normal") -> DataFrame:
    """Every term with every root ``q`` of its key and the component CDF there as ``cdf``."""
    roots = roots.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return standardised(prepared.join(roots.hint("shuffle_hash"), [*keys, "_salt"]), "q", error).withColumn("cdf", conditional_cdf(error))


def standardised(terms: DataFrame, x: str, error: str) -> DataFrame:
    """Attach the standardised distance of column ``x`` to every component as ``_v`` (and ``_v_wide``)."""
    out = terms.withColumn("_v", (F.col(x) - F.col("mu")) / F.col("sd"))
    return out if error == "normal" else out.withColumn("_v_wide", (F.col(x) - F.col("mu")) / F.col("sd_wide"))


def conditional_cdf(error: str) -> Column:
    """Component CDF over ``standardised`` terms; contamination adds a 5% share of variance v + 8 sigma_r^2."""
    base = norm_cdf("_v")
    return base if error == "normal" else F.lit(0.95) * base + F.lit(0.05) * norm_cdf("_v_wide")


def conditional_density(error: str) -> Column:
    base = norm_pdf("_v") / F.col("sd")
    return base if error == "normal" else F.lit(0.95) * base + F.lit(0.05) * norm_pdf("_v_wide") / F.col("sd_wide")


def quantile_mcse(influences: DataFrame, quantiles: DataFrame, keys: Sequence[str], tail: float) -> DataFrame:
    """Precision record of every quantile and batch size: MCSE on both scales, upper bounds, influence ESS.

    ``influences`` must carry ``sizes``. The rows of the draws are read once; everything after the
    batch sums works on reduced tables.
    """
    return mcse_of_series(batch_means(influences, [*keys, "p"], "h", F.col("sizes")), quantiles, keys, tail)


def mcse_of_series(series: DataFrame, quantiles: DataFrame, keys: Sequence[str], tail: float) -> DataFrame:
    """``quantile_mcse`` from the batch means of the influences."""
    by = [*keys, "p"]
    pooled = pool_chains(series, by, tail).drop("n_total")
    j = pooled.join(quantiles.select(*by, "quantile", "density", "mean_w", "n_total", "residual", "weight_ess"), by)
    unit = F.lit(1.0) / (F.col("mean_w") * F.col("density"))
    ess = F.when(F.col("variance") > 0, F.col("marginal_variance") / F.col("variance")).when(
        (F.col("variance") == 0) & (F.col("marginal_variance") == 0), F.col("n_total").cast("double"))
    return j.select(
        *by, F.col("b").alias("batch_size"), "chains", "quantile", (F.col("variance") * unit * unit).alias("log_variance"), (F.col("mcse") * unit).alias("log_mcse"),
        (F.col("quantile") * F.col("mcse") * unit).alias("mcse"), F.col("dof"), (F.col("upper_mcse") * unit).alias("log_upper_mcse"),
        (F.col("quantile") * F.col("upper_mcse") * unit).alias("upper_mcse"), ess.alias("influence_ess"), "weight_ess", "residual", "density", "mean_w",
    )


def batch_stability(records: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Absolute and relative difference of the MCSEs at the smaller and the larger batch size."""
    g = records.groupBy(*keys).agg(F.min_by("mcse", "batch_size").alias("mcse_small"), F.max_by("mcse", "batch_size").alias("mcse_large"))
    d = F.abs(F.col("mcse_small") - F.col("mcse_large"))
    top = F.greatest("mcse_small", "mcse_large")
    return g.withColumn("absolute", d).withColumn("relative", F.when(top > 0, d / F.nullif(top, F.lit(0.0))).otherwise(F.lit(0.0)))


def finite_flags(records: DataFrame) -> DataFrame:
    """Names of the numerical checks a record fails."""
    return records.withColumn("failed_checks", reasons({
        "residual": ~is_finite(F.col("residual")), "density": ~(is_finite(F.col("density")) & (F.col("density") > 0)), "weights": ~(F.col("mean_w") > 0),
        "quantile": ~(is_finite(F.col("quantile")) & (F.col("quantile") > 0)), "mcse": ~is_finite(F.col("mcse")),
        "upper_mcse": F.col("upper_mcse").isNotNull() & ~is_finite(F.col("upper_mcse")),
    }))


def precision_gate(records: DataFrame, pooled: bool = True, weight_ess: float = WEIGHT_ESS_LIMIT, influence_ess: float = INFLUENCE_ESS_LIMIT, upper: float = UPPER_MCSE_LIMIT, residual: float = RESIDUAL_LIMIT) -> DataFrame:
    """PASS/FAIL per record. A single fit only has to be finite; the pooled one must also be precise."""
    checks = {
        "residual": ~(F.abs("residual") <= residual), "weights": ~(F.col("mean_w") > 0), "density": ~(F.col("density") > 0),
        "upper_undefined": ~is_finite(F.col("upper_mcse")), "influence_ess_undefined": ~is_finite(F.col("influence_ess")),
    }
    if pooled:
        checks |= {"upper_mcse": ~(F.col("upper_mcse") <= upper), "influence_ess": ~(F.col("influence_ess") >= influence_ess), "weight_ess": ~(F.col("weight_ess") >= weight_ess)}
    out = records.withColumn("reasons", reasons(checks))
    return out.withColumn("status", status(F.col("reasons")))


def exceedances(records: DataFrame, limit: float = UPPER_MCSE_LIMIT, id_cols: Sequence[str] = ("entity_id", "p")) -> DataFrame:
    """Records above the threshold, and how many distinct quantiles they touch."""
    return records.filter(F.col("upper_mcse") > limit).agg(F.count(F.lit(1)).alias("n_records"), F.count_distinct(*[F.col(c) for c in id_cols]).alias("n_quantiles"))


def compatibility(records: DataFrame, other: DataFrame | None, z: float, keys: Sequence[str] = ("entity_id", "p"), fit: str = "fit") -> DataFrame:
    """Difference of two quantile sources against z times their combined MCSE; fails closed.

    The MCSE of a source is its larger one over batch sizes. With ``other`` None every pair of fits
    of one table is compared.
    """
    def reduced(r: DataFrame, side: str) -> DataFrame:
        cols = [*keys, fit] if fit in r.columns else list(keys)
        g = r.groupBy(*cols).agg(F.max("quantile").alias(f"q_{side}"), F.max("mcse").alias(f"mcse_{side}"))
        return g.withColumnRenamed(fit, f"{fit}_{side}") if fit in cols else g

    a, b = reduced(records, "a"), reduced(records if other is None else other, "b")
    j = a.join(b, list(keys))
    if other is None:
        j = j.filter(F.col(f"{fit}_a") < F.col(f"{fit}_b"))
    diff = F.abs(F.col("q_a") - F.col("q_b"))
    combined = F.sqrt(F.col("mcse_a") * F.col("mcse_a") + F.col("mcse_b") * F.col("mcse_b"))
    ok = is_finite(combined) & (combined > 0) & is_finite(diff) & (diff <= F.lit(z) * combined)
    return j.withColumn("difference", diff).withColumn("combined_mcse", combined).withColumn("compatible", F.coalesce(ok, F.lit(False)))


def validate_mcse(replications: DataFrame, by: Sequence[str]) -> DataFrame:
    """Stored replications (error, mcse): ratio of root mean squares and coverage of 1.96 MCSE."""
    g = replications.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("rms_error"), F.sqrt(F.avg(F.col("mcse") * F.col("mcse"))).alias("rms_mcse"),
        F.count_if(F.abs("error") <= F.lit(COVERAGE_Z) * F.col("mcse")).alias("covered"),
    )
    g = g.withColumn("ratio", safe_div(F.col("rms_error"), F.col("rms_mcse")))
    g = wilson_columns(g, "covered", "n", prefix="coverage_")
    ok = F.col("ratio").between(*RATIO_RANGE) & (F.col("coverage_proportion") >= COVERAGE_FLOOR)
    return g.withColumn("passes", F.coalesce(ok, F.lit(False)))


def acceptance(gated: DataFrame, compared: DataFrame) -> DataFrame:
    """One verdict for a run, with the extremes that decided it."""
    a = gated.agg(
        F.count(F.lit(1)).alias("n_records"), F.min("weight_ess").alias("min_weight_ess"), F.min("influence_ess").alias("min_influence_ess"), F.max("upper_mcse").alias("max_upper_mcse"),
        F.max(F.abs("residual")).alias("max_residual"), F.count_if(F.col("status") != "PASS").alias("n_failed"),
    ).withColumn("_k", F.lit(0))
    b = compared.agg(F.count(F.lit(1)).alias("n_comparisons"), F.count_if(~F.col("compatible")).alias("n_incompatible")).withColumn("_k", F.lit(0))
    j = a.join(F.broadcast(b), "_k").drop("_k")
    j = j.withColumn("reasons", reasons({"precision": F.col("n_failed") > 0, "replication": F.col("n_incompatible") > 0, "empty": F.col("n_records") == 0}))
    return j.withColumn("status", status(F.col("reasons")))
