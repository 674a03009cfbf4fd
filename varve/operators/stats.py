"""Summaries, ranks, correlations, intervals and resampling statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varve.functions.hashing import replicate_picks
from varve.functions.numeric import is_finite, reasons, safe_div, status, wilson
from varve.functions.special import norm_ppf, norm_ppf_column
from varve.operators.exact import exact_sums
from varve.operators.ordering import average_ranks, finite_only, linear_quantiles

# Thresholds of the chain diagnostics gate.
RHAT_LIMIT, ESS_LIMIT, BFMI_LIMIT, DEPTH_FRACTION_LIMIT, DEPTH_SATURATED = 1.01, 400.0, 0.3, 0.01, 12


def summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """n, min, quartiles, mean and max per key, for keys of any size."""
    q = linear_quantiles(df, keys, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    basic = df.groupBy(*keys).agg(F.min(value).alias("min"), F.avg(value).alias("mean"), F.max(value).alias("max"))
    if keys:
        return basic.join(q, list(keys), "left").fillna(0, ["n"])
    one = F.lit(0).alias("_k")
    return basic.select("*", one).join(F.broadcast(q.select("*", one)), "_k").drop("_k")


def pearson(x: Column, y: Column) -> Column:
    """Correlation aggregate: null below two rows or at zero variance of either side.

    A side is constant if its extremes are equal: the moments of a constant, merged over tasks, may
    leave a variance of a few rounding errors.
    """
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    varies = (F.min(a) < F.max(a)) & (F.min(b) < F.max(b))
    return F.when((F.count(a) >= 2) & varies, safe_div(F.covar_pop(a, b), F.sqrt(F.var_pop(a) * F.var_pop(b))))


def associations(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Pearson and Spearman (Pearson of average ranks) per key."""
    ranked = average_ranks(average_ranks(df, keys, x, "_rx"), keys, y, "_ry")
    return ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        pearson(F.col(x).cast("double"), F.col(y).cast("double")).alias("pearson"),
        pearson(F.col("_rx"), F.col("_ry")).alias("spearman"),
    )


def top_correlations(df: DataFrame, columns: Sequence[str], k: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Largest absolute pairwise correlations; constant columns yield null and are skipped."""
    pairs = [(columns[i], columns[j]) for i in range(len(columns)) for j in range(i + 1, len(columns))]
    wide = df.groupBy(*by).agg(*[pearson(F.col(a), F.col(b)).alias(f"r_{a}_{b}") for a, b in pairs])
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r_{a}_{b}").alias("r")) for a, b in pairs])
    long = wide.select(*by, F.inline(cells)).filter(F.col("r").isNotNull())
    order = [F.abs("r").desc(), "a", "b"]
    if not by:
        return long.orderBy(*order).limit(k)
    return long.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_n") <= k).drop("_n")


def wilson_columns(df: DataFrame, successes: str, trials: str, confidence: float = 0.95, prefix: str = "") -> DataFrame:
    """Proportion, binomial MCSE and Wilson bounds; all null for zero trials."""
    z = norm_ppf(0.5 + confidence / 2.0)
    n = F.nullif(F.col(trials).cast("double"), F.lit(0.0))
    p = F.col(successes) / n
    low, high = wilson(F.col(successes).cast("double"), F.col(trials), z)
    return (
        df.withColumn(f"{prefix}proportion", p)
        .withColumn(f"{prefix}mcse", F.sqrt(p * (F.lit(1.0) - p) / n))
        .withColumn(f"{prefix}wilson_low", low)
        .withColumn(f"{prefix}wilson_high", high)
    )


def benchmark_mean(pairs: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean of the complete stored differences; unavailable below two rows or with any non-finite one."""
    g = exact_sums(pairs, by, {"_s": F.col(value)}, F.count(F.lit(1)).alias("n"), F.count_if(~is_finite(F.col(value))).alias("n_bad"))
    failures = reasons({"fewer_than_two": F.col("n") < 2, "nonfinite": F.col("n_bad") > 0})
    return g.withColumn("status", status(failures)).withColumn("mean_difference", F.when(F.col("status") == "PASS", F.col("_s") / F.col("n"))).drop("_s")


def influence_diagnostics(pairs: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Largest share of the absolute centred sum, and largest leave-one-out shift of the mean in SE units."""
    base = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count(F.lit(1)))).alias("se"))
    # one row per cohort
    d = pairs.join(F.broadcast(base), list(by)).withColumn("_d", F.abs(F.col(value) - F.col("mean")))
    g = d.groupBy(*by, "n", "mean", "se").agg(F.max("_d").alias("_max"), F.sum("_d").alias("_sum"))
    return g.select(
        *by, "n", "mean", "se",
        safe_div(F.col("_max"), F.col("_sum")).alias("max_share"),
        safe_div(F.col("_max") / (F.col("n") - 1), F.col("se")).alias("max_loo_shift"),
    )


def bootstrap_pivots(values: DataFrame, replicates: int, seed: str, value: str = "x", by: str = "scenario") -> DataFrame:
    """Resampled mean and standard error per replicate.

    ``values`` must carry a dense ``slot`` 1..n per scenario. Every slot of every replicate draws a
    position by hash; sums are combined before the shuffle.
    """
    base = values.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count(F.lit(1)))).alias("se"))
    small = base.select(by, "n")
    slots = values.select(by, "slot").join(F.broadcast(small), by)
    drawn = replicate_picks(slots, replicates, seed, by, "n", by_first=True).select(by, "replicate", "_pick")
    pool = values.select(by, F.col("slot").alias("_pick"), value).hint("shuffle_hash")
    reps = drawn.join(pool, [by, "_pick"]).groupBy(by, "replicate").agg(
        F.avg(value).alias("rep_mean"), (F.stddev_samp(value) / F.sqrt(F.count(F.lit(1)))).alias("rep_se")
    )
    j = reps.join(F.broadcast(base), by)
    bad = ~(is_finite(F.col("rep_mean")) & is_finite(F.col("rep_se")))
    return j.select(
        by, "replicate", "n", "mean", "se", bad.alias("nonfinite"), (~bad & (F.col("rep_se") == 0)).alias("zero_se"),
        safe_div(F.col("rep_mean") - F.col("mean"), F.col("rep_se")).alias("pivot"),
    )


def bootstrap_t(pivots: DataFrame, by: str = "scenario") -> DataFrame:
    """Bootstrap-t interval and one-sided bound. One zero or non-finite draw invalidates the result.

    The status names the first problem in the order: non-finite observed statistic, zero observed
    standard error, zero draw, non-finite draw, non-finite endpoint.
    """
    probs = F.array(F.lit(0.025), F.lit(0.05), F.lit(0.975))
    # the exact percentile holds one value per replicate of a scenario, a count the caller sets
    g = pivots.groupBy(by).agg(
        F.max("n").alias("n"), F.max("mean").alias("mean"), F.max("se").alias("se"), F.count(F.lit(1)).alias("draws"),
        F.count_if("zero_se").alias("zero_se_draws"), F.count_if("nonfinite").alias("nonfinite_draws"), F.percentile("pivot", probs).alias("_q"),
    )
    low = F.col("mean") - F.col("_q")[2] * F.col("se")
    high = F.col("mean") - F.col("_q")[0] * F.col("se")
    one = F.col("mean") - F.col("_q")[1] * F.col("se")
    st = (
        F.when(~(is_finite(F.col("mean")) & is_finite(F.col("se"))), "nonfinite_observed_statistic")
        .when(F.col("se") == 0, "zero_observed_standard_error")
        .when(F.col("zero_se_draws") > 0, "zero_bootstrap_standard_error")
        .when(F.col("nonfinite_draws") > 0, "nonfinite_bootstrap_pivot")
        .when(~(is_finite(low) & is_finite(high) & is_finite(one)), "nonfinite_interval_endpoint")
        .otherwise("ok")
    )
    g = g.withColumn("status", st)
    ok = lambda c: F.when(F.col("status") == "ok", c)
    return g.select(
        by, "n", "mean", "se", "draws", "zero_se_draws", "nonfinite_draws", "status",
        ok(low).alias("interval_low"), ok(high).alias("interval_high"), ok(one).alias("one_sided_upper"),
        ok((low <= 0) & (high >= 0)).alias("contains_zero"), ok(one < 0).alias("rejects"),
    )


def outcome_summary(results: DataFrame, by: str = "scenario", confidence: float = 0.95) -> DataFrame:
    """Operating characteristics of stored bootstrap results: coverage and rejection among available
    intervals, availability among all, and the zero-SE share. Statuses are counted, none is dropped.

    Results that carry ``max_share`` or ``max_loo_shift`` also get the number of defined values, their
    median, 95th percentile and maximum, null where none is defined."""
    ok = F.col("status") == "ok"
    g = results.groupBy(by).agg(
        F.count(F.lit(1)).alias("attempted"), F.count_if(ok).alias("available"),
        F.count_if(F.col("status") == "zero_observed_standard_error").alias("zero_observed"),
        F.count_if(F.col("zero_se_draws") > 0).alias("any_zero_draw"),
        F.count_if(ok & F.col("contains_zero")).alias("covered"), F.count_if(ok & F.col("rejects")).alias("rejected"),
        safe_div(F.sum("zero_se_draws").cast("double"), F.sum("draws").cast("double")).alias("zero_se_fraction"),
        F.sum("nonfinite_draws").alias("nonfinite_draws"),
    )
    g = wilson_columns(g, "covered", "available", confidence, "coverage_")
    g = wilson_columns(g, "rejected", "available", confidence, "rejection_")
    g = wilson_columns(g, "available", "attempted", confidence, "availability_")
    for c in [c for c in ("max_share", "max_loo_shift") if c in results.columns]:
        defined = finite_only(results, c)
        order = linear_quantiles(defined, [by], c, {f"{c}_median": 0.5, f"{c}_p95": 0.95}).withColumnRenamed("n", f"{c}_n_defined")
        g = g.join(order, by, "left").join(defined.groupBy(by).agg(F.max(c).alias(f"{c}_maximum")), by, "left").fillna(0, [f"{c}_n_defined"])
    return g


def unpivot(df: DataFrame, keys: Sequence[str], params: Sequence[str]) -> DataFrame:
    return df.select(*keys, F.inline(F.array(*[F.struct(F.lit(p).alias("param"), F.col(p).cast("double").alias("value")) for p in params])))


def spread_draws(draws: DataFrame, by: Sequence[str], rows: int = 1 << 15) -> DataFrame:
    """Draws over many tasks: they are few bytes, but a row per parameter each, which a task would else hold at once."""
    tasks = max(int(draws.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-draws.count() // rows))
    return draws.repartition(tasks, *by)


def recovery(draws: DataFrame, truth: Mapping[str, float], by: Sequence[str] = ("fit",)) -> DataFrame:
    """Posterior mean, SD and equal-tail 95% interval of each parameter against its true value."""
    dealt = [*by, *[c for c in ("chain", "draw", *truth) if c in draws.columns]]
    long = unpivot(spread_draws(draws, dealt), by, list(truth))
    keys = [*by, "param"]
    q = linear_quantiles(long, keys, "value", {"low": 0.025, "high": 0.975})
    m = long.groupBy(*keys).agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    known = F.element_at(F.create_map(*[F.lit(v) for kv in truth.items() for v in kv]), F.col("param"))
    j = m.join(q, keys).withColumn("truth", known)
    z = safe_div(F.col("mean") - F.col("truth"), F.col("sd"))
    return j.select(
        *keys, "n", "truth", "mean", "sd", "low", "high", F.col("truth").between(F.col("low"), F.col("high")).alias("inside"),
        z.alias("z_error"), (F.abs(z) > 3).alias("gross"),
    )


def recovery_rollup(recovered: DataFrame, by: Sequence[str] = ("regime", "param")) -> DataFrame:
    return recovered.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("inside").alias("covered"),
        F.avg(F.col("mean") - F.col("truth")).alias("mean_bias"), F.max(F.abs("z_error")).alias("max_abs_z"),
    )


def sd_ratio(posterior: DataFrame, prior: DataFrame, params: Sequence[str], by: Sequence[str] = ("fit",)) -> DataFrame:
    """Posterior over prior SD of each parameter; a parameter fixed a priori has no ratio."""
    post = unpivot(posterior, by, params).groupBy(*by, "param").agg(F.stddev_samp("value").alias("posterior_sd"))
    pri = unpivot(prior, [], params).groupBy("param").agg(F.stddev_samp("value").alias("prior_sd"))
    # one prior row per parameter
    return post.join(F.broadcast(pri), "param").withColumn("ratio", safe_div(F.col("posterior_sd"), F.col("prior_sd")))


def replica_tails(replicas: DataFrame, observed: DataFrame, by: Sequence[str]) -> DataFrame:
    """Share of replicated statistics at or above the observed one, with their 5-50-95% band."""
    q = linear_quantiles(replicas, by, "value", {"p05": 0.05, "p50": 0.5, "p95": 0.95})
    tail = replicas.join(observed.select(*by, F.col("value").alias("observed")), list(by))
    t = tail.groupBy(*by, "observed").agg(F.avg((F.col("value") >= F.col("observed")).cast("int")).alias("tail_area"))
    return t.join(q, list(by))


def geometry(draws: DataFrame) -> DataFrame:
    """Unbounded views of the bounded parameters: log scales, inverse hyperbolic tangent of correlations,
    and the log of the AR(1) innovation variance."""
    return draws.select(
        "fit", "chain", "draw",
        F.log("sigma_z").alias("log_sigma_z"), F.log("sigma_r").alias("log_sigma_r"),
        F.atanh("rho").alias("atanh_rho"), F.atanh("r_g").alias("atanh_r_g"),
        (F.lit(2.0) * F.log("sigma_z") + F.log1p(-F.col("rho") * F.col("rho"))).alias("log_nu"),
    )


def bfmi(draw_stats: DataFrame, by: Sequence[str] = ("fit", "chain")) -> DataFrame:
    """Energy Bayesian fraction of missing information per chain.

    Successive energies meet through an equi-join on the draw number, so a long chain stays split.
    """
    nxt = draw_stats.select(*by, (F.col("draw") - 1).alias("draw"), F.col("energy").alias("_next"))
    j = draw_stats.join(nxt, [*by, "draw"], "left")
    d = F.col("_next") - F.col("energy")
    return j.groupBy(*by).agg(safe_div(F.avg(d * d), F.var_samp("energy")).alias("bfmi"))


def sampler_health(draw_stats: DataFrame) -> DataFrame:
    """Divergences, lowest BFMI and depth saturation per fit."""
    g = draw_stats.groupBy("fit").agg(
        F.count(F.lit(1)).alias("n_draws"), F.count_if("diverging").alias("divergences"),
        F.avg((F.col("depth") >= DEPTH_SATURATED).cast("int")).alias("depth_fraction"),
    )
    return g.join(bfmi(draw_stats).groupBy("fit").agg(F.min("bfmi").alias("min_bfmi")), "fit")


def split_rhat(long: DataFrame, by: Sequence[str] = ("fit", "param")) -> DataFrame:
    """Rank-normalised split R-hat: the larger of the bulk and the folded statistic.

    ``long`` holds (keys, chain, draw, value). Ranks come from the distributed order statistics.
    """
    keys = list(by)
    sizes = long.groupBy(*keys, "chain").agg(F.count(F.lit(1)).alias("_c")).groupBy(*keys).agg(F.min("_c").alias("_n"))
    half = F.floor(F.col("_n") / 2)
    j = long.join(sizes, keys).withColumn("_h", F.when(F.col("draw") < half, 0).when((F.col("draw") >= F.col("_n") - half) & (F.col("draw") < F.col("_n")), 1))
    split = j.filter("_h is not null").select(*keys, F.concat_ws("-", "chain", "_h").alias("_chain"), "value")
    med = linear_quantiles(split, keys, "value", {"_med": 0.5}).drop("n")
    folded = split.join(med, keys).withColumn("value", F.abs(F.col("value") - F.col("_med"))).drop("_med")
    both = split.withColumn("_kind", F.lit("bulk")).unionByName(folded.withColumn("_kind", F.lit("folded")))
    ranked = average_ranks(both, [*keys, "_kind"], "value", "_rank")
    total = ranked.groupBy(*keys, "_kind").agg(F.count(F.lit(1)).alias("_s"))
    z = ranked.join(total, [*keys, "_kind"]).withColumn("_p", (F.col("_rank") - F.lit(0.375)) / (F.col("_s") + F.lit(0.25)))
    z = z.withColumn("_z", norm_ppf_column("_p"))
    per = z.groupBy(*keys, "_kind", "_chain").agg(F.count(F.lit(1)).alias("_m"), F.avg("_z").alias("_mean"), F.var_samp("_z").alias("_var"))
    g = per.groupBy(*keys, "_kind").agg(F.avg("_m").alias("_m"), F.var_samp("_mean").alias("_b"), F.avg("_var").alias("_w"))
    r = F.sqrt(safe_div((F.col("_m") - 1) / F.col("_m") * F.col("_w") + F.col("_b"), F.col("_w")))
    return g.groupBy(*keys).agg(F.max(r).alias("rhat"))


def chain_gate(rhat: DataFrame, ess: DataFrame, health: DataFrame) -> DataFrame:
    """PASS/FAIL per fit from R-hat, batch-means ESS and sampler health, every reason kept."""
    worst = rhat.groupBy("fit").agg(F.max("rhat").alias("max_rhat"))
    least = ess.groupBy("fit").agg(F.min("ess_batch_means").alias("min_ess_batch_means"))
    j = health.join(worst, "fit", "left").join(least, "fit", "left")
    checks = {
        "rhat": ~(F.col("max_rhat") < RHAT_LIMIT),
        "ess": ~(F.col("min_ess_batch_means") >= ESS_LIMIT),
        "divergences": F.col("divergences") > 0,
        "bfmi": ~(F.col("min_bfmi") > BFMI_LIMIT),
        "tree_depth": F.col("depth_fraction") > DEPTH_FRACTION_LIMIT,
    }
    j = j.withColumn("reasons", reasons(checks))
    return j.withColumn("status", status(F.col("reasons")))
