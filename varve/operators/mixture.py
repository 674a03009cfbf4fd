"""Prediction from posterior draws: sensor terms, importance weights and mixture quantiles."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varve.functions.numeric import reasons, safe_div, status
from varve.functions.special import norm_pdf, norm_ppf, norm_ppf_column
from varve.operators import precision
from varve.operators.precision import SALTS
from varve.session import checkpointed, checkpointed_count

PROBS = (0.05, 0.5, 0.95)
PAIRS = ("zz", "z1", "zs", "11", "1s", "ss")

# Inner products under AR(1) whitening, from four sums per pair of sequences.
_INNER = {f"i_{p}": f"p{p}_first + (p{p}_tail - rho * p{p}_cross + rho * rho * p{p}_head) / (1 - rho * rho)" for p in PAIRS}

# Conditional predictive terms of one (draw, entity) pair; every line may use the lines above it.
TERM_STEPS: tuple[tuple[str, str], ...] = (
    *_INNER.items(),
    ("m0", "g00 + g01 * log_age"),
    ("m1", "g10 + g11 * log_age"),
    ("u1", "i_z1 - m0 * i_11 - m1 * i_1s"),
    ("us", "i_zs - m0 * i_1s - m1 * i_ss"),
    ("uu", "i_zz - 2 * m0 * i_z1 - 2 * m1 * i_zs + m0 * m0 * i_11 + 2 * m0 * m1 * i_1s + m1 * m1 * i_ss"),
    ("s00", "tau0 * tau0"),
    ("s11", "tau1 * tau1"),
    ("s01", "tau0 * tau1 * r_g"),
    ("det_s", "s00 * s11 - s01 * s01"),
    ("sz2", "sigma_z * sigma_z"),
    ("a00", "s11 / det_s + i_11 / sz2"),
    ("a11", "s00 / det_s + i_ss / sz2"),
    ("a01", "i_1s / sz2 - s01 / det_s"),
    ("det_a", "a00 * a11 - a01 * a01"),
    ("d0", "(a11 * u1 - a01 * us) / (det_a * sz2)"),
    ("d1", "(a00 * us - a01 * u1) / (det_a * sz2)"),
    ("log_w", "-0.5 * (w * ln(2 * pi()) + w * ln(sz2) + (w - 1) * ln(1 - rho * rho) + ln(det_s) + ln(det_a) + (uu - u1 * d0 - us * d1) / sz2)"),
    ("mu", "beta0 + beta1 * log_age + gamma0 * (m0 + d0) + gamma1 * (m1 + d1)"),
    ("var", "sigma_r * sigma_r + (gamma0 * gamma0 * a11 - 2 * gamma0 * gamma1 * a01 + gamma1 * gamma1 * a00) / det_a"),
)


def term_stages() -> list[list[tuple[str, str]]]:
    """TERM_STEPS cut into runs whose lines do not use one another."""
    stages: list[list[tuple[str, str]]] = [[]]
    for name, text in TERM_STEPS:
        if any(re.search(rf"\b{earlier}\b", text) for earlier, _ in stages[-1]):
            stages.append([])
        stages[-1].append((name, text))
    return stages


def sequence_sums(scored: DataFrame, keys: Sequence[str] = ("entity_id",), unit: float = 30.0) -> DataFrame:
    """Four sums per pair among {z, 1, s} for each entity's window: first, tail, lag-cross and head.

    A window holds at most 30 rows, so the lag needs no large sort. After this step the cost of a
    (draw, entity) pair no longer depends on the window length.
    """
    w = Window.partitionBy(*keys).orderBy("cycle")
    r = scored.withColumn("_one", F.lit(1.0)).withColumn("_s", (F.col("cycle") - F.col("cutoff")) / F.lit(unit))
    names = {"z": "z", "1": "_one", "s": "_s"}
    for c in names.values():
        r = r.withColumn(f"_prev_{c}", F.lag(c).over(w))
    r = r.withColumn("_first", F.col("_prev__one").isNull()).withColumn("_last", F.col("cycle") == F.col("cutoff"))
    aggs = []
    zero = F.lit(0.0)
    for p in PAIRS:
        x, y = names[p[0]], names[p[1]]
        prod = F.col(x) * F.col(y)
        cross = F.col(x) * F.col(f"_prev_{y}") + F.col(f"_prev_{x}") * F.col(y)
        aggs += [
            F.sum(F.when(F.col("_first"), prod).otherwise(zero)).alias(f"p{p}_first"),
            F.sum(F.when(~F.col("_first"), prod).otherwise(zero)).alias(f"p{p}_tail"),
            F.sum(F.when(~F.col("_first"), cross).otherwise(zero)).alias(f"p{p}_cross"),
            F.sum(F.when(~F.col("_last"), prod).otherwise(zero)).alias(f"p{p}_head"),
        ]
    return r.groupBy(*keys, "cutoff").agg(F.count(F.lit(1)).alias("w"), F.log(F.first("cutoff") / F.lit(100.0)).alias("log_age"), *aggs)


def sensor_terms(sums: DataFrame, draws: DataFrame, fit: str = "fit", salts: int = SALTS) -> DataFrame:
    """Log weight, mean and variance of log remaining life for every draw of an entity's fit.

    The pairing is an equi-join on the fit. Draws are split over salts by their number and entities
    are copied per salt, so one popular fit is shared by many tasks. The number of partitions is
    stated: draws are few bytes but many pairs, and would else be coalesced into one task.
    """
    n = int(draws.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = draws.withColumn("_salt", F.pmod(F.col("draw"), F.lit(salts)).cast("int")).repartition(n, fit, "_salt")
    right = sums.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    j = right.join(left, [fit, "_salt"]).drop("_salt")
    for stage in term_stages():
        j = j.withColumns({name: F.expr(text) for name, text in stage})
    return j.select("entity_id", fit, "chain", "draw", "mu", "var", "log_w", "sigma_r")


def pool_fits(terms: DataFrame, fit: str = "fit") -> DataFrame:
    """Treat the chains of several fits as chains of one: renumber them (fit, chain) -> chain."""
    return terms.withColumn("chain", F.concat_ws(":", fit, "chain")).drop(fit)


def prepare(terms: DataFrame, keys: Sequence[str], error: str = "normal", reweight: bool = True, salts: int = SALTS, persist: bool = True) -> DataFrame:
    """Terms with max-shifted weights, laid out by (key, salt) for the repeated passes of the search.

    At cluster scale hand in a written table: each search round reads these rows again.
    """
    t = terms.withColumn("_salt", F.pmod(F.col("draw"), F.lit(salts)).cast("int")).withColumn("sd", F.sqrt("var"))
    if error == "contamination":
        t = t.withColumn("sd_wide", F.sqrt(F.col("var") + 8 * F.col("sigma_r") * F.col("sigma_r")))
    elif error != "normal":
        raise ValueError("error must be 'normal' or 'contamination'")
    if reweight:
        top = t.groupBy(*keys).agg(F.max("log_w").alias("_top"))
        top = top.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        t = t.join(top.hint("shuffle_hash"), [*keys, "_salt"]).withColumn("w", F.exp(F.col("log_w") - F.col("_top"))).drop("_top")
    else:
        t = t.withColumn("w", F.lit(1.0))
    n = int(t.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    t = t.repartition(n, *keys, "_salt")
    return t.persist(StorageLevel.MEMORY_AND_DISK) if persist else t


def weight_stats(prepared: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Draw count, mean scaled weight, weight ESS (at most the draw count) and the largest normalised weight."""
    w = F.col("w")
    g = prepared.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_total"), F.sum(w).alias("_s"), F.sum(w * w).alias("_s2"), F.max(w).alias("_m"))
    return g.select(
        *keys, "n_total", (F.col("_s") / F.col("n_total")).alias("mean_w"),
        F.least(safe_div(F.col("_s") * F.col("_s"), F.col("_s2")), F.col("n_total").cast("double")).alias("weight_ess"), safe_div(F.col("_m"), F.col("_s")).alias("max_weight"),
    )


def _start(prepared: DataFrame, keys: Sequence[str], probs: Sequence[float], error: str) -> DataFrame:
    """Bracket and normal-approximation starting point of every (key, p)."""
    w = F.col("w")
    sd = F.col("sd_wide") if error == "contamination" else F.col("sd")
    g = prepared.groupBy(*keys).agg(
        F.min("mu").alias("_lo"), F.max("mu").alias("_hi"), F.max(sd).alias("_sd"), F.sum(w).alias("sum_w"),
        F.sum(w * F.col("mu")).alias("_m1"), F.sum(w * (F.col("mu") * F.col("mu") + F.col("var"))).alias("_m2"),
    )
    mean = F.col("_m1") / F.col("sum_w")
    spread = F.sqrt(F.greatest(F.col("_m2") / F.col("sum_w") - mean * mean, F.lit(0.0)))
    rows = F.array(*[F.struct(F.lit(float(p)).alias("p"), F.lit(norm_ppf(p)).alias("_z")) for p in probs])
    s = g.select(*keys, "sum_w", "_lo", "_hi", "_sd", mean.alias("_mean"), spread.alias("_spread"), F.inline(rows))
    radius = (F.abs("_z") + 12) * F.col("_sd") + (F.col("_hi") - F.col("_lo"))
    lo, hi = F.col("_lo") - radius, F.col("_hi") + radius
    x = F.least(F.greatest(F.col("_mean") + F.col("_z") * F.col("_spread"), lo), hi)
    return s.select(*keys, "p", F.col("_z").alias("z"), "sum_w", lo.alias("lo"), hi.alias("hi"), x.alias("x"))


def cdf_and_density(prepared: DataFrame, points: DataFrame, keys: Sequence[str], error: str = "normal", salts: int = SALTS) -> DataFrame:
    """Weighted mixture CDF and density at one point per (key, p): one pass over the terms.

    Points are rows, not columns, and are copied per salt; sums combine before the shuffle.
    """
    spread = points.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    j = prepared.join(spread.hint("shuffle_hash"), [*keys, "_salt"])
    w = F.col("w")
    j = precision.standardised(j, "x", error)
    c, d = precision.conditional_cdf(error), precision.conditional_density(error)
    # the point's own columns are constant within (key, p): grouping by them saves joining them back
    g = j.groupBy(*points.columns).agg(F.sum(w * c).alias("_c"), F.sum(w * d).alias("_d"))
    return g.withColumn("cdf", F.col("_c") / F.col("sum_w")).withColumn("density", F.col("_d") / F.col("sum_w")).drop("_c", "_d")


def mixture_quantiles(prepared: DataFrame, keys: Sequence[str], probs: Sequence[float] = PROBS, error: str = "normal", tolerance: float = 1e-12, max_rounds: int = 120) -> DataFrame:
    """Quantiles of every key's weighted mixture, all keys and probabilities together.

    Safeguarded Newton: each round is one aggregate over the terms of the unfinished points, a step
    that leaves the bracket is replaced by bisection, and the small state table is checkpointed.
    Returns q on the log scale, its exponential, CDF, residual, density and the weight statistics.
    """
    state = checkpointed(_start(prepared, keys, probs, error))
    done: DataFrame | None = None
    for _ in range(max_rounds):
        v = cdf_and_density(prepared, state, keys, error)
        r = F.col("cdf") - F.col("p")
        tight = (F.col("hi") - F.col("lo")) <= 4 * F.lit(2.220446049250313e-16) * F.abs("x")
        lo, hi = F.when(r < 0, F.col("x")).otherwise(F.col("lo")), F.when(r >= 0, F.col("x")).otherwise(F.col("hi"))
        v = v.withColumn("finished", (F.abs(r) <= tolerance) | tight).withColumn("lo", lo).withColumn("hi", hi)
        # far away, Newton on the probit scale (nearly linear for a bell-shaped mixture); close by, plain Newton
        v = v.withColumn("_c", F.greatest(F.least("cdf", F.lit(1.0 - 1e-12)), F.lit(1e-12))).withColumn("_probit", norm_ppf_column("_c"))
        bell = (F.col("_probit") - F.col("z")) * norm_pdf("_probit")
        slope = F.nullif(F.col("density"), F.lit(0.0))
        step = F.col("x") - F.when(F.abs(r) > 1e-4, bell).otherwise(r) / slope
        inside = F.coalesce((step > F.col("lo")) & (step < F.col("hi")), F.lit(False))
        v = v.withColumn("next", F.when(inside, step).otherwise((F.col("lo") + F.col("hi")) / 2)).drop("_c", "_probit")
        v, left = checkpointed_count(v, ~F.col("finished"))
        finished = v.filter("finished").select(*keys, "p", F.col("x").alias("q"), "cdf", "density")
        done = finished if done is None else done.unionByName(finished)
        if not left:
            break
        state = v.filter("not finished").select(*keys, "p", "z", "sum_w", "lo", "hi", F.col("next").alias("x"))
    else:
        raise RuntimeError("mixture quantile search did not converge")
    out = done.withColumn("quantile", F.exp("q")).withColumn("residual", F.col("cdf") - F.col("p"))
    return out.join(weight_stats(prepared, keys), list(keys))


def chain_mcse(chain_quantiles: DataFrame, sizes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """SD of per-chain quantiles over root chains; undefined unless all chains hold equally many draws."""
    g = chain_quantiles.groupBy(*keys, "p").agg(F.count(F.lit(1)).alias("chains"), F.stddev_samp("quantile").alias("_sd"))
    even = sizes.select(*keys, (F.col("draws_per_chain") == F.col("longest_chain")).alias("_even"))
    j = g.join(even, list(keys))
    return j.select(*keys, "p", "chains", F.when(F.col("_even") & (F.col("chains") > 1), F.col("_sd") / F.sqrt("chains")).alias("between_chain_mcse"))


def endpoints(quantiles: DataFrame, keys: Sequence[str], probs: Sequence[float] = PROBS) -> DataFrame:
    """lower, median, upper per key with the ordering gate."""
    names = ("lower", "median", "upper")
    wide = quantiles.groupBy(*keys).agg(*[F.max(F.when(F.col("p") == p, F.col("quantile"))).alias(n) for p, n in zip(probs, names, strict=True)])
    why = reasons({"unordered": ~((F.col("lower") <= F.col("median")) & (F.col("median") <= F.col("upper")))})
    return wide.withColumn("status", status(why))


def recheck_quantiles(prepared: DataFrame, stored: DataFrame, keys: Sequence[str], error: str = "normal", atol: float = 1e-14, rtol: float = 1e-12) -> DataFrame:
    """CDF, density and weight ESS recomputed at the stored roots; rows beyond the tolerance come back."""
    from varve.operators.quality import compare_tables

    by = [*keys, "p"]
    sums = prepared.groupBy(*keys).agg(F.sum("w").alias("sum_w"))
    points = stored.select(*by, F.col("q").alias("x")).join(sums, list(keys))
    again = cdf_and_density(prepared, points, keys, error).select(*by, "cdf", "density")
    again = again.join(weight_stats(prepared, keys).select(*keys, "weight_ess"), list(keys))
    return compare_tables(again, stored, by, ["cdf", "density", "weight_ess"], atol, rtol)


def recheck_precision(prepared: DataFrame, stored: DataFrame, keys: Sequence[str], tail: float, error: str = "normal", atol: float = 1e-14, rtol: float = 1e-12) -> DataFrame:
    """MCSE, its upper bound, influence ESS and degrees of freedom recomputed at the stored roots.

    ``stored`` has a row per (key, p, batch_size) with the root ``q`` and the four values. Density,
    weights and influences come from the terms, nothing from the record but its root; rows beyond the
    tolerance, missing or unknown ones come back.
    """
    from varve.operators.quality import compare_tables

    by = [*keys, "p"]
    sums = prepared.groupBy(*keys).agg(F.sum("w").alias("sum_w"))
    roots = stored.groupBy(*by).agg(F.max("q").alias("x")).join(sums, list(keys))
    at = cdf_and_density(prepared, roots, keys, error).drop("sum_w").withColumnRenamed("x", "q")
    at = at.withColumn("quantile", F.exp("q")).withColumn("residual", F.col("cdf") - F.col("p"))
    at = checkpointed(at.join(weight_stats(prepared, keys), list(keys)))
    h = precision.influence(prepared, at, keys, precision.chain_sizes(prepared, keys), error)
    again = precision.quantile_mcse(h, at, keys, tail)
    return compare_tables(again, stored, [*by, "batch_size"], ["mcse", "upper_mcse", "influence_ess", "dof"], atol, rtol)
