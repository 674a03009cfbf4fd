"""Interval scores, paired comparison, and the Monte Carlo error of a mean score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varve.functions.numeric import is_finite, reasons, safe_div
from varve.operators import precision
from varve.operators.exact import exact_sums

ALPHA = 0.1
# Qualification threshold, kink radius in upper MCSEs, Lipschitz constant 2/alpha - 1 of the 90% score.
SCORE_MCSE_LIMIT, KINK_RADIUS, LIPSCHITZ = 0.5, 3.0, 19.0
COMPONENTS = ["width", "below_penalty", "above_penalty", "score"]


def interval_score(y: Column, lower: Column, upper: Column, alpha: float = ALPHA) -> Column:
    """Width plus 2/alpha times the miss distance; null for crossed or non-finite input."""
    zero, k = F.lit(0.0), F.lit(2.0 / alpha)
    s = upper - lower + k * F.greatest(lower - y, zero) + k * F.greatest(y - upper, zero)
    return F.when(is_finite(y) & is_finite(lower) & is_finite(upper) & (lower <= upper), s)


def components(predictions: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Per row: width, penalties, score, inclusive coverage, misses and the median's error."""
    y, lo, hi = F.col("y"), F.col("lower"), F.col("upper")
    k, zero = F.lit(2.0 / alpha), F.lit(0.0)
    return predictions.select(
        "*", (hi - lo).alias("width"), (k * F.greatest(lo - y, zero)).alias("below_penalty"), (k * F.greatest(y - hi, zero)).alias("above_penalty"),
        interval_score(y, lo, hi, alpha).alias("score"), ((lo <= y) & (y <= hi)).alias("covered"), (y < lo).alias("below"), (y > hi).alias("above"),
        (F.col("median") - y).alias("median_error"),
    )


def cohort_gate(scored: DataFrame, cohort: DataFrame, by: Sequence[str] = ("method",), id_col: str = "entity_id") -> DataFrame:
    """All or nothing: a method is AVAILABLE only when every cohort member has exactly one finite score."""
    known = cohort.select(id_col).distinct()
    size = known.agg(F.count(F.lit(1)).alias("n_cohort")).withColumn("_k", F.lit(0))
    per = scored.groupBy(*by, id_col).agg(F.count(F.lit(1)).alias("_n"), F.count_if(~is_finite(F.col("score")) | ~(F.col("y") > 0)).alias("_bad"))
    j = per.join(known.withColumn("_known", F.lit(True)), id_col, "left")
    g = j.groupBy(*by).agg(
        F.count_if("_known").alias("n_known"), F.count_if(F.col("_known").isNull()).alias("n_unknown"), F.count_if(F.col("_n") > 1).alias("n_repeated"), F.sum("_bad").alias("n_bad")
    )
    g = g.withColumn("_k", F.lit(0)).join(F.broadcast(size), "_k").drop("_k")
    ok = (F.col("n_known") == F.col("n_cohort")) & (F.col("n_unknown") == 0) & (F.col("n_repeated") == 0) & (F.col("n_bad") == 0)
    return g.withColumn("primary_status", F.when(ok, "AVAILABLE").otherwise("UNAVAILABLE"))


def method_summary(scored: DataFrame, cohort: DataFrame, by: Sequence[str] = ("method",), id_col: str = "entity_id") -> DataFrame:
    """Mean score, coverage, misses and median errors per method; nulled when the cohort is incomplete."""
    err = F.col("median_error")
    g = exact_sums(
        scored, by, {"_s": F.col("score"), "_ae": F.abs(err), "_se": err * err, "_e": err},
        F.count(F.lit(1)).alias("n"), F.count_if("covered").alias("covered"), F.count_if("below").alias("below"), F.count_if("above").alias("above"),
        F.avg("width").alias("mean_width"), F.count_if(F.col("median") < 0).alias("negative_medians"),
    )
    gate = cohort_gate(scored, cohort, by, id_col).select(*by, "primary_status")
    g = g.join(F.broadcast(gate), list(by))
    # a summary that is not finite makes the primary result unavailable, however complete the cohort
    summed = is_finite(F.col("_s")) & is_finite(F.col("_ae")) & is_finite(F.col("_se")) & is_finite(F.col("_e")) & is_finite(F.col("mean_width"))
    g = g.withColumn("primary_status", F.when(summed, F.col("primary_status")).otherwise("UNAVAILABLE"))
    ok = lambda c: F.when(F.col("primary_status") == "AVAILABLE", c)
    n = F.col("n")
    return g.select(
        *by, "primary_status", "n", ok(F.col("_s") / n).alias("mean_score"), "covered", ok(F.col("covered") / n).alias("coverage"), "below", "above",
        ok(F.col("mean_width")).alias("mean_width"), ok(F.col("_ae") / n).alias("median_mae"), ok(F.sqrt(F.col("_se") / n)).alias("median_rmse"), ok(F.col("_e") / n).alias("median_bias"), "negative_medians",
    )


def paired_components(scored: DataFrame, first: str, second: str, id_col: str = "entity_id", by: Sequence[str] = ()) -> DataFrame:
    """Component differences first - second of each entity (equi-join on the entity)."""
    keys = [*by, id_col]
    a = scored.filter(F.col("method") == first).select(*keys, *[F.col(c).alias(f"_a_{c}") for c in COMPONENTS])
    b = scored.filter(F.col("method") == second).select(*keys, *[F.col(c).alias(f"_b_{c}") for c in COMPONENTS])
    return a.join(b, keys).select(*keys, *[(F.col(f"_a_{c}") - F.col(f"_b_{c}")).alias(c) for c in COMPONENTS], F.col("_a_score").alias("first_score"), F.col("_b_score").alias("second_score"))


def paired_contrast(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean component differences (order-independent sums) and the ratio of mean scores, null at a zero denominator."""
    sums = {f"mean_{c}": F.col(c) for c in COMPONENTS} | {"_a": F.col("first_score"), "_b": F.col("second_score")}
    g = exact_sums(pairs, by, sums, F.count(F.lit(1)).alias("n"))
    g = g.withColumns({f"mean_{c}": safe_div(F.col(f"mean_{c}"), F.col("n")) for c in COMPONENTS})
    return g.withColumn("score_ratio", F.when(F.col("_b") > 0, safe_div(F.col("_a"), F.col("_b")))).drop("_a", "_b")


def contrast_range(contrasts: DataFrame) -> DataFrame:
    """Spread of the mean difference over alternative fits."""
    return contrasts.agg(F.count(F.lit(1)).alias("n_fits"), F.min("mean_score").alias("low"), F.max("mean_score").alias("high"), (F.max("mean_score") - F.min("mean_score")).alias("range"))


def prediction_sensitivity(predictions: DataFrame, base: str, variant: str = "method", id_col: str = "entity_id") -> DataFrame:
    """Largest and mean absolute change of each quantile against the base variant."""
    names = ["lower", "median", "upper"]
    b = predictions.filter(F.col(variant) == base).select(id_col, *[F.col(n).alias(f"_b_{n}") for n in names])
    j = predictions.join(b, id_col)
    aggs = []
    for n in names:
        d = F.abs(F.col(n) - F.col(f"_b_{n}"))
        aggs += [F.max(d).alias(f"max_{n}"), F.avg(d).alias(f"mean_{n}")]
    return j.groupBy(variant).agg(*aggs)


# ---------------------------------------------------------------- Monte Carlo error of the score


def with_gradients(endpoints: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Score gradients by endpoint; a label on an endpoint counts as covered."""
    k = F.lit(2.0 / alpha)
    return endpoints.withColumn("g_lower", F.lit(-1.0) + F.when(F.col("y") < F.col("lower"), k).otherwise(F.lit(0.0))).withColumn(
        "g_upper", F.lit(1.0) - F.when(F.col("y") > F.col("upper"), k).otherwise(F.lit(0.0)))


def score_influence(endpoint_influence: DataFrame, endpoints: DataFrame, by: Sequence[str] = ("fit",), id_col: str = "entity_id", low: float = 0.05, high: float = 0.95) -> DataFrame:
    """H(chain, draw): mean over entities of g_L X_L + g_U X_U.

    ``endpoint_influence`` is long in (entity, p); the sum combines before the shuffle.
    """
    side = F.when(F.col("p") == low, F.col("g_lower")).when(F.col("p") == high, F.col("g_upper"))
    j = endpoint_influence.join(with_gradients(endpoints).select(*by, id_col, "g_lower", "g_upper"), [*by, id_col])
    g = j.filter(side.isNotNull()).groupBy(*by, "chain", "draw").agg(F.sum(side * F.col("x")).alias("_h"), F.count_if(F.col("p") == low).alias("_n"))
    return g.select(*by, "chain", "draw", (F.col("_h") / F.col("_n")).alias("h"))


def fused_score_influence(prepared: DataFrame, quantiles: DataFrame, endpoints: DataFrame, by: Sequence[str] = ("fit",), id_col: str = "entity_id", low: float = 0.05, high: float = 0.95, error: str = "normal") -> DataFrame:
    """``score_influence`` straight from the terms: the same H(chain, draw), no row per (draw, endpoint).

    Gradients ride on the endpoints' quantile rows, so influences of all entities are added up in the
    task that works them out, and only a sum per (chain, draw) is shuffled. Other quantiles than the
    two endpoints are dropped before the terms are read.
    """
    keys = [*by, id_col]
    side = F.when(F.col("p") == low, F.col("g_lower")).otherwise(F.col("g_upper"))
    roots = quantiles.filter(F.col("p").isin(low, high)).join(with_gradients(endpoints).select(*keys, "g_lower", "g_upper"), keys)
    roots = roots.withColumn("_g", -F.exp("q") * side / (F.col("mean_w") * F.col("density"))).select(*keys, "p", "q", "_g")
    j = precision.at_roots(prepared, roots, keys, error)
    g = j.groupBy(*by, "chain", "draw").agg(F.sum(F.col("_g") * F.col("w") * (F.col("cdf") - F.col("p"))).alias("_h"), F.count_if(F.col("p") == low).alias("_n"))
    return g.select(*by, "chain", "draw", (F.col("_h") / F.col("_n")).alias("h"))


def kink_flags(endpoints: DataFrame, radius: float = KINK_RADIUS) -> DataFrame:
    """Labels within ``radius`` upper MCSEs of an endpoint, per batch size; an undefined bound is flagged."""
    near = lambda end, r: F.coalesce(F.abs(F.col("y") - F.col(end)) <= F.lit(radius) * F.col(r), F.lit(True))
    return endpoints.withColumn("lower_kink", near("lower", "r_lower")).withColumn("upper_kink", near("upper", "r_upper"))


def score_mcse(influence: DataFrame, sizes: Column, tail: float, by: Sequence[str] = ("fit",)) -> DataFrame:
    """MCSE of the mean score from batch means of H with a Satterthwaite upper bound."""
    lrv = precision.batch_means(influence, by, "h", sizes)
    return precision.pool_chains(lrv, by, tail)


def endpoint_covariance(endpoint_influence: DataFrame, sizes: Column, by: Sequence[str] = ("fit",), id_col: str = "entity_id") -> DataFrame:
    """Joint Monte Carlo covariance of all endpoints from batch means, upper triangle only.

    Cells meet through (chain, batch): the result has one row per coordinate pair by definition, so
    this is the check for small cohorts; ``score_mcse`` is the path that scales.
    """
    x = endpoint_influence.withColumn("b", F.explode(sizes)).withColumn("_batch", F.floor(F.col("draw") / F.col("b")))
    cells = x.groupBy(*by, "b", "chain", "_batch", id_col, "p").agg(F.avg("x").alias("_m"), F.count(F.lit(1)).alias("_n"))
    shape = x.groupBy(*by, "b", "chain", id_col, "p").agg(F.count(F.lit(1)).alias("n_chain"))
    total = shape.groupBy(*by, "b", id_col, "p").agg(F.sum("n_chain").alias("_total"))
    full = cells.filter(F.col("_n") == F.col("b"))
    centre = full.groupBy(*by, "b", "chain", id_col, "p").agg(F.avg("_m").alias("_c"), F.count(F.lit(1)).alias("n_batches"))
    dev = full.join(centre, [*by, "b", "chain", id_col, "p"]).join(shape, [*by, "b", "chain", id_col, "p"]).join(total, [*by, "b", id_col, "p"])
    dev = dev.withColumn("_d", F.col("_m") - F.col("_c")).select(*by, "b", "chain", "_batch", id_col, "p", "_d", "n_batches", "n_chain", "_total")
    right = dev.select(*by, "b", "chain", "_batch", F.col(id_col).alias("entity_j"), F.col("p").alias("p_j"), F.col("_d").alias("_dj"))
    pairs = dev.withColumnRenamed(id_col, "entity_i").withColumnRenamed("p", "p_i").join(right, [*by, "b", "chain", "_batch"])
    pairs = pairs.filter(F.struct("p_i", "entity_i") <= F.struct("p_j", "entity_j"))
    weight = F.col("n_chain") * F.col("b") / ((F.col("n_batches") - 1) * F.col("_total") * F.col("_total"))
    return pairs.groupBy(*by, "b", "entity_i", "p_i", "entity_j", "p_j").agg(F.sum(F.col("_d") * F.col("_dj") * weight).alias("covariance"))


def project_covariance(covariance: DataFrame, endpoints: DataFrame, by: Sequence[str] = ("fit",), id_col: str = "entity_id", low: float = 0.05) -> DataFrame:
    """Quadratic form of the covariance with the score gradient: must equal the score variance."""
    g = with_gradients(endpoints)
    n = g.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    def grads(i: str) -> DataFrame:
        return g.select(*by, F.col(id_col).alias(f"entity_{i}"), F.col("g_lower").alias(f"_l{i}"), F.col("g_upper").alias(f"_u{i}"))

    j = covariance.join(grads("i"), [*by, "entity_i"]).join(grads("j"), [*by, "entity_j"]).join(n, list(by))
    gi = F.when(F.col("p_i") == low, F.col("_li")).otherwise(F.col("_ui"))
    gj = F.when(F.col("p_j") == low, F.col("_lj")).otherwise(F.col("_uj"))
    same = (F.col("entity_i") == F.col("entity_j")) & (F.col("p_i") == F.col("p_j"))
    twice = F.when(same, F.lit(1.0)).otherwise(F.lit(2.0))
    return j.groupBy(*by, "b").agg((F.sum(twice * gi * gj * F.col("covariance")) / F.max(F.col("_n") * F.col("_n"))).alias("projected_variance"))


def lipschitz_bound(endpoints: DataFrame, by: Sequence[str] = ("fit",), constant: float = LIPSCHITZ) -> DataFrame:
    """constant / N times the summed endpoint radii."""
    g = endpoints.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("r_lower") + F.col("r_upper")).alias("_r"))
    return g.select(*by, "n", (F.lit(constant) * F.col("_r") / F.col("n")).alias("bound"))


def qualification(mcse: DataFrame, kinks: DataFrame, by: Sequence[str] = ("fit",), limit: float = SCORE_MCSE_LIMIT) -> DataFrame:
    """PASS, or numerically qualified with the reasons: undefined or large upper MCSE, or a label at a kink."""
    m = mcse.groupBy(*by).agg(F.count_if(~is_finite(F.col("upper_mcse"))).alias("_undefined"), F.max("upper_mcse").alias("max_upper_mcse"))
    k = kinks.groupBy(*by).agg(F.bool_or(F.col("lower_kink") | F.col("upper_kink")).alias("_kink"))
    j = m.join(k, list(by))
    why = reasons({
        "undefined_upper_mcse": F.col("_undefined") > 0,
        "upper_mcse_above_limit": (F.col("_undefined") == 0) & (F.col("max_upper_mcse") > limit),
        "label_near_endpoint": F.col("_kink"),
    })
    j = j.withColumn("reasons", why)
    return j.select(*by, F.when(F.size("reasons") == 0, "PASS").otherwise("NUMERICALLY_QUALIFIED").alias("status"), "reasons", F.when(F.col("_undefined") == 0, F.col("max_upper_mcse")).alias("max_upper_mcse"))
