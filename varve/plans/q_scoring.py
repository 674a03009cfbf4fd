"""Queries: interval scores, paired comparison, score error propagation."""

from __future__ import annotations

from pyspark.sql import functions as F

from varve.operators import keywise, mixture, precision, scoring
from varve.operators.exact import exact_sums
from varve.operators.precision import default_batch_sizes
from varve.plans import base
from varve.plans.registry import query, rnd
from varve.plans.sqlkit import build, cte, pdf, phi, precision_ctes, upper_ctes
from varve.session import checkpointed

cte(
    "comp",
    "SELECT *, upper - lower AS width, 20 * greatest(lower - y, 0) AS below_penalty, 20 * greatest(y - upper, 0) AS above_penalty, "
    "upper - lower + 20 * greatest(lower - y, 0) + 20 * greatest(y - upper, 0) AS score, lower <= y AND y <= upper AS covered, y < lower AS below, y > upper AS above, median - y AS median_error FROM fc",
)


@query("sco1_interval_score", build("SELECT method, entity_id, round(score, 6) AS score FROM comp"))
def sco1(spark, sf):
    fc = base.forecasts(spark, sf)
    return fc.select("method", "entity_id", rnd(scoring.interval_score(F.col("y"), F.col("lower"), F.col("upper")), 6, "score"))


@query("sco2_components", build("SELECT method, entity_id, round(width, 6) AS width, round(below_penalty, 6) AS below_penalty, round(above_penalty, 6) AS above_penalty, covered, below, above, round(median_error, 6) AS median_error FROM comp"))
def sco2(spark, sf):
    c = scoring.components(base.forecasts(spark, sf))
    return c.select("method", "entity_id", rnd("width", 6), rnd("below_penalty", 6), rnd("above_penalty", 6), "covered", "below", "above", rnd("median_error", 6))


_SUMMARY_SQL = (
    "SELECT method, {status} AS primary_status, count(*) AS n, {w}round(avg(score), 6){e} AS mean_score, count(*) FILTER (WHERE covered) AS covered, {w}round(count(*) FILTER (WHERE covered) / count(*), 6){e} AS coverage, "
    "count(*) FILTER (WHERE below) AS below, count(*) FILTER (WHERE above) AS above, {w}round(avg(width), 6){e} AS mean_width, {w}round(avg(abs(median_error)), 6){e} AS median_mae, {w}round(sqrt(avg(median_error ** 2)), 6){e} AS median_rmse, "
    "{w}round(avg(median_error), 6){e} AS median_bias, count(*) FILTER (WHERE median < 0) AS negative_medians FROM comp {where} GROUP BY 1"
)
_SUMMARY_COLS = ("mean_score", "mean_width", "median_mae", "median_rmse", "median_bias")


def _summary(spark, sf, keep=None):
    fc = base.forecasts(spark, sf)
    # read three times below: by the sums, the plain aggregates and the cohort gate
    scored = checkpointed(scoring.components(fc if keep is None else fc.filter(keep)))
    s = scoring.method_summary(scored, base.ship_entities(spark, sf).filter("eligible"))
    return s.select("method", "primary_status", "n", "covered", rnd("coverage"), "below", "above", "negative_medians", *[rnd(c, 6) for c in _SUMMARY_COLS])


@query("sco3_method_summary", build(_SUMMARY_SQL.format(status="'AVAILABLE'", w="", e="", where="")))
def sco3(spark, sf):
    return _summary(spark, sf)


@query(
    "sco6_cohort_rule",
    build(_SUMMARY_SQL.format(status="CASE WHEN method = 'last30' THEN 'UNAVAILABLE' ELSE 'AVAILABLE' END", w="CASE WHEN method = 'full' THEN ", e=" END", where="WHERE method = 'full' OR role <> 'tune'")),
)
def sco6(spark, sf):
    """One method lost its tuning entities: its statistics are withheld, not taken over the rest."""
    return _summary(spark, sf, "method = 'full' OR role <> 'tune'")


cte("pairc", "SELECT a.entity_id, a.role, a.width - b.width AS width, a.below_penalty - b.below_penalty AS below_penalty, a.above_penalty - b.above_penalty AS above_penalty, a.score - b.score AS score, a.score AS first_score, b.score AS second_score "
    "FROM comp a JOIN comp b ON a.entity_id = b.entity_id AND a.method = 'last30' AND b.method = 'full'")


@query("sco4_paired_components", build("SELECT entity_id, round(width, 6) AS width, round(below_penalty, 6) AS below_penalty, round(above_penalty, 6) AS above_penalty, round(score, 6) AS score FROM pairc"))
def sco4(spark, sf):
    p = scoring.paired_components(scoring.components(base.forecasts(spark, sf)), "last30", "full")
    return p.select("entity_id", *[rnd(c, 6) for c in scoring.COMPONENTS])


@query("sco4_paired_contrast", build("SELECT count(*) AS n, " + ", ".join(f"round(avg({c}), 6) AS mean_{c}" for c in scoring.COMPONENTS) + ", round(sum(first_score) / sum(second_score), 6) AS score_ratio FROM pairc"))
def sco4b(spark, sf):
    p = scoring.paired_components(scoring.components(base.forecasts(spark, sf)), "last30", "full")
    c = scoring.paired_contrast(checkpointed(p))
    return c.select("n", *[rnd(f"mean_{k}", 6) for k in scoring.COMPONENTS], rnd("score_ratio"))


@query(
    "sco5_exact_sum",
    "SELECT l_returnflag, CAST(sum(CAST(CASE WHEN l_linenumber % 3 = 0 THEN l_extendedprice * 1e12 WHEN l_linenumber % 3 = 1 THEN l_tax ELSE -l_extendedprice * 1e12 END AS DECIMAL(38,4))) AS DOUBLE) AS total FROM lineitem GROUP BY 1",
)
def sco5(spark, sf):
    """A sum of very unequal terms, independent of the order in which they arrive."""
    big = F.col("l_extendedprice") * F.lit(1e12)
    m = F.col("l_linenumber") % 3
    v = F.when(m == 0, big).when(m == 1, F.col("l_tax")).otherwise(-big)
    return exact_sums(base.table(spark, sf, "lineitem"), ["l_returnflag"], {"total": v})


@query(
    "sco7_contrast_range",
    build("SELECT count(*) AS n_fits, round(min(d), 6) AS low, round(max(d), 6) AS high, round(max(d) - min(d), 6) AS range FROM (SELECT role, avg(score) AS d FROM pairc GROUP BY 1)"),
)
def sco7(spark, sf):
    """Contrast per role and its spread, the role standing in for the fit."""
    c = scoring.components(base.forecasts(spark, sf))
    r = scoring.contrast_range(scoring.paired_contrast(checkpointed(scoring.paired_components(c, "last30", "full", by=["role"])), ["role"]))
    return r.select("n_fits", rnd("low", 6), rnd("high", 6), rnd("range", 6))


@query(
    "sco8_prediction_sensitivity",
    build("SELECT v.method, " + ", ".join(f"round(max(abs(v.{c} - b.{c})), 6) AS max_{c}, round(avg(abs(v.{c} - b.{c})), 6) AS mean_{c}" for c in ("lower", "median", "upper")) + " FROM fc v JOIN fc b ON b.entity_id = v.entity_id AND b.method = 'full' GROUP BY 1"),
)
def sco8(spark, sf):
    s = scoring.prediction_sensitivity(base.forecasts(spark, sf), "full")
    return s.select("method", *[rnd(f"{k}_{c}", 6) for c in ("lower", "median", "upper") for k in ("max", "mean")])


# ---------------------------------------------------------------- score error from draws

_S = {"z": "z", "1": "1.0::DOUBLE", "s": "((cycle - cutoff) / 30.0::DOUBLE)"}
_P = {"z": "pz", "1": "CASE WHEN pz IS NULL THEN NULL ELSE 1.0::DOUBLE END", "s": "((cycle - 1 - cutoff) / 30.0::DOUBLE)"}
cte("lagged", "SELECT *, lag(z) OVER (PARTITION BY entity_id ORDER BY cycle) AS pz FROM scored")
_sum_cols = []
for _p in mixture.PAIRS:
    _x, _y, _px, _py = _S[_p[0]], _S[_p[1]], _P[_p[0]], _P[_p[1]]
    _sum_cols += [
        f"sum(CASE WHEN pz IS NULL THEN {_x} * {_y} ELSE 0 END) AS p{_p}_first", f"sum(CASE WHEN pz IS NOT NULL THEN {_x} * {_y} ELSE 0 END) AS p{_p}_tail",
        f"sum(CASE WHEN pz IS NOT NULL THEN {_x} * {_py} + {_px} * {_y} ELSE 0 END) AS p{_p}_cross", f"sum(CASE WHEN cycle < cutoff THEN {_x} * {_y} ELSE 0 END) AS p{_p}_head",
    ]
cte("seq_sums", "SELECT entity_id, cutoff, lifetime, count(*) AS w, ln(cutoff / 100.0::DOUBLE) AS log_age, " + ", ".join(_sum_cols) + " FROM lagged GROUP BY 1, 2, 3")
cte("term0", "SELECT s.*, d.* FROM seq_sums s JOIN supplier p ON p.s_suppkey = s.entity_id JOIN draws d ON d.fit = p.s_nationkey")
_stages = mixture.term_stages()
for _k, _stage in enumerate(_stages[:-1]):
    cte(f"term{_k + 1}", "SELECT *, " + ", ".join(f"{t} AS {n}" for n, t in _stage) + f" FROM term{_k}")
cte("pterms", "SELECT entity_id, fit, chain, draw, lifetime - cutoff AS y, sigma_r, " + ", ".join(f"{t} AS {n}" for n, t in _stages[-1]) + f" FROM term{len(_stages) - 1}")


def quantile_ctes(name: str, terms: str, keys: str, error: str = "normal") -> None:
    """Weights, bisection and the resulting quantile table over ``terms``, as SQL."""
    k = keys.replace(" ", "").split(",")
    using = ", ".join(k)
    cte(f"{name}_w", f"SELECT *, sqrt(var) AS sd, exp(log_w - max(log_w) OVER (PARTITION BY {using})) AS w FROM {terms}")
    cte(f"{name}_s", f"SELECT {using}, count(*) AS n_total, sum(w) AS sum_w, sum(w) / count(*) AS mean_w, least(sum(w) ** 2 / sum(w * w), count(*)) AS weight_ess, max(w) / sum(w) AS max_weight, "
        f"min(mu) - 20 * max(sd) - (max(mu) - min(mu)) AS lo, max(mu) + 20 * max(sd) + (max(mu) - min(mu)) AS hi FROM {name}_w GROUP BY {using}")
    sel = ", ".join(f"b.{c}" for c in k)
    on = " AND ".join(f"t.{c} = b.{c}" for c in k)
    cdf = phi("v") if error == "normal" else f"(0.95::DOUBLE * {phi('v')} + 0.05::DOUBLE * {phi('v2')})"
    wide = "" if error == "normal" else ", (0.5 * (b.lo + b.hi) - t.mu) / sqrt(t.var + 8 * t.sigma_r * t.sigma_r) AS v2"
    cte(
        f"{name}_b",
        f"SELECT 0 AS step, {using}, p, lo, hi FROM {name}_s, (VALUES (0.05::DOUBLE), (0.5::DOUBLE), (0.95::DOUBLE)) g(p) UNION ALL "
        f"SELECT step + 1, {using}, p, CASE WHEN sum(w * {cdf}) / sum(w) < p THEN 0.5 * (lo + hi) ELSE lo END, CASE WHEN sum(w * {cdf}) / sum(w) < p THEN hi ELSE 0.5 * (lo + hi) END "
        f"FROM (SELECT b.step, {sel}, b.p, b.lo, b.hi, t.w, (0.5 * (b.lo + b.hi) - t.mu) / t.sd AS v{wide} FROM {name}_b b JOIN {name}_w t ON {on} WHERE b.step < 58) GROUP BY step, {using}, p, lo, hi",
        recursive=True,
    )
    cte(f"{name}_r", f"SELECT {using}, p, 0.5 * (lo + hi) AS q FROM {name}_b WHERE step = 58")
    wide_at = "" if error == "normal" else ", (b.q - t.mu) / sqrt(t.var + 8 * t.sigma_r * t.sigma_r) AS v2, sqrt(t.var + 8 * t.sigma_r * t.sigma_r) AS sd2"
    cte(f"{name}_e", f"SELECT {sel}, b.p, b.q, t.chain, t.draw, t.w, t.sd, (b.q - t.mu) / t.sd AS v{wide_at} FROM {name}_r b JOIN {name}_w t ON {on}")
    dens = f"{pdf('v')} / sd" if error == "normal" else f"(0.95::DOUBLE * {pdf('v')} / sd + 0.05::DOUBLE * {pdf('v2')} / sd2)"
    cte(f"{name}_f", f"SELECT {using}, p, q, chain, draw, w, {cdf} AS cdf, {dens} AS dens FROM {name}_e")
    cte(f"{name}_q", f"SELECT {', '.join('f.' + c for c in k)}, p, q, exp(q) AS quantile, sum(f.w * cdf) / sum(f.w) AS cdf, sum(f.w * dens) / sum(f.w) AS density, any_value(s.mean_w) AS mean_w, any_value(s.weight_ess) AS weight_ess, any_value(s.max_weight) AS max_weight, any_value(s.n_total) AS n_total "
        f"FROM {name}_f f JOIN {name}_s s USING ({using}) GROUP BY {', '.join('f.' + c for c in k)}, p, q")


quantile_ctes("pt", "pterms", "fit, entity_id")
cte("pt_x", "SELECT f.fit, f.entity_id, f.p, f.chain, f.draw, -exp(f.q) * f.w * (f.cdf - f.p) / (q.mean_w * q.density) AS x FROM pt_f f JOIN pt_q q ON q.fit = f.fit AND q.entity_id = f.entity_id AND q.p = f.p")
cte("pt_ends", "SELECT q.fit, q.entity_id, y.y, max(CASE WHEN p = 0.05 THEN quantile END) AS lower, max(CASE WHEN p = 0.95 THEN quantile END) AS upper FROM pt_q q JOIN (SELECT DISTINCT entity_id, y FROM pterms) y ON y.entity_id = q.entity_id GROUP BY 1, 2, 3")
cte("pt_g", "SELECT *, CASE WHEN y < lower THEN 19 ELSE -1 END AS g_lower, CASE WHEN y > upper THEN -19 ELSE 1 END AS g_upper FROM pt_ends")
cte("pt_h", "SELECT x.fit, x.chain, x.draw, sum(CASE WHEN p = 0.05 THEN g_lower * x WHEN p = 0.95 THEN g_upper * x END) / count(*) FILTER (WHERE p = 0.05) AS h FROM pt_x x JOIN pt_g g ON g.fit = x.fit AND g.entity_id = x.entity_id WHERE p <> 0.5 GROUP BY 1, 2, 3")
cte("pt_n", "SELECT fit, min(c) AS shortest FROM (SELECT fit, chain, count(*) AS c FROM draws GROUP BY 1, 2) GROUP BY 1")
cte("pt_sizes", "SELECT fit, least(greatest(greatest(1, floor(shortest ** (1.0 / 3.0))) + 1, floor(sqrt(shortest))), floor(shortest / 2))::BIGINT AS b2, greatest(1, floor(shortest ** (1.0 / 3.0)))::BIGINT AS b1 FROM pt_n WHERE shortest >= 4")
cte("pt_bsize", "SELECT fit, unnest([least(b1, b2 - 1), b2]) AS b FROM pt_sizes")
cte("pt_batch", "SELECT h.fit, b.b, h.chain, h.draw // b.b AS batch, avg(h) AS m, count(*) AS n FROM pt_h h JOIN pt_bsize b ON b.fit = h.fit GROUP BY 1, 2, 3, 4")
cte("pt_lrv", "SELECT fit, b, chain, sum(n)::BIGINT AS n_chain, count(*) FILTER (WHERE n = b) AS n_batches, b * var_samp(m) FILTER (WHERE n = b) AS lrv FROM pt_batch GROUP BY 1, 2, 3")
cte("pt_part", "SELECT *, n_chain * lrv / (sum(n_chain) OVER (PARTITION BY fit, b)) ** 2 AS part FROM pt_lrv")

# upper MCSEs: of every endpoint, and of the mean score of each fit
cte("pt_hh", "SELECT fit, entity_id, p, chain, draw, w * (cdf - p) AS h FROM pt_f")
precision_ctes("ptp", "fit, entity_id", "pt_hh", "pt_q")
upper_ctes("ptp", "fit, entity_id")
cte("pt_radii", "SELECT fit, entity_id, batch_size, max(CASE WHEN p = 0.05 THEN upper_mcse END) AS r_lower, max(CASE WHEN p = 0.95 THEN upper_mcse END) AS r_upper FROM ptp_up GROUP BY 1, 2, 3")
cte("pt_kink", "SELECT e.fit, e.entity_id, r.batch_size, coalesce(abs(y - lower) <= 3 * r_lower, TRUE) AS lower_kink, coalesce(abs(y - upper) <= 3 * r_upper, TRUE) AS upper_kink FROM pt_ends e JOIN pt_radii r ON r.fit = e.fit AND r.entity_id = e.entity_id")
cte("ptm_rec", "SELECT fit, 0 AS p, b AS batch_size, sqrt(sum(part)) AS mcse, sum(part) ** 2 / nullif(sum(CASE WHEN part > 0 THEN part ** 2 / (n_batches - 1) END), 0) AS dof FROM pt_part GROUP BY 1, 2, 3")
upper_ctes("ptm", "fit")


def entity_sums(spark, sf):
    """One row per supplier with its nation as the fit, written once."""
    _, scored = base.landmarks(spark, sf)
    return checkpointed(mixture.sequence_sums(scored).join(base.supplier_fits(spark, sf), "entity_id"))


def labels(spark, sf):
    return base.ship_entities(spark, sf).select("entity_id", (F.col("lifetime") - F.col("cutoff")).cast("double").alias("y"))


def endpoint_results(spark, sf):
    """(endpoint quantiles, their batch series, endpoints with labels): pairs of draws and suppliers stay inside
    tasks, or are written where a nation has too many draws for a task."""
    keys, sums, draws = ["fit", "entity_id"], entity_sums(spark, sf), checkpointed(base.draws(spark, sf))
    if keywise.fits_bounded(draws):
        found = checkpointed(keywise.paired_results(sums, draws, mixture.TERM_STEPS, ENDPOINTS))
        q, series = keywise.quantile_table(found, keys), keywise.series_table(found, keys)
    else:
        prepared = mixture.prepare(mixture.sensor_terms(sums, draws), keys)
        q = checkpointed(mixture.mixture_quantiles(prepared, keys, ENDPOINTS))
        series = precision.batch_means(precision.influence(prepared, q, keys, precision.chain_sizes(draws, ["fit"])), [*keys, "p"], "h", F.col("sizes"))
    return q, series, _ends(q, labels(spark, sf))


def _ends(q, labelled):
    end = lambda p, name: F.max(F.when(F.col("p") == p, F.col("quantile"))).alias(name)
    return q.groupBy("fit", "entity_id").agg(end(ENDPOINTS[0], "lower"), end(ENDPOINTS[1], "upper")).join(labelled, "entity_id")


def score_and_endpoints(spark, sf):
    """What ``score_series`` and ``endpoint_results`` give: (H, sizes, (q, series, ends)); from one search where a task
    may hold the draws of a fit and every fit has batch sizes."""
    keys, sums, draws = ["fit", "entity_id"], entity_sums(spark, sf), checkpointed(base.draws(spark, sf))
    sizes = checkpointed(precision.chain_sizes(draws, ["fit"]))
    if not keywise.fits_bounded(draws) or sizes.filter("sizes is null").head(1):
        return *score_series(spark, sf), endpoint_results(spark, sf)
    sums = checkpointed(sums.join(labels(spark, sf), "entity_id"))
    found = checkpointed(keywise.paired_score(sums, draws, mixture.TERM_STEPS, scoring.ALPHA))
    results = found.filter("_h is null")
    q = keywise.quantile_table(results, keys)
    return keywise.mean_influence(found.filter("_h is not null")), sizes, (q, keywise.series_table(results, keys), _ends(q, sums.select("entity_id", "y")))


def score_inputs(sums, draws):
    """(quantiles, influences by row, batch sizes) by repeated passes, for fits with too many draws for a task."""
    keys = ["fit", "entity_id"]
    prepared = mixture.prepare(mixture.sensor_terms(sums, draws), keys)
    q = mixture.mixture_quantiles(prepared, keys)
    sizes = precision.chain_sizes(draws, ["fit"])
    return q, checkpointed(precision.influence(prepared, q, keys, sizes)), sizes


def score_series(spark, sf):
    """H(chain, draw) of every fit from the two endpoint quantiles only, and the batch sizes."""
    keys, sums, draws = ["fit", "entity_id"], entity_sums(spark, sf), checkpointed(base.draws(spark, sf))
    sizes = precision.chain_sizes(draws, ["fit"])
    if keywise.fits_bounded(draws):
        return keywise.paired_score_influence(sums.join(labels(spark, sf), "entity_id"), draws, mixture.TERM_STEPS, scoring.ALPHA), sizes
    prepared = mixture.prepare(mixture.sensor_terms(sums, draws), keys)
    q = checkpointed(mixture.mixture_quantiles(prepared, keys, ENDPOINTS))
    end = lambda p, name: F.max(F.when(F.col("p") == p, F.col("quantile"))).alias(name)
    ends = q.groupBy(*keys).agg(end(ENDPOINTS[0], "lower"), end(ENDPOINTS[1], "upper")).join(labels(spark, sf), "entity_id")
    return scoring.fused_score_influence(prepared, q, ends), sizes


ENDPOINTS = (0.05, 0.95)


@query("prd1_sensor_terms", build("SELECT entity_id, fit, chain, draw, round(mu, 6) AS mu, round(var, 6) AS var, round(log_w, 6) AS log_w FROM pterms"))
def prd1(spark, sf):
    sums, draws = entity_sums(spark, sf), checkpointed(base.draws(spark, sf))
    if keywise.fits_bounded(draws):
        return keywise.paired_terms(sums, draws, mixture.TERM_STEPS, 6)
    return mixture.sensor_terms(sums, draws).select("entity_id", "fit", "chain", "draw", rnd("mu"), rnd("var"), rnd("log_w"))


@query("sco9_endpoint_influence", build("SELECT fit, entity_id, p, chain, draw, round(x, 4) AS x FROM pt_x"))
def sco9(spark, sf):
    sums, draws = entity_sums(spark, sf), checkpointed(base.draws(spark, sf))
    if keywise.fits_bounded(draws):
        return keywise.paired_influence(sums, draws, mixture.TERM_STEPS, mixture.PROBS, 4)
    _, x, _ = score_inputs(sums, draws)
    return x.select("fit", "entity_id", "p", "chain", "draw", rnd("x", 4))


@query("sco10_score_influence", build("SELECT fit, chain, draw, round(h, 3) AS h FROM pt_h"))
def sco10(spark, sf):
    h, _ = score_series(spark, sf)
    return h.select("fit", "chain", "draw", rnd("h", 3))


def _sized(x, sizes):
    return x.join(F.broadcast(sizes.select("fit", "sizes")), "fit")


def _radii(q, series):
    """Upper MCSE of both endpoints per entity and batch size."""
    keys = ["fit", "entity_id"]
    rec = precision.mcse_of_series(series, q, keys, TAIL)
    pick = lambda p, n: F.max(F.when(F.col("p") == p, F.col("upper_mcse"))).alias(n)
    return rec.groupBy(*keys, "batch_size").agg(pick(0.05, "r_lower"), pick(0.95, "r_upper"))


TAIL = 0.025


def _flagged(q, series, ends):
    return scoring.kink_flags(ends.join(_radii(q, series), ["fit", "entity_id"]))


@query("sco11_kink_flags", build("SELECT fit, entity_id, batch_size, lower_kink, upper_kink FROM pt_kink"))
def sco11(spark, sf):
    return _flagged(*endpoint_results(spark, sf)).select("fit", "entity_id", "batch_size", "lower_kink", "upper_kink")


@query(
    "sco12_score_mcse",
    build("SELECT fit, b, count(*) AS chains, round(sum(part), 3) AS variance, round(sqrt(sum(part)), 4) AS mcse, round(sum(part) ** 2 / sum(CASE WHEN part > 0 THEN part ** 2 / (n_batches - 1) END), 4) AS dof FROM pt_part GROUP BY 1, 2"),
)
def sco12(spark, sf):
    h, sizes = score_series(spark, sf)
    m = scoring.score_mcse(_sized(h, sizes), F.col("sizes"), TAIL)
    return m.select("fit", "b", "chains", rnd("variance", 3), rnd("mcse", 4), rnd("dof", 4))


@query("sco13_covariance_projection", build("SELECT fit, b, round(sum(part), 3) AS projected_variance FROM pt_part GROUP BY 1, 2"))
def sco13(spark, sf):
    """Joint endpoint covariance of each nation's suppliers projected on the score gradient."""
    sums, draws, labelled = entity_sums(spark, sf), checkpointed(base.draws(spark, sf)), labels(spark, sf)
    if keywise.fits_bounded(draws):
        sums = checkpointed(sums.join(labelled, "entity_id"))
        found = keywise.paired_projection(sums, draws, mixture.TERM_STEPS, scoring.ALPHA)
        return found.select("fit", "b", rnd("projected_variance", 3))
    q, x, sizes = score_inputs(sums, draws)
    ends = mixture.endpoints(q, ["fit", "entity_id"]).join(labelled, "entity_id")
    cov = scoring.endpoint_covariance(x.filter("p <> 0.5"), F.col("sizes"))
    return scoring.project_covariance(cov, ends).select("fit", "b", rnd("projected_variance", 3))


@query("sco14_lipschitz_bound", build("SELECT r.fit, r.batch_size, count(*) AS n, round(19 * sum(r_lower + r_upper) / count(*), 4) AS bound FROM pt_ends e JOIN pt_radii r ON r.fit = e.fit AND r.entity_id = e.entity_id GROUP BY 1, 2"))
def sco14(spark, sf):
    q, series, ends = endpoint_results(spark, sf)
    r = ends.join(_radii(q, series), ["fit", "entity_id"])
    return scoring.lipschitz_bound(r, ["fit", "batch_size"]).select("fit", "batch_size", "n", rnd("bound", 4))


@query(
    "sco15_qualification",
    build("SELECT fit, CASE WHEN undefined OR above OR kink THEN 'NUMERICALLY_QUALIFIED' ELSE 'PASS' END AS status, "
          "concat_ws(',', CASE WHEN undefined THEN 'undefined_upper_mcse' END, CASE WHEN above THEN 'upper_mcse_above_limit' END, CASE WHEN kink THEN 'label_near_endpoint' END) AS reasons, CASE WHEN NOT undefined THEN round(top, 4) END AS max_upper_mcse "
          "FROM (SELECT fit, bool_or(upper_mcse IS NULL) AS undefined, NOT bool_or(upper_mcse IS NULL) AND max(upper_mcse) > 0.5 AS above, max(upper_mcse) AS top FROM ptm_up GROUP BY 1) JOIN (SELECT fit, bool_or(lower_kink OR upper_kink) AS kink FROM pt_kink GROUP BY 1) USING (fit)"),
)
def sco15(spark, sf):
    h, sizes, found = score_and_endpoints(spark, sf)
    out = scoring.qualification(scoring.score_mcse(_sized(h, sizes), F.col("sizes"), TAIL), _flagged(*found))
    return out.select("fit", "status", F.concat_ws(",", "reasons").alias("reasons"), rnd("max_upper_mcse", 4))
