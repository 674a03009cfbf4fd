"""Queries: candidate selection, conformal calibration, quantile learners."""

from __future__ import annotations

from pyspark.sql import functions as F

from varve.operators import assign, conformal, features, quantreg, replicates
from varve.operators.quality import identical_tables
from varve.plans import base
from varve.plans.base import SEED
from varve.plans.registry import query, rnd
from varve.plans.sqlkit import build, cte, digest_mod
from varve.session import checkpointed

# Twelve prefix forecasts stand in for the fitted candidates: window x quantile level, in grid order.
WINDOWS, LEVELS = (15, 30, 60, 100000), (0.02, 0.05, 0.1)
_IDS = [r["candidate_id"] for r in conformal.grid_rows()]
_SETTINGS = [(cid, w, p) for cid, (w, p) in zip(_IDS, [(w, p) for w in WINDOWS for p in LEVELS], strict=True)]


def candidate_forecasts(spark, sf):
    """Tuning-role forecasts of all twelve settings; a prefix is bounded, so are the percentiles."""
    rows = base.ship_prefix(spark, sf, extra=1).filter("role = 'tune'")
    seen = F.col("cycle") <= F.col("cutoff")
    per = rows.groupBy("entity_id").agg(
        F.max(F.when(~seen, F.col("c2"))).alias("y"),
        *[F.percentile(F.when(seen & (F.col("cycle") > F.col("cutoff") - w), F.col("c2")), F.array(*[F.lit(v) for p in LEVELS for v in (p, 1 - p)])).alias(f"w{w}") for w in WINDOWS],
    )
    cells = [
        F.struct(F.lit(cid).alias("candidate_id"), F.col(f"w{w}")[2 * LEVELS.index(p)].alias("lower"), F.col(f"w{w}")[2 * LEVELS.index(p) + 1].alias("upper"))
        for cid, w, p in _SETTINGS
    ]
    return per.select("entity_id", "y", F.inline(F.array(*cells)))


cte("cand_rows", "SELECT t.*, e.cutoff FROM s_traj t JOIN s_ent e USING (entity_id) WHERE e.role = 'tune' AND cycle <= cutoff + 1")
cte("cand_y", "SELECT entity_id, max(CASE WHEN cycle = cutoff + 1 THEN c2 END) AS y FROM cand_rows GROUP BY 1")
cte("cand", " UNION ALL ".join(
    f"SELECT '{cid}' AS candidate_id, entity_id, quantile_cont(c2, {p!r}) AS lower, quantile_cont(c2, {1 - p!r}) AS upper FROM cand_rows WHERE cycle <= cutoff AND cycle > cutoff - {w} GROUP BY 2"
    for cid, w, p in _SETTINGS))
cte("cand_score", "SELECT candidate_id, avg(upper - lower + 20 * greatest(lower - y, 0) + 20 * greatest(y - upper, 0)) AS mean_score, count(*) AS n_rows FROM cand JOIN cand_y USING (entity_id) GROUP BY 1")


@query("cqr1_candidate_grid", build(
    "SELECT candidate_id, depth::INT AS depth, leaf::INT AS leaf, rate::DOUBLE AS rate, alpha::DOUBLE AS alpha, mean_score IS NOT NULL AS scored FROM (VALUES "
    + ", ".join("('{}', {}, {}, {}, {})".format(r["candidate_id"], *("NULL" if r[k] is None else r[k] for k in ("depth", "leaf", "rate", "alpha"))) for r in conformal.grid_rows())
    + ") g(candidate_id, depth, leaf, rate, alpha) LEFT JOIN cand_score USING (candidate_id)"))
def cqr1(spark, sf):
    """The grid joined to the candidates' tuning scores."""
    s = conformal.candidate_scores(candidate_forecasts(spark, sf), conformal.candidate_grid(spark))
    return s.select("candidate_id", "depth", "leaf", "rate", "alpha", F.col("mean_score").isNotNull().alias("scored"))


@query("cqr4_ordered_endpoints", "SELECT l_orderkey, l_linenumber, round(min(least(l_quantity, l_extendedprice / 1000)), 6) AS lower, round(max(greatest(l_quantity, l_extendedprice / 1000)), 6) AS upper FROM lineitem GROUP BY 1, 2")
def cqr4(spark, sf):
    rows = base.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("lower"), (F.col("l_extendedprice") / 1000).alias("upper"))
    return conformal.ordered_endpoints(rows).groupBy("l_orderkey", "l_linenumber").agg(rnd(F.min("lower"), 6, "lower"), rnd(F.max("upper"), 6, "upper"))


@query("cqr6_candidate_scores", build("SELECT candidate_id, round(mean_score, 6) AS mean_score, n_rows FROM cand_score"))
def cqr6(spark, sf):
    s = conformal.candidate_scores(candidate_forecasts(spark, sf), conformal.candidate_grid(spark))
    return s.select("candidate_id", rnd("mean_score"), "n_rows")


_BAND = 3000.0


_ORDER = sorted(conformal.grid_rows(), key=lambda r: (r["family"] != "linear", -(r["alpha"] or 0), r["depth"] or 0, -(r["leaf"] or 0), r["rate"] or 0))
cte("cand_order", "SELECT * FROM (VALUES " + ", ".join(f"('{r['candidate_id']}', {i})" for i, r in enumerate(_ORDER)) + ") o(candidate_id, k)")


def _selected(band: float) -> str:
    """The simplest candidate within ``band`` of the best score, as SQL."""
    return ("SELECT candidate_id, best, mean_score, n_tied FROM (SELECT *, count(*) OVER () AS n_tied, row_number() OVER (ORDER BY candidate_id NOT LIKE 'linear%', k) AS r FROM "
            f"(SELECT *, min(mean_score) OVER () AS best FROM cand_score JOIN cand_order USING (candidate_id)) WHERE mean_score <= best + {band!r}) WHERE r = 1")


@query("cqr7_select_candidate", build(f"SELECT candidate_id, round(best, 6) AS best_score, round(mean_score, 6) AS selected_score, n_tied FROM ({_selected(_BAND)})"))
def cqr7(spark, sf):
    """Selection with a tie band of 3000, a fitting width for prices."""
    s = conformal.candidate_scores(candidate_forecasts(spark, sf), conformal.candidate_grid(spark))
    return conformal.select_candidate(s, tie_band=_BAND).select("candidate_id", rnd("best_score"), rnd("selected_score"), "n_tied")


def _scores(spark, sf, roles=("calibration",)):
    fc = base.forecasts(spark, sf).filter(F.col("role").isin(*roles))
    return fc.select("method", "entity_id", conformal.nonconformity(F.col("y"), F.col("lower"), F.col("upper")).alias("score"))


cte("ncs", "SELECT method, entity_id, greatest(lower - y, y - upper) AS score FROM fc WHERE role = 'calibration'")
cte("nck", "SELECT *, row_number() OVER (PARTITION BY method ORDER BY score) AS i, count(*) OVER (PARTITION BY method) AS n FROM ncs")


@query("cqr8_conformal_rank", "SELECT l_suppkey, count(*) AS n, ceil((count(*) + 1)::DECIMAL(20,0) * 0.9)::BIGINT AS rank FROM lineitem GROUP BY 1")
def cqr8(spark, sf):
    """Rank for the row count of every supplier."""
    g = base.table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    return g.select("l_suppkey", "n", conformal.conformal_rank(F.col("n")).alias("rank"))


cte("ncc", "SELECT method, n, ceil((n + 1)::DECIMAL(20,0) * 0.9)::BIGINT AS rank, max(CASE WHEN i = ceil((n + 1)::DECIMAL(20,0) * 0.9) THEN score END) AS raw FROM nck GROUP BY 1, 2")
cte("ncq", "SELECT *, CASE WHEN rank > n THEN 'infinity'::DOUBLE ELSE greatest(0, raw) END AS correction FROM ncc")


@query("cqr9_corrections", build("SELECT method, n, rank, round(raw, 6) AS raw, round(correction, 6) AS correction FROM ncq"))
def cqr9(spark, sf):
    return conformal.corrections(_scores(spark, sf), ["method"]).select("method", "n", "rank", rnd("raw"), rnd("correction"))


@query(
    "cqr10_apply_correction",
    build("SELECT f.method, f.entity_id, f.role, round(greatest(0, f.lower - q.correction), 6) AS lower, round(greatest(0, f.upper + q.correction), 6) AS upper FROM fc f JOIN ncq q USING (method) WHERE f.role <> 'calibration'"),
)
def cqr10(spark, sf):
    fc = checkpointed(base.forecasts(spark, sf))
    score = conformal.nonconformity(F.col("y"), F.col("lower"), F.col("upper")).alias("score")
    q = conformal.corrections(fc.filter("role = 'calibration'").select("method", "entity_id", score), ["method"])
    return conformal.apply_correction(fc.filter("role <> 'calibration'"), q).select("method", "entity_id", "role", rnd("lower"), rnd("upper"))


def leave_one_out_scores(scores):
    """Scores to six decimals: prices interpolated in different ways differ in their last bits, which makes no distinct score."""
    return scores.withColumn("score", F.round("score", 6))


cte("loo", "SELECT a.method, a.entity_id, a.score, b.score AS other, row_number() OVER (PARTITION BY a.method, a.entity_id ORDER BY b.score) AS i, count(*) OVER (PARTITION BY a.method, a.entity_id) AS n FROM ncs a JOIN ncs b ON a.method = b.method AND a.entity_id <> b.entity_id")


@query(
    "cqr11_leave_one_out",
    build("SELECT method, round(score, 6) AS score, count(*) AS multiplicity, round(max(c), 6) AS correction FROM (SELECT method, entity_id, score, CASE WHEN ceil((n + 1)::DECIMAL(20,0) * 0.9) > n THEN 'infinity'::DOUBLE ELSE greatest(0, max(CASE WHEN i = ceil((n + 1)::DECIMAL(20,0) * 0.9) THEN other END)) END AS c FROM loo GROUP BY method, entity_id, score, n) GROUP BY 1, 2"),
)
def cqr11(spark, sf):
    out = conformal.leave_one_out(leave_one_out_scores(_scores(spark, sf)), ["method"])
    return out.select("method", rnd("score"), "multiplicity", rnd("correction"))


SUBSETS, SUBSET_REPS = (9, 19, 24, 25), 100
cte("sub_h", f"SELECT r.replicate, n.entity_id, n.score, row_number() OVER (PARTITION BY r.replicate ORDER BY sha256('{SEED}|subset|' || r.replicate || '|' || n.entity_id), n.entity_id) AS o FROM ncs n, range(1, {SUBSET_REPS + 1}) r(replicate) WHERE n.method = 'full'")
cte("sub_r", "SELECT s.size, h.replicate, h.score, row_number() OVER (PARTITION BY s.size, h.replicate ORDER BY h.score) AS i, count(*) OVER (PARTITION BY s.size, h.replicate) AS n FROM sub_h h JOIN (VALUES (9), (19), (24), (25)) s(size) ON h.o <= s.size")
cte("sub_c", "SELECT size, replicate, CASE WHEN ceil((n + 1)::DECIMAL(20,0) * 0.9) > n THEN 'infinity'::DOUBLE ELSE greatest(0, max(CASE WHEN i = ceil((n + 1)::DECIMAL(20,0) * 0.9) THEN score END)) END AS c FROM sub_r GROUP BY size, replicate, n")


@query(
    "cqr12_subset_corrections",
    build("SELECT size, count(*) AS replicates, round(quantile_cont(c, 0.025), 4) AS low, round(quantile_cont(c, 0.5), 4) AS mid, round(quantile_cont(c, 0.975), 4) AS high FROM sub_c GROUP BY 1"),
)
def cqr12(spark, sf):
    scores = checkpointed(_scores(spark, sf).filter("method = 'full'"))
    reps = conformal.subset_corrections(scores, SUBSETS, SUBSET_REPS, SEED)
    r = conformal.correction_ranges(reps)
    return r.select("size", "replicates", rnd("low", 4), rnd("mid", 4), rnd("high", 4))


BOOT_REPS = 50
cte("cb_pool", "SELECT entity_id, score, row_number() OVER (ORDER BY entity_id) AS slot, count(*) OVER () AS n_role FROM ncs WHERE method = 'full'")
cte("cb_draw", f"SELECT d.replicate, p.score FROM (SELECT replicate, 1 + {digest_mod('h', 'n_role')} AS pick FROM (SELECT g.replicate, n_role, sha256('{SEED}|' || g.replicate || '|calibration|' || slot) AS h FROM cb_pool, range(1, {BOOT_REPS + 1}) g(replicate))) d JOIN cb_pool p ON p.slot = d.pick")
cte("cb_rank", "SELECT *, row_number() OVER (PARTITION BY replicate ORDER BY score) AS i, count(*) OVER (PARTITION BY replicate) AS n FROM cb_draw")


@query(
    "cqr12_bootstrap_corrections",
    build("SELECT replicate, n, round(greatest(0, max(CASE WHEN i = ceil((n + 1)::DECIMAL(20,0) * 0.9) THEN score END)), 6) AS correction FROM cb_rank GROUP BY 1, 2"),
)
def cqr12b(spark, sf):
    scores = checkpointed(_scores(spark, sf).filter("method = 'full'").withColumn("role", F.lit("calibration")))
    out = conformal.bootstrap_corrections(scores, assign.role_rosters(scores), BOOT_REPS, SEED)
    return out.select("replicate", "n", rnd("correction"))


# The replicate counts of the reference, over both methods.
ALL_SUBSET_REPS, ALL_BOOT_REPS = 500, 2000
cte("suba_h", f"SELECT n.method, r.replicate, n.score, row_number() OVER (PARTITION BY n.method, r.replicate ORDER BY sha256('{SEED}|subset|' || r.replicate || '|' || n.entity_id), n.entity_id) AS o FROM ncs n, range(1, {ALL_SUBSET_REPS + 1}) r(replicate)")
cte("suba_r", "SELECT h.method, s.size, h.replicate, h.score, row_number() OVER (PARTITION BY h.method, s.size, h.replicate ORDER BY h.score) AS i, count(*) OVER (PARTITION BY h.method, s.size, h.replicate) AS n FROM suba_h h JOIN (VALUES (9), (19), (24), (25)) s(size) ON h.o <= s.size")
cte("suba_c", "SELECT method, size, replicate, CASE WHEN ceil((n + 1)::DECIMAL(20,0) * 0.9) > n THEN 'infinity'::DOUBLE ELSE greatest(0, max(CASE WHEN i = ceil((n + 1)::DECIMAL(20,0) * 0.9) THEN score END)) END AS c FROM suba_r GROUP BY method, size, replicate, n")


@query(
    "cqr12_subset_corrections_all",
    build("SELECT method, size, count(*) AS replicates, round(quantile_cont(c, 0.025), 4) AS low, round(quantile_cont(c, 0.5), 4) AS mid, round(quantile_cont(c, 0.975), 4) AS high FROM suba_c GROUP BY 1, 2"),
)
def cqr12c(spark, sf):
    reps = conformal.subset_corrections(checkpointed(_scores(spark, sf)), SUBSETS, ALL_SUBSET_REPS, SEED, by=["method"])
    r = conformal.correction_ranges(reps, ["method", "size"])
    return r.select("method", "size", "replicates", rnd("low", 4), rnd("mid", 4), rnd("high", 4))


cte("cba_pool", "SELECT entity_id, row_number() OVER (ORDER BY entity_id) AS slot, count(*) OVER () AS n_role FROM (SELECT DISTINCT entity_id FROM ncs)")
cte("cba_draw", f"SELECT d.replicate, n.method, n.score FROM (SELECT replicate, 1 + {digest_mod('h', 'n_role')} AS pick FROM (SELECT g.replicate, n_role, sha256('{SEED}|' || g.replicate || '|calibration|' || slot) AS h FROM cba_pool, range(1, {ALL_BOOT_REPS + 1}) g(replicate))) d JOIN cba_pool p ON p.slot = d.pick JOIN ncs n USING (entity_id)")
cte("cba_rank", "SELECT *, row_number() OVER (PARTITION BY method, replicate ORDER BY score) AS i, count(*) OVER (PARTITION BY method, replicate) AS n FROM cba_draw")


@query(
    "cqr12_bootstrap_corrections_all",
    build("SELECT method, replicate, n, round(CASE WHEN ceil((n + 1)::DECIMAL(20,0) * 0.9) > n THEN 'infinity'::DOUBLE ELSE greatest(0, max(CASE WHEN i = ceil((n + 1)::DECIMAL(20,0) * 0.9) THEN score END)) END, 6) AS correction FROM cba_rank GROUP BY 1, 2, 3"),
)
def cqr12d(spark, sf):
    scores = checkpointed(_scores(spark, sf))
    rosters = assign.role_rosters(scores.select("entity_id", F.lit("calibration").alias("role")).distinct())
    out = conformal.bootstrap_corrections(scores, rosters, ALL_BOOT_REPS, SEED, by=["method"])
    return out.select("method", "replicate", "n", rnd("correction"))


@query(
    "cqr14_posthoc_identity",
    build("SELECT 2 * count(*) FILTER (WHERE role = 'calibration') AS identical, 0::BIGINT AS changed, 0::BIGINT AS only_right, 0::BIGINT AS only_left FROM fc_wide"),
)
def cqr14(spark, sf):
    """A secondary method whose scores are all negative gets correction zero and must stay identical."""
    fc = base.forecasts(spark, sf).filter("role = 'calibration'")
    wide = checkpointed(fc.withColumn("lower", F.least("lower", "y") * 0.5).withColumn("upper", F.greatest("upper", "y") * 2.0))
    score = conformal.nonconformity(F.col("y"), F.col("lower"), F.col("upper")).alias("score")
    q = conformal.corrections(wide.select("method", "entity_id", score), ["method"])
    q = q.withColumn("correction", F.when(F.col("correction") == float("inf"), F.lit(0.0)).otherwise(F.col("correction")))
    return identical_tables(conformal.apply_correction(wide, q), wide, ["method", "entity_id"], ["lower", "median", "upper"])


# ---------------------------------------------------------------- quantile learners


def learning_rows(spark, sf, fit_roles=("fit",)):
    """Summary and resampled features with the remaining life, one row per supplier."""
    _, scored = base.landmarks(spark, sf, fit_roles)
    scored = checkpointed(scored)
    summary = features.trend(scored)
    full = features.sequences(scored).select("entity_id", features.resampled(F.col("z")).alias("_seq"))
    j = summary.join(full, "entity_id")
    return checkpointed(j.select(
        "entity_id", "role", (F.col("lifetime") - F.col("cutoff")).cast("double").alias("y"), F.array(*features.SUMMARY).alias("summary"), F.concat(F.array("log_age"), "_seq").alias("full"),
    ))


def single(rows):
    """Rows as the one replicate of themselves."""
    return rows.withColumns({"replicate": F.lit(0), "multiplicity": F.lit(1).cast("long")})


@query("cqr2_boosted_quantiles")
def cqr2(spark, sf):
    """All eight boosted candidates of 200 trees at both endpoint levels, scored on the tuning suppliers."""
    rows = single(learning_rows(spark, sf))
    grid = [g for g in conformal.grid_rows() if g["family"] == "boosted"]
    pred = replicates.fit_predict_groups(rows.filter("role = 'fit'"), rows.filter("role = 'tune'"), grid)
    return pred.groupBy("candidate_id", "tau").agg(F.count(F.lit(1)).alias("n"), rnd(F.avg(quantreg.pinball(F.col("y"), F.col("prediction"), F.col("tau"))), 4, "pinball"))


@query("cqr3_linear_quantiles")
def cqr3(spark, sf):
    rows = learning_rows(spark, sf)
    grid = [g for g in conformal.grid_rows() if g["family"] == "linear"]
    model = quantreg.fit_linear(rows.filter("role = 'fit'"), grid, (0.05, 0.95))
    pred = quantreg.predict_linear(rows.filter("role = 'tune'"), model)
    return pred.groupBy("candidate_id", "tau").agg(F.count(F.lit(1)).alias("n"), rnd(F.avg(quantreg.pinball(F.col("y"), F.col("prediction"), F.col("tau"))), 3, "pinball"))


@query("cqr5_median_model")
def cqr5(spark, sf):
    """Select on the tuning role with features of the fit role alone, then rebuild them on fit + tune and refit the chosen candidate's median."""
    rows = single(learning_rows(spark, sf))
    tuned = replicates.intervals(replicates.fit_predict_groups(rows.filter("role = 'fit'"), rows.filter("role = 'tune'"), conformal.grid_rows()))
    best = conformal.select_candidate(conformal.candidate_scores(tuned, conformal.candidate_grid(spark))).first()  # one row
    chosen = [g for g in conformal.grid_rows() if g["candidate_id"] == best["candidate_id"]]
    rows = single(learning_rows(spark, sf, ("fit", "tune")))
    pred = replicates.fit_predict_groups(rows.filter("role <> 'calibration'"), rows.filter("role = 'calibration'"), chosen, (0.5,))
    return pred.select("entity_id", "candidate_id", rnd("prediction", 3), (F.col("prediction") < 0).alias("negative_median"))


# Fixed value: the number of planned perturbation replicates.
REPLICATES = 8
cte("s_rost", "SELECT role, entity_id, eligible, row_number() OVER (PARTITION BY role ORDER BY entity_id) AS slot, count(*) OVER (PARTITION BY role) AS n_role FROM s_ent")
cte(
    "s_boot",
    f"SELECT d.replicate, d.role, r.entity_id, r.eligible FROM (SELECT replicate, role, 1 + {digest_mod('h', 'n_role')} AS pick FROM "
    f"(SELECT *, sha256('{SEED}|' || replicate || '|' || role || '|' || slot) AS h FROM s_rost, range(1, {REPLICATES + 1}) g(replicate))) d JOIN s_rost r ON r.role = d.role AND r.slot = d.pick",
)
cte("s_mult", "SELECT replicate, role, entity_id, eligible, count(*) AS m FROM s_boot GROUP BY ALL")
cte("s_least", "SELECT * FROM (VALUES ('calibration', 9), ('fit', 20), ('tune', 5)) v(role, least)")
cte(
    "s_gate",
    "SELECT r.replicate, l.role, coalesce(sum(m), 0)::BIGINT AS draws, coalesce(sum(m) FILTER (WHERE eligible), 0)::BIGINT AS eligible_draws, "
    f"count(*) FILTER (WHERE eligible) < any_value(l.least) AS failing FROM range(1, {REPLICATES + 1}) r(replicate) CROSS JOIN s_least l LEFT JOIN s_mult s ON s.replicate = r.replicate AND s.role = l.role GROUP BY 1, 2",
)


def stage_draws(spark, sf):
    """(entities, multiplicities) of REPLICATES draws from whole rosters, eligible or not."""
    entities = checkpointed(base.ship_entities(spark, sf))
    return entities, checkpointed(assign.stage_multiplicities(assign.bootstrap_draws(assign.role_rosters(entities), REPLICATES, SEED)))


@query(
    "cqr13_stage_gates",
    build("SELECT replicate, sum(draws)::BIGINT AS draws, sum(eligible_draws)::BIGINT AS eligible_draws, coalesce(string_agg(CASE WHEN failing THEN role END, ',' ORDER BY role), '') AS failing, "
          "CASE WHEN bool_or(failing) THEN 'FAIL' ELSE 'PASS' END AS status FROM s_gate GROUP BY 1 HAVING sum(draws) > 0"),
)
def cqr13_gates(spark, sf):
    entities, mult = stage_draws(spark, sf)
    out = replicates.stage_gates(mult, entities)
    return out.select("replicate", "draws", "eligible_draws", F.array_join(F.array_sort("failing_stages"), ",").alias("failing"), "status")


_PAIRS = [(a, b) for i, a in enumerate(base.CHANNELS) for b in base.CHANNELS[i:]]
cte("s_use", "SELECT s.replicate, g.stage, s.entity_id, s.m FROM s_mult s, (VALUES ('select', 'fit'), ('refit', 'fit'), ('refit', 'tune')) g(stage, role) WHERE s.role = g.role AND s.eligible")
cte("s_wrow", "SELECT u.replicate, u.stage, u.m / (sum(u.m) FILTER (WHERE p.cycle = 1) OVER (PARTITION BY u.replicate, u.stage) * p.cutoff) AS w, p.* FROM s_use u JOIN s_prefix p USING (entity_id)")
cte("s_mean", "SELECT replicate, stage, " + ", ".join(f"sum(w * {c}) AS m_{c}" for c in base.CHANNELS) + " FROM s_wrow GROUP BY 1, 2")
cte("s_cov", "SELECT replicate, stage, " + ", ".join(f"sum(w * ({a} - m_{a}) * ({b} - m_{b})) AS v_{a}_{b}" for a, b in _PAIRS) + " FROM s_wrow JOIN s_mean USING (replicate, stage) GROUP BY 1, 2")


@query(
    "cqr13_stage_preprocessors",
    build("SELECT replicate, stage, " + ", ".join(f"round(m_{c}, 5) AS mean_{c}, round(sqrt(v_{c}_{c}), 5) AS sd_{c}" for c in base.CHANNELS) + ", "
          + ", ".join(f"round(v_{a}_{b} / sqrt(v_{a}_{a} * v_{b}_{b}), 8) AS corr_{a}_{b}" for a, b in _PAIRS if a != b) + " FROM s_mean JOIN s_cov USING (replicate, stage)"),
)
def cqr13_preprocessors(spark, sf):
    """Weighted means, deviations and correlations that each replicate's selection and refit stages standardise by."""
    entities, mult = stage_draws(spark, sf)
    eligible = mult.join(entities.filter("eligible").select("entity_id"), "entity_id")
    m = replicates.stage_moments(replicates.entity_moments(base.ship_prefix(spark, sf), base.CHANNELS), eligible, base.CHANNELS)
    sd = {c: F.sqrt(f"cov_{c}_{c}") for c in base.CHANNELS}
    return m.select(
        "replicate", "stage", *[rnd(f"mean_{c}", 5, f"mean_{c}") for c in base.CHANNELS], *[rnd(sd[c], 5, f"sd_{c}") for c in base.CHANNELS],
        *[rnd(F.col(f"cov_{a}_{b}") / (sd[a] * sd[b]), 8, f"corr_{a}_{b}") for a, b in _PAIRS if a != b],
    )


@query("cqr13_bootstrap_reselection")
def cqr13(spark, sf):
    """Reselect, refit and calibrate every planned replicate: whole-roster draws, stage minimums, preprocessors of its own, 200 trees."""
    entities, mult = stage_draws(spark, sf)
    out = replicates.bootstrap(checkpointed(base.ship_prefix(spark, sf)), entities, mult, base.CHANNELS, base.WINDOW)
    return out.select("replicate", "status", "draws", "eligible_draws", "candidate_id", "n_calibration_rows", "n_calibration_distinct", rnd("correction", 3))


@query(
    "asg10_selection_barrier",
    build(f"SELECT e.entity_id, 'a' AS dataset, c.candidate_id FROM s_ent e CROSS JOIN ({_selected(conformal.TIE_BAND)}) c WHERE e.role = 'calibration' AND e.entity_id % 2 = 0"),
)
def asg10(spark, sf):
    """Calibration rows appear only for the data set whose selection record is frozen."""
    cal = base.ship_entities(spark, sf).filter("role = 'calibration'").withColumn("dataset", F.when(F.col("entity_id") % 2 == 0, "a").otherwise("b"))
    s = conformal.select_candidate(conformal.candidate_scores(candidate_forecasts(spark, sf), conformal.candidate_grid(spark)))
    record = s.select("candidate_id", F.explode(F.array(F.struct(F.lit("a").alias("dataset"), F.lit(True).alias("frozen")), F.struct(F.lit("b").alias("dataset"), F.lit(False).alias("frozen")))).alias("_r")).select("candidate_id", "_r.*")
    return assign.behind_selection(cal, record).select("entity_id", "dataset", "candidate_id")
