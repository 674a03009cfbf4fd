"""Queries: features, weighted moments, principal component and least squares."""

from __future__ import annotations

from pyspark.sql import functions as F

from varve.operators import features, linear
from varve.plans import base
from varve.plans.base import CHANNELS, WINDOW
from varve.plans.registry import query, rnd
from varve.plans.sqlkit import build, cte
from varve.session import checkpointed

SUMMARY = features.SUMMARY


@query("fea1_recent_rows", build("SELECT entity_id, cycle, cutoff, c1, c2, c3, c4 FROM s_prefix WHERE cycle > cutoff - 30"))
def fea1(spark, sf):
    return features.recent_rows(base.ship_prefix(spark, sf), WINDOW).select("entity_id", "cycle", "cutoff", *CHANNELS)


@query("fea2_project", build("SELECT entity_id, cycle, round(z, 6) AS z FROM scored"))
def fea2(spark, sf):
    _, scored = base.landmarks(spark, sf)
    return scored.select("entity_id", "cycle", rnd("z"))


@query("fea3_sequences", build("SELECT entity_id, count(*) AS w, round(min_by(z, cycle), 6) AS first_z, round(max_by(z, cycle), 6) AS last_z, round(sum(z * (cycle - cutoff)), 5) AS weighted FROM scored GROUP BY 1"))
def fea3(spark, sf):
    _, scored = base.landmarks(spark, sf)
    s = features.sequences(scored)
    weighted = F.aggregate(F.transform("z", lambda v, i: v * (i - F.size("z") + 1)), F.lit(0.0), lambda a, v: a + v)
    return s.select("entity_id", "w", rnd(F.element_at("z", 1), 6, "first_z"), rnd(F.element_at("z", -1), 6, "last_z"), rnd(weighted, 5, "weighted"))


@query("fea4_log_targets", build("SELECT entity_id, round(ln(cutoff / 100.0::DOUBLE), 9) AS log_age, CASE WHEN lifetime > cutoff THEN round(ln((lifetime - cutoff)::DOUBLE), 9) END AS y FROM u_ent"))
def fea4(spark, sf):
    ents = base.read_entities(spark, sf)
    return ents.select("entity_id", rnd(features.log_age(F.col("cutoff")), 9, "log_age"), rnd(features.log_remaining(F.col("lifetime"), F.col("cutoff")), 9, "y"))


@query("fea5_trend", build("SELECT entity_id, w, round(level, 6) AS level, round(slope, 6) AS slope, round(resid_sd, 6) AS resid_sd FROM summ"))
def fea5(spark, sf):
    _, scored = base.landmarks(spark, sf)
    return features.trend(scored).select("entity_id", "w", rnd("level"), rnd("slope"), rnd("resid_sd"))


@query("fea6_summary_vector", build("SELECT entity_id, role, " + ", ".join(f"round({c}, 6) AS {c}" for c in SUMMARY) + " FROM summ"))
def fea6(spark, sf):
    _, scored = base.landmarks(spark, sf)
    return features.trend(scored).select("entity_id", "role", *[rnd(c) for c in SUMMARY])


cte("seqs", "SELECT entity_id, role, cutoff, lifetime, list(z ORDER BY cycle) AS z, count(*) AS w FROM u_scored GROUP BY 1, 2, 3, 4")
cte("u_scored", "SELECT *, c1 / 100.0::DOUBLE AS z FROM u_prefix WHERE cycle > cutoff - 20")
cte("full_vec", "SELECT entity_id, role, k, z[floor(k * (w - 1) / 29.0::DOUBLE)::INT + 1] AS lo, z[least(floor(k * (w - 1) / 29.0::DOUBLE) + 1, w - 1)::INT + 1] AS hi, "
    "k * (w - 1) / 29.0::DOUBLE - floor(k * (w - 1) / 29.0::DOUBLE) AS f FROM seqs, range(30) g(k)")


@query("fea7_resampled_vector", build("SELECT entity_id, k::INT AS k, round(lo + f * (hi - lo), 6) AS v FROM full_vec"))
def fea7(spark, sf):
    """User histories of 20 cycles stretched to 30 points."""
    rows = features.recent_rows(base.read_prefix(spark, sf), 20).withColumn("z", F.col("c1") / 100.0)
    s = features.sequences(rows)
    return s.select("entity_id", F.posexplode(features.resampled(F.col("z"))).alias("k", "v")).select("entity_id", "k", rnd("v"))


@query(
    "fea8_feature_gate",
    build("SELECT count(*) AS n_entities, count(*) FILTER (WHERE role = 'tune') AS n_unmatched, count(*) FILTER (WHERE role <> 'tune' AND entity_id % 4 = 1) AS n_misaligned FROM summ"),
)
def fea8(spark, sf):
    """The second feature set lacks the tuning role and shifts the log age of some."""
    _, scored = base.landmarks(spark, sf)
    summary = features.trend(scored)
    full = features.sequences(scored).filter("role <> 'tune'").select("entity_id", (features.log_age(F.col("cutoff")) + F.when(F.col("entity_id") % 4 == 1, 1e-6).otherwise(0.0)).alias("log_age"))
    return features.feature_gate(summary, full)


@query(
    "fea9_linear_scaler",
    build("SELECT k::INT AS k, round(avg(lo + f * (hi - lo)), 6) AS mean, round(stddev_pop(lo + f * (hi - lo)), 6) AS sd FROM full_vec WHERE role = 'fit' GROUP BY 1"),
)
def fea9(spark, sf):
    rows = features.recent_rows(base.read_prefix(spark, sf), 20).withColumn("z", F.col("c1") / 100.0)
    vecs = features.sequences(rows).filter("role = 'fit'").select(F.lit("fit").alias("stage"), features.resampled(F.col("z")).alias("x"))
    return features.fit_linear_scaler(vecs).select("k", rnd("mean"), rnd("sd"))


@query("fea10_leakage", "SELECT (SELECT count(DISTINCT l_suppkey) FROM lineitem) AS identical, 0::BIGINT AS changed, 0::BIGINT AS only_right, 0::BIGINT AS only_left")
def fea10(spark, sf):
    """Raise every channel after the cutoff by a million and fit the preprocessor on either table: no feature
    may move by more than sums in another order move it."""
    from varve.operators.ordering import dense_index
    from varve.operators.quality import compare_tables

    ents = base.ship_entities(spark, sf).filter("eligible").select("entity_id", "role", "cutoff", "lifetime")
    rows = dense_index(base.shipments(spark, sf), ["entity_id"], base.SHIP_CELLS, base.SHIP_ORDER, "cycle").join(ents, "entity_id")
    future = F.when(F.col("cycle") > F.col("cutoff"), F.lit(1e6)).otherwise(F.lit(0.0))
    tampered = rows.select("entity_id", "cycle", "role", "cutoff", "lifetime", *[(F.col(c) + future).alias(c) for c in CHANNELS])

    def feats(r):
        _, scored = features.fit_and_project(checkpointed(r.filter("cycle <= cutoff")), CHANNELS, window=WINDOW)
        return checkpointed(features.trend(scored).select("entity_id", *SUMMARY))

    plain, moved = feats(rows), feats(tampered)
    differ = compare_tables(plain, moved, ["entity_id"], SUMMARY, atol=1e-9, rtol=1e-9).groupBy("entity_id").agg(F.max("reason").alias("reason"))
    each = plain.select("entity_id").unionByName(moved.select("entity_id")).distinct().join(differ, "entity_id", "left")
    reason = F.col("reason")
    return each.agg(F.count_if(reason.isNull()).alias("identical"), F.count_if(reason == "differs").alias("changed"), F.count_if(reason == "missing_left").alias("only_right"), F.count_if(reason == "missing_right").alias("only_left"))


# ---------------------------------------------------------------- moments and fits


def _fit_moments(spark, sf):
    prefix = checkpointed(base.ship_prefix(spark, sf)).filter("role = 'fit'").withColumn("stage", F.lit("fit"))
    return linear.weighted_moments(linear.entity_weights(prefix), CHANNELS)


@query("fit1_weighted_moments", build("SELECT " + ", ".join(f"round(m_{c}, 6) AS mean_{c}, round(cov_{c}_{c}, 5) AS var_{c}" for c in CHANNELS) + ", round(weight_sum, 9) AS weight_sum FROM mom1, mom2"))
def fit1(spark, sf):
    m = _fit_moments(spark, sf)
    return m.select(*[c for ch in CHANNELS for c in (rnd(f"mean_{ch}"), rnd(f"cov_{ch}_{ch}", 5, f"var_{ch}"))], rnd("weight_sum", 9))


cte("boot_w", "SELECT m.replicate, m.role, m.entity_id, p.cutoff, p.cycle, p.c1, p.c2, m.multiplicity / (sum(CASE WHEN p.cycle = 1 THEN m.multiplicity END) OVER (PARTITION BY m.replicate, m.role) * p.cutoff)::DOUBLE AS w "
    "FROM mult m JOIN u_prefix p ON p.entity_id = m.entity_id")
cte("boot_m", "SELECT replicate, role, sum(w) AS weight_sum, sum(w * c1) AS m1, sum(w * c2) AS m2 FROM boot_w GROUP BY 1, 2")


@query(
    "fit1_bootstrap_moments",
    build("SELECT b.replicate, b.role, round(max(weight_sum), 9) AS weight_sum, round(max(m1), 6) AS mean_c1, round(max(m2), 6) AS mean_c2, round(sum(w * (c1 - m1) ** 2), 5) AS var_c1, round(sum(w * (c1 - m1) * (c2 - m2)), 5) AS cov_c1_c2 "
          "FROM boot_w b JOIN boot_m m ON m.replicate = b.replicate AND m.role = b.role GROUP BY 1, 2"),
)
def fit1b(spark, sf):
    """Weighted moments of every bootstrap replicate and role in one job."""
    from varve.operators import assign
    from varve.plans.q_design import _boot

    mult = assign.stage_multiplicities(_boot(spark, sf))
    rows = checkpointed(base.read_prefix(spark, sf).drop("role").join(mult, "entity_id"))
    w = linear.entity_weights(rows, ["replicate", "role"], "multiplicity")
    m = linear.weighted_moments(w, ["c1", "c2"], ["replicate", "role"])
    return m.select("replicate", "role", rnd("weight_sum", 9), rnd("mean_c1"), rnd("mean_c2"), rnd("cov_c1_c1", 5, "var_c1"), rnd("cov_c1_c2", 5))


@query("fit2_channel_mask", build(" UNION ALL ".join(f"SELECT {i} AS k, round(sqrt(cov_{c}_{c}), 6) AS sd, sqrt(cov_{c}_{c}) > 1e-8 AS retained FROM mom2" for i, c in enumerate(CHANNELS))))
def fit2(spark, sf):
    pre = linear.principal_component(_fit_moments(spark, sf), CHANNELS)
    return pre.select(F.posexplode(F.arrays_zip("sd", "retained")).alias("k", "v")).select("k", rnd(F.col("v.sd"), 6, "sd"), F.col("v.retained").alias("retained"))


@query("fit3_correlation_matrix", build("SELECT i, j, round(v, 6) AS r FROM corr4"))
def fit3(spark, sf):
    m = _fit_moments(spark, sf)
    k = len(CHANNELS)
    name = lambda i, j: F.col(f"cov_{CHANNELS[min(i, j)]}_{CHANNELS[max(i, j)]}")
    cells = [F.struct(F.lit(i + 1).alias("i"), F.lit(j + 1).alias("j"), (name(i, j) / F.sqrt(name(i, i) * name(j, j))).alias("r")) for i in range(k) for j in range(k)]
    return m.select(F.inline(F.array(*cells))).select("i", "j", rnd("r"))


@query("fit4_principal_component", build("SELECT i::INT AS i, round(x, 6) AS loading, round(sqrt((SELECT eig FROM pc_eig)), 6) AS pc_scale, round((SELECT eig FROM pc_eig) / 4, 6) AS explained FROM pc"))
def fit4(spark, sf):
    pre = linear.principal_component(_fit_moments(spark, sf), CHANNELS)
    return pre.select(F.posexplode("pc").alias("i", "loading"), "pc_scale", "explained").select((F.col("i") + 1).alias("i"), rnd("loading"), rnd("pc_scale"), rnd("explained"))


def _log_remaining():
    return features.log_remaining(F.col("lifetime"), F.col("cutoff"))


def _ols(spark, sf):
    _, scored = base.landmarks(spark, sf, ("fit", "tune"))
    rows = features.trend(scored).withColumn("stage", F.lit("refit"))
    model = linear.fit_least_squares(rows.filter("role <> 'calibration'"), SUMMARY, _log_remaining())
    return rows, model


@query("fit5_least_squares")
def fit5(spark, sf):
    _, model = _ols(spark, sf)
    return model.select("stage", "n", "rank", "dof", "status", rnd("residual_variance"), F.posexplode("coefficients").alias("k", "coefficient")).withColumn("coefficient", rnd("coefficient"))


@query(
    "fit5_simple_regression",
    build("SELECT k, round(v, 6) AS coefficient, n, dof FROM (SELECT count(*) AS n, count(*) - 2 AS dof, regr_intercept(ln((lifetime - cutoff)::DOUBLE), ln(cutoff / 100.0::DOUBLE)) AS b0, regr_slope(ln((lifetime - cutoff)::DOUBLE), ln(cutoff / 100.0::DOUBLE)) AS b1 FROM s_ent WHERE role <> 'calibration') "
          "CROSS JOIN LATERAL (VALUES (0, b0), (1, b1)) t(k, v)"),
)
def fit5b(spark, sf):
    rows = base.ship_entities(spark, sf).filter("role <> 'calibration'").select(F.lit("refit").alias("stage"), features.log_age(F.col("cutoff")).alias("log_age"), _log_remaining().alias("y"))
    model = linear.fit_least_squares(rows, ["log_age"], F.col("y"))
    return model.select(F.posexplode("coefficients").alias("k", "coefficient"), "n", "dof").withColumn("coefficient", rnd("coefficient"))


@query("fit6_predictive_interval")
def fit6(spark, sf):
    rows, model = _ols(spark, sf)
    pred = linear.predict_least_squares(rows.filter("role = 'calibration'"), model, SUMMARY)
    return pred.select("entity_id", rnd("lower", 4), rnd("median", 4), rnd("upper", 4), "estimable")
