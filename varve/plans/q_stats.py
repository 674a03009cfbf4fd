"""Queries: summaries, ranks, correlations, bootstrap inference, draw diagnostics, manifests, sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from varve.functions.special import norm_ppf
from varve.operators import assign, precision, quality, scoring, stats
from varve.plans import base
from varve.plans.base import CHANNELS, DRAW_PARAMS, SEED, table
from varve.plans.registry import query, rnd
from varve.plans.sqlkit import build, cte, digest_mod
from varve.session import checkpoint_dir, checkpointed
from varve.sources import readers, sinks

PARAMS = list(DRAW_PARAMS)
TRUTH = {n: c for n, (c, _) in DRAW_PARAMS.items()}
Z975 = norm_ppf(0.975)


@query(
    "sta1_summary",
    "SELECT l_returnflag, count(*) AS n, min(l_extendedprice) AS min, round(quantile_cont(l_extendedprice, 0.25), 6) AS q1, round(quantile_cont(l_extendedprice, 0.5), 6) AS median, round(quantile_cont(l_extendedprice, 0.75), 6) AS q3, round(avg(l_extendedprice), 5) AS mean, max(l_extendedprice) AS max FROM lineitem GROUP BY 1",
)
def sta1(spark, sf):
    s = stats.summary(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice")
    return s.select("l_returnflag", "n", "min", rnd("q1"), rnd("median"), rnd("q3"), rnd("mean", 5), "max")


@query("sta2_average_ranks", "SELECT l_orderkey, l_linenumber, sum(r) AS r FROM (SELECT l_orderkey, l_linenumber, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2 AS r FROM lineitem) GROUP BY 1, 2")
def sta2(spark, sf):
    """Ranks of quantity within the return flag: three keys, each a third of the table."""
    from varve.operators.ordering import average_ranks

    r = average_ranks(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity"), ["l_returnflag"], "l_quantity", "r")
    return r.groupBy("l_orderkey", "l_linenumber").agg(F.sum("r").alias("r"))


@query("sta3_pearson", build("SELECT entity_id, round(corr(c1, c2), 6) AS r12, round(corr(c2, tax), 6) AS r24, NULL::DOUBLE AS r_const FROM s_traj GROUP BY 1"))
def sta3(spark, sf):
    g = base.shipments(spark, sf).groupBy("entity_id").agg(
        stats.pearson(F.col("c1"), F.col("c2")).alias("r12"), stats.pearson(F.col("c2"), F.col("tax")).alias("r24"), stats.pearson(F.col("c1"), F.lit(1.0)).alias("r_const"))
    return g.select("entity_id", rnd("r12"), rnd("r24"), "r_const")


cte("sp", "SELECT l_returnflag, l_quantity, l_extendedprice, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2 AS rx, rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2 AS ry FROM lineitem")


@query("sta4_spearman", build("SELECT l_returnflag, count(*) AS n, round(corr(l_quantity, l_extendedprice), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM sp GROUP BY 1"))
def sta4(spark, sf):
    a = stats.associations(table(spark, sf, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice"), ["l_returnflag"], "l_quantity", "l_extendedprice")
    return a.select("l_returnflag", "n", rnd("pearson"), rnd("spearman"))


@query(
    "sta5_top_correlations",
    build("SELECT a, b, round(r, 6) AS r FROM (" + " UNION ALL ".join(f"SELECT '{PARAMS[i]}' AS a, '{PARAMS[j]}' AS b, corr({PARAMS[i]}, {PARAMS[j]}) AS r FROM draws" for i in range(len(PARAMS)) for j in range(i + 1, len(PARAMS))) + ") ORDER BY abs(r) DESC, a, b LIMIT 10"),
)
def sta5(spark, sf):
    return stats.top_correlations(base.draws(spark, sf), PARAMS).select("a", "b", rnd("r"))


cte("wil", "SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag = 'R') AS k, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') / count(*) AS p FROM lineitem GROUP BY 1")


@query(
    "sta6_wilson",
    build(f"SELECT l_suppkey, k, n, round(p, 6) AS proportion, round(sqrt(p * (1 - p) / n), 6) AS mcse, round(greatest(0, (p + {Z975!r} ** 2 / (2 * n) - {Z975!r} * sqrt(p * (1 - p) / n + {Z975!r} ** 2 / (4 * n * n))) / (1 + {Z975!r} ** 2 / n)), 6) AS wilson_low, "
          f"round(least(1, (p + {Z975!r} ** 2 / (2 * n) + {Z975!r} * sqrt(p * (1 - p) / n + {Z975!r} ** 2 / (4 * n * n))) / (1 + {Z975!r} ** 2 / n)), 6) AS wilson_high FROM wil"),
)
def sta6(spark, sf):
    g = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("k"), F.count(F.lit(1)).alias("n"))
    return stats.wilson_columns(g, "k", "n").select("l_suppkey", "k", "n", rnd("proportion"), rnd("mcse"), rnd("wilson_low"), rnd("wilson_high"))


def _pairs(spark, sf):
    c = scoring.components(base.forecasts(spark, sf))
    return scoring.paired_components(c, "last30", "full", by=["role"]).select("role", "entity_id", F.col("score").alias("x"))


@query("sta7_benchmark_mean", build("SELECT role, count(*) AS n, 0::BIGINT AS n_bad, CASE WHEN count(*) >= 2 THEN 'PASS' ELSE 'FAIL' END AS status, CASE WHEN count(*) >= 2 THEN round(avg(score), 6) END AS mean_difference FROM pairc GROUP BY 1"))
def sta7(spark, sf):
    return stats.benchmark_mean(checkpointed(_pairs(spark, sf)), "x", ["role"]).select("role", "n", "n_bad", "status", rnd("mean_difference"))


@query(
    "sta8_influence_diagnostics",
    build("SELECT role, n, round(m, 6) AS mean, round(se, 6) AS se, round(max(abs(score - m)) / sum(abs(score - m)), 6) AS max_share, round(max(abs(m - score)) / (n - 1) / se, 6) AS max_loo_shift FROM (SELECT role, score, avg(score) OVER w AS m, count(*) OVER w AS n, stddev_samp(score) OVER w / sqrt(count(*) OVER w) AS se FROM pairc WINDOW w AS (PARTITION BY role)) GROUP BY role, n, m, se"),
)
def sta8(spark, sf):
    d = stats.influence_diagnostics(_pairs(spark, sf), "x", ["role"])
    return d.select("role", "n", rnd("mean"), rnd("se"), rnd("max_share"), rnd("max_loo_shift"))


# Fixed value: resamples of the bootstrap-t.
BOOT = 1999
cte("bt_pool", "SELECT role AS scenario, entity_id, score AS x, row_number() OVER (PARTITION BY role ORDER BY entity_id) AS slot, count(*) OVER (PARTITION BY role) AS n FROM pairc")
cte("bt_base", "SELECT scenario, count(*) AS n, avg(x) AS m, stddev_samp(x) / sqrt(count(*)) AS se FROM bt_pool GROUP BY 1")
cte("bt_draw", f"SELECT d.scenario, d.replicate, p.x FROM (SELECT scenario, replicate, 1 + {digest_mod('h', 'n')} AS pick FROM (SELECT scenario, n, g.replicate, sha256('{SEED}|' || scenario || '|' || g.replicate || '|' || slot) AS h FROM bt_pool, range(1, {BOOT + 1}) g(replicate))) d JOIN bt_pool p ON p.scenario = d.scenario AND p.slot = d.pick")
cte("bt_rep", "SELECT r.scenario, r.replicate, (r.rm - b.m) / nullif(r.rs, 0) AS pv, r.rs = 0 AS zero FROM (SELECT scenario, replicate, avg(x) AS rm, stddev_samp(x) / sqrt(count(*)) AS rs FROM bt_draw GROUP BY 1, 2) r JOIN bt_base b ON b.scenario = r.scenario")
cte("bt", "SELECT b.scenario, any_value(b.n) AS n, any_value(b.m) AS m, any_value(b.se) AS se, count(*) AS draws, count(*) FILTER (WHERE zero) AS zero_se_draws, CASE WHEN any_value(b.se) = 0 THEN 'zero_observed_standard_error' WHEN count(*) FILTER (WHERE zero) > 0 THEN 'zero_bootstrap_standard_error' ELSE 'ok' END AS status, "
    "quantile_cont(pv, 0.025) AS q1, quantile_cont(pv, 0.05) AS q2, quantile_cont(pv, 0.975) AS q3 FROM bt_rep r JOIN bt_base b ON b.scenario = r.scenario GROUP BY 1")


def _bootstrap(spark, sf):
    pairs = checkpointed(_pairs(spark, sf))
    slots = assign.role_rosters(pairs).drop("n_role").join(pairs, ["role", "entity_id"]).withColumnRenamed("role", "scenario")
    return stats.bootstrap_t(stats.bootstrap_pivots(slots, BOOT, SEED))


@query(
    "sta9_bootstrap_t",
    build("SELECT scenario, n, draws, zero_se_draws, status, CASE WHEN status = 'ok' THEN round(m - q3 * se, 3) END AS interval_low, CASE WHEN status = 'ok' THEN round(m - q1 * se, 3) END AS interval_high, CASE WHEN status = 'ok' THEN round(m - q2 * se, 3) END AS one_sided_upper, "
          "CASE WHEN status = 'ok' THEN m - q3 * se <= 0 AND m - q1 * se >= 0 END AS contains_zero FROM bt"),
)
def sta9(spark, sf):
    b = _bootstrap(spark, sf)
    return b.select("scenario", "n", "draws", "zero_se_draws", "status", rnd("interval_low", 3), rnd("interval_high", 3), rnd("one_sided_upper", 3), "contains_zero")


cte("infl", "SELECT scenario, max(abs(x - m)) / nullif(sum(abs(x - m)), 0) AS max_share, max(abs(x - m)) / (n - 1) / nullif(se, 0) AS max_loo_shift FROM (SELECT p.scenario, p.x, b.n, b.m, b.se FROM bt_pool p JOIN bt_base b ON b.scenario = p.scenario) GROUP BY scenario, n, se")
_ORDER10 = {c: {f"{c}_n_defined": f"count({c})", f"{c}_median": f"round(quantile_cont({c}, 0.5), 6)", f"{c}_p95": f"round(quantile_cont({c}, 0.95), 6)", f"{c}_maximum": f"round(max({c}), 6)"} for c in ("max_share", "max_loo_shift")}


@query(
    "sta10_outcome_summary",
    build("SELECT count(*) AS attempted, count(*) FILTER (WHERE status = 'ok') AS available, count(*) FILTER (WHERE status = 'ok' AND m - q3 * se <= 0 AND m - q1 * se >= 0) AS covered, count(*) FILTER (WHERE status = 'ok' AND m - q2 * se < 0) AS rejected, round(sum(zero_se_draws) / sum(draws), 6) AS zero_se_fraction, "
          + ", ".join(f"{sql} AS {name}" for named in _ORDER10.values() for name, sql in named.items()) + " FROM bt JOIN infl USING (scenario)"),
)
def sta10(spark, sf):
    """Outcomes of the bootstrap by role, with the spread of their influence diagnostics."""
    shares = stats.influence_diagnostics(_pairs(spark, sf), "x", ["role"]).select(F.col("role").alias("scenario"), "max_share", "max_loo_shift")
    results = checkpointed(_bootstrap(spark, sf).join(shares, "scenario").withColumn("scenario", F.lit("all")))
    s = stats.outcome_summary(results)
    order = [F.col(n) if n.endswith("_n_defined") else rnd(n) for named in _ORDER10.values() for n in named]
    return s.select("attempted", "available", "covered", "rejected", rnd("zero_se_fraction"), *order)


cte("dl", " UNION ALL ".join(f"SELECT fit, chain, draw, '{p}' AS param, {p} AS value, {TRUTH[p]!r}::DOUBLE AS truth FROM draws" for p in PARAMS))
cte("rec", "SELECT fit, param, count(*) AS n, any_value(truth) AS truth, avg(value) AS mean, stddev_samp(value) AS sd, quantile_cont(value, 0.025) AS low, quantile_cont(value, 0.975) AS high FROM dl GROUP BY 1, 2")


@query(
    "sta11_recovery",
    build("SELECT fit, param, n, truth, round(mean, 7) AS mean, round(sd, 7) AS sd, round(low, 7) AS low, round(high, 7) AS high, truth BETWEEN low AND high AS inside, round((mean - truth) / sd, 5) AS z_error, abs((mean - truth) / sd) > 3 AS gross FROM rec"),
)
def sta11(spark, sf):
    r = stats.recovery(checkpointed(base.draws(spark, sf)), TRUTH)
    return r.select("fit", "param", "n", "truth", *[rnd(c, 7) for c in ("mean", "sd", "low", "high")], "inside", rnd("z_error", 5), "gross")


@query(
    "sta12_recovery_rollup",
    build("SELECT n_regionkey AS regime, param, count(*) AS n, count(*) FILTER (WHERE truth BETWEEN low AND high) AS covered, round(avg(mean - truth), 7) AS mean_bias, round(max(abs((mean - truth) / sd)), 5) AS max_abs_z FROM rec JOIN nation ON n_nationkey = fit GROUP BY 1, 2"),
)
def sta12(spark, sf):
    """Recovery by region: the region of the nation is the regime."""
    regime = table(spark, sf, "nation").select(F.col("n_nationkey").alias("fit"), F.col("n_regionkey").alias("regime"))
    r = stats.recovery_rollup(stats.recovery(checkpointed(base.draws(spark, sf)), TRUTH).join(regime, "fit"))
    return r.select("regime", "param", "n", "covered", rnd("mean_bias", 7), rnd("max_abs_z", 5))


@query(
    "sta13_sd_ratio",
    build("SELECT d.fit, d.param, round(stddev_samp(value) / any_value(p.sd), 6) AS ratio FROM dl d JOIN (SELECT param, stddev_samp(value) AS sd FROM dl GROUP BY 1) p ON p.param = d.param GROUP BY 1, 2"),
)
def sta13(spark, sf):
    """SD of each nation's draws against all draws as the prior."""
    d = base.draws(spark, sf)
    return stats.sd_ratio(d, d, PARAMS).select("fit", "param", rnd("ratio"))


@query(
    "sta14_replica_tails",
    "SELECT r.l_suppkey, round(avg((r.l_extendedprice >= o.v)::INT), 6) AS tail_area, count(*) AS n, round(quantile_cont(r.l_extendedprice, 0.05), 4) AS p05, round(quantile_cont(r.l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(r.l_extendedprice, 0.95), 4) AS p95 FROM lineitem r JOIN (SELECT s_suppkey, s_acctbal * 5 AS v FROM supplier) o ON o.s_suppkey = r.l_suppkey GROUP BY 1",
)
def sta14(spark, sf):
    reps = table(spark, sf, "lineitem").select("l_suppkey", F.col("l_extendedprice").alias("value"))
    obs = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), (F.col("s_acctbal") * 5).alias("value"))
    t = stats.replica_tails(reps, obs, ["l_suppkey"])
    return t.select("l_suppkey", rnd("tail_area"), "n", rnd("p05", 4), rnd("p50", 4), rnd("p95", 4))


@query(
    "sta15_posterior_geometry",
    build("SELECT fit, chain, round(avg(ln(sigma_z)), 7) AS log_sigma_z, round(avg(ln(sigma_r)), 7) AS log_sigma_r, round(avg(atanh(rho)), 7) AS atanh_rho, round(avg(2 * ln(sigma_z) + ln(1 - rho * rho)), 7) AS log_nu FROM draws GROUP BY 1, 2"),
)
def sta15(spark, sf):
    g = stats.geometry(base.draws(spark, sf))
    cols = ["log_sigma_z", "log_sigma_r", "atanh_rho", "log_nu"]
    return g.groupBy("fit", "chain").agg(*[rnd(F.avg(c), 7, c) for c in cols])


cte("health", "SELECT fit, chain, draw, energy, diverging, depth, lead(energy) OVER (PARTITION BY fit, chain ORDER BY draw) AS nxt FROM draws")
cte("bf", "SELECT fit, chain, avg((nxt - energy) ** 2) / var_samp(energy) AS bfmi FROM health GROUP BY 1, 2")


@query(
    "sta16_sampler_health",
    build("SELECT h.fit, count(*) AS n_draws, count(*) FILTER (WHERE diverging) AS divergences, round(avg((depth >= 12)::INT), 6) AS depth_fraction, round(any_value(b.m), 6) AS min_bfmi FROM health h JOIN (SELECT fit, min(bfmi) AS m FROM bf GROUP BY 1) b ON b.fit = h.fit GROUP BY 1"),
)
def sta16(spark, sf):
    h = stats.sampler_health(base.draws(spark, sf))
    return h.select("fit", "n_draws", "divergences", rnd("depth_fraction"), rnd("min_bfmi"))


@query("sta16_chain_gate")
def sta16b(spark, sf):
    """R-hat, batch-means ESS and sampler health of every nation's draws."""
    d = checkpointed(base.draws(spark, sf))
    long = stats.unpivot(stats.spread_draws(d, ["fit", "chain", "draw"]), ["fit", "chain", "draw"], PARAMS)
    sizes = precision.chain_sizes(d, ["fit"])
    sized = long.join(F.broadcast(sizes.select("fit", "sizes")), "fit")
    lrv = precision.batch_means(sized, ["fit", "param"], "value", F.slice("sizes", 1, 1))
    pooled = precision.pool_chains(lrv, ["fit", "param"], 0.05)
    marginal = long.groupBy("fit", "param").agg(F.var_samp("value").alias("_v"))
    ess = pooled.join(marginal, ["fit", "param"]).select("fit", "param", (F.col("_v") / F.nullif(F.col("variance"), F.lit(0.0))).alias("ess_batch_means"))
    g = stats.chain_gate(stats.split_rhat(long), ess, stats.sampler_health(d))
    return g.select("fit", "divergences", rnd("max_rhat"), rnd("min_ess_batch_means", 4), rnd("min_bfmi"), F.concat_ws(",", "reasons").alias("reasons"), "status")


# ---------------------------------------------------------------- manifests and sinks


@query("val10_file_manifest")
def val10(spark, sf):
    """Inventory of the table folder against a manifest with one file left out, one altered, one invented."""
    inv = checkpointed(readers.file_inventory(spark, sf))
    altered = F.when(F.col("path").contains("orders"), F.concat(F.lit("0"), F.col("sha256"))).otherwise(F.col("sha256"))
    listed = inv.filter(~F.col("path").contains("nation")).select("path", "bytes", altered.alias("sha256"))
    invented = inv.filter(F.col("path").contains("region")).select(F.concat("path", F.lit(".copy")).alias("path"), "bytes", "sha256")
    bad = readers.inventory_mismatches(inv, listed.unionByName(invented))
    return bad.select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), "reason")


def _fresh(spark) -> str:
    return f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}"


@query("snk1_write_once", "SELECT s_nationkey, count(*) AS n, true AS refused FROM supplier GROUP BY 1")
def snk1(spark, sf):
    """Write, try to write again, read back what the first write left."""
    from pyspark.errors import AnalysisException

    path = _fresh(spark)
    src = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    sinks.write_once(src, path)
    try:
        sinks.write_once(src.limit(0), path)
        refused = False
    except AnalysisException:
        refused = True
    return spark.read.parquet(path).groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n")).withColumn("refused", F.lit(refused))


@query("snk2_run_registry", "SELECT status, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'failed' ELSE 'completed' END AS status FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT 'rerun' FROM orders WHERE o_orderstatus = 'P') GROUP BY 1")
def snk2(spark, sf):
    """Register finished orders as runs, then offer all orders again: only unseen ids are appended."""
    path = _fresh(spark)
    orders = table(spark, sf, "orders")
    done = orders.filter("o_orderstatus <> 'P'").select(F.concat(F.lit("run-"), F.col("o_orderkey").cast("string")).alias("run_id"), F.when(F.col("o_orderkey") % 3 == 0, "failed").otherwise("completed").alias("status"))
    sinks.append_runs(spark, done, path)
    again = orders.select(F.concat(F.lit("run-"), F.col("o_orderkey").cast("string")).alias("run_id"), F.lit("rerun").alias("status"))
    sinks.append_runs(spark, again, path)
    return sinks.read_runs(spark, path, done.schema).groupBy("status").agg(F.count(F.lit(1)).alias("n"))
