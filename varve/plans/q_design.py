"""Queries: sources, validation, assignment and the design audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from varve.operators import assign, audit, features, linear, quality
from varve.operators.ordering import dense_index, linear_quantiles
from varve.plans import base
from varve.plans.base import CHANNELS, READ_CHANNELS, READ_LOW, READ_WIDTH, SEED, table
from varve.plans.registry import query, rnd
from varve.plans.sqlkit import build, cte, digest, digest_mod, hash_mod
from varve.session import checkpointed
from varve.sources import readers, sinks

# ---------------------------------------------------------------- sources


def _trajectory_lines(spark, sf):
    """lineitem written as text rows: returned rows lose a field, open orders carry a NaN, and
    linenumber 7 a fractional cycle."""
    r = table(spark, sf, "lineitem")
    cycle = F.when(F.col("l_linenumber") == 7, F.lit("7.5")).otherwise(F.col("l_linenumber").cast("string"))
    last = F.when(F.col("l_returnflag") == "R", F.lit("")).when(F.col("l_linestatus") == "O", F.lit(" nan")).otherwise(F.concat(F.lit("  "), F.col("l_tax").cast("string")))
    return r.select(F.concat(F.lit(" "), F.col("l_suppkey").cast("string"), F.lit("\t"), cycle, F.lit(" "), F.col("l_quantity").cast("string"), last).alias("value"))


@query(
    "src1_read_trajectories",
    "SELECT CASE WHEN l_returnflag = 'R' THEN 'field_count' WHEN l_linestatus = 'O' THEN 'non_finite' WHEN l_linenumber = 7 THEN 'not_integral' ELSE 'ok' END AS reject, "
    "count(*) AS n_rows, count(DISTINCT CASE WHEN l_returnflag <> 'R' AND l_linestatus <> 'O' AND l_linenumber <> 7 THEN l_suppkey END) AS n_entities FROM lineitem GROUP BY 1",
)
def src1(spark, sf):
    parsed = readers.parse_trajectories(_trajectory_lines(spark, sf), ["c1", "c4"])
    return parsed.groupBy(F.coalesce("reject", F.lit("ok")).alias("reject")).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("entity_id").alias("n_entities"))


@query(
    "src2_read_manifest",
    build("SELECT role, CASE WHEN entity_id % 7 = 3 THEN 'wrong_dataset' WHEN entity_id % 5 = 1 THEN 'duplicate_id' ELSE 'ok' END AS reject, "
          "sum(CASE WHEN entity_id % 5 = 1 THEN 2 ELSE 1 END)::BIGINT AS n_rows, sum((CASE WHEN entity_id % 5 = 1 THEN 2 ELSE 1 END) * cutoff)::BIGINT AS sum_cutoff FROM u_ent GROUP BY 1, 2"),
)
def src2(spark, sf):
    ents = base.read_entities(spark, sf)
    dataset = F.when(F.col("entity_id") % 7 == 3, F.lit("other")).otherwise(F.lit("events"))
    record = F.to_json(F.struct(dataset.alias("dataset"), "entity_id", "role", F.col("cutoff").alias("proposed_cutoff"), F.col("eligible").alias("eligible_alive")))
    copies = F.when(F.col("entity_id") % 5 == 1, F.lit(2)).otherwise(F.lit(1))
    lines = ents.select(record.alias("value"), F.explode(F.sequence(F.lit(1), copies)))
    parsed = lines.select(F.from_json("value", readers.MANIFEST_SCHEMA, {"mode": "FAILFAST"}).alias("m")).select("m.*")
    checked = readers.check_manifest(parsed, "events")
    return checked.groupBy("role", F.coalesce("reject", F.lit("ok")).alias("reject")).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("proposed_cutoff").alias("sum_cutoff"))


@query(
    "src3_read_predictions",
    build("SELECT count(*) FILTER (WHERE method = 'full' AND role <> 'tune') AS n_matched, count(*) FILTER (WHERE method = 'full' AND role = 'tune') AS n_missing, 0::BIGINT AS n_unknown, 0::BIGINT AS n_repeated FROM fc"),
)
def src3(spark, sf):
    fc = base.forecasts(spark, sf).filter("method = 'full'")
    fields = ["entity_id", "cutoff", "lower", "median", "upper"]
    lines = fc.filter("role <> 'tune'").select(F.to_csv(F.struct(*fields)).alias("value"))
    schema = "entity_id long, cutoff int, lower double, median double, upper double"
    parsed = lines.select(F.from_csv("value", F.lit(schema), {"mode": "FAILFAST"}).alias("p")).select("p.*")
    return readers.cohort_cover(parsed, fc)


@query(
    "src4_read_labels",
    "SELECT CASE WHEN c_acctbal <= 0 THEN 'not_positive' ELSE 'ok' END AS reject, count(*) AS n_rows, round(sum(c_acctbal), 2) AS sum_y FROM customer GROUP BY 1",
)
def src4(spark, sf):
    labels = table(spark, sf, "customer").select(F.col("c_custkey").alias("entity_id"), F.col("c_acctbal").alias("y"))
    g = labels.groupBy(F.coalesce(readers.label_rejects(labels), F.lit("ok")).alias("reject"))
    return g.agg(F.count(F.lit(1)).alias("n_rows"), rnd(F.sum("y"), 2, "sum_y"))


@query("src5_draw_grid", build("SELECT fit, chain, count(*) AS n_draws, min(draw) = 0 AND max(draw) = count(*) - 1 AS dense FROM draws GROUP BY 1, 2"))
def src5(spark, sf):
    return readers.draw_grid(base.draws(spark, sf))


@query("src6_file_inventory")
def src6(spark, sf):
    return readers.file_inventory(spark, sf).select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), "bytes", "sha256")


@query(
    "snk3_paired_table",
    build("SELECT entity_id, " + ", ".join(
        f"round(max(CASE WHEN method = '{m}' THEN {c} END), 6) AS {m}_{c}" for m in ("full", "last30") for c in ("lower", "median", "upper")) + " FROM fc GROUP BY 1"),
)
def snk3(spark, sf):
    wide = sinks.paired_table(base.forecasts(spark, sf), ["full", "last30"], ["lower", "median", "upper"])
    return wide.select("entity_id", *[rnd(f"{m}_{c}") for m in ("full", "last30") for c in ("lower", "median", "upper")])


# ---------------------------------------------------------------- validation


@query("val1_duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def val1(spark, sf):
    return quality.duplicate_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "val2_cycle_gaps",
    "SELECT l_orderkey AS entity_id, min(l_linenumber) AS first_cycle, max(l_linenumber) AS last_cycle, count(*) AS n_rows, count(DISTINCT l_linenumber) AS n_cycles, "
    "min(l_linenumber) = 1 AND max(l_linenumber) = count(*) AND count(DISTINCT l_linenumber) = count(*) AS complete FROM lineitem GROUP BY 1",
)
def val2(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("entity_id"), F.col("l_linenumber").alias("cycle"))
    return quality.cycle_gaps(rows)


@query(
    "val3_finite_gate",
    "SELECT l_returnflag, count(*) AS n_rows, count(*) FILTER (WHERE isnan(v) OR isinf(v) OR v IS NULL) AS bad_v, "
    "count(*) FILTER (WHERE isnan(l_tax) OR isinf(l_tax) OR l_tax IS NULL) AS bad_l_tax, "
    "CASE WHEN count(*) FILTER (WHERE isnan(v) OR isinf(v) OR v IS NULL) > 0 THEN 'FAIL' ELSE 'PASS' END AS status "
    "FROM (SELECT *, CASE WHEN l_returnflag = 'R' AND l_discount = 0 THEN NULL ELSE ln(l_quantity) END AS v FROM lineitem) GROUP BY 1",
)
def val3(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("v", F.when(~((F.col("l_returnflag") == "R") & (F.col("l_discount") == 0)), F.log("l_quantity")))
    return quality.finite_gate(rows, ["v", "l_tax"], ["l_returnflag"])


_PROFILE = " UNION ALL ".join(f"SELECT '{c}' AS channel, round(min({c}), 6) AS low, round(max({c}), 6) AS high, round(var_pop({c}), 4) AS variance FROM s_traj" for c in CHANNELS)


@query("val4_channel_profile", build(_PROFILE))
def val4(spark, sf):
    return quality.channel_profile(base.shipments(spark, sf), CHANNELS).select("channel", rnd("low"), rnd("high"), rnd("variance", 4))


@query("val4_lifetime_profile", build("SELECT sum(lifetime)::BIGINT AS n_rows, count(*) AS n_entities, min(lifetime) AS lifetime_min, quantile_cont(lifetime::DOUBLE, 0.5) AS lifetime_median, max(lifetime) AS lifetime_max FROM u_life"))
def val4b(spark, sf):
    lives = table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("lifetime"))
    median = linear_quantiles(lives, [], "lifetime", {"lifetime_median": 0.5}).select("lifetime_median", F.lit(0).alias("_k"))
    whole = lives.agg(F.sum("lifetime").alias("n_rows"), F.count(F.lit(1)).alias("n_entities"), F.min("lifetime").alias("lifetime_min"), F.max("lifetime").alias("lifetime_max"))
    return whole.withColumn("_k", F.lit(0)).join(median, "_k").drop("_k")


@query(
    "val5_profile_against_stored",
    build("SELECT channel, 'variance' AS \"column\", round(v, 4) AS left_value, round(s, 4) AS right_value, 'differs' AS reason FROM ("
          + " UNION ALL ".join(f"SELECT '{c}' AS channel, var_pop({c}) AS v, var_pop({c}) FILTER (WHERE cycle > 1) AS s FROM s_traj" for c in CHANNELS) + ") WHERE abs(v - s) > 1e-12"),
)
def val5(spark, sf):
    """The stored profile was taken without each supplier's first row, so the variances must be flagged."""
    rows = base.ship_cycles(spark, sf)
    diff = quality.compare_tables(quality.channel_profile(rows, CHANNELS), quality.channel_profile(rows.filter("cycle > 1"), CHANNELS), ["channel"], ["variance"], atol=1e-12)
    return diff.select("channel", "column", rnd("left_value", 4), rnd("right_value", 4), "reason")


@query(
    "val6_prefix_integrity",
    build("SELECT entity_id, cutoff, count(*) AS n_rows, max(cycle) AS last_cycle, CASE WHEN count(*) = cutoff AND max(cycle) <= cutoff THEN 'PASS' ELSE 'FAIL' END AS status FROM u_prefix GROUP BY 1, 2"),
)
def val6(spark, sf):
    prefix = base.read_prefix(spark, sf)
    return quality.prefix_integrity(prefix, base.read_entities(spark, sf).filter("eligible"))


@query(
    "val7_manifest_mismatches",
    build("SELECT entity_id, list_aggregate(list_filter([CASE WHEN role = 'tune' THEN 'unlisted' END, CASE WHEN role <> 'tune' AND entity_id % 13 = 0 THEN 'cutoff_mismatch' END, "
          "CASE WHEN role <> 'tune' AND entity_id % 13 = 0 AND eligible <> (cutoff + 20 < lifetime) THEN 'eligible_mismatch' END], lambda x: x IS NOT NULL), 'string_agg', ',') AS reasons "
          "FROM u_ent WHERE role = 'tune' OR entity_id % 13 = 0"),
)
def val7(spark, sf):
    """The stored manifest lacks the tuning role and moved some cutoffs by 20 cycles."""
    ents = base.read_entities(spark, sf)
    moved = F.when(F.col("entity_id") % 13 == 0, F.col("cutoff") + 20).otherwise(F.col("cutoff"))
    stored = assign.with_eligibility(ents.filter("role <> 'tune'").withColumn("cutoff", moved))
    return quality.manifest_mismatches(ents, stored).select("entity_id", F.concat_ws(",", "reasons").alias("reasons"))


_VAL8_SRC = "SELECT method, entity_id, CASE WHEN method = 'last30' AND entity_id % 10 = 4 THEN upper ELSE lower END AS lower, median - 20000 AS median, CASE WHEN method = 'last30' AND entity_id % 10 = 4 THEN lower ELSE upper END AS upper FROM fc WHERE NOT (method = 'last30' AND role = 'tune')"


@query(
    "val8_prediction_gate",
    build("SELECT method, count(*) AS n_rows, 0::BIGINT AS n_nonfinite, count(*) FILTER (WHERE lower < 0) AS n_negative_lower, count(*) FILTER (WHERE lower > upper) AS n_crossed, "
          "count(*) FILTER (WHERE median < 0) AS n_negative_median, 0::BIGINT AS n_unknown, 0::BIGINT AS n_repeated, (SELECT count(*) FROM s_ent) AS n_cohort, "
          "(SELECT count(*) FROM s_ent) - count(*) AS n_missing, "
          "CASE WHEN (SELECT count(*) FROM s_ent) - count(*) > 0 OR count(*) FILTER (WHERE lower > upper) > 0 OR count(*) FILTER (WHERE lower < 0) > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM v8 GROUP BY 1", {"v8": _VAL8_SRC}),
)
def val8(spark, sf):
    """Predictions with crossed intervals and missing ids in one method."""
    fc = base.forecasts(spark, sf)
    swap = (F.col("method") == "last30") & (F.col("entity_id") % 10 == 4)
    pred = fc.filter(~((F.col("method") == "last30") & (F.col("role") == "tune"))).select(
        "method", "entity_id", F.when(swap, F.col("upper")).otherwise(F.col("lower")).alias("lower"), (F.col("median") - 20000).alias("median"),
        F.when(swap, F.col("lower")).otherwise(F.col("upper")).alias("upper"),
    )
    return quality.prediction_gate(pred, base.ship_entities(spark, sf))


@query(
    "val9_identical_tables",
    build("SELECT count(*) FILTER (WHERE a.entity_id IS NOT NULL AND b.entity_id IS NOT NULL AND a.l = b.l AND a.m = b.m AND a.u = b.u) AS identical, "
          "count(*) FILTER (WHERE a.entity_id IS NOT NULL AND b.entity_id IS NOT NULL AND NOT (a.l = b.l AND a.m = b.m AND a.u = b.u)) AS changed, "
          "count(*) FILTER (WHERE a.entity_id IS NULL) AS only_right, count(*) FILTER (WHERE b.entity_id IS NULL) AS only_left "
          "FROM (SELECT entity_id, full_q[1] AS l, full_q[2] AS m, full_q[3] AS u FROM fc_wide) a FULL OUTER JOIN "
          "(SELECT entity_id, last_q[1] AS l, last_q[2] AS m, last_q[3] AS u FROM fc_wide WHERE role <> 'tune') b ON a.entity_id = b.entity_id"),
)
def val9(spark, sf):
    """Identity of the two methods: equal exactly where the prefix is no longer than the window."""
    fc = base.forecasts(spark, sf)
    values = ["lower", "median", "upper"]
    return quality.identical_tables(fc.filter("method = 'full'"), fc.filter("method = 'last30' AND role <> 'tune'"), ["entity_id"], values)


cte("ev_rows", "SELECT l_orderkey AS campaign, l_linenumber AS event, min(l_returnflag) AS kind, count(*) AS n, sum(l_partkey)::BIGINT AS parts, max(l_suppkey) AS supp FROM lineitem GROUP BY 1, 2")
cte("ev_text", "SELECT *, campaign || '|' || event || '|' || kind || '|' || parts AS payload FROM ev_rows")
cte("ev_full", "SELECT a.*, CASE WHEN a.supp % 17 = 0 THEN 'forged' ELSE sha256(b.payload) END AS previous_sha256 FROM ev_text a LEFT JOIN ev_text b ON b.campaign = a.campaign AND b.event = a.event - 1")


@query(
    "val11_event_chain",
    build("SELECT reason, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN NOT first AND p.event IS NULL THEN 'gap' END, "
          "CASE WHEN p.event IS NOT NULL AND j.previous_sha256 IS DISTINCT FROM sha256(p.payload) THEN 'hash_mismatch' END, CASE WHEN first AND j.event <> 1 THEN 'first_not_one' END, CASE WHEN j.kind = 'R' THEN 'forbidden_kind' END], lambda x: x IS NOT NULL)) AS reason "
          "FROM (SELECT *, event = min(event) OVER (PARTITION BY campaign) AS first FROM ev_full) j LEFT JOIN ev_full p ON p.campaign = j.campaign AND p.event = j.event - 1) GROUP BY 1"),
)
def val11(spark, sf):
    """An order is a campaign and its line numbers the events; suppliers divisible by 17 forged their hash."""
    li = table(spark, sf, "lineitem")
    rows = li.groupBy(F.col("l_orderkey").alias("campaign"), F.col("l_linenumber").alias("event")).agg(
        F.min("l_returnflag").alias("kind"), F.sum("l_partkey").alias("parts"), F.max("l_suppkey").alias("supp")
    )
    text = rows.withColumn("payload", F.concat_ws("|", "campaign", "event", "kind", "parts"))
    prior = text.select("campaign", (F.col("event") + 1).alias("event"), F.sha2("payload", 256).alias("_h"))
    full = text.join(prior, ["campaign", "event"], "left").withColumn("previous_sha256", F.when(F.col("supp") % 17 == 0, "forged").otherwise(F.col("_h")))
    bad = quality.chain_verification(full, forbidden=["R"])
    return bad.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query(
    "val12_gate_table",
    build("SELECT entity_id, list_aggregate(list_filter([CASE WHEN avg(c2) < 40000 THEN 'low_mean' END, CASE WHEN count(*) > 600 THEN 'too_long' END, CASE WHEN max(tax) < 0.08 THEN 'tax' END], lambda x: x IS NOT NULL), 'string_agg', ',') AS reasons, "
          "CASE WHEN avg(c2) < 40000 OR count(*) > 600 OR max(tax) < 0.08 THEN 'FAIL' ELSE 'PASS' END AS status FROM s_traj GROUP BY 1"
          ).replace("list_aggregate(", "coalesce(list_aggregate(").replace("'string_agg', ',')", "'string_agg', ','), '')"),
)
def val12(spark, sf):
    g = base.shipments(spark, sf).groupBy("entity_id").agg(F.avg("c2").alias("m"), F.count(F.lit(1)).alias("n"), F.max("tax").alias("t"))
    out = quality.gate(g, {"low_mean": F.col("m") < 40000, "too_long": F.col("n") > 600, "tax": F.col("t") < 0.08})
    return out.select("entity_id", F.concat_ws(",", "reasons").alias("reasons"), "status")


_ROWH = "sha256(l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_suppkey || '|' || l_returnflag)"


@query(
    "val13_fingerprint",
    "SELECT l_linestatus, n_rows, sha256(n_rows || '|' || " + " || '|' || ".join(f"s{i}" for i in range(8)) + ") AS sha256 FROM (SELECT l_linestatus, count(*) AS n_rows, "
    + ", ".join(f"sum(('0x' || substr(h, {8 * i + 1}, 8))::BIGINT)::HUGEINT AS s{i}" for i in range(8)) + f" FROM (SELECT *, {_ROWH} AS h FROM lineitem) GROUP BY 1)",
)
def val13(spark, sf):
    return quality.fingerprint(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"], ["l_linestatus"])


# ---------------------------------------------------------------- assignment


@query("asg1_hash_mod", f"SELECT o_orderkey, {hash_mod(chr(39) + 'cutoff' + chr(39), 'o_orderkey', 221)} AS h, {hash_mod(chr(39) + 'wide' + chr(39), 'o_orderkey', 2147483647)} AS h_wide FROM orders")
def asg1(spark, sf):
    from varve.functions.hashing import hash_mod as hm

    return table(spark, sf, "orders").select("o_orderkey", hm(SEED, "cutoff", F.col("o_orderkey"), 221).alias("h"), hm(SEED, "wide", F.col("o_orderkey"), 2147483647).alias("h_wide"))


_CUST_HASH = "SELECT c_custkey AS entity_id, row_number() OVER (ORDER BY " + digest(repr(SEED), "'split'", "CAST(c_custkey AS VARCHAR)") + ", c_custkey) AS split_rank, count(*) OVER () AS n_all FROM customer"


@query(
    "asg2_role_split",
    build("SELECT entity_id, split_rank, CASE WHEN split_rank <= floor(n_all * 55 / 100) THEN 'fit' WHEN split_rank <= floor(n_all * 70 / 100) THEN 'tune' ELSE 'calibration' END AS role FROM ch", {"ch": _CUST_HASH}),
)
def asg2(spark, sf):
    ids = table(spark, sf, "customer").select(F.col("c_custkey").alias("entity_id"))
    return assign.assign_roles(ids, SEED).select("entity_id", "split_rank", "role")


@query("asg3_cutoffs", build("SELECT entity_id, cutoff FROM s_hash"))
def asg3(spark, sf):
    return base.ship_entities(spark, sf).select("entity_id", "cutoff")


@query("asg4_alternate_cutoffs", build(f"SELECT entity_id, cutoff, {READ_LOW} + {hash_mod(chr(39) + 'salt-7' + chr(39), 'entity_id', READ_WIDTH)} AS alternate FROM u_hash"))
def asg4(spark, sf):
    ents = base.read_entities(spark, sf)
    return ents.select("entity_id", "cutoff", assign.alternate_cutoff_column(SEED, "salt-7", READ_LOW, READ_WIDTH).alias("alternate"))


@query("asg5_eligibility", build("SELECT entity_id, role, cutoff, lifetime, eligible FROM u_ent"))
def asg5(spark, sf):
    return base.read_entities(spark, sf).select("entity_id", "role", "cutoff", "lifetime", "eligible")


@query("asg6_endpoint_cutoffs", build("SELECT entity_id, max(cycle) AS cutoff FROM u_traj GROUP BY 1"))
def asg6(spark, sf):
    return assign.endpoint_cutoffs(base.read_cycles(spark, sf))


REPLICATES = 10
cte("rost", "SELECT role, entity_id, eligible, row_number() OVER (PARTITION BY role ORDER BY entity_id) AS slot, count(*) OVER (PARTITION BY role) AS n_role FROM u_ent")
cte(
    "boot",
    f"SELECT d.replicate, d.role, d.slot, r.entity_id, r.eligible FROM (SELECT replicate, role, slot, 1 + {digest_mod('h', 'n_role')} AS pick FROM "
    f"(SELECT *, sha256('{SEED}|' || replicate || '|' || role || '|' || slot) AS h FROM rost, range(1, {REPLICATES + 1}) g(replicate))) d JOIN rost r ON r.role = d.role AND r.slot = d.pick",
)
cte("mult", "SELECT replicate, role, entity_id, eligible, count(*) AS multiplicity FROM boot GROUP BY 1, 2, 3, 4")


def _boot(spark, sf):
    return assign.bootstrap_draws(assign.role_rosters(base.read_entities(spark, sf)), REPLICATES, SEED)


@query("asg7_role_bootstrap", build("SELECT replicate, role, slot, entity_id FROM boot"))
def asg7(spark, sf):
    return _boot(spark, sf).select("replicate", "role", "slot", "entity_id")


@query(
    "asg8_stage_summary",
    build("SELECT replicate, role, sum(multiplicity)::BIGINT AS draws, count(*) AS unique_drawn, count(*) FILTER (WHERE eligible) AS eligible_unique, coalesce(sum(multiplicity) FILTER (WHERE eligible), 0)::BIGINT AS eligible_draws, "
          "CASE role WHEN 'fit' THEN 20 WHEN 'tune' THEN 5 ELSE 9 END AS minimum_unique, CASE WHEN count(*) FILTER (WHERE eligible) < CASE role WHEN 'fit' THEN 20 WHEN 'tune' THEN 5 ELSE 9 END THEN 'FAIL' ELSE 'PASS' END AS status FROM mult GROUP BY 1, 2"),
)
def asg8(spark, sf):
    return assign.stage_summary(assign.stage_multiplicities(_boot(spark, sf)), base.read_entities(spark, sf))


@query("asg9_anchor_cohort", build("SELECT entity_id, role, cutoff FROM u_ent WHERE role = 'calibration' AND eligible"))
def asg9(spark, sf):
    marks = base.read_entities(spark, sf).withColumn("y", features.log_remaining(F.col("lifetime"), F.col("cutoff")))
    return assign.anchor_cohort(marks, outcome=("y", "lifetime", "eligible", "split_rank"))


# ---------------------------------------------------------------- design audit


@query(
    "aud1_role_counts",
    build("SELECT role, count(*) AS reserved, count(*) FILTER (WHERE eligible) AS eligible, count(*) FILTER (WHERE NOT eligible) AS ineligible, round(count(*) FILTER (WHERE eligible) / count(*), 6) AS eligible_fraction, "
          "quantile_cont(cutoff::DOUBLE, 0.5) FILTER (WHERE eligible) AS median_cutoff, quantile_cont(lifetime::DOUBLE, 0.5) FILTER (WHERE eligible) AS median_lifetime FROM u_ent GROUP BY 1"),
)
def aud1(spark, sf):
    return audit.role_counts(base.written_entities(spark, sf)).select("role", "reserved", "eligible", "ineligible", rnd("eligible_fraction"), "median_cutoff", "median_lifetime")


cte("bands", f"SELECT b AS band, {READ_LOW} + b * {READ_WIDTH} // 5 AS min_cutoff, {READ_LOW} + (b + 1) * {READ_WIDTH} // 5 - 1 AS max_cutoff FROM range(5) t(b)")
cte("role_dim", "SELECT unnest(['fit', 'tune', 'calibration']) AS role")


@query(
    "aud2_cutoff_bands",
    build("SELECT b.band::INT AS band, r.role, b.min_cutoff, b.max_cutoff, count(e.entity_id) AS assigned, count(e.entity_id) FILTER (WHERE e.eligible) AS eligible "
          "FROM bands b CROSS JOIN (SELECT role FROM role_dim UNION ALL SELECT 'all') r LEFT JOIN u_ent e ON e.cutoff BETWEEN b.min_cutoff AND b.max_cutoff AND (r.role = 'all' OR e.role = r.role) GROUP BY 1, 2, 3, 4"),
)
def aud2(spark, sf):
    return audit.cutoff_bands(base.read_entities(spark, sf), READ_LOW, READ_WIDTH)


cte("quart", "SELECT *, least(3, (row_number() OVER (ORDER BY lifetime, entity_id) - 1) * 4 // count(*) OVER ())::INT AS quartile FROM u_ent")


@query("aud3_lifetime_quartiles", build("SELECT entity_id, lifetime, quartile FROM quart"))
def aud3(spark, sf):
    return audit.lifetime_quartiles(base.written_entities(spark, sf)).select("entity_id", "lifetime", "quartile")


@query(
    "aud4_quartile_tables",
    build("SELECT q.quartile::INT AS quartile, r.role, count(e.entity_id) AS assigned, count(e.entity_id) FILTER (WHERE e.eligible) AS eligible, min(e.lifetime) AS lifetime_min, max(e.lifetime) AS lifetime_max "
          "FROM range(4) q(quartile) CROSS JOIN (SELECT role FROM role_dim UNION ALL SELECT 'all') r LEFT JOIN quart e ON e.quartile = q.quartile AND (r.role = 'all' OR e.role = r.role) GROUP BY 1, 2"),
)
def aud4(spark, sf):
    return audit.quartile_tables(audit.lifetime_quartiles(base.written_entities(spark, sf)))


@query("aud4_quartile_medians", build("SELECT quartile, count(*) AS n, quantile_cont(lifetime::DOUBLE, 0.5) AS lifetime_median, quantile_cont(cutoff::DOUBLE, 0.5) AS cutoff_median FROM quart GROUP BY 1"))
def aud4b(spark, sf):
    return audit.quartile_medians(audit.lifetime_quartiles(base.written_entities(spark, sf)))


cte("assoc", "SELECT 'all' AS cohort, cutoff, lifetime FROM u_ent UNION ALL SELECT 'eligible', cutoff, lifetime FROM u_ent WHERE eligible")
cte("assoc_rank", "SELECT *, rank() OVER (PARTITION BY cohort ORDER BY cutoff) + (count(*) OVER (PARTITION BY cohort, cutoff) - 1) / 2 AS rx, rank() OVER (PARTITION BY cohort ORDER BY lifetime) + (count(*) OVER (PARTITION BY cohort, lifetime) - 1) / 2 AS ry FROM assoc")


@query("aud5_cutoff_lifetime_association", build("SELECT cohort, count(*) AS n, round(corr(cutoff, lifetime), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM assoc_rank GROUP BY 1"))
def aud5(spark, sf):
    return audit.cutoff_lifetime_association(base.written_entities(spark, sf)).select("cohort", "n", rnd("pearson"), rnd("spearman"))


_SENS_HASH = digest(repr(SEED), "'cutoff-sensitivity-' || lpad(CAST(scenario AS VARCHAR), 3, '0')", "CAST(entity_id AS VARCHAR)")
cte("sens", f"SELECT entity_id, role, eligible, scenario, {READ_LOW} + {digest_mod('h', READ_WIDTH)} < lifetime AS alternate FROM (SELECT *, {_SENS_HASH} AS h FROM u_ent, range(1, 101) g(scenario))")
cte("sens_n", "SELECT role, scenario, count(*) FILTER (WHERE alternate) AS eligible FROM sens GROUP BY 1, 2 UNION ALL SELECT 'all', scenario, count(*) FILTER (WHERE alternate) FROM sens GROUP BY 2")


@query(
    "aud6_sensitivity_by_role",
    build("SELECT role, min(eligible) AS min, round(avg(eligible), 6) AS mean, max(eligible) AS max, count(*) AS n, quantile_cont(eligible::DOUBLE, 0.25) AS q1, quantile_cont(eligible::DOUBLE, 0.5) AS median, quantile_cont(eligible::DOUBLE, 0.75) AS q3 FROM sens_n GROUP BY 1"),
)
def aud6(spark, sf):
    flags = audit.sensitivity_flags(base.read_entities(spark, sf), SEED, READ_LOW, READ_WIDTH)
    return audit.sensitivity_by_role(flags).withColumn("mean", rnd("mean"))


@query(
    "aud6_sensitivity_by_entity",
    build("SELECT entity_id, role, eligible, count(*) FILTER (WHERE alternate) AS selected, count(*) FILTER (WHERE alternate <> eligible) AS mismatches, count(*) FILTER (WHERE alternate) / 100 AS frequency, "
          "count(*) FILTER (WHERE alternate) > 0 AND count(*) FILTER (WHERE alternate) < 100 AS unstable FROM sens GROUP BY 1, 2, 3"),
)
def aud6b(spark, sf):
    return audit.sensitivity_by_entity(audit.sensitivity_flags(base.read_entities(spark, sf), SEED, READ_LOW, READ_WIDTH))


@query("aud7_channel_scales", build("SELECT " + ", ".join(f"round(CASE WHEN stddev_pop({c}) > 1e-12 THEN stddev_pop({c}) ELSE 1 END, 6) AS scale_{c}" for c in CHANNELS) + " FROM s_prefix"))
def aud7(spark, sf):
    s = linear.channel_scales(base.ship_prefix(spark, sf), CHANNELS)
    return s.select(*[rnd(f"scale_{c}") for c in CHANNELS])


cte("sc", "SELECT " + ", ".join(f"CASE WHEN stddev_pop({c}) > 1e-12 THEN stddev_pop({c}) ELSE 1 END AS k_{c}" for c in CHANNELS) + " FROM s_prefix")
cte(
    "pairs8",
    "SELECT a.entity_id AS a, b.entity_id AS b, least(a.cutoff, b.cutoff) AS common_cycles, " + ", ".join(f"sum(((a.{c} - b.{c}) / k_{c}) ** 2) / least(a.cutoff, b.cutoff) AS ms_{c}" for c in CHANNELS)
    + " FROM s_prefix a JOIN s_prefix b ON a.cycle = b.cycle AND a.entity_id < b.entity_id, sc WHERE least(a.cutoff, b.cutoff) >= 30 GROUP BY 1, 2, 3",
)
_MEAN8 = "sqrt((" + " + ".join(f"ms_{c}" for c in CHANNELS) + ") / 4)"
_MAX8 = "sqrt(greatest(" + ", ".join(f"ms_{c}" for c in CHANNELS) + "))"


@query(
    "aud8_exact_prefix_groups",
    build("SELECT (SELECT count(*) FROM s_ent WHERE eligible) AS n_entities, (SELECT count(*) FROM pairs8) AS pair_comparisons, (SELECT count(*) FROM pairs8 WHERE " + " AND ".join(f"ms_{c} = 0" for c in CHANNELS) + ") AS exact_pairs, "
          f"(SELECT count(*) FROM pairs8 WHERE {_MEAN8} > 0 AND {_MEAN8} <= 0.02 AND {_MAX8} <= 0.10) AS near_pairs"),
)
def aud8(spark, sf):
    """Duplicate screen at the default limits: entities, comparable pairs, exact and near pairs."""
    prefix = checkpointed(base.ship_prefix(spark, sf))
    long_enough = F.count_if(F.col("cutoff") >= audit.MIN_COMMON)
    n = prefix.filter("cycle = 1").agg(F.count(F.lit(1)).alias("n_entities"), (long_enough * (long_enough - 1) / 2).cast("long").alias("pair_comparisons"))
    exact = audit.exact_groups(prefix, CHANNELS).agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("exact_pairs"))
    near = audit.near_pairs(prefix, None, linear.channel_scales(prefix, CHANNELS), CHANNELS).agg(
        F.coalesce(F.sum(F.col("copies_a") * F.col("copies_b")), F.lit(0)).alias("near_pairs"))
    one = lambda df: df.withColumn("_k", F.lit(0))
    return one(n).join(one(exact), "_k").join(one(near), "_k").drop("_k")


# Planted from table rows, by id: near copies at growing distances and a few exact copies, under ids of their own.
_PLANT8 = 1_000_000_000
cte("plant8", f"SELECT entity_id, cutoff, cycle, {', '.join(CHANNELS)} FROM s_prefix UNION ALL SELECT entity_id + {_PLANT8}, cutoff, cycle, CASE WHEN entity_id % 50 = 1 THEN c1 ELSE c1 * (1.0::DOUBLE + 0.001::DOUBLE * (1 + entity_id % 97)) END, "
    + ", ".join(CHANNELS[1:]) + " FROM s_prefix WHERE entity_id % 4 = 0 OR entity_id % 50 = 1")
cte("sc8p", "SELECT " + ", ".join(f"CASE WHEN stddev_pop({c}) > 1e-12 THEN stddev_pop({c}) ELSE 1 END AS k_{c}" for c in CHANNELS) + " FROM plant8")
cte(
    "pairs8p",
    "SELECT a.entity_id AS a, b.entity_id AS b, least(a.cutoff, b.cutoff) AS common_cycles, " + ", ".join(f"sum(((a.{c} - b.{c}) / k_{c}) ** 2) / least(a.cutoff, b.cutoff) AS ms_{c}" for c in CHANNELS)
    + " FROM plant8 a JOIN plant8 b ON a.cycle = b.cycle AND a.entity_id < b.entity_id, sc8p WHERE least(a.cutoff, b.cutoff) >= 30 GROUP BY 1, 2, 3",
)


def _planted8(spark, sf):
    prefix = checkpointed(base.ship_prefix(spark, sf).select("entity_id", "cutoff", "cycle", *CHANNELS))
    exact = F.col("entity_id") % 50 == 1
    factor = F.when(exact, F.lit(1.0)).otherwise(F.lit(1.0) + F.lit(0.001) * (1 + F.col("entity_id") % 97))
    copies = prefix.filter((F.col("entity_id") % 4 == 0) | exact).select((F.col("entity_id") + _PLANT8).alias("entity_id"), "cutoff", "cycle", (F.col("c1") * factor).alias("c1"), *CHANNELS[1:])
    return prefix.unionByName(copies)


@query(
    "aud8_planted_screen",
    build("SELECT count(*) FILTER (WHERE " + " AND ".join(f"ms_{c} = 0" for c in CHANNELS) + f") AS exact_pairs, count(*) FILTER (WHERE {_MEAN8} > 0 AND {_MEAN8} <= 0.02 AND {_MAX8} <= 0.10) AS near_pairs FROM pairs8p"),
)
def aud8_planted(spark, sf):
    """The screen of aud8 over histories with planted copies: exact pairs and near ones."""
    planted = _planted8(spark, sf)
    exact = audit.exact_groups(planted, CHANNELS).agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("exact_pairs")).withColumn("_k", F.lit(0))
    near = audit.near_pairs(planted, None, linear.channel_scales(planted, CHANNELS), CHANNELS).agg(
        F.coalesce(F.sum(F.col("copies_a") * F.col("copies_b")), F.lit(0)).alias("near_pairs")).withColumn("_k", F.lit(0))
    return exact.join(near, "_k").drop("_k")


@query(
    "aud8_closest_pairs",
    build(f"SELECT a, b, common_cycles, round({_MEAN8}, 6) AS mean_nrmse, round({_MAX8}, 6) AS max_channel_nrmse FROM pairs8p ORDER BY {_MEAN8}, {_MAX8}, common_cycles DESC, a, b LIMIT 5"),
)
def aud8_closest(spark, sf):
    """The five closest pairs of histories among those of aud8_planted_screen, exact copies first."""
    planted = _planted8(spark, sf)
    top = audit.closest_pairs(planted, linear.channel_scales(planted, CHANNELS), CHANNELS)
    return top.select("a", "b", "common_cycles", rnd("mean_nrmse"), rnd("max_channel_nrmse"))


@query(
    "aud9_cross_table_screen",
    build("SELECT count(*) AS comparisons, count(*) FILTER (WHERE d = 0) AS exact_pairs FROM (SELECT a.entity_id AS a, b.entity_id AS b, sum(abs(a.c1 - b.c1) + abs(a.c2 - b.c2)) AS d "
          "FROM u_prefix a JOIN u_traj b ON a.cycle = b.cycle GROUP BY 1, 2)"),
)
def aud9(spark, sf):
    """Openings shared between the cut histories of eligible users and the whole histories of all users:
    everyone must meet at least themselves."""
    left = checkpointed(base.read_prefix(spark, sf))
    everyone = base.read_entities(spark, sf).select("entity_id", F.col("lifetime").alias("cutoff"))
    # no common history is longer than the longest cutoff, so nothing after it is needed
    bound = everyone.withColumn("upto", F.lit(READ_LOW + READ_WIDTH))
    right = dense_index(base.readings(spark, sf), ["entity_id"], base.READ_CELLS, base.READ_ORDER, "cycle", bound)
    hits = audit.cross_exact_groups(left, right, READ_CHANNELS).agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("exact_pairs"))
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name)).withColumn("_k", F.lit(0))
    sizes = count(left.filter("cycle = 1"), "_l").join(count(everyone, "_r"), "_k").join(hits.withColumn("_k", F.lit(0)), "_k")
    return sizes.select((F.col("_l") * F.col("_r")).alias("comparisons"), "exact_pairs")


# Planted from table rows, by id: near copies, exact copies, and histories that meet only by chance.
_PLANT9 = (1.001, 1.0, 3.0)
_MS9 = ", ".join(f"sum(((a.{c} - b.{c}) / k_{c}) ** 2) / count(*) AS ms_{c}" for c in READ_CHANNELS)
cte("sc9", "SELECT " + ", ".join(f"CASE WHEN stddev_pop({c}) > 1e-12 THEN stddev_pop({c}) ELSE 1 END AS k_{c}" for c in READ_CHANNELS) + " FROM u_prefix")
cte("plant9", "SELECT entity_id, cycle, c1 * CASE entity_id % 3 WHEN 0 THEN {!r} WHEN 1 THEN {!r} ELSE {!r} END AS c1, c2 FROM u_traj".format(*_PLANT9))
cte("pairs9", f"SELECT a.entity_id AS a, b.entity_id AS b, count(*) AS common_cycles, {_MS9} FROM u_prefix a JOIN plant9 b ON a.cycle = b.cycle, sc9 GROUP BY 1, 2")
cte("hits9", "SELECT count(*) FILTER (WHERE ms_c1 = 0 AND ms_c2 = 0) AS exact_pairs, count(*) FILTER (WHERE common_cycles >= 30 AND ms_c1 + ms_c2 > 0 AND sqrt((ms_c1 + ms_c2) / 2) <= 0.02 AND sqrt(greatest(ms_c1, ms_c2)) <= 0.10) AS near_pairs FROM pairs9")


@query("aud9_cross_table_gate", build("SELECT exact_pairs, near_pairs, CASE WHEN exact_pairs > 0 OR near_pairs > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM hits9"))
def aud9b(spark, sf):
    """Exact and near openings shared between the cut histories of eligible users and histories with planted copies, and the gate's status."""
    left = checkpointed(base.read_prefix(spark, sf))
    everyone = base.read_entities(spark, sf).select("entity_id", F.col("lifetime").alias("cutoff"))
    bound = everyone.withColumn("upto", F.lit(READ_LOW + READ_WIDTH))
    right = dense_index(base.readings(spark, sf), ["entity_id"], base.READ_CELLS, base.READ_ORDER, "cycle", bound)
    kind = F.col("entity_id") % 3
    factor = F.when(kind == 0, F.lit(_PLANT9[0])).when(kind == 1, F.lit(_PLANT9[1])).otherwise(F.lit(_PLANT9[2]))
    planted = checkpointed(right.withColumn("c1", F.col("c1") * factor).select("entity_id", "cycle", "cutoff", *READ_CHANNELS))
    return audit.cross_screen(left, planted, linear.channel_scales(left, READ_CHANNELS), READ_CHANNELS)
