import hashlib

import pytest
from pyspark.sql import functions as F

from varve.operators import assign


@pytest.fixture(scope="module")
def entities(spark):
    e = spark.range(1, 101).select(F.col("id").alias("entity_id"), F.lit(150).alias("lifetime"))
    e = assign.assign_roles(e, "seed").withColumn("cutoff", assign.cutoff_column("seed", 30, 221))
    return assign.with_eligibility(e).cache()


def test_split_and_cutoffs_rederived(entities):
    digest = lambda tag, i: hashlib.sha256(f"seed|{tag}|{i}".encode()).hexdigest()
    order = sorted(range(1, 101), key=lambda i: digest("split", i))
    for r in entities.collect():
        k = order.index(r.entity_id)
        assert r.role == ("fit" if k < 55 else "tune" if k < 70 else "calibration")
        assert r.cutoff == 30 + int(digest("cutoff", r.entity_id), 16) % 221
        assert r.eligible == (r.cutoff < 150)


def test_salt_rules():
    for bad in ("", "  ", "a|b", None):
        with pytest.raises(ValueError):
            assign.alternate_cutoff_column("seed", bad, 30, 221)
    with pytest.raises(ValueError):
        assign.alternate_cutoff_column("seed", "x", 30, 221, mode="canonical")


def test_bootstrap_keeps_role_sizes_and_gate_keeps_failures(spark, entities):
    draws = assign.bootstrap_draws(assign.role_rosters(entities), 3, "b")
    sizes = {(r.replicate, r.role): r["count"] for r in draws.groupBy("replicate", "role").count().collect()}
    assert all(sizes[(k, role)] == n for k in (1, 2, 3) for role, n in (("fit", 55), ("tune", 15), ("calibration", 30)))
    again = assign.bootstrap_draws(assign.role_rosters(entities), 3, "b")
    assert draws.exceptAll(again).isEmpty()
    none = entities.withColumn("eligible", F.col("eligible") & (F.col("role") != "tune"))
    summary = {r.role: r for r in assign.stage_summary(assign.stage_multiplicities(draws), none).filter("replicate = 1").collect()}
    assert summary["tune"].status == "FAIL" and summary["tune"].draws == 15 and summary["tune"].eligible_draws == 0


def test_anchor_has_no_outcome_and_barrier_needs_a_frozen_record(spark, entities):
    marks = entities.withColumn("y", F.lit(1.0))
    assert "y" not in assign.anchor_cohort(marks).columns
    cal = marks.withColumn("dataset", F.lit("d"))
    frozen = lambda f: spark.createDataFrame([("d", "c", f)], "dataset string, candidate_id string, frozen boolean")
    assert assign.behind_selection(cal, frozen(False)).isEmpty()
    assert assign.behind_selection(cal, frozen(True)).count() == 100
