"""Resampled corrections at sizes where the exploded rows must not be joined, broadcast or ranked as a whole."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from varve.operators import assign, conformal, stats


def _scores(spark, n=400):
    rng = np.random.default_rng(5)
    rows = [(m, i, float(round(rng.normal(), 1 if m == "a" else 6))) for m in "ab" for i in range(n)]
    return spark.createDataFrame(rows, "method string, entity_id long, score double")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("\n")


def _explodes_below_broadcast(lines):
    """Is a row per (row, replicate) made below a broadcast?"""
    depth = lambda line: len(line) - len(line.lstrip(" :+-*()0123456789"))
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            for below in lines[i + 1:]:
                if depth(below) <= depth(line):
                    break
                if "Generate explode(sequence" in below:
                    return True
    return False


@pytest.mark.parametrize("slack", [4, 0])
def test_subsets_by_threshold_equal_the_smallest_hashes(spark, slack, monkeypatch):
    scores, plans = _scores(spark), []
    kept = conformal.checkpointed
    monkeypatch.setattr(conformal, "checkpointed", lambda df: plans.append(_plan(df)) or kept(df))
    got = {(r.method, r["size"], r.replicate): r.correction for r in conformal.subset_corrections(scores, (9, 25), 6, "s", by=["method"], slack=slack).collect()}
    assert plans and not any(_explodes_below_broadcast(p) for p in plans)
    h = scores.crossJoin(spark.range(1, 7).select(F.col("id").cast("int").alias("r"))).withColumn("h", conformal.digest("s", "subset", F.col("r"), F.col("entity_id"))).collect()
    want = {}
    for m in "ab":
        for r in range(1, 7):
            rows = sorted((x.h, x.score) for x in h if x.method == m and x.r == r)
            for size, k in ((9, 9), (25, 24)):
                want[m, size, r] = max(0.0, sorted(s for _, s in rows[:size])[k - 1])
    assert got == want


@pytest.mark.parametrize("width", [8.0, 0.0])
def test_bootstrap_near_the_rank_equals_all_draws(spark, width):
    scores = _scores(spark)
    rosters = assign.role_rosters(scores.select("entity_id", F.lit("calibration").alias("role")).distinct())
    drawn = assign.bootstrap_draws(rosters, 20, "s")
    assert not _explodes_below_broadcast(_plan(drawn))
    want = conformal.corrections(drawn.join(scores, "entity_id"), ["method", "replicate"]).select("method", "replicate", "n", "correction").collect()
    got = conformal.bootstrap_corrections(scores, rosters, 20, "s", by=["method"], width=width).select("method", "replicate", "n", "correction").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 40


def test_resamples_too_small_have_no_finite_correction(spark):
    few = _scores(spark, 8)
    rosters = assign.role_rosters(few.select("entity_id", F.lit("calibration").alias("role")).distinct())
    assert {(r.n, r.correction) for r in conformal.bootstrap_corrections(few, rosters, 3, "s", by=["method"]).collect()} == {(8, float("inf"))}
    assert {r.correction for r in conformal.subset_corrections(few, (9,), 3, "s", by=["method"]).collect()} == {float("inf")}


def test_constant_side_has_no_correlation_over_many_tasks(spark):
    # merged partial moments of a constant leave a variance near, not at, zero
    rows = spark.range(0, 5000, 1, 7).select((F.col("id") % 3).alias("k"), F.rand(3).alias("x"), F.lit(0.1).alias("c"))
    got = rows.groupBy("k").agg(stats.pearson(F.col("x"), F.col("c")).alias("r"), stats.pearson(F.col("c"), F.col("x")).alias("s"), stats.pearson(F.col("x"), F.col("x")).alias("t")).collect()
    assert all(r.r is None and r.s is None and r.t == pytest.approx(1.0) for r in got)


def test_scores_equal_but_for_rounding_are_one_score(spark):
    # 0.1 + 0.2 and 0.3 differ in the last bit: one distinct score with multiplicity 2
    rows = [("a", i, v) for i, v in enumerate([0.1 + 0.2, 0.3, *map(float, range(1, 19))])]
    scores = spark.createDataFrame(rows, "method string, entity_id long, score double")
    from varve.plans.q_conformal import leave_one_out_scores

    got = {r.score: r.multiplicity for r in conformal.leave_one_out(leave_one_out_scores(scores), ["method"]).collect()}
    assert got[0.3] == 2 and len(got) == 19


@pytest.mark.parametrize("by_first", [True, False])
def test_picks_are_the_digest_modulo_the_size(spark, by_first):
    from varve.functions import hashing

    slots = spark.createDataFrame([("fit", s, 1000) for s in range(1, 8)] + [("tune", 1, 7)], "role string, slot long, n long")
    got = hashing.replicate_picks(slots, 9, "s", "role", "n", by_first)
    middle = [F.col("role"), F.col("replicate")] if by_first else [F.col("replicate"), F.col("role")]
    both = got.join(slots, ["role", "slot"]).withColumn("want", 1 + hashing.digest_mod(hashing.digest("s", *middle, F.col("slot")), F.col("n"))).collect()
    assert len(both) == 72 and all(r._pick == r.want for r in both)


def test_draws_are_spread_before_a_row_per_parameter_is_made(spark):
    # one input task made all rows of all parameters, and held them to count repeated values
    draws = spark.range(3000).select((F.col("id") % 2).cast("int").alias("fit"), F.rand(1).alias("a"), F.rand(2).alias("b")).coalesce(1)
    long = stats.unpivot(stats.spread_draws(draws, ["fit", "a"], rows=100), ["fit"], ["a", "b"])
    assert long.rdd.getNumPartitions() == 30 and long.count() == 6000
    n = spark.createDataFrame(stats.recovery(draws, {"a": 0.5, "b": 0.5}).collect())
    assert {r.n for r in n.collect()} == {1500} and all(r.inside for r in n.collect())
