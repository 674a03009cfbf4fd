import math

import numpy as np
from pyspark.sql import functions as F

from varve.operators import conformal


def test_ranks_and_corrections(spark):
    df = spark.createDataFrame([(8, 9), (9, 9), (19, 18), (25, 24), (99, 90)], "n long, k long")
    assert all(r.k == r.g for r in df.select("k", conformal.conformal_rank(F.col("n")).alias("g")).collect())
    cases = {"a": [float(i) for i in range(25)], "b": [-2.0] * 25, "c": [float(i) for i in range(8)], "d": [1.0] * 25}
    s = spark.createDataFrame([(k, v) for k, vs in cases.items() for v in vs], "m string, score double")
    got = {r.m: r.correction for r in conformal.corrections(s, ["m"]).collect()}
    assert got == {"a": 23.0, "b": 0.0, "c": math.inf, "d": 1.0}


def test_leave_one_out_against_brute_force(spark):
    rng = np.random.default_rng(2)
    for n in (9, 20, 31):
        v = np.round(rng.normal(size=n), 1)
        got = {r.score: r.correction for r in conformal.leave_one_out(spark.createDataFrame([(float(x),) for x in v], "score double")).collect()}
        for i, x in enumerate(v):
            rest = np.sort(np.delete(v, i))
            k = math.ceil(n * 0.9 - 1e-12)
            assert got[float(x)] == (math.inf if k > n - 1 else max(0.0, rest[k - 1]))


def test_clipping_keeps_membership(spark):
    p = spark.createDataFrame([("m", -5.0, 5.0), ("m", 10.0, 20.0)], "method string, lower double, upper double")
    for q in (0.0, 2.0, 10.0):
        out = conformal.apply_correction(p, spark.createDataFrame([("m", q)], "method string, correction double")).collect()
        for (lo, hi), r in zip(((-5, 5), (10, 20)), sorted(out, key=lambda r: r.upper)):
            assert all((lo - q <= y <= hi + q) == (r.lower <= y <= r.upper) for y in range(31))


def _scores(spark, changed):
    base = {r["candidate_id"]: changed.get(r["candidate_id"], 50.0) for r in conformal.grid_rows()}
    s = spark.createDataFrame(list(base.items()), "candidate_id string, mean_score double")
    return conformal.candidate_grid(spark).join(s, "candidate_id")


def test_selection_rule(spark):
    pick = conformal.select_candidate(_scores(spark, {"gb-depth1-leaf5-lr0p1": 10.0, "linear-l1-alpha0p01": 10.4, "linear-l1-alpha0p1": 10.4})).first()
    assert (pick.candidate_id, pick.best_score, pick.selected_score, pick.n_tied) == ("linear-l1-alpha0p1", 10.0, 10.4, 3)
    assert conformal.select_candidate(_scores(spark, {})).first().candidate_id == "linear-l1-alpha1"
    trees = {c: (None if c.startswith("linear") else 50.0) for c in [r["candidate_id"] for r in conformal.grid_rows()]}
    assert conformal.select_candidate(_scores(spark, trees)).first().candidate_id == "gb-depth1-leaf10-lr0p03"


def test_crossed_endpoints_are_sorted(spark):
    df = conformal.ordered_endpoints(spark.createDataFrame([(5.0, 4.0), (10.0, 15.0)], "lower double, upper double"))
    assert sorted((r.lower, r.upper) for r in df.collect()) == [(4.0, 5.0), (10.0, 15.0)]


def test_resampled_corrections_by_method(spark):
    """Every method gets its own corrections, the same as when it is alone."""
    from varve.operators import assign

    rng = np.random.default_rng(6)
    s = spark.createDataFrame([(m, e, float(rng.normal(k))) for k, m in enumerate("ab") for e in range(30)], "method string, entity_id long, score double")
    alone = s.filter("method = 'b'")
    pick = lambda df, *c: sorted((tuple(r[x] for x in c), r.correction) for r in df.filter("method = 'b'").collect())
    got = conformal.subset_corrections(s, (9, 19), 4, "t", by=["method"])
    want = conformal.subset_corrections(alone, (9, 19), 4, "t")
    assert pick(got, "size", "replicate") == sorted(((r["size"], r.replicate), r.correction) for r in want.collect())
    rosters = assign.role_rosters(alone.select("entity_id").selectExpr("entity_id", "'calibration' AS role"))
    both = conformal.bootstrap_corrections(s, rosters, 3, "t", by=["method"])
    one = conformal.bootstrap_corrections(alone, rosters, 3, "t")
    assert both.count() == 6 and pick(both, "replicate") == sorted(((r.replicate,), r.correction) for r in one.collect())
