
import pytest
from pyspark.sql import functions as F

from varve.operators import mixture, precision, scoring

SCHEMA = "method string, entity_id long, lower double, median double, upper double, y double"


def test_interval_score_values(spark):
    rows = [(15, 10, 20, 10), (5, 10, 20, 110), (25, 10, 20, 110), (10, 10, 20, 10), (20, 10, 20, 10)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in rows], "y double, lower double, upper double, s double")
    for r in df.select("s", scoring.interval_score(F.col("y"), F.col("lower"), F.col("upper")).alias("g")).collect():
        assert r.g == r.s
    bad = spark.createDataFrame([(1.0, 3.0, 2.0), (float("nan"), 1.0, 2.0), (1.0, 1.0, float("inf"))], "y double, lower double, upper double")
    assert all(r.g is None for r in bad.select(scoring.interval_score(F.col("y"), F.col("lower"), F.col("upper")).alias("g")).collect())


def _two_methods(change=None):
    rows = []
    for i in range(100):
        y = float((5, 10, 15, 20, 25)[i % 5])
        rows += [["B", i + 1, 10.0, 15.0, 20.0, y], ["C", i + 1, 0.0, -2.0, 15.0, y]]
    if change:
        change(rows)
    return [tuple(r) for r in rows]


def test_paired_scoring(spark):
    df = spark.createDataFrame(_two_methods(), SCHEMA)
    scored = scoring.components(df)
    s = {r.method: r for r in scoring.method_summary(scored, df.filter("method = 'B'")).collect()}
    assert s["B"].primary_status == "AVAILABLE" and s["B"].mean_score == (110 + 10 + 10 + 10 + 110) / 5
    assert s["B"].covered == s["C"].covered == 60 and s["C"].negative_medians == 100
    c = scoring.paired_contrast(scoring.paired_components(scored, "B", "C")).first()
    assert c.mean_score == pytest.approx(s["B"].mean_score - s["C"].mean_score, abs=1e-9)
    assert c.mean_width + c.mean_below_penalty + c.mean_above_penalty == pytest.approx(c.mean_score, abs=1e-9)


@pytest.mark.parametrize("change", [
    lambda r: r[4].__setitem__(5, float("nan")), lambda r: r[4].__setitem__(5, 0.0), lambda r: r[4].__setitem__(5, -1.0),
    lambda r: r[4].__setitem__(2, None), lambda r: r.pop(4), lambda r: r.append(list(r[4])), lambda r: r[4].__setitem__(4, 1e308) or r[4].__setitem__(2, -1e308),
])
def test_one_bad_row_withholds_the_method(spark, change):
    df = spark.createDataFrame(_two_methods(change), SCHEMA)
    cohort = spark.range(1, 101).withColumnRenamed("id", "entity_id")
    s = {r.method: r for r in scoring.method_summary(scoring.components(df), cohort).collect()}
    assert s["B"].primary_status == "UNAVAILABLE" and s["B"].mean_score is None and s["C"].primary_status == "AVAILABLE"


def test_large_errors_are_summed_and_infinite_ones_withhold(spark):
    cohort = spark.range(1, 101).withColumnRenamed("id", "entity_id")

    def summary(median):
        df = spark.createDataFrame(_two_methods(lambda r: r[0].__setitem__(3, median)), SCHEMA)
        return {r.method: r for r in scoring.method_summary(scoring.components(df), cohort).collect()}["B"]

    fine = summary(5e9)
    assert fine.primary_status == "AVAILABLE" and fine.median_rmse == pytest.approx(5e8, rel=1e-6)
    lost = summary(1e200)
    assert lost.primary_status == "UNAVAILABLE" and lost.mean_score is None and lost.median_rmse is None


def test_cancellation_of_large_scores(spark):
    rows = [(m, i + 1, 1.0, 1.0, 1.0, 1.0) for i in range(100) for m in "BC"]
    bump = {("B", 1): 1e16 + 2, ("B", 2): 2.0, ("C", 3): 1e16 + 2}
    rows = [(m, i, lo, md, bump.get((m, i), up), y) for m, i, lo, md, up, y in rows]
    c = scoring.paired_contrast(scoring.paired_components(scoring.components(spark.createDataFrame(rows, SCHEMA)), "B", "C")).first()
    assert c.mean_score == pytest.approx(0.01, abs=1e-15)


def test_gradients_kinks_and_lipschitz(spark):
    e = spark.createDataFrame([("f", 1, 9.9, 10.0, 15.0, 0.1, 0.1), ("f", 2, 26.0, 20.0, 25.0, 0.1, 0.1), ("f", 3, 35.0, 30.0, 35.0, 0.1, 0.0)],
                              "fit string, entity_id long, y double, lower double, upper double, r_lower double, r_upper double")
    g = {r.entity_id: (r.g_lower, r.g_upper) for r in scoring.with_gradients(e).collect()}
    assert g == {1: (19.0, 1.0), 2: (-1.0, -19.0), 3: (-1.0, 1.0)}
    k = {r.entity_id: (r.lower_kink, r.upper_kink) for r in scoring.kink_flags(e).collect()}
    assert k == {1: (True, False), 2: (False, False), 3: (False, True)}
    assert scoring.lipschitz_bound(e).first().bound == pytest.approx(19 / 3 * 0.5)
    m = spark.createDataFrame([("f", 4, None), ("f", 8, 0.2)], "fit string, b int, upper_mcse double")
    q = scoring.qualification(m, scoring.kink_flags(e)).first()
    assert q.status == "NUMERICALLY_QUALIFIED" and set(q.reasons) == {"undefined_upper_mcse", "label_near_endpoint"}


def test_fused_influence_equals_the_one_by_rows(spark):
    keys = ["fit", "entity_id"]
    # entity 0 of fit "a" holds most draws; fit "b" has one entity
    rows = [(f, e, c, d, 3.0 + 0.1 * e + ((7 * d + 3 * c + e) % 11) / 50, 0.04 + (d % 5) / 100, ((d * d + e) % 13) / 10, 0.1)
            for f, e, n in [("a", 0, 60), ("a", 1, 20), ("a", 2, 20), ("b", 3, 20)] for c in range(2) for d in range(n)]
    terms = spark.createDataFrame(rows, "fit string, entity_id long, chain int, draw int, mu double, var double, log_w double, sigma_r double")
    prepared = mixture.prepare(terms, keys)
    q = mixture.mixture_quantiles(prepared, keys)
    labels = spark.createDataFrame([(0, 1.0), (1, 500.0), (2, 25.0), (3, 21.0)], "entity_id long, y double")
    ends = mixture.endpoints(q, keys).join(labels, "entity_id")
    want = {(r.fit, r.chain, r.draw): r.h for r in scoring.score_influence(precision.influence(prepared, q, keys), ends).collect()}
    got = {(r.fit, r.chain, r.draw): r.h for r in scoring.fused_score_influence(prepared, q, ends).collect()}
    assert got.keys() == want.keys() and len(got) == 160
    assert all(got[k] == pytest.approx(want[k], rel=1e-9, abs=1e-12) for k in want)
    prepared.unpersist()
