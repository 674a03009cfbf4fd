import numpy as np
import pytest
from pyspark.sql import functions as F

from varve.operators import audit, features, linear, quantreg
from varve.operators.conformal import grid_rows

CH = ["a", "b", "c"]


def _trajectories(spark, shift=0.0):
    rows = []
    for e, c, m in ((1, 30, 2), (2, 50, 1)):
        for t in range(1, 61):
            late = shift if t > c else 0.0
            rows.append((e, t, c, m, 518.67, 0.02 * e + 0.003 * t * 2 + np.sin(t / 3 + e / 11) + late, 0.04 * e + 0.003 * t * 3 + np.sin(t / 4 + e / 11) + late))
    df = spark.createDataFrame([(r[0], r[1], r[2], r[3], *map(float, r[4:])) for r in rows], "entity_id long, cycle int, cutoff int, m int, a double, b double, c double")
    return df.withColumn("stage", F.lit("fit"))


def _preprocess(df):
    prefix = df.filter("cycle <= cutoff")
    return linear.principal_component(linear.weighted_moments(linear.entity_weights(prefix, multiplicity="m"), CH), CH)


def test_weighted_component_from_first_principles(spark):
    df = _trajectories(spark)
    pre = _preprocess(df).first()
    rows = [r for r in df.collect() if r.cycle <= r.cutoff]
    x = np.array([[r.a, r.b, r.c] for r in rows])
    w = np.array([r.m / (3 * r.cutoff) for r in rows])
    assert w.sum() == pytest.approx(1)
    mean = w @ x
    sd = np.sqrt(w @ (x - mean) ** 2)
    z = (x[:, 1:] - mean[1:]) / sd[1:]
    val, vec = np.linalg.eigh((z * w[:, None]).T @ z)
    lead = vec[:, -1] * np.sign(vec[np.argmax(abs(vec[:, -1])), -1])
    assert pre.retained == [False, True, True] and np.allclose(pre.pc[1:], lead, atol=1e-9)
    assert pre.pc_scale == pytest.approx(np.sqrt(val[-1])) and pre.explained == pytest.approx(val[-1] / val.sum())


def test_future_rows_do_not_leak(spark):
    def feats(df):
        scored = linear.project(features.recent_rows(df, 30), _preprocess(df), CH)
        return sorted(map(tuple, features.trend(scored, keep=("cutoff",)).collect()))

    assert feats(_trajectories(spark)) == feats(_trajectories(spark, 1e6))


def test_resampling_and_short_trends(spark):
    df = spark.createDataFrame([([7.0],), ([1.0, 3.0],), ([float(i) for i in range(30)],)], "z array<double>").select(features.resampled(F.col("z")).alias("r")).collect()
    assert df[0].r == [7.0] * 30 and np.allclose(df[1].r, np.linspace(1, 3, 30)) and np.allclose(df[2].r, range(30))
    s = spark.createDataFrame([(1, 5, 5, 2.0), (2, 4, 5, 1.0), (2, 5, 5, 3.0)], "entity_id long, cycle int, cutoff int, z double")
    t = {r.entity_id: r for r in features.trend(s, keep=("cutoff",)).collect()}
    assert (t[1].level, t[1].slope, t[1].resid_sd) == (2.0, 0.0, 0.0)
    assert t[2].level == pytest.approx(3.0) and t[2].slope == pytest.approx(60.0) and t[2].resid_sd == 0.0


def _design(spark, n=56, zero=False):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(n, 5))
    if zero:
        x[:, 4] = 0.0
    y = x @ [0.2, -0.1, 0.3, -0.2, 0.1] + 4 + rng.normal(size=n) * 0.3
    df = spark.createDataFrame([("s", *map(float, r), float(v)) for r, v in zip(x, y)], "stage string, a double, b double, c double, d double, e double, y double")
    return x, y, df.repartition(3)


def test_least_squares_and_interval(spark):
    x, y, df = _design(spark)
    model = linear.fit_least_squares(df, list("abcde"), F.col("y"))
    m = model.first()
    d = np.column_stack([np.ones(len(x)), x])
    coef, rss, rank, _ = np.linalg.lstsq(d, y, rcond=None)
    assert m["rank"] == rank == 6 and np.allclose(m.coefficients, coef, atol=1e-10) and m.residual_variance == pytest.approx(rss[0] / 50)
    new = df.limit(4)
    for r in linear.predict_least_squares(new, model, list("abcde")).collect():
        v = np.array([1, r.a, r.b, r.c, r.d, r.e])
        half = m.t_upper * np.sqrt(m.residual_variance * (1 + v @ np.linalg.inv(d.T @ d) @ v))
        assert np.allclose([r.lower, r.median, r.upper], np.exp([v @ coef - half, v @ coef, v @ coef + half]), rtol=1e-9)


def test_rank_deficient_design_rejects_new_directions(spark):
    _, _, df = _design(spark, zero=True)
    model = linear.fit_least_squares(df, list("abcde"), F.col("y"))
    assert model.first()["rank"] == 5
    ones = spark.createDataFrame([("s", 1.0, 1.0, 1.0, 1.0, 1.0)], "stage string, a double, b double, c double, d double, e double")
    assert linear.predict_least_squares(ones, model, list("abcde"), strict=False).first().estimable is False
    with pytest.raises(Exception, match="row space"):
        linear.predict_least_squares(ones, model, list("abcde")).collect()
    assert linear.predict_least_squares(df, model, list("abcde")).filter("estimable").count() == 56


def test_duplicate_screen_against_brute_force(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(6, 60, 2))
    hist = {1: base[0], 2: base[0] + rng.normal(size=(60, 2)) * 0.005, 3: base[1], 4: base[1], 5: base[1][:45], 6: base[2], 7: base[3], 8: base[2] + 0.015, 9: base[4], 10: base[4] + 0.05}
    rows = [(e, t + 1, len(h), float(h[t, 0]), float(h[t, 1])) for e, h in hist.items() for t in range(len(h))]
    df = spark.createDataFrame(rows, "entity_id long, cycle int, cutoff int, u double, v double")
    scales = linear.channel_scales(df, ["u", "v"])
    s = np.array(scales.first())
    want, dist = set(), []
    for a in hist:
        for b in hist:
            if a < b:
                n = min(len(hist[a]), len(hist[b]))
                per = np.sqrt((((hist[a][:n] - hist[b][:n]) / s) ** 2).mean(0))
                mean = np.sqrt((per**2).mean())
                dist.append((mean, a, b))
                if 0 < mean <= 0.02 and per.max() <= 0.10:
                    want.add((a, b))
    near = audit.near_pairs(df, None, scales, ["u", "v"]).collect()
    assert want and {(r.a, r.b) for r in near} == want
    exact = audit.exact_groups(df, ["u", "v"]).collect()
    assert sum(r.pairs for r in exact) == 3
    top = [(r.a, r.b) for r in audit.closest_pairs(df, scales, ["u", "v"], k=3).collect()]
    assert top == [(a, b) for m, c, a, b in sorted((m, -min(len(hist[a]), len(hist[b])), a, b) for m, a, b in dist)][:3]
    cross = audit.cross_exact_groups(df.filter("entity_id in (3, 6)"), df.filter("entity_id in (4, 5, 7)"), ["u", "v"]).collect()
    assert sum(r.pairs for r in cross) == 2


def test_pivot_index_loses_no_pair(spark):
    """Every pair within the radius is a candidate, within one table and across two, whatever the lengths; few others are."""
    rng = np.random.default_rng(21)
    hist = {}
    for e in range(60):
        hist[e] = np.cumsum(rng.normal(size=(int(rng.integers(25, 120)), 2)), axis=0) if e % 2 else rng.normal(size=(int(rng.integers(28, 90)), 2))
        twin = np.vstack([hist[e], rng.normal(size=(int(rng.integers(1, 60)), 2))]) if e % 3 else hist[e][: max(25, len(hist[e]) - e)]
        hist[100 + e] = twin + rng.normal(size=twin.shape) * rng.choice([0.0, 0.005, 0.03, 0.2])
    rows = [(e, t + 1, len(h), float(h[t, 0]), float(h[t, 1])) for e, h in hist.items() for t in range(len(h))]
    df = spark.createDataFrame(rows, "entity_id long, cycle int, cutoff int, u double, v double")
    index = lambda d: audit.pivot_index(d, audit.pivot_points(df, ["u", "v"]), ["u", "v"])
    mean = lambda a, b, n: np.sqrt(((hist[a][:n] - hist[b][:n]) ** 2).mean())
    usable = [e for e in hist if len(hist[e]) >= 30]
    n_of = lambda a, b: min(len(hist[a]), len(hist[b]))
    for limit in (1e-12, 0.02, 0.1):
        want = {(a, b) for a in usable for b in usable if a < b and mean(a, b, n_of(a, b)) <= limit}
        got = [(r.a, r.b) for r in audit.candidate_pairs(index(df), None, 2, limit).collect()]
        assert len(got) == len(set(got)) and want and want <= set(got) and len(got) <= 3 * len(usable)
        low, high = df.filter("entity_id < 100"), df.filter("entity_id >= 100")
        cross = [(r.a, r.b) for r in audit.candidate_pairs(index(low), index(high), 2, limit).collect()]
        assert len(cross) == len(set(cross)) and {p for p in want if p[0] < 100 <= p[1]} <= set(cross)


def test_closest_pairs_with_copies_and_without_close_ones(spark):
    """Copies are pairs of their own, ties go by length and ids, and few or no histories give few or no pairs."""
    rng = np.random.default_rng(22)
    base = rng.normal(size=(6, 60, 1))
    hist = {1: base[0][:40], 2: base[1], 3: base[2][:29], 4: base[0][:40], 5: base[0][:40], 6: base[1], 7: base[3], 8: base[0][:40], 9: base[2][:29]}
    rows = [(e, t + 1, len(h), float(h[t, 0])) for e, h in hist.items() for t in range(len(h))]
    df = spark.createDataFrame(rows, "entity_id long, cycle int, cutoff int, u double")
    scales = linear.channel_scales(df, ["u"])
    s = scales.first()[0]
    every = []
    for a in hist:
        for b in hist:
            n = min(len(hist[a]), len(hist[b]))
            if a < b and n >= 30:
                every.append((np.sqrt((((hist[a][:n] - hist[b][:n]) / s) ** 2).mean()), -n, a, b))
    pairs = lambda d, k: [(r.a, r.b) for r in audit.closest_pairs(d, scales, ["u"], k=k).collect()]
    rank = lambda chosen: [(a, b) for m, n, a, b in sorted((round(m, 9), n, a, b) for m, n, a, b in chosen)]
    assert pairs(df, 5) == rank(every)[:5] and pairs(df, 9) == rank(every)[:9]
    few = {2, 7, 3}
    assert pairs(df.filter("entity_id in (2, 3, 7)"), 5) == rank(x for x in every if x[2] in few and x[3] in few)
    assert pairs(df.filter("entity_id = 3"), 5) == [] and pairs(df.limit(0), 5) == []


def test_cross_screen_fails_on_near_copies(spark):
    """Near copies of longer histories count from 30 cycles, times their copies; without a hit the gate passes."""
    rng = np.random.default_rng(12)
    base = rng.normal(size=(5, 60, 2))
    def table(hist):
        rows = [(e, t + 1, len(h), float(h[t, 0]), float(h[t, 1])) for e, h in hist.items() for t in range(len(h))]
        return spark.createDataFrame(rows, "entity_id long, cycle int, cutoff int, u double, v double")
    left = table({1: base[0][:40], 2: base[1][:35], 3: base[2][:45]})
    scales = linear.channel_scales(left, ["u", "v"])
    hits = lambda right: tuple(audit.cross_screen(left, table(right), scales, ["u", "v"]).first())
    near = base[0] + 0.005
    assert hits({1: near, 2: near, 3: base[3], 4: base[1][:20] + 0.005}) == (0, 2, "FAIL")
    assert hits({1: base[3], 2: base[2]}) == (1, 0, "FAIL")
    assert hits({1: base[3], 2: base[4], 3: base[1][:20] + 0.005}) == (0, 0, "PASS")


def test_quantile_learners_reach_low_pinball_loss(spark):
    rng = np.random.default_rng(4)
    x = rng.uniform(-1, 1, size=(300, 3))
    y = 10 + 5 * x[:, 0] + rng.normal(size=300)
    df = spark.createDataFrame([(i, "fit", float(v), list(map(float, r)), list(map(float, r))) for i, (r, v) in enumerate(zip(x, y))], "entity_id long, role string, y double, summary array<double>, full array<double>")
    loss = lambda p, tau: np.mean(np.where(y >= p, tau * (y - p), (tau - 1) * (y - p)))
    lin = quantreg.fit_linear(df, [{"candidate_id": "l", "family": "linear", "alpha": 0.001}], (0.5, 0.95))
    for t, tau in enumerate((0.5, 0.95)):
        beta = lin.coef[0, t]
        got = loss(beta[0] + ((x - lin.mean[0]) / lin.sd[0]) @ beta[1:], tau)
        # no nearby coefficient vector does noticeably better
        trials = [loss(b[0] + ((x - lin.mean[0]) / lin.sd[0]) @ b[1:], tau) + 0.001 * abs(b[1:]).sum() for b in beta + rng.normal(size=(400, 4)) * 0.02]
        assert got + 0.001 * abs(beta[1:]).sum() <= min(trials) + 1e-4
    grid = [g for g in grid_rows() if g["candidate_id"] in ("gb-depth2-leaf5-lr0p1", "gb-depth1-leaf5-lr0p1")]
    model = quantreg.fit_boosted(df, grid, (0.05, 0.95), trees=10, refresh=4)
    pred = quantreg.predict_boosted(df, model)
    got = {(r.candidate_id, r.tau): r.v for r in pred.groupBy("candidate_id", "tau").agg(F.avg(quantreg.pinball(F.col("y"), F.col("prediction"), F.col("tau"))).alias("v")).collect()}
    for tau in (0.05, 0.95):
        flat = loss(np.quantile(y, tau), tau)
        assert all(got[(g["candidate_id"], tau)] < 0.8 * flat for g in grid)
