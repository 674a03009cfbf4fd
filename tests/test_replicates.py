"""Bootstrap replicates: gates, moments and features against row-level fits, learners against plain ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from varve.operators import assign, conformal, features, linear, quantreg, replicates

CHANNELS = ["c1", "c2", "c3"]


@pytest.fixture(scope="module")
def world(spark):
    """Entities of three roles, some of them without a future, with prefixes of one row and more."""
    rng, rows, ents = np.random.default_rng(2), [], []
    for e in range(90):
        role = ("fit", "fit", "fit", "tune", "calibration", "calibration")[e % 6]
        cutoff, life = (1 + e % 2 if e < 4 else 5 + e % 40), 30 + e % 60
        ents.append((e, role, cutoff, life, cutoff < life))
        if cutoff < life:
            x = rng.normal(size=3).cumsum() + rng.normal(size=(cutoff, 3)) * [1, 5, 0.2] + np.arange(cutoff)[:, None] * 0.05 * (e % 3)
            rows += [(e, c + 1, *map(float, x[c]), role, cutoff, life) for c in range(cutoff)]
    prefix = spark.createDataFrame(rows, "entity_id long, cycle long, c1 double, c2 double, c3 double, role string, cutoff long, lifetime long")
    entities = spark.createDataFrame(ents, "entity_id long, role string, cutoff long, lifetime long, eligible boolean")
    mult = assign.stage_multiplicities(assign.bootstrap_draws(assign.role_rosters(entities), 3, "t")).withColumn("replicate", F.col("replicate").cast("int"))
    return prefix.persist(), entities.persist(), mult.persist()


def test_moments_and_features_equal_those_of_repeated_rows(world):
    prefix, entities, mult = world
    draws = mult.join(entities.filter("eligible").select("entity_id"), "entity_id")
    pre = linear.principal_component(replicates.stage_moments(replicates.entity_moments(prefix, CHANNELS), draws, CHANNELS), CHANNELS, ["replicate", "stage"])
    got = {(r.replicate, r.stage): r for r in pre.collect()}
    assert len(got) == 6
    windows = replicates.entity_windows(prefix, CHANNELS, 30).join(draws.drop("role"), "entity_id").withColumn("stage", F.explode(F.array(F.lit("select"), F.lit("refit"))))
    found = {(r.replicate, r.stage, r.entity_id): r for r in replicates.stage_features(windows, pre).collect()}
    for stage, roles in replicates.STAGES.items():
        # the row-level path: every row of a drawn entity, weighted by its draws
        rows = prefix.join(draws.filter("replicate = 2").drop("role"), "entity_id").withColumn("stage", F.lit(stage))
        weighted = linear.entity_weights(rows.filter(F.col("role").isin(*roles)), multiplicity="multiplicity")
        plain = linear.principal_component(linear.weighted_moments(weighted, CHANNELS), CHANNELS)
        want = plain.first()
        assert np.allclose(want["mean"], got[2, stage]["mean"]) and np.allclose(want["sd"], got[2, stage]["sd"]) and np.allclose(want["pc"], got[2, stage]["pc"])
        scored = linear.project(features.recent_rows(rows, 30), plain, CHANNELS)
        for r in features.trend(scored).collect():
            own = found[2, stage, r.entity_id]
            assert np.allclose(own.summary, [r[c] for c in features.SUMMARY], atol=1e-7) and own.y == r.lifetime - r.cutoff
        for r in features.sequences(scored).select("entity_id", features.resampled(F.col("z")).alias("s")).collect():
            assert np.allclose(found[2, stage, r.entity_id].full[1:], r.s, atol=1e-9)


def test_gates_count_distinct_eligible_draws(spark, world):
    _, entities, mult = world
    own = {r.replicate: r for r in replicates.stage_gates(mult, entities, {"fit": 20, "tune": 5, "calibration": 9}).collect()}
    eligible = {r.entity_id for r in entities.filter("eligible").collect()}
    for k, r in own.items():
        rows = mult.filter(F.col("replicate") == k).collect()
        failing = sorted(role for role, least in assign.STAGE_MINIMUM.items() if len({x.entity_id for x in rows if x.role == role and x.entity_id in eligible}) < least)
        assert sorted(r.failing_stages) == failing and r.status == ("FAIL" if failing else "PASS")
        assert (r.draws, r.eligible_draws) == (sum(x.multiplicity for x in rows), sum(x.multiplicity for x in rows if x.entity_id in eligible))
    alone = replicates.stage_gates(mult.filter("role <> 'tune'"), entities).collect()
    assert all("tune" in r.failing_stages and r.status == "FAIL" for r in alone)


def plain_boost(x, y, others, g, tau, trees):
    """One row, one split, one leaf at a time."""
    n, edges = len(y), [[np.sort(x[:, f])[max(int(np.ceil((i + 1) / 64 * len(y))) - 1, 0)] for i in range(63)] for f in range(x.shape[1])]
    b, o = (np.array([[np.searchsorted(edges[f], v[f], "left") for f in range(x.shape[1])] for v in m]) for m in (x, others))
    low = lambda v: np.sort(v)[max(int(np.ceil(tau * len(v))) - 1, 0)]
    score, out = np.full(n, low(y)), np.full(len(others), low(y))

    def split(rows, grad):
        best = (1e-12, None)
        for f in range(x.shape[1]):
            for c in range(64):
                left = rows & (b[:, f] <= c)
                right = rows & ~left
                if min(left.sum(), right.sum()) >= g["leaf"]:
                    gain = left.sum() * right.sum() / rows.sum() * (grad[left].mean() - grad[right].mean()) ** 2
                    if gain > best[0] * (1 + 1e-9):
                        best = (gain, (f, c))
        return best[1]

    for _ in range(trees):
        grad = np.where(y > score, tau, tau - 1)
        leaf, leaf_o = np.zeros(n, int), np.zeros(len(others), int)
        top = split(np.ones(n, bool), grad)
        if top:
            leaf, leaf_o = 2 * (b[:, top[0]] > top[1]), 2 * (o[:, top[0]] > top[1])
            if g["depth"] > 1:
                for side in (0, 2):
                    s = split(leaf == side, grad)
                    if s:
                        leaf, leaf_o = leaf + ((leaf == side) & (b[:, s[0]] > s[1])), leaf_o + ((leaf_o == side) & (o[:, s[0]] > s[1]))
        residual = y - score
        for k in set(leaf):
            v = g["rate"] * low(residual[leaf == k])
            score[leaf == k] += v
            out[leaf_o == k] += v
    return out


@pytest.mark.parametrize("depth, leaf", [(1, 5), (2, 5), (2, 10)])
def test_boosting_against_a_plain_learner(depth, leaf):
    rng = np.random.default_rng(depth * leaf)
    x, others = rng.normal(size=(150, 3)), rng.normal(size=(60, 3))
    y = 10 + 5 * x[:, 0] + 2 * x[:, 1] * (x[:, 2] > 0) + rng.normal(size=150)
    g = {"candidate_id": "g", "family": "boosted", "depth": depth, "leaf": leaf, "rate": 0.1, "trees": 200}
    truth = 10 + 5 * others[:, 0] + 2 * others[:, 1] * (others[:, 2] > 0) + rng.normal(size=60)
    got = replicates.boost(x, y, others, [g], (0.05, 0.95))
    for t, tau in enumerate((0.05, 0.95)):
        want = plain_boost(x, y, others, g, tau, 200)
        loss = lambda p, tau=tau: np.mean(np.where(truth >= p, tau * (truth - p), (tau - 1) * (truth - p)))
        assert abs(loss(got[:, t]) - loss(want)) <= 0.01 * loss(want)


def test_one_task_and_many_tasks_agree(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 3))
    y = 5 + x @ [3, 1, 0] + rng.normal(size=200)
    rows = [(1 + i % 2, i, "fit" if i < 150 else "tune", float(y[i]), list(map(float, x[i])), list(map(float, x[i])), 1 + i % 3) for i in range(200)]
    df = spark.createDataFrame(rows, "replicate int, entity_id long, role string, y double, summary array<double>, full array<double>, multiplicity long").filter("replicate = 1")
    grid = [g for g in conformal.grid_rows() if g["candidate_id"] in ("gb-depth2-leaf5-lr0p1", "linear-l1-alpha0p01")]
    take = lambda: {(r.entity_id, r.candidate_id, r.tau): r.prediction for r in replicates.fit_predict_groups(df.filter("role = 'fit'"), df.filter("role = 'tune'"), grid, trees=15).collect()}
    one = take()
    monkeypatch.setattr(replicates, "GROUP_ROWS", 0)
    many = take()
    assert one.keys() == many.keys() and len(one) == 2 * 2 * 25
    assert all(one[k] == pytest.approx(many[k], abs=0.02) for k in one if k[1].startswith("linear"))
    loss = lambda p: np.mean([np.where(y[i] >= v, t * (y[i] - v), (t - 1) * (y[i] - v)) for (i, c, t), v in p.items() if c.startswith("gb")])
    assert loss(one) == pytest.approx(loss(many), rel=0.01)


def test_failed_replicates_keep_their_row(world):
    prefix, entities, mult = world
    few = mult.filter("replicate <> 3 or role <> 'tune'").filter("replicate <> 2")
    out = {r.replicate: r for r in replicates.bootstrap(prefix, entities, few, CHANNELS, 30, trees=5).collect()}
    assert set(out) == {1, 3} and out[3].status == "failed" and out[3].failing_stages == ["tune"] and out[3].correction is None
    assert out[1].status == "completed" and out[1].n_calibration_rows >= out[1].n_calibration_distinct >= 9


def test_a_replicate_of_many_draws_is_fitted_in_a_task(spark, monkeypatch):
    """150,000 drawn rows are no reason for several hundred passes over spread rows."""
    def spread(*_):
        raise AssertionError("rows were spread over tasks")

    monkeypatch.setattr(quantreg, "fit_predict", spread)
    rows = spark.range(5).select(
        F.lit(0).alias("replicate"), F.col("id").alias("entity_id"), F.lit("fit").alias("role"), (F.col("id") * 10.0).cast("double").alias("y"),
        F.array(F.col("id").cast("double")).alias("summary"), F.array(F.col("id").cast("double")).alias("full"), F.lit(30_000).cast("long").alias("multiplicity"))
    grid = [g for g in conformal.grid_rows() if g["family"] == "boosted"][:1]
    got = replicates.fit_predict_groups(rows, rows, grid, (0.5,), trees=2).collect()
    assert len(got) == 5 and all(r.multiplicity == 30_000 for r in got)
