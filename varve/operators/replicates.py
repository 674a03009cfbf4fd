"""Bootstrap replicates as rows: stage gates, preprocessors, features and learners keyed by replicate.

A replicate only reweighs entities, so what is read from an entity's rows is read once: its channel
moments over the prefix, and per channel the trend and the resampled window. A preprocessor of a
(replicate, stage) is a weighted sum of entity moments, and since a score is an affine function of
the channels, every feature of that stage is algebra on the entity's own row. Learners run for each
(replicate, candidate) in a task of their own where its rows are within ``GROUP_ROWS``; beyond that
``quantreg`` spreads the rows of a model over tasks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varve.operators import assign, conformal, features, linear, quantreg
from varve.session import checkpointed, ship

# Drawn rows of a replicate that a task may hold.
GROUP_ROWS = 400_000
STAGES = {"select": ("fit",), "refit": ("fit", "tune")}


def stage_gates(multiplicities: DataFrame, entities: DataFrame, minimum: Mapping[str, int] = assign.STAGE_MINIMUM) -> DataFrame:
    """Per replicate: PASS where every stage has its minimum of distinct eligible entities, with the stages that fail.

    Draws come from whole rosters; ineligible ones stay on record and are not redrawn. A stage without any draw fails.
    """
    per = assign.stage_summary(multiplicities, entities, minimum)
    failing = F.array(*[F.when(F.coalesce(F.max(F.when(F.col("role") == role, F.col("eligible_unique"))), F.lit(0)) < least, F.lit(role)) for role, least in minimum.items()])
    out = per.groupBy("replicate").agg(F.sum("draws").alias("draws"), F.sum("eligible_draws").alias("eligible_draws"), F.array_compact(failing).alias("failing_stages"))
    return out.withColumn("status", F.when(F.size("failing_stages") == 0, "PASS").otherwise("FAIL"))


def entity_moments(prefix: DataFrame, channels: Sequence[str], id_col: str = "entity_id") -> DataFrame:
    """Means and population covariances (upper triangle) of the channels over each entity's prefix."""
    pairs = [(a, b) for i, a in enumerate(channels) for b in channels[i:]]
    return prefix.groupBy(id_col, "role").agg(*[F.avg(c).alias(f"own_{c}") for c in channels], *[F.covar_pop(a, b).alias(f"within_{a}_{b}") for a, b in pairs])


def stage_moments(moments: DataFrame, multiplicities: DataFrame, channels: Sequence[str], stages: Mapping[str, Sequence[str]] = STAGES, id_col: str = "entity_id") -> DataFrame:
    """Weighted means and covariances for each (replicate, stage): every entity weighs m / M.

    The covariance is that within entities plus that of entity means about the weighted mean. A row
    of input is an (entity, replicate), whatever the length of the prefix.
    """
    kinds = F.array(*[F.when(F.col("role").isin(*roles), F.lit(stage)) for stage, roles in stages.items()])
    rows = multiplicities.drop("role").join(moments, id_col).withColumn("stage", F.explode(F.array_compact(kinds)))
    by, m = ["replicate", "stage"], F.col("multiplicity").cast("double")
    means = rows.groupBy(*by).agg(F.sum(m).alias("_total"), *[(F.sum(m * F.col(f"own_{c}")) / F.sum(m)).alias(f"mean_{c}") for c in channels])
    centred = rows.join(means, by)
    d = {c: F.col(f"own_{c}") - F.col(f"mean_{c}") for c in channels}
    pairs = [(a, b) for i, a in enumerate(channels) for b in channels[i:]]
    cross = centred.groupBy(*by).agg(*[F.sum(m / F.col("_total") * (F.col(f"within_{a}_{b}") + d[a] * d[b])).alias(f"cov_{a}_{b}") for a, b in pairs])
    return means.drop("_total").join(cross, by)


def entity_windows(prefix: DataFrame, channels: Sequence[str], window: int, unit: float = 30.0, id_col: str = "entity_id") -> DataFrame:
    """Once per entity: by channel the endpoint, level, slope and resampled window, and the cross-products of residuals."""
    recent = features.recent_rows(prefix, window).withColumn("_t", (F.col("cycle") - F.col("cutoff")) / F.lit(unit))
    keep = [id_col, "role", "cutoff", "lifetime"]
    pairs = [(i, j) for i in range(len(channels)) for j in range(len(channels))]
    rows = F.sort_array(F.collect_list(F.struct("cycle", *channels)))  # a window at most
    g = recent.groupBy(*keep).agg(
        F.count(F.lit(1)).alias("w"), rows.alias("_rows"), F.regr_sxx(channels[0], "_t").alias("_sxx"),
        F.array(*[F.regr_intercept(c, "_t") for c in channels]).alias("_b0"), F.array(*[F.regr_slope(c, "_t") for c in channels]).alias("_b1"),
        F.array(*[F.covar_pop(channels[i], channels[j]) for i, j in pairs]).alias("_cov"),
    )
    k = len(channels)
    last = F.array(*[F.element_at("_rows", -1)[c] for c in channels])
    residual = F.array(*[F.col("_cov")[i * k + j] * F.col("w") - F.col("_b1")[i] * F.col("_b1")[j] * F.col("_sxx") for i, j in pairs])
    return g.select(
        *keep, "w", last.alias("endpoint"),
        F.when(F.col("w") == 1, last).otherwise(F.col("_b0")).alias("level"),
        F.when(F.col("w") == 1, F.array(*[F.lit(0.0)] * k)).otherwise(F.col("_b1")).alias("slope"),
        F.when(F.col("w") < 3, F.array(*[F.lit(0.0)] * (k * k))).otherwise(F.transform(residual, lambda v: v / (F.col("w") - 2))).alias("resid"),
        F.array(*[features.resampled(F.col(f"_rows.{c}")) for c in channels]).alias("seq"),
    )


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def stage_features(windows: DataFrame, preprocessors: DataFrame) -> DataFrame:
    """``summary`` and ``full`` feature arrays and y for each row of (entity, replicate, stage): windows joined with preprocessors.

    A score is slope . channels + shift, so level, slope, endpoint and the resampled values map through it, and
    the residual variance is the quadratic form of the residual cross-products.
    """
    j = windows.join(preprocessors, ["replicate", "stage"])
    a = F.transform(F.arrays_zip("retained", "pc", "sd"), lambda s: F.when(s["retained"], s["pc"] / s["sd"]).otherwise(F.lit(0.0)) / F.col("pc_scale"))
    j = j.withColumn("_a", a).withColumn("_b", -_dot(F.col("_a"), F.col("mean")))
    k = F.size("_a")
    pairs = F.flatten(F.transform("_a", lambda x: F.transform(F.col("_a"), lambda y: x * y)))
    variance = F.greatest(F.lit(0.0), _dot(pairs, F.col("resid")))
    seq = F.transform(F.sequence(F.lit(0), F.lit(features.GRID - 1)), lambda p: F.col("_b") + F.aggregate(F.sequence(F.lit(0), k - 1), F.lit(0.0), lambda s, c: s + F.get("_a", c) * F.get(F.get("seq", c), p)))
    age = features.log_age(F.col("cutoff"))
    through = lambda c: _dot(F.col("_a"), F.col(c)) + F.col("_b")
    summary = F.array(age, through("endpoint"), through("level"), _dot(F.col("_a"), F.col("slope")), F.sqrt(variance))
    return j.select("replicate", "stage", "entity_id", "role", "multiplicity", (F.col("lifetime") - F.col("cutoff")).cast("double").alias("y"), summary.alias("summary"), F.concat(F.array(age), seq).alias("full"))


# --- learners of one group ----------------------------------------------------------------------


def _ranked(sorted_values: np.ndarray, n: np.ndarray, tau: np.ndarray) -> np.ndarray:
    """Position of the tau-quantile among n ascending values: the least whose rank reaches tau * n."""
    return np.maximum(np.ceil(tau * n).astype(np.int64) - 1, 0)


def boost(x: np.ndarray, y: np.ndarray, others: np.ndarray, grid: Sequence[dict], taus: Sequence[float], trees: int | None = None, n_bin: int = quantreg.BINS) -> np.ndarray:
    """Fit every (candidate, level) on (x, y) by histogram boosting of the pinball loss; predictions of ``others`` (rows, tasks).

    A gradient is tau or tau - 1, so nodes are compared by their counts of rows at or below the score, which
    are exact; of splits that gain the same the first feature and cut is taken. A level-two node's histogram is counted for the smaller child only; its sibling's is the parent's less that.
    """
    tasks = [(g, t) for g in grid for t in taus]
    n, width, n_task = len(y), x.shape[1], len(tasks)
    tau, least = np.array([t for _, t in tasks]), np.array([g["leaf"] for g, _ in tasks])
    depth, rate = np.array([g["depth"] for g, _ in tasks]), np.array([g["rate"] for g, _ in tasks])
    rounds = np.array([trees if trees is not None else g["trees"] for g, _ in tasks])
    ordered = np.sort(x, axis=0)
    edges = ordered[_ranked(ordered, np.array(n), np.arange(1, n_bin) / n_bin)]
    binned = lambda m: np.stack([np.searchsorted(edges[:, f], m[:, f], "left") for f in range(width)], axis=1)
    b, o = binned(x), binned(others)
    start = np.sort(y)[_ranked(y, np.array(n), tau)]
    score, out = np.tile(start, (n, 1)), np.tile(start, (len(others), 1))
    lane, cell = np.arange(n_task), np.arange(n_task) * width * n_bin
    place = np.arange(width) * n_bin + b  # (n, width): cell of each feature

    def count(rows: np.ndarray) -> np.ndarray:
        """Rows marked in (n, tasks) by task, feature and bin."""
        i, t = np.nonzero(rows)
        return np.bincount((cell[t][:, None] + place[i]).ravel(), minlength=n_task * width * n_bin).astype(float).reshape(n_task, width, n_bin)

    everyone = count(np.ones((n, n_task), bool))

    def split(g: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        gl, nl = g.cumsum(-1), c.cumsum(-1)
        gr, nr = gl[..., -1:] - gl, nl[..., -1:] - nl
        ok = (nl >= least[:, None, None]) & (nr >= least[:, None, None])
        with np.errstate(all="ignore"):
            gain = np.where(ok, nl * nr / (nl + nr) * (gl / nl - gr / nr) ** 2, -1.0).reshape(n_task, -1)
        best = gain.max(-1)
        at = (gain >= best[:, None] * (1 - 1e-9)).argmax(-1)
        found = best > 1e-12
        return np.where(found, at // n_bin, -1), at % n_bin

    def goes_right(m: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
        return (feature >= 0) & (np.take_along_axis(m, np.maximum(feature, 0), 1) > cut)

    for step in range(int(rounds.max())):
        below = y[:, None] <= score
        g, c = count(below), everyone
        feature, cut = np.full((3, n_task), -1), np.zeros((3, n_task), int)
        feature[0], cut[0] = split(g, c)
        top = goes_right(b, np.tile(feature[0], (n, 1)), cut[0])
        if (depth > 1).any():
            few = top.sum(axis=0) * 2 <= n  # the right child is the smaller one
            small = top == few
            sg, sc = count(small & below), count(small)
            for child in (0, 1):
                own = few == bool(child)
                f, k = split(np.where(own[:, None, None], sg, g - sg), np.where(own[:, None, None], sc, c - sc))
                feature[1 + child], cut[1 + child] = np.where((depth > 1) & (feature[0] >= 0), f, -1), k

        def leaves(m: np.ndarray) -> np.ndarray:
            first = goes_right(m, np.tile(feature[0], (len(m), 1)), cut[0])
            second = first + 1
            return 2 * first + goes_right(m, feature[second, lane], cut[second, lane])

        leaf, residual = leaves(b), y[:, None] - score
        value = np.zeros((n_task, 4))
        for t in lane:
            for k in range(4):
                own = residual[leaf[:, t] == k, t]
                if len(own):
                    at = _ranked(own, len(own), tau[t])
                    value[t, k] = np.partition(own, at)[at]
        value *= np.where(step < rounds, rate, 0.0)[:, None]
        score += value[lane, leaf]
        out += value[lane, leaves(o)]
    return out


def solve_linear(x: np.ndarray, y: np.ndarray, others: np.ndarray, grid: Sequence[dict], taus: Sequence[float]) -> np.ndarray:
    """Fit every (alpha, level) on (x, y) by the Newton steps of ``quantreg``; predictions of ``others`` (rows, tasks)."""
    mean, sd = x.mean(axis=0), x.std(axis=0)
    sd = np.where(sd > 0, sd, 1.0)
    design = np.column_stack([np.ones(len(y)), (x - mean) / sd])

    def sums(size: int, part) -> np.ndarray:
        return part(0, design, y)[None] / len(y)

    tasks = [(g, t) for g in grid for t in taus]
    coef, _ = quantreg.settle(sums, 1, tasks, x.shape[1], np.array([y.mean()]), np.array([max(y.std(), 1e-12)]))
    return coef[0, :, 0] + ((others - mean) / sd) @ coef[0, :, 1:].T


def fit_predict_groups(train: DataFrame, test: DataFrame, grid: Sequence[dict], taus: Sequence[float] = quantreg.ENDPOINTS, trees: int | None = None) -> DataFrame:
    """Predictions of ``test`` (replicate, entity_id, role, y, multiplicity) by every candidate fitted on its replicate's ``train`` rows.

    A row of ``train`` counts ``multiplicity`` times. A (replicate, candidate) is a task; with more than
    GROUP_ROWS drawn rows in a replicate the models are spread over tasks instead. A replicate without
    training rows has no predictions.
    """
    ship(train.sparkSession)
    largest = train.groupBy("replicate").agg(F.sum("multiplicity").alias("n")).agg(F.max("n")).first()[0] or 0
    if largest > GROUP_ROWS:
        copies = lambda d: d.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("multiplicity").cast("int")))).drop("_copy", "multiplicity")
        spread = quantreg.fit_predict(copies(train), test.drop("multiplicity"), grid, taus, trees)
        return spread.join(test.select("replicate", "entity_id", "multiplicity"), ["replicate", "entity_id"])
    known = {g["candidate_id"]: g for g in grid}
    ids = F.explode(F.array(*[F.lit(k) for k in known])).alias("candidate_id")
    cols = ["replicate", ids, "entity_id", "role", "y", "summary", "full", "multiplicity"]
    both = train.select(*cols, F.lit(True).alias("learns")).unionByName(test.select(*cols, F.lit(False).alias("learns")))

    def run(key, group):
        fit, wanted = group[group["learns"]], group[~group["learns"]]
        g = known[key[1]]
        if not len(fit) or not len(wanted):
            return pd.DataFrame({c: [] for c in ("replicate", "candidate_id", "entity_id", "role", "y", "multiplicity", "tau", "prediction")})
        fit, wanted = (d.sort_values("entity_id", kind="stable") for d in (fit, wanted))
        fit = fit.loc[fit.index.repeat(fit["multiplicity"])]
        side = "summary" if g["family"] == "boosted" else "full"
        x, others = np.stack(fit[side].to_numpy()), np.stack(wanted[side].to_numpy())
        y = fit["y"].to_numpy(float)
        got = boost(x, y, others, [g], taus, trees) if g["family"] == "boosted" else solve_linear(x, y, others, [g], taus)
        own = wanted[["replicate", "candidate_id", "entity_id", "role", "y", "multiplicity"]]
        return pd.concat([own.assign(tau=t, prediction=got[:, i]) for i, t in enumerate(taus)])

    return both.groupBy("replicate", "candidate_id").applyInPandas(run, "replicate int, candidate_id string, entity_id long, role string, y double, multiplicity long, tau double, prediction double")


def intervals(predictions: DataFrame, taus: Sequence[float] = quantreg.ENDPOINTS) -> DataFrame:
    """Ordered lower and upper endpoint for each drawn entity, replicate and candidate."""
    low, high = taus
    side = lambda t: F.max(F.when(F.col("tau") == t, F.col("prediction")))
    g = predictions.groupBy("replicate", "entity_id", "role", "y", "candidate_id", "multiplicity").agg(side(low).alias("lower"), side(high).alias("upper"))
    return conformal.ordered_endpoints(g)


def drawn(df: DataFrame) -> DataFrame:
    """A row for each draw."""
    return df.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("multiplicity").cast("int")))).drop("_copy")


def bootstrap(prefix: DataFrame, entities: DataFrame, multiplicities: DataFrame, channels: Sequence[str], window: int, trees: int | None = None) -> DataFrame:
    """Select, refit and calibrate every replicate with preprocessors of its own stages; one row per replicate.

    ``multiplicities`` are draws from whole rosters. A replicate in which a stage has fewer distinct
    eligible entities than its minimum is ``failed`` with the stages named, and nothing of it is fitted.
    """
    gates = checkpointed(stage_gates(multiplicities, entities))
    draws = multiplicities.select(F.col("replicate").cast("int").alias("replicate"), "entity_id", "multiplicity")
    draws = checkpointed(draws.join(gates.filter("status = 'PASS'").select(F.col("replicate").cast("int").alias("replicate")), "replicate").join(entities.filter("eligible").select("entity_id"), "entity_id"))
    pre = checkpointed(linear.principal_component(stage_moments(entity_moments(prefix, channels), draws, channels), channels, ["replicate", "stage"]))
    windows = entity_windows(prefix, channels, window).join(draws, "entity_id")
    kinds = F.array(*[F.when(F.lit(stage == "refit") | (F.col("role") != "calibration"), F.lit(stage)) for stage in STAGES])
    rows = checkpointed(stage_features(windows.withColumn("stage", F.explode(F.array_compact(kinds))), pre))
    select, refit = rows.filter("stage = 'select'"), rows.filter("stage = 'refit'")
    grid = conformal.grid_rows()
    tuned = intervals(fit_predict_groups(select.filter("role = 'fit'"), select.filter("role = 'tune'"), grid, trees=trees))
    chosen = checkpointed(conformal.select_candidate(conformal.candidate_scores(drawn(tuned), conformal.candidate_grid(rows.sparkSession), by=["replicate"]), ["replicate"]).select("replicate", "candidate_id"))
    used = sorted(r[0] for r in chosen.select("candidate_id").distinct().collect())  # of the grid's candidates
    by_id = {g["candidate_id"]: g for g in grid}
    parts = []
    for candidate in used:  # only the replicates that chose a candidate refit it
        own = refit.join(chosen.filter(F.col("candidate_id") == candidate).select("replicate"), "replicate", "left_semi")
        parts.append(fit_predict_groups(own.filter("role <> 'calibration'"), own.filter("role = 'calibration'"), [by_id[candidate]], trees=trees))
    everyone = gates.select(F.col("replicate").cast("int").alias("replicate"), "draws", "eligible_draws", "failing_stages")
    if not parts:
        return everyone.withColumns({"status": F.lit("failed"), "candidate_id": F.lit(None).cast("string"), "n_calibration_rows": F.lit(None).cast("long"), "n_calibration_distinct": F.lit(None).cast("long"), "correction": F.lit(None).cast("double")})
    calibrated = parts[0]
    for p in parts[1:]:
        calibrated = calibrated.unionByName(p)
    scored = checkpointed(drawn(intervals(calibrated)).withColumn("score", conformal.nonconformity(F.col("y"), F.col("lower"), F.col("upper"))))
    q = conformal.corrections(scored, ["replicate"]).select("replicate", "correction")
    sizes = scored.groupBy("replicate").agg(F.count(F.lit(1)).alias("n_calibration_rows"), F.count_distinct("entity_id").alias("n_calibration_distinct"))
    out = everyone.join(chosen, "replicate", "left").join(sizes, "replicate", "left").join(q, "replicate", "left")
    return out.withColumn("status", F.when((F.size("failing_stages") == 0) & F.col("correction").isNotNull(), "completed").otherwise("failed"))
