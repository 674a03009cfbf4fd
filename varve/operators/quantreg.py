"""Quantile learners as iterated Spark aggregates.

Every pass reads the training rows once, reduces them inside each task to sums whose size depends
only on the number of models, and adds those sums up in Spark. All candidates, levels and bootstrap
replicates are fitted together; the driver holds trees and coefficients, never rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varve.session import checkpointed, ship

ENDPOINTS = (0.05, 0.95)
BINS = 64
SKETCH_ACCURACY = 10000


def pinball(y: Column, prediction: Column, tau: Column) -> Column:
    r = y - prediction
    return F.when(r >= 0, tau * r).otherwise((tau - 1) * r)


@dataclass
class Tree:
    """One depth-2 tree per (replicate, task). A node without a split sends every row left."""

    feature: np.ndarray  # (R, T, 3): root, left child, right child; -1 for no split
    cut: np.ndarray  # (R, T, 3): rows with bin <= cut go left
    value: np.ndarray  # (R, T, 4): leaf values, learning rate included

    def leaves(self, rep: np.ndarray, bins: np.ndarray) -> np.ndarray:
        n, t = len(rep), self.feature.shape[1]
        rows, tasks = np.arange(n)[:, None], np.arange(t)[None, :]
        r = rep[:, None]

        def right(slot: np.ndarray | int) -> np.ndarray:
            f = self.feature[r, tasks, slot]
            return (f >= 0) & (bins[rows, np.maximum(f, 0)] > self.cut[r, tasks, slot])

        top = right(0)
        return 2 * top + right(np.where(top, 2, 1))

    def add_to(self, scores: np.ndarray, rep: np.ndarray, bins: np.ndarray) -> np.ndarray:
        return scores + self.value[rep[:, None], np.arange(scores.shape[1])[None, :], self.leaves(rep, bins)]


@dataclass
class Boosted:
    grid: list[dict]
    taus: tuple[float, ...]
    reps: list[int]
    edges: np.ndarray
    start: np.ndarray
    trees: list[Tree] = field(default_factory=list)

    @property
    def tasks(self) -> list[tuple[dict, float]]:
        return [(g, tau) for g in self.grid for tau in self.taus]


def _replicates(rows: DataFrame) -> tuple[DataFrame, list[int]]:
    """Give rows a dense replicate number (a single 0 without replicates); replicate ids are few."""
    if "replicate" not in rows.columns:
        return rows.withColumn("_rep", F.lit(0)), [0]
    ids = sorted(r[0] for r in rows.select("replicate").distinct().collect())
    position = F.array_position(F.array(*map(F.lit, ids)), F.col("replicate")) - 1
    return rows.withColumn("_rep", position.cast("int")), ids


def _matrix(series: pd.Series) -> np.ndarray:
    return np.stack(series.to_numpy()).astype(float) if len(series) else np.zeros((0, 0))


def fit_boosted(rows: DataFrame, grid: Sequence[dict], taus: Sequence[float] = ENDPOINTS, trees: int | None = None, features: str = "summary", refresh: int = 8) -> Boosted:
    """Gradient boosting of the pinball loss with histogram splits of depth 1 or 2.

    A round makes one histogram pass per tree level and one pass for the leaf quantiles. New trees
    are applied on the fly and folded into the written score table every ``refresh`` rounds.
    """
    grid, taus = list(grid), tuple(float(t) for t in taus)
    ship(rows.sparkSession)
    rows, reps = _replicates(rows)
    tasks = [(g, tau) for g in grid for tau in taus]
    n_rep, n_task = len(reps), len(tasks)
    tau_of = np.array([tau for _, tau in tasks])
    leaf_min = np.array([g["leaf"] for g, _ in tasks])
    depth = np.array([g["depth"] for g, _ in tasks])
    rate = np.array([g["rate"] for g, _ in tasks])
    rounds = trees if trees is not None else max(g["trees"] for g in grid)

    # bin borders: a bounded sketch per feature, shared by all replicates
    fractions = F.array(*[F.lit((i + 1) / BINS) for i in range(BINS - 1)])
    width = len(rows.select(features).first()[0])
    sketch = rows.agg(*[F.percentile_approx(F.col(features)[i], fractions, SKETCH_ACCURACY).alias(f"e{i}") for i in range(width)]).first()
    edges = np.array([list(sketch[i]) for i in range(width)])
    starts = rows.groupBy("_rep").agg(F.percentile_approx("y", F.array(*map(F.lit, taus)), SKETCH_ACCURACY).alias("q")).collect()
    start = np.zeros((n_rep, n_task))
    for r in starts:
        start[r["_rep"]] = np.tile(np.array(r["q"]), len(grid))
    model = Boosted(grid, taus, reps, edges, start)

    state_schema = "_rep int, y double, bins array<int>, scores array<double>"

    def bin_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = _matrix(pdf["x"])
            b = np.column_stack([np.searchsorted(edges[i], x[:, i], side="left") for i in range(width)])
            yield pd.DataFrame({"_rep": pdf["_rep"], "y": pdf["y"], "bins": list(b), "scores": list(start[pdf["_rep"].to_numpy()])})

    state = checkpointed(rows.select("_rep", "y", F.col(features).alias("x")).mapInPandas(bin_rows, state_schema))
    pending: list[Tree] = []

    def unpack(pdf: pd.DataFrame, waiting: list[Tree]):
        rep, b, s = pdf["_rep"].to_numpy(), np.stack(pdf["bins"].to_numpy()).astype(int), _matrix(pdf["scores"])
        for t in waiting:
            s = t.add_to(s, rep, b)
        return rep, b, s, pdf["y"].to_numpy(float)

    n_bin = BINS

    def histogram(level: int, tree: Tree, waiting: list[Tree]) -> tuple[np.ndarray, np.ndarray]:
        shape = (n_rep, n_task, 2, width, n_bin)
        size = int(np.prod(shape))

        def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            g_sum, n_sum = np.zeros(size), np.zeros(size)
            for pdf in batches:
                if not len(pdf):
                    continue
                rep, b, s, y = unpack(pdf, waiting)
                grad = np.where(y[:, None] > s, tau_of, tau_of - 1.0)
                node = tree.leaves(rep, b) // 2 if level else np.zeros_like(s, dtype=int)
                base = (rep[:, None] * n_task + np.arange(n_task)) * 2 + node
                for f in range(width):
                    idx = ((base * width + f) * n_bin + b[:, [f]]).ravel()
                    g_sum += np.bincount(idx, grad.ravel(), size)
                    n_sum += np.bincount(idx, minlength=size)
            hit = np.nonzero(n_sum)[0]
            yield pd.DataFrame({"i": hit, "g": g_sum[hit], "n": n_sum[hit]})

        total = state.mapInPandas(reduce, "i long, g double, n double").groupBy("i").agg(F.sum("g").alias("g"), F.sum("n").alias("n")).toPandas()
        g_all, n_all = np.zeros(size), np.zeros(size)
        g_all[total["i"]], n_all[total["i"]] = total["g"], total["n"]
        return g_all.reshape(shape), n_all.reshape(shape)

    def best_split(g: np.ndarray, n: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest between-children gradient contrast per (replicate, task) of one node's histogram."""
        gl, nl = g.cumsum(-1), n.cumsum(-1)
        gr, nr = gl[..., -1:] - gl, nl[..., -1:] - nl
        ok = (nl >= least[None, :, None, None]) & (nr >= least[None, :, None, None])
        with np.errstate(all="ignore"):
            gain = np.where(ok, nl * nr / (nl + nr) * (gl / nl - gr / nr) ** 2, -1.0)
        flat = gain.reshape(n_rep, n_task, -1)
        at = flat.argmax(-1)
        found = np.take_along_axis(flat, at[..., None], -1)[..., 0] > 0
        return np.where(found, at // n_bin, -1), at % n_bin

    for step in range(rounds):
        tree = Tree(np.full((n_rep, n_task, 3), -1), np.zeros((n_rep, n_task, 3), int), np.zeros((n_rep, n_task, 4)))
        g, n = histogram(0, tree, list(pending))
        tree.feature[..., 0], tree.cut[..., 0] = best_split(g[:, :, 0], n[:, :, 0], leaf_min)
        if (depth > 1).any():
            g, n = histogram(1, tree, list(pending))
            for child in (0, 1):
                f, c = best_split(g[:, :, child], n[:, :, child], leaf_min)
                splits = (depth > 1)[None, :] & (tree.feature[..., 0] >= 0)
                tree.feature[..., 1 + child], tree.cut[..., 1 + child] = np.where(splits, f, -1), c
        waiting, shape_now = list(pending), Tree(tree.feature.copy(), tree.cut.copy(), tree.value.copy())

        def residuals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if not len(pdf):
                    continue
                rep, b, s, y = unpack(pdf, waiting)
                key = (rep[:, None] * n_task + np.arange(n_task)) * 4 + shape_now.leaves(rep, b)
                yield pd.DataFrame({"key": key.ravel(), "r": (y[:, None] - s).ravel()})

        levels = F.array(*[F.lit(t) for t in taus])
        found = state.mapInPandas(residuals, "key long, r double").groupBy("key").agg(F.percentile_approx("r", levels, SKETCH_ACCURACY).alias("q")).collect()
        for row in found:
            rt, leaf = divmod(row["key"], 4)
            rep_i, task = divmod(rt, n_task)
            tree.value[rep_i, task, leaf] = rate[task] * row["q"][task % len(taus)]
        model.trees.append(tree)
        pending.append(tree)
        if len(pending) >= refresh and step + 1 < rounds:
            applied = list(pending)

            def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for pdf in batches:
                    if len(pdf):
                        yield pdf.assign(scores=list(unpack(pdf, applied)[2]))

            state = checkpointed(state.mapInPandas(fold, state_schema))
            pending = []
    return model


def predict_boosted(rows: DataFrame, model: Boosted, features: str = "summary", id_col: str = "entity_id") -> DataFrame:
    """Predictions of every task: (replicate,) id, y, candidate_id, tau, prediction."""
    by = ["replicate"] if "replicate" in rows.columns else []
    rows, _ = _replicates(rows) if not by else (rows.withColumn("_rep", (F.array_position(F.array(*map(F.lit, model.reps)), F.col("replicate")) - 1).cast("int")), None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            rep, x = pdf["_rep"].to_numpy(), _matrix(pdf["x"])
            b = np.column_stack([np.searchsorted(model.edges[i], x[:, i], side="left") for i in range(x.shape[1])])
            s = model.start[rep]
            for t in model.trees:
                s = t.add_to(s, rep, b)
            yield pdf.drop(columns=["x", "_rep"]).assign(p=list(s))

    keep = [*by, id_col, "role", "y"]
    types = {"replicate": "int", id_col: "long", "role": "string", "y": "double"}
    schema = ", ".join(f"{c} {types[c]}" for c in keep) + ", p array<double>"
    scored = rows.filter(F.col("_rep") >= 0).select(*keep, "_rep", F.col(features).alias("x")).mapInPandas(run, schema)
    return _long(scored, keep, model.tasks)


def _long(scored: DataFrame, keep: Sequence[str], tasks: Sequence[tuple[dict, float]]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(g["candidate_id"]).alias("candidate_id"), F.lit(tau).alias("tau"), F.col("p")[i].alias("prediction")) for i, (g, tau) in enumerate(tasks)])
    return scored.select(*keep, F.inline(cells))


@dataclass
class Linear:
    grid: list[dict]
    taus: tuple[float, ...]
    reps: list[int]
    mean: np.ndarray
    sd: np.ndarray
    coef: np.ndarray  # (R, T, p + 1), intercept first
    objective: np.ndarray

    @property
    def tasks(self) -> list[tuple[dict, float]]:
        return [(g, tau) for g in self.grid for tau in self.taus]


def _soft_descent(a: np.ndarray, c: np.ndarray, lam: np.ndarray, b: np.ndarray, sweeps: int = 200) -> np.ndarray:
    """Coordinate descent of b'Ab - 2c'b + lam * |b[1:]|_1, all models of the batch together."""
    b = b.copy()
    diag = np.maximum(np.einsum("mjj->mj", a), 1e-300)
    for _ in range(sweeps):
        before = b.copy()
        for j in range(b.shape[1]):
            rho = c[:, j] - np.einsum("mk,mk->m", a[:, j], b) + a[:, j, j] * b[:, j]
            b[:, j] = rho / diag[:, j] if j == 0 else np.sign(rho) * np.maximum(np.abs(rho) - lam / 2.0, 0.0) / diag[:, j]
        if np.max(np.abs(b - before) * np.sqrt(diag)) < 1e-10:
            break
    return b


STEPS = (1.0, 0.5, 0.25, 0.1, 0.03, 0.01, 0.001, 1.5, 3.0, 8.0)
LEVELS = tuple(0.1 * 0.25**k for k in range(9))


def settle(sums, n_rep: int, tasks: Sequence[tuple[dict, float]], p: int, ym: np.ndarray, ys: np.ndarray, max_rounds: int = 400, gap: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (replicates, tasks, p + 1) and objectives; ``sums(size, part)`` averages ``part(rep, design, y)`` over the rows of each replicate."""
    n_task, q = len(tasks), p + 1
    tau_of, lam = np.array([tau for _, tau in tasks]), np.array([g["alpha"] for g, _ in tasks])
    coef = np.zeros((n_rep, n_task, q))
    coef[..., 0] = ym[:, None]

    def curvature(coefs: np.ndarray, level: float):
        def part(r: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
            eps = level * ys[r]
            res = y[:, None] - x @ coefs[r].T
            soft = np.sqrt(res * res + eps * eps)
            slope = tau_of - 0.5 + res / (2 * soft)
            # Newton's weight, with a little of the weight that surely descends where few residuals are near zero
            w = eps * eps / (2 * soft**3) + 0.02 / (2 * soft)
            return np.stack([np.concatenate([(x.T @ (x * w[:, [t]])).ravel(), x.T @ slope[:, t]]) for t in range(n_task)])

        return part

    def losses(trials: np.ndarray, level: float):
        def part(r: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
            eps = level * ys[r]
            res = y[:, None, None] - np.einsum("np,tsp->nts", x, trials[r])
            return ((tau_of - 0.5)[:, None] * res + 0.5 * np.sqrt(res * res + eps * eps)).sum(axis=0)

        return part

    lengths, rounds = np.array((0.0, *STEPS)), 0
    for level in LEVELS:
        open_models = np.ones((n_rep, n_task), bool)
        while open_models.any():
            if rounds == max_rounds:
                raise RuntimeError(f"{int(open_models.sum())} linear models did not settle in {max_rounds} rounds")
            rounds += 1
            acc = sums(q * q + q, curvature(coef, level))
            hess = acc[..., : q * q].reshape(-1, q, q)
            flat = coef.reshape(-1, q)
            target = (np.einsum("mij,mj->mi", hess, flat) + acc[..., q * q :].reshape(-1, q)) / 2
            step = _soft_descent(hess / 2, target, np.tile(lam, n_rep), flat).reshape(n_rep, n_task, q) - coef
            trials = coef[:, :, None] + lengths[:, None] * step[:, :, None]
            objective = sums(len(lengths), losses(trials, level)) + lam[:, None] * np.abs(trials[..., 1:]).sum(-1)
            pick = objective.argmin(axis=-1)
            lowest = np.take_along_axis(objective, pick[..., None], -1)[..., 0]
            open_models = objective[..., 0] - lowest > (gap if level == LEVELS[-1] else 100 * gap) * np.maximum(np.abs(objective[..., 0]), 1e-12)
            coef = np.take_along_axis(trials, pick[..., None, None], 2)[:, :, 0]
    return coef, lowest


def fit_linear(rows: DataFrame, grid: Sequence[dict], taus: Sequence[float] = ENDPOINTS, features: str = "full", max_rounds: int = 400, gap: float = 1e-6) -> Linear:
    """L1-penalised linear quantile regression: mean pinball loss + alpha * |coefficients|_1.

    The pinball loss is rounded off near zero, by less and less of the target's spread (``LEVELS``).
    A round is a penalised Newton step: one aggregate for the weighted Gram matrices, a small solve,
    and one aggregate for the losses at several step lengths, of which the best is taken. A level is
    left when no step lowers any objective by more than ``gap`` of it (the last level; 100 times that before); rounds that run out before the
    last level is done are an error.
    """
    grid, taus = list(grid), tuple(float(t) for t in taus)
    ship(rows.sparkSession)
    rows, reps = _replicates(rows)
    tasks = [(g, tau) for g in grid for tau in taus]
    n_rep, n_task = len(reps), len(tasks)
    rows = checkpointed(rows.select("_rep", "y", F.col(features).alias("x")))
    p = len(rows.select("x").first()[0])
    moments = rows.select("_rep", "y", F.posexplode("x").alias("k", "v")).groupBy("_rep", "k").agg(
        F.avg("v").alias("m"), F.stddev_pop("v").alias("s"), F.count(F.lit(1)).alias("n"), F.avg("y").alias("ym"), F.stddev_pop("y").alias("ys")).collect()
    mean, sd, n_of, ys, ym = np.zeros((n_rep, p)), np.ones((n_rep, p)), np.ones(n_rep), np.ones(n_rep), np.zeros(n_rep)
    for r in moments:
        mean[r["_rep"], r["k"]] = r["m"]
        sd[r["_rep"], r["k"]] = r["s"] if r["s"] > 0 else 1.0
        n_of[r["_rep"]], ys[r["_rep"]], ym[r["_rep"]] = r["n"], max(r["ys"], 1e-12), r["ym"]

    def sums(size: int, part) -> np.ndarray:
        """Add up ``part(rep, x, y)`` (tasks x size numbers) over all rows, first within each task."""

        def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            acc = np.zeros((n_rep, n_task, size))
            for pdf in batches:
                rep_all, y_all = pdf["_rep"].to_numpy(), pdf["y"].to_numpy(float)
                x_all = _matrix(pdf["x"]) if len(pdf) else np.zeros((0, p))
                for r in np.unique(rep_all):
                    at = rep_all == r
                    acc[r] += part(r, np.column_stack([np.ones(at.sum()), (x_all[at] - mean[r]) / sd[r]]), y_all[at])
            yield pd.DataFrame({"rt": np.arange(n_rep * n_task), "v": list(acc.reshape(n_rep * n_task, size))})

        parts = rows.mapInPandas(reduce, "rt int, v array<double>").select("rt", F.posexplode("v").alias("i", "v"))
        total = parts.groupBy("rt", "i").agg(F.sum("v").alias("v")).toPandas()
        out = np.zeros((n_rep * n_task, size))
        out[total["rt"], total["i"]] = total["v"]
        return out.reshape(n_rep, n_task, size) / n_of[:, None, None]

    coef, lowest = settle(sums, n_rep, tasks, p, ym, ys, max_rounds, gap)
    return Linear(grid, taus, reps, mean, sd, coef, lowest)


def predict_linear(rows: DataFrame, model: Linear, features: str = "full", id_col: str = "entity_id") -> DataFrame:
    by = ["replicate"] if "replicate" in rows.columns else []
    rep = (F.array_position(F.array(*map(F.lit, model.reps)), F.col("replicate")) - 1).cast("int") if by else F.lit(0)
    keep = [*by, id_col, "role", "y"]
    types = {"replicate": "int", id_col: "long", "role": "string", "y": "double"}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            r = pdf["_rep"].to_numpy()
            x = (_matrix(pdf["x"]) - model.mean[r]) / model.sd[r]
            s = model.coef[r][..., 0] + np.einsum("np,ntp->nt", x, model.coef[r][..., 1:])
            yield pdf.drop(columns=["x", "_rep"]).assign(p=list(s))

    schema = ", ".join(f"{c} {types[c]}" for c in keep) + ", p array<double>"
    scored = rows.withColumn("_rep", rep).filter(F.col("_rep") >= 0).select(*keep, "_rep", F.col(features).alias("x")).mapInPandas(run, schema)
    return _long(scored, keep, model.tasks)


def fit_predict(train: DataFrame, test: DataFrame, grid: Sequence[dict], taus: Sequence[float] = ENDPOINTS, trees: int | None = None) -> DataFrame:
    """Fit every candidate of both families on ``train`` and predict ``test``."""
    boosted, linear = [g for g in grid if g["family"] == "boosted"], [g for g in grid if g["family"] == "linear"]
    parts = []
    if boosted:
        parts.append(predict_boosted(test, fit_boosted(train, boosted, taus, trees)))
    if linear:
        parts.append(predict_linear(test, fit_linear(train, linear, taus)))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
