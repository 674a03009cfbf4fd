"""Weighted moments, first principal component, and least squares through QR.

Rows are reduced by Spark; what is left for NumPy is k x k algebra on one row per stage.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varve.functions.special import t_ppf
from varve.session import ship

SD_FLOOR = 1e-8
ROW_SPACE_TOLERANCE = 1e-8


def entity_weights(prefix: DataFrame, by: Sequence[str] = ("stage",), multiplicity: str | None = None, id_col: str = "entity_id") -> DataFrame:
    """Row weight m / (M * C): each entity weighs in proportion to its multiplicity (1 when none is given)."""
    m = F.col(multiplicity).cast("double") if multiplicity else F.lit(1.0)
    firsts = prefix.filter(F.col("cycle") == 1)
    totals = firsts.groupBy(*by).agg(F.sum(m).alias("_total"))
    # one row per (replicate, stage)
    return prefix.join(F.broadcast(totals), list(by)).withColumn("weight", m / (F.col("_total") * F.col("cutoff"))).drop("_total")


def weighted_moments(rows: DataFrame, channels: Sequence[str], by: Sequence[str] = ("stage",), weight: str = "weight") -> DataFrame:
    """Weighted means and centred cross-products (upper triangle), one row per stage.

    Two passes: the one-pass form cancels when the mean is large against the spread.
    """
    w = F.col(weight)
    means = rows.groupBy(*by).agg(*[F.sum(w * F.col(c)).alias(f"mean_{c}") for c in channels], F.sum(w).alias("weight_sum"))
    centred = rows.join(F.broadcast(means), list(by))
    d = {c: F.col(c) - F.col(f"mean_{c}") for c in channels}
    k = len(channels)
    pairs = [(channels[i], channels[j]) for i in range(k) for j in range(i, k)]
    cross = centred.groupBy(*by).agg(*[F.sum(w * d[a] * d[b]).alias(f"cov_{a}_{b}") for a, b in pairs])
    return means.join(F.broadcast(cross), list(by))


def channel_scales(rows: DataFrame, channels: Sequence[str], floor: float = 1e-12) -> DataFrame:
    """Population SD of each channel, 1 where it does not exceed ``floor``; one row."""
    sd = {c: F.stddev_pop(c) for c in channels}
    return rows.agg(*[F.when(sd[c] > floor, sd[c]).otherwise(F.lit(1.0)).alias(f"scale_{c}") for c in channels])


_PCA_SCHEMA = "sd array<double>, retained array<boolean>, pc array<double>, pc_scale double, explained double, status string"


def _pca(covariances: pd.Series) -> pd.DataFrame:
    out = []
    for flat in covariances:
        k = int(round(len(flat) ** 0.5))
        cov = np.asarray(flat, float).reshape(k, k)
        sd = np.sqrt(np.clip(np.diag(cov), 0.0, None))
        keep = sd > SD_FLOOR
        row = {"sd": sd, "retained": keep, "pc": np.zeros(k), "pc_scale": None, "explained": None, "status": "no_channel_left"}
        if keep.any() and np.isfinite(cov).all():
            corr = cov[np.ix_(keep, keep)] / np.outer(sd[keep], sd[keep])
            eig, vec = np.linalg.eigh(corr)
            lead = vec[:, -1]
            lead = lead if lead[np.argmax(np.abs(lead))] > 0 else -lead
            row["pc"][keep] = lead
            scale = float(np.sqrt(eig[-1])) if eig[-1] > 0 else 0.0
            usable = np.isfinite(scale) and scale > 0
            row |= {"pc_scale": scale, "explained": float(eig[-1] / eig.sum()), "status": "ok" if usable else "zero_scale"}
        out.append(row)
    return pd.DataFrame(out)


def principal_component(moments: DataFrame, channels: Sequence[str], by: Sequence[str] = ("stage",)) -> DataFrame:
    """Leading eigenvector of the weighted correlation matrix of each stage.

    Channels whose weighted SD is at most 1e-8 drop out; the largest absolute loading is positive.
    """
    ship(moments.sparkSession)
    k = len(channels)
    name = lambda i, j: f"cov_{channels[min(i, j)]}_{channels[max(i, j)]}"
    flat = F.array(*[F.col(name(i, j)) for i in range(k) for j in range(k)])
    mean = F.array(*[F.col(f"mean_{c}") for c in channels])
    fitted = moments.select(*by, mean.alias("mean"), F.pandas_udf(_pca, _PCA_SCHEMA)(flat).alias("_f"))
    return fitted.select(*by, "mean", "_f.*")


def project(rows: DataFrame, pre: DataFrame, channels: Sequence[str], by: Sequence[str] = ("stage",)) -> DataFrame:
    """Score of each row on the frozen component: standardise the retained channels, project, scale."""
    # one preprocessor row per (replicate, stage), each a few arrays of channel length
    j = rows.join(F.broadcast(pre.select(*by, "mean", "sd", "retained", "pc", "pc_scale")), list(by))
    z: Column = F.lit(0.0)
    for i, c in enumerate(channels):
        z = z + F.when(F.col("retained")[i], (F.col(c) - F.col("mean")[i]) / F.col("sd")[i] * F.col("pc")[i]).otherwise(F.lit(0.0))
    return j.withColumn("z", z / F.col("pc_scale")).drop("mean", "sd", "retained", "pc", "pc_scale")


def fit_least_squares(rows: DataFrame, features: Sequence[str], target: Column, by: str = "stage", alpha: float = 0.1, fan_in: int = 64) -> DataFrame:
    """Least squares of ``target`` on an intercept and ``features`` with the singular values kept.

    Every task reduces its rows to one triangular factor, factors are merged in two steps, and the
    last p x p factor goes through an SVD: normal equations would square the condition number.
    """
    p = len(features) + 1
    width = p + 1
    data = rows.select(by, *[F.col(f).cast("double") for f in features], target.cast("double").alias("_y"))
    data = data.withColumn("_salt", (F.spark_partition_id() % fan_in).cast("int"))
    part_schema = f"{by} string, _salt int, n long, r array<double>"

    def shrink(block: np.ndarray) -> np.ndarray:
        r = np.linalg.qr(block, mode="r")
        return np.vstack([r, np.zeros((width - len(r), width))]) if len(r) < width else r

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[str, int], tuple[int, np.ndarray]] = {}
        for pdf in batches:
            for (stage, salt), part in pdf.groupby([by, "_salt"]):
                x = np.column_stack([np.ones(len(part)), part[list(features)].to_numpy(float), part["_y"].to_numpy(float)])
                n, r = held.get((stage, salt), (0, np.zeros((0, width))))
                held[(stage, salt)] = (n + len(part), shrink(np.vstack([r, x])))
        for (stage, salt), (n, r) in held.items():
            yield pd.DataFrame({by: [stage], "_salt": [salt], "n": [n], "r": [r.ravel()]})

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        stack = np.vstack([np.asarray(v).reshape(width, width) for v in pdf["r"]])
        return pd.DataFrame({by: [pdf[by].iloc[0]], "_salt": [0], "n": [int(pdf["n"].sum())], "r": [shrink(stack).ravel()]})

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        merged = merge(pdf)
        n = int(merged["n"].iloc[0])
        r = np.asarray(merged["r"].iloc[0]).reshape(width, width)
        rx, ry, rest = r[:, :p], r[:, p], None
        _, s, vt = np.linalg.svd(rx, full_matrices=False)
        row = {by: pdf[by].iloc[0], "n": n, "rank": 0, "status": "zero_rank", "coefficients": None, "directions": None, "singular": None, "residual_variance": None, "dof": None, "t_upper": None}
        if s[0] > 0:
            u, s, vt = np.linalg.svd(rx, full_matrices=False)
            rank = int((s > np.finfo(float).eps * max(n, p) * s[0]).sum())
            coef = vt[:rank].T @ ((u[:, :rank].T @ ry) / s[:rank])
            rest = ry - rx @ coef
            dof = n - rank
            row |= {"rank": rank, "dof": dof, "coefficients": coef, "directions": vt[:rank].ravel(), "singular": s[:rank], "status": "no_residual_dof"}
            if dof > 0:
                row |= {"residual_variance": float(rest @ rest / dof), "t_upper": t_ppf(1.0 - alpha / 2.0, dof), "status": "ok"}
        return pd.DataFrame([row])

    model_schema = f"{by} string, n long, rank int, status string, coefficients array<double>, directions array<double>, singular array<double>, residual_variance double, dof long, t_upper double"
    partials = data.mapInPandas(partial, part_schema)
    merged = partials.groupBy(by, "_salt").applyInPandas(merge, part_schema)
    return merged.groupBy(by).applyInPandas(solve, model_schema)


def predict_least_squares(rows: DataFrame, model: DataFrame, features: Sequence[str], by: str = "stage", strict: bool = True) -> DataFrame:
    """Exponentiated Student-t interval and median for a model of the log target.

    A row with a component outside the fitted row space (1e-8 relative) cannot be predicted: strict
    mode raises, otherwise it is flagged and its interval is null.
    """
    p = len(features) + 1
    j = rows.join(F.broadcast(model.drop("n")), by)
    x = [F.lit(1.0), *[F.col(f).cast("double") for f in features]]
    design = F.array(*x)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda acc, v: acc + v)
    j = j.withColumn("_x", design)
    direction = lambda i: F.slice("directions", i * p + 1, p)
    coords = F.transform(F.sequence(F.lit(0), F.col("rank") - 1), lambda i: dot(F.slice(F.col("directions"), i * p + 1, p), F.col("_x")))
    j = j.withColumn("_c", coords)
    norm2 = dot(F.col("_x"), F.col("_x"))
    # outside part: subtract each retained direction in turn instead of differencing squared norms
    residual = F.aggregate(
        F.sequence(F.lit(0), F.col("rank") - 1), F.col("_x"),
        lambda acc, i: F.zip_with(acc, F.slice(F.col("directions"), i * p + 1, p), lambda a, v: a - v * F.element_at(F.col("_c"), (i + 1).cast("int"))),
    )
    j = j.withColumn("_out", F.sqrt(dot(residual, residual)))
    ok = (F.col("_out") <= F.lit(ROW_SPACE_TOLERANCE) * F.greatest(F.lit(1.0), F.sqrt(norm2))) & (F.col("status") == "ok")
    j = j.withColumn("estimable", ok)
    leverage = F.aggregate(F.zip_with("_c", "singular", lambda c, s: (c / s) * (c / s)), F.lit(0.0), lambda acc, v: acc + v)
    location = dot(F.col("_x"), F.col("coefficients"))
    half = F.col("t_upper") * F.sqrt(F.col("residual_variance") * (F.lit(1.0) + leverage))
    guard = F.col("estimable")
    if strict:
        guard = F.when(F.col("estimable"), F.lit(True)).otherwise(F.raise_error(F.lit("row outside the fitted row space")).cast("boolean"))
    value = lambda c: F.when(guard, c)
    out = j.withColumn("lower", value(F.exp(location - half))).withColumn("median", value(F.exp(location))).withColumn("upper", value(F.exp(location + half)))
    return out.drop("_x", "_c", "_out", "rank", "status", "coefficients", "directions", "singular", "residual_variance", "dof", "t_upper")
