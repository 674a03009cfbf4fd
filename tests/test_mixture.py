import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from varve.functions.special import norm_ppf
from varve.operators import mixture, precision

SCHEMA = "entity_id long, chain int, draw long, mu double, var double, log_w double, sigma_r double"
# The parameters of the simulation law that the mixture is checked under.
TRUTH = dict(beta0=math.log(100), beta1=-0.4, gamma0=-0.35, gamma1=0.15, g00=0.1, g01=0.5, g10=-0.1, g11=-0.25, tau0=0.45, tau1=0.3, r_g=0.2, sigma_z=0.3, sigma_r=0.25)


def _dense(z, cutoff, p, rho):
    """Latent line plus AR(1) noise, by plain matrix algebra."""
    w = len(z)
    a = np.array([1.0, math.log(cutoff / 100)])
    b = np.column_stack([np.ones(w), np.arange(-(w - 1), 1) / 30.0])
    m = np.array([[p["g00"], p["g01"]], [p["g10"], p["g11"]]]) @ a
    c = p["tau0"] * p["tau1"] * p["r_g"]
    s = np.array([[p["tau0"] ** 2, c], [c, p["tau1"] ** 2]])
    v = b @ s @ b.T + p["sigma_z"] ** 2 * rho ** np.abs(np.subtract.outer(np.arange(w), np.arange(w)))
    u = z - b @ m
    solve = np.linalg.solve(v, u)
    gamma = np.array([p["gamma0"], p["gamma1"]])
    post = s - s @ b.T @ np.linalg.solve(v, b @ s)
    log_w = -0.5 * (w * math.log(2 * math.pi) + np.linalg.slogdet(v)[1] + u @ solve)
    return log_w, a @ [p["beta0"], p["beta1"]] + gamma @ (m + s @ b.T @ solve), p["sigma_r"] ** 2 + gamma @ post @ gamma


def test_sensor_terms_against_dense_algebra(spark):
    rng = np.random.default_rng(3)
    seqs = {1: rng.normal(size=1), 2: rng.normal(size=2), 30: rng.normal(size=30)}
    rows = [(w, 40 + i - w + 1, 40, float(v)) for w, z in seqs.items() for i, v in enumerate(z)]
    sums = mixture.sequence_sums(spark.createDataFrame(rows, "entity_id long, cycle int, cutoff int, z double")).withColumn("fit", F.lit(0))
    rhos = [-0.5, 0.0, 0.5, 0.9, 0.99]
    draws = spark.createDataFrame([(0, 0, i, r) for i, r in enumerate(rhos)], "fit int, chain int, draw long, rho double").withColumns({k: F.lit(v) for k, v in TRUTH.items()})
    got = mixture.sensor_terms(sums, draws).collect()
    assert len(got) == 15
    for r in got:
        want = _dense(seqs[r.entity_id], 40, TRUTH, rhos[r.draw])
        assert np.allclose([r.log_w, r.mu, r["var"]], want, rtol=1e-8, atol=1e-8)


def test_single_component_and_contamination(spark):
    one = spark.createDataFrame([(1, 0, d, 4.0, 0.25, 0.0, 0.2) for d in range(8)], SCHEMA)
    q = {r.p: r for r in mixture.mixture_quantiles(mixture.prepare(one, ["entity_id"]), ["entity_id"]).collect()}
    for p in mixture.PROBS:
        assert q[p].quantile == pytest.approx(math.exp(4 + 0.5 * norm_ppf(p)), rel=1e-10)
        assert abs(q[p].residual) <= 1e-12 and q[p].weight_ess == pytest.approx(8)
    wide = mixture.mixture_quantiles(mixture.prepare(one, ["entity_id"], "contamination"), ["entity_id"], error="contamination")
    assert wide.filter("p = 0.95").first().quantile > q[0.95].quantile


def test_precision_against_numpy(spark):
    rng = np.random.default_rng(11)
    chains, draws = 4, 400
    theta = rng.normal(size=(chains, draws))
    mu, var, lw = math.log(100) + 0.2 * theta, np.full_like(theta, 0.09), -0.5 * (1 - theta) ** 2
    rows = [(1, c, d, float(mu[c, d]), 0.09, float(lw[c, d]), 0.0) for c in range(chains) for d in range(draws)]
    terms = spark.createDataFrame(rows, SCHEMA)
    prepared = mixture.prepare(terms, ["entity_id"])
    q = mixture.mixture_quantiles(prepared, ["entity_id"])
    sizes = terms.select("entity_id").distinct().withColumn("sizes", F.array(F.lit(10), F.lit(20)))
    rec = precision.quantile_mcse(precision.influence(prepared, q, ["entity_id"], sizes), q, ["entity_id"], 0.05)
    got = {(r.p, r.batch_size): r for r in rec.collect()}
    phi = np.vectorize(lambda v: 0.5 * math.erfc(-v / math.sqrt(2)))
    w = np.exp(lw - lw.max())
    for r in q.collect():
        f = phi((r.q - mu) / 0.3)
        dens = (w * np.exp(-0.5 * ((r.q - mu) / 0.3) ** 2) / (0.3 * math.sqrt(2 * math.pi))).sum() / w.sum()
        assert (w * f).sum() / w.sum() == pytest.approx(r.p, abs=1e-11) and dens == pytest.approx(r.density, rel=1e-10)
        h = w * (f - r.p)
        for b in (10, 20):
            means = h.reshape(chains, draws // b, b).mean(-1)
            lrv = b * means.var(axis=1, ddof=1)
            v = (draws * lrv).sum() / (w.size**2 * w.mean() ** 2 * dens**2)
            g = got[(r.p, b)]
            assert g.log_variance == pytest.approx(v, rel=1e-9)
            assert g.influence_ess == pytest.approx(h.var(ddof=1) / (v * (dens * w.mean()) ** 2), rel=1e-8)
            assert g.dof == pytest.approx((lrv.sum()) ** 2 / ((lrv**2).sum() / (draws // b - 1)), rel=1e-8)
            assert g.upper_mcse > g.mcse
    # stored as computed nothing comes back; a changed value and a moved root do
    again = lambda s: sorted((r.p, r.batch_size, r.column) for r in mixture.recheck_precision(prepared, s, ["entity_id"], 0.05, rtol=1e-11).collect())
    default = precision.quantile_mcse(precision.influence(prepared, q, ["entity_id"], precision.chain_sizes(prepared, ["entity_id"])), q, ["entity_id"], 0.05)
    stored = default.join(q.select("entity_id", "p", "q"), ["entity_id", "p"])
    first = min(r.batch_size for r in stored.collect())
    assert again(stored) == []
    assert again(stored.withColumn("upper_mcse", F.when((F.col("p") == 0.5) & (F.col("batch_size") == first), F.col("upper_mcse") * 1.000001).otherwise(F.col("upper_mcse")))) == [(0.5, first, "upper_mcse")]
    assert {(p, c) for p, _, c in again(stored.withColumn("q", F.when(F.col("p") == 0.95, F.col("q") + 1e-6).otherwise(F.col("q"))))} >= {(0.95, "mcse"), (0.95, "influence_ess")}


def test_long_run_variance_and_batch_rules(spark):
    rng = np.random.default_rng(7)
    e = rng.normal(size=(4, 8192))
    ar = np.zeros_like(e)
    for t in range(1, e.shape[1]):
        ar[:, t] = 0.6 * ar[:, t - 1] + np.sqrt(1 - 0.36) * e[:, t]
    rows = [(k, c, d, float(s[c, d])) for k, s in (("iid", e), ("ar", ar)) for c in range(4) for d in range(8192)]
    df = spark.createDataFrame(rows, "key string, chain int, draw long, x double")
    lrv = {r.key: r.v for r in precision.batch_means(df, ["key"], "x", F.array(F.lit(64))).groupBy("key").agg(F.avg("lrv").alias("v")).collect()}
    assert abs(lrv["iid"] - 1) < 0.2 and abs(lrv["ar"] - 4) < 0.8
    one = precision.batch_means(df.filter("draw < 5"), ["key"], "x", F.array(F.lit(4))).first()
    assert one.lrv is None and one.dropped == 1
    s = spark.createDataFrame([(3,), (4,), (100,), (8000,)], "n long").select("n", precision.default_batch_sizes(F.col("n")).alias("s")).collect()
    assert [r.s for r in s] == [None, [1, 2], [4, 10], [19, 89]]
