import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from varve.operators import quality, stats
from varve.sources import readers, sinks


def test_readers_reject_with_reasons(spark, tmp_path):
    (tmp_path / "t.txt").write_text("1 1 2.0 3.0\n\n1 2 nan 3\n 1  3\t2 1 \n1 4 2\n1 5.5 2 3\nx 6 1 1\n")
    got = readers.read_trajectories(spark, str(tmp_path / "t.txt"), ["a", "b"])
    assert {r.reject: r["count"] for r in got.groupBy("reject").count().collect()} == {None: 2, "non_finite": 2, "field_count": 1, "not_integral": 1}
    (tmp_path / "p.csv").write_text("entity_id,cutoff,lower,median,upper\n1,30,0.1,0.2,0.30000000000000004\n")
    assert readers.read_predictions(spark, str(tmp_path / "p.csv")).first().upper == 0.30000000000000004
    (tmp_path / "bad.csv").write_text("entity_id,cutoff,low,median,upper\n1,30,0.1,0.2,0.3\n")
    with pytest.raises(Exception):
        readers.read_predictions(spark, str(tmp_path / "bad.csv")).collect()
    (tmp_path / "m.json").write_text('{"dataset":"d","entity_id":1,"role":"fit","proposed_cutoff":30,"eligible_alive":true}\n{"dataset":"e","entity_id":2,"role":"fit","proposed_cutoff":30,"eligible_alive":true}\n')
    assert [r.reject for r in readers.read_manifest(spark, str(tmp_path / "m.json"), "d").orderBy("entity_id").collect()] == [None, "wrong_dataset"]


def test_file_manifest(spark, tmp_path):
    for n, text in (("a", b"one"), ("b", b"two" * 10), ("c", b"")):
        (tmp_path / n).write_bytes(text)
    inv = readers.file_inventory(spark, str(tmp_path), chunk=4)
    got = {r.path.rsplit("/", 1)[1]: (r.bytes, r.sha256) for r in inv.collect()}
    assert got["b"] == (30, hashlib.sha256(b"two" * 10).hexdigest()) and got["c"][0] == 0
    listed = [(r.path, r.bytes, "0" if r.path.endswith("a") else r.sha256) for r in inv.collect() if not r.path.endswith("b")] + [("gone", 1, "x")]
    bad = readers.inventory_mismatches(inv, spark.createDataFrame(listed, "path string, bytes long, sha256 string"))
    assert {r.path.rsplit("/", 1)[-1]: r.reason for r in bad.collect()} == {"a": "changed", "b": "extra", "gone": "missing"}


def test_sinks_never_overwrite(spark, tmp_path):
    df = spark.range(3)
    sinks.write_once(df, str(tmp_path / "o"))
    with pytest.raises(Exception):
        sinks.write_once(df, str(tmp_path / "o"))
    runs = spark.createDataFrame([("r1", "failed"), ("r2", "completed")], "run_id string, status string")
    assert sinks.append_runs(spark, runs, str(tmp_path / "reg")) == 2
    assert sinks.append_runs(spark, runs.union(spark.createDataFrame([("r3", "completed")], runs.schema)), str(tmp_path / "reg")) == 1
    with pytest.raises(ValueError):
        sinks.append_runs(spark, runs.union(runs), str(tmp_path / "reg"))


def test_event_chain_damage(spark):
    def chain(edit=None):
        rows, prev = [], None
        for i in range(1, 6):
            payload = f"{i}|{prev}"
            rows.append(["c", i, "STEP", prev, payload])
            prev = hashlib.sha256(payload.encode()).hexdigest()
        if edit:
            edit(rows)
        df = spark.createDataFrame([tuple(r) for r in rows], "campaign string, event int, kind string, previous_sha256 string, payload string")
        return {(r.event, x) for r in quality.chain_verification(df, ["BAD"]).collect() for x in r.reasons}

    assert chain() == set()
    assert chain(lambda r: r[1].__setitem__(4, "x")) == {(3, "hash_mismatch")}
    assert chain(lambda r: r.pop(2)) == {(4, "gap")}
    assert chain(lambda r: r[4].__setitem__(2, "BAD")) == {(5, "forbidden_kind")}


def test_fingerprint_ignores_order_but_not_copies(spark):
    df = spark.range(100).select("id", (F.col("id") % 7).alias("v"))
    fp = lambda d: quality.fingerprint(d, ["id", "v"]).first().sha256
    assert fp(df) == fp(df.orderBy(F.col("id").desc()).repartition(5)) != fp(df.union(df.limit(1)))


def test_bootstrap_status_order(spark):
    v = [("z", i + 1, 0.0) for i in range(100)] + [("a", i + 1, x) for i, x in enumerate([-3.2, -1.7, -0.9, -0.2, 0.1, 0.6, 1.3, 1.9, 2.4, 3.8, 4.7, 7.1])]
    df = spark.createDataFrame(v, "scenario string, slot long, x double")
    out = {r.scenario: r for r in stats.bootstrap_t(stats.bootstrap_pivots(df, 17, "s")).collect()}
    assert out["z"].status == "zero_observed_standard_error" and out["z"].zero_se_draws == 17 and out["z"].interval_low is None
    assert out["a"].status == "ok" and out["a"].interval_low < out["a"].mean < out["a"].interval_high
    m = stats.benchmark_mean(spark.createDataFrame([(-2.0,), (0.0,), (1.0,), (5.0,)], "x double"), "x").first()
    assert m.mean_difference == 1.0
    bad = stats.benchmark_mean(spark.createDataFrame([(1.0,), (float("inf"),)], "x double"), "x").first()
    assert bad.status == "FAIL" and bad.mean_difference is None


def test_labels_must_cover_the_cohort_once(spark):
    cohort = spark.range(1, 6).withColumnRenamed("id", "entity_id")

    def told(rows):
        return tuple(readers.label_completeness(spark.createDataFrame(rows, "entity_id long, y double"), cohort).first())

    whole = [(i, 1.0 * i) for i in range(1, 6)]
    assert told(whole) == (0, 0, 0, 0, True)
    assert told(whole[1:] + [(9, 2.0), (2, 2.0), (3, float("nan"))]) == (1, 1, 2, 1, False)


def test_two_registry_writers_with_one_id(spark, tmp_path, monkeypatch):
    """A writer that lost its number to another sees that writer's ids; the loser's other rows still go in."""
    path = str(tmp_path / "runs")
    make = lambda *ids: spark.createDataFrame([(i, "completed") for i in ids], "run_id string, state string")
    real, rivals = sinks.put_if_absent, [make("r1", "r2")]
    def raced(session, staged, target):
        if rivals:
            monkeypatch.setattr(sinks, "put_if_absent", real)
            assert sinks.append_runs(session, rivals.pop(), path) == 2
        return real(session, staged, target)
    monkeypatch.setattr(sinks, "put_if_absent", raced)
    assert sinks.append_runs(spark, make("r2", "r3"), path) == 1
    assert sorted(r.run_id for r in sinks.read_runs(spark, path, make("x").schema).collect()) == ["r1", "r2", "r3"]
    assert sinks.append_runs(spark, make("r1", "r3"), path) == 0
    assert sinks.read_runs(spark, str(tmp_path / "none"), make("x").schema).isEmpty()
    with pytest.raises(Exception, match="(?i)does not exist|not found|No such"):
        sinks.put_if_absent(spark, str(tmp_path / "gone"), str(tmp_path / "goal"))


def test_outcome_diagnostics(spark):
    """Median, 95th percentile and maximum over the defined diagnostics; none defined gives null and zero."""
    rng = np.random.default_rng(4)
    share = [float(v) for v in rng.random(40)]
    rows = [("a", "ok", 0, 0, 17, True, False, s if i % 4 else None, None) for i, s in enumerate(share)]
    schema = "scenario string, status string, zero_se_draws long, nonfinite_draws long, draws long, contains_zero boolean, rejects boolean, max_share double, max_loo_shift double"
    r = stats.outcome_summary(spark.createDataFrame(rows, schema)).first()
    want = [s for i, s in enumerate(share) if i % 4]
    assert r.max_share_n_defined == 30 and r.max_share_maximum == max(want)
    assert np.allclose([r.max_share_median, r.max_share_p95], np.quantile(want, [0.5, 0.95]), rtol=1e-12)
    assert (r.max_loo_shift_n_defined, r.max_loo_shift_median, r.max_loo_shift_p95, r.max_loo_shift_maximum) == (0, None, None, None)
