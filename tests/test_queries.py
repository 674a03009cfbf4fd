import pytest

from tools import compare as cmp

SF = "/root/testdata/sf0.001"
FAST = [
    "src1_read_trajectories", "val2_cycle_gaps", "val11_event_chain", "val13_fingerprint", "asg2_role_split", "asg7_role_bootstrap",
    "aud2_cutoff_bands", "fea1_recent_rows", "sco3_method_summary", "sta2_average_ranks", "sta6_wilson",
]


@pytest.fixture(scope="module")
def duck():
    return cmp.connect(SF)


@pytest.mark.parametrize("name", FAST)
def test_query_matches_its_sql(spark, duck, name):
    import __spark_entry__ as entry

    verdict, _, _, note = cmp.compare(spark, duck, name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert verdict == "ok", note


def test_registry_is_consistent():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_no_python_in_the_draw_passes(spark):
    """The repeated pass over the draws must stay in generated code, without sorting or pairing everything."""
    from pyspark.sql import functions as F

    from varve.operators import mixture

    terms = spark.range(100).select(F.lit(1).cast("long").alias("entity_id"), F.lit(0).alias("chain"), F.col("id").alias("draw"), F.rand(1).alias("mu"), F.lit(0.1).alias("var"), F.lit(0.0).alias("log_w"))
    prepared = mixture.prepare(terms, ["entity_id"], persist=False)
    points = prepared.groupBy("entity_id").agg(F.sum("w").alias("sum_w")).select("entity_id", F.lit(0.5).alias("p"), F.lit(0.3).alias("x"), "sum_w")
    plan = mixture.cdf_and_density(prepared, points, ["entity_id"])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "CartesianProduct" not in plan and "ShuffledHashJoin" in plan
