import math
import random

from pyspark.sql import functions as F

from varve.operators.exact import exact_sums


def _groups():
    rng = random.Random(5)
    groups = {}
    for g in range(120):
        span = 300 if g % 3 else 5
        xs = [rng.choice([-1, 1]) * rng.uniform(1, 10) * 10 ** rng.uniform(-span, span) for _ in range(rng.randint(1, 60))]
        if g % 4 == 0:  # all but one value cancel
            xs += [-x for x in xs[:-1]]
        if g % 7 == 0:  # below the normal range
            top = max(map(abs, xs))
            xs = [x / top * 1e-310 for x in xs]
        groups[g] = xs
    edges = [
        [1.0, 2.0**-53], [1.0, 2.0**-53, 2.0**-200], [-1.0, -(2.0**-53), -5e-324], [1.0 + 2**-52, 2.0**-53], [1e16, 1.0, -1e16], [0.0], [-0.0, 5e-324],
        [1e-20] * 3, [4e-19] * 1000, [1e10, 2**-18, -1e10], [2.0**20, 2.0**40, -(2.0**40)], [1.7976931348623157e308], [9e18] * 20,
    ]
    return groups | {1000 + i: xs for i, xs in enumerate(edges)}


def test_sums_equal_fsum_in_any_order(spark):
    groups = _groups()
    rows = [(g, x) for g, xs in groups.items() for x in xs]
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, "g long, x double").repartition(3)
        got = exact_sums(df, ["g"], {"s": F.col("x"), "a": F.abs("x")}, F.count(F.lit(1)).alias("n")).collect()
        assert len(got) == len(groups)
        for r in got:
            assert (r.s, r.a, r.n) == (math.fsum(groups[r.g]), math.fsum(map(abs, groups[r.g])), len(groups[r.g]))


def test_undefined_totals_and_empty_tables(spark):
    def total(*values):
        return exact_sums(spark.createDataFrame([(v,) for v in values], "x double"), [], {"s": F.col("x")}).first().s

    assert total(1e308, 1e308) is None and total(1e308, 1e308, -1e308) == 1e308
    assert total(1.0, float("inf")) is None and total(1.0, float("nan")) is None and total(1.0, None) is None
    none = spark.createDataFrame([], "g int, x double")
    assert exact_sums(none, [], {"s": F.col("x")}, F.count(F.lit(1)).alias("n")).collect() == [(0, None)]
    assert exact_sums(none, ["g"], {"s": F.col("x")}).collect() == []
    odd = spark.createDataFrame([(None, 1.0), (None, 2.0), (3, None)], "g int, x double")
    assert {(r.g, r.s) for r in exact_sums(odd, ["g"], {"s": F.col("x")}).collect()} == {(None, 3.0), (3, None)}


def test_a_hot_group_is_combined_before_the_shuffle(spark):
    hot = spark.range(0, 60_000, numPartitions=6).select(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("g"), (F.col("id") * 0.1).alias("x")).filter("g = 0")
    out = exact_sums(hot, ["g"], {"s": F.col("x")})
    assert out.first().s == math.fsum(i * 0.1 for i in range(0, 60_000, 3))
