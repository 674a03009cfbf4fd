import numpy as np
from pyspark.sql import functions as F

from varve.operators import ordering


def test_dense_index_and_prefix_bound(spark):
    df = spark.range(500).select((F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7)).alias("k"), ((F.col("id") * 37) % 500).alias("o"))
    df = df.withColumn("cell", F.floor(F.col("o") / 50))
    got = ordering.dense_index(df, ["k"], ["cell"], ["o"], "i").collect()
    by = {}
    for r in got:
        by.setdefault(r.k, []).append((r.o, r.i))
    for rows in by.values():
        assert [i for _, i in sorted(rows)] == list(range(1, len(rows) + 1))
    bound = spark.createDataFrame([(0, 25, "a"), (1, 3, "b")], "k long, upto int, tag string")
    cut = ordering.dense_index(df, ["k"], ["cell"], ["o"], "i", bound).collect()
    assert len(cut) == 28 and max(r.i for r in cut if r.k == 0) == 25 and {r.tag for r in cut} == {"a", "b"}


def test_cumulative_counts_quantiles_and_ranks_with_heavy_ties(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([np.full(700, 3.0), np.round(rng.normal(size=900), 2)])
    df = spark.createDataFrame([(int(i % 2), float(v)) for i, v in enumerate(x)], "g int, v double")
    q = {r.g: r for r in ordering.linear_quantiles(df, ["g"], "v", {"a": 0.05, "b": 0.5, "c": 0.937}).collect()}
    for g in (0, 1):
        want = np.quantile(x[g::2], [0.05, 0.5, 0.937])
        assert np.allclose([q[g].a, q[g].b, q[g].c], want, rtol=0, atol=1e-12)
    ranks = {(r.g, r.v): r.r for r in ordering.average_ranks(df, ["g"], "v", "r").collect()}
    for g in (0, 1):
        s = np.sort(x[g::2])
        for v in np.unique(s):
            at = np.nonzero(s == v)[0] + 1
            assert ranks[(g, v)] == at.mean()


def test_global_hash_rank(spark):
    df = spark.range(300).withColumn("h", F.sha2(F.col("id").cast("string"), 256))
    got = ordering.hash_rank(df, "h", "id", "r").collect()
    assert [r.r for r in sorted(got, key=lambda r: r.h)] == list(range(1, 301)) and {r.n_all for r in got} == {300}


def test_blocks_of_sparse_ids_are_even_and_rise_with_the_id(spark):
    from varve.operators.ordering import id_blocks

    ids = [i**5 + 7 for i in range(400)]
    rows = id_blocks(spark.createDataFrame([(i,) for i in ids], "entity_id long"), "entity_id", "b", rows=40).orderBy("entity_id").collect()
    blocks = [r.b for r in rows]
    assert blocks == sorted(blocks) and len(set(blocks)) == 10 and max(blocks.count(b) for b in set(blocks)) <= 44
