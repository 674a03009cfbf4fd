"""Candidate scoring and selection, conformal calibration and its sensitivity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from varve.functions.hashing import CHUNK_BASE, digest, hex_chunk
from varve.operators.assign import bootstrap_picks
from varve.operators.ordering import cumulative_counts, value_at
from varve.operators.scoring import interval_score
from varve.session import checkpointed, checkpointed_count

# The tuning grid and the tie band of the selection rule.
TREE_DEPTHS, TREE_LEAVES, TREE_RATES, TREE_COUNT = (1, 2), (5, 10), (0.03, 0.1), 200
LINEAR_ALPHAS = (0.001, 0.01, 0.1, 1.0)
TIE_BAND = 0.5


def _spell(x: float) -> str:
    return f"{x:g}".replace(".", "p")


def grid_rows() -> list[dict]:
    """The 8 boosted and 4 linear candidates with their stable ids."""
    boosted = [
        {"candidate_id": f"gb-depth{d}-leaf{leaf}-lr{_spell(rate)}", "family": "boosted", "depth": d, "leaf": leaf, "rate": rate, "trees": TREE_COUNT, "alpha": None}
        for d in TREE_DEPTHS for leaf in TREE_LEAVES for rate in TREE_RATES
    ]
    linear = [
        {"candidate_id": f"linear-l1-alpha{_spell(a)}", "family": "linear", "depth": None, "leaf": None, "rate": None, "trees": None, "alpha": a}
        for a in LINEAR_ALPHAS
    ]
    return boosted + linear


GRID_SCHEMA = "candidate_id string, family string, depth int, leaf int, rate double, trees int, alpha double"


def candidate_grid(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(grid_rows(), GRID_SCHEMA)


def ordered_endpoints(df: DataFrame, lower: str = "lower", upper: str = "upper") -> DataFrame:
    """Sort crossing endpoints."""
    return df.withColumn("_lo", F.least(lower, upper)).withColumn(upper, F.greatest(lower, upper)).withColumn(lower, F.col("_lo")).drop("_lo")


def candidate_scores(predictions: DataFrame, grid: DataFrame, failures: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Mean interval score of each candidate on its tuning rows; a failed one keeps a null score and its reason."""
    scored = predictions.groupBy(*by, "candidate_id").agg(F.avg(interval_score(F.col("y"), F.col("lower"), F.col("upper"))).alias("mean_score"), F.count(F.lit(1)).alias("n_rows"))
    out = F.broadcast(grid).join(scored, "candidate_id", "left") if not by else scored.join(F.broadcast(grid), "candidate_id")
    if failures is not None:
        return out.join(failures.select(*by, "candidate_id", "failure"), [*by, "candidate_id"], "left")
    return out.withColumn("failure", F.lit(None).cast("string"))


def select_candidate(scores: DataFrame, by: Sequence[str] = (), tie_band: float = TIE_BAND) -> DataFrame:
    """Best score plus the tie band, then the simplest candidate inside it.

    Linear before boosted; a larger penalty first; then shallower trees, larger leaves, smaller
    steps; the id decides what is left. At most a grid's worth of rows per replicate. Without ``by``
    the result is one row, and it is an error when read if no candidate is usable; with ``by`` a
    group without a usable candidate has no row.
    """
    keys = [F.col(k) for k in by] or [F.lit(0)]
    usable = scores.filter(F.col("mean_score").isNotNull())
    best = F.min("mean_score").over(Window.partitionBy(*keys))
    tied = usable.withColumn("best_score", best).filter(F.col("mean_score") <= F.col("best_score") + F.lit(tie_band))
    order = [
        (F.col("family") != "linear").cast("int"), F.col("alpha").desc_nulls_last(), F.col("depth").asc_nulls_last(),
        F.col("leaf").desc_nulls_last(), F.col("rate").asc_nulls_last(), F.col("candidate_id"),
    ]
    ranked = tied.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).withColumn("n_tied", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    chosen = ranked.filter("_r = 1").select(*by, "candidate_id", "best_score", F.col("mean_score").alias("selected_score"), "n_tied")
    if by:
        return chosen
    # a global aggregate has a row even where nothing is left to aggregate
    one = chosen.agg(F.first(F.struct(*chosen.columns)).alias("c"))
    return one.select(F.coalesce("c", F.when(F.col("c").isNull(), F.raise_error(F.lit("no usable candidate")))).alias("c")).select("c.*")


def conformal_rank(n: Column, alpha: float = 0.1) -> Column:
    """ceil((n + 1)(1 - alpha)) in exact decimals."""
    return F.ceil((n + 1).cast("decimal(20,0)") * (F.lit(1).cast("decimal(10,6)") - F.lit(str(alpha)).cast("decimal(10,6)"))).cast("long")


def nonconformity(y: Column, lower: Column, upper: Column) -> Column:
    return F.greatest(F.least(lower, upper) - y, y - F.greatest(lower, upper))


def corrections(scores: DataFrame, by: Sequence[str] = (), score: str = "score", alpha: float = 0.1) -> DataFrame:
    """k-th smallest score per cohort, floored at zero, infinite when k exceeds n. Cohorts of any size."""
    table = cumulative_counts(scores, by, score)
    k = conformal_rank(F.col("n_key"), alpha)
    g = table.groupBy(*by, F.col("n_key").alias("n")).agg(value_at(score, k - 1).alias("raw"))
    rank = conformal_rank(F.col("n"), alpha)
    q = F.when(rank > F.col("n"), F.lit(float("inf"))).otherwise(F.greatest(F.lit(0.0), F.col("raw")))
    return g.select(*by, "n", rank.alias("rank"), "raw", q.alias("correction"))


def apply_correction(predictions: DataFrame, correction: DataFrame, by: Sequence[str] = ("method",)) -> DataFrame:
    """Widen by the cohort's correction, endpoints clipped at zero."""
    # one correction per cohort key
    j = ordered_endpoints(predictions).join(F.broadcast(correction.select(*by, "correction")), list(by))
    widen = lambda c, sign: F.greatest(F.lit(0.0), F.col(c) + F.lit(sign) * F.col("correction"))
    return j.withColumn("lower", widen("lower", -1.0)).withColumn("upper", widen("upper", 1.0))


def leave_one_out(scores: DataFrame, by: Sequence[str] = (), score: str = "score", alpha: float = 0.1) -> DataFrame:
    """Correction without each distinct score value in turn.

    With sorted scores and k' the rank for n - 1, dropping a row ranked above k' leaves s(k'), any
    other leaves s(k' + 1): two order statistics serve every row. One output row per distinct score
    with its multiplicity.
    """
    table = cumulative_counts(scores, by, score)
    k = conformal_rank(F.col("n_key") - 1, alpha)
    pair = table.groupBy(*by).agg(value_at(score, k - 1).alias("_at"), value_at(score, k).alias("_next"), F.max(k).alias("rank"), F.max("n_key").alias("n"))
    if by:
        j = table.drop("n_key").join(F.broadcast(pair), list(by))
    else:
        j = table.drop("n_key").withColumn("_k", F.lit(0)).join(F.broadcast(pair.withColumn("_k", F.lit(0))), "_k").drop("_k")
    # of tied rows any may be the dropped one: the remaining sorted values are the same
    above = F.col("n_before") + F.col("n_at") > F.col("rank")
    q = F.when(F.col("rank") > F.col("n") - 1, F.lit(float("inf"))).otherwise(F.greatest(F.lit(0.0), F.when(above, F.col("_at")).otherwise(F.col("_next"))))
    return j.select(*by, score, F.col("n_at").alias("multiplicity"), q.alias("correction"))


def _replicate_corrections(drawn: DataFrame, by: Sequence[str], score: str, alpha: float) -> DataFrame:
    """Correction per replicate; a replicate holds a caller-set number of scores, so a window is bounded."""
    w = Window.partitionBy(*by)
    r = drawn.withColumn("_i", F.row_number().over(w.orderBy(score))).withColumn("n", F.count(F.lit(1)).over(w))
    k = conformal_rank(F.col("n"), alpha)
    g = r.groupBy(*by, "n").agg(F.max(F.when(F.col("_i") == k, F.col(score))).alias("_s"))
    inf = conformal_rank(F.col("n"), alpha) > F.col("n")
    return g.select(*by, "n", F.when(inf, F.lit(float("inf"))).otherwise(F.greatest(F.lit(0.0), F.col("_s"))).alias("correction"))


def subset_corrections(scores: DataFrame, sizes: Sequence[int], replicates: int, seed: str, score: str = "score", id_col: str = "entity_id", alpha: float = 0.1, by: Sequence[str] = (), slack: int = 4) -> DataFrame:
    """Corrections of random subsets drawn without replacement: the ``size`` smallest hashes of each replicate (and of ``by``).

    Hashes are uniform, so those below ``slack`` times the share wanted hold the subset almost surely:
    the others are dropped in the task that makes them. A replicate left with too few rows is ranked
    again over all its rows. Nothing made by the explosion is ever broadcast or joined.
    """
    tasks, most = int(scores.sparkSession.conf.get("spark.sql.shuffle.partitions")), max(sizes)
    n = scores.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    # one row per group of ``by``
    sized = scores.join(F.broadcast(n), list(by)) if by else scores.crossJoin(F.broadcast(n))
    rep = sized.select(*by, id_col, score, "_n").repartition(tasks, id_col).withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    rep = rep.withColumn("_h", digest(seed, "subset", F.col("replicate"), F.col(id_col)))
    keys = [*by, "replicate"]
    order = Window.partitionBy(*keys).orderBy("_h", id_col)
    low = rep.filter(hex_chunk(F.col("_h"), 0) < F.lit(float(CHUNK_BASE * slack * most)) / F.col("_n"))
    held = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    top = low.withColumn("_order", F.row_number().over(order)).withColumn("_held", held).filter(F.col("_order") <= most)
    top = checkpointed(top.drop("_h"))
    full = top.filter(F.col("_held") >= F.least(F.col("_n"), F.lit(most))).select(*keys).distinct()
    wanted = (scores.select(*by).distinct().crossJoin(_numbers(scores, replicates)) if by else _numbers(scores, replicates))
    short = checkpointed(wanted.join(full, keys, "left_anti"))
    if not short.isEmpty():
        again = rep.join(F.broadcast(short), keys).withColumn("_order", F.row_number().over(order)).filter(F.col("_order") <= most)
        top = top.join(F.broadcast(short), keys, "left_anti").drop("_held").unionByName(again.drop("_h"))
    sized = top.withColumn("size", F.explode(F.array(*map(F.lit, sizes)))).filter(F.col("_order") <= F.col("size"))
    return _replicate_corrections(sized, [*by, "size", "replicate"], score, alpha)


def _numbers(df: DataFrame, replicates: int) -> DataFrame:
    return df.sparkSession.range(1, replicates + 1).select(F.col("id").cast("int").alias("replicate"))


def bootstrap_corrections(scores: DataFrame, rosters: DataFrame, replicates: int, seed: str, score: str = "score", id_col: str = "entity_id", alpha: float = 0.1, by: Sequence[str] = (), width: float = 8.0) -> DataFrame:
    """Corrections of full-size resamples with replacement; every group of ``by`` sees the same draws of entities.

    The k-th smallest drawn score lies within a few deviations of the k-th smallest score, so draws are
    counted by value only within ``width`` of them, and as two sums below and above: these combine
    before the shuffle. A replicate whose k-th score lies outside is worked out from all its draws.
    """
    keys = [*by, "replicate"]
    known = scores.filter(F.col(score).isNotNull()).select(*by, id_col, score)
    # a score's place among the scores that can be drawn; the extent of the window is taken from their number
    table = cumulative_counts(known, by, score)
    mid = conformal_rank(F.col("n_key"), alpha)
    reach = F.lit(width) * F.sqrt(F.col("n_key") * F.lit(alpha * (1 - alpha))) + 2
    place = F.when(F.col("n_before") + F.col("n_at") < mid - reach, -1.0).when(F.col("n_before") > mid + reach, float("inf")).otherwise(F.col("n_before"))
    ranked = known.join(table.select(*by, score, place.alias("_place")), [*by, score])
    pool = checkpointed(rosters.select("role", F.col("slot").alias("_pick"), id_col).join(ranked, id_col))
    drawn = bootstrap_picks(rosters, replicates, seed).select("role", "replicate", "_pick").join(pool.hint("shuffle_hash"), ["role", "_pick"])
    inside = F.when((F.col("_place") >= 0) & (F.col("_place") < float("inf")), F.col(score))
    counts = drawn.groupBy(*keys, "_place", inside.alias("_score")).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*keys)
    counts = counts.withColumn("_upto", F.sum("_c").over(w.orderBy("_place"))).withColumn("n", F.sum("_c").over(w))
    k = conformal_rank(F.col("n"), alpha)
    hit = (F.col("_upto") >= k) & (F.col("_upto") - F.col("_c") < k)
    g = counts.groupBy(*keys, "n").agg(F.max(F.when(hit, F.col("_score"))).alias("_s"))
    inf = conformal_rank(F.col("n"), alpha) > F.col("n")
    g = g.select(*keys, "n", F.when(inf, F.lit(float("inf"))).when(F.col("_s").isNotNull(), F.greatest(F.lit(0.0), F.col("_s"))).alias("correction"))
    g, outside = checkpointed_count(g, F.col("correction").isNull())
    if not outside:
        return g
    left = F.broadcast(g.filter("correction is null").select(*keys))
    whole = corrections(drawn.join(left, keys), keys, score, alpha).select(*keys, "n", "correction")
    return g.filter("correction is not null").unionByName(whole)


def correction_ranges(replicated: DataFrame, by: Sequence[str] = ("size",)) -> DataFrame:
    """2.5, 50 and 97.5% of the corrections of each group (one value per replicate)."""
    probs = F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975))
    g = replicated.groupBy(*by).agg(F.count(F.lit(1)).alias("replicates"), F.percentile("correction", probs).alias("_q"))
    return g.select(*by, "replicates", F.col("_q")[0].alias("low"), F.col("_q")[1].alias("mid"), F.col("_q")[2].alias("high"))
