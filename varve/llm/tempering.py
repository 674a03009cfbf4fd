"""Mixing sources to target weights: a temperature on token shares, then budgeted block permutations."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varve.llm.common import HASH_RANGE, hash32, key_text, sealed, word_count
from varve.session import checkpointed

BLOCK_DOCS = 1024
_SECTIONS = 32


def temper_stats(totals: DataFrame, exponents: list[float], budget: float) -> dict[float, tuple[float, float, float]]:
    """For each exponent: log of the normaliser, entropy in nats, and the most often a source repeats."""
    tried = totals.select(F.log("tokens").alias("_l"), F.explode(F.array(*[F.lit(float(a)) for a in exponents])).alias("a"))
    power = F.exp(F.col("a") * F.col("_l"))
    by = tried.groupBy("a").agg(F.sum(power).alias("z"), F.sum(power * F.col("a") * F.col("_l")).alias("zl"), F.max((F.col("a") - 1) * F.col("_l")).alias("top"))
    return {r.a: (math.log(r.z), math.log(r.z) - r.zl / r.z, budget * math.exp(r.top) / r.z) for r in by.collect()}


def find_exponent(totals: DataFrame, budget: float, repeat_limit: float | None, target_entropy: float | None, bits: int = 40) -> float:
    """The smallest exponent in 0..1 that keeps to ``repeat_limit`` and whose entropy is at most ``target_entropy``.

    Both measures fall as the exponent grows. Each round halves the bracket five times at once: one
    aggregate over the sources tries all inner points. At exponent 1 nothing repeats more than
    budget / corpus, so a limit below that is met as nearly as it can be.
    """
    low, high = 0.0, 1.0

    def held(stats: tuple[float, float, float]) -> bool:
        return (repeat_limit is None or stats[2] <= repeat_limit) and (target_entropy is None or stats[1] <= target_entropy)

    if held(temper_stats(totals, [0.0], budget)[0.0]):
        return 0.0
    for _ in range(bits // 5):
        points = [low + (high - low) * i / _SECTIONS for i in range(1, _SECTIONS)]
        stats = temper_stats(totals, points, budget)
        ok = [a for a in points if held(stats[a])]
        high = min(ok, default=high)
        low = max((a for a in points if a < high), default=low)
    return high


def mix_sources(
    docs: DataFrame, budget: float | None = None, repeat_limit: float | None = None, target_entropy: float | None = None, block_docs: int = BLOCK_DOCS, seed: str = "mix-1"
) -> DataFrame:
    """The rows of ``docs`` the mixture takes, each as struct ``row`` with tokens, weight, epoch, block and block_rank.

    A source's weight is its share of tokens (words, one at least per row) to an exponent, normalised.
    It is due weight x budget tokens (budget: the corpus), whole epochs first and then part of one.
    Each epoch permutes the source's blocks, which are cut by hash, so a source with a third of all
    rows is many blocks; the last block is taken up to the document that meets the due amount. Order
    of training: (epoch, block_rank, hash of the row). A null source is a source; null and empty
    texts weigh one token; rows with equal doc_id share a place and go together; no rows give no rows.
    Columns of ``docs`` may have any names: they stay inside ``row``.
    """
    rows = sealed(docs, F.greatest(word_count("text"), F.lit(1)).alias("_tokens"), key_text("source").alias("_source"), hash32(F.lit(seed), F.col("doc_id")).alias("_h"))
    slim = checkpointed(rows.select("_source", "_h", "_tokens"))
    totals = checkpointed(slim.groupBy("_source").agg(F.sum("_tokens").alias("tokens"), F.count(F.lit(1)).alias("n_docs")))
    corpus = totals.agg(F.sum("tokens")).first()[0] or 0
    budget = float(corpus if budget is None else budget)
    exponent = find_exponent(totals, budget, repeat_limit, target_entropy) if corpus else 1.0
    norm = temper_stats(totals, [exponent], budget)[exponent][0] if corpus else 0.0
    plan = totals.withColumn("_weight", F.exp(F.lit(exponent) * F.log("tokens") - F.lit(norm)))
    plan = plan.withColumn("_due", F.floor(F.col("_weight") * F.lit(budget)).cast("long")).withColumn("_nb", F.ceil(F.col("n_docs") / F.lit(block_docs)))
    plan = checkpointed(plan.withColumn("_whole", F.floor(F.col("_due") / F.col("tokens")).cast("int")).withColumn("_rest", F.col("_due") % F.col("tokens")))

    def in_blocks(df: DataFrame) -> DataFrame:
        by = plan.select(F.col("_source").alias("_s"), "_nb", "_weight")
        out = df.join(by, F.col("_source") == F.col("_s")).drop("_s")
        return out.withColumn("_block", F.floor(F.col("_h") * F.col("_nb") / F.lit(HASH_RANGE)).cast("long")).drop("_nb")

    places = checkpointed(in_blocks(slim).groupBy("_source", "_block", "_h").agg(F.sum("_tokens").alias("_tokens")))
    blocks = places.groupBy("_source", "_block").agg(F.sum("_tokens").alias("_size")).join(plan.select("_source", "_whole", "_rest"), "_source")
    epochs = blocks.withColumn("_epoch", F.explode(F.sequence(F.lit(0), F.col("_whole"))))
    epochs = epochs.withColumn("_perm", F.md5(key_text(F.lit(seed), F.col("_source"), F.col("_epoch"), F.col("_block"))))
    order = Window.partitionBy("_source", "_epoch").orderBy("_perm", "_block")
    epochs = epochs.withColumn("_block_rank", F.row_number().over(order) - 1).withColumn("_before", F.sum("_size").over(order) - F.col("_size"))
    partial = F.col("_epoch") == F.col("_whole")
    taken = epochs.filter(~partial | (F.col("_before") < F.col("_rest"))).withColumn("_room", F.when(partial & (F.col("_before") + F.col("_size") > F.col("_rest")), F.col("_rest") - F.col("_before")))
    taken = checkpointed(taken.select("_source", "_block", "_epoch", "_block_rank", "_room"))
    # at most one block of a source is cut: find the hash up to which it is taken
    inside = Window.partitionBy("_source", "_block", "_epoch").orderBy("_h").rowsBetween(Window.unboundedPreceding, -1)
    cut = places.join(taken.filter(F.col("_room").isNotNull()), ["_source", "_block"]).withColumn("_sum", F.coalesce(F.sum("_tokens").over(inside), F.lit(0)))
    last = cut.filter(F.col("_sum") < F.col("_room")).groupBy("_source", "_block", "_epoch").agg(F.max("_h").alias("_last"))
    chosen = taken.join(last, ["_source", "_block", "_epoch"], "left").select(F.col("_source").alias("_s"), F.col("_block").alias("_b"), "_epoch", "_block_rank", "_last")
    out = in_blocks(rows).join(chosen, (F.col("_source") == F.col("_s")) & (F.col("_block") == F.col("_b")))
    kept = out.filter(F.col("_last").isNull() | (F.col("_h") <= F.col("_last")))
    return kept.select("row", *[F.col(f"_{c}").alias(c) for c in ("tokens", "weight", "epoch", "block", "block_rank")])
