"""Packing into optimal length buckets: least padding by dynamic programming, token-budget batches inside."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varve.llm.common import spread_rank, word_count

MAX_LEN = 2048
BUCKETS = 16
BATCH_TOKENS = 65_536


def best_bounds(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets with the least total padding.

    cost(i, j) pads all sequences of the i+1-th to j-th distinct length to the j-th; the best cost of
    j lengths in k buckets is the least over i of the best of i in k-1 plus cost(i, j). The first of
    equal splits is taken.
    """
    order = np.argsort(lengths)
    size, n = np.asarray(lengths, dtype=np.float64)[order], np.asarray(counts, dtype=np.float64)[order]
    if not len(size):
        return []
    rows, tokens = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * size)])
    m = len(size)
    cost = size[None, :] * (rows[None, 1:] - rows[:-1, None]) - (tokens[None, 1:] - tokens[:-1, None])
    cost[np.tril_indices(m, -1)] = np.inf
    best, cuts = np.concatenate([[0], np.full(m, np.inf)]), []
    done = None
    for _ in range(min(buckets, m)):
        total = best[:-1, None] + cost
        cuts.append(total.argmin(axis=0))
        best = np.concatenate([[np.inf], total.min(axis=0)])
        if done is None or best[-1] < done:
            done, used = best[-1], len(cuts)
    bounds, j = [], m
    for cut in reversed(cuts[:used]):
        bounds.append(int(size[j - 1]))
        j = int(cut[j - 1])
    return bounds[::-1]


def pack_buckets(docs: DataFrame, max_len: int = MAX_LEN, buckets: int = BUCKETS, batch_tokens: int = BATCH_TOKENS) -> DataFrame:
    """doc_id, piece, n_tokens, bucket, bucket_len, batch and slot of every sequence.

    A document has as many tokens as words plus an end token; what exceeds ``max_len`` goes on in
    further pieces, so nothing is cut off and the histogram has at most ``max_len`` rows whatever the
    corpus holds. Batches of a bucket hold floor(batch_tokens / bucket_len) sequences, one at least;
    only its last batch may be short. Bucket ranks come from ``spread_rank``, so a bucket with most
    rows is many tasks. Null and empty texts are a single end token; rows with the same doc_id are
    packed each; a null doc_id is a value; no rows give no rows; other columns are ignored.
    """
    n = word_count("text") + 1
    pieces = docs.select("doc_id", n.alias("_n")).select("doc_id", "_n", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / max_len).cast("int"))).alias("piece"))
    pieces = pieces.select("doc_id", "piece", F.least(F.col("_n") - F.col("piece") * max_len, F.lit(max_len)).cast("long").alias("n_tokens"))
    histogram = pieces.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect()  # at most max_len rows
    bounds = best_bounds([r.n_tokens for r in histogram], [r.n for r in histogram], buckets)
    bucket = F.lit(0)
    for b in bounds:
        bucket = bucket + (F.col("n_tokens") > b).cast("int")
    ends = F.array(*[F.lit(b) for b in bounds] or [F.lit(1)])
    ranked = spread_rank(pieces.withColumn("bucket", bucket), ["bucket"], ["doc_id", "piece", "n_tokens"], "_rank")
    placed = ranked.withColumn("bucket_len", F.get(ends, F.col("bucket")).cast("long"))
    room = F.greatest(F.floor(F.lit(batch_tokens) / F.col("bucket_len")), F.lit(1)).cast("long")
    placed = placed.withColumn("_room", room)
    return placed.select(
        "doc_id", "piece", "n_tokens", "bucket", "bucket_len", F.floor(F.col("_rank") / F.col("_room")).alias("batch"), (F.col("_rank") % F.col("_room")).alias("slot")
    )
