"""Validation and integrity checks. A check returns rows that say what failed; it drops nothing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varve.functions.hashing import CHUNKS, hex_chunk
from varve.functions.numeric import is_finite, reasons, status


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def cycle_gaps(df: DataFrame, id_col: str = "entity_id", cycle: str = "cycle") -> DataFrame:
    """Entities whose cycles are not exactly 1..T.

    Distinct cycles are counted by grouping (entity, cycle) first: map-side combining keeps a hot
    entity spread out, which a per-entity distinct set would not.
    """
    per_cycle = df.groupBy(id_col, cycle).agg(F.count(F.lit(1)).alias("_n"))
    stats = per_cycle.groupBy(id_col).agg(
        F.min(cycle).alias("first_cycle"), F.max(cycle).alias("last_cycle"), F.sum("_n").alias("n_rows"), F.count(F.lit(1)).alias("n_cycles")
    )
    good = (F.col("first_cycle") == 1) & (F.col("last_cycle") == F.col("n_rows")) & (F.col("n_cycles") == F.col("n_rows"))
    return stats.withColumn("complete", good)


def finite_gate(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """One verdict per cohort: non-finite counts per column, and PASS only when all are zero."""
    bad = [F.count_if(~is_finite(F.col(c))).alias(f"bad_{c}") for c in columns]
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), *bad)
    checks = {f"nonfinite_{c}": F.col(f"bad_{c}") > 0 for c in columns}
    return out.withColumn("status", status(reasons(checks)))


def channel_profile(df: DataFrame, channels: Sequence[str]) -> DataFrame:
    """Minimum, maximum and population variance of each channel, one row per channel."""
    aggs = []
    for c in channels:
        aggs += [F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"), F.var_pop(c).alias(f"{c}_var")]
    wide = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("channel"), F.col(f"{c}_min").alias("low"), F.col(f"{c}_max").alias("high"), F.col(f"{c}_var").alias("variance")) for c in channels])
    return wide.select(F.inline(rows))


def compare_tables(left: DataFrame, right: DataFrame, keys: Sequence[str], values: Sequence[str], atol: float = 0.0, rtol: float = 0.0) -> DataFrame:
    """Full outer comparison, long form: one row per (key, column) that differs beyond the tolerance."""
    l = left.select(*keys, *[F.col(v).cast("double").alias(f"_l_{v}") for v in values], F.lit(True).alias("_in_l"))
    r = right.select(*keys, *[F.col(v).cast("double").alias(f"_r_{v}") for v in values], F.lit(True).alias("_in_r"))
    both = l.join(r, list(keys), "full_outer")
    cells = F.array(*[F.struct(F.lit(v).alias("column"), F.col(f"_l_{v}").alias("left_value"), F.col(f"_r_{v}").alias("right_value")) for v in values])
    long = both.select(*keys, "_in_l", "_in_r", F.inline(cells))
    a, b = F.col("left_value"), F.col("right_value")
    close = a.eqNullSafe(b) | F.coalesce(F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b), F.lit(False))
    reason = (
        F.when(F.col("_in_l").isNull(), "missing_left").when(F.col("_in_r").isNull(), "missing_right").when(~close, "differs")
    )
    return long.withColumn("reason", reason).filter("reason is not null").drop("_in_l", "_in_r")


def identical_tables(left: DataFrame, right: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Counts of matching, changed and unmatched rows under exact equality."""
    l = left.select(*keys, F.struct(*values).alias("_l"))
    r = right.select(*keys, F.struct(*values).alias("_r"))
    j = l.join(r, list(keys), "full_outer")
    return j.agg(
        F.count_if(F.col("_l").isNotNull() & F.col("_l").eqNullSafe(F.col("_r"))).alias("identical"),
        F.count_if(F.col("_l").isNotNull() & F.col("_r").isNotNull() & ~F.col("_l").eqNullSafe(F.col("_r"))).alias("changed"),
        F.count_if(F.col("_l").isNull()).alias("only_right"),
        F.count_if(F.col("_r").isNull()).alias("only_left"),
    )


def prefix_integrity(prefix: DataFrame, cutoffs: DataFrame, id_col: str = "entity_id") -> DataFrame:
    """Rows of each prefix against its cutoff, and rows after the cutoff (which must be none)."""
    n = prefix.groupBy(id_col).agg(F.count(F.lit(1)).alias("n_rows"), F.max("cycle").alias("last_cycle"))
    j = cutoffs.select(id_col, "cutoff").join(n, id_col, "left").fillna(0, ["n_rows", "last_cycle"])
    return j.withColumn("status", status(reasons({"row_count": F.col("n_rows") != F.col("cutoff"), "future_row": F.col("last_cycle") > F.col("cutoff")})))


def manifest_mismatches(recomputed: DataFrame, stored: DataFrame, values: Sequence[str] = ("role", "cutoff", "eligible"), id_col: str = "entity_id") -> DataFrame:
    """Rows whose stored assignment differs from the recomputed one, with every reason kept."""
    l = recomputed.select(id_col, *[F.col(v).alias(f"_l_{v}") for v in values], F.lit(True).alias("_in_l"))
    r = stored.select(id_col, *[F.col(v).alias(f"_r_{v}") for v in values], F.lit(True).alias("_in_r"))
    j = l.join(r, id_col, "full_outer")
    present = F.col("_in_l").isNotNull() & F.col("_in_r").isNotNull()
    checks = {"unlisted": F.col("_in_r").isNull(), "unknown": F.col("_in_l").isNull()}
    checks |= {f"{v}_mismatch": present & ~F.col(f"_l_{v}").eqNullSafe(F.col(f"_r_{v}")) for v in values}
    return j.select(id_col, reasons(checks).alias("reasons")).filter(F.size("reasons") > 0)


def prediction_gate(predictions: DataFrame, cohort: DataFrame, id_col: str = "entity_id") -> DataFrame:
    """Per method: complete ids, finite values, 0 <= lower <= upper. Medians are counted, never projected."""
    methods = predictions.groupBy("method").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(~(is_finite(F.col("lower")) & is_finite(F.col("median")) & is_finite(F.col("upper")))).alias("n_nonfinite"),
        F.count_if(F.col("lower") < 0).alias("n_negative_lower"),
        F.count_if(F.col("lower") > F.col("upper")).alias("n_crossed"),
        F.count_if(F.col("median") < 0).alias("n_negative_median"),
    )
    known = cohort.select(id_col).distinct()
    size = known.groupBy().agg(F.count(F.lit(1)).alias("n_cohort")).withColumn("_k", F.lit(0))
    # one partial count per (method, id) finds both repeats and strangers without a distinct set per method
    ids = predictions.groupBy("method", id_col).agg(F.count(F.lit(1)).alias("_n")).join(known.withColumn("_known", F.lit(True)), id_col, "left")
    cover = ids.groupBy("method").agg(F.count_if("_known").alias("n_known"), F.count_if(F.col("_known").isNull()).alias("n_unknown"), F.count_if(F.col("_n") > 1).alias("n_repeated"))
    j = methods.join(cover, "method").withColumn("_k", F.lit(0)).join(F.broadcast(size), "_k").drop("_k")
    j = j.withColumn("n_missing", F.col("n_cohort") - F.col("n_known"))
    bad = ("n_missing", "n_unknown", "n_repeated", "n_nonfinite", "n_negative_lower", "n_crossed")
    return j.withColumn("status", status(reasons({c: F.col(c) > 0 for c in bad}))).drop("n_known")


def chain_verification(events: DataFrame, forbidden: Sequence[str] = (), campaign: str = "campaign", block: int = 1 << 16) -> DataFrame:
    """Check every event against its predecessor: numbering, stored hash of the prior payload, kind.

    The predecessor is found by an equi-join on (campaign, event - 1), so one long campaign stays
    spread over many tasks.
    """
    prior = events.select(campaign, (F.col("event") + 1).alias("event"), F.sha2("payload", 256).alias("_prior"), F.lit(True).alias("_has"))
    firsts = events.groupBy(campaign).agg(F.min("event").alias("_first"))
    j = events.join(prior, [campaign, "event"], "left").join(firsts, campaign)
    is_first = F.col("event") == F.col("_first")
    checks = {
        "gap": ~is_first & F.col("_has").isNull(),
        "hash_mismatch": F.col("_has").isNotNull() & ~F.col("previous_sha256").eqNullSafe(F.col("_prior")),
        "first_not_one": is_first & (F.col("event") != 1),
        "forbidden_kind": F.col("kind").isin(*forbidden) if forbidden else F.lit(False),
    }
    return j.select(campaign, "event", reasons(checks).alias("reasons"))


def gate(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """Attach the failed check names and PASS/FAIL; failing rows are kept."""
    out = df.withColumn("reasons", reasons(dict(checks)))
    return out.withColumn("status", status(F.col("reasons")))


def row_hash(columns: Sequence[str]) -> Column:
    """SHA-256 of a row's canonical text; doubles print their shortest round-trip form."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns]), 256)


def fingerprint(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Order-independent fingerprint of a table of any size.

    The eight 32-bit chunks of every row's SHA-256 are summed (mergeable, so combined before the
    shuffle) and the row count and the sums are hashed once more. Repeated rows count.
    """
    h = df.select(*by, row_hash(columns).alias("_h"))
    sums = [F.sum(hex_chunk(F.col("_h"), i).cast("decimal(20,0)")).alias(f"_s{i}") for i in range(CHUNKS)]
    folded = h.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), *sums)
    text = F.concat_ws("|", F.col("n_rows").cast("string"), *[F.col(f"_s{i}").cast("string") for i in range(CHUNKS)])
    return folded.select(*by, "n_rows", F.sha2(text, 256).alias("sha256"))
