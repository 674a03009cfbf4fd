"""Small shared pieces: table access, reproducible hashes and ranks that stay spread over tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from varve.session import checkpointed

HASH_RANGE = 1 << 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sealed(docs: DataFrame, *more: Column, keep: list[str] | None = None) -> DataFrame:
    """All columns (or those to ``keep``) as one struct ``row``, so that no name of theirs can clash."""
    return docs.select(F.struct(*keep if keep else "*").alias("row"), *more)


def key_text(*cols: str | Column) -> Column:
    """Columns as one string; a null differs from the empty string."""
    parts = [F.coalesce(F.concat(F.lit("="), (F.col(c) if isinstance(c, str) else c).cast("string")), F.lit("~")) for c in cols]
    return F.concat_ws("|", *parts)


def hash32(*cols: str | Column) -> Column:
    """The first 32 bits of an MD5 over the columns, as a long: the same on every engine."""
    return F.conv(F.substring(F.md5(key_text(*cols)), 1, 8), 16, 10).cast("long")


def crc32_long(text: str) -> Column:
    """Unsigned crc32 of the UTF-8 bytes; null counts as empty."""
    return F.crc32(F.coalesce(F.col(text), F.lit("")))


def word_count(text: str) -> Column:
    """Number of runs of characters that are not white space; null counts as empty."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\s]+")), F.lit(0)).cast("long")


def spread_rank(rows: DataFrame, group: Sequence[str], ident: Sequence[str], name: str, per_block: int = 4096) -> DataFrame:
    """Number the rows of each group 0.. in order of a hash of ``ident``; adds ``n_group`` too.

    Only ``group`` and ``ident`` columns come back, one row per input row. Repeated rows are
    collapsed to a count before anything is sorted, and a group is cut by the leading part of the
    hash into blocks of about ``per_block`` rows, so a group of any size, or a row repeated any
    number of times, is never sorted in one task. Block offsets are running sums over block counts.
    """
    group, ident = list(group), list(ident)
    once = checkpointed(rows.groupBy(*group, *ident).agg(F.count(F.lit(1)).alias("_copies")).withColumn("_h", hash32(*ident)))
    by = [F.col(g).alias(f"_s{i}") for i, g in enumerate(group)]
    sizes = once.groupBy(*by).agg(F.sum("_copies").alias("n_group"), F.ceil(F.count(F.lit(1)) / F.lit(per_block)).alias("_nb"))
    joined = once.join(sizes, [F.col(g).eqNullSafe(F.col(f"_s{i}")) for i, g in enumerate(group)])
    cut = joined.withColumn("_block", F.floor(F.col("_h") * F.col("_nb") / F.lit(HASH_RANGE)).cast("long"))
    counts = cut.groupBy(*group, "_block").agg(F.sum("_copies").alias("_n"))
    before = (Window.unboundedPreceding, -1)
    w = Window.partitionBy(*group).orderBy("_block").rowsBetween(*before)
    offsets = counts.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_block").alias("_ob"), F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_start"))
    on = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)] + [F.col("_block") == F.col("_ob")]
    inside = Window.partitionBy(*group, "_block").orderBy("_h", *ident).rowsBetween(*before)
    placed = cut.join(offsets, on).withColumn("_first", F.col("_start") + F.coalesce(F.sum("_copies").over(inside), F.lit(0)))
    return placed.select(*group, *ident, "n_group", F.explode(F.sequence(F.col("_first"), F.col("_first") + F.col("_copies") - 1)).alias(name))
