"""Sharding along a Hilbert curve over quantised metadata, cut into runs of equal row counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varve.llm.common import crc32_long, hash32, sealed, spread_rank
from varve.session import checkpointed

LAW = "rows"


def hilbert_index(axes: list[str], bits: int) -> Column:
    """Hilbert index of integer coordinates 0 .. 2**bits - 1 (Skilling's transform), as folds over bits and axes."""
    n, levels = len(axes), [1 << b for b in range(bits - 1, 0, -1)]
    steps = F.array(*[F.struct(F.lit(q).cast("long").alias("q"), F.lit(i).alias("i")) for q in levels for i in range(n)])
    start = F.array(*[F.col(a).cast("long") for a in axes])

    def turn(x: Column, s: Column) -> Column:
        own, low = F.get(x, s["i"]), s["q"] - 1
        is_set = own.bitwiseAND(s["q"]) != 0
        flip = F.when(is_set, low).otherwise(F.get(x, F.lit(0)).bitwiseXOR(own).bitwiseAND(low))
        return F.transform(x, lambda v, j: F.when((j == 0) | ((j == s["i"]) & ~is_set), v.bitwiseXOR(flip)).otherwise(v))

    def gray(x: Column) -> Column:
        xor = lambda acc, v: acc.bitwiseXOR(v)
        return F.transform(x, lambda v, j: F.aggregate(F.slice(x, 1, j + 1), F.lit(0).cast("long"), xor))

    def mask(x: Column) -> Column:
        last = F.get(x, F.lit(n - 1))
        return F.aggregate(F.array(*[F.lit(q).cast("long") for q in levels]), F.lit(0).cast("long"), lambda t, q: F.when(last.bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t))

    def woven(x: Column) -> Column:
        bit = lambda b, i: F.shiftleft(F.shiftright(F.get(x, F.lit(i)).bitwiseXOR(mask(x)), b).bitwiseAND(F.lit(1)), b * n + n - 1 - i)
        return sum((bit(b, i) for b in range(bits) for i in range(n)), F.lit(0).cast("long"))

    turned = F.aggregate(steps, start, turn, gray)
    return F.get(F.transform(F.array(turned), woven), F.lit(0))


def _log_bin(amount: Column, bits: int) -> Column:
    """Octave bins of a positive amount, the last one open."""
    return F.least(F.floor(F.log2(amount)), F.lit((1 << bits) - 1)).cast("long")


def hilbert_shards(docs: DataFrame, shards: int = 8, bits: int = 4, columns: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """doc_id, size, text_crc32, hilbert, shard and slot of every row.

    Coordinates: log2 of the size, and the leading hash bits of each metadata column (so a file's
    range of them prunes equality filters). The curve has at most 2**(bits * dimensions) cells;
    inside a cell rows follow a hash, so one source with a third of all rows, or a row repeated any
    number of times, is ranked by many tasks. Runs of the order are cut so that shards differ by one
    row at most; ``slot`` is gapless from 0. Null metadata hash as their own value, a null text has
    size 1 and crc32 0, repeated rows are kept, no rows give no rows, other columns are ignored.
    """
    axes = ["_a0", *(f"_a{i + 1}" for i in range(len(columns)))]
    # whole texts are read once, here; all that follows moves a few numbers a row
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")
    slim = docs.select("doc_id", size.alias("size"), crc32_long("text").alias("text_crc32"), *[F.shiftright(hash32(c), 32 - bits).alias(a) for a, c in zip(axes[1:], columns)])
    slim = checkpointed(slim.withColumn("_a0", _log_bin(F.col("size"), bits)))
    ranked = spread_rank(slim, axes, ["doc_id", "size", "text_crc32"], "_in_cell")
    # one row per cell of the curve: at most 2**(bits * dimensions)
    cells = slim.groupBy(*[F.col(a).alias(f"_c{a}") for a in axes]).agg(F.count(F.lit(1)).alias("_n")).withColumn("hilbert", hilbert_index([f"_c{a}" for a in axes], bits))
    w = Window.partitionBy(F.lit(0)).orderBy("hilbert")
    starts = cells.withColumns({"_start": F.sum("_n").over(w) - F.col("_n"), "_total": F.sum("_n").over(Window.partitionBy(F.lit(0)))}).drop("_n")
    rank = F.col("_start") + F.col("_in_cell")
    placed = ranked.join(starts, [F.col(a) == F.col(f"_c{a}") for a in axes]).withColumn("_rank", rank)
    placed = placed.withColumn("shard", F.floor(F.col("_rank") * shards / F.col("_total")).cast("int"))
    first = F.floor((F.col("shard") * F.col("_total") + F.lit(shards - 1)) / F.lit(shards)).cast("long")
    return placed.select("doc_id", "size", "text_crc32", "hilbert", "shard", (F.col("_rank") - first).alias("slot"))


def write_shards(docs: DataFrame, placed: DataFrame, path: str) -> None:
    """Write whole rows as one folder per shard, each file a run of the curve.

    ``placed`` names a row by (doc_id, size, text_crc32), so all of its copies go where the first went.
    """
    where = placed.groupBy("doc_id", "size", "text_crc32").agg(F.min(F.struct("shard", "hilbert", "slot")).alias("w")).select(F.col("doc_id").alias("_id"), F.col("size").alias("_s"), F.col("text_crc32").alias("_c"), "w.*")
    keyed = sealed(docs, F.col("doc_id").alias("_doc"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("_size"), crc32_long("text").alias("_crc"))
    same = F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_size") == F.col("_s")) & (F.col("_crc") == F.col("_c"))
    order = ["shard", "hilbert", "slot"]
    rows = keyed.join(where, same).select("row", *order).repartitionByRange(*order).sortWithinPartitions(*order)
    rows.select("row", F.col("shard").alias("in_shard")).write.partitionBy("in_shard").parquet(path)
