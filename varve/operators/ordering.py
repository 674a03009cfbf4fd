"""Exact ranks and order statistics that stay distributed when one key holds most of the rows.

The common shape is two-level: count rows per (key, cell) with map-side combining, turn those
counts into cell offsets, and number rows only inside a cell. No task ever sorts a whole key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varve.functions.numeric import is_finite
from varve.session import checkpointed

_BEFORE = (Window.unboundedPreceding, -1)


def cell_offsets(df: DataFrame, keys: Sequence[str], cells: Sequence[str], weight: Column | None = None) -> DataFrame:
    """Rows per (key, cell) and the number of rows of that key in earlier cells (``start``)."""
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = df.groupBy(*keys, *cells).agg(n.alias("_n"))
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*cells).rowsBetween(*_BEFORE)
    return counts.withColumn("_start", F.coalesce(F.sum("_n").over(w), F.lit(0).cast("long")))


def dense_index(
    df: DataFrame,
    keys: Sequence[str],
    cells: Sequence[str],
    order: Sequence[str],
    name: str,
    upto: DataFrame | None = None,
    upto_col: str = "upto",
) -> DataFrame:
    """Number the rows of each key 1..n in (cells, order) order.

    ``cells`` must be a monotone coarsening of the full order (a day, an id block): they split a
    hot key across tasks. With ``upto`` (key, bound, ...) only the first ``bound`` rows of each key
    are produced, cells past the bound are dropped before the rows are shuffled for sorting, and the
    other columns of ``upto`` ride along.
    """
    offsets = cell_offsets(df, keys, cells)
    if upto is not None:
        offsets = offsets.join(upto.withColumnRenamed(upto_col, "_upto"), list(keys))
        offsets = offsets.filter(F.col("_start") < F.col("_upto"))
    rows = df.join(offsets.drop("_n"), [*keys, *cells])
    w = Window.partitionBy(*keys, *cells).orderBy(*order)
    rows = rows.withColumn(name, (F.col("_start") + F.row_number().over(w)).cast("long")).drop("_start")
    if upto is not None:
        rows = rows.filter(F.col(name) <= F.col("_upto")).drop("_upto")
    return rows


def id_blocks(df: DataFrame, id_col: str, name: str, rows: int = 1 << 14, most: int = 1024) -> DataFrame:
    """Add a block number that rises with the id; blocks hold about ``rows`` rows however the ids are spaced.

    Borders are sketched quantiles of the ids at hand. They are constants of the plan and steer its
    layout only, so a task that runs again sees the same blocks.
    """
    blocks = min(most, -(-df.count() // rows))
    if blocks < 2:
        return df.withColumn(name, F.lit(0))
    cuts = F.array(*[F.lit(i / blocks) for i in range(1, blocks)])
    borders = df.select(F.percentile_approx(id_col, cuts, 8 * blocks)).first()[0] or []
    return df.withColumn(name, F.size(F.filter(F.array(*map(F.lit, borders)), lambda b: b < F.col(id_col))))


def hash_rank(df: DataFrame, hex_col: str, tiebreak: str, name: str, hex_digits: int = 3) -> DataFrame:
    """Global 1..n rank by a uniform hex digest, plus the total ``n_all``.

    The leading hex digits cut the table into 16**hex_digits even cells, so the only global step
    is a running sum over that many rows.
    """
    cut = df.withColumn("_cell", F.substring(hex_col, 1, hex_digits))
    offsets = cell_offsets(cut, [], ["_cell"])
    offsets = offsets.withColumn("n_all", F.sum("_n").over(Window.partitionBy(F.lit(0))))
    # one row per leading hex prefix: 16**hex_digits at most
    offsets = F.broadcast(offsets.drop("_n"))
    w = Window.partitionBy("_cell").orderBy(hex_col, tiebreak)
    ranked = cut.join(offsets, "_cell").withColumn(name, F.col("_start") + F.row_number().over(w))
    return ranked.drop("_cell", "_start")


def cumulative_counts(df: DataFrame, keys: Sequence[str], value: str, buckets: int | None = None) -> DataFrame:
    """Distinct values of each key with ``n_at``, ``n_before`` and ``n_key``.

    Repeats are collapsed first, so ties cannot pile into one task. Bucket borders come from a
    mergeable sketch of the distinct values; they only steer the split, so the counts are exact.
    The border table is checkpointed: a recomputed task must see the same borders. A key is cut into as
    many buckets as the session has shuffle partitions, 64 at least.
    """
    keys = list(keys)
    buckets = buckets or max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n_at"))
    if not keys:
        counts = counts.withColumn("_all", F.lit(0))
    by = keys or ["_all"]
    fractions = F.array(*[F.lit((i + 1) / buckets) for i in range(buckets - 1)])
    borders = checkpointed(
        counts.groupBy(*by).agg(F.percentile_approx(value, fractions, 4 * buckets).alias("_borders"), F.sum("n_at").alias("n_key"))
    )
    cut = counts.join(borders, by).withColumn("_cell", F.size(F.filter("_borders", lambda b: b < F.col(value)))).drop("_borders")
    offsets = cell_offsets(cut, by, ["_cell"], F.col("n_at")).drop("_n")
    w = Window.partitionBy(*by, "_cell").orderBy(value).rowsBetween(*_BEFORE)
    out = cut.join(offsets, [*by, "_cell"]).withColumn("n_before", F.col("_start") + F.coalesce(F.sum("n_at").over(w), F.lit(0).cast("long")))
    return out.select(*keys, value, "n_at", "n_before", "n_key")


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Attach the rank of ``value`` within ``keys``, ties sharing their average rank."""
    table = cumulative_counts(df, keys, value)
    ranked = table.select(*keys, value, (F.col("n_before") + (F.col("n_at") + 1) / F.lit(2.0)).alias(name))
    return df.join(ranked, [*keys, value])


def value_at(table_value: str, index: Column) -> Column:
    """Aggregate over a cumulative_counts table: the value at 0-based ``index`` of its key."""
    hit = (F.col("n_before") <= index) & (index < F.col("n_before") + F.col("n_at"))
    return F.max(F.when(hit, F.col(table_value)))


def linear_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Linearly interpolated exact quantiles per key, for keys of any size."""
    table = cumulative_counts(df, keys, value)
    aggs, outs = [], []
    for name, p in probs.items():
        h = (F.col("n_key") - 1) * F.lit(float(p))
        aggs += [value_at(value, F.floor(h)).alias(f"_lo_{name}"), value_at(value, F.ceil(h)).alias(f"_hi_{name}"), F.max(h - F.floor(h)).alias(f"_g_{name}")]
        outs.append((F.col(f"_lo_{name}") + F.col(f"_g_{name}") * (F.col(f"_hi_{name}") - F.col(f"_lo_{name}"))).alias(name))
    return table.groupBy(*keys).agg(F.max("n_key").alias("n"), *aggs).select(*keys, "n", *outs)


def finite_only(df: DataFrame, value: str) -> DataFrame:
    return df.filter(is_finite(F.col(value)))
