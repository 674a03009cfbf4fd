"""Design audit: counts by role, band and quartile, cutoff sensitivity, duplicate histories."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varve.functions.hashing import hash_mod
from varve.operators.ordering import cumulative_counts, dense_index, id_blocks, linear_quantiles
from varve.operators.stats import associations, summary
from varve.session import checkpointed

ROLES = ("fit", "tune", "calibration")
# Thresholds of the duplicate screen.
MIN_COMMON, MEAN_LIMIT, CHANNEL_LIMIT = 30, 0.02, 0.10
# Pivots of the metric index, those that make its grid, and how much longer each band of histories is.
PIVOTS, KEYED, GROWTH = 8, 3, 1.25


def role_counts(entities: DataFrame) -> DataFrame:
    g = entities.groupBy("role").agg(F.count(F.lit(1)).alias("reserved"), F.count_if("eligible").alias("eligible"))
    alive = entities.filter("eligible")
    for c in ("cutoff", "lifetime"):
        g = g.join(linear_quantiles(alive, ["role"], c, {f"median_{c}": 0.5}).drop("n"), "role", "left")
    return g.withColumn("ineligible", F.col("reserved") - F.col("eligible")).withColumn("eligible_fraction", F.col("eligible") / F.col("reserved"))


def band_index(cutoff: Column, low: int, width: int, bands: int = 5) -> Column:
    """0-based integer band: band i starts at low + floor(i * width / bands)."""
    starts = [low + (i * width) // bands for i in range(bands)]
    out = F.lit(0)
    for i, s in enumerate(starts):
        out = F.when(cutoff >= s, F.lit(i)).otherwise(out) if i else out
    return out


def cutoff_bands(entities: DataFrame, low: int, width: int, bands: int = 5, roles: Sequence[str] = ROLES) -> DataFrame:
    """Assigned and eligible counts per band and role, empty cells included, plus an ``all`` role."""
    counted = entities.withColumn("band", band_index(F.col("cutoff"), low, width, bands)).groupBy("band", "role").agg(
        F.count(F.lit(1)).alias("assigned"), F.count_if("eligible").alias("eligible")
    )
    spark = entities.sparkSession
    cells = spark.range(bands).select(F.col("id").cast("int").alias("band"), F.explode(F.array(*map(F.lit, roles))).alias("role"))
    full = cells.join(counted, ["band", "role"], "left").fillna(0, ["assigned", "eligible"])
    out = full.groupingSets([["band", "role"], ["band"]], "band", "role").agg(F.sum("assigned").alias("assigned"), F.sum("eligible").alias("eligible"))
    lo = F.lit(low) + F.floor(F.col("band") * width / bands)
    hi = F.lit(low) + F.floor((F.col("band") + 1) * width / bands) - 1
    return out.select("band", F.coalesce("role", F.lit("all")).alias("role"), lo.alias("min_cutoff"), hi.alias("max_cutoff"), "assigned", "eligible")


def lifetime_quartiles(entities: DataFrame, id_col: str = "entity_id", block: int = 1 << 14) -> DataFrame:
    """Rank quartile min(3, floor(4 i / n)), i counted from 0 by (lifetime, id)."""
    before = cumulative_counts(entities, [], "lifetime").select("lifetime", "n_before", "n_key")
    cut = id_blocks(entities, id_col, "_block", block)
    inside = dense_index(cut, ["lifetime"], ["_block"], [id_col], "_i").drop("_block")
    i = F.col("n_before") + F.col("_i") - 1
    return inside.join(before, "lifetime").withColumn("quartile", F.least(F.lit(3), F.floor(i * 4 / F.col("n_key"))).cast("int")).drop("_i", "n_before", "n_key")


def quartile_tables(with_quartile: DataFrame, roles: Sequence[str] = ROLES) -> DataFrame:
    """Counts per quartile and per (role, quartile), empty cells included."""
    counted = with_quartile.groupBy("quartile", "role").agg(
        F.count(F.lit(1)).alias("assigned"), F.count_if("eligible").alias("eligible"), F.min("lifetime").alias("lo"), F.max("lifetime").alias("hi")
    )
    cells = with_quartile.sparkSession.range(4).select(F.col("id").cast("int").alias("quartile"), F.explode(F.array(*map(F.lit, roles))).alias("role"))
    full = cells.join(counted, ["quartile", "role"], "left").fillna(0, ["assigned", "eligible"])
    g = full.groupingSets([["quartile", "role"], ["quartile"]], "quartile", "role").agg(
        F.sum("assigned").alias("assigned"), F.sum("eligible").alias("eligible"), F.min("lo").alias("lifetime_min"), F.max("hi").alias("lifetime_max")
    )
    return g.withColumn("role", F.coalesce("role", F.lit("all")))


def quartile_medians(with_quartile: DataFrame) -> DataFrame:
    a = linear_quantiles(with_quartile, ["quartile"], "lifetime", {"lifetime_median": 0.5})
    b = linear_quantiles(with_quartile, ["quartile"], "cutoff", {"cutoff_median": 0.5}).drop("n")
    return a.join(b, "quartile")


def cutoff_lifetime_association(entities: DataFrame) -> DataFrame:
    """Correlations of cutoff and lifetime for everyone and for the eligible."""
    cohorts = entities.select("entity_id", "cutoff", "lifetime", F.explode(F.when(F.col("eligible"), F.array(F.lit("all"), F.lit("eligible"))).otherwise(F.array(F.lit("all")))).alias("cohort"))
    return associations(cohorts, ["cohort"], "cutoff", "lifetime")


def sensitivity_flags(entities: DataFrame, seed: str, low: int, width: int, scenarios: int = 100, id_col: str = "entity_id") -> DataFrame:
    """Eligibility of every entity under each alternative cutoff salt."""
    s = entities.withColumn("scenario", F.explode(F.sequence(F.lit(1), F.lit(scenarios))))
    tag = F.concat(F.lit("cutoff-sensitivity-"), F.lpad(F.col("scenario").cast("string"), 3, "0"))
    cut = F.lit(low) + hash_mod(seed, tag, F.col(id_col), width)
    return s.withColumn("alternate", cut < F.col("lifetime"))


def sensitivity_by_role(flags: DataFrame) -> DataFrame:
    """Distribution over scenarios of the eligible count, per role and in total."""
    per = flags.groupBy("scenario", "role").agg(F.count_if("alternate").alias("eligible"))
    both = per.groupingSets([["scenario", "role"], ["scenario"]], "scenario", "role").agg(F.sum("eligible").alias("eligible"))
    # at most scenarios x roles rows from here on
    return summary(both.select(F.coalesce("role", F.lit("all")).alias("role"), "eligible"), ["role"], "eligible")


def sensitivity_by_entity(flags: DataFrame, scenarios: int = 100, id_col: str = "entity_id") -> DataFrame:
    """Selection frequency and mismatches with the canonical status; unstable when it changes at all."""
    g = flags.groupBy(id_col, "role", "eligible").agg(
        F.count_if("alternate").alias("selected"), F.count_if(F.col("alternate") != F.col("eligible")).alias("mismatches")
    )
    return g.withColumn("frequency", F.col("selected") / F.lit(scenarios)).withColumn("unstable", (F.col("selected") > 0) & (F.col("selected") < scenarios))


def prefix_fingerprints(prefix: DataFrame, channels: Sequence[str], id_col: str = "entity_id") -> DataFrame:
    """Running fingerprint of each history at every length (two 55-bit sums of row hashes).

    A prefix is at most the longest cutoff, so the running window is bounded.
    """
    w = Window.partitionBy(id_col).orderBy("cycle").rowsBetween(Window.unboundedPreceding, 0)
    h = lambda salt: F.shiftright(F.xxhash64(F.lit(salt), "cycle", *channels), 9)
    return prefix.withColumn("_a", F.sum(h(1)).over(w)).withColumn("_b", F.sum(h(2)).over(w)).select(
        id_col, "cutoff", F.col("cycle").alias("length"), "_a", "_b", (F.col("cycle") == F.col("cutoff")).alias("full")
    )


def exact_groups(prefix: DataFrame, channels: Sequence[str], min_common: int = MIN_COMMON, id_col: str = "entity_id") -> DataFrame:
    """Identical histories, grouped rather than paired.

    Two entities match when the shorter one's whole history opens the longer one. A group is one
    (length, content); ``n_full`` entities end there, ``n_longer`` continue, and ``pairs`` counts
    the matching pairs whose shorter member ends there. The group size never becomes a pair list.
    """
    fp = prefix_fingerprints(prefix, channels, id_col).filter(F.col("length") >= min_common)
    g = fp.groupBy("length", "_a", "_b").agg(F.count_if("full").alias("n_full"), F.count_if(~F.col("full")).alias("n_longer"), F.min(id_col).alias("representative"))
    pairs = F.col("n_full") * (F.col("n_full") - 1) / 2 + F.col("n_full") * F.col("n_longer")
    return g.withColumn("pairs", pairs.cast("long")).filter("pairs > 0").drop("_a", "_b")


def cross_exact_groups(left: DataFrame, right: DataFrame, channels: Sequence[str], id_col: str = "entity_id") -> DataFrame:
    """Identical openings across two tables at any positive common length, grouped.

    Rows after the shorter of the two longest histories cannot be common and are dropped first.
    """
    longest = lambda df: df.agg(F.max("cutoff").alias("_p"))
    bound = longest(left).unionByName(longest(right)).agg(F.min("_p").alias("_p")).withColumn("_k", F.lit(0))
    cut = lambda df: df.withColumn("_k", F.lit(0)).join(F.broadcast(bound), "_k").filter(F.col("cycle") <= F.col("_p")).drop("_k", "_p")
    left, right = cut(left), cut(right)
    l = prefix_fingerprints(left, channels, id_col).withColumn("_left", F.lit(True))
    r = prefix_fingerprints(right, channels, id_col).withColumn("_left", F.lit(False))
    g = l.unionByName(r).groupBy("length", "_a", "_b").agg(
        F.count_if(F.col("_left") & F.col("full")).alias("left_full"), F.count_if(F.col("_left") & ~F.col("full")).alias("left_longer"),
        F.count_if(~F.col("_left") & F.col("full")).alias("right_full"), F.count_if(~F.col("_left") & ~F.col("full")).alias("right_longer"),
    )
    pairs = F.col("left_full") * (F.col("right_full") + F.col("right_longer")) + F.col("right_full") * F.col("left_longer")
    return g.withColumn("pairs", pairs).filter("pairs > 0").drop("_a", "_b")


def scaled(prefix: DataFrame, scales: DataFrame, channels: Sequence[str]) -> DataFrame:
    """Channels divided by their frozen scale (a one-row table)."""
    j = prefix.withColumn("_k", F.lit(0)).join(F.broadcast(scales.withColumn("_k", F.lit(0))), "_k").drop("_k")
    return j.select(*[c for c in prefix.columns if c not in channels], *[(F.col(c) / F.col(f"scale_{c}")).alias(c) for c in channels])


def distinct_histories(prefix: DataFrame, channels: Sequence[str], id_col: str = "entity_id") -> DataFrame:
    """One representative per identical history with its number of copies, so copies are screened once."""
    fp = prefix_fingerprints(prefix, channels, id_col).filter("full")
    return fp.groupBy("length", "_a", "_b").agg(F.min(id_col).alias(id_col), F.count(F.lit(1)).alias("copies")).select(id_col, "copies")


def _segment(cycle: Column, head: int) -> Column:
    """Segments of growing length: 0 holds the first ``head`` cycles, each border is GROWTH times the one before."""
    return F.greatest(F.lit(0), F.ceil(F.log(cycle / F.lit(float(head))) / F.lit(math.log(GROWTH)) - F.lit(1e-9))).cast("int")


def pivot_points(rows: DataFrame, channels: Sequence[str], head: int = MIN_COMMON, id_col: str = "entity_id") -> DataFrame:
    """PIVOTS histories chosen by hash, as one row per cycle: ``_p`` holds each pivot's channels.

    A pivot may be any point, so a history that has ended, or is missing, counts as zero. The table
    has at most as many rows as the longest history.
    """
    firsts = rows.filter((F.col("cycle") == 1) & (F.col("cutoff") >= head)).select(id_col)
    chosen = firsts.orderBy(F.xxhash64(F.lit(8), id_col), id_col).limit(PIVOTS)
    numbered = chosen.withColumn("_n", F.row_number().over(Window.orderBy(id_col)))
    points = rows.join(numbered, id_col).groupBy("cycle").agg(*[
        F.max(F.when(F.col("_n") == p + 1, F.col(c))).alias(f"_p{p}_{i}") for p in range(PIVOTS) for i, c in enumerate(channels)])
    return checkpointed(points)


def pivot_index(rows: DataFrame, points: DataFrame, channels: Sequence[str], head: int = MIN_COMMON, id_col: str = "entity_id") -> DataFrame:
    """Distances of every history to the pivots over its first segments, one row per (history, segment).

    ``band`` is the last segment counted; only segments that lie wholly inside the history have a row.
    ``own`` marks a history's last one.
    """
    square = lambda p: sum(((F.col(c) - F.coalesce(F.col(f"_p{p}_{i}"), F.lit(0.0))) ** 2 for i, c in enumerate(channels)), F.lit(0.0))
    last = _segment(F.col("cutoff") + 1, head) - 1
    j = rows.join(points, "cycle", "left").withColumn("band", _segment(F.col("cycle"), head)).filter(F.col("band") <= last)
    parts = j.groupBy(id_col, "cutoff", "band").agg(*[F.sum(square(p)).alias(f"_s{p}") for p in range(PIVOTS)])
    w = Window.partitionBy(id_col).orderBy("band").rowsBetween(Window.unboundedPreceding, 0)
    return parts.select(id_col, "cutoff", "band", (F.col("band") == last).alias("own"), *[F.sqrt(F.sum(f"_s{p}").over(w)).alias(f"_d{p}") for p in range(PIVOTS)])


def candidate_pairs(left: DataFrame, right: DataFrame | None, n_channels: int, mean_limit: float, head: int = MIN_COMMON, id_col: str = "entity_id") -> DataFrame:
    """Pairs of indexed histories that can still lie within ``mean_limit``; none that does is lost.

    With K channels the squared scaled distance over the common cycles is K * common * mean^2. A pair
    is met in the band of its shorter history, all of whose cycles are common, so over that band
    the distance of the two is at most r = mean_limit * sqrt(K * longest history of the band), and by
    the triangle inequality their distances to any pivot differ by at most r. The first KEYED pivots
    make a grid of cells 2 r wide, in which the shorter side enters every cell within r; the join
    drops whatever another pivot tells apart. A pair meets in one cell at most, so nothing is repeated.
    """
    r = (F.lit(mean_limit * (1.0 + 1e-9)) * F.sqrt(F.lit(float(n_channels)) * (F.lit(float(head)) * F.pow(F.lit(GROWTH), F.col("band") + 1) + 2)) + F.lit(1e-9))
    cells = [f"_c{d}" for d in range(KEYED)]

    def shorter(side: DataFrame, name: str) -> DataFrame:
        g = side.filter("own").withColumn("_r", r)
        for d, c in enumerate(cells):
            reach = F.col("_r") + F.col(f"_d{d}") * F.lit(1e-12)
            at = lambda x: F.floor(x / (F.col("_r") * 2))
            g = g.withColumn(c, F.explode(F.array_distinct(F.array(at(F.col(f"_d{d}") - reach), at(F.col(f"_d{d}") + reach)))))
        return g.select(F.col(id_col).alias(name), F.col("cutoff").alias("_cs"), "_r", "band", *cells, *[F.col(f"_d{p}").alias(f"_e{p}") for p in range(PIVOTS)])

    def longer(side: DataFrame, name: str) -> DataFrame:
        g = side.withColumn("_r", r)
        grid = [F.floor(F.col(f"_d{d}") / (F.col("_r") * 2)).alias(c) for d, c in enumerate(cells)]
        return g.select(F.col(id_col).alias(name), F.col("cutoff").alias("_cl"), "own", "band", *grid, *[f"_d{p}" for p in range(PIVOTS)])

    near = F.lit(True)
    for p in range(PIVOTS):
        near = near & (F.abs(F.col(f"_d{p}") - F.col(f"_e{p}")) <= F.col("_r") + F.col(f"_d{p}") * F.lit(1e-12))
    common = F.least("_cs", "_cl").alias("common_cycles")
    on = ["band", *cells]
    if right is None:
        once = ~F.col("own") | (F.struct("_cs", "_s") < F.struct("_cl", "_l"))
        return shorter(left, "_s").join(longer(left, "_l"), on).filter(near & once).select(F.least("_s", "_l").alias("a"), F.greatest("_s", "_l").alias("b"), common)
    first = shorter(left, "a").join(longer(right, "b"), on).filter(near)
    second = shorter(right, "b").join(longer(left, "a").filter(~F.col("own")), on).filter(near)
    return first.select("a", "b", common).unionByName(second.select("a", "b", common))


def pair_distances(pairs: DataFrame, left: DataFrame, right: DataFrame, channels: Sequence[str], id_col: str = "entity_id") -> DataFrame:
    """Root mean square scaled difference of each pair over its common cycles, mean and worst channel."""
    l = left.select(F.col(id_col).alias("a"), "cycle", *[F.col(c).alias(f"_l_{c}") for c in channels])
    r = right.select(F.col(id_col).alias("b"), "cycle", *[F.col(c).alias(f"_r_{c}") for c in channels])
    j = pairs.join(l, "a").filter(F.col("cycle") <= F.col("common_cycles")).join(r, ["b", "cycle"])
    sq = {c: F.col(f"_l_{c}") - F.col(f"_r_{c}") for c in channels}
    g = j.groupBy("a", "b", "common_cycles").agg(*[F.sum(d * d).alias(f"_s_{c}") for c, d in sq.items()])
    ms = [F.col(f"_s_{c}") / F.col("common_cycles") for c in channels]
    total = ms[0]
    for m in ms[1:]:
        total = total + m
    worst = F.sqrt(F.greatest(*ms)) if len(ms) > 1 else F.sqrt(ms[0])
    return g.select("a", "b", "common_cycles", F.sqrt(total / len(channels)).alias("mean_nrmse"), worst.alias("max_channel_nrmse"))


def _screened(side: DataFrame, scales: DataFrame, channels: Sequence[str], id_col: str) -> tuple[DataFrame, DataFrame]:
    """Representatives with their number of copies, and the representatives' scaled rows."""
    reps = distinct_histories(side, channels, id_col)
    return reps, scaled(side.join(reps.select(id_col), id_col, "left_semi"), scales, channels)


def near_pairs(
    left: DataFrame, right: DataFrame | None, scales: DataFrame, channels: Sequence[str], mean_limit: float = MEAN_LIMIT,
    channel_limit: float = CHANNEL_LIMIT, head: int = MIN_COMMON, id_col: str = "entity_id", include_exact: bool = False,
) -> DataFrame:
    """Near-duplicate pairs within one table (``right`` None) or across two; identical pairs excluded.

    Identical histories are collapsed to one representative first (``copies``), so a group of
    copies costs one history, not its square.
    """
    lreps, lrows = _screened(left, scales, channels, id_col)
    rreps, rrows = (lreps, lrows) if right is None else _screened(right, scales, channels, id_col)
    points = pivot_points(lrows, channels, head, id_col)
    index = lambda rows: checkpointed(pivot_index(rows, points, channels, head, id_col))
    pairs = candidate_pairs(index(lrows), None if right is None else index(rrows), len(channels), mean_limit, head, id_col)
    dist = pair_distances(pairs, lrows, rrows, channels, id_col)
    near = dist.filter((F.col("mean_nrmse") <= mean_limit) & (F.col("max_channel_nrmse") <= channel_limit))
    if not include_exact:
        near = near.filter(F.col("mean_nrmse") > 0)
    ca = lreps.select(F.col(id_col).alias("a"), F.col("copies").alias("copies_a"))
    cb = rreps.select(F.col(id_col).alias("b"), F.col("copies").alias("copies_b"))
    return near.join(ca, "a").join(cb, "b")


def cross_screen(left: DataFrame, right: DataFrame, scales: DataFrame, channels: Sequence[str], id_col: str = "entity_id") -> DataFrame:
    """One row: exact pairs at any common length, near pairs from MIN_COMMON cycles, and the status, FAIL on any hit.

    ``scales`` are those of the training side. Histories on the right are cut after the longest on the left:
    nothing after it is common.
    """
    count = lambda df, n, name: df.agg(F.coalesce(F.sum(n), F.lit(0)).cast("long").alias(name)).withColumn("_k", F.lit(0))
    exact = count(cross_exact_groups(left, right, channels, id_col), F.col("pairs"), "exact_pairs")
    bound = left.agg(F.max("cutoff").alias("_p")).withColumn("_k", F.lit(0))
    cut = right.withColumn("_k", F.lit(0)).join(F.broadcast(bound), "_k").filter(F.col("cycle") <= F.col("_p"))
    cut = checkpointed(cut.select(id_col, "cycle", F.least("cutoff", "_p").alias("cutoff"), *channels))
    near = count(near_pairs(left, cut, scales, channels, id_col=id_col), F.col("copies_a") * F.col("copies_b"), "near_pairs")
    hit = (F.col("exact_pairs") > 0) | (F.col("near_pairs") > 0)
    return exact.join(near, "_k").select("exact_pairs", "near_pairs", F.when(hit, "FAIL").otherwise("PASS").alias("status"))


def least_members(prefix: DataFrame, channels: Sequence[str], k: int, id_col: str = "entity_id") -> DataFrame:
    """(representative, member) for the ``k`` least members of each identical history, itself included.

    Members are cut to ``k`` within hash blocks first, so a history held by most entities is no single task.
    """
    fp = prefix_fingerprints(prefix, channels, id_col).filter("full").withColumn("_salt", F.pmod(F.xxhash64(id_col), F.lit(64)))
    key = ["length", "_a", "_b"]
    cut = lambda df, by: df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(id_col))).filter(F.col("_n") <= k)
    least = cut(cut(fp, [*key, "_salt"]), key)
    return least.select(F.min(id_col).over(Window.partitionBy(*key)).alias("rep"), F.col(id_col).alias("member"), F.col("length").alias("common_cycles"))


def closest_pairs(prefix: DataFrame, scales: DataFrame, channels: Sequence[str], k: int = 5, start: float = MEAN_LIMIT, id_col: str = "entity_id") -> DataFrame:
    """The ``k`` closest pairs by (mean, worst channel, longer common history, a, b), exactly; fewer if there are no more.

    Rounds over one pivot index: the radius doubles but never passes the k-th distance met so far,
    which later rounds can only lower; the search ends when that distance lies within the radius, as
    a pair outside it cannot be closer. Copies of one history are pairs at distance zero: each
    history stands for its ``k`` least members, since any other pair has ``k`` better ones. On
    data without close pairs the last radius, and with it the work, is that of the k-th pair.
    """
    _, rows = _screened(prefix, scales, channels, id_col)
    rows = checkpointed(rows)
    index = checkpointed(pivot_index(rows, pivot_points(rows, channels, id_col=id_col), channels, id_col=id_col))
    members = checkpointed(least_members(prefix.filter(F.col("cutoff") >= MIN_COMMON), channels, k, id_col))
    order = ["mean_nrmse", "max_channel_nrmse", F.col("common_cycles").desc(), "a", "b"]
    other = members.select("rep", F.col("member").alias("b"))
    copies = members.withColumnRenamed("member", "a").join(other, "rep").filter("a < b")
    copies = checkpointed(copies.select("a", "b", "common_cycles", F.lit(0.0).alias("mean_nrmse"), F.lit(0.0).alias("max_channel_nrmse")))
    n = prefix.filter((F.col("cycle") == 1) & (F.col("cutoff") >= MIN_COMMON)).count()
    target, radius = min(k, n * (n - 1) // 2), start
    of = lambda rep, name: members.select(F.col("rep").alias(rep), F.col("member").alias(name))
    while True:
        found = pair_distances(candidate_pairs(index, None, len(channels), radius, id_col=id_col), rows, rows, channels, id_col)
        best = found.orderBy(*order).limit(k).withColumnRenamed("a", "_ra").withColumnRenamed("b", "_rb")
        spread = best.join(of("_ra", "_ma"), "_ra").join(of("_rb", "_mb"), "_rb")
        spread = spread.select(F.least("_ma", "_mb").alias("a"), F.greatest("_ma", "_mb").alias("b"), "common_cycles", "mean_nrmse", "max_channel_nrmse")
        top = checkpointed(spread.unionByName(copies).orderBy(*order).limit(k))
        met = top.agg(F.count(F.lit(1)).alias("n"), F.max("mean_nrmse").alias("far")).first()
        if met.n >= target and (met.far is None or met.far <= radius):
            return top
        radius = min(2.0 * radius, met.far) if met.n >= target else 2.0 * radius
