"""Exact top-k search over binary codes by incremental multi-index hashing.

A 64-bit code is cut into segments. A code within Hamming distance m * (r + 1) - 1 of a query (m
segments) agrees with it in some segment up to r bits, so after probing every segment at radii 0..r
all codes that near are known. The radius grows until the k-th verified distance is covered.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varve.session import checkpointed

BITS = 64


def sign_codes(vectors: DataFrame, ident: str, column: str) -> DataFrame:
    """(id, code): bit i is set where the sum of components i, i + 64, ... is positive.

    Null vectors, and vectors with null or non-finite components, have no code and are left out; an
    empty vector has code 0. Repeated (id, code) rows count once; a null id is left out.
    """
    vec = F.col(column).cast("array<double>")
    fine = vec.isNotNull() & F.col(ident).isNotNull() & ~F.exists(vec, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    code = F.expr(f"aggregate(transform(sequence(0, {BITS - 1}), i -> if(aggregate(filter(_v, (x, j) -> j % {BITS} = i), 0D, (s, x) -> s + x) > 0, shiftleft(1L, i), 0L)), 0L, (a, b) -> a | b)")
    return vectors.filter(fine).select(F.col(ident).cast("long").alias("id"), vec.alias("_v")).select("id", code.alias("code")).distinct()


def _segments(width: int) -> list[tuple[int, int]]:
    """(shift, width) of the segments, as even as they can be."""
    m = -(-BITS // width)
    cuts = [BITS * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _part(code: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(code, shift).bitwiseAND(F.lit((1 << width) - 1))


def _flipped(value: Column, masks: list[int]) -> Column:
    constants = F.split(F.lit(",".join(map(str, masks))), ",").cast("array<bigint>")
    return F.transform(constants, lambda m: value.bitwiseXOR(m))


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def top_k(queries: DataFrame, codes: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, distance, rank) of the k nearest codes of every query, ties by least id.

    Rows of one code are indexed once with their k least ids, which are all that can be among the k
    nearest, so copies cost nothing. Fewer than k codes give fewer rows; no codes or queries give none.
    A pair met in several segments is verified once, in the segment where it is nearest.
    """
    w = Window.partitionBy("code").orderBy("id")
    index = checkpointed(codes.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    size = index.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("ids")), F.lit(0)).alias("ids")).first()
    wanted = min(k, size["ids"])
    # bound: the distance of a query's k-th code so far, beyond which none matters
    active = checkpointed(queries.select(F.col("code").alias("query"), F.lit(BITS).alias("bound")).distinct())
    # some eight codes a bucket
    segments = _segments(min(20, max(8, size["n"].bit_length() - 3)))
    keys = [F.struct(F.lit(i).alias("seg"), _part(F.col("code"), *s).alias("val")) for i, s in enumerate(segments)]
    table = index.select(F.explode(F.array(*keys)).alias("s"), "code", "ids").select("s.seg", "s.val", "code", "ids")
    done, best, radius = None, None, 0
    while True:
        probes = []
        for i, (shift, width) in enumerate(segments):
            if radius <= width:
                masks = [sum(1 << b for b in bits) for bits in combinations(range(width), radius)]
                own = _part(F.col("query"), shift, width)
                probes.append(active.select("query", "bound", F.lit(i).alias("seg"), F.explode(_flipped(own, masks)).alias("val")))
        probe = probes[0]
        for p in probes[1:]:
            probe = probe.unionByName(p)
        # the probes are many rows made from few, so their size is not what the optimizer takes it for
        differ = F.col("query").bitwiseXOR(F.col("code"))
        met = probe.hint("merge").join(table, ["seg", "val"]).filter(F.bit_count(differ) <= F.col("bound"))
        met = met.withColumns({f"_d{i}": F.bit_count(_part(differ, *s)) for i, s in enumerate(segments)})
        elsewhere = F.lit(False)
        for i in range(len(segments)):
            elsewhere = elsewhere | (F.col(f"_d{i}") < radius) | ((F.col(f"_d{i}") == radius) & (F.col("seg") > i))
        new = met.filter(~elsewhere).select("query", F.bit_count(differ).cast("int").alias("distance"), F.explode("ids").alias("id"))
        if best is not None:
            new = new.unionByName(best.select("query", "distance", "id"))
        best = checkpointed(_best(new, k))
        covered = min(BITS, len(segments) * (radius + 1) - 1)
        settled = best.filter((F.col("rank") == wanted) & (F.col("distance") <= covered)).select("query")
        ready = best.join(settled, "query", "left_semi")
        done = ready if done is None else done.unionByName(ready)
        far = best.filter(F.col("rank") == wanted).select("query", F.col("distance").alias("_far"))
        active = checkpointed(active.join(settled, "query", "left_anti").join(far, "query", "left").select("query", F.coalesce("_far", "bound").alias("bound")))
        if active.isEmpty() or covered >= BITS or not wanted:
            break
        best, radius = best.join(active, "query", "left_semi"), radius + 1
    asked = queries.select(F.col("id").alias("query_id"), F.col("code").alias("query"))
    return asked.join(done, "query").select("query_id", F.col("id").alias("vec_id"), "distance", "rank")
