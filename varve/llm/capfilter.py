"""Embedding near-duplicates by spherical-cap filters from structured random product codes.

A filter direction is one random unit vector per block of coordinates, side by side; there are
``CODE ** BLOCKS`` of them. A vector is list-decoded to every direction whose inner product with it
exceeds the cap's height, by extending partial choices block after block while the best rest can still
reach it. Vectors that share a filter are compared exactly.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from varve.llm.common import HASH_RANGE, hash32
from varve.llm.components import components
from varve.session import checkpointed, ship

THRESHOLD = 0.95
BLOCKS, CODE = 4, 16
HEIGHT = 3.6  # of a cap, in standard deviations of a random direction's inner product
LEAST = 8  # a vector in fewer caps takes its nearest ones
CHUNK = 1024
FILTERS_A_GROUP = 32


def product_code(dim: int, blocks: int = BLOCKS, code: int = CODE, seed: int = 11) -> list[np.ndarray]:
    """For each block of coordinates ``code`` unit vectors, scaled so that a whole direction has norm 1."""
    rng, out = np.random.default_rng(seed), []
    for part in np.array_split(np.arange(dim), min(blocks, dim)):
        v = rng.standard_normal((code, len(part)))
        out.append(v / np.linalg.norm(v, axis=1, keepdims=True) / np.sqrt(min(blocks, dim)))
    return out


def list_decode(unit: np.ndarray, code: list[np.ndarray], height: float = HEIGHT, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) of all directions whose inner product with the row exceeds height / sqrt(dim).

    A row with fewer than ``least`` takes its ``least`` best directions instead, found by lowering the
    height for those rows, so every vector is in some filter.
    """
    n, dim = unit.shape
    at, parts = 0, []
    for v in code:
        parts.append(unit[:, at : at + v.shape[1]] @ v.T)
        at += v.shape[1]
    rest = np.cumsum([p.max(axis=1) for p in parts[::-1]], axis=0)[::-1]
    rows, filters, todo, bar = [], [], np.arange(n), height / np.sqrt(dim)
    while len(todo):
        row, name, total = todo, np.zeros(len(todo), np.int64), np.zeros(len(todo))
        for b, p in enumerate(parts):
            further = rest[b + 1] if b + 1 < len(parts) else np.zeros(n)
            grown = total[:, None] + p[row]
            i, c = np.nonzero(grown + further[row][:, None] > bar)
            row, name, total = row[i], name[i] * p.shape[1] + c, grown[i, c]
        found = np.bincount(row, minlength=n)
        short = todo[found[todo] < least] if bar > -1 else todo[:0]
        full = ~np.isin(row, short)
        rows.append(row[full]), filters.append(name[full])
        todo, bar = short, bar - 0.3 / np.sqrt(dim)
    return np.concatenate(rows), np.concatenate(filters)


def _units(vectors: np.ndarray) -> np.ndarray:
    """Vectors of one length at norm 1; scaled by their largest component first, so that no square is lost."""
    x = np.stack(vectors).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _decoded(vectors: DataFrame) -> DataFrame:
    """Distinct vectors with their sorted filters; each length has a product code and filters of its own."""
    names = vectors.columns

    def run(batches):
        codes: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            length = batch["vec"].map(len)
            for dim in np.unique(length):
                own = batch[length == dim]
                unit = _units(own["vec"].to_numpy())
                row, name = list_decode(unit, codes.setdefault(int(dim), product_code(int(dim))))
                order = np.lexsort((name, row))
                split = np.split(name[order] + int(dim) * CODE**BLOCKS, np.cumsum(np.bincount(row, minlength=len(unit)))[:-1])
                yield own.assign(filters=split)

    return vectors.mapInPandas(run, ", ".join(f"{c} {vectors.schema[c].dataType.simpleString()}" for c in names) + ", filters array<bigint>")


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of each node's component in a small graph."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low), np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _compare(threshold: float):
    """Links within filters, or between two chunks of one: per vector the weight of those whose first common filter it is, and a forest of all of them."""

    def linked(name, x, weight, filters, chunk, left, right):
        ia, ib = np.flatnonzero(chunk == left), np.flatnonzero(chunk == right)
        near = np.argwhere(x[ia] @ x[ib].T >= threshold - 1e-12)
        i, j = ia[near[:, 0]], ib[near[:, 1]]
        if left == right:
            i, j = i[i < j], j[i < j]
        exact = np.einsum("ij,ij->i", x[i], x[j]) >= threshold
        i, j = i[exact], j[exact]
        # all pairs here share this filter: is it the first of those they share?
        first = _first_common(filters, i, j, name) if len(i) else np.zeros(0, bool)
        links = np.bincount(i[first], weight[j[first]], len(x)) + np.bincount(j[first], weight[i[first]], len(x))
        return links, _roots(len(x), i, j)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = int(pdf["left"].iloc[0]), int(pdf["right"].iloc[0])
        pdf = pdf.sort_values(["filter", "node"], kind="stable")
        x = _units(pdf["vec"].to_numpy())
        name, node, weight, chunk, filters = (pdf[c].to_numpy() for c in ("filter", "node", "copies", "chunk", "filters"))
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(name)) + 1, [len(name)]])
        told = []
        for a, b in zip(cuts, cuts[1:]):
            links, root = linked(int(name[a]), x[a:b], weight[a:b], filters[a:b], chunk[a:b], left, right)
            some = np.flatnonzero((links > 0) | (root != np.arange(b - a)))
            told.append((node[a:b][some], links[some].astype(np.int64), node[a:b][root[some]]))
        return pd.DataFrame(dict(zip(("node", "links", "root"), map(np.concatenate, zip(*told)))))

    return run


def _first_common(filters: np.ndarray, i: np.ndarray, j: np.ndarray, name: int) -> np.ndarray:
    """Whether no filter below ``name`` is common to the rows of each pair."""
    if len(i) < 64:
        return np.fromiter((np.intersect1d(filters[a], filters[b], assume_unique=True)[0] == name for a, b in zip(i, j)), bool, len(i))
    earlier = [f[f < name] for f in filters]
    values = np.unique(np.concatenate(earlier)) if len(earlier) else np.zeros(0, np.int64)
    out = np.ones(len(i), bool)
    if not len(values):
        return out
    bits = np.zeros((len(filters), len(values)), bool)
    for r, f in enumerate(earlier):
        bits[r, np.searchsorted(values, f)] = True
    packed = np.packbits(bits, axis=1)
    for at in range(0, len(i), 1 << 16):
        out[at : at + (1 << 16)] = ~(packed[i[at : at + (1 << 16)]] & packed[j[at : at + (1 << 16)]]).any(axis=1)
    return out


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of (vec_id, embedding).

    Links are pairs of rows with cosine >= ``threshold`` in double precision. Equal vectors are one
    vector with a number of copies, so copies are never paired. A filter with many vectors is cut by
    hash into chunks of about CHUNK and its pairs of chunks are tasks of their own; a pair in several
    filters counts in the first. Null, zero and non-finite vectors, and vectors of another length than
    the most common one, link with nothing. Repeated rows with one vec_id are one vector each, and the
    row is repeated in the result. A null vec_id links with nothing. No rows give no rows.
    """
    ship(vectors.sparkSession)
    vec = F.col("embedding")
    bad = F.exists(vec, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    usable = F.coalesce(F.col("vec_id").isNotNull() & ~bad & F.exists(vec, lambda v: v != 0), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(usable, vec).alias("vec"))
    distinct = rows.filter("vec is not null").groupBy("vec").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies"))
    decoded = checkpointed(_decoded(distinct.select("node", "copies", "vec").withColumn("h", hash32("node"))))
    entries = decoded.select("node", "h", F.explode("filters").alias("filter"))
    sizes = entries.groupBy("filter").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("filter", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))
    placed = decoded.withColumn("filter", F.explode("filters")).join(sizes, "filter").withColumn("chunk", F.floor(F.col("h") * F.col("chunks") / F.lit(HASH_RANGE)).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.struct(F.least(c, F.col("chunk")).alias("left"), F.greatest(c, F.col("chunk")).alias("right")))
    # small filters are dealt out many to a group; one that is cut has its groups to itself
    bunch = F.when(F.col("chunks") == 1, F.floor(F.col("filter") / FILTERS_A_GROUP)).otherwise(-1 - F.col("filter"))
    dealt = placed.select(bunch.alias("bunch"), "filter", F.explode(pairs).alias("p"), "chunk", "node", "copies", "vec", "filters").select("bunch", "filter", "p.left", "p.right", "chunk", "node", "copies", "vec", "filters")
    found = checkpointed(dealt.groupBy("bunch", "left", "right").applyInPandas(_compare(threshold), "node bigint, links bigint, root bigint"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(found.filter("node != root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    per_vector = distinct.join(links, "node", "left").join(groups, "node", "left").select("vec", "node", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "node").alias("component"))
    placed_rows = rows.filter("vec is not null").join(per_vector, "vec").select("vec_id", (F.col("links") + F.col("copies") - 1).cast("long").alias("n_links"), F.col("component").alias("component_id"))
    lone = rows.filter("vec is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return placed_rows.unionByName(lone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
