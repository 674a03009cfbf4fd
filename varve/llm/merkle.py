"""Merkle manifest of a dataset: an eight-ary hash tree for each key value, folded again from kept hash states.

The tree is cut into subtrees of ``BLOCK`` consecutive nodes, each built inside one task. A parent
there keeps a copy of its SHA-256 state from before every child slot, so that folding a changed leaf
copies that state and feeds the new digest and the siblings to its right; nothing to the left is
hashed again. Block tops are the nodes of the next tier. Above its block a leaf folds through the
block's path: for each level the state after all left siblings, made once, and the right siblings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from varve.session import checkpointed, ship

FAN = 8
BLOCK_LEVELS = 3
BLOCK = FAN**BLOCK_LEVELS
HEX = 64  # characters of a digest

_NODE = "tree string, pos long, digest string"
_PATH = "tree string, pos long, subroot string, root string, path string"


def encoded(value: str | Column) -> Column:
    """UTF-8 byte count, ``:`` and the value as text; ``-`` for null."""
    text = (F.col(value) if isinstance(value, str) else value).cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def record_hash(*values: str | Column) -> Column:
    return F.sha2(F.concat(*[encoded(v) for v in values]), 256)


def levels_above(n: int, most: int = BLOCK_LEVELS) -> int:
    """Foldings until ``n`` nodes are one, ``most`` at most."""
    levels = 0
    while n > 1 and levels < most:
        n, levels = -(-n // FAN), levels + 1
    return levels


class Subtree:
    """Levels over consecutive digests, with the hash state of every parent before each of its child slots."""

    def __init__(self, digests: Sequence[str], levels: int):
        self.level, self.before, now = [], [], list(digests)
        for _ in range(levels):
            self.level.append("".join(now).encode())
            states, parents = [], []
            for i, digest in enumerate(now):
                if i % FAN == 0:
                    if i:
                        parents.append(state.hexdigest())
                    state = hashlib.sha256()
                states.append(state.copy())
                state.update(digest.encode())
            parents.append(state.hexdigest())
            self.before.append(states)
            now = parents
        self.top = now

    def sides(self, level: int, at: int) -> tuple[bytes, bytes]:
        """Digests of the run left and right of node ``at``."""
        text, first = self.level[level], at - at % FAN
        return text[HEX * first : HEX * at], text[HEX * (at + 1) : HEX * (first + FAN)]

    def fold(self, at: int, digest: str) -> str:
        """The top as it were if node ``at`` had this digest."""
        for level, states in enumerate(self.before):
            state = states[at].copy()
            state.update(digest.encode())
            state.update(self.sides(level, at)[1])
            at, digest = at // FAN, state.hexdigest()
        return digest

    def siblings(self, at: int) -> list[tuple[bytes, bytes]]:
        out = []
        for level in range(len(self.level)):
            out.append(self.sides(level, at))
            at //= FAN
        return out


class Path:
    """Siblings of the levels above a block, and for each the hash state after all its left ones."""

    def __init__(self, text: str):
        self.sides = [tuple(level.split("|")) for level in text.split(";")] if text else []
        self.states = [hashlib.sha256(left.encode()) for left, _ in self.sides]
        self.proof = "".join(left + right for left, right in self.sides).encode()

    def fold(self, digest: str) -> str:
        for kept, (_, right) in zip(self.states, self.sides):
            state = kept.copy()
            state.update(digest.encode())
            state.update(right.encode())
            digest = state.hexdigest()
        return digest


def numbered(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Adds ``pos``, 0.. within each ``tree`` in ``order``, and ``n``, the rows of the tree.

    Rows lie in ranges of (tree, order); offsets come from the count of each (tree, range). No tree
    is sorted in one task, and a window sees a row for each range only.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["tree", *order]
    placed = checkpointed(rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_range", F.shiftright("_at", 33))
    runs = placed.groupBy("tree", "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    own = Window.partitionBy("tree")
    before = own.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("tree", "_range", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(own).alias("n"))
    return checkpointed(placed.join(runs, ["tree", "_range"]).withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_shift", "_range"))


def _ordered(group: pa.Table) -> pa.Table:
    return group.sort_by("pos")


def _tops(key, group):
    group = _ordered(group)
    tree = Subtree(group["digest"].to_pylist(), levels_above(group["n"][0].as_py()))
    return pa.table({"tree": [key[0].as_py()], "pos": pa.array([key[1].as_py()], pa.int64()), "digest": tree.top, "n": pa.array([-(-group["n"][0].as_py() // BLOCK)], pa.int64())})


def _blocks(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("pos") / BLOCK))


def climb(nodes: DataFrame) -> list[DataFrame]:
    """Tiers of nodes (tree, pos, digest, n) from the given ones up to one node a tree, each written once."""
    tiers = [nodes]
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        tiers.append(checkpointed(_blocks(tiers[-1].select("tree", "pos", "digest", "n")).groupBy("tree", "block").applyInArrow(_tops, f"{_NODE}, n long")))
        most = -(-most // BLOCK)
    return tiers


def _paths_below(key, group, above):
    group, over = _ordered(group), above.slice(0, 1).to_pylist()[0]
    tree = Subtree(group["digest"].to_pylist(), levels_above(group["n"][0].as_py()))
    upper = [over["path"]] if over["path"] else []
    texts = [";".join([f"{a.decode()}|{b.decode()}" for a, b in tree.siblings(i)] + upper) for i in range(len(group))]
    return pa.table({"tree": group["tree"].cast(pa.string()), "pos": group["pos"], "subroot": pa.array([over["subroot"]] * len(group), pa.string()), "root": pa.array([over["root"]] * len(group), pa.string()), "path": pa.array(texts, pa.string())})


def descend(tiers: list[DataFrame], tops: DataFrame) -> DataFrame:
    """Paths of the blocks of the lowest tier, from paths of the trees' tops (``_PATH`` columns)."""
    paths = tops
    for nodes in reversed(tiers[1:]):
        paths = checkpointed(_blocks(nodes).groupBy("tree", "block").cogroup(paths.withColumnRenamed("pos", "block").groupBy("tree", "block")).applyInArrow(_paths_below, _PATH))
    return paths


def _folded(key, group, above):
    group, over = _ordered(group), above.slice(0, 1).to_pylist()[0]
    digests, path = group["digest"].to_pylist(), Path(over["path"])
    tree = Subtree(digests, levels_above(group["n"][0].as_py()))
    proof, folded = [], []
    for i, (digest, changed) in enumerate(zip(digests, group["changed"].to_pylist())):
        own = hashlib.sha256(b"".join(a + b for a, b in tree.siblings(i)))
        own.update(path.proof)
        proof.append(own.hexdigest())
        folded.append(path.fold(tree.fold(i, digest if changed is None else changed)))
    n = len(group)
    same = np.array([f == over["root"] for f in folded], bool)
    return pa.table({"row": group["row"], "leaf": digests, "subroot": [over["subroot"]] * n, "root": [over["root"]] * n, "proof_sha256": proof, "folded_root": folded, "verified": same})


def manifest(docs: DataFrame, leaf: Column, tree: Column, order: str, changed: Column | None = None) -> DataFrame:
    """A row for each row of ``docs``: struct ``row`` with its ``order`` column, leaf, subroot, root, proof_sha256, folded_root, verified.

    Leaves of equal ``tree`` value ascend by ``order`` (null first; ties by the leaf's digest, and equal
    leaves are interchangeable) and fold by runs of FAN until one node is left, the subroot; subroots in
    bytewise order of their value, null first, fold likewise to the root. ``changed`` is the digest a
    reader computes from the record at hand, null where it is untouched; ``folded_root`` is the root
    from it and the original siblings. No rows give no rows; columns not read may have any names.
    """
    spark = ship(docs.sparkSession)
    key = F.coalesce(F.concat(F.lit("="), tree.cast("string")), F.lit(""))  # "" for null sorts first
    other = F.lit(None).cast("string") if changed is None else changed
    hashed = docs.select(F.struct(F.col(order)).alias("row"), key.alias("tree"), leaf.alias("digest"), other.alias("changed"), F.monotonically_increasing_id().alias("spread"))
    leaves = numbered(checkpointed(hashed).withColumn("order", F.col(f"row.{order}")), ["order", "digest", "spread"]).drop("order", "spread")
    tiers = climb(leaves)
    subroots = tiers[-1].filter("pos = 0").select("tree", "digest")
    forest = numbered(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), ["name"])
    upper = climb(forest)
    root = upper[-1].select("tree", F.lit(0).cast("long").alias("pos"), F.col("digest").alias("subroot"), F.col("digest").alias("root"), F.lit("").alias("path"))
    named = forest.select("tree", "pos", "n", "name", "digest")
    over = descend(upper, root)
    pos = _blocks(named).groupBy("tree", "block").cogroup(over.withColumnRenamed("pos", "block").groupBy("tree", "block")).applyInArrow(_tree_paths, _PATH)
    block_paths = descend(tiers, checkpointed(pos))
    kind = StructType([leaves.schema["row"], *[StructField(c, StringType()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], StructField("verified", BooleanType())])
    return _blocks(leaves).groupBy("tree", "block").cogroup(block_paths.withColumnRenamed("pos", "block").groupBy("tree", "block")).applyInArrow(_folded, kind)


def _tree_paths(key, group, above):
    """Paths of the trees' tops: the subroot of each is its own digest, and its position in its tree 0."""
    group = _ordered(group)
    out = _paths_below(key, group, above)
    return pa.table({"tree": group["name"], "pos": pa.array([0] * len(group), pa.int64()), "subroot": group["digest"], "root": out["root"], "path": out["path"]})
