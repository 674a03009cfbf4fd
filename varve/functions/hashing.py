"""Hash-derived integers as Column expressions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A SHA-256 digest is 64 hex digits: eight 32-bit chunks.
CHUNKS = 8
CHUNK_BASE = 1 << 32
MAX_MODULUS = 1 << 31


def digest(*parts: Column | str) -> Column:
    """SHA-256 hex of the parts joined by ``|``; plain strings are literals."""
    cols = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    return F.sha2(F.concat_ws("|", *cols), 256)


def hex_chunk(hex_digest: Column, index: int) -> Column:
    """The ``index``-th 32-bit chunk (from 0, most significant first) of a hex digest."""
    return F.conv(F.substring(hex_digest, 8 * index + 1, 8), 16, 10).cast("long")


def digest_mod(hex_digest: Column, modulus: int | Column) -> Column:
    """The 256-bit integer spelled by ``hex_digest``, modulo ``modulus`` (below 2**31).

    Horner over 32-bit chunks keeps every intermediate inside a signed 64-bit integer.
    """
    if isinstance(modulus, int):
        if not 0 < modulus < MAX_MODULUS:
            raise ValueError("modulus must lie in 1 .. 2**31 - 1")
        modulus = F.lit(modulus)
    m = modulus.cast("long")
    acc = F.lit(0).cast("long")
    for i in range(CHUNKS):
        acc = (acc * F.lit(CHUNK_BASE) + hex_chunk(hex_digest, i)) % m
    return acc


def hash_mod(seed: str, tag: Column | str, ident: Column, modulus: int | Column) -> Column:
    """SHA-256 of ``seed|tag|ident`` as an integer modulo ``modulus``."""
    return digest_mod(digest(seed, tag, ident), modulus)


def replicate_picks(slots: DataFrame, replicates: int, seed: str, by: str, size: str, by_first: bool) -> DataFrame:
    """(by, slot, replicate, _pick): 1 + the digest of (replicate, by, slot), or of (by, replicate, slot), modulo ``size``.

    The value of ``digest_mod`` at a tenth of its cost, since a digest need not be spelled and read again. Slots
    are spread over all tasks first, as each becomes a row per replicate. Spark's size estimate does not see
    that growth: give the other side of a join a hint.
    """
    tasks = int(slots.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = pa.schema([(by, pa.string()), ("slot", pa.int64()), ("replicate", pa.int32()), ("_pick", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha, number = hashlib.sha256, int.from_bytes
        for batch in batches:
            for row in batch.to_pylist():
                group, slot, n = row[by], row["slot"], row[size]
                head, tail = (f"{seed}|{group}|", f"|{slot}") if by_first else (f"{seed}|", f"|{group}|{slot}")
                picks = [1 + number(sha(f"{head}{r}{tail}".encode()).digest(), "big") % n for r in range(1, replicates + 1)]
                yield pa.record_batch([pa.repeat(group, replicates), pa.repeat(slot, replicates).cast(pa.int64()), pa.array(range(1, replicates + 1), pa.int32()), pa.array(picks, pa.int64())], schema=schema)

    spread = slots.select(F.col(by).cast("string").alias(by), F.col("slot").cast("long").alias("slot"), size).repartition(tasks, by, "slot")
    return spread.mapInArrow(work, f"{by} string, slot long, replicate int, _pick long")
