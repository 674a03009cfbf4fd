"""Strict readers: the schema is given, bad input becomes a reject row with its reason."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varve.functions.numeric import is_finite

MANIFEST_SCHEMA = T.StructType([
    T.StructField("dataset", T.StringType()),
    T.StructField("entity_id", T.LongType()),
    T.StructField("role", T.StringType()),
    T.StructField("proposed_cutoff", T.IntegerType()),
    T.StructField("eligible_alive", T.BooleanType()),
])
PREDICTION_SCHEMA = T.StructType([
    T.StructField("entity_id", T.LongType()),
    T.StructField("cutoff", T.IntegerType()),
    T.StructField("lower", T.DoubleType()),
    T.StructField("median", T.DoubleType()),
    T.StructField("upper", T.DoubleType()),
])
DRAW_KEYS = ["fit", "chain", "draw"]


def parse_trajectories(lines: DataFrame, channels: Sequence[str], value: str = "value") -> DataFrame:
    """Parse whitespace-separated rows (id, cycle, channels); ``reject`` names the first broken rule.

    Blank lines vanish. A good row has exactly the expected fields, all finite, with an integral
    id and an integral cycle of at least 1.
    """
    width = 2 + len(channels)
    text = F.trim(F.regexp_replace(F.col(value), r"\s+", " "))
    rows = lines.select(text.alias("_t")).filter(F.length("_t") > 0).select(F.split("_t", " ").alias("_f"))
    numbers = F.transform("_f", lambda v: v.try_cast("double"))
    rows = rows.withColumn("_v", numbers)
    broken = F.exists("_v", lambda v: ~is_finite(v))
    ident, cycle = F.get("_v", F.lit(0)), F.get("_v", F.lit(1))
    reject = (
        F.when(F.size("_f") != width, "field_count")
        .when(broken, "non_finite")
        .when((ident != F.floor(ident)) | (cycle != F.floor(cycle)) | (cycle < 1), "not_integral")
    )
    good = lambda c: F.when(reject.isNull(), c)
    cols = [good(ident.cast("long")).alias("entity_id"), good(cycle.cast("int")).alias("cycle")]
    cols += [good(F.get("_v", F.lit(i + 2))).alias(c) for i, c in enumerate(channels)]
    return rows.select(*cols, reject.alias("reject"))


def read_trajectories(spark: SparkSession, path: str, channels: Sequence[str]) -> DataFrame:
    return parse_trajectories(spark.read.text(path), channels)


def check_manifest(manifest: DataFrame, dataset: str) -> DataFrame:
    """Flag rows of another data set and repeated ids."""
    repeated = manifest.groupBy("entity_id").agg((F.count(F.lit(1)) > 1).alias("_twice"))
    j = manifest.join(repeated, "entity_id", "left")
    reject = F.when(~F.col("dataset").eqNullSafe(F.lit(dataset)), "wrong_dataset").when(F.col("_twice"), "duplicate_id").when(F.col("entity_id").isNull(), "missing_id")
    return j.withColumn("reject", reject).drop("_twice")


def read_manifest(spark: SparkSession, path: str, dataset: str, multi_line: bool = False) -> DataFrame:
    return check_manifest(spark.read.schema(MANIFEST_SCHEMA).json(path, multiLine=multi_line, mode="FAILFAST"), dataset)


def cohort_cover(rows: DataFrame, cohort: DataFrame, id_col: str = "entity_id") -> DataFrame:
    """Counts that must all be zero for a complete table: missing, unknown and repeated ids."""
    have = rows.groupBy(id_col).agg(F.count(F.lit(1)).alias("_n"))
    want = cohort.select(id_col).distinct().withColumn("_want", F.lit(True))
    j = have.join(want, id_col, "full_outer")
    return j.agg(
        F.count_if(F.col("_n").isNull()).alias("n_missing"),
        F.count_if(F.col("_want").isNull()).alias("n_unknown"),
        F.count_if(F.col("_n") > 1).alias("n_repeated"),
        F.count_if(F.col("_n").isNotNull() & F.col("_want").isNotNull()).alias("n_matched"),
    )


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """CSV with exactly the expected header; a different header is an error."""
    return spark.read.csv(path, schema=PREDICTION_SCHEMA, header=True, enforceSchema=False, mode="FAILFAST")


def label_rejects(labels: DataFrame, y: str = "y") -> Column:
    value = F.col(y)
    return F.when(~is_finite(value), "non_finite").when(value <= 0, "not_positive")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.csv(path, schema="entity_id long, y double", header=True, enforceSchema=False, mode="FAILFAST")
    return raw.withColumn("reject", label_rejects(raw))


def label_completeness(labels: DataFrame, cohort: DataFrame, id_col: str = "entity_id") -> DataFrame:
    """One row: cohort members without a label, labels of strangers, repeated and rejected labels, and whether all are none."""
    per = labels.groupBy(id_col).agg(F.count(F.lit(1)).alias("_n"), F.count_if(label_rejects(labels).isNotNull()).alias("_bad"), F.lit(True).alias("_l"))
    known = cohort.select(id_col).distinct().withColumn("_c", F.lit(True))
    out = per.join(known, id_col, "full_outer").agg(
        F.count_if(F.col("_l").isNull()).alias("n_missing"), F.count_if(F.col("_c").isNull()).alias("n_unknown"),
        F.count_if(F.col("_n") > 1).alias("n_repeated"), F.coalesce(F.sum("_bad"), F.lit(0)).alias("n_rejected"),
    )
    return out.withColumn("complete", F.col("n_missing") + F.col("n_unknown") + F.col("n_repeated") + F.col("n_rejected") == 0)


def read_draws(spark: SparkSession, path: str, required: Sequence[str]) -> DataFrame:
    """Parquet draw table; the axes and every required parameter must be present."""
    df = spark.read.parquet(path)
    missing = [c for c in [*DRAW_KEYS, *required] if c not in df.columns]
    if missing:
        raise ValueError(f"draw table lacks {missing}")
    return df.select(*DRAW_KEYS, *required)


def draw_grid(draws: DataFrame) -> DataFrame:
    """Shape of each chain: draws held, and whether they are numbered 0..n-1 without repeats."""
    per = draws.groupBy("fit", "chain", "draw").agg(F.count(F.lit(1)).alias("_n"))
    g = per.groupBy("fit", "chain").agg(F.sum("_n").alias("n_draws"), F.min("draw").alias("_lo"), F.max("draw").alias("_hi"), F.count(F.lit(1)).alias("_d"))
    dense = (F.col("_lo") == 0) & (F.col("_hi") == F.col("_d") - 1) & (F.col("_d") == F.col("n_draws"))
    return g.select("fit", "chain", "n_draws", dense.alias("dense"))


def file_inventory(spark: SparkSession, folder: str, chunk: int = 8 << 20, tasks: int | None = None) -> DataFrame:
    """Path, size and SHA-256 of every file under ``folder``, empty ones included.

    Spark lists the names; contents are streamed in fixed-size chunks inside the tasks, so a file may
    be larger than a task's memory. (A plain binaryFile scan would load each file whole and skip
    empty ones.)
    """
    names = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).inputFiles()
    listing = spark.createDataFrame([(n,) for n in names], "path string").repartition(tasks or spark.sparkContext.defaultParallelism, "path")

    def hash_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for pdf in batches:
            sizes, digests = [], []
            for path in pdf["path"]:
                # Hadoop may spell local files file:/x, Arrow file:///x
                uri = path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path
                filesystem, inner = fs.FileSystem.from_uri(uri)
                h, n = hashlib.sha256(), 0
                with filesystem.open_input_stream(inner) as stream:
                    while block := stream.read(chunk):
                        h.update(block)
                        n += len(block)
                sizes.append(n)
                digests.append(h.hexdigest())
            yield pdf.assign(bytes=sizes, sha256=digests)

    return listing.mapInPandas(hash_files, "path string, bytes long, sha256 string")


def inventory_mismatches(inventory: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files listed but absent, present but unlisted, or changed in size or hash."""
    l = inventory.select("path", F.col("bytes").alias("_b"), F.col("sha256").alias("_h"))
    r = manifest.select("path", "bytes", "sha256", F.lit(True).alias("_listed"))
    j = l.join(r, "path", "full_outer")
    reason = (
        F.when(F.col("_h").isNull(), "missing").when(F.col("_listed").isNull(), "extra")
        .when((F.col("_h") != F.col("sha256")) | (F.col("_b") != F.col("bytes")), "changed")
    )
    return j.select("path", reason.alias("reason")).filter("reason is not null")
