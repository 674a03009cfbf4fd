"""Sinks that never overwrite."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException
from pyspark.sql.types import StructType

from varve.session import checkpointed


def write_once(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Write a new Parquet table; an existing one is an error."""
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def unregistered(runs: DataFrame, registry: DataFrame) -> DataFrame:
    """Runs whose id is not in the registry yet: completed and failed ids cannot run again."""
    return runs.join(registry.select("run_id"), "run_id", "left_anti")


def _numbered(path: str, number: int) -> str:
    return f"{path}/batch={number:08d}"


def _last_batch(spark: SparkSession, path: str) -> int:
    """The highest number committed under ``path``; 0 for an empty or missing registry."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(where)] if fs.exists(where) else []
    return max([int(n.removeprefix("batch=")) for n in names if n.startswith("batch=")], default=0)


def put_if_absent(spark: SparkSession, staged: str, target: str) -> bool:
    """Move a written folder to ``target`` in one step, or tell that another writer took it.

    The move never replaces a folder: file systems with an atomic rename let one of two writers win.
    Object stores without one need a committer of their own.
    """
    jvm = spark._jvm
    source, goal = jvm.org.apache.hadoop.fs.Path(staged), jvm.org.apache.hadoop.fs.Path(target)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri(), spark._jsc.hadoopConfiguration())
    never = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(source, goal, never)
    except Py4JJavaError:
        fs = goal.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(goal):
            raise
        return False
    return True


def read_runs(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """All committed rows of a registry; batches not yet committed lie in hidden folders. A missing one is empty."""
    try:
        return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def append_runs(spark: SparkSession, runs: DataFrame, path: str) -> int:
    """Append new registry rows and return how many were new; refuse a batch that repeats an id.

    Only a missing path counts as an empty registry. Writers need no lock: a batch takes the number
    after the last one its writer knew, and a writer whose number is gone looks again at what
    is registered by now, so of two that bring one id only the first adds it.
    """
    if not runs.groupBy("run_id").count().filter("count > 1").isEmpty():
        raise ValueError("a batch names a run id twice")
    while True:
        # the number is read before the rows: a batch committed in between is seen, or its number is taken
        number = _last_batch(spark, path) + 1
        # written first, so that what is counted is what is appended
        fresh = checkpointed(unregistered(runs, read_runs(spark, path, runs.schema)))
        n = fresh.count()
        if not n:
            return 0
        staged = f"{path}/_new-{uuid.uuid4().hex}"
        fresh.write.parquet(staged)
        if put_if_absent(spark, staged, _numbered(path, number)):
            return n


def paired_table(components: DataFrame, methods: Sequence[str], values: Sequence[str], id_col: str = "entity_id") -> DataFrame:
    """One wide row per entity: every component of every method side by side."""
    aggs = [F.first(v).alias(v) for v in values]
    return components.groupBy(id_col).pivot("method", list(methods)).agg(*aggs)
