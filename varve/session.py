"""Session settings and the reliable checkpoint used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def local_session(app: str = "varve", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and the bench; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``; a temporary one only in local mode."""
    sc = spark.sparkContext
    known = sc.getCheckpointDir()
    if known is not None:
        return known
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and continue from the written table.

    Unlike ``DataFrame.checkpoint`` this computes the plan a single time, and the files' size lets
    the optimizer choose the join. A lost executor only means reading the files again.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed_count(df: DataFrame, condition: Column) -> tuple[DataFrame, int]:
    """Checkpoint ``df`` and count the rows meeting ``condition`` in the same job."""
    seen = Observation()
    written = checkpointed(df.observe(seen, F.count_if(condition).alias("n")))
    return written, seen.get["n"]


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers once per application, so that functions pickled by
    name are found there even where the repository lies on the driver's path alone."""
    sc = spark.sparkContext
    if getattr(sc, "_varve_shipped", False):
        return spark
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="spark-")) / "varve_workers.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent).as_posix())
    sc.addPyFile(str(archive))
    sc._varve_shipped = True
    return spark
