"""Session settings and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# SQL settings every operator relies on; all can change at run time.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even where that costs one more shuffle further up.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Rows may hold whole texts, and a Python worker has a batch of them in memory.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings the operators rely on to an existing session."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(
    cores: int | str = "*", *, app: str = "tallygrain", memory: str = "8g", shuffle_partitions: int = 8
) -> SparkSession:
    """A single-JVM session for tests and the bench."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.compress", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder, taken from ``spark.checkpoint.dir`` when the cluster names one.

    Only a local master may fall back to a temporary folder: on a cluster it would not be shared.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("Set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="tallygrain-checkpoint-")
    context.setCheckpointDir(named)
    return named


def release(spark: SparkSession) -> None:
    """Have the driver collect its garbage, so that it returns the heap that many small jobs made it take."""
    spark.sparkContext._jvm.System.gc()


def materialize(frame: DataFrame) -> DataFrame:
    """Cut lineage through the shared checkpoint folder, so that lost executors cost no recomputation."""
    ensure_checkpoint_dir(frame.sparkSession)
    return frame.checkpoint(eager=True)


def stored(frame: DataFrame) -> DataFrame:
    """Write a frame to the shared checkpoint folder once, so that each later scan reads only the columns it names.

    Cells that parquet has no type for are kept by ``materialize``, as rows.
    """
    if "void" in frame.schema.simpleString():
        return materialize(frame)
    path = f"{ensure_checkpoint_dir(frame.sparkSession)}/stored-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)
