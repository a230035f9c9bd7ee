"""Session defaults and the shared scratch area."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SCRATCH_CONF = "spark.checkpoint.dir"

# Folders of local sessions without the setting, by application.
_OWN: dict[str, str] = {}


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-JVM session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("mirrorframe")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def current() -> SparkSession:
    """The session of this thread, or the application's default one (threads of a pool have none active)."""
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one only where none is named and all runs in one process.

    The setting is read, never written: it is fixed when a session starts.
    """
    path = spark.conf.get(SCRATCH_CONF, None)
    if path:
        return path.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(f"{SCRATCH_CONF} must name a folder that the driver and all executors of {master} share")
    key = spark.sparkContext.applicationId
    if key not in _OWN:
        _OWN[key] = "file://" + tempfile.mkdtemp(prefix="mirrorframe-")
    return _OWN[key]


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage of `df` through a parquet table in the shared scratch folder.

    Unlike a cached or locally checkpointed frame the table outlives its executors, and unlike an
    RDD checkpoint it is computed once and keeps column pruning for its readers.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# Below this estimated size a frame may be redistributed to use idle cores.
SPREAD_BYTES = 256 * 1024 * 1024


def spread(df: DataFrame) -> DataFrame:
    """Rows of a small input over all cores before work that is heavy per row.

    A small file is one split and would keep one core busy. Inputs beyond SPREAD_BYTES come in many
    splits already and are left as they are: they are never shuffled for this.
    """
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    if int(size) > SPREAD_BYTES:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def drop_scratch(spark: SparkSession) -> None:
    """Delete what this application materialized (call when its frames are no longer used)."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{scratch_dir(spark)}/{spark.sparkContext.applicationId}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(path, True)
