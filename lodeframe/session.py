"""Session defaults for local runs and tests; a cluster's own session is used as it is."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("lodeframe")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("LODEFRAME_DRIVER_MEMORY", memory))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


BATCH_ROWS, BATCH_BYTES = 512, 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_ROWS rows and about BATCH_BYTES: texts are long, and a batch is held whole by JVM and Python.

    Plans read the settings when they run, so they stay for the session; no result depends on them.
    """
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(rows)) > BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    set_to = spark.conf.get(size, None)
    if set_to is not None and not 0 < int(set_to.rstrip("b")) <= BATCH_BYTES:
        spark.conf.set(size, f"{BATCH_BYTES}b")


def table(spark: SparkSession, sf_dir: str, name: str):
    """One Parquet table of a data folder; column pruning and pushdown are Catalyst's."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df):
    """df over all cores, where it comes in fewer parts, as a small file does; for work that is heavy for each row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def dealt(df, *keys: str, rows: int):
    """df by hash of keys in parts of about so many rows, and over all cores at least; what is grouped by more than these keys afterwards needs no other shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-df.count() // rows)), *keys)


SMALL = 100_000  # rows of a table that every task may get whole


def counted(df):
    """df, to be copied to every task if it is counted to be small; a plain table otherwise."""
    return F.broadcast(df) if df.count() <= SMALL else df


def kept(df, name: str):
    """df, computed once and written compressed below the cluster's checkpoint folder, for what several steps read; forget() removes it, else it stays."""
    folder = shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def forget(df) -> None:
    """Removes the files that kept() wrote, once nothing reads them any more."""
    spark = df.sparkSession
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for written tables below the cluster's checkpoint folder; only a local session without one gets it from this machine."""
    context = spark.sparkContext
    root = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.gettempdir()
    return f"{root}/lodeframe-{name}-{uuid.uuid4().hex}"
