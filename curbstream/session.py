"""Session helpers: a local session for tests and benchmarks, and staged tables."""
from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", shuffle: int = 8, memory: str = "16g") -> SparkSession:
    """A single-JVM session for tests and benchmarks. On a cluster, pass your own session instead."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("curbstream")
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def staging_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a scratch folder only for a local master where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local"):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


#: Rows of staged tables take about this many times more memory than their compressed files.
UNPACKED = "10.0"


def stage(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` as a parquet table in the shared folder and read it back.

    Cuts the lineage so that lost executors re-read files instead of recomputing, gives later
    readers column pruning, and gives the planner file sizes, so it broadcasts a side only when
    that side is known to be under ``spark.sql.autoBroadcastJoinThreshold``. Files are far smaller than the rows
    in memory, so the session's factor between them is raised, unless the user has set it. A boolean column ``by``
    puts its rows into folders of their own, so that a filter on it reads only those.
    """
    spark = df.sparkSession
    if float(spark.conf.get("spark.sql.sources.fileCompressionFactor", "1.0")) == 1.0:
        spark.conf.set("spark.sql.sources.fileCompressionFactor", UNPACKED)
    path = os.path.join(staging_root(spark), "curbstream", f"{name}-{uuid.uuid4().hex}")
    if by is None:
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    # Both files of a task stay open; otherwise its rows would be sorted, and spilled, first.
    writers = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(writers)
    spark.conf.set(writers, "2")
    try:
        df.write.partitionBy(by).parquet(path)
    finally:
        spark.conf.set(writers, before)
    return spark.read.schema(df.schema).parquet(path)
