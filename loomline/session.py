"""Sessions, and cutting lineage in the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session for tests, benchmarks and the command line; on a cluster, pass its own session instead."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("loomline")
    defaults = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("LOOMLINE_DRIVER_MEMORY", "6g"),
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the session's ``spark.checkpoint.dir``.

    Only where that is unset and the master is a single local JVM (tests) a temporary folder stands in.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="loomline-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete files or folders, wherever Spark reaches them."""
    for path in paths:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and keep it in the shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_dealt(df: DataFrame, parts: int, *keys: str, order: tuple[str, ...] = ()) -> DataFrame:
    """``cut``, dealt by ``keys`` to ``parts`` partitions or more, each sorted by ``order``.

    The plan of what is kept knows this, so joins, groups and windows by the keys leave it where it is.  That holds for
    plans made without adaptive execution only, and for as many partitions as a shuffle has by default at least; so
    ``df`` should be a cut table, or rows straight from a scan.
    """
    spark = df.sparkSession
    shared_folder(spark)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        dealt = df.repartition(max(parts, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)
        return (dealt.sortWithinPartitions(*order) if order else dealt).checkpoint(eager=True)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
