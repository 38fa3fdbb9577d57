"""Session builder and the one place where lineage is cut."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Settings every session of this library wants; a cluster's own values win where they are set.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def build_session(app: str = "quaver", master: str | None = None, **conf: str) -> SparkSession:
    """A session with this library's defaults; ``conf`` uses ``__`` for dots (``spark__ui__enabled="false"``)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def durable(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder, so that a lost executor loses nothing.

    The folder is the one that :func:`shared_folder` gives.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is never broadcast, whatever the planner takes its size for.

    Sizes are guessed from files and from what was shuffled; the rows that ``explode`` adds to them are left out. A side
    that grows with the tables would pass through the driver's memory as a whole.
    """
    return df.hint("merge")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines share, as ``spark.checkpoint.dir`` names it.

    Only where that is unset and all runs in one process, as in tests, a temporary folder of this machine is used;
    a cluster without the setting is an error.
    """
    sc = spark.sparkContext
    named = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), f"quaver-checkpoints-{os.getuid()}")


def shuffle_width(spark: SparkSession) -> int:
    """The session's number of shuffle partitions; salts follow it, so that they grow with the cluster."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def wide_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table for work that is heavy in each row: spread over all cores where its files are fewer than these.

    A large table has more files than cores and is read as it is, without a shuffle.
    """
    df, cores = table(spark, folder, name), spark.sparkContext.defaultParallelism
    return df.repartition(3 * cores) if df.rdd.getNumPartitions() < 2 * cores else df
