"""Session construction, the shared folder, and tables that cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a row group of a settled table; rows can be megabytes, and a reader holds a row group.
ROW_GROUP = 16 << 20
#: Drops a write's shuffle files when it ends: what it wrote is read instead.
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "quarryline", cpus: int | None = None, memory: str = "8g", partitions: int | None = None) -> SparkSession:
    """A session with adaptive execution and a UTC clock. On a cluster the master and memory come from spark-submit."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if cpus:
        builder = builder.master(f"local[{cpus}]").config("spark.driver.memory", memory)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: spark.checkpoint.dir, or one of our own where that is unset (tests, one machine)."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if there:
        return there
    if spark.sparkContext.getCheckpointDir() is None:
        own = os.path.join(tempfile.gettempdir(), "quarryline-checkpoints")
        spark.sparkContext.setCheckpointDir("file://" + own)
    return spark.sparkContext.getCheckpointDir()


def settle(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write df to the shared folder and continue from there, so a lost executor costs no recomputation of what came before.

    `by` names a column that parts the table into folders, so one part can be
    deleted before the others. forget() deletes the table once nothing that is
    still to run reads it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/settled_{uuid.uuid4().hex}"
    before = spark.conf.get(_TIDY, None)
    spark.conf.set(_TIDY, "true")
    try:
        writer = df.write.option("parquet.block.size", ROW_GROUP)
        (writer.partitionBy(by) if by else writer).parquet(path)
    finally:
        spark.conf.unset(_TIDY) if before is None else spark.conf.set(_TIDY, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def forget(*tables: DataFrame | None) -> None:
    """Delete settled tables. Others, and None, are passed over."""
    for df in tables:
        if path := getattr(df, "settled_at", None):
            delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system, if it is there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path of the shared file system is there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
