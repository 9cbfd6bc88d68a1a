"""Session settings and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  driver_memory: str | None = None) -> SparkSession:
    """A session with adaptive execution and a UTC clock.

    ``master`` and the sizes are left alone on a cluster, where ``spark-submit`` sets them.
    """
    b = (
        SparkSession.builder.appName("tickloom")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
    )
    if master:
        b = b.master(master).config("spark.ui.enabled", "false").config(
            "spark.ui.showConsoleProgress", "false")
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if driver_memory:
        b = b.config("spark.driver.memory", driver_memory)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder for checkpoints and intermediate tables, readable by every executor.

    It is the one named in ``spark.checkpoint.dir``. Only a local session without that setting
    gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="tickloom-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def checkpointed(df):
    """``df`` written to the checkpoint folder, so its lineage is cut and survives lost executors."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def written(df, path: str):
    """``df`` written to ``path`` as Parquet and read again, for loops whose rounds join what earlier rounds made.

    A checkpoint keeps the size that the planner had guessed. A join multiplies the guesses of its sides, so in a loop the digits
    of that number double each round until it fills the driver. A table has the size of its files.
    """
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
