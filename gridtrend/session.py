"""Session settings and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", memory: str = "20g") -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own."""
    cores = str(cpus)
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("gridtrend")
        .config("spark.sql.shuffle.partitions", "8" if cores == "*" else cores)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names; make one only for a local master."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        context.setCheckpointDir(shared)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="gridtrend-ckpt-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a shared folder")


def scratch_path(spark: SparkSession) -> str:
    """A new path in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/gridtrend-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the checkpoint folder and read it back.

    Used where a frame is scanned several times (model iterations, group
    statistics) or a value has to stay the same for every later reader. A
    written table survives lost executors, carries its real size for the
    planner, and, unlike a checkpointed plan, hands no constraints of its
    origin on to the next iteration.
    """
    path = scratch_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_ordered(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: keeps the partitions and the order of their rows."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
