"""Session helpers shared by every operator."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(name: str = "walkframe", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point checkpoints at the cluster's shared folder (``spark.checkpoint.dir``).

    Only a local master may fall back to a temporary folder: elsewhere a folder
    of one machine is invisible to the other executors, so that is an error.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="walkframe-checkpoint-")
    sc.setCheckpointDir(configured)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the checkpoint folder and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession, kind: str = "table") -> str:
    """A new place in the checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{kind}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as a compressed table to the checkpoint folder and read it again."""
    spark = df.sparkSession
    path = shared_path(spark)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._stored_at = path
    return table


def discard(table: DataFrame) -> None:
    """Delete a table that ``stored`` wrote; for tables whose every reader has been written itself."""
    path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._stored_at)
    path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let shuffle files of finished queries go.

    Spark drops them in the background once the driver's garbage collector has seen
    that nothing refers to their stages; references that Python held go in a second turn.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(1)
