"""Reading named tables and keeping intermediate ones."""

from __future__ import annotations

import atexit
import gc
import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The parquet table ``name`` (a file or a directory of parts) of ``directory``."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Where the setting is absent, a local master gets a folder of its own (tests, one machine);
    on a cluster that is an error, since a machine-local folder would be lost with its machine.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = kept.get() if kept.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"/tmp/lexiloom-{os.getuid()}-{os.getpid()}"
        os.makedirs(found, exist_ok=True)
    return found.rstrip("/")


def kept(df: DataFrame, label: str = "step") -> DataFrame:
    """``df`` written to the shared folder and read again.

    Cuts the lineage: what is read survives the loss of executors and isn't computed twice.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if not _WRITTEN:
        atexit.register(drop_kept)
    _WRITTEN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def let_go(spark: SparkSession) -> None:
    """Has the driver collect its garbage, upon which Spark deletes the shuffle files of jobs that nobody can read any more; else they stay on disk until it happens to."""
    gc.collect()
    spark._jvm.System.gc()


_WRITTEN: list[tuple[SparkSession, str]] = []


def kept_so_far() -> int:
    """A mark for ``drop_kept``."""
    return len(_WRITTEN)


def drop_kept(since: int = 0) -> None:
    """Deletes what ``kept`` wrote after the mark ``since``, all of it when the driver ends.

    Long sessions call it when the results that were made of these tables have been written; frames made of them can't be read any more.
    """
    while len(_WRITTEN) > since:
        spark, path = _WRITTEN.pop()
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # noqa: BLE001 - the session may be gone already
            pass
