"""Scratch tables in the folder that the cluster shares.

Intermediate tables are written as Parquet under ``spark.checkpoint.dir``: every executor
sees them, so a lost executor costs a re-read and not a recomputation of its lineage.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where it is unset, a local session gets a folder of its own."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="quillspark-")
        spark.sparkContext.setCheckpointDir(_OWN[app])
    return _OWN[app]


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/quillspark/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the application's folder of the shared one."""
    return f"{_folder(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str, block_bytes: int | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of it.

    ``block_bytes`` is the size of a row group, for tables of few large rows: a scan holds one of them at a time.
    """
    path = scratch_path(df.sparkSession, label)
    (df.write.option("parquet.block.size", block_bytes) if block_bytes else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a scratch path through Hadoop's file system (any store)."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def discard_all(spark: SparkSession) -> None:
    """Delete the application's scratch tables; results that were not read yet are lost."""
    discard(spark, _folder(spark))
