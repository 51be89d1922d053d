"""Tables written once and read again, in the folder that all executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

_left: list[tuple] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; only where it is unset and the master is local (tests) a temporary folder is set.

    On a cluster without the setting this fails: a folder of one machine would lose what other executors write.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sparkloom-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it again: it cuts the lineage, survives lost executors
    and lets later readers prune columns. The folder goes when the driver ends, or earlier by ``drop``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sparkloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _left.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def hold(df: DataFrame) -> DataFrame:
    """``df`` kept on the executors' disks for several readers in one run: no files in the shared folder, and what a lost executor held is
    computed again from its sources. ``release`` it once nothing reads it."""
    return df.persist(StorageLevel.DISK_ONLY)


def release(*frames: DataFrame) -> None:
    for df in frames:
        df.unpersist()


def drop(*frames: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for df in frames:
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    if sc._jsc is None:
        return
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _sweep() -> None:
    for spark, path in _left:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone
            return
