"""Checkpoints of a pipeline's state: versions of Parquet, of which the newest complete one counts."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), lambda name: spark._jvm.org.apache.hadoop.fs.Path(folder, name)


def _versions(spark: SparkSession, folder: str) -> list[str]:
    """The complete versions of a state, oldest first."""
    fs, path = _fs(spark, folder)
    if not fs.exists(path(".")):
        return []
    names = sorted(s.getPath().getName() for s in fs.listStatus(path(".")) if s.getPath().getName().startswith("state-"))
    return [n for n in names if fs.exists(path(f"{n}/_SUCCESS"))]


def _claimed(spark: SparkSession, folder: str, number: int) -> int:
    """The first number from ``number`` on that no other writer has taken: a claim is a file that only one of them can create."""
    fs, path = _fs(spark, folder)
    while True:
        try:
            fs.create(path(f"claim-{number:012d}"), False).close()
            return number
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in e.java_exception.getClass().getName() and not fs.exists(path(f"claim-{number:012d}")):
                raise
            number += 1


def save_state(rows: DataFrame, folder: str, pack: str) -> None:
    """Write the state of ``pack`` as a version of its own beside the ones before; readers take the newest complete version.

    A version is complete once its job has committed, so a crash at any time leaves the version before. Older versions than the previous one are then
    deleted; a reader that has just listed them may still read the previous one.
    """
    spark = rows.sparkSession
    old = _versions(spark, folder)
    number = _claimed(spark, folder, int(old[-1].split("-")[1]) + 1 if old else 1)
    rows.withColumn("pack", F.lit(pack)).write.parquet(f"{folder}/state-{number:012d}-{uuid.uuid4().hex}")
    fs, path = _fs(spark, folder)
    for claim in range(max(1, number - 100), number - 1):
        fs.delete(path(f"claim-{claim:012d}"), False)  # claims below a complete version are of no use
    for name in old[:-1]:
        if not fs.delete(path(name), True):
            raise OSError(f"could not delete {folder}/{name}")


def load_state(spark: SparkSession, folder: str, pack: str) -> DataFrame | None:
    """The saved state, or None where there is none; that of another pack is an error."""
    versions = _versions(spark, folder)
    if not versions:
        return None
    rows = spark.read.parquet(f"{folder}/{versions[-1]}")
    other = rows.filter(F.col("pack") != pack).select("pack").first()
    if other:
        raise ValueError(f"{folder} holds the state of {other[0]!r}, not of {pack!r}")
    return rows.drop("pack")


def pending(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The rows whose key isn't among the ``done`` ones."""
    return rows.join(done.select(key), key, "left_anti")
