"""Files or rows that arrive in batches, taken in once each, whatever fails in between."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Ledger:
    """A folder of batches: ``batches/<id>`` holds what a batch brought, ``ledger/<id>`` says that it is complete. Readers see complete batches only."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
        for name in ("batches", "ledger"):
            self.fs.mkdirs(self.path(f"{folder}/{name}"))

    def complete(self) -> list[int]:
        return sorted(int(x.getPath().getName()) for x in self.fs.listStatus(self.path(f"{self.folder}/ledger")) if x.getPath().getName().isdigit())

    def rows(self, schema: str) -> DataFrame:
        """All rows of complete batches, with their ``batch``; none of a batch that failed before its entry."""
        paths = [f"{self.folder}/batches/{b}" for b in self.complete()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def enter(self, batch: int) -> None:
        """The entry is a file that appears whole or not at all; one that exists already is left."""
        entry = self.path(f"{self.folder}/ledger/{batch}")
        if not self.fs.exists(entry):
            self.fs.create(entry, True).close()


def taken_in(ledger: Ledger, key: str, prepare: Callable[[DataFrame], DataFrame], schema: str) -> Callable[[DataFrame, int], None]:
    """The body of a ``foreachBatch``: of each batch, the rows whose ``key`` no complete batch has, each key once, as ``prepare`` gives them.

    A batch is written over what an earlier try at it left, then entered. One that is in the ledger already adds nothing, so a batch that runs again
    after any failure, also between the write and the entry, gives the same rows once. Rows without a key are left out. The known keys meet a batch in
    a join; nothing is collected.
    """

    def take(rows: DataFrame, batch: int) -> None:
        if batch in ledger.complete():
            return
        fresh = rows.filter(rows[key].isNotNull()).dropDuplicates([key])
        known = ledger.rows(schema).select(key)
        prepare(fresh.join(known, key, "left_anti")).write.mode("overwrite").parquet(f"{ledger.folder}/batches/{batch}")
        ledger.enter(batch)

    return take
