"""Runs a stream over what its source holds now, at once or delivery by delivery, and reads the result as a table."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

#: What streams are started with: list and map state, timers and TTL need RocksDB, which writes only what a micro-batch has changed.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
PARTITIONS = "spark.sql.shuffle.partitions"


@contextmanager
def rocks_state(spark: SparkSession) -> Iterator[None]:
    """Streams started meanwhile keep their state in RocksDB, in at most as many parts as there are cores, as each part is committed after every
    micro-batch, however small; the session's own choices come back after.
    """
    parts = max(1, min(int(spark.conf.get(PARTITIONS)), spark.sparkContext.defaultParallelism))
    wanted = STATE | {PARTITIONS: str(parts)}
    own = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in own.items():
            spark.conf.set(name, value) if value else spark.conf.unset(name)


def shared_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, or a temporary one where the master is local and it isn't set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="sparkloom-")
    return f"{found}/streams/{uuid.uuid4().hex}"


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a data folder, one file or a folder of them, as a stream."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    reader = spark.readStream.schema(spark.read.parquet(f"{folder}/{name}.parquet").schema)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return reader.parquet(f"{folder}/{name}.parquet")
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)  # file streams read folders


def drained(stream: DataFrame) -> DataFrame:
    """All rows that ``stream`` appends for what its source holds now, written as Parquet with a checkpoint beside it."""
    spark = stream.sparkSession
    folder = shared_folder(spark)
    sink = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/rows")
    with rocks_state(spark):
        query = sink.outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def _dealt(rows: DataFrame, by: str, folder: str, start: Callable[[DataFrame], StreamingQuery]) -> None:
    """Runs the query that ``start`` makes of the stream of ``rows``, a micro-batch for each value of ``by``, in order."""
    spark = rows.sparkSession
    rows.write.partitionBy(by).parquet(f"{folder}/staged")
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    found = [x.getPath() for x in fs.listStatus(hadoop.Path(f"{folder}/staged")) if x.isDirectory()]
    for name in ("source", "rows"):  # without deliveries both stay empty
        fs.mkdirs(hadoop.Path(f"{folder}/{name}"))
    with rocks_state(spark):
        query = start(spark.readStream.schema(rows.drop(by).schema).parquet(f"{folder}/source/*"))
    try:
        for path in sorted(found, key=lambda p: int(p.getName().split("=")[1])):
            fs.rename(path, hadoop.Path(f"{folder}/source/{path.getName().split('=')[1]}"))  # a name without "=" isn't a column
            query.processAllAvailable()
    finally:
        query.stop()


def delivered(rows: DataFrame, by: str, through: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What the stream ``through`` appends if ``rows`` come in deliveries, one micro-batch for each value of ``by`` (a small number of whole numbers),
    in order.

    The rows are written once, a folder for each delivery, and moved one by one to where one running stream finds them, so its state goes from batch
    to batch. Nothing but folder names comes to the driver.
    """
    folder, shapes = shared_folder(rows.sparkSession), []

    def start(stream: DataFrame) -> StreamingQuery:
        out = through(stream)
        shapes.append(out.schema)
        return out.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/rows").outputMode("append").start()

    _dealt(rows, by, folder, start)
    return rows.sparkSession.read.schema(shapes[0]).parquet(f"{folder}/rows")


def delivered_to(rows: DataFrame, by: str, take: Callable[[DataFrame, int], None]) -> None:
    """The same deliveries, each given to ``take`` as a batch (``foreachBatch``)."""
    folder = shared_folder(rows.sparkSession)
    _dealt(rows, by, folder, lambda stream: stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{folder}/checkpoint").start())
