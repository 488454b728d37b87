"""Start a stream over what is available, land its rows in files, and read the newest row per key."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint_root
from ..sources.adapters import table

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared folder for checkpoints."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def table_stream(spark: SparkSession, folder: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """A table's files as a stream; the schema comes from the files' footers, not from the data."""
    path = f"{folder}/{name}.parquet"
    reader = spark.readStream.schema(table(spark, folder, name).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path + "*")


def with_end(stream: DataFrame, time: str, name: str = "end") -> tuple[DataFrame, Callable[[], None]]:
    """The stream, to be used before its watermark is set, and the ``finish`` of :func:`run_available` that ends it.

    ``finish`` adds one row that is empty but for a time far ahead, so the watermark passes everything that is still open.
    """
    spark, folder = stream.sparkSession, scratch_folder(stream.sparkSession, name)
    empty = spark.createDataFrame([], stream.schema)
    empty.write.parquet(folder)

    def finish() -> None:
        far = F.lit("9000-01-01").cast(stream.schema[time].dataType).alias(time)
        spark.range(1).select(*[far if f.name == time else F.lit(None).cast(f.dataType).alias(f.name) for f in stream.schema]).write.mode(
            "append").parquet(folder)

    return stream.unionByName(spark.readStream.schema(stream.schema).parquet(folder)), finish


def run_available(stream: DataFrame, mode: str, keys: Sequence[str] = (), name: str = "stream",
                  finish: Callable[[], None] | None = None, rocksdb: bool = False,
                  progress: list | None = None) -> DataFrame:
    """Process all available input. Every micro-batch is written as files; with ``keys`` the newest row of each
    key is returned (update mode), else all rows (append mode). ``finish`` is called when the input has been read; the
    stream then goes on from its checkpoint with whatever ``finish`` added. ``rocksdb`` runs this stream, and no other, with
    the state store that map states and timers need. ``progress`` receives what the stream reported of its micro-batches."""
    spark = stream.sparkSession
    out, ckpt = scratch_folder(spark, name), scratch_folder(spark, f"{name}-checkpoint")

    def land(batch: DataFrame, batch_id: int) -> None:
        # the batch id is part of the path, so a repeated batch replaces itself
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    def run() -> None:
        before = spark.conf.get(PROVIDER)
        if rocksdb:  # a stream copies the settings when it starts
            spark.conf.set(PROVIDER, ROCKSDB)
        try:
            started = stream.writeStream.foreachBatch(land).outputMode(mode).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
        finally:
            spark.conf.set(PROVIDER, before)
        started.awaitTermination()
        if progress is not None:
            progress.extend(started.recentProgress)

    run()
    if finish:
        finish()
        run()
    rows = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])).parquet(out)
    if keys:
        newest = Window.partitionBy(*keys).orderBy(F.col("batch").desc())
        rows = rows.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")
    return rows.drop("batch")
