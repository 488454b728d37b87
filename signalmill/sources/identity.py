"""Content identity, work keys and incremental processing."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def fingerprint_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Size and SHA-256 of every file below ``path``."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return f.select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))


def fingerprint(content: Column) -> tuple[Column, Column]:
    return F.octet_length(content).cast("bigint"), F.sha2(content.cast("binary"), 256)


def work_key(schema_version: Column, source_hash: Column, model: Column, version: Column, model_hash: Column, flags: Column,
             parts: Column) -> Column:
    """Identity of a unit of work: equal for equal inputs whatever the order or repetition of ``parts``."""
    names = F.array_join(F.array_sort(F.array_distinct(parts)), ";")
    return F.sha2(F.concat_ws(";", schema_version.cast("string"), source_hash, model, version, model_hash, flags, names), 256)


def split_completed(work: DataFrame, done: DataFrame, key: str = "work_key") -> tuple[DataFrame, DataFrame]:
    """(still to do, already complete) by key; incomplete entries of ``done`` are ignored."""
    ready = done.filter(F.col("status") == "complete").select(key).distinct()
    return work.join(ready, key, "left_anti"), work.join(ready, key, "left_semi")


def invalid_entries(done: DataFrame) -> DataFrame:
    """Entries that cannot be reused, with the reason."""
    return done.filter(~F.col("status").eqNullSafe(F.lit("complete"))).withColumn(
        "warning", F.concat(F.lit("ignored: status "), F.coalesce("status", F.lit("missing"))))


def run_incremental(work: DataFrame, store: str, process) -> DataFrame:
    """Process what the store lacks, append it, and return all results for ``work``.

    Failed rows are kept with their status and are tried again next time.
    """
    spark = work.sparkSession
    try:
        done = spark.read.parquet(store)
    except AnalysisException:  # the first run has no store yet
        done = None
    todo = work if done is None else split_completed(work, done)[0]
    process(todo).write.mode("append").parquet(store)
    keys = work.select("work_key").distinct()
    return spark.read.parquet(store).filter("status = 'complete'").join(keys, "work_key", "left_semi")
