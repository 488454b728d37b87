"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "signalmill") -> SparkSession:
    """A session for tests and local runs; on a cluster use the session the cluster gives you."""
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir`` (or the context's checkpoint folder).

    A scratch folder is used only in local mode; on a cluster a folder of one machine would not be seen by the rest.
    """
    global _scratch
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        if _scratch is None:
            _scratch = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        root = _scratch
    return root.rstrip("/")


_scratch: str | None = None


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows as a table written once to the shared folder: what is read twice is computed once, columns stay
    prunable, and lost executors read it again instead of recomputing it."""
    path = f"{checkpoint_root(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
