"""JSON forms of reports, events and plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def rounded_struct(df: DataFrame, names: list[str], digits: int = 4) -> Column:
    """Struct of the columns with doubles rounded; null members are left out when written as JSON."""
    cols = [F.round(n, digits).alias(n) if isinstance(df.schema[n].dataType, (T.DoubleType, T.FloatType)) else F.col(n) for n in names]
    return F.struct(*cols)


def report_json(df: DataFrame, groups: dict[str, list[str]], version: int = 3) -> DataFrame:
    """One JSON document per row: ``schema_version`` and one object per group of columns."""
    parts = [rounded_struct(df, cols).alias(name) for name, cols in groups.items()]
    return df.select("track_id", F.to_json(F.struct(F.lit(version).alias("schema_version"), *parts)).alias("report"))


def write_report_json(df: DataFrame, groups: dict[str, list[str]], folder: str, version: int = 3) -> None:
    parts = [rounded_struct(df, cols).alias(name) for name, cols in groups.items()]
    df.select("track_id", F.lit(version).alias("schema_version"), *parts).write.mode("overwrite").json(folder)
