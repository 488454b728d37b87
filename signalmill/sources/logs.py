"""Append-only event logs and study files as JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.study import DAMAGE

NUMBERS = ("delta_lufs", "delta_brightness", "delta_bass", "delta_width", "delta_saturation", "delta_punch")
EVENT_SCHEMA = T.StructType(
    [T.StructField("event_id", T.StringType()), T.StructField("timestamp_ms", T.LongType()),
     T.StructField("event_type", T.IntegerType()),
     *[T.StructField(n, T.DoubleType()) for n in NUMBERS], T.StructField("notes", T.StringType())]
)


def json_number(text: str, key: str) -> Column:
    """A numeric property of a JSON text, 0 when absent."""
    return F.coalesce(F.get_json_object(text, f"$.{key}").cast("double"), F.lit(0.0))


def append_events(events: DataFrame, folder: str) -> None:
    """Append to the log, one partition folder per profile."""
    events.write.mode("append").partitionBy("profile_name").json(folder)


def read_event_log(spark: SparkSession, folder: str, profile: str | None = None) -> DataFrame:
    """Events of one or all profiles; missing numbers read as 0, blank lines are skipped by the reader."""
    log = spark.read.schema(T.StructType([*EVENT_SCHEMA.fields, T.StructField("profile_name", T.StringType())])).json(folder)
    if profile is not None:
        log = log.filter(F.col("profile_name") == profile)  # partition pruning
    # the marker of an emptied profile is not an event; an event without an id is one
    return log.filter(~F.col("event_id").eqNullSafe("__reset__")).fillna(0.0, list(NUMBERS))


def export_all(spark: SparkSession, folder: str, target: str) -> None:
    """All logs as one JSON-lines data set with the profile inside each row."""
    read_event_log(spark, folder).write.mode("overwrite").json(target)


def import_all(spark: SparkSession, source: str, folder: str, profile: str | None = None) -> None:
    """Append an exported data set; rows keep their own profile unless ``profile`` overrides it."""
    rows = spark.read.schema(
        T.StructType([*EVENT_SCHEMA.fields, T.StructField("profile_name", T.StringType())])).json(source)
    name = F.lit(profile) if profile else F.coalesce("profile_name", F.lit("default"))
    append_events(rows.withColumn("profile_name", name), folder)


def reset_profile(spark: SparkSession, folder: str, profile: str) -> None:
    """Empty one profile's partition; the others are untouched (dynamic partition overwrite).

    Overwriting a partition needs a row in it, so a marker row without numbers replaces the log and
    :func:`read_event_log` hides it.
    """
    marker = spark.createDataFrame([("__reset__", profile)], "event_id string, profile_name string")
    marker.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("profile_name").json(folder)


def read_live_events(spark: SparkSession, folder: str, profile: str | None = None) -> DataFrame:
    """The same as :func:`read_event_log`, under its older name."""
    return read_event_log(spark, folder, profile)


STUDY_FIELDS = {
    "trackId": "string", "category": "string", "alreadyGood": "boolean", "sourceGuidanceApplied": "boolean",
    "blindPreference": "string", "artifactAudible": "boolean", "transientDamage": "boolean",
    "monoCompatibilityWorse": "boolean", "stereoImageWorse": "boolean", "sectionConsistencyWorse": "boolean",
    "tonalSideEffect": "boolean",
}


def read_study(spark: SparkSession, path: str, fail_fast: bool = False) -> DataFrame:
    """Study JSON lines with an ``errors`` array per row; blank and ``#`` lines are skipped.

    With ``fail_fast`` the first invalid row stops the job.
    """
    lines = spark.read.text(path).filter(
        (F.length(F.trim("value")) > 0) & ~F.trim("value").startswith("#")
    ).select("value", F.input_file_name().alias("file"))
    return _typed(check_study_lines(lines), fail_fast)


def check_study_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Type check of each field on the raw JSON text, so that a wrong type is an error and not a null."""
    def raw(f: str) -> Column:
        return F.try_variant_get(F.col("_v"), f"$.{f}", "variant")

    def kind(f: str) -> Column:
        return F.schema_of_variant(raw(f))

    parsed = lines.withColumn("_v", F.try_parse_json(value))
    rules = [F.when(F.col("_v").isNull() | ~F.schema_of_variant("_v").startswith("OBJECT"), "record must be an object")]
    for f, t in STUDY_FIELDS.items():
        if t == "boolean":
            rules.append(F.when(F.coalesce(kind(f), F.lit("")) != "BOOLEAN", f"{f} must be boolean"))
        else:
            text = F.try_variant_get(F.col("_v"), f"$.{f}", "string")
            rules.append(F.when((F.coalesce(kind(f), F.lit("")) != "STRING") | (F.coalesce(text, F.lit("")) == ""),
                                f"{f} must be a non-empty string"))
    pref = F.try_variant_get(F.col("_v"), "$.blindPreference", "string")
    rules.append(F.when(pref.isNotNull() & (pref != "") & ~pref.isin("guided", "stereo", "tie"), "unknown preference"))
    low = kind("lowEndImproved")
    rules.append(F.when(raw("lowEndImproved").isNotNull() & (low != "BOOLEAN"), "lowEndImproved must be boolean"))
    return parsed.withColumn("errors", F.filter(F.array(*rules), lambda e: e.isNotNull()))


def _typed(checked: DataFrame, fail_fast: bool) -> DataFrame:
    names = ["track_id", "category", "already_good", "guidance_applied", "preference", *DAMAGE]
    cols = [F.try_variant_get(F.col("_v"), f"$.{f}", t).alias(n) for n, (f, t) in zip(names, STUDY_FIELDS.items())]
    out = checked.select(*cols, "errors", *[c for c in checked.columns if c not in ("_v", "errors")])
    if fail_fast:
        ok = F.assert_true(F.size("errors") == 0, F.concat(F.lit("invalid study record: "), F.array_join("errors", "; ")))
        out = out.filter(ok.isNull())
    return out
