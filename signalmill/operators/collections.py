"""Albums, preference logs, retention, revisions: analytics over result and log tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.levels import clamp
from ..session import cut_lineage
from .ordering import fill_from_neighbours, home_rows, position, running_total, with_halo
from .quantiles import ranked_value

# fixed values
NOT_MEASURED = -70.0
JUMP_LIMIT = 3.5
GAP_SECONDS = 2.0
ALBUM_BLOCK = 4096


def collection_stats(tracks: DataFrame, key: str = "album_id") -> DataFrame:
    """Count of all tracks; min, max, span, mean, upper median and variance of the measured ones."""
    measured = F.when(F.col("input_lufs") > NOT_MEASURED, F.col("input_lufs"))
    base = tracks.groupBy(key).agg(
        F.count(F.lit(1)).alias("track_count"), F.min(measured).alias("min_lufs"), F.max(measured).alias("max_lufs"),
        F.avg(measured).alias("mean_lufs"), F.var_pop(measured).alias("lufs_variance"))
    median = ranked_value(
        tracks.select(key, measured.alias("_m")), [key], "_m", lambda n: F.floor(n / F.lit(2)), "median_lufs", 0.25)
    return base.join(median, key, "left").withColumn("span_lu", F.col("max_lufs") - F.col("min_lufs"))


def transitions(tracks: DataFrame, key: str = "album_id") -> DataFrame:
    """Loudness step from each track to the next, master level first, input level as fallback."""
    level = F.when(F.col("master_lufs") > NOT_MEASURED, F.col("master_lufs")).otherwise(F.col("input_lufs"))
    rows, w = with_halo(tracks.select(key, "track_index", level.alias("_l")), [key], "track_index", ALBUM_BLOCK, after=1)
    out = home_rows(rows.withColumn("jump_lu", F.lead("_l").over(w) - F.col("_l"))).filter(F.col("jump_lu").isNotNull())
    return out.select(
        key, F.col("track_index").alias("from_track"), (F.col("track_index") + 1).alias("to_track"), "jump_lu",
        (F.abs("jump_lu") > JUMP_LIMIT).alias("jump_warning"), F.lit(GAP_SECONDS).alias("gap_s"))


def cohesion_plan(tracks: DataFrame, stats: DataFrame, target: float = -14.0, key: str = "album_id") -> DataFrame:
    """Per-track target that keeps half of the distance to the album median, at most 2.5 LU."""
    ref = F.coalesce("median_lufs", F.lit(target))
    unmeasured = F.col("input_lufs") <= NOT_MEASURED
    t = tracks.join(stats.select(key, "median_lufs"), key)
    t = t.withColumn("offset_lu", F.when(unmeasured, 0.0).otherwise(clamp((F.col("input_lufs") - ref) * 0.5, -2.5, 2.5)))
    off = F.col("offset_lu")
    digits = F.format_string("%.6f", off)
    note = (
        F.when(unmeasured, "album default")
        .when(F.abs(off) < 0.2, "kept at album baseline")
        .when(off > 0, F.concat(F.lit("louder than album by "), F.substring(digits, 1, 3), F.lit(" LU")))
        .otherwise(F.concat(F.lit("softer than album by "), F.substring(digits, 1, 4), F.lit(" LU")))
    )
    return t.select(key, "track_index", (off + target).alias("target_lufs"), "offset_lu", note.alias("explanation"))


def album_report(tracks: DataFrame, key: str = "album_id", part: int = 1000) -> DataFrame:
    """Markdown track table as text lines in order: one row per track, so no album is gathered in one row."""
    line = F.format_string(
        "| %d | %s | %.1f | %.1f | %.1f | %s |", F.col("track_index") + 1, "title", "input_lufs", "master_lufs",
        "master_true_peak", "status")
    return tracks.select(key, "track_index", line.alias("line"))


def album_manifest(tracks: DataFrame, key: str = "album_id", page: int = 1000) -> DataFrame:
    """JSON track lists in order, one document per album page of ``page`` tracks."""
    row = F.struct(
        (F.col("track_index") + 1).alias("track_number"), "title",
        F.round("master_lufs", 4).alias("integrated_lufs"), F.round("master_true_peak", 4).alias("true_peak_dbtp"))
    return (
        tracks.groupBy(key, F.floor(F.col("track_index") / F.lit(page)).cast("bigint").alias("page"))
        .agg(F.array_sort(F.collect_list(row)).alias("tracks"))
        .select(key, "page", F.size("tracks").cast("bigint").alias("track_count"), F.to_json("tracks").alias("tracks"))
    )


PREFERENCE_FIELDS = ("lufs", "brightness", "bass", "width", "saturation", "punch")


def preference_sums(events: DataFrame, block: int = 1 << 16, growth: float = 1.02) -> DataFrame:
    """Recency-weighted sums per profile: weight ``growth^i`` for the i-th event of ``seq``.

    Weights are taken relative to the profile's last event, so long logs neither overflow
    nor need their events in one task.
    """
    sizes = events.groupBy("profile_name").agg(F.max("seq").alias("_top"), F.count(F.lit(1)).alias("event_count"))
    weight = F.pow(F.lit(growth), (F.col("seq") - F.col("_top")).cast("double"))
    e = events.join(sizes, "profile_name").withColumn("_w", weight)
    return e.groupBy("profile_name").agg(
        F.max("event_count").alias("event_count"), F.sum("_w").alias("total_weight"),
        *[F.sum(F.col(f"delta_{f}") * F.col("_w")).alias(f"sum_{f}") for f in PREFERENCE_FIELDS])


def preference_vector(sums: DataFrame, rate: float = 0.25) -> DataFrame:
    # fixed values: limits of each bias
    limits = {"lufs": (-2, 2), "brightness": (-3, 3), "bass": (-3, 3), "saturation": (-0.5, 0.5), "punch": (-0.5, 0.5)}
    mean = {f: F.col(f"sum_{f}") * (F.lit(rate) / F.col("total_weight")) for f in PREFERENCE_FIELDS}
    return sums.select(
        "profile_name", "event_count", *[clamp(mean[f], *limits[f]).alias(f"{f}_bias") for f in limits],
        clamp(mean["width"] + 1.0, 0.80, 1.25).alias("width_scale"))


def aggregate_profiles(profiles: DataFrame, key: str) -> DataFrame:
    cols = ("integrated_lufs", "true_peak_dbtp", "bass_db", "presence_db")
    return profiles.groupBy(key).agg(
        F.count(F.lit(1)).alias("reference_count"), *[F.avg(c).alias(c) for c in cols])


def retention_plan(items: DataFrame, budget: int, *buckets: Column) -> DataFrame:
    """Which disposable items go, oldest first, until the total fits the budget. A report: nothing is deleted.

    ``buckets``, coarse ones first, must not decrease with (modified_ms, item_id); totals run over buckets, level by level.
    """
    total = items.agg(F.sum("size_bytes").alias("_all"))
    free = running_total(
        items.filter(~F.col("owned")), [], buckets, [F.col("modified_ms"), F.col("item_id")], F.col("size_bytes"), "_cum")
    freed_before = F.col("_cum") - F.col("size_bytes")
    remove = F.col("_all") - freed_before > F.lit(budget)
    return free.crossJoin(F.broadcast(total)).select(  # one-row side
        "item_id", "size_bytes", "modified_ms", remove.alias("remove"),
        F.when(remove, F.col("_all") - F.col("_cum")).alias("bytes_after"))


def latest_revision(revisions: DataFrame, key: str = "project_id") -> DataFrame:
    return revisions.groupBy(key).agg(
        F.max(F.struct("ts_ms", "id", "kind", "summary")).alias("r"), F.count(F.lit(1)).alias("revisions")
    ).select(key, "revisions", "r.ts_ms", "r.id", "r.kind", "r.summary")


def history_conflicts(a: DataFrame, b: DataFrame, key: str = "project_id") -> DataFrame:
    """Compare two revision histories by position; a conflict is when neither is a prefix of the other."""
    left = a.select(key, "pos", F.col("id").alias("a_id"))
    right = b.select(key, "pos", F.col("id").alias("b_id"))
    both = left.join(right, [key, "pos"], "full").groupBy(key).agg(
        F.count("a_id").alias("a_len"), F.count("b_id").alias("b_len"),
        F.count_if(F.col("a_id").isNotNull() & F.col("b_id").isNotNull() & (F.col("a_id") != F.col("b_id")))
        .alias("mismatches"))
    verdict = (
        F.when(F.col("mismatches") > 0, "conflict").when(F.col("a_len") == F.col("b_len"), "same")
        .when(F.col("a_len") < F.col("b_len"), "a_behind").otherwise("b_behind"))
    return both.withColumn("verdict", verdict)


def head_of_chain(revisions: DataFrame, key: str = "project_id") -> DataFrame:
    """Revisions that no other revision names as parent."""
    parents = revisions.filter(F.col("parent_id").isNotNull()).select(key, F.col("parent_id").alias("id"))
    return revisions.join(parents, [key, "id"], "left_anti")


def list_recent(projects: DataFrame, n: int) -> DataFrame:
    return projects.orderBy(F.col("updated_ms").desc(), F.col("project_id")).limit(n)


def merge_events(events: DataFrame, max_gap: float, block: int = 4096, root: str = "unknown") -> DataFrame:
    """Join neighbouring events of one label: same label as the row before, starting within ``max_gap`` of its end.

    Rows that end before they start are dropped first. Another label in between ends the run. The gap is
    measured to the furthest end of the run so far. ``track_id, seq, label, start_s, end_s, confidence`` in;
    ``seq`` is the position in the track.
    """
    keys = ["track_id"]
    ok = events.filter(F.col("end_s") >= F.col("start_s"))
    ok = position(ok.drop("_p"), keys, [F.floor(F.col("seq") / F.lit(block))], [F.col("seq")], "_p")
    rows, w = with_halo(ok, keys, "_p", block, before=1)
    change = F.coalesce(F.lag("label").over(w) != F.col("label"), F.lit(True)) | (F.col("label") == root)
    # label runs first (each bounded by a change of label), then gaps inside a label run
    runs_ = home_rows(rows.withColumn("_start", F.when(change, F.col("_p"))))
    # every step reads its input more than once: keep the (event-sized) intermediate tables
    runs_ = cut_lineage(fill_from_neighbours(cut_lineage(runs_), keys, "_p", block, "_start", "_run", None))
    reach = _running_max(runs_, ["track_id", "_run"], "_p", block, "end_s", "_reach")
    rows, w = with_halo(reach, keys, "_p", block, before=1)
    same = F.coalesce(F.lag("_run").over(w) == F.col("_run"), F.lit(False))
    joined = same & (F.col("start_s") <= F.lag("_reach").over(w) + max_gap)
    marked = home_rows(rows.withColumn("_head", F.when(~F.coalesce(joined, F.lit(False)), F.col("_p"))))
    marked = fill_from_neighbours(cut_lineage(marked), keys, "_p", block, "_head", "_group", None)
    return marked.groupBy("track_id", "_group").agg(
        F.first("label").alias("label"), F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"),
        F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("merged")).drop("_group")


def _running_max(df: DataFrame, keys: list[str], pos: str, block: int, value: str, out: str) -> DataFrame:
    base = df.withColumn("_bk", F.floor(F.col(pos) / F.lit(block)).cast("bigint"))
    w = Window.partitionBy(*keys, "_bk").orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tops = base.groupBy(*keys, "_bk").agg(F.max(value).alias("_top"))
    wb = Window.partitionBy(*keys).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    before = tops.select(*keys, "_bk", F.max("_top").over(wb).alias("_before"))
    return (
        base.withColumn(out, F.max(value).over(w)).join(before, [*keys, "_bk"], "left")
        .withColumn(out, F.greatest(out, "_before")).drop("_bk", "_before"))
