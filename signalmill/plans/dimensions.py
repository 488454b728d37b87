"""Fixed lookup tables: label tree, phrase rules, recipes, styles, candidates, strengths, device profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: id, parent, role, minimum confidence
TAXONOMY = [
    ("unknown", "", "unknown", 0.0),
    ("drums", "unknown", "drums", 0.55),
    ("bass_source", "unknown", "bass", 0.55),
    ("vocals", "unknown", "vocals", 0.55),
    ("tonal_source", "unknown", "tonal", 0.55),
    ("kick", "drums", "drums", 0.80),
    ("snare", "drums", "drums", 0.80),
    ("clap", "drums", "drums", 0.80),
    ("closed_hihat", "drums", "drums", 0.82),
    ("open_hihat", "drums", "drums", 0.82),
    ("sub_808", "bass_source", "bass", 0.82),
    ("synth_bass", "bass_source", "bass", 0.80),
    ("electric_bass", "bass_source", "bass", 0.80),
    ("acoustic_piano", "tonal_source", "tonal", 0.82),
    ("electric_piano", "tonal_source", "tonal", 0.70),
    ("rhodes", "electric_piano", "tonal", 0.85),
    ("organ", "tonal_source", "tonal", 0.82),
    ("acoustic_guitar", "tonal_source", "tonal", 0.82),
    ("electric_guitar", "tonal_source", "tonal", 0.82),
    ("strings", "tonal_source", "tonal", 0.72),
    ("brass", "tonal_source", "tonal", 0.72),
    ("synth_lead", "tonal_source", "tonal", 0.82),
    ("synth_pad", "tonal_source", "tonal", 0.82),
    ("lead_vocal", "vocals", "vocals", 0.82),
    ("backing_vocal", "vocals", "vocals", 0.82),
]

# fixed values: constraint rules (target scope, name, rule text, phrases)
CONSTRAINT_RULES = [
    ("stem_bass", "bass", "don't touch bass", [
        "don't touch the bass", "dont touch the bass", "don't touch bass", "leave the bass alone", "leave bass alone",
        "preserve the bass", "preserve bass"]),
    ("stem_vocal", "vocal", "leave vocals alone", [
        "don't touch vocals", "leave vocals alone", "preserve vocals", "leave the vocal alone", "don't touch the vocal",
        "without touching vocals"]),
    ("instrument_snare", "snare", "preserve snare transient", [
        "without flattening the snare", "preserve the snare", "preserve snare", "keep snare punch",
        "don't squash the snare"]),
    ("section_hook", "hook", "only in hook section", [
        "only in the hook", "only in hook", "only the hook", "only chorus"]),
]

# fixed values: action rules in order; the first match of a category counts
# (category, action, target scope, target name, amount, delta dB, phrases)
ACTION_RULES = [
    ("punch", "increase_punch", "stem_drums", "drums", 0.6, 0.0, [
        "hit harder", "more punch", "punchier", "tighter drums", "punchy drums", "boost punch"]),
    ("punch", "reduce_punch", "stem_drums", "drums", 0.5, 0.0, ["less punch", "softer transient", "tame drums"]),
    ("highs", "reduce_harshness", "global", "highs", 0.6, 0.0, [
        "hats are too sharp", "too sharp", "too harsh", "tame harshness", "reduce harshness", "harsh", "smooth the top",
        "less harsh", "tame hats"]),
    ("highs", "increase_brightness", "global", "air", 0.5, 0.0, [
        "more air", "brighter", "more brightness", "more top end", "add air", "crisper"]),
    ("bass", "adjust_bass_level", "instrument_808", "808", -0.5, -1.5, [
        "back the 808 down", "turn down 808", "less 808", "lower 808", "808 is too loud"]),
    ("bass", "adjust_bass_level", "stem_bass", "bass", 0.5, 1.5, [
        "more bass", "more sub", "boost bass", "heavier bass", "fatter low end"]),
    ("bass", "adjust_bass_level", "stem_bass", "bass", -0.5, -1.5, [
        "less bass", "too much bass", "reduce sub", "less sub"]),
    ("mud", "reduce_mud", "global", "low_mids", 0.5, 0.0, [
        "reduce mud", "less muddy", "muddy", "clean up the low mids", "too boxy", "boxy"]),
    ("mud", "increase_warmth", "global", "warmth", 0.5, 0.0, ["more warmth", "warmer", "add warmth"]),
    ("width", "adjust_stereo_width", "global", "stereo_field", 0.6, 0.0, [
        "more width", "wider", "increase width", "spread it out"]),
    ("width", "adjust_stereo_width", "global", "stereo_field", -0.4, 0.0, [
        "narrower", "less width", "tighter stereo", "more centered"]),
    ("loudness", "adjust_loudness", "global", "master", 0.6, 1.0, [
        "make it louder", "louder", "push it harder", "more level", "hotter master"]),
    ("loudness", "adjust_loudness", "global", "master", -0.5, -1.0, [
        "more dynamic", "more headroom", "quieter", "less squashed"]),
    ("saturation", "adjust_saturation", "global", "saturation", 0.5, 0.0, [
        "more grit", "add saturation", "more color", "analog feel", "tape warmth", "more bite"]),
]

# fixed values: key, extension, container, sample format, rate, dither
RECIPES = [
    ("studio_master", ".wav", "wav", "pcm24", None, True),
    ("distribution_wav", ".wav", "wav", "pcm24", None, True),
    ("distribution_flac", ".flac", "flac", "pcm24", None, True),
    ("cd", ".wav", "wav", "pcm16", 44100, True),
    ("client_preview", ".mp3", "mp3", "compressed", None, False),
    ("archive_float", ".wav", "wav", "float32", None, False),
]

# fixed values: style, target LUFS, bass dB, presence dB, width, punch, warmth (defaults of a neutral request)
DEFAULT_CONTROLS = (-11.0, 0.0, 0.0, 1.0, 0.5, 0.2)
STYLES = [
    ("balanced", *DEFAULT_CONTROLS),
    ("transparent", -13.0, 0.0, 0.0, 1.0, 0.35, 0.0),
    ("punchy", -10.5, 0.3, 0.2, 1.04, 0.85, 0.15),
    ("warm", -11.5, 0.8, -0.5, 1.0, 0.45, 0.65),
    ("wide", -11.5, -0.2, 0.3, 1.14, 0.5, 0.2),
    ("loud", -9.0, 0.0, 0.3, 1.03, 0.7, 0.3),
]

# fixed values: candidate, branch, target offset, preservation
CANDIDATES = [
    ("candidate_balanced", "master_a", 0.0, 0.35),
    ("candidate_preservation", "master_b", -1.5, 0.85),
    ("candidate_warm", "master_warm", -0.5, 0.60),
]

# fixed values: strength, weight, limit
STRENGTHS = [("loose", 0.25, 1.5), ("balanced", 0.50, 3.0), ("close", 0.80, 4.5)]


def taxonomy(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TAXONOMY, "id string, parent_id string, role string, minimum double")


def ancestor_closure(spark: SparkSession) -> DataFrame:
    """``label, depth, ancestor, role, minimum``: each label with itself and all nodes above it."""
    parent = {n[0]: n for n in TAXONOMY}
    rows = []
    for node in TAXONOMY:
        depth, at = 0, node
        while True:
            rows.append((node[0], depth, at[0], at[2], at[3]))
            if not at[1]:
                break
            depth, at = depth + 1, parent[at[1]]
    return spark.createDataFrame(rows, "label string, depth int, ancestor string, role string, minimum double")


def recipes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        RECIPES, "recipe string, extension string, container string, sample_format string, rate int, dither boolean")


def styles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        STYLES, "style string, target_lufs double, bass_db double, presence_db double, width double, punch double, "
                "warmth double")


def expand(df: DataFrame, rows: list[tuple], names: list[str]) -> DataFrame:
    """Every row of ``df`` once per row of a short fixed table, as a projection (no join)."""
    table = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r)]) for r in rows])
    return df.withColumn("_row", F.explode(table)).select(*df.columns, *[F.col(f"_row.{n}").alias(n) for n in names])
