"""Free-text revision requests: phrase rules, target resolution, conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dimensions import ACTION_RULES, CONSTRAINT_RULES

Rules = list[tuple]


def _any_phrase(text: Column, phrases: list[str]) -> Column:
    cond = F.lit(False)
    for p in phrases:
        cond = cond | F.contains(text, F.lit(p))
    return cond


def match_phrases(
    messages: DataFrame, text: str = "text", actions: Rules = ACTION_RULES, constraints: Rules = CONSTRAINT_RULES
) -> DataFrame:
    """Add ``actions`` and ``constraints`` arrays. Per category the first matching rule counts; constraints are
    independent; a text with neither becomes one ``custom`` action. A projection: rules are fixed and few,
    so each text is read once and nothing is joined or shuffled."""
    low = F.lower(F.col(text))
    chosen, categories = [], []
    for rule in actions:
        if rule[0] not in categories:
            categories.append(rule[0])
    for cat in categories:
        expr = None
        for c, action, target, name, amount, delta, phrases in [r for r in actions if r[0] == cat]:
            value = F.struct(
                F.lit(cat).alias("category"), F.lit(action).alias("action"), F.lit(target).alias("target"),
                F.lit(name).alias("target_name"), F.lit(float(amount)).alias("amount"), F.lit(float(delta)).alias("delta_db"))
            hit = _any_phrase(low, phrases)
            expr = F.when(hit, value) if expr is None else expr.when(hit, value)
        chosen.append(expr)
    kept = F.filter(F.array(*chosen), lambda a: a.isNotNull())
    rules = F.filter(
        F.array(*[
            F.when(_any_phrase(low, phrases), F.struct(
                F.lit(target).alias("target"), F.lit(name).alias("name"), F.lit(rule).alias("rule")))
            for target, name, rule, phrases in constraints]),
        lambda c: c.isNotNull())
    custom = F.array(F.struct(
        F.lit("custom").alias("category"), F.lit("custom").alias("action"), F.lit("global").alias("target"),
        F.lit("custom").alias("target_name"), F.lit(0.5).alias("amount"), F.lit(0.0).alias("delta_db")))
    out = messages.withColumns({"_kept": kept, "constraints": rules})
    return out.withColumn(
        "actions", F.when((F.size("_kept") == 0) & (F.size("constraints") == 0), custom).otherwise(F.col("_kept"))
    ).drop("_kept")


def with_parser_hook(messages: DataFrame, hook: Column | None, text: str = "text") -> DataFrame:
    """Optional parsed column (for example from a model) with the phrase rules as fallback where it is null."""
    parsed = match_phrases(messages, text)
    return parsed if hook is None else parsed.withColumn("actions", F.coalesce(hook, F.col("actions")))


def constraint_conflicts(parsed: DataFrame) -> DataFrame:
    """Add ``violations`` and ``warnings``: constraints against the actions of the same message."""
    def has(target: str) -> Column:
        return F.exists("constraints", lambda c: c["target"] == target)

    bass = F.filter("actions", lambda a: a["target"].isin("stem_bass", "instrument_808")
                    & (a["action"] == "adjust_bass_level"))
    vocal = F.filter("actions", lambda a: a["target"].isin("stem_vocal", "instrument_lead_vocal"))
    heavy = F.filter("actions", lambda a: (a["action"] == "adjust_loudness") & (a["amount"] > 0.8))
    empty = F.array().cast("array<string>")
    violations = F.concat(
        F.when(has("stem_bass"), F.transform(bass, lambda a: F.concat(F.lit("bass is protected: "), a["action"]))).otherwise(empty),
        F.when(has("stem_vocal"), F.transform(vocal, lambda a: F.concat(F.lit("vocals are protected: "), a["action"])))
        .otherwise(empty))
    warnings = F.when(
        has("instrument_snare"), F.transform(heavy, lambda a: F.lit("heavy limiting may flatten the snare"))).otherwise(empty)
    return parsed.withColumns({"violations": violations, "warnings": warnings})


def resolve_targets(actions: DataFrame, events: DataFrame, key: str = "track_id") -> DataFrame:
    """Is an action's target present? Highest confidence of the fitting events; 0.2 and a warning when absent.

    Events are reduced to one row per track (a maximum per target kind) before the join.
    """
    label, role = F.lower("label"), F.col("role")
    kinds = {
        "instrument_808": F.contains(label, F.lit("808")), "instrument_kick": F.contains(label, F.lit("kick")),
        "instrument_snare": F.contains(label, F.lit("snare")),
        "vocal": F.contains(label, F.lit("vocal")) | (role == "vocals")}
    best = events.groupBy(key).agg(
        F.lit(True).alias("_any"), *[F.max(F.when(cond, F.col("confidence"))).alias(f"_{k}") for k, cond in kinds.items()])
    t = F.col("target")
    found = F.when(t.isin("stem_vocal", "instrument_lead_vocal"), F.col("_vocal"))
    for k in ("instrument_808", "instrument_kick", "instrument_snare"):
        found = found.when(t == k, F.col(f"_{k}"))
    certain = (t == "global") | F.col("_any").isNull()
    j = actions.join(best, key, "left").withColumn("_f", found)
    return j.select(
        *actions.columns, (certain | F.col("_f").isNotNull()).alias("present"),
        F.when(certain, 1.0).otherwise(F.coalesce("_f", F.lit(0.2))).alias("target_confidence"),
        F.when(~certain & F.col("_f").isNull(), F.concat("target_name", F.lit(" not detected"))).alias("warning"))


def explain_revision(result: DataFrame) -> Column:
    """Text of a revision: its changes and kept constraints, or why it was refused."""
    lines = F.concat(
        F.transform("changes", lambda c: F.concat(F.lit("changed: "), c)),
        F.transform("constraints", lambda c: F.concat(F.lit("kept: "), c["rule"])))
    return F.when(F.size("violations") > 0, F.concat(F.lit("refused: "), F.get("violations", F.lit(0)))).otherwise(
        F.array_join(lines, "\n"))
