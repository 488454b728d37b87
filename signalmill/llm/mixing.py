"""Mixing sources to target weights: a budget goes down a tree of domains, languages and sources; every leaf then takes a
prefix of its documents, in an order that a seed gives for each epoch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

LEVELS = ("domain", "lang", "source")
WORD = r"[^\x20\x09-\x0D]+"


def leaf_columns(docs: DataFrame, domain) -> DataFrame:
    """The three levels as strings; null values are a node of their own."""
    named = {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}
    return docs.select("doc_id", *(F.coalesce(c.cast("string"), F.lit("(none)")).alias(k) for k, c in named.items()),
                       F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("n_tokens"))


def weight_of(level: str, weights: dict[str, int]):
    """A node's weight by its name; 1 where none is given."""
    out = F.lit(1)
    for name, w in sorted(weights.items()):
        out = F.when(F.col(level) == name, w).otherwise(out)
    return out.cast("long")


def share(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Divide each parent's ``quota`` among its children by weight, none over its ``cap``: what one cannot take goes to
    its siblings. As a parent never holds more than its children can take, only what all siblings together lack has gone
    to other parents before. All whole numbers."""
    by_need = Window.partitionBy(*parent).orderBy(F.col("cap") / F.col("weight"), name)
    below = by_need.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*parent)
    left = F.col("quota") - F.coalesce(F.sum("cap").over(below), F.lit(0))
    rest = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(below), F.lit(0))
    full = children.withColumn("full", F.col("cap") * rest <= F.col("weight") * left)
    taken = F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(every)
    weight = F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(every)
    part = F.expr("weight * (quota - taken) div open_weight")
    return full.withColumn("taken", taken).withColumn("open_weight", weight).withColumn(
        "quota", F.when(F.col("full"), F.col("cap")).otherwise(part)).drop("full", "taken", "open_weight", "cap", "weight")


def seeded_key(seed: int, epoch):
    return F.md5(F.concat(F.lit(f"{seed}|"), epoch.cast("string"), F.lit("|"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def mixture_plan(rows: DataFrame, weights: dict[str, dict[str, int]], percent: int, epochs: int, seed: int) -> DataFrame:
    """One row per leaf: ``tokens, quota, full_epochs``, and the last document of the prefix that the next epoch gives
    (``cut_key, cut_id, cut_tokens`` of it taken). ``rows``: the result of ``leaf_columns``.

    The prefix is found without sorting a leaf: documents are summed by the first three digits of their keys, and only
    the one group per leaf in which the prefix ends is ordered.
    """
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")).withColumn("cap", F.col("tokens") * epochs)
    quotas = leaves.agg(F.least(F.expr(f"sum(tokens) * {percent} div 100"), F.sum("cap")).alias("quota")).withColumn("root", F.lit(0))
    parent = ["root"]
    for i, level in enumerate(LEVELS):
        names = list(LEVELS[: i + 1])
        caps = leaves.withColumn("root", F.lit(0)).groupBy("root", *names).agg(F.sum("cap").alias("cap"))
        quotas = share(caps.join(quotas, parent).withColumn("weight", weight_of(level, weights.get(level, {}))), parent, level)
        parent = ["root", *names]
    plan = leaves.join(quotas.drop("root"), list(LEVELS)).select(
        *LEVELS, "tokens", "quota", F.expr("CASE WHEN tokens > 0 THEN quota div tokens ELSE 0 END").alias("full_epochs"))
    plan = cut_lineage(plan.withColumn("open", F.col("quota") - F.col("full_epochs") * F.col("tokens")))
    keyed = rows.join(plan.where("open > 0").select(*LEVELS, "full_epochs", "open"), list(LEVELS)).withColumn(
        "key", seeded_key(seed, F.col("full_epochs"))).withColumn("bucket", F.substring("key", 1, 3))
    sums = keyed.groupBy(*LEVELS, "bucket", "open").agg(F.sum("n_tokens").alias("size"))
    before = F.sum("size").over(Window.partitionBy(*LEVELS).orderBy("bucket")) - F.col("size")
    last = sums.withColumn("before", before).where("before < open AND before + size >= open").select(*LEVELS, "bucket", "before")
    # before + size >= open can hold for a later group too, if it has no tokens: before < open keeps the first only
    inside = keyed.join(last, [*LEVELS, "bucket"])
    order = Window.partitionBy(*LEVELS).orderBy("key", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("start", F.col("before") + F.sum("n_tokens").over(order) - F.col("n_tokens")).where("start < open")
    ends = inside.groupBy(*LEVELS).agg(F.max(F.struct("key", "doc_id", (F.col("open") - F.col("start")).alias("tokens"))).alias("cut"))
    return cut_lineage(plan.join(ends, list(LEVELS), "left").select(
        *LEVELS, "tokens", "quota", "full_epochs", F.col("cut.key").alias("cut_key"), F.col("cut.doc_id").alias("cut_id"),
        F.col("cut.tokens").alias("cut_tokens")))


def with_epochs(rows: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """Every row once for each epoch that takes it, with ``epoch``. ``rows`` has the level columns; the plan has a row per leaf."""
    joined = rows.join(plan.withColumnsRenamed({"tokens": "leaf_tokens"}), list(LEVELS)).withColumn("key", seeded_key(seed, F.col("full_epochs")))
    place, cut = F.struct("key", F.coalesce("doc_id", F.lit(-(1 << 63)))), F.struct("cut_key", F.coalesce("cut_id", F.lit(-(1 << 63))))
    n = F.col("full_epochs") + F.when(F.col("cut_key").isNotNull() & (place <= cut), 1).otherwise(0)
    return joined.withColumn("n", n).where("n > 0").withColumn("epoch", F.explode(F.expr("sequence(0, n - 1)")))


def mix_sources(docs: DataFrame, domain, weights: dict[str, dict[str, int]], percent: int = 60, epochs: int = 4, seed: int = 7) -> DataFrame:
    """A mixture of ``percent`` of the corpus' tokens (words) with at most ``epochs`` passes over a leaf.

    Returns ``doc_id, domain, lang, source, epoch, n_tokens, taken_tokens``: one row per document and epoch that takes
    it; only the last document of a leaf's prefix is taken in part. Null levels are a node of their own, a null text has
    no tokens. Rows that repeat an id follow each other; if a prefix ends at one of them, all rows of that id are in it.
    """
    rows = cut_lineage(leaf_columns(docs, domain))
    plan = mixture_plan(rows, weights, percent, epochs, seed)
    at_cut = (F.col("epoch") == F.col("full_epochs")) & (F.col("key") == F.col("cut_key"))
    return with_epochs(rows, plan, seed).select(
        "doc_id", *LEVELS, "epoch", "n_tokens", F.when(at_cut, F.least("n_tokens", "cut_tokens")).otherwise(F.col("n_tokens")).alias("taken_tokens"))


def mix_documents(docs: DataFrame, domain, weights: dict[str, dict[str, int]], percent: int, epochs: int, seed: int) -> DataFrame:
    """The rows of ``docs`` with their own columns, each as often as the mixture takes it, always whole."""
    rows = cut_lineage(leaf_columns(docs, domain))
    plan = mixture_plan(rows, weights, percent, epochs, seed)
    named = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id"), *(
        F.coalesce(c.cast("string"), F.lit("(none)")).alias(k) for k, c in {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}.items()))
    return with_epochs(named, plan, seed).select("row.*")
