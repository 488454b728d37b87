"""How filters overlap: what each removes in every order of application, and its share over all orders.

A document's failures are one of 2^k masks, so the corpus is counted once into cells (part, mask). Each cell is then folded
across the array of all orders by ``transform`` and ``aggregate``, which gives a weighted struct for every order and step;
the arrays of a part's cells are merged by elementwise sums.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORDS = r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: what a document fails, by letter, over ``text`` and its ``words``
CONDITIONS = {
    "A": "size(words) < 50",
    "B": "100 * size(array_distinct(words)) < 65 * size(words)",
    "C": f"100 * (length(text) - length(translate(text, '{CAPITALS}', ''))) > 5 * length(text)",
    "D": "text RLIKE '[#$%&*|]'",
}
#: counts of a step, in the order of the columns of the result
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def failures(docs: DataFrame, labels: DataFrame, conditions: dict[str, str], repeat: str, part: str) -> DataFrame:
    """Documents counted by ``part`` and the letters they fail: ``part, fails, n, good, toxic``.

    Equal texts meet as digests. A text's rows are first added up by id, so that neither a text nor an id that
    a third of all rows share comes to one task row by row.
    """
    conditions = dict(sorted(conditions.items()))
    base = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long")).alias("doc_id"),
        F.coalesce(F.col(part), F.lit("")).alias("part"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"))
    failing = F.concat(*[F.when(F.expr(c), k).otherwise("") for k, c in conditions.items()])
    marked = base.withColumn("words", F.expr(WORDS)).select(
        "doc_id", "part", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), failing.alias("fails"))
    texts = marked.groupBy("digest", "doc_id", "part").agg(F.first("fails").alias("fails"), F.count("*").alias("n"))
    first = texts.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("is_first", F.lit(True))
    again = F.when(F.col("is_first").isNull(), repeat).otherwise("")
    counted = texts.join(first, ["digest", "doc_id"], "left").groupBy(
        "doc_id", "part", F.concat("fails", again).alias("fails")).agg(F.sum("n").alias("n"))
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.expr("CAST(quality = 1 AS INT)")).alias("good"), F.max(F.expr("CAST(toxic = 1 AS INT)")).alias("toxic"))
    n = F.col("n")
    return counted.join(known, "doc_id", "left").groupBy("part", "fails").agg(
        F.sum(n).alias("n"), F.sum(n * F.coalesce("good", F.lit(0))).alias("good"), F.sum(n * F.coalesce("toxic", F.lit(0))).alias("toxic"))


def orders(letters: str) -> Column:
    """All orders of the letters, in alphabetical order."""
    return F.array(*[F.lit("".join(p)) for p in permutations(sorted(letters))])


def fold(cell: Column, letters: str) -> Column:
    """A cell's counts for every order and step, as one array: order after order, step after step."""
    steps = F.sequence(F.lit(1), F.lit(len(letters)))

    def weight(when: Column, count: str) -> Column:
        return F.when(when, cell[count]).otherwise(F.lit(0).cast("long"))

    def along(order: Column) -> Column:
        def step(seen: Column, k: Column) -> Column:
            letter = F.substring(order, k, F.lit(1))
            fails, here = F.contains(cell["fails"], letter), seen["here"]
            counts = F.struct(
                weight(here & ~fails, "n").alias("kept"), weight(here & fails, "n").alias("removed"),
                weight(~here & fails, "n").alias("redundant"), weight(cell["fails"] == letter, "n").alias("unique_fails"),
                weight(here & fails, "good").alias("good_lost"), weight(here & fails, "toxic").alias("toxic_lost"))
            return F.struct((here & ~fails).alias("here"), F.concat(seen["counts"], F.array(counts)).alias("counts"))

        kind = ", ".join(f"{c}: BIGINT" for c in COUNTS)
        start = F.struct(F.lit(True).alias("here"), F.array().cast(f"array<struct<{kind}>>").alias("counts"))
        return F.aggregate(steps, start, step, lambda seen: seen["counts"])

    return F.flatten(F.transform(orders(letters), along))


def plus(left: Column, right: Column) -> Column:
    """Elementwise sums of two arrays of counts."""
    return F.zip_with(left, right, lambda a, b: F.struct(*[(a[c] + b[c]).alias(c) for c in COUNTS]))


def audit_filters(docs: DataFrame, labels: DataFrame, conditions: dict[str, str] = CONDITIONS, repeat: str = "E",
                  part: str = "source") -> DataFrame:
    """One row per value of ``part``, order of the filters and step: ``part, filter_order, step`` and, within the part,

    ``kept`` after the step, ``removed`` in it, ``redundant`` (fail its filter, removed before), ``unique_fails`` (fail its
    filter only), ``good_lost`` and ``toxic_lost`` (removed here, labelled so), ``shapley`` (removed by its filter, summed over
    all orders).

    ``conditions`` gives each filter's letter and what fails it, in SQL over ``text`` and ``words``; ``repeat`` is the letter
    of the filter that fails a text which a smaller ``doc_id`` has too, in whatever part. Null texts are empty texts, a null part
    is the empty string, a null id is smaller than all others and has no label. Rows with equal id and text are counted each
    and do not fail ``repeat`` for one another; an id with several labels counts as good or toxic if one of them says so. Other
    columns are not read. Empty documents give no rows; empty labels give zeros. No part has more than 2^k cells.
    """
    letters = "".join(sorted([*conditions, repeat]))
    cells = failures(docs, labels, conditions, repeat, part).groupBy("part").agg(
        F.collect_list(F.struct("fails", "n", "good", "toxic")).alias("cells"))
    folded = cells.select("part", F.transform("cells", lambda cell: fold(cell, letters)).alias("folded"))
    merged = folded.select("part", F.aggregate(F.slice("folded", 2, F.size("folded")), F.col("folded")[0], plus).alias("counts"))
    size = len(letters)
    rows = merged.select("part", F.posexplode("counts").alias("at", "count"))
    rows = rows.select("part", F.element_at(orders(letters), F.floor(F.col("at") / size).cast("int") + 1).alias("filter_order"),
                       (F.col("at") % size + 1).alias("step"), "count.*")
    own = Window.partitionBy("part", F.substring("filter_order", F.col("step"), F.lit(1)))
    return rows.select("part", "filter_order", F.col("step").cast("int").alias("step"), *COUNTS, F.sum("removed").over(own).alias("shapley"))
