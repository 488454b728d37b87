"""Line dedup: repeated runs of lines by prefix doubling over line digests. DataFrame operations only.

A rank stands for a run of lines: rank 1 is a line's digest, ranks of longer runs pair those of two shorter ones that
overlap or touch. Equal ranks of one length are one longest-common-prefix interval of the suffix order: places whose
suffixes share at least that many lines. A run counts when it has enough lines, or fewer lines with enough characters;
every such run is the union of its windows of that many lines and of its shortest windows with that many characters, so
those are looked up. Windows of later copies merge into maximal runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import given_id, id_and_text, numbered


def paired(ranks: Column, step: int) -> Column:
    """Ranks of runs that begin ``step`` apart, joined: one less for each step."""
    n = F.greatest(F.size(ranks) - step, F.lit(0))
    return F.zip_with(F.slice(ranks, 1, n), F.slice(ranks, step + 1, n), lambda a, b: F.unhex(F.md5(F.concat(a, b))))


def run_ranks(docs: DataFrame, length: int, chars: int | None, copies: bool) -> DataFrame:
    """``doc_id, part, start, n, rank, size``: runs of ``n`` lines that count if they repeat; ``n`` 0 is a whole text.

    Runs of ``length`` lines with some text, and shorter ones with ``chars`` characters (those of each line without
    spaces around it) that fall below it without their first or without their last line.
    """
    lines = F.split(F.col("text"), "\n", -1)
    rows = docs.where("text <> ''").select("doc_id", "part", "text", lines.alias("lines"))
    rows = rows.select("doc_id", "part", "text", F.transform("lines", lambda x: F.unhex(F.md5(x.cast("binary")))).alias("rank1"),
                       F.transform("lines", lambda x: F.length(F.trim(x))).alias("chars"))
    lengths = [length] if chars is None else [*range(1, length), length]
    k = 1
    while 2 * k <= length:
        rows = rows.withColumn(f"rank{2 * k}", paired(F.col(f"rank{k}"), k))
        k *= 2

    def windows(n: int) -> Column:
        half = 1 << (n.bit_length() - 1)
        ranks = F.col(f"rank{half}") if half == n else paired(F.col(f"rank{half}"), n - half)
        total = lambda i, m: F.aggregate(F.slice("chars", i + 1, m), F.lit(0), lambda a, b: a + b)
        found = F.transform(ranks, lambda r, i: F.struct(
            i.cast("long").alias("start"), F.lit(n).alias("n"), r.alias("rank"), F.lit(n).cast("long").alias("size"),
            (total(i, n) > 0 if n == length else (total(i, n) >= chars) & (
                F.lit(True) if n == 1 else (total(i, n - 1) < chars) | (total(i + 1, n - 1) < chars))).alias("counts")))
        return F.filter(found, lambda w: w["counts"])

    found = [windows(n) for n in lengths]
    if copies:
        found.append(F.when(F.exists("chars", lambda c: c > 0), F.array(F.struct(
            F.lit(0).cast("long").alias("start"), F.lit(0).alias("n"), F.unhex(F.md5(F.col("text").cast("binary"))).alias("rank"),
            F.size("chars").cast("long").alias("size"), F.lit(True).alias("counts")))))
    rows = rows.select("doc_id", "part", F.explode(F.flatten(F.filter(F.array(*found), lambda x: x.isNotNull()))).alias("r"))
    return rows.select("doc_id", "part", "r.start", "r.n", "r.rank", "r.size")


def repeated_runs(docs: DataFrame, length: int, chars: int | None, copies: bool) -> DataFrame:
    """``doc_id, part, start, stop``: maximal runs of lines covered by runs that count and also start earlier."""
    ranks = cut_lineage(run_ranks(docs, length, chars, copies))
    place = F.struct("doc_id", "part", "start")
    first = ranks.groupBy("n", "rank").agg(F.min(place).alias("first"), F.count("*").alias("times")).where("times > 1")
    later = ranks.join(first, ["n", "rank"]).where(place > F.col("first"))
    later = later.groupBy("doc_id", "part", "start").agg(F.max(F.col("start") + F.col("size")).alias("stop"))
    before = Window.partitionBy("doc_id", "part").orderBy("start")
    reach = F.max("stop").over(before.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce(F.col("start") > reach, F.lit(True)).cast("int")
    runs = later.withColumn("new", new).withColumn("run", F.sum("new").over(before))
    return runs.groupBy("doc_id", "part", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("run")


def line_dedup(docs: DataFrame, length: int = 3, chars: int | None = None, copies: bool = False) -> DataFrame:
    """Delete every line covered by a run of lines that counts and also starts earlier (smaller doc_id, or same document).

    A run counts if it has ``length`` lines and some text, or (``chars`` given) fewer lines with ``chars`` characters,
    spaces around lines left out. With ``copies`` a text with more than blank lines that equals an earlier one
    goes whole, however short it is.

    Returns ``doc_id, n_lines, n_removed, n_runs, longest_run, kept`` (kept lines joined by line feeds). An empty or null
    text has no lines, an empty table gives no rows; a line feed at the end leaves an empty last line. Rows that repeat an
    id and its text are one document: equal (id, start) never removes itself. Different texts of one id are documents of
    their own, in the order of their digests; a null id sorts before all others.
    """
    docs = numbered(id_and_text(docs))
    runs = repeated_runs(docs, length, chars, copies).groupBy("doc_id", "part").agg(
        F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("runs"))
    rows = docs.join(runs, ["doc_id", "part"], "left").select(
        "doc_id", F.when(F.col("text") == "", F.array().cast("array<string>")).otherwise(F.split("text", "\n", -1)).alias("lines"),
        F.coalesce("runs", F.array().cast("array<struct<start:bigint,stop:bigint>>")).alias("runs"))
    n = F.size("lines").cast("long")
    begins = F.concat(F.array(F.lit(0).cast("long")), F.transform("runs", lambda r: r["stop"]))
    ends = F.concat(F.transform("runs", lambda r: r["start"]), F.array(n))
    pieces = F.filter(F.arrays_zip(begins.alias("a"), ends.alias("b")), lambda p: p["b"] > p["a"])
    kept = F.array_join(F.transform(pieces, lambda p: F.array_join(
        F.slice("lines", (p["a"] + 1).cast("int"), (p["b"] - p["a"]).cast("int")), "\n")), "\n")
    sizes = F.transform("runs", lambda r: r["stop"] - r["start"])
    return rows.select(
        given_id(), n.alias("n_lines"),
        F.aggregate(sizes, F.lit(0).cast("long"), lambda a, b: a + b).alias("n_removed"), F.size("runs").cast("long").alias("n_runs"),
        F.coalesce(F.array_max(sizes), F.lit(0).cast("long")).alias("longest_run"), kept.alias("kept"))
