"""URL filters: rules first, then trust and distrust that flow along links between hosts. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path); the longest that fits wins
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: whole-number arithmetic: the mass of a fully trusted host, the grain of link shares
UNIT, GRAIN = 1_000_000_000, 1 << 20
#: mass that may still reach any host when the rounds end, as parts of the block threshold
FINE = 1000
LINK = r"""(?i)(?:href|src)\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for null and where there is no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, or nulls; of equally long ones a blocking one."""
    name = verdict = F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "block")):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name, verdict = F.when(fits, rule_host + rule_path).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def host_links(pages: DataFrame) -> DataFrame:
    """``source, target, links``: pages of a host that link to another host, each page once."""
    links = F.array_distinct(F.transform(
        F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1)), lambda u: F.translate(u, UPPER, LOWER)))
    return pages.where("host <> ''").select(F.col("host").alias("source"), F.explode(links).alias("target")).where(
        "target <> source").groupBy("source", "target").agg(F.count("*").alias("links"))


def share_of(value: str, part: str, whole: int) -> str:
    """``value * part div whole`` in SQL, for values whose product with ``part`` has no room in 64 bits."""
    return f"(({value}) div {whole} * {part} + ({value}) % {whole} * {part} div {whole})"


def propagate(seeds: DataFrame, edges: DataFrame, keep: int, open_mass: int) -> DataFrame:
    """Personalised PageRank in whole numbers: ``host, mass``. Each round a host gets ``keep`` hundredths of its seed and
    the rest of what flows in. ``edges``: ``source, target, links``; ``seeds``: ``host, seed``, all hosts.

    Mass only grows from the kept seed on, and what all hosts gain in a round is at most 1 - ``keep`` hundredths of what
    they gained in the round before: rounds end when all that is still to come is ``open_mass`` or less for all hosts together.
    """
    out = edges.groupBy("source").agg(F.sum("links").alias("all_links"))
    shares = cut_lineage(edges.join(out, "source").select("source", "target", F.expr(f"links * {GRAIN} div all_links").alias("share")))
    mass = seeds.select("host", F.expr(f"seed * {keep} div 100").alias("mass"))
    while True:
        sent = shares.join(mass, shares["source"] == mass["host"]).select("target", F.expr(share_of("mass", "share", GRAIN)).alias("sent"))
        flow = sent.groupBy(F.col("target").alias("host")).agg(F.sum(F.expr(share_of("sent", f"{100 - keep}", 100))).alias("flow"))
        mass = cut_lineage(seeds.join(flow, "host", "left").join(mass.withColumnRenamed("mass", "was"), "host").select(
            "host", "was", (F.expr(f"seed * {keep} div 100") + F.coalesce("flow", F.lit(0))).alias("mass")))
        gain = mass.agg(F.sum((F.col("mass") - F.col("was")).cast("decimal(38,0)"))).first()[0] or 0
        mass = mass.select("host", "mass")
        if gain * (100 - keep) <= open_mass * keep:
            return mass


def judge_urls(pages: DataFrame, rules=RULES, keep: int = 15, threshold: int = 50) -> DataFrame:
    """``page_id, host, path, rule, verdict, trust, distrust`` of every page.

    A rule decides where one fits. Elsewhere the host does: trust starts from hosts by the share of their pages that a
    rule allows and flows along links; distrust starts from the share that a rule blocks and flows against them (a host
    that links to blocked ones is suspect). A host is blocked if its distrust is greater than its trust and at least
    ``threshold`` hundredths of what a wholly blocked host has without any links. Both flow until what is still to come is
    less than a thousandth of that, however long the paths. Pages without a host are allowed; null html has no
    links; repeated rows count as pages of their own.
    """
    host, path = url_parts(F.col("url"))
    named = pages.select("page_id", "html", host.alias("host"), path.alias("path"))
    edges = cut_lineage(host_links(named))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = named.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))
    counts = ruled.where("host <> ''").groupBy("host").agg(
        F.count("*").alias("pages"), F.count(F.when(F.col("verdict") == "allow", 1)).alias("allowed"),
        F.count(F.when(F.col("verdict") == "block", 1)).alias("blocked"))
    hosts = counts.select("host").union(edges.select("target")).distinct()
    seeds = cut_lineage(hosts.join(counts, "host", "left").select(
        "host", F.coalesce(F.expr(f"allowed * {UNIT} div pages"), F.lit(0)).alias("allow"),
        F.coalesce(F.expr(f"blocked * {UNIT} div pages"), F.lit(0)).alias("block")))
    reverse = edges.select(F.col("target").alias("source"), F.col("source").alias("target"), "links")
    limit = UNIT * keep * threshold // 10_000
    trust = propagate(seeds.select("host", F.col("allow").alias("seed")), edges, keep, limit // FINE)
    distrust = propagate(seeds.select("host", F.col("block").alias("seed")), reverse, keep, limit // FINE)
    scores = cut_lineage(trust.withColumnRenamed("mass", "trust").join(distrust.withColumnRenamed("mass", "distrust"), "host"))
    bad = (F.col("distrust") > F.col("trust")) & (F.col("distrust") >= limit)
    return ruled.join(scores, "host", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", F.when(bad, "block").otherwise("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0)).alias("trust"), F.coalesce("distrust", F.lit(0)).alias("distrust"))
