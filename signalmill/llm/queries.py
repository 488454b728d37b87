"""The registered query of each operator: it applies the operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op3_suffix_dedup")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes of ``documents`` covered by 100-byte strings that also start earlier are removed."""
    from .suffixes import suffix_dedup

    found = suffix_dedup(table(spark, folder, "documents"), length=100)
    return found.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


@query("op6_token_files")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    """``documents`` as token files, read back."""
    import public_tokenizers

    from .tokens import read_token_files, token_files

    written = token_files(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read_token_files(spark, written)


@query("op7_substring_dedup")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """Words of ``documents`` covered by windows of 20 words that also start earlier are removed."""
    from .substrings import kept_digest, substring_dedup

    return kept_digest(substring_dedup(table(spark, folder, "documents"), size=20))


@query("op8_jaccard_join")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of ``documents`` that sets of 4-word shingles with a similarity of 0.85 or more link."""
    from .jaccard import jaccard_join

    return jaccard_join(table(spark, folder, "documents"), words=4, percent=85)


@query("op2_weighted_fingerprints")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of ``documents`` and of their edited texts."""
    from .fingerprints import edited_fingerprints

    return edited_fingerprints(table(spark, folder, "documents"), samples=64)


@query("op5_quality_classifier")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of ``documents`` as learned from ``labels`` outside the held-out fold."""
    from .quality import score_quality

    return score_quality(table(spark, folder, "documents"), table(spark, folder, "labels"), threshold=0.3, most_rows=20_000)


@query("op9_template_decontamination")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """Items of ``benchmark`` in ``documents``."""
    from .templates import find_leaks

    return find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


#: the tree of the mixture: sources with one-digit numbers are one domain, all others the other
DOMAIN = "CASE WHEN length(source) <= 4 THEN 'primary' ELSE 'secondary' END"
WEIGHTS = {"domain": {"primary": 1, "secondary": 3}, "lang": {"en": 4, "de": 2, "fr": 2}, "source": {"src0": 2, "src12": 3}}


def _levels_sql(percent: int, epochs: int) -> str:
    out, parent = [], "root"
    for i, level in enumerate(("domain", "lang", "source")):
        names = ", ".join(("domain", "lang", "source")[: i + 1])
        weight = "CASE " + level + "".join(f" WHEN '{k}' THEN {v}" for k, v in WEIGHTS[level].items()) + " ELSE 1 END"
        up = f"q{i - 1}" if i else "root"
        using = parent
        out.append(f"""c{i} AS (SELECT 0 AS root, {names}, CAST(sum(cap) AS BIGINT) AS cap FROM leaves GROUP BY ALL),
w{i} AS (SELECT *, {weight} AS weight FROM c{i} JOIN {up} USING ({using})),
s{i} AS (SELECT *, quota - coalesce(sum(cap) OVER below, 0) AS remaining,
    sum(weight) OVER (PARTITION BY {using}) - coalesce(sum(weight) OVER below, 0) AS rest FROM w{i}
  WINDOW below AS (PARTITION BY {using} ORDER BY cap / weight, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f{i} AS (SELECT *, cap * rest <= weight * remaining AS is_full FROM s{i}),
q{i} AS (SELECT root, {names}, CAST(CASE WHEN is_full THEN cap ELSE
    (weight * (quota - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER (PARTITION BY {using})))
    // sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER (PARTITION BY {using}) END AS BIGINT) AS quota FROM f{i})""")
        parent = f"root, {names}"
    return ",\n".join(out)


OP1_SQL = f"""WITH docs AS (
  SELECT doc_id, {DOMAIN} AS domain, lang, source, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS n_tokens FROM documents),
leaves AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(sum(n_tokens) AS BIGINT) * 4 AS cap FROM docs GROUP BY ALL),
root AS (SELECT 0 AS root, CAST(least(sum(tokens) * 60 // 100, sum(cap)) AS BIGINT) AS quota FROM leaves),
{_levels_sql(60, 4)},
plan AS (SELECT domain, lang, source, quota, CASE WHEN tokens > 0 THEN quota // tokens ELSE 0 END AS full_epochs,
    CASE WHEN tokens > 0 THEN quota % tokens ELSE quota END AS open FROM leaves JOIN q2 USING (domain, lang, source)),
ordered AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('7|' || full_epochs || '|' || doc_id), doc_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n_tokens AS start FROM docs JOIN plan USING (domain, lang, source))
SELECT doc_id, domain, lang, source, epoch, CAST(n_tokens AS BIGINT) AS n_tokens, CAST(CASE WHEN epoch < full_epochs THEN n_tokens
    ELSE least(n_tokens, open - start) END AS BIGINT) AS taken_tokens
FROM (SELECT *, unnest(range(full_epochs + CASE WHEN start < open THEN 1 ELSE 0 END)) AS epoch FROM ordered)"""


@query("op1_mix_sources", OP1_SQL)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """Six tenths of the words of ``documents``, mixed by domain, language and source."""
    from .mixing import mix_sources

    return mix_sources(table(spark, folder, "documents"), F.expr(DOMAIN), WEIGHTS, percent=60, epochs=4, seed=7)


OP10_SQL = """WITH l AS (
  SELECT doc_id, text, CASE WHEN coalesce(text, '') = '' THEN []::VARCHAR[] ELSE string_split(text, chr(10)) END AS lines FROM documents),
c AS (SELECT doc_id, lines, list_transform(lines, lambda x: length(trim(x, ' '))) AS c FROM l),
i AS (SELECT doc_id, lines, c, unnest(range(len(lines))) AS i FROM c),
w AS (SELECT doc_id, CAST(i AS BIGINT) AS start, 3 AS n, 3 AS size, array_to_string(list_slice(lines, i + 1, i + 3), chr(10)) AS run
    FROM i WHERE i + 3 <= len(lines) AND c[i + 1] + c[i + 2] + c[i + 3] > 0
  UNION ALL SELECT doc_id, i, 2, 2, lines[i + 1] || chr(10) || lines[i + 2]
    FROM i WHERE i + 2 <= len(lines) AND c[i + 1] + c[i + 2] >= 200 AND (c[i + 1] < 200 OR c[i + 2] < 200)
  UNION ALL SELECT doc_id, i, 1, 1, lines[i + 1] FROM i WHERE c[i + 1] >= 200
  UNION ALL SELECT doc_id, 0, 0, len(lines), text FROM l WHERE trim(replace(text, chr(10), ''), ' ') <> ''),
later AS (SELECT doc_id, start, size FROM (
  SELECT doc_id, start, size, row_number() OVER (PARTITION BY n, run ORDER BY doc_id, start) AS k FROM w) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(start, start + size)) AS i FROM later),
runs AS (SELECT doc_id, count(*) AS size FROM (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM gone)
  GROUP BY doc_id, k),
per AS (SELECT doc_id, CAST(sum(size) AS BIGINT) AS n_removed, count(*) AS n_runs, max(size) AS longest_run FROM runs GROUP BY doc_id),
kept AS (SELECT u.doc_id, string_agg(line, chr(10) ORDER BY u.i) AS text
  FROM (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM l) u ANTI JOIN gone USING (doc_id, i) GROUP BY u.doc_id)
SELECT l.doc_id, CAST(len(lines) AS BIGINT) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_runs, 0) AS n_runs,
  coalesce(longest_run, 0) AS longest_run, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM l LEFT JOIN per USING (doc_id) LEFT JOIN kept USING (doc_id)"""


@query("op10_line_runs", OP10_SQL)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    """Later copies of runs of three lines or 200 characters or more, and of whole texts, of ``documents`` are deleted."""
    from .lines import line_dedup

    found = line_dedup(table(spark, folder, "documents"), length=3, chars=200, copies=True)
    return found.withColumn("kept_sha256", F.sha2(F.col("kept").cast("binary"), 256)).drop("kept")


def _op4_sql(rounds: int = 10) -> str:
    """Rules, links and the rounds of both propagations written out; the constants are those of ``hosts``."""
    from .hosts import GRAIN, LINK, LOWER, RULES, UNIT, UPPER

    cases = " ".join(
        f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') THEN '{h + p}|{v}'"
        for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2])))
    link = LINK.replace("'", "''")
    text = f"""WITH rest AS (SELECT page_id, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
hosts0 AS (SELECT page_id, html, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM rest),
named AS (SELECT page_id, html, translate(raw, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM hosts0),
ruled AS (SELECT page_id, host, path, CASE {cases} END AS hit FROM named),
links AS (SELECT row_number() OVER () AS page, host, unnest(regexp_extract_all(coalesce(html, ''), '{link}', 1)) AS u FROM named WHERE host <> ''),
edges AS MATERIALIZED (SELECT host AS source, target, count(*) AS links FROM (
    SELECT DISTINCT page, host, translate(u, '{UPPER}', '{LOWER}') AS target FROM links) WHERE target <> host GROUP BY ALL),
counts AS (SELECT host, count(*) AS pages, count(*) FILTER (hit LIKE '%|allow') AS allowed, count(*) FILTER (hit LIKE '%|block') AS blocked
  FROM ruled WHERE host <> '' GROUP BY host),
seeds AS MATERIALIZED (SELECT host, coalesce(allowed * {UNIT} // pages, 0) AS allow, coalesce(blocked * {UNIT} // pages, 0) AS block
  FROM (SELECT host FROM counts UNION SELECT target FROM edges) LEFT JOIN counts USING (host)),
forth AS MATERIALIZED (SELECT source, target, CAST(links * {GRAIN} // sum(links) OVER (PARTITION BY source) AS BIGINT) AS share FROM edges),
back AS MATERIALIZED (SELECT target AS source, source AS target, CAST(links * {GRAIN} // sum(links) OVER (PARTITION BY target) AS BIGINT) AS share FROM edges),
t0 AS (SELECT host, allow AS mass FROM seeds), d0 AS (SELECT host, block AS mass FROM seeds)"""
    for k in range(1, rounds + 1):
        for name, seed, edges in (("t", "allow", "forth"), ("d", "block", "back")):
            text += f""",
{name}{k} AS MATERIALIZED (SELECT host, CAST({seed} * 15 // 100 + coalesce(flow, 0) AS BIGINT) AS mass FROM seeds LEFT JOIN (
  SELECT e.target AS host, sum(mass * share // {GRAIN} * 85 // 100) AS flow FROM {edges} e JOIN {name}{k - 1} m ON e.source = m.host GROUP BY ALL) USING (host))"""
    return text + f"""
SELECT page_id, r.host, path, CASE WHEN hit IS NOT NULL THEN split_part(hit, '|', 1) END AS rule,
  CASE WHEN hit IS NOT NULL THEN split_part(hit, '|', 2) WHEN d.mass > t.mass AND d.mass >= {UNIT * 15 * 50 // 10_000} THEN 'block' ELSE 'allow' END AS verdict,
  coalesce(t.mass, 0) AS trust, coalesce(d.mass, 0) AS distrust
FROM ruled r LEFT JOIN t{rounds} t ON r.host = t.host LEFT JOIN d{rounds} d ON r.host = d.host"""


@query("op4_link_trust", _op4_sql())
def op4(spark: SparkSession, folder: str) -> DataFrame:
    """Rules and host trust for ``pages``."""
    from .hosts import judge_urls

    return judge_urls(table(spark, folder, "pages"))


@query("op11_token_counts")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of ``documents`` by byte-pair merging, and the texts with more than 512."""
    import public_tokenizers

    from .token_counts import token_counts

    return token_counts(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


OP12_SQL = """WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
d AS (SELECT doc_id, part,
    CASE WHEN len(words) < 50 THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS fails FROM t),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
cells AS (SELECT part, fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM d LEFT JOIN l USING (doc_id) GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a, f b, f c, f d, f e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, step, substr(filter_order, step, 1) AS letter, substr(filter_order, 1, step - 1) AS done
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
marked AS (SELECT part, filter_order, step, letter, n, good, toxic, fails = letter AS alone, contains(fails, letter) AS fail,
    done <> '' AND regexp_matches(fails, '[' || done || '0]') AS gone FROM cells, steps),
audit AS (SELECT part, filter_order, step, letter, coalesce(sum(n) FILTER (NOT gone AND NOT fail), 0) AS kept,
    coalesce(sum(n) FILTER (NOT gone AND fail), 0) AS removed, coalesce(sum(n) FILTER (gone AND fail), 0) AS redundant,
    coalesce(sum(n) FILTER (alone), 0) AS unique_fails, coalesce(sum(good) FILTER (NOT gone AND fail), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (NOT gone AND fail), 0) AS toxic_lost FROM marked GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM audit"""


@query("op12_filter_audit", OP12_SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    """Five filters over ``documents`` in all 120 orders, by source."""
    from .filter_audit import audit_filters

    return audit_filters(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op13_periodic_runs")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of 24 words or more with three periods or more in ``documents``, a tenth of which have a periodic end."""
    from .periodic import periodic_runs, planted, run_digests

    return run_digests(periodic_runs(planted(table(spark, folder, "documents")), least=24, times=3))
