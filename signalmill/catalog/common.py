"""SQL text of the series adapters, shared by the checks."""

SIG_LINE = """sig_line AS (
  SELECT l_suppkey AS track_id,
         row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey,
           l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) - 1 AS frame_ix,
         l_quantity / 50.0 AS l, l_discount * 20.0 - 1.0 AS r
  FROM lineitem)"""

LONG_LINE = SIG_LINE + """,
long_line AS (
  SELECT track_id, 0 AS ch, frame_ix, l AS x FROM sig_line
  UNION ALL SELECT track_id, 1 AS ch, frame_ix, r AS x FROM sig_line)"""

VECS = """vecs AS (
  SELECT CAST(label AS BIGINT) AS track_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS window_ix,
         list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS e
  FROM embeddings)"""

SIG_EMBED = VECS + """,
sig_embed AS (
  SELECT track_id, window_ix * 32 + i AS frame_ix, e[i + 1] AS l, e[i + 33] AS r
  FROM vecs, (SELECT unnest(range(32)) AS i))"""

EMBED_MONO = VECS + """,
embed_mono AS (
  SELECT track_id, 0 AS ch, window_ix * 64 + i AS frame_ix, e[i + 1] AS x
  FROM vecs, (SELECT unnest(range(64)) AS i))"""

SIG_EVENT = """sig_event AS (
  SELECT event_type AS source, user_id, event_id, ts, epoch_us(ts) / 1e6 AS t, value / 500.0 AS x FROM events)"""

ALB = """alb AS (
  SELECT o_custkey AS album_id,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS track_index,
         'order ' || o_orderkey AS title,
         CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN -80.0 ELSE -30 + o_totalprice / 20000 END AS input_lufs,
         CASE WHEN o_orderstatus = 'F' THEN -14 + o_totalprice / 250000 ELSE -80.0 END AS master_lufs,
         -1 - o_totalprice / 500000 AS master_true_peak,
         CASE WHEN o_orderstatus = 'P' THEN 'Error' ELSE 'Ready' END AS status
  FROM orders)"""

STUDY = """study AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS track_id, lang AS category, quality = 1 AS already_good,
         d.doc_id % 7 <> 0 AS guidance_applied,
         CASE d.doc_id % 3 WHEN 0 THEN 'guided' WHEN 1 THEN 'stereo' ELSE 'tie' END AS preference,
         toxic = 1 AS artifact_audible, d.doc_id % 11 = 0 AS transient_damage, d.doc_id % 13 = 0 AS mono_worse,
         false AS image_worse, false AS sections_worse, n_chars % 17 = 0 AS tonal_side_effect
  FROM documents d JOIN labels USING (doc_id))"""


def rd(expr: str, digits: int = 6) -> str:
    """Rounded output without a negative zero."""
    return f"CAST(round({expr}, {digits}) + 0.0 AS DOUBLE)"


# pseudo-measurements per order: u1..u14 in 0..1 from the order's key and price, k from the customer
PRIMES = (101, 211, 307, 401, 503, 601, 701, 809, 907, 613, 419, 331, 223, 127)
MET = "met0 AS (SELECT o_orderkey AS track_id, o_custkey, " + ", ".join(
    f"((o_orderkey * {p} + CAST(floor(o_totalprice) AS BIGINT)) % 1009) / 1009.0::DOUBLE AS u{i + 1}" for i, p in enumerate(PRIMES)
) + " FROM orders)"
