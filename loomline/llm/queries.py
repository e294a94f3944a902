"""The registered queries of the subpackage: each operator over its whole table, with its digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm import brown, decontaminate, hilbert_ann, langid, line_dedup, mixing, quality, secrets, simhash, suffix_dedup
from loomline.llm.common import table


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_hilbert_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_ann.search(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 100 == 0)


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(table(spark, sf_dir, "documents", "doc_id", "text"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


#: Shares of the tokens after mixing.
MIX_TARGETS = {"clean": 0.85, "poor": 0.12, "toxic": 0.03}


def op5_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = mixing.label_domains(table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))
    return mixing.rates(table(spark, sf_dir, "documents", "doc_id", "text"), labelled, MIX_TARGETS)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents", "doc_id", "text"))
    return kept.select("doc_id", F.col("__ll_lines").alias("n_lines"), F.col("__ll_dropped").alias("n_dropped"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality"))


def op8_brown_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score_held_out(table(spark, sf_dir, "documents", "doc_id", "text"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents", "doc_id", "text"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))


QUERIES = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_hilbert_ann": op2_hilbert_ann,
    "op3_suffix_array_dedup": op3_suffix_array_dedup,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_soft_mixing": op5_soft_mixing,
    "op6_line_dedup": op6_line_dedup,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_brown_lm_scoring": op8_brown_lm_scoring,
    "op9_secret_scan": op9_secret_scan,
    "op10_language_id": op10_language_id,
}

def _sql_hits(kind: int, pattern: str, group: int = 0, fine: str = "true") -> str:
    """Matches of a pattern in ``docs``: place, the gap before, own length, and whether the value is fine."""
    p = "'" + pattern.replace("'", "''") + "'"
    return f"""SELECT r, {kind} AS k, i, length(gaps[i]) AS gap, length(hits[i]) AS size, {fine} AS fine
  FROM (SELECT r, gaps, hits, vals, unnest(generate_series(1, len(hits))) AS i
    FROM (SELECT r, regexp_split_to_array(t, {p}) AS gaps, regexp_extract_all(t, {p}) AS hits, regexp_extract_all(t, {p}, {group}) AS vals FROM docs WHERE regexp_matches(t, {p})))"""


#: A weak secret is a whole run of these characters that is long and mixed enough.
_RUN, _MIXED = "[A-Za-z0-9+/_-]+", "length(hits[i]) >= 16 AND regexp_matches(hits[i], '[0-9]') AND regexp_matches(hits[i], '[A-Z]') AND regexp_matches(hits[i], '[a-z]')"
_HITS = " UNION ALL ".join(
    [
        _sql_hits(0, secrets.ASSIGN, 2, "length(vals[i]) >= 6"),
        *(_sql_hits(k, p) for k, p in ((1, secrets.ACCESS), (2, secrets.HEX), (3, secrets.IDENTIFIER), (5, secrets.ENDPOINT))),
        _sql_hits(4, _RUN, 0, _MIXED),
    ]
)
_NAMED = "list_value(" + ", ".join(f"'{k}'" for k in secrets.KINDS) + ")[k + 1] || ':' || s || ':' || e"
_EARLIER, _LATER = (f"OVER (PARTITION BY r ORDER BY s{x}, k{x}, e{x} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)" for x in ("", " DESC"))


def _sql_near(kinds: str) -> str:
    return f"(coalesce(s - max(CASE WHEN k IN {kinds} THEN e END) {_EARLIER} <= {secrets.REACH}, false) OR coalesce(min(CASE WHEN k IN {kinds} THEN s END) {_LATER} - e <= {secrets.REACH}, false))"


ORACLE_SQL = {
    "op9_secret_scan": f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
hit AS ({_HITS}),
placed AS (SELECT r, k, size, fine, (sum(gap + size) OVER (PARTITION BY r, k ORDER BY i))::BIGINT AS e FROM hit),
part AS (SELECT r, k, e - size AS s, e FROM placed WHERE fine),
linked AS (
  SELECT r, k, s, e, {_sql_near('(1, 3)')} AS ident, {_sql_near('(0, 2, 4)')} AS secret,
    coalesce(max(CASE WHEN k <= 2 THEN e END) {_EARLIER} <= s, true) AND coalesce(min(CASE WHEN k <= 2 THEN s END) {_LATER} >= e, true) AS apart
  FROM part),
kept AS (SELECT * FROM linked WHERE k <= 2 OR (apart AND CASE k WHEN 3 THEN secret WHEN 4 THEN ident ELSE ident AND secret END))
SELECT any_value(doc_id) AS doc_id, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex,
  sha256(coalesce(string_agg({_NAMED}, ',' ORDER BY s, k, e) FILTER (WHERE k <= 2), '')) AS base_sha256,
  coalesce(string_agg({_NAMED}, ',' ORDER BY s, k, e), '') AS spans
FROM docs LEFT JOIN kept USING (r) GROUP BY r
""",
    "op3_suffix_array_dedup": r"""
WITH texts AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS (SELECT doc_id, h, unnest(generate_series(0, length(h) // 2 - 50)) AS pos FROM texts WHERE length(h) >= 100),
strings AS (SELECT doc_id, pos, substr(h, (2 * pos + 1)::BIGINT, 100) AS s FROM windows),
firsts AS (SELECT s, min(doc_id) AS first FROM strings GROUP BY s HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT strings.doc_id, pos FROM strings JOIN firsts ON strings.s = firsts.s WHERE first < strings.doc_id),
near AS (SELECT doc_id, pos, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM gone),
runs AS (SELECT doc_id, pos, sum(CASE WHEN before IS NULL OR pos - before > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM near),
spans AS (SELECT doc_id, run, min(pos) AS a, max(pos) + 50 AS b FROM runs GROUP BY doc_id, run),
cuts AS (SELECT doc_id, run, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY run) AS last_b FROM spans),
sums AS (
  SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS b,
         string_agg(substr(h, (2 * last_b + 1)::BIGINT, (2 * (a - last_b))::BIGINT), '' ORDER BY run) AS kept
  FROM cuts JOIN texts USING (doc_id) GROUP BY doc_id)
SELECT t.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN s.doc_id IS NULL THEN h ELSE s.kept || substr(h, (2 * s.b + 1)::BIGINT) END)) AS kept_sha256
FROM texts t LEFT JOIN sums s ON t.doc_id = s.doc_id
""",
    "op4_benchmark_decontamination": r"""
WITH doc_words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
item_words AS (
  SELECT row_number() OVER () AS item, item_id, w, least(5, len(w)) AS k FROM (
    SELECT DISTINCT item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM benchmark WHERE text IS NOT NULL)),
sizes AS (SELECT DISTINCT k FROM item_words WHERE k > 0),
doc_shingles AS (
  SELECT doc_id, k, len(w) - k + 1 AS n, pos, array_to_string(list_slice(w, pos + 1, pos + k), ' ') AS s
  FROM (SELECT doc_id, k, w, unnest(generate_series(0, len(w) - k)) AS pos FROM doc_words CROSS JOIN sizes WHERE len(w) >= k)),
item_positions AS (
  SELECT item, item_id, k, len(w) - k + 1 AS m, array_to_string(list_slice(w, pos + 1, pos + k), ' ') AS s
  FROM (SELECT item, item_id, k, w, unnest(generate_series(0, len(w) - k)) AS pos FROM item_words WHERE k > 0)),
item_shingles AS (SELECT item, item_id, k, m, s, count(*) AS c FROM item_positions GROUP BY ALL),
hits AS (SELECT DISTINCT d.doc_id, i.item, i.k, i.m, least(i.m, d.n) AS size, d.n, d.pos FROM doc_shingles d JOIN item_shingles i ON d.s = i.s AND d.k = i.k),
starts AS (
  SELECT DISTINCT doc_id, item, k, m, size, start FROM (
    SELECT *, unnest(generate_series(greatest(0, pos - size + 1), least(pos, n - size))) AS start FROM hits)),
counted AS (
  SELECT x.doc_id, x.item, x.m, x.size, x.start, d.s, count(*) AS c
  FROM starts x JOIN doc_shingles d ON d.doc_id = x.doc_id AND d.k = x.k AND d.pos >= x.start AND d.pos < x.start + x.size
  GROUP BY ALL),
shared AS (
  SELECT x.doc_id, i.item_id, x.m, x.size, x.start, sum(least(x.c, i.c)) AS met
  FROM counted x JOIN item_shingles i ON x.item = i.item AND x.s = i.s GROUP BY x.doc_id, x.item, i.item_id, x.m, x.size, x.start),
scored AS (SELECT doc_id, item_id, start, (met / (m + size - met))::DOUBLE AS similarity FROM shared),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) AS r FROM scored WHERE similarity >= 0.8)
SELECT doc_id, item_id, start::BIGINT AS first_word, similarity FROM best WHERE r = 1
""",
    "op6_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
repeated AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT k.doc_id, k.pos, k.line, (r.key IS NOT NULL AND k.doc_id <> r.keeper) AS gone
  FROM keyed k LEFT JOIN repeated r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
}
