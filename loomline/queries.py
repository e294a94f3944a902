"""The registered queries of the engine's own operators, each over whole tables, with DuckDB SQL where it can express them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions import scalar
from loomline.functions.patterns import CANONICAL_INT, KEY_VALUE, KINDS, NORMAL_NAMES, NORMAL_ORDER, SIMPLE
from loomline.functions.codecs import varint_bytes, varint_longs
from loomline.operators import chunks, columns, metrics, structure, templates
from loomline.plans import archive
from loomline.session import cut, shared_folder
from loomline.sources.corpora import rows_as_files, table_lines
from loomline.streaming import counts as streaming

CORPORA = ("documents", "pages", "events", "conversations")
#: What joins arrays in results, as arrays aren't compared.
SEP = "\x01"
QUERIES = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# ---- lines and templates ---------------------------------------------------------------------------------------

_LINES = {
    "documents": "SELECT doc_id AS file_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line_index, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents",
    "pages": "SELECT page_id AS file_id, generate_subscripts(string_split(coalesce(html, ''), chr(10)), 1) - 1 AS line_index, unnest(string_split(coalesce(html, ''), chr(10))) AS line FROM pages",
    "events": "SELECT ascii(event_type)::BIGINT AS file_id, event_id AS line_index, coalesce(props, '') AS line FROM events",
    "conversations": "SELECT conv_id AS file_id, turn AS line_index, coalesce(text, '') AS line FROM conversations",
}
_ALL_LINES = "lines AS (" + " UNION ALL ".join(f"SELECT '{c}' AS corpus, * FROM ({s})" for c, s in _LINES.items()) + ")"
_RE = _q(f"({SIMPLE})")
_TOKENS = f"{_ALL_LINES}, tokens AS (SELECT *, array_to_string(regexp_split_to_array(line, {_q(SIMPLE)}), chr(1)) AS parts, regexp_extract_all(line, {_RE}, 1) AS vals FROM lines)"
_COUNTS = f"{_TOKENS}, counts AS (SELECT corpus, parts, count(*) AS n, min(struct_pack(f := file_id, l := line_index)) AS first FROM tokens GROUP BY ALL)"
_DICT = f"{_COUNTS}, dict AS (SELECT corpus, parts, n, first, row_number() OVER (PARTITION BY corpus ORDER BY first.f, first.l) - 1 AS tpl_id FROM counts WHERE n >= 2)"
_RECORDS = f"{_DICT}, records AS (SELECT t.corpus, t.file_id, t.line_index, d.tpl_id, CASE WHEN d.tpl_id IS NOT NULL THEN t.vals END AS vals, t.line, t.parts FROM tokens t LEFT JOIN dict d ON t.corpus = d.corpus AND t.parts = d.parts)"


def _per_corpus(f) -> DataFrame:
    return metrics.union_all([f(c).withColumn("corpus", F.lit(c)) for c in CORPORA])


def _tokens(spark: SparkSession, d: str, corpus: str) -> DataFrame:
    return templates.tokenize(table_lines(spark, d, corpus))


def _dictionary(spark: SparkSession, d: str, corpus: str) -> DataFrame:
    return templates.template_dictionary(templates.template_counts(_tokens(spark, d, corpus)))


def _tokens_and_dictionary(spark: SparkSession, d: str, corpus: str) -> tuple[DataFrame, DataFrame]:
    tokens = cut(_tokens(spark, d, corpus))
    return tokens, templates.template_dictionary(templates.template_counts(tokens))


def _records(spark: SparkSession, d: str, corpus: str) -> DataFrame:
    return templates.records(*_tokens_and_dictionary(spark, d, corpus))


def _joined(c: str):
    return F.array_join(c, SEP)


@query("q_lines", f"WITH {_ALL_LINES} SELECT corpus, file_id, line_index::BIGINT AS line_index, line FROM lines")
def q_lines(spark: SparkSession, d: str) -> DataFrame:
    return _per_corpus(lambda c: table_lines(spark, d, c).select("file_id", F.col("line_index").cast("long").alias("line_index"), "line"))


@query("q_legacy_template", f"WITH {_TOKENS} SELECT corpus, file_id, line_index::BIGINT AS line_index, parts, array_to_string(vals, chr(1)) AS vals FROM tokens")
def q_legacy_template(spark: SparkSession, d: str) -> DataFrame:
    return _per_corpus(lambda c: _tokens(spark, d, c).select("file_id", F.col("line_index").cast("long").alias("line_index"), _joined("parts").alias("parts"), _joined("values").alias("vals")))


@query("q_template_counts", f"WITH {_COUNTS} SELECT corpus, parts, n, first.f AS first_file, first.l::BIGINT AS first_line FROM counts")
def q_template_counts(spark: SparkSession, d: str) -> DataFrame:
    return _per_corpus(lambda c: templates.template_counts(_tokens(spark, d, c)).select(_joined("parts").alias("parts"), "n", "first_file", F.col("first_line").cast("long").alias("first_line")))


@query("q_template_dict", f"WITH {_DICT} SELECT corpus, tpl_id, parts, n FROM dict")
def q_template_dict(spark: SparkSession, d: str) -> DataFrame:
    return _per_corpus(lambda c: _dictionary(spark, d, c).select("tpl_id", _joined("parts").alias("parts"), "n"))


@query("q_records", f"WITH {_RECORDS} SELECT corpus, file_id, line_index::BIGINT AS line_index, tpl_id, array_to_string(vals, chr(1)) AS vals, CASE WHEN tpl_id IS NULL THEN line END AS raw FROM records")
def q_records(spark: SparkSession, d: str) -> DataFrame:
    return _per_corpus(lambda c: _records(spark, d, c).select("file_id", F.col("line_index").cast("long").alias("line_index"), "tpl_id", _joined("values").alias("vals"), F.col("line").alias("raw")))


@query("q_raw_lines", f"WITH {_DICT} SELECT corpus, file_id, line_index::BIGINT AS line_index, line FROM tokens t WHERE NOT EXISTS (SELECT 1 FROM dict d WHERE d.corpus = t.corpus AND d.parts = t.parts)")
def q_raw_lines(spark: SparkSession, d: str) -> DataFrame:
    return _per_corpus(lambda c: templates.raw_lines(*_tokens_and_dictionary(spark, d, c)).withColumn("line_index", F.col("line_index").cast("long")))


@query("q_templated_lines", f"WITH {_DICT} SELECT corpus, file_id, line_index::BIGINT AS line_index, line FROM tokens t WHERE EXISTS (SELECT 1 FROM dict d WHERE d.corpus = t.corpus AND d.parts = t.parts)")
def q_templated_lines(spark: SparkSession, d: str) -> DataFrame:
    return _per_corpus(lambda c: templates.templated_lines(*_tokens_and_dictionary(spark, d, c)).withColumn("line_index", F.col("line_index").cast("long")))


_RATES = f"{_RECORDS}, rates AS (SELECT corpus, file_id, count(*) AS n_lines, count(tpl_id) AS hits, count(*) - count(tpl_id) AS raw, coalesce(sum(len(vals)), 0)::BIGINT AS slots, count(tpl_id) / count(*) AS rate FROM records GROUP BY corpus, file_id)"
_REASONS = f"{_RATES}, reasons AS (SELECT *, CASE WHEN hits = 0 THEN 'no_templates' WHEN rate < 0.10 THEN 'low_structure' END AS reason FROM rates)"


@query("q_file_rates", f"WITH {_RATES} SELECT corpus, file_id, n_lines, hits, raw, slots, round(rate, 6) AS rate FROM rates")
def q_file_rates(spark: SparkSession, d: str) -> DataFrame:
    return _per_corpus(lambda c: templates.file_rates(_records(spark, d, c)).withColumn("rate", F.round("rate", 6)))


@query("q_fallback_reason", f"WITH {_REASONS} SELECT corpus, file_id, reason FROM reasons")
def q_fallback_reason(spark: SparkSession, d: str) -> DataFrame:
    return _per_corpus(lambda c: templates.fallback_reason(templates.file_rates(_records(spark, d, c))).select("file_id", "reason"))


@query("q_reason_counts", f"WITH {_REASONS} SELECT corpus, coalesce(reason, 'template') AS reason, count(*) AS n_files FROM reasons GROUP BY ALL")
def q_reason_counts(spark: SparkSession, d: str) -> DataFrame:
    return _per_corpus(lambda c: metrics.reason_counts(templates.fallback_reason(templates.file_rates(_records(spark, d, c)))))


@query("q_reuse_rate", f"WITH {_COUNTS} SELECT corpus, sum(n)::BIGINT AS n_lines, coalesce(sum(n) FILTER (WHERE n >= 2), 0)::BIGINT AS reused, round(coalesce(sum(n) FILTER (WHERE n >= 2), 0) / sum(n), 6) AS rate FROM counts GROUP BY corpus")
def q_reuse_rate(spark: SparkSession, d: str) -> DataFrame:
    return _per_corpus(lambda c: templates.reuse_rate(templates.template_counts(_tokens(spark, d, c))).withColumn("rate", F.round("rate", 6)))


@query(
    "q_metrics",
    f"""WITH {_REASONS} SELECT corpus, count(*) AS num_files, sum(n_lines)::BIGINT AS num_lines,
    coalesce(sum(hits) FILTER (WHERE reason IS NULL), 0)::BIGINT AS template_reuse_count, coalesce(sum(raw) FILTER (WHERE reason IS NULL), 0)::BIGINT AS raw_fallback_lines,
    coalesce(sum(slots) FILTER (WHERE reason IS NULL), 0)::BIGINT AS total_var_slots, count(reason) AS raw_files,
    count(*) FILTER (WHERE reason = 'low_structure') AS low_structure_fallback_files, count(*) FILTER (WHERE reason = 'no_templates') AS no_template_files,
    count(*) FILTER (WHERE reason = 'binary') AS binary_files, (SELECT count(*) FROM dict d WHERE d.corpus = r.corpus) AS num_shared_templates,
    round(coalesce(sum(hits) FILTER (WHERE reason IS NULL), 0) / sum(n_lines), 6) AS template_reuse_rate,
    round(coalesce(sum(slots) FILTER (WHERE reason IS NULL) / nullif(sum(hits) FILTER (WHERE reason IS NULL), 0), 0), 6) AS avg_vars_per_tpl_line
    FROM reasons r GROUP BY corpus""",
)
def q_metrics(spark: SparkSession, d: str) -> DataFrame:
    def one(c):
        tokens = cut(_tokens(spark, d, c))
        counts = cut(templates.template_counts(tokens))
        rates = templates.fallback_reason(templates.file_rates(templates.records(tokens, templates.template_dictionary(counts))))
        found = metrics.archive_metrics(rates, counts)
        return found.withColumns({n: F.round(n, 6) for n in ("template_reuse_rate", "avg_vars_per_tpl_line")})

    return _per_corpus(one)


@query("q_rebuild", f"WITH {_ALL_LINES} SELECT corpus, file_id, line_index::BIGINT AS line_index, line FROM lines")
def q_rebuild(spark: SparkSession, d: str) -> DataFrame:
    def one(c):
        tokens = cut(_tokens(spark, d, c))
        dictionary = templates.template_dictionary(templates.template_counts(tokens))
        return templates.restored(templates.records(tokens, dictionary), dictionary).withColumn("line_index", F.col("line_index").cast("long"))

    return _per_corpus(one)


@query("q_roundtrip_check", "SELECT doc_id AS file_id, sha256(coalesce(text, '')) AS sha FROM documents")
def q_roundtrip_check(spark: SparkSession, d: str) -> DataFrame:
    tokens, dictionary = _tokens_and_dictionary(spark, d, "documents")
    lines = templates.restored(templates.records(tokens, dictionary), dictionary)
    return templates.restored_texts(lines).select("file_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))


_DAMAGED = f"{_RECORDS}, left_ AS (SELECT * FROM records WHERE corpus = 'documents' AND line_index <> 1)"


@query(
    "q_integrity",
    f"""WITH {_DAMAGED} SELECT file_id, line_index::BIGINT AS line_index, 'unknown template' AS error FROM left_ WHERE tpl_id % 2 = 0
    UNION ALL SELECT file_id, NULL, 'gap or repeat in lines' FROM left_ GROUP BY file_id HAVING count(*) <> count(DISTINCT line_index) OR count(*) <> max(line_index) + 1""",
)
def q_integrity(spark: SparkSession, d: str) -> DataFrame:
    """What the check finds in records without the second line of each file and a dictionary without every other template."""
    found = cut(_records(spark, d, "documents"))
    dictionary = _dictionary(spark, d, "documents").filter("tpl_id % 2 = 1")
    return templates.integrity_errors(found.filter("line_index <> 1"), dictionary).withColumn("line_index", F.col("line_index").cast("long"))


@query("q_integrity_whole", "SELECT count(DISTINCT doc_id) AS n_files, 0::BIGINT AS n_errors FROM documents")
def q_integrity_whole(spark: SparkSession, d: str) -> DataFrame:
    """The same check of whole records: files, and errors found."""
    found = cut(_records(spark, d, "documents"))
    errors = templates.integrity_errors(found, _dictionary(spark, d, "documents")).agg(F.count(F.lit(1)).alias("n_errors"))
    return found.agg(F.count_distinct("file_id").alias("n_files")).join(errors)


# ---- columns and encodings -------------------------------------------------------------------------------------

_ROWS = f"{_RECORDS}, rows_ AS (SELECT corpus, tpl_id, file_id, line_index, vals, row_number() OVER (PARTITION BY corpus, tpl_id ORDER BY file_id, line_index) - 1 AS row_no FROM records WHERE tpl_id IS NOT NULL)"
_SLOTS = f"{_ROWS}, cells AS (SELECT corpus, tpl_id, row_no // 262144 AS block_id, row_no, file_id, line_index, unnest(generate_series(0, len(vals) - 1)) AS slot, unnest(vals) AS value FROM rows_ WHERE len(vals) > 0)"
_W = "OVER (PARTITION BY corpus, tpl_id, block_id, slot ORDER BY row_no)"
_K = "corpus, tpl_id, block_id, slot"
_INT = f"CASE WHEN regexp_matches(value, '{CANONICAL_INT}') AND abs(try_cast(value AS HUGEINT)) < 4611686018427387904 THEN try_cast(value AS BIGINT) END"
_INTS = f"{_SLOTS}, marked AS (SELECT *, {_INT} AS v FROM cells), ints AS (SELECT * FROM marked WHERE ({_K}) IN (SELECT ({_K}) FROM marked GROUP BY {_K} HAVING count(v) = count(*)))"


def _cells(spark: SparkSession, d: str, corpus: str) -> DataFrame:
    return columns.dealt_cells(cut(columns.numbered_rows(_records(spark, d, corpus))))


def _longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


@query("q_slots", f"WITH {_SLOTS} SELECT corpus, tpl_id, block_id, slot, row_no, file_id, line_index::BIGINT AS line_index, value FROM cells")
def q_slots(spark: SparkSession, d: str) -> DataFrame:
    return _per_corpus(lambda c: _longs(_cells(spark, d, c), "slot", "line_index"))


@query("q_row_blocks", f"WITH {_ROWS} SELECT corpus, tpl_id, row_no // 100 AS block_id, row_no, file_id, line_index::BIGINT AS line_index FROM rows_")
def q_row_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Template rows in blocks of a hundred, so that there are several."""
    return _per_corpus(lambda c: _longs(columns.numbered_rows(_records(spark, d, c), 100), "line_index").drop("values"))


@query("q_column_stats", f"WITH {_INTS} SELECT {_K}, count(*) AS n, count(v) AS n_ints, count(DISTINCT value) AS n_distinct, coalesce(max(v), -1) AS top FROM marked GROUP BY {_K}")
def q_column_stats(spark: SparkSession, d: str) -> DataFrame:
    def one(c):
        v = F.when(scalar.is_canonical_int(F.col("value")), F.col("value").try_cast("long"))
        marked = _longs(_cells(spark, d, c), "slot").withColumn("v", F.when(F.abs(v) < 1 << 62, v))
        return marked.groupBy(*columns.KEY).agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("n_ints"), F.count_distinct("value").alias("n_distinct"), F.coalesce(F.max("v"), F.lit(-1)).cast("long").alias("top"))

    return _per_corpus(one)


@query("q_delta", f"WITH {_INTS} SELECT {_K}, row_no, v - coalesce(lag(v) {_W}, 0) AS d FROM ints")
def q_delta(spark: SparkSession, d: str) -> DataFrame:
    return _per_corpus(lambda c: _longs(columns.deltas(_cells(spark, d, c)), "slot"))


@query("q_delta_decode", f"WITH {_INTS} SELECT {_K}, row_no, value FROM ints")
def q_delta_decode(spark: SparkSession, d: str) -> DataFrame:
    return _per_corpus(lambda c: _longs(columns.deltas_decode(columns.deltas(_cells(spark, d, c))), "slot"))


_RUNS = f"{_SLOTS}, fresh AS (SELECT *, CASE WHEN lag(value) {_W} IS NULL OR lag(value) {_W} <> value THEN 1 ELSE 0 END AS c FROM cells), runs_ AS (SELECT *, sum(c) {_W} - 1 AS run FROM fresh)"


@query("q_rle", f"WITH {_RUNS} SELECT {_K}, run::BIGINT AS run, min(value) AS value, count(*) AS n, min(row_no) AS first_row FROM runs_ GROUP BY {_K}, run")
def q_rle(spark: SparkSession, d: str) -> DataFrame:
    return _per_corpus(lambda c: _longs(columns.runs(_cells(spark, d, c)), "slot"))


@query("q_rle_decode", f"WITH {_SLOTS} SELECT {_K}, row_no, value FROM cells")
def q_rle_decode(spark: SparkSession, d: str) -> DataFrame:
    return _per_corpus(lambda c: _longs(columns.runs_decode(columns.runs(_cells(spark, d, c))), "slot"))


_WORDS = f"{_SLOTS}, words_ AS (SELECT {_K}, value, count(*) AS n, row_number() OVER (PARTITION BY {_K} ORDER BY min(row_no)) - 1 AS index FROM cells GROUP BY {_K}, value)"


@query("q_dictionary", f"WITH {_WORDS} SELECT * FROM words_")
def q_dictionary(spark: SparkSession, d: str) -> DataFrame:
    return _per_corpus(lambda c: _longs(columns.dictionaries(_cells(spark, d, c)), "slot"))


_BW = _W.replace(", slot", "").replace("block_id", "row_no // 262144")


@query("q_row_refs", f"WITH {_ROWS} SELECT corpus, tpl_id, row_no // 262144 AS block_id, row_no, file_id - coalesce(lag(file_id) {_BW}, 0) AS file_delta, CASE WHEN lag(file_id) {_BW} = file_id THEN line_index - lag(line_index) {_BW} ELSE line_index END AS line_delta FROM rows_")
def q_row_refs(spark: SparkSession, d: str) -> DataFrame:
    return _per_corpus(lambda c: _longs(columns.row_refs(columns.numbered_rows(_records(spark, d, c))), "line_delta"))


@query("q_row_refs_decode", f"WITH {_ROWS} SELECT corpus, tpl_id, row_no // 262144 AS block_id, row_no, file_id, line_index::BIGINT AS line_index FROM rows_")
def q_row_refs_decode(spark: SparkSession, d: str) -> DataFrame:
    return _per_corpus(lambda c: _longs(columns.row_refs_decode(columns.row_refs(columns.numbered_rows(_records(spark, d, c)))), "line_index"))


@query("q_zigzag", "SELECT l_orderkey, l_linenumber, l_partkey - l_suppkey AS v, CASE WHEN l_partkey >= l_suppkey THEN 2 * (l_partkey - l_suppkey) ELSE -2 * (l_partkey - l_suppkey) - 1 END AS z, l_partkey - l_suppkey AS back FROM lineitem")
def q_zigzag(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", (F.col("l_partkey") - F.col("l_suppkey")).alias("v"))
    return rows.withColumn("z", scalar.zigzag(F.col("v"))).withColumn("back", scalar.unzigzag(F.col("z")))


def _sql_leb128(u: str) -> str:
    """Hex of the bytes of a varint below 2^35."""
    byte = lambda n, more: f"printf('%02X', (({u} >> {7 * n}) & 127) + {128 * more})"
    return "CASE " + " ".join(f"WHEN {u} < {1 << (7 * (n + 1))} THEN " + " || ".join(byte(i, i < n) for i in range(n + 1)) for n in range(5)) + " END"


@query("q_varint_bytes", f"SELECT l_orderkey, l_linenumber, {_sql_leb128('(l_partkey * l_orderkey)')} || {_sql_leb128('(2 * l_suppkey)')} AS bytes, l_partkey * l_orderkey AS first, 2 * l_suppkey AS second FROM lineitem WHERE l_partkey >= 0 UNION ALL SELECT l_orderkey, l_linenumber, {_sql_leb128('(-2 * l_partkey * l_orderkey - 1)')}, l_partkey * l_orderkey, 2 * l_suppkey FROM lineitem WHERE l_partkey < 0")
def q_varint_bytes(spark: SparkSession, d: str) -> DataFrame:
    """Two integers a row as varints, and back; a negative first one is written alone, signed."""
    first = F.col("l_partkey").cast("long") * F.col("l_orderkey")
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", first.alias("a"), (F.col("l_suppkey").cast("long") * 2).alias("b"))
    below = F.col("a") < 0
    coded = rows.withColumn("data", varint_bytes(F.when(below, F.array("a")).otherwise(F.array("a", "b")), below))
    back = varint_longs("data", F.when(below, 1).otherwise(2), below)
    return coded.withColumn("back", back).select("l_orderkey", "l_linenumber", F.hex("data").alias("bytes"), F.col("back")[0].alias("first"), F.coalesce(F.try_element_at("back", F.lit(2)), F.col("b")).alias("second"))


def _sql_varint(u: str) -> str:
    return "(1 + " + " + ".join(f"CASE WHEN {u} >= {1 << (7 * n)} THEN 1 ELSE 0 END" for n in range(1, 9)) + ")"


def _sql_zigzag(v: str) -> str:
    return f"(CASE WHEN {v} >= 0 THEN 2 * {v} ELSE -2 * {v} - 1 END)"


def _sql_str(s: str) -> str:
    o = f"octet_length(encode({s}))"
    return f"({o} + CASE WHEN {o} <= 31 THEN 1 WHEN {o} <= 255 THEN 2 WHEN {o} <= 65535 THEN 3 ELSE 5 END)"


def _sql_bin(n: str) -> str:
    return f"({n} + CASE WHEN {n} <= 255 THEN 2 WHEN {n} <= 65535 THEN 3 ELSE 5 END)"


def _sql_head(n: str) -> str:
    return f"(CASE WHEN {n} <= 15 THEN 1 WHEN {n} <= 65535 THEN 3 ELSE 5 END)"


_SIZES = f"""{_SLOTS},
m AS (SELECT *, {_INT} AS v, CASE WHEN lag(value) {_W} IS NULL OR lag(value) {_W} <> value THEN 1 ELSE 0 END AS c FROM cells),
m2 AS (SELECT *, v - lag(v) {_W} AS d, sum(c) {_W} AS run, {_sql_str('value')} AS bytes FROM m),
per AS (SELECT {_K}, count(*) AS n, sum(bytes) AS raw_bytes, count(v) AS ints, sum({_sql_varint(_sql_zigzag('v'))}) AS v_bytes, sum({_sql_varint(_sql_zigzag('coalesce(d, v)'))}) AS d_bytes,
  count(d) AS steps, count(*) FILTER (WHERE d >= 0) AS up, count(*) FILTER (WHERE d <= 0) AS down, count(*) FILTER (WHERE abs(d) <= 16) AS near, sum(c) AS runs, sum(bytes) FILTER (WHERE c = 1) AS run_bytes FROM m2 GROUP BY {_K}),
dw AS (SELECT {_K}, value, count(*) AS n, row_number() OVER (PARTITION BY {_K} ORDER BY min(row_no)) - 1 AS idx FROM cells GROUP BY {_K}, value),
dk AS (SELECT {_K}, count(*) AS k, sum({_sql_str('value')}) AS word_bytes, sum(n * {_sql_varint('idx')}) AS index_bytes FROM dw GROUP BY {_K}),
rn AS (SELECT {_K}, run, count(*) AS n FROM m2 GROUP BY {_K}, run), rc AS (SELECT {_K}, sum({_sql_varint('n')}) AS count_bytes FROM rn GROUP BY {_K}),
sizes AS (SELECT {_K}, per.n AS n, (27 + {_sql_bin('(' + _sql_head('per.n') + ' + raw_bytes)')})::BIGINT AS raw_msgpack, (CASE WHEN ints = per.n THEN 22 + {_sql_bin('v_bytes')} END)::BIGINT AS varint,
  (CASE WHEN ints = per.n AND steps > 0 AND (greatest(up, down) >= 0.9 * steps OR near >= 0.9 * steps) THEN 28 + {_sql_bin('d_bytes')} END)::BIGINT AS delta_varint,
  (CASE WHEN k < per.n THEN 32 + {_sql_head('k')} + word_bytes + 8 + {_sql_bin('index_bytes')} END)::BIGINT AS dictionary, (CASE WHEN runs < per.n THEN 21 + {_sql_head('runs')} + run_bytes + 7 + {_sql_bin('count_bytes')} END)::BIGINT AS rle
  FROM per JOIN dk USING ({_K}) JOIN rc USING ({_K})),
choice AS (SELECT {_K}, n, least(raw_msgpack, varint, delta_varint, dictionary, rle) AS size, CASE least(raw_msgpack, varint, delta_varint, dictionary, rle) WHEN raw_msgpack THEN 'raw_msgpack' WHEN varint THEN 'varint' WHEN delta_varint THEN 'delta_varint' WHEN dictionary THEN 'dictionary' ELSE 'rle' END AS encoding FROM sizes)"""


@query("q_column_sizes", f"WITH {_SIZES} SELECT * FROM sizes")
def q_column_sizes(spark: SparkSession, d: str) -> DataFrame:
    return _per_corpus(lambda c: _longs(columns.column_sizes(_cells(spark, d, c)), "slot", *columns.ENCODINGS))


@query("q_encoding_choice", f"WITH {_SIZES} SELECT * FROM choice")
def q_encoding_choice(spark: SparkSession, d: str) -> DataFrame:
    return _per_corpus(lambda c: _longs(columns.encoding_choice(columns.column_sizes(_cells(spark, d, c))), "slot"))


@query("q_encoding_counts", f"WITH {_SIZES} SELECT corpus, encoding, count(*) AS n_columns, sum(size)::BIGINT AS bytes FROM choice GROUP BY ALL")
def q_encoding_counts(spark: SparkSession, d: str) -> DataFrame:
    return _per_corpus(lambda c: metrics.encoding_counts(columns.encoding_choice(columns.column_sizes(_cells(spark, d, c)))))


_ROW_SIZE = f"""row_sizes AS (SELECT corpus, sum(CASE WHEN tpl_id IS NOT NULL THEN 1 + CASE WHEN tpl_id < 128 THEN 1 WHEN tpl_id < 256 THEN 2 WHEN tpl_id < 65536 THEN 3 ELSE 5 END + {_sql_head('len(vals)')} + coalesce(list_sum(list_transform(vals, lambda x: {_sql_str('x')})), 0) ELSE 2 + {_sql_str('line')} END)::BIGINT AS row_size FROM records GROUP BY corpus)"""


_REF_SIZE = f"""refs AS (SELECT corpus, file_id - coalesce(lag(file_id) {_BW}, 0) AS fd, CASE WHEN lag(file_id) {_BW} = file_id THEN line_index - lag(line_index) {_BW} ELSE line_index END AS ld FROM rows_),
ref_sizes AS (SELECT corpus, sum({_sql_varint('fd')} + {_sql_varint('ld')})::BIGINT AS ref_size FROM refs GROUP BY corpus)"""


@query("q_mode_choice", f"WITH {_SIZES}, {_ROW_SIZE}, {_REF_SIZE}, cs AS (SELECT corpus, sum(size)::BIGINT AS column_size FROM choice GROUP BY corpus), rs AS (SELECT corpus, coalesce(sum({_sql_str('line')}) FILTER (WHERE tpl_id IS NULL), 0)::BIGINT AS raw_size FROM records GROUP BY corpus), both_ AS (SELECT corpus, row_size, coalesce(column_size, 0) + raw_size + coalesce(ref_size, 0) AS columnar_size FROM row_sizes LEFT JOIN cs USING (corpus) LEFT JOIN rs USING (corpus) LEFT JOIN ref_sizes USING (corpus)) SELECT *, CASE WHEN columnar_size < row_size THEN 'columnar' ELSE 'row' END AS mode FROM both_")
def q_mode_choice(spark: SparkSession, d: str) -> DataFrame:
    def one(c):
        found = cut(_records(spark, d, c))
        rows = cut(columns.numbered_rows(found))
        return columns.mode_sizes(found, columns.row_refs(rows), columns.encoding_choice(columns.column_sizes(columns.dealt_cells(rows))))

    return _per_corpus(one)


@query("q_columnar_roundtrip", f"WITH {_SLOTS} SELECT {_K}, row_no, value FROM cells")
def q_columnar_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    def one(c):
        cells = _cells(spark, d, c)
        return _longs(columns.decoded(columns.encoded(cells, columns.encoding_choice(columns.column_sizes(cells)))), "slot")

    return _per_corpus(one)


# ---- chunks ----------------------------------------------------------------------------------------------------

_CHUNKS = """pieces AS (SELECT file_id, unnest(generate_series(0, (octet_length(encode(text)) + {k} - 1) // {k} - 1)) AS seq, hex(encode(text)) AS h FROM files WHERE text <> ''),
chunk AS (SELECT file_id, seq, substr(h, (seq * {k} * 2 + 1)::BIGINT, {k} * 2) AS data FROM pieces),
dict AS (SELECT data, count(*) AS n, row_number() OVER (ORDER BY min(struct_pack(f := file_id, s := seq))) - 1 AS chunk_id FROM chunk GROUP BY data),
sequence_ AS (SELECT file_id, seq, chunk_id FROM chunk JOIN dict USING (data))""".replace("{k}", str(chunks.CHUNK))
_PROPS = f"files AS (SELECT event_id AS file_id, coalesce(props, '') AS text FROM events), {_CHUNKS}"
_CHUNKS = f"files AS (SELECT doc_id AS file_id, text FROM documents), {_CHUNKS}"
_EQUAL = "list_sum(list_transform(generate_series(0, length(a.data) // 2 - 1), lambda i: (substr(a.data, 2 * i + 1, 2) = substr(b.data, 2 * i + 1, 2))::INT))::BIGINT"
_PAIRS = f"{_PROPS}, pairs AS (SELECT a.chunk_id AS a, b.chunk_id AS b, length(a.data) // 2 AS length, {_EQUAL} AS matches FROM dict a JOIN dict b ON length(a.data) = length(b.data) AND b.chunk_id < a.chunk_id AND b.chunk_id >= a.chunk_id - {chunks.CANDIDATES})"
_BASES = f"{_PAIRS}, bases AS (SELECT a AS chunk_id, max(struct_pack(m := matches, b := b)) AS best FROM pairs WHERE matches > floor(length * {chunks.SIMILARITY}) GROUP BY a)"
_DIFFS = f"""{_BASES}, places AS (SELECT x.chunk_id, best.b AS base_id, t.data AS t, d.data AS d, unnest(generate_series(0, length(t.data) // 2 - 1)) AS off FROM bases x JOIN dict t ON t.chunk_id = x.chunk_id JOIN dict d ON d.chunk_id = best.b),
diffs AS (SELECT chunk_id, base_id, length(t) // 2 AS target_len, off, substr(t, (2 * off + 1)::BIGINT, 2) AS byte FROM places WHERE substr(t, (2 * off + 1)::BIGINT, 2) <> substr(d, (2 * off + 1)::BIGINT, 2)),
sized AS (SELECT chunk_id, base_id, target_len, count(*) AS n_diffs, sum(1 + CASE WHEN off < 128 THEN 1 WHEN off < 256 THEN 2 ELSE 3 END + CASE WHEN byte < '80' THEN 1 ELSE 2 END) + CASE WHEN count(*) <= 15 THEN 1 ELSE 3 END AS size FROM diffs GROUP BY ALL),
kept AS (SELECT chunk_id, base_id, target_len, n_diffs FROM sized WHERE size < target_len)"""


def _files(spark: SparkSession, d: str) -> DataFrame:
    return rows_as_files(spark, d, "documents").select("file_id", F.col("text").cast("binary").alias("content"))


def _props(spark: SparkSession, d: str) -> DataFrame:
    """Events as small files of much alike content."""
    return spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("file_id"), F.coalesce("props", F.lit("")).cast("binary").alias("content"))


def _chunk_tables(spark: SparkSession, d: str, files=_files) -> tuple[DataFrame, DataFrame]:
    pieces = chunks.fixed_chunks(files(spark, d))
    dictionary = chunks.chunk_dictionary(pieces)
    return dictionary, chunks.file_sequence(pieces, dictionary)


@query("q_fixed_chunks", f"WITH {_CHUNKS} SELECT file_id, seq::BIGINT AS seq, sha256(unhex(data)) AS sha, length(data) // 2 AS length FROM chunk")
def q_fixed_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunks.fixed_chunks(_files(spark, d)).select("file_id", F.col("seq").cast("long").alias("seq"), F.sha2("data", 256).alias("sha"), F.octet_length("data").cast("long").alias("length"))


@query("q_chunk_dict", f"WITH {_CHUNKS} SELECT chunk_id, sha256(unhex(data)) AS sha, n, length(data) // 2 AS length FROM dict")
def q_chunk_dict(spark: SparkSession, d: str) -> DataFrame:
    return _chunk_tables(spark, d)[0].select("chunk_id", "sha", "n", "length")


@query("q_sequence", f"WITH {_CHUNKS} SELECT file_id, seq::BIGINT AS seq, chunk_id FROM sequence_")
def q_sequence(spark: SparkSession, d: str) -> DataFrame:
    return _longs(_chunk_tables(spark, d)[1], "seq")


@query("q_dedup_ratio", f"WITH {_CHUNKS} SELECT (SELECT count(*) FROM chunk) AS n_chunks, count(*) AS n_distinct, (SELECT sum(length(data) // 2) FROM chunk)::BIGINT AS raw_bytes, sum(length(data) // 2)::BIGINT AS kept_bytes, round((SELECT sum(length(data) // 2) FROM chunk) / sum(length(data) // 2), 6) AS ratio FROM dict")
def q_dedup_ratio(spark: SparkSession, d: str) -> DataFrame:
    dictionary, sequence = _chunk_tables(spark, d)
    return chunks.dedup_ratio(sequence, dictionary).withColumn("ratio", F.round("ratio", 6))


@query("q_cross_file_chunks", f"WITH {_CHUNKS} SELECT chunk_id, count(DISTINCT file_id) AS n_files, count(*) AS n_uses FROM sequence_ GROUP BY chunk_id HAVING count(DISTINCT file_id) > 1")
def q_cross_file_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunks.cross_file_chunks(_chunk_tables(spark, d)[1])


@query("q_chunk_restore", "SELECT doc_id AS file_id, sha256(text) AS sha FROM documents WHERE text <> ''")
def q_chunk_restore(spark: SparkSession, d: str) -> DataFrame:
    dictionary, sequence = _chunk_tables(spark, d)
    return chunks.restore_chunks(sequence, dictionary).select("file_id", F.sha2("content", 256).alias("sha"))


@query("q_similarity", f"WITH {_PAIRS} SELECT a, b, length, matches FROM pairs")
def q_similarity(spark: SparkSession, d: str) -> DataFrame:
    return chunks.similar_pairs(_chunk_tables(spark, d, _props)[0])


@query("q_best_base", f"WITH {_BASES} SELECT chunk_id, best.b AS base_id, best.m AS matches FROM bases")
def q_best_base(spark: SparkSession, d: str) -> DataFrame:
    return chunks.best_bases(_chunk_tables(spark, d, _props)[0])


def _deltas(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    dictionary = _chunk_tables(spark, d, _props)[0]
    return dictionary, chunks.chunk_deltas(dictionary, chunks.best_bases(dictionary))


@query("q_byte_delta", f"WITH {_DIFFS} SELECT chunk_id, base_id, off, byte FROM diffs WHERE chunk_id IN (SELECT chunk_id FROM kept)")
def q_byte_delta(spark: SparkSession, d: str) -> DataFrame:
    each = _deltas(spark, d)[1].select("chunk_id", "base_id", F.explode("diffs").alias("x"))
    return each.select("chunk_id", "base_id", F.col("x.off").cast("long").alias("off"), F.lpad(F.hex("x.byte"), 2, "0").alias("byte"))


@query("q_chunk_deltas", f"WITH {_DIFFS} SELECT * FROM kept")
def q_chunk_deltas(spark: SparkSession, d: str) -> DataFrame:
    return _deltas(spark, d)[1].select("chunk_id", "base_id", "target_len", F.size("diffs").cast("long").alias("n_diffs"))


@query("q_apply_delta", f"WITH {_DIFFS} SELECT chunk_id, sha256(unhex(data)) AS sha FROM kept JOIN dict USING (chunk_id)")
def q_apply_delta(spark: SparkSession, d: str) -> DataFrame:
    """Chunks restored from deltas."""
    return chunks.resolve_deltas(*_deltas(spark, d)).select("chunk_id", F.sha2("data", 256).alias("sha"))


@query("q_sequential_deltas")
def q_sequential_deltas(spark: SparkSession, d: str) -> DataFrame:
    """Deltas by the exact rule, in which only chunks kept whole are bases: a single pass over each range of ids."""
    found = chunks.sequential_deltas(_chunk_tables(spark, d, _props)[0])
    return found.select("chunk_id", "base_id", "target_len", F.size("diffs").cast("long").alias("n_diffs"))


@query("q_cdc_chunks")
def q_cdc_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunks.content_chunks(_files(spark, d)).select("file_id", F.col("seq").cast("long").alias("seq"), F.sha2("data", 256).alias("sha"), F.octet_length("data").cast("long").alias("length"))


@query("q_cdc_restore", "SELECT doc_id AS file_id, sha256(text) AS sha FROM documents WHERE text <> ''")
def q_cdc_restore(spark: SparkSession, d: str) -> DataFrame:
    pieces = cut(chunks.content_chunks(_files(spark, d)))
    dictionary = chunks.chunk_dictionary(pieces)
    return chunks.restore_chunks(chunks.file_sequence(pieces, dictionary), dictionary).select("file_id", F.sha2("content", 256).alias("sha"))


@query("q_dictionary_samples", f"WITH {_CHUNKS}, step AS (SELECT greatest(1, count(*) // {archive.DICT_SAMPLES}) AS k, count(*) AS n, sum(length(data) // 2) AS total FROM dict) SELECT chunk_id, sha256(unhex(data)) AS sha FROM dict, step WHERE step.n >= {archive.DICT_CHUNKS} AND total >= {archive.DICT_BYTES} AND chunk_id % k = 0 AND chunk_id < k * {archive.DICT_SAMPLES}")
def q_dictionary_samples(spark: SparkSession, d: str) -> DataFrame:
    return archive.dictionary_samples(_chunk_tables(spark, d)[0]).select("chunk_id", F.sha2("data", 256).alias("sha"))


def _row_files(spark: SparkSession, d: str, corpus: str) -> DataFrame:
    """A table's rows as the files of a directory."""
    files = rows_as_files(spark, d, corpus).select("file_id", F.concat(F.lit(f"{corpus}/"), F.col("file_id").cast("string")).alias("path"), F.col("text").cast("binary").alias("content"))
    return files.select("file_id", "path", F.octet_length("content").cast("long").alias("length"), "content", F.lit(True).alias("is_text"))


def _archived(spark: SparkSession, d: str, corpus: str, make) -> DataFrame:
    """(file_id, sha) of what is restored from an archive of a table's rows as files."""
    place = f"{shared_folder(spark)}/archive-{uuid.uuid4().hex}"
    make(spark, _row_files(spark, d, corpus), place)
    return archive.restored_files(spark, place).select("file_id", F.sha2("content", 256).alias("sha"))


@query("q_template_archive", "SELECT doc_id AS file_id, sha256(coalesce(text, '')) AS sha FROM documents")
def q_template_archive(spark: SparkSession, d: str) -> DataFrame:
    return _archived(spark, d, "documents", lambda s, files, place: archive.template_archive(s, files, place, structured=False))


@query("q_structured_archive", "SELECT page_id AS file_id, sha256(coalesce(html, '')) AS sha FROM pages")
def q_structured_archive(spark: SparkSession, d: str) -> DataFrame:
    return _archived(spark, d, "pages", archive.template_archive)


@query("q_chunk_archive", "SELECT doc_id AS file_id, sha256(coalesce(text, '')) AS sha FROM documents")
def q_chunk_archive(spark: SparkSession, d: str) -> DataFrame:
    return _archived(spark, d, "documents", lambda s, files, place: archive.chunk_archive(s, files, place, "cdc", delta=True))


@query("q_compare", "SELECT 'templates' AS archive, count(*) AS n_files, sum(octet_length(encode(coalesce(html, ''))))::BIGINT AS raw_bytes, 0::BIGINT AS n_different FROM pages UNION ALL SELECT 'chunks', count(*), sum(octet_length(encode(coalesce(html, ''))))::BIGINT, 0::BIGINT FROM pages")
def q_compare(spark: SparkSession, d: str) -> DataFrame:
    """Both kinds of archive of one table: files and bytes that went in, and files that come back otherwise."""
    files = _row_files(spark, d, "pages")

    def one(name, make):
        place = f"{shared_folder(spark)}/archive-{uuid.uuid4().hex}"
        make(spark, files, place)
        bad = metrics.tree_differences(files, archive.restored_files(spark, place)).agg(F.count(F.lit(1)).alias("n_different"))
        whole = files.agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("length"), F.lit(0)).alias("raw_bytes"))
        return whole.join(bad).select(F.lit(name).alias("archive"), "n_files", "raw_bytes", "n_different")

    return one("templates", archive.template_archive).union(one("chunks", archive.chunk_archive))


@query("q_zstd_sizes")
def q_zstd_sizes(spark: SparkSession, d: str) -> DataFrame:
    sized = _files(spark, d).select("file_id", F.octet_length("content").cast("long").alias("raw"), archive.zstd_size("content").alias("packed"))
    return sized.withColumn("ratio", F.round(scalar.ratio(F.col("raw"), F.col("packed")), 4))


# ---- structure -------------------------------------------------------------------------------------------------

# DuckDB's \b, \d and \s know ASCII only.  A word with a letter or digit beyond ASCII holds no match of a pattern with a word
# end, so for counts such words become one letter; where text is replaced, guards keep word ends away from them.
_BEYOND = r"(?:[^\P{L}A-Za-z]|[^\P{N}0-9])"
_WORD_BEYOND = rf"[A-Za-z0-9_]*{_BEYOND}(?:[A-Za-z0-9_]|{_BEYOND})*"


def _sql_pattern(pattern: str) -> str:
    return _q(pattern.replace(r"[^\s", r"[^\s\x1c-\x1f\x{85}\p{Z}").replace(r"\d", r"\p{Nd}"))


def _sql_count(kind: str, pattern: str) -> str:
    text = f"regexp_replace(line, {_q(_WORD_BEYOND)}, 'é', 'g')" if r"\b" in pattern else "line"
    return f"len(regexp_extract_all({text}, {_sql_pattern(pattern)}))::BIGINT AS n_{kind}"


def _every_line(spark: SparkSession, d: str) -> DataFrame:
    return _per_corpus(lambda c: _longs(table_lines(spark, d, c), "line_index"))


@query("q_kind_counts", f"WITH {_ALL_LINES} SELECT corpus, file_id, line_index::BIGINT AS line_index, " + ", ".join(_sql_count(k, p) for k, p in [*KINDS.items(), ("kv", KEY_VALUE)]) + " FROM lines")
def q_kind_counts(spark: SparkSession, d: str) -> DataFrame:
    return _every_line(spark, d).select("corpus", "file_id", "line_index", *structure.kind_counts(F.col("line")))


@query("q_kv_pairs", f"WITH {_ALL_LINES} SELECT corpus, file_id, line_index::BIGINT AS line_index, lower(unnest(regexp_extract_all(line, {_q(KEY_VALUE)}, 1))) AS key, unnest(regexp_extract_all(line, {_q(KEY_VALUE)}, 2)) AS value FROM lines")
def q_kv_pairs(spark: SparkSession, d: str) -> DataFrame:
    return metrics.union_all([structure.key_values(_every_line(spark, d).filter(F.col("corpus") == c)).withColumn("corpus", F.lit(c)) for c in CORPORA])


def _sql_normalize(text: str) -> str:
    out = f"regexp_replace(lower(trim({text})), '[\\s\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+', ' ', 'g')"
    out = f"regexp_replace({out}, '([A-Za-z0-9_])({_BEYOND})', '\\1_ǂ\\2', 'g')"
    out = f"regexp_replace({out}, '({_BEYOND})([A-Za-z0-9_])', '\\1ǂ_\\2', 'g')"
    for k in NORMAL_ORDER:
        out = f"regexp_replace({out}, {_sql_pattern(KINDS[k])}, '{NORMAL_NAMES.get(k, f'<{k}>')}', 'g')"
    return f"replace(replace(replace({out}, '_ǂ', ''), 'ǂ_', ''), 'ǂ', '')"


@query("q_normalize", f"WITH {_ALL_LINES} SELECT corpus, file_id, line_index::BIGINT AS line_index, {_sql_normalize('line')} AS normal FROM lines")
def q_normalize(spark: SparkSession, d: str) -> DataFrame:
    return _every_line(spark, d).select("corpus", "file_id", "line_index", structure.normalized(F.col("line")).alias("normal"))


@query("q_v2_template")
def q_v2_template(spark: SparkSession, d: str) -> DataFrame:
    return _per_corpus(lambda c: _longs(structure.tokenize(table_lines(spark, d, c)), "line_index").select("file_id", "line_index", _joined("parts").alias("parts"), _joined("values").alias("vals"), _joined("kinds").alias("kinds"), _joined("skeleton").alias("skeleton"), "is_json"))


@query("q_v2_rebuild", f"WITH {_ALL_LINES} SELECT corpus, file_id, line_index::BIGINT AS line_index, line FROM lines")
def q_v2_rebuild(spark: SparkSession, d: str) -> DataFrame:
    return _per_corpus(lambda c: _longs(structure.tokenize(table_lines(spark, d, c), ["parts", "values"]), "line_index").select("file_id", "line_index", templates.rebuild(F.col("parts"), F.col("values")).alias("line")))


@query("q_v2_metrics")
def q_v2_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _per_corpus(lambda c: structure.tokenize(table_lines(spark, d, c), ["skeleton", "is_json", "json_key"]).transform(metrics.structure_metrics))


@query("q_fuzzy_merge")
def q_fuzzy_merge(spark: SparkSession, d: str) -> DataFrame:
    return _per_corpus(lambda c: structure.fuzzy_merge(structure.tokenize(table_lines(spark, d, c), ["parts", "skeleton"])))


@query("q_json_leaves", "SELECT ascii(event_type)::BIGINT AS file_id, event_id AS line_index, unnest(generate_series(0, len(json_keys(props)) - 1)) AS pos, unnest(json_keys(props)) AS path, json_extract(props, '$.' || unnest(json_keys(props)))::VARCHAR AS raw FROM events WHERE props IS NOT NULL")
def q_json_leaves(spark: SparkSession, d: str) -> DataFrame:
    return _longs(structure.json_leaf_rows(table_lines(spark, d, "events")), "pos", "line_index").select("file_id", "line_index", "pos", F.array_join("path", ".").alias("path"), "raw")


_JSON_KEY = "list_aggregate(list_sort(list_transform(json_keys(props), lambda k: k || '=json_' || CASE json_type(props, '$.' || k) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'bool' WHEN 'NULL' THEN 'null' ELSE 'number' END)), 'string_agg', ',')"


@query("q_json_structure", f"SELECT ascii(event_type)::BIGINT AS file_id, event_id AS line_index, {_JSON_KEY} AS json_key FROM events WHERE props IS NOT NULL")
def q_json_structure(spark: SparkSession, d: str) -> DataFrame:
    found = structure.json_structure(structure.json_leaf_rows(table_lines(spark, d, "events")))
    return _longs(found, "line_index").withColumn("json_key", F.array_join("json_key", ","))


@query("q_json_template_counts", f"SELECT {_JSON_KEY} AS json_key, count(*) AS n FROM events WHERE props IS NOT NULL GROUP BY ALL")
def q_json_template_counts(spark: SparkSession, d: str) -> DataFrame:
    found = structure.json_structure(structure.json_leaf_rows(table_lines(spark, d, "events")))
    return found.groupBy(F.array_join("json_key", ",").alias("json_key")).agg(F.count(F.lit(1)).alias("n"))


# ---- comparisons, streaming ------------------------------------------------------------------------------------

@query("q_tree_compare", "SELECT coalesce(a.doc_id, b.doc_id)::VARCHAR AS path, CASE WHEN b.doc_id IS NULL THEN 'missing' WHEN a.doc_id IS NULL THEN 'extra' ELSE 'changed' END AS difference FROM (SELECT * FROM documents WHERE source <> 'src1') a FULL JOIN (SELECT doc_id, CASE WHEN lang = 'de' THEN upper(text) ELSE text END AS text FROM documents WHERE source <> 'src2') b ON a.doc_id = b.doc_id WHERE a.doc_id IS NULL OR b.doc_id IS NULL OR a.text <> b.text")
def q_tree_compare(spark: SparkSession, d: str) -> DataFrame:
    """Two trees made from the documents: each lacks a source, and one has other texts in one language."""
    docs = spark.read.parquet(f"{d}/documents.parquet").withColumn("path", F.col("doc_id").cast("string"))
    other = F.when(F.col("lang") == "de", F.upper("text")).otherwise(F.col("text"))
    return metrics.tree_differences(docs.filter("source <> 'src1'").select("path", F.col("text").alias("content")), docs.filter("source <> 'src2'").select("path", other.alias("content")))


_PCT = "(CASE WHEN l_partkey > 0 THEN (l_suppkey - l_partkey) / l_partkey::DOUBLE * 100.0 END)"


@query("q_verdict", f"SELECT l_orderkey, l_linenumber, round({_PCT}, 6) AS pct, CASE WHEN {_PCT} <= -10.0 THEN 'strong win' WHEN {_PCT} < 0.0 THEN 'win' WHEN {_PCT} <= 10.0 THEN 'acceptable' WHEN {_PCT} IS NOT NULL THEN 'loss' END AS verdict FROM lineitem")
def q_verdict(spark: SparkSession, d: str) -> DataFrame:
    pct = scalar.delta_pct(F.col("l_suppkey"), F.col("l_partkey"))
    return spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.round(pct, 6).alias("pct"), scalar.verdict(pct).alias("verdict"))


_RESULTS = "SELECT l_suppkey::VARCHAR AS name, l_suppkey % 2 = 0 AS structured, (sum(l_quantity) - 25 * count(*)) / (25 * count(*))::DOUBLE * 100.0 AS delta_pct FROM lineitem GROUP BY l_suppkey"


@query("q_roll_up", f"SELECT count(*) FILTER (WHERE delta_pct < 0) AS wins, count(*) FILTER (WHERE delta_pct > 10) AS losses, count(*) FILTER (WHERE delta_pct > 10 AND structured) AS structured_losses, max_by(name, delta_pct) AS worst, count(*) FILTER (WHERE delta_pct < 0) >= 3 AND count(*) FILTER (WHERE delta_pct > 10 AND structured) = 0 AS passed FROM ({_RESULTS})")
def q_roll_up(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as results: how far the quantities of each lie from 25 on average."""
    n = F.count(F.lit(1))
    results = spark.read.parquet(f"{d}/lineitem.parquet").groupBy("l_suppkey").agg(((F.sum("l_quantity") - n * 25).cast("double") / (n * 25) * 100.0).alias("delta_pct"))
    return metrics.roll_up(results.select(F.col("l_suppkey").cast("string").alias("name"), (F.pmod("l_suppkey", F.lit(2)) == 0).alias("structured"), "delta_pct"))


@query("q_format_delta", "SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey = 0 THEN '(baseline size is 0, delta not meaningful)' WHEN l_suppkey < l_partkey THEN format('archive is {:,} bytes ({:.1f}%) SMALLER than baseline.', l_partkey - l_suppkey, (l_partkey - l_suppkey) / l_partkey::DOUBLE * 100) WHEN l_suppkey > l_partkey THEN format('archive is {:,} bytes ({:.1f}%) LARGER than baseline.', l_suppkey - l_partkey, (l_suppkey - l_partkey) / l_partkey::DOUBLE * 100) ELSE 'archive is equal in size to baseline.' END AS said FROM lineitem")
def q_format_delta(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", scalar.format_delta(F.col("l_suppkey"), F.col("l_partkey"), "archive", "baseline").alias("said"))


@query("q_format_bytes", "SELECT doc_id, CASE WHEN n_chars IS NULL THEN 'n/a' WHEN n_chars < 1024 THEN n_chars || ' B' WHEN n_chars < 1048576 THEN format('{:.1f} KB', n_chars / 1024::DOUBLE) WHEN n_chars < 1073741824 THEN format('{:.1f} MB', n_chars / 1048576::DOUBLE) ELSE format('{:.2f} GB', n_chars / 1073741824::DOUBLE) END AS said FROM documents")
def q_format_bytes(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", scalar.format_bytes(F.col("n_chars")).alias("said"))


def _event_stream(spark: SparkSession, d: str) -> DataFrame:
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*").select(F.col("ts").cast("timestamp").alias("ts"), F.col("props").alias("line"))


@query("q_stream_template_counts", f"SELECT regexp_replace(props, {_q(SIMPLE)}, '{{}}', 'g') AS template, count(*) AS n FROM events GROUP BY ALL")
def q_stream_template_counts(spark: SparkSession, d: str) -> DataFrame:
    return streaming.drain(streaming.stream_templates(_event_stream(spark, d)), f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}", streaming.KEYS).select("template", "n")


@query("q_windowed_template_counts", f"SELECT time_bucket(INTERVAL 1 hour, ts)::TIMESTAMP AS window_start, regexp_replace(props, {_q(SIMPLE)}, '{{}}', 'g') AS template, count(*) AS n FROM events GROUP BY ALL")
def q_windowed_template_counts(spark: SparkSession, d: str) -> DataFrame:
    counted = streaming.drain(streaming.windowed_templates(_event_stream(spark, d)), f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}", streaming.WINDOWED_KEYS)
    return counted.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "template", "n")
