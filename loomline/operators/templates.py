"""Line templates: tokenise, count, number, look up, and rebuild.

A template is the array of a line's literal parts; its variables' values stand between them.  Parts are the key
(not parts joined with a placeholder), so that every line is rebuilt exactly, placeholders in it or not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions.patterns import SIMPLE
from loomline.operators.numbering import positions

MIN_OCCURRENCES = 2
#: A text file with a smaller share of template lines is kept raw.
MIN_FILE_RATE = 0.10
#: Lines from which a template is hot, if they are also more than a thousandth of all: a join doesn't bring its lines together.
HOT_LINES = 100_000


#: The variable tokens, tried only where their first character can be one's.
_TOKEN = rf"(?=[0-9a-fA-F\[h-])(?:{SIMPLE})"


def _may_vary(line: Column) -> Column:
    """Whether a line can hold variables: these need a digit, or a scheme, or the first group of a UUID."""
    return line.rlike("[0-9]") | line.contains("://") | (line.contains("-") & line.rlike("[a-fA-F]{8}-"))


def parts_of(line: Column) -> Column:
    return F.when(~_may_vary(line), F.array(line)).otherwise(F.split(line, _TOKEN, -1))


def values_of(line: Column) -> Column:
    return F.when(~_may_vary(line), F.array().cast("array<string>")).otherwise(F.regexp_extract_all(line, F.lit(f"({_TOKEN})"), F.lit(1)))


def tokenize(lines: DataFrame) -> DataFrame:
    """``lines`` with ``parts`` and ``values``, by the simple tokeniser."""
    return lines.withColumns({"parts": parts_of(F.col("line")), "values": values_of(F.col("line"))})


def display(parts: Column) -> Column:
    """A template as text, with {} for variables; for reading only."""
    return F.array_join(parts, "{}")


def rebuild(parts: Column, values: Column) -> Column:
    """The line of a template's parts and a row's values."""
    return F.array_join(F.flatten(F.zip_with(parts, values, lambda p, v: F.array(p, F.coalesce(v, F.lit(""))))), "")


def template_counts(tokens: DataFrame) -> DataFrame:
    """(parts, n, first_file, first_line) of every template; partial counts precede the shuffle."""
    first = F.min(F.struct("file_id", "line_index"))
    return tokens.groupBy("parts").agg(F.count(F.lit(1)).alias("n"), first.alias("first")).select("parts", "n", F.col("first.file_id").alias("first_file"), F.col("first.line_index").alias("first_line"))


def template_dictionary(counts: DataFrame, least: int = MIN_OCCURRENCES) -> DataFrame:
    """Templates that recur, numbered in the order in which they are first seen."""
    return positions(counts.filter(F.col("n") >= least), ["first_file", "first_line"], "tpl_id")


def _hot(dictionary: DataFrame) -> DataFrame | None:
    """The few templates (a thousand at most) that a large share of the lines has, if there are any."""
    if "n" not in dictionary.columns:
        return None
    most, lines = dictionary.agg(F.max("n"), F.sum("n")).first()
    least = max(HOT_LINES, (lines or 0) // 1000)
    return dictionary.filter(F.col("n") >= least) if (most or 0) >= least else None


def _met(tokens: DataFrame, dictionary: DataFrame, how: str) -> DataFrame:
    """``tokens`` joined with a dictionary by ``parts``.

    Rows of hot templates stay where they are and those templates are broadcast; all others meet in a shuffle, in which no
    key has many rows.
    """
    hot = _hot(dictionary)
    if hot is None:
        return tokens.join(dictionary, "parts", how)
    wide, few = F.broadcast(hot.select("parts")), F.broadcast(hot)
    rest = tokens.join(wide, "parts", "left_anti").join(dictionary.join(wide, "parts", "left_anti"), "parts", how)
    return rest if how == "left_anti" else tokens.join(few, "parts", "left_semi" if how == "left_semi" else "inner").unionByName(rest)


def records(tokens: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(file_id, line_index, tpl_id, values, line): tpl_id is null for raw lines, which keep the line.

    ``tokens`` are read twice where there are hot templates, so they should be a cut table.
    """
    joined = _met(tokens, dictionary, "left")
    raw = F.col("tpl_id").isNull()
    return joined.select("file_id", "line_index", "tpl_id", F.when(~raw, F.col("values")).alias("values"), F.when(raw, F.col("line")).alias("line"))


def raw_lines(tokens: DataFrame, dictionary: DataFrame) -> DataFrame:
    return _met(tokens, dictionary, "left_anti").select("file_id", "line_index", "line")


def templated_lines(tokens: DataFrame, dictionary: DataFrame) -> DataFrame:
    return _met(tokens, dictionary, "left_semi").select("file_id", "line_index", "line")


def file_rates(found: DataFrame) -> DataFrame:
    """(file_id, n_lines, hits, raw, slots, rate) of ``records``."""
    hit = F.col("tpl_id").isNotNull()
    grouped = found.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("n_lines"), F.count(F.when(hit, 1)).alias("hits"), F.count(F.when(~hit, 1)).alias("raw"),
        F.coalesce(F.sum(F.when(hit, F.size("values"))), F.lit(0)).cast("long").alias("slots"),
    )
    return grouped.withColumn("rate", F.col("hits") / F.col("n_lines"))


def fallback_reason(rates: DataFrame, is_text: Column | None = None) -> DataFrame:
    """``rates`` with ``reason``: why a file is kept raw, null if it isn't."""
    reason = F.when(F.col("hits") == 0, "no_templates").when(F.col("rate") < MIN_FILE_RATE, "low_structure")
    if is_text is not None:
        reason = F.when(~is_text, "binary").otherwise(reason)
    return rates.withColumn("reason", reason)


def reuse_rate(counts: DataFrame) -> DataFrame:
    """(n_lines, reused, rate): lines whose template recurs; rate 0 without lines."""
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_lines"), F.coalesce(F.sum(F.when(F.col("n") >= MIN_OCCURRENCES, F.col("n"))), F.lit(0)).alias("reused"))
    return sums.withColumn("rate", F.coalesce(F.try_divide(F.col("reused").cast("double"), F.col("n_lines").cast("double")), F.lit(0.0)))


def restored(found: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(file_id, line_index, line) of ``records``."""
    with_parts = found.join(dictionary.select("tpl_id", "parts"), "tpl_id", "left")
    line = F.when(F.col("tpl_id").isNull(), F.col("line")).otherwise(rebuild(F.col("parts"), F.col("values")))
    return with_parts.select("file_id", "line_index", line.alias("line"))


def restored_texts(lines: DataFrame) -> DataFrame:
    """(file_id, text) of lines, joined with newlines in order; a file is the unit, as its text is one value."""
    ordered = F.array_sort(F.collect_list(F.struct("line_index", "line")))
    return lines.groupBy("file_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text"))


def integrity_errors(found: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(file_id, line_index, error) of records that can't be rebuilt: an unknown template, a wrong number of
    values, a raw record without a line, and gaps or repeats in a file's line numbers."""
    known = found.join(dictionary.select("tpl_id", F.size("parts").alias("n_parts")), "tpl_id", "left")
    error = (
        F.when(F.col("tpl_id").isNotNull() & F.col("n_parts").isNull(), "unknown template")
        .when(F.col("tpl_id").isNotNull() & (F.coalesce(F.size("values"), F.lit(-1)) != F.col("n_parts") - 1), "wrong number of values")
        .when(F.col("tpl_id").isNull() & F.col("line").isNull(), "raw record without line")
    )
    bad = known.select("file_id", "line_index", error.alias("error")).filter("error is not null")
    span = found.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("line_index").alias("distinct_n"), F.max("line_index").alias("last"))
    gaps = span.filter((F.col("n") != F.col("distinct_n")) | (F.col("n") != F.col("last") + 1))
    return bad.union(gaps.select("file_id", F.lit(None).cast(bad.schema["line_index"].dataType), F.lit("gap or repeat in lines")))
