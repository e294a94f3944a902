"""Columns of variable values: blocks, statistics, encodings and their sizes, and exact inverses.

Rows of a template are numbered by position, from range partitions, so one dominant template (a third of all
lines, say) is never a window of its own; windows run inside (template, block, slot), of ``BLOCK_ROWS`` at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomline.functions.codecs import varint_bytes, varint_longs
from loomline.functions.scalar import array_header, bin_size, is_canonical_int, str_size, varint_size, zigzag
from loomline.operators.numbering import positions
from loomline.session import cut_dealt

#: Cells of a partition, about; places in which a template's rows meet its first one.
PART_CELLS, SPAN = 2_000_000, 65_536
# Rows in a block; share and step of columns that deltas suit; encodings in order of preference.
BLOCK_ROWS = 262_144
DELTA_SHARE, DELTA_STEP = 0.9, 16
ENCODINGS = ("raw_msgpack", "varint", "delta_varint", "dictionary", "rle")
KEY = ["tpl_id", "block_id", "slot"]


def numbered_rows(found: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Template records with ``row_no`` (place in their template's order) and ``block_id``.

    Rows meet their template's first place by template and span of places, so that no key has more than ``SPAN`` rows.
    """
    placed = positions(found.filter("tpl_id is not null").select("tpl_id", "file_id", "line_index", "values"), ["tpl_id", "file_id", "line_index"], "at")
    placed = placed.withColumn("span", F.floor(F.col("at") / SPAN))
    spans = placed.groupBy("tpl_id", "span").agg(F.min("at").alias("first"))
    firsts = spans.groupBy("tpl_id").agg(F.min("first").alias("first"))
    row_no = F.col("at") - F.col("first")
    joined = placed.join(spans.drop("first").join(firsts, "tpl_id"), ["tpl_id", "span"])
    return joined.select("tpl_id", "file_id", "line_index", "values", row_no.alias("row_no"), F.floor(row_no / block_rows).alias("block_id"))


def slots(rows: DataFrame) -> DataFrame:
    """(tpl_id, block_id, slot, row_no, file_id, line_index, value): a row for each variable."""
    return rows.select("tpl_id", "block_id", "row_no", "file_id", "line_index", F.posexplode("values").alias("slot", "value"))


def dealt_cells(rows: DataFrame) -> DataFrame:
    """``slots`` of a cut table of rows, kept by column and in order, so that what follows needs no further shuffle or sort."""
    total = rows.agg(F.coalesce(F.sum(F.size("values")), F.lit(0))).first()[0]
    return cut_dealt(slots(rows), 1 + total // PART_CELLS, *KEY, order=(*KEY, "row_no"))


def row_refs(rows: DataFrame) -> DataFrame:
    """(tpl_id, block_id, row_no, file_delta, line_delta): positions as deltas, lines afresh in each file."""
    w = Window.partitionBy("tpl_id", "block_id").orderBy("row_no")
    before, line_before = F.lag("file_id").over(w), F.lag("line_index").over(w)
    line_delta = F.when(before == F.col("file_id"), F.col("line_index") - line_before).otherwise(F.col("line_index"))
    return rows.select("tpl_id", "block_id", "row_no", (F.col("file_id") - F.coalesce(before, F.lit(0))).alias("file_delta"), line_delta.alias("line_delta"))


def row_refs_decode(refs: DataFrame) -> DataFrame:
    """The file_id and line_index of ``row_refs``."""
    w = Window.partitionBy("tpl_id", "block_id").orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    files = refs.withColumn("file_id", F.sum("file_delta").over(w))
    run = Window.partitionBy("tpl_id", "block_id", "file_id").orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    return files.select("tpl_id", "block_id", "row_no", "file_id", F.sum("line_delta").over(run).alias("line_index"))


def _in_order() -> Window:
    return Window.partitionBy(*KEY).orderBy("row_no")


def int_values(cells: DataFrame) -> DataFrame:
    """``cells`` of the columns whose values are all canonical 62-bit integers, with them as ``v``."""
    v = F.when(is_canonical_int(F.col("value")), F.col("value").try_cast("long"))
    whole = cells.withColumn("v", F.when(F.abs(v) < 1 << 62, v))
    return whole.withColumn("ok", F.min(F.col("v").isNotNull()).over(Window.partitionBy(*KEY))).filter("ok").drop("ok")


def deltas(cells: DataFrame) -> DataFrame:
    """(key, row_no, d) of integer columns: the first value, then differences."""
    return int_values(cells).select(*KEY, "row_no", (F.col("v") - F.coalesce(F.lag("v").over(_in_order()), F.lit(0))).alias("d"))


def deltas_decode(coded: DataFrame) -> DataFrame:
    """(key, row_no, value) of ``deltas``."""
    total = F.sum("d").over(_in_order().rowsBetween(Window.unboundedPreceding, 0))
    return coded.select(*KEY, "row_no", total.cast("string").alias("value"))


def runs(cells: DataFrame) -> DataFrame:
    """(key, run, value, n, first_row): runs of equal values."""
    before = F.lag("value").over(_in_order())
    changed = F.when(before.isNull() | (before != F.col("value")), 1).otherwise(0)
    marked = cells.withColumn("changed", changed)
    run = F.sum("changed").over(_in_order().rowsBetween(Window.unboundedPreceding, 0)) - 1
    return marked.withColumn("run", run).groupBy(*KEY, "run").agg(F.min("value").alias("value"), F.count(F.lit(1)).alias("n"), F.min("row_no").alias("first_row"))


def runs_decode(coded: DataFrame) -> DataFrame:
    """(key, row_no, value) of ``runs``."""
    return coded.select(*KEY, F.explode(F.sequence(F.col("first_row"), F.col("first_row") + F.col("n") - 1)).alias("row_no"), "value")


def dictionaries(cells: DataFrame) -> DataFrame:
    """(key, value, n, index): distinct values in the order in which they are first seen."""
    seen = cells.groupBy(*KEY, "value").agg(F.count(F.lit(1)).alias("n"), F.min("row_no").alias("first_row"))
    return seen.select(*KEY, "value", "n", (F.row_number().over(Window.partitionBy(*KEY).orderBy("first_row")) - 1).cast("long").alias("index"))


def column_sizes(cells: DataFrame) -> DataFrame:
    """(key, n, raw_msgpack, varint, delta_varint, dictionary, rle): the packed size of each encoding, null where
    it doesn't apply."""
    octets = F.octet_length("value")
    v = F.when(is_canonical_int(F.col("value")), F.col("value").try_cast("long"))
    v = F.when(F.abs(v) < 1 << 62, v)
    d = F.col("v") - F.lag("v").over(_in_order())
    before = F.lag("value").over(_in_order())
    fresh = before.isNull() | (before != F.col("value"))
    marked = cells.withColumn("v", v).select(*KEY, "row_no", "value", "v", d.alias("d"), fresh.alias("fresh"), str_size(octets).alias("bytes"))
    step = F.coalesce("d", F.col("v"))
    per = marked.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("raw_bytes"), F.count("v").alias("ints"),
        F.sum(varint_size(zigzag(F.col("v")))).alias("v_bytes"), F.sum(varint_size(zigzag(step))).alias("d_bytes"),
        F.count("d").alias("steps"), F.count(F.when(F.col("d") >= 0, 1)).alias("up"), F.count(F.when(F.col("d") <= 0, 1)).alias("down"),
        F.count(F.when(F.abs("d") <= DELTA_STEP, 1)).alias("near"),
        F.count(F.when(F.col("fresh"), 1)).alias("runs"), F.sum(F.when(F.col("fresh"), F.col("bytes"))).alias("run_bytes"),
    )
    words = dictionaries(cells).groupBy(*KEY).agg(F.count(F.lit(1)).alias("k"), F.sum(str_size(F.octet_length("value"))).alias("word_bytes"), F.sum(F.col("n") * varint_size(F.col("index"))).alias("index_bytes"))
    counts = runs(cells).groupBy(*KEY).agg(F.sum(varint_size(F.col("n"))).alias("count_bytes"))
    all_ = per.join(words, KEY).join(counts, KEY)
    c, ints = F.col, F.col("ints") == F.col("n")
    friendly = ints & (c("steps") > 0) & ((F.greatest("up", "down") >= DELTA_SHARE * c("steps")) | (c("near") >= DELTA_SHARE * c("steps")))
    return all_.select(
        *KEY, "n",
        (F.lit(27) + bin_size(array_header(c("n")) + c("raw_bytes"))).alias("raw_msgpack"),
        F.when(ints, F.lit(22) + bin_size(c("v_bytes"))).alias("varint"),
        F.when(friendly, F.lit(28) + bin_size(c("d_bytes"))).alias("delta_varint"),
        F.when(c("k") < c("n"), F.lit(32) + array_header(c("k")) + c("word_bytes") + F.lit(8) + bin_size(c("index_bytes"))).alias("dictionary"),
        F.when(c("runs") < c("n"), F.lit(21) + array_header(c("runs")) + c("run_bytes") + F.lit(7) + bin_size(c("count_bytes"))).alias("rle"),
    )


def encoding_choice(sizes: DataFrame) -> DataFrame:
    """(key, n, encoding, size): the smallest encoding, ties to the earlier of ``ENCODINGS``."""
    options = F.array(*[F.struct(F.col(e).cast("long").alias("size"), F.lit(i).alias("order"), F.lit(e).alias("encoding")) for i, e in enumerate(ENCODINGS)])
    best = F.array_min(F.filter(options, lambda x: x["size"].isNotNull()))
    return sizes.select(*KEY, "n", best.alias("best")).select(*KEY, "n", F.col("best.encoding").alias("encoding"), F.col("best.size").alias("size"))


def encoded(cells: DataFrame, choice: DataFrame) -> DataFrame:
    """(key, encoding, n, first_row, words, numbers): the chosen encoding's data, by column.

    words: raw values, dictionary, or run values; numbers: integers, differences, indexes, or run lengths.
    A column has a block's rows at most, so it is one bounded row.
    """
    chosen = cells.join(choice.select(*KEY, "encoding"), KEY)
    e, row, value = F.col("encoding"), F.col("row_no"), F.col("value")
    v = F.when(e.isin("varint", "delta_varint"), value.try_cast("long"))
    fresh = F.coalesce(F.lag("value").over(_in_order()) != value, F.lit(True))
    first = F.min("row_no").over(Window.partitionBy(*KEY, "value"))
    marked = chosen.withColumns({"v": v, "fresh": fresh, "first": first}).withColumn("d", F.col("v") - F.coalesce(F.lag("v").over(_in_order()), F.lit(0)))
    index = (F.dense_rank().over(Window.partitionBy(*KEY).orderBy("first")) - 1).cast("long")
    number = F.when(e == "varint", F.col("v")).when(e == "delta_varint", F.col("d")).when(e == "dictionary", F.col("index"))
    word = (e == "raw_msgpack") | ((e == "dictionary") & (F.col("first") == row)) | ((e == "rle") & F.col("fresh"))
    in_order = lambda x: F.array_sort(F.collect_list(x))
    one = marked.withColumn("index", index).groupBy(*KEY, "encoding").agg(
        F.count(F.lit(1)).alias("n"), F.min("row_no").alias("first_row"),
        in_order(F.when(word, F.struct(row.alias("row"), value.alias("x")))).alias("w"), in_order(F.when(number.isNotNull(), F.struct(row.alias("row"), number.alias("x")))).alias("i"),
    )
    listed = one.select(*KEY, "encoding", "n", "first_row", F.transform("w", lambda x: x["x"]).alias("words"), F.transform("w", lambda x: x["row"]).alias("starts"), F.transform("i", lambda x: x["x"]).alias("numbers"))
    ends = F.concat(F.slice("starts", 2, F.greatest(F.size("starts"), F.lit(1))), F.array(F.col("first_row") + F.col("n")))
    lengths = F.zip_with(ends, F.col("starts"), lambda a, b: a - b)
    words = F.when(e.isin("raw_msgpack", "dictionary", "rle"), F.col("words"))
    numbers = F.when(e == "rle", lengths).when(e != "raw_msgpack", F.col("numbers"))
    return listed.select(*KEY, "encoding", "n", "first_row", words.alias("words"), numbers.alias("numbers"))


def decoded(columns: DataFrame) -> DataFrame:
    """(key, row_no, value) of ``encoded``; a column whose data aren't as many as its rows is an error."""
    e, words, numbers = F.col("encoding"), F.col("words"), F.col("numbers")
    repeated = F.flatten(F.zip_with(words, numbers, lambda w, n: F.array_repeat(w, n.cast("int"))))
    values = (
        F.when(e == "raw_msgpack", words).when(e.isin("varint", "delta_varint"), F.transform(numbers, lambda x: x.cast("string")))
        .when(e == "dictionary", F.transform(numbers, lambda i: F.element_at(words, i.cast("int") + 1))).when(e == "rle", repeated)
    )
    checked = F.when(F.size(values) == F.col("n"), values).otherwise(F.raise_error(F.lit("column length differs from its rows")))
    each = columns.select(*KEY, "encoding", "first_row", F.posexplode(checked).alias("at", "value")).select(*KEY, "encoding", (F.col("first_row") + F.col("at")).alias("row_no"), "value")
    total = F.sum(F.col("value").try_cast("long")).over(_in_order().rowsBetween(Window.unboundedPreceding, 0))
    steps = each.filter("encoding = 'delta_varint'").select(*KEY, "row_no", total.cast("string").alias("value"))
    return each.filter("encoding <> 'delta_varint'").select(*KEY, "row_no", "value").union(steps)


def packed(coded: DataFrame) -> DataFrame:
    """``encoded`` with the numbers as bytes: integers and differences signed, indexes and run lengths unsigned."""
    signed = F.col("encoding").isin("varint", "delta_varint")
    return coded.select(*KEY, "encoding", "n", "first_row", "words", varint_bytes("numbers", signed).alias("data"), F.size("numbers").alias("count"))


def unpacked(columns: DataFrame) -> DataFrame:
    """The columns of ``packed`` as ``encoded`` has them; bytes that don't hold the numbers are an error."""
    signed = F.col("encoding").isin("varint", "delta_varint")
    return columns.select(*KEY, "encoding", "n", "first_row", "words", varint_longs("data", "count", signed).alias("numbers"))


def row_mode_size(found: DataFrame) -> DataFrame:
    """(size): packed bytes of all row records: [template, values] or [-1, line]."""
    value_bytes = F.aggregate(F.transform("values", lambda v: str_size(F.octet_length(v)).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    id_bytes = F.when(F.col("tpl_id") < 128, 1).when(F.col("tpl_id") < 256, 2).when(F.col("tpl_id") < 65536, 3).otherwise(5)
    size = F.when(F.col("tpl_id").isNotNull(), 1 + id_bytes + array_header(F.size("values")) + value_bytes).otherwise(2 + str_size(F.octet_length("line")))
    return found.agg(F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("size"))


def mode_sizes(found: DataFrame, refs: DataFrame, choice: DataFrame) -> DataFrame:
    """(row_size, columnar_size, mode) of records, the ``row_refs`` of their template rows, and their columns' encodings.

    Columns take their encodings' bytes, two varints a row for its place, and the packed raw lines.
    """
    ref = refs.agg(F.coalesce(F.sum(varint_size(F.col("file_delta")) + varint_size(F.col("line_delta"))), F.lit(0)).alias("r"))
    raw = found.filter("tpl_id is null").agg(F.coalesce(F.sum(str_size(F.octet_length("line"))), F.lit(0)).alias("l"))
    data = choice.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("c"))
    both = row_mode_size(found).withColumnRenamed("size", "row_size").join(data).join(ref).join(raw)
    both = both.select("row_size", (F.col("c") + F.col("r") + F.col("l")).cast("long").alias("columnar_size"))
    return both.withColumn("mode", F.when(F.col("columnar_size") < F.col("row_size"), "columnar").otherwise("row"))
