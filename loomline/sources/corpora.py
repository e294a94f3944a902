"""Corpora as tables: files of a directory tree, or rows of a table, and their lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.operators.numbering import positions


#: Bytes a core below which a table's rows are dealt over all cores.
SPREAD_BYTES = 32 << 20


def directory(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, path, length, content, is_text) of all files under ``path``, numbered by path component.

    A path that is no directory is a ValueError.  A file is text if all its bytes are UTF-8.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hadoop) or not fs.getFileStatus(hadoop).isDirectory():
        raise ValueError(f"Not a directory: {path}")
    root = fs.resolvePath(hadoop).toString().rstrip("/") + "/"
    listed, empty, some = fs.listFiles(hadoop, True), [], False
    while listed.hasNext():  # the scan leaves empty files out
        one = listed.next()
        some = some or one.getLen() > 0
        if not one.getLen():
            empty.append((one.getPath().toString()[len(root) :], 0, bytearray()))
    files = spark.createDataFrame(empty, "path string, length long, content binary")
    if some:
        read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        files = files.union(read.select(F.expr(f"substring(path, {len(root) + 1})").alias("path"), "length", "content"))
    numbered = positions(files.select("path", F.split("path", "/").alias("parts")), ["parts"], "file_id").drop("parts")
    files = files.join(numbered, "path")
    return files.select("file_id", "path", "length", "content", F.is_valid_utf8(F.col("content").cast("string")).alias("is_text"))


def one_file(spark: SparkSession, path: str) -> DataFrame:
    """The table of ``directory`` for a single file, whose path is its name; anything else is a ValueError."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hadoop) or fs.getFileStatus(hadoop).isDirectory():
        raise ValueError(f"Not a file: {path}")
    if fs.getFileStatus(hadoop).getLen():
        read = spark.read.format("binaryFile").load(path).select("length", "content")
    else:
        read = spark.createDataFrame([(0, bytearray())], "length long, content binary")
    return read.select(F.lit(0).cast("long").alias("file_id"), F.lit(hadoop.getName()).alias("path"), "length", "content", F.is_valid_utf8(F.col("content").cast("string")).alias("is_text"))


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` of a scan, dealt over all cores if they are few bytes in few files; larger tables have parts enough of their own."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return rows.repartition(cores) if size < cores * SPREAD_BYTES and len(rows.inputFiles()) < cores else rows


def rows_as_files(spark: SparkSession, sf_dir: str, corpus: str) -> DataFrame:
    """(file_id, text) of a table that serves as a corpus: documents, pages, or conversations and events, whose
    rows are the lines of a file."""
    read = spark.read.parquet(f"{sf_dir}/{corpus}.parquet")
    if corpus == "documents":
        return spread(read.select(F.col("doc_id").alias("file_id"), F.coalesce("text", F.lit("")).alias("text")))
    if corpus == "pages":
        return spread(read.select(F.col("page_id").alias("file_id"), F.coalesce("html", F.lit("")).alias("text")))
    raise ValueError(f"no such corpus: {corpus}")


def lines_of_text(files: DataFrame) -> DataFrame:
    """(file_id, line_index, line): only newlines end lines, and the piece after the last one is a line too."""
    return files.select("file_id", F.posexplode(F.split("text", "\n", -1)).alias("line_index", "line"))


def lines_of_files(files: DataFrame) -> DataFrame:
    """Lines of the text files of a directory table."""
    return lines_of_text(files.filter("is_text").select("file_id", F.col("content").cast("string").alias("text")))


def table_lines(spark: SparkSession, sf_dir: str, corpus: str) -> DataFrame:
    """(file_id, line_index, line) of a table as a corpus; of events the props, by initial letter of type and by id, and of conversations
    the turns.  Null lines are empty."""
    if corpus in ("documents", "pages"):
        return lines_of_text(rows_as_files(spark, sf_dir, corpus))
    read = spark.read.parquet(f"{sf_dir}/{corpus}.parquet")
    if corpus == "events":
        return spread(read.select(F.ascii("event_type").cast("long").alias("file_id"), F.col("event_id").alias("line_index"), F.coalesce("props", F.lit("")).alias("line")))
    if corpus == "conversations":
        return spread(read.select(F.col("conv_id").alias("file_id"), F.col("turn").alias("line_index"), F.coalesce("text", F.lit("")).alias("line")))
    raise ValueError(f"no such corpus: {corpus}")
