"""Compressing a directory to a Parquet archive, restoring it, and comparing sizes.

An archive is a folder of Parquet tables with a ``manifest``.  Template archives keep files as rows (``records``) or
as encoded columns (``encoded_columns``, ``row_refs``, ``raw_lines``); files that are binary or have too little
structure are kept whole in ``raw_files``.  Chunk archives keep distinct chunks and each file's sequence of them, file
archives one file, as template rows or raw.
"""

from __future__ import annotations

import io
import os
import tarfile
from collections.abc import Iterable, Iterator
from pathlib import PurePosixPath

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from loomline.operators import chunks, columns, metrics, structure, templates
from loomline.session import cut, remove
from loomline.sources.corpora import directory, lines_of_files, one_file

VERSION, ARCHIVES = 2, ("template", "chunk", "file")
# How much larger than the baseline a template archive may be, and compression levels.
FALLBACK_RATIO, LEVEL, PACKED_LEVEL = 1.10, 3, 1
# When a dictionary is trained on chunks, from how many, and how large it is.
DICT_CHUNKS, DICT_BYTES, DICT_SAMPLES, DICT_MOST = 8, 32 << 10, 128, 64 << 10
#: Bytes of files that one task puts in a tar to measure the baseline; lines of a block of a file archive, and text bytes of one of its parts.
TAR_BYTES, BLOCK_LINES, FILE_BYTES = 256 << 20, 8192, 64 << 20


class _Sink(io.RawIOBase):
    """Compresses what is written; ``done`` takes the compressed bytes."""

    def __init__(self, done):
        self.press, self.done = zstandard.ZstdCompressor(level=LEVEL).compressobj(), done

    def write(self, data) -> int:
        self.done(self.press.compress(bytes(data)))
        return len(data)

    def writable(self) -> bool:
        return True


def _tar(rows: Iterable[tuple[str, bytes]], done) -> None:
    """A tar of (path, content) with fixed owners, times and modes, compressed; files pass one at a time."""
    sink = _Sink(done)
    with tarfile.open(fileobj=sink, mode="w|", format=tarfile.PAX_FORMAT) as tar:
        for path, content in rows:
            info = tarfile.TarInfo(path)
            info.size, info.mtime, info.mode = len(content), 0, 0o644
            tar.addfile(info, io.BytesIO(content))
    done(sink.press.flush())


def tar_zstd(files: DataFrame) -> bytes:
    """The files in order as a compressed tar, on the driver."""
    out = io.BytesIO()
    _tar(((r.path, r.content) for r in files.orderBy("file_id").select("path", "content").toLocalIterator()), out.write)
    return out.getvalue()


def tar_size(files: DataFrame, part_bytes: int = TAR_BYTES) -> int:
    """Bytes of the compressed tar; of more than ``part_bytes`` of files, of as many tars as there are parts."""
    total = files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    parts = max(1, -(-total // part_bytes))
    ordered = files.select("file_id", "path", "content").repartitionByRange(parts, "file_id").sortWithinPartitions("file_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes: list[int] = []
        rows = ((path.as_py(), content.as_py()) for batch in batches for path, content in zip(batch.column(1), batch.column(2), strict=True))
        _tar(rows, lambda data: sizes.append(len(data)))
        yield pa.RecordBatch.from_arrays([pa.array([sum(sizes)], pa.int64())], ["size"])

    return ordered.mapInArrow(run, "size long").agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]


@F.pandas_udf(T.LongType())
def zstd_size(data):
    """Bytes of each value compressed alone."""
    press = zstandard.ZstdCompressor(level=LEVEL)
    return data.map(lambda x: len(press.compress(x)))


def dictionary_samples(dictionary: DataFrame) -> DataFrame:
    """(chunk_id, data) of every k-th chunk, at most ``DICT_SAMPLES``: none if there are too few or too small chunks."""
    n, total = dictionary.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    if n < DICT_CHUNKS or total < DICT_BYTES:
        return dictionary.select("chunk_id", "data").limit(0)
    step = max(1, n // DICT_SAMPLES)
    return dictionary.filter(F.col("chunk_id") % step == 0).filter(F.col("chunk_id") < step * DICT_SAMPLES).select("chunk_id", "data")


def train_dictionary(dictionary: DataFrame) -> bytes | None:
    """A compression dictionary from the samples, or None if there are none or they are too much alike."""
    samples = dictionary_samples(dictionary).orderBy("chunk_id").collect()
    if not samples:
        return None
    total = dictionary.agg(F.sum("length")).first()[0]
    try:
        return zstandard.train_dictionary(min(DICT_MOST, max(1024, total // 20)), [bytes(r.data) for r in samples]).as_bytes()
    except zstandard.ZstdError:
        return None


def with_dictionary(data: Column, trained: bytes, inflate: bool = False) -> Column:
    """Each value compressed with a trained dictionary, or back."""

    @F.pandas_udf(T.BinaryType())
    def run(values: pd.Series) -> pd.Series:
        kept = zstandard.ZstdCompressionDict(trained)
        one = zstandard.ZstdDecompressor(dict_data=kept).decompress if inflate else zstandard.ZstdCompressor(level=LEVEL, dict_data=kept).compress
        return values.map(one)

    return run(data)


def _save(df: DataFrame, archive: str, name: str) -> None:
    df.write.mode("overwrite").option("compression", "zstd").parquet(f"{archive}/{name}")


def _manifest(spark: SparkSession, archive: str, **values) -> None:
    row = {"version": VERSION, **values}
    _save(spark.createDataFrame([{k: str(v) for k, v in row.items()}]), archive, "manifest")


def read_manifest(spark: SparkSession, archive: str) -> dict[str, str]:
    """The manifest; a folder without one, an empty one, an unknown kind or version are ValueErrors."""
    try:
        row = spark.read.parquet(f"{archive}/manifest").first()
    except AnalysisException as e:
        raise ValueError(f"not an archive: {archive} has no manifest") from e
    if row is None:
        raise ValueError(f"not an archive: the manifest of {archive} is empty")
    found = row.asDict()
    if found.get("kind") not in ARCHIVES:
        raise ValueError(f"not an archive of a known kind: {found.get('kind')}")
    if found.get("version") != str(VERSION):
        raise ValueError(f"not an archive of version {VERSION}: {found.get('version')}")
    return found


def compress_templates(spark: SparkSession, source: str, archive: str, structured: bool = True, block_rows: int = columns.BLOCK_ROWS) -> dict:
    """Write a template archive of a directory; see ``template_archive``."""
    return template_archive(spark, directory(spark, source), archive, structured, block_rows)


def template_archive(spark: SparkSession, files: DataFrame, archive: str, structured: bool = True, block_rows: int = columns.BLOCK_ROWS) -> dict:
    """Write a template archive of ``files`` (file_id, path, length, content, is_text); the smallest of rows, columns
    and the tar baseline decides its mode.

    Returns the metrics that the manifest holds too.  Sizes compared are packed sizes before compression for
    rows against columns, and compressed bytes of the Parquet tables against the baseline.  What the mode doesn't need
    doesn't stay in the archive.
    """
    lines = lines_of_files(files)
    tokens = cut(structure.tokenize(lines, ["parts", "values"]) if structured else templates.tokenize(lines))
    counts = cut(templates.template_counts(tokens))
    dictionary = templates.template_dictionary(counts)
    found = cut(templates.records(tokens, dictionary))
    per_file = files.select("file_id", "is_text").join(templates.file_rates(found), "file_id", "left").na.fill(0)
    rates = cut(templates.fallback_reason(per_file, F.col("is_text")))
    kept = rates.filter("reason is null").select("file_id")
    good = cut(found.join(kept, "file_id", "left_semi"))
    rows = cut(columns.numbered_rows(good, block_rows))
    cells = columns.dealt_cells(rows)
    choice = cut(columns.encoding_choice(columns.column_sizes(cells)))
    refs = columns.row_refs(rows)
    row_size, column_size, mode = columns.mode_sizes(good, refs, choice).first()
    _save(files.select("file_id", "path", "length", "is_text"), archive, "files")
    _save(dictionary.select("tpl_id", "parts"), archive, "templates")
    _save(files.join(kept, "file_id", "left_anti").select("file_id", "content"), archive, "raw_files")
    if mode == "row":
        _save(good.repartitionByRange("file_id").sortWithinPartitions("file_id", "line_index"), archive, "records")
    else:
        _save(columns.packed(columns.encoded(cells, choice)), archive, "encoded_columns")
        _save(refs.sortWithinPartitions("tpl_id", "block_id", "row_no"), archive, "row_refs")
        _save(good.filter("tpl_id is null").select("file_id", "line_index", "line"), archive, "raw_lines")
    baseline, chosen = tar_size(files), mode
    if _stored(spark, archive) > FALLBACK_RATIO * baseline:
        chosen = "raw"
        remove(spark, *(f"{archive}/{name}" for name in ("templates", "records", "encoded_columns", "row_refs", "raw_lines")))
        _save(files.select("file_id", "content"), archive, "raw_files")
    summary = metrics.archive_metrics(rates, counts).first().asDict()
    summary |= {"kind": "template", "mode": chosen, "layout": mode, "row_mode_size": row_size, "columnar_size": column_size, "tarzstd_size": baseline, "compressed_size": _stored(spark, archive), "structured": structured}
    summary["raw_tar_zstd_files"] = summary["num_files"] if chosen == "raw" else 0
    _manifest(spark, archive, **summary)
    return summary


def compress_file(spark: SparkSession, source: str, archive: str) -> dict:
    """Write an archive of a single file: as template rows if a template recurs and they take no more bytes, else raw."""
    files = cut(one_file(spark, source))
    tokens = cut(templates.tokenize(lines_of_files(files)))
    counts = cut(templates.template_counts(tokens))
    dictionary = templates.template_dictionary(counts)
    _save(files.select("file_id", "path", "length", "is_text"), archive, "files")
    _save(files.select("file_id", "content"), archive, "raw_files")
    raw_size, size = _stored(spark, f"{archive}/raw_files"), None
    mode = "raw"
    if not dictionary.isEmpty():
        _save(dictionary.select("tpl_id", "parts"), archive, "templates")
        found = templates.records(tokens, dictionary).withColumn("block", F.floor(F.col("line_index") / BLOCK_LINES))
        items = F.array_sort(F.collect_list(F.struct("line_index", "tpl_id", "values", "line")))
        bare = F.transform(items, lambda x: F.struct(x["tpl_id"].alias("tpl_id"), x["values"].alias("values"), x["line"].alias("line")))
        blocks = found.groupBy("block").agg(bare.alias("items"))
        _save(blocks.repartitionByRange(max(1, files.first().length // FILE_BYTES), "block"), archive, "records")
        size = _stored(spark, f"{archive}/templates") + _stored(spark, f"{archive}/records")
        mode = "template" if size <= raw_size else "raw"
    remove(spark, *(f"{archive}/{name}" for name in (("raw_files",) if mode == "template" else ("templates", "records"))))
    reuse = templates.reuse_rate(counts).first()
    summary = {"kind": "file", "mode": mode, "raw_size": raw_size, "template_size": size, "template_reuse_rate": reuse.rate, "num_lines": reuse.n_lines, "tarzstd_size": tar_size(files), "compressed_size": _stored(spark, archive)}
    _manifest(spark, archive, **summary)
    return summary


def _stored(spark: SparkSession, archive: str) -> int:
    """Bytes of the archive's Parquet files."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(archive)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()


def restored_files(spark: SparkSession, archive: str) -> DataFrame:
    """(file_id, path, content) of an archive."""
    manifest = read_manifest(spark, archive)
    table = lambda name: spark.read.parquet(f"{archive}/{name}")
    files = table("files").select("file_id", "path")
    if manifest["kind"] == "chunk":
        kept = table("chunks")
        if int(manifest["dictionary_bytes"]):
            trained = bytes(table("dictionary").first().data)
            kept = cut(kept.select("chunk_id", with_dictionary(F.col("data"), trained, inflate=True).alias("data")))
        if manifest["delta"] == "True":
            kept = kept.unionByName(chunks.resolve_deltas(kept, table("chunk_deltas")))
        found = chunks.restore_chunks(table("file_sequence"), kept)
        return files.join(found, "file_id", "left").select("file_id", "path", F.coalesce("content", F.unhex(F.lit(""))).alias("content"))
    if manifest["mode"] == "raw":
        return files.join(table("raw_files"), "file_id").select("file_id", "path", "content")
    dictionary = table("templates")
    if manifest["kind"] == "file":
        each = table("records").select("block", F.posexplode("items").alias("at", "x"))
        lines = templates.restored(each.select(F.lit(0).cast("long").alias("file_id"), (F.col("block") * BLOCK_LINES + F.col("at")).alias("line_index"), "x.*"), dictionary)
    elif manifest["mode"] == "row":
        lines = templates.restored(table("records"), dictionary)
    else:
        cells = columns.decoded(columns.unpacked(table("encoded_columns")))
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("slot", "value"))), lambda x: x["value"])
        values = cells.groupBy("tpl_id", "block_id", "row_no").agg(ordered.alias("values"))
        refs = columns.row_refs_decode(table("row_refs")).join(values, ["tpl_id", "block_id", "row_no"], "left")
        parts = refs.join(dictionary, "tpl_id")
        line = templates.rebuild(F.col("parts"), F.coalesce("values", F.expr("cast(array() as array<string>)")))
        lines = parts.select("file_id", "line_index", line.alias("line")).unionByName(table("raw_lines"))
    texts = templates.restored_texts(lines).select("file_id", F.col("text").cast("binary").alias("content"))
    if manifest["kind"] == "template":
        texts = texts.unionByName(table("raw_files"))
    return files.join(texts, "file_id").select("file_id", "path", "content")


def compress_chunks(spark: SparkSession, source: str, archive: str, chunking: str = "fixed", delta: bool = False, seed: bytes = chunks.GEAR_SEED, single: bool = False) -> dict:
    """Write a chunk archive of a directory, or of a ``single`` file; see ``chunk_archive``."""
    return chunk_archive(spark, (one_file if single else directory)(spark, source), archive, chunking, delta, seed)


def chunk_archive(spark: SparkSession, files: DataFrame, archive: str, chunking: str = "fixed", delta: bool = False, seed: bytes = chunks.GEAR_SEED) -> dict:
    """Write a chunk archive of ``files`` (file_id, path, length, content): distinct chunks in order of id, compressed
    with a dictionary trained on them where there are enough, and the sequence of each file."""
    if chunking not in ("fixed", "cdc"):
        raise ValueError(f"unknown chunking: {chunking}")
    pieces = cut(chunks.fixed_chunks(files) if chunking == "fixed" else chunks.content_chunks(files, seed))
    dictionary = chunks.chunk_dictionary(pieces)
    sequence = cut(chunks.file_sequence(pieces, dictionary))
    _save(files.select("file_id", "path", "length"), archive, "files")
    _save(sequence, archive, "file_sequence")
    by_id = lambda df: df.repartitionByRange("chunk_id").sortWithinPartitions("chunk_id")
    whole = dictionary
    if delta:
        deltas = cut(chunks.sequential_deltas(dictionary))
        _save(by_id(deltas), archive, "chunk_deltas")
        whole = dictionary.join(deltas, "chunk_id", "left_anti")
    trained = train_dictionary(whole)
    data = with_dictionary(F.col("data"), trained) if trained else F.col("data")
    _save(by_id(whole.select("chunk_id", data.alias("data"))), archive, "chunks")
    if trained:
        _save(spark.createDataFrame([(bytearray(trained),)], "data binary"), archive, "dictionary")
    summary = chunks.dedup_ratio(sequence, dictionary).first().asDict()
    summary |= {"kind": "chunk", "chunking": chunking, "delta": delta, "compressed_size": _stored(spark, archive), "tarzstd_size": tar_size(files), "dictionary_bytes": len(trained or b"")}
    _manifest(spark, archive, **summary)
    return summary


def safe_path(root: str, path: str) -> str:
    """The place of an archived path under ``root``; absolute paths and those that leave it are a ValueError."""
    parts = PurePosixPath(path)
    if parts.is_absolute() or ".." in parts.parts or not parts.parts:
        raise ValueError(f"unsafe path in archive: {path}")
    return os.path.join(root, *parts.parts)


def _write_file(target: str, path: str, content: bytes) -> None:
    place = safe_path(target, path)
    os.makedirs(os.path.dirname(place), exist_ok=True)
    with open(place, "wb") as f:
        f.write(content)


def restore(spark: SparkSession, archive: str, target: str, shared: bool | None = None) -> list[str]:
    """Write an archive's files under a folder; returns their paths in order.

    Executors write them where the folder is ``shared`` with them (by default where the master is local), else
    the driver does, one file at a time.  A path that would leave the folder is a ValueError, before anything is written.
    """
    found = restored_files(spark, archive)
    for row in spark.read.parquet(f"{archive}/files").select("path").toLocalIterator():
        safe_path(target, row.path)
    if shared is None:
        shared = spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster")
    if not shared:
        written = []
        for row in found.orderBy("file_id").toLocalIterator():
            _write_file(target, row.path, row.content)
            written.append(row.path)
        return written

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(1), batch.column(2), strict=True):
                _write_file(target, path.as_py(), content.as_py())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["file_id", "path"])

    return [r.path for r in cut(found.select("file_id", "path", "content").mapInArrow(run, "file_id long, path string")).orderBy("file_id").toLocalIterator()]


def differences(spark: SparkSession, source: str, archive: str, single: bool = False) -> DataFrame:
    """Files of the directory, or the ``single`` file, that the archive doesn't restore exactly."""
    return metrics.tree_differences((one_file if single else directory)(spark, source), restored_files(spark, archive))
