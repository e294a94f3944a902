"""Chunks of byte strings: fixed and content-defined cutting, dedup, sequences, restore, similarity and deltas."""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.operators.numbering import positions
from loomline.sources.batches import pieces

# Chunk sizes and boundary mask, share of equal bytes that makes a base, and bases looked at.
CHUNK = 4096
CDC_MIN, CDC_MAX, CDC_MASK = 2048, 8192, 4095
SIMILARITY, CANDIDATES = 0.8, 64
#: Chunks of a range in which the sequential rule runs; ranges run in parallel.
RANGE = 65_536
#: What seeds the table of byte values; archives cut elsewhere agree only if their seed is given.
GEAR_SEED = b"loomline-gear-"


def fixed_chunks(files: DataFrame, size: int = CHUNK) -> DataFrame:
    """(file_id, seq, data) of binary ``content``; the last chunk of a file may be shorter, empty files have none."""
    length = F.octet_length("content")
    count = F.floor((length + size - 1) / size)
    seq = F.explode(F.when(count > 0, F.sequence(F.lit(0).cast("long"), count - 1))).alias("seq")
    return files.select("file_id", "content", seq).select("file_id", F.col("seq").cast("int").alias("seq"), F.substring("content", (F.col("seq") * size + 1).cast("int"), F.lit(size)).alias("data"))


def gear_table(seed: bytes = GEAR_SEED) -> np.ndarray:
    """One 64-bit value for each byte, from SHA-256 of the seed and the byte."""
    return np.array([int.from_bytes(hashlib.sha256(seed + bytes([i])).digest()[:8], "big") for i in range(256)], np.uint64)


def cut_points(data: bytes, table: np.ndarray, least: int = CDC_MIN, most: int = CDC_MAX, mask: int = CDC_MASK) -> list[int]:
    """Ends of the content-defined chunks of ``data``.

    A chunk ends after the first byte, ``least`` or more into it, at which the masked rolling hash of the bytes
    from there on is zero, at ``most`` bytes in any case, and a rest of at most ``least`` is one chunk.  The low
    bits of the hash depend on the last few bytes only, so the hash of full windows is computed for all places
    at once; just the first bytes after a restart are summed apart.
    """
    n, reach = len(data), mask.bit_length()
    values = table[np.frombuffer(data, np.uint8)]
    rolling = np.zeros(n, np.uint64)
    for back in range(min(reach, n)):
        rolling[back:] += values[: n - back] << np.uint64(back)
    zero = np.nonzero((rolling & np.uint64(mask)) == 0)[0]
    ends, at = [], 0
    while n - at > least:
        limit, end = min(at + most, n), 0
        h = 0
        for i in range(at + least, min(at + least + reach - 1, limit)):
            h = (h << 1) + int(values[i])
            if h & mask == 0:
                end = i + 1
                break
        if not end:
            k = int(np.searchsorted(zero, at + least + reach - 1))
            end = int(zero[k]) + 1 if k < len(zero) and zero[k] < limit else limit
        ends.append(end)
        at = end
    return ends + [n] * (at < n)


def content_chunks(files: DataFrame, seed: bytes = GEAR_SEED, least: int = CDC_MIN, most: int = CDC_MAX, mask: int = CDC_MASK) -> DataFrame:
    """(file_id, seq, data) cut at content-defined places; a file is cut in one task, files in parallel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = gear_table(seed)
        for batch in batches:
            for piece in pieces(batch, 1):
                ids, seqs, chunks = [], [], []
                for file_id, data in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                    at = 0
                    for seq, end in enumerate(cut_points(data or b"", table, least, most, mask)):
                        ids.append(file_id)
                        seqs.append(seq)
                        chunks.append(data[at:end])
                        at = end
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(seqs, pa.int32()), pa.array(chunks, pa.binary())], ["file_id", "seq", "data"])

    return files.select(F.col("file_id").cast("long"), "content").mapInArrow(run, "file_id long, seq int, data binary")


def chunk_dictionary(chunks: DataFrame) -> DataFrame:
    """(chunk_id, sha, data, length, n): distinct chunks, by SHA-256, numbered as first seen."""
    first = F.min(F.struct("file_id", "seq"))
    distinct = chunks.withColumn("sha", F.sha2("data", 256)).groupBy("sha").agg(F.first("data").alias("data"), F.count(F.lit(1)).alias("n"), first.alias("first"))
    flat = distinct.select("sha", "data", F.octet_length("data").cast("long").alias("length"), "n", F.col("first.file_id").alias("first_file"), F.col("first.seq").alias("first_seq"))
    return positions(flat, ["first_file", "first_seq"], "chunk_id")


def file_sequence(chunks: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(file_id, seq, chunk_id): which chunks make a file."""
    return chunks.select("file_id", "seq", F.sha2("data", 256).alias("sha")).join(dictionary.select("sha", "chunk_id"), "sha").select("file_id", "seq", "chunk_id")


def restore_chunks(sequence: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(file_id, content) of files; a chunk that the dictionary lacks is an error."""
    joined = sequence.join(dictionary.select("chunk_id", "data"), "chunk_id", "left")
    data = F.when(F.col("data").isNull(), F.raise_error(F.lit("missing chunk"))).otherwise(F.col("data"))
    ordered = F.array_sort(F.collect_list(F.struct("seq", F.hex(data).alias("data"))))
    return joined.groupBy("file_id").agg(F.unhex(F.array_join(F.transform(ordered, lambda x: x["data"]), "")).alias("content"))


def dedup_ratio(sequence: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(n_chunks, n_distinct, raw_bytes, kept_bytes, ratio)."""
    every = sequence.join(dictionary.select("chunk_id", "length"), "chunk_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.coalesce(F.sum("length"), F.lit(0)).alias("raw_bytes"))
    kept = dictionary.agg(F.count(F.lit(1)).alias("n_distinct"), F.coalesce(F.sum("length"), F.lit(0)).alias("kept_bytes"))
    ratio = F.try_divide(F.col("raw_bytes").cast("double"), F.col("kept_bytes").cast("double"))
    return every.join(kept).select("n_chunks", "n_distinct", "raw_bytes", "kept_bytes", ratio.alias("ratio"))


def cross_file_chunks(sequence: DataFrame) -> DataFrame:
    """(chunk_id, n_files, n_uses) of the chunks that several files share."""
    grouped = sequence.groupBy("chunk_id").agg(F.count_distinct("file_id").alias("n_files"), F.count(F.lit(1)).alias("n_uses"))
    return grouped.filter("n_files > 1")


@F.pandas_udf(T.LongType())
def equal_bytes(a: pd.Series, b: pd.Series) -> pd.Series:
    """Number of places at which two byte strings agree; 0 if their lengths differ."""
    return pd.Series([int(np.count_nonzero(np.frombuffer(x, np.uint8) == np.frombuffer(y, np.uint8))) if len(x) == len(y) else 0 for x, y in zip(a, b, strict=True)])


def similar_pairs(dictionary: DataFrame, window: int = CANDIDATES) -> DataFrame:
    """(a, b, length, matches): each chunk with those of its length among the ``window`` before it, and their equal bytes.

    The join is on blocks of ids and on length, so it stays an equi-join.
    """
    block = F.floor(F.col("chunk_id") / window)
    left = dictionary.select(F.col("chunk_id").alias("a"), F.col("data").alias("x"), "length", F.explode(F.array(block, block - 1)).alias("block"))
    right = dictionary.select(F.col("chunk_id").alias("b"), F.col("data").alias("y"), F.col("length").alias("length2"), block.alias("block2"))
    near = left.join(right, (F.col("block") == F.col("block2")) & (F.col("length") == F.col("length2")) & (F.col("b") < F.col("a")) & (F.col("b") >= F.col("a") - window))
    return near.select("a", "b", "length", equal_bytes("x", "y").alias("matches"))


def best_bases(dictionary: DataFrame, window: int = CANDIDATES) -> DataFrame:
    """(chunk_id, base_id, matches): of the ``window`` chunks before each, the one of its length with the most equal
    bytes, if more than ``SIMILARITY`` of them are; ties to the latest.

    An approximation that runs in parallel: every chunk of the window may be a base, also one that is a delta itself,
    and none before the window (see ``sequential_deltas`` for the rule).
    """
    good = similar_pairs(dictionary, window).filter(F.col("matches") > F.floor(F.col("length") * SIMILARITY))
    best = good.groupBy("a").agg(F.max(F.struct("matches", "b")).alias("best"))
    return best.select(F.col("a").alias("chunk_id"), F.col("best.b").alias("base_id"), F.col("best.matches").alias("matches"))


DIFFS = T.ArrayType(T.StructType().add("off", "integer").add("byte", "short"))


def byte_delta(base: bytes, target: bytes) -> list[tuple[int, int]]:
    """Places and bytes at which target differs from base."""
    a, b = np.frombuffer(base[: len(target)], np.uint8), np.frombuffer(target, np.uint8)
    where = np.nonzero(a != b[: len(a)])[0].tolist() + list(range(len(a), len(b)))
    return [(i, int(b[i])) for i in where]


def apply_delta(base: bytes, length: int, diffs: list[tuple[int, int]]) -> bytes:
    out = bytearray(base[:length].ljust(length, b"\0"))
    for i, v in diffs:
        out[i] = v
    return bytes(out)


@F.pandas_udf(DIFFS)
def diffs_of(base: pd.Series, target: pd.Series) -> pd.Series:
    return pd.Series([byte_delta(a, b) for a, b in zip(base, target, strict=True)])


@F.pandas_udf(T.BinaryType())
def patched(base: pd.Series, length: pd.Series, diffs: pd.Series) -> pd.Series:
    return pd.Series([apply_delta(a, int(n), [(d["off"], d["byte"]) for d in x]) for a, n, x in zip(base, length, diffs, strict=True)])


def delta_size(diffs: list[tuple[int, int]]) -> int:
    """Packed bytes of a list of [offset, byte] pairs."""
    number = lambda x: 1 if x < 128 else 2 if x < 256 else 3 if x < 65536 else 5
    return (1 if len(diffs) <= 15 else 3 if len(diffs) <= 65535 else 5) + sum(1 + number(i) + number(v) for i, v in diffs)


def chunk_deltas(dictionary: DataFrame, bases: DataFrame) -> DataFrame:
    """(chunk_id, base_id, target_len, diffs) of the chunks with a base for which the difference is smaller."""
    pairs = bases.join(dictionary.select("chunk_id", F.col("data").alias("target"), "length"), "chunk_id")
    pairs = pairs.join(dictionary.select(F.col("chunk_id").alias("base_id"), F.col("data").alias("base")), "base_id")
    found = pairs.select("chunk_id", "base_id", F.col("length").alias("target_len"), diffs_of("base", "target").alias("diffs"))
    number = lambda x: F.when(x < 128, 1).when(x < 256, 2).when(x < 65536, 3).otherwise(5)
    size = F.aggregate("diffs", F.when(F.size("diffs") <= 15, 1).when(F.size("diffs") <= 65535, 3).otherwise(5), lambda acc, d: acc + 1 + number(d["off"]) + number(d["byte"]))
    return found.filter(size < F.col("target_len"))


def resolve_deltas(dictionary: DataFrame, deltas: DataFrame) -> DataFrame:
    """(chunk_id, data) of the chunks in ``deltas``; an unknown base is an error."""
    joined = deltas.join(dictionary.select(F.col("chunk_id").alias("base_id"), "data"), "base_id", "left")
    base = F.when(F.col("data").isNull(), F.raise_error(F.lit("unknown base chunk"))).otherwise(F.col("data"))
    return joined.select("chunk_id", patched(base, "target_len", "diffs").alias("data"))


def sequential_deltas(dictionary: DataFrame, width: int = RANGE) -> DataFrame:
    """(chunk_id, base_id, target_len, diffs) by the sequential rule: only chunks kept whole can be bases, and the
    last ``CANDIDATES`` of those are looked at.

    The rule makes each choice depend on those before it, so ids are dealt to ranges of ``width`` that run in
    parallel, each with its own bases; within a range the result is that of a single pass.  A range passes in order
    of ids, and a worker holds its last ``CANDIDATES`` bases and a piece of a batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole: deque[tuple[int, bytes]] = deque(maxlen=CANDIDATES)
        now = None
        for batch in batches:
            for piece in pieces(batch, 1):
                out = []
                for chunk_id, data in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                    if chunk_id // width != now:
                        now = chunk_id // width
                        whole.clear()
                    x, best = np.frombuffer(data, np.uint8), (0, -1, b"")
                    for base_id, base in whole:
                        if len(base) == len(data):
                            equal = int(np.count_nonzero(np.frombuffer(base, np.uint8) == x))
                            if equal > int(SIMILARITY * len(data)) and equal >= best[0]:
                                best = (equal, base_id, base)
                    diffs = byte_delta(best[2], data) if best[1] >= 0 else []
                    if best[1] >= 0 and delta_size(diffs) < len(data):
                        out.append((chunk_id, best[1], len(data), [dict(zip(("off", "byte"), d, strict=True)) for d in diffs]))
                    else:
                        whole.append((chunk_id, data))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), kinds, strict=True)], ["chunk_id", "base_id", "target_len", "diffs"])

    kinds = [pa.int64()] * 3 + [pa.list_(pa.struct([("off", pa.int32()), ("byte", pa.int16())]))]
    ranged = dictionary.select("chunk_id", "data").repartition(F.floor(F.col("chunk_id") / width)).sortWithinPartitions("chunk_id")
    return ranged.mapInArrow(run, f"chunk_id long, base_id long, target_len long, diffs {DIFFS.simpleString()}")
