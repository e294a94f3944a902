"""Line dedup over a sharded minimal perfect hash.

Distinct lines are counted once by a 128-bit hash.  The hashes of lines held by ``min_docs`` documents
or more are dealt to shards; each shard becomes a minimal perfect hash with compact arrays beside it
(fingerprint, document count, keeper).  Documents then probe the arrays: their lines are never joined.
While all shards together stay under ``broadcast_bytes`` they go to the executors in one broadcast of
checked size; beyond it the line hashes are dealt to (shard, salt) groups, each of which loads its own
shard alone, so that neither a shard nor a line that a third of all documents hold gathers in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.llm.common import ASCII_SPACE, arrow_schema, cut, slices, text_bytes

#: Distinct repeated lines in a shard, about; bounds the memory of the task that builds it.
SHARD_KEYS = 200_000
#: Line occurrences of a shard that one probing task reads, about.
SALT_ROWS = 1_000_000
_MIX = 0x9E3779B97F4A7C15


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The line stripped and lower-cased (ASCII), or None if it has fewer than ``min_chars`` code points."""
    key = line.strip(ASCII_SPACE).lower()
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return key


class PerfectHash:
    """Minimal perfect hash of distinct uint64 keys: levels of bit arrays; a key's place is its bit's rank.

    Each level sets the bits that exactly one remaining key asks for; the others go on to the next.
    """

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks, base = [], 0
        for bits in levels:
            counts = np.cumsum(bits, dtype=np.int64)
            self.ranks.append(counts + (base - 1))
            base += int(counts[-1]) if len(bits) else 0
        self.size = base

    @staticmethod
    def _slot(keys: np.ndarray, level: int, width: int) -> np.ndarray:
        x = (keys ^ np.uint64((level + 1) * _MIX % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        return ((x ^ (x >> np.uint64(29))) % np.uint64(width)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        left, levels = np.unique(keys.astype(np.uint64)), []
        while len(left):
            width = max(8, len(left) * 3 // 2)
            slot = cls._slot(left, len(levels), width)
            alone = np.bincount(slot, minlength=width) == 1
            levels.append(alone)
            left = left[~alone[slot]]
        return cls(levels)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Places of ``keys``; a key that was not built in gets some place or -1."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            if not len(left):
                break
            slot = self._slot(keys[left], level, len(bits))
            hit = bits[slot]
            out[left[hit]] = ranks[slot[hit]]
            left = left[~hit]
        return out

    def to_bytes(self) -> bytes:
        head = np.array([len(self.levels), *map(len, self.levels)], np.int64).tobytes()
        return head + b"".join(np.packbits(x).tobytes() for x in self.levels)

    @classmethod
    def from_bytes(cls, blob: bytes) -> PerfectHash:
        n = int(np.frombuffer(blob, np.int64, 1)[0])
        widths, at, levels = np.frombuffer(blob, np.int64, n, 8), 8 * (n + 1), []
        for width in widths.tolist():
            size = (width + 7) // 8
            levels.append(np.unpackbits(np.frombuffer(blob, np.uint8, size, at), count=width).astype(bool))
            at += size
        return cls(levels)


class Shard:
    """A perfect hash with its fingerprint, count and keeper arrays."""

    def __init__(self, mph: bytes, fingerprints: bytes, counts: bytes, keepers: bytes):
        self.mph = PerfectHash.from_bytes(mph)
        self.fingerprints = np.frombuffer(fingerprints, np.int64)
        self.counts = np.frombuffer(counts, np.int64)
        self.keepers = np.frombuffer(keepers, np.int64)

    def drops(self, h1: np.ndarray, h2: np.ndarray, ids: np.ndarray, no_id: np.ndarray) -> np.ndarray:
        """Which occurrences are known repeated lines outside the document that keeps them."""
        place = self.mph(h1.view(np.uint64))
        known = place >= 0
        known[known] = self.fingerprints[place[known]] == h2[known]
        known[known] = no_id[known] | (self.keepers[place[known]] != ids[known])
        return known


SHARD_SCHEMA = "shard long, mph binary, fingerprints binary, counts binary, keepers binary"


def _build_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    h1 = pdf.h1.to_numpy(np.int64)
    mph = PerfectHash.build(h1.view(np.uint64))
    place = mph(h1.view(np.uint64))
    arrays = []
    for name in ("h2", "n", "keeper"):
        out = np.empty(len(h1), np.int64)
        out[place] = pdf[name].to_numpy(np.int64)
        arrays.append(out.tobytes())
    return pd.DataFrame([[int(pdf.shard.iloc[0]), mph.to_bytes(), *arrays]], columns=["shard", "mph", "fingerprints", "counts", "keepers"])


def _hash_lines(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), np.int64).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2, doc_id) of each distinct line key of each row that is long enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, 16 << 20):
            keys, rows = [], []
            for i, text in enumerate(text_bytes(batch.column(1))):
                own = {k for line in text.split(b"\n") if (k := line_key(line, min_chars))}
                keys += own
                rows += [i] * len(own)
            if keys:
                h1, h2 = _hash_lines(keys)
                yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), batch.column(0).take(pa.array(rows))], ["h1", "h2", "doc_id"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "h1 long, h2 long, doc_id long")


def repeated_lines(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """(h1, h2, n, keeper) of the repeated lines: documents that hold the line, and the largest of them."""
    pairs = line_hashes(docs, min_chars).distinct()
    counted = pairs.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper"))
    return cut(counted.filter((F.col("n") >= min_docs) & F.col("keeper").isNotNull()))


def _apply(batch: pa.RecordBatch, text_at: int, schema: pa.Schema, min_chars: int, drop) -> pa.RecordBatch:
    """The batch with its dropped lines gone.  drop: (row of each line, h1, h2) -> mask."""
    texts = [x.split(b"\n") for x in text_bytes(batch.column(text_at))]
    keys, where = [], []
    for i, lines in enumerate(texts):
        for j, line in enumerate(lines):
            if k := line_key(line, min_chars):
                keys.append(k)
                where.append((i, j))
    gone: dict[int, set[int]] = {}
    if keys:
        h1, h2 = _hash_lines(keys)
        at = np.array(where, np.int64)
        for i, j in at[drop(at[:, 0], h1, h2)].tolist():
            gone.setdefault(i, set()).add(j)
    kept = [b"\n".join([x for j, x in enumerate(lines) if j not in gone[i]] if i in gone else lines) for i, lines in enumerate(texts)]
    columns = [*batch.columns[: len(schema) - 2]]
    columns[text_at] = pa.array(kept, pa.binary()).cast(schema.field(text_at).type)
    counts = [pa.array([len(x) for x in texts], pa.int64()), pa.array([len(gone.get(i, ())) for i in range(len(texts))], pa.int64())]
    return pa.RecordBatch.from_arrays([*columns, *counts], schema=schema)


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """``docs`` with repeated lines removed from ``text``, and columns ``__ll_lines`` and ``__ll_dropped`` added.

    A line's key is the line stripped of ASCII white space and with A-Z lower-cased.  Keys of at least
    ``min_chars`` code points in at least ``min_docs`` distinct documents stay only in the largest doc_id.
    Null text counts as one empty line and comes back empty.  Rows with a null doc_id together count as
    one document and never keep a repeated line; rows that repeat a doc_id are one document and all keep
    their lines if that id is the keeper.  Texts of any length are read whole.  Other columns pass through,
    whatever their names.  An empty table comes back empty.
    """
    spark = docs.sparkSession
    repeated = repeated_lines(docs, min_chars, min_docs)
    total = repeated.count()
    shards = max(1, -(-total // SHARD_KEYS))
    dealt = repeated.withColumn("shard", F.pmod("h1", F.lit(shards)))
    index = cut(dealt.groupBy("shard").applyInPandas(_build_shard, SHARD_SCHEMA))
    fields = docs.schema.fields
    out = T.StructType([*fields, T.StructField("__ll_lines", T.LongType()), T.StructField("__ll_dropped", T.LongType())])
    arrow, text_at = arrow_schema(out), docs.columns.index("text")
    if total * 26 <= broadcast_bytes:
        id_at = docs.columns.index("doc_id")
        held = spark.sparkContext.broadcast({r.shard: tuple(map(bytes, r[1:])) for r in index.collect()})
        return docs.mapInArrow(_prober(held, shards, text_at, id_at, arrow, min_chars), out)
    return _routed(docs, index, repeated, shards, min_chars, out)


def _shard_of(h1: np.ndarray, shards: int) -> np.ndarray:
    """Same dealing as ``pmod(h1, shards)`` in Spark."""
    return h1 % shards


def _prober(held, shards: int, text_at: int, id_at: int, arrow: pa.Schema, min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = {k: Shard(*v) for k, v in held.value.items()}
        for batch in slices(batches, text_at, 16 << 20):
            ids_column = batch.column(id_at).cast(pa.int64())
            no_id = np.array(ids_column.is_null())
            ids = ids_column.fill_null(0).to_numpy(zero_copy_only=False)

            def drop(row, h1, h2, ids=ids, no_id=no_id):
                mask, shard = np.zeros(len(row), bool), _shard_of(h1, shards)
                for k, own in loaded.items():
                    mine = shard == k
                    if mine.any():
                        mask[mine] = own.drops(h1[mine], h2[mine], ids[row[mine]], no_id[row[mine]])
                return mask

            yield _apply(batch, text_at, arrow, min_chars, drop)

    return run


def _routed(docs: DataFrame, index: DataFrame, repeated: DataFrame, shards: int, min_chars: int, out: T.StructType) -> DataFrame:
    """The way beyond the broadcast bound: hashes probe in (shard, salt) groups, verdicts go back by doc_id; rows without
    one get theirs by the hash of their text, so that they form no common group."""
    arrow, text_at = arrow_schema(out), docs.columns.index("text")
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    null = F.col("doc_id").isNull()
    both = [line_hashes(some, min_chars).withColumn("no_id", F.lit(x)) for x, some in ((False, named.filter(~null)), (True, named.filter(null).select(F.xxhash64("text").alias("doc_id"), "text")))]
    seen = cut(both[0].union(both[1]).distinct().withColumn("shard", F.pmod("h1", F.lit(shards))))
    salts = cut(seen.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / SALT_ROWS).cast("int").alias("salts")))
    probes = seen.join(salts, "shard").withColumn("salt", F.pmod(F.xxhash64("h1", "h2", "doc_id", "no_id"), F.col("salts"))).drop("salts")
    copies = index.join(salts, "shard").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts").cast("long") - 1))).drop("salts")

    def probe(occurrences: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        if not len(occurrences) or not len(shard):
            return pd.DataFrame({"h1": [], "h2": [], "doc_id": [], "no_id": []}).astype({"h1": "int64", "h2": "int64", "doc_id": "int64", "no_id": "bool"})
        r = shard.iloc[0]
        gone = Shard(r.mph, r.fingerprints, r.counts, r.keepers).drops(occurrences.h1.to_numpy(np.int64), occurrences.h2.to_numpy(np.int64), occurrences.doc_id.to_numpy(np.int64), occurrences.no_id.to_numpy(bool))
        return occurrences.loc[gone, ["h1", "h2", "doc_id", "no_id"]]

    hits = probes.groupBy("shard", "salt").cogroup(copies.groupBy("shard", "salt")).applyInPandas(probe, "h1 long, h2 long, doc_id long, no_id boolean")
    hits = hits.groupBy(F.col("doc_id").alias("__ll_id"), F.col("no_id").alias("__ll_none")).agg(F.collect_list("h1").alias("__ll_h1"), F.collect_list("h2").alias("__ll_h2"))
    n = len(docs.columns)
    own = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))
    joined = docs.join(hits, (own == F.col("__ll_id")) & (null == F.col("__ll_none")), "left").drop("__ll_id", "__ll_none")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_at, 16 << 20):
            gone = [set(zip(a or (), b or (), strict=True)) for a, b in zip(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist(), strict=True)]

            def drop(row, h1, h2, gone=gone):
                return np.array([(a, b) in gone[r] for r, a, b in zip(row.tolist(), h1.tolist(), h2.tolist(), strict=True)], bool)

            yield _apply(batch, text_at, arrow, min_chars, drop)

    return joined.mapInArrow(run, out)
