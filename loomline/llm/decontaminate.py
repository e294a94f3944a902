"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact verification.

Texts and items become 5-word shingles of lower-cased words.  A window as long as an item can reach a weighted
Jaccard similarity J only if 2J/(1+J) of its shingles are shingles of some item, so only such windows are
fingerprinted (no window that could match is lost).  Item fingerprints are indexed by eight blocks of eight
bits: within ``RADIUS`` (23) differing bits some block differs in at most two, so looking up each block's
values within two bits finds every item within the radius.  Candidates are verified by the exact weighted
similarity of their shingle counts.  Items are sent to the workers in blocks of bounded size, texts pass by
once for each block, and each row is decided by itself: nothing is shuffled, whatever documents share.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.common import arrow_schema, slices, text_bytes

SHINGLE, SIMILARITY, RADIUS, BITS = 5, 0.8, 23, 64
#: Bytes of item text in a block that is broadcast, about.
BLOCK_BYTES = 16 << 20
_NEAR = [[v for v in range(256) if (v ^ u).bit_count() <= RADIUS // 8] for u in range(256)]


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` words."""
    if len(words) < size:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh3_64_intdigest
    ends = list(accumulate(len(w) + 1 for w in words))
    return np.array([digest(joined[s : e - 1]) for s, e in zip([0, *ends], ends[size - 1 :], strict=False)], np.uint64)


def _bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard similarity of two shingle multisets."""
    both = sum((a & b).values())
    return both / max(1, sum(a.values()) + sum(b.values()) - both)


class Items:
    """Items of one shingle size (5, or fewer for items of fewer words), indexed."""

    def __init__(self, size: int, texts: list[list[bytes]], ids: list[int | None]):
        self.size, self.ids = size, ids
        self.hashes = [shingle_hashes(w, size) for w in texts]
        self.counts = [Counter(h.tolist()) for h in self.hashes]
        self.lengths = np.array([len(h) for h in self.hashes])  # in shingles
        prints = np.packbits(np.array([2 * _bits(h).sum(axis=0, dtype=np.int64) > len(h) for h in self.hashes]), axis=1)
        self.prints = prints.view(">u8").astype(np.uint64).ravel()
        self.known = np.unique(np.concatenate(self.hashes))
        self.coarse = np.zeros(1 << 22, bool)
        self.coarse[(self.known >> np.uint64(42)).astype(np.int64)] = True
        by_value: list[list[list[int]]] = [[[] for _ in range(256)] for _ in range(8)]
        for i, row in enumerate(prints.tolist()):
            for block, value in enumerate(row):
                for near in _NEAR[value]:
                    by_value[block][near].append(i)
        self.blocks = [[np.array(x, np.int64) for x in block] for block in by_value]

    def candidates(self, fingerprint: np.ndarray, length: int) -> list[int]:
        """Items of ``length`` shingles within the radius of a fingerprint given as eight bytes."""
        found = np.concatenate([self.blocks[i][v] for i, v in enumerate(fingerprint.tolist())])
        found = found[self.lengths[found] == length]
        whole = fingerprint.view(">u8").astype(np.uint64)
        return sorted(set(found[np.bitwise_count(self.prints[found] ^ whole) <= RADIUS].tolist()))

    def match(self, words: list[bytes]) -> list[tuple[int, float, int]]:
        """(item's place, similarity, first word) of the best window of each matching item."""
        hashes = shingle_hashes(words, self.size)
        hit = self.coarse[(hashes >> np.uint64(42)).astype(np.int64)]
        if not hit.any():
            return []
        where = np.nonzero(hit)[0]
        some = hashes[where]
        hit[where] = self.known[np.minimum(np.searchsorted(self.known, some), len(self.known) - 1)] == some
        total = np.concatenate([[0], np.cumsum(hit)])
        if not total[-1]:
            return []
        best: dict[int, tuple[float, int]] = {}
        for m in np.unique(self.lengths).tolist():
            size = min(m, len(hashes))  # a text shorter than the item is one window
            least = math.ceil(2 * SIMILARITY / (1 + SIMILARITY) * (m + size) / 2 - 1e-9)
            starts = np.nonzero(total[size:] - total[:-size] >= least)[0]
            for lot in np.split(starts, np.nonzero(np.diff(starts) > size)[0] + 1) if len(starts) else ():
                first, last = int(lot[0]), int(lot[-1]) + size
                ones = np.concatenate([np.zeros((1, BITS), np.int32), np.cumsum(_bits(hashes[first:last]), axis=0, dtype=np.int32)])
                prints = np.packbits(2 * (ones[lot - first + size] - ones[lot - first]) > size, axis=1)
                for at, fingerprint in zip(lot.tolist(), prints, strict=True):
                    for i in self.candidates(fingerprint, m):
                        s = similarity(Counter(hashes[at : at + size].tolist()), self.counts[i])
                        if s >= SIMILARITY and (i not in best or s > best[i][0]):
                            best[i] = (s, at)
        return [(i, s, at) for i, (s, at) in sorted(best.items())]


def blocks_of(items: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[int | None, bytes]]]:
    """The distinct items (item_id, text) in blocks of about ``block_bytes``, dealt by the hash of their ids, one at a time."""
    items = items.select(F.col("item_id").cast("long"), "text").filter("text is not null").distinct()
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-total // block_bytes))
    dealt = F.pmod(F.xxhash64(F.coalesce("item_id", F.xxhash64("text"))), F.lit(n))
    for block in range(n):
        rows = items.filter(dealt == block).collect()
        yield sorted(((r.item_id, r.text.encode()) for r in rows), key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def index(block: list[tuple[int | None, bytes]]) -> list[Items]:
    """The items of a block by shingle size; items without words match nothing and are left out."""
    by_size: dict[int, tuple[list, list]] = {}
    for item_id, text in block:
        words = text.lower().split()
        if words:
            texts, ids = by_size.setdefault(min(SHINGLE, len(words)), ([], []))
            texts.append(words)
            ids.append(item_id)
    return [Items(size, *found) for size, found in sorted(by_size.items())]


#: The last block that this worker has indexed, by the name it was sent under.
_LAST: dict[str, list[Items]] = {}


def _sent(spark: SparkSession, block: list[tuple[int | None, bytes]]):
    """A block on its way to the workers, under a name of its own."""
    return spark.sparkContext.broadcast((uuid.uuid4().hex, block))


def _indexed(held) -> list[Items]:
    """The index of a block that was sent; tasks of one worker share it."""
    name, block = held.value
    if name not in _LAST:
        _LAST.clear()
        _LAST[name] = index(block)
    return _LAST[name]


def _best(indexed: list[Items], words: list[bytes]) -> list[tuple[int | None, float, int]]:
    """(item_id, similarity, first word) of the best window of each item found; of several texts of an item the best."""
    found: dict[object, tuple[int | None, float, int]] = {}
    for own in indexed:
        for i, s, at in own.match(words):
            item = own.ids[i]
            key = (own.size, i) if item is None else item
            if key not in found or (-s, at) < (-found[key][1], found[key][2]):
                found[key] = (item, s, at)
    return list(found.values())


def contaminated(docs: DataFrame, items: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, first_word, similarity): the best window of each item found in each row.

    Null and empty texts match nothing, null and empty items neither; texts of any length are searched whole.  An item
    of fewer than five words is one shingle of all its words.  Rows that repeat come back each; an item that is
    repeated counts once, an item_id with several texts is found by the best of them, and texts with a null item_id
    are items of their own.  Ties between windows go to the first.  Other columns are not read.
    """
    spark, found = docs.sparkSession, None
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    for block in blocks_of(items, block_bytes):
        part = rows.mapInArrow(_finder(_sent(spark, block)), "doc_id long, item_id long, first_word long, similarity double")
        found = part if found is None else found.union(part)
    return found


def _finder(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexed = _indexed(held)
        for batch in slices(batches, 1, 16 << 20):
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
                out += [(doc_id, item, at, s) for item, s, at in _best(indexed, text.lower().split())]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate(kinds)], ["doc_id", "item_id", "first_word", "similarity"])

    return run


def clean(docs: DataFrame, items: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the rows in which ``contaminated`` finds an item; all columns pass through, whatever their names.

    Null and empty texts hold nothing and stay, as do rows with a null doc_id and repeated rows, each judged by its text."""
    at, arrow = docs.columns.index("text"), arrow_schema(docs.schema)
    for block in blocks_of(items, block_bytes):
        docs = docs.mapInArrow(_cleaner(_sent(docs.sparkSession, block), at, arrow), docs.schema)
    return docs


def _cleaner(held, at: int, arrow: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexed = _indexed(held)
        for batch in slices(batches, at, 16 << 20):
            keep = [not any(own.match(words) for own in indexed) for words in (t.lower().split() for t in text_bytes(batch.column(at)))]
            yield pa.RecordBatch.from_arrays(batch.filter(pa.array(keep)).columns, schema=arrow)

    return run
