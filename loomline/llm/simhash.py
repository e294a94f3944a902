"""SimHash near-dedup by covering locality-sensitive hashing.

64-bit fingerprints of 3-word shingles link at ``radius`` (2) or fewer differing bits.  Every bit position
i gets a nonzero vector m(i) of radius+1 bits; each nonzero vector v gives a table whose mask holds the
positions with odd <m(i), v>.  Any ``radius`` differing positions leave a v orthogonal to all of theirs, so
every pair within the radius agrees under some mask: with radius 2 that is 7 tables of about 36 bits.

Work is on distinct fingerprints, so exact copies cost one row.  Buckets of up to ``bucket`` fingerprints
are compared inside one Python call that returns a spanning star per local component, never its pairs.
Larger buckets are dealt anew, by the points within one bit of a fingerprint over the bits that the mask
leaves free: two fingerprints are within two bits exactly if they share such a point, and at most 65 can.
Nothing is dropped or capped at either size.

Near copies differ in more bits (``together``): of 13 blocks of the 64 bits, fingerprints within ``WIDE`` (10) bits have
three blocks alike, so every such pair meets in one of 286 tables.  A fingerprint is dealt in 8 bytes by each block but
the last two, in parts by its bits there; the tables of that block and two later ones are made in the part, which
returns a spanning forest.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import components, cut, slices, text_bytes, whole_groups

BITS, RADIUS, SHINGLE, SEED = 64, 2, 3, 42
#: Distinct fingerprints of a bucket that are compared in one call (16 M bit comparisons).
BUCKET = 4096
#: Differing bits up to which fingerprints of near copies meet, and fingerprints for which a block gets one more part (as long as its bits differ).
WIDE, PART = 10, 1 << 13
#: Fingerprints that are dealt at a time; those of a bucket up to which buckets are compared side by side.
CHUNK, SMALL = 1 << 14, 64


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """The masks of the 2^(radius+1)-1 tables; position i has the vector i mod (2^(radius+1)-1) + 1."""
    tables = 2 ** (radius + 1) - 1
    return [sum(1 << i for i in range(bits) if ((i % tables + 1) & v).bit_count() % 2) for v in range(1, tables + 1)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: bytes) -> int:
    """SimHash of one text as an unsigned integer; no words: zero."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        digest = xxhash.xxh64_intdigest
        ends = list(accumulate(len(w) + 1 for w in words))
        starts = [0, *ends]
        hashes = [digest(joined[s : e - 1], SEED) for s, e in zip(starts, ends[SHINGLE - 1 :], strict=False)]
    return majority(np.array(hashes, np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; of none: zero."""
    ones = np.zeros(BITS, np.int64)
    array = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    for at in range(0, len(array), 65_536):
        ones += np.unpackbits(array[at : at + 65_536], axis=1).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row of ``docs``; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, 16 << 20):
            fps = np.array([fingerprint(x) for x in text_bytes(batch.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def _stars(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A star (centre, member) for each local component of one bucket."""
    x = np.sort(values).view(np.uint64)
    label = np.arange(len(x))
    for i in range(1, len(x)):
        near = np.nonzero(np.bitwise_count(x[:i] ^ x[i]) <= radius)[0]
        if len(near):
            roots = np.unique(label[near])
            label[i] = roots[0]
            if len(roots) > 1:
                label[: i + 1][np.isin(label[: i + 1], roots)] = roots[0]
    x = x.view(np.int64)
    return [(int(x[r]), int(x[i])) for i, r in enumerate(label.tolist()) if r != i]


def links(fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column ``fp``) that span every component of the graph of
    pairs within ``radius`` bits."""
    masks = [signed(m) for m in covering_masks(radius)]
    keyed = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("key")) for t, m in enumerate(masks)])).alias("k")).select("fp", "k.t", "k.key")
    shared = cut(keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    members = cut(keyed.join(shared, ["t", "key"]).select("t", "key", "fp", "n"))

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = {e for values in frame.fps for e in _stars(np.asarray(values, np.int64), radius)}
            yield pd.DataFrame(sorted(found), columns=["a", "b"], dtype="int64")

    few = members.filter(F.col("n") <= bucket).groupBy("t", "key").agg(F.collect_list("fp").alias("fps")).select("fps").mapInPandas(compare, "a long, b long")
    free = F.element_at(F.array(*[F.array(F.lit(0).cast("long"), *[F.lit(signed(1 << i)).cast("long") for i in range(BITS) if not m >> i & 1]) for m in covering_masks(radius)]), F.col("t") + 1)
    points = members.filter(F.col("n") > bucket).select("fp", F.explode(F.transform(free, lambda bit: F.col("fp").bitwiseXOR(bit))).alias("point"))
    # at a shared point all are within two bits of each other: one star spans them
    many = points.groupBy("point").agg(F.collect_set("fp").alias("fps")).filter(F.size("fps") > 1).select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).filter("a <> b")
    return few.union(many) if radius == 2 else few


def near_duplicates(docs: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs``.

    Null, empty and white-space-only texts have fingerprint zero and link like any other.  component_id is
    the smallest non-null doc_id of the component; it is null only where all its ids are null.  Rows that
    repeat a doc_id each come back.  Texts of any length are read whole; an empty table gives no rows.  Columns other
    than ``doc_id`` and ``text`` are not read.
    """
    if radius != RADIUS:
        raise ValueError("large buckets are split for a radius of two")
    fps = cut(fingerprints(docs))
    nodes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    root = components(links(nodes.select("fp"), radius, bucket)).select(F.col("v").alias("fp"), F.col("l").alias("root"))
    rooted = cut(nodes.join(root, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    least = cut(rooted.groupBy("root").agg(F.min("first").alias("component_id")))
    assigned = cut(rooted.join(least, "root").select("fp", "component_id"))
    return fps.join(assigned, "fp").select("doc_id", "fp", "component_id")


def block_bounds(blocks: int, bits: int = BITS) -> list[tuple[int, int]]:
    """First bit and width of each of ``blocks`` blocks that are as equal as can be."""
    ends = [bits * i // blocks for i in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:], strict=False)]


def _joined(x: np.ndarray, blocks: list[tuple[int, int]]) -> np.ndarray:
    """The bits of the blocks, side by side."""
    key = np.zeros(len(x), np.uint64)
    for first, width in blocks:
        key = key << np.uint64(width) | x >> np.uint64(first) & np.uint64((1 << width) - 1)
    return key


def _wide_stars(x: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """``_stars``, for values few of which are near others."""
    label = np.arange(len(x))
    step = max(1, (1 << 18) // len(x))
    for at in range(0, len(x), step):
        near = np.tril(np.bitwise_count(x[at : at + step, None] ^ x) <= radius, at - 1)
        for row in np.nonzero(near.any(axis=1))[0].tolist():
            roots = np.unique(label[near[row]])
            label[at + row] = roots[0]
            if len(roots) > 1:
                label[: at + row][np.isin(label[: at + row], roots)] = roots[0]
    x = x.view(np.int64)
    return [(int(x[r]), int(x[i])) for i, r in enumerate(label.tolist()) if r != i]


def _bucket_edges(x: np.ndarray, key: np.ndarray, radius: int, bucket: int) -> tuple[list[tuple[int, int]], list[np.ndarray]]:
    """Edges that span the components of each bucket (equal ``key``) of fingerprints, and, for a bucket of more than
    ``bucket``, the values of each pair of its blocks instead."""
    order = np.argsort(key, kind="stable")
    x, key = x[order], key[order]
    first = np.nonzero(np.concatenate([[True], key[1:] != key[:-1]]))[0]
    size = np.diff(np.append(first, len(x)))
    end = np.repeat(np.where(size <= min(SMALL, bucket), first + size, 0), size)
    found, many, apart, at = [], [], 1, np.nonzero(end)[0]
    while len(at := at[at + apart < end[at]]):
        near = at[np.bitwise_count(x[at] ^ x[at + apart]) <= radius]
        found += zip(x[near].view(np.int64).tolist(), x[near + apart].view(np.int64).tolist(), strict=True)
        apart += 1
    large = size > min(SMALL, bucket)
    for a, n in zip(first[large].tolist(), size[large].tolist(), strict=True):
        if n <= bucket:
            found += _wide_stars(x[a : a + n], radius)
            continue
        every = np.sort(x[a : a + n])
        blocks = [every[i :: -(-n // bucket)] for i in range(-(-n // bucket))]
        many += [np.sort(np.concatenate([u, v])).view(np.int64) for i, u in enumerate(blocks) for v in blocks[:i]]
    return found, many


def _joins(forest: dict[int, int], a: int, b: int) -> bool:
    """Whether a and b were in two trees of the forest, which are one from now on."""
    ends = []
    for v in (a, b):
        while (up := forest.get(v, v)) != v:
            forest[v] = v = forest.get(up, up)
        ends.append(v)
    forest[max(ends)] = min(ends)
    return ends[0] != ends[1]


def _wide_links(fps: DataFrame, radius: int, bucket: int) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column ``fp`` of a cut table) that span every component of the graph of
    pairs within ``radius`` bits.  Buckets over ``bucket`` fingerprints are dealt in blocks, each pair of blocks to one list."""
    blocks = block_bounds(radius + 3)
    parts = max(1, min(-(-fps.count() // PART), 1 << max(width for _, width in blocks)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(every), CHUNK):
                x = every[at : at + CHUNK]
                keys, packed = [], []
                for t, block in enumerate(blocks[:-2]):
                    part = (_joined(x, [block]) % np.uint64(parts)).astype(np.int64)
                    order = np.argsort(part, kind="stable")
                    ends = np.searchsorted(part[order], np.arange(parts + 1))
                    for p in np.nonzero(np.diff(ends))[0].tolist():
                        keys.append(t * parts + p)
                        packed.append(x[order[ends[p] : ends[p + 1]]].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(packed, pa.binary())], ["key", "fps"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, ends in whole_groups(batches):
            keys = rows["key"].to_numpy()
            for a, b in zip([0, *ends], ends, strict=False):
                x = np.frombuffer(b"".join(rows["fps"].slice(a, b - a).to_pylist()), np.uint64)
                i = int(keys[a]) // parts
                forest: dict[int, int] = {}
                edges: list[tuple[int, int]] = []
                many: list[np.ndarray] = []
                for j, k in combinations(range(i + 1, len(blocks)), 2):
                    key = _joined(x, [blocks[i], blocks[j], blocks[k]])
                    found, lists = _bucket_edges(x, key.astype(np.uint16) if sum(w for _, w in blocks[:3]) < 16 else key, radius, bucket)
                    edges += [(u, v) for u, v in found if _joins(forest, u, v)]
                    many += lists
                none = [None] * len(many)
                ab = [pa.array([*(e[i] for e in edges), *none], pa.int64()) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*ab, pa.array([None] * len(edges) + many, pa.list_(pa.int64()))], ["a", "b", "fps"])

    def compare_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = sorted({e for values in batch.column(0) for e in _wide_stars(np.array(values.as_py(), np.int64).view(np.uint64), radius)})
            yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    dealt = fps.select("fp").mapInArrow(deal, "key long, fps binary").repartition("key").sortWithinPartitions("key")
    found = cut(dealt.mapInArrow(compare, "a long, b long, fps array<long>"))
    many = found.filter("fps is not null").select("fps").distinct().mapInArrow(compare_lists, "a long, b long")
    return found.filter("fps is null").select("a", "b").union(many)


def together(nodes: DataFrame, radius: int = WIDE, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) between the rows of ``nodes`` (v, fp; no v twice) that span every component of the graph of
    fingerprints within ``radius`` bits."""
    nodes = cut(nodes.select("v", "fp"))
    first = cut(nodes.groupBy("fp").agg(F.min("v").alias("b"), F.count(F.lit(1)).alias("n")))
    near = _wide_links(first.select("fp"), radius, bucket).distinct()
    for end in ("a", "b"):
        near = near.join(first.select(F.col("fp").alias(end), F.col("b").alias(f"v{end}")), end)
    same = nodes.join(first.filter("n > 1"), "fp").filter("v <> b").select(F.col("v").alias("a"), "b")
    return near.select(F.col("va").alias("a"), F.col("vb").alias("b")).union(same)


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of near copies.

    These link by sets of 5-word shingles (similarity 0.8 or more).  Fingerprints of the sets bring texts within 10
    bits together, which are then compared exactly; as more bits can differ at that similarity, a join finds the rest.
    See ``near_copies.keep_one`` for nulls, repeated rows and other columns.
    """
    from loomline.llm import near_copies

    return near_copies.keep_one(docs)
