"""Exact removal of byte strings that documents with smaller ids hold, over suffix arrays.

A byte goes if it lies in a ``WINDOW`` (50) byte string that also starts in a document with a smaller doc_id.
A suffix array of all documents in one task is out of the question, so equal strings are first brought
together:

1. Texts are put in packs of a few MB, compressed, in the shared checkpoint folder.  A document whose whole
   text a smaller id holds is settled at once; texts with equal SHA-256 digests are taken for equal here.
2. Every window is owned by its leftmost least 24-byte gram (by a 40-bit hash), so equal windows have equal
   owners.  Each pack sends its distinct owners to buckets once, however often it has them; an owner that
   two documents have is a candidate, and the pack gets that back as one bit for each owner, with another one that
   says whether the owner is hot: had by very many packs, or often in one of them.
3. The windows of a candidate owner fall in two parts, by which side has at least 13 more bytes of context;
   a part's key is its 37 bytes around the owner that all its windows hold.  Each pack sends each distinct
   part to the bucket of its key with the smallest doc_id that has it.  A hot owner's windows are parts of their
   own, and their own keys, so what a key brings together is bounded whatever documents share.
4. In a bucket, the distinct parts of a key are set one after another, the key itself as a single symbol, and
   their suffix array is built by linear grouping.  Equal windows are neighbours there; each run of them gets
   its smallest doc_id, which goes back to the packs.
5. Packs mark their windows and drop the bytes they cover.

Steps 2 to 4 are exact (owners' hashes only choose candidates; keys are compared as bytes) and no step gathers
the occurrences of a string: copies meet as one entry for each pack.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import cut, slices, text_bytes
from loomline.llm.suffix_groups import suffix_array, suffix_arrays
from loomline.session import cut_dealt

WINDOW, GRAM, SIDE = 50, 24, 13
KEY = GRAM + SIDE
#: Bytes of text in a pack, owners in a bucket of step 2 and parts in a bucket of step 4, about.
PACK_BYTES, BUCKET_OWNERS, BUCKET_PARTS = 4 << 20, 500_000, 150_000
#: Packs of a task, about; an owner is hot if more packs than this have it, or one has more runs of it than this.
TASK_PACKS, HOT_PACKS, HOT_RUNS = 3, 512, 1024
#: Texts longer than this are cut for owner search, with an overlap of a window; positions take 24 bits.
SEGMENT = 8 << 20
#: Symbols below which small texts are sorted in lockstep.
LOCKSTEP = 160
_ODD = np.uint64(0x9E3779B97F4A7C15)
_LOW24 = np.uint64((1 << 24) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x * _ODD
    return x ^ (x >> np.uint64(29))


def owners(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The runs of windows with one owner: first window, window after the last, owner's place, its hash."""
    if len(text) > SEGMENT:
        parts = []
        for at in range(0, len(text) - WINDOW + 1, SEGMENT - WINDOW + 1):
            s, e, p, h = owners(text[at : at + SEGMENT])
            parts.append((s + at, e + at, p + at, h))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
    if len(text) < WINDOW:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    a = np.frombuffer(text, np.uint8).astype(np.uint64)
    two = _mix(a[:-1] << np.uint64(8) | a[1:])
    four = _mix(two[:-2] * np.uint64(0x100000001B3) + two[2:])
    eight = _mix(four[:-4] * np.uint64(0x100000001B3) + four[4:])
    sixteen = _mix(eight[:-8] * np.uint64(0x100000001B3) + eight[8:])
    grams = _mix(sixteen[:-8] * np.uint64(0x100000001B3) + eight[16:])
    width = WINDOW - GRAM + 1
    least = (grams & ~_LOW24) | np.arange(len(grams), dtype=np.uint64)
    span = 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    n = len(grams) - width + 1
    least = np.minimum(least[:n], least[width - span : width - span + n])
    first = np.nonzero(np.concatenate([[True], least[1:] != least[:-1]]))[0]
    own = least[first]
    return first, np.append(first[1:], n), (own & _LOW24).astype(np.int64), own >> np.uint64(24)


class Pack:
    """Documents whose texts are kept together: ids, which of them are null, and texts."""

    def __init__(self, ids: bytes, sizes: bytes, data: bytes):
        self.ids = np.frombuffer(ids, np.int64, len(ids) // 9)
        self.null = np.frombuffer(ids, bool, len(ids) // 9, 8 * (len(ids) // 9))
        size = np.frombuffer(sizes, np.int64)
        whole = zstandard.ZstdDecompressor().decompress(data, max_output_size=max(1, int(size.sum())))
        ends = np.cumsum(size).tolist()
        self.texts = [whole[e - s : e] for s, e in zip(size.tolist(), ends, strict=True)]


PACK_SCHEMA = "pack long, ids binary, sizes binary, data binary"


def packs(docs: DataFrame, total: int, pack_bytes: int = PACK_BYTES) -> DataFrame:
    """The texts of ``docs`` (null: empty, ``total`` bytes) in packs, dealt by pack once: what the packs are joined with
    comes to them, and they stay where they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, texts, held = TaskContext.get().partitionId() << 32, [], [], 0
        press = zstandard.ZstdCompressor(level=3)

        def out() -> pa.RecordBatch:
            size = np.array([len(x) for x in texts], np.int64)
            named = np.array([i or 0 for i in ids], np.int64).tobytes() + bytes([i is None for i in ids])
            row = [[number], [named], [size.tobytes()], [press.compress(b"".join(texts))]]
            return pa.RecordBatch.from_arrays([pa.array(row[0], pa.int64()), *[pa.array(x, pa.binary()) for x in row[1:]]], ["pack", "ids", "sizes", "data"])

        for batch in slices(batches, 1, pack_bytes):
            for i, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
                ids.append(i)
                texts.append(text)
                held += len(text)
                if held >= pack_bytes:
                    yield out()
                    number, ids, texts, held = number + 1, [], [], 0
        if ids:
            yield out()

    packed = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PACK_SCHEMA)
    return cut_dealt(packed, -(-total // (TASK_PACKS * pack_bytes)), "pack")


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of the batches, one at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(column[i].as_py() for column in batch.columns)


def copies(packed: DataFrame) -> DataFrame:
    """(pack, copies): places in the pack of documents whose whole text, of a window or more, a smaller id holds, by SHA-256."""

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, ids, sizes, data in _each(batches):
            pack = Pack(ids, sizes, data)
            at = [i for i, t in enumerate(pack.texts) if len(t) >= WINDOW and not pack.null[i]]
            digests = [hashlib.sha256(pack.texts[i]).digest() for i in at]
            yield pa.RecordBatch.from_arrays([pa.array([number] * len(at), pa.int64()), pa.array(at, pa.int64()), pa.array(pack.ids[at]), pa.array(digests, pa.binary())], ["pack", "at", "doc_id", "h"])

    found = cut(packed.mapInArrow(heads, "pack long, at long, doc_id long, h binary"))
    first = cut(found.groupBy("h").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").drop("last"))
    return found.join(first, "h").filter("doc_id > first").groupBy("pack").agg(F.collect_list("at").alias("copies"))


def _settled(pack: Pack, copied: list | None) -> list[bool]:
    """Which documents of a pack take no part in the search: copies, and those without an id."""
    out = pack.null.tolist()
    for i in copied or ():
        out[i] = True
    return out


class _Owners:
    """The owner runs of a pack: documents searched as (place in the pack, text, (first, end, place) of the runs), the
    pack's distinct owners in order, and for each run, document after document, which of them it has."""

    def __init__(self, pack: Pack, skip: list[bool]):
        found = [(i, t, owners(t)) for i, t in enumerate(pack.texts) if not skip[i] and len(t) >= WINDOW]
        self.docs = [(i, t, r[:3]) for i, t, r in found]
        self.sizes = np.array([len(r[3]) for _, _, r in found], np.int64)
        every = np.concatenate([r[3] for _, _, r in found]) if found else np.zeros(0, np.uint64)
        self.order = np.argsort(every)
        ranked = every[self.order]
        fresh = np.ones(len(ranked), bool)
        fresh[1:] = ranked[1:] != ranked[:-1]
        self.starts = np.nonzero(fresh)[0]
        self.distinct = ranked[self.starts]
        self.which = np.empty(len(every), np.int64)
        self.which[self.order] = np.cumsum(fresh) - 1

    def often(self, runs: int) -> np.ndarray:
        """Which distinct owners have more than so many runs."""
        return np.diff(np.append(self.starts, len(self.order))) > runs

    def several(self) -> np.ndarray:
        """Which distinct owners two documents have."""
        if not len(self.starts):
            return np.zeros(0, bool)
        doc = np.repeat(np.arange(len(self.sizes)), self.sizes)[self.order]
        return np.minimum.reduceat(doc, self.starts) < np.maximum.reduceat(doc, self.starts)


def _dealt(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order of the hashes by bucket, in which a bucket's keep theirs, and (bucket, first, after the last) in it."""
    bucket = (_mix(hashes + np.uint64(1)) >> np.uint64(20)).astype(np.int64) % buckets
    order = np.argsort(bucket, kind="stable")
    ranked = bucket[order]
    first = np.nonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))[0] if len(ranked) else np.zeros(0, np.int64)
    return order, list(zip(ranked[first].tolist(), first.tolist(), [*first[1:].tolist(), len(ranked)], strict=False))


def _bits(*masks: np.ndarray) -> bytes:
    return b"".join(np.packbits(m).tobytes() for m in masks)


def _masks(bits: bytes, n: int) -> list[np.ndarray]:
    """The two masks of ``n`` places that ``_bits`` packed."""
    width = -(-n // 8)
    return [np.unpackbits(np.frombuffer(bits, np.uint8, width, at), count=n).astype(bool) for at in (0, width)]


def _send_owners(buckets: int, hot_runs: int):
    """Step 2, from packs: one row for each bucket, with its owners (5 bytes each), whether two documents of the pack
    have them, and whether it has them often; a row for bucket -1 hands the pack's copies on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, ids, sizes, data, copied in _each(batches):
            pack = Pack(ids, sizes, data)
            own = _Owners(pack, _settled(pack, copied))
            distinct, several, often = own.distinct, own.several(), own.often(hot_runs)
            rows = [(-1, np.array(copied or [], np.int64).tobytes(), b"")]
            order, dealt = _dealt(distinct, buckets)
            for b, first, last in dealt:
                mine = order[first:last]
                h = distinct[mine]
                rows.append((b, (h >> np.uint64(8)).astype(np.uint32).tobytes() + (h & np.uint64(255)).astype(np.uint8).tobytes(), _bits(several[mine], often[mine])))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([number] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["bucket", "pack", "hashes", "several"])

    return run


def _meet_owners(group: pd.DataFrame, hot_packs: int) -> pd.DataFrame:
    """Step 2, in a bucket: for each pack, two bits for each owner: do two documents have it, and is it hot?"""
    if group.bucket.iloc[0] == -1:
        return pd.DataFrame({"pack": group.pack, "bucket": -1, "bits": group.hashes, "n": 0})
    parts, several, often = [], [], []
    for blob, bits in zip(group.hashes, group.several, strict=True):
        n = len(blob) // 5
        parts.append(np.frombuffer(blob, np.uint32, n).astype(np.uint64) << np.uint64(8) | np.frombuffer(blob, np.uint8, n, 4 * n))
        for kept, mask in zip((several, often), _masks(bits, n), strict=True):
            kept.append(mask)
    every = np.concatenate(parts)
    order = np.argsort(every, kind="stable")
    ranked = every[order]
    fresh = np.concatenate([[True], ranked[1:] != ranked[:-1]]) if len(ranked) else np.zeros(0, bool)
    which = np.cumsum(fresh) - 1
    packs = np.bincount(which)
    shared = (packs > 1) | (np.bincount(which, np.concatenate(several)[order]) > 0)
    hot = (packs > hot_packs) | (np.bincount(which, np.concatenate(often)[order]) > 0)
    ends = np.cumsum([len(p) for p in parts])
    out = []
    for mask in (shared, hot):
        placed = np.empty(len(every), bool)
        placed[order] = mask[which]
        out.append(np.split(placed, ends[:-1]))
    return pd.DataFrame({"pack": group.pack, "bucket": group.bucket, "bits": [_bits(*x) for x in zip(*out, strict=True)], "n": [int(x.sum()) for x in out[0]]})


#: What a part's bytes are preceded by: its side (2 for a window of a hot owner) and where its key or owner starts.
_HEADS = [[bytes([side, shift]) for shift in range(WINDOW)] for side in (0, 1, 2)]


def _parts(own: _Owners, replies, buckets: int):
    """The candidate parts of a pack: {side, shift and bytes: entry}, and for each the windows (place in ``own.docs``,
    first window) that it stands for."""
    order, dealt = _dealt(own.distinct, buckets)
    places = {b: order[first:last] for b, first, last in dealt}
    shared, hot = np.zeros(len(own.distinct), bool), np.zeros(len(own.distinct), bool)
    for r in replies:
        if r["bucket"] >= 0:
            mine = places[r["bucket"]]
            shared[mine], hot[mine] = _masks(r["bits"], len(mine))
    ends = np.cumsum(own.sizes)[:-1]
    hits = zip(np.split(shared[own.which], ends), np.split(hot[own.which], ends), strict=True) if len(own.docs) else ()
    windows: dict[bytes, list[tuple[int, int]]] = {}
    runs: dict[bytes, list[tuple[int, int]]] = {}  # of hot owners: most of them are alike
    right, left, whole = _HEADS
    for place, ((_, text, (s, e, p)), (hit, heat)) in enumerate(zip(own.docs, hits, strict=True)):
        for a, b, at, many in zip(s[hit].tolist(), e[hit].tolist(), p[hit].tolist(), heat[hit].tolist(), strict=True):
            if many:
                run = whole[at - a] + text[a : b + WINDOW - 1]
                if run in runs:
                    runs[run].append((place, a))
                else:
                    runs[run] = [(place, a)]
                continue
            middle = min(max(a, at - SIDE), b)  # windows before it have more on the left
            if middle < b:
                part = right[at - middle] + text[middle : b + WINDOW - 1]
                if part in windows:
                    windows[part].append((place, middle))
                else:
                    windows[part] = [(place, middle)]
            if a < middle:
                part = left[at - SIDE - a] + text[a : middle + WINDOW - 1]
                if part in windows:
                    windows[part].append((place, a))
                else:
                    windows[part] = [(place, a)]
    for run, held in runs.items():
        for w in range(len(run) - 2 - WINDOW + 1):
            windows.setdefault(whole[run[1] - w] + run[2 + w : 2 + w + WINDOW], []).extend([(place, a + w) for place, a in held] if w else held)
    return windows


def _key(part: bytes) -> bytes:
    """Side and key of a part; a window of a hot owner is its own key."""
    if part[0] == 2:
        return part
    at = part[1] + 2
    return part[:1] + part[at : at + KEY]


def _send_parts(owner_buckets: int, part_buckets: int):
    """Step 3, from packs: one compressed row for each bucket, with its parts and their smallest and largest ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for number, ids, sizes, data, replies in _each(batches):
            pack = Pack(ids, sizes, data)
            own = _Owners(pack, _settled(pack, _copied(replies)))
            windows = _parts(own, replies, owner_buckets)
            ids_of = pack.ids[[i for i, _, _ in own.docs]].tolist()
            dealt: dict[int, list] = {}
            for part, held in windows.items():
                first = last = ids_of[held[0][0]]
                if len(held) > 1:
                    has = [ids_of[place] for place, _ in held]
                    first, last = min(has), max(has)
                dealt.setdefault(xxhash.xxh3_64_intdigest(_key(part)) % part_buckets, []).append((part, first, last))
            rows = []
            for b, found in dealt.items():
                sizes = bytes([len(x[0]) for x in found])
                least, most = (np.array([x[i] for x in found], np.int64).tobytes() for i in (1, 2))
                rows.append((b, len(found), press.compress(sizes + least + most + b"".join([x[0] for x in found]))))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([number] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], ["bucket", "pack", "n", "data"])

    return run


def _copied(replies) -> list[int]:
    return [i for r in replies if r["bucket"] == -1 for i in np.frombuffer(r["bits"], np.int64).tolist()]


class _KeyGroups:
    """The keys of a bucket that have several distinct parts: equal windows found over suffix arrays."""

    def __init__(self) -> None:
        self.texts: list[list[int]] = []
        self.starts: list[list[tuple[int, int, int]]] = []  # symbol place of a part's first window, windows, part

    def add(self, parts: list[tuple[int, int, bytes]]) -> None:
        """parts: (number, shift, bytes)."""
        text: list[int] = []
        starts = []
        for number, shift, data in parts:
            starts.append((len(text), len(data) - WINDOW + 1, number))
            text += [x + 2 for x in data[:shift]]
            text.append(258)  # the key
            text += [x + 2 for x in data[shift + KEY :]]
            text.append(1)
        text[-1] = 0
        self.texts.append(text)
        self.starts.append(starts)

    def least(self, doc: np.ndarray) -> dict[int, np.ndarray]:
        """For each part number the smallest doc_id that has each of its windows; doc: by part number."""
        out: dict[int, np.ndarray] = {}
        by_size = sorted(range(len(self.texts)), key=lambda i: len(self.texts[i]))
        small = [i for i in by_size if len(self.texts[i]) <= LOCKSTEP]
        for at in range(0, len(small), 2000):
            some = small[at : at + 2000]
            lengths = np.array([len(self.texts[i]) for i in some])
            matrix = np.zeros((len(some), lengths.max()), np.int32)
            for r, i in enumerate(some):
                matrix[r, : lengths[r]] = self.texts[i]
            for i, row, n in zip(some, suffix_arrays(matrix, lengths), lengths.tolist(), strict=True):
                self._runs(i, row[:n], doc, out)
        for i in by_size[len(small) :]:
            self._runs(i, np.array(suffix_array(self.texts[i])), doc, out)
        return out

    def _runs(self, i: int, array: np.ndarray, doc: np.ndarray, out: dict[int, np.ndarray]) -> None:
        text, span = np.array(self.texts[i], np.int16), WINDOW - KEY + 1
        part = np.full(len(text), -1, np.int64)
        for first, n, number in self.starts[i]:
            part[first : first + n] = number
            out[number] = np.empty(n, np.int64)
        array = array[part[array] >= 0]
        seen = text[array[:, None] + np.arange(span)]
        fresh = np.concatenate([[True], (seen[1:] != seen[:-1]).any(axis=1)])
        run = np.cumsum(fresh) - 1
        ids = np.minimum.reduceat(doc[part[array]], np.nonzero(fresh)[0])[run]
        by_place = np.empty(len(text), np.int64)
        by_place[array] = ids
        for first, n, number in self.starts[i]:
            out[number][:] = by_place[first : first + n]


def _meet_parts(group: pd.DataFrame) -> pd.DataFrame:
    """Steps 3 and 4, in a bucket: for each pack the runs (entry, first window, after the last, smallest id) in which
    some of the entry's documents have a smaller one."""
    number: dict[bytes, int] = {}
    keys: dict[bytes, list[int]] = {}
    least: list[int] = []
    listed = []
    open_ = zstandard.ZstdDecompressor()
    for n, data in zip(group.n.tolist(), group.data, strict=True):
        blob = open_.decompress(data)
        low, high = (np.frombuffer(blob, np.int64, n, n + 8 * n * i).tolist() for i in (0, 1))
        at, own = 17 * n, []
        for size, a in zip(blob[:n], low, strict=True):
            part = blob[at : at + size]
            at += size
            i = number.setdefault(part, len(least))
            if i == len(least):
                least.append(a)
                keys.setdefault(_key(part), []).append(i)
            elif a < least[i]:
                least[i] = a
            own.append(i)
        listed.append((own, high))
    parts = list(number)
    groups = _KeyGroups()
    for members in keys.values():
        if len(members) > 1:
            groups.add([(i, parts[i][1], parts[i][2:]) for i in members])
    found = groups.least(np.array(least, np.int64))
    press = zstandard.ZstdCompressor(level=1)
    out = []
    for own, high in listed:
        rows = []
        for n, (i, most) in enumerate(zip(own, high, strict=True)):
            by_window = found.get(i)
            if by_window is None:
                if least[i] < most:
                    rows.append((n, 0, len(parts[i]) - 2 - WINDOW + 1, least[i]))
                continue
            ends = np.append(np.nonzero(by_window[1:] != by_window[:-1])[0] + 1, len(by_window)).tolist()
            a = 0
            for b in ends:
                if by_window[a] < most:
                    rows.append((n, a, b, int(by_window[a])))
                a = b
        out.append(press.compress(np.array(rows, np.int64).reshape(-1, 4).tobytes()))
    return pd.DataFrame({"pack": group.pack, "bucket": group.bucket, "runs": out})


def _remove(owner_buckets: int, part_buckets: int):
    """Step 5, from packs: a row for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        for _, ids, sizes, data, replies, verdicts in _each(batches):
            pack = Pack(ids, sizes, data)
            copied = _copied(replies)
            own = _Owners(pack, _settled(pack, copied))
            windows = _parts(own, replies, owner_buckets)
            places, all_ids = [i for i, _, _ in own.docs], pack.ids.tolist()
            by_bucket: dict[int, list[list[tuple[int, int]]]] = {}
            for part, held in windows.items():
                by_bucket.setdefault(xxhash.xxh3_64_intdigest(_key(part)) % part_buckets, []).append(held)
            gone: dict[int, list[tuple[int, int]]] = {i: [(0, len(pack.texts[i]))] for i in copied}
            for v in verdicts or ():
                order = by_bucket[v["bucket"]]
                for n, a, b, least in np.frombuffer(open_.decompress(v["runs"]), np.int64).reshape(-1, 4).tolist():
                    for place, first in order[n]:
                        i = places[place]
                        if all_ids[i] > least:
                            gone.setdefault(i, []).append((first + a, first + b - 1 + WINDOW))
            starts, ends, kept = [], [], []
            for i, text in enumerate(pack.texts):
                spans: list[list[int]] = []
                for a, b in sorted(gone.get(i, ())):
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(b, spans[-1][1])
                    else:
                        spans.append([a, b])
                edges = [0, *[x for s in spans for x in s], len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)) if spans else text)
                starts.append([s[0] for s in spans])
                ends.append([s[1] for s in spans])
            doc_id = pa.array(pack.ids, pa.int64(), mask=pack.null)
            longs = pa.list_(pa.int64())
            digest = [hashlib.sha256(x).hexdigest() for x in kept]
            yield pa.RecordBatch.from_arrays([doc_id, pa.array([len(t) for t in pack.texts], pa.int64()), pa.array(starts, longs), pa.array(ends, longs), pa.array(kept, pa.binary()), pa.array(digest, pa.string())], ["doc_id", "n_bytes", "starts", "ends", "kept", "kept_sha256"])

    return run


def remove_repeats(docs: DataFrame, pack_bytes: int = PACK_BYTES, bucket_owners: int = BUCKET_OWNERS, bucket_parts: int = BUCKET_PARTS, hot_packs: int = HOT_PACKS, hot_runs: int = HOT_RUNS) -> DataFrame:
    """(doc_id, n_bytes, starts, ends, kept, kept_sha256) of every row: the removed byte spans and what is left.

    Null text is empty.  Rows with a null doc_id are kept whole and are no one's smaller document.  Rows that
    repeat a doc_id are one document: none of them loses bytes to another, and each comes back.  ``kept`` is
    binary, as a cut may fall inside a character.  Texts of any length are read whole, an empty table gives no rows.  Columns other than ``doc_id`` and ``text`` are not read.
    """
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    packed = packs(docs, total, pack_bytes)
    owner_buckets = max(1, -(-total // (14 * bucket_owners)))
    known = packed.join(cut(copies(packed)).hint("merge"), "pack", "left").select("pack", "ids", "sizes", "data", "copies")
    sent = known.mapInArrow(_send_owners(owner_buckets, hot_runs), "bucket long, pack long, hashes binary, several binary")
    # copies are handed on in buckets of their own, one for each pack
    met = cut(sent.groupBy("bucket", F.when(F.col("bucket") < 0, F.col("pack")).otherwise(0).alias("own")).applyInPandas(lambda group: _meet_owners(group, hot_packs), "pack long, bucket long, bits binary, n long"))
    part_buckets = max(1, -(-2 * (met.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) // bucket_parts))
    replies = cut(met.groupBy("pack").agg(F.collect_list(F.struct("bucket", "bits")).alias("replies")))
    told = packed.join(replies.hint("merge"), "pack").select("pack", "ids", "sizes", "data", "replies")
    parts = told.mapInArrow(_send_parts(owner_buckets, part_buckets), "bucket long, pack long, n long, data binary")
    verdicts = parts.groupBy("bucket").applyInPandas(_meet_parts, "pack long, bucket long, runs binary")
    verdicts = cut(verdicts.groupBy("pack").agg(F.collect_list(F.struct("bucket", "runs")).alias("verdicts")))
    last = packed.join(replies.hint("merge"), "pack").join(verdicts.hint("merge"), "pack", "left").select("pack", "ids", "sizes", "data", "replies", "verdicts")
    return last.mapInArrow(_remove(owner_buckets, part_buckets), "doc_id long, n_bytes long, starts array<long>, ends array<long>, kept binary, kept_sha256 string")


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    found = remove_repeats(docs).drop("kept")
    length = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda acc, x: acc + x)
    return found.select("doc_id", "n_bytes", length.alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), "kept_sha256")
