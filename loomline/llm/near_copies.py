"""Near copies by SimHash, and by an exact join of shingle sets where fingerprints are far apart.

Two texts link if the Jaccard similarity of their sets of 5-word shingles is 4/5 or more.  Sets whose SimHash fingerprints
differ in 10 bits or fewer are found by tables of their blocks (``simhash.together``); their texts are fetched and their sets
compared.  Linked texts can be farther apart than that, so a prefix join names the pairs that fingerprints didn't bring
together.  Shingles are 64-bit hashes in one order: by value, those that very many texts hold last.  Of n shingles the n - ceil(4n/5) + 1 first
are a text's prefix: linked texts share a shingle of their prefixes, so joining prefixes loses no pair, whatever
the order; putting common shingles last only keeps them out of most prefixes.  Texts that share a prefix shingle
are a bucket, which is left out if fingerprints brought all to one of them.  Sizes and parity sketches, which rule out no linked pair, first split buckets into components of
pairs that may link; only these texts are fetched, and their sets compared.  Equal buckets count once.  Buckets and
components of any size are dealt in blocks, each pair of blocks to one group.  Nothing is dropped or capped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from loomline.llm import simhash
from loomline.llm.common import components, cut, slices, text_bytes, whole_groups

SHINGLE, SEED = 5, 42
#: Texts of a block, and shingles of one whose sets are compared; a group holds two blocks at most.
BUCKET, BLOCK_SHINGLES = 4096, 4 << 20
#: Members up to which a bucket is compared pair by pair.
SMALL = 48
#: Shingles that a task counts at a time, how often one must be among them to be common, and common ones told apart.
CHUNK, OFTEN, COMMON = 2_000_000, 16, 200_000
#: Least and most bits of a parity sketch; in between it has as many as its set has members, rounded up to a power of two.
SKETCH = (64, 1 << 16)
#: Rows (of two longs) up to which the texts to be fetched are named in a broadcast.
NAMED = 1_000_000


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of the 5-word shingles; shorter texts have one of all their words, empty ones none."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    digest = xxhash.xxh64_intdigest
    ends = list(accumulate(len(w) + 1 for w in words))
    return np.unique(np.array([digest(joined[s : e - 1], SEED) for s, e in zip([0, *ends], ends[SHINGLE - 1 :], strict=False)], np.uint64))


def _node(shingles: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())).view(np.int64))


def _common(docs: DataFrame) -> np.ndarray:
    """Common shingles, sorted, in a table with their rank (from 1, the commonest last): at most ``COMMON`` rows.

    It decides nothing but an order, so it needs to hold the very common ones only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            values, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            often = n >= OFTEN
            return pa.RecordBatch.from_arrays([pa.array(values[often].view(np.int64)), pa.array(n[often].astype(np.int64))], ["key", "n"])

        size = 0
        for batch in slices(batches, 0, 8 << 20):
            for text in text_bytes(batch.column(0)):
                held.append(shingle_set(text))
                size += len(held[-1])
                if size >= CHUNK:
                    yield out()
                    size = 0
        if held:
            yield out()

    counted = docs.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    rows = counted.orderBy(F.desc("n"), "key").limit(COMMON).toArrow()
    keys = rows["key"].to_numpy().view(np.uint64)[::-1]
    order = np.argsort(keys)
    return np.stack([keys[order], order.astype(np.uint64) + np.uint64(1)])


def prefix(shingles: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first n - ceil(4n/5) + 1 shingles in the order of (rank among the common ones, value): rare and common ones."""
    n = len(shingles)
    size = n - -(-4 * n // 5) + 1 if n else 0
    if not n or not common.shape[1]:
        return shingles[:size], shingles[:0]
    at = np.minimum(np.searchsorted(common[0], shingles), common.shape[1] - 1)
    rank = np.where(common[0][at] == shingles, common[1][at], np.uint64(0))
    first = np.argsort(rank, kind="stable")[:size]
    return shingles[first[rank[first] == 0]], shingles[first[rank[first] > 0]]


def _sketch(shingles: np.ndarray) -> bytes:
    """Bit i says whether an odd number of shingles fall to i, so sketches differ in no more bits than their sets in members."""
    bits = min(max(SKETCH[0], 1 << max(0, len(shingles) - 1).bit_length()), SKETCH[1])
    odd = np.bincount((shingles % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _folded(sketch: np.ndarray) -> np.ndarray:
    """Sketches of half the bits of those in the last axis."""
    half = sketch.shape[-1] // 2
    return sketch[..., :half] ^ sketch[..., half:]


def _partners(n: np.ndarray, sketches: list[bytes]) -> Iterator[np.ndarray]:
    """For each member, of members in order of size, those before it that sizes and sketches allow to link with it.

    Linked sets differ in a ninth of both sizes at most, so their sketches are equally long or one is twice the other.
    """
    if len(n) <= SMALL:
        held = [(size, len(s) * 8, int.from_bytes(s, "little")) for size, s in zip(n.tolist(), sketches, strict=True)]
        for i, (size, bits, own) in enumerate(held):
            half = (own >> bits // 2) ^ (own & ((1 << bits // 2) - 1))
            found = []
            for j in range(i - 1, -1, -1):
                other, length, sketch = held[j]
                if 5 * other < 4 * size:
                    break
                if 9 * ((own if length == bits else half) ^ sketch).bit_count() <= size + other:
                    found.append(j)
            yield np.array(found[::-1], np.int64)
        return
    length = np.array([len(s) for s in sketches])
    first = {x: int(np.searchsorted(length, x)) for x in np.unique(length).tolist()}
    matrix = {x: np.frombuffer(b"".join(s for s in sketches if len(s) == x), np.uint64).reshape(-1, x // 8) for x in first}
    low = np.searchsorted(5 * n, 4 * n)
    for i, x in enumerate(length.tolist()):
        own, found = matrix[x][i - first[x]], []
        for size, mine in ((x // 2, _folded(own)), (x, own)) if x // 2 in first else ((x, own),):
            start, stop = max(int(low[i]), first[size]), min(i, first[size] + len(matrix[size]))
            if start < stop:
                apart = np.bitwise_count(matrix[size][start - first[size] : stop - first[size]] ^ mine).sum(axis=1, dtype=np.int64)
                found.append(start + np.nonzero(9 * apart <= n[start:stop] + n[i])[0])
        yield np.concatenate(found) if found else np.zeros(0, np.int64)


def _met(a: np.ndarray, b: np.ndarray) -> int:
    """How many members two sorted sets share."""
    return int(np.count_nonzero(b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a)) if len(b) else 0


def stars(nodes: np.ndarray, n: np.ndarray, sketches: list[bytes], sets: list[np.ndarray] | None = None) -> list[tuple[int, int]]:
    """A star (centre, member) for each local component of one bucket; without sets, of the pairs that may link."""
    order = np.lexsort((nodes, n))
    nodes, n, sketches = nodes[order], n[order], [sketches[i] for i in order.tolist()]
    label = np.arange(len(nodes))
    for i, near in enumerate(_partners(n, sketches)):
        if sets is not None:
            linked: set[int] = set()
            own = sets[order[i]]
            for j in near.tolist():
                if label[j] not in linked:
                    met = _met(own, sets[order[j]])
                    if 5 * met >= 4 * (n[i] + n[j] - met):
                        linked.add(int(label[j]))
            roots = np.array(sorted(linked), np.int64)
        else:
            roots = np.unique(label[near])
        if len(roots) > 1:
            label[:i][np.isin(label[:i], roots)] = roots[0]
        if len(roots):
            label[i] = roots[0]
    return [(int(nodes[r]), int(nodes[i])) for i, r in enumerate(label.tolist()) if r != i]


SETS = "doc_id long, node long, t long, n int, fp long, sketch binary, rare array<long>, common array<long>"


def _sets(docs: DataFrame) -> DataFrame:
    """(doc_id, node, t, n, fp, sketch, rare, common) of every row: the hash of its shingle set, that of its text, and the
    set's size, fingerprint, sketch and prefix; the last four are null where the same task has them in an earlier row, so that copies stay small."""
    held = docs.sparkSession.sparkContext.broadcast(_common(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in slices(batches, 2, 8 << 20):
            found = [shingle_set(x) for x in text_bytes(batch.column(2))]
            nodes = [_node(s) for s in found]
            new = []
            for node in nodes:
                new.append(node not in seen)
                seen.add(node)
            keys = [prefix(s, held.value) if x else None for s, x in zip(found, new, strict=True)]
            lists = [pa.array([x and x[i].view(np.int64) for x in keys], pa.list_(pa.int64())) for i in (0, 1)]
            fps = pa.array([simhash.signed(simhash.majority(s)) if x else None for s, x in zip(found, new, strict=True)], pa.int64())
            sketches = pa.array([_sketch(s) if x else None for s, x in zip(found, new, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.int64()), batch.column(1), pa.array([len(s) for s in found], pa.int32()), fps, sketches, *lists], ["doc_id", "node", "t", "n", "fp", "sketch", "rare", "common"])

    return docs.select(F.col("doc_id").cast("long"), _text_hash().alias("t"), "text").mapInArrow(run, SETS)


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _dealt(members: DataFrame, blocks: Column) -> DataFrame:
    """(nodes) of the groups of ``members`` (key, node and what ``blocks`` names): a group of several blocks becomes a
    list for each pair of them."""
    own = members.withColumn("blocks", blocks.cast("int")).withColumn("i", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: x != F.col("i"))
    each = own.select("key", "node", "i", F.explode(F.when(F.col("blocks") > 1, others).otherwise(F.array("i"))).alias("o"))
    each = each.select("key", F.least("i", "o").alias("j"), F.greatest("i", "o").alias("k"), "node")
    return each.groupBy("key", "j", "k").agg(F.array_sort(F.collect_set("node")).alias("nodes")).select("nodes").filter(F.size("nodes") > 1)


def _rare(keyed: DataFrame, bucket: int) -> DataFrame:
    """(nodes) of the keys of ``keyed`` (key, node) that several nodes have, for keys that aren't common, whose rows
    are therefore few: they meet in one sorted shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _ in whole_groups(batches):
            key, node = rows["key"].to_numpy(), rows["node"].to_numpy()
            fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])])
            key, node = key[fresh], node[fresh]
            first = np.nonzero(np.concatenate([[True], key[1:] != key[:-1]]))[0]
            size = np.diff(np.append(first, len(key)))
            out = []
            for a, n in zip(first[size > 1].tolist(), size[size > 1].tolist(), strict=True):
                blocks = -(-n // bucket)
                parts = [node[a : a + n][i::blocks] for i in range(blocks)]
                out += [np.sort(np.concatenate([x, y])) for i, x in enumerate(parts) for y in parts[:i]] if blocks > 1 else parts
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.int64()))], ["nodes"])

    return keyed.select("key", "node").repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, "nodes array<long>")


def _buckets(lists: DataFrame) -> DataFrame:
    """(bucket, node) of lists of nodes; equal ones count once, and a bucket is the hash of its nodes."""
    return lists.distinct().select(F.xxhash64("nodes").alias("bucket"), F.explode("nodes").alias("node"))


def _each_bucket(compare: Callable[[dict[str, list]], list[tuple[int, int]]]):
    """Edges of the buckets of a partition sorted by ``bucket``, its first column; a bucket is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, ends in whole_groups(batches):
            columns = {name: rows[name].to_pylist() for name in rows.column_names[1:]}
            found: set[tuple[int, int]] = set()
            for a, b in zip([0, *ends], ends, strict=False):
                found.update(compare({name: values[a:b] for name, values in columns.items()}))
            yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in sorted(found)], pa.int64()) for i in (0, 1)], ["a", "b"])

    return run


def links(docs: DataFrame, sets: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) between nodes that span every component of the graph of linked texts.

    Fingerprints bring texts together first; of the buckets of the prefix join those are left out whose texts all
    met the same one.  In the rest sizes and sketches tell which members may link.  The components of all
    these pairs are few and small, and only their texts are fetched and compared.
    """
    met = cut(simhash.together(sets.filter("fp is not null").select(F.col("node").alias("v"), "fp").dropDuplicates(["v"]), bucket=bucket))
    both = met.union(met.select(F.col("b").alias("a"), F.col("a").alias("b")))
    label = both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("l"))
    common = sets.select("node", F.explode("common").alias("key"))
    sizes = common.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
    lists = _rare(sets.select("node", F.explode("rare").alias("key")), bucket).union(_dealt(common.join(sizes, "key"), F.ceil(F.col("size") / bucket)))
    held = cut(_buckets(lists).join(label, "node", "left").select("bucket", "node", F.coalesce("l", "node").alias("l")))
    apart = held.groupBy("bucket").agg(F.min("l").alias("x"), F.max("l").alias("y")).filter("x < y").select("bucket")
    sketched = held.join(apart, "bucket").join(sets.filter("sketch is not null").select("node", "n", "sketch").dropDuplicates(["node"]), "node").select("bucket", "node", "n", "sketch")

    def may_link(part: dict[str, list]) -> list[tuple[int, int]]:
        return stars(np.array(part["node"], np.int64), np.array(part["n"], np.int64), part["sketch"])

    far = sketched.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_each_bucket(may_link), "a long, b long")
    near = cut(components(met.union(far)))
    rows = sets.select(F.col("node").alias("v"), "doc_id", "t", "n")
    wanted = cut(near.join(rows, "v").dropDuplicates(["v"]).withColumnRenamed("v", "node"))
    sizes = wanted.groupBy("l").agg(F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count(F.lit(1)) / bucket)).alias("most"))
    members = _buckets(_dealt(wanted.join(sizes, "l").select(F.col("l").alias("key"), "node", "most"), F.col("most")))
    named = wanted.select("node", F.col("doc_id").alias("__ll_id"), "t")
    if named.count() <= NAMED:
        named = F.broadcast(named)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, 8 << 20):
            found = [shingle_set(x) for x in text_bytes(batch.column(1))]
            right = [_node(s) == node for s, node in zip(found, batch.column(0).to_pylist(), strict=True)]
            out = pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in found], pa.binary())], ["node", "shingles"])
            yield out.filter(pa.array(right, pa.bool_()))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_hash().alias("t"), "text")
    texts = rows.join(named, (rows.t == named.t) & rows.doc_id.eqNullSafe(named["__ll_id"]))
    shingles = texts.select("node", "text").mapInArrow(hashed, "node long, shingles binary").dropDuplicates(["node"])

    def compare(part: dict[str, list]) -> list[tuple[int, int]]:
        sets = [np.frombuffer(x, np.uint64) for x in part["shingles"]]
        return stars(np.array(part["node"], np.int64), np.array([len(x) for x in sets]), [_sketch(x) for x in sets], sets)

    found = members.join(shingles, "node").select("bucket", "node", "shingles")
    return found.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_each_bucket(compare), "a long, b long")


def groups(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, component_id) of every row of ``docs``; component_id is the smallest non-null doc_id of its group.

    Texts without a word are one group.  It is null only where all ids of a group are null.  Texts of any length are
    read whole.  Columns other than ``doc_id`` and ``text`` are not read.
    """
    sets = cut(_sets(docs))
    root = components(links(docs, sets, bucket)).select(F.col("v").alias("node"), F.col("l").alias("root"))
    firsts = sets.groupBy("node").agg(F.min("doc_id").alias("first"))
    rooted = cut(firsts.join(root, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root")))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return sets.select("doc_id", "node").join(rooted.join(least, "root").select("node", "component_id"), "node").select("doc_id", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of near copies: that of its smallest doc_id.

    Of rows that repeat that doc_id one stays, that with the least hash of its columns.  Rows with a null doc_id can't
    be named by a group and stay.  All columns pass through, whatever their names; an empty table comes back empty.
    """
    found = cut(groups(docs))
    keep = found.filter("doc_id = component_id").select(F.col("doc_id").alias("__ll_id")).distinct()
    named = docs.filter("doc_id is not null").join(keep, F.col("doc_id").cast("long") == F.col("__ll_id"), "left_semi")
    if found.filter("doc_id = component_id").groupBy("doc_id").count().filter("count > 1").limit(1).count():
        row = F.xxhash64(*[F.col("`" + f.name.replace("`", "``") + "`") for f in docs.schema.fields if not isinstance(f.dataType, MapType)])
        one = named.groupBy(F.col("doc_id").alias("__ll_one")).agg(F.min(row).alias("__ll_row"))
        named = named.join(one, (F.col("doc_id") == F.col("__ll_one")) & (row == F.col("__ll_row"))).drop("__ll_one", "__ll_row").dropDuplicates(["doc_id"])
    return named.unionByName(docs.filter("doc_id is null"))
