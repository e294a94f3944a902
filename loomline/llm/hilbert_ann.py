"""Approximate nearest neighbours over shifted Hilbert curves.

Vectors are projected onto a few random orthonormal directions, shifted, and put in the order of a Hilbert
curve; several curves with projections and shifts of their own see different neighbours.  Spark range-partitions
and sorts every curve's keys; a row's rank is its partition's offset plus its place.  A query's candidates are the
vectors within ``window`` ranks of its own on each curve.  Ranks are cut into blocks, and queries into spans of
ranks; a group is a block and a span, so its size doesn't depend on the table's.  A group finds its queries' nearest
candidates by codes of a byte a component; the best of all groups are merged and reranked by exact distance.
Every distinct vector is indexed on every curve.

How many curves and how wide a window are needed depends on the data.  Both are fitted on a bounded sample: for each
number of curves the least window whose recall against brute force there is ``RECALL``, and of these the pair with
the fewest candidates.  Of a query's neighbours in the table the sample holds its share, so as many are sought there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import cut

#: Numbers of curves tried, dimensions and bits a dimension of their keys (below 64 bits in all).
CURVES, DIMENSIONS, BITS = (4, 8, 12, 16, 24, 32, 48, 64), 8, 7
#: Sampled vectors and queries that fit curves and window, and the recall that they must reach.
SAMPLE, SAMPLE_QUERIES, RECALL = 8192, 256, 0.97
#: Ranks of a block of candidates, and of a span of queries.
BLOCK, SPAN = 4096, 65_536
#: Candidates that a group returns for a query and that are reranked, in multiples of the neighbours wanted.
NEAR, RERANK = 2, 4


def hilbert_keys(x: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert indexes of the rows of ``x``, whose entries are below 2**bits."""
    axes = [c.astype(np.int64) for c in x.T]
    m = len(axes)
    for level in range(bits - 1, 0, -1):  # undo the rotations and reflections of each level
        q = 1 << level
        low = q - 1
        for i in range(m):
            high = (axes[i] & q) != 0
            swap = np.where(high, 0, (axes[0] ^ axes[i]) & low)
            axes[0] = axes[0] ^ np.where(high, low, swap)
            axes[i] = axes[i] ^ (swap if i else 0)
    for i in range(1, m):  # Gray code
        axes[i] = axes[i] ^ axes[i - 1]
    flip = np.zeros(len(x), np.int64)
    for level in range(bits - 1, 0, -1):
        flip = np.where(axes[-1] & (1 << level), flip ^ ((1 << level) - 1), flip)
    key = np.zeros(len(x), np.int64)
    for level in range(bits - 1, -1, -1):
        for a in axes:
            key = key << 1 | ((a ^ flip) >> level) & 1
    return key


@dataclass
class Curves:
    """For each curve: its directions, and the lowest value, width and shift of its grid; middle and scale of the codes."""

    directions: list[np.ndarray]
    low: np.ndarray
    width: np.ndarray
    shift: np.ndarray
    middle: np.ndarray
    scale: float

    @classmethod
    def fit(cls, sample: np.ndarray, curves: int, seed: int = 11) -> Curves:
        rng = np.random.default_rng(seed)
        dim = sample.shape[1]
        m = min(DIMENSIONS, dim)
        directions = [np.linalg.qr(rng.normal(size=(dim, m)))[0] for _ in range(curves)]
        spread = [np.percentile(sample @ p, [0.5, 99.5]) for p in directions]
        low, high = np.array([s[0] for s in spread]), np.array([s[1] for s in spread])
        middle = sample.mean(0)
        scale = max(float(np.quantile(np.abs(sample - middle), 0.999)), 1e-300)
        return cls(directions, low, np.maximum(high - low, 1e-300), rng.random((curves, m)) * 0.25, middle, scale)

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        """A byte a component; the few that lie further out than nearly all of the sample's are cut."""
        return np.clip(np.rint((vectors - self.middle) / self.scale * 120), -127, 127).astype(np.int8)

    def keys(self, curve: int, vectors: np.ndarray) -> np.ndarray:
        y = (vectors @ self.directions[curve] - self.low[curve]) / self.width[curve] * 0.75 + self.shift[curve]
        return hilbert_keys(np.clip(y * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64), BITS)


def _distances(queries: np.ndarray, candidates: np.ndarray) -> Iterator[np.ndarray]:
    """Euclidean distances of each query to all candidates, in double precision."""
    for q in queries:
        d = candidates - q
        yield np.sqrt(np.einsum("ij,ij->i", d, d))


def fit_window(sample: np.ndarray, curves: Curves, k: int) -> tuple[int, float]:
    """How many curves to use, and the share of all ranks that a window spans to either side."""
    n = len(sample)
    if n <= k + 1:
        return 1, 1.0
    queries = np.arange(0, n, max(1, n // SAMPLE_QUERIES))
    truth = []
    for i, d in zip(queries, _distances(sample[queries], sample), strict=True):
        d[i] = np.inf
        truth.append(np.argpartition(d, k)[:k])
    near = np.array(truth)
    gaps = np.full(near.shape, n)  # least rank gap over the curves so far
    best = (math.inf, 1, 1.0)
    for c in range(len(curves.directions)):
        rank = np.empty(n, np.int64)
        rank[np.argsort(curves.keys(c, sample), kind="stable")] = np.arange(n)
        gaps = np.minimum(gaps, np.abs(rank[near] - rank[queries][:, None]))
        if c + 1 in CURVES:
            window = int(np.quantile(gaps, RECALL, method="higher"))
            best = min(best, ((c + 1) * window, c + 1, window / n))
    return best[1:]


def packed(vectors: DataFrame, is_query: Column) -> DataFrame:
    """(vec_id, vec, dim, q) of the usable rows of ``vectors`` (vec_id, embedding); vec holds doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            n = len(lists)
            length = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
            values = pc.fill_null(lists.flatten().cast(pa.float64()), math.nan).to_numpy() + 0.0  # no negative zero
            row = np.repeat(np.arange(n), length)
            fine = (np.bincount(row, ~np.isfinite(values), n) == 0) & (np.bincount(row, values != 0, n) > 0)
            start = np.cumsum(length) - length
            rows = np.nonzero(fine)[0]
            vec = [values[s : s + x].tobytes() for s, x in zip(start[rows].tolist(), length[rows].tolist(), strict=True)]
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), pa.array(vec, pa.binary()), pa.array(length[rows].astype(np.int32)), batch.column(2).take(take)], ["vec_id", "vec", "dim", "q"])

    rows = vectors.filter("vec_id is not null and embedding is not null")
    rows = rows.select(F.col("vec_id").cast("long"), "embedding", is_query.alias("q"))
    return rows.mapInArrow(run, "vec_id long, vec binary, dim int, q boolean")


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """(did, vec, ids, q): each distinct vector with a number, its ``keep`` smallest ids, and whether any of its rows is
    a query.  Tasks reduce their rows first, so that a vector that many rows share stays small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bytes, list] = {}

        def out() -> pa.RecordBatch:
            ids = [sorted(x[0])[:keep] for x in found.values()]
            columns = [pa.array(list(found), pa.binary()), pa.array(ids, pa.list_(pa.int64())), pa.array([x[1] for x in found.values()])]
            found.clear()
            return pa.RecordBatch.from_arrays(columns, ["vec", "ids", "q"])

        for batch in batches:
            for vec_id, vec, q in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
                own = found.setdefault(vec, [[], False])
                own[0].append(vec_id)
                own[1] |= q
                if len(own[0]) > 1000:
                    own[0] = sorted(own[0])[:keep]
            if len(found) > 20_000:
                yield out()
        if found:
            yield out()

    part = rows.mapInArrow(run, "vec binary, ids array<long>, q boolean")
    least = F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, keep)
    return part.groupBy("vec").agg(least.alias("ids"), F.max("q").alias("q")).select(F.monotonically_increasing_id().alias("did"), "vec", "ids", "q")


def _matrix(column) -> np.ndarray:
    blobs = list(column)
    return np.frombuffer(b"".join(blobs), np.float64).reshape(len(blobs), -1) if blobs else np.zeros((0, 1))


def coded(distinct: DataFrame, curves: Curves) -> DataFrame:
    """(did, code, q): each vector in a byte a component."""
    held = distinct.sparkSession.sparkContext.broadcast(curves)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes = pa.array([row.tobytes() for row in held.value.codes(_matrix(batch.column(1).to_pylist()))], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), codes, batch.column(2)], ["did", "code", "q"])

    return distinct.select("did", "vec", "q").mapInArrow(run, "did long, code binary, q boolean")


def ranks(distinct: DataFrame, curves: Curves, used: int) -> DataFrame:
    """(curve, rank, did) of every distinct vector on the first ``used`` curves."""
    spark = distinct.sparkSession
    held = spark.sparkContext.broadcast(curves)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Curves = held.value
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1).to_pylist())
                for c in range(used):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), c, np.int32)), pa.array(own.keys(c, x)), batch.column(0)], ["curve", "key", "did"])

    keyed = distinct.select("did", "vec").mapInArrow(keys, "curve int, key long, did long")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = cut(keyed.repartitionByRange(parts, "curve", "key", "did").sortWithinPartitions("curve", "key", "did").withColumn("p", F.spark_partition_id()))
    sizes = sorted(tuple(r) for r in ordered.groupBy("p", "curve").count().collect())
    offsets, seen = {}, {}
    for p, c, n in sizes:
        offsets[p, c] = seen.get(c, 0)
        seen[c] = seen.get(c, 0) + n

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: dict[int, int] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            curve, p = batch.column(0).to_numpy(), batch.column(3)[0].as_py()
            rank = np.empty(len(curve), np.int64)
            for c in np.unique(curve).tolist():
                own = np.nonzero(curve == c)[0]
                first = at.setdefault(c, offsets[p, c])
                rank[own] = first + np.arange(len(own))
                at[c] = first + len(own)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rank), batch.column(2)], ["curve", "rank", "did"])

    return ordered.mapInArrow(number, "curve int, rank long, did long")


def plan(distinct: DataFrame, total: int, k: int) -> tuple[Curves, int, int]:
    """The fitted curves, how many of them to use, and their window in ranks."""
    share = F.pmod(F.xxhash64("vec"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE / total))
    sample = _matrix(distinct.filter(share).select("vec").limit(2 * SAMPLE).orderBy("vec").toPandas().vec)
    if not len(sample):
        sample = _matrix(distinct.select("vec").limit(1).toPandas().vec)
    fitted = Curves.fit(sample, CURVES[-1])
    # of a query's k neighbours in the table a sample holds its share, and these are the nearest in the sample
    used, window = fit_window(sample, fitted, max(1, math.ceil(k * len(sample) / total)))
    return fitted, used, max(1, math.ceil(window * total))


def nearest_codes(placed: DataFrame, total: int, window: int, k: int, block: int = BLOCK, span: int = SPAN) -> DataFrame:
    """(asker, did): the ``RERANK`` * (k + 1) candidates of every query that are nearest by code.

    On the first curve a window spans k + 1 ranks at least, so that every query has as many candidates as it can.
    """
    reach = F.when(F.col("curve") == 0, max(window, k + 1)).otherwise(window).cast("long")
    last = (total - 1) // block
    rows = placed.withColumn("reach", reach)
    near = F.sequence(F.floor(F.greatest(F.col("rank") - F.col("reach"), F.lit(0)) / block), F.least(F.floor((F.col("rank") + F.col("reach")) / block), F.lit(last).cast("long")))
    asks = rows.filter("q").select("curve", F.explode(near).alias("block"), F.floor(F.col("rank") / span).alias("span"), "rank", "did", "code", F.lit(True).alias("asks"))
    own = F.floor(F.col("rank") / block)
    begin, end = own * block - F.col("reach"), (own + 1) * block + F.col("reach")
    spans = F.sequence(F.floor(F.greatest(begin, F.lit(0)) / span), F.floor(F.least(end, F.lit(total - 1).cast("long")) / span))
    offered = rows.select("curve", own.alias("block"), F.explode(spans).alias("span"), "rank", "did", "code", F.lit(False).alias("asks"))

    def nearest(group: pd.DataFrame) -> pd.DataFrame:
        asked = group.asks.to_numpy(bool)
        out: list[tuple[int, int, float]] = []
        if asked.any() and not asked.all():
            mine = group[~asked].sort_values("rank")
            ids, rank = mine.did.to_numpy(np.int64), mine["rank"].to_numpy(np.int64)
            x = _codes(mine.code)
            wide = max(window, k + 1) if group.curve.iloc[0] == 0 else window
            queries = group[asked]
            at = queries["rank"].to_numpy(np.int64)
            first, stop = np.searchsorted(rank, at - wide), np.searchsorted(rank, at + wide, side="right")
            for did, q, a, b in zip(queries.did.tolist(), _codes(queries.code), first.tolist(), stop.tolist(), strict=True):
                d = x[a:b] - q
                d = np.einsum("ij,ij->i", d, d)
                best = np.argpartition(d, NEAR * (k + 1))[: NEAR * (k + 1)] if len(d) > NEAR * (k + 1) else np.arange(len(d))
                out += zip([did] * len(best), ids[a:b][best].tolist(), d[best].tolist(), strict=True)
        return pd.DataFrame(out, columns=["asker", "did", "d"]).astype({"asker": "int64", "did": "int64", "d": "float64"})

    found = asks.union(offered).groupBy("curve", "block", "span").applyInPandas(nearest, "asker long, did long, d double")
    best = F.slice(F.array_sort(F.collect_set(F.struct("d", "did"))), 1, RERANK * (k + 1))
    return found.groupBy("asker").agg(best.alias("near")).select("asker", F.explode("near.did").alias("did"))


def _codes(column) -> np.ndarray:
    blobs = list(column)
    return np.frombuffer(b"".join(blobs), np.int8).reshape(len(blobs), -1).astype(np.float32)


def _of_one_length(rows: DataFrame, k: int) -> DataFrame:
    """``search`` over rows of ``packed`` whose vectors are equally long."""
    distinct = cut(distinct_vectors(rows, k + 1))
    total = distinct.count()
    fitted, used, window = plan(distinct, total, k)
    placed = ranks(distinct, fitted, used).join(coded(distinct, fitted), "did").select("curve", "rank", "did", "code", "q")
    pairs = nearest_codes(placed, total, window, k)
    asker = distinct.filter("q").select(F.col("did").alias("asker"), F.col("vec").alias("own"))
    both = pairs.join(distinct.select("did", "vec", "ids"), "did").join(asker, "asker").select("asker", "ids", "own", "vec")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = _matrix(batch.column(3).to_pylist()) - _matrix(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(np.sqrt(np.einsum("ij,ij->i", d, d)))], ["asker", "ids", "d"])

    scored = both.mapInArrow(exact, "asker long, ids array<long>, d double").select("asker", "d", F.explode("ids").alias("vec_id"))
    lists = scored.groupBy("asker").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "vec_id"))), 1, k + 1).alias("near"))
    asked = rows.filter("q").select(F.col("vec_id").alias("query_id"), "vec").join(distinct.select("did", "vec"), "vec").select("query_id", F.col("did").alias("asker"))
    mine = F.array_position(F.transform("near", lambda x: x["vec_id"]), F.col("query_id"))
    others = asked.join(lists, "asker").select("query_id", F.slice(F.filter("near", lambda x, i: i + 1 != mine), 1, k).alias("near"))
    ranked = others.select("query_id", F.posexplode("near").alias("at", "n"))
    return ranked.select("query_id", (F.col("at") + 1).alias("rank"), F.col("n.vec_id").alias("vec_id"), F.col("n.d").alias("score"))


def search(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of every query row, nearest first, ties to the
    smaller vec_id; score is the Euclidean distance in double precision.

    Null and zero vectors and those with null or non-finite components take no part, nor do null ids.  Only vectors
    of one length have a distance, so each length is searched on its own.  Rows that repeat an id are rows like
    any other: a query row has every row but itself as a candidate, and each query row has its own neighbours.
    No usable vector: no rows.  A vector alone: no rows, as there is no candidate.  Other columns are not read.
    """
    rows = cut(packed(vectors, is_query))
    found = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for dim in sorted(r.dim for r in rows.filter("q").select("dim").distinct().collect()):
        found = found.union(_of_one_length(rows.filter(F.col("dim") == dim), k))
    return found
