"""Pieces that several text operators share.

Conventions of the subpackage: operators select the columns they need first, so that extra input
columns never clash; names made here start with ``__ll_``; lineage is cut only with ``checkpoint()``
in the shared folder of ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.session import cut
from loomline.sources.corpora import spread

#: The white space that separates words and pads lines (fixed values).
ASCII_SPACE = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table, read through Spark (any store Spark can open); a small table is dealt over all cores."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns))


def crc_bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus`` (null ids: null)."""
    return F.crc32(doc_id.cast("string")) % F.lit(modulus)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null becomes empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], text_index: int, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most_bytes`` of text at most (one row at least)."""
    for batch in batches:
        rows = batch.num_rows
        if not rows:
            continue
        per_row = max(1, batch.column(text_index).nbytes // rows)
        step = max(1, most_bytes // per_row)
        for start in range(0, rows, step):
            yield batch.slice(start, step)


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[int]]]:
    """The rows of a partition that is sorted by its first column, in tables that hold whole groups of equal values,
    and where the groups end; a group that spans batches is held until it ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and held[0].column(0)[0] == batch.column(0)[batch.num_rows - 1]:
            held.append(batch)  # still within one group
            continue
        rows = pa.Table.from_batches([*held, batch]).combine_chunks()
        key = rows.column(0).to_numpy()
        ends = (np.nonzero(key[1:] != key[:-1])[0] + 1).tolist()
        if ends:
            yield rows.slice(0, ends[-1]).combine_chunks(), ends
        held = rows.slice(ends[-1] if ends else 0).to_batches()
    if held:
        rows = pa.Table.from_batches(held).combine_chunks()
        yield rows, [rows.num_rows]


def arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph with long node ids.

    ``edges`` has columns ``a`` and ``b``; returns ``(v, l)``, ``l`` being the smallest node of v's
    component, for every node that has an edge.  Each round every label adopts the smallest label
    next to it and the paths of adopted labels are halved to their ends, so at least half of the labels that
    aren't final go in each round.  All joins are between two checkpointed tables, so that a skewed label is
    split at run time; no group is gathered.  An empty graph gives an empty table.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = cut(both.filter("a <> b").distinct())
    state = cut(both.select(F.col("a").alias("v"), F.col("a").alias("l")).distinct())
    while True:
        near = both.join(state.withColumnRenamed("v", "a"), "a").groupBy("b").agg(F.min("l").alias("m"))
        seen = cut(state.join(near, state.v == near.b).select("v", "l", F.least("l", "m").alias("n")))
        hook = cut(seen.groupBy("l").agg(F.min("n").alias("h")))
        if not hook.filter("h < l").limit(1).count():
            return state
        while True:  # each label points to a smaller one or itself: halve the paths until all point to their ends
            up = hook.select(F.col("l").alias("h"), F.col("h").alias("__ll_up"))
            hook = cut(hook.join(up, "h").select("l", F.col("__ll_up").alias("h"), (F.col("__ll_up") < F.col("h")).alias("moved")))
            if not hook.filter("moved").limit(1).count():
                break
        state = cut(seen.select("v", "l").join(hook, "l").select("v", F.col("h").alias("l")))


def bounded_sample(rows: DataFrame, by: str, key: str, per_class: int) -> DataFrame:
    """About ``per_class`` rows of each value of ``by``, chosen by the hash of ``key`` alone.

    Used only to fit classifiers.  Chosen by hash thresholds rather than ranks, so that no class is sorted or
    gathered; the closing limit only bounds what rows that repeat one key could add.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(by).count().collect() if r[0] is not None}
    share = F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 30))
    keep = F.lit(False)
    for value, n in sorted(counts.items(), key=str):
        keep = keep | ((F.col(by) == F.lit(value)) & (share < int((1 << 30) * min(1.0, per_class / n))))
    return rows.filter(keep).limit(4 * per_class * max(1, len(counts)))
