"""Global positions without a single-partition window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.session import cut


def positions(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with a column ``name`` of its rows' places (from 0) in the order of the columns ``order``.

    Rows are range-partitioned and sorted; the sizes of the partitions before a row's own give its offset, so
    no partition holds more than its share, whatever the keys.  Rows that tie on ``order`` get some order.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # an id's upper bits are the partition, its lower 33 bits the place in it
    placed = cut(ranged.withColumn("__place", F.monotonically_increasing_id()))
    sizes = {r[0]: r[1] for r in placed.groupBy(F.shiftright("__place", 33)).count().collect()}
    offset, offsets = 0, []
    for part in range(max(sizes, default=0) + 1):
        offsets.append(offset)
        offset += sizes.get(part, 0)
    base = F.element_at(F.array(*[F.lit(x).cast("long") for x in offsets]), F.shiftright("__place", 33).cast("int") + 1)
    return placed.withColumn(name, base + F.col("__place").bitwiseAND((1 << 33) - 1)).drop("__place")
