"""Template counts over streams of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.operators.templates import display, parts_of

#: What a stream's results are told apart by.
KEYS, WINDOWED_KEYS = ("parts",), ("window_start", "parts")


def stream_templates(lines: DataFrame) -> DataFrame:
    """Running (parts, template, n) of a stream with a column ``line``; its state holds every template."""
    counted = lines.groupBy(parts_of(F.col("line")).alias("parts")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select("parts", display(F.col("parts")).alias("template"), "n")


def windowed_templates(lines: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window_start, parts, template, n) of a stream with ``line`` and an event time ``ts``.

    In update or append mode, rows whose window closed ``late`` ago are dropped and closed windows leave the state; in
    complete mode Spark keeps all.
    """
    rows = lines.select("ts", parts_of(F.col("line")).alias("parts")).withWatermark("ts", late)
    counted = rows.groupBy(F.window("ts", width).alias("w"), "parts").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), "parts", display(F.col("parts")).alias("template"), "n")


def drain(stream: DataFrame, folder: str, keys: tuple[str, ...]) -> DataFrame:
    """Run an aggregating stream over all that is there now.

    The rows that a batch changes are added to Parquet in ``folder``; of a key the last batch's row is the result.  A
    batch that is run again after a failure writes its own folder again.
    """

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/result/batch={number}")

    stream.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").foreachBatch(save).trigger(availableNow=True).start().awaitTermination()
    changes = stream.sparkSession.read.schema(stream.schema.add("batch", "long")).parquet(f"{folder}/result")
    values = [c for c in stream.columns if c not in keys]
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("last"))
    return last.select(*keys, *[F.col(f"last.{c}").alias(c) for c in values]).select(*stream.columns)
