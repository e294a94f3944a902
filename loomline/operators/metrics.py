"""One-row summaries of a compressed corpus."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.operators.templates import MIN_OCCURRENCES


def structure_metrics(tokens: DataFrame) -> DataFrame:
    """(num_lines, json_lines_detected, json_template_count, normalized_template_count) of analysed lines."""
    return tokens.agg(
        F.count(F.lit(1)).alias("num_lines"), F.count_if("is_json").alias("json_lines_detected"),
        F.count_distinct(F.when(F.size("json_key") > 0, F.col("json_key"))).alias("json_template_count"), F.count_distinct("skeleton").alias("normalized_template_count"),
    )


def archive_metrics(rates: DataFrame, counts: DataFrame) -> DataFrame:
    """One row from ``fallback_reason`` and ``template_counts``: lines in files kept raw count as raw."""
    kept = F.col("reason").isNull()
    per = rates.agg(
        F.count(F.lit(1)).alias("num_files"), F.coalesce(F.sum("n_lines"), F.lit(0)).alias("num_lines"),
        F.coalesce(F.sum(F.when(kept, F.col("hits"))), F.lit(0)).alias("template_reuse_count"), F.coalesce(F.sum(F.when(kept, F.col("raw"))), F.lit(0)).alias("raw_fallback_lines"),
        F.coalesce(F.sum(F.when(kept, F.col("slots"))), F.lit(0)).alias("total_var_slots"),
        F.count(F.when(~kept, 1)).alias("raw_files"), F.count(F.when(F.col("reason") == "low_structure", 1)).alias("low_structure_fallback_files"),
        F.count(F.when(F.col("reason") == "no_templates", 1)).alias("no_template_files"), F.count(F.when(F.col("reason") == "binary", 1)).alias("binary_files"),
    )
    shared = counts.agg(F.count(F.when(F.col("n") >= MIN_OCCURRENCES, 1)).alias("num_shared_templates"))
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    return per.join(shared).withColumns({"template_reuse_rate": share("template_reuse_count", "num_lines"), "avg_vars_per_tpl_line": share("total_var_slots", "template_reuse_count")})


def reason_counts(rates: DataFrame) -> DataFrame:
    """(reason, n_files); files kept as templates count as template."""
    return rates.groupBy(F.coalesce("reason", F.lit("template")).alias("reason")).agg(F.count(F.lit(1)).alias("n_files"))


def encoding_counts(choice: DataFrame) -> DataFrame:
    return choice.groupBy("encoding").agg(F.count(F.lit(1)).alias("n_columns"), F.sum("size").alias("bytes"))


def tree_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """(path, difference) of two tables (path, content): missing, extra or changed files."""
    a, b = left.select("path", F.col("content").alias("a")), right.select("path", F.col("content").alias("b"))
    what = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").when(F.col("a") != F.col("b"), "changed")
    return a.join(b, "path", "full_outer").select("path", what.alias("difference")).filter("difference is not null")


def roll_up(results: DataFrame) -> DataFrame:
    """One row of results (name, structured, delta_pct): wins, losses, structured losses, and whether the whole passes:
    three wins or more and no structured loss."""
    wins, lost = F.count_if(F.col("delta_pct") < 0), F.count_if((F.col("delta_pct") > 10) & F.col("structured"))
    return results.agg(wins.alias("wins"), F.count_if(F.col("delta_pct") > 10).alias("losses"), lost.alias("structured_losses"), F.max_by("name", "delta_pct").alias("worst")).withColumn("passed", (F.col("wins") >= 3) & (F.col("structured_losses") == 0))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
