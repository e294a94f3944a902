"""A training-data pipeline: five stages, each calling one operator on all that the stage before kept.

Every stage takes (spark, docs, sf_dir) and returns the columns of ``docs`` (the last adds ``mix_rate``).  All read texts of
any length whole, pass other columns through whatever their names, and return an empty table for an empty one.  Rows that
repeat are each judged by themselves, but for the near-copy stage, which keeps one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm import decontaminate, langid, line_dedup, mixing, simhash
from loomline.llm.common import table
from loomline.llm.queries import MIX_TARGETS
from loomline.session import remove, shared_folder


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has a language stay; null texts and texts without a letter go.  A null doc_id or lang teaches
    nothing and doesn't count against a row."""
    found = langid.predict(docs, langid.fit(langid.taught(docs.select("doc_id", "text", "lang"))))
    return found.filter(F.col("__ll_lang") != langid.UNKNOWN).select(*map(_quoted, docs.columns))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose their repeated lines; ``n_chars`` follows.  All rows stay; a null text becomes empty, and rows with a
    null doc_id keep no repeated line."""
    kept = line_dedup.dedup_lines(docs).select(*map(_quoted, docs.columns))
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group stays, that of its smallest doc_id.  Texts without a word are one group; rows with
    a null doc_id stay."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item go; null and empty texts and items hold nothing."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows stay, with the rate at which each is to be drawn in ``mix_rate``: 1 for null and empty texts, and for all
    rows where no label is known."""
    labelled = mixing.label_domains(table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))
    return mixing.with_rates(docs, labelled, MIX_TARGETS)


def _quoted(name: str):
    return F.col("`" + name.replace("`", "``") + "`")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("simhash_dedup", simhash_dedup),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
]

#: SQL can't express the stages; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each result is written as Parquet and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = None
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            folder = folder or f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
            docs.write.parquet(f"{folder}/{n}-{name}")
            docs = spark.read.parquet(f"{folder}/{n}-{name}")
            if n:  # all that follows reads the new result
                remove(spark, f"{folder}/{n - 1}-{STAGES[n - 1][0]}")
    return docs
