"""A corpus pipeline: each stage calls one operator on all that the stage before it kept.

Stages take documents with columns doc_id, text, lang, source and n_chars, and any others, which all but
the last stage carry as they are. Nulls may stand in any column; null texts count as empty. Empty tables
pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import decontamination, packing, pii, quality_rules, simhash
from lodestar.llm.common import materialise, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null, empty and short texts go, as they have fewer words than the rules ask for. Null languages and
    sources are groups of their own. Equal rows stay or go together. Columns named like the rules' own are carried.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")
    judged = quality_rules.judge(docs.select(row, "text", "lang", "source"))
    return judged.where("kept").select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: the least doc_id (nulls last), of equal ids the first in the table.

    Null and empty texts are duplicates of each other, and of nothing else.
    """
    return simhash.drop_near_duplicates(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not cover half of a test item's words by tiles of five words or more.

    Null texts hold nothing. Rows with the same doc_id and text stay or go together; a null doc_id is one as well.
    """
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with personal data in their texts replaced by its kind, and n_chars counted anew.

    Null texts stay null, with a null count.
    """
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their window and place in it; null and empty texts are an end id.

    Of the columns, doc_id alone is carried.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", benchmark_leaks),
    ("personal_data", personal_data),
    ("packing", pack),
]

#: SQL expresses neither distances to robust estimates nor decisions in order; tests/llm/test_pipeline.py
#: holds the rows of each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
