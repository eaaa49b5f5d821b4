"""A training-data pipeline: language ID, line deduplication, near duplicates, mix, encoding.

Each stage takes the documents that its predecessor kept and returns documents; the last returns
token counts and digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe.llm import jaccard_join, language_id, line_chunks, piece_table, source_mix
from strideframe.llm.common import SPACES, kept_table
from strideframe.llm.queries import PIECE_MODEL, learned_languages


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a margin; the language found replaces `lang`.

    Null texts and texts without letters are rejected and go. Without any labelled text nothing
    can be learned, and every document is rejected.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", F.col("text").cast("string").alias("text"))
    rows = language_id.with_language(rows, learned_languages(docs.select("doc_id", "text", "lang"))).where(~F.col("guess.rejected"))
    return rows.select(*[F.col("guess.lang").alias(c) if c == "lang" else F.col(f"row.`{c}`") for c in docs.columns])


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated passages; one of which nothing is left is a copy and goes."""
    kept = line_chunks.without_repeats(docs)
    blank = F.btrim(F.coalesce(F.col("text"), F.lit("")), F.lit(SPACES)) == ""
    return kept.where(~blank | (F.col("removed_lines") == 0)).select(*[F.col(f"`{c}`") for c in docs.columns])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the least doc_id; of rows that repeat it, one."""
    classes = kept_table(jaccard_join.jaccard_classes(docs), "classes")
    first = classes.where("doc_id = component_id").select(F.col("doc_id").alias("first_id")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"))
    kept = rows.join(first, F.col("id") == F.col("first_id")).select("row.*", "id")
    return kept.dropDuplicates(["id"]).drop("id") if _repeats(classes) else kept.drop("id")


def _repeats(classes: DataFrame) -> bool:
    return not classes.groupBy("doc_id").count().where("count > 1").isEmpty()


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents mixed to their sources' targets."""
    return source_mix.mixed_documents(docs)


def token_digests(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of the decoded text."""
    return piece_table.encoded(docs, PIECE_MODEL)


STAGES = [
    ("language_id", known_language),
    ("line_dedup", without_repeated_lines),
    ("jaccard_join", one_of_each_group),
    ("source_mix", mixed),
    ("sentencepiece", token_digests),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is a Parquet table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for label, stage in STAGES[:-1]:
        docs = kept_table(stage(spark, docs, sf_dir), label)
    return STAGES[-1][1](spark, docs, sf_dir)
