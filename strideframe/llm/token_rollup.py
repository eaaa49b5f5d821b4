"""Token counts by source, language and tokenizer version, maintained by signed deltas.

A store is a folder with one subfolder for each batch, which holds the batch's sums and, once these
are complete, a mark. Only marked batches count; committing one again changes nothing, and an
attempt that broke off before its mark is written over. Totals are sums over the batches, so
batches may arrive in any order.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("source", "lang", "tokenizer")
SUMS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def inserted(counts: DataFrame) -> DataFrame:
    """Signed rows for new documents; `counts` has KEYS and n_tokens, null tokens count as 0."""
    return _signed(counts, F.lit(1), F.col("n_tokens"))


def deleted(counts: DataFrame) -> DataFrame:
    """Signed rows that take documents out again; `counts` as they were inserted."""
    return _signed(counts, F.lit(-1), -F.col("n_tokens"))


def revised(counts: DataFrame) -> DataFrame:
    """Signed rows for changed counts of documents that stay: old_tokens goes, n_tokens comes."""
    return _signed(counts, F.lit(0), F.col("n_tokens") - F.coalesce("old_tokens", F.lit(0)))


def _signed(counts: DataFrame, docs: Column, tokens: Column) -> DataFrame:
    return counts.select(*[F.col(k).cast("string").alias(k) for k in KEYS], docs.cast("long").alias("n_docs"), F.coalesce(tokens, F.lit(0)).cast("long").alias("n_tokens"))


def _folder(store: str, batch: str) -> str:
    if not batch or "/" in batch or batch[0] in "._":
        raise ValueError(f"not a batch name: {batch!r}")
    return f"{store}/{batch}"


def committed(spark: SparkSession, store: str, batch: str) -> bool:
    try:
        return not spark.read.schema("batch string").parquet(f"{_folder(store, batch)}/mark").isEmpty()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return False


def commit(spark: SparkSession, store: str, batch: str, signed: DataFrame) -> bool:
    """Writes the sums of a batch unless it is committed already; True if it was written now.

    Rows are summed on the map side first, so a source with a third of all rows costs a task no
    more than any other. Null keys are keys of their own. An empty batch is committed as such.
    """
    if committed(spark, store, batch):
        return False
    path = _folder(store, batch)
    sums = signed.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    sums.write.mode("overwrite").parquet(f"{path}/sums")
    spark.createDataFrame([(batch,)], "batch string").coalesce(1).write.mode("overwrite").parquet(f"{path}/mark")
    return True


def totals(spark: SparkSession, store: str, batches: list[str]) -> DataFrame:
    """(source, lang, tokenizer, n_docs, n_tokens) over the committed batches of the list; keys whose sums are all 0 are gone."""
    paths = [f"{_folder(store, b)}/sums" for b in dict.fromkeys(batches) if committed(spark, store, b)]
    rows = spark.read.schema(SUMS).parquet(*paths) if paths else spark.createDataFrame([], SUMS)
    summed = rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    return summed.where("n_docs <> 0 or n_tokens <> 0")
