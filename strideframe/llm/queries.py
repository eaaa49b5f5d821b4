"""Registered queries of the corpus operators and the SQL that checks them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe.llm import (
    decision_list, fingerprints, jaccard_join, language_id, line_chunks, merkle_manifest, periodic_runs, pii_bootstrap, piece_table,
    repeat_removal, source_mix, token_rollup, url_aliases)
from strideframe.llm.common import documents, kept_table, low_ascii, n_words, shared_folder

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def learned_languages(docs: DataFrame) -> dict[str, bytes]:
    """Dictionaries from the two thirds of labelled documents that are not held out."""
    return language_id.dictionaries(docs.where(~held_out()))


def held_out():
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    found = language_id.with_language(docs.select("doc_id", "text"), learned_languages(docs))
    return found.select("doc_id", held_out().alias("held_out"), F.col("guess.lang").alias("lang_pred"), F.col("guess.score").alias("score"), F.col("guess.rejected").alias("rejected"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix_sources(documents(spark, sf_dir))


def op3_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_chunks.without_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", "removed_lines", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op4_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return decision_list.judged(documents(spark, sf_dir), labels, lambda frame: kept_table(frame, "stats"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_classes(documents(spark, sf_dir))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(documents(spark, sf_dir))


#: Rules of the contract, host, path and decision.
URL_RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def op7_url_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "rule_host string, rule_path string, decision string")
    return url_aliases.judged_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


def op8_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four batches over all documents: load, recount of a third under another rule, delete of a seventh, second version.

    The load and the recount are committed twice, which must change nothing.
    """
    text = F.col("text").cast("string")
    signs = F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[.,;:!?]"), F.lit(0))).cast("long")
    docs = kept_table(documents(spark, sf_dir).select("doc_id", "source", "lang", n_words(text).alias("n_words"), signs.alias("signs")), "counts")
    words = docs.select("doc_id", "source", "lang", F.lit("words-1").alias("tokenizer"), F.col("n_words").alias("n_tokens"), "signs")
    split = words.withColumns({"tokenizer": F.lit("words-2"), "n_tokens": F.col("n_tokens") + F.col("signs")})
    recount = words.where("doc_id % 3 = 0").withColumns({"old_tokens": F.col("n_tokens"), "n_tokens": F.col("n_tokens") + F.col("signs")})
    now = recount.unionByName(words.where("doc_id % 3 <> 0 or doc_id is null"), allowMissingColumns=True)
    store = f"{shared_folder(spark)}/rollup-{uuid.uuid4().hex}"
    for batch, signed in (("load", token_rollup.inserted(words)), ("recount", token_rollup.revised(recount)), ("load", token_rollup.inserted(words)),
                          ("delete", token_rollup.deleted(now.where("doc_id % 7 = 0"))), ("recount", token_rollup.revised(recount)), ("second", token_rollup.inserted(split))):
        token_rollup.commit(spark, store, batch, signed)
    return token_rollup.totals(spark, store, ["load", "recount", "delete", "second", "never"])


OP8_SQL = """
with c as (
    select doc_id, source, lang, case when length(b) = 0 then 0 else len(regexp_split_to_array(b, '[ \\t\\n\\v\\f\\r]+')) end as w,
           len(regexp_extract_all(coalesce(text, ''), '[.,;:!?]')) as s
    from (select *, trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as b from documents)),
r as (
    select source, lang, 'words-1' as tokenizer, 1 as d, w + case when doc_id % 3 = 0 then s else 0 end as n
    from c where doc_id is null or doc_id % 7 <> 0
    union all select source, lang, 'words-2', 1, w + s from c)
select source, lang, tokenizer, sum(d)::bigint as n_docs, sum(n)::bigint as n_tokens from r group by all"""


def op9_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_bootstrap.personal_data(documents(spark, sf_dir))


def op10_piece_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_table.encoded(documents(spark, sf_dir), PIECE_MODEL)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of words of every document, after the contract's rewrite of the rows that crc32 picks."""
    found = periodic_runs.periodic_runs(documents(spark, sf_dir).select("doc_id", "text"), rewrite=True)
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "n_words")


def op12_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every byte of `documents` texts covered by a 100-byte string that stands earlier goes."""
    out = repeat_removal.without_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of `documents` by lang; rows whose crc32(doc_id) 3 divides are checked with text's A-Z lower-cased."""
    docs = documents(spark, sf_dir)
    touched = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 0
    text = F.when(touched, low_ascii(F.col("text"))).otherwise(F.col("text"))
    tampered = merkle_manifest.leaf_digest([F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text])
    built = merkle_manifest.manifest(docs, carry=["doc_id"], recheck=tampered)
    return built.select(F.col("row.doc_id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256",
                        F.col("refolded").alias("folded_root"), (F.col("refolded") == F.col("root")).alias("verified"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_source_mix": op2_source_mix,
    "op3_line_chunks": op3_line_chunks,
    "op4_decision_list": op4_decision_list,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_fingerprints": op6_fingerprints,
    "op7_url_aliases": op7_url_aliases,
    "op8_token_rollup": op8_token_rollup,
    "op9_pii_bootstrap": op9_pii_bootstrap,
    "op10_piece_table": op10_piece_table,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_repeat_removal": op12_repeat_removal,
    "op13_merkle_manifest": op13_merkle_manifest,
}
SQL: dict[str, str] = {"op8_token_rollup": OP8_SQL}
