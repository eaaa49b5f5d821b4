"""Language identification by compression with a raw-content dictionary for each language."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strideframe.llm.common import kept_table

#: Bounds of the fitted sample: rows a language, bytes of text a row, bytes of dictionary a language.
SAMPLE_ROWS = 96
SAMPLE_TEXT = 8_192
DICTIONARY_BYTES = 98_304
#: Texts are compressed in pieces of so many bytes, so that the dictionary counts for all of a long text.
PIECE = 8_192
LEVEL = 6
#: A prediction is rejected if the next language needs less than this share of bytes more.
MARGIN = 0.002
UNKNOWN = "und"
#: ASCII characters other than letters say nothing of a language: controls become spaces, the rest goes.
CONTROLS = bytes.maketrans(bytes(range(32)), b" " * 32)
SIGNS = bytes(b for b in range(33, 128) if not chr(b).isalpha())


def letters_of(text: str) -> bytes:
    """The text in lower case without digits, ASCII punctuation and control characters."""
    return text.lower().encode("utf-8", "surrogatepass").translate(CONTROLS, SIGNS)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def dictionaries(labelled: DataFrame, salts: int = 64) -> dict[str, bytes]:
    """A dictionary of raw texts for each language of `labelled` (doc_id, text, lang).

    The sample is bounded: of each language, SAMPLE_ROWS texts of at most SAMPLE_TEXT characters in
    the order of a hash of the id, until DICTIONARY_BYTES are full. Rows whose language is null,
    or whose text is null or without letters, teach nothing; repeated rows teach once. Only ranks
    are shuffled, within salts first, so that no task gathers a whole language; then the texts of
    the chosen ranks are fetched by a join with that small written table.
    """
    fit = labelled.where(F.col("lang").isNotNull() & has_letter(F.col("text")) & (F.length("text") <= SAMPLE_TEXT))
    fit = fit.select("lang", F.xxhash64(F.col("doc_id").cast("string"), "text").alias("rank"), "text")
    least = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy("rank"))
    ranks = fit.select("lang", "rank", F.pmod("rank", F.lit(salts)).alias("salt"))
    ranks = ranks.withColumn("nth", least("lang", "salt")).where(F.col("nth") <= SAMPLE_ROWS).select("lang", "rank").distinct()
    chosen = kept_table(ranks.withColumn("nth", least("lang")).where(F.col("nth") <= SAMPLE_ROWS), "sample")
    fit = fit.join(chosen, ["lang", "rank"]).groupBy("lang", "nth").agg(F.min("text").alias("text"))
    out: dict[str, list[bytes]] = {}
    for row in fit.select("lang", "nth", "text").orderBy("lang", "nth").toLocalIterator():
        taken = out.setdefault(row["lang"], [])
        text = letters_of(row["text"])
        if sum(map(len, taken)) + len(text) <= DICTIONARY_BYTES:
            taken.append(text)
    return {lang: b"\n".join(taken) for lang, taken in out.items() if taken}


def _measure(learned: dict[str, bytes]):
    def run(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = sorted(learned)
        packers = []
        for name in names:
            content = zstandard.ZstdCompressionDict(learned[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=LEVEL)
            packers.append(zstandard.ZstdCompressor(dict_data=content, write_content_size=False, write_checksum=False, write_dict_id=False))
        for texts in series:
            best, margins, scores = [], [], []
            for text in texts:
                data = letters_of(text) if text is not None else b""
                pieces = [data[i:i + PIECE] for i in range(0, len(data), PIECE)]
                sizes = [sum(len(p.compress(piece)) for piece in pieces) for p in packers]
                least = min(sizes)
                first = sizes.index(least)
                other = min((s for k, s in enumerate(sizes) if k != first), default=least + max(1, len(data)))
                best.append(names[first])
                margins.append((other - least) / other if other else 0.0)
                scores.append(1 / sum(2.0 ** -min(1000, 8 * (s - least)) for s in sizes))
            yield pd.DataFrame({"lang": best, "margin": margins, "score": scores})
    return run


def with_language(docs: DataFrame, learned: dict[str, bytes], into: str = "guess") -> DataFrame:
    """`docs` with a struct column `into`: lang, score (0 to 1), margin and rejected.

    The language is the one whose dictionary makes the text smallest; equal sizes go to the first
    language by name. The score is the weight of the best language if every byte that another one
    needs more halves its weight eight times. Null texts, texts without a letter, and all texts if
    nothing was learned, are `und` with score 0 and rejected. Narrow margins are rejected too.
    """
    text = F.col("text").cast("string")
    unknown = F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"), F.lit(0.0).alias("margin"), F.lit(True).alias("rejected"))
    if not learned:
        return docs.withColumn(into, unknown)
    # not deterministic to Spark: else a filter on `into` below a projection of it measures every text twice, by two Python workers a task
    measured = F.pandas_udf(_measure(learned), "lang string, margin double, score double").asNondeterministic()
    rows = docs.withColumn(into, measured(text))
    found = F.struct(F.col(f"{into}.lang").alias("lang"), F.col(f"{into}.score").alias("score"), F.col(f"{into}.margin").alias("margin"), (F.col(f"{into}.margin") < MARGIN).alias("rejected"))
    return rows.withColumn(into, F.when(has_letter(text), found).otherwise(unknown))
