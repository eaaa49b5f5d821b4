"""Line deduplication by content-defined chunks of lines.

Lines that occur once cannot be part of a repeated passage; what is left of a document are runs of
repeated lines. A run is cut where the global frequency of neighbouring lines jumps, and where a
rolling hash over two line hashes has a local minimum; both depend on the neighbouring lines alone,
so an insertion elsewhere moves no boundary. Chunks are matched by hash, then by their bytes, and
all but the first occurrence in the corpus are removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.llm.common import SPACES, kept_table, n_words

#: A chunk of one line is a passage of its own from so many words on.
PASSAGE_WORDS = 50
#: Neighbouring lines whose numbers of occurrences differ by this factor belong to different passages.
JUMP = 2


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc"), F.xxhash64(text).alias("mark"), text.alias("text"))


def _chunks(keyed: DataFrame) -> DataFrame:
    """(doc, mark, start, n, chunk) of the runs of repeated lines; hashes only, no texts."""
    hashed = F.transform(F.split("text", "\n"), lambda x: F.xxhash64(x))
    lines = kept_table(keyed.where("text is not null").select("doc", "mark", F.posexplode(hashed).alias("at", "line")), "lines")
    repeated = kept_table(lines.groupBy("line").agg(F.count("*").alias("times")).where("times > 1"), "repeated")
    runs = lines.join(repeated, "line").groupBy("doc", "mark").agg(F.array_sort(F.collect_set(F.struct("at", "line", "times"))).alias("run"))
    before = lambda i: F.get("run", i - 1)

    def is_edge(x, i):
        jump = F.greatest(x["times"], before(i)["times"]) >= JUMP * F.least(x["times"], before(i)["times"])
        return F.coalesce((x["at"] != before(i)["at"] + 1) | jump, F.lit(True))

    runs = runs.withColumn("edge", F.transform("run", is_edge))
    runs = runs.withColumn("rolled", F.transform("run", lambda x, i: F.when(~F.get("edge", i), F.xxhash64(before(i)["line"], x["line"]))))
    lowest = lambda i: F.coalesce((F.get("rolled", i) < F.get("rolled", i - 1)) & (F.get("rolled", i) < F.get("rolled", i + 1)), F.lit(False))
    places = F.sequence(F.lit(0), F.size("run") - 1)
    runs = runs.withColumn("starts", F.filter(places, lambda i: F.get("edge", i) | lowest(i)))

    def chunk(i, k):
        n = F.coalesce(F.get("starts", k + 1), F.size("run")) - i
        whole = F.aggregate(F.slice("run", i + 1, n), F.lit(0).cast("long"), lambda a, x: F.xxhash64(a, x["line"]))
        return F.struct(F.get("run", i)["at"].alias("start"), n.alias("n"), whole.alias("chunk"))

    return runs.select("doc", "mark", F.inline(F.transform("starts", chunk)))


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """(doc, mark, start, n): the line ranges that repeat an earlier passage byte for byte.

    Earlier means a smaller doc_id, then a smaller line number. A chunk counts as a passage if it
    has two lines with words, or PASSAGE_WORDS words. Rows that repeat doc_id and text are one
    document here, and keep or lose the same lines.
    """
    keyed = _keyed(docs)
    chunks = kept_table(_chunks(keyed), "chunks")
    again = chunks.groupBy("chunk").agg(F.count("*").alias("times")).where("times > 1").select("chunk")
    found = chunks.join(again, "chunk").groupBy("doc", "mark").agg(F.collect_list(F.struct("start", "n", "chunk")).alias("found"))
    texts = keyed.where("text is not null").hint("merge").join(found, ["doc", "mark"])  # never broadcast: what is found grows with the input
    pieces = texts.select("doc", "mark", F.split("text", "\n").alias("lines"), F.explode("found").alias("f"))
    piece = F.slice("lines", F.col("f.start") + 1, F.col("f.n"))
    pieces = kept_table(pieces.select("doc", "mark", "f.*", F.array_join(piece, "\n").alias("piece"), F.size(F.filter(piece, lambda x: F.btrim(x, F.lit(SPACES)) != "")).alias("filled"))
                        .where((F.col("filled") >= 2) | (n_words(F.col("piece")) >= PASSAGE_WORDS)).drop("filled"), "pieces")
    first = pieces.groupBy("chunk", "piece").agg(F.min(F.struct("doc", "mark", "start")).alias("first"))
    same = pieces.join(first.withColumnRenamed("piece", "other").withColumnRenamed("chunk", "of"), (F.col("chunk") == F.col("of")) & (F.col("piece") == F.col("other")))
    return same.where(F.struct("doc", "mark", "start") != F.col("first")).select("doc", "mark", "start", "n").distinct()


def without_repeats(docs: DataFrame) -> DataFrame:
    """All rows and columns of `docs`, the text without its repeated passages, and `removed_lines`.

    A null text stays null, a text without repeats stays as it is, and a text of which no line is
    left becomes empty. An empty table gives an empty result.
    """
    ranges = kept_table(repeated_chunks(docs).groupBy("doc", "mark").agg(F.collect_list(F.struct("start", "n")).alias("ranges")), "ranges")
    text = F.col("row.text").cast("string")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).select(
        "row", F.coalesce(F.col("row.doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc"), F.xxhash64(text).alias("mark"))
    rows = rows.hint("merge").join(ranges, ["doc", "mark"], "left")
    kept = F.filter(F.split(text, "\n"), lambda _, i: ~F.exists("ranges", lambda r: (i >= r["start"]) & (i < r["start"] + r["n"])))
    return rows.select(
        *[F.when(F.col("ranges").isNull(), F.col("row.text")).otherwise(F.array_join(kept, "\n")).alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns],
        F.coalesce(F.aggregate("ranges", F.lit(0), lambda a, r: a + r["n"]), F.lit(0)).cast("long").alias("removed_lines"))
