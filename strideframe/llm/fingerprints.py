"""Document fingerprints: one-permutation MinHash with optimal densification and few bits a bin.

Every shingle is hashed once; the top byte names its bin and a bin keeps its least hash. An empty
bin takes the value of a non-empty one found by a universal hash of bin and attempt, so two texts
with the same empty bins borrow alike. Of each value the low BITS are stored as one hex digit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strideframe.llm.common import WORDS_A_SHINGLE, kept_table, words

BINS = 256
BITS = 4
#: Probes before the rest of the search order is looked at as a whole.
PROBES = 8
IDS_A_PART = 500_000


def with_fingerprint(frame: DataFrame, text: str, into: str, width: int = WORDS_A_SHINGLE) -> DataFrame:
    """`frame` with a string column `into`: BINS hex digits, or an empty string for a text without words.

    Shingles are of `width` words in lower case; a shorter text is one shingle. Equal texts have
    equal fingerprints.
    """
    a = f"{into}_a"
    frame = frame.withColumn(a, F.transform(words(F.lower(F.col(text))), lambda w: F.xxhash64(w)))
    whole = F.array(F.aggregate(a, F.lit(0).cast("long"), lambda s, x: F.xxhash64(s, x)))
    windows = F.transform(F.sequence(F.lit(0), F.size(a) - width), lambda i: F.xxhash64(*[F.get(a, i + k) for k in range(width)]))
    hashes = F.when(F.size(a) >= width, windows).when(F.size(a) > 0, whole).otherwise(F.array().cast("array<long>"))
    frame = frame.withColumn(a, F.sort_array(hashes))
    place = lambda x: F.shiftright(x, 56).cast("int") + 128
    frame = frame.withColumn(a, F.filter(a, lambda x, i: (i == 0) | (place(x) != place(F.get(a, i - 1)))))
    nothing = F.lit(None).cast("long")
    gap = lambda x, i: place(x) - F.when(i == 0, -1).otherwise(place(F.get(a, i - 1))) - 1
    filled = F.flatten(F.transform(a, lambda x, i: F.concat(F.array_repeat(nothing, gap(x, i)), F.array(x))))
    frame = frame.withColumn(f"{into}_b", F.concat(filled, F.array_repeat(nothing, BINS - 1 - F.coalesce(place(F.get(a, F.size(a) - 1)), F.lit(-1)))))
    b = f"{into}_b"

    def borrowed(x: Column, j: Column) -> Column:
        tries = [F.get(b, F.pmod(F.xxhash64(j, F.lit(k)), F.lit(BINS)).cast("int")) for k in range(PROBES)]
        rest = F.array_min(F.transform(a, lambda v: F.struct(F.xxhash64(j, place(v)).alias("order"), v.alias("value"))))["value"]
        return F.coalesce(x, *tries, rest)

    digits = F.transform(b, lambda x, j: F.hex(borrowed(x, j).bitwiseAND(F.lit((1 << BITS) - 1))))
    packed = F.when(F.size(a) == 0, F.lit("")).otherwise(F.lower(F.array_join(digits, "")))
    return frame.withColumn(into, packed).drop(a, b)


def likeness(one: Column, other: Column) -> Column:
    """Estimated Jaccard similarity, 0 to 1: the share of equal digits, less what chance makes equal.

    Two texts without words are alike (1); one without words is unlike any other (0).
    """
    equal = F.aggregate(F.zip_with(F.split(one, ""), F.split(other, ""), lambda x, y: (x == y).cast("int")), F.lit(0), lambda a, x: a + x)
    chance = 1 / (1 << BITS)
    estimate = F.greatest(F.lit(0.0), (equal / BINS - chance) / (1 - chance))
    return F.when(one == other, 1.0).when((one == "") | (other == ""), 0.0).otherwise(estimate)


def following(ids: DataFrame) -> DataFrame:
    """(doc_id, next_id): the next smaller id, and after the smallest the largest.

    Ids are dealt into ranges of even size that are written down, so that numbers of parts stay as
    they are; only the largest id of each range crosses to its neighbour.
    """
    ids = ids.select("doc_id").distinct()
    parts = max(64, ids.count() // IDS_A_PART)
    dealt = kept_table(ids.repartitionByRange(parts, "doc_id").withColumn("part", F.spark_partition_id()), "ids")
    edges = dealt.groupBy("part").agg(F.max("doc_id").alias("largest"))
    every = Window.orderBy("part")
    edges = edges.select("part", F.coalesce(F.lag("largest").over(every), F.max("largest").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("beyond"))
    smaller = F.lag("doc_id").over(Window.partitionBy("part").orderBy("doc_id"))
    return dealt.withColumn("next_id", smaller).join(edges, "part").select("doc_id", F.coalesce("next_id", "beyond").alias("next_id"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    The edited text has the last half of its code points (rounded down) replaced by as many from
    the start of the next document. A null text counts as empty. Rows that repeat a doc_id give a
    row each, and stand as "next document" with the least of their texts; a lone document is its
    own next. Rows with a null doc_id have no place in the order and are left out.
    """
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    marks = kept_table(with_fingerprint(texts, "text", "fingerprint").select("doc_id", F.xxhash64("text").alias("mark"), F.length("text").cast("long").alias("n_chars"), "fingerprint"), "marks")
    repeated = not marks.groupBy("doc_id").count().where("count > 1").isEmpty()
    links = following(marks)
    halves = marks.groupBy("doc_id").agg(F.floor(F.max("n_chars") / 2).cast("int").alias("half"))
    wanted = kept_table(links.join(halves, "doc_id").select(F.col("doc_id").alias("for_id"), F.col("next_id").alias("doc_id"), "half"), "wanted")
    givers = texts.groupBy("doc_id").agg(F.min("text").alias("text")) if repeated else texts
    heads = givers.join(wanted, "doc_id").select(F.col("for_id").alias("doc_id"), F.left("text", F.col("half")).alias("head"), F.xxhash64("text").alias("next_mark"), F.col("doc_id").alias("next_id"))
    rows = texts.join(heads, "doc_id")
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    rows = rows.select("doc_id", F.xxhash64("text").alias("mark"), "next_id", "next_mark", F.concat(F.left("text", n - half), F.left("head", half)).alias("edited"))
    rows = with_fingerprint(rows, "edited", "edited_fingerprint").select("doc_id", "mark", "next_id", "next_mark", "edited_fingerprint", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    own = marks.dropDuplicates(["doc_id", "mark"])
    after = own.select(F.col("doc_id").alias("next_id"), F.col("mark").alias("next_mark"), F.col("fingerprint").alias("next_fingerprint"))
    rows = rows.join(own, ["doc_id", "mark"]).join(after, ["next_id", "next_mark"])
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                       likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
