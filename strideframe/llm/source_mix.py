"""Mixing sources to target weights by apportioning equal-token blocks.

Every source's documents are dealt into shards, each shard is a seeded order of documents cut into
blocks of nearly `block` words. The highest quotients v / 1, v / 3, v / 5, ... give integer numbers
of blocks, first to sources by their targets and then to the shards of a source by their words. A
shard takes each of its blocks quota div n times, and the remainder by a seeded permutation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strideframe.llm.common import kept_table, n_words

WEIGHTS = (5, 2, 1)
MOST_TIMES = 3
BLOCK = 16
SHARD_WORDS = 1 << 18
#: Shards of a source at most; a shard then holds more words, of which only ids and sizes are sorted.
MOST_SHARDS = 1 << 16
#: Quotients this close to each other count as equal.
TIE = 1e-12
#: Primes above any number of blocks in a shard, multipliers of the seeded permutations.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579, 2147483563, 2147483549, 2147483543, 2147483497)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most_times: int = MOST_TIMES) -> DataFrame:
    """(source, place, source_size, target): the words that each source should give.

    Sources in code-point order, null last, weigh `weights` in turn and share the sum of all
    sizes. A target stops at `most_times` its source's size; the excess is shared by weight among
    the others, so that all targets are weight * level or their limit. Runs over one row a source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("place", F.row_number().over(by_name) - 1)
    turn = F.array(*[F.lit(float(w)) for w in weights])
    sources = sources.withColumn("weight", F.get(turn, F.col("place") % len(weights))).withColumn("limit", F.col("source_size") * float(most_times))
    by_limit = Window.orderBy(F.col("limit") / F.col("weight"), "place")
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = ((F.sum("source_size").over(whole) - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
             / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    sources = sources.withColumn("own_level", level)
    reached = F.when(F.col("own_level") * F.col("weight") <= F.col("limit"), F.col("own_level"))
    sources = sources.withColumn("level", F.max(reached).over(whole))
    return sources.select("source", "place", "source_size", F.least(F.col("limit"), F.coalesce(F.col("level") * F.col("weight"), F.col("limit"))).alias("target"))


def apportioned(frame: DataFrame, group: list[str], item: str, votes: str, seats: str) -> DataFrame:
    """Adds `quota`: the seats of each item of a group by the highest quotients votes / (2k + 1).

    The smallest divisor d with at least `seats` roundings of votes / d up is found by halving;
    items on the edge share what is left in the order of `item`, so ties are settled alike in
    every run. No votes or no seats give no quota. A group must fit in a row (one number an item).
    """
    listed = frame.groupBy(*group).agg(F.collect_list(F.col(votes).cast("double")).alias("all_votes"), F.first(seats).alias("n_seats"))
    total = F.aggregate("all_votes", F.lit(0.0), lambda a, x: a + x)
    given = lambda d, all_votes: F.aggregate(all_votes, F.lit(0.0), lambda a, v: a + F.floor(v / d + 0.5))

    def halved(edge: Column, _: Column) -> Column:
        middle = (edge["low"] + edge["high"]) / 2
        enough = given(middle, F.col("all_votes")) >= F.col("n_seats")
        return F.struct(F.when(enough, middle).otherwise(edge["low"]).alias("low"), F.when(enough, edge["high"]).otherwise(middle).alias("high"))

    first = F.struct((F.col("total") / (F.col("n_seats") + F.size("all_votes") + 1)).alias("low"), (F.col("total") * 4 + 1).alias("high"))
    edges = (listed.withColumn("total", total)
             .withColumn("edge", F.when((F.col("total") > 0) & (F.col("n_seats") > 0), F.aggregate(F.sequence(F.lit(1), F.lit(90)), first, halved)))
             .withColumn("edge", F.struct((F.col("edge.low") * (1 - TIE)).alias("low"), (F.col("edge.high") * (1 + TIE)).alias("high")))
             .withColumn("left_over", F.col("n_seats") - given(F.col("edge.high"), F.col("all_votes"))).select(*group, "edge", "left_over"))
    sure, most = F.floor(F.col(votes) / F.col("edge.high") + 0.5), F.floor(F.col(votes) / F.col("edge.low") + 0.5)
    with_edges = frame.join(edges, group).withColumn("sure", sure).withColumn("on_edge", most > sure)
    turn = F.row_number().over(Window.partitionBy(*group, "on_edge").orderBy(item))
    quota = F.col("sure") + F.when(F.col("on_edge") & (turn <= F.col("left_over")), 1).otherwise(0)
    return with_edges.withColumn("quota", F.coalesce(quota, F.lit(0)).cast("long")).drop("edge", "left_over", "sure", "on_edge")


def block_plan(sizes: DataFrame, seed: int = 7, block: int = BLOCK) -> DataFrame:
    """`sizes` (doc_id, source, size, ...) with the place of each row in its shard and the shard's quota."""
    sources = source_targets(sizes)
    sources = sources.withColumn("seats", F.round(F.sum("source_size").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) / block))
    sources = kept_table(apportioned(sources.withColumn("all", F.least("place", F.lit(0))), ["all"], "place", "target", "seats").drop("all", "seats").withColumnRenamed("quota", "source_quota"), "sources")
    shard_words = F.greatest(F.lit(SHARD_WORDS), F.ceil(F.col("source_size") / MOST_SHARDS))
    placed = (sizes.join(sources.withColumnRenamed("source", "of_source"), F.col("source").eqNullSafe(F.col("of_source"))).drop("of_source")
              .withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words))).cast("int")))
    shards = placed.groupBy("place", "shard").agg(F.sum("size").alias("shard_size"), F.first("source_quota").alias("source_quota"))
    shards = apportioned(shards, ["place"], "shard", "shard_size", "source_quota").drop("source_quota")
    n_blocks = F.when(F.col("shard_size") > 0, F.greatest(F.lit(1), F.round(F.col("shard_size") / block))).otherwise(0).cast("long")
    shards = (shards.withColumn("n_blocks", n_blocks).withColumn("quota", F.least("quota", F.col("n_blocks") * MOST_TIMES))
              .withColumn("turn", F.get(F.array(*[F.lit(p) for p in PRIMES]), F.pmod(F.xxhash64(F.lit(seed), "place", "shard", F.lit("turn")), F.lit(len(PRIMES))).cast("int")).cast("long"))
              .withColumn("shift", F.coalesce(F.pmod(F.xxhash64(F.lit(seed), "place", "shard"), F.when(F.col("n_blocks") > 0, F.col("n_blocks"))), F.lit(0))))
    order = Window.partitionBy("place", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    return (placed.drop("source_quota").join(kept_table(shards, "shards"), ["place", "shard"])
            .withColumn("begin", F.coalesce(F.sum("size").over(order), F.lit(0))))


def _times(block: Column) -> Column:
    n, quota = F.col("n_blocks"), F.col("quota")
    return F.floor(quota / n).cast("long") + F.when((block * F.col("turn") + F.col("shift")) % n < quota % n, 1).otherwise(0)


def _block_of(word: Column) -> Column:
    return F.expr("0L") + F.floor(((word + 1) * F.col("n_blocks") - 1) / F.col("shard_size")).cast("long")


def _edge(block: Column) -> Column:
    return F.floor(block * F.col("shard_size") / F.col("n_blocks")).cast("long")


def words_taken(plan: DataFrame) -> DataFrame:
    """`plan` with `taken`: words of the row that the mix takes, repeats counted."""
    end = F.col("begin") + F.col("size")
    blocks = F.sequence(_block_of(F.col("begin")), _block_of(end - 1))
    overlap = lambda j: F.least(end, _edge(j + 1)) - F.greatest(F.col("begin"), _edge(j))
    taken = F.aggregate(blocks, F.lit(0).cast("long"), lambda a, j: a + _times(j) * overlap(j))
    return plan.withColumn("taken", F.when((F.col("size") > 0) & (F.col("quota") > 0), taken).otherwise(0).cast("long"))


def mix_sources(docs: DataFrame, seed: int = 7, block: int = BLOCK) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row.

    Null and blank texts have size 0 and are never taken; a null source is a source of its own,
    the last; rows that repeat a doc_id are rows like any other; an empty table gives an empty
    result. Equal input and seed give equal results. No row is taken more than three times.
    """
    sizes = kept_table(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text").cast("string")).alias("size")), "sizes")
    return words_taken(block_plan(sizes, seed, block)).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, seed: int = 7, block: int = BLOCK) -> DataFrame:
    """The documents of the mix, with the columns of `docs`.

    A row comes once for each pass over its blocks, with the words that the pass takes and their
    own white space; a text that is taken whole stays as it is. Rows without words are not part of
    a mix of words and go.
    """
    keys = {"key_id": F.col("doc_id").cast("long"), "key_source": F.col("source").cast("string"), "key_text": F.xxhash64(F.col("text").cast("string"))}
    twin = Window.partitionBy("key_id", "key_source", "key_text").orderBy(F.lit(0))
    sizes = kept_table(docs.select(keys["key_id"].alias("doc_id"), keys["key_source"].alias("source"), keys["key_text"].alias("key_text"), n_words(F.col("text").cast("string")).alias("size")), "sizes")
    plan = words_taken(block_plan(sizes, seed, block)).where("taken > 0")
    plan = plan.select(F.col("doc_id").alias("key_id"), F.col("source").alias("key_source"), "key_text", "begin", "size", "n_blocks", "quota", "turn", "shift", "shard_size", "taken")
    plan = kept_table(plan.withColumn("twin", F.row_number().over(Window.partitionBy("key_id", "key_source", "key_text").orderBy("begin"))), "plan")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[v.alias(k) for k, v in keys.items()]).withColumn("twin", F.row_number().over(twin))
    plan = plan.select(*[F.col(c).alias(f"p_{c}") if c.startswith("key") or c == "twin" else F.col(c) for c in plan.columns])
    same = F.col("key_text") == F.col("p_key_text")
    for c in ("key_id", "key_source"):
        same = same & F.col(c).eqNullSafe(F.col(f"p_{c}"))
    taken = rows.join(plan, same & (F.col("twin") == F.col("p_twin")))
    pieces = F.regexp_extract_all(F.col("row.text"), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    blocks = F.sequence(_block_of(F.col("begin")), _block_of(F.col("begin") + F.col("size") - 1))
    taken = (taken.withColumn("least", F.array_min(F.transform(blocks, _times))).withColumn("most", F.array_max(F.transform(blocks, _times)))
             .withColumn("round", F.explode(F.sequence(F.lit(1).cast("long"), F.col("most")))))
    part = F.btrim(F.array_join(F.filter(pieces, lambda _, i: _times(_block_of(F.col("begin") + i)) >= F.col("round")), ""), F.lit(" \t\n\x0b\x0c\r"))
    text = F.when(F.col("round") <= F.col("least"), F.col("row.text")).otherwise(part)
    return taken.select(*[text.alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])
