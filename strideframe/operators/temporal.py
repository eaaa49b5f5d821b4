"""As-of, interval and nearest-match joins without pairwise comparison.

The ordered joins rest on `carry`: rows of both sides are put in one sequence per key and a
value is carried along it. A key may hold a large share of all rows, so a sequence is cut
into chunks of its order column. Within a chunk a window carries the value; across chunks
only one summary row per chunk is carried. No task has to sort a whole key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def _named(columns: Sequence[str]) -> list[Column]:
    return [F.col(f"`{c}`") for c in columns]


def carry(df: DataFrame, keys: Sequence[str], order: str, value: str,
          below: str | None = None, above: str | None = None,
          chunk: Column | None = None) -> DataFrame:
    """Add, as `below`, the non-null `value` nearest at or before each row in the order of its
    key and, as `above`, the nearest at or after it.

    Rows must be unique per (keys, order). `chunk` must rise with `order`. Without it a key
    is one window partition, which is right only where the calendar bounds the rows of a
    key, as with dates.
    """
    wanted = [(name, up) for name, up in ((below, True), (above, False)) if name]

    def walk(by: Sequence[str], column: str, up: bool, last: int):
        ordered = F.col(column).asc() if up else F.col(column).desc()
        return (Window.partitionBy(*by).orderBy(ordered)
                .rowsBetween(Window.unboundedPreceding, last))

    def carried(column: str, spec) -> Column:
        return F.last(column, ignorenulls=True).over(spec)

    if chunk is None:
        return df.withColumns({n: carried(value, walk(keys, order, up, 0)) for n, up in wanted})

    cut = df.withColumn("_chunk", chunk)
    local = cut.withColumns({
        f"_local_{n}": carried(value, walk([*keys, "_chunk"], order, up, 0)) for n, up in wanted})
    present = F.when(F.col(value).isNotNull(), F.col(order))
    edges = cut.groupBy(*keys, "_chunk").agg(*[
        (F.max_by if up else F.min_by)(value, present).alias(f"_edge_{n}") for n, up in wanted])
    summary = edges.select(*keys, "_chunk", *[
        carried(f"_edge_{n}", walk(keys, "_chunk", up, -1)).alias(f"_far_{n}")
        for n, up in wanted])
    return local.join(summary, [*keys, "_chunk"]).select(*_named(df.columns), *[
        F.coalesce(f"_local_{n}", f"_far_{n}").alias(n) for n, up in wanted])


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str,
              right_time: str, payload: Sequence[str], matched: str = "matched_time",
              tie_break: Sequence[str] = (), direction: str = "backward",
              chunk=None) -> DataFrame:
    """Left join to the latest right row at or before each left time (or, forward, the
    earliest at or after it). An equal time matches.

    The matched row is kept as it is, with NULL payload fields; the join never looks further
    for a non-null one. Among right rows of one time the last by `tie_break`, then by
    payload, is used. `chunk` maps the time column to a coarser value, for instance
    `lambda t: F.to_date(t)` on timestamps.

    Both sides are reduced to distinct (keys, time) before they are ordered, so repeated
    times cost nothing. Left rows get their match back by an equi-join on (keys, time) in
    which the right side is unique.
    """
    keys, payload = list(keys), list(payload)
    rank = [c.alias(f"r{i}") for i, c in enumerate(_named([*tie_break, *payload]))]
    picked = F.max_by(F.struct(F.col(right_time).alias("_at"), *_named(payload)), F.struct(*rank))
    stops = (right.where(F.col(right_time).isNotNull())
             .groupBy(*keys, F.col(right_time).alias("_t")).agg(picked.alias("_hit")))
    probes = (left.where(F.col(left_time).isNotNull())
              .select(*keys, F.col(left_time).alias("_t")).distinct()
              .withColumn("_probe", F.lit(True)))
    points = (
        stops.withColumn("_probe", F.lit(False))
        .unionByName(probes, allowMissingColumns=True)
        .groupBy(*keys, "_t")
        .agg(F.max("_hit").alias("_hit"), F.max("_probe").alias("_probe")))
    side = {"below" if direction == "backward" else "above": "_found"}
    found = carry(points, keys, "_t", "_hit", chunk=chunk and chunk(F.col("_t")), **side)
    answers = found.where("_probe").select(*keys, "_t", "_found")
    hit = F.col("_found")
    return (
        left.withColumn("_t", F.col(left_time)).join(answers, [*keys, "_t"], "left")
        .select(*_named(left.columns), hit.getField("_at").alias(matched),
                *[hit.getField(c).alias(c) for c in payload]))


def block_days(blocks: DataFrame, keys: Sequence[str] = ("athlete_id",)) -> DataFrame:
    """Blocks unfolded to one row per day, so that an interval join becomes an equi-join.

    Rows per block are the days it lasts.
    """
    days = F.sequence("start_date", "end_date", F.expr("INTERVAL 1 DAY"))
    return (blocks.where(F.col("start_date") <= F.col("end_date"))
            .select(*keys, "block_name", "priority", F.explode(days).alias("date")))


def slice_blocks(days: DataFrame, blocks: DataFrame, keys: Sequence[str] = ("athlete_id",),
                 date_col: str = "date") -> DataFrame:
    """Every row once for each block whose inclusive date range holds it, with its name."""
    spans = block_days(blocks, keys).withColumnRenamed("date", date_col).drop("priority")
    return days.join(spans.distinct(), [*keys, date_col])


def label_intervals(df: DataFrame, blocks: DataFrame, keys: Sequence[str] = ("athlete_id",),
                    date_col: str = "date", out: str = "marathon_block",
                    default: str = "Outside marathon blocks") -> DataFrame:
    """Tag each row with the block that holds its date; of several, the highest priority
    (equal priorities: the greatest name).

    Overlaps are settled by a change-point sweep on the block side: the starts and the days
    after the ends of a key's blocks cut its calendar into segments, and each segment takes the
    highest open block. The open blocks of a segment are found through a segment tree over the
    numbered change points: a block marks the at most two nodes a level that its span of
    change points covers exactly, and a change point reads the nodes above it. So a block costs
    two events and O(log) marks, never a row a day, and no pairs of blocks are formed. Rows then
    find their segment by an as-of lookup on the date.
    """
    keys = list(keys)
    spans = blocks.where(F.col("start_date") <= F.col("end_date")).select(
        *keys, "start_date", F.date_add("end_date", 1).alias("_after"), F.struct("priority", "block_name").alias("_label"))
    cuts = (spans.select(*keys, F.col("start_date").alias("_c")).unionByName(spans.select(*keys, F.col("_after").alias("_c")))
            .distinct().withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy("_c")) - 1))
    levels = (cuts.agg(F.max("_i")).first()[0] or 0).bit_length() + 1
    first = cuts.select(*keys, F.col("_c").alias("start_date"), F.col("_i").alias("_a"))
    last = cuts.select(*keys, F.col("_c").alias("_after"), (F.col("_i") - 1).alias("_b"))
    ranged = spans.join(first, [*keys, "start_date"]).join(last, [*keys, "_after"])
    nodes = F.explode(F.array(*[
        F.struct(F.lit(j).alias("level"), k.alias("node"), F.shiftleft(k, j).alias("lo"), (F.shiftleft(k + 1, j) - 1).alias("hi"))
        for j in range(levels)
        for k in (F.shiftright(F.col("_a") + (1 << j) - 1, j), F.shiftright(F.col("_b") + 1, j) - 1)]))
    marks = (ranged.select(*keys, "_label", "_a", "_b", nodes.alias("_n"))
             .where((F.col("_n.lo") >= F.col("_a")) & (F.col("_n.hi") <= F.col("_b")))
             .groupBy(*keys, F.col("_n.level").alias("level"), F.col("_n.node").alias("node")).agg(F.max("_label").alias("_top")))
    above = F.explode(F.array(*[F.struct(F.lit(j).alias("level"), F.shiftright("_i", j).alias("node")) for j in range(levels)]))
    segments = (cuts.select(*keys, "_c", above.alias("_n")).select(*keys, "_c", "_n.level", "_n.node")
                .join(marks, [*keys, "level", "node"], "left").groupBy(*keys, "_c").agg(F.max("_top").alias("_top")))
    found = asof_join(df, segments, keys, date_col, "_c", ["_top"], matched="_segment")
    return found.select(*_named(df.columns), F.coalesce(F.col("_top.block_name"), F.lit(default)).alias(out))


def nearest_match(left: DataFrame, right: DataFrame, keys: Sequence[str], left_value: str,
                  right_value: str, prefer: Sequence[str], payload: Sequence[str],
                  chunk_width: float = 1.0) -> DataFrame:
    """Left join to the right row of the same keys whose value is nearest.

    Equal gaps go to the smallest `prefer` columns, in order, NULL last. A right row without
    a value is used only where its key has no other. Right rows of one value are first
    reduced to the preferred one; then the nearest is the nearer of the neighbour below and
    the neighbour above, each found by `carry`. No pairs are formed inside a key.
    """
    keys = list(keys)
    ranks = [x for c in prefer for x in (F.col(c).isNull(), F.col(c))]
    row = F.struct(*_named(payload))
    rank = F.struct(*[x.alias(f"r{i}") for i, x in enumerate(ranks)])
    per_value = (right.groupBy(*keys, F.col(right_value).cast("double").alias("_v"))
                 .agg(F.min(F.struct(rank.alias("rank"), F.col(right_value).cast("double").alias("at"),
                                     row.alias("row"))).alias("_hit")))
    stops = per_value.where(F.col("_v").isNotNull())
    without_value = (per_value.where(F.col("_v").isNull())
                     .select(*keys, F.col("_hit").alias("_fallback")))
    probes = (left.where(F.col(left_value).isNotNull())
              .select(*keys, F.col(left_value).cast("double").alias("_v")).distinct()
              .withColumn("_probe", F.lit(True)))
    points = (
        stops.withColumn("_probe", F.lit(False))
        .unionByName(probes, allowMissingColumns=True)
        .groupBy(*keys, "_v").agg(F.max("_hit").alias("_hit"), F.max("_probe").alias("_probe")))
    chunk = F.floor(F.col("_v") / F.lit(chunk_width))
    both = carry(points, keys, "_v", "_hit", below="_below", above="_above", chunk=chunk)

    def scored(name: str) -> Column:
        hit = F.col(name)
        return F.when(hit.isNotNull(), F.struct(
            F.abs(hit.getField("at") - F.col("_v")).alias("gap"),
            hit.getField("rank").alias("rank"), hit.getField("row").alias("row")))

    best = F.least(scored("_below"), scored("_above"))
    answers = both.where("_probe").select(*keys, "_v", best.getField("row").alias("_best"))
    found = F.coalesce(F.col("_best"), F.col("_fallback").getField("row"))
    return (
        left.withColumn("_v", F.col(left_value).cast("double"))
        .join(answers, [*keys, "_v"], "left")
        .join(without_value, keys, "left")
        .select(*_named(left.columns), *[found.getField(c).alias(c) for c in payload]))


def apply_overrides(df: DataFrame, overrides: DataFrame | None, on: Sequence[str],
                    column: str) -> DataFrame:
    """Replace `column` where the overrides table (unique on `on`) names a value."""
    if overrides is None:
        return df
    fixes = overrides.select(*on, F.col(column).alias("_fix"))
    return (df.join(fixes, list(on), "left")
            .select(*[F.coalesce("_fix", column).alias(c) if c == column else F.col(f"`{c}`")
                      for c in df.columns]))


def label_contains(left: DataFrame, right: DataFrame, keys: Sequence[str], word: str,
                   label: str) -> DataFrame:
    """Pairs of distinct words and distinct labels of one key where the label holds the word.

    Both sides meet on a short piece of text (the word's first three letters against every
    three-letter piece of the label), not on the key alone, and then the full word is
    checked. Both are compared in lower case.
    """
    words = (left.select(*keys, F.lower(word).alias("_word")).distinct()
             .where(F.length("_word") > 0)
             .withColumn("_piece", F.substring("_word", 1, 3)))
    labels = (right.select(*keys, F.col(label).alias("_label")).distinct()
              .where(F.length("_label") > 0))
    text = F.lower("_label")
    spots = F.sequence(F.lit(1), F.length("_label"))
    pieces = F.array_distinct(F.flatten(F.transform(
        spots, lambda i: F.array(*[F.substring(text, i, F.lit(n)) for n in (1, 2, 3)]))))
    return (labels.withColumn("_piece", F.explode(pieces))
            .join(words, [*keys, "_piece"])
            .where(F.contains(text, F.col("_word")))
            .select(*keys, "_word", "_label"))
