"""Merkle manifest of a table: leaves, one subtree a group, a root over the subtrees, proofs.

Every level of a tree is one grouped aggregate: the children of a parent are spread into `fanout`
slot columns by conditional aggregates (a pivot), the parent digest hashes the slot columns
concatenated, and the siblings of a child are the same columns without its own slot, to the left
and to the right of it. No window runs over a whole group and no group of the shuffle holds more
than `fanout` rows, whatever share of the table one group has.

Digests are lowercase hex SHA-256; a node's input is its children's hex digests concatenated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strideframe.llm.common import kept_table

#: The fields of a leaf and their order, and the children a parent takes.
LEAF_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 8
EMPTY_PATH = "array<struct<left:string,right:string>>"


def field_code(value: Column) -> Column:
    """`-` for null, else the UTF-8 byte count of the value as text, `:` and the text."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field_code(v) for v in values]), 256)


def numbered(frame: DataFrame, group: str, order: Sequence[Column]) -> DataFrame:
    """Adds `_pos`, the 0-based place of a row within its group by `order`, and `_size`.

    Rows are range-partitioned on (group, order, a row id), so one group spreads over many tasks;
    each task numbers its own rows, and the counts of (task, group), a table of at most tasks times
    groups rows, give every task its offset. Rows equal in group and order are numbered in the
    order of a row id; `group` may be null (a group of its own). The ranges are written once: made
    a second time for the counts, their bounds are sampled anew and adaptive execution merges them
    by other sizes, so places and offsets would not belong together.
    """
    keyed = frame.withColumn("_tie", F.monotonically_increasing_id())
    ranged = keyed.repartitionByRange(F.col(group).asc_nulls_first(), *order, F.col("_tie")).withColumn("_part", F.spark_partition_id())
    ranged = kept_table(ranged, "merkle-ranges")
    local = ranged.withColumn("_local", F.row_number().over(Window.partitionBy("_part", group).orderBy(*order, "_tie")) - 1)
    counts = ranged.groupBy("_part", F.col(group).alias("_g")).agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_part", "_g", (F.sum("_n").over(Window.partitionBy("_g").orderBy("_part")) - F.col("_n")).alias("_before"),
        F.sum("_n").over(Window.partitionBy("_g")).alias("_size"))
    joined = local.join(offsets, (local["_part"] == offsets["_part"]) & local[group].eqNullSafe(offsets["_g"]))
    return joined.select(*[local[c] for c in frame.columns], (F.col("_local") + F.col("_before")).cast("long").alias("_pos"), F.col("_size").cast("long").alias("_size"))


def _pivot(nodes: DataFrame, fanout: int, extra: Sequence[str] = ()) -> DataFrame:
    """One row a parent: (g, pos, size) and per slot k the child `c{k}` and its `extra` columns `{e}{k}`."""
    slot = F.col("pos") % fanout
    return nodes.groupBy("g", (F.col("pos") / fanout).cast("long").alias("pos"), "size").agg(
        *[F.max(F.when(slot == k, F.col("h"))).alias(f"c{k}") for k in range(fanout)],
        *[F.first(F.when(slot == k, F.col(e)), ignorenulls=True).alias(f"{e}{k}") for e in extra for k in range(fanout)])


def _slots(fanout: int, extra: Sequence[str] = ()) -> Column:
    """The pivot read back per slot: the child, what stands left and right of it, its extra columns."""
    c = [F.col(f"c{k}") for k in range(fanout)]
    return F.array(*[F.struct(F.lit(k).alias("slot"), c[k].alias("h"), F.concat_ws("", *c[:k]).alias("left"),
                              F.concat_ws("", *c[k + 1:]).alias("right"), *[F.col(f"{e}{k}").alias(e) for e in extra])
                     for k in range(fanout)])


def _digest(fanout: int) -> Column:
    return F.sha2(F.concat_ws("", *[F.col(f"c{k}") for k in range(fanout)]), 256)


def build(nodes: DataFrame, fanout: int = FANOUT, extra: Sequence[str] = ()) -> tuple[DataFrame, list[DataFrame]]:
    """Trees over `nodes` (g, pos, h, size, extra...): one per g over its nodes at pos 0..size-1.

    Returns the tops (g, top) and the pivot table of every level, bottom first, each written to
    the shared folder. Level 0 keeps the `extra` columns of its children. A group of one node is
    its own top; a last run of fewer than `fanout` nodes, even one, still makes a parent.
    """
    largest = nodes.agg(F.max("size")).first()[0] or 0
    tops, pivots = [], []
    current, span = nodes, 1
    while True:
        tops.append(current.where(F.col("size") <= span).select("g", F.col("h").alias("top")))
        if span >= largest:
            break
        pivot = kept_table(_pivot(current.where(F.col("size") > span), fanout, extra if not pivots else ()), "merkle-level")
        pivots.append(pivot)
        current = pivot.select("g", "pos", _digest(fanout).alias("h"), "size")
        span *= fanout
    top = tops[0]
    for more in tops[1:]:
        top = top.unionByName(more)
    return top, pivots


def upper_paths(pivots: list[DataFrame], tops_path: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """For the parent of every pivot row, its sibling path up to the top and on by `tops_path`.

    `tops_path` gives (g, upper) for each tree's top. Built top-down: a parent's path is its own
    siblings in the pivot above, then that pivot's path; one row a parent, so a leaf's path is
    never stored or moved. Returns (g, pos, upper) tables matching `pivots`.
    """
    out: list[DataFrame | None] = [None] * len(pivots)
    span = fanout ** len(pivots)
    for level in range(len(pivots) - 1, -1, -1):
        rows = pivots[level].select("g", "pos", "size")
        top_here = rows.where(F.col("size") <= span).join(tops_path, "g").select("g", "pos", "upper")
        if level + 1 < len(pivots):
            above = pivots[level + 1].join(out[level + 1], ["g", "pos"]).select(
                "g", F.col("pos").alias("up"), "upper", F.inline(_slots(fanout))).where(F.col("h").isNotNull())
            below = above.select("g", (F.col("up") * fanout + F.col("slot")).alias("pos"),
                                 F.concat(F.array(F.struct("left", "right")), "upper").alias("upper"))
            top_here = top_here.unionByName(below)
        out[level] = kept_table(top_here, "merkle-path")
        span //= fanout
    return out


def manifest(docs: DataFrame, group: str = "lang", order: str = "doc_id", fields: Sequence[str] = LEAF_FIELDS,
             fanout: int = FANOUT, carry: Sequence[str] | None = None, recheck: Column | None = None) -> DataFrame:
    """Leaf, subroot, root, proof digest and a re-folded root of every row of `docs`.

    Leaves of a group (null is a group) ascend by `order` (nulls first; equal keys by leaf, then as
    read; repeated rows have equal leaves, so the digests do not depend on that choice). Subroots,
    ordered by group (null first, then UTF-8 bytewise), make the root likewise. Returns `row`
    (the `carry` columns, all by default, so any names may clash with ours), `leaf`, `subroot`,
    `root`, `proof_sha256` (H of all siblings, level by level from the bottom, left to right; H
    of nothing without any) and `refolded`: the root that the digest `recheck` (a column of
    `docs`, by default the leaf) gives with the original siblings. An empty table gives no rows.
    Every level is written to the shared folder, which keeps plans and shuffles small.
    """
    carry = list(docs.columns if carry is None else carry)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"),
                       F.col(f"`{group}`").alias("_grp"), F.col(f"`{order}`").alias("_ord"),
                       leaf_digest([F.col(f"`{c}`") for c in fields]).alias("leaf"),
                       (recheck if recheck is not None else leaf_digest([F.col(f"`{c}`") for c in fields])).alias("again"))
    kinds = numbered(rows.select("_grp").distinct().withColumn("_one", F.lit(0)), "_one", [F.col("_grp").asc_nulls_first()])
    kinds = kept_table(kinds.select("_grp", F.col("_pos").alias("g"), F.col("_size").alias("n_groups")), "merkle-groups")
    placed = numbered(rows, "_grp", [F.col("_ord").asc_nulls_first(), F.col("leaf")])
    placed = kept_table(placed.join(kinds, placed["_grp"].eqNullSafe(kinds["_grp"])).select(
        "row", "leaf", "again", "g", F.col("_pos").alias("pos"), F.col("_size").alias("size")), "merkle-leaves")
    sub_tops, pivots = build(placed.select("g", "pos", F.col("leaf").alias("h"), "size", "again", "row"), fanout, ("again", "row"))
    subroots = kept_table(sub_tops.join(kinds, "g").select(
        F.lit(0).cast("long").alias("g"), F.col("g").alias("pos"), F.col("top").alias("h"), F.col("n_groups").alias("size")), "merkle-subroots")
    root_tops, root_pivots = build(subroots, fanout)
    nothing = F.array().cast(EMPTY_PATH)
    root_paths = upper_paths(root_pivots, root_tops.select("g", nothing.alias("upper")), fanout) if root_pivots else []
    # a subroot's path in the tree of subroots: its siblings in the first pivot, then that pivot's path
    if root_pivots:
        firsts = root_pivots[0].join(root_paths[0], ["g", "pos"]).select(F.col("pos").alias("up"), "upper", F.inline(_slots(fanout))).where(F.col("h").isNotNull())
        per_group = firsts.select((F.col("up") * fanout + F.col("slot")).alias("g"), F.col("h").alias("subroot"),
                                  F.concat(F.array(F.struct("left", "right")), "upper").alias("upper"))
    else:
        per_group = subroots.select(F.col("pos").alias("g"), F.col("h").alias("subroot"), nothing.alias("upper"))
    per_group = kept_table(per_group.withColumn("root", root_tops.select("top").scalar()), "merkle-groups-paths")
    leaf_paths = upper_paths(pivots, per_group.select("g", "upper"), fanout) if pivots else []

    def finish(frame: DataFrame, left: Column, right: Column, upper: Column) -> DataFrame:
        siblings = F.array_join(F.transform(upper, lambda s: F.concat(s["left"], s["right"])), "")
        refolded = F.aggregate(upper, F.sha2(F.concat(left, F.col("again"), right), 256) if left is not None else F.col("again"),
                               lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))
        first = F.concat(left, right) if left is not None else F.lit("")
        return frame.select("row", "leaf", "subroot", "root", F.sha2(F.concat(first, siblings), 256).alias("proof_sha256"), refolded.alias("refolded"))

    lone = placed.where(F.col("size") == 1).join(per_group, "g")
    out = finish(lone, None, None, F.col("upper"))
    if pivots:
        spread = pivots[0].join(leaf_paths[0], ["g", "pos"]).join(per_group.select("g", "subroot", "root"), "g").select(
            "subroot", "root", "upper", F.inline(_slots(fanout, ("again", "row")))).where(F.col("h").isNotNull()).withColumnRenamed("h", "leaf")
        out = out.unionByName(finish(spread, F.col("left"), F.col("right"), F.col("upper")))
    return out
