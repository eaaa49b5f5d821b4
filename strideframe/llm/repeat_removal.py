"""Removal of repeated byte strings: every byte covered by a `length`-byte string seen earlier goes.

Texts are UTF-8 bytes (null: empty); a string never crosses documents. A string's earlier place
is a smaller doc_id (nulls last, then the order of reading), or the same document and an earlier
start. Overlaps count, and strings are judged on the input, not on what is left.

Like prefix-free parsing, the work goes by marks that depend on content only. The anchor of a
string is the place in it whose `window` bytes have the least hash (of equal ones the leftmost), so
equal strings have equal anchors at equal places, and neighbouring starts share one anchor: about
two of `length` - `window` starts open a new range of starts with one anchor. A range is one row;
its context, the bytes of all its strings, is hashed. All rows of an anchor meet in one shuffle:

1. A later copy of a context repeats all its strings at the first copy's places, so it is settled
   as a whole: a passage copied a thousand times costs one row a range, not one a byte.
2. First copies are left. An anchor with a single one holds no other repeat. Where an anchor has
   several different contexts, their bytes are fetched and met by anchor, string by string, in
   order; contexts of an anchor with more than MOST of them are met by string hashes instead.

This replaces the suffix arrays of dictionary and parse that the method names: Spark meets equal
keys by hashing, which needs no global order. Contexts are told apart by 64 bits among those of
one anchor, strings of crowded anchors by 128 bits; no byte comparison follows these hashes.

Texts are written once as a table bucketed by a row id, so the later passes over texts join
their small per-document lists without moving the texts. Python tasks work in pieces of PIECE
bytes; a text longer than that is read in overlapping pieces.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strideframe.llm.common import kept_table

#: Fixed value of the contract: the length of a string that counts as repeated.
LENGTH = 100
#: Parameters of the parse: bytes an anchor spans, and the most starts a range takes.
WINDOW = 24
SPACING = 128
#: Bytes a Python task works on at once, rows it gathers, and contexts of an anchor it meets itself.
PIECE = 1 << 19
SLICE = 65_536
MOST = 4096
#: The rolling hash: a base with its inverse modulo 2^64, and a number for each byte.
BASE = 0x9E3779B97F4A7C15
CODES = np.random.default_rng(11).integers(0, 1 << 64, 256, dtype=np.uint64)


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def anchor_ranges(buf: np.ndarray, ends: np.ndarray, length: int, window: int, spacing: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last starts of the ranges and their anchors' hashes; `ends` are the ends of the texts in `buf`."""
    n = len(buf)
    if n < length:
        return (np.zeros(0, dtype=np.int64),) * 2 + (np.zeros(0, dtype=np.uint64),)
    size = 1 << (n - 1).bit_length()
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(CODES[buf] * _powers(BASE, size)[:n], out=sums[1:])
    h = (sums[window:] - sums[:-window]) * _powers(pow(BASE, -1, 1 << 64), size)[:n - window + 1]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    # the least hash of every `length - window + 1` neighbours, by doubling; equal ones: the leftmost
    reach, done = length - window + 1, 1
    least, at = h, np.arange(len(h), dtype=np.int32)
    while done < reach:
        step = min(done, reach - done)
        right = least[step:] < least[:-step]
        at = np.where(right, at[step:], at[:-step])
        least = np.minimum(least[step:], least[:-step])
        done += step
    start = np.arange(len(at), dtype=np.int64)
    inside = start + length <= ends[np.searchsorted(ends, start, side="right")]
    start, at = start[inside], at[inside].astype(np.int64)
    if not len(start):
        return start, start, np.zeros(0, dtype=np.uint64)
    cut = np.nonzero((np.diff(at) != 0) | (np.diff(start) != 1) | (np.diff((at - start) // spacing) != 0))[0] + 1
    first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(start)]]) - 1
    return start[first], start[last], h[at[first]]


def _bytes(value) -> bytes:
    return value if value is not None else b""


def _pieces(batch: pd.DataFrame, length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (row of the batch, place in its text, bytes) of about PIECE bytes."""
    held, size = [], 0
    for i, value in enumerate(batch["_bytes"]):
        raw = _bytes(value)
        for at in range(0, max(len(raw) - length + 1, 0), PIECE):
            part = raw[at:at + PIECE + length - 1]
            held.append((i, at, part))
            size += len(part)
            if size >= PIECE:
                yield held
                held, size = [], 0
    if held:
        yield held


def _range_rows(length: int, window: int, spacing: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rid, null, doc = (batch[c].to_numpy() for c in ("_rid", "_null", "_doc"))
            for held in _pieces(batch, length):
                raw = b"".join(part for _, _, part in held)
                ends = np.cumsum([len(part) for _, _, part in held])
                first, last, gram = anchor_ranges(np.frombuffer(raw, dtype=np.uint8), ends, length, window, spacing)
                if not len(first):
                    continue
                context = np.fromiter((xxhash.xxh3_64_intdigest(raw[a:b + length]) for a, b in zip(first.tolist(), last.tolist())),
                                      dtype=np.uint64, count=len(first))
                k = np.searchsorted(ends, first, side="right")
                row = np.array([i for i, _, _ in held])[k]
                begin = np.concatenate([[0], ends[:-1]]) - np.array([at for _, at, _ in held])
                yield pd.DataFrame({"_rid": rid[row], "_null": null[row], "_doc": doc[row], "a": first - begin[k],
                                    "n": last - first + 1, "G": gram.view(np.int64), "C": context.view(np.int64)})
    return run


def _context_rows(length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = {k: [] for k in ("G", "_null", "_doc", "_rid", "a", "bytes")}
            for r, null, doc, value, spans in zip(batch["_rid"], batch["_null"], batch["_doc"], batch["_bytes"], batch["_spans"]):
                raw = _bytes(value)
                for span in spans:
                    a = int(span["a"])
                    for name, v in zip(out, (int(span["G"]), null, doc, r, a, raw[a:a + int(span["n"]) + length - 1])):
                        out[name].append(v)
                if len(out["G"]) >= SLICE:
                    yield pd.DataFrame(out)
                    out = {k: [] for k in out}
            if out["G"]:
                yield pd.DataFrame(out)
    return run


def _met(length: int):
    """Rows come sorted by anchor, then by place; strings of an anchor seen before are marked."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gram, seen = None, set()
        for batch in batches:
            out = {k: [] for k in ("_rid", "s", "t")}
            for g, r, a, raw in zip(batch["G"], batch["_rid"], batch["a"], batch["bytes"]):
                if g != gram:
                    gram, seen = g, set()
                open_at = None
                for j in range(len(raw) - length + 1):
                    string = raw[j:j + length]
                    if string in seen:
                        open_at = j if open_at is None else open_at
                        continue
                    seen.add(string)
                    if open_at is not None:
                        for name, v in zip(out, (r, a + open_at, a + j)):
                            out[name].append(v)
                        open_at = None
                if open_at is not None:
                    for name, v in zip(out, (r, a + open_at, a + len(raw) - length + 1)):
                        out[name].append(v)
            yield pd.DataFrame({k: pd.Series(v, dtype="int64") for k, v in out.items()})
    return run


def _string_rows(length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = {k: [] for k in ("_rid", "_null", "_doc", "pos", "H")}
            for null, doc, r, a, raw in zip(batch["_null"], batch["_doc"], batch["_rid"], batch["a"], batch["bytes"]):
                for j in range(len(raw) - length + 1):
                    for name, v in zip(out, (r, null, doc, a + j, xxhash.xxh3_128_digest(raw[j:j + length]))):
                        out[name].append(v)
                if len(out["_rid"]) >= SLICE:
                    yield pd.DataFrame(out)
                    out = {k: [] for k in out}
            if out["_rid"]:
                yield pd.DataFrame(out)
    return run


def _kept_rows(length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = {k: [] for k in ("_null", "_doc", "n_bytes", "n_removed", "n_spans", "kept")}
            for null, doc, value, marks in zip(batch["_null"], batch["_doc"], batch["_bytes"], batch["_marks"]):
                raw = value or b""
                n = len(raw)
                covered = sorted((int(m["s"]), min(int(m["t"]) - 1 + length, n)) for m in marks) if marks is not None else []
                merged: list[list[int]] = []
                for s, t in covered:
                    if merged and s <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], t)
                    else:
                        merged.append([s, t])
                kept, at = [], 0
                for s, t in merged:
                    kept.append(raw[at:s])
                    at = t
                kept.append(raw[at:])
                for name, v in zip(out, (null, doc, len(raw), sum(t - s for s, t in merged), len(merged), b"".join(kept))):
                    out[name].append(v)
            yield pd.DataFrame(out)
    return run


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH,
                    window: int = WINDOW, spacing: int = SPACING, most: int = MOST) -> DataFrame:
    """Per row of `docs`: `key`, n_bytes, n_removed, n_spans (maximal removed runs) and `kept` (binary).

    Every row gives one result; repeated rows are ordered as read, so the second copy of a text
    loses every string of `length` bytes or more. Texts shorter than `length` keep all bytes. An
    empty table gives no rows. Other columns of `docs` are not carried. The texts are written
    once, as a table bucketed by row id in the session's warehouse, which stays. The result is the
    same for any `window` up to `length`, `spacing` and `most`.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"repeat_texts_{uuid.uuid4().hex}"
    (docs.select(F.monotonically_increasing_id().alias("_rid"), F.col(f"`{key}`").isNull().alias("_null"),
                 F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(0)).alias("_doc"), F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b"")).alias("_bytes"))
     .repartition(parts, "_rid").write.option("compression", "zstd").bucketBy(parts, "_rid").sortBy("_rid").saveAsTable(name))
    texts = spark.table(name)
    place = ["_null", "_doc", "_rid", "a"]
    found = texts.mapInPandas(_range_rows(length, window, spacing), "_rid long, _null boolean, _doc long, a int, n int, G long, C long").repartition("G")
    # both windows read the one shuffle by anchor
    copy = F.row_number().over(Window.partitionBy("G", "C").orderBy(*place))
    met = found.withColumn("_first", copy == 1).withColumn("_many", F.count_if("_first").over(Window.partitionBy("G")))
    met = kept_table(met.where(~F.col("_first") | (F.col("_many") > 1)).select(
        "_rid", "a", "n", *[F.when(F.col("_first"), F.col(c)).alias(c) for c in ("G", "_many")]), "ranges")
    firsts = met.where(F.col("G").isNotNull())

    def contexts(some: DataFrame) -> DataFrame:
        lists = some.groupBy("_rid").agg(F.collect_list(F.struct("a", "n", "G")).alias("_spans"))
        return texts.join(lists, "_rid").mapInPandas(_context_rows(length), "G long, _null boolean, _doc long, _rid long, a int, bytes binary")

    marks = met.where(F.col("G").isNull()).select("_rid", F.col("a").cast("long").alias("s"), (F.col("a") + F.col("n")).cast("long").alias("t"))
    few = contexts(firsts.where(F.col("_many") <= most)).repartition("G").sortWithinPartitions("G", *place)
    marks = marks.unionByName(few.select("G", "_rid", "a", "bytes").mapInPandas(_met(length), "_rid long, s long, t long"))
    crowded = firsts.where(F.col("_many") > most)
    if not crowded.isEmpty():
        strings = contexts(crowded).mapInPandas(_string_rows(length), "_rid long, _null boolean, _doc long, pos long, H binary")
        again = strings.withColumn("_k", F.row_number().over(Window.partitionBy("H").orderBy("_null", "_doc", "_rid", "pos"))).where("_k > 1")
        marks = marks.unionByName(again.select("_rid", F.col("pos").alias("s"), (F.col("pos") + 1).alias("t")))
    marks = marks.groupBy("_rid").agg(F.collect_list(F.struct("s", "t")).alias("_marks"))
    kept = texts.join(marks, "_rid", "left").select("_null", "_doc", "_bytes", "_marks").mapInPandas(
        _kept_rows(length), "_null boolean, _doc long, n_bytes long, n_removed long, n_spans long, kept binary")
    return kept.select(F.when(~F.col("_null"), F.col("_doc")).alias(key), "n_bytes", "n_removed", "n_spans", "kept")
