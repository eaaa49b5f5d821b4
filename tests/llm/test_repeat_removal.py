"""Removal of repeated strings against a brute-force scan of every string in reading order."""

import hashlib
import random

from strideframe.llm import repeat_removal
from strideframe.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows, length):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    seen, out = set(), []
    for i in order:
        raw = (rows[i][1] or "").encode()
        gone = [False] * len(raw)
        for j in range(len(raw) - length + 1):
            piece = raw[j:j + length]
            if piece in seen:
                gone[j:j + length] = [True] * length
            seen.add(piece)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((rows[i][0], len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def fixture(rng):
    words = ["alpha", "beta", "gamma", "délta", "ε", "zz"]
    passage = " ".join(rng.choice(words) for _ in range(40))
    rows = []
    for i in range(1, 60):
        body = " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))
        if i % 4 == 0:
            body = body[: len(body) // 2] + passage + body[len(body) // 2:]
        rows.append((i * 7 % 61, body, "en", "s", 0))
    rows += [(3, "x" * 500, "en", "s", 0), (500, "xy" * 300, "en", "s", 0), (501, None, None, None, None), (502, "", "en", "s", 0),
             (503, rows[5][1], "en", "s", 0), (503, rows[5][1], "en", "s", 0), (None, passage + " tail", "en", "s", 0)]
    return rows


def test_small_strings_equal_brute_force(spark):
    rng = random.Random(11)
    rows = fixture(rng)
    frame = spark.createDataFrame(rows, DOCS).repartition(3)
    for length, window, spacing in ((12, 3, 4), (30, 4, 8), (100, 16, 32)):
        got = repeat_removal.without_repeats(frame, length=length, window=window, spacing=spacing)
        got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in got.collect()), key=repr)
        assert got == brute(rows, length), (length, window, spacing)


def test_query_and_empty_table(spark, tmp_path):
    rows = fixture(random.Random(5))
    spark.createDataFrame(rows, DOCS).withColumn("kept", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(1)).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((tuple(r) for r in QUERIES["op12_repeat_removal"](spark, str(tmp_path)).collect()), key=repr)
    assert got == brute(rows, 100) and any(r[2] for r in got)
    assert repeat_removal.without_repeats(spark.createDataFrame([], DOCS)).count() == 0


def test_every_way_of_meeting_contexts(spark):
    """Crowded anchors by string hashes, and cut ranges, give the brute-force result too."""
    rows = fixture(random.Random(3))
    frame = spark.createDataFrame(rows, DOCS).repartition(3)
    for most, spacing in ((1, 128), (2, 5), (4096, 3)):
        got = repeat_removal.without_repeats(frame, length=30, window=6, spacing=spacing, most=most)
        got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in got.collect()), key=repr)
        assert got == brute(rows, 30), (most, spacing)


def test_one_row_a_range_not_one_a_byte_or_short_phrase():
    """Fewer rows than a twentieth of the bytes; pieces of a text have the ranges of the whole."""
    import numpy as np
    rng = np.random.default_rng(2)
    buf = rng.integers(97, 123, 40_000).astype(np.uint8)
    first, last, gram = repeat_removal.anchor_ranges(buf, np.array([len(buf)]), 100, repeat_removal.WINDOW, repeat_removal.SPACING)
    assert len(first) < len(buf) / 30 and first[0] == 0 and last[-1] == len(buf) - 100
    assert (first[1:] == last[:-1] + 1).all()
    for a, b in ((0, 15_000), (15_000, 39_900)):
        part = repeat_removal.anchor_ranges(buf[a:b + 99], np.array([b + 99 - a]), 100, repeat_removal.WINDOW, repeat_removal.SPACING)
        assert set((part[0] + a)[1:].tolist()) <= set(first.tolist())
