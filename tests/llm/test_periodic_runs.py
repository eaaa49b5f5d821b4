"""Periodic runs against a brute-force search of every period, and the registered query on odd rows."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

from strideframe.llm import periodic_runs
from strideframe.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def smallest_period(seq):
    return next(q for q in range(1, len(seq) + 1) if all(seq[k] == seq[k + q] for k in range(len(seq) - q)))


def brute(seq):
    n, out = len(seq), set()
    for q in range(1, n // 2 + 1):
        k = 0
        while k < n - q:
            if seq[k] != seq[k + q]:
                k += 1
                continue
            first = k
            while k < n - q and seq[k] == seq[k + q]:
                k += 1
            length = k - first + q
            if length >= 2 * q and smallest_period(seq[first:first + length]) == q:
                out.add((first, length, q))
    return sorted(out, key=lambda r: (r[0], r[2], r[1]))


def test_runs_equal_brute_force():
    import numpy as np
    rng = random.Random(7)
    for _ in range(600):
        seq = [rng.choice("ab" if rng.random() < 0.6 else "abc") for _ in range(rng.randint(0, 90))]
        ids = np.array([ord(c) - 97 for c in seq], dtype=np.int64)
        assert periodic_runs.runs_of_exponent_three(ids) == [r for r in brute(seq) if r[1] >= 3 * r[2]], seq


def test_lyndon_array_by_pointer_jumping():
    import numpy as np
    rng = random.Random(9)
    for _ in range(300):
        seq = [rng.randint(0, 2) for _ in range(rng.randint(1, 40))]
        ranks = periodic_runs.suffix_ranks(np.array(seq, dtype=np.int64))
        suffixes = [seq[i:] for i in range(len(seq))]
        assert sorted(range(len(seq)), key=lambda i: suffixes[i]) == sorted(range(len(seq)), key=lambda i: ranks[i])
        naive = [next((j for j in range(i + 1, len(seq)) if suffixes[j] < suffixes[i]), len(seq)) - i for i in range(len(seq))]
        assert periodic_runs.lyndon_array(ranks).tolist() == naive


def contract(words):
    runs = [r for r in brute(words) if r[1] >= max(24, 3 * r[2])]
    runs.sort(key=lambda r: (r[0], r[2]))
    gone = {i for s, ln, q in runs for i in range(s + q, s + ln)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    text = "".join(f"{s},{ln},{q}\n" for s, ln, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (len(runs), *(best or (None, None, None)), (1000 * best[1]) // best[2] if best else None,
            hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def rewrite(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(3)
    picked = [i for i in range(1, 400) if zlib.crc32(str(i).encode()) % 10 == 0][:4]
    rows = [(i, " ".join(rng.choice(["x", "y", "Zz"]) for _ in range(rng.randint(0, 90))), "en", "s", 0) for i in range(1, 40)]
    rows += [(i, " ".join(f"w{rng.randint(0, 99)}" for _ in range(80)), "en", "s", 0) for i in picked]
    rows += [(500, None, None, None, None), (501, "", "en", "s", 0), (502, " \t\n", "en", "s", 0), (503, "a b c " * 40, "en", "s", 0),
             (503, "a b c " * 40, "en", "s", 0), (None, "q r " * 30, "en", "s", 0), (504, "lone", "en", "s", 0)]
    spark.createDataFrame(rows, DOCS).withColumn("n_runs", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(9)).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((tuple(r) for r in QUERIES["op11_periodic_runs"](spark, str(tmp_path)).drop("n_words").collect()), key=repr)
    want = []
    for doc_id, text, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        want.append((doc_id, *contract(rewrite(doc_id, words))))
    assert got == sorted(want, key=repr)
    assert sum(1 for r in got if r[1]) >= 4


def test_empty_table(spark):
    assert periodic_runs.periodic_runs(spark.createDataFrame([], DOCS)).count() == 0
