"""Periodic runs of words: Lyndon roots under two orders, extended into maximal repetitions.

By the runs theorem every maximal repetition (run) of period p and length at least 2p holds a
Lyndon root: a stretch of length p that is the longest Lyndon word starting there, under the
word order or under its inverse. So the candidates are the entries of the two Lyndon arrays,
and each is extended left and right as far as the period holds (longest common extensions).
Lyndon arrays are read off suffix ranks: the next suffix of smaller rank ends the longest
Lyndon word.

Only runs of at least three periods are wanted, and each of them holds a Lyndon root followed
by a copy of itself; prefix hashes of word ids test that for every position at once, and plain
comparison extends the few that pass. Suffix ranks come from prefix doubling (numpy sorts), the
next smaller suffix from pointer jumping.

A document is one row: words are split and rewritten on the JVM, each document's runs are found
in a Python task (Arrow batches), and digests are hashed on the JVM again.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideframe.llm.common import words as split_words

#: Fixed values of the contract: the least run length and the least exponent.
MIN_LENGTH = 24
MIN_EXPONENT = 3

RUNS_SCHEMA = ("_key long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, "
               "runs_text string, collapsed string")


def suffix_ranks(seq: np.ndarray) -> np.ndarray:
    """Rank of every suffix (0 = least); a suffix that is a prefix of another is less."""
    n = len(seq)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    _, rank = np.unique(seq, return_inverse=True)
    rank = rank.astype(np.int64)
    step = 1
    while True:
        second = np.full(n, -1, dtype=np.int64)
        second[:n - step] = rank[step:] if step < n else second[:0]
        order = np.lexsort((second, rank))
        changed = (np.diff(rank[order]) != 0) | (np.diff(second[order]) != 0)
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(changed)])
        if rank[order[-1]] == n - 1 or step >= n:
            return rank
        step *= 2


def lyndon_array(ranks: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word at every position: up to the next smaller suffix.

    The next smaller suffix is found by pointer jumping, all positions at once: from i the
    pointer moves to j's own pointer while j's suffix is larger, since everything between j and
    its pointer is larger still.
    """
    n = len(ranks)
    extended = np.append(ranks, -1)
    nxt = np.minimum(np.arange(1, n + 1, dtype=np.int64), n)
    nxt = np.append(nxt, n)
    active = np.arange(n, dtype=np.int64)
    while len(active):
        j = nxt[active]
        larger = extended[j] > extended[active]
        active = active[larger]
        nxt[active] = nxt[nxt[active]]
    return nxt[:n] - np.arange(n, dtype=np.int64)


PRIME, BASE = 2_147_483_629, 1_000_003
_LOW = np.ones(1024, dtype=np.int64)
for _k in range(1, 1024):
    _LOW[_k] = _LOW[_k - 1] * BASE % PRIME
_STEP = int(_LOW[1023]) * BASE % PRIME
_WEIGHTS = {seed: np.random.default_rng(seed).integers(1, PRIME, size=1 << 16, dtype=np.int64) for seed in (7, 11)}


def _prefix_hashes(ids: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of r[id] * BASE^k (k the position) modulo PRIME, prefix by prefix; and the powers.

    The random weights r are drawn once a process from a fixed seed and grow with the largest id.
    """
    n = len(ids)
    weights = _WEIGHTS[seed]
    if len(ids) and ids.max() >= len(weights):
        more = np.random.default_rng([seed, len(weights)]).integers(1, PRIME, size=int(ids.max()) + 1 - len(weights), dtype=np.int64)
        weights = _WEIGHTS[seed] = np.concatenate([weights, more])
    high = np.ones(n // 1024 + 1, dtype=np.int64)
    for k in range(1, len(high)):
        high[k] = high[k - 1] * _STEP % PRIME
    k = np.arange(n, dtype=np.int64)
    powers = _LOW[k % 1024] * high[k // 1024] % PRIME
    terms = weights[ids] * powers % PRIME
    return np.concatenate([[0], np.cumsum(terms) % PRIME]), powers


def runs_of_exponent_three(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """Every run (start, length, smallest period) of length at least three periods.

    Such a run holds, under one of the two orders, a Lyndon root at i with i + 2p inside it
    (the runs theorem), so the candidates are the positions whose longest Lyndon word (length
    p) is followed by itself; prefix hashes test that for all positions at once and plain
    comparison then extends each candidate to its run. A candidate inside a run already found
    with its period is skipped.
    """
    n = len(ids)
    if n < 3:
        return []
    prime = PRIME
    sums, powers = _prefix_hashes(ids, 7)
    sums2, powers2 = _prefix_hashes(ids, 11)
    found: dict[tuple[int, int], int] = {}
    pos = np.arange(n, dtype=np.int64)
    for order in (ids, ids.max() - ids):
        p = lyndon_array(suffix_ranks(order))
        last: dict[int, tuple[int, int]] = {}
        ok = pos + 2 * p <= n
        i, q = pos[ok], p[ok]
        first = (sums[i + q] - sums[i]) % prime * powers[q] % prime
        second = (sums[i + 2 * q] - sums[i + q]) % prime
        first2 = (sums2[i + q] - sums2[i]) % prime * powers2[q] % prime
        second2 = (sums2[i + 2 * q] - sums2[i + q]) % prime
        square = (first == second) & (first2 == second2)
        for a, period in zip(i[square].tolist(), q[square].tolist()):
            seen = last.get(period)
            if seen and seen[0] <= a and a + 2 * period <= seen[1]:
                continue
            right = _match(ids, a, a + period, n)
            left = _match_back(ids, a - 1, a + period - 1)
            start, end = a - left, a + period + right
            last[period] = (start, end)
            if end - start >= 3 * period:
                found[(start, period)] = end
    return sorted(((s, e - s, q) for (s, q), e in found.items()), key=lambda r: (r[0], r[2], r[1]))


def _match(ids: np.ndarray, x: int, y: int, n: int) -> int:
    """Words equal from x and from y on, y > x."""
    got, width = 0, 32
    while y + got < n:
        a = ids[x + got:min(x + got + width, n)]
        b = ids[y + got:min(y + got + width, n)]
        m = min(len(a), len(b))
        diff = np.nonzero(a[:m] != b[:m])[0]
        if len(diff):
            return got + int(diff[0])
        got += m
        width *= 2
    return got


def _match_back(ids: np.ndarray, x: int, y: int) -> int:
    """Words equal backwards from x and from y (x < y), both inclusive."""
    got, width = 0, 32
    while x - got >= 0:
        lo = max(x - got - width + 1, 0)
        a = ids[lo:x - got + 1][::-1]
        b = ids[y - (x - got - lo) - got:y - got + 1][::-1]
        diff = np.nonzero(a != b)[0]
        if len(diff):
            return got + int(diff[0])
        got += len(a)
        width *= 2
    return got


def _repeats_stretch(ids: np.ndarray, width: int) -> bool:
    """Whether some `width` consecutive ids occur twice (a hash collision can only say yes)."""
    n = len(ids)
    if n <= width:
        return False
    one, p1 = _prefix_hashes(ids, 7)
    two, p2 = _prefix_hashes(ids, 11)
    start = np.arange(n - width + 1, dtype=np.int64)
    # a stretch's sum, moved back to position 0, is the same wherever it stands
    back1 = _inverse_powers(start, _INV)
    h1 = (one[start + width] - one[start]) % PRIME * back1 % PRIME
    h2 = (two[start + width] - two[start]) % PRIME * back1 % PRIME
    keys = h1 * PRIME + h2
    return len(np.unique(keys)) < len(keys)


_INV = pow(BASE, PRIME - 2, PRIME)
_INV_LOW = np.ones(1024, dtype=np.int64)
for _k in range(1, 1024):
    _INV_LOW[_k] = _INV_LOW[_k - 1] * _INV % PRIME


def _inverse_powers(k: np.ndarray, inv: int) -> np.ndarray:
    low = _INV_LOW
    step = int(low[1023]) * inv % PRIME
    high = np.ones(int(k.max()) // 1024 + 1 if len(k) else 1, dtype=np.int64)
    for j in range(1, len(high)):
        high[j] = high[j - 1] * step % PRIME
    return low[k % 1024] * high[k // 1024] % PRIME


def summarise(words: list[str], min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> dict:
    """Runs of one word list: count, the one of greatest exponent, their text and the words kept.

    A run counts from max(min_length, min_exponent * period) words on (min_exponent at least 3).
    A word is dropped when a run holds it after its first period. The greatest exponent is
    compared exactly; ties go to the smaller start, then the smaller period. Without a run the
    four numbers are None.
    """
    ids = pd.factorize(pd.Series(words, dtype=object))[0].astype(np.int64) if words else np.zeros(0, dtype=np.int64)
    # such a run repeats ceil(min_length * (e - 1) / e) words at a lag of its period: without a
    # repeated stretch of that many words there is none, and the search is left out
    width = -(-min_length * (min_exponent - 1) // min_exponent)
    found = runs_of_exponent_three(ids) if _repeats_stretch(ids, max(width, 1)) else []
    runs = [r for r in found if r[1] >= max(min_length, min_exponent * r[2])]
    runs.sort(key=lambda r: (r[0], r[2]))
    dropped = np.zeros(len(words) + 1, dtype=np.int64)
    for s, ln, q in runs:
        dropped[s + q] += 1
        dropped[s + ln] -= 1
    gone = np.cumsum(dropped)[:len(words)] > 0
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    return {
        "n_words": len(words), "n_runs": len(runs),
        "start": best[0] if best else None, "length": best[1] if best else None, "period": best[2] if best else None,
        "exponent_milli": (1000 * best[1]) // best[2] if best else None,
        "runs_text": "".join(f"{s},{ln},{q}\n" for s, ln, q in runs),
        "collapsed": " ".join(w for w, g in zip(words, gone) if not g)}


def _tasks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = [summarise(list(w) if w is not None else []) for w in batch["_words"]]
        frame = pd.DataFrame(out, columns=["n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs_text", "collapsed"])
        frame.insert(0, "_key", batch["_key"].values)
        yield frame


def rewritten(words: Column, doc_id: Column) -> Column:
    """The contract's rewrite: where crc32(decimal doc_id) % 10 = 0, words from a point on repeat a stretch.

    With h = crc32, g = h div 10, n words, a = g % n and p = 1 + (n - a) div (3 + g % 8), word
    i >= a becomes word a + (i - a) % p. A null doc_id is never rewritten.
    """
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    n = F.size(words)
    a = F.pmod(g, F.greatest(n, F.lit(1)))
    p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
    shifted = F.transform(words, lambda w, i: F.when(i >= a, F.get(words, (a + F.pmod(i - a, p)).cast("int"))).otherwise(w))
    return F.when((F.pmod(h, F.lit(10)) == 0) & (n > 0), shifted).otherwise(words)


def periodic_runs(docs: DataFrame, text: str = "text", key: str = "doc_id", rewrite: bool = False) -> DataFrame:
    """Runs of the words of every row of `docs` (null text: no words), with their digests.

    Returns the `key` column and n_words, n_runs, start, length, period, exponent_milli (null
    without a run), runs_sha256 (of `start,length,period` lines by start, then period) and
    collapsed_sha256 (kept words joined by one space); with `rewrite` the words are first
    rewritten as `rewritten` says. Other input columns are not carried; a key named like one of
    ours is refused (ValueError). Repeated rows give equal results; an empty table gives none.
    """
    ours = ("n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    if key in ours:
        raise ValueError(f"key column {key!r} clashes with a result column")
    # the words are a column of their own before the rewrite reads them once a word: inside the
    # lambda the split would otherwise be evaluated again for every word
    w = F.col("_split")
    if rewrite:
        w = rewritten(w, F.col("_key"))
    kind = docs.schema[key].dataType.simpleString()
    # documents are dealt out evenly first: a file read as one split would leave one Python
    # worker with all of them
    spread = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text")).repartition(spread)
    split = dealt.select("_key", split_words(F.col("_text").cast("string")).alias("_split"))
    found = split.select("_key", w.alias("_words")).mapInPandas(_tasks, RUNS_SCHEMA.replace("_key long", f"_key {kind}"))
    return found.select(
        F.col("_key").alias(key), "n_words", "n_runs", "start", "length", "period", "exponent_milli",
        F.sha2(F.col("runs_text"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"))
