"""Quality rules: a decision list learned by sequential covering, applied as one Spark expression."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bound of the fitted sample: labelled rows, taken in the order of a hash of their id.
FIT_ROWS = 20_000
#: A learned rule must be right for this share of the rows that prune it, and cover so many of them.
LEAST_RIGHT = 0.95
LEAST_COVERED = 4
MOST_RULES = 16
MOST_CONDITIONS = 4
CUTS = 48
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("n_words", "mean_chars", "symbols_a_word", "dup_lines", "repeat_words", "capitals", "digits", "signs_a_word", "distinct_words", "top_word", "words_a_line", "stops_a_word")

_word = re.compile(r"[^\x20\x09-\x0d]+")
_symbol = re.compile(r"[#*$%&|<>]")
_capital, _digit, _sign = re.compile(r"[A-ZÀ-ÖØ-Þ]"), re.compile(r"[0-9]"), re.compile(r"[!-/:-@\[-`{-~]")


def repeated_words(words: list[str], width: int = 3) -> int:
    """Words that stand in a window of `width` words found at least twice in the text."""
    if len(words) <= width:
        return 0
    number: dict[str, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    windows = ids
    for k in range(1, width):  # numbered anew at each step, so products stay below the square of the length
        n = len(ids) - k
        windows = np.unique(windows[:n] * len(number) + ids[k:k + n], return_inverse=True)[1].astype(np.int64)
    again = np.bincount(windows)[windows] > 1
    covered = np.zeros(len(ids), bool)
    for k in range(width):
        covered[k:k + len(again)] |= again
    return int(covered.sum())


def statistics(text: str | None) -> tuple[float, ...]:
    """BASE, then FEATURES of a text; all 0 for a null text."""
    text = text or ""
    words = _word.findall(text)
    lines = [line for line in text.split("\n") if _word.search(line)]
    n, n_lines = max(1, len(words)), max(1, len(lines))
    chars = sum(map(len, words))
    symbols, dup, again = len(_symbol.findall(text)), len(lines) - len(set(lines)), repeated_words(words)
    counts = Counter(words)
    return (
        len(words), chars, symbols, dup, again,
        len(words), chars / n, symbols / n, dup / n_lines, again / n,
        len(_capital.findall(text)) / max(1, chars), len(_digit.findall(text)) / max(1, chars), len(_sign.findall(text)) / n,
        len(counts) / n, max(counts.values(), default=0) / n, len(words) / n_lines, text.count(".") / n)


def with_statistics(docs: DataFrame, into: str = "stats") -> DataFrame:
    """`docs` with a struct `into` of BASE (long) and FEATURES (double, f_ in front)."""
    names = [*BASE, *[f"f_{f}" for f in FEATURES]]
    kinds = ", ".join([f"{b} long" for b in BASE] + [f"f_{f} double" for f in FEATURES])

    def run(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in series:
            frame = pd.DataFrame([statistics(t) for t in texts], columns=names, dtype=float)
            yield frame.astype({b: "int64" for b in BASE})

    return docs.withColumn(into, F.pandas_udf(run, kinds)(F.col("text").cast("string")))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def holds(self, frame: pd.DataFrame) -> np.ndarray:
        values = frame[self.feature].to_numpy()
        return values > self.cut if self.above else values <= self.cut

    def column(self, stats: Column) -> Column:
        value = stats[f"f_{self.feature}"]
        return value > F.lit(self.cut) if self.above else value <= F.lit(self.cut)


Rule = tuple[Condition, ...]


def _covers(rule: Rule, frame: pd.DataFrame) -> np.ndarray:
    held = np.ones(len(frame), bool)
    for condition in rule:
        held &= condition.holds(frame)
    return held


def _grown(frame: pd.DataFrame, bad: np.ndarray) -> Rule:
    """Adds the condition with the highest information gain until no good row is covered."""
    rule: Rule = ()
    held = np.ones(len(frame), bool)
    while (held & ~bad).any() and len(rule) < MOST_CONDITIONS:
        p0, n0 = (held & bad).sum(), (held & ~bad).sum()
        best, chosen = 0.0, None
        for feature in FEATURES:
            values = frame[feature].to_numpy()[held]
            mine = bad[held]
            cuts = np.unique(np.quantile(values, np.linspace(0, 1, CUTS)))
            for cut in (cuts[:-1] + cuts[1:]) / 2:
                low = values <= cut
                for above, side in ((False, low), (True, ~low)):
                    p, n = (side & mine).sum(), (side & ~mine).sum()
                    if p:
                        gain = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
                        if gain > best + 1e-12:
                            best, chosen = gain, Condition(feature, above, float(cut))
        if chosen is None:
            break
        rule += (chosen,)
        held &= chosen.holds(frame)
    return rule


def _pruned(rule: Rule, frame: pd.DataFrame, bad: np.ndarray) -> tuple[Rule, float, int]:
    """The start of the rule that is right most clearly on rows it was not grown on; the shortest of equals."""
    best: tuple[Rule, float, int] = ((), -1.0, 0)
    for n in range(1, len(rule) + 1):
        held = _covers(rule[:n], frame)
        p, q = (held & bad).sum(), (held & ~bad).sum()
        worth = (p + 1) / (p + q + 2) if p + q else 0.0
        if worth > best[1]:
            best = (rule[:n], worth, int(p + q))
    held = _covers(best[0], frame)
    right = (held & bad).sum() / max(1, held.sum())
    return best[0], float(right), best[2]


def learned_rules(frame: pd.DataFrame, bad: np.ndarray) -> list[Rule]:
    """Ordered rules for bad rows: sequential covering, each rule grown on two thirds and pruned on one.

    Without bad or without good rows there is nothing to learn. Equal input gives equal rules.
    """
    rules: list[Rule] = []
    third = np.arange(len(frame)) % 3 == 2
    left = np.ones(len(frame), bool)
    while len(rules) < MOST_RULES:
        grow, prune = left & ~third, left & third
        if not (grow & bad).any() or not (grow & ~bad).any() or not prune.any():
            break
        rule, right, covered = _pruned(_grown(frame[grow], bad[grow]), frame[prune], bad[prune])
        if not rule or right < LEAST_RIGHT or covered < LEAST_COVERED:
            break
        rules.append(rule)
        left &= ~_covers(rule, frame)
    return rules


def fitted(docs_with_stats: DataFrame, labels: DataFrame) -> list[Rule]:
    """Rules from at most FIT_ROWS labelled documents; labels that are null or contradict each other teach nothing."""
    clear = labels.where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most").select("doc_id", "quality")
    rows = docs_with_stats.select("doc_id", "stats").join(clear, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "stats").limit(FIT_ROWS)
    found = rows.select("quality", *[F.col(f"stats.f_{f}").alias(f) for f in FEATURES]).toPandas()
    return learned_rules(found, found["quality"].to_numpy() == 0) if len(found) else []


def verdict(rules: list[Rule], stats: Column) -> Column:
    """True where no rule of the list fires; the first that does decides."""
    out = None
    for rule in rules:
        fires = rule[0].column(stats)
        for condition in rule[1:]:
            fires = fires & condition.column(stats)
        out = F.when(fires, False) if out is None else out.when(fires, False)
    return F.lit(True) if out is None else out.otherwise(True)


def judged(docs: DataFrame, labels: DataFrame, keep) -> DataFrame:
    """(doc_id, BASE, base_failed, kept) of every row; `keep` writes the statistics once.

    A null or blank text has no words, fails the base rules and is not kept. Repeated rows give a
    row each; other columns are ignored; without labels the base rules alone decide.
    """
    stats = keep(with_statistics(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).drop("text"))
    rules = fitted(stats, labels)
    failed = (F.col("stats.n_words") < 50) | (100 * F.col("stats.n_repeat_words") > 50 * F.col("stats.n_words"))
    return stats.select("doc_id", *[F.col(f"stats.{b}").alias(b) for b in BASE], failed.alias("base_failed"), (~failed & verdict(rules, F.col("stats"))).alias("kept"))
