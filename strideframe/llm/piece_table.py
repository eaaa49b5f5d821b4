"""Merge-type subword encoding and decoding by a table of each prefix's unique last token.

A text splits into segments that no token crosses: a run of word marks and the characters up to
the next run. In a segment, every prefix has one last token: the token that ends there and is
compatible with the last token of the prefix before it, that is, both together encode to just
these two. An automaton over the vocabulary lists the tokens that end at each place; the ids are
recovered from the end of the segment backwards. Pieces without a rank of their own share one
lowest score, which has no unique order; they are merged after all others, leftmost first.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Segments and pairs that a worker remembers at most; beyond, the memory is emptied and filled anew.
MEMORY = 500_000


class PieceTable:
    """Encodes and decodes with the vocabulary of a model file; only its pieces, scores and types are read."""

    def __init__(self, path: str) -> None:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.surface: dict[int, str] = {}
        self.byte: list[int] = [0] * 256
        self.byte_value: dict[int, int] = {}
        for i in range(model.vocab_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.byte_value[i] = int(piece[3:5], 16)
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.id[piece], self.score[piece], self.surface[i] = i, model.get_score(i), piece.replace(MARK, " ")
        counted = pd.Series(self.score).groupby(pd.Series(self.score)).transform("size")
        self.unranked = {p for p in self.score if len(p) > 1 and counted[p] > 1}
        self.ranked = {p for p in self.score if len(p) > 1 and p not in self.unranked}
        self.id_text = {p: str(i) for p, i in self.id.items()}
        self.surface_text = {p: self.surface[i] for p, i in self.id.items()}
        self.automaton = ahocorasick.Automaton()
        for piece in self.ranked:
            if self._merged(list(piece), self.ranked) == [piece]:
                self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        self.segment = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        self.pairs: dict[tuple[str, str], bool] = {}
        self.marked, self.bare = _Memory(self, MARK), _Memory(self, "")
        #: A line break that is part of no longer piece parts segments, so lines can be encoded alone.
        self.lines_stand_alone = not any("\n" in p for p in self.id if len(p) > 1)

    def _merged(self, parts: list[str], allowed: set[str]) -> list[str]:
        """Plain merging, best score first and leftmost among equals; used for pairs and odd pieces."""
        if len(parts) > 64:
            return self._merged_long(parts, allowed)
        score = self.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                both = parts[k] + parts[k + 1]
                if both in allowed and (best is None or score[both] > best):
                    best, at = score[both], k
            if at < 0:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _merged_long(self, parts: list[str], allowed: set[str]) -> list[str]:
        """The same with a heap over a linked list, for long runs."""
        parts, follow, before = list(parts), [*range(1, len(parts)), -1], [-1, *range(len(parts) - 1)]
        heap: list[tuple[float, int, str]] = []

        def offer(k: int) -> None:
            if k >= 0 and follow[k] >= 0 and (both := parts[k] + parts[follow[k]]) in allowed:
                heapq.heappush(heap, (-self.score[both], k, both))

        for k in range(len(parts) - 1):
            offer(k)
        while heap:
            _, k, both = heapq.heappop(heap)
            after = follow[k]
            if not parts[k] or after < 0 or parts[k] + parts[after] != both:
                continue
            parts[k], parts[after], follow[k] = both, "", follow[after]
            if follow[k] >= 0:
                before[follow[k]] = k
            offer(before[k])
            offer(k)
        return [p for p in parts if p]

    def _compatible(self, left: str, right: str) -> bool:
        if len(self.pairs) >= MEMORY:
            self.pairs.clear()
        found = self.pairs[left, right] = self._merged(list(left + right), self.ranked) == [left, right]
        return found

    def pieces(self, segment: str) -> list[str]:
        """The pieces of a segment; characters that are no piece stand alone.

        The automaton gives the tokens by their ends, the longest of an end first, so that the last
        tokens of all shorter prefixes are known when a token is tested against them.
        """
        last, done, known = list(segment), -1, self.pairs.get
        for end, piece in self.automaton.iter(segment):
            if end == done:
                continue
            start = end - len(piece)
            if start >= 0:
                pair = last[start], piece
                fits = known(pair)
                if fits is None:
                    fits = self._compatible(*pair)
                if not fits:
                    continue
            last[end], done = piece, end
        out, at = [], len(segment)
        while at:
            out.append(last[at - 1])
            at -= len(last[at - 1])
        out.reverse()
        if len(out) > 1 and MARK in segment[1:] and any(a + b in self.unranked for a, b in zip(out, out[1:], strict=False)):
            out = self._merged(out, self.ranked | self.unranked)
        return out

    def segment_ids(self, segment: str) -> list[int]:
        ids: list[int] = []
        for piece in self.pieces(segment):
            known = self.id.get(piece)
            ids += [known] if known is not None else [self.byte[b] for b in piece.encode("utf-8")]
        return ids

    def listed(self, segment: str) -> tuple[str, str]:
        """Ids of a segment joined by commas, and what they decode to inside a text."""
        out = self.pieces(segment)
        try:
            return ",".join([self.id_text[p] for p in out]), "".join([self.surface_text[p] for p in out])
        except KeyError:  # a character that is no piece
            ids = self.segment_ids(segment)
            return ",".join(map(str, ids)), self._joined(ids)

    def _line(self, line: str, first: bool) -> list[tuple[str, str]]:
        """The segments of a line, listed; the first line of a text has a mark before it."""
        if "  " in line or MARK in line or first and line[:1] == " ":
            return [self.listed(s) for s in self.segment.findall(MARK * first + line.replace(" ", MARK))]
        if first:
            return list(map(self.marked.__getitem__, line.split(" ")))
        head, *rest = line.split(" ")
        return [self.bare[head], *map(self.marked.__getitem__, rest)] if head else list(map(self.marked.__getitem__, rest))

    def _parts(self, text: str) -> list[tuple[str, str]]:
        if not text:
            return []
        if not self.lines_stand_alone:
            return [self.listed(s) for s in self.segment.findall(MARK + text.replace(" ", MARK))]
        line, *lines = text.split("\n")
        parts = self._line(line, True)
        for line in lines:
            parts.append(self.bare["\n"])
            parts += self._line(line, False)
        return parts

    def encode(self, text: str) -> list[int]:
        return [int(i) for ids, _ in self._parts(text) for i in ids.split(",")]

    def _joined(self, ids: list[int]) -> str:
        out: list[str] = []
        raw = bytearray()
        for i in [*ids, -1]:
            if i in self.byte_value:
                raw.append(self.byte_value[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            if i in self.surface:
                out.append(self.surface[i])
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """Joins surfaces; runs of byte pieces are read as UTF-8, stray bytes as U+FFFD; the first mark goes."""
        return self._joined(ids).removeprefix(" ")

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids joined by commas, SHA-256 of the decoded text.

        A text's byte pieces spell whole characters, so segments may be decoded one by one.
        """
        parts = self._parts(text or "")
        ids, surfaces = zip(*parts, strict=True) if parts else ((), ())
        listed = ",".join(ids)
        n = listed.count(",") + 1 if listed else 0
        return n, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256("".join(surfaces).removeprefix(" ").encode()).hexdigest()


class _Memory(dict):
    """Segments already listed, at most MEMORY of them."""

    def __init__(self, table: PieceTable, mark: str) -> None:
        super().__init__()
        self.table, self.mark = table, mark

    def __missing__(self, word: str) -> tuple[str, str]:
        found = self.table.listed(self.mark + word)
        if len(word) <= 64:
            if len(self) >= MEMORY:
                self.clear()
            self[word] = found
        return found


_tables: dict[str, PieceTable] = {}


def piece_table(path: str) -> PieceTable:
    """One table for each worker process and model."""
    if path not in _tables:
        _tables[path] = PieceTable(path)
    return _tables[path]


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row, without begin and end ids.

    Null and empty texts give no ids and the digests of the empty string. Repeated rows give a row
    each; other columns are ignored; an empty table gives an empty result. Segments are remembered
    up to MEMORY, so a worker's memory does not grow with the data.
    """
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        table = piece_table(path)
        for texts in batches:
            yield pd.DataFrame([table.digest(t) for t in texts], columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    digest = F.pandas_udf(run, "n_tokens long, ids_sha256 string, decoded_sha256 string")
    return docs.select("doc_id", digest(F.col("text").cast("string")).alias("d")).select("doc_id", "d.*")


def encoded_ids(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids): the token ids themselves, for writing training data."""
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = piece_table(path)
        for texts in batches:
            yield pd.Series([table.encode(t or "") for t in texts])

    return docs.select("doc_id", F.pandas_udf(run, "array<int>")(F.col("text").cast("string")).alias("ids"))
