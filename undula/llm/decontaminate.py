"""Benchmark decontamination by pigeonhole edit matching.

An item that a document holds with at most k edits has, if it is cut into k + 1 pieces, one piece that the document holds
unchanged. All pieces are sought at once by an Aho-Corasick automaton; around each piece found, Myers' bit-parallel distance
verifies the item. Short items are sought without edits, between word bounds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

WORD = re.compile(r"\w+")
HITS = "array<struct<item_id:bigint,distance:int,start:bigint,end:bigint>>"
#: Characters of items that one scan of the documents looks for, and a bound on what is sent to the executors at once; more are
#: sought in blocks of this size, one after the other.
BLOCK_CHARS = 1_000_000
#: Letters of scripts that don't part words by spaces: Thai, Lao, Burmese, Khmer, Kana, Chinese.
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")


def folded(text: str | None) -> str:
    """Words parted by one space, case folded: what is matched."""
    return " ".join(WORD.findall(text or "")).casefold()


def myers(pattern: str, text: str) -> list[int]:
    """For each character of text the least edit distance of pattern to a stretch of text that ends there."""
    peq: dict[str, int] = {}
    for k, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << k
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, out = full, 0, m, []
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (full & ~(xh | pv)), pv & xh
        score += ((ph & top) != 0) - ((mh & top) != 0)
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = mh | (full & ~(xv | ph)), ph & xv
        out.append(score)
    return out


@dataclass
class ItemMatcher:
    """Items by id with their error budgets; scan() finds them in a text."""

    items: list[tuple[int, str]]
    error_rate: float = 0.05
    least_piece: int = 8
    exact_below: int = 0  # shorter items are found without edits and between word bounds only
    _machine: list = field(default_factory=list, repr=False, compare=False)

    def __getstate__(self):
        return self.__dict__ | {"_machine": []}

    def budget(self, item: str) -> int:
        """Edits allowed: error_rate of the length, but pieces keep least_piece characters."""
        if len(item) < self.exact_below:
            return 0
        return max(0, min(int(self.error_rate * len(item)), len(item) // self.least_piece - 1))

    def pieces(self, item: str) -> list[tuple[int, str]]:
        n = self.budget(item) + 1
        cuts = [len(item) * k // n for k in range(n + 1)]
        return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]

    def machine(self):
        if not self._machine:
            by_piece: dict[str, list[tuple[int, int]]] = {}
            for k, (_, item) in enumerate(self.items):
                for at, piece in self.pieces(item):
                    by_piece.setdefault(piece, []).append((k, at))
            built = ahocorasick.Automaton()
            for piece, places in by_piece.items():
                built.add_word(piece, (len(piece), places))
            built.make_automaton()
            self._machine.append(built if by_piece else None)
        return self._machine[0]

    def scan(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, start, end) of each item that the text holds: its best place, in characters of the text."""
        machine, norm = self.machine(), folded(text)
        if machine is None or not norm:
            return []
        spans: dict[int, list[list[int]]] = {}
        exact: dict[int, int] = {}
        for last, (length, places) in machine.iter(norm):
            for k, at in places:
                item = self.items[k][1]
                extra = self.budget(item)
                start = last - length + 1 - at
                if len(item) < self.exact_below:
                    if k not in exact and _bound(norm, start) and _bound(norm, last + 1):
                        exact[k] = start
                    continue
                a, b = max(0, start - extra), min(len(norm), start + len(item) + extra)
                of = spans.setdefault(k, [])
                if of and a <= of[-1][1]:
                    of[-1][1] = max(b, of[-1][1])
                    of[-1][0] = min(a, of[-1][0])
                else:
                    of.append([a, b])
        out = [(self.items[k][0], 0, start, start + len(self.items[k][1])) for k, start in exact.items()]
        for k, windows in spans.items():
            item_id, item = self.items[k]
            best = None
            for a, b in windows:
                scores = myers(item, norm[a:b])
                if best is None or min(scores) < best[0]:
                    best = (min(scores), a, a + scores.index(min(scores)) + 1)
            distance, a, end = best
            if distance <= self.budget(item):
                # where it begins: the item read backwards from its end
                start = end - myers(item[::-1], norm[a:end][::-1]).index(distance) - 1
                out.append((item_id, distance, start, end))
        return _in_text(text, norm, sorted(out))


def _bound(norm: str, at: int) -> bool:
    """Whether a word may begin or end before the character at this place."""
    sides = norm[max(0, at - 1) : at + 1]
    return at in (0, len(norm)) or " " in sides or UNSPACED.search(sides) is not None


def _in_text(text: str, norm: str, hits: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Places in the folded text as places in the text: from the first to the last word that they touch."""
    if not hits:
        return hits
    words = [m.span() for m in WORD.finditer(text)]
    place = lambda at: words[min(norm.count(" ", 0, at), len(words) - 1)]
    return [(i, d, place(a)[0], place(max(a, b - 1))[1]) for i, d, a, b in hits]


def matchers(benchmark: DataFrame, error_rate: float, least_chars: int) -> Iterator[ItemMatcher]:
    """The items in blocks of BLOCK_CHARS; those of fewer than least_chars folded characters are sought without edits."""
    block, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("bigint"), "text").where("item_id is not null").toLocalIterator():
        item = folded(row["text"])
        if item:
            block.append((row["item_id"], item))
            size += len(item)
        if size >= BLOCK_CHARS:
            yield ItemMatcher(block, error_rate, exact_below=least_chars)
            block, size = [], 0
    if block:
        yield ItemMatcher(block, error_rate, exact_below=least_chars)


def with_hits(docs: DataFrame, benchmark: DataFrame, error_rate: float = 0.05, least_chars: int = 24, text: str = "text", into: str = "hits") -> DataFrame:
    """docs plus an array of the items that each whole text holds with at most error_rate edits a character.

    Case, punctuation and white space don't count. Null and empty texts hold nothing; items that are null or
    have no word are never found; those shorter than least_chars folded characters are found where they stand unchanged between
    word bounds (in scripts without spaces, anywhere); an item given twice is found once for each. An existing column called
    `into` is replaced. start and end are the places in the text of the first and last word that the best match touches, the
    shortest of equals. Documents are scanned once for each block of items (one block below BLOCK_CHARS) and never shuffled; what
    a block found is written before the next one is sought, so that one block at a time is held.
    """
    out = docs.withColumn(into, F.array().cast(HITS))
    for k, matcher in enumerate(matchers(benchmark, error_rate, least_chars)):
        one = F.pandas_udf(_unary(matcher), HITS)(F.col(text))
        out = written(out, "hits").withColumn(into, F.concat(into, one)) if k else out.withColumn(into, one)
    return out


def _unary(matcher: ItemMatcher):
    def found(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([[{"item_id": i, "distance": d, "start": a, "end": b} for i, d, a, b in matcher.scan(t)] for t in batch], dtype=object)

    return found


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(doc_id, item_id, distance, start, end) of each benchmark item in each document; repeated rows give repeated hits."""
    hits = with_hits(docs.select("doc_id", "text"), benchmark, **options)
    return hits.select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.*")


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that hold no item; repeated rows stay or go together."""
    return with_hits(docs, benchmark, into="_u_hits", **options).where(F.size("_u_hits") == 0).drop("_u_hits")
