"""Offset-mapped token attribution.

A whole document is encoded once. Tokens' byte lengths give their spans in the document; spans and section boundaries are both
ascending, so the interval join of tokens with sections is one merge. A token that crosses a boundary is allocated by a rule:

  start     to the section that holds its first byte
  majority  to the section that holds most of its bytes, the earlier one at a tie
  split     to every section that holds bytes of it, by their share
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES = ("start", "majority", "split")
#: The pre-tokenisation pattern of the public byte-level vocabularies: a fixed value.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A long run of white space as that pattern sees it. It is encoded by itself, as the pattern's matcher fails on a million characters.
LONG_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{10000,}")
ROW = "n_tokens bigint, n_crossing bigint, section_tokens array<double>, section_start array<bigint>"


@dataclass
class Encoder:
    """A byte-level vocabulary as lines of base64 token and rank, read on the driver and sent along."""

    ranks: bytes
    pattern: str = PATTERN
    _built: list = field(default_factory=list, repr=False, compare=False)

    @classmethod
    def read(cls, path: str, pattern: str = PATTERN) -> Encoder:
        with open(path, "rb") as f:
            return cls(f.read(), pattern)

    def __getstate__(self):
        return self.__dict__ | {"_built": []}

    def built(self):
        if not self._built:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.ranks.splitlines()) if a}
            sizes = np.zeros(max(ranks.values()) + 1, np.int64)
            for token, rank in ranks.items():
                sizes[rank] = len(token)
            self._built += [tiktoken.Encoding("own", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={}), sizes]
        return self._built

    def spans(self, text: str) -> np.ndarray:
        """Byte offsets in the UTF-8 text at which tokens begin, and at last its length."""
        sizes = self.built()[1]
        ids = np.concatenate([np.empty(0, np.int64), *(np.asarray(x, np.int64) for x in self._encoded(text))])
        return np.concatenate([[0], np.cumsum(sizes[ids])])

    def _encoded(self, text: str) -> Iterator[list[int]]:
        """Token ids of a text in stretches. The pattern's pieces are those of the whole text: it takes a run of white space
        up to its last character, which goes with what follows, or whole at the text's end."""
        encoding, at = self.built()[0], 0
        for run in LONG_RUN.finditer(text) if self.pattern == PATTERN else ():
            end = run.end() - (run.end() < len(text))
            yield encoding.encode_ordinary(text[at : run.start()])
            yield encoding._encode_single_piece(text[run.start() : end])
            at = end
        yield encoding.encode_ordinary(text[at:])


def line_starts(raw: bytes) -> np.ndarray:
    """Byte offsets of sections that are lines: each ends with its line feed."""
    code = np.frombuffer(raw, np.uint8)
    ends = np.flatnonzero(code == 10) + 1
    return np.concatenate([[0], ends[ends < len(code)]]).astype(np.int64)


def attribute(ends: np.ndarray, starts: np.ndarray, rule: str = "majority") -> tuple[np.ndarray, int]:
    """Tokens by section, and the number of tokens that cross a boundary.

    ends: token boundaries, 0 first. starts: section boundaries, 0 first; the last section goes to the end.
    """
    a, b = ends[:-1], ends[1:]
    first, last = np.searchsorted(starts, a, "right") - 1, np.searchsorted(starts, b - 1, "right") - 1
    out = np.zeros(len(starts))
    whole = first == last
    out += np.bincount(first[whole], minlength=len(starts))
    for t in np.flatnonzero(~whole):
        cuts = np.concatenate([[a[t]], starts[first[t] + 1 : last[t] + 1], [b[t]]])
        share = np.diff(cuts)
        if rule == "split":
            out[first[t] : last[t] + 1] += share / share.sum()
        else:
            out[first[t] + (int(share.argmax()) if rule == "majority" else 0)] += 1
    return out, int((~whole).sum())


def count_tokens(text: str | None, encoder: Encoder, rule: str) -> tuple[int, int, list[float], list[int]]:
    if not text:
        return 0, 0, [], []
    clean = text.encode("utf-8", "replace").decode()
    ends, starts = encoder.spans(clean), line_starts(clean.encode())
    by_section, crossing = attribute(ends, starts, rule)
    return len(ends) - 1, crossing, by_section.tolist(), starts.tolist()


def with_token_counts(docs: DataFrame, encoder: Encoder, rule: str = "majority", text: str = "text", into: str = "tokens") -> DataFrame:
    """docs plus a struct: n_tokens, n_crossing (tokens over a line's end), section_tokens and section_start (bytes) by line.

    Null and empty texts have no tokens and no section; long runs of white space, letters or line feeds are as any text. The section counts of a document sum to n_tokens under every rule. A
    column called `into` is replaced. One scan without a shuffle.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {', '.join(RULES)}")

    def counted(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield pd.DataFrame([count_tokens(t, encoder, rule) for t in batch], columns=["n_tokens", "n_crossing", "section_tokens", "section_start"])

    return docs.withColumn(into, F.pandas_udf(counted, ROW)(F.col(text)))


def with_field_tokens(rows: DataFrame, encoder: Encoder, fields: list[str], separator: str = "\n", rule: str = "majority", into: str = "field_tokens") -> DataFrame:
    """rows plus the tokens of each field, as the fields are encoded together with separators between them.

    A separator belongs to the field before it. Null fields are empty: they hold no token under start and majority unless the
    separator's token falls to them.
    """

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for b in batches:
            out = []
            for values in b.itertuples(index=False):
                parts = [(v or "") + (separator if k < len(values) - 1 else "") for k, v in enumerate(values)]
                raw = [p.encode("utf-8", "replace") for p in parts]
                starts = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
                text = b"".join(raw).decode()
                got = [0.0] * len(parts)
                held = [k for k, x in enumerate(raw) if x]
                if text:
                    for k, v in zip(held, attribute(encoder.spans(text), starts[:-1][held], rule)[0].tolist()):
                        got[k] = v
                out.append(got)
            yield pd.Series(out, dtype=object)

    return rows.withColumn(into, F.pandas_udf(counted, "array<double>")(F.struct(*[F.col(f).cast("string").alias(f"f{k}") for k, f in enumerate(fields)])))


def total(column: Column) -> Column:
    return F.aggregate(column, F.lit(0.0), lambda a, b: a + b)
