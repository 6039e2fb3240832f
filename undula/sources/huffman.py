"""Huffman codes of bytes as trees of numbered nodes: a leaf is (-1, value), another node the numbers of its two sons; 0 is the root."""

from __future__ import annotations

import heapq

import numpy as np


class Tree:
    def __init__(self, pairs: list[list[int]]):
        """Refuses a tree that names nodes it doesn't have, or whose root is a leaf."""
        size = len(pairs)
        for k, (left, right) in enumerate(pairs):
            if left < 0 and (k == 0 or not 0 <= right < 256) or left >= 0 and not (0 <= left < size and 0 <= right < size):
                raise ValueError("a bad tree of codes")
        self.pairs = pairs

    @classmethod
    def of(cls, counts: np.ndarray) -> Tree:
        """The tree of least total length for counts of byte values; a lone value is both sons of the root."""
        held = [int(v) for v in np.flatnonzero(counts)] or [0]
        heap = [(int(counts[v]), k, v) for k, v in enumerate(held * 2 if len(held) == 1 else held)]
        heapq.heapify(heap)
        made = len(heap)
        while len(heap) > 1:
            (a, _, left), (b, _, right) = heapq.heappop(heap), heapq.heappop(heap)
            heapq.heappush(heap, (a + b, made, (left, right)))
            made += 1
        pairs, level = [None], [(0, heap[0][2])]
        for at, node in level:  # nodes get their numbers in order of depth
            if isinstance(node, tuple):
                pairs[at] = [len(pairs), len(pairs) + 1]
                level += zip(pairs[at], node)
                pairs += [None, None]
            else:
                pairs[at] = [-1, node]
        return cls(pairs)

    def codes(self) -> dict[int, str]:
        """Each value's code: 0 for the first son, 1 for the second."""
        out, open_ = {}, [(0, "")]
        for at, code in open_:
            left, right = self.pairs[at]
            if left < 0:
                out.setdefault(right, code)
            else:
                open_ += [(left, code + "0"), (right, code + "1")]
        return out


def encoded(tree: Tree, values: np.ndarray) -> bytes:
    """Whole words of 32 bits, the first bit highest, filled up with zeros."""
    code = tree.codes()
    bits = "".join(map(code.__getitem__, values.tolist()))
    bits += "0" * (-len(bits) % 32)
    return int(bits, 2).to_bytes(len(bits) // 8, "big") if bits else b""


def decoded(tree: Tree, words: bytes, count: int) -> tuple[np.ndarray, int]:
    """So many values, and how many bits they took."""
    out, at, used, pairs = [], 0, 0, tree.pairs
    for bit in np.unpackbits(np.frombuffer(words, np.uint8)).tolist() if count else ():
        at, used = pairs[at][bit], used + 1
        if pairs[at][0] < 0:
            out.append(pairs[at][1])
            if len(out) == count:
                return np.array(out, np.int64), used
            at = 0
    if len(out) < count:
        raise ValueError("the codes end too early")
    return np.array(out, np.int64), used
