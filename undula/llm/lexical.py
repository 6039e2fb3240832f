"""Ranked lexical search by windowed bucket scoring.

Documents become postings of the terms that the items hold: one scan, in which nothing is shuffled. What a task reads of them is
a segment, in ascending doc_id, and is traversed in windows of WINDOW documents. In a window the postings lie by term; for each
item its terms' contributions are scatter-added into one array of a window's length, which fits the processor's cache, and its
terms' occupancy bitsets are or-ed; the buckets that the bitset names are harvested into the item's heap and emptied. A task
gives its heaps, at most k rows an item, and the k best of those are an item's result.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Documents of a window: 8 bytes a bucket.
WINDOW = 4096
#: Items and distinct terms sought at once, about: what is sent to the executors and what their heaps hold. More are sought in
#: blocks of this size, one after the other.
BLOCK_ITEMS, BLOCK_TERMS = 10_000, 200_000
#: Bytes of a text that are split at once.
STRETCH = 1 << 20
#: ASCII letters and digits and all bytes of other characters are parts of terms; only A-Z change.
TERM_BYTES = bytes(c if c > 0x7F or chr(c).isalnum() else 0x20 for c in range(256)).lower()
LAYOUT = "item int, item_id bigint, doc_id bigint, score bigint"


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text, in lists of bounded length."""
    plain, at = text.translate(TERM_BYTES), 0
    while at < len(plain):
        end = plain.find(b" ", at + STRETCH)
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end


def item_blocks(items: DataFrame, block_items: int | None = None, block_terms: int | None = None) -> Iterator[list[tuple[int | None, Counter]]]:
    """(item_id, its terms' counts) of each row of items, in blocks of bounded size. Items without a term match nothing."""
    block, seen = [], set()
    for row in items.select(F.col("item_id").cast("bigint"), "text").where("text is not null").toLocalIterator():
        own = Counter(t for part in terms(row["text"].encode("utf-8", "surrogatepass")) for t in part)
        if own:
            block.append((row["item_id"], own))
            seen.update(own)
        if len(block) >= (block_items or BLOCK_ITEMS) or len(seen) >= (block_terms or BLOCK_TERMS):
            yield block
            block, seen = [], set()
    if block:
        yield block


def postings(docs: DataFrame, known: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, counts) of each document of at least one term: n of them with repeats, and those known with counts."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary())):
                n, own = 0, Counter()
                for part in terms(text.as_py() or b""):
                    n += len(part)
                    own.update(map(known.get, part))
                own.pop(None, None)
                if n:
                    out.append((doc, n, list(own), list(own.values())))
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())))], ["doc_id", "n", "terms", "counts"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(found, "doc_id bigint, n bigint, terms array<int>, counts array<bigint>")


def document_counts(index: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each of the known terms. Tasks count; the driver gets a number a term."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            total += np.bincount(b.column("terms").flatten().to_numpy(), minlength=size)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["term", "n"])

    out = np.zeros(size, np.int64)
    sums = index.select("terms").mapInArrow(counted, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    out[sums["term"].to_numpy(np.int64)] = sums["n"].to_numpy(np.int64)
    return out


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def impact(count, length):
    """The saturating share of a term's occurrences in a document of this normalised length."""
    return 1_000_000_000 * count // (1000 * count + 8 * length)


class Windows:
    """Heaps of the best documents of each item, fed with windows of postings."""

    def __init__(self, items: list[tuple[int | None, list[tuple[int, int]]]], weights: np.ndarray, documents: int, total: int, k: int):
        self.items, self.weights, self.documents, self.total, self.k = items, weights, documents, total, k
        self.heaps: list[list[tuple]] = [[] for _ in items]
        self.buckets = np.zeros(WINDOW, np.int64)

    def length(self, n: int) -> int:
        return 100 - 75 + 75 * n * self.documents // self.total  # of Python's whole numbers: no overflow

    def add(self, docs: list[int | None], lengths: list[int], owner: np.ndarray, term: np.ndarray, count: np.ndarray) -> None:
        """A window's documents in ascending doc_id (null last) and their postings; owner is a document's place."""
        order = np.argsort(term, kind="stable")
        term, owner, count = term[order], owner[order], count[order]
        norm = np.array([self.length(n) for n in lengths], np.int64)
        value = self.weights[term] * impact(count, norm[owner])
        held, starts = np.unique(term, return_index=True)
        ends = np.append(starts[1:], len(term))
        row = dict(zip(held.tolist(), range(len(held))))
        bits = self.bitsets(np.repeat(np.arange(len(held)), ends - starts), owner, len(held))
        for heap, (_, own) in zip(self.heaps, self.items):
            rows = [(row[t], times) for t, times in own if t in row]
            if not rows:
                continue
            for r, times in rows:
                a, b = starts[r], ends[r]
                self.buckets[owner[a:b]] += value[a:b] if times == 1 else value[a:b] * times
            occupied = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(bits[[r for r, _ in rows]], axis=0), bitorder="little"))
            self.harvest(heap, docs, occupied)
            self.buckets[occupied] = 0

    @staticmethod
    def bitsets(row: np.ndarray, place: np.ndarray, rows: int) -> np.ndarray:
        """For each row of postings, sorted by row and place, a bit for each place of the window."""
        out = np.zeros(rows * WINDOW // 8, np.uint8)
        byte = row * (WINDOW // 8) + (place >> 3)
        if len(byte):
            first = np.flatnonzero(np.append(True, byte[1:] != byte[:-1]))
            out[byte[first]] = np.bitwise_or.reduceat(np.uint8(1) << (place & 7).astype(np.uint8), first)
        return out.reshape(rows, WINDOW // 8)

    def harvest(self, heap: list[tuple], docs: list[int | None], occupied: np.ndarray) -> None:
        score = self.buckets[occupied]
        least = max(1, heap[0][0]) if len(heap) == self.k else 1
        ok = score >= least
        score, place = score[ok], occupied[ok]
        if len(score) > self.k:
            ok = score >= np.partition(score, -self.k)[-self.k]
            score, place = score[ok], place[ok]
            best = np.argsort(-score, kind="stable")[: self.k]  # of equals those of the least doc_id
            score, place = score[best], place[best]
        for s, p in zip(score.tolist(), place.tolist()):
            doc = docs[p]
            entry = (s, doc is not None, -(doc or 0))
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            else:
                heapq.heappushpop(heap, entry)

    def rows(self) -> Iterator[tuple[int, int | None, int | None, int]]:
        for k, (heap, (item_id, _)) in enumerate(zip(self.heaps, self.items)):
            for score, named, doc in heap:
                yield k, item_id, -doc if named else None, score


def ranked(index: DataFrame, items: list[tuple[int | None, list[tuple[int, int]]]], weights: np.ndarray, documents: int, total: int, k: int) -> DataFrame:
    """(item, item_id, doc_id, score): the k best of each item by task, then of all."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, held, rows = Windows(items, weights, documents, total, k), [], 0

        def full(parts: list[pa.RecordBatch]) -> None:
            t = pa.Table.from_batches(parts).combine_chunks()
            own = t.column("terms").combine_chunks()
            sizes = np.diff(own.offsets.to_numpy())
            owner = np.repeat(np.arange(len(sizes)), sizes)
            windows.add(t.column("doc_id").to_pylist(), t.column("n").to_pylist(), owner, own.flatten().to_numpy(), t.column("counts").combine_chunks().flatten().to_numpy())

        for b in batches:
            while b.num_rows:
                part = b.slice(0, WINDOW - rows)
                b = b.slice(part.num_rows)
                held.append(part)
                rows += part.num_rows
                if rows == WINDOW:
                    full(held)
                    held, rows = [], 0
        if rows:
            full(held)
        out = list(windows.rows())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 4, (pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["item", "item_id", "doc_id", "score"])

    found = index.sortWithinPartitions(F.col("doc_id").asc_nulls_last()).mapInArrow(scored, LAYOUT)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the k highest-scoring documents of each item (item_id, text), those of score above 0.

    Terms are maximal runs of ASCII letters and digits and of all characters beyond ASCII, only A-Z lower-cased. N documents have
    a term, L terms in all (with repeats); a term that df documents hold weighs w = floor(1000 ln((2N + 2) / (2df + 1))); a
    document of n terms has m = 25 + 75 n N div L; it scores the sum over the item's terms, repeats included, of
    w * (10^9 tf div (1000 tf + 8 m)). Equal scores are ranked by ascending doc_id, null ids last.

    Null and empty texts have no term: such documents don't count, such items have no row. Rows of one doc_id are documents of
    their own, and rows of one item_id items of their own with their own ranks. Empty tables give no rows. Other columns
    aren't read. Each block of items (see BLOCK_ITEMS) scans the documents once.
    """
    out = None
    for block in item_blocks(items):
        known = {t: n for n, t in enumerate(dict.fromkeys(t for _, own in block for t in own))}
        index = written(postings(docs, known), "postings")
        documents, total = index.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        weights = np.array([weight(documents, n) for n in document_counts(index, len(known)).tolist()], np.int64)
        asked = [(item_id, [(known[t], times) for t, times in own.items()]) for item_id, own in block]
        found = ranked(index.where("size(terms) > 0"), asked, weights, documents, max(total, 1), k)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = docs.sparkSession.createDataFrame([], LAYOUT + ", rank int")
    return out.select("item_id", "rank", "doc_id", "score")
