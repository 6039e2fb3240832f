"""Dedup of lines that many documents share, by a sharded minimal perfect hash.

Tasks count in how many of their documents each line's 128-bit hash is found; sums by hash give the distinct lines. Those of
min_docs documents or more are dealt to shards by their hash. Each shard is a minimal perfect hash (levels of bits, each
holding the keys that met no other one there) which gives every key a place of its own in two arrays: fingerprints, by which
other lines are told, and counts. Documents probe the arrays with their lines' hashes; lines are never joined.

The lines of most documents, as many as TOP_LINES, are sent to the executors as arrays of bounded size, and documents probe
them where they are read. If there are more, documents send the hashes of their other lines to the shards: as no such
line is in more documents than one that was sent, none is hot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Lines whose arrays are sent to the executors, at most: about 13 bytes each.
TOP_LINES = 2_000_000
#: Lines of a shard, about.
SHARD_LINES = 1 << 14
#: Hashes that a task counts at once.
AT_ONCE = 1_000_000
#: Bits of the map of lines in shards that leaves most other lines out before hashes travel.
MARKS = 1 << 23
RESULT = "n_lines bigint, n_dropped bigint, kept string"


def keys(lines: list[bytes]) -> list[bytes]:
    """Lines without the ASCII white space at their ends, A-Z lower-cased: what is compared."""
    return [line.strip(b" \t\n\v\f\r").lower() for line in lines]


def counts(key: bytes, min_chars: int) -> bool:
    """Whether a key has at least min_chars code points."""
    return len(key) >= min_chars and (min_chars <= 1 or len(key.decode("utf-8", "surrogatepass")) >= min_chars)


def hashes(digests: bytes) -> np.ndarray:
    """(rows, 2) halves of 128-bit digests."""
    return np.frombuffer(digests, ">u8").astype(np.uint64).reshape(-1, 2)


def mixed(h: np.ndarray, seed: int) -> np.ndarray:
    """64 bits of both halves and a seed."""
    x = h[:, 0] ^ (h[:, 1] + np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shard_of(h: np.ndarray, total: int) -> np.ndarray:
    return ((h[:, 0] >> np.uint64(40)) % np.uint64(total)).astype(np.int64)


class MinimalHash:
    """A place from 0 to n - 1 for each of n distinct keys (rows, 2), in about 4 bits a key.

    Each level has two bits a key that is left; a key that falls on a bit alone has its place there, the others go on.
    """

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        ones = [np.bitwise_count(w).astype(np.int64) for w in levels]
        sums = np.cumsum(np.concatenate([np.zeros(1, np.int64), *ones]))
        self.before = np.split(sums[:-1], np.cumsum([len(w) for w in ones])[:-1]) if ones else []

    @classmethod
    def of(cls, h: np.ndarray) -> MinimalHash:
        levels: list[np.ndarray] = []
        while len(h):
            size = -(-2 * len(h) // 64) * 64
            at = cls.at(h, size, len(levels))
            alone = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
            h = h[~alone[at]]
        return cls(levels)

    @staticmethod
    def at(h: np.ndarray, size: int, level: int) -> np.ndarray:
        return ((mixed(h, level + 1) >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)

    def places(self, h: np.ndarray) -> np.ndarray:
        """The place of each key; for what is no key any place, or -1."""
        out, left = np.full(len(h), -1, np.int64), np.arange(len(h))
        for level, (words, before) in enumerate(zip(self.levels, self.before)):
            at = self.at(h[left], len(words) * 64, level)
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            here = (word >> bit & np.uint64(1)).astype(bool)
            out[left[here]] = before[at[here] >> 6] + np.bitwise_count(word[here] & ((np.uint64(1) << bit[here]) - np.uint64(1)))
            left = left[~here]
        return out


class Shard:
    """The lines of one shard: a minimal perfect hash, and by its places fingerprints and counts."""

    def __init__(self, levels: list[bytes], fingerprints: bytes, counts: bytes):
        self.hash = MinimalHash([np.frombuffer(x, np.uint64) for x in levels])
        self.fingerprints, self.counts = np.frombuffer(fingerprints, np.uint64), np.frombuffer(counts, np.uint32)

    @staticmethod
    def packed(h: np.ndarray, n: np.ndarray) -> tuple[list[bytes], bytes, bytes]:
        """The arrays of a shard of lines h, found in n documents (from 2^32 - 1 on: so many)."""
        made = MinimalHash.of(h)
        place = made.places(h)
        fingerprints, counts = np.zeros(len(h), np.uint64), np.zeros(len(h), np.uint32)
        fingerprints[place], counts[place] = h[:, 1], np.minimum(n, 0xFFFFFFFF)
        return [x.tobytes() for x in made.levels], fingerprints.tobytes(), counts.tobytes()

    def documents(self, h: np.ndarray) -> np.ndarray:
        """In how many documents each line is found; 0 for lines that aren't here."""
        place = self.hash.places(h)
        ok = place >= 0
        ok[ok] = self.fingerprints[place[ok]] == h[ok, 1]
        return np.where(ok, self.counts[np.where(ok, place, 0)] if len(self.counts) else 0, 0)


class Shards:
    """The shards that are sent to the executors, probed together."""

    def __init__(self, rows: list[tuple], total: int):
        self.rows, self.total, self.opened = rows, total, {}

    def __getstate__(self):
        return self.__dict__ | {"opened": {}}

    def documents(self, h: np.ndarray) -> np.ndarray:
        if not self.opened:
            self.opened = {k: Shard(*arrays) for k, *arrays in self.rows}
        out, own = np.zeros(len(h), np.int64), shard_of(h, self.total)
        order = np.argsort(own, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(own[order])) + 1):
            if len(part) and (shard := self.opened.get(int(own[part[0]]))):
                out[part] = shard.documents(h[part])
        return out


def _arrow(layout: str, columns: list) -> pa.RecordBatch:
    names, kinds = zip(*(c.split() for c in layout.split(", ")))
    kind = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "string": pa.string(), "array<binary>": pa.list_(pa.binary())}
    return pa.RecordBatch.from_arrays([pa.array(c, kind[k]) for c, k in zip(columns, kinds)], list(names))


def line_counts(docs: DataFrame, min_docs: int, min_chars: int) -> DataFrame:
    """(hi, lo, n): hashes of the lines that min_docs rows of docs (text) or more hold, and how many do."""
    layout = "hi bigint, lo bigint, n bigint"

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sums(parts: list[bytes]) -> pa.RecordBatch:
            h = hashes(b"".join(parts))
            h = h[np.lexsort((h[:, 1], h[:, 0]))]
            first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]).any(axis=1))) if len(h) else np.empty(0, np.int64)
            return _arrow(layout, [h[first, 0].view(np.int64), h[first, 1].view(np.int64), np.diff(np.append(first, len(h)))])

        held, size = [], 0
        for b in batches:
            for text in b.column("text").cast(pa.binary()):
                own = {xxhash.xxh3_128_digest(k) for k in keys((text.as_py() or b"").split(b"\n")) if counts(k, min_chars)}
                held.extend(own)
                size += len(own)
                if size >= AT_ONCE:
                    yield sums(held)
                    held, size = [], 0
        yield sums(held)

    return docs.select("text").mapInArrow(counted, layout).groupBy("hi", "lo").agg(F.sum("n").alias("n")).where(F.col("n") >= min_docs)


def shards(lines: DataFrame, total: int) -> DataFrame:
    """(shard, levels, fingerprints, counts) of lines (hi, lo, n) dealt to `total` shards by their hash; empty ones have no row."""
    layout = "shard int, levels array<binary>, fingerprints binary, counts binary"
    n = min(total, int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def one() -> pa.RecordBatch:
            h, n = (np.concatenate(x) for x in zip(*held))
            return _arrow(layout, [[x] for x in (now, *Shard.packed(h, n))])

        for b in batches:
            own, n = b.column("shard").to_numpy(), b.column("n").to_numpy()
            h = np.stack([b.column(c).to_numpy().view(np.uint64) for c in ("hi", "lo")], axis=1)
            cuts = np.flatnonzero(np.diff(own)) + 1
            for part in np.split(np.arange(len(own)), cuts):
                if len(part):
                    if own[part[0]] != now and held:
                        yield one()
                        held = []
                    now = int(own[part[0]])
                    held.append((h[part], n[part]))
        if held:
            yield one()

    own = F.pmod(F.shiftrightunsigned("hi", 40), F.lit(total)).cast("int").alias("shard")
    return lines.select(own, "hi", "lo", "n").repartition(n, "shard").sortWithinPartitions("shard").mapInArrow(built, layout)


def _top_level(lines: DataFrame) -> tuple[int, int, int]:
    """The least power of two from which on at most TOP_LINES lines have such counts, how many do, and how many don't."""
    found = sorted(((r["level"], r["n"]) for r in lines.groupBy(F.floor(F.log2("n")).cast("int").alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    sent, level = 0, 64
    for at, n in found:
        if sent + n > TOP_LINES:
            break
        sent, level = sent + n, at
    return level, sent, sum(n for _, n in found) - sent


def _cut(text: str | None, gone) -> tuple[int, int, str]:
    """n_lines, n_dropped and what is kept of a text; gone gives a truth value for each of its lines."""
    own = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
    drop = gone(own)
    kept = [line for line, d in zip(own, drop) if not d]
    return len(own), len(own) - len(kept), (text or "") if len(kept) == len(own) else b"\n".join(kept).decode("utf-8", "surrogatepass")


def _probed(top: Shards, min_chars: int):
    """A column expression of texts (and of the digests of further lines to drop) for what stays of them."""

    def result(texts: pd.Series, more: pd.Series | None) -> pd.DataFrame:
        split = [keys((t or "").encode("utf-8", "surrogatepass").split(b"\n")) for t in texts]
        digests = [[xxhash.xxh3_128_digest(k) if counts(k, min_chars) else None for k in own] for own in split]
        found = iter(top.documents(hashes(b"".join(d for own in digests for d in own if d))) > 0)
        rows = []
        for k, (text, own) in enumerate(zip(texts, digests)):
            also = set() if more is None or more.iat[k] is None else {bytes(x) for x in more.iat[k]}
            rows.append(_cut(text, lambda _: [d is not None and (bool(next(found)) | (d in also)) for d in own]))  # noqa: B023
        return pd.DataFrame(rows, columns=["n_lines", "n_dropped", "kept"])

    def alone(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield result(texts, None)

    def both(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, more in batches:
            yield result(texts, more)

    return F.pandas_udf(alone, RESULT), F.pandas_udf(both, RESULT)


def _routed(docs: DataFrame, rest: DataFrame, total: int, min_chars: int) -> DataFrame:
    """(digest, gone): the lines of each distinct text of docs (text, digest) that the shards of `rest` hold."""
    spark = docs.sparkSession
    place = F.pmod(F.xxhash64("hi", "lo"), F.lit(MARKS))
    words = rest.select(place.alias("p")).selectExpr("shiftright(p, 5) AS w", "shiftleft(1, CAST(p % 32 AS INT)) AS b").groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    marks = np.zeros(MARKS // 32, np.int32)
    marks[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int32)
    marks = marks.view(np.uint32)

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digest, line = [], []
            for d, text in zip(b.column("digest").to_pylist(), b.column("text").cast(pa.binary())):
                own = list({xxhash.xxh3_128_digest(k) for k in keys((text.as_py() or b"").split(b"\n")) if counts(k, min_chars)})
                line += own
                digest += [d] * len(own)
            h = hashes(b"".join(line)).view(np.int64)
            yield _arrow("digest binary, hi bigint, lo bigint", [digest, h[:, 0], h[:, 1]])

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column("place").to_numpy().astype(np.int64)
            yield b.select(["digest", "hi", "lo"]).filter(pa.array((marks[at >> 5] >> (at & 31).astype(np.uint32) & 1).astype(bool)))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, shard = None, None
        for b in batches:
            own, kind = b.column("shard").to_numpy(), b.column("kind").to_numpy()
            cuts = np.flatnonzero((np.diff(own) != 0) | (np.diff(kind) != 0) | (kind[1:] == 0)) + 1
            for a, z in zip(np.append(0, cuts).tolist(), np.append(cuts, len(own)).tolist()):
                if a == z:
                    continue
                if kind[a] == 0:  # the arrays of a shard come before its probes
                    now, shard = own[a], Shard(*(b.column(c)[a].as_py() for c in ("levels", "fingerprints", "counts")))
                elif own[a] == now:
                    h = np.stack([b.column(c).slice(a, z - a).to_numpy().view(np.uint64) for c in ("hi", "lo")], axis=1)
                    hit = shard.documents(h) > 0
                    gone = h[hit].astype(">u8").tobytes()
                    yield _arrow("digest binary, gone binary", [b.column("digest").slice(a, z - a).filter(pa.array(hit)), [gone[k : k + 16] for k in range(0, len(gone), 16)]])

    probes = docs.where("digest is not null").mapInArrow(sent, "digest binary, hi bigint, lo bigint").withColumn("place", F.pmod(F.xxhash64("hi", "lo"), F.lit(MARKS))).mapInArrow(marked, "digest binary, hi bigint, lo bigint")
    probes = probes.select(F.pmod(F.shiftrightunsigned("hi", 40), F.lit(total)).cast("int").alias("shard"), F.lit(1).alias("kind"), "digest", "hi", "lo")
    both = shards(rest, total).withColumn("kind", F.lit(0)).unionByName(probes, allowMissingColumns=True)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hits = both.repartition(n, "shard").sortWithinPartitions("shard", "kind").mapInArrow(told, "digest binary, gone binary")
    return hits.groupBy("digest").agg(F.collect_set("gone").alias("gone"))


def with_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, text: str = "text", into: str = "lines") -> DataFrame:
    """docs plus a struct (n_lines, n_dropped, kept): the text without the lines that min_docs rows or more hold.

    Texts are split at \\n; a line's key is the line without ASCII white space at its ends, A-Z lower-cased. Lines whose key has
    at least min_chars code points and is found in at least min_docs rows (once or more in each) go in every text; the others
    stay as they are, joined by \\n. Null and empty texts have one empty line. Repeated rows count as rows of their own and
    lose the same lines; an empty table gives no rows; an existing column called `into` is replaced. Keys are told by 128-bit hashes.
    """
    own = docs.select(F.col(text).alias("text"))
    lines = written(line_counts(own, min_docs, min_chars), "lines")
    level, sent, rest = _top_level(lines)
    total = max(1, -(-sent // SHARD_LINES))
    top = Shards([tuple(r) for r in shards(lines.where(F.col("n") >= F.lit(2.0) ** level), total).collect()] if sent else [], total)
    alone, both = _probed(top, min_chars)
    if not rest:
        return docs.withColumn(into, alone(F.col(text)))
    digest = F.unhex(F.md5(F.col(text).cast("binary")))
    gone = written(_routed(own.withColumn("digest", digest), lines.where(F.col("n") < F.lit(2.0) ** level), -(-rest // SHARD_LINES), min_chars), "gone")
    joined = docs.withColumn("_u_digest", digest).join(gone.select(F.col("digest").alias("_u_digest"), F.col("gone").alias("_u_gone")), "_u_digest", "left")
    return joined.withColumn(into, both(F.col(text), F.col("_u_gone"))).drop("_u_digest", "_u_gone")


def drop_shared_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """docs with shared lines taken out of their texts; see with_lines. Null texts become empty."""
    return with_lines(docs, min_docs, min_chars, into="_u_lines").withColumn("text", F.col("_u_lines.kept")).drop("_u_lines")
