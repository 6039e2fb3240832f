"""Canonical exact document fingerprints.

A text is Unicode-normalised, case folded and its white space folded; xxhash's 128-bit digest of the result is its bucket.
Within each bucket of more than one text the canonical bytes are compared with those of the bucket's first text; a text that
differs (two texts of one digest) gets a suffix of its own, so equal fingerprints mean equal canonical texts.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Members of a bucket that one task compares with the bucket's first text.
MEMBERS = 100
#: So many texts of colliding digests are broadcast; more are joined by a shuffle.
FEW = 1000
OUT_ROWS = 2000


def canonical(text: str | None) -> bytes:
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text or "").casefold())
    return " ".join(folded.split()).encode("utf-8", "surrogatepass")


def digest(text: str | None) -> str:
    return xxhash.xxh3_128_hexdigest(canonical(text))


def _batches(rows: Iterator[tuple], schema: pa.Schema, at_once: int = OUT_ROWS) -> Iterator[pa.RecordBatch]:
    block: list[tuple] = []
    size = 0
    for row in rows:
        block.append(row)
        size += sum(len(v) for v in row if isinstance(v, bytes))
        if len(block) >= at_once or size > 16_000_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*block), schema.types)], schema=schema)
            block, size = [], 0
    if block:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*block), schema.types)], schema=schema)


def collisions(members: DataFrame) -> DataFrame:
    """(id, kind, bucket, suffix) of the members whose bytes differ from those of their bucket's first text.

    members: id bigint, kind int, bucket string, salt int, first boolean, blob binary (the canonical text, zstd). Each salt of
    a bucket holds a copy of its first text and at most about MEMBERS others, so no task gets a whole hot bucket; a task holds
    one text at a time.
    """
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = pa.schema([("id", pa.int64()), ("kind", pa.int32()), ("bucket", pa.string()), ("suffix", pa.string())])

    def differing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            now, first, opened = None, None, zstandard.ZstdDecompressor()
            for b in batches:
                for id_, kind, bucket, salt, is_first, blob in zip(*(b.column(k).to_pylist() for k in ("id", "kind", "bucket", "salt", "first", "blob"))):
                    if (bucket, salt) != now:
                        now, first = (bucket, salt), blob
                    elif blob != first and (own := opened.decompress(blob)) != opened.decompress(first):
                        yield id_, kind, bucket, hashlib.sha256(own).hexdigest()[:16]

        yield from _batches(rows(), schema)

    dealt = members.repartition(n, "bucket", "salt").sortWithinPartitions("bucket", "salt", F.desc("first"))
    return dealt.mapInArrow(differing, "id bigint, kind int, bucket string, suffix string")


def _splits(docs: DataFrame, n: int) -> tuple[np.ndarray, int | None, bool]:
    """Ids that begin the second and later ranges of about equal numbers of rows; the least id; whether there are null ids."""
    share = F.percentile_approx("doc_id", [k / n for k in range(1, n)] or [0.5], 10_000)
    r = docs.agg(share.alias("s"), F.min("doc_id").alias("lo"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    return np.array(sorted(set(r["s"] or [])), np.int64) if n > 1 else np.empty(0, np.int64), r["lo"], bool(r["nulls"])


def _in_order(docs: DataFrame, flags: DataFrame | None) -> DataFrame:
    """Texts (kind 1) and flags (kind 0) dealt to ranges of doc_id and sorted, each range followed by a guest: the next range's
    first row, and after the last range the table's first row. Texts travel compressed."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    starts, least, nulls = _splits(docs, n)
    last = len(starts)
    schema = pa.schema([("range", pa.int32()), ("guest", pa.bool_()), ("doc_id", pa.int64()), ("kind", pa.int32()), ("blob", pa.binary()), ("hash", pa.string()), ("edited_hash", pa.string()), ("salts", pa.int32()), ("edited_salts", pa.int32()), ("leads", pa.int32())])
    begins = set(starts.tolist())

    def where(id_):
        return 0 if id_ is None else int(np.searchsorted(starts, id_, "right"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            pack = zstandard.ZstdCompressor(level=3, write_checksum=False)
            for b in batches:
                for id_, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                    blob = pack.compress((text or "").encode("utf-8", "surrogatepass"))
                    at = where(id_)
                    yield at, False, id_, 1, blob, None, None, None, None, None
                    if id_ in begins and at:
                        yield at - 1, True, id_, 1, blob, None, None, None, None, None
                    if (id_ is None) if nulls else id_ == least:
                        yield last, True, id_, 1, blob, None, None, None, None, None

        yield from _batches(rows(), schema)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(k).to_pylist() for k in ("doc_id", "hash", "edited_hash", "salts", "edited_salts", "leads")))
            yield from _batches(((where(r[0]), False, r[0], 0, None, *r[1:]) for r in rows), schema)

    ddl = "range int, guest boolean, doc_id bigint, kind int, blob binary, hash string, edited_hash string, salts int, edited_salts int, leads int"
    both = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(packed, ddl)
    if flags is not None:
        both = both.unionByName(flags.select("doc_id", "hash", "edited_hash", "salts", "edited_salts", "leads").mapInArrow(placed, ddl))
    return both.repartitionById(last + 1, "range").sortWithinPartitions("range", "guest", "doc_id", "kind", "blob")


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as many first characters of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(flags by (hash, edited hash), id, text, the next row's id and text) for each text, in order."""
    opened = zstandard.ZstdDecompressor()
    held, flags, at, done = None, {}, None, False
    for b in batches:
        for row in zip(*(b.column(k).to_pylist() for k in ("range", "guest", "doc_id", "kind", "blob", "hash", "edited_hash", "salts", "edited_salts", "leads"))):
            if row[0] != at:
                at, held, flags, done = row[0], None, {}, False
            if row[3] == 0:  # sorted before the texts of its id
                if flags.get("id", row) != row[2]:
                    flags = {}
                flags["id"] = row[2]
                flags[row[5], row[6]] = row[7:]
                continue
            if done:
                continue
            text = opened.decompress(row[4]).decode("utf-8", "surrogatepass")
            if held is not None:
                yield held[2], held[0], held[1], row[2], text
            if row[1]:
                done, held = True, None
            else:
                held = (row[2], text, flags if flags.get("id") == row[2] else {})


def fingerprint_pairs(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, its edited text's and how like they are.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next (1.0 for equal canonical texts,
    else 0.0). The next document is the next by doc_id, after the last the first; null ids come first, rows of one id in the
    order of their compressed bytes. Null texts are empty; equal rows get equal fingerprints; an empty table gives an empty
    table; other columns are not read. Texts travel twice, compressed, in ranges of doc_id, and those of shared digests once
    more.
    """
    docs = docs.select("doc_id", "text")
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("hash", pa.string()), ("edited_hash", pa.string()), ("next_id", pa.int64()), ("next_hash", pa.string())])

    def slim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            known = (None, None)
            for _, id_, text, next_id, following in _pairs(batches):
                mine = known[1] if known[0] is text else digest(text)
                theirs = digest(following)
                known = (following, theirs)
                other = edited(text, following)
                yield id_, len(text), hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest(), mine, mine if other == text else digest(other), next_id, theirs

        yield from _batches(rows(), schema)

    seen = written(_in_order(docs, None).mapInArrow(slim, "doc_id bigint, n_chars bigint, edited_sha256 string, hash string, edited_hash string, next_id bigint, next_hash string"), "digests")
    each = seen.select(F.col("hash").alias("bucket"), F.struct("doc_id", F.lit(0).alias("kind")).alias("who")).unionByName(seen.select(F.col("edited_hash").alias("bucket"), F.struct("doc_id", F.lit(1).alias("kind")).alias("who")))
    shared = written(each.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("who").alias("lead")).where("n > 1"), "buckets")
    mine = shared.select(F.col("bucket").alias("hash"), F.ceil(F.col("n") / MEMBERS).cast("int").alias("salts"), F.col("lead").alias("lead_0"))
    other = shared.select(F.col("bucket").alias("edited_hash"), F.ceil(F.col("n") / MEMBERS).cast("int").alias("edited_salts"), F.col("lead").alias("lead_1"))
    marked = seen.select("doc_id", "hash", "edited_hash").join(mine, "hash", "left").join(other, "edited_hash", "left").where("salts is not null or edited_salts is not null")
    is_lead = lambda k: F.coalesce(F.col(f"lead_{k}.doc_id").eqNullSafe(F.col("doc_id")) & (F.col(f"lead_{k}.kind") == k), F.lit(False))
    flags = written(marked.withColumn("leads", is_lead(0).cast("int") + 2 * is_lead(1).cast("int")), "flags")

    members_schema = pa.schema([("id", pa.int64()), ("kind", pa.int32()), ("bucket", pa.string()), ("salt", pa.int32()), ("first", pa.bool_()), ("blob", pa.binary())])

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            pack = zstandard.ZstdCompressor(level=3, write_checksum=False)
            for told, id_, text, _, following in _pairs(batches):
                if not told:
                    continue
                other = edited(text, following)
                for (h, eh), (salts, edited_salts, leads) in ((k, v) for k, v in told.items() if k != "id"):
                    for kind, bucket, n, whole in ((0, h, salts, text), (1, eh, edited_salts, other)):
                        if n is None or digest(whole) != bucket:  # not shared, or another row of this id
                            continue
                        blob = pack.compress(canonical(whole))
                        if leads >> kind & 1:
                            for salt in range(n):
                                yield id_, kind, bucket, salt, True, blob
                        else:
                            yield id_, kind, bucket, xxhash.xxh32_intdigest(f"{id_} {kind}") % n, False, blob

        yield from _batches(rows(), members_schema)

    found = written(collisions(_in_order(docs, flags).mapInArrow(members, "id bigint, kind int, bucket string, salt int, first boolean, blob binary")), "collisions")
    few = found.limit(FEW + 1).count() <= FEW
    suffix = lambda kind, bucket, name: (lambda s: F.broadcast(s) if few else s)(found.where(F.col("kind") == kind).select(F.col("id").alias(f"_{name}"), F.col("bucket").alias(bucket), F.concat(F.lit("-"), "suffix").alias(name)).distinct())
    out = seen
    for kind, bucket, id_, name in ((0, "hash", "doc_id", "_a"), (1, "edited_hash", "doc_id", "_b"), (0, "next_hash", "next_id", "_c")):
        s = suffix(kind, bucket, name)
        out = out.join(s, (out[id_] == s[f"_{name}"]) & (out[bucket] == s[bucket]), "left").drop(s[bucket]).drop(f"_{name}")
    full = lambda bucket, name: F.concat(F.col(bucket), F.coalesce(F.col(name), F.lit("")))
    return out.select("doc_id", "n_chars", "edited_sha256", full("hash", "_a").alias("fingerprint"), full("edited_hash", "_b").alias("edited_fingerprint"), (full("hash", "_a") == full("edited_hash", "_b")).cast("double").alias("near_edited"), (full("hash", "_a") == full("next_hash", "_c")).cast("double").alias("near_next"))


def with_fingerprints(docs: DataFrame, text: str = "text", into: str = "fingerprint") -> DataFrame:
    """docs plus the digest of each whole canonical text, without the comparison inside buckets; one scan, no shuffle."""

    def digests(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([digest(t) for t in batch], dtype=object)

    return docs.withColumn(into, F.pandas_udf(digests, "string")(F.col(text)))
