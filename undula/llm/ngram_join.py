"""N-gram Jaccard self-join as a blocked sparse matrix product.

The matrix of documents by word shingles is multiplied with its transpose in blocks, over the columns that can matter: with
shingles in one global order (those found frequent last), two sets of Jaccard similarity t or more share one of the first
n - ceil(t n) + 1 shingles of each (its prefix). Overlaps in the prefixes are summed by pair; a pair whose sum plus what lies
beyond the prefixes is below the overlap that its sizes ask for is discarded, and the others are verified on the whole sets.

Documents of equal sets are one class, compared once. A column of more than LIGHT rows is not multiplied out. Its rows are first
compared with a few central rows (those whose prefixes are most frequent: the originals of near copies), and pairs of rows
that this has not brought into one component are then compared in blocks. Which pairs are compared never changes the result:
two documents that stay uncompared are already in one component.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Rows of a column that are all multiplied with each other.
LIGHT = 24
#: Central rows that each row of a heavier column is compared with.
HUBS = 3
#: Rows of a column that go to one task.
SALTED = 4096
#: Rows of a block of the product over heavy columns.
BLOCK = 512
#: Bits of the map of documents whose texts are fetched.
MARKS = 1 << 23
#: Shingles known to be frequent, at most: they only set the order.
FREQUENT = 100_000
#: Shingles that a task counts at once, to tell the frequent ones (more, if one text has more).
COUNTED = 4_000_000


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles.

    A-Z are lower-cased and words are parted by ASCII white space. A text of fewer words has one shingle, one without words none.
    """
    own = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: only ASCII letters and white space
    if not own:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, own), np.uint64, len(own))
    size = min(words, len(own))
    out = np.full(len(h) - size + 1, size, np.uint64)
    for k in range(size):
        out = (out ^ h[k : len(h) - size + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(out ^ (out >> np.uint64(32)))


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


def least_overlap(a: int, b: int, percent: int) -> int:
    """The least intersection at which 100 * intersection >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


def _arrow(schema: str, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns.values(), map({"l": pa.int64(), "i": pa.int32(), "b": pa.binary(), "s": pa.string()}.get, schema))], list(columns))


def frequent_shingles(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of shingles that tasks find in several of their documents, and those counts' sums.

    The FREQUENT most counted; a broadcast of bounded size. Equal sets in a task count once.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(h: np.ndarray) -> pa.RecordBatch:
            h.sort()  # in place: a block is held once
            found, n = np.unique(h[2:][h[2:] == h[:-2]], return_counts=True)  # the third place of a shingle and each after it
            return _arrow("ll", token=found.view(np.int64), n=n + 2)

        held, size, seen = np.empty(COUNTED, np.uint64), 0, set()
        for b in batches:
            for text in b.column("text").to_pylist():
                one = shingles(text, words)
                key = xxhash.xxh3_64_intdigest(one.tobytes())
                if key in seen:
                    continue
                if size + len(one) > len(held):
                    yield block(held[:size])
                    held, size, seen = held if len(one) <= len(held) else np.empty(len(one), np.uint64), 0, set()
                seen.add(key)
                held[size : size + len(one)] = one
                size += len(one)
        yield block(held[:size])

    top = docs.select("text").mapInArrow(counted, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(FREQUENT).toPandas()
    token = top["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(token)
    return token[order], top["n"].to_numpy(np.int64)[order]


def _sets(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray], words: int, percent: int) -> DataFrame:
    """(doc_id, set, n, heavy, prefix, salts): the set's digest and size, its frequent shingles in the prefix, the prefix in order."""
    known, counts = frequent

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
            for k in range(0, len(ids), 500):
                out = []
                for text in texts[k : k + 500]:
                    h = shingles(text, words)
                    p = prefix_size(len(h), percent)
                    at = np.searchsorted(known, h)
                    often = at < len(known)
                    often[often] = known[at[often]] == h[often]
                    rare = h[~often][:p]
                    heavy, n = h[often], counts[at[often]]
                    order = np.lexsort((heavy, n))[: p - len(rare)]
                    token = np.concatenate([rare, heavy[order]]).view(np.int64)
                    salts = np.concatenate([np.ones(len(rare), int), n[order] // SALTED + 1]).astype(np.int32)
                    out.append((xxhash.xxh3_128_digest(h.tobytes()), len(h), len(order), token, salts))
                yield pa.RecordBatch.from_arrays([pa.array(ids[k : k + 500], pa.int64()), pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.int32()), pa.array([x[3] for x in out], pa.list_(pa.int64())), pa.array([x[4] for x in out], pa.list_(pa.int32()))], ["doc_id", "set", "n", "heavy", "prefix", "salts"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(made, "doc_id bigint, set binary, n int, heavy int, prefix array<bigint>, salts array<int>")


def _columns(entries: DataFrame) -> DataFrame:
    """Products within columns: (kind, token, a, na, b, nb).

    kind 0: a pair of a light column. kind 1: a row of a heavier column with one of its central rows. kind 2: a row (a) of a
    heavier column, with nb its place among central rows or -1. Rows come sorted by column, most frequent prefixes first.
    """
    n = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def column(token: int, salts: int, doc: np.ndarray, size: np.ndarray) -> Iterator[tuple]:
        m = len(doc)
        if m <= LIGHT and salts <= 1:
            i, j = np.triu_indices(m, 1)
            yield 0, token, doc[i], size[i], doc[j], size[j]
            return
        hubs = min(HUBS, m)
        for h in range(hubs):
            yield 1, token, doc[h + 1 :], size[h + 1 :], np.full(m - h - 1, doc[h]), np.full(m - h - 1, size[h])
        place = np.full(m, -1, np.int64)
        place[:hubs] = np.arange(hubs)
        yield 2, token, doc, size, np.zeros(m, np.int64), place

    def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # the rows of the column that is not known to be whole
        out, rows = [], 0

        def flush() -> pa.RecordBatch:
            kind = np.concatenate([np.full(len(x[2]), x[0]) for x in out])
            token = np.concatenate([np.full(len(x[2]), x[1]) for x in out])
            a, na, b, nb = (np.concatenate([x[k] for x in out]) for k in range(2, 6))
            return _arrow("illili", kind=kind.astype(np.int32), token=token, a=a, na=na.astype(np.int32), b=b, nb=nb.astype(np.int32))

        def add(part: list[np.ndarray], last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, out, rows
            token, salt = part[0], part[1]
            if held and not last and token[0] == token[-1] == held[0][0][-1] and salt[0] == salt[-1] == held[0][1][-1]:
                held.append(part)  # the column goes on through the whole batch
                return
            token, salt, salts, doc, size = (np.concatenate(x) for x in zip(*held, part)) if held else part
            edge = np.flatnonzero((token[1:] != token[:-1]) | (salt[1:] != salt[:-1])) + 1
            starts = np.concatenate([[0], edge, [len(token)]])
            done = len(starts) - 1 if last else len(starts) - 2
            runs = np.flatnonzero(np.diff(starts)[:done] > 1)
            single = np.flatnonzero((np.diff(starts)[:done] == 1) & (salts[starts[:-1][:done]] > 1))
            for r in np.union1d(runs, single):
                a, b = starts[r], starts[r + 1]
                for x in column(int(token[a]), int(salts[a]), doc[a:b], size[a:b]):
                    if len(x[2]):
                        out.append(x)
                        rows += len(x[2])
                        if rows > 50_000:
                            yield flush()
                            out, rows = [], 0
            held = [] if last else [[x[starts[done] :] for x in (token, salt, salts, doc, size)]]

        for b in batches:
            if b.num_rows:
                yield from add([b.column(k).to_numpy(zero_copy_only=False) for k in ("token", "salt", "salts", "doc", "n")], False)
        if held:
            yield from add([x[:0] for x in held[0]], True)
        if out:
            yield flush()

    dealt = entries.repartition(n, "token", "salt").sortWithinPartitions("token", "salt", F.desc("rank"), "doc")
    return dealt.select("token", "salt", "salts", "doc", "n").mapInArrow(multiplied, "kind int, token bigint, a bigint, na int, b bigint, nb int")


def _could(percent: int) -> F.Column:
    """Whether sizes na, nb allow the similarity."""
    return (F.col("na") * 100 >= F.col("nb") * percent) & (F.col("nb") * 100 >= F.col("na") * percent)


def _ordered(pairs: DataFrame) -> DataFrame:
    """a < b in each pair, with their sizes."""
    swap = F.col("a") > F.col("b")
    return pairs.where("a != b").select(F.least("a", "b").alias("a"), F.when(swap, F.col("nb")).otherwise(F.col("na")).alias("na"), F.greatest("a", "b").alias("b"), F.when(swap, F.col("na")).otherwise(F.col("nb")).alias("nb"), *[c for c in pairs.columns if c not in ("a", "na", "b", "nb")])


def _marks(ids: DataFrame, key: str = "doc") -> np.ndarray:
    """A bit map of hashed ids of fixed size, for leaving out most of the other documents before a join.

    It loses no id. With many more ids than bits it leaves out less, and the join itself does the work.
    """
    place = F.pmod(F.xxhash64(key), F.lit(MARKS))
    words = ids.select(place.alias("p")).selectExpr("shiftright(p, 5) AS w", "shiftleft(1, CAST(p % 32 AS INT)) AS b").groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    out = np.zeros(MARKS // 32, np.int32)
    out[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int32)
    return out.view(np.uint32)


def _marked(rows: DataFrame, *maps: tuple[np.ndarray, str, bool], then: Callable | None = None, schema: str | None = None) -> DataFrame:
    """rows without most of those whose keys aren't in the maps: (marks, key, True) each, or with False without all that are in it.

    then: what is made of the batches left, with its schema. It runs in the same worker, where a mapInArrow of its own would
    have each task hold a second one.
    """
    names = rows.columns

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.ones(b.num_rows, bool)
            for k, (marks, _, inside) in enumerate(maps):
                place = b.column(f"place{k}").to_numpy().astype(np.int64)
                keep &= (marks[place >> 5] >> (place & 31).astype(np.uint32) & 1).astype(bool) == inside
            yield b.select(names).filter(pa.array(keep))

    placed = rows.withColumns({f"place{k}": F.pmod(F.xxhash64(key), F.lit(MARKS)) for k, (_, key, _) in enumerate(maps)})
    return placed.mapInArrow((lambda batches: then(kept(batches))) if then else kept, schema or rows.schema)


def _by_set(seen: DataFrame) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """The sets of seen (see _sets) as (set, doc), and what gives one row of each, that of the least doc_id, in the maps it is given.

    Only the rows of sets of several rows, told by a bit map, travel with their prefixes, those of a task as one; a set whose bit
    another one shares travels too, alone. Rows without a bit are their set's only ones and stay where they are.
    """
    rows = seen.where("n > 0 and doc_id is not null").withColumnRenamed("doc_id", "doc")
    ids = written(rows.groupBy("set").agg(F.min("doc").alias("doc"), F.count(F.lit(1)).alias("m")), "ids")
    marks = _marks(ids.where("m > 1"), "set")
    least = F.min_by(F.struct("doc", "n", "heavy", "prefix", "salts"), "doc").alias("r")
    several = written(_marked(rows, (marks, "set", True)).groupBy("set").agg(least).select("set", "r.*"), "prefixes")
    return ids.drop("m"), lambda *maps: _marked(rows, (marks, "set", False), *maps).unionByName(_marked(several, *maps) if maps else several)


def _one_of_each_set(seen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sets of seen (see _sets) and one row of each, that of the least doc_id: (set, doc), (set, doc, n, heavy, prefix, salts)."""
    ids, inside = _by_set(seen)
    return ids, inside()


def verified(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets link. Texts of the documents in pairs travel compressed, to each of their pairs."""
    ids = pairs.select(F.col("a").alias("doc")).unionByName(pairs.select(F.col("b").alias("doc"))).distinct()

    marks = _marks(ids)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3, write_checksum=False)
        for b in batches:
            yield _arrow("lb", doc=b.column("doc"), blob=[pack.compress((t or "").encode("utf-8", "surrogatepass")) for t in b.column("text").to_pylist()])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, kept = zstandard.ZstdDecompressor(), {}

        def of(blob: bytes) -> np.ndarray:
            if blob not in kept:
                if len(kept) > 16:
                    kept.clear()
                kept[blob] = shingles(opened.decompress(blob).decode("utf-8", "surrogatepass"), words)
            return kept[blob]

        for b in batches:
            yes = []
            for x, y in zip(b.column("blob_a").to_pylist(), b.column("blob_b").to_pylist()):
                s, t = of(x), of(y)
                both = len(np.intersect1d(s, t, assume_unique=True))
                yes.append(bool(both) and 100 * both >= percent * (len(s) + len(t) - both))
            mask = pa.array(yes, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a").filter(mask), b.column("b").filter(mask)], ["a", "b"])

    doc = docs.select(F.col("doc_id").cast("bigint").alias("doc"), "text").where("doc is not null")
    # the few texts that the map lets through besides those of pairs meet no pair below
    blobs = written(_marked(doc, (marks, "doc", True), then=packed, schema="doc bigint, blob binary"), "texts")
    left = pairs.select("a", "b").join(blobs.select(F.col("doc").alias("a"), F.col("blob").alias("blob_a")), "a")
    full = left.join(blobs.select(F.col("doc").alias("b"), F.col("blob").alias("blob_b")), "b")
    return full.select("a", "b", "blob_a", "blob_b").mapInArrow(linked, "a bigint, b bigint").distinct()


def components(links: DataFrame) -> DataFrame:
    """(doc, component): the least document reachable, for each document in links (a, b).

    Labels fall to the least of the neighbours', then to their label's label, until none changes; each round is a written
    table. Nothing but the count of changes comes to the driver.
    """
    edges = written(links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct(), "edges")
    label = written(edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("label")), "labels")
    while True:
        seen = edges.join(label.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.min("label").alias("near"))
        lower = label.join(seen, "u").select("u", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        parent = label.select(F.col("u").alias("label"), F.col("label").alias("above"))
        after = written(lower.join(parent, "label", "left").select("u", "old", F.least("label", F.coalesce("above", "label")).alias("label")), "labels")
        if after.where("label != old").limit(1).count() == 0:
            return after.select(F.col("u").alias("doc"), F.col("label").alias("component"))
        label = after.select("u", "label")


def _open_columns(rows: DataFrame, comps: DataFrame, prefixes: DataFrame | Callable[..., DataFrame], percent: int) -> DataFrame:
    """Pairs (a, na, b, nb) of rows of heavy columns that are not in one component yet and whose prefixes allow a link.

    rows: (token, doc, n); prefixes: (doc, n, prefix), or what gives those in a map (see _by_set). Columns of the same rows (as those of one passage) offer the same pairs: one of them is taken, told by
    the number of rows and two digests of 64 bits. Two rows can only link if their sizes are of one size class or of neighbours,
    as a class spans the ratio of sizes at which a link is possible, from the column's least size on. The rows of two
    neighbouring classes of a column that hold several components are cut into blocks; every block meets every other and itself,
    and a task multiplies two blocks' prefixes. Of a prefix the distinct upper halves of its hashes travel: shingles that become one
    count to what lies beyond the prefix, so no pair is lost, and pairs too many are told by the whole sets.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    of = rows.join(comps, "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    digest = [F.bit_xor(F.xxhash64("doc", F.lit(k))).alias(f"d{k}") for k in (1, 2)]
    whole = of.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("m"), F.min("n").alias("least"), *digest).where("lo != hi")
    one = whole.groupBy("m", "d1", "d2", "least").agg(F.min("token").alias("token")).select("token", "least")
    of = written(of.join(one, "token"), "open")
    kind = F.floor(F.log(F.col("n") / F.col("least")) / F.lit(float(np.log(100 / percent)) * 1.000001)).cast("int")
    of = of.withColumn("own", kind).withColumn("size", F.explode(F.when(F.col("own") > 0, F.array(F.col("own"), F.col("own") - 1)).otherwise(F.array("own")))).drop("n")
    group = ["token", "size"]
    counted = of.groupBy(*group).agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count_if(F.col("own") == F.col("size")).alias("lower"), F.count(F.lit(1)).alias("m"))
    mixed = counted.where("lo != hi AND lower > 0").select(*group, F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    left = of.join(mixed, group)
    mine = left.withColumn("mine", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    met = mine.select(*group, "own", "doc", "component", "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    halves = F.array_distinct(F.transform("prefix", lambda t: F.shiftright(t, 32).cast("int"))).alias("prefix")
    inside = prefixes if callable(prefixes) else lambda *maps: _marked(prefixes, *maps)
    own = inside((_marks(left.select("doc")), "doc", True)).select("doc", "n", halves)
    cells = met.join(own, "doc").select(*group, F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine", "doc", "component", "n", (F.col("own") > F.col("size")).alias("upper"), "prefix")

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cell(rows: list[tuple]) -> pa.RecordBatch | None:
            doc, comp, size, side, upper = (np.array([r[k] for r in rows], np.int64) for k in (5, 6, 7, 4, 8))
            token = np.concatenate([r[9] for r in rows])
            owner = np.repeat(np.arange(len(rows)), [len(r[9]) for r in rows])
            order = np.argsort(token, kind="stable")
            token, owner = token[order], owner[order]
            starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            overlap = np.zeros((len(rows), len(rows)), np.int32)
            for a, b in zip(starts, np.concatenate([starts[1:], [len(token)]])):
                if b - a > 1:
                    overlap[np.ix_(owner[a:b], owner[a:b])] += 1
            i, j = np.nonzero(np.triu(overlap, 1))
            rest = np.array([r[7] - len(r[9]) for r in rows])
            need = -(-percent * (size[i] + size[j]) // (100 + percent))
            ok = (comp[i] != comp[j]) & (doc[i] != doc[j]) & ((rows[0][2] == rows[0][3]) | (side[i] != side[j])) & ~(upper[i] & upper[j]).astype(bool) & (overlap[i, j] + np.maximum(rest[i], rest[j]) >= need)
            i, j = i[ok], j[ok]
            return _arrow("lili", a=doc[i], na=size[i].astype(np.int32), b=doc[j], nb=size[j].astype(np.int32)) if len(i) else None

        now, held = None, []
        for b in batches:
            columns = [b.column(k).to_pylist() for k in ("token", "size", "lo", "hi", "mine", "doc", "component", "n", "upper")]
            prefix = b.column("prefix")
            for k, r in enumerate(zip(*columns)):
                if r[:4] != now:
                    if held and (out := cell(held)):
                        yield out
                    now, held = r[:4], []
                held.append((*r, prefix[k].values.to_numpy()))
        if held and (out := cell(held)):
            yield out

    return cells.repartition(n, "token", "size", "lo", "hi").sortWithinPartitions("token", "size", "lo", "hi", "doc").mapInArrow(product, "a bigint, na int, b bigint, nb int")


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of docs (doc_id, text; other columns are not read).

    Documents link when 100 * |intersection| >= percent * |union| of their shingle sets; component_id is the least doc_id
    reachable by links, its own included. Empty and null texts have no shingle and no link. A null doc_id takes part in no link
    and has a null component. Rows of one doc_id
    with different texts each get the component of their own text. An empty table gives no rows.
    Sets are 64-bit hashes of shingles.
    """
    docs = docs.select("doc_id", "text")
    seen = written(_sets(docs, frequent_shingles(docs, words), words, percent), "sets")
    ids, prefixes = _by_set(seen)
    size = F.size("prefix")
    entry = prefixes().select("doc", "n", (F.col("heavy").cast("bigint") * 1_000_000 / size).cast("int").alias("rank"), F.explode(F.arrays_zip("prefix", "salts")).alias("e"))
    entries = entry.select(F.col("e.prefix").alias("token"), F.col("e.salts").alias("salts"), F.pmod(F.xxhash64("doc"), F.col("e.salts")).cast("int").alias("salt"), "rank", "doc", "n")
    product = written(_columns(entries), "product")

    rows = product.where("kind = 2").select("token", F.col("a").alias("doc"), F.col("na").alias("n"), F.col("nb").alias("place"))
    most = rows.groupBy("doc").agg(F.count(F.lit(1)).alias("h"))
    light = _ordered(product.where("kind = 0").drop("kind", "token").where(_could(percent))).groupBy("a", "na", "b", "nb").agg(F.count(F.lit(1)).alias("c"))
    light = light.join(most.withColumnRenamed("doc", "a").withColumnRenamed("h", "ha"), "a", "left").join(most.withColumnRenamed("doc", "b").withColumnRenamed("h", "hb"), "b", "left")
    beyond = lambda n: F.ceil(F.col(n) * percent / 100) - 1
    need = F.ceil((F.col("na") + F.col("nb")) * percent / (100 + percent))
    light = light.where(F.col("c") + F.least(F.coalesce("ha", F.lit(0)), F.coalesce("hb", F.lit(0))) + F.greatest(beyond("na"), beyond("nb")) >= need).select("a", "b")
    # of a row's central rows those that share most columns with it; what they leave apart is compared further on
    met = product.where("kind = 1").where(_could(percent)).groupBy("a", "na", "b", "nb").agg(F.count(F.lit(1)).alias("c"))
    star = _ordered(met.withColumn("k", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("c"), "b"))).where(F.col("k") <= HUBS).drop("k", "c")).select("a", "b")
    hubs = rows.where("place >= 0")
    top = hubs.where("place = 0").groupBy("token").agg(F.min(F.struct("doc", "n")).alias("t"))
    across = _ordered(hubs.join(top, "token").select(F.col("doc").alias("a"), F.col("n").alias("na"), F.col("t.doc").alias("b"), F.col("t.n").alias("nb")).where(_could(percent))).select("a", "b")
    pairs = written(light.unionByName(star).unionByName(across).distinct(), "pairs")
    links = written(verified(pairs, docs, words, percent), "links")
    comps = components(links)

    left = _open_columns(rows.select("token", "doc", "n").distinct(), comps, prefixes, percent)
    more = written(_ordered(left.where(_could(percent))).select("a", "b").distinct().join(pairs, ["a", "b"], "left_anti"), "more")
    if more.limit(1).count():
        found = written(verified(more, docs, words, percent), "links")
        comps = components(links.unionByName(found))
    names = ids.join(comps, "doc", "left").select("set", F.coalesce("component", "doc").alias("component"))
    out = seen.select("doc_id", F.col("n").cast("bigint").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("set")).alias("set")).join(names, "set", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """docs without those that another of their component stands for: the one of the least doc_id stays.

    Documents without shingles and rows with a null doc_id stay; rows of one doc_id stay or go together, with the row that goes.
    """
    gone = jaccard_components(docs, **options).where("doc_id != component_id").select(F.col("doc_id").alias("_u_gone"))
    return docs.join(gone, F.col("doc_id") == F.col("_u_gone"), "left_anti")
