"""Files read by ranges: a Python data source whose partitions are stretches of bytes of files.

A partition gives the wide samples that begin in its stretch: it reads the file's first bytes, which tell the layout, and then
just its own samples, a buffer at a time. So one long file is read by many tasks, in bounded memory. Planning needs names and
sizes alone; if the rows are filtered by n (as trim does), headers are read too and stretches without such rows are left out. Files
whose samples have no place of their own (packed codes, text) are decoded whole, in the partition of their first byte.

The stores are those that pyarrow opens (see store); files of another store that Spark reads come through files.decode_files.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from ..signal import LAYOUT
from . import formats, store

#: Bytes of a file in which its header is sought.
HEAD = 1 << 16
#: Bytes of a partition, and those decoded at once.
RANGE, BUFFER = 32 << 20, 1 << 20
FACTS = "path string, type string, rate double, channels int, length bigint, bits int, seconds double"


@dataclass
class Stretch:
    path: str
    size: int
    start: int
    end: int


@dataclass
class Stretches(InputPartition):
    """Stretches of one partition: small files share one."""

    parts: list[Stretch]


@dataclass
class Options:
    kind: str | None
    rate: float | None
    channels: int | None
    range_bytes: int

    def layout(self, path: str, size: int) -> formats.Layout | None:
        return formats.layout(store.part(path, 0, min(HEAD, size)), size, self.kind, self.rate, self.channels, path)


def owned(layout: formats.Layout, start: int, end: int) -> tuple[int, int]:
    """The wide samples, from and to, whose first byte lies in a stretch of bytes."""
    first = lambda at: min(layout.length, max(0, -(-(at - layout.start) // layout.frame)))
    return first(start), first(end)


class SampleReader(DataSourceReader):
    def __init__(self, paths: list[str], options: Options):
        self.paths, self.options = paths, options
        self.low, self.high, self.streams = 0, None, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Bounds of n and names of streams. Spark tests the rows that are left again."""
        for f in filters:
            if getattr(f, "attribute", None) == ("n",) and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
                if not isinstance(f, LessThan | LessThanOrEqual):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if not isinstance(f, GreaterThan | GreaterThanOrEqual):
                    high = f.value + (not isinstance(f, LessThan))
                    self.high = high if self.high is None else min(self.high, high)
            elif getattr(f, "attribute", None) == ("stream_id",) and isinstance(f, EqualTo | In):
                names = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.streams = names if self.streams is None else self.streams & names
            yield f

    def wanted(self, layout: formats.Layout, start: int, end: int) -> tuple[int, int]:
        a, b = owned(layout, start, end)
        return max(a, self.low), b if self.high is None else min(b, self.high)

    def stretches(self) -> list[Stretch]:
        files = [(p, size) for path in self.paths for p, size in store.listed(path) if self.streams is None or p in self.streams]
        step = self.options.range_bytes
        cut = [[Stretch(p, size, a, min(a + step, size)) for a in range(0, size, step)] for p, size in files]
        if self.low or self.high is not None:
            with ThreadPoolExecutor(32) as pool:
                found = pool.map(lambda f: self.options.layout(*f), files)
                cut = [[s for s in own if (r := self.wanted(at, s.start, s.end))[0] < r[1]] if at else own[:1] for own, at in zip(cut, found)]
        return [s for own in cut for s in own]

    def partitions(self) -> list[Stretches]:
        """Stretches packed up to range_bytes, where opening a file counts as reading its header."""
        out, cost = [Stretches([])], 0
        for s in self.stretches():
            own = s.end - s.start + min(HEAD, self.options.range_bytes)
            if out[-1].parts and cost + own > self.options.range_bytes:
                out.append(Stretches([]))
                cost = 0
            out[-1].parts.append(s)
            cost += own
        return out

    def read(self, partition: Stretches) -> Iterator[pa.RecordBatch]:
        for s in partition.parts:
            yield from self.samples(s)

    def samples(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        layout = self.options.layout(partition.path, partition.size)
        if layout is None:
            if partition.start == 0:
                kind = self.options.kind or formats.detect(store.part(partition.path, 0, 256), partition.path)
                _, a, _ = formats.FORMATS[kind].read(store.part(partition.path, 0, partition.size))
                channels = self.options.channels
                a = formats.wide(formats.flat(a), channels) if channels and channels > 1 and a.shape[1] == 1 else a
                for k in range(0, len(a), BUFFER):
                    yield _batch(partition.path, k, a[k : k + BUFFER])
            return
        a, b = self.wanted(layout, partition.start, partition.end)
        step = max(1, BUFFER // layout.frame)
        for k in range(a, b, step):
            m = min(step, b - k)
            yield _batch(partition.path, k, layout.decode(store.part(partition.path, layout.start + k * layout.frame, m * layout.frame)))


def _batch(path: str, first: int, a: np.ndarray) -> pa.RecordBatch:
    n, c = a.shape
    columns = [pa.repeat(pa.scalar(path), n * c), pa.array(np.tile(np.arange(c, dtype=np.int32), n)), pa.array(first + np.repeat(np.arange(n), c)), pa.array(a.reshape(-1), pa.int32())]
    return pa.RecordBatch.from_arrays(columns, ["stream_id", "channel", "n", "s"])


class Samples(DataSource):
    """spark.read.format("undula"): options paths (or path), kind, rate, channels, range_bytes."""

    @classmethod
    def name(cls) -> str:
        return "undula"

    def schema(self) -> str:
        return LAYOUT

    def reader(self, schema) -> SampleReader:
        o = self.options
        number = lambda key, f: f(o[key]) if o.get(key) else None
        paths = json.loads(o["paths"]) if o.get("paths") else [o["path"]]
        return SampleReader(paths, Options(o.get("kind"), number("rate", float), number("channels", int), int(o.get("range_bytes") or RANGE)))


def load(spark: SparkSession, paths: str | list[str], kind: str | None = None, rate: float | None = None, channels: int | None = None, range_bytes: int = RANGE) -> DataFrame:
    """(stream_id, channel, n, s) of files, globs and folders; a file is a stream, called by its path."""
    spark.dataSource.register(Samples)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    given = {"paths": json.dumps([paths] if isinstance(paths, str) else list(paths)), "kind": kind, "rate": rate, "channels": channels, "range_bytes": range_bytes}
    return spark.read.format("undula").options(**{k: v for k, v in given.items() if v is not None}).load()


def facts(spark: SparkSession, paths: str | list[str], kind: str | None = None, rate: float | None = None, channels: int | None = None) -> DataFrame:
    """(path, type, rate, channels, length, bits, seconds) of files, of each of which a task reads the first bytes; those without a
    layout are decoded."""
    options = Options(kind, rate, channels, RANGE)
    names = [f for p in ([paths] if isinstance(paths, str) else paths) for f in store.listed(p)]
    n = min(len(names), 4 * spark.sparkContext.defaultParallelism)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, size in zip(b.column("path").to_pylist(), b.column("size").to_pylist()):
                name = kind or formats.detect(store.part(path, 0, 256), path)
                at = options.layout(path, size)
                if at is None:
                    r, a, bits = formats.FORMATS[name].read(store.part(path, 0, size))
                    rows.append((path, name, r, a.shape[1], len(a), bits, len(a) / r))
                else:
                    rows.append((path, name, at.rate, at.channels, at.length, at.kept, at.length / at.rate))
            kinds = [pa.string(), pa.string(), pa.float64(), pa.int32(), pa.int64(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["path", "type", "rate", "channels", "length", "bits", "seconds"])

    return spark.createDataFrame(names, "path string, size bigint").repartition(n, F.col("path")).mapInArrow(told, FACTS)
