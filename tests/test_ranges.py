"""Files read by ranges give what whole files give, with no sample twice or lost at a cut."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from undula.signal import Signal
from undula.sources import files, formats, ranges, store

WAVE = (np.sin(np.arange(2999) * 0.1) * 2**30).astype(np.int32)


def wave(spark, channels=2, names=("a", "b/c")):
    rows = [(s, k % channels, k // channels, int(v) // (i + 1)) for i, s in enumerate(names) for k, v in enumerate(WAVE[: len(WAVE) // channels * channels])]
    return Signal(spark.createDataFrame(rows, "stream_id string, channel int, n bigint, s int"), 8000.0, channels)


def same(a, b):
    key = ["stream_id", "channel", "n", "s"]
    return a.select(key).exceptAll(b.select(key)).count() == 0 and b.select(key).exceptAll(a.select(key)).count() == 0


@pytest.mark.parametrize("kind", ["wav", "wav8", "wav24", "wav32", "wav_float", "wav_alaw", "aiff", "aifc", "aifc_float", "au", "native", "s3", "u2", "f4", "f8", "ul", "la", "cdda", "ima", "caf", "dat", "8svx"])
def test_ranges_are_whole_files(spark, tmp_path, kind):
    x = wave(spark, 1 if kind in ("ima", "ul") else 2)
    files.save(x, str(tmp_path), kind)
    pattern = f"{tmp_path}/*.{kind}"
    with pytest.raises(FileExistsError):
        files.save(x, str(tmp_path), kind)
    whole = files.decode_files(spark.read.format("binaryFile").load([f"{tmp_path}/a.{kind}", f"{tmp_path}/b/c.{kind}"]), kind, 8000.0, x.channels).withColumn("stream_id", F.regexp_replace("stream_id", "^file:/+", "/"))
    assert same(ranges.load(spark, [pattern, f"{tmp_path}/b"], kind, 8000.0, x.channels), whole)
    fast = files.read(spark, [pattern, f"{tmp_path}/b"], kind, 8000.0, x.channels, ranges_of=777)
    assert same(fast.df, whole) and fast.channels == x.channels


def test_partitions_and_pruning(spark, tmp_path):
    x = wave(spark)
    files.save(x, str(tmp_path), "wav")
    path = f"{tmp_path}/a.wav"
    got = files.read(spark, path, ranges_of=500)
    bytes_ = store.listed(path)[0][1]
    assert got.df.rdd.getNumPartitions() == -(-bytes_ // 500) > 10
    cut = got.chain("trim 1000s 100s")
    assert cut.df.rdd.getNumPartitions() == 1
    assert same(cut.df, got.df.where("n >= 1000 AND n < 1100").withColumn("n", F.col("n") - 1000)) and cut.df.count() == 200
    for where, low, high in (("n > 10 AND n <= 20", 11, 21), ("n = 7", 7, 8), ("n >= 5 AND channel = 1", 5, 1499), ("n < 0", 0, 0)):
        found = got.df.where(where).agg(F.min("n"), F.max("n"), F.count_distinct("n")).first()
        assert tuple(found) == ((low, high - 1, high - low) if high > low else (None, None, 0))
    both = ranges.load(spark, [f"{tmp_path}/*.wav", f"{tmp_path}/b"])
    assert both.rdd.getNumPartitions() == 1  # small files share a partition
    assert {r[0] for r in both.where(F.col("stream_id") == path).select("stream_id").distinct().collect()} == {path}
    assert both.where(F.col("stream_id") == path).rdd.getNumPartitions() == 1


def test_trim_reads_only_its_bytes(tmp_path, monkeypatch):
    path = f"{tmp_path}/long.s2"
    store.put(path, bytes(2_000_000))
    read = []
    whole = store.part
    monkeypatch.setattr(store, "part", lambda p, start, size: read.append(size) or whole(p, start, size))
    reader = ranges.SampleReader([path], ranges.Options("s2", 8000.0, 1, 100_000))
    assert len(reader.partitions()) == 20 and not read  # names and sizes alone
    list(reader.pushFilters([ranges.GreaterThanOrEqual(("n",), 400_000), ranges.LessThan(("n",), 460_000)]))
    parts = reader.partitions()
    assert [(s.start, s.end) for p in parts for s in p.parts] == [(800_000, 900_000), (900_000, 1_000_000)]
    rows = sum(b.num_rows for p in parts for b in reader.read(p))
    assert rows == 60_000 and sum(read) <= 3 * ranges.HEAD + 120_000


def test_a_long_file_is_read_in_buffers(tmp_path, monkeypatch):
    path = f"{tmp_path}/long.s2"
    store.put(path, np.arange(3_000_000, dtype="<i2").tobytes())
    most = []
    whole = store.part
    monkeypatch.setattr(store, "part", lambda p, start, size: most.append(size) or whole(p, start, size))
    reader = ranges.SampleReader([path], ranges.Options("s2", 8000.0, 1, 4_000_000))
    parts = reader.partitions()
    assert len(parts) == 2 and sum(b.num_rows for p in parts for b in reader.read(p)) == 3_000_000
    assert max(most) <= ranges.BUFFER


def test_facts_of_files(spark, tmp_path, monkeypatch):
    x = wave(spark)
    for kind in ("wav24", "aiff", "au", "dat"):
        files.save(x, f"{tmp_path}/{kind}", kind)
        got = ranges.facts(spark, f"{tmp_path}/{kind}", kind).first()
        assert (got["rate"], got["channels"], got["length"]) == (8000.0, 2, 1499)
    with pytest.raises(FileNotFoundError):
        ranges.facts(spark, f"{tmp_path}/nowhere/*.wav")
    files.save(wave(spark, 1, ["empty"]), f"{tmp_path}/m", "wav")
    store.put(f"{tmp_path}/m/none.s2", b"")
    assert ranges.load(spark, f"{tmp_path}/m/none.s2").count() == 0


def test_long_headers_and_rf64(tmp_path):
    a = np.stack([WAVE, -WAVE], axis=1)
    plain = formats.write_wav(a, 8000.0)
    note = b"LIST" + (100_000).to_bytes(4, "little") + bytes(100_000)
    late = plain[:12] + note + plain[12:]
    assert formats.layout(late[: ranges.HEAD], len(late)) is None  # decoded whole
    store.put(f"{tmp_path}/late.wav", late)
    reader = ranges.SampleReader([f"{tmp_path}/late.wav"], ranges.Options(None, None, None, 5000))
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 2 * len(WAVE)
    at = formats.layout(plain[: ranges.HEAD], len(plain))
    assert (at.start, at.length, at.frame) == (44, len(WAVE), 4)
    starts = [ranges.owned(at, k, k + 13) for k in range(0, len(plain), 13)]
    assert starts[0][0] == 0 and all(x[1] == y[0] for x, y in zip(starts, starts[1:])) and starts[-1][1] == len(WAVE)


@pytest.mark.parametrize("kind", ["wav", "wav24", "aiff", "au"])
def test_comments_in_headers(spark, tmp_path, kind):
    said = ["plain words", "Title=A name", "Artist=Someone é", "Odd=one"]
    x = Signal(wave(spark).df, 8000.0, 2, comments=said)
    files.save(x, str(tmp_path), kind)
    read = spark.read.format("binaryFile").load(f"{tmp_path}/a.{kind}")
    got = files.file_comments(read, kind).first()["comments"]
    assert got == said
    assert ranges.load(spark, f"{tmp_path}/a.{kind}", kind).count() == 2998
    if kind == "wav":
        a = formats.wav_with_comments(formats.write_wav(WAVE[:, None], 8000.0), ["x"])
        at = a.index(b"LIST")
        assert a[at : at + 22] == b"LIST" + (14).to_bytes(4, "little") + b"INFOICMT" + (2).to_bytes(4, "little") + b"x\0" and int.from_bytes(a[4:8], "little") == len(a) - 8
