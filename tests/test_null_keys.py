"""Events without a time, or without a user: the 13 queries of round 3's findings on events, in every row."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import DATA
from undula import queries
from undula.operators import scan
from undula.signal import Signal

FILTERS = ["allpass", "allpass_1", "allpass_2", "band", "bandpass", "bandpass_skirt", "bandreject"]
NAMES = [*FILTERS, "bits_16", "bits_24", "bits_8", "chain", "contrast", "dcshift"]
NOBODY = 10**9

needs_tables = pytest.mark.skipif(not DATA.exists(), reason="no tables")


def table(folder, **changed):
    columns = ", ".join(f"CASE WHEN {rows} THEN {to} ELSE {c} END AS {c}" for c, (rows, to) in changed.items())
    duckdb.execute(f"COPY (SELECT * REPLACE ({columns}) FROM '{DATA}/events.parquet') TO '{folder}/events.parquet' (FORMAT parquet)")
    return str(folder)


def rows(df):
    return sorted(tuple(r) for r in df.withColumn("stream_id", F.coalesce("stream_id", F.lit(str(NOBODY)))).select("stream_id", "channel", "n", "s").collect())


@pytest.fixture(scope="module")
def untimed(tmp_path_factory):
    return table(tmp_path_factory.mktemp("untimed"), ts=("event_id % 7 = 3", "NULL"))


@pytest.fixture(scope="module")
def unnamed(tmp_path_factory):
    """The same events of nobody, once without a user and once with one of a name of its own."""
    return [table(tmp_path_factory.mktemp("unnamed"), user_id=("event_id % 9 = 4", to)) for to in ("NULL", str(NOBODY))]


@needs_tables
@pytest.mark.parametrize("name", NAMES)
def test_events_without_time_come_last(spark, untimed, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS FROM '{untimed}/events.parquet'")
    want = con.execute(f"SELECT stream_id, channel, n, s FROM ({queries.SQL[name]})").fetchall()
    assert want and rows(queries.QUERIES[name](spark, untimed)) == sorted(want)


@needs_tables
@pytest.mark.parametrize("name", NAMES)
def test_events_without_user_are_one_stream(spark, unnamed, name):
    got, want = (rows(queries.QUERIES[name](spark, d)) for d in unnamed)
    assert sum(r[0] == str(NOBODY) for r in want) > 100 and got == want


def test_state_carried_in_stream_without_name(spark):
    """A filter over several blocks of a stream without a name, beside one with a name."""
    v = np.random.default_rng(5).normal(0, 1, 100)
    df = spark.createDataFrame([(s, 0, k, float(u)) for s in (None, "a") for k, u in enumerate(v)], "stream_id string, channel int, n bigint, v double")
    b, a = [0.3, 0.2, 0.1], [1.0, -0.9, 0.4]
    got = {(r["stream_id"], r["n"]): r["y"] for r in scan.recursive_by_channel(df, b, a, block=16).collect()}
    want = scan.recurse(b, a, v)
    assert len(got) == 200 and all(np.isclose([got[s, k] for k in range(100)], want).all() for s in (None, "a"))


def test_length_of_stream_without_name(spark):
    x = Signal(spark.createDataFrame([(None, 0, 0, 1), (None, 0, 1, 2), ("a", 0, 0, 3)], "stream_id string, channel int, n bigint, s int"))
    assert sorted((r["s"], r["length"]) for r in x.with_length().collect()) == [(1, 2), (2, 2), (3, 1)]
