"""A sweep by the cycle over samples beyond 32 bits and without a value, created and combined."""

import duckdb
import pytest

from conftest import DATA
from undula import queries
from undula.operators import synth


@pytest.fixture(scope="module")
def far(tmp_path_factory):
    folder, con = tmp_path_factory.mktemp("far"), duckdb.connect()
    value = "CASE event_id % 97 WHEN 0 THEN 1e11 WHEN 1 THEN -1e11 WHEN 2 THEN 700.5 WHEN 3 THEN NULL ELSE value END"
    con.execute(f"COPY (SELECT * REPLACE ({value} AS value) FROM '{DATA}/events.parquet') TO '{folder}/events.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW events AS FROM '{folder}/events.parquet'")
    return folder, con


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
def test_sweep_by_cycle_over_far_samples(spark, far):
    folder, con = far
    want = sorted(con.execute(f"SELECT stream_id, channel, n, s FROM ({queries.SQL['synth_sweep_cycle']})").fetchall())
    got = queries.QUERIES["synth_sweep_cycle"](spark, str(folder)).select("stream_id", "channel", "n", "s")
    assert len(want) == 1000 and sorted(tuple(r) for r in got.collect()) == want


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
def test_sweep_by_cycle_mixed_with_far_samples(spark, far):
    """What is combined is the sample itself, then clipped."""
    x = queries.events(spark, str(far[0]))
    tone = synth.synth(x, "sine", f=2.0, f2=20.0, sweep="-", length=100).df.withColumnRenamed("s", "tone")
    mixed = synth.synth(x, "sine", "mix", f=2.0, f2=20.0, sweep="-", length=100).df.withColumnRenamed("s", "mixed")
    rows = x.df.join(tone, ["stream_id", "channel", "n"]).join(mixed, ["stream_id", "channel", "n"]).collect()
    assert len(rows) == 1000 and {2**31 - 1, -(2**31)} <= {r["mixed"] for r in rows}
    for r in rows:
        if r["s"] is not None:
            assert abs(r["mixed"] - max(-(2**31), min(2**31 - 1, (r["tone"] + r["s"]) / 2))) <= 1


def test_phases_of_a_long_sweep():
    """To the last bit those of the SQL, over 2,000 places."""
    hz = "2 * exp((n + 1) * (ln(10.0::DOUBLE) / 100))"
    begun = f"b + CASE WHEN {hz} * ((n + 1) / 100.0::DOUBLE - b) >= 1 THEN 1 / ({hz}) ELSE 0 END"
    table = f"c AS (SELECT 0 AS n, 0.0::DOUBLE AS b, 0.0::DOUBLE AS p UNION ALL SELECT n + 1, {begun}, {hz} * ((n + 1) / 100.0::DOUBLE - ({begun})) FROM c WHERE n < 1999)"
    want = duckdb.connect().execute(f"WITH RECURSIVE {table} SELECT p FROM c ORDER BY n").fetchall()
    assert synth.cycle_phases(2000, 100.0, 2.0, 20.0, 100).tolist() == [r[0] for r in want]
    assert len(synth.cycle_phases(40_000, 100.0, 2.0, 20.0, 100)) == 40_000
