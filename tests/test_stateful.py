"""Operators in blocks: the same result however blocks are cut, in batch and over streams; voice detection by a plain loop."""

import math

import numpy as np
import pytest

from undula.operators import frames, sequential, stateful
from undula.signal import Signal

RATE = 8000.0


def samples(channels=2, places=3000, seed=3):
    """Bursts of tone and noise with rests in between."""
    rng = np.random.default_rng(seed)
    loud = np.repeat(rng.choice([0.0, 0.01, 0.4, 0.9], places // 100), 100)
    v = (np.sin(np.arange(places) * 0.3) + rng.normal(0, 0.2, (channels, places))) * loud * 0.6
    return np.clip(v * 2**31, -(2**31), 2**31 - 1).astype(np.int32)


def built():
    """An operator of each kind, caught on its way to blockwise."""
    made = {}

    class Caught(Exception):
        pass

    def take(name, f):
        def put(x, operator, **_):
            made[name] = operator
            raise Caught

        before, sequential.blockwise = sequential.blockwise, put
        try:
            f(Signal(None, RATE, 2))
        except Caught:
            pass
        finally:
            sequential.blockwise = before

    points = [(-60.0, -40.0), (-20.0, -15.0)]
    take("compand", lambda x: sequential.compand(x, [(0.01, 0.05)], points, 6.0))
    take("compand late", lambda x: sequential.compand(x, [(0.01, 0.05), (0.02, 0.03)], points, delay=0.02))
    take("mcompand", lambda x: sequential.mcompand(x, [{"times": [(0.01, 0.05)], "points": points}, {"times": [(0.02, 0.1)], "points": points}], [800.0]))
    take("flanger", lambda x: sequential.flanger(x, 1, 2, 30))
    take("flanger quadratic", lambda x: sequential.flanger(x, 1, 2, 30, interp="quadratic"))
    take("phaser", lambda x: sequential.phaser(x))
    take("reverb", lambda x: sequential.reverb(x, 50, pre_delay=3))
    take("tempo", lambda x: sequential.tempo(x, 1.3, 20, 4, 5))
    take("tempo fast", lambda x: sequential.tempo(x, 3.7, 20, 4, 5))
    take("tempo slow", lambda x: sequential.tempo(x, 0.6, 20, 4, 5))
    take("splice", lambda x: sequential.splice(x, [(200, 20, 30), (250, 15, 5), (1500, 0, 0), (2980, 10, 20), (5000, 3, 3)], "h"))
    take("bend", lambda x: sequential.bend(x, [(300, 300.0, 900)], 25, 8))
    take("silence", lambda x: sequential.silence(x, 1, (80, 0.05), 1, (200, 0.05)))
    take("silence within", lambda x: sequential.silence(x, 0, (0, 0.0), -1, (90, 0.05), leave=True))
    take("silence twice", lambda x: sequential.silence(x, 2, (50, 0.02), -2, (80, 0.02)))
    take("vad", lambda x: sequential.vad(x, 8.0, 0.05, 0.1, 0.02, 0.01, 0.02, frequency=100.0))
    made["noisered"] = frames.Gate(64, np.stack([np.linspace(-3, 1, 33), np.linspace(1, -3, 33)]))
    made["dither"] = stateful.Dither(8, [], [], False, 1, None)
    made["dither slope"] = stateful.Dither(8, [], [], True, 1, None)
    take("dither shaped", lambda x: sequential.dither(x, 10, "shibata"))
    take("dither automatic", lambda x: sequential.dither(x, 16, "shibata", automatic=True))
    return made


OPERATORS = built()


def in_blocks(operator, s, cuts):
    state = operator.start(len(s))
    out = [operator.flow(state, part) for part in np.split(s, cuts, axis=1)]
    return np.concatenate([p for p in (*out, operator.drain(state)) if p is not None], axis=1)


@pytest.mark.parametrize("name", OPERATORS)
def test_blocks_do_not_matter(name):
    s = samples()
    want = stateful.whole(OPERATORS[name], s)
    assert want.shape[1] > 0
    rng = np.random.default_rng(len(name))
    for cuts in (range(1, 3000), [0, 0, 1500, 1500], sorted(rng.integers(0, 3000, 12)), sorted(rng.integers(0, 3000, 400))):
        assert np.array_equal(in_blocks(OPERATORS[name], s, list(cuts)), want)


def rows_of(spark, streams):
    rows = [(k, c, n, int(v)) for k, s in streams.items() for c, row in enumerate(s) for n, v in enumerate(row)]
    return spark.createDataFrame(rows, "stream_id string, channel int, n bigint, s int")


def streams_of(df):
    out = {}
    for r in df.orderBy("stream_id", "channel", "n").collect():
        out.setdefault(r["stream_id"], {}).setdefault(r["channel"], []).append((r["n"], r["s"]))
    for channels in out.values():
        assert all([n for n, _ in v] == list(range(len(v))) for v in channels.values())
    return {k: [[s for _, s in v[c]] for c in sorted(v)] for k, v in out.items()}


def test_batches_of_rows(spark):
    """Streams of several Arrow batches and of a few samples, in one task or more."""
    streams = {"a": samples(2, 3000, 1), "b": samples(2, 200, 2), "c": samples(2, 100, 3)[:, :1], "d": samples(2, 900, 4)}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "333")
    try:
        x = Signal(rows_of(spark, streams).repartition(3), RATE, 2)
        for name in ("compand late", "dither shaped", "silence"):
            got = streams_of(stateful.blockwise(x, OPERATORS[name]).df)
            want = {k: stateful.whole(OPERATORS[name], s).tolist() for k, s in streams.items()}
            assert got == {k: v for k, v in want.items() if v[0]}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("name", ["compand late", "silence", "vad", "dither shaped"])
def test_streams_of_micro_batches(spark, tmp_path, name):
    streams = {"a": samples(2, 1200, 1), "b": samples(2, 700, 2)}
    whole = rows_of(spark, streams)
    # a cut within a wide sample, one micro-batch each, and the rows that end the streams
    parts = [whole.where("2 * n + channel < 501"), whole.where("2 * n + channel BETWEEN 501 AND 1100"), whole.where("2 * n + channel > 1100")]
    parts[-1] = parts[-1].unionByName(spark.createDataFrame([("a", 0, 1 << 40, None), ("b", 0, 1 << 40, None)], whole.schema))
    for k, part in enumerate(parts):
        part.coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    source = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    run = stateful.streamed(source, OPERATORS[name], 2).writeStream.option("checkpointLocation", f"{tmp_path}/state").format("parquet").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
    run.awaitTermination()
    assert len([p for p in run.recentProgress if p["numInputRows"]]) == 3
    got = streams_of(spark.read.parquet(f"{tmp_path}/out"))
    want = {k: stateful.whole(OPERATORS[name], s).tolist() for k, s in streams.items()}
    assert got == {k: v for k, v in want.items() if v[0]}


def test_user_operator_in_a_chain(spark):
    from undula.plans import chain

    class Difference:
        """s[n] - s[n-1], and the last sample once more."""

        def start(self, channels):
            return {"last": np.zeros((channels, 1), np.int32)}

        def flow(self, state, s):
            led = np.concatenate([state["last"], s], axis=1)
            state["last"] = led[:, -1:]
            return np.diff(led, axis=1)

        def drain(self, state):
            return state["last"]

    chain.USER["difference"] = Difference()
    try:
        x = Signal(rows_of(spark, {"a": samples(1, 100)[:, :50] // 4}), RATE, 1)
        s = [r["s"] for r in x.df.orderBy("n").collect()]
        got = [r["s"] for r in x.chain("difference").df.orderBy("n").collect()]
        assert got == [*np.diff(s, prepend=0).tolist(), s[-1]]
    finally:
        del chain.USER["difference"]


def test_a_held_block_is_bounded():
    """Ten million samples pass; what waits stays small."""
    for name, bound in {"compand late": 200, "vad": 40_000, "silence": 300, "silence within": 300}.items():
        operator, most = OPERATORS[name], 0
        state = operator.start(2)
        for k in range(20):
            operator.flow(state, np.full((2, 10_000), (k % 2) << 10, np.int32))
            most = max(most, state["held"].shape[1])
        assert most <= bound


def plain_vad(s, rate, o):
    """Where the output begins, by loops over frames and sums over samples; None without a trigger."""
    window, period = int(rate * o["duration"] + 0.5), int(rate / o["frequency"] + 0.5)
    size = 1 << (window - 1).bit_length()
    lo, hi = max(1, int(o["high"] / rate * size + 0.5)), min(size // 2, int(o["low"] / rate * size + 0.5))
    c0, c1 = math.ceil(rate / 2 / o["lifter_low"]), min(size // 4, math.floor(rate / 2 / o["lifter_high"]))
    hann = lambda k, n: (0.5 - 0.5 * math.cos(2 * math.pi * k / (n - 1))) * 2 / math.sqrt(n)
    fall = lambda seconds: math.exp(-1 / (seconds * o["frequency"]))
    level, floor, mean, measures = [0.0] * (hi - lo), [0.0] * (hi - lo), 0.0, []
    for k in range((len(s) - window) // period + 1 if len(s) >= window else 0):
        frame = [s[k * period + j] / 2**31 * hann(j, window) for j in range(window)]
        cleared = []
        for i, b in enumerate(range(lo, hi)):
            now = abs(sum(x * complex(math.cos(2 * math.pi * b * j / size), -math.sin(2 * math.pi * b * j / size)) for j, x in enumerate(frame)))
            boot = k < int(o["boot"] * o["frequency"] - 0.5) + 1
            w = k / (1 + k) if boot else fall(o["smoothing"])
            level[i] = level[i] * w + now * (1 - w)
            p = level[i] ** 2
            w = 0 if boot else fall(o["noise_up"]) if p > floor[i] else fall(0.01)
            floor[i] = floor[i] * w + p * (1 - w)
            cleared.append(math.sqrt(max(0, p - o["reduction"] * floor[i])) * hann(i, hi - lo))
        power = [abs(sum(x * complex(math.cos(4 * math.pi * q * (lo + i) / size), -math.sin(4 * math.pi * q * (lo + i) / size)) for i, x in enumerate(cleared))) ** 2 for q in range(c0, c1)]
        total = sum(power) / len(power)
        measures.insert(0, max(0, 21 + math.log(total)) if total else 0.0)
        mean = mean * fall(0.25) + measures[0] * (1 - fall(0.25))
        if mean >= o["trigger"]:
            kept = math.ceil(o["search"] * o["frequency"])
            recent = (measures + [0.0] * kept)[:kept]
            loud = [j for j, m in enumerate(recent) if m >= o["trigger"]]
            back = loud[0]
            for j in loud:
                back = j if j - back <= int(o["gap"] * o["frequency"] + 0.5) else back
                if j != back:
                    break
            while back < kept and recent[back] > 0:
                back += 1
            return max(0, k * period - back * period)
    return None


def test_vad_is_the_plain_loop(spark):
    from undula.queries import VOICE

    rng = np.random.default_rng(8)
    streams = {str(k): np.clip(rng.normal(0, 0.3, (1, 160)) * np.repeat([0, rng.random(), 1, 0.2], 40) * 2**31, -(2**31), 2**31 - 1).astype(np.int32) for k in range(12)}
    streams["quiet"] = np.zeros((1, 160), np.int32)
    for trigger in (6.0, 8.9, 9.3):
        o = VOICE | {"trigger": trigger, "smoothing": 0.3, "noise_up": 0.1, "reduction": 1.2}
        got = streams_of(sequential.vad(Signal(rows_of(spark, streams), 100.0, 1), **o).df)
        begins = {k: plain_vad(s[0].tolist(), 100.0, o) for k, s in streams.items()}
        assert got == {k: [streams[k][0, b:].tolist()] for k, b in begins.items() if b is not None}
        assert 0 < len(got) < len(streams), trigger
