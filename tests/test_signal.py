"""Kernels against plain loops, inverses, parsers, formats and streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from undula.functions import design, laws
from undula.operators import combine, maps, rows, scan, sequential, stateful, synth, windows
from undula.plans import chain, parse
from undula.signal import Signal
from undula.sources import files, formats, pcm


def signal(spark, data, rate=8000.0):
    a = np.atleast_2d(np.asarray(data))
    rows_ = [("a", c, n, int(a[c, n])) for c in range(a.shape[0]) for n in range(a.shape[1])]
    return Signal(spark.createDataFrame(rows_, "stream_id string, channel int, n bigint, s int"), rate, a.shape[0], 16)


def values(x):
    got = x.df.orderBy("channel", "n").collect()
    c = max(r["channel"] for r in got) + 1
    return np.array([[r["s"] for r in got if r["channel"] == k] for k in range(c)])


@pytest.fixture(scope="module")
def wave():
    return (np.random.default_rng(1).integers(-(1 << 30), 1 << 30, (2, 300)) >> 16) << 16


def test_recursion_is_the_loop():
    x = np.random.default_rng(2).normal(size=1000)
    b, a = [0.3, 0.2, 0.1], [1.0, -1.2, 0.5]
    y, want = scan.recurse(b, a, x), []
    for n in range(len(x)):
        want.append(sum(b[k] * x[n - k] for k in range(3) if n >= k) - sum(a[k] * want[n - k] for k in (1, 2) if n >= k))
    assert np.allclose(y, want, atol=1e-12)


def test_blocks_are_one_channel(spark, wave):
    x = signal(spark, wave)
    c = design.biquad("lowpass", 8000, 1000)
    rows_ = x.df.selectExpr("stream_id", "channel", "n", "double(s) v")
    got = scan.recursive_by_channel(rows_, list(c[:3]), list(c[3:]), block=37).where("channel = 0").orderBy("n").toPandas()["y"].to_numpy()
    assert np.allclose(got, scan.recurse(c[:3], c[3:], wave[0].astype(float)), rtol=1e-9, atol=1e-3)


def test_long_kernel_in_blocks(spark, wave):
    h = np.cos(np.arange(151) * 0.3) / 50
    x = signal(spark, wave)
    got = windows.convolve_blocks(x, h, 75, block=64).where("channel = 1").orderBy("n").toPandas()["y"].to_numpy()
    assert np.allclose(got, np.convolve(wave[1], h)[75 : 75 + 300], rtol=1e-6, atol=1)


def test_inverses(spark, wave):
    x = signal(spark, wave)
    for y in (rows.reverse(rows.reverse(x)), maps.swap(maps.swap(x)), maps.downsample(maps.upsample(x, 3), 3), rows.trim(rows.pad(x, 5, 7), [5, 305])):
        assert (values(y) == wave).all()


def test_trim_reaches_the_scan(spark, wave, tmp_path):
    signal(spark, wave).df.write.parquet(str(tmp_path / "x"))
    x = Signal(spark.read.parquet(str(tmp_path / "x")), 8000.0, 2)
    plan = rows.trim(x, [10, 20]).df._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(n), GreaterThanOrEqual(n,10), LessThan(n,20)]" in plan


def test_linear(spark, wave):
    half = combine.mix([signal(spark, wave // 4), signal(spark, wave // 4)], 1.0)
    assert (values(half) == 2 * (wave // 4)).all()


def test_generator_by_doubling():
    x, want = 1, []
    for _ in range(1000):
        x = (1664525 * x + 1013904223) % (1 << 32)
        want.append(x - (1 << 32) if x >> 31 else x)
    assert stateful.lcg(1, 1000).tolist() == want


def test_resampled_tone(spark):
    n = np.arange(2000)
    x = signal(spark, np.rint(np.sin(2 * np.pi * 440 * n / 8000) * (1 << 30)).astype(int))
    for quality in "lmhv":
        y = values(x.effect("rate", f"-{quality}", 12000))[0]
        m = np.arange(len(y))
        assert len(y) == 3000
        assert np.abs(y - np.sin(2 * np.pi * 440 * m / 12000) * (1 << 30))[400:-400].max() < (1 << 30) * 1e-3


@pytest.mark.parametrize("text", ["vol 3dB", "norm -1", "dcshift 0.1", "remix 1,2", "channels 1", "fade t 0.001", "lowpass 500", "bass 3", "treble -3", "equalizer 800 1q 6", "band 500", "bandpass -c 500 100", "allpass 500 100", "sinc -t 400 1k", "hilbert -n 31", "compand 0.01,0.05 -60,-40,-20", "flanger", "phaser 0.6 0.6 3 0.4 2 -t", "reverb 30", "tempo 1.2 10 2 2", "pitch 100", "bend 0.005,200,0.01", "splice 0.02,0.002,0.001", "silence 1 0.001 1%", "vad", "dither -p 8", "dither -s -p 8", "overdrive 10", "echo 0.8 0.8 5 0.4", "echos 0.8 0.8 5 0.4", "chorus 0.7 0.7 25 0.4 2 2 -s", "stretch 1.2 5", "synth sine mix 440", "synth pluck 440", "tremolo 5 40", "repeat 1", "delay 0 0.001", "contrast", "speed 1.5", "downsample 2", "oops", "divide", "swap", "mcompand '0.01,0.1 -40,-30' 800 '0.01,0.1 -40,-35'", "trim 0 =0.02", "firfit 20 0 4000 -3", "silence -l 1 0.001 1% 1 0.002 1%", "vad -t 3 -f 50 -m 0.01 -s 0.2", "gain -b", "gain -h", "dither -a -p 8", "synth sine 300-3000", "rate -s -L 6000", "rate -b 80 -v 6000", "rate -M 4000", "rate -I -b 85 6000", "rate -a -p 40 4000", "rate 700", "allpass -1 500", "allpass -2 500"])
def test_chain(spark, wave, text):
    y = signal(spark, wave).chain(text)
    assert y.df.count() >= 0
    assert {r["channel"] for r in y.df.select("channel").distinct().collect()} <= set(range(max(1, y.channels)))


def test_unknown_and_user_operators(spark, wave):
    with pytest.raises(ValueError):
        signal(spark, wave).effect("nothing")
    chain.register("half", lambda v: v / 2)
    assert (values(signal(spark, wave).chain("half")) == wave // 2).all()


@pytest.mark.parametrize("text", ["rate -p 101 4000", "rate -a -b 80 4000", "rate -l -M 4000", "rate -b 50 4000", "rate -q -s 4000", "dither -f low-shibata", "dither -f nothing", "dither -q", "noisered 0.3", "noiseprof", "spectrogram", "vad -x 3", "vad -t", "gain -n -r", "gain -e -b", "bandpass -1 500"])
def test_options_that_cannot_be_met_are_errors(spark, wave, text):
    with pytest.raises(ValueError):
        signal(spark, wave).chain(text).df.count()


def test_noisered_in_a_chain(spark, wave, tmp_path):
    from undula.operators import frames

    x = signal(spark, wave)
    frames.noise_profile(x, 64).write.parquet(str(tmp_path / "profile"))
    got = x.chain(f"noisered {tmp_path}/profile 0.3")
    want = frames.noise_reduce(x, frames.noise_profile(x, 64), 0.3, 64)
    assert (values(got) == values(want)).all()


def test_headroom_and_balance(spark):
    a = np.stack([tone(440, 400, level=0.5), tone(300, 400, level=0.1)])
    x = signal(spark, a)
    back = x.chain("gain -h -6 gain -r")
    assert np.abs(values(back) - a).max() <= 1 and back.headroom == 1.0
    loud = values(x.chain("gain -h -6 vol 1.8 gain -r"))
    assert abs(np.abs(loud).max() - 0.9 * (1 << 31)) < 1 << 24
    assert np.abs(values(x.chain("gain -h -6 vol 3 gain -r"))).max() >= 2147483600  # as far as nothing clips
    peak = np.abs(values(x.chain("gain -b"))).max(1)
    power = np.sqrt((values(x.chain("gain -b")).astype(float) ** 2).mean(1))
    assert peak.max() <= 2147483647 and abs(power[0] / power[1] - 1) < 1e-6
    spiky = a.copy()
    spiky[1, 5] = 1 << 30
    balanced = values(signal(spark, spiky).chain("gain -b")).astype(float)
    assert np.abs(balanced).max() >= 2147483600 and abs(np.sqrt((balanced[0] ** 2).mean() / (balanced[1] ** 2).mean()) - 1) < 1e-3


def test_long_gap_of_silence(spark):
    from undula.operators.rows import ZEROS

    x = rows.pad(signal(spark, np.arange(1, 11)), 3 * ZEROS + 5)
    got = values(x)[0]
    assert len(got) == 3 * ZEROS + 15 and not got[:-10].any() and (got[-10:] == np.arange(1, 11)).all()


def test_chain_targets(spark, wave):
    y = chain.run(signal(spark, wave), "gain -3", rate=4000.0, channels=1, dither_to=16)
    assert (y.rate, y.channels, y.precision) == (4000.0, 1, 16)


def test_times():
    cases = {"1": 10000, "0.5": 5000, "12s": 12, "1:30": 900000, "1:00:00": 36000000, "1+0.5": 15000, "1-2": 0, "1e3s": 1000, ".25": 2500, "2t": 20000, "3-12s": 29988}
    assert {k: parse.samples(k, 10000) for k in cases} == cases
    assert parse.position("-1", 10, length=25) == 15
    with pytest.raises(ValueError):
        parse.position("-1", 10)
    assert parse.frequency("A4") == 440 and parse.frequency("1.5k") == 1500 and round(parse.frequency("%12")) == 880


def test_laws_invert():
    for t in (laws.alaw_table(), laws.ulaw_table()):
        assert (t[laws.nearest_code(t, t)] == t).all()


@pytest.mark.parametrize("kind", [k for k, f in formats.FORMATS.items() if f.read and f.write and k not in ("null", "cdda", "cdr", "ima", "vox", "cvsd", "cvs", "cvu", "dvms", "vms", "al", "ul", "la", "lu", "gsrt", "prc", "wve", "wav_alaw", "wav_ulaw")])
def test_format(kind):
    f = formats.FORMATS[kind]
    c = f.channels or 2
    a = np.random.default_rng(3).integers(-(1 << 31), 1 << 31, (101, c))
    step = 1 << (32 - f.bits)
    a = np.clip(a, -(1 << 31), (1 << 31) - step) // step * step
    rate, back, bits = f.read(f.write(a.astype(np.int32), f.rate or 8000.0))
    back = formats.wide(formats.flat(back), c)
    assert (back == a).all() and bits == f.bits
    assert formats.detect(f.write(a.astype(np.int32), 8000.0), f"x.{kind}") in formats.FORMATS


@pytest.mark.parametrize("kind", ["al", "ul", "la", "lu", "wve", "gsrt", "prc", "ima", "vox"])
def test_lossy_format(kind):
    a = np.rint(np.sin(np.arange(400) / 15) * (1 << 29)).astype(np.int32)[:, None]
    f = formats.FORMATS[kind]
    back = f.read(f.write(a, 8000.0))[1]
    assert np.sqrt(np.mean((back[:400].astype(float) - a) ** 2)) < (1 << 29) * 0.06


@pytest.mark.parametrize("kind", ["cvsd", "dvms"])
def test_delta_modulation(kind):
    a = np.rint(np.sin(np.arange(800) / 40) * (1 << 29)).astype(np.int32)[:, None]
    f = formats.FORMATS[kind]
    back = f.read(f.write(a, 8000.0))[1]
    assert np.corrcoef(back[100:800, 0], a[100:, 0])[0, 1] > 0.9


def test_integer_edges():
    s = np.array([0, 1, 2147483647, -2147483648, -2147483647, -1, 1 << 23, (1 << 23) - 1])
    assert pcm.bytes_int(pcm.int_bytes(s, 8), 8).tolist() == [0, 0, 127 << 24, -128 << 24, -128 << 24, 0, 1 << 24, 0]


def test_files(spark, wave, tmp_path):
    (tmp_path / "b.wav").write_bytes(formats.write_wav(wave.T.astype(np.int32), 8000.0))
    (tmp_path / "l.m3u").write_text("# list\nb.wav\n")
    x = files.read(spark, str(tmp_path / "l.m3u"))
    assert (values(x) == wave).all() and x.rate == 8000.0 and x.channels == 2


def test_stream_is_the_batch(spark, wave, tmp_path):
    from undula.streaming import windows as stream

    x = signal(spark, wave)
    src = str(tmp_path / "in")
    for k in range(3):
        x.df.where(f"n >= {k * 100} and n < {k * 100 + 100}").withColumn("ts", F.expr("timestamp_seconds(n)")).coalesce(1).write.mode("append").parquet(src)
    schema = spark.read.parquet(src).schema
    c = design.biquad("lowpass", 8000, 1000)
    q = stream.recursive(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src), list(c[:3]), list(c[3:])).writeStream.format("memory").queryName("filtered").outputMode("append").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = spark.sql("SELECT y FROM filtered WHERE channel = 0 ORDER BY n").toPandas()["y"].to_numpy()
    assert len(got) == 300


def test_silence_and_tones(spark):
    assert synth.silent(spark, 10, 8000.0, 2).df.count() == 20
    y = synth.synth(synth.silent(spark, 8000, 8000.0), "sine", f=440.0)
    a = np.abs(np.fft.rfft(values(y)[0]))
    assert a.argmax() == 440


@pytest.mark.parametrize("code, name", [(23, "G.721"), (25, "G.723"), (26, "G.723"), (99, "99")])
def test_au_codes_that_are_not_covered(code, name):
    with pytest.raises(ValueError, match=f"{name}.*not covered"):
        formats.read_au(b".snd" + np.array([24, 4, code, 8000, 1], ">u4").tobytes() + b"\0\0\0\0")


# --- operators without SQL, by what they do to tones, impulses and silence ---


def tone(hz, n, rate=8000.0, level=0.25, start=0):
    return np.rint(np.sin(2 * np.pi * hz * (np.arange(n) + start) / rate) * level * (1 << 31)).astype(np.int64)


def pitch_of(v, rate=8000.0):
    w = np.abs(np.fft.rfft(v * np.hanning(len(v)), 1 << 16))
    return w.argmax() * rate / (1 << 16)


def level_at(v, hz, rate):
    n = np.arange(len(v))
    return 20 * np.log10(2 * abs(np.exp(-2j * np.pi * hz * n / rate) @ v) / len(v))


@pytest.mark.parametrize("hz, want", [(50, 0.0), (1000, -6.0), (2000, -12.0)])
def test_firfit_meets_its_knots(spark, hz, want):
    x = signal(spark, tone(hz, 12_000))
    y = values(windows.firfit(x, [(20, 0.0), (100, 0.0), (1000, -6.0), (2000, -12.0), (4000, -12.0)]))[0]
    assert abs(level_at(y[2000:10_000] / 2**31, hz, 8000) - level_at(tone(hz, 8000) / 2**31, hz, 8000) - want) < 0.3


def test_loudness_lowers_the_middle_most(spark):
    change = {}
    for hz in (100, 1000, 3000):
        y = values(windows.loudness(signal(spark, tone(hz, 8000)), -10))[0]
        change[hz] = level_at(y[2000:6000] / 2**31, hz, 8000) - level_at(tone(hz, 4000) / 2**31, hz, 8000)
    assert abs(change[1000] + 10) < 0.3 and change[100] > change[1000] + 2


def test_mcompand_of_unit_gain_keeps_levels(spark):
    same = {"times": [(0.01, 0.1)], "points": [(-90.0, -90.0), (-40.0, -40.0)]}
    for hz in (100, 3000):
        y = values(sequential.mcompand(signal(spark, tone(hz, 4000)), [same, same], [800.0]))[0]
        assert abs(level_at(y[1000:] / 2**31, hz, 8000) - level_at(tone(hz, 3000) / 2**31, hz, 8000)) < 0.1
    quiet = {"times": [(0.001, 0.1)], "points": [(-90.0, -110.0), (0.0, -20.0)]}
    y = values(sequential.mcompand(signal(spark, tone(100, 4000) + tone(3000, 4000)), [quiet, same], [800.0]))[0] / 2**31
    base = (tone(100, 4000) + tone(3000, 4000)) / 2**31
    assert abs(level_at(y[1000:], 100, 8000) - level_at(base[1000:], 100, 8000) + 20) < 0.5 and abs(level_at(y[1000:], 3000, 8000) - level_at(base[1000:], 3000, 8000)) < 0.3


def test_reverb_of_an_impulse(spark):
    a = np.zeros(3000, np.int64)
    a[0] = 1 << 30
    y = values(sequential.reverb(signal(spark, a), 50))
    first = int(min(sequential.COMBS) * 8000 / 44100)
    assert y.shape == (2, 3000) and abs(y[0, 0] - (1 << 30)) < 256 and not y[:, 1 : first - 60].any() and y[0, first:].any() and (y[0] != y[1]).any()
    double = values(sequential.reverb(signal(spark, a // 2), 50))
    assert np.abs(y - 2 * double).max() < 512


def test_tempo_keeps_the_pitch_and_pitch_the_length(spark):
    x = signal(spark, tone(440, 8000))
    fast = values(sequential.tempo(x, 1.25))[0]
    assert len(fast) == 6400 and abs(pitch_of(fast) - 440) < 3
    high = values(sequential.pitch(x, 700))[0]
    assert abs(len(high) - 8000) <= 2 and abs(pitch_of(high[500:-500]) - 440 * 2 ** (7 / 12)) < 4


def test_bend_from_one_pitch_to_another(spark):
    y = values(sequential.bend(signal(spark, tone(440, 16_000)), [(6000, 500.0, 8000)]))[0]
    assert len(y) == 16_000 and abs(pitch_of(y[500:5000]) - 440) < 4 and abs(pitch_of(y[10_000:]) - 440 * 2 ** (5 / 12)) < 8


def test_silence_is_cut(spark):
    quiet, loud = np.zeros(2000, np.int64), tone(500, 4000, level=0.5)
    x = signal(spark, np.concatenate([quiet, loud, quiet, loud]))
    start = values(sequential.silence(x, 1, (80, 0.05)))[0]
    assert abs(len(start) - 10_000) < 160 and (start[-4000:] == loud).all()
    both = values(sequential.silence(x, 1, (80, 0.05), 1, (400, 0.05)))[0]
    assert abs(len(both) - 4000) < 320
    left = values(sequential.silence(x, 1, (80, 0.05), 1, (400, 0.05), leave=True))[0]
    assert len(left) == len(both) + 400
    inner = values(sequential.silence(x, 0, (0, 0.0), -1, (400, 0.05)))[0]
    assert len(inner) < 12_000 - 2000


def test_vad_finds_the_voice(spark):
    rng = np.random.default_rng(4)
    noise = rng.normal(0, 0.001, 12_000)
    voice = sum(np.sin(2 * np.pi * 150 * k * np.arange(8000) / 8000) / k for k in range(1, 12)) * 0.1
    noise[4000:] += voice
    y = values(sequential.vad(signal(spark, np.rint(noise * (1 << 31)).astype(np.int64)), before=0.1))[0]
    assert 8000 <= len(y) <= 10_500
    for quiet in (np.zeros(4000, np.int64), np.rint(rng.normal(0, 0.001, 12_000) * (1 << 31)).astype(np.int64)):
        assert sequential.vad(signal(spark, quiet)).df.count() == 0
    assert [stateful.onset(np.array([*m, *[0] * (8 - len(m))]), 7.0, 2) for m in ([8, 8, 1, 8, 0, 0, 9], [8, 3, 3, 3, 8], [8, 3, 0, 8, 8, 8, 8, 8])] == [4, 5, 2]


def test_noise_is_reduced(spark):
    from undula.operators import frames

    rng = np.random.default_rng(5)
    noise = rng.normal(0, 0.01, 16_000)
    x = signal(spark, np.rint(np.concatenate([noise[:8000], noise[8000:] + tone(700, 8000) / 2**31]) * 2**31).astype(np.int64))
    profile = frames.noise_profile(Signal(x.df.where("n < 8000"), 8000.0), 512)
    y = values(frames.noise_reduce(x, profile, 0.3, 512))[0] / 2**31
    assert np.std(y[1000:7000]) < 0.5 * np.std(noise[1000:7000])
    assert abs(level_at(y[10_000:15_000], 700, 8000) - level_at(tone(700, 5000) / 2**31, 700, 8000)) < 0.5


@pytest.mark.parametrize("kind, least", [("ima", 25), ("vox", 20), ("cvsd", 4), ("dvms", 4)])
def test_adaptive_formats_keep_a_tone(spark, kind, least):
    x = signal(spark, (tone(200, 4000) >> 16) << 16)
    y = values(Signal(files.decode_files(files.encode_streams(x, kind), kind, 8000.0, 1)))[0][:4000] / 2**31
    a = tone(200, 4000) / 2**31
    late = max(range(40), key=lambda k: y[600 + k : 3600 + k] @ a[600:3600])
    part, whole = y[600 + late : 3600 + late], a[600:3600]
    part = part * (part @ whole / (part @ part))
    assert 10 * np.log10((whole**2).sum() / ((whole - part) ** 2).sum()) > least


def test_one_channel_of_many_blocks(spark):
    """A long channel, cut into blocks, against the loop over all of it."""
    v = np.random.default_rng(9).integers(-(1 << 24), 1 << 24, 3000)
    x = signal(spark, np.stack([v, -v]))
    for b, a in (([0.2, 0.1, 0.05], [1.0, -1.1, 0.4]), ([1.0], [1.0, -0.9]), ([0.5, 0.5], [1.0])):
        got = scan.recursive_by_channel(x.df.selectExpr("stream_id", "channel", "n", "double(s) v", "s"), b, a, block=64, keep="s").orderBy("channel", "n").toPandas()
        want = scan.recurse(b, a, v.astype(float))
        assert np.allclose(got["y"], np.concatenate([want, -want]), rtol=1e-9, atol=1e-6) and (got["s"] == np.concatenate([v, -v])).all()


@pytest.mark.parametrize("shape, rate", [(k, r) for k, rows in sequential.SHAPES.items() for r in rows])
def test_shaped_dither_moves_noise_out_of_the_ear(spark, shape, rate):
    """The error is within a few steps, has no offset, and its spectrum is the shaper's."""
    a = tone(1000, 6000, rate, 0.2)
    y = values(sequential.dither(signal(spark, a, float(rate)), 10, shape, strict=True))[0]
    e = (y - a) / (1 << 22)
    assert np.abs(e).max() < 60 and abs(e.mean()) < 0.3 and not (y % (1 << 22)).any()
    plain = (values(sequential.dither(signal(spark, a, float(rate)), 10))[0] - a) / (1 << 22)
    part = lambda v: np.abs(np.fft.rfft(v * np.hanning(len(v))))[: int(len(v) * 4000 / rate)][20:]
    gain = 20 * np.log10(np.sqrt((part(e) ** 2).mean() / (part(plain) ** 2).mean()))
    taps = sequential.shaper(shape, rate)
    w = np.exp(-2j * np.pi * np.linspace(50, 4000, 400)[:, None] / rate * np.arange(1, 21))
    b, c = (taps[:4], taps[4:]) if shape == "gesemann" else (taps, [])
    h = 1 - (w[:, : len(b)] @ np.array(b)) / (1 + (w[:, : len(c)] @ np.array(c) if c else 0))
    want = 20 * np.log10(np.sqrt((np.abs(h) ** 2).mean()))
    assert abs(gain - want) < 2.5


def test_automatic_dither_rests(spark):
    exact = (np.arange(-300, 300) << 20).astype(np.int64)
    x = signal(spark, exact)
    assert (values(sequential.dither(x, 12, automatic=True))[0] == exact).all()
    exact[100] += 12345
    y = values(sequential.dither(signal(spark, exact), 12, automatic=True))[0]
    assert (y[:100] == exact[:100]).all() and (y[164:] == exact[164:]).all() and (y[100:164] != exact[100:164]).any()


# --- bytes laid out by hand ---


def golden():
    import struct

    ramp = [0, 1, -1, 32767, -32768, 256]
    wide = [v << 16 for v in ramp]
    le, be = struct.pack("<6h", *ramp), struct.pack(">6h", *ramp)
    fmt = lambda e, code, ch, rate, bits: struct.pack(e + "HHIIHH", code, ch, rate, rate * ch * bits // 8, ch * bits // 8, bits)
    extensible = fmt("<", 0xFFFE, 1, 8000, 24) + struct.pack("<HHI", 22, 24, 4) + struct.pack("<H", 1) + bytes.fromhex("000000001000800000aa00389b71")
    comm = struct.pack(">HIH", 2, 3, 16) + bytes.fromhex("400bfa00000000000000")  # 8000 Hz as an 80-bit number
    prc = bytes.fromhex("37000010 6d000010 7e000010 cfac0855 14000000 04 52000010 34000000 89000010 25000000 7e000010") + b"\x2aRecord.app"
    return [
        ("wav", b"RIFF" + struct.pack("<I", 48) + b"WAVEfmt " + struct.pack("<I", 16) + fmt("<", 1, 1, 8000, 16) + b"data" + struct.pack("<I", 12) + le, 8000.0, 1, wide),
        ("wav", b"RIFF" + struct.pack("<I", 60) + b"WAVELIST" + struct.pack("<I", 3) + b"abc\0fmt " + struct.pack("<I", 16) + fmt("<", 1, 2, 8000, 16) + b"data" + struct.pack("<I", 12) + le, 8000.0, 2, wide),
        ("wav", b"RIFX" + struct.pack(">I", 48) + b"WAVEfmt " + struct.pack(">I", 16) + fmt(">", 1, 1, 8000, 16) + b"data" + struct.pack(">I", 12) + be, 8000.0, 1, wide),
        ("wav", b"RIFF" + struct.pack("<I", 78) + b"WAVEfmt " + struct.pack("<I", 40) + extensible + b"data" + struct.pack("<I", 6) + bytes.fromhex("010000ffffff"), 8000.0, 1, [256, -256]),
        ("wav", b"RIFF" + struct.pack("<I", 38) + b"WAVEfmt " + struct.pack("<I", 16) + fmt("<", 1, 1, 8000, 8) + b"data" + struct.pack("<I", 3) + bytes([128, 0, 255]) + b"\0", 8000.0, 1, [0, -(1 << 31), 127 << 24]),
        ("au", b".snd" + struct.pack(">5I", 24, 12, 3, 8000, 1) + be, 8000.0, 1, wide),
        ("au", b".snd" + struct.pack(">5I", 32, 0xFFFFFFFF, 1, 8000, 1) + b"note\0\0\0\0" + bytes([0xFF, 0x80, 0x00]), 8000.0, 1, [0, 32124 << 16, -32124 << 16]),
        ("au", b"dns." + struct.pack("<5I", 24, 8, 6, 8000, 1) + struct.pack("<2f", 0.5, -0.25), 8000.0, 1, [1 << 30, -(1 << 29)]),
        ("aiff", b"FORM" + struct.pack(">I", 58) + b"AIFFCOMM" + struct.pack(">I", 18) + comm + b"SSND" + struct.pack(">3I", 20, 0, 0) + be, 8000.0, 2, wide),
        ("prc", prc.ljust(0x34, b"\0") + struct.pack("<IIHBBII", 2, 0, 0, 3, 0, 0, 2) + bytes([0xD5, 0x55]), 8000.0, 1, [8 << 16, -8 << 16]),
        ("sln", le, 8000.0, 1, wide),
        ("u1", bytes([0, 128, 255]), 8000.0, 1, [-(1 << 31), 0, 127 << 24]),
    ]


@pytest.mark.parametrize("k", range(12))
def test_golden_bytes(k):
    kind, raw, rate, channels, want = golden()[k]
    r, a, _ = formats.FORMATS[kind].read(raw)
    assert (r, a.shape[1], a.reshape(-1).tolist()) == (rate, channels, want)
    if raw[:4] in formats.HEADERS:
        told = formats.HEADERS[raw[:4]](raw, len(raw))
        assert (told.rate, told.channels, told.length) == (rate, channels, len(want) // channels)
        assert told.decode(raw[told.start : told.start + told.length * told.frame]).reshape(-1).tolist() == want


def test_facts_from_headers(spark, wave):
    x = signal(spark, wave)
    for kind in ("wav", "wav24", "wav_float", "wav_ulaw", "aiff", "aifc", "aifc_float", "au", "8svx", "sph", "native"):
        files_ = files.encode_streams(x, kind)
        r = files.file_facts(files_).first()
        rate, a, bits = formats.FORMATS[kind].read(bytes(files_.first()["content"]))
        assert (r["rate"], r["channels"], r["length"], r["bits"]) == (rate, a.shape[1], len(a), bits)


def test_comments(spark, wave):
    from dataclasses import replace

    from undula.plans import comments

    own = comments.appended(["Title=One"], "artist=Someone\nsecond line")
    assert own == ["Title=One", "artist=Someone", "second line"] and comments.find(own, "ARTIST") == "Someone" and comments.find(own, "second") is None and comments.joined(own).count("\n") == 2
    x = replace(signal(spark, wave), comments=own)
    for kind in ("au", "aiff", "aifc", "wav"):
        made = files.encode_streams(x, kind)
        assert files.file_comments(made).first()["comments"] == own
        assert (values(Signal(files.decode_files(made, kind))) == wave).all() and files.file_facts(made).first()["length"] == 300


def test_replay_gain_and_ignored_length(spark, wave):
    from dataclasses import replace

    x = replace(signal(spark, wave), comments=["REPLAYGAIN_TRACK_GAIN=-6.00 dB", "x=y"])
    assert (values(combine.replay_gain(x)) == values(maps.gain(x, -6.0))).all() and (values(combine.replay_gain(x, "album")) == wave).all()
    made = files.encode_streams(replace(x, comments=[]), "wav").withColumn("content", F.expr("concat(substring(content, 1, 40), X'0A000000', substring(content, 45))"))
    assert files.decode_files(made, "wav").where("channel = 0").count() < 10
    assert (values(Signal(files.decode_files(made, "wav", ignore_length=True))) == wave).all()
