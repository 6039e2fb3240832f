"""Operators whose state depends on its own past in ways that are not linear.

Work is spread over streams. Those whose state is bounded run in blocks (see stateful); the kernels of the others get a stream's
samples as an array of (channels, places) in units of full scale and give such an array back.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import design, draws
from ..functions.numeric import FULL
from ..signal import LAYOUT, Signal
from . import stateful
from .stateful import blockwise, shipped, to_samples


def by_stream(x: Signal, kernel: Callable[[np.ndarray], np.ndarray], channels: int | None = None, rate: float | None = None, cut: bool = False) -> Signal:
    """kernel over all channels of a stream together."""
    kernel = shipped(kernel)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot(index="n", columns="channel", values="s").fillna(0).sort_index()
        y = np.atleast_2d(kernel(wide.to_numpy(float).T / FULL))
        c, n = y.shape
        return pd.DataFrame({"stream_id": pdf["stream_id"].iat[0], "channel": np.repeat(np.arange(c, dtype=np.int32), n), "n": np.tile(np.arange(n), c), "s": to_samples(y, cut).ravel()})

    return x.with_df(x.df.groupBy("stream_id").applyInPandas(run, LAYOUT), channels=channels or x.channels, rate=rate or x.rate, precision=32)


# --- dynamics ---


def transfer(points: list[tuple[float, float]], knee: float = 0.0, post_gain: float = 0.0):
    """Gain (linear) of a level (linear) for (in dB, out dB) points, ascending; below the first, its gain holds, and above 0 dB
    too. A knee rounds the corners by a parabola."""
    pts = sorted((float(a), float(b)) for a, b in points)
    if pts[-1][0] < 0:
        pts.append((0.0, 0.0))
    xs, gs = np.array([p[0] for p in pts]), np.array([p[1] - p[0] for p in pts])

    def gain(level: np.ndarray) -> np.ndarray:
        db = 20 * np.log10(np.maximum(level, 1e-10))
        g = np.interp(db, xs, gs)
        if len(xs) > 1:  # the last stretch from its end, so that 0 dB and what is near it are exact
            g = np.where((db >= xs[-2]) & (db < xs[-1]), gs[-1] + (gs[-1] - gs[-2]) / (xs[-1] - xs[-2]) * (db - xs[-1]), g)
        if knee > 0:
            for k in range(1, len(xs) - 1):
                r = min(knee, xs[k] - xs[k - 1], xs[k + 1] - xs[k]) / 2
                near = np.abs(db - xs[k]) < r
                left, right = (gs[k] - gs[k - 1]) / (xs[k] - xs[k - 1]), (gs[k + 1] - gs[k]) / (xs[k + 1] - xs[k])
                g = np.where(near, gs[k] + left * (db - xs[k]) + (right - left) * (db - xs[k] + r) ** 2 / (4 * r), g)
        return 10 ** ((g + post_gain) / 20)

    return gain


def curve(spark: SparkSession, points: list[tuple[float, float]], knee: float = 0.01, gain: float = 0.0, steps: int = 101) -> DataFrame:
    """(in_db, out_db) of a transfer curve from -100 to 0 dB."""
    db = np.linspace(-100, 0, steps)
    out = db + 20 * np.log10(transfer(points, knee, gain)(10 ** (db / 20)))
    return spark.createDataFrame([(float(a), float(b)) for a, b in zip(db, out)], "in_db double, out_db double")


def rate_of(seconds: float, rate: float) -> float:
    return 1 - math.exp(-1 / (rate * seconds)) if seconds > 1 / rate else 1.0


def compand(x: Signal, times: list[tuple[float, float]], points: list[tuple[float, float]], knee: float = 0.01, gain: float = 0.0, initial: float = 0.0, delay: float = 0.0) -> Signal:
    """Gain by a transfer curve of the level. One (attack, decay) pair for all channels together, or one for each.

    delay (seconds) lets the gain look ahead: the output is late by it and cut to the input's length here.
    """
    curve, start = transfer(points, knee, gain), 10 ** (initial / 20)
    rates = [(rate_of(a, x.rate), rate_of(d, x.rate)) for a, d in times]
    late = int(delay * x.rate)

    return blockwise(x, stateful.Compand(rates, curve, start, late))


def mcompand(x: Signal, bands: list[dict], crossovers: list[float]) -> Signal:
    """compand by frequency band: fourth-order Linkwitz-Riley splits at ascending crossovers, bands companded and added.

    bands: dicts of compand's times, points, knee, gain, initial.
    """
    splits = [tuple(tuple(design.biquad(kind, x.rate, f, math.sqrt(0.5))) for kind in ("lowpass", "highpass")) for f in crossovers]
    made = [(tuple(rate_of(t, x.rate) for t in b["times"][0]), transfer(b["points"], b.get("knee", 0.01), b.get("gain", 0.0)), 10 ** (b.get("initial", 0.0) / 20)) for b in bands]
    return blockwise(x, stateful.Bands(splits, made))


# --- modulated delays ---


def wave(shape: str, n: np.ndarray, period: float, phase: float = 0.0) -> np.ndarray:
    """From 0 to 1: s sine, t triangle."""
    p = (n / period + phase) % 1
    return (np.sin(2 * np.pi * p) + 1) / 2 if shape.startswith("s") else np.where(p < 0.5, 2 * p, 2 - 2 * p)


def flanger(x: Signal, delay: float = 0, depth: float = 2, regen: float = 0, width: float = 71, speed: float = 0.5, shape: str = "sine", phase: float = 25, interp: str = "linear") -> Signal:
    """A swinging delay (ms) with feedback; the wave of each channel is later by phase%."""
    w, g = width / 100, regen / 100
    dry, wet = 1 / (1 + w), w / (1 + w) * (1 - abs(g))
    low, size = delay / 1000 * x.rate, int((delay + depth) / 1000 * x.rate + 0.5) + 2

    def swing(n: np.ndarray, c: int) -> np.ndarray:
        return low + depth / 1000 * x.rate * wave(shape[:1], n, x.rate / speed, (c * phase / 100 + 0.75) % 1)

    return blockwise(x, stateful.Flanger(swing, size + 2, g, dry, wet, interp != "linear"))


def phaser(x: Signal, gain_in: float = 0.4, gain_out: float = 0.74, delay: float = 3, decay: float = 0.4, speed: float = 0.5, shape: str = "t") -> Signal:
    """Feedback through a swinging delay; no tail."""
    size = max(1, int(delay * 0.001 * x.rate + 0.5))
    period = int(x.rate / speed + 0.5)

    def place(n: np.ndarray) -> np.ndarray:
        return (1 + np.round(wave(shape, n, period, 0.25) * (size - 1))).astype(int)

    return blockwise(x, stateful.Phaser(place, size, gain_in, gain_out, decay))


#: Lengths of the reverberator's combs and all-passes in samples at 44.1 kHz: fixed values.
COMBS, ALLPASSES = (1116, 1188, 1277, 1356, 1422, 1491, 1557, 1617), (225, 341, 441, 556)


def reverb(x: Signal, reverberance: float = 50, damping: float = 50, room: float = 100, stereo: float = 100, pre_delay: float = 0, wet_db: float = 0, wet_only: bool = False) -> Signal:
    """Eight damped combs in parallel, four all-passes in series, for left and right; mono becomes stereo if stereo depth is given."""
    scale, spread = room / 100 * 0.9 + 0.1, stereo / 100
    # fixed formula: how the feedback follows the percentage, from 0.3 at 0 to 0.98 at 100
    a = -1 / math.log(1 - 0.3)
    b = 100 / (math.log(1 - 0.98) * a + 1)
    feedback = 1 - math.exp((reverberance - b) / (a * b))
    damp, gain = damping / 100 * 0.3 + 0.2, 10 ** (wet_db / 20) * 0.015
    r = x.rate / 44100
    early = int(pre_delay / 1000 * x.rate + 0.5)

    offsets = [side * spread * 12 for side in ((0, 1) if spread and x.channels <= 2 else (0,))]
    lines = [([max(1, int(scale * r * (c + o) + 0.5)) for c in COMBS], [max(1, int(r * (c + o) + 0.5)) for c in ALLPASSES]) for o in offsets]
    dry = 0 if wet_only else 1

    def mixed(v: np.ndarray, wet: list[list[np.ndarray]]) -> list[np.ndarray]:
        if len(v) == 1:
            return [v[0] * dry + side for side in wet[0]]
        if len(v) == 2 and spread:
            return [v[c] * dry + (wet[0][c] + wet[1][c]) / 2 for c in (0, 1)]
        return [row * dry + sides[0] for row, sides in zip(v, wet)]

    return blockwise(x, stateful.Reverb(lines, early, feedback, damp, gain, mixed), channels=2 if x.channels == 1 and spread else x.channels)


# --- time ---


def tempo(x: Signal, factor: float, segment_ms: float = 82, search_ms: float = 14.68, overlap_ms: float = 12) -> Signal:
    """Faster at the same pitch: segments are overlapped where they fit best (least squared distance over all channels)."""
    seg, search, over = (int(x.rate * ms / 1000 + 0.5) for ms in (segment_ms, search_ms, overlap_ms))
    over = max(over, 16)
    return blockwise(x, stateful.Tempo(factor, seg, search, over))


def pitch(x: Signal, cents: float, **options) -> Signal:
    """tempo by the inverse of the pitch ratio, then the rate times the ratio; a rate operator brings the rate back."""
    from .resample import rate

    ratio = 2 ** (cents / 1200)
    slow = tempo(x, 1 / ratio, **options)
    return rate(slow.with_df(slow.df, rate=x.rate * ratio), x.rate)


def splice(x: Signal, joins: list[tuple[int, int, int]], shape: str = "t") -> Signal:
    """Cross-fades at (position, excess, leeway) in samples: the best fit within the leeway, then a fade over twice the excess."""

    def fade(i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        up = i if shape == "t" else np.sin(i * np.pi / 2) if shape == "q" else (1 - np.cos(i * np.pi)) / 2
        return up, np.sqrt(1 - up**2) if shape == "q" else 1 - up

    return blockwise(x, stateful.Splice(list(joins), fade))


def bend(x: Signal, bends: list[tuple[int, float, int]], frames_per_second: int = 25, oversampling: int = 16) -> Signal:
    """Pitch bends (start, cents, end in samples) by a phase vocoder; a bend's pitch holds after it."""
    size = 1 << max(6, int(math.floor(math.log2(x.rate / frames_per_second))) + 1)

    def ratio_at(n: int) -> float:
        cents = 0.0
        for start, c, end in bends:
            cents += c * (0 if n < start else 1 if n >= end else (1 - math.cos(math.pi * (n - start) / (end - start))) / 2)
        return 2 ** (cents / 1200)

    return blockwise(x, stateful.Bend(ratio_at, size, oversampling))


# --- choosing by level ---


def silence(x: Signal, above_periods: int, above: tuple[int, float] = (0, 0.0), below_periods: int = 0, below: tuple[int, float] = (0, 0.0), leave: bool = False) -> Signal:
    """Drops silence at the start until `above_periods` times sound lasts; stops (or, with negative below_periods, restarts) where
    silence lasts. above and below: (samples, level as a share of full scale). Level: running RMS over 20 ms; sound is any
    channel over it. leave: the first below[0] samples of a silence that is cut stay."""
    return blockwise(x, stateful.Silence(max(1, int(x.rate / 50)), above_periods, above, below_periods, below, leave), precision=32)


def vad(
    x: Signal, trigger: float = 7.0, trigger_seconds: float = 0.25, search: float = 1.0, gap: float = 0.25, before: float = 0.0, boot: float = 0.35, noise_up: float = 0.1, noise_down: float = 0.01,
    reduction: float = 1.35, frequency: float = 20.0, duration: float | None = None, smoothing: float = 0.4, high: float = 50.0, low: float = 6000.0, lifter_high: float = 150.0, lifter_low: float = 2000.0,
) -> Signal:
    """Drops what comes before speech.

    Power in the cepstrum (lifter frequencies) of magnitudes from `high` to `low` Hz over a noise floor, in nepers over -21, is
    measured `frequency` times a second over `duration` (two periods if not given). A running mean that reaches the trigger ends
    the search: the output begins where the measures of the last `search` seconds rose, over gaps of up to `gap`, and `before`
    seconds earlier. Without a trigger nothing is left.
    """
    window = int(x.rate * (duration or 2 / frequency) + 0.5)
    size = max(16, 1 << max(0, window - 1).bit_length())
    period, kept, bridged = int(x.rate / frequency + 0.5), math.ceil(search * frequency), int(gap * frequency + 0.5)
    first, last = max(1, int(high / x.rate * size + 0.5)), min(size // 2, int(low / x.rate * size + 0.5))
    c0, c1 = math.ceil(x.rate * 0.5 / lifter_low), min(size // 4, math.floor(x.rate * 0.5 / lifter_high))
    if c1 <= c0 or last <= first:
        raise ValueError("the filters leave no frequency to measure at this rate")
    fall = lambda seconds: math.exp(-1 / (seconds * frequency))
    up, down, slow, mean_share = fall(noise_up), fall(noise_down), fall(smoothing), fall(trigger_seconds)
    boots = int(boot * frequency - 0.5) + 1
    taper, lift = stateful.tapers(window, last - first)
    return blockwise(x, stateful.Voice(window, size, period, kept, bridged, int(before * x.rate + 0.5), boots, (first, last), (c0, c1), trigger, up, down, slow, mean_share, reduction, taper, lift))


# --- requantising ---

#: Noise-shaping kernels by name and rate, published in the literature on psychoacoustically shaped dither: fixed values. Those of
#: gesemann are four taps over errors and four over the shaper's own outputs.
SHAPES = {
    "lipshitz": {44100: [2.033, -2.165, 1.959, -1.590, 0.6149]},
    "f-weighted": {46000: [2.412, -3.370, 3.937, -4.174, 3.353, -2.205, 1.281, -0.569, 0.0847]},
    "modified-e-weighted": {46000: [1.662, -1.263, 0.4827, -0.2913, 0.1268, -0.1124, 0.03252, -0.01265, -0.03524]},
    "improved-e-weighted": {46000: [2.847, -4.685, 6.214, -7.184, 6.639, -5.032, 3.263, -1.632, 0.4191]},
    "gesemann": {
        48000: [2.2374, -0.7339, -0.1251, -0.6033, 0.903, 0.0116, -0.5853, -0.2571],
        44100: [2.2061, -0.4706, -0.2534, -0.6214, 1.0587, 0.0676, -0.6054, -0.2738],
    },
    "shibata": {
        48000: [2.87207293510437, -5.041323184967041, 6.244299411773682, -5.848398685455322, 3.706754207611084, -1.0495119094848633, -1.1830236911773682, 2.1126792430877686, -1.9094531536102295, 0.9991308450698853, -0.17090806365013123, -0.32615602016448975, 0.39127644896507263, -0.2687646150588989, 0.0976761057972908, -0.023473845794796944],
        44100: [2.6773197650909424, -4.830892562866211, 6.570110321044922, -7.4572014808654785, 6.726327419281006, -4.848165035247803, 2.0412089824676514, 0.7006359100341797, -2.95375657081604, 4.080038547515869, -4.184521675109863, 3.331181287765503, -2.117992639541626, 0.879302978515625, -0.031759146600961685, -0.4238278865814209, 0.4788210391998291, -0.35490813851356506, 0.1749683916568756, -0.06090816855430603],
        37800: [1.6335992813110352, -2.261549234390259, 2.407702922821045, -2.634171724319458, 2.144036293029785, -1.8153258562088013, 1.0816224813461304, -0.703026533126831, 0.15991993248462677, 0.04154951870441437, -0.2941657602787018, 0.25183168053627014, -0.27766478061676025, 0.15785403549671173, -0.10165894031524658, 0.016833892092108727],
        32000: [0.8211855292320251, -1.0063692331314087, 0.6234196424484253, -1.0447187423706055, 0.6453251242637634, -0.8761513233184814, 0.5221975445747375, -0.6743426322937012, 0.44954317808151245, -0.5255749821662903, 0.34567299485206604, -0.39618203043937683, 0.26791760325431824, -0.28936097025871277, 0.1883765310049057, -0.19097308814525604, 0.10431359708309174, -0.10633844882249832, 0.04683221876621246, -0.03965331241488457],
        22050: [0.056581053882837296, -0.5695690512657166, -0.40727734565734863, -0.33870288729667664, -0.29810553789138794, -0.19039161503314972, -0.16510021686553955, -0.1346815973520279, -0.09663376957178116, -0.0810491293668747, -0.06495305895805359, -0.054459091275930405, -0.04337870702147484, -0.03660014271736145, -0.026256965473294258, -0.01878620684146881, -0.013387725688517094, -0.009098323062062263, -0.0026585909072309732, -0.0004208330065011978],
        16000: [-0.3725113272666931, -0.8142357468605042, -0.5501095652580261, -0.474057674407959, -0.32624706625938416, -0.3161766529083252, -0.2286367267370224, -0.22916607558727264, -0.1956561654806137, -0.18160104751586914, -0.15423151850700378, -0.14104481041431427, -0.11844276636838913, -0.0975830927491188, -0.07649359852075577, -0.06810691952705383, -0.04188165441155434, -0.03692242503166199, -0.019364040344953537, -0.014994367957115173],
        11025: [-0.9264228343963623, -0.9869598746299744, -0.631156325340271, -0.5196693539619446, -0.3973887264728546, -0.35679301619529724, -0.2972072660923004, -0.26310476660728455, -0.21719355881214142, -0.18561814725399017, -0.15404847264289856, -0.12687471508979797, -0.10339745879173279, -0.0836886316537857, -0.05875682458281517, -0.04689367115497589, -0.027950936928391457, -0.020740609616041183, -0.009366452693939209, -0.00602601608261466],
        8000: [-1.202863335609436, -0.9410309791564941, -0.6787855625152588, -0.5765001773834229, -0.5000447630882263, -0.44349345564842224, -0.37833768129348755, -0.3402872383594513, -0.2941308915615082, -0.24994957447052002, -0.21715600788593292, -0.18792112171649933, -0.15268312394618988, -0.12135542929172516, -0.09961062669754028, -0.07527361065149307, -0.048787496984004974, -0.0425863191485405, -0.02899129129946232, -0.011869125068187714],
    },
    "low-shibata": {
        48000: [2.3925774097442627, -3.4350297451019287, 3.185370922088623, -1.8117271661758423, -0.2012477070093155, 1.4759907722473145, -1.7210904359817505, 0.9774670004844666, -0.13790138065814972, -0.38185903429985046, 0.27421241998672485, 0.06658421456813812, -0.35223302245140076, 0.37672343850135803, -0.23964276909828186, 0.06867482513189316],
        44100: [2.0833916664123535, -3.0418450832366943, 3.204789876937866, -2.757192611694336, 1.4978630542755127, -0.34275946021080017, -0.7173374891281128, 1.073705792427063, -1.0225815773010254, 0.5664999485015869, -0.20968692004680634, -0.06537853181362152, 0.10322438180446625, -0.06744202226400375, -0.00495197344571352],
    },
    "high-shibata": {44100: [3.025918960571289, -6.026871681213379, 9.195003509521484, -11.824929237365723, 12.767142295837402, -11.917946815490723, 9.173916816711426, -5.371232032775879, 1.1393624544143677, 2.4484779834747314, -4.971983909606934, 6.039200305938721, -5.935952186584473, 4.903278350830078, -3.5527443885803223, 2.190969705581665, -1.1672389507293701, 0.49039143323898315, -0.16519790887832642, 0.023217858746647835]},
}


def shaper(name: str, rate: float, strict: bool = False) -> list[float]:
    """The kernel of the nearest rate; strict: an error where that is more than 5% away."""
    if name not in SHAPES:
        raise ValueError(f"no noise shape {name!r}; there are {', '.join(SHAPES)}")
    near = min(SHAPES[name], key=lambda r: abs(r - rate))
    if strict and abs(near - rate) > 0.05 * near:
        raise ValueError(f"{name} is for rates of {', '.join(map(str, SHAPES[name]))}")
    return SHAPES[name][near]


#: Places without bits to lose after which automatic dither rests.
RESTS = 64


def dither(x: Signal, bits: int, shape: str | None = None, slope: bool = False, seed: int = 1, automatic: bool = False, strict: bool = False) -> Signal:
    """To so many bits with triangular noise (slope: the difference of neighbouring draws); shape: the error is fed back.

    automatic: only while one of the last RESTS samples has bits that would be lost; in between samples pass unchanged.
    Without a shape and automatic, a sample's noise is an expression of its place; else blocks carry the errors on.
    """
    if shape is None and not automatic:
        return flat_dither(x, bits, slope, seed)
    taps = shaper(shape, x.rate, strict) if shape else []
    fed, own = (taps[:4], taps[4:]) if shape == "gesemann" else (taps, [])
    return blockwise(x, stateful.Dither(bits, fed, own, slope, seed, RESTS if automatic else None), precision=bits)


def flat_dither(x: Signal, bits: int, slope: bool, seed: int) -> Signal:
    step, top = 1 << (32 - bits), 1 << (bits - 1)
    place = F.col("n") if slope else F.col("n") * 2 + 1
    df = draws.with_state(x.df, place, F.col("channel") + seed, "_u")
    one, two = (F.shiftright(draws.signed(u), bits) for u in (F.col("_u"), draws.after(F.col("_u"))))
    noise = two - F.when(F.col("n") == 0, 0).otherwise(one) if slope else one + two
    level = (F.col("s") + noise) / F.lit(float(step))
    level = F.when(level < 0, F.ceil(level - 0.5)).otherwise(F.floor(level + 0.5))
    return x.with_df(df.withColumn("s", (F.greatest(F.lit(-top), F.least(F.lit(top - 1), level)) * step).cast("int")), precision=bits)


def user(x: Signal, kernel: Callable[[np.ndarray], np.ndarray] | stateful.Operator) -> Signal:
    """A caller's own kernel over (channels, places) of float samples, or an operator in blocks with a state."""
    return blockwise(x, kernel) if hasattr(kernel, "flow") else by_stream(x, kernel)

