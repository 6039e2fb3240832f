"""Chains of operators by name.

A chain is parsed into (name, arguments), resolved against what is known of the signal (rate, channels), and applied. Operators
that do nothing vanish. A trim that comes first is a range predicate on n that reaches the scan.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import functions as F

from ..functions.numeric import linear
from ..operators import aggregates, frames, maps, resample, rows, scan, sequential, synth, windows
from ..signal import Signal
from . import parse

OPERATORS: dict[str, Callable[[Signal, list[str]], Signal]] = {}
USER: dict[str, Callable] = {}


def operator(*names: str):
    def put(f):
        for n in names:
            OPERATORS[n] = f
        return f

    return put


def register(name: str, kernel: Callable) -> None:
    """A caller's operator: a kernel over an array (channels, places)."""
    USER[name] = kernel


def _flags(args: list[str], known: str) -> tuple[set[str], list[str]]:
    found = set()
    while args and len(args[0]) > 1 and args[0][0] == "-" and all(c in known for c in args[0][1:]):
        found |= set(args[0][1:])
        args = args[1:]
    return found, args


def _f(args: list[str], k: int, default: float) -> float:
    return float(args[k]) if len(args) > k else default


@operator("vol")
def _vol(x, a):
    value, kind = parse.level(a[0])
    rest = a[1:]
    if rest and rest[0] in ("amplitude", "dB", "power"):
        kind, rest = rest[0], rest[1:]
    return maps.vol(x, value, kind, float(rest[0]) if rest else None)


@operator("gain")
def _gain(x, a):
    """-n, -e, -B, -b: by peaks or powers of all the signal (-b: -B, but no channel above full scale); -l: limiter; -h: room of
    the given level is made, and -r gives it back as far as nothing clips."""
    flags, rest = _flags(a, "nelBbrh")
    if "r" in flags and flags & set("neBbh") or len(flags & set("eBb")) > 1 or "l" in flags and "n" in flags:
        raise ValueError(f"gain: {' '.join(a)} contradicts itself")
    db = _f(rest, 0, 0.0)
    if flags & set("eBb"):
        x = aggregates.normalise(x, 0.0, "e" if "e" in flags else "b" if "b" in flags else "B")
    if "n" in flags:
        return aggregates.normalise(x, db)
    if "r" in flags:
        return aggregates.reclaim(x, db)
    y = maps.gain(x, db, "l" in flags)
    return replace(y, headroom=x.headroom * linear(db)) if "h" in flags else y


OPERATORS["norm"] = lambda x, a: aggregates.normalise(x, _f(a, 0, 0.0))
OPERATORS["dcshift"] = lambda x, a: maps.dcshift(x, float(a[0]), float(a[1]) if len(a) > 1 else None)
OPERATORS["contrast"] = lambda x, a: maps.contrast(x, _f(a, 0, 75))
OPERATORS["channels"] = lambda x, a: maps.channels(x, int(a[0]))
OPERATORS["oops"] = lambda x, a: maps.oops(x)
OPERATORS["swap"] = lambda x, a: maps.swap(x)
OPERATORS["divide"] = lambda x, a: maps.divide(x)
OPERATORS["upsample"] = lambda x, a: maps.upsample(x, int(_f(a, 0, 2)))
OPERATORS["downsample"] = lambda x, a: maps.downsample(x, int(_f(a, 0, 2)))
OPERATORS["tremolo"] = lambda x, a: maps.tremolo(x, float(a[0]), _f(a, 1, 40))
OPERATORS["reverse"] = lambda x, a: rows.reverse(x)
OPERATORS["repeat"] = lambda x, a: rows.repeat(x, int(_f(a, 0, 1)))
OPERATORS["hilbert"] = lambda x, a: windows.hilbert(x, int(a[1]) if a[:1] == ["-n"] else None)
OPERATORS["loudness"] = lambda x, a: windows.loudness(x, _f(a, 0, -10), _f(a, 1, 65), int(_f(a, 2, 1023)))
OPERATORS["earwax"] = lambda x, a: windows.earwax(x)
OPERATORS["stretch"] = lambda x, a: windows.stretch(x, float(a[0]), _f(a, 1, 20))
OPERATORS["overdrive"] = lambda x, a: scan.overdrive(x, _f(a, 0, 20), _f(a, 1, 20))
OPERATORS["biquad"] = lambda x, a: scan.biquad(x, [float(v) for v in a])
OPERATORS["deemph"] = lambda x, a: scan.biquad(x, scan.design.deemphasis(x.rate))
OPERATORS["riaa"] = lambda x, a: scan.biquad(x, scan.design.riaa(x.rate))
OPERATORS["phaser"] = lambda x, a: sequential.phaser(x, *[float(v) for v in a if not v.startswith("-")], shape="s" if "-s" in a else "t")
OPERATORS["input"] = OPERATORS["output"] = OPERATORS["stat"] = OPERATORS["stats"] = lambda x, a: x  # samples pass through


@operator("dither")
def _dither(x, a):
    shape, slope, automatic, bits = None, False, False, min(x.precision, 16)
    while a:
        if a[0] in ("-s", "-S", "-a"):
            shape, slope, automatic, a = "shibata" if a[0] == "-s" else shape, slope or a[0] == "-S", automatic or a[0] == "-a", a[1:]
        elif a[0] in ("-f", "-p") and len(a) > 1:
            shape, bits, a = a[1] if a[0] == "-f" else shape, int(a[1]) if a[0] == "-p" else bits, a[2:]
        else:
            raise ValueError(f"dither: {a[0]!r} isn't an option with what it needs")
    return sequential.dither(x, bits, None if shape == "none" else shape, slope, automatic=automatic, strict=True)


@operator("speed")
def _speed(x, a):
    return maps.speed(x, 2 ** (float(a[0][:-1]) / 1200) if a[0].endswith("c") else float(a[0]))


@operator("remix")
def _remix(x, a):
    flags, rest = _flags(a, "map")
    return maps.remix(x, rest, "p" in flags)


@operator("fade")
def _fade(x, a):
    shape = a[0] if a[0] in tuple("qhltp") else "l"
    t = a[1:] if a[0] in tuple("qhltp") else a
    n = [parse.samples(v.lstrip("-"), x.rate) for v in t]
    return maps.fade(x, n[0], n[1] if len(n) > 1 else None, n[2] if len(n) > 2 else None, shape)


def _places(x: Signal, texts: list[str]) -> list[int]:
    out: list[int] = []
    for t in texts:
        out.append(parse.position(t, x.rate, out[-1] if out else 0, None, "+"))
    return out


@operator("trim")
def _trim(x, a):
    if len(a) == 2 and a[1].startswith("-"):
        before_end = parse.samples(a[1][1:], x.rate)
        start = parse.position(a[0], x.rate)
        return rows.trim(x, [start]) if before_end == 0 else rows.trim_end(x, start, before_end)
    places = _places(x, a)
    return x if places == [0] else rows.trim(x, places)


@operator("pad")
def _pad(x, a):
    before = after = 0
    inside = []
    for k, t in enumerate(a):
        count, at, place = t.partition("@")
        n = parse.samples(count, x.rate)
        if at:
            inside.append((n, parse.samples(place, x.rate)))
        elif k == 0:
            before = n
        else:
            after = n
    return rows.pad(x, before, after, inside)


@operator("delay")
def _delay(x, a):
    return rows.delay(x, [parse.position(t, x.rate) for t in a])


OPERATORS["echo"] = lambda x, a: windows.echo(x, float(a[0]), float(a[1]), list(zip(map(float, a[2::2]), map(float, a[3::2]))))
OPERATORS["echos"] = lambda x, a: windows.echos(x, float(a[0]), float(a[1]), list(zip(map(float, a[2::2]), map(float, a[3::2]))))


@operator("chorus")
def _chorus(x, a):
    return windows.chorus(x, float(a[0]), float(a[1]), [(*map(float, a[k : k + 4]), a[k + 4].lstrip("-")) for k in range(2, len(a), 5)])


@operator("flanger")
def _flanger(x, a):
    return sequential.flanger(x, *[float(v) for v in a[:5]], *a[5:6], *[float(v) for v in a[6:7]], *a[7:8])


@operator("reverb")
def _reverb(x, a):
    wet = a[:1] == ["-w"]
    return sequential.reverb(x, *[float(v) for v in (a[1:] if wet else a)], wet_only=wet)


for _name in ("lowpass", "highpass", "bandpass", "bandreject", "allpass", "equalizer"):

    @operator(_name)
    def _filter(x, a, name=_name):
        flags, rest = _flags(a, "12c")
        kind = "bandpass_skirt" if "c" in flags else "allpass_2" if name == "allpass" and "2" in flags else name
        w, unit = parse.width(rest[1], "q" if name == "equalizer" else "h") if len(rest) > 1 else (0.5**0.5, "q")
        return scan.shelf_or_band(x, kind, parse.frequency(rest[0]), w, unit, _f(rest, 2, 0.0), 1 if "1" in flags else 2)


for _name, _at in (("bass", 100.0), ("treble", 3000.0)):

    @operator(_name)
    def _shelf(x, a, name=_name, at=_at):
        w, unit = parse.width(a[2], "s") if len(a) > 2 else (0.5, "s")
        return scan.shelf_or_band(x, name, parse.frequency(a[1]) if len(a) > 1 else at, w, unit, float(a[0]))


@operator("band")
def _band(x, a):
    flags, rest = _flags(a, "n")
    f = parse.frequency(rest[0])
    return scan.biquad(x, scan.design.band(x.rate, f, parse.frequency(rest[1]) if len(rest) > 1 else f / 2, "n" in flags))


@operator("fir", "dft_filter")
def _fir(x, a):
    return windows.fir(x, [float(v) for v in a])


@operator("firfit")
def _firfit(x, a):
    return windows.firfit(x, list(zip(map(float, a[::2]), map(float, a[1::2]))))


@operator("sinc")
def _sinc(x, a):
    attenuation, transition, taps, phase, beta = 120.0, None, None, 50.0, None
    while a and a[0].startswith("-") and len(a[0]) == 2:
        if a[0] in ("-M", "-I", "-L"):
            phase, a = {"-M": 0.0, "-I": 25.0, "-L": 50.0}[a[0]], a[1:]
            continue
        value = a[1]
        if a[0] == "-a":
            attenuation = float(value)
        elif a[0] == "-b":
            beta = float(value)
        elif a[0] == "-p":
            phase = float(value)
        elif a[0] == "-t":
            transition = parse.frequency(value)
        else:
            taps = int(value)
        a = a[2:]
    high, dash, low = a[0].partition("-")
    return windows.sinc(x, parse.frequency(high) if high else None, parse.frequency(low) if dash else None, attenuation, transition, taps, phase, beta)


@operator("rate")
def _rate(x, a):
    """-q -l -m -h -v: quality; -s or -b percent: the share of the band that is passed; -M -I -L or -p percent: minimum,
    intermediate, linear or any phase; -a: aliases above the pass band are allowed."""
    quality, bandwidth, phase, aliasing = "h", None, 50.0, False
    while a and a[0].startswith("-"):
        if a[0] in ("-q", "-l", "-m", "-h", "-v"):
            quality = a[0][1]
        elif a[0] == "-s":
            bandwidth = 0.99
        elif a[0] == "-b" and len(a) > 1:
            bandwidth, a = float(a[1]) / 100, a[1:]
        elif a[0] == "-p" and len(a) > 1:
            phase, a = float(a[1]), a[1:]
            if not 0 <= phase <= 100:
                raise ValueError("rate: -p is a percentage from 0 to 100")
        elif a[0] in ("-M", "-I", "-L"):
            phase = {"M": 0.0, "I": 25.0, "L": 50.0}[a[0][1]]
        elif a[0] == "-a":
            aliasing = True
        else:
            raise ValueError(f"rate: there is no option {a[0]!r}")
        a = a[1:]
    if bandwidth and not (0.85 if aliasing else 0.74) <= bandwidth <= 0.997:
        raise ValueError("rate: -b is a percentage from 74 (with -a from 85) to 99.7")
    if (bandwidth or aliasing or phase != 50) and quality in "ql":
        raise ValueError("rate: the qualities q and l have no other options")
    return resample.rate(x, parse.frequency(a[0]), quality, bandwidth, phase, aliasing)


@operator("tempo")
def _tempo(x, a):
    flags, rest = _flags(a, "qmsl")
    profile = {"m": (82, 14.68, 12), "s": (41, 14.68, 12), "l": (22, 0, 16)}.get(next(iter(flags - {"q"}), ""), (82, 14.68, 12))
    return sequential.tempo(x, float(rest[0]), *[_f(rest, k + 1, v) for k, v in enumerate(profile)])


@operator("pitch")
def _pitch(x, a):
    return sequential.pitch(x, float(_flags(a, "q")[1][0]))


@operator("bend")
def _bend(x, a):
    bends, at, options = [], 0, {}
    while a:
        if a[0] in ("-f", "-o"):
            options["frames_per_second" if a[0] == "-f" else "oversampling"], a = int(a[1]), a[2:]
            continue
        start, cents, end = a[0].split(",")
        begin = parse.position(start, x.rate, at, None, "+")
        at = parse.position(end, x.rate, begin, None, "+")
        bends.append((begin, float(cents), at))
        a = a[1:]
    return sequential.bend(x, bends, **options)


@operator("splice")
def _splice(x, a):
    flags, rest = _flags(a, "hqt")
    joins = []
    for t in rest:
        p = t.split(",")
        joins.append((parse.position(p[0], x.rate), parse.samples(p[1], x.rate) if len(p) > 1 else int(0.005 * x.rate), parse.samples(p[2], x.rate) if len(p) > 2 else int(0.005 * x.rate)))
    return sequential.splice(x, joins, next(iter(flags), "t"))


@operator("compand")
def _compand(x, a):
    t = [float(v) for v in a[0].split(",")]
    knee, pts = parse.points(a[1])
    return sequential.compand(x, list(zip(t[::2], t[1::2])), pts, knee, _f(a, 2, 0.0), _f(a, 3, 0.0), _f(a, 4, 0.0))


@operator("mcompand")
def _mcompand(x, a):
    bands = []
    for text in a[::2]:
        b = text.split()
        t = [float(v) for v in b[0].split(",")]
        knee, pts = parse.points(b[1])
        bands.append({"times": list(zip(t[::2], t[1::2])), "points": pts, "knee": knee, "gain": _f(b, 2, 0.0), "initial": _f(b, 3, 0.0)})
    return sequential.mcompand(x, bands, [parse.frequency(v) for v in a[1::2]])


@operator("silence")
def _silence(x, a):
    leave, a = a[:1] == ["-l"], [v for v in a if v != "-l"]
    n = int(a[0])
    at = 3 if n else 1
    above = (parse.samples(a[1], x.rate), parse.share(a[2])) if n else (0, 0.0)
    below_n = int(a[at]) if len(a) > at else 0
    below = (parse.samples(a[at + 1], x.rate), parse.share(a[at + 2])) if below_n else (0, 0.0)
    return sequential.silence(x, n, above, below_n, below, leave)


#: Options of vad and their parameters.
VAD = {
    "t": "trigger", "T": "trigger_seconds", "s": "search", "g": "gap", "p": "before", "b": "boot", "N": "noise_up", "n": "noise_down", "r": "reduction", "f": "frequency", "m": "duration", "M": "smoothing",
    "h": "high", "l": "low", "H": "lifter_high", "L": "lifter_low",
}


@operator("vad")
def _vad(x, a):
    options = {}
    while a:
        if a[0][:1] != "-" or a[0][1:] not in VAD or len(a) < 2:
            raise ValueError(f"vad: {a[0]!r} isn't an option with a value")
        options[VAD[a[0][1:]]] = parse.frequency(a[1]) if a[0][1:] in "hlHL" else float(a[1])
        a = a[2:]
    return sequential.vad(x, **options)


@operator("noiseprof", "spectrogram")
def _passes(x, a):
    raise ValueError("a profile or spectrogram is a table of its own: call operators.frames.noise_profile() or spectrogram()")


@operator("noisered")
def _noisered(x, a):
    """A table of noise_profile(), as a Parquet path, and an amount."""
    if not a or not a[0].strip(".0123456789"):
        raise ValueError("noisered needs the path of a profile, a table of operators.frames.noise_profile()")
    profile = x.df.sparkSession.read.parquet(a[0])
    size = 2 * profile.agg(F.max("bin")).first()[0]
    return frames.noise_reduce(x, profile.groupBy("channel", "bin").agg(F.avg("log_power").alias("log_power")), _f(a, 1, 0.5), size)


@operator("synth")
def _synth(x, a):
    if a and a[0][0].isdigit():
        x, a = rows.trim(x, [0, parse.samples(a[0], x.rate)]), a[1:]
    kind = {"noise": "whitenoise", "trapetz": "trapezium"}.get(a[0], a[0])
    rest = a[1:]
    how = "create"
    if rest and rest[0] in ("create", "mix", "amod", "fmod"):
        how, rest = rest[0], rest[1:]
    f, f2, sweep = 440.0, None, ":"
    if rest:
        for sweep in ":+/-":
            if sweep in rest[0][1:]:
                lo, _, hi = rest[0][1:].partition(sweep)
                lo = rest[0][0] + lo
                f, f2 = parse.frequency(lo), parse.frequency(hi)
                break
        else:
            f, sweep = parse.frequency(rest[0]), ":"
    more = [float(v) / 100 for v in rest[1:]]
    length = None
    if f2 is not None:
        length = x.lengths().agg(F.max("length")).first()[0]
    return synth.synth(x, kind, how, f, f2, sweep, *more[:5], length=length)


def _external(name: str):
    def missing(x, a):
        if name in USER:
            return sequential.user(x, USER[name])
        raise ValueError(f"{name} runs an outside library; register a kernel under that name")

    return missing


for _name in ("ladspa", "speexdsp"):
    OPERATORS[_name] = _external(_name)


def apply(x: Signal, name: str, args: list[str]) -> Signal:
    if name in USER and name not in OPERATORS:
        return sequential.user(x, USER[name])
    if name not in OPERATORS:
        near = [k for k in OPERATORS if k.startswith(name.lower())]
        if len(near) != 1:
            raise ValueError(f"no operator {name!r}")
        name = near[0]
    return OPERATORS[name](x, args)


def parse_chain(text: str) -> list[tuple[str, list[str]]]:
    """(name, arguments) of each operator: an argument list ends at the next operator's name."""
    out: list[tuple[str, list[str]]] = []
    for w in parse.words(text):
        if w in OPERATORS or w in USER:
            out.append((w, []))
        elif out:
            out[-1][1].append(w)
        else:
            raise ValueError(f"{w!r} is no operator")
    return out


def run(x: Signal, text: str, rate: float | None = None, channels: int | None = None, dither_to: int | None = None) -> Signal:
    """The chain over x; then, if asked for, to a rate and channel count (fewer channels first, more last) and a precision.

    After speed, and without a rate operator, the rate is brought back to the input's.
    """
    own, operators = x.rate, parse_chain(text)
    for name, args in operators:
        x = apply(x, name, args)
    if rate is None and any(n == "speed" for n, _ in operators) and not any(n == "rate" for n, _ in operators):
        rate = own  # what is sped up keeps the rate that it came with
    if channels is not None and channels < x.channels:
        x = maps.channels(x, channels)
    if rate is not None and rate != x.rate:
        x = resample.rate(x, rate)
    if channels is not None and channels > x.channels:
        x = maps.channels(x, channels)
    if dither_to is not None and dither_to < x.precision and dither_to < 24:
        x = sequential.dither(x, dither_to)
    return x


def chains(x: Signal, text: str) -> list[Signal]:
    """Several chains parted by ':'; 'newfile' and 'restart' after a chain go on with what it left of the input.

    A chain that begins with trim takes its stretch; the next goes on after it.
    """
    out, offset = [], 0
    for part in text.split(" : "):
        words = [(n, a) for n, a in parse_chain(" ".join(w for w in parse.words(part) if w not in ("newfile", "restart")))]
        cut = Signal(x.df.where(f"n >= {offset}").selectExpr("stream_id", "channel", f"n - {offset} as n", "s"), x.rate, x.channels, x.precision)
        taken = 0
        for name, args in words:
            if name == "trim":
                taken = max(_places(x, args))
            cut = apply(cut, name, args)
        offset += taken
        out.append(cut)
    return out
