"""Filter design on the driver: windows, low-pass kernels, phase conversion, biquad coefficients."""

from __future__ import annotations

import math

import numpy as np


def bessel0(x):
    return np.i0(x)


def kaiser_beta(attenuation: float) -> float:
    """Kaiser's beta for a stop-band attenuation in dB."""
    if attenuation > 50:
        return 0.1102 * (attenuation - 8.7)
    return 0.5842 * (attenuation - 20.96) ** 0.4 + 0.07886 * (attenuation - 20.96) if attenuation > 20.96 else 0.0


def window(kind: str, n: int, parameter: float = 0.0) -> np.ndarray:
    """Symmetric window of n points: hann, hamming, bartlett, blackman, nuttall, kaiser, dolph."""
    x = 2 * np.pi * np.arange(n) / max(1, n - 1)
    if kind == "hann":
        return 0.5 - 0.5 * np.cos(x)
    if kind == "hamming":
        return 0.53836 - 0.46164 * np.cos(x)
    if kind == "bartlett":
        return 1 - np.abs(2 * np.arange(n) / max(1, n - 1) - 1)
    if kind == "blackman":
        a = parameter or 0.16
        return (1 - a) / 2 - 0.5 * np.cos(x) + a / 2 * np.cos(2 * x)
    if kind == "nuttall":
        return 0.3635819 - 0.4891775 * np.cos(x) + 0.1365995 * np.cos(2 * x) - 0.0106411 * np.cos(3 * x)
    if kind == "kaiser":
        return np.kaiser(n, parameter)
    if kind == "dolph":
        m = n - 1
        b = np.cosh(np.arccosh(10 ** (abs(parameter or 100) / 20)) / m)
        v = b * np.cos(np.pi * np.arange(n) / n)
        t = np.where(np.abs(v) <= 1, np.cos(m * np.arccos(np.clip(v, -1, 1))), np.cosh(m * np.arccosh(np.maximum(1, np.abs(v)))) * np.where((v < 0) & (m % 2 == 1), -1, 1))
        if n % 2:
            w = np.real(np.fft.fft(t))
            h = (n + 1) // 2
            w = np.concatenate([w[h - 1 : 0 : -1], w[:h]])
        else:
            w = np.real(np.fft.fft(t * np.exp(1j * np.pi * np.arange(n) / n)))
            h = n // 2 + 1
            w = np.concatenate([w[h - 1 : 0 : -1], w[1:h]])
        return w / w.max()
    return np.ones(n)


def lowpass_kernel(cutoff: float, taps: int, beta: float, scale: float = 1.0) -> np.ndarray:
    """Kaiser-windowed sinc; cutoff is a share of the Nyquist frequency."""
    m = np.arange(taps) - (taps - 1) / 2
    return scale * cutoff * np.sinc(cutoff * m) * np.kaiser(taps, beta)


def kaiser_taps(attenuation: float, transition: float) -> int:
    """Odd number of taps for a transition width that is a share of the Nyquist frequency."""
    return int(np.ceil((attenuation - 7.95) / (2.285 * np.pi * transition))) | 1


def sinc_kernel(rate: float, high: float | None = None, low: float | None = None, attenuation: float = 120.0, transition: float | None = None, taps: int | None = None, beta: float | None = None) -> np.ndarray:
    """Kernel that passes above `high` and below `low`; high over low rejects the band between."""
    nyquist = rate / 2
    beta = kaiser_beta(attenuation) if beta is None else beta

    def low_at(f: float) -> np.ndarray:
        width = transition / nyquist if transition else 0.05 * f / nyquist
        n = taps or kaiser_taps(attenuation, max(width, 1e-4))
        return lowpass_kernel(f / nyquist, min(n | 1, 65535), beta)

    def inverted(h: np.ndarray) -> np.ndarray:
        h = -h
        h[len(h) // 2] += 1
        return h

    if high is None:
        return low_at(low)
    if low is None:
        return inverted(low_at(high))
    a, b = low_at(high), low_at(low)
    n = max(len(a), len(b))
    a, b = (np.pad(x, (n - len(x)) // 2) for x in (a, b))
    return b - a if low > high else inverted(a - b)  # band-pass; band-reject


def phased(h: np.ndarray, phase: float, floor: float = 0.0, times: int = 16) -> np.ndarray:
    """A symmetric kernel's magnitude with phase 0 (minimum) to 50 (linear) to 100 (maximum), by folding the cepstrum: on a ring that
    is so many times as long as the kernel, from its place 0 on. A floor under the magnitude fills its zeros, at which the phase jumps."""
    n = 1 << int(np.ceil(np.log2(len(h) * times)))
    spectrum = np.fft.fft(h, n)
    log = np.log(np.maximum(np.hypot(np.abs(spectrum), floor), 1e-13))
    c = np.real(np.fft.ifft(log))
    c[1 : n // 2] *= 2
    c[n // 2 + 1 :] = 0
    minimum = np.imag(np.fft.fft(c))
    share = phase / 50 if phase <= 50 else 2 - phase / 50
    linear = -np.arange(n) * 2 * np.pi / n * (len(h) - 1) / 2
    half = n // 2 + 1
    angle = ((1 - share) * minimum + share * np.unwrap(linear))[:half]
    return np.fft.irfft(np.exp(log[:half] + 1j * angle), n)


def to_phase(h: np.ndarray, phase: float) -> np.ndarray:
    """A kernel of the same magnitude and length with that phase."""
    if phase == 50:
        return h
    out = phased(h, phase)[: len(h)]
    return out if phase <= 50 else out[::-1]


def to_phase_whole(h: np.ndarray, phase: float, attenuation: float) -> tuple[np.ndarray, int]:
    """A kernel of the same magnitude with that phase, and the place of its peak. It is as long as it must be for what is left out
    to lie below an attenuation in dB."""
    if phase == 50:
        return h, len(h) // 2
    ring = phased(h, phase, np.sum(h) * 10 ** (-attenuation / 20), max(64, (1 << 16) // len(h)))
    middle = len(ring) // 2
    ring = np.roll(ring, middle - int(np.argmax(np.abs(ring))))
    ring[: middle - 2 * len(h)] = ring[middle + 2 * len(h) :] = 0  # what the folding leaves half a ring away
    energy = np.cumsum(ring**2)
    left = energy[-1] * 10 ** (-(attenuation + 6) / 10)
    first, last = int(np.searchsorted(energy, left)), int(np.searchsorted(energy, energy[-1] - left))
    out, peak = ring[first : last + 1], middle - first
    return (out, peak) if phase <= 50 else (out[::-1], len(out) - 1 - peak)


# --- biquads: (b0, b1, b2, a0, a1, a2) by the widely published audio cookbook ---
# Functions are math's: numpy's differ from them in a last bit or two, by processor, and so may a rounded sample in millions.


def alpha(w0: float, width: float, kind: str, gain_db: float = 0.0) -> float:
    s, f = math.sin(w0), w0
    if kind == "s":  # slope
        a = 10 ** (gain_db / 40)
        return s / 2 * np.sqrt((a + 1 / a) * (1 / width - 1) + 2)
    if kind == "q":
        return s / (2 * width)
    if kind == "o":  # octaves
        return s * math.sinh(math.log(2) / 2 * width * f / s)
    if kind == "b":  # octaves without warping
        return s * math.sinh(math.log(2) / 2 * width)
    return math.tan(width / 2) if kind == "h" else s / (2 * width)


def biquad(kind: str, rate: float, f: float, width: float = np.sqrt(0.5), width_kind: str = "q", gain: float = 0.0, poles: int = 2) -> tuple[float, ...]:
    """lowpass highpass bandpass bandpass_skirt bandreject allpass equalizer bass treble. Widths of kind h are Hz."""
    w0 = 2 * math.pi * f / rate
    if w0 >= math.pi:
        raise ValueError("the frequency must be below half the sample rate")
    c = math.cos(w0)
    if poles == 1:
        if kind == "lowpass":
            a1 = -math.exp(-w0)
            return (1 + a1, 0.0, 0.0, 1.0, a1, 0.0)
        if kind == "highpass":
            a1 = -math.exp(-w0)
            return ((1 - a1) / 2, -(1 - a1) / 2, 0.0, 1.0, a1, 0.0)
        if kind == "allpass":  # experimental one-pole all-pass
            return (math.exp(-w0), -1.0, 0.0, 1.0, -math.exp(-w0), 0.0)
        raise ValueError(f"{kind} has two poles")
    if kind == "allpass_2":  # experimental two-pole all-pass without a width
        s = math.sin(w0)
        return (1 - s, -2 * c, 1 + s, 1 + s, -2 * c, 1 - s)
    al = alpha(w0, 2 * math.pi * width / rate if width_kind == "h" else width, width_kind, gain) if width_kind != "h" else math.sin(w0) / (2 * f / width)
    a = 10 ** (gain / 40)
    if kind == "lowpass":
        return ((1 - c) / 2, 1 - c, (1 - c) / 2, 1 + al, -2 * c, 1 - al)
    if kind == "highpass":
        return ((1 + c) / 2, -(1 + c), (1 + c) / 2, 1 + al, -2 * c, 1 - al)
    if kind == "bandpass":
        return (al, 0.0, -al, 1 + al, -2 * c, 1 - al)
    if kind == "bandpass_skirt":
        return (math.sin(w0) / 2, 0.0, -math.sin(w0) / 2, 1 + al, -2 * c, 1 - al)
    if kind == "bandreject":
        return (1.0, -2 * c, 1.0, 1 + al, -2 * c, 1 - al)
    if kind == "allpass":
        return (1 - al, -2 * c, 1 + al, 1 + al, -2 * c, 1 - al)
    if kind == "equalizer":
        return (1 + al * a, -2 * c, 1 - al * a, 1 + al / a, -2 * c, 1 - al / a)
    r = 2 * np.sqrt(a) * al
    sign = 1 if kind == "bass" else -1
    return (
        a * ((a + 1) - sign * (a - 1) * c + r), sign * 2 * a * ((a - 1) - sign * (a + 1) * c), a * ((a + 1) - sign * (a - 1) * c - r),
        (a + 1) + sign * (a - 1) * c + r, -sign * 2 * ((a - 1) + sign * (a + 1) * c), (a + 1) + sign * (a - 1) * c - r,
    )


def band(rate: float, f: float, width: float, noise: bool = False) -> tuple[float, ...]:
    """Resonator at f with a band of `width` Hz; noise: scaled for noise-like instead of tonal input."""
    a2 = math.exp(-2 * math.pi * width / rate)
    a1 = -4 * a2 / (1 + a2) * math.cos(2 * math.pi * f / rate)
    b0 = np.sqrt(((1 + a2) ** 2 - a1 * a1) * (1 - a2) / (1 + a2)) if noise else np.sqrt(1 - a1 * a1 / (4 * a2)) * (1 - a2)
    return (b0, 0.0, 0.0, 1.0, a1, a2)


def deemphasis(rate: float) -> tuple[float, ...]:
    """Shelf for discs recorded with pre-emphasis, at 44.1 or 48 kHz: corner, slope and gain are fixed values."""
    corner, slope, gain = {44100: (5283, 0.4845, -9.477), 48000: (5356, 0.479, -9.62)}[int(rate)]
    return biquad("treble", rate, corner, slope, "s", gain)


#: Zeros and poles of the record playback curve by rate, of a published design: fixed values.
RIAA = {
    44100: ((-0.2014898, 0.9233820), (0.7083149, 0.9924091)),
    48000: ((-0.1766069, 0.9321590), (0.7396325, 0.9931330)),
    88200: ((-0.1168735, 0.9648312), (0.8590646, 0.9964002)),
    96000: ((-0.1141486, 0.9676817), (0.8699137, 0.9966946)),
    192000: ((-0.1040610965, 0.9837523263), (0.9328992971, 0.9983633125)),
}


def riaa(rate: float) -> tuple[float, ...]:
    """Record playback curve at one of five rates, 0 dB at 1 kHz."""
    if rate not in RIAA:
        raise ValueError("the rate must be 44.1, 48, 88.2, 96 or 192 kHz")
    b, a = (np.poly(roots) for roots in RIAA[int(rate)])
    z = np.exp(-2j * np.pi * 1000 / rate * np.arange(3))
    b = b / abs((b @ z) / (a @ z))
    return (*b, *a)


def response(coefficients: tuple[float, ...], rate: float, points: int = 512) -> list[tuple[float, float]]:
    """(frequency, dB) of a biquad, or of a kernel."""
    f = np.linspace(0, rate / 2, points, endpoint=False)
    k = np.asarray(coefficients, float)
    b, a = (k[:3], k[3:]) if len(k) == 6 else (k, np.ones(1))
    at = lambda c: np.exp(-2j * np.pi * np.outer(f / rate, np.arange(len(c)))) @ c
    return list(zip(f.tolist(), (20 * np.log10(np.maximum(1e-12, np.abs(at(b) / at(a))))).tolist()))


def spline(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Natural cubic spline through (x, y)."""
    n = len(x)
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    m = np.zeros(n)
    if n > 2:
        a = np.diag(2 * (h[:-1] + h[1:])) + np.diag(h[1:-1], 1) + np.diag(h[1:-1], -1)
        m[1:-1] = np.linalg.solve(a, 6 * np.diff(d))
    k = np.clip(np.searchsorted(x, at, "right") - 1, 0, n - 2)
    t = at - x[k]
    return y[k] + t * (d[k] - h[k] * (2 * m[k] + m[k + 1]) / 6) + t**2 * m[k] / 2 + t**3 * (m[k + 1] - m[k]) / (6 * h[k])


def hilbert_kernel(taps: int) -> np.ndarray:
    k = np.arange(taps) - taps // 2
    with np.errstate(divide="ignore", invalid="ignore"):
        h = np.where(k == 0, 0.0, (1 - np.cos(np.pi * k)) / (np.pi * k))
    return h * window("blackman", taps, 0.16)


def curve_kernel(points: list[tuple[float, float]], rate: float, taps: int = 2047, shape: str = "nuttall", beta: float = 0.0) -> np.ndarray:
    """Linear-phase kernel of a response given as (Hz, dB) knots, joined by a spline over log frequency."""
    f, g = (np.array(v, float) for v in zip(*points))
    n = 1 << int(np.ceil(np.log2(taps * 4)))
    grid = np.arange(n // 2 + 1) * rate / n
    gain = spline(np.log(np.maximum(f, 1.0)), g, np.log(np.clip(grid, max(f[0], 1.0), f[-1])))
    h = np.fft.fftshift(np.fft.irfft(10 ** (gain / 20), n))
    return h[n // 2 - taps // 2 : n // 2 - taps // 2 + taps] * window(shape, taps, beta)


#: Equal-loudness contours (ISO 226:2003): frequency, exponent, transfer and threshold in dB. Fixed values.
ISO226 = [
    (20, 0.532, -31.6, 78.5), (25, 0.506, -27.2, 68.7), (31.5, 0.480, -23.0, 59.5), (40, 0.455, -19.1, 51.1), (50, 0.432, -15.9, 44.0), (63, 0.409, -13.0, 37.5), (80, 0.387, -10.3, 31.5), (100, 0.367, -8.1, 26.5),
    (125, 0.349, -6.2, 22.1), (160, 0.330, -4.5, 17.9), (200, 0.315, -3.1, 14.4), (250, 0.301, -2.0, 11.4), (315, 0.288, -1.1, 8.6), (400, 0.276, -0.4, 6.2), (500, 0.267, 0.0, 4.4), (630, 0.259, 0.3, 3.0),
    (800, 0.253, 0.5, 2.2), (1000, 0.250, 0.0, 2.4), (1250, 0.246, -2.7, 3.5), (1600, 0.244, -4.1, 1.7), (2000, 0.243, -1.0, -1.3), (2500, 0.243, 1.7, -4.2), (3150, 0.243, 2.5, -6.0), (4000, 0.242, 1.2, -5.4),
    (5000, 0.242, -2.1, -1.5), (6300, 0.245, -7.1, 6.0), (8000, 0.254, -11.2, 12.6), (10000, 0.271, -10.7, 13.9), (12500, 0.301, -3.1, 12.3),
]


def loudness_kernel(rate: float, gain: float = -10.0, reference: float = 65.0, taps: int = 1023) -> np.ndarray:
    """Kernel that keeps the heard balance when the level changes by gain dB from a reference in phon."""

    def pressure(phon: float) -> np.ndarray:
        out = []
        for _, a, lu, tf in ISO226:
            v = 4.47e-3 * (10 ** (0.025 * phon) - 1.15) + (0.4 * 10 ** ((tf + lu) / 10 - 9)) ** a
            out.append(10 / a * np.log10(v) - lu + 94)
        return np.array(out)

    change = pressure(reference + gain) - pressure(reference)
    points = [(f, c) for (f, *_), c in zip(ISO226, change)]
    return curve_kernel([*points, (max(rate / 2, 13000.0), float(change[-1]))], rate, taps, "kaiser", kaiser_beta(100))
