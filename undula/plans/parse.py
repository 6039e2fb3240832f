"""Text forms: times, positions, frequencies and notes, gains, widths."""

from __future__ import annotations

import re

_NUMBER = r"\d+(?:\.\d*)?(?:e[+-]?\d+)?|\.\d+(?:e[+-]?\d+)?"
_TIME = re.compile(rf"(?:(?P<count>{_NUMBER})s)|(?:(?:(?P<h>\d+):)?(?:(?P<m>\d+):))?(?P<s>{_NUMBER})t?", re.IGNORECASE)


def samples(text: str, rate: float) -> int:
    """Samples of '1:30.5' (h:m:s), '44100s' (samples) or '2.5t' (seconds), with + and -; a difference is never below 0."""
    at, total, sign = 0, 0, 1
    if not text:
        raise ValueError("a time is missing")
    while at < len(text):
        if at:
            if text[at] not in "+-":
                raise ValueError(f"can't read the time {text!r}")
            sign = 1 if text[at] == "+" else -1
            at += 1
        m = _TIME.match(text, at)
        if not m or m.end() == at:
            raise ValueError(f"can't read the time {text!r}")
        if m["count"] is not None:
            n = int(float(m["count"]) + 0.5)
        else:
            n = int((int(m["h"] or 0) * 3600 + int(m["m"] or 0) * 60 + float(m["s"])) * rate + 0.5)
        total = max(0, total + sign * n)
        at = m.end()
    return total


def position(text: str, rate: float, latest: int = 0, length: int | None = None, default: str = "=") -> int:
    """A place: '=' from the start, '+' from the latest place, '-' before the end (which must then be known)."""
    anchor, rest = (text[0], text[1:]) if text[:1] in "=+-" else (default, text)
    n = samples(rest, rate)
    if anchor == "=":
        return n
    if anchor == "+":
        return latest + n
    if length is None:
        raise ValueError("a place before the end needs a known length")
    if n > length:
        raise ValueError(f"{text!r} is before the start")
    return length - n


def frequency(text: str) -> float:
    """Hz of '440', '1.5k', '%9' (semitones from A 440) or a note like A4, C#5, Bb3."""
    if text.startswith("%"):
        return 440.0 * 2 ** (float(text[1:]) / 12)
    if m := re.fullmatch(r"([A-Ga-g])([#b]?)(-?\d)?", text):
        steps = {"c": -9, "d": -7, "e": -5, "f": -4, "g": -2, "a": 0, "b": 2}[m[1].lower()] + {"#": 1, "b": -1, "": 0}[m[2]]
        return 440.0 * 2 ** ((steps + 12 * (int(m[3] or 4) - 4)) / 12)
    return float(text[:-1]) * 1000 if text.endswith("k") else float(text)


def level(text: str) -> tuple[float, str]:
    """A value and whether it is an amplitude or dB: '0.5', '3dB'."""
    return (float(text[:-2]), "dB") if text.lower().endswith("db") else (float(text), "amplitude")


def share(text: str) -> float:
    """A level as a share of full scale: '1%', '-48d'."""
    if text.endswith("%"):
        return float(text[:-1]) / 100
    return 10 ** (float(text[:-1]) / 20) if text.endswith("d") else float(text)


def width(text: str, default: str = "h") -> tuple[float, str]:
    """A band width and its kind: h Hz, k kHz, q quality, o octaves, s slope."""
    kind = text[-1] if text[-1] in "hkqos" else ""
    value = float(text[: -len(kind)] if kind else text)
    return (value * 1000, "h") if kind == "k" else (value, kind or default)


def points(text: str) -> tuple[float, list[tuple[float, float]]]:
    """Knee and points of a compander: '6:-70,-60,-20' (a last single value is an output at 0 dB)."""
    knee, _, rest = text.rpartition(":")
    values = [float(v) for v in rest.split(",")]
    if len(values) % 2:
        values = [*values[:-1], 0.0, values[-1]] if values[-1] <= 0 else values[:-1] + [values[-1], values[-1]]
    return float(knee or 0.01), list(zip(values[::2], values[1::2]))


def words(text: str) -> list[str]:
    """A line cut at white space; quotes keep it."""
    import shlex

    return shlex.split(text, comments=True)
