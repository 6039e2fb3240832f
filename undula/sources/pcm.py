"""Samples from and to bytes: integers, floats, companded bytes, ADPCM and delta modulation."""

from __future__ import annotations

import numpy as np

from ..functions import laws

#: Step sizes and index changes of the ADPCM coders: fixed values.
IMA_STEPS = [
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449,
    494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
]
OKI_STEPS = [
    256, 272, 304, 336, 368, 400, 448, 496, 544, 592, 656, 720, 800, 880, 960, 1056, 1168, 1280, 1408, 1552, 1712, 1888, 2080, 2288, 2512, 2768, 3040, 3344, 3680, 4048, 4464, 4912, 5392, 5936, 6528, 7184, 7904, 8704, 9568, 10528, 11584, 12736, 14016, 15408, 16960, 18656, 20512, 22576, 24832,
]
CHANGES = [-1, -1, -1, -1, 2, 4, 6, 8]


def int_bytes(s: np.ndarray, bits: int, signed: bool = True, big: bool = False) -> bytes:
    """Whole numbers of so many bits from samples, halves up, saturated."""
    v = np.minimum((s.astype(np.int64) + (1 << (31 - bits) if bits < 32 else 0)) >> (32 - bits), (1 << (bits - 1)) - 1)
    if not signed:
        v = v + (1 << (bits - 1))
    if bits == 24:
        raw = (v & 0xFFFFFF).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]
        return np.ascontiguousarray(raw[:, ::-1] if big else raw).tobytes()
    return v.astype(f"{'>' if big else '<'}{'i' if signed else 'u'}{bits // 8}").tobytes()


def bytes_int(raw: bytes, bits: int, signed: bool = True, big: bool = False) -> np.ndarray:
    size = bits // 8
    raw = raw[: len(raw) // size * size]
    if bits == 24:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3)
        b = (b[:, ::-1] if big else b).astype(np.int64)
        v = b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16
        v = np.where(v >= 1 << 23, v - (1 << 24), v) if signed else v
    else:
        v = np.frombuffer(raw, f"{'>' if big else '<'}{'i' if signed else 'u'}{size}").astype(np.int64)
    return ((v if signed else v - (1 << (bits - 1))) << (32 - bits)).astype(np.int32)


def float_bytes(s: np.ndarray, bits: int, big: bool = False) -> bytes:
    return (s / 2147483648.0).astype(f"{'>' if big else '<'}f{bits // 8}").tobytes()


def bytes_float(raw: bytes, bits: int, big: bool = False) -> np.ndarray:
    v = np.frombuffer(raw[: len(raw) // (bits // 8) * (bits // 8)], f"{'>' if big else '<'}f{bits // 8}").astype(float) * 2147483648.0
    return np.clip(np.trunc(v + np.where(v < 0, -0.5, 0.5)), -2147483648, 2147483647).astype(np.int64).astype(np.int32)


def law_bytes(s: np.ndarray, law: str, flipped: bool = False) -> bytes:
    code = laws.nearest_code(getattr(laws, f"{law}_table")(), (s.astype(np.int64) + (1 << 15)) >> 16)
    return (laws.reversed_bits()[code] if flipped else code).tobytes()


def bytes_law(raw: bytes, law: str, flipped: bool = False) -> np.ndarray:
    code = np.frombuffer(raw, np.uint8)
    return (getattr(laws, f"{law}_table")()[laws.reversed_bits()[code] if flipped else code] << 16).astype(np.int32)


class Adpcm:
    """Four-bit adaptive coding: a code moves the value by odd eighths of a step and the step along its table."""

    def __init__(self, steps: list[int], mask: int = ~0):
        self.steps, self.mask, self.value, self.index = steps, mask, 0, 0

    def decode(self, code: int) -> int:
        move = (self.steps[self.index] * (2 * (code & 7) + 1) >> 3) & self.mask
        self.value = max(-32768, min(32767, self.value - move if code & 8 else self.value + move))
        self.index = max(0, min(len(self.steps) - 1, self.index + CHANGES[code & 7]))
        return self.value

    def encode(self, value: int) -> int:
        move = value - self.value
        code = min(7, abs(move) * 4 // self.steps[self.index]) | (8 if move < 0 else 0)
        self.decode(code)
        return code


def adpcm_bytes(s: np.ndarray, steps: list[int], mask: int = ~0, high_first: bool = True) -> bytes:
    coder = Adpcm(steps, mask)
    codes = [coder.encode(int(v)) for v in s.astype(np.int64) >> 16]
    codes += [0] * (len(codes) % 2)
    return bytes(a << 4 | b if high_first else b << 4 | a for a, b in zip(codes[::2], codes[1::2]))


def bytes_adpcm(raw: bytes, steps: list[int], mask: int = ~0, high_first: bool = True) -> np.ndarray:
    coder = Adpcm(steps, mask)
    out = [coder.decode(c) for b in raw for c in ((b >> 4, b & 15) if high_first else (b & 15, b >> 4))]
    return (np.array(out, np.int64) << 16).astype(np.int32)


def delta_bytes(s: np.ndarray, over: int = 2) -> bytes:
    """Continuously variable slope delta modulation: one bit a step, least bit first."""
    bits, value, slope, last = [], 0.0, 0.01, 0
    for v in np.repeat(s / 2147483648.0, over):
        bit = int(v > value)
        last = (last << 1 | bit) & 7
        slope = min(0.3, slope * 1.1 + 0.005) if last in (0, 7) else max(0.002, slope * 0.95)
        value = value * 0.98 + (slope if bit else -slope)
        bits.append(bit)
    return np.packbits(np.array(bits, np.uint8), bitorder="little").tobytes()


def bytes_delta(raw: bytes, over: int = 2) -> np.ndarray:
    out, value, slope, last = [], 0.0, 0.01, 0
    for bit in np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little").tolist():
        last = (last << 1 | bit) & 7
        slope = min(0.3, slope * 1.1 + 0.005) if last in (0, 7) else max(0.002, slope * 0.95)
        value = value * 0.98 + (slope if bit else -slope)
        out.append(value)
    v = np.array(out[: len(out) // over * over]).reshape(-1, over).mean(1) if out else np.empty(0)
    return (np.clip(v, -1, 1) * 2147483647).astype(np.int32)
