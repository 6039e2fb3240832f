"""File formats: each reads bytes to (rate, samples[n, channels], bits) and writes them. The layouts are published ones."""

from __future__ import annotations

import struct
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from . import huffman, pcm

Read = Callable[[bytes], tuple[float, np.ndarray, int]]


@dataclass(frozen=True)
class Format:
    names: tuple[str, ...]
    read: Read | None
    write: Callable[[np.ndarray, float], bytes] | None
    channels: int = 0  # 0: any number
    rate: float = 0.0  # 0: any
    bits: int = 16  # what a round trip keeps


FORMATS: dict[str, Format] = {}


@dataclass(frozen=True)
class Layout:
    """Where a file's samples lie, if each takes `width` bytes: `length` wide samples of `channels` from byte `start` on.

    code: int, float, alaw or ulaw. kept: bits that a sample has.
    """

    rate: float
    channels: int
    start: int
    length: int
    kept: int
    code: str
    width: int
    signed: bool = True
    big: bool = False
    flipped: bool = False

    @property
    def frame(self) -> int:
        return self.width * self.channels

    def decode(self, b: bytes) -> np.ndarray:
        """(places, channels) of the bytes of whole wide samples."""
        if self.code == "int":
            s = pcm.bytes_int(b, 8 * self.width, self.signed, self.big)
        elif self.code == "float":
            s = pcm.bytes_float(b, 8 * self.width, self.big)
        else:
            s = pcm.bytes_law(b, self.code, self.flipped)
        return wide(s, self.channels)


#: Codings of headerless kinds: code, width, signed, big-endian, bits reversed, bits kept, rate and channels (0: the caller's).
CODINGS: dict[str, tuple[str, int, bool, bool, bool, int, float, int]] = {}


def put(*names: str, read: Read | None = None, write=None, **more) -> None:
    f = Format(names, read, write, **more)
    FORMATS.update(dict.fromkeys(names, f))


def wide(s: np.ndarray, channels: int) -> np.ndarray:
    return s[: len(s) // channels * channels].reshape(-1, channels)


def flat(a: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(a).reshape(-1)


# --- without a header: rate and channels are the caller's ---


def raw_reader(decode, bits: int, rate: float = 8000.0, channels: int = 1):
    return lambda b: (rate, wide(decode(b), channels), bits)


def raw(names: tuple[str, ...], decode, encode, bits: int, rate: float = 0.0, channels: int = 0) -> None:
    put(*names, read=raw_reader(decode, bits, rate or 8000.0, channels or 1), write=lambda a, r: encode(flat(a)), bits=bits, rate=rate, channels=channels or 1)


for _b in (8, 16, 24, 32):
    CODINGS |= {f"{_t}{_b // 8}": ("int", _b // 8, _t == "s", False, False, _b, 0.0, 0) for _t in "su"}
    raw({8: ("s1", "s8", "sb"), 16: ("s2", "s16", "sw", "raw"), 24: ("s3", "s24"), 32: ("s4", "s32", "sl")}[_b], lambda r, b=_b: pcm.bytes_int(r, b), lambda s, b=_b: pcm.int_bytes(s, b), _b)
    raw({8: ("u1", "u8", "ub", "sou", "fssd"), 16: ("u2", "u16", "uw"), 24: ("u3", "u24"), 32: ("u4", "u32")}[_b], lambda r, b=_b: pcm.bytes_int(r, b, False), lambda s, b=_b: pcm.int_bytes(s, b, False), _b)
for _b in (32, 64):
    CODINGS[f"f{_b // 8}"] = ("float", _b // 8, True, False, False, 24 if _b == 32 else 32, 0.0, 0)
    raw(("f4", "f32") if _b == 32 else ("f8", "f64"), lambda r, b=_b: pcm.bytes_float(r, b), lambda s, b=_b: pcm.float_bytes(s, b), 24 if _b == 32 else 32)
for _names, _law, _flip in ((("al",), "alaw", False), (("ul",), "ulaw", False), (("la",), "alaw", True), (("lu",), "ulaw", True)):
    CODINGS[_names[0]] = (_law, 1, True, False, _flip, 13 if _law == "alaw" else 14, 0.0, 0)
    raw(_names, lambda r, w=_law, f=_flip: pcm.bytes_law(r, w, f), lambda s, w=_law, f=_flip: pcm.law_bytes(s, w, f), 13 if _law == "alaw" else 14)
CODINGS |= {"sln": ("int", 2, True, False, False, 16, 8000.0, 1), "cdda": ("int", 2, True, True, False, 16, 44100.0, 2)}
raw(("sln",), lambda r: pcm.bytes_int(r, 16), lambda s: pcm.int_bytes(s, 16), 16, 8000.0, 1)
raw(("ima",), lambda r: pcm.bytes_adpcm(r, pcm.IMA_STEPS), lambda s: pcm.adpcm_bytes(s, pcm.IMA_STEPS), 13)
raw(("vox",), lambda r: pcm.bytes_adpcm(r, pcm.OKI_STEPS, ~15), lambda s: pcm.adpcm_bytes(s, pcm.OKI_STEPS, ~15), 12)
raw(("cvsd", "cvs", "cvu"), pcm.bytes_delta, pcm.delta_bytes, 8, 8000.0, 1)


def read_dvms(b: bytes) -> tuple[float, np.ndarray, int]:
    """Delta modulation after a header of 120 bytes: length in bytes at 26, rate in 100 Hz at 30."""
    size, rate = struct.unpack_from("<IH", b, 26)
    return 8000.0, wide(pcm.bytes_delta(b[120 : 120 + size] if size else b[120:]), 1), 8


def write_dvms(a: np.ndarray, rate: float) -> bytes:
    data = pcm.delta_bytes(flat(a))
    head = b"\0" * 14 + struct.pack("<HHIHHIHHHH", 0, 0, 0, 0, 0, len(data), 160, 0, 0, 0) + b"\0" * 80
    return head + struct.pack("<H", sum(head[:117]) & 0xFFFF) + data


put("dvms", "vms", read=read_dvms, write=write_dvms, channels=1, rate=8000.0, bits=7)


def _cdda(a: np.ndarray, rate: float) -> bytes:
    out = pcm.int_bytes(flat(a), 16, big=True)
    return out + b"\0" * (-len(out) % 2352)  # whole sectors


put("cdda", "cdr", read=lambda b: (44100.0, wide(pcm.bytes_int(b, 16, big=True), 2), 16), write=_cdda, channels=2, rate=44100.0)
put("null", read=lambda b: (48000.0, np.zeros((0, 1), np.int32), 1), write=lambda a, r: b"", bits=0)


# --- RIFF ---


def _decode(code: int, bits: int, data: bytes, big: bool = False, unsigned8: bool = True) -> tuple[np.ndarray, int]:
    if code == 1:
        return pcm.bytes_int(data, bits, not (bits == 8 and unsigned8), big), bits
    if code == 3:
        return pcm.bytes_float(data, bits, big), 24 if bits == 32 else 32
    if code in (6, 7):
        return pcm.bytes_law(data, "alaw" if code == 6 else "ulaw"), 13 if code == 6 else 14
    raise ValueError(f"unsupported encoding {code}")


def chunks(b: bytes, at: int, big: bool, head: str = "4s", align: int = 2):
    """(name, start, size) of chunks from `at` on; a size of all ones goes to the end."""
    while at + 8 <= len(b):
        name, size = b[at : at + 4], struct.unpack_from(">I" if big else "<I", b, at + 4)[0]
        if size == 0xFFFFFFFF:
            size = len(b) - at - 8
        yield name, at + 8, size
        at += 8 + size + (-size % align)


def ima_block(raw_block: bytes, channels: int) -> np.ndarray:
    """Samples of one block of wav's IMA ADPCM: a header of value and index by channel, then groups of eight codes."""
    coders, out = [], []
    for c in range(channels):
        value, index = struct.unpack_from("<hB", raw_block, 4 * c)
        coder = pcm.Adpcm(pcm.IMA_STEPS)
        coder.value, coder.index = value, min(88, index)
        coders.append(coder)
        out.append([value])
    for at in range(4 * channels, len(raw_block) - 4 * channels + 1, 4 * channels):
        for c, coder in enumerate(coders):
            for b in raw_block[at + 4 * c : at + 4 * c + 4]:
                out[c] += [coder.decode(b & 15), coder.decode(b >> 4)]
    return (np.array(out, np.int64).T << 16).astype(np.int32)


#: Predictor pairs and step adaptation of wav's MS ADPCM: fixed values.
MS_PAIRS = [(256, 0), (512, -256), (0, 0), (192, 64), (240, 0), (460, -208), (392, -232)]
MS_ADAPT = [230, 230, 230, 230, 307, 409, 512, 614, 768, 614, 512, 409, 307, 230, 230, 230]


def ms_block(raw_block: bytes, channels: int) -> np.ndarray:
    """Samples of one block of wav's MS ADPCM."""
    pairs = [MS_PAIRS[min(6, raw_block[c])] for c in range(channels)]
    at = channels
    step, one, two = ([struct.unpack_from("<h", raw_block, at + 2 * (k * channels + c))[0] for c in range(channels)] for k in range(3))
    out = [two[:], one[:]]
    c, row = 0, []
    for b in raw_block[7 * channels :]:
        for code in (b >> 4, b & 15):
            guess = (one[c] * pairs[c][0] + two[c] * pairs[c][1]) >> 8
            v = max(-32768, min(32767, guess + (code - 16 if code & 8 else code) * step[c]))
            step[c] = max(16, MS_ADAPT[code] * step[c] >> 8)
            two[c], one[c] = one[c], v
            row.append(v)
            c = (c + 1) % channels
            if c == 0:
                out.append(row)
                row = []
    return (np.array(out, np.int64) << 16).astype(np.int32)


def read_wav(b: bytes) -> tuple[float, np.ndarray, int]:
    if b[:4] not in (b"RIFF", b"RIFX", b"RF64") or b[8:12] != b"WAVE":
        raise ValueError("not a RIFF WAVE file")
    big = b[:4] == b"RIFX"
    e, long_size = ">" if big else "<", None
    code = channels = rate = align = bits = None
    for name, at, size in chunks(b, 12, big):
        if name == b"ds64":
            long_size = struct.unpack_from("<QQ", b, at)[1]
        elif name == b"fmt ":
            code, channels, rate, _, align, bits = struct.unpack_from(e + "HHIIHH", b, at)
            if code == 0xFFFE and size >= 40:
                code = struct.unpack_from(e + "H", b, at + 24)[0]
        elif name == b"data":
            if code is None:
                raise ValueError("no format before the data")
            data = b[at : at + (long_size if long_size and b[:4] == b"RF64" else size)]
            if code in (2, 0x11):
                block = ima_block if code == 0x11 else ms_block
                parts = [block(data[k : k + align], channels) for k in range(0, len(data), align) if len(data[k : k + align]) >= 7 * channels]
                return float(rate), np.concatenate(parts) if parts else np.zeros((0, channels), np.int32), 16
            s, kept = _decode(code, bits, data, big)
            return float(rate), wide(s, channels), kept
    raise ValueError("no data")


def write_wav(a: np.ndarray, rate: float, bits: int = 16, code: int = 1) -> bytes:
    s, channels = flat(a), a.shape[1]
    data = pcm.int_bytes(s, bits, bits > 8) if code == 1 else pcm.float_bytes(s, bits) if code == 3 else pcm.law_bytes(s, "alaw" if code == 6 else "ulaw")
    fmt = struct.pack("<HHIIHH", code, channels, int(rate + 0.5), int(rate + 0.5) * channels * bits // 8, channels * bits // 8, bits)
    if code != 1:
        fmt += b"\0\0"
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(fmt)) + fmt + (b"fact" + struct.pack("<II", 4, len(a)) if code != 1 else b"") + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def wav_layout(b: bytes, total: int) -> Layout | None:
    """From a file's first bytes and its size; None where they don't tell or samples don't lie in bytes of their own."""
    big = b[:4] == b"RIFX"
    e, long_size, fmt = ">" if big else "<", None, None
    for name, at, size in chunks(b, 12, big):
        if name == b"ds64" and at + 16 <= len(b):
            long_size = struct.unpack_from("<QQ", b, at)[1]
        elif name == b"fmt " and at + 16 <= len(b):
            fmt = struct.unpack_from(e + "HHIIHH", b, at)
            if fmt[0] == 0xFFFE and size >= 40 and at + 26 <= len(b):
                fmt = (struct.unpack_from(e + "H", b, at + 24)[0], *fmt[1:])
        elif name == b"data" and fmt:
            code, channels, rate, _, _, bits = fmt
            size = long_size if long_size and b[:4] == b"RF64" else struct.unpack_from(e + "I", b, at - 4)[0]
            if code not in (1, 3, 6, 7) or not channels or not bits:
                return None
            width = -(-bits // 8)
            kept = {3: 24 if bits == 32 else 32, 6: 13, 7: 14}.get(code, bits)
            return Layout(float(rate), channels, at, min(size, total - at) // (channels * width), kept, {1: "int", 3: "float", 6: "alaw", 7: "ulaw"}[code], width, bits > 8, big)
    return None


def to_the_end(b: bytes) -> bytes:
    """A RIFF file whose data goes to the file's end, whatever its header says."""
    for name, at, _ in chunks(b, 12, b[:4] == b"RIFX"):
        if name == b"data":
            return b[: at - 4] + b"\xff" * 4 + b[at:]
    return b


put("wav", "wavpcm", "amb", read=read_wav, write=write_wav)
for _name, _bits, _code, _kept in (("wav8", 8, 1, 8), ("wav24", 24, 1, 24), ("wav32", 32, 1, 32), ("wav_float", 32, 3, 24), ("wav_alaw", 8, 6, 13), ("wav_ulaw", 8, 7, 14)):
    put(_name, read=read_wav, write=lambda a, r, b=_bits, c=_code: write_wav(a, r, b, c), bits=_kept)


# --- AIFF ---


def extended(v: float) -> bytes:
    """80-bit IEEE number of a positive value."""
    m, e = np.frexp(v)
    return struct.pack(">HQ", 16382 + int(e), int(m * (1 << 63)) << 1)


def from_extended(b: bytes) -> float:
    e, m = struct.unpack(">HQ", b)
    return float(m) * 2.0 ** ((e & 0x7FFF) - 16383 - 63)


def read_aiff(b: bytes) -> tuple[float, np.ndarray, int]:
    if b[:4] != b"FORM" or b[8:12] not in (b"AIFF", b"AIFC"):
        raise ValueError("not an AIFF file")
    channels = bits = rate = None
    kind = b"NONE"
    for name, at, size in chunks(b, 12, True):
        if name == b"COMM":
            channels, _, bits = struct.unpack_from(">HIH", b, at)
            rate = from_extended(b[at + 8 : at + 18])
            if b[8:12] == b"AIFC":
                kind = b[at + 18 : at + 22]
        elif name == b"SSND":
            data = b[at + 8 + struct.unpack_from(">I", b, at)[0] : at + size]
            s, kept = (pcm.bytes_float(data, 32 if kind.lower() == b"fl32" else 64, True), 24) if kind.lower() in (b"fl32", b"fl64") else _decode({b"alaw": 6, b"ulaw": 7}.get(kind.lower(), 1), -(-bits // 8) * 8, data, kind != b"sowt", False)
            return rate, wide(s, channels), kept
    raise ValueError("no sound data")


def write_aiff(a: np.ndarray, rate: float, bits: int = 16, kind: bytes | None = None) -> bytes:
    data = pcm.float_bytes(flat(a), 32, True) if kind == b"fl32" else pcm.int_bytes(flat(a), bits, True, kind != b"sowt")
    comm = struct.pack(">HIH", a.shape[1], len(a), bits) + extended(rate) + (kind + b"\0\0" if kind else b"")
    body = (b"AIFC" + b"FVER" + struct.pack(">II", 4, 0xA2805140) if kind else b"AIFF") + b"COMM" + struct.pack(">I", len(comm)) + comm + b"SSND" + struct.pack(">III", len(data) + 8, 0, 0) + data + b"\0" * (len(data) % 2)
    return b"FORM" + struct.pack(">I", len(body)) + body


def aiff_layout(b: bytes, total: int) -> Layout | None:
    common = None
    for name, at, _ in chunks(b, 12, True):
        if name == b"COMM" and at + 22 <= len(b):
            channels, length, bits = struct.unpack_from(">HIH", b, at)
            kind = b[at + 18 : at + 22].lower() if b[8:12] == b"AIFC" else b"none"
            width = {b"alaw": 1, b"ulaw": 1, b"fl32": 4, b"fl64": 8}.get(kind, -(-bits // 8))
            kept = {b"alaw": 13, b"ulaw": 14, b"fl32": 24, b"fl64": 24}.get(kind, 8 * width)
            code = {b"alaw": "alaw", b"ulaw": "ulaw", b"fl32": "float", b"fl64": "float"}.get(kind, "int")
            common = from_extended(b[at + 8 : at + 18]), channels, length, kept, code, width, kind != b"sowt"
        elif name == b"SSND" and common and at + 4 <= len(b):
            rate, channels, length, kept, code, width, big = common
            start = at + 8 + struct.unpack_from(">I", b, at)[0]
            return Layout(rate, channels, start, min(length, (total - start) // (width * channels)), kept, code, width, True, big)
    return None


put("aiff", "aif", read=read_aiff, write=write_aiff)
put("aifc", "aiffc", read=read_aiff, write=lambda a, r: write_aiff(a, r, 16, b"sowt"))
put("aifc_float", read=read_aiff, write=lambda a, r: write_aiff(a, r, 32, b"fl32"), bits=24)


# --- others with plain headers ---


def read_au(b: bytes) -> tuple[float, np.ndarray, int]:
    big = b[:4] == b".snd"
    if not big and b[:4] != b"dns.":
        raise ValueError("not an au file")
    start, size, code, rate, channels = struct.unpack_from(">5I" if big else "<5I", b, 4)
    data = b[start:] if size == 0xFFFFFFFF else b[start : start + size]
    codes = {1: (7, 8), 2: (1, 8), 3: (1, 16), 4: (1, 24), 5: (1, 32), 6: (3, 32), 7: (3, 64), 27: (6, 8)}
    if code not in codes:
        name = {23: " (G.721 ADPCM)", 25: " (G.723 ADPCM, 3 bits)", 26: " (G.723 ADPCM, 5 bits)"}.get(code, "")
        raise ValueError(f"au encoding {code}{name} is not covered")
    kind, bits = codes[code]
    s, kept = _decode(kind, bits, data, big, False)
    return float(rate), wide(s, channels), kept


def au_layout(b: bytes, total: int) -> Layout | None:
    big = b[:4] == b".snd"
    start, size, code, rate, channels = struct.unpack_from(">5I" if big else "<5I", b, 4)
    kind, width, kept = {1: ("ulaw", 1, 14), 2: ("int", 1, 8), 3: ("int", 2, 16), 4: ("int", 3, 24), 5: ("int", 4, 32), 6: ("float", 4, 24), 7: ("float", 8, 32), 27: ("alaw", 1, 13)}.get(code, ("", 0, 0))
    return Layout(float(rate), channels, start, min(size, total - start) // (width * channels), kept, kind, width, True, big) if width and channels else None


def write_au(a: np.ndarray, rate: float) -> bytes:
    data = pcm.int_bytes(flat(a), 16, big=True)
    return b".snd" + struct.pack(">5I", 28, len(data), 3, int(rate + 0.5), a.shape[1]) + b"\0\0\0\0" + data


put("au", "snd", read=read_au, write=write_au)


#: First bytes of this library's 32-bit intermediate format, little-endian.
NATIVE = b"Undu"


def read_native(b: bytes) -> tuple[float, np.ndarray, int]:
    e = {NATIVE: "<", NATIVE[::-1]: ">"}.get(b[:4])
    if not e:
        raise ValueError("not in the native format")
    header, n, rate, channels, _ = struct.unpack_from(e + "IQdII", b, 4)
    return rate, wide(pcm.bytes_int(b[4 + header :], 32, big=e == ">")[:n], channels), 32


def native_layout(b: bytes, total: int) -> Layout | None:
    e = "<" if b[:4] == NATIVE else ">"
    header, n, rate, channels, _ = struct.unpack_from(e + "IQdII", b, 4)
    return Layout(rate, channels, 4 + header, min(n, (total - 4 - header) // 4) // channels, 32, "int", 4, True, e == ">") if channels else None


put("native", read=read_native, write=lambda a, r: NATIVE + struct.pack("<IQdII", 28, a.size, r, a.shape[1], 0) + pcm.int_bytes(flat(a), 32), bits=32)


def read_dat(b: bytes) -> tuple[float, np.ndarray, int]:
    rate, rows = 0.0, []
    for line in b.decode("ascii", "replace").splitlines():
        words = line.split()
        if line.lstrip().startswith(";"):
            if words[:3] == [";", "Sample", "Rate"]:
                rate = float(words[3])
        elif words:
            rows.append([float(v) for v in words])
    a = np.array(rows)
    if not len(a):
        return rate or 48000.0, np.zeros((0, 1), np.int32), 24
    rate = rate or float(np.round((len(a) - 1) / max(1e-12, a[-1, 0] - a[0, 0])))
    return rate, np.clip(np.rint(a[:, 1:] * 2147483648.0), -2147483648, 2147483647).astype(np.int64).astype(np.int32), 24


def write_dat(a: np.ndarray, rate: float) -> bytes:
    head = f"; Sample Rate {rate:.8g}\n; Channels {a.shape[1]}\n"
    return (head + "".join(f"{k / rate:15.8g} " + " ".join(f"{v / 2147483648.0:15.11g}" for v in row) + "\n" for k, row in enumerate(a.tolist()))).encode()


put("dat", read=read_dat, write=write_dat, bits=24)


def read_svx(b: bytes) -> tuple[float, np.ndarray, int]:
    if b[:4] != b"FORM" or b[8:12] != b"8SVX":
        raise ValueError("not an 8SVX file")
    rate, channels = 0.0, 1
    for name, at, size in chunks(b, 12, True):
        if name == b"VHDR":
            rate = float(struct.unpack_from(">H", b, at + 12)[0])
        elif name == b"CHAN":
            channels = {2: 1, 4: 1, 6: 2, 30: 4}[struct.unpack_from(">I", b, at)[0]]
        elif name == b"BODY":
            s = pcm.bytes_int(b[at : at + size], 8)
            n = len(s) // channels
            return rate, s[: n * channels].reshape(channels, n).T, 8  # one channel after the other
    raise ValueError("no body")


def write_svx(a: np.ndarray, rate: float) -> bytes:
    data = b"".join(pcm.int_bytes(a[:, c], 8) for c in range(a.shape[1]))
    vhdr = struct.pack(">IIIHBBI", len(a), 0, 0, int(rate + 0.5), 1, 0, 0x10000)
    body = b"8SVX" + b"VHDR" + struct.pack(">I", len(vhdr)) + vhdr + (b"CHAN" + struct.pack(">II", 4, {1: 2, 2: 6, 4: 30}[a.shape[1]]) if a.shape[1] > 1 else b"") + b"BODY" + struct.pack(">I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"FORM" + struct.pack(">I", len(body)) + body


put("8svx", read=read_svx, write=write_svx, bits=8)


def read_avr(b: bytes) -> tuple[float, np.ndarray, int]:
    if b[:4] != b"2BIT":
        raise ValueError("not an AVR file")
    stereo, bits, signed = struct.unpack_from(">HHH", b, 12)
    rate, n = struct.unpack_from(">II", b, 22)
    return float(rate & 0xFFFFFF), wide(pcm.bytes_int(b[128:], bits, bool(signed), True)[: n or None], 2 if stereo else 1), bits


def write_avr(a: np.ndarray, rate: float) -> bytes:
    stereo = 0xFFFF if a.shape[1] == 2 else 0
    head = b"2BIT" + b"\0" * 8 + struct.pack(">5H", stereo, 16, 0xFFFF, 0, 0xFFFF) + struct.pack(">4I3H", int(rate + 0.5), a.size, 0, a.size, 0, 0, 0)
    return head.ljust(128, b"\0") + pcm.int_bytes(flat(a), 16, big=True)


put("avr", read=read_avr, write=write_avr)


def read_htk(b: bytes) -> tuple[float, np.ndarray, int]:
    n, period, size, kind = struct.unpack_from(">IIHH", b)
    if kind:
        raise ValueError("not a waveform")
    return 1e7 / period, wide(pcm.bytes_int(b[12:], size * 8, big=True)[:n], 1), size * 8


put("htk", read=read_htk, write=lambda a, r: struct.pack(">IIHH", len(a), int(1e7 / r + 0.5), 2, 0) + pcm.int_bytes(flat(a), 16, big=True), channels=1)


def read_ircam(b: bytes) -> tuple[float, np.ndarray, int]:
    if b[:2] == b"\x64\xa3":
        big = b[2] in (2, 4)
    elif b[2:4] == b"\xa3\x64":
        big = b[1] in (1, 3)
    else:
        raise ValueError("not an IRCAM file")
    rate, channels, code = struct.unpack_from((">" if big else "<") + "fII", b, 4)
    kind, bits = {0x10001: (6, 8), 0x20001: (7, 8), 1: (1, 8), 2: (1, 16), 3: (1, 24), 0x40004: (1, 32), 4: (3, 32), 8: (3, 64)}[code]
    s, kept = _decode(kind, bits, b[1024:], big, False)
    return float(rate), wide(s, channels), kept


put("sf", "ircam", read=read_ircam, write=lambda a, r: (b"\x64\xa3\x01\0" + struct.pack("<fIIHH", r, a.shape[1], 2, 2, 4)).ljust(1024, b"\0") + pcm.int_bytes(flat(a), 16))


def read_smp(b: bytes) -> tuple[float, np.ndarray, int]:
    if b[:18] != b"SOUND SAMPLE DATA ":
        raise ValueError("not a SampleVision file")
    n = struct.unpack_from("<I", b, 112)[0]
    tail = 116 + 2 * n + 2 + 8 * 11 + 8 * 14 + 1
    return float(struct.unpack_from("<I", b, tail)[0]), wide(pcm.bytes_int(b[116 : 116 + 2 * n], 16), 1), 16


def write_smp(a: np.ndarray, rate: float) -> bytes:
    head = b"SOUND SAMPLE DATA " + b"2.1 " + b" " * 60 + b" " * 30 + struct.pack("<I", len(a))
    loops = struct.pack("<IIBH", 0xFFFFFFFF, 0, 0, 0) * 8 + (b"\0" * 10 + struct.pack("<I", 0xFFFFFFFF)) * 8
    return head + pcm.int_bytes(flat(a), 16) + b"\0\0" + loops + struct.pack("<bIII", 60, int(rate + 0.5), 0, 0xFFFFFFFF)


put("smp", read=read_smp, write=write_smp, channels=1)


def read_sndr(b: bytes) -> tuple[float, np.ndarray, int]:
    kind, rate = struct.unpack_from("<HH", b)
    if kind:
        raise ValueError("not a Sounder file")
    return float(rate), wide(pcm.bytes_int(b[8:], 8, False), 1), 8


put("sndr", read=read_sndr, write=lambda a, r: struct.pack("<4H", 0, min(65535, int(r + 0.5)), 10, 4) + pcm.int_bytes(flat(a), 8, False), channels=1, bits=8)


def read_sndt(b: bytes) -> tuple[float, np.ndarray, int]:
    if b[:6] != b"SOUND\x1a":
        raise ValueError("not a SoundTool file")
    n, rate = struct.unpack_from("<IH", b, 16)
    return float(rate), wide(pcm.bytes_int(b[124:], 8, False)[: n or None], 1), 8


put("sndt", read=read_sndt, write=lambda a, r: b"SOUND\x1a" + struct.pack("<HIIIHHHH", 0, len(a), 0, len(a), min(65535, int(r + 0.5)), 0, 10, 4) + b"\0" * 96 + pcm.int_bytes(flat(a), 8, False), channels=1, bits=8)


def read_sphere(b: bytes) -> tuple[float, np.ndarray, int]:
    if b[:7] != b"NIST_1A":
        raise ValueError("not a SPHERE file")
    size = int(b[8:16])
    fields = {w[0]: w[2] for line in b[16:size].decode("ascii", "replace").splitlines() if len(w := line.split()) >= 3}
    width, law = int(fields.get("sample_n_bytes", 2)), fields.get("sample_coding", "pcm") in ("ulaw", "mu-law")
    s = pcm.bytes_law(b[size:], "ulaw") if law else pcm.bytes_int(b[size:], 8 * width, big=fields.get("sample_byte_format") == "10")
    return float(fields.get("sample_rate", 16000)), wide(s, int(fields.get("channel_count", 1))), 14 if law else 8 * width


def write_sphere(a: np.ndarray, rate: float) -> bytes:
    head = f"NIST_1A\n   1024\nsample_count -i {len(a)}\nsample_n_bytes -i 2\nchannel_count -i {a.shape[1]}\nsample_byte_format -s2 01\nsample_rate -i {int(rate + 0.5)}\nsample_coding -s3 pcm\nend_head\n"
    return head.encode().ljust(1024) + pcm.int_bytes(flat(a), 16)


put("sph", "nist", read=read_sphere, write=write_sphere)


def read_wve(b: bytes) -> tuple[float, np.ndarray, int]:
    if b[:15] != b"ALawSoundFile**":
        raise ValueError("not a Psion file")
    return 8000.0, wide(pcm.bytes_law(b[32:], "alaw"), 1), 13


put("wve", read=read_wve, write=lambda a, r: b"ALawSoundFile**\0\x0f\x10" + struct.pack(">I", len(a)) + b"\0\0\0\1\0\0\0\0\0\0" + pcm.law_bytes(flat(a), "alaw"), channels=1, rate=8000.0, bits=13)


def read_gsrt(b: bytes) -> tuple[float, np.ndarray, int]:
    if b[16:24] != b"ring.bin":
        raise ValueError("not a ring tone")
    code = struct.unpack_from(">h", b, 34)[0]
    start = struct.unpack_from(">h", b, 32)[0] * 2 or 512
    return 8000.0, wide(pcm.bytes_law(b[start:], "alaw" if code == 8 else "ulaw"), 1), 13 if code == 8 else 14


def write_gsrt(a: np.ndarray, rate: float) -> bytes:
    body = pcm.law_bytes(flat(a), "alaw")
    body += b"\0" * (len(body) % 2)
    rest = struct.pack(">I6s", 0x1000000, b"\0" * 6)[:10] + b"ring.bin".ljust(16, b"\0") + struct.pack(">hh", 256, 8)
    rest = rest.ljust(512 - 6, b"\0") + body
    size = (len(rest) + 6) // 2
    check = -(sum(struct.unpack(f">{len(rest) // 2}h", rest)) + (size >> 16) + size) & 0xFFFF
    return struct.pack(">IH", size, check) + rest


put("gsrt", read=read_gsrt, write=write_gsrt, channels=1, rate=8000.0, bits=13)


def read_maud(b: bytes) -> tuple[float, np.ndarray, int]:
    if b[:4] != b"FORM" or b[8:12] != b"MAUD":
        raise ValueError("not a MAUD file")
    bits = channels = rate = code = None
    for name, at, size in chunks(b, 12, True):
        if name == b"MHDR":
            _, bits, _, clock, by, layout, channels, code = struct.unpack_from(">IHHIHHHH", b, at)
            rate = clock / by
        elif name == b"MDAT":
            s, kept = _decode({0: 1, 2: 6, 3: 7}[code], bits, b[at : at + size], True)
            return float(rate), wide(s, channels), kept
    raise ValueError("no data")


def write_maud(a: np.ndarray, rate: float) -> bytes:
    data = pcm.int_bytes(flat(a), 16, big=True)
    head = struct.pack(">IHHIHHHH", a.size, 16, 16, int(rate + 0.5), 1, 1 if a.shape[1] == 2 else 0, a.shape[1], 0) + b"\0" * 12
    body = b"MAUD" + b"MHDR" + struct.pack(">I", len(head)) + head + b"MDAT" + struct.pack(">I", len(data)) + data
    return b"FORM" + struct.pack(">I", len(body)) + body


put("maud", read=read_maud, write=write_maud)


def read_voc(b: bytes) -> tuple[float, np.ndarray, int]:
    """Typed blocks: sound in 8 bits or (type 9) others, continuation, silence, repeats."""
    if b[:20] != b"Creative Voice File\x1a":
        raise ValueError("not a VOC file")
    at, rate, channels, parts, bits, again = struct.unpack_from("<H", b, 20)[0], None, 1, [], 8, []
    code = 0
    while at < len(b) and b[at]:
        kind, size = b[at], int.from_bytes(b[at + 1 : at + 4], "little")
        body = b[at + 4 : at + 4 + size]
        if kind == 8:
            rate, channels = 256e6 / (65536 - struct.unpack_from("<H", body)[0]), body[3] + 1
            rate /= channels
        elif kind in (1, 2):
            if kind == 1:
                rate = rate or 1e6 / (256 - body[0])
                code, body = body[1], body[2:]
            if code:
                raise ValueError("packed sound")
            parts.append(pcm.bytes_int(body, 8, False))
        elif kind == 3:
            rate = rate or 1e6 / (256 - body[2])
            parts.append(np.zeros((struct.unpack_from("<H", body)[0] + 1) * channels, np.int32))
        elif kind == 6:
            again.append((len(parts), struct.unpack_from("<H", body)[0]))
        elif kind == 7 and again:
            start, count = again.pop()
            parts += parts[start:] * (count if count != 0xFFFF else 0)
        elif kind == 9:
            rate, bits, channels, code = struct.unpack_from("<IBBH", body)
            s, bits = _decode({0: 1, 4: 1, 6: 6, 7: 7}[code], bits, body[12:])
            parts.append(s)
        at += 4 + size
    return float(round(rate or 8000)), wide(np.concatenate(parts) if parts else np.zeros(0, np.int32), channels), bits


def write_voc(a: np.ndarray, rate: float) -> bytes:
    data = pcm.int_bytes(flat(a), 16)
    out = b"Creative Voice File\x1a" + struct.pack("<HHH", 26, 0x0114, ~0x0114 + 0x1234 & 0xFFFF)
    top = (1 << 24) - 1 - 12 & ~3
    for k in range(0, max(1, len(data)), top):
        part = data[k : k + top]
        out += b"\x09" + (len(part) + 12).to_bytes(3, "little") + struct.pack("<IBBHI", int(rate + 0.5), 16, a.shape[1], 4, 0) + part
    return out + b"\0"


put("voc", read=read_voc, write=write_voc)


def read_txw(b: bytes) -> tuple[float, np.ndarray, int]:
    if b[:6] != b"LM8953":
        raise ValueError("not a TX16W file")
    rate = {1: 1e5 / 3, 2: 1e5 / 2, 3: 1e5 / 6}.get(b[23], 1e5 / 3)
    attack, loop = (int.from_bytes([b[k], b[k + 1], b[k + 2] & 1], "little") for k in (24, 27))
    body = np.frombuffer(b[32 : 32 + (len(b) - 32) // 3 * 3], np.uint8).reshape(-1, 3).astype(np.int64)
    v = np.stack([body[:, 0] << 4 | body[:, 1] >> 4, body[:, 2] << 4 | body[:, 1] & 15], 1).reshape(-1)[: attack + loop]
    return rate, wide((np.where(v >= 2048, v - 4096, v) << 20).astype(np.int32), 1), 12


def write_txw(a: np.ndarray, rate: float) -> bytes:
    v = np.minimum((flat(a).astype(np.int64) + (1 << 19)) >> 20, 2047) & 0xFFF
    n = len(v)
    v = np.pad(v, (0, n % 2)).reshape(-1, 2)
    body = np.stack([v[:, 0] >> 4, (v[:, 0] & 15) << 4 | v[:, 1] & 15, v[:, 1] >> 4], 1).astype(np.uint8).tobytes()
    code = min({1: 1e5 / 3, 2: 1e5 / 2, 3: 1e5 / 6}.items(), key=lambda p: abs(p[1] - rate))[0]
    length = lambda k, m: bytes([k & 255, k >> 8 & 255, (k >> 16 & 1) | m])
    return b"LM8953" + b"\0" * 16 + bytes([0xC9, code]) + length(n, {1: 6, 2: 16, 3: 246}[code] & ~1) + length(0, {1: 82, 2: 0, 3: 82}[code] & ~1) + b"\0\0" + body


put("txw", read=read_txw, write=write_txw, channels=1, rate=1e5 / 3, bits=12)

_W64 = {k: bytes.fromhex(v) for k, v in {"riff": "726966662e91cf11a5d628db04c10000", "wave": "77617665f3acd3118cd100c04f8edb8a", "fmt ": "666d7420f3acd3118cd100c04f8edb8a", "data": "64617461f3acd3118cd100c04f8edb8a"}.items()}


def read_w64(b: bytes) -> tuple[float, np.ndarray, int]:
    if b[:16] != _W64["riff"]:
        raise ValueError("not a Wave64 file")
    at, fmt = 40, None
    while at + 24 <= len(b):
        name, size = b[at : at + 16], struct.unpack_from("<Q", b, at + 16)[0]
        if name == _W64["fmt "]:
            fmt = struct.unpack_from("<HHIIHH", b, at + 24)
        elif name == _W64["data"]:
            s, kept = _decode(fmt[0], fmt[5], b[at + 24 : at + size])
            return float(fmt[2]), wide(s, fmt[1]), kept
        at += size + (-size % 8)
    raise ValueError("no data")


def write_w64(a: np.ndarray, rate: float) -> bytes:
    data, c, r = pcm.int_bytes(flat(a), 16), a.shape[1], int(rate + 0.5)
    body = _W64["wave"] + _W64["fmt "] + struct.pack("<QHHIIHH", 40, 1, c, r, r * c * 2, c * 2, 16) + _W64["data"] + struct.pack("<Q", 24 + len(data)) + data
    return _W64["riff"] + struct.pack("<Q", 24 + len(body)) + body


put("w64", read=read_w64, write=write_w64)


def read_caf(b: bytes) -> tuple[float, np.ndarray, int]:
    if b[:4] != b"caff":
        raise ValueError("not a CAF file")
    at, d = 8, None
    while at + 12 <= len(b):
        name, size = b[at : at + 4], struct.unpack_from(">q", b, at + 4)[0]
        if name == b"desc":
            d = struct.unpack_from(">d4sIIIII", b, at + 12)
        elif name == b"data":
            end = len(b) if size < 0 else at + 12 + size
            s, kept = _decode({b"alaw": 6, b"ulaw": 7}.get(d[1], 3 if d[2] & 1 else 1), d[6], b[at + 16 : end], not d[2] & 2, False)
            return d[0], wide(s, d[5]), kept
        at += 12 + size
    raise ValueError("no data")


def write_caf(a: np.ndarray, rate: float) -> bytes:
    c, data = a.shape[1], pcm.int_bytes(flat(a), 16, big=True)
    return b"caff\0\1\0\0" + b"desc" + struct.pack(">qd4sIIIII", 32, rate, b"lpcm", 0, 2 * c, 1, c, 16) + b"data" + struct.pack(">qI", len(data) + 4, 0) + data


put("caf", read=read_caf, write=write_caf)


def read_pvf(b: bytes) -> tuple[float, np.ndarray, int]:
    head, _, rest = b.partition(b"\n")
    if head != b"PVF1":
        raise ValueError("not a PVF file")
    line, _, data = rest.partition(b"\n")
    channels, rate, bits = map(int, line.split())
    return float(rate), wide(pcm.bytes_int(data, bits, big=True), channels), bits


put("pvf", read=read_pvf, write=lambda a, r: f"PVF1\n{a.shape[1]} {int(r + 0.5)} 32\n".encode() + pcm.int_bytes(flat(a), 32, big=True), bits=32)


def read_mat4(b: bytes) -> tuple[float, np.ndarray, int]:
    at, found = 0, {}
    while at + 20 <= len(b):
        kind, rows, columns, _, size = struct.unpack_from("<5I", b, at)
        name = b[at + 20 : at + 20 + size - 1].decode()
        dtype = {0: "<f8", 10: "<f4", 20: "<i4", 30: "<i2"}[kind]
        v = np.frombuffer(b, dtype, rows * columns, at + 20 + size)
        found[name] = (kind, v.reshape(columns, rows))
        at += 20 + size + v.nbytes
    kind, v = found["wavedata"]
    s = v.astype(np.int64) << (0 if kind == 20 else 16) if kind >= 20 else np.clip(np.rint(v * 2147483648.0), -2147483648, 2147483647).astype(np.int64)
    return float(found["samplerate"][1][0, 0]), s.astype(np.int32), 16 if kind == 30 else 32


def write_mat4(a: np.ndarray, rate: float) -> bytes:
    return struct.pack("<5I", 0, 1, 1, 0, 11) + b"samplerate\0" + struct.pack("<d", rate) + struct.pack("<5I", 30, a.shape[1], len(a), 0, 9) + b"wavedata\0" + pcm.int_bytes(flat(a), 16)


put("mat4", "mat", read=read_mat4, write=write_mat4)


def read_xa(b: bytes) -> tuple[float, np.ndarray, int]:
    """Maxis XA: 15-byte blocks by channel of a coder byte and 28 four-bit codes; read only."""
    if b[:3] != b"XA\0" and b[:2] != b"XA":
        raise ValueError("not an XA file")
    _, _, channels, rate, _, _, _ = struct.unpack_from("<IHHIIHH", b, 4)
    one, two = (0, 240, 460, 392), (0, 0, -208, -220)
    now, before, out = [0] * channels, [0] * channels, [[] for _ in range(channels)]
    for at in range(24, len(b) - 15 * channels + 1, 15 * channels):
        block = b[at : at + 15 * channels]
        for c in range(channels):
            head = block[c]
            f, shift = head >> 4 & 3, (head & 15) + 8
            for byte in block[channels + c :: channels]:
                for code in (byte >> 4, byte & 15):
                    v = ((code - 16 if code & 8 else code) << 28 >> shift) + now[c] * one[f] + before[c] * two[f] + 0x80 >> 8
                    before[c], now[c] = now[c], max(-32768, min(32767, v))
                    out[c].append(now[c])
    return float(rate), (np.array(out, np.int64).T << 16).astype(np.int32), 16


put("xa", read=read_xa)

#: First bytes that tell a format: (offset, bytes, name). Fixed values.
MAGIC = [
    (8, b"WAVE", "wav"), (8, b"AIFF", "aiff"), (8, b"AIFC", "aifc"), (8, b"8SVX", "8svx"), (8, b"MAUD", "maud"), (0, b".snd", "au"), (0, b"dns.", "au"), (0, NATIVE, "native"), (0, NATIVE[::-1], "native"), (0, b"2BIT", "avr"), (0, b"NIST_1A", "sph"),
    (0, b"SOUND\x1a", "sndt"), (0, b"SOUND SAMPLE DATA ", "smp"), (0, b"ALawSoundFile**", "wve"), (0, b"Creative Voice File\x1a", "voc"), (0, b"LM8953", "txw"), (0, b"caff", "caf"), (0, b"riff.\x91", "w64"), (0, b"PVF1", "pvf"), (16, b"ring.bin", "gsrt"), (0, b"XA\0\0", "xa"), (0, b"\x64\xa3", "sf"), (2, b"\xa3\x64", "sf"), (128, b"HCOM", "hcom"),
]


def detect(b: bytes, path: str | None = "") -> str:
    """A format's name by the first bytes, else by the file's extension."""
    for at, mark, name in MAGIC:
        if b[at : at + len(mark)] == mark:
            return name
    end = (path or "").rsplit(".", 1)[-1].lower()
    if end in FORMATS:
        return end
    raise ValueError(f"no known format: {path!r}")


# --- Huffman-coded sound in a MacBinary file ---


def read_hcom(b: bytes) -> tuple[float, np.ndarray, int]:
    if b[65:69] != b"FSSD" or b[128:132] != b"HCOM":
        raise ValueError("not an HCOM file")
    count, check, kind, divisor, size = struct.unpack_from(">IIIIH", b, 132)
    if kind > 1 or not 1 <= divisor <= 4 or not 0 < size < 512:
        raise ValueError("a bad HCOM header")
    b = b[: 128 + struct.unpack_from(">I", b, 83)[0]]  # what follows fills up a block
    at = 150 + 4 * size
    pairs = np.frombuffer(b, ">i2", 2 * size, 150).reshape(-1, 2).tolist()
    if not count:
        return 22050.0 / divisor, np.zeros((0, 1), np.int32), 8
    words = np.frombuffer(b[at + 2 : at + 2 + (len(b) - at - 2) // 4 * 4], ">u4")
    values, used = huffman.decoded(huffman.Tree(pairs), words.tobytes(), count - 1)
    if int(words[: -(-used // 32)].astype(np.uint64).sum()) & 0xFFFFFFFF != check:
        raise ValueError("the HCOM checksum is wrong")
    v = np.concatenate([[b[at + 1]], values])
    v = np.cumsum(v) & 0xFF if kind else v  # differences, or values
    return 22050.0 / divisor, wide(pcm.bytes_int(v.astype(np.uint8).tobytes(), 8, False), 1), 8


def write_hcom(a: np.ndarray, rate: float) -> bytes:
    v = np.frombuffer(pcm.int_bytes(flat(a), 8, False), np.uint8)
    moves = np.diff(v)  # modulo 256
    tree = huffman.Tree.of(np.bincount(moves, minlength=256))
    words = huffman.encoded(tree, moves)
    check = int(np.frombuffer(words, ">u4").astype(np.uint64).sum()) & 0xFFFFFFFF
    divisor = max(1, min(4, int(22050 / rate + 0.5)))
    fork = b"HCOM" + struct.pack(">IIIIH", len(v), check, 1, divisor, len(tree.pairs)) + np.array(tree.pairs, ">i2").tobytes() + b"\0" + v[:1].tobytes() + words
    head = b"\0\1A".ljust(65, b"\0") + b"FSSD".ljust(18, b"\0") + struct.pack(">II", len(fork), 0)
    return head.ljust(128, b"\0") + fork + b"\0" * (-len(fork) % 128)


put("hcom", read=read_hcom, write=write_hcom, channels=1, rate=22050.0, bits=8)

# --- Psion records ---

#: First bytes of a record of the Psion Series 5: identifiers, their checksum and the table of two sections. Fixed values.
RECORD = bytes.fromhex("37000010" "6d000010" "7e000010" "cfac0855" "14000000" "04" "52000010" "34000000" "89000010" "25000000" "7e000010")


def read_prc(b: bytes) -> tuple[float, np.ndarray, int]:
    if b[:41] != RECORD:
        raise ValueError("not a Psion record")
    length, code = struct.unpack_from("<II", b, 0x34)
    if code:
        raise ValueError("ADPCM in Psion records is not covered")
    size = struct.unpack_from("<I", b, 0x34 + 16)[0]
    at = 0x34 + 20
    return 8000.0, wide(pcm.bytes_law(b[at : at + min(size, length)], "alaw"), 1), 13


def write_prc(a: np.ndarray, rate: float) -> bytes:
    data = pcm.law_bytes(flat(a), "alaw")
    name = b"Record.app"
    head = (RECORD + bytes([4 * len(name) + 2]) + name).ljust(0x34, b"\0")
    return head + struct.pack("<IIHBBII", len(data), 0, 0, 3, 0, 0, len(data)) + data


put("prc", read=read_prc, write=write_prc, channels=1, rate=8000.0, bits=13)

#: Layouts by a file's first bytes.
HEADERS: dict[bytes, Callable[[bytes, int], Layout | None]] = {b"RIFF": wav_layout, b"RIFX": wav_layout, b"RF64": wav_layout, b"FORM": aiff_layout, b".snd": au_layout, b"dns.": au_layout, NATIVE: native_layout, NATIVE[::-1]: native_layout}


def layout(b: bytes, total: int, kind: str | None = None, rate: float | None = None, channels: int | None = None, path: str = "") -> Layout | None:
    """The layout of a file by its first bytes and size, or of a headerless kind; None for files to be decoded as a whole."""
    kind = kind or detect(b[:256], path)
    name = FORMATS[kind].names[0]
    if name in CODINGS:
        code, width, signed, big, flipped, kept, own_rate, own_channels = CODINGS[name]
        channels = own_channels or channels or 1
        return Layout(own_rate or rate or 8000.0, channels, 0, total // (width * channels), kept, code, width, signed, big, flipped)
    found = HEADERS.get(b[:4])
    return found(b, total) if found else None


# --- comments in headers ---


def au_comments(b: bytes) -> list[str]:
    start = struct.unpack_from(">I" if b[:4] == b".snd" else "<I", b, 4)[0]
    return b[24:start].rstrip(b"\0").decode("utf-8", "replace").splitlines()


def au_with_comments(b: bytes, comments: list[str]) -> bytes:
    note = "\n".join(comments).encode() + b"\0"
    note += b"\0" * (-len(note) % 8)
    start = struct.unpack_from(">I", b, 4)[0]
    return b[:4] + struct.pack(">I", 24 + len(note)) + b[8:24] + note + b[start:]


def aiff_comments(b: bytes) -> list[str]:
    return [b[at : at + size].rstrip(b"\0").decode("utf-8", "replace") for name, at, size in chunks(b, 12, True) if name == b"ANNO" and at + size <= len(b)]


def aiff_with_comments(b: bytes, comments: list[str]) -> bytes:
    """Annotations come before the sound, so that the first bytes tell them."""
    at = next(at for name, at, _ in chunks(b, 12, True) if name == b"SSND") - 8
    notes = b"".join(b"ANNO" + struct.pack(">I", len(t)) + t + b"\0" * (len(t) % 2) for t in (c.encode() for c in comments))
    return b[:4] + struct.pack(">I", struct.unpack_from(">I", b, 4)[0] + len(notes)) + b[8:at] + notes + b[at:]


#: Names of text chunks in a RIFF list of information: fixed values. What has none of its own goes into a comment.
INFO = {b"ICMT": "Comment", b"INAM": "Title", b"IART": "Artist", b"ICRD": "Date", b"IGNR": "Genre", b"ICOP": "Copyright", b"IPRD": "Album", b"ISFT": "Software"}


def wav_comments(b: bytes) -> list[str]:
    big, out = b[:4] == b"RIFX", []
    for name, at, size in chunks(b, 12, big):
        if name == b"LIST" and b[at : at + 4] == b"INFO":
            for kind, start, length in chunks(b[: at + size], at + 4, big):
                text = b[start : start + length].rstrip(b"\0").decode("utf-8", "replace")
                if kind in INFO and start + length <= len(b):
                    out.append(text if kind == b"ICMT" else f"{INFO[kind]}={text}")
    return out


def wav_with_comments(b: bytes, comments: list[str]) -> bytes:
    """A list of information before the data, so that the first bytes tell it. Comments come back as they were."""
    known = {v: k for k, v in INFO.items() if k != b"ICMT"}
    items = b""
    for c in comments:
        key, _, text = c.partition("=")
        kind = known.get(key) if text else None
        raw = (text if kind else c).encode() + b"\0"
        items += (kind or b"ICMT") + struct.pack("<I", len(raw)) + raw + b"\0" * (len(raw) % 2)
    at = next(at for name, at, _ in chunks(b, 12, False) if name == b"data") - 8
    note = b"LIST" + struct.pack("<I", 4 + len(items)) + b"INFO" + items
    return b[:4] + struct.pack("<I", struct.unpack_from("<I", b, 4)[0] + len(note)) + b[8:at] + note + b[at:]


#: Formats whose headers hold comments: reads them from a file's first bytes, puts them into a file.
COMMENTS: dict[str, tuple[Callable[[bytes], list[str]], Callable[[bytes, list[str]], bytes]]] = {n: (au_comments, au_with_comments) for n in ("au", "snd")} | {n: (aiff_comments, aiff_with_comments) for n in ("aiff", "aif", "aifc", "aiffc", "aifc_float")} | {n: (wav_comments, wav_with_comments) for n in ("wav", "wavpcm", "amb", "wav8", "wav24", "wav32", "wav_float", "wav_alaw", "wav_ulaw")}


# --- PARIS ---


def read_paf(b: bytes) -> tuple[float, np.ndarray, int]:
    if b[:4] not in (b" paf", b"fap "):
        raise ValueError("not a PARIS file")
    big = b[:4] == b" paf"
    _, order, rate, code, channels, _ = struct.unpack_from(">6i" if big else "<6i", b, 4)
    if code not in (0, 2):
        raise ValueError("only 8 and 16 bits of PARIS files are covered")
    bits = 16 if code == 0 else 8
    return float(rate), wide(pcm.bytes_int(b[2048:], bits, True, order == 0), channels), bits


def write_paf(a: np.ndarray, rate: float, big: bool = True) -> bytes:
    head = struct.pack(">6i" if big else "<6i", 0, 0 if big else 1, int(rate + 0.5), 0, a.shape[1], 0)
    return ((b" paf" if big else b"fap ") + head).ljust(2048, b"\0") + pcm.int_bytes(flat(a), 16, big=big)


put("paf", read=read_paf, write=write_paf)
put("fap", read=read_paf, write=lambda a, r: write_paf(a, r, False))
