"""HCOM files: bytes laid out by hand, both ways, damaged files, and any counts."""

import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from undula.sources import formats, huffman


def by_hand(count=6, check=None, kind=1, divisor=2):
    """Values 128 130 130 127 127 127 as differences 2 0 -3 0 0: codes 0 -> 0, 2 -> 10, 253 -> 11; bits 10 0 11 0 0."""
    pairs = struct.pack(">10h", 1, 2, -1, 0, 3, 4, -1, 2, -1, 253)
    word = 0b1001100 << 25
    fork = b"HCOM" + struct.pack(">IIIIH", count, word if check is None else check, kind, divisor, 5) + pairs + b"\0\x80" + struct.pack(">I", word)
    return (b"\0\1A" + b"\0" * 62 + b"FSSD" + b"\0" * 14 + struct.pack(">II", len(fork), 0)).ljust(128, b"\0") + fork.ljust(128, b"\0")


def test_bytes_by_hand():
    rate, a, bits = formats.FORMATS["hcom"].read(by_hand())
    assert (rate, bits) == (11025.0, 8) and ((a[:, 0] >> 24) + 128).tolist() == [128, 130, 130, 127, 127, 127]
    assert formats.detect(by_hand()[:256]) == "hcom"
    # of values instead of differences
    values = formats.FORMATS["hcom"].read(by_hand(kind=0))[1]
    assert ((values[:, 0] >> 24) + 128).tolist() == [128, 2, 0, 253, 0, 0]


def test_written_bytes():
    v = np.array([128, 130, 130, 127, 127, 127], np.int64)
    made = formats.FORMATS["hcom"].write(((v - 128) << 24).astype(np.int32)[:, None], 11025.0)
    assert len(made) == 256 and made[65:69] == b"FSSD" and made[83:87] == struct.pack(">I", 22 + 20 + 2 + 4)
    count, check, kind, divisor, size = struct.unpack_from(">IIIIH", made, 132)
    assert (count, kind, divisor, size) == (6, 1, 2, 5)
    # 0 is the most frequent move and has the code of one bit
    tree = huffman.Tree(np.frombuffer(made, ">i2", 10, 150).reshape(-1, 2).tolist())
    assert {k: len(c) for k, c in tree.codes().items()} == {0: 1, 2: 2, 253: 2}
    assert struct.unpack_from(">I", made, 150 + 20 + 2)[0] == check
    assert made[150 + 20 : 150 + 22] == b"\0\x80"


@pytest.mark.parametrize("bad", [by_hand(check=5), by_hand(count=60), by_hand(divisor=5), by_hand(kind=2), by_hand()[:140], by_hand().replace(b"FSSD", b"TEXT"), by_hand()[:150] + struct.pack(">2h", -1, 0) + by_hand()[154:]])
def test_damaged_files(bad):
    with pytest.raises((ValueError, struct.error)):
        formats.FORMATS["hcom"].read(bad)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 255), max_size=300))
def test_round_trip(values):
    v = np.array(values, np.int64)
    rate, a, _ = formats.FORMATS["hcom"].read(formats.FORMATS["hcom"].write(((v - 128) << 24).astype(np.int32)[:, None], 7350.0))
    assert rate == 7350.0 and ((a[:, 0] >> 24) + 128).tolist() == values


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(0, 255), st.integers(1, 10_000), min_size=2))
def test_codes_are_as_short_as_can_be(counts):
    n = np.zeros(256, np.int64)
    n[list(counts)] = list(counts.values())
    code = huffman.Tree.of(n).codes()
    assert set(code) == set(counts) and sum(2.0 ** -len(c) for c in code.values()) == 1
    # the sum of the least two counts, again and again
    left, total = sorted(counts.values()), 0
    while len(left) > 1:
        a, b, *left = left
        total += a + b
        left = sorted([*left, a + b])
    assert sum(n[v] * len(c) for v, c in code.items()) == total
