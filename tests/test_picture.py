"""Spectrograms as pictures: headers, sizes, colours and where a tone is drawn."""

import struct
import zlib

import numpy as np
import pytest

from undula.operators import frames
from undula.signal import Signal


def tones(spark, places=4000):
    """Left a tone at a quarter of the band, right silence and then one at three quarters."""
    n = np.arange(places)
    s = np.stack([np.sin(np.pi / 4 * n), np.sin(np.pi * 3 / 4 * n) * (n >= places // 2)]) * 2**30
    return Signal(spark.createDataFrame([("a", c, k, int(v)) for c, row in enumerate(s) for k, v in enumerate(row)], "stream_id string, channel int, n bigint, s int"), 8000.0, 2)


def test_rows_fit_the_height():
    assert [frames.rows_for(550, c) for c in (1, 2, 4, 8, 40)] == [513, 257, 129, 65, 33]


@pytest.mark.parametrize(("options", "width"), [({"rows": 65, "width": 50}, 50), ({"rows": 65, "pixels_per_second": 100.0}, 50), ({"rows": 65, "pixels_per_second": 1000.0, "width": 30}, 30), ({"height": 140}, 800)])
def test_picture(spark, options, width):
    r = frames.picture(tones(spark), **options).first()
    rows = options.get("rows") or 65
    png = bytes(r["png"])
    assert png[:8] == b"\x89PNG\r\n\x1a\n" and struct.unpack_from(">IIBB", png, 16) == (r["width"], r["height"], 8, 3)
    assert abs(r["width"] - width) <= width // 10 + 2 and r["height"] == 2 * rows
    grid, at, kinds = frames.png_pixels(png), 8, []
    while at < len(png):
        size, kind = struct.unpack_from(">I4s", png, at)
        assert struct.unpack_from(">I", png, at + 8 + size)[0] == zlib.crc32(png[at + 4 : at + 8 + size])
        kinds.append((kind, size))
        at += 12 + size
    assert [k for k, _ in kinds] == [b"IHDR", b"PLTE", b"IDAT", b"IEND"] and kinds[1][1] == 3 * 251
    left, right = grid[:rows, 1:-2], grid[rows:, 1:-2]  # the last frames reach past the end
    assert (left.argmax(0) == rows - 1 - (rows - 1) // 4).all()
    if width < 100 and options.get("width") != 30:
        assert (right[:, : width // 2 - 4].max(0) == 0).all() and (right[:, width // 2 + 2 :].argmax(0) == rows - 1 - 3 * (rows - 1) // 4).all()
    assert left.max() <= 250 and left.max() > 230  # half of full scale: 6 dB below the top of 120


def test_levels_and_colours(spark):
    look = frames.palette(4)
    assert look.shape == (6, 3) and look[0].tolist() == [0, 0, 0] and look[-1].tolist() == [255, 255, 255]
    assert (frames.palette(4, light=True) == 255 - look).all() and (np.diff(frames.palette(9, grey=True)[:, 0].astype(int)) > 0).all()
    x = tones(spark, 800)
    loudest = frames.png_pixels(bytes(frames.picture(x, rows=33, width=20, top=None).first()["png"]))
    assert loudest.max() == 250
    low = frames.png_pixels(bytes(frames.picture(x, rows=33, width=20, top=-40.0, colours=8).first()["png"]))
    assert low.max() == 9 and set(np.unique(low)) <= set(range(10))
    with pytest.raises(ValueError):
        frames.picture(x, width=0)
