"""The transfer curve of companding."""

import numpy as np

from undula.operators import sequential


def test_last_stretch_from_its_end():
    level = np.geomspace(0.2, 1, 1000)
    db = 20 * np.log10(level)
    assert (sequential.transfer([(-60.0, -40.0), (-20.0, -15.0)])(level) == 10 ** (-0.25 * db / 20)).all()
