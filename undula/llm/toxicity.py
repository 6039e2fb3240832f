"""Compression-distance toxicity.

Two pairs of zstandard dictionaries, one of ordinary and one of toxic text each, are made from labelled rows.

The first pair is trained by zstandard on windows of SPAN words. A text's overlapping windows are compressed with both; the
bytes saved under the toxic dictionary, on average and by the number of windows over a threshold beyond what is usual in as many
windows of ordinary text, tell phrases and words in combination, however long the text is.

The second pair is for single words. Its toxic dictionary holds word beginnings that occur in far more contexts (distinct
neighbouring words) in toxic than in ordinary training rows; counting contexts and not rows keeps copies of one document from
making its words look toxic. A word whose compressed length falls by at least a calibrated number of bytes is a hit.

A logistic curve turns hits, rate of hits and the bytes saved by windows into a score. For its calibration the trained
dictionaries are made from one half of the training rows and applied to the other, as they know their own rows by heart.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, is_held_out

WORD = re.compile(r"\w+")
#: Both dictionaries and every window end with these bytes. Their match makes zstandard write a compressed block, so that one
#: more match saves bytes, and fills the last bytes of a window, in which zstandard looks for no match.
ANCHOR = bytes(range(1, 9)) + bytes(range(14, 30))
#: Comes before every word in dictionaries and windows. With it, and matches of seven bytes at least, only words that begin alike
#: match, by four bytes or more; what lies inside a word does not.
MARK = b"\x1f\x1e\x1d"
#: A window is a word's first bytes, as many as this at most; longer words are cut into several windows.
WINDOW_CHARS = 32
CACHE_WORDS = 200_000
#: Words of a window of the trained dictionaries; windows overlap by half.
SPAN = 16
#: Bytes of a trained dictionary, at most.
TRAINED_BYTES = 110_000
#: Share of ordinary windows that may reach the threshold of saved bytes.
USUAL = 0.005
#: Weight of the toxic class in the calibration: near its share of texts, so that clean texts are left alone.
TOXIC_WEIGHT = 0.2


@dataclass
class ToxicityModel:
    ordinary: bytes
    toxic: bytes
    threshold: int = 2
    weights: tuple[float, ...] = (-4.0, 2.0, 20.0, 0.0, 0.0)
    trained: tuple[bytes, bytes] | None = None
    #: Saved bytes from which on a window counts, and the share of ordinary windows that do.
    cut: float = 8.0
    usual: float = 0.005
    #: The share of words of ordinary text, not trained on, that are hits.
    usual_hits: float = 0.0
    _ready: list = field(default_factory=list, repr=False, compare=False)
    _seen: dict = field(default_factory=dict, repr=False, compare=False)
    _pair: list = field(default_factory=list, repr=False, compare=False)

    def __getstate__(self):
        return self.__dict__ | {"_ready": [], "_seen": {}, "_pair": []}

    def gain(self, window: str) -> int:
        """Bytes by which a window is shorter under the toxic dictionary."""
        seen = self._seen.get(window)
        if seen is None:
            if not self._ready:
                self._ready.extend(_compressor(x) for x in (self.ordinary, self.toxic))
            if len(self._seen) >= CACHE_WORDS:
                self._seen.clear()
            raw = b" " + MARK + f"{window} ".encode("utf-8", "replace") + ANCHOR
            seen = self._seen[window] = len(self._ready[0](raw)) - len(self._ready[1](raw))
        return seen

    def gains(self, words: list[str]) -> list[int]:
        """gain() of each window of the words."""
        own = windows(words)
        found = list(map(self._seen.get, own))
        if None in found:
            found = [self.gain(w) if g is None else g for g, w in zip(found, own)]
        return found

    def saved_by_window(self, words: list[str]) -> np.ndarray:
        """Bytes by which each window of several words is shorter under the trained toxic dictionary."""
        if self.trained is None:
            return np.empty(0)
        if not self._pair:
            self._pair.extend(_trained_compressor(x) for x in self.trained)
        ordinary, toxic = self._pair
        return np.fromiter((len(ordinary(w)) - len(toxic(w)) for w in spans(words)), float)

    def features(self, text: str | None) -> tuple[float, ...]:
        words = words_of(text)
        return (*_features(self.gains(words), self.threshold, self.usual_hits), *_beyond(self.saved_by_window(words), self.cut, self.usual))

    def score(self, text: str | None) -> float:
        return _sigmoid(_dot(self.weights, self.features(text)))


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def windows(words: list[str]) -> list[str]:
    """The words, longer ones cut."""
    if max(map(len, words), default=0) <= WINDOW_CHARS:
        return words
    return [w[k : k + WINDOW_CHARS] for w in words for k in range(0, len(w), WINDOW_CHARS)]


def spans(words: list[str], step: int = SPAN // 2) -> Iterator[bytes]:
    """Windows of SPAN words; a shorter text is one window."""
    for k in range(0, max(min(1, len(words)), len(words) - SPAN + step), step):
        yield " ".join(words[k : k + SPAN]).encode("utf-8", "replace")


def _trained(ordinary: list[str], toxic: list[str]) -> tuple[bytes, bytes] | None:
    """Dictionaries trained on all windows of the texts, or None where zstandard finds too little to train on."""
    out = []
    for texts in (ordinary, toxic):
        samples = [w for t in texts for w in spans(words_of(t))]
        try:
            out.append(zstandard.train_dictionary(min(TRAINED_BYTES, max(1024, sum(map(len, samples)) // 4)), samples, k=64, d=8).as_bytes())
        except zstandard.ZstdError:
            return None
    return out[0], out[1]


def _trained_compressor(content: bytes):
    shared = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_FULLDICT)
    how = zstandard.ZstdCompressionParameters.from_level(3, source_size=128, dict_size=len(content), min_match=4, write_content_size=False, write_checksum=False, write_dict_id=False)
    shared.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=shared, compression_params=how).compress


def _compressor(content: bytes):
    content += ANCHOR
    shared = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    how = zstandard.ZstdCompressionParameters.from_level(1, source_size=64, dict_size=len(content), min_match=7, write_content_size=False, write_checksum=False, write_dict_id=False)
    shared.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=shared, compression_params=how).compress


def _features(gains: list[int], threshold: int, usual: float) -> tuple[float, float]:
    """Hits beyond those usual in as long a text, as a number and by the text's length."""
    expected = usual * len(gains)
    hits = max(0.0, sum(g >= threshold for g in gains) - expected) / math.sqrt(1 + expected)
    return math.log1p(hits), math.sqrt(hits / (len(gains) + 5))


def _beyond(saved: np.ndarray, cut: float, usual: float) -> tuple[float, float]:
    """Mean of the saved bytes, and windows from the cut on beyond the usual number, in standard deviations from 0 to 8."""
    if not len(saved):
        return 0.0, 0.0
    expected = usual * len(saved)
    return float(saved.mean()), float(np.clip(((saved >= cut).sum() - expected) / math.sqrt(expected + 0.5), 0, 8))


def _dot(w, x) -> float:
    return w[0] + sum(a * b for a, b in zip(w[1:], x))


def _sigmoid(v: float) -> float:
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, v))))


def _beginnings(texts: list[str]) -> tuple[Counter, int]:
    contexts = set()
    for text in texts:
        words = ["^", *WORD.findall(text.lower()), "$"]
        contexts.update(zip(words, words[1:], words[2:]))
    counts: Counter = Counter()
    for _, word, _ in contexts:
        for k in range(4, min(len(word), 10)):
            counts[word[:k]] += 1
        counts[f"{word[:WINDOW_CHARS]} "] += 1
    return counts, max(1, len(contexts))


def _word_lists(toxic: list[str], ordinary: list[str], ordinary_bytes: int, terms: int | None, least_ratio: float, least_g2: float) -> tuple[bytes, bytes]:
    """Contents of the word dictionaries, ordinary and toxic."""
    (a, na), (b, nb) = _beginnings(toxic), _beginnings(ordinary)
    found = {}
    for term, x in a.items():
        y = b.get(term, 0)
        if x >= 4 and len(term) >= 4 and x / na >= least_ratio * y / nb:
            e, f = (x + y) * na / (na + nb), (x + y) * nb / (na + nb)
            if (g2 := 2 * (x * math.log(x / e) + (y * math.log(y / f) if y else 0))) >= least_g2:
                found[term] = g2
    kept: list[str] = []
    for term in sorted(found, key=lambda t: (-found[t], -len(t), t)):
        if (terms is None or len(kept) < terms) and not any(term.startswith(k) or k.startswith(term.rstrip()) for k in kept):
            kept.append(term)
    marked = lambda words: b"".join(MARK + w.encode("utf-8", "replace") for w in words)
    alike = {k[:4] for k in kept}
    # ordinary words that begin like toxic ones, but not with them, come last, nearest to a window; before them the most frequent words
    usual = sorted((w for w in b if w.endswith(" ") and not w.startswith(tuple(kept) or "\0")), key=lambda w: (w[:4] in alike, b[w], w))
    near = [w for w in usual if w[:4] in alike][-ordinary_bytes // 20 :]
    base = [w for w in usual if w[:4] not in alike][-ordinary_bytes // 16 :] + near
    return marked(base)[-ordinary_bytes:] or b" ", marked(reversed(kept)) or b" "


def _half(text: str) -> int:
    """Copies of a text share a half."""
    return zlib.crc32(text.encode("utf-8", "replace")) % 2


def fit(rows: list[tuple[str, int]], ordinary_bytes: int = 16384, terms: int | None = None, least_ratio: float = 40.0, least_g2: float = 30.0) -> ToxicityModel:
    """Dictionaries and calibration from (text, label) pairs. Without toxic rows the score is a low constant."""
    ordinary, toxic = ([t for t, y in rows if t and y == v] for v in (0, 1))
    options = ordinary_bytes, terms, least_ratio, least_g2
    model = ToxicityModel(*_word_lists(toxic, ordinary, *options))
    if not toxic or not ordinary:
        model.weights = (-4.0 if not toxic else 4.0, 0.0, 0.0, 0.0, 0.0)
        return model
    labels = np.array([1.0] * len(toxic) + [0.0] * len(ordinary))
    gains = [model.gains(words_of(t)) for t in toxic + ordinary]
    halves = [ToxicityModel(*_word_lists(*([t for t in texts if _half(t) != k] for texts in (toxic, ordinary)), *options)) for k in (0, 1)]
    unseen = np.array([g for t in ordinary for g in halves[_half(t)].gains(words_of(t))])
    across = _saved_across(toxic, ordinary)
    clean = np.sort(np.concatenate(across[len(toxic) :]))
    if len(clean):
        model.cut = float(clean[min(len(clean) - 1, int(len(clean) * (1 - USUAL)))]) + 1
        model.usual = float((clean >= model.cut).mean())
    saved = [_beyond(v, model.cut, model.usual) for v in across]
    best = None
    for threshold in (1, 2, 3, 4):
        usual = float((unseen >= threshold).mean()) if len(unseen) else 0.0
        x = np.array([(*_features(g, threshold, usual), *v) for g, v in zip(gains, saved)])
        w, loss = _logistic(x, labels)
        if best is None or loss < best[0] - 1e-9:
            best = (loss, threshold, w, usual)
    _, model.threshold, model.weights, model.usual_hits = best
    model._seen.clear()
    model.trained = _trained(ordinary, toxic)
    return model


def _saved_across(toxic: list[str], ordinary: list[str]) -> list[np.ndarray]:
    """saved_by_window() of toxic and then ordinary texts, each under dictionaries of the other half."""
    models = [ToxicityModel(b" ", b" ", trained=_trained(*([t for t in texts if _half(t) != k] for texts in (ordinary, toxic)))) for k in (0, 1)]
    return [models[_half(t)].saved_by_window(words_of(t)) for t in toxic + ordinary]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.02) -> tuple[tuple, float]:
    """Logistic regression by Newton steps; the toxic class has TOXIC_WEIGHT of the weight, however many rows it has."""
    z = np.c_[np.ones(len(x)), x]
    share = np.where(y == 1, TOXIC_WEIGHT / max(1, y.sum()), (1 - TOXIC_WEIGHT) / max(1, (1 - y).sum()))
    w, keep = np.zeros(5), np.diag([1e-6, ridge / 20, ridge / 400, ridge / 200, ridge / 200])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        grad = z.T @ (share * (p - y)) + keep @ w
        step = np.linalg.solve((z * (share * p * (1 - p) + 1e-9)[:, None]).T @ z + keep, grad)
        w -= step * min(1.0, 4 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-7:
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(z @ w, -40, 40))), 1e-9, 1 - 1e-9)
    return tuple(float(v) for v in w), float(-(share * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum())


def train(docs: DataFrame, labels: DataFrame, per_class: int = 1500, max_chars: int = 20_000) -> ToxicityModel:
    """A model from labelled rows that are not held out.

    per_class and max_chars bound what comes to the driver: that many rows of each label, each of at most so many characters.
    """
    y = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(~is_held_out(F.col("doc_id")))
    return fit(bounded_sample(docs, per_class, max_chars, "toxic", y))


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", into: str = "score") -> DataFrame:
    """docs with a toxicity score from 0 to 1 for every whole text.

    Null and empty texts have no window and get the score of no hit. Repeated rows score alike. Other columns stay as they
    are; a column already called `into` is replaced. One scan, no shuffle; memory is a batch and a bounded cache of windows.
    """

    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([model.score(t) for t in batch], dtype="float64")

    return docs.withColumn(into, F.pandas_udf(scored, "double")(F.col(text)))
