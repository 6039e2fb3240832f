"""Quality by importance resampling.

Two generative models of hashed word unigrams and bigrams, of target and of raw text, give each document a log importance
weight: the sum over its n-grams of log p_target - log p_raw. Gumbel noise, a hash of the document's key, is added and the
documents with the k largest sums are selected: a sample without replacement in proportion to the weights.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

TOKEN = re.compile(r"\w+|[^\w\s]+")
BUCKETS = 10_000
CACHE_TOKENS = 100_000
#: Ids of target text up to this many are broadcast; with more the target documents are shuffled.
BROADCAST_IDS = 100_000

@dataclass
class Hasher:
    _seen: dict = field(default_factory=dict, repr=False, compare=False)

    def __getstate__(self):
        return {"_seen": {}}

    def grams(self, text: str | None) -> np.ndarray:
        """Bucket of each unigram and bigram of a whole text."""
        words = TOKEN.findall((text or "").lower())
        if not words:
            return np.empty(0, np.int64)
        seen = self._seen
        if len(seen) > CACHE_TOKENS:
            seen.clear()
        for w in words:
            if w not in seen:
                seen[w] = zlib.crc32(w.encode("utf-8", "replace"))
        one = np.fromiter(map(seen.__getitem__, words), np.int64, len(words))
        two = (one[:-1] * 31 + one[1:] * 17 + 7) >> 3
        return np.concatenate([one, two]) % BUCKETS


def gram_counts(rows: DataFrame) -> DataFrame:
    """(bucket, raw, target) over all rows (text, _raw boolean, _target boolean): counts of the rows of either kind.

    Each task sums its rows into two vectors of fixed length before the shuffle.
    """

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        raw, target, hasher = np.zeros(BUCKETS), np.zeros(BUCKETS), Hasher()
        for b in batches:
            for text, one, other in zip(b["text"], b["_raw"], b["_target"]):
                got = np.bincount(hasher.grams(text), minlength=BUCKETS)
                if one:
                    raw += got
                if other:
                    target += got
        at = np.flatnonzero(raw + target)
        yield pd.DataFrame({"bucket": at, "raw": raw[at], "target": target[at]})

    return rows.select("text", "_raw", "_target").mapInPandas(summed, "bucket bigint, raw double, target double").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def fit(docs: DataFrame, target: DataFrame) -> np.ndarray:
    """log p_target - log p_raw by bucket. target: the doc_ids of target text, in one column. Add-one smoothed counts.

    Up to BROADCAST_IDS distinct ids, counted first, are broadcast; with more the target documents alone are shuffled.
    """
    ids = target.select(F.col("doc_id").alias("_id")).where("_id is not null").distinct()
    texts = docs.select("doc_id", "text").withColumn("_raw", F.lit(True))
    same = F.col("doc_id") == F.col("_id")
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        rows = texts.join(F.broadcast(ids), same, "left").withColumn("_target", F.col("_id").isNotNull())
    else:
        rows = texts.withColumn("_target", F.lit(False)).unionByName(texts.join(ids, same, "left_semi").withColumns({"_raw": F.lit(False), "_target": F.lit(True)}))
    raw, aim = np.ones(BUCKETS), np.ones(BUCKETS)
    for r in gram_counts(rows).collect():  # BUCKETS rows
        raw[r["bucket"]] += r["raw"]
        aim[r["bucket"]] += r["target"]
    return np.log(aim / aim.sum()) - np.log(raw / raw.sum())


def with_weights(docs: DataFrame, ratio: np.ndarray, key: str = "doc_id", keep: list[str] | None = None, seed: int = 42) -> DataFrame:
    """docs (or the columns `keep`) plus n_grams, log_weight and noisy_weight (with the key's Gumbel noise)."""
    hasher = Hasher()

    def weighed(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            found = [hasher.grams(t) for t in batch]
            yield pd.DataFrame({"n": [len(g) for g in found], "w": [float(ratio[g].sum()) for g in found]})

    names = [c for c in (docs.columns if keep is None else keep) if c not in ("n_grams", "log_weight", "noisy_weight")]
    out = docs.select(*names, F.pandas_udf(weighed, "n bigint, w double")(F.col("text")).alias("_u_w"), F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(seed)).alias("_u_h"))
    u = (F.shiftrightunsigned("_u_h", 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return out.select(*names, F.col("_u_w.n").alias("n_grams"), F.col("_u_w.w").alias("log_weight"), (F.col("_u_w.w") - F.log(-F.log(u))).alias("noisy_weight"))


def rank_cut(rows: DataFrame, value: str, k: int) -> tuple[float | int, int] | None:
    """The value of rank k from above, and how many of the rows that have it are among the first k; None if k is 0 or no row.

    Rows are counted in 1,024 bins of ever smaller ranges until one value is left. Only counts come to the driver.
    """
    ends = rows.agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("n")).first()
    if k <= 0 or not ends["n"]:
        return None
    lo, hi, left = ends["lo"], ends["hi"], min(k, ends["n"])
    while lo < hi:
        inside = rows.where((F.col(value) >= F.lit(lo)) & (F.col(value) <= F.lit(hi)))
        share = (F.col(value).cast("double") - F.lit(float(lo))) / F.lit(float(hi) - float(lo))
        bins = inside.groupBy(F.least(F.floor(share * 1024), F.lit(1023)).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"))
        for b in bins.orderBy(F.desc("lo")).collect():
            if b["n"] >= left:
                lo, hi = b["lo"], b["hi"]
                break
            left -= b["n"]
    return lo, left


def resample(docs: DataFrame, target: DataFrame, fraction: float = 0.5, key: str = "doc_id", keep: list[str] | None = None, seed: int = 42) -> DataFrame:
    """docs (or the columns `keep`) plus n_grams, log_weight, noisy_weight and selected.

    selected: the floor(fraction * rows) rows of the largest noisy weights, exactly as many at every size. Repeated rows have the
    same noise; where only some rows of one noisy weight are due, which of them are taken isn't defined. Null and empty texts
    have weight 0 and take part. An empty table gives an empty table.
    """
    weighed = written(with_weights(docs, fit(docs, target), key, keep, seed).withColumn("_u_row", F.monotonically_increasing_id()), "weights")
    k = int(Fraction(str(fraction)) * weighed.count())
    cut = rank_cut(weighed, "noisy_weight", k)
    if cut is None:
        return weighed.withColumn("selected", F.lit(False)).drop("_u_row")
    edge, due = cut
    first = rank_cut(weighed.where(F.col("noisy_weight") == F.lit(edge)), "_u_row", due)[0]
    taken = (F.col("noisy_weight") > F.lit(edge)) | ((F.col("noisy_weight") == F.lit(edge)) & (F.col("_u_row") >= F.lit(first)))
    return weighed.withColumn("selected", taken).drop("_u_row")
