"""Language identification by fusing evidence in Bayes' way.

log posterior = log prior of the host + log likelihood of the text + log likelihood of the declared markup language + log
likelihood of the address suffix. Text likelihoods come from hashed character trigrams, tempered by the length. Host priors are
sums of the rows' text posteriors by host (grouped aggregation), smoothed towards the host's domain, its top-level domain and
the whole table in turn.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, written

BUCKETS = 1 << 15
NOT_LETTERS = re.compile(r"[\W\d_]+")
#: Hosts up to this many have their priors broadcast; with more they are joined by a shuffle.
BROADCAST_HOSTS = 50_000
UNKNOWN = "und"


def trigrams(text: str | None) -> np.ndarray:
    """Bucket of each character trigram of the letters of a text, words parted by one space."""
    letters = f" {NOT_LETTERS.sub(' ', (text or '').lower()).strip()} "
    code = np.frombuffer(letters.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(code) < 4:  # no letter, or one
        return np.empty(0, np.uint32)
    return ((code[:-2] * np.uint32(2654435761)) ^ (code[1:-1] * np.uint32(2246822519)) ^ (code[2:] * np.uint32(3266489917))) >> np.uint32(32 - 15)


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # (BUCKETS, languages): log likelihoods
    floor: float  # a mean log likelihood under it is of no known language

    def text_logs(self, text: str | None) -> tuple[list[float], float]:
        """Tempered log likelihoods by language, the largest 0; mean log likelihood of the best (-inf without letters)."""
        found = trigrams(text)
        if not len(found):
            return [0.0] * len(self.languages), float("-inf")
        mean = np.zeros(len(self.languages))
        for k in range(0, len(found), 65536):  # long texts in blocks, all of them
            mean += self.table[found[k : k + 65536]].sum(0, dtype=np.float64)
        mean /= len(found)
        return ((mean - mean.max()) * min(len(found), 60 + len(found) ** 0.5)).tolist(), float(mean.max())


def fit(rows: list[tuple[str, str]]) -> LanguageModel:
    names = sorted({lang for _, lang in rows}) or [UNKNOWN]
    counts = np.full((BUCKETS, len(names)), 0.5)
    for text, lang in rows:
        counts[:, names.index(lang)] += np.bincount(trigrams(text), minlength=BUCKETS)
    model = LanguageModel(names, np.log(counts / counts.sum(0)).astype(np.float32), float("-inf"))
    means = [m for t, _ in rows if (m := model.text_logs(t)[1]) > float("-inf")]
    if means:
        model.floor = float(np.percentile(means, 0.1)) - 1.5
    return model


def train(docs: DataFrame, per_language: int = 400, max_chars: int = 20_000) -> LanguageModel:
    """From rows whose lang is given; per_language rows of each language, of max_chars characters at most, come to the driver."""
    return fit(bounded_sample(docs, per_language, max_chars, "lang"))


def with_text_evidence(rows: DataFrame, model: LanguageModel, text: str) -> DataFrame:
    """rows plus _u_text, a struct of logs (array by language) and mean."""

    def logs(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            found = [model.text_logs(t) for t in batch]
            yield pd.DataFrame({"logs": [x[0] for x in found], "mean": [x[1] for x in found]})

    return rows.withColumn("_u_text", F.pandas_udf(logs, "logs array<double>, mean double")(F.col(text)))


def softmax(logs: Column) -> Column:
    e = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def domain_of(host: Column) -> Column:
    """The last two labels of a host name."""
    return F.substring_index(host, ".", -2)


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def host_priors(evidence: DataFrame, languages: list[str], strength: float = 4.0) -> DataFrame:
    """(_u_host, _u_prior: array of log priors by language) from rows with _u_host, _u_logs and _u_mean.

    A host's counts are smoothed by strength times its domain's prior, that by its suffix's, that by the whole table's. Sums
    are partial before the shuffle, so a host with a third of all rows is a few rows by then.
    """
    n = len(languages)
    post = F.when(F.col("_u_mean") > float("-inf"), softmax(F.col("_u_logs"))).otherwise(F.array(*[F.lit(0.0)] * n))
    host = evidence.select("_u_host", post.alias("p")).groupBy("_u_host").agg(*[F.sum(F.col("p")[k]).alias(f"h{k}") for k in range(n)])
    host = written(host.withColumns({"_u_domain": domain_of(F.col("_u_host")), "_u_suffix": suffix_of(F.col("_u_host"))}), "hosts")
    domain = host.groupBy("_u_domain", "_u_suffix").agg(*[F.sum(f"h{k}").alias(f"d{k}") for k in range(n)])
    suffix = domain.groupBy("_u_suffix").agg(*[F.sum(f"d{k}").alias(f"s{k}") for k in range(n)])
    whole = suffix.agg(*[F.coalesce(F.sum(f"s{k}"), F.lit(0.0)) for k in range(n)]).first()  # a number for each language
    level = host.join(domain, ["_u_domain", "_u_suffix"]).join(suffix, "_u_suffix").withColumns({f"w{k}": F.lit(float(whole[k])) for k in range(n)})
    prior = [F.lit(1.0 / n)] * n
    for letter in "wsdh":
        total = sum((F.col(f"{letter}{k}") for k in range(n)), F.lit(0.0))
        prior = [(F.col(f"{letter}{k}") + F.lit(strength) * prior[k]) / (total + F.lit(strength)) for k in range(n)]
        level = level.withColumns({f"_{letter}{k}": prior[k] for k in range(n)})
        prior = [F.col(f"_{letter}{k}") for k in range(n)]
    return written(level.select("_u_host", F.transform(F.array(*prior), lambda x: F.log(x)).alias("_u_prior")), "priors")


def told(value: Column, languages: list[str], trust: float) -> Column:
    """Log likelihoods of a language that is told by markup or address; none told, or one that isn't known: no evidence."""
    n = len(languages)
    away = float(np.log((1 - trust) / max(1, n - 1)))
    out = F.array(*[F.lit(0.0)] * n)
    for k, name in enumerate(languages):
        out = F.when(value == name, F.array(*[F.lit(float(np.log(trust)) if j == k else away) for j in range(n)])).otherwise(out)
    return out


def identify(rows: DataFrame, model: LanguageModel, text: str = "text", host: Column | None = None, declared: Column | None = None, suffix: Column | None = None, trust: tuple[float, float] = (0.9, 0.8), keep: list[str] | None = None, into: str = "found") -> DataFrame:
    """Each row's language.

    host, declared, suffix: the row's host, its declared markup language and the language its address tells (each may be null
    or absent). keep: the columns of rows that the result has (all of them if not given). Adds a struct: language ('und' where
    the text has no letters or is like no known language), probability of that language and text_language, from the text alone.
    A column called `into` is replaced; names that begin with _u_ are the operator's own.
    Null and empty texts are 'und' with probability 0; a null host counts as one host. Ties go to the first language in order.
    Hosts' priors are broadcast when counted to be at most BROADCAST_HOSTS, and joined by a shuffle (which AQE splits at a hot
    host) otherwise.
    """
    names, n = model.languages, len(model.languages)
    keep = [c for c in (rows.columns if keep is None else keep) if c != into]
    src = rows.select(*keep, F.coalesce(host if host is not None else F.lit(""), F.lit("")).alias("_u_host"), F.lower(declared if declared is not None else F.lit(None).cast("string")).alias("_u_declared"), F.lower(suffix if suffix is not None else F.lit(None).cast("string")).alias("_u_told"), F.col(text).alias("_u_whole"))
    # each text is read once: what was found of it is written, with the columns that the result has
    scored = written(with_text_evidence(src, model, "_u_whole").drop("_u_whole"), "evidence").withColumns({"_u_logs": F.col("_u_text.logs"), "_u_mean": F.col("_u_text.mean")})
    priors = host_priors(scored.select("_u_host", "_u_logs", "_u_mean"), names)
    small = priors.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS
    joined = scored.join(F.broadcast(priors) if small else priors, "_u_host", "left")
    sums = F.transform(F.arrays_zip(F.col("_u_prior").alias("a"), F.col("_u_logs").alias("b"), told(F.col("_u_declared"), names, trust[0]).alias("c"), told(F.col("_u_told"), names, trust[1]).alias("d")), lambda x: x["a"] + x["b"] + x["c"] + x["d"])
    array = F.array(*[F.lit(x) for x in names])
    known = F.col("_u_mean") >= F.lit(model.floor)
    best = lambda logs: array[F.array_position(logs, F.array_max(logs)).cast("int") - 1]
    out = joined.withColumn("_u_p", softmax(sums))
    found = F.struct(F.when(known, best(F.col("_u_p"))).otherwise(UNKNOWN).alias("language"), F.when(known, F.array_max("_u_p")).otherwise(0.0).alias("probability"), F.when(known, best(F.col("_u_logs"))).otherwise(UNKNOWN).alias("text_language"))
    return out.select(*keep, found.alias(into))


def markup_language(html: Column) -> Column:
    """The primary subtag of a page's lang attribute, or null."""
    return F.nullif(F.lower(F.regexp_extract(html, r"""(?i)<html[^>]*?\blang\s*=\s*["']?([a-z]{2,3})""", 1)), F.lit(""))


def address_language(url: Column, languages: list[str]) -> Column:
    """The language that a host's country suffix, or else a path's part, tells, or null."""
    names = "|".join(languages)
    tld = F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://[^/:?#]*\.([a-zA-Z]{2})(?:[/:?#]|$)", 1))
    path = F.lower(F.regexp_extract(url, rf"(?i)^[a-z]+://[^/?#]+/(?:[^?#]*/)?({names})(?:[/.?#]|$)", 1))
    return F.coalesce(F.when(tld.isin(languages), tld), F.nullif(path, F.lit("")))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://(?:[^/@?#]*@)?([^/:?#]+)", 1))


def visible_text(html: Column) -> Column:
    """A page's text without scripts, styles, comments and tags."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    return F.regexp_replace(bare, r"&[a-zA-Z#0-9]{1,10};", " ")
