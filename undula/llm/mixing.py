"""Soft-membership mixing.

A softmax classifier, fitted on a table of labelled documents, predicts each document's domain posterior. Documents get
nonnegative rates such that the expected tokens of each domain, the sum of rate * tokens * posterior, match target weights of
a total. The rates solve a least-squares problem by projected gradient steps:

    minimise  1/2 sum_c w_c (S_c(r) - T_c)^2 / N  +  1/2 ridge sum_d t_d (r_d - 1)^2,    r_d >= 0,  S_c(r) = sum_d r_d t_d p_dc

N: all tokens; w_c = 1 / max(T_c / N, SMALL), so that a small domain's miss counts by its target. With a document's tokens as its
metric, the step is r_d <- max(0, y_d - h (p_d . g + ridge (y_d - 1))) with g_c = w_c (S_c(y) - T_c) / N and y the point that
momentum leads to. A step needs one number a domain from all documents: executors hold tokens and posteriors, apply the
gradients so far to them and sum; the driver sees sums only.
"""

from __future__ import annotations

import re
import warnings
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, written

TOKEN = re.compile(r"\w+|[^\w\s]+")
BUCKETS = 1 << 14
CACHE_TOKENS = 100_000
#: A target share below this weighs as if it were this much.
SMALL = 0.005
#: Steps after which documents' rates are written down; between, they are recomputed from the gradients.
WRITE_EVERY = 25
#: Documents whose rates a task advances at once.
AT_ONCE = 1 << 16


@dataclass
class DomainModel:
    domains: list[str]
    weights: np.ndarray  # (BUCKETS + 1, domains); the last row is the bias
    _bucket: dict = field(default_factory=dict, repr=False, compare=False)

    def __getstate__(self):
        return self.__dict__ | {"_bucket": {}}

    def features(self, text: str | None) -> tuple[np.ndarray, np.ndarray, int]:
        """Buckets of the distinct tokens, their unit-length weights, the number of tokens."""
        counts = Counter(TOKEN.findall(text or ""))
        if len(self._bucket) > CACHE_TOKENS:
            self._bucket.clear()
        seen = self._bucket
        for token in counts:
            if token not in seen:
                seen[token] = zlib.crc32(token.encode("utf-8", "replace")) % BUCKETS
        if not counts:
            return np.empty(0, int), np.empty(0), 0
        value = np.sqrt(np.fromiter(counts.values(), float, len(counts)))
        return np.fromiter(map(seen.__getitem__, counts), int, len(counts)), value / np.linalg.norm(value), sum(counts.values())

    def predict(self, text: str | None) -> tuple[np.ndarray, int]:
        """Posterior by domain, and tokens."""
        where, value, tokens = self.features(text)
        z = value @ self.weights[where] + self.weights[-1]
        p = np.exp(z - z.max())
        return p / p.sum(), tokens


def fit(rows: list[tuple[str, str]], priors: dict[str, float] | None = None, steps: int = 300, rate: float = 8.0, decay: float = 1e-5) -> DomainModel:
    """Softmax regression on (text, domain) pairs, by full gradient steps with momentum over hashed tokens.

    priors: weights of the domains, however many rows each has; so the posteriors' mean is that of the labelled table. Domains
    weigh alike where they aren't given.
    """
    names = sorted({d for _, d in rows}) or ["all"]
    model = DomainModel(names, np.zeros((BUCKETS + 1, len(names))))
    if len(names) < 2:
        return model
    found = [model.features(t)[:2] for t, _ in rows]
    row = np.repeat(np.arange(len(rows)), [len(f[0]) for f in found])
    where, value = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    y = np.eye(len(names))[[names.index(d) for _, d in rows]]
    prior = np.array([(priors or {}).get(d, 0.0 if priors else 1.0) for d in names])
    share = (prior / prior.sum() / y.sum(0))[y.argmax(1)]
    move = np.zeros_like(model.weights)
    for _ in range(steps):
        z = np.stack([np.bincount(row, value * model.weights[where, c], len(rows)) for c in range(len(names))], 1) + model.weights[-1]
        p = np.exp(z - z.max(1, keepdims=True))
        g = (p / p.sum(1, keepdims=True) - y) * share[:, None]
        grad = np.vstack([np.stack([np.bincount(where, value * g[row, c], BUCKETS) for c in range(len(names))], 1), g.sum(0)]) + decay * model.weights
        move = 0.9 * move - rate * grad
        model.weights += move
    return model


def domain(quality: Column, toxic: Column) -> Column:
    """Domains of the labels table."""
    return F.when(toxic == 1, "toxic").when(quality == 0, "low").when(quality == 1, "high")


def train(docs: DataFrame, labelled: DataFrame, per_domain: int = 800, max_chars: int = 20_000) -> DomainModel:
    """labelled: (doc_id, domain). per_domain rows of each domain, of max_chars characters at most, come to the driver.

    Domains are weighed by their numbers of labelled rows.
    """
    rows = bounded_sample(docs, per_domain, max_chars, "domain", labelled)
    return fit(rows, {r["domain"]: r["count"] for r in labelled.where("domain is not null").groupBy("domain").count().limit(1000).collect()})


def with_membership(docs: DataFrame, model: DomainModel, text: str = "text") -> DataFrame:
    """docs plus _u_m, a struct of the posterior p (by model.domains) and tokens. One scan, no shuffle."""

    def predicted(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            found = [model.predict(t) for t in batch]
            yield pd.DataFrame({"p": [x[0] for x in found], "tokens": [x[1] for x in found]})

    return docs.withColumn("_u_m", F.pandas_udf(predicted, "p array<double>, tokens bigint")(F.col(text)))


@dataclass
class Descent:
    """The gradients so far, each with the momentum that follows it: what gives a document's rate from its posterior."""

    size: float
    ridge: float
    steps: list[tuple[np.ndarray, float]]

    def advance(self, q: np.ndarray, r: np.ndarray, y: np.ndarray, start: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Rates r and points y of posteriors q after the steps from `start` on; the last step's old r and y."""
        old, at = r, y
        for g, momentum in self.steps[start:]:
            old, at = r, y
            r = np.maximum(0, y - self.size * (q @ g + self.ridge * (y - 1)))
            y = r + momentum * (r - old)
        return r, y, old, at

    def rates(self, q: np.ndarray) -> np.ndarray:
        return self.advance(q, np.ones(len(q)), np.ones(len(q)))[0]


def _gathered(batches: Iterator[pa.RecordBatch], names: list[str], n: int) -> Iterator[tuple[np.ndarray, ...]]:
    """The columns of AT_ONCE rows at least as arrays, p with n columns."""
    held: list[pa.RecordBatch] = []

    def taken() -> tuple[np.ndarray, ...]:
        t = pa.Table.from_batches(held).combine_chunks()
        return tuple(t.column(c).combine_chunks().flatten().to_numpy().reshape(-1, n) if c == "p" else t.column(c).to_numpy().astype(float) for c in names)

    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= AT_ONCE:
            yield taken()
            held.clear()
    if any(x.num_rows for x in held):
        yield taken()


def solve(members: DataFrame, targets: dict[str, float], domains: list[str], total: float | None = None, ridge: float = 1e-4, iterations: int = 2000, tolerance: float = 0.002, settled: float = 1e-6) -> tuple[Descent, dict]:
    """The descent, and what it reached, for members (p, tokens): a row for each document, read once a step.

    Steps go on until every domain's share of the total is within `tolerance` of its target, or nothing moves: no document's
    projected gradient is above `settled`, so the least-squares optimum is reached, which misses unattainable targets. 'converged'
    says whether either was met within `iterations`, 'missed' is the largest deviation of a share. A step brings two numbers a
    domain, the largest move and the momentum's direction to the driver. Domains that no document belongs to, or without a
    target, have target 0.
    """
    n = len(domains)
    p = [F.col("p")[k] for k in range(n)]
    gram = members.agg(F.sum("tokens").alias("n"), *[F.sum(F.col("tokens") * p[i] * p[j]).alias(f"g{i}_{j}") for i in range(n) for j in range(i, n)]).first()
    whole = float(gram["n"] or 0)
    if not whole:
        return Descent(0.0, ridge, []), {"tokens": {d: 0.0 for d in domains}, "goal": {d: 0.0 for d in domains}, "iterations": 0, "converged": True, "missed": 0.0}
    weight = np.array([max(0.0, targets.get(d, 0.0)) for d in domains])
    goal = (whole if total is None else total) * weight / max(weight.sum(), 1e-300)
    w = 1 / np.maximum(goal / whole, SMALL)
    g = np.array([[gram[f"g{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)], float) / whole
    descent = Descent(1 / (float(np.linalg.eigvalsh(np.sqrt(w)[:, None] * g * np.sqrt(w))[-1]) + ridge), ridge, [])
    schema = ", ".join(f"s{k} double" for k in range(2 * n + 2))
    names = [x.split()[0] for x in schema.split(", ")]

    def sums_of(start: int):
        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for q, t, r, y in _gathered(batches, ["p", "tokens", "r", "y"], n):
                r, y, old, at = descent.advance(q, r, y, start)
                row = [*((t * r) @ q), *((t * y) @ q), np.abs(r - at).max(), ((at - r) * (r - old) * t).sum()]
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.float64()) for v in row], names)

        return sums

    def states(start: int):
        def state(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for q, t, r, y in _gathered(batches, ["p", "tokens", "r", "y"], n):
                r, y, _, _ = descent.advance(q, r, y, start)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(q) + 1) * n, pa.int32()), pa.array(q.ravel()))
                yield pa.RecordBatch.from_arrays([lists, pa.array(t.astype(np.int64)), pa.array(r), pa.array(y)], ["p", "tokens", "r", "y"])

        return state

    state, start = members.select("p", "tokens", F.lit(1.0).alias("r"), F.lit(1.0).alias("y")), 0
    reached = ahead = g.sum(1) * whole
    aim = whole if total is None else max(total, 1e-300)
    missed, moved, t = float(np.abs(reached - goal).max()) / aim, float("inf"), 1.0
    while missed > tolerance and moved > settled and len(descent.steps) < iterations:
        if len(descent.steps) - start >= WRITE_EVERY:
            state, start = written(state.mapInArrow(states(start), "p array<double>, tokens bigint, r double, y double"), "rates"), len(descent.steps)
        after = (1 + (1 + 4 * t * t) ** 0.5) / 2
        descent.steps.append((w * (ahead - goal) / whole, (t - 1) / after))
        row = state.mapInArrow(sums_of(start), schema).agg(*[(F.max if k == 2 * n else F.sum)(c).alias(c) for k, c in enumerate(names)]).first()
        reached, ahead = np.array(row[:n]), np.array(row[n : 2 * n])
        missed, moved, t = float(np.abs(reached - goal).max()) / aim, row[2 * n] / descent.size, after
        if row[2 * n + 1] > 0:  # momentum leads uphill: begin it anew
            t, descent.steps[-1] = 1.0, (descent.steps[-1][0], 0.0)
            ahead = reached
    told = {"tokens": dict(zip(domains, reached.tolist())), "goal": dict(zip(domains, goal.tolist())), "iterations": len(descent.steps), "converged": missed <= tolerance or moved <= settled, "missed": missed}
    return descent, told


def mix(docs: DataFrame, model: DomainModel, targets: dict[str, float], total: float | None = None, keep: list[str] | None = None, **options) -> DataFrame:
    """docs (or the columns `keep` of them) plus tokens, posterior (array by model.domains) and rate.

    A rate is how many times a document is to be drawn on average. Null and empty texts have no tokens; their rate is that of
    their posterior and moves nothing. Repeated rows get the same rate each. An empty table gives an empty table. Columns
    called tokens, posterior or rate are replaced. Targets that can't be met give the nearest rates and a warning. Texts are read
    once and nothing is shuffled.
    """
    names = [c for c in (docs.columns if keep is None else keep) if c not in ("tokens", "posterior", "rate")]
    slim = docs.select(*[F.col(c) for c in dict.fromkeys([*names, "text"])])
    seen = written(with_membership(slim, model).select(*names, "_u_m"), "members")
    descent, told = solve(seen.select("_u_m.p", "_u_m.tokens"), targets, model.domains, total, **options)
    reached = f"after {told['iterations']} iterations; reached {told['tokens']} of {told['goal']}"
    if not told["converged"]:
        raise RuntimeError(f"rates are not within the tolerance {reached}")
    if told["missed"] > options.get("tolerance", 0.002):
        warnings.warn(f"the targets can't be met: the nearest rates {reached}", stacklevel=2)
    n = len(model.domains)

    def rated(posteriors: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in posteriors:
            yield pd.Series(descent.rates(np.array(p.tolist(), float).reshape(len(p), n)))

    rate = F.pandas_udf(rated, "double").asNondeterministic()  # else a filter on rates reckons them once more, in a worker of its own
    return seen.select(*names, F.col("_u_m.tokens").alias("tokens"), F.col("_u_m.p").alias("posterior"), rate(F.col("_u_m.p")).alias("rate"))
