"""Which rows of the n-gram join travel: prefixes of repeated sets alone, and halves of their hashes between blocks."""

import random

import pytest

from test_llm import brute, near_copies
from undula.llm import ngram_join


@pytest.mark.parametrize("marks", [1 << 16, 32])
def test_prefixes_that_travel(spark, monkeypatch, marks):
    """Sets of one row aren't regrouped (but for those whose bit another set has), whatever the map's size the result is the same."""
    rng, written, tables = random.Random(21), ngram_join.written, {}
    rows = [(k, " ".join(rng.choices("abcdefghij", k=40))) for k in range(300)]
    rows += [(1000 + k, rows[k % 4][1]) for k in range(12)] + [(2000, "x y z"), (2000, "x y z")]
    monkeypatch.setattr(ngram_join, "MARKS", marks)
    monkeypatch.setattr(ngram_join, "written", lambda df, name="step": tables.setdefault(name, written(df, name)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    seen = written(ngram_join._sets(docs, ngram_join.frequent_shingles(docs, 5), 5, 80), "sets")
    ids, prefixes = ngram_join._one_of_each_set(seen)
    got = prefixes.collect()
    assert sorted(r["doc"] for r in got) == sorted(r["doc"] for r in ids.collect()) == [*range(300), 2000]
    assert len({bytes(r["set"]) for r in got}) == 301 and all(len(r["prefix"]) == len(r["salts"]) > 0 for r in got)
    assert marks == 32 or tables["prefixes"].count() <= 8  # the 5 sets of several rows, and sets of their bits


@pytest.mark.parametrize("seed", [4, 5])
def test_components_by_a_crowded_map(spark, monkeypatch, seed):
    monkeypatch.setattr(ngram_join, "MARKS", 64)
    monkeypatch.setattr(ngram_join, "LIGHT", 3)
    monkeypatch.setattr(ngram_join, "BLOCK", 7)
    rows = near_copies(random.Random(seed), 200)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(docs).collect()} == brute(rows)


def test_halves_of_hashes_lose_no_pair(spark):
    """Three shingles whose hashes share their upper half count as one in the prefix, and to what lies beyond it."""
    same = [(1 << 32) + k for k in range(3)]
    rows = spark.createDataFrame([(same[0], 1, 10), (same[0], 2, 10)], "token bigint, doc bigint, n int")
    comps = spark.createDataFrame([], "doc bigint, component bigint")
    prefixes = spark.createDataFrame([(d, 10, same) for d in (1, 2)], "doc bigint, n int, prefix array<bigint>")
    assert [(r["a"], r["b"]) for r in ngram_join._open_columns(rows, comps, prefixes, 80).collect()] == [(1, 2)]
