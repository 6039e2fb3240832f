"""Stages of the pipeline on odd rows, empty tables and clashing names, and all of them against a plain run of each rule."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tests.llm.test_llm import brute, labelled, prose, table

DOCUMENTS = "doc_id text lang source n_chars".split()


@pytest.fixture(scope="module")
def stages():
    import corpus_pipeline

    return dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder with labels and a benchmark, documents with clashing column names and odd rows among them."""
    folder = tmp_path_factory.mktemp("tables")
    docs, labels = labelled(spark)
    rng = random.Random(31)
    item = prose(30, rng=rng)
    copy = prose(80, rng=rng)
    odd = [
        (1001, None, "en", "a"), (1002, "", None, "a"), (1003, "!!! ... ???", "en", None), (1004, " \n\t", "en", "b"), (1005, copy, "en", "a"), (1006, copy.upper(), "en", "a"), (1007, copy + " end", "en", "a"), (1007, copy + " end", "en", "a"),
        (None, prose(40, rng=rng), "en", "c"), (1008, prose(30_000, rng=rng), "en", "a"), (1009, prose(50, rng=rng) + " " + item + " " + prose(50, rng=rng), "en", "a"), (1010, item, "en", "a"), (1011, "zorgface blatherskite numbwit " * 20, "en", "a"), (1011, "zorgface blatherskite numbwit " * 20, "en", "a"),
    ]
    both = docs.unionByName(table(spark, odd)).withColumns({c: F.lit(7) for c in ("score", "hits", "tokens", "posterior", "language", "doc", "component_id", "selected", "item_id", "a", "label")})
    both.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def read(spark, tables):
    return spark.read.parquet(f"{tables}/documents.parquet")


#: Ids of odd rows that a stage drops, each with the number of its rows; all other odd rows stay.
DROPPED = {"toxicity": {1011: 2}, "language": {1001: 1, 1002: 1, 1003: 1, 1004: 1}, "near_copies": {1006: 1, 1007: 2}, "benchmark": {1009: 1, 1010: 1}}


@pytest.mark.parametrize("name", list(DROPPED))
def test_stage_on_odd_rows(spark, tables, stages, name):
    docs = read(spark, tables)
    out = stages[name](spark, docs, tables)
    assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
    left = {i: n for i, n in docs.where("doc_id > 1000 OR doc_id IS NULL").groupBy("doc_id").count().collect()}
    want = {i: n for i, n in left.items() if i not in DROPPED[name]}
    assert all(left[i] == n for i, n in DROPPED[name].items())
    assert {i: n for i, n in out.where("doc_id > 1000 OR doc_id IS NULL").groupBy("doc_id").count().collect()} == want
    kept = out.where("doc_id < 1000")
    assert kept.count() == (300 if name == "toxicity" else 400)  # a quarter of the ordinary rows is toxic
    assert out.where("label != 7 OR score != 7 OR a != 7").count() == 0


def test_mixing_stage_on_odd_rows(spark, tables, stages):
    docs = read(spark, tables)
    clean = docs.where("doc_id IS NULL OR doc_id % 4 != 0 OR doc_id > 1000")
    out = stages["mixing"](spark, clean, tables)
    assert set(docs.columns) <= set(out.columns) and out.where("rate <= 0 OR tokens < 0").count() == 0
    assert out.where("doc_id = 1001").select("tokens").first()[0] in (0, None) or out.where("doc_id = 1001").count() == 0
    rates = out.groupBy("text").agg(F.countDistinct("rate").alias("n")).where("n > 1").count()
    assert rates == 0


@pytest.mark.parametrize("name", ["toxicity", "language", "near_copies", "benchmark", "mixing"])
def test_stage_on_an_empty_table(spark, tables, stages, name):
    docs = read(spark, tables)
    out = stages[name](spark, docs.where("false"), tables)
    assert out.count() == 0 and set(docs.columns) <= set(out.columns)


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no tables")
def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    got = out.collect()
    assert set(docs.columns) < set(out.columns)
    ids = [r["doc_id"] for r in got]
    assert len(set(ids)) == len(ids) and 0 < len(ids) <= docs.count() and all(r["rate"] > 0 for r in got)
    left = brute([(r["doc_id"], r["text"]) for r in got])
    assert all(i == c for i, (n, c) in left.items() if n)


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no tables")
def test_near_copies_stage_by_brute_force(spark, stages):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {i for i, (n, c) in brute([(r["doc_id"], r["text"]) for r in docs.collect()]).items() if i == c}
    assert {r["doc_id"] for r in stages["near_copies"](spark, docs, "/root/testdata/sf0.001").collect()} == want
