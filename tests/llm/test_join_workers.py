"""How much of an executor's memory the n-gram join's Python takes: a worker a task, a block of shingles once."""

import random

import pytest

from test_llm import brute, near_copies
from undula.llm import ngram_join

#: What stays in the task of what is below it.
SAME_TASK = {"Project", "Filter", "Union", "Generate", "Sort"}


def chained(node, above: bool = False) -> bool:
    """Whether a task of the plan feeds a Python worker from another one."""
    name = node.nodeName()
    here = name == "MapInArrow"
    if above and here:
        return True
    children = node.children()
    return any(chained(children.apply(k), here or above and name in SAME_TASK) for k in range(children.size()))


def test_one_worker_a_task(spark, monkeypatch):
    written, plans = ngram_join.written, {}

    def seen(df, name="step"):
        plans.setdefault(name, df._jdf.queryExecution().sparkPlan())
        return written(df, name)

    monkeypatch.setattr(ngram_join, "written", seen)
    docs = spark.createDataFrame(near_copies(random.Random(3), 60), "doc_id bigint, text string")
    ngram_join.jaccard_components(docs).collect()
    assert {"texts", "more", "product"} <= plans.keys()
    assert [name for name, plan in plans.items() if chained(plan)] == []


@pytest.mark.parametrize("counted", [7, 200])
def test_blocks_of_shingles(spark, monkeypatch, counted):
    """Blocks smaller than a text, and of a few texts, change no result."""
    monkeypatch.setattr(ngram_join, "COUNTED", counted)
    rows = near_copies(random.Random(8), 120)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.jaccard_components(docs).collect()} == brute(rows)
