"""A filter on rates doesn't have them reckoned twice."""

import numpy as np
from pyspark.sql import functions as F

from test_llm import labelled
from undula.llm import mixing


def test_rates_are_reckoned_once(spark):
    docs, _ = labelled(spark)
    model = mixing.DomainModel(["a", "b"], np.random.default_rng(5).normal(size=(mixing.BUCKETS + 1, 2)))
    rated = mixing.mix(docs, model, {"a": 0.5, "b": 0.5})
    some = rated.where(F.col("rate") > 0)
    assert some._jdf.queryExecution().sparkPlan().toString().count("ArrowEvalPython") == 1
    assert sorted(r["doc_id"] for r in some.collect()) == sorted(r["doc_id"] for r in rated.collect() if r["rate"] > 0)
