"""A training corpus in five stages: toxicity, language, near duplicates, benchmark passages, mixing weights.

Each stage takes (spark, docs, sf_dir) and returns what it keeps of docs with the columns of documents; the last adds tokens,
posterior and rate. run() applies them to documents, each stage written as Parquet in the shared folder and read again.

In every stage an empty table gives an empty table, columns beyond those of documents pass through (those called tokens,
posterior or rate are replaced by the last stage; names that begin with _u_ are the operators' own), repeated rows stay or go
together, and texts of any length are read whole. Each stage says what becomes of null and empty texts and of ties.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undula.llm import decontaminate, language, mixing, ngram_join, toxicity
from undula.llm.common import table, written
from undula.llm.queries import TARGETS


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of toxicity 0.5 or more go.

    Null and empty texts have the score of a text without a hit and stay; a score of just 0.5 goes. Rows without a label, or
    with a null doc_id, are scored like others.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, model, into="_u_score").where("_u_score < 0.5").drop("_u_score")


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no known language go.

    Those are null and empty texts, texts without letters and texts like no language of the table's lang column. A null lang
    isn't trained on; null sources are one host. Languages as likely as each other don't matter here: either is known.
    """
    found = language.identify(docs, language.train(docs), host=F.col("source"), into="_u_found")
    return found.where(F.col("_u_found.language") != language.UNKNOWN).drop("_u_found")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the document of the least doc_id stays.

    Null and empty texts are linked with nothing and stay, and so do rows with a null doc_id.
    """
    return ngram_join.one_of_each(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and empty texts hold nothing and stay; null and empty items are in no document.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def weigh(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a rate above 0 stay, with tokens, posterior and rate.

    A document of rate 0 is drawn never: it holds more of what is over its target than of the rest. Null and empty texts have 0
    tokens and the rate of their posterior. Documents of equal texts have equal rates.
    """
    labels = table(spark, sf_dir, "labels")
    model = mixing.train(docs, labels.select("doc_id", mixing.domain(F.col("quality"), F.col("toxic")).alias("domain")))
    return mixing.mix(docs, model, TARGETS).where("rate > 0")


STAGES = [("toxicity", drop_toxic), ("language", drop_unknown_language), ("near_copies", drop_near_copies), ("benchmark", drop_benchmark), ("mixing", weigh)]

#: Stages train models and compare by edit distance, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
