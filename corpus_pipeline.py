"""The training-corpus pipeline: five stages, each over all that the one before kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, with the columns of documents in all stages but the last.
Stages must run in this order; run() writes each result to the folder that the
cluster shares and rereads it for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from freshet.llm import mixing, ngram_join, packing, quality, toxicity
from freshet.llm.shared import stored, table

#: SQL can't express the trained stages; the tests hold each stage against a plain version instead.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the trained classifier go.

    The classifier learns from the labelled rows of the whole table, so that a
    stage's input does not change what good means.
    """
    model = quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.judge(docs, model).where("kept").select(*docs.columns)


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated score is 0.3 or more go."""
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where("predicted = 0").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents one stays: that with the smallest doc_id, rows without one last."""
    return ngram_join.one_of_each(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.stage(docs)


def packed_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences and offsets."""
    return packing.pack_documents(docs.select("doc_id", "text"))


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxic_documents),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing", mixed_sources),
    ("packing", packed_windows),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
