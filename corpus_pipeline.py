"""Corpus preparation as a chain of stages, each written and read again.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one
before has kept; all but the last return the columns of documents.

Nulls and edge cases: a document with null or empty text goes at the first
stage, as there is nothing to learn from; one without doc_id stays through all
stages (the near-duplicate stage can't name it) and is packed; rows that repeat
a doc_id and a text stay together or go together; an empty table gives no rows;
columns beyond those of documents are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from newstide.llm import ngram_join, packing, quality, rules
from newstide.llm.common import remove, stage_table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised classifier rejects go."""
    return quality.keep(docs)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines too frequent on a source go; documents that fail the base rules or lose most of their words go."""
    return rules.clean(docs, host="source")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group linked by a Jaccard similarity of 0.8 or more on 5-word shingles."""
    return ngram_join.one_of_each(docs, k=5, num=80, den=100)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' ids in sequences of at most 2048."""
    return packing.pack(docs, window=2048, end_id=1)


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("packing", pack),
]

#: The classifier is trained by iteration and packing is a dynamic program: SQL can't express run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, over documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), name.replace(" ", "-"), docs)  # the table before goes
    out = STAGES[-1][1](spark, docs, sf_dir)  # packing has written its pieces, and reads those
    remove(spark, docs._stage_path)
    return out
