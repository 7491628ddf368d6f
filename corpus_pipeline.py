"""The corpus pipeline: quality rules, toxicity, near duplicates, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and reread as the next stage's docs. All but the last
return the columns of documents. Classifiers are trained on the labelled
documents of ``sf_dir``.

Edge cases: a null or empty text fails the base rules of the first stage, so it
goes; documents without doc_id are judged like others, stand behind those with one
where near copies are told apart, and get equal numbers of copies in the mixture;
rows that repeat a doc_id with other texts are documents of their own, equal rows
one; a row without a source is of a source of its own. Very long texts are read
whole. An empty table gives an empty result. Further columns, whatever their names,
go along up to the last stage.

Memory: a task holds the row group that it reads and the one that it writes. Stages
hand whole texts on, so at Parquet's 128 MB each the heap would have to grow with the
cores; a stage has the session write row groups of ``ROW_GROUP`` unless their size is set.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from barlume.llm import bpe, jaccard, mixing, quality, toxicity
from barlume.llm.common import Scratch, table

#: No SQL: stages decode random fields, train classifiers and merge byte pairs. Tested against brute force.
ORACLE_SQL = None
#: Bytes of a row group between stages, and the setting that Spark hands on to Parquet's writer.
ROW_GROUP, ROW_GROUP_KEY = 16 << 20, "parquet.block.size"

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def handed_on(stage: Stage) -> Stage:
    """A stage whose result, which the caller writes, gets small row groups."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if spark.conf.get(ROW_GROUP_KEY, None) is None:
            spark.conf.set(ROW_GROUP_KEY, str(ROW_GROUP))
        return stage(spark, docs, sf_dir)

    return run_stage


@handed_on
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line labelling keeps."""
    return quality.keep_good(docs, quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


@handed_on
def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic."""
    return toxicity.keep_clean(docs, toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


@handed_on
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, Jaccard similarity of 0.8 or more."""
    return jaccard.keep_one(docs, words=5, num=80, den=100)


@handed_on
def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture of the sources, in shuffled order; a document's copies are rows of their own."""
    return mixing.mix(docs).select(docs.columns)


@handed_on
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each row of the mixture, and the text that they decode to."""
    return bpe.encode_decode(docs)


STAGES = [("quality rules", quality_rules), ("toxicity", toxicity_filter), ("n-gram Jaccard join", near_duplicates), ("source mixing", source_mixing), ("byte-pair encoding", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    before = spark.conf.get(ROW_GROUP_KEY, None)
    try:
        for k, (_, stage) in enumerate(STAGES):
            docs = scratch.put(stage(spark, docs, sf_dir), str(k))
            if k > 0:
                scratch.drop(str(k - 1))
    finally:
        if before is None:
            spark.conf.unset(ROW_GROUP_KEY)
    return docs
