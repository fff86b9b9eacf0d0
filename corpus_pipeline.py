"""A training corpus from documents: each stage applies one operator of hunkwise.llm to what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hunkwise.llm import common, decontamination, line_dedup, packing, simhash, toxicity


def clean_of_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the field doesn't call toxic; it learns from the labelled ones among docs.

    Null and empty texts are scored as texts without words, null ids are in no fold; repeated rows get equal scores; without
    documents or labels nothing is toxic.
    """
    model = toxicity.learn(docs, common.table(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, model).filter("predicted = 0").select(docs.columns)


def without_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten of them share; n_chars follows the text.

    A document that loses all lines keeps its row with an empty text, and a null text becomes empty; each row, repeated ones
    too, is a document; a table without n_chars, or an empty one, is no special case.
    """
    out = line_dedup.dedup_lines(docs, min_docs=10, min_length=1)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies: that of the smallest id.

    Texts without words, nulls among them, are copies of each other, and so are repeated rows; null ids come last; further columns
    of any type are handed on; an empty table stays empty.
    """
    return simhash.deduplicate(docs).select(docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts and items match nothing; rows of one id, null ids too, go together;
    without items all documents stay."""
    return decontamination.decontaminate(docs, common.table(spark, sf_dir, "benchmark")).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training sequences: pieces of documents, with their token ids. Null and empty texts are their end id alone, repeated rows
    are packed apart, null ids are handed on; an empty table has no pieces."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", clean_of_toxicity),
    ("line_dedup", without_common_lines),
    ("near_dedup", one_of_each_group),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

#: SQL cannot express the conditional random field, SimHash or the tokenizer; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sequences of all documents that every stage keeps. What a stage writes for itself is deleted when its result is written."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = common.scratch(spark, f"pipeline-{name}")
        with common.tidied():
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.schema(docs.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
