"""A training corpus from raw documents: five stages, each one of the ten operators.

Each stage takes the documents that the one before left, written as Parquet
and read again, and returns their columns; the last adds token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapmatch.llm import line_templates, mixing, pieces, rule_ensemble, setsketch
from gapmatch.llm.common import table, written
from gapmatch.llm.queries import piece_model


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    rules = rule_ensemble.fit(docs, table(spark, sf_dir, "labels"))
    return rule_ensemble.score(docs, rules).filter("predicted = 1").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines of recurring templates; ``n_chars`` follows the text."""
    out = line_templates.drop_template_lines(docs)
    return (out.withColumn("n_chars", F.when(F.size("dropped") > 0, F.char_length("clean_text").cast("long"))
                           .otherwise(F.col("n_chars")))
            .withColumn("text", F.col("clean_text")).select(*docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return setsketch.keep_one(docs, setsketch.near_duplicates(docs))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.take(docs, mixing.mix(docs))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids, their number and the digest of the decoded text."""
    return pieces.tokenized(docs, pieces.load(piece_model()))


STAGES = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("near-duplicates", near_dedup),
    ("mixing", mixture),
    ("sentencepiece", tokenize),
]

#: Fitted models and sketches have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
