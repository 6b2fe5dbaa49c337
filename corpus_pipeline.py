"""A training corpus from the documents table, in stages.

Each stage takes (spark, docs, sf_dir), works on all documents that the one
before kept and returns documents again, but for the last, which returns the
pieces of packed sequences. What a stage returns is written as Parquet and read
back as the next one's input, so a lost executor repeats tasks of one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.langid import UNKNOWN, fit_documents, identified
from lodestar.llm.mixing import sampled
from lodestar.llm.packing import packed
from lodestar.llm.pii import scrubbed
from lodestar.llm.queries import tokenizer_path
from lodestar.llm.simhash import deduplicated
from lodestar.llm.store import Scratch

#: Documents in which a smaller share of the n-grams are of the predicted language are rejected.
LEAST_LANGUAGE_SCORE = 0.35


def _with_length(docs: DataFrame) -> DataFrame:
    """``n_chars`` is that of the text as it now is."""
    return docs.withColumn("n_chars", F.char_length("text").cast("bigint")) if "n_chars" in docs.columns else docs


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages; ``lang`` becomes the predicted one."""
    predicted = identified(docs, fit_documents(docs))
    kept = predicted.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE))
    return kept.withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id."""
    return deduplicated(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    return _with_length(scrubbed(docs))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return _with_length(sampled(docs, whole=True))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 tokens."""
    return packed(docs, tokenizer_path())


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("pii", pii), ("source_mix", source_mix), ("packing", packing)]

#: The mix depends on hashes that SQL engines don't share and the pieces on a tokenizer, so there is no SQL for the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        docs = scratch.write(stage(spark, docs, sf_dir), f"{k}-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
