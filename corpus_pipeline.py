"""A corpus from documents to token ids, stage by stage.

Every stage takes all documents that the one before kept. The first four return the columns of
``documents``; each says what becomes of NULLs, empty and very long texts, ties, repeated rows and empty tables in
its operator's module. In short: documents without letters go with the language stage;
NULL ids pass the filters; repeated rows are one document to near-dedup; an empty table stays empty.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tuneprep.llm.common import held_out
from tuneprep.llm.decontaminate import decontaminate
from tuneprep.llm.language import keep_identified, learn_languages
from tuneprep.llm.mixing import mix
from tuneprep.llm.near_dedup import deduplicate
from tuneprep.llm.queries import MIXTURE, THIN, TOKENIZER, domain_labels, ship, table
from tuneprep.llm.token_ids import tokenized
from tuneprep.storage import materialize


# What goes to a Python worker at a time. Stages hold several such batches on both sides, whole texts in them.
BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def stage(function):
    """A stage makes sure that the workers find the package, and keeps batches small unless the application names a size."""

    @functools.wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        if spark.sparkContext.getConf().get(BATCH_KEY) is None:
            spark.conf.set(BATCH_KEY, str(BATCH_BYTES))
        return function(spark, docs, sf_dir)

    return run_stage


@stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled rows teach; the model comes from those not held out."""
    return keep_identified(docs, learn_languages(docs.where(~held_out(F.col("doc_id")))))


@stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five-word shingles, similarity 0.8)."""
    return deduplicate(docs)


@stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


@stage
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated as their rates say, so that domains reach their target weights."""
    return mix(docs, domain_labels(spark, sf_dir), MIXTURE, THIN)


@stage
def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write the corpus as token ids and describe every document from the files."""
    return tokenized(docs, TOKENIZER)


STAGES = [
    ("language ID", language_id),
    ("near dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token ids", token_ids),
]
# Classifiers, estimates by sketch and tokenizers are not SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{i}")
    return docs


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark, sf_dir)
