"""A training corpus out of raw documents, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and
returns a DataFrame; ``run`` writes every stage as Parquet and reads it again for the
next, so that a lost executor never costs more than a stage.

A null or empty text is no toxic one, equals other empty texts, has no near copies and no
tokens. Rows that repeat an id are documents of their own; of equal rows one stays. A null
source is a source of the mix. All columns but the text pass through, whatever their names,
up to the last stage; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stoopwise.llm import bpe, exact_dedup, mixing, ngram_join, toxicity
from stoopwise.llm.catalog import toxicity_scorer, vocabulary
from stoopwise.session import dropped, written


TEXTS_PER_BATCH = 500


def _few_texts_per_batch(spark: SparkSession) -> None:
    """Record batches that go to Python hold few rows from here on.

    Whole documents go along; by default 10,000 of them are held in several copies by every
    task, in the executor and in its Python process, and what a process once had it keeps.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= TEXTS_PER_BATCH:
        spark.conf.set(name, str(TEXTS_PER_BATCH))


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity scorer rejects go."""
    _few_texts_per_batch(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.without_toxic(docs, toxicity_scorer(docs, labels))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest doc_id stays."""
    return exact_dedup.without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts connected by a similarity of 0.8 or more the smallest doc_id stays."""
    _few_texts_per_batch(spark)
    return ngram_join.one_of_each_class(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it."""
    return mixing.mixed_documents(docs)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether decoding them gives the text back."""
    _few_texts_per_batch(spark)
    return bpe.encode_checked(docs.select("doc_id", "source", "text"), vocabulary(spark))


STAGES = [
    ("toxicity", keep_civil),
    ("exact_dedup", drop_exact_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("mix_sources", mix_sources),
    ("byte_level_bpe", to_tokens),
]

# The learnt filter, the near copies and the mix cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        if last is not None:
            dropped(last)
        last = docs
    return docs
