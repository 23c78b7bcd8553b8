"""A training-data pipeline over ``documents``: toxicity, near-duplicates, personal data, mixing, packing.

Each stage takes ``(spark, docs, sf_dir)``, is written as Parquet and read again as
the next one's documents. All but the last keep the columns of ``documents``.

Defined results: a null or empty text has no toxic word, no shingle and no personal data, counts
no words in the mix, and is packed as the end id alone where the mix takes it; a null source is one of
its own, last in the mix; of near copies, and of rows with one ``doc_id``, one stays, while rows without an
id all stay; very long texts are read whole; an empty table gives no piece; other columns pass through to the
last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vacantia.llm import mixing, packing, pseudonyms, token_groups, toxicity
from vacantia.llm.common import save, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose predicted label is clean. The lexicon is learned from the labelled ones among them."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), lambda doc_id: ~toxicity.held_out(doc_id))
    return toxicity.score(docs, model).filter("toxic_predicted = 0").select("row.*")


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: five-word shingles, Jaccard similarity of 0.8 or more."""
    return token_groups.one_per_class(docs, size=5, percent=80)


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pseudonyms.protect(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 1024 tokens."""
    return packing.packed_digest(docs)


STAGES = [("toxicity", drop_toxic), ("ngram_jaccard", one_of_near_copies), ("pii", pseudonymise),
          ("mixing", mix_sources), ("packing", pack)]

ORACLE_SQL = None  # tokenizers and learned scores have no SQL form; the stages are tested against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
