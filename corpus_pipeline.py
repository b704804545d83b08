"""The corpus pipeline: documents in, packed token sequences out.

STAGES are applied in order, each to all that the one before has kept, with a Parquet table in
between. All but the last return the columns of documents:

language    documents without letters, mostly in scripts of no learned language, or with words too
            unlikely in the learned languages, go
near_dup    of each group of near-duplicates (five-word shingles, similarity of 0.8) one stays
repeats     passages of 50 words and more that stood before are cut out of later texts; a text of
            which nothing is left goes
private     personal data is replaced by its kind, such as [EMAIL]
packing     texts become tokens, cut and packed into sequences of at most 2048

Where doc_id is null or repeats, near_dup and repeats go by a key of the row instead, in the order of
doc_id (null last): copies are found by their text, whatever their ids.

SQL can't express these stages; tests hold each one, and the whole, against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from noticeflow.llm import langid, minhash, packing, pii, suffixes
from noticeflow.llm.common import by_row, documents, materialize, scratch


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.in_known_languages(docs)


def near_dup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return by_row(docs, minhash.keep_one, k=5)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffixes.without_repeats(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("language", language), ("near_dup", near_dup), ("repeats", repeats), ("private", private), ("packing", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stage writes for itself goes as soon as its result is written."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            docs = materialize(stage(spark, docs, sf_dir), name, keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
