"""A training corpus from raw documents in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last keep the columns of documents. Between stages the rows are written as
Parquet to the shared folder and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import bpe, jaccard, language, mixing, secrets
from sparkloom.llm.common import BATCHES, materialize

#: Documents whose language is less probable than this are rejected.
LEAST_SCORE = 0.4


def bounded(spark: SparkSession) -> None:
    """Whole rows go to Python here: in batches of bounded bytes, for the rest of the session."""
    for key, value in BATCHES.items():
        spark.conf.set(key, value)


def with_own_names(stage, docs: DataFrame, *names: str) -> DataFrame:
    """What ``stage`` makes of ``docs``, whose own columns of these names, if any, step aside meanwhile."""
    aside = {c: max(docs.columns, key=len) + f"_{i}" for i, c in enumerate(names) if c in docs.columns}
    back = {v: k for k, v in aside.items()}
    renamed = docs.withColumnsRenamed(aside)
    return stage(renamed).select(*(F.col(f"`{c}`").alias(back.get(c, c)) for c in renamed.columns))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language: null texts, texts without a letter and undecided ones go.

    Repeated rows are judged one by one and alike; without labelled rows nothing
    is learned and all go; an empty table stays empty. Other columns, whatever
    their names, are carried along.
    """
    bounded(spark)
    model = language.fit(docs)
    known = (F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE)
    return with_own_names(lambda rows: language.predict(rows, model).where(known), docs, "lang_pred", "score")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of the smallest id.

    Rows that share an id stay or go together; null and blank texts and rows
    without an id stay; other columns are carried along.
    """
    return jaccard.keep_one(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking secrets masked; every document stays, null texts as null, repeated rows repeated, with all columns."""
    return secrets.redact_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target share draws it, shuffled.

    Rows of one id are drawn equally often; a null source is a source; other
    columns, whatever their names, are carried along.
    """
    return with_own_names(mixing.mix, docs, "copy_no", "mix_key")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every copy; a null text counts as empty."""
    bounded(spark)
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("language", identify_language), ("near_duplicates", drop_near_duplicates), ("secrets", mask_secrets), ("mixing", mix_sources), ("encoding", encode)]

#: SQL expresses neither the network nor the encoding; test_pipeline_agrees_with_a_plain_one in tests/llm compares run() with plain stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The encoded corpus of the documents in ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
