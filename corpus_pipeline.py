"""The corpus pipeline: five stages over ``documents``, each written and reread as the next one's input.

Toxic documents go, then exact copies, then all but one document of each group of near copies; the rest is
mixed by source and encoded.  Every stage sees all rows its predecessor kept and returns the columns of
documents, except the last, which replaces the text by its token ids and their digests.
"""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tabwright.llm import (  # noqa: E402, F401
    bpe,
    exact_dedup,
    fingerprints,
    language_model,
    lexical_search,
    line_dedup,
    mixing,
    negatives,
    ngram_join,
    preferences,
    quality,
    secret_scan,
    toxicity,
)
from tabwright.llm.components import stored  # noqa: E402
from tabwright.llm.registry import LLM_QUERIES, LLM_SQL  # noqa: E402, F401


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the labelled documents among ``docs`` and drop what scores at the threshold or above."""
    chain = toxicity.train_toxicity(docs, toxicity.learned_labels(spark, sf_dir))
    return toxicity.drop_toxic(docs, chain)


def remove_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    return exact_dedup.exact_dedup(docs)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents the one with the smallest id stays."""
    return ngram_join.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or thin documents so that the sources meet their targets."""
    return mixing.mix_sources(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, their number and the digests of ids and decoded text."""
    encoded = bpe.encode_documents(docs, bpe.default_path()).drop("text")
    return bpe.digests(encoded, keep_ids=True)


STAGES = [
    ("toxicity", remove_toxic),
    ("exact_dedup", remove_copies),
    ("ngram_join", remove_near_copies),
    ("mixing", mix),
    ("bpe", encode),
]

#: Fitted models and token ids are beyond SQL; the tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


LLM_QUERIES["pipeline"] = run
