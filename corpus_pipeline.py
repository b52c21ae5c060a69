"""A training-data pipeline over ``documents``: language ID, near-dedup, mixing, SentencePiece encoding.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs. All but the last return the columns of ``documents``.

Rows, stage by stage:
* language_id learns from the texts and labels of its own input and drops what it can't determine: texts that are
  null or have no letter, and texts whose best language has a posterior probability under ``LEAST_SCORE``;
* near_dedup keeps of every group of near-duplicates (five-word shingles, similarity 0.8 or more, transitively) the
  rows with the smallest doc_id - one of them, if rows repeat; documents without a doc_id are kept only
  where nothing like them has an id;
* mix repeats and drops documents so that each source's words come near its target;
* encode turns what is left into ids: doc_id, lang, source, ids, n_ids, round_trip, parity.

Every stage works on any input: an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelab.llm import langid, mixing, near_dedup, sentencepiece_codec
from pricelab.llm.queries import SENTENCEPIECE_MODEL
from pricelab.session import scratch_path

LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = langid.identify(docs.withColumnsRenamed({c: f"in_{c}" for c in docs.columns}), langid.fit(docs), "in_text")
    kept = found.filter((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SCORE))
    return kept.select(*[F.col(f"in_{c}").alias(c) for c in docs.columns])


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs, similarity=0.8, shingle_words=5)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs, weights=(3, 1, 2), budget=1.5, max_epochs=2)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with open(SENTENCEPIECE_MODEL, "rb") as f:
        return sentencepiece_codec.encode(docs, f.read(), keep=["doc_id", "lang", "source"])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_dedup", dedup),
    ("mix", mix),
    ("sentencepiece", encode),
]

#: SQL expresses none of the four methods; tests/llm holds the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
