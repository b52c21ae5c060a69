"""Registered queries of the corpus operators: each applies its operator, with production
parameters, to its whole table. ``ORACLES`` holds DuckDB SQL where SQL can express a query."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelab.llm import (
    context_mixing,
    exact_dedup,
    filter_audit,
    hash_forest,
    langid,
    license_scan,
    mixing,
    near_dedup,
    order_minhash,
    perspectives,
    sentencepiece_codec,
    url_filter,
    whitening,
)

#: The public SentencePiece model that op4 and the pipeline encode with; read on the driver, never copied.
SENTENCEPIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_mixing.score_documents(_table(spark, sf_dir, "documents"), training="crc32(cast(doc_id as string)) % 7 <> 2")


def op2_budget_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_table(_table(spark, sf_dir, "documents"), weights=(3, 1, 2), budget=1.5, max_epochs=2)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    known = docs.filter("crc32(cast(doc_id as string)) % 3 <> 1")
    model = langid.fit(known)
    return langid.identify(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")


def op4_sentencepiece(spark: SparkSession, sf_dir: str, model: str = SENTENCEPIECE_MODEL) -> DataFrame:
    return sentencepiece_codec.encode(_table(spark, sf_dir, "documents"), Path(model).read_bytes(), keep=["doc_id"])


def op5_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives.rotate(_table(spark, sf_dir, "conversations"))


def op6_hash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_forest.nearest(_table(spark, sf_dir, "embeddings"), queries=F.col("vec_id") % 50 == 0, k=5)


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.fingerprints(_table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the links counted are those the method confirmed, which is no fixed set inside a large component
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), similarity=0.8, shingle_words=4).drop("class_links")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"), url_filter.RULES)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten_rows(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(_table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_context_mixing": op1_context_mixing,
    "op2_budget_mix": op2_budget_mix,
    "op3_language_id": op3_language_id,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_perspectives": op5_perspectives,
    "op6_hash_forest": op6_hash_forest,
    "op7_order_minhash": op7_order_minhash,
    "op8_license_scan": op8_license_scan,
    "op9_near_dedup": op9_near_dedup,
    "op10_url_filter": op10_url_filter,
    "op11_whitening": op11_whitening,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_filter_audit": op13_filter_audit,
}

NEAR_DEDUP_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM d
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)
), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (SELECT doc_id, doc_id AS reached FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.reached = e.a)
SELECT doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(reached) AS component_id, doc_id = min(reached) AS kept
FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""

ORACLES: dict[str, str] = {
    "op9_near_dedup": NEAR_DEDUP_SQL,
    "op5_perspectives": perspectives.ORACLE,
    "op12_exact_dedup": exact_dedup.ORACLE,
    "op13_filter_audit": filter_audit.ORACLE,
}
