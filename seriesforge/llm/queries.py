"""Registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import common, embedding_dedup, hmm, mixing, packing, quality_rules, rule_ensemble, simhash, suffix_dedup, token_files, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probability of every text; texts of fold 1 of 5 are held out of training."""
    return hmm.HiddenMarkov().score(table(spark, sf_dir, "documents"), common.fold("doc_id", 5) == 1)


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written as Parquet in ascending order and read back."""
    path = common.staging_path(spark, "tokens")
    token_files.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return token_files.digest(spark, path)


def op3_differencing_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of at most 4096 ids."""
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2, capacity=4096)


def op4_int8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector at cosine 0.9."""
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.9)


def op5_quality_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; labels of fold 1 of 3 are held out."""
    docs = table(spark, sf_dir, "documents")
    rules = rule_ensemble.RuleEnsemble().fit(docs, table(spark, sf_dir, "labels"), keep=common.fold("doc_id", 3) != 1)
    scored = rule_ensemble.score(docs, rules)
    return scored.select("doc_id", (common.fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op6_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.mixture(table(spark, sf_dir, "documents"), weights=(5, 2, 1), cap=3)


def op7_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; 4 differing bits link."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), bits=4, width=4)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without repeated strings of 100 bytes."""
    return suffix_dedup.spans(table(spark, sf_dir, "documents"), width=100)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline.py over documents."""
    return corpus_pipeline.run(spark, sf_dir)


def op9_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; labels of fold 0 of 5 are held out."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.ToxicPassages().fit(docs, table(spark, sf_dir, "labels"), keep=common.fold("doc_id", 5) != 0)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (common.fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted", "n_segments")


def op10_quality_ngram_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rule and calibrated n-gram verdict of every document."""
    docs = table(spark, sf_dir, "documents")
    model = quality_rules.QualityRules().fit(docs, table(spark, sf_dir, "labels"))
    return quality_rules.score(docs, model)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hmm_scores": op1_hmm_scores,
    "op2_token_files": op2_token_files,
    "op3_differencing_packs": op3_differencing_packs,
    "op4_int8_embedding_dedup": op4_int8_embedding_dedup,
    "op5_quality_rule_ensemble": op5_quality_rule_ensemble,
    "op6_entropy_mix": op6_entropy_mix,
    "op7_golay_simhash": op7_golay_simhash,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_toxic_segments": op9_toxic_segments,
    "op10_quality_ngram_rules": op10_quality_ngram_rules,
    "pipeline": pipeline,
}

#: The other operators cannot be written as SQL: fitted models, tokenizers, XXH64 with a seed, a convex dual.
ORACLE_SQL: dict[str, str] = {
    "op4_int8_embedding_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, CASE WHEN len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0 THEN CAST(embedding AS DOUBLE[]) END AS e
  FROM embeddings),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
component AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, component_id = v.vec_id AS kept
FROM v JOIN component ON component.a = v.vec_id LEFT JOIN counts ON counts.a = v.vec_id
""",
    "op8_suffix_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, h, UNNEST(range(CAST(length(h) / 2 AS BIGINT))) AS i FROM d),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 2) AS byte, CASE WHEN 2 * i + 200 <= length(h) THEN md5_number(substr(h, 2 * i + 1, 200)) END AS s FROM p),
n AS (SELECT doc_id, i, byte, s IS NOT NULL AND row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1 AS again FROM w),
g AS (SELECT doc_id, i, byte, coalesce(bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), false) AS gone FROM n),
e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS begins FROM g),
k AS (SELECT doc_id, count(*) AS n_bytes, count(*) FILTER (gone) AS n_removed, count(*) FILTER (begins) AS n_spans, string_agg(byte, '' ORDER BY i) FILTER (NOT gone) AS kept FROM e GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id
""",
}
