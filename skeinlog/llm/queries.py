"""The corpus operators as registered queries, each over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers

import corpus_pipeline
from skeinlog.llm import bpe, conversations, divergence, fingerprint, language, mixing, ngram_join, quality, secret_scan, sharding, suffix_dedup, token_counts, vector_dedup
from skeinlog.llm.shared import documents
from skeinlog.session import scratch_path


def op1_ngram_join(spark, sf_dir):
    return ngram_join.joined(documents(spark, sf_dir))


def op2_mixing(spark, sf_dir):
    return mixing.digests(documents(spark, sf_dir))


def op3_suffix_dedup(spark, sf_dir):
    return suffix_dedup.deduplicated(documents(spark, sf_dir))


def op4_secret_scan(spark, sf_dir):
    return secret_scan.digests(documents(spark, sf_dir))


def op5_token_counts(spark, sf_dir):
    return token_counts.corpus_totals(documents(spark, sf_dir), scratch_path(spark, "token-rollup"))


def op6_bpe_round_trip(spark, sf_dir):
    return bpe.digests(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op7_language_id(spark, sf_dir):
    return language.predictions(documents(spark, sf_dir))


def op8_vector_dedup(spark, sf_dir):
    return vector_dedup.joined(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op9_fingerprints(spark, sf_dir):
    return fingerprint.digests(documents(spark, sf_dir))


def op10_quality(spark, sf_dir):
    return quality.predictions(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op11_sharding(spark, sf_dir):
    return sharding.sharded(documents(spark, sf_dir))


def op12_source_divergence(spark, sf_dir):
    return divergence.audit(documents(spark, sf_dir))


def op13_conversation_repair(spark, sf_dir):
    return conversations.digests(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES = {f.__name__: f for f in (op1_ngram_join, op2_mixing, op3_suffix_dedup, op4_secret_scan, op5_token_counts, op6_bpe_round_trip, op7_language_id, op8_vector_dedup, op9_fingerprints, op10_quality, op11_sharding, op12_source_divergence, op13_conversation_repair)} | {"pipeline": corpus_pipeline.run}
ORACLES = {"op5_token_counts": token_counts.CORPUS_SQL, "op12_source_divergence": divergence.SQL}
