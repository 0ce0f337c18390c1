"""Registered queries of the corpus operators; each applies its operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, factorization, hmm, jaccard, near, negatives, packing, pages, phrases, pii, rules, token_counts
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: Operators 1 to 10 are not expressible in SQL as a whole (trees, tokenizers, models, max-flow, search); tests use brute force.
ORACLES: dict[str, str] = {"op11_phrases": phrases.ORACLE, "op12_ngram_jaccard": jaccard.ORACLE, "op13_hard_negatives": negatives.ORACLE}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detected(table(spark, sf_dir, "documents"))


@query
def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op4_minhash_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.components(table(spark, sf_dir, "documents"))


@query
def op5_factorization_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return factorization.scored(docs, factorization.trained(docs, table(spark, sf_dir, "labels")))


@query
def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extracted(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


@query
def op7_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.scores(table(spark, sf_dir, "documents"))


@query
def op8_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


@query
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_counts.by_limit(token_counts.histogram(token_counts.lengths(docs, public_tokenizers.path("byte_bpe_50k.json"), encode_special_tokens=False)))


@query
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), encode_special_tokens=False)


@query
def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


@query
def op12_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.joined(table(spark, sf_dir, "documents"))


@query
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mined(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, negatives.shifted())
