"""Registered queries of the corpus operators and, where SQL can say them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers

import corpus_pipeline
from opsloom.llm import (decontamination, language_model, minhash, mixing, pseudonyms, quality_classifier, quality_rules,
                         secret_scan, substring_dedup, token_alignment, token_counts, toxicity,
                         whitening)
from opsloom.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(prepare(spark), sf_dir)
        if sql:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_substring_dedup")
def op1(spark, sf_dir):
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


@query("op2_mix_sources", mixing.mix_sql())
def op2(spark, sf_dir):
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


@query("op3_secret_scan")
def op3(spark, sf_dir):
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents")))


@query("op4_minhash_dedup")
def op4(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op5_quality_rules")
def op5(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality_rules.judge(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


@query("op6_quality_classifier")
def op6(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality_classifier.classify(docs, quality_classifier.fit(docs, table(spark, sf_dir, "labels")))


@query("op7_lm_score")
def op7(spark, sf_dir):
    return language_model.score_texts(table(spark, sf_dir, "documents"))


@query("op8_decontaminate")
def op8(spark, sf_dir):
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op9_pii_pseudonyms")
def op9(spark, sf_dir):
    return pseudonyms.pseudonymise(table(spark, sf_dir, "documents"))


@query("op10_toxicity")
def op10(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.predict(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@query("op11_whitening")
def op11(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query("op12_token_alignment")
def op12(spark, sf_dir):
    return token_alignment.align_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                        public_tokenizers.path("piece_bpe_32k.model"))


@query("op13_token_counts")
def op13(spark, sf_dir):
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)
