"""The thin queries over the synthetic tables, one for each operator, and their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jaccard_join, langid, mixing, packing, pii, quality_classifier, quality_rules, suffix_dedup, topk, warc
from .common import Workspace

POLICY = "v2"


def tokenizer_path() -> str:
    """The public tokenizer's file, the same on every machine; FOLIO_TOKENIZER names another."""
    import public_tokenizers

    return os.environ.get("FOLIO_TOKENIZER") or public_tokenizers.path("word_bpe_49k.json")


#: Without a key named, one is drawn for this process: values stay linked within it and nobody can invert them later.
_SESSION_KEY = os.urandom(32)


def pseudonym_key() -> bytes:
    """FOLIO_PSEUDONYM_KEY, where values must stay linked over several runs or be inverted; else the session's own. 64 bytes at most count."""
    named = os.environ.get("FOLIO_PSEUDONYM_KEY", "").encode()
    return named[:64] or _SESSION_KEY


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites of documents: the source is the host, the language within it the path."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return quality_classifier.classify(docs, labels, Workspace(spark, "classifier"), F.col("source"), F.concat_ws("/", "source", "lang"))


def op2_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"), Workspace(spark, "warc"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(_table(spark, sf_dir, "documents"), Workspace(spark, "jaccard"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_policy(quality_rules.ledger(_table(spark, sf_dir, "documents")), POLICY)


def quality_rules_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the policy rejects, alone and with others, from the ledger's bits."""
    return quality_rules.ablation(quality_rules.ledger(_table(spark, sf_dir, "documents")), POLICY).drop("seen_bits")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(_table(spark, sf_dir, "documents"), Workspace(spark, "suffix")).drop("kept")


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), Workspace(spark, "topk"), "vec_id % 20 = 0")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path(), Workspace(spark, "pack"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    learn = docs.filter(~langid.held_out())
    out = langid.identify(docs, learn)
    return out.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(mixing.sizes(_table(spark, sf_dir, "documents")), Workspace(spark, "mix"))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def op10_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(_table(spark, sf_dir, "documents"), pseudonym_key())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_classifier, op2_warc_round_trip, op3_ngram_jaccard_join, op4_quality_rules, op5_suffix_dedup, op6_exact_top_k, op7_best_fit_packing, op8_language_id, op9_source_mixing, op10_pii_pseudonyms, quality_rules_ablation)}


def oracle_sql() -> dict[str, str]:
    return {"op2_warc_round_trip": warc.oracle_sql(), "op6_exact_top_k": topk.oracle_sql(), "op4_quality_rules": quality_rules.oracle_sql(POLICY), "quality_rules_ablation": quality_rules.ablation_sql(POLICY), "op9_source_mixing": mixing.oracle_sql()}
