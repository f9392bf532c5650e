"""A training corpus from documents: rules, near duplicates, personal data, mixing, packing.

Each stage works on all rows its predecessor kept, as Parquet in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folio.llm import jaccard_join, mixing, packing, pii, quality_rules
from folio.llm.common import Workspace
from folio.llm.queries import POLICY, pseudonym_key, tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality_rules.keep_rows(docs, POLICY)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links join, the one with the smallest id stays."""
    return jaccard_join.keep_first(docs, Workspace(spark, "near"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts become pseudonyms; n_chars follows."""
    return pii.pseudonymize_rows(docs, pseudonym_key())


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix_rows(docs, Workspace(spark, "mixture"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequence and place."""
    return packing.pack(docs, tokenizer_path(), Workspace(spark, "packed"))


STAGES: list[tuple[str, Stage]] = [("quality_rules", quality), ("ngram_jaccard_join", near_duplicates), ("pii", personal_data), ("mixing", mixture), ("best_fit_packing", packed)]

#: Shingle components, keyed permutations and tokens can't be expressed in SQL: tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES over the documents of sf_dir."""
    work, docs = Workspace(spark, "pipeline"), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = work.keep(docs, name)
            if k:
                work.drop(STAGES[k - 1][0])
    return docs
