"""Each query of the catalogue against its SQL on the second engine; the others for their invariants."""

import pytest

from folio.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_matches_sql(name, same):
    assert same(catalogue.QUERIES[name], catalogue.ORACLE[name]) is not None


def test_prose_chunks_are_dense_and_within_sections(spark, data):
    rows = catalogue.QUERIES["prose_chunks"](spark, data).collect()
    by = {}
    for r in rows:
        by.setdefault(r["document_id"], []).append(r)
    assert by
    for own in by.values():
        assert sorted(r["chunk_index"] for r in own) == list(range(len(own)))
        assert all(r["text"].strip() == r["text"] != "" for r in own)


def test_hybrid_ranks_are_dense(spark, data):
    rows = catalogue.QUERIES["hybrid_pipeline"](spark, data).collect()
    by = {}
    for r in rows:
        by.setdefault(r["query_id"], []).append(r["rank"])
    assert by and all(sorted(v) == list(range(1, len(v) + 1)) and len(v) <= 3 for v in by.values())


@pytest.mark.parametrize("name", ["rrf_fusion", "rerank_overlap", "hybrid_pipeline"])
def test_every_language_is_searched(name, spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    languages = {r["lang"] for r in docs.select("lang").distinct().collect()}
    assert len(languages) > 1 and {r["document_id"] for r in catalogue.QUERIES[name](spark, data).select("document_id").distinct().collect()} == languages


@pytest.mark.parametrize("name", ["recall_precision_ndcg", "hit_mrr_pagehit"])
def test_every_language_is_judged(name, spark, data):
    languages = {r["lang"] for r in spark.read.parquet(f"{data}/documents.parquet").select("lang").distinct().collect()}
    found = catalogue.QUERIES[name](spark, data).filter("mrr > 0").selectExpr("split_part(query_id, ':', 2) AS lang").distinct().collect()
    assert len({r["lang"] for r in found}) > 1 and {r["lang"] for r in found} <= languages


@pytest.mark.parametrize("name", ["knn_l2_topk", "knn_cosine_topk"])
def test_every_fiftieth_vector_is_asked(name, spark, data):
    ids = {r["vec_id"] for r in spark.read.parquet(f"{data}/embeddings.parquet").filter("vec_id % 50 = 0").collect()}
    assert ids and {r["query_id"] for r in catalogue.QUERIES[name](spark, data).collect()} == ids
