"""Uploads and their status over pages, parts, events and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import store
from ..streaming import ingest
from .registry import literal, query, table


@query(f"""WITH m AS (SELECT DISTINCT CASE WHEN p_partkey % 97 = 0 THEN '{store.DEFAULT_MODEL}' WHEN p_partkey % 3 = 0 THEN '--' || p_name || '/' || p_partkey || ' with a long name v1.2--' ELSE p_name END AS model FROM part),
s AS (SELECT model, regexp_replace(regexp_replace(model, '[^a-zA-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM m)
SELECT model, CASE WHEN model = '{store.DEFAULT_MODEL}' THEN 'pdf_documents' ELSE 'pdf_documents__' || CASE WHEN length(slug) > 40 THEN rtrim(left(slug, 31), '_') || '_' || left(sha1(model), 8) ELSE slug END END AS collection FROM s""")
def collection_name(spark, d):
    """Names of parts as names of models, some long, some the default."""
    key = F.col("p_partkey")
    model = F.when(key % 97 == 0, F.lit(store.DEFAULT_MODEL)).when(key % 3 == 0, F.concat(F.lit("--"), F.col("p_name"), F.lit("/"), key.cast("string"), F.lit(" with a long name v1.2--"))).otherwise(F.col("p_name"))
    return table(spark, d, "part").select(model.alias("model")).distinct().withColumn("collection", store.collection_name(F.col("model")))


_UPLOADS = """u AS (SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'text/plain' WHEN 1 THEN NULL ELSE 'application/pdf' END AS content_type, CAST(strlen(coalesce(html, '')) AS BIGINT) * CASE WHEN page_id % 11 = 3 THEN 100000 ELSE 1 END AS size,
 CASE WHEN page_id % 5 = 2 THEN left(html, 8) ELSE '%PDF-1.7' END AS head, 250 + page_id % 60 AS pages, CASE page_id % 9 WHEN 4 THEN 'malformed' WHEN 5 THEN 'disk' END AS open_error, CASE WHEN page_id % 2 = 0 THEN 'A.PDF' ELSE 'a.txt' END AS name FROM pages)"""


@query(f"""WITH {_UPLOADS}, c AS (SELECT *, CASE WHEN coalesce(content_type, '') <> 'application/pdf' THEN 1 WHEN size > 20971520 THEN 2 WHEN coalesce(left(head, 5), '') <> '%PDF-' THEN 3 WHEN open_error = 'malformed' THEN 3 WHEN open_error IS NOT NULL THEN 4 WHEN pages > 300 THEN 5 ELSE 6 END AS k FROM u)
SELECT page_id, [400, 413, 400, 500, 400, 202][k] AS status_code, {literal([store.NOT_PDF, store.TOO_LARGE, store.UNREADABLE, store.INTERNAL, store.TOO_MANY_PAGES])}[k] AS detail, (coalesce(content_type, '') = 'application/pdf' OR ends_with(lower(name), '.pdf')) AS client_accepts FROM c""")
def upload_validate(spark, d):
    """Web pages as uploads: types, sizes, beginnings, page counts and failures to open by their id."""
    i = F.col("page_id")
    kind = F.when(i % 7 == 0, "text/plain").when(i % 7 != 1, "application/pdf")
    size = F.octet_length(F.coalesce("html", F.lit(""))).cast("long") * F.when(i % 11 == 3, 100_000).otherwise(1)
    u = table(spark, d, "pages").select("page_id", kind.alias("content_type"), size.alias("size"), F.when(i % 5 == 2, F.left("html", F.lit(8))).otherwise(F.lit("%PDF-1.7")).alias("head"), (250 + i % 60).alias("pages"),
                                        F.when(i % 9 == 4, "malformed").when(i % 9 == 5, "disk").alias("open_error"), F.when(i % 2 == 0, "A.PDF").otherwise("a.txt").alias("name"))
    return store.validate(u).select("page_id", "status_code", "detail", store.client_accepts(F.col("name"), F.col("content_type")).alias("client_accepts"))


_LOG = """lg AS (SELECT user_id AS document_id, event_id AS seq, ['queued', 'reading', 'recognizing', 'embedding', 'saving', 'done'][event_id % 6 + 1] AS step, event_id % 5 AS pages, event_id % 7 AS chunks, CASE WHEN event_id % 50 = 7 THEN 'x' END AS error FROM events),
ow AS (SELECT *, CASE WHEN error IS NOT NULL THEN 'failed' WHEN step = 'done' THEN CASE WHEN pages = 0 OR chunks = 0 THEN 'failed' ELSE 'ready' END WHEN step = 'queued' THEN 'pending' ELSE 'processing' END AS own FROM lg),
st AS (SELECT document_id, seq, CASE WHEN bool_or(own = 'failed') OVER (PARTITION BY document_id ORDER BY seq) THEN 'failed' ELSE own END AS status FROM ow)"""


def _log(spark, d):
    i = F.col("event_id")
    step = F.get(F.array(*map(F.lit, ("queued", "reading", "recognizing", "embedding", "saving", "done"))), (i % 6).cast("int"))
    return table(spark, d, "events").select(F.col("user_id").alias("document_id"), i.alias("seq"), step.alias("step"), (i % 5).alias("pages"), (i % 7).alias("chunks"), F.when(i % 50 == 7, "x").alias("error"))


@query(f"WITH {_LOG} SELECT document_id, seq, status FROM st")
def upload_states(spark, d):
    return ingest.states(_log(spark, d))


@query(f"""WITH {_LOG}, la AS (SELECT document_id, arg_max(status, seq) AS status, max(seq) AS seq FROM st GROUP BY 1)
SELECT c_custkey AS document_id, CASE WHEN status IS NULL THEN 404 ELSE 200 END AS status_code, status, CASE WHEN status = 'failed' THEN CASE WHEN seq % 2 = 0 THEN 'why' ELSE {literal(ingest.GENERIC_REASON)} END END AS reason, CASE WHEN status <> 'failed' THEN CAST(seq % 100 AS INT) END AS progress FROM customer LEFT JOIN la ON la.document_id = c_custkey""")
def upload_status(spark, d):
    """Customers ask for the uploads of their number; few have one."""
    e = ingest.states(_log(spark, d)).select("document_id", "seq", "status", F.when(F.col("seq") % 2 == 0, "why").alias("reason"), (F.col("seq") % 100).cast("int").alias("progress"))
    return ingest.status(table(spark, d, "customer").select(F.col("c_custkey").alias("document_id")), e)


_STAGES = ("reading", "recognizing", "embedding", "saving")


@query(f"""WITH s AS (SELECT event_id, {literal(list(_STAGES))}[event_id % 4 + 1] AS stage, CAST(event_id % 7 AS INT) AS done, CASE WHEN event_id % 11 = 0 THEN 0 ELSE 7 END AS total, user_id % 2 = 0 AS ocr FROM events)
SELECT event_id, CAST(trunc(CASE stage WHEN 'recognizing' THEN CASE WHEN total = 0 THEN 0 ELSE 60.0::DOUBLE * done / total END WHEN 'embedding' THEN (CASE WHEN ocr THEN 60 ELSE 10 END) + CASE WHEN total = 0 THEN 0 ELSE (95.0::DOUBLE - CASE WHEN ocr THEN 60 ELSE 10 END) * (done / CAST(total AS DOUBLE)) END WHEN 'saving' THEN 95 ELSE 0 END) AS INT) AS percent,
CASE stage WHEN 'recognizing' THEN 'This PDF is scanned. Reading page ' || done || ' of ' || total || ' with text recognition…' WHEN 'embedding' THEN {literal(ingest.INDEXING)} WHEN 'saving' THEN {literal(ingest.SAVING)} ELSE {literal(ingest.READING)} END AS shown FROM s""")
def job_progress(spark, d):
    """Events as steps of jobs; every eleventh has nothing to count."""
    i = F.col("event_id")
    stage, done, total = F.get(F.array(*map(F.lit, _STAGES)), (i % 4).cast("int")), (i % 7).cast("int"), F.when(i % 11 == 0, 0).otherwise(7)
    return table(spark, d, "events").select("event_id", ingest.progress(stage, done, total, F.col("user_id") % 2 == 0).alias("percent"), ingest.stage_text(stage, done, total).alias("shown"))


@query("SELECT user_id, CAST(count(*) AS BIGINT) AS requests, CAST(count(*) AS BIGINT) AS ids, 36 AS id_length, CAST(count(*) FILTER (event_type = 'purchase') AS BIGINT) AS failed FROM events GROUP BY user_id")
def request_log(spark, d):
    """Each request has an id of its own; purchases fail."""
    r = ingest.with_request_id(table(spark, d, "events"), F.col("event_type") == "purchase")
    return r.groupBy("user_id").agg(F.count("*").alias("requests"), F.count_distinct("request_id").alias("ids"), F.max(F.length("request_id")).alias("id_length"), F.count_if(F.col("detail").isNotNull()).alias("failed"))
