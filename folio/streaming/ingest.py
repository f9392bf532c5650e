"""Ingestion status: a log of events, its latest state by document, and a file stream that appends chunks."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Shares of the progress bar, and the reason given when none is known.
TEXT_SHARE, OCR_SHARE, EMBEDDED = 10, 60, 95
GENERIC_REASON = "The document could not be processed."


def progress(stage: Column, done: Column, total: Column, used_ocr: Column) -> Column:
    """Whole percent: reading 0, recognizing up to 60, embedding from the read share to 95, saving 95."""
    base = F.when(used_ocr, OCR_SHARE).otherwise(TEXT_SHARE)
    share = F.when(total > 0, done / total).otherwise(F.lit(0.0))
    return F.when(stage == "recognizing", OCR_SHARE * share).when(stage == "embedding", base + (EMBEDDED - base) * share).when(stage == "saving", EMBEDDED).otherwise(0).cast("int")


def outcome(pages: Column, chunks: Column, error: Column) -> Column:
    """ready, or failed if nothing was extracted, nothing chunked, or a step failed."""
    return F.when(error.isNotNull() | (F.coalesce(pages, F.lit(0)) == 0) | (F.coalesce(chunks, F.lit(0)) == 0), "failed").otherwise("ready")


#: Steps of an upload between its acceptance and its end.
STEPS = ("reading", "recognizing", "embedding", "saving")


def states(log: DataFrame) -> DataFrame:
    """document_id, seq, status of each event of a log (document_id, seq, step, pages, chunks, error): pending, processing, then ready or failed.

    An error fails the document at any step, and what comes after does not change that.
    """
    own = F.when(F.col("error").isNotNull(), "failed").when(F.col("step") == "done", outcome(F.col("pages"), F.col("chunks"), F.col("error"))).when(F.col("step").isin(*STEPS), "processing").otherwise("pending")
    failed = F.max(F.col("own") == "failed").over(Window.partitionBy("document_id").orderBy("seq"))
    return log.withColumn("own", own).withColumn("failed", failed).select("document_id", "seq", F.when(F.col("failed"), "failed").otherwise(F.col("own")).alias("status"))


def poll(status_of: Callable[[], str | None], every: float = 0.4, most: int | None = None, sleep: Callable[[float], None] = time.sleep) -> str | None:
    """The first status that ends an upload (ready or failed), asked for every so many seconds; None after most questions."""
    asked = 0
    while most is None or asked < most:
        asked += 1
        if (status := status_of()) in ("ready", "failed"):
            return status
        sleep(every)
    return None


def with_request_id(requests: DataFrame, failed: Column) -> DataFrame:
    """requests with a request_id of their own and the response's status_code and detail: an unexpected failure says nothing but the id."""
    from ..sources.store import INTERNAL

    return requests.withColumns({"request_id": F.uuid(), "status_code": F.when(failed, 500).otherwise(200), "detail": F.when(failed, INTERNAL)})


def latest(events: DataFrame, key: str = "document_id", seq: str = "seq") -> DataFrame:
    """The newest event of each document, by partial aggregation."""
    rest = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("e")).select(key, *(F.col(f"e.{c}").alias(c) for c in rest))


def status(asked: DataFrame, events: DataFrame) -> DataFrame:
    """document_id, status_code, status, reason, progress for each document asked for: 404 if unknown; a failed one only has its reason."""
    last = latest(events)
    j = asked.join(last, "document_id", "left")
    failed = F.col("status") == "failed"
    return j.select("document_id", F.when(F.col("status").isNull(), 404).otherwise(200).alias("status_code"), "status", F.when(failed, F.coalesce("reason", F.lit(GENERIC_REASON))).alias("reason"), F.when(~failed, F.col("progress")).alias("progress"))


def ready_summary(pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """document_id, pages (the largest page number present), chunks, ocr_pages, ocr_quality.

    The mean confidence is rounded before it is judged: its last digits depend on the order in which pages are added up.
    """
    p = pages.groupBy("document_id").agg(F.max("page").alias("pages"), F.count_if(F.coalesce(F.col("ocr"), F.lit(False))).alias("ocr_pages"), F.round(F.avg("ocr_confidence"), 9).alias("c"))
    n = chunks.groupBy("document_id").agg(F.count("*").alias("chunks"))
    quality = F.when(F.col("c") < 0.9, "low").when(F.col("c").isNotNull(), "good")
    return p.join(n, "document_id", "left").select("document_id", "pages", F.coalesce("chunks", F.lit(0)).alias("chunks"), "ocr_pages", quality.alias("ocr_quality"))


#: What a client shows for a stage.
READING, INDEXING, SAVING = "Reading the document…", "Indexing the document for search…", "Saving…"


def stage_text(stage: Column, done: Column, total: Column) -> Column:
    """What a client shows for a stage."""
    scanned = F.concat(F.lit("This PDF is scanned. Reading page "), F.coalesce(done.cast("string"), F.lit("0")), F.lit(" of "), F.coalesce(total.cast("string"), F.lit("?")), F.lit(" with text recognition…"))
    return F.when(stage == "recognizing", scanned).when(stage == "embedding", INDEXING).when(stage == "saving", SAVING).otherwise(READING)


def error_detail(body: Column, fallback: Column) -> Column:
    """The detail of an error body if it is a JSON string, else the fallback."""
    v = F.try_parse_json(body)
    return F.coalesce(F.when(F.schema_of_variant(F.try_variant_get(v, "$.detail", "variant")) == "STRING", F.try_variant_get(v, "$.detail", "string")), fallback)


def answer_events(answers: DataFrame) -> DataFrame:
    """request_id, seq, event, data from answers (request_id, sources JSON, deltas, error): sources, tokens, then done or error."""
    token = F.transform(F.filter("deltas", lambda d: F.coalesce(d, F.lit("")) != ""), lambda d: F.struct(F.lit("token").alias("event"), F.to_json(F.struct(d.alias("text"))).alias("data")))
    from ..functions.conversation import final_answer

    done = F.struct(F.lit("done").alias("event"), F.to_json(F.struct(final_answer(F.array_join("deltas", "")).alias("answer"))).alias("data"))
    fail = F.struct(F.lit("error").alias("event"), F.to_json(F.struct(F.col("error").alias("detail"))).alias("data"))
    first = F.array(F.struct(F.lit("sources").alias("event"), F.col("sources").alias("data")))
    rows = F.concat(first, token, F.array(F.when(F.col("error").isNull(), done).otherwise(fail)))
    return answers.select("request_id", F.posexplode(rows).alias("seq", "e")).select("request_id", F.col("seq").cast("long").alias("seq"), "e.event", "e.data")


def stream_pages(spark: SparkSession, folder: str, schema: str, out: str, checkpoint: str, chunk: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Pages arriving as JSON files are kept, and the documents they belong to chunked anew from all their pages so far; see read_chunks.

    Each batch has folders of its own, so one that runs again replaces them.
    """
    pages = spark.readStream.schema(schema).json(folder)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/pages/batch={batch_id}")
        seen = spark.read.option("basePath", f"{out}/pages").parquet(f"{out}/pages").filter(F.col("batch") <= batch_id)
        touched = seen.filter(F.col("batch") == batch_id).select("document_id").distinct()
        chunk(seen.drop("batch").join(touched, "document_id", "left_semi")).write.mode("overwrite").parquet(f"{out}/chunks/batch={batch_id}")
        touched.write.mode("overwrite").parquet(f"{out}/touched/batch={batch_id}")

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_chunks(spark: SparkSession, out: str) -> DataFrame:
    """The chunks of stream_pages: of each document those of the last batch that touched it."""
    last = spark.read.parquet(f"{out}/touched").groupBy("document_id").agg(F.max("batch").alias("batch"))
    return spark.read.parquet(f"{out}/chunks").join(last, ["document_id", "batch"], "left_semi").drop("batch")


def stream_latest(events: DataFrame, key: str = "document_id", seq: str = "seq") -> DataFrame:
    """The newest event of each document of a stream, kept as state; for output mode update or complete."""
    rest = [c for c in events.columns if c != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("event"))
