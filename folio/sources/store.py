"""Chunk and vector stores as partitioned Parquet, files as sources, reports as JSON."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The default embedding model, the collection's name, and how long names are cut.
DEFAULT_MODEL, COLLECTION = "sentence-transformers/all-mpnet-base-v2", "pdf_documents"


@dataclass(frozen=True)
class Config:
    """Limits from the environment: anything but a positive integer falls back to the default."""

    max_bytes: int = 20 * 1024 * 1024
    max_pages: int = 300
    ocr: bool = True

    @classmethod
    def from_env(cls, env=os.environ) -> "Config":
        def positive(name: str, default: int) -> int:
            try:
                n = int(env.get(name, default))
            except ValueError:
                return default
            return n if n > 0 else default

        return cls(positive("MAX_UPLOAD_SIZE_BYTES", cls.max_bytes), positive("MAX_PDF_PAGES", cls.max_pages), env.get("OCR_ENABLED", "true").strip().lower() not in ("0", "false", "no", "off"))


def files(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)


#: What a client is told of an upload that is not taken.
NOT_PDF, TOO_LARGE, UNREADABLE = "Only PDF files are accepted.", "The uploaded file is too large.", "The uploaded file is not a readable PDF."
TOO_MANY_PAGES, INTERNAL = "The uploaded PDF has too many pages.", "An unexpected internal error occurred."


def validate(files: DataFrame, config: Config = Config()) -> DataFrame:
    """files (content_type, size, head, pages, optional open_error) with status_code and detail; checks in order: type, size, magic, opening, pages.

    open_error says why a file could not be opened: malformed (as a PDF), or anything else, which is an internal error.
    """
    head, error = F.substring(F.col("head"), 1, 5), F.col("open_error") if "open_error" in files.columns else F.lit(None)
    checks = (
        (F.coalesce(F.col("content_type"), F.lit("")) != "application/pdf", 400, NOT_PDF),
        (F.col("size") > config.max_bytes, 413, TOO_LARGE),
        (F.coalesce(head, F.lit("")) != "%PDF-", 400, UNREADABLE),
        (error == "malformed", 400, UNREADABLE),
        (error.isNotNull(), 500, INTERNAL),
        (F.col("pages") > config.max_pages, 400, TOO_MANY_PAGES),
    )
    code = detail = F
    for failed, status, text in checks:
        code, detail = code.when(failed, status), detail.when(failed, text)
    return files.withColumns({"status_code": code.otherwise(202), "detail": detail})


def client_accepts(name: Column, content_type: Column) -> Column:
    """The looser check of a client: the type or the name's ending."""
    return (F.coalesce(content_type, F.lit("")) == "application/pdf") | F.lower(name).endswith(".pdf")


def collection_name(model: Column) -> Column:
    slug = F.regexp_replace(F.regexp_replace(model, "[^a-zA-Z0-9]+", "_"), "^_+|_+$", "")
    cut = F.concat(F.regexp_replace(F.left(slug, F.lit(31)), "_+$", ""), F.lit("_"), F.left(F.sha1(model.cast("binary")), F.lit(8)))
    return F.when(model == DEFAULT_MODEL, F.lit(COLLECTION)).otherwise(F.concat(F.lit(f"{COLLECTION}__"), F.when(F.length(slug) > 40, cut).otherwise(slug)))


def chunk_key(document_id: Column, chunk_index: Column) -> Column:
    return F.concat_ws(":", document_id, chunk_index)


class Store:
    """Chunks with vectors of one model in one folder, in buckets by a hash of the document, sorted by document within.

    However many documents there are, folders stay as many as buckets; a document's scan reads one bucket's files, and of them the
    row groups whose statistics hold it.
    """

    def __init__(self, spark: SparkSession, folder: str, model: str = DEFAULT_MODEL, buckets: int = 256):
        self.spark, self.buckets = spark, buckets
        name = spark.range(1).select(collection_name(F.lit(model)).alias("n")).first()["n"]
        self.path = f"{folder.rstrip('/')}/{name}"

    def _bucket(self, document_id: Column) -> Column:
        return F.pmod(F.xxhash64(document_id.cast("string")), F.lit(self.buckets)).cast("int")

    def add(self, chunks: DataFrame) -> None:
        """Appends chunks; rows of one bucket are brought together first, so that it gets one file."""
        rows = chunks.withColumn("bucket", self._bucket(F.col("document_id")))
        rows.repartition("bucket").sortWithinPartitions("bucket", "document_id", "chunk_index").write.mode("append").partitionBy("bucket").parquet(self.path)

    def scan(self, document_id: str | None = None) -> DataFrame:
        rows = self.spark.read.parquet(self.path)
        if document_id is not None:
            rows = rows.filter((F.col("bucket") == self._bucket(F.lit(document_id))) & (F.col("document_id") == document_id))
        return rows.drop("bucket")

    def get(self, keys: DataFrame) -> DataFrame:
        """Point lookup by (document_id, chunk_index); keys that do not exist are dropped. The bucket prunes folders at run time."""
        asked = keys.select("document_id", "chunk_index").distinct().withColumn("bucket", self._bucket(F.col("document_id")))
        return self.spark.read.parquet(self.path).join(asked, ["bucket", "document_id", "chunk_index"]).drop("bucket")

    def delete(self) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def isolated(spark: SparkSession, model: str = DEFAULT_MODEL) -> Iterator[Store]:
    """A store of its own for one run of a benchmark, which goes afterwards: under spark.checkpoint.dir, or on a local master in a local folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    store = Store(spark, f"{shared or 'file://' + tempfile.gettempdir()}/isolated-{uuid.uuid4().hex}", model)
    try:
        yield store
    finally:
        store.delete()


def diagnostics(chunks: DataFrame) -> DataFrame:
    """document_id (missing as unknown), chunks, preview: the first chunk's first 150 characters."""
    return chunks.groupBy(F.coalesce(F.col("document_id").cast("string"), F.lit("unknown")).alias("document_id")).agg(F.count("*").alias("chunks"), F.left(F.min_by("text", "chunk_index"), F.lit(150)).alias("preview"))


def report(rows: DataFrame, folder: str) -> None:
    """Rows as JSON lines, without contexts."""
    rows.drop("context").write.mode("overwrite").json(folder)
