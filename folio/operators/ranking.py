"""Ranked retrieval as relational algebra: BM25, k nearest neighbours, fusion, rerank, neighbours, context.

Chunks are rows (document_id, chunk_index, ..., text); a ranking is rows (query_id, document_id, chunk_index, rank, score).
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.text import bm25_tokens

K1, B, RRF_K = 1.5, 0.75, 60
DIGITS = 6


def _top(rows: DataFrame, k: int, *order: Column, by: tuple[str, ...] = ("query_id", "document_id")) -> DataFrame:
    """row_number() <= k, which Spark prunes before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).filter(F.col("rank") <= k)


#: Distinct terms that queries may ask for while they are broadcast, weights of terms, and queries with vectors: each a few dozen MB at most. Beyond, joins shuffle.
BROADCAST_TERMS, BROADCAST_WEIGHTS, BROADCAST_QUERIES = 1 << 20, 1 << 18, 1 << 16


def few(rows: DataFrame, limit: int) -> DataFrame:
    """rows, marked for broadcast if there are no more than limit."""
    return F.broadcast(rows) if rows.limit(limit + 1).count() <= limit else rows


def postings(chunks: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """document_id, chunk_index, term, tf, length: of all terms, or those in terms only, which then go before anything is shuffled.

    Chunks may have a column asked, the terms that matter in their document.
    """
    t = chunks.select("document_id", "chunk_index", *(["asked"] if "asked" in chunks.columns else []), F.sort_array(bm25_tokens(F.col("text"))).alias("tokens")).withColumn("length", F.size("tokens"))
    if "asked" in chunks.columns:
        t = t.withColumn("tokens", F.filter("tokens", lambda x: F.array_contains("asked", x)))
    n = F.size("tokens")
    # equal tokens lie side by side: a term counts from its first place to that of the next, so no row leaves its task
    firsts = F.filter(F.when(n > 0, F.sequence(F.lit(1), n)), lambda i: (i == 1) | (F.get("tokens", i - 1) != F.get("tokens", i - 2)))
    t = t.select("document_id", "chunk_index", "length", "tokens", firsts.alias("firsts"))
    counted = F.transform("firsts", lambda i, no: F.struct(F.get("tokens", i - 1).alias("term"), (F.coalesce(F.get("firsts", no + 1), F.size("tokens") + 1) - i).cast("long").alias("tf")))
    rows = t.select("document_id", "chunk_index", "length", F.inline(counted))
    return rows if terms is None else rows.join(few(terms.select("term").distinct(), BROADCAST_TERMS), "term", "left_semi")


def document_stats(chunks: DataFrame) -> DataFrame:
    """document_id, n, avg_length over all chunks, those without tokens too. Tokens are counted, not built."""
    t = chunks.select("document_id", F.regexp_count("text", F.lit("[A-Za-z0-9]+")).alias("length"))
    return t.groupBy("document_id").agg(F.count("*").alias("n"), F.avg("length").alias("avg_length"))


def term_counts(chunks: DataFrame, terms: DataFrame) -> DataFrame:
    """document_id, term, df of the terms asked for, straight from the texts: without places and frequencies this costs less than postings."""
    t = chunks.select("document_id", F.explode(F.array_distinct(bm25_tokens(F.col("text")))).alias("term"))
    return term_stats(t.join(few(terms.select("term").distinct(), BROADCAST_TERMS), "term", "left_semi"))


def term_stats(posted: DataFrame) -> DataFrame:
    return posted.groupBy("document_id", "term").agg(F.count("*").alias("df"))


class Index:
    """Postings, document statistics and chunk places of a collection, written once for each version of it.

    A question reads the postings of its terms instead of the texts: they are sorted by term, so whole row groups are skipped. When the collection has
    changed, the caller names another version and the index is made anew.
    """

    def __init__(self, chunks: DataFrame, folder: str, version: str):
        self.spark, self.path = chunks.sparkSession, f"{folder.rstrip('/')}/index-{version}"
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/complete")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(path):
            places = chunks.select("document_id", "chunk_index")
            for name, rows in (("postings", postings(chunks).repartitionByRange("term").sortWithinPartitions("term", "document_id")), ("stats", document_stats(chunks)), ("places", places)):
                rows.write.mode("overwrite").parquet(f"{self.path}/{name}")
            fs.create(path).close()

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def bm25(self, queries: DataFrame, k: int = 10, drop_zero: bool = False) -> DataFrame:
        terms = query_terms(queries)
        posted = self._read("postings").join(few(terms.select("term").distinct(), BROADCAST_TERMS), "term", "left_semi")
        return _bm25(terms, posted, term_stats(posted), self._read("stats"), self._read("places"), k, drop_zero)


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, (document_id if queries name one), term, times."""
    keys = [c for c in ("query_id", "document_id") if c in queries.columns]
    return queries.select(*keys, F.explode(bm25_tokens(F.col("text"))).alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("times"))


def bm25(queries: DataFrame, chunks: DataFrame, k: int = 10, drop_zero: bool = False) -> DataFrame:
    """The k best chunks of each document for each query; chunks that score 0 pad the list in chunk order.

    Queries name their document by document_id, or else are asked of all. Statistics are each document's own; a query term
    counts as often as it occurs. Padding takes no cross join with all chunks: a list with m < k hits needs
    k - m misses, and among the first 2k chunks of a document there are that many.
    """
    terms = query_terms(queries)
    if "document_id" in terms.columns:
        # texts meet the terms asked of their own document, and only postings of those are made: the vocabulary of all questions would leave out little
        met = chunks.select("document_id", "chunk_index", "text").join(terms.groupBy("document_id").agg(F.collect_set("term").alias("asked")), "document_id")
        posted = postings(met)
        return _bm25(terms, posted, term_stats(posted), document_stats(chunks), chunks.select("document_id", "chunk_index"), k, drop_zero)
    return _bm25(terms, postings(chunks, terms), term_counts(chunks, terms), document_stats(chunks), chunks.select("document_id", "chunk_index"), k, drop_zero)


def _numbered(spark: SparkSession, table: pa.Table, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """The rows of table with query_no in place of query_id, and query_no, query_id of each query; both as rows of the plan."""
    codes = table["query_id"].combine_chunks().dictionary_encode(null_encoding="encode")
    numbered = table.set_column(table.column_names.index("query_id"), "query_no", codes.indices.cast(pa.int32()))
    names = pa.table({"query_no": pa.array(range(len(codes.dictionary)), pa.int32()), "query_id": codes.dictionary})
    number = StructField("query_no", IntegerType())
    return (spark.createDataFrame(numbered, StructType([number if f.name == "query_id" else f for f in schema])),
            spark.createDataFrame(names, StructType([number, schema["query_id"]])))


def _bm25(terms: DataFrame, posted: DataFrame, counts: DataFrame, stats: DataFrame, chunks: DataFrame, k: int, drop_zero: bool) -> DataFrame:
    """See bm25; posted holds the queries' terms only."""
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    known = counts.join(stats, "document_id").select("document_id", "term", idf.alias("idf"), "avg_length")
    weights = known.join(few(terms, BROADCAST_TERMS), [c for c in ("document_id", "term") if c in terms.columns])
    weights = weights.select("query_id", "document_id", "term", (F.col("times") * F.col("idf")).alias("weight"), "avg_length")
    table = None if "document_id" in terms.columns else weights.limit(BROADCAST_WEIGHTS + 1).toArrow()
    key = "query_id"
    if table is not None and table.num_rows <= BROADCAST_WEIGHTS:
        # a chunk's postings meet in one task and stay there until its scores are whole and the k best of the task are known; queries go by number
        local, names = _numbered(posted.sparkSession, table, weights.schema)
        hits, key = posted.repartition("document_id", "chunk_index").join(F.broadcast(local), ["document_id", "term"]), "query_no"
    else:
        hits = posted.join(weights, ["document_id", "term"])
    norm = F.when(F.col("avg_length") > 0, 1 - B + B * F.col("length") / F.col("avg_length")).otherwise(F.lit(1.0))
    part = F.col("weight") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * norm)
    scored = hits.groupBy(key, "document_id", "chunk_index").agg(F.round(F.sum(part), DIGITS).alias("score"))
    best = _top(scored, k, F.desc("score"), F.col("chunk_index"), by=(key, "document_id"))
    if key != "query_id":
        best = best.join(F.broadcast(names), key).drop(key)
    if drop_zero:
        return best.select("query_id", "document_id", "chunk_index", "rank", "score")
    first = _top(chunks.select("document_id", "chunk_index"), 2 * k, F.col("chunk_index"), by=("document_id",)).select("document_id", "chunk_index")
    asked = terms.select(*[c for c in ("query_id", "document_id") if c in terms.columns]).distinct()
    pad = first.join(asked, "document_id") if "document_id" in asked.columns else first.crossJoin(asked)
    pad = pad.select("query_id", "document_id", "chunk_index", F.lit(0.0).alias("score"))
    both = best.drop("rank").unionByName(pad).groupBy("query_id", "document_id", "chunk_index").agg(F.max("score").alias("score"))
    return _top(both, k, F.desc("score"), F.col("chunk_index")).select("query_id", "document_id", "chunk_index", "rank", "score")


def knn(queries: DataFrame, vectors: DataFrame, k: int = 3, metric: str = "l2") -> DataFrame:
    """Exact k nearest vectors within the query's document: queries (query_id, document_id, vector), vectors (document_id, chunk_index, vector).

    score is the squared distance (l2) or the cosine; the join is on document_id, so only one document's vectors meet a query. Few queries are
    broadcast: then vectors stay where they are, and each task keeps its k best.
    """
    q = queries.select("query_id", "document_id", F.col("vector").alias("q"))
    v = vectors.select("document_id", "chunk_index", F.col("vector").alias("v"))
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    dot = lambda a, b: add(F.zip_with(a, b, lambda x, y: x * y))
    if metric == "l2":
        score, order = add(F.zip_with("q", "v", lambda x, y: (x - y) * (x - y))), F.asc
    else:
        score, order = dot("q", "v") / (F.sqrt(dot("q", "q")) * F.sqrt(dot("v", "v"))), F.desc
    # widened only where they have met: vectors of floats are half as large in a shuffle
    rows = v.join(few(q, BROADCAST_QUERIES), "document_id").withColumns({c: F.transform(c, lambda x: x.cast("double")) for c in ("q", "v")}).withColumn("score", F.round(score, DIGITS))
    return _top(rows.drop("q", "v"), k, order("score"), F.col("chunk_index")).select("query_id", "document_id", "chunk_index", "rank", "score")


def fuse(lists: list[DataFrame], k: int = RRF_K, payload: tuple[str, ...] = ()) -> DataFrame:
    """Reciprocal rank fusion: the sum of 1 / (k + rank); ties keep the order of first sight, list by list.

    payload: columns to carry along; where lists differ, the later list's values hold.
    """
    rows = None
    for no, ranking in enumerate(lists):
        part = ranking.select("query_id", "document_id", "chunk_index", "rank", *payload, F.lit(no).alias("list_no"))
        rows = part if rows is None else rows.unionByName(part)
    carried = [F.max_by(F.struct(*payload), "list_no").alias("carried")] if payload else []
    fused = rows.groupBy("query_id", "document_id", "chunk_index").agg(F.sum(1 / (k + F.col("rank"))).alias("score"), F.min(F.struct("list_no", "rank")).alias("seen"), *carried)
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "seen", "document_id", "chunk_index")
    return fused.withColumn("rank", F.row_number().over(order).cast("long")).select("query_id", "document_id", "chunk_index", "rank", "score", *(["carried.*"] if payload else []))


def first(ranking: DataFrame, k: int) -> DataFrame:
    return ranking.filter(F.col("rank") <= k)


def overlap_score(query: Column, text: Column) -> Column:
    """A stand-in for a trained scorer: the share of the query's distinct tokens that the text has."""
    q, t = F.array_distinct(bm25_tokens(query)), F.array_distinct(bm25_tokens(text))
    return F.when(F.size(q) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(q, t)) / F.size(q))


def rerank(ranking: DataFrame, queries: DataFrame, chunks: DataFrame, scorer=overlap_score, limit: int = 6, keep_rest: bool = False) -> DataFrame:
    """The first limit rows in order of scorer(query text, chunk text), ties by rank before; keep_rest appends the others as they were.

    The limit comes before the scorer, which may be costly.
    """
    few = ranking.filter(F.col("rank") <= limit)
    texts = few.join(queries.select("query_id", F.col("text").alias("query_text")), "query_id").join(chunks.select("document_id", "chunk_index", "text"), ["document_id", "chunk_index"])
    scored = texts.withColumn("new_score", F.round(scorer(F.col("query_text"), F.col("text")), DIGITS))
    order = Window.partitionBy("query_id").orderBy(F.desc("new_score"), "rank")
    out = scored.withColumn("new_rank", F.row_number().over(order).cast("long")).select("query_id", "document_id", "chunk_index", F.col("new_rank").alias("rank"), F.col("new_score").alias("score"))
    return out.unionByName(ranking.filter(F.col("rank") > limit).select(*out.columns)) if keep_rest else out


def merge_overlapping(a: Column, b: Column, least: int = 20, most: int = 600) -> Column:
    """a and b with b's longest beginning (least to most characters) that ends a said once; else joined by a space."""
    longest = F.least(F.length(a), F.length(b), F.lit(most))
    sizes = F.when(longest >= least, F.sequence(longest, F.lit(least), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    hit = F.get(F.filter(sizes, lambda n: F.endswith(a, F.left(b, n))), F.lit(0))
    return F.when(hit.isNotNull(), F.concat(a, F.substring(b, hit + 1, F.length(b)))).otherwise(F.concat_ws(" ", a, b))


def expand(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, passage_no, document_id, page, section, subsection, text: prose hits widened by their neighbours.

    hits: query_id, rank, document_id, chunk_index. In rank order, a hit already included is skipped; else it takes the chunks one
    before and after it, in its section and not yet included. Other types pass as they are and include nothing. The neighbours come by an
    equi-join on exploded places; the running set of what is included is a fold over a query's few hits.
    """
    c = chunks.select("document_id", "chunk_index", "page", "section", "subsection", "document_type", "text")
    near = hits.select("query_id", "rank", "document_id", F.col("chunk_index").alias("hit"), F.explode(F.array(*(F.col("chunk_index") + d for d in (-1, 0, 1)))).alias("chunk_index"))
    found = near.join(c, ["document_id", "chunk_index"])
    part = F.struct("chunk_index", "page", "section", "subsection", "document_type", "text")
    per_hit = found.groupBy("query_id", "rank", "document_id", "hit").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    own = F.get(F.filter("parts", lambda p: p["chunk_index"] == F.col("hit")), F.lit(0))
    per_hit = per_hit.withColumn("own", own).filter("own is not null")
    same = F.filter("parts", lambda p: F.when(F.col("own.document_type") == "prose", F.coalesce(p["section"], F.lit("")) == F.coalesce(F.col("own.section"), F.lit(""))).otherwise(p["chunk_index"] == F.col("hit")))
    item = F.struct("rank", "document_id", "hit", (F.col("own.document_type") == "prose").alias("prose"), "own", same.alias("parts"))
    lists = per_hit.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("hits"))
    key = lambda h, i: F.concat_ws(":", h["document_id"], i)
    start = F.struct(F.array().cast("array<string>").alias("seen"), F.array().cast(f"array<struct<own:{chunk_type(c)},document_id:{c.schema['document_id'].dataType.simpleString()},parts:array<{chunk_type(c)}>>>").alias("out"))

    def step(acc: Column, h: Column) -> Column:
        parts = F.when(h["prose"], F.filter(h["parts"], lambda p: ~F.array_contains(acc["seen"], key(h, p["chunk_index"])))).otherwise(h["parts"])
        skip = h["prose"] & F.array_contains(acc["seen"], key(h, h["hit"]))
        seen = F.when(h["prose"], F.concat(acc["seen"], F.transform(parts, lambda p: key(h, p["chunk_index"])))).otherwise(acc["seen"])
        one = F.array(F.struct(h["own"].alias("own"), h["document_id"].alias("document_id"), parts.alias("parts")))
        return F.when(skip, acc).otherwise(F.struct(seen.alias("seen"), F.concat(acc["out"], one).alias("out")))

    folded = lists.select("query_id", F.posexplode(F.aggregate("hits", start, step)["out"]).alias("no", "p"))
    texts = F.col("p.parts")
    merged = F.aggregate(F.slice(texts, F.lit(2), F.greatest(F.size(texts) - 1, F.lit(0))), texts[0]["text"], lambda acc, x: merge_overlapping(acc, x["text"]))
    return folded.select("query_id", (F.col("no") + 1).cast("long").alias("passage_no"), "p.document_id", texts[0]["page"].alias("page"), F.col("p.own.section").alias("section"), F.col("p.own.subsection").alias("subsection"), merged.alias("text"))


def chunk_type(chunks: DataFrame) -> str:
    return "struct<" + ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in chunks.schema if f.name != "document_id") + ">"


def format_context(passages: DataFrame) -> DataFrame:
    """query_id, context: numbered passages with page and section, a blank line between."""
    filled = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c))
    page = F.when(F.coalesce(F.col("page"), F.lit(0)) != 0, F.concat(F.lit("page "), F.col("page").cast("string")))
    label = F.concat_ws(" | ", F.concat(F.lit("["), F.col("passage_no").cast("string"), F.lit("]")), page, F.coalesce(filled("section"), filled("subsection")))
    one = F.struct("passage_no", F.concat(label, F.lit("\n"), F.col("text")).alias("t"))
    return passages.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["t"]), "\n\n").alias("context"))


def sources(passages: DataFrame) -> DataFrame:
    """query_id, sources: array<struct<id, page, section, text>> for a client."""
    filled = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c))
    one = F.struct(F.col("passage_no").alias("id"), "page", F.coalesce(filled("section"), filled("subsection"), F.lit("")).alias("section"), "text")
    return passages.groupBy("query_id").agg(F.array_sort(F.collect_list(one)).alias("sources"))
