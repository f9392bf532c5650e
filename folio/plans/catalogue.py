"""The query catalogue over the synthetic tables, each with SQL for a second engine where SQL can express it.

Roles: a document is a language (its rows are the chunks) or a row of documents (its lines are blocks, ten to a page); queries are
benchmark passages; the log is events. Texts that the tables hardly have (bullets, hyphens, boxes) are made from their texts, in both engines alike:
see the modules cases_*, which enter their queries here as well.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import conversation as C
from ..functions import text as T
from ..operators import chunking, evaluation, ranking
from ..providers import hash_embedding
from ..sources import store
from ..streaming import ingest
from . import retrieval
from .cases_chunks import PAGES as _PAGES
from .cases_chunks import pages_of
from .registry import LINES as _LINES
from .registry import ORACLE, QUERIES, literal, query, r6, table  # noqa: F401

# ---- texts -------------------------------------------------------------------------------------------------------

_TOK = r"regexp_extract_all(text, '[^\s]+')"


@query(rf"""WITH t AS (SELECT doc_id, {_TOK} AS tok FROM documents)
SELECT doc_id, CAST(len(tok) AS BIGINT) AS n_words, round(CASE WHEN len(tok) = 0 THEN 1.0 ELSE len(list_filter(tok, lambda x: NOT regexp_matches(x, '[A-Za-z]{{2,}}'))) / CAST(len(tok) AS DOUBLE) END, 6) AS noise FROM t""")
def word_count_noise(spark, d):
    x = table(spark, d, "documents")
    return x.select("doc_id", T.word_count(F.col("text")).alias("n_words"), r6(T.noise_ratio(F.col("text")), "noise"))


@query(f"SELECT doc_id, CAST(len({_LINES}) AS BIGINT) AS n_lines, array_to_string({_LINES}, ' ') AS block FROM documents")
def line_blocks(spark, d):
    lines = T.block_lines(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(lines).cast("long").alias("n_lines"), F.array_join(lines, " ").alias("block"))


@query(rf"""WITH l AS (SELECT doc_id, unnest({_LINES}) AS line FROM documents),
w AS (SELECT doc_id, line, len(regexp_extract_all(line, '[^\s]+')) AS n FROM l)
SELECT doc_id, CAST(count(*) AS BIGINT) AS lines, CAST(sum(CASE WHEN n > 15 OR regexp_matches(line, '[.,;:]$') THEN 0
 WHEN regexp_matches(line, '^\d{{1,3}}(\.\d{{1,3}})*\.?\s+[A-Z]') THEN CASE WHEN regexp_matches(line, '^\d{{1,3}}(\.\d{{1,3}})+\s') OR n <= 8 THEN 1 ELSE 0 END
 WHEN regexp_matches(line, '(?i)^(chapter|appendix|part)\s+[\w.]+') AND n <= 10 THEN 1
 WHEN upper(line) = line AND lower(line) <> line AND regexp_matches(line, '[A-Za-z]{{3,}}') AND n <= 8 THEN 1 ELSE 0 END) AS BIGINT) AS headings FROM w GROUP BY doc_id""")
def heading_prose(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.explode(T.block_lines(F.col("text"))).alias("line"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(T.is_prose_heading(F.col("line"))).alias("headings"))


@query("SELECT doc_id, CAST(len(list_distinct(list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}_]+'), lambda x: lower(x)))) AS BIGINT) AS n_distinct FROM documents")
def document_vocabulary(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(T.vocabulary(F.col("text"))).cast("long").alias("n_distinct"))


@query("SELECT item_id, regexp_replace(lower(text), '[^\\p{L}\\p{N}]', '', 'g') AS normal FROM benchmark")
def evidence_normal(spark, d):
    return table(spark, d, "benchmark").select("item_id", T.evidence_text(F.col("text")).alias("normal"))


# ---- keyword search ----------------------------------------------------------------------------------------------

_BT = "list_transform(regexp_extract_all({}, '[A-Za-z0-9]+'), lambda x: lower(x))"


def _chunks(spark, d):
    return table(spark, d, "documents").select(F.col("lang").alias("document_id"), F.col("doc_id").alias("chunk_index"), "text")


def _queries(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query(f"SELECT doc_id, CAST(len({_BT.format('text')}) AS BIGINT) AS n_tokens, CAST(len(list_distinct({_BT.format('text')})) AS BIGINT) AS n_terms FROM documents")
def bm25_token_counts(spark, d):
    t = T.bm25_tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_terms"))


@query(f"SELECT lang AS document_id, CAST(count(*) AS BIGINT) AS n, round(avg(len({_BT.format('text')})), 6) AS avg_length FROM documents GROUP BY lang")
def bm25_stats(spark, d):
    return ranking.document_stats(_chunks(spark, d)).select("document_id", "n", r6(F.col("avg_length"), "avg_length"))


_BM25 = f"""tok AS (SELECT lang AS document_id, doc_id AS chunk_index, unnest({_BT.format('text')}) AS term FROM documents),
dl AS (SELECT d.lang AS document_id, d.doc_id AS chunk_index, len({_BT.format('d.text')}) AS length FROM documents d),
st AS (SELECT document_id, count(*) AS n, avg(length) AS a FROM dl GROUP BY 1),
tf AS (SELECT document_id, chunk_index, term, count(*) AS tf FROM tok GROUP BY ALL),
df AS (SELECT document_id, term, count(*) AS df FROM tf GROUP BY ALL),
qt AS (SELECT item_id AS query_id, term, count(*) AS times FROM (SELECT item_id, unnest({_BT.format('text')}) AS term FROM benchmark) GROUP BY ALL),
sc AS (SELECT query_id, tf.document_id, tf.chunk_index, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / a))), 6) AS score
  FROM qt JOIN tf USING (term) JOIN df ON df.document_id = tf.document_id AND df.term = tf.term JOIN st ON st.document_id = tf.document_id JOIN dl ON dl.document_id = tf.document_id AND dl.chunk_index = tf.chunk_index GROUP BY ALL),
al AS (SELECT q.query_id, dl.document_id, dl.chunk_index, coalesce(sc.score, 0.0) AS score FROM (SELECT DISTINCT query_id FROM qt) q CROSS JOIN dl LEFT JOIN sc ON sc.query_id = q.query_id AND sc.document_id = dl.document_id AND sc.chunk_index = dl.chunk_index),
bm AS (SELECT query_id, document_id, chunk_index, CAST(rank AS BIGINT) AS rank, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, document_id ORDER BY score DESC, chunk_index) AS rank FROM al) WHERE rank <= 10)"""


@query(f"WITH {_BM25} SELECT * FROM bm")
def bm25_topk(spark, d):
    return ranking.bm25(_queries(spark, d), _chunks(spark, d), 10)


# ---- vectors and fusion ------------------------------------------------------------------------------------------

def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("label").alias("document_id"), F.col("vec_id").alias("chunk_index"), F.col("embedding").alias("vector"))


_FIFTIETH = "SELECT chunk_index AS query_id, document_id, v AS q FROM v WHERE chunk_index % 50 = 0"


def _knn_sql(score: str, order: str) -> str:
    return f"""WITH v AS (SELECT label AS document_id, vec_id AS chunk_index, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
q AS ({_FIFTIETH}),
s AS (SELECT query_id, v.document_id, chunk_index, round({score}, 6) + 0.0 AS score FROM q JOIN v USING (document_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score {order}, chunk_index) AS rank FROM s)
SELECT query_id, document_id, chunk_index, CAST(rank AS BIGINT) AS rank, score FROM r WHERE rank <= 10"""


def _fiftieth(spark, d):
    return _vectors(spark, d).filter("chunk_index % 50 = 0").withColumn("query_id", F.col("chunk_index"))


@query(_knn_sql("list_sum(list_transform(list_zip(q, v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))", "ASC"))
def knn_l2_topk(spark, d):
    return ranking.knn(_fiftieth(spark, d), _vectors(spark, d), 10).withColumn("score", F.col("score") + 0.0)


@query(_knn_sql("list_cosine_similarity(q, v)", "DESC"))
def knn_cosine_topk(spark, d):
    return ranking.knn(_fiftieth(spark, d), _vectors(spark, d), 10, "cosine").withColumn("score", F.col("score") + 0.0)


_OV = f"(CASE WHEN len(list_distinct({_BT.format('q.text')})) = 0 THEN 0.0 ELSE len(list_intersect(list_distinct({_BT.format('q.text')}), list_distinct({_BT.format('c.text')}))) / CAST(len(list_distinct({_BT.format('q.text')})) AS DOUBLE) END)"
def _asked(spark, d):
    """Each query asked of each language: a query of its own, query_id and language joined by a colon."""
    languages = _chunks(spark, d).select("document_id").filter("document_id IS NOT NULL").distinct()
    return _queries(spark, d).crossJoin(F.broadcast(languages)).withColumn("query_id", F.concat_ws(":", "query_id", "document_id"))


_ASKED = "b AS (SELECT item_id || ':' || lang AS query_id, lang AS document_id, item_id, text FROM benchmark CROSS JOIN (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL))"
#: The second ranking of each language: its longest texts, as a stand-in.
_FUSED = f"""{_BM25}, {_ASKED},
l0 AS (SELECT query_id || ':' || document_id AS query_id, document_id, chunk_index, rank FROM bm),
l1 AS (SELECT b.query_id, document_id, chunk_index, rank FROM b JOIN (SELECT lang AS document_id, doc_id AS chunk_index, CAST(row_number() OVER (PARTITION BY lang ORDER BY length(text) DESC, doc_id) AS BIGINT) AS rank FROM documents) USING (document_id) WHERE rank <= 10),
u AS (SELECT query_id, document_id, chunk_index, rank, 0 AS l FROM l0 UNION ALL SELECT query_id, document_id, chunk_index, rank, 1 FROM l1),
f AS (SELECT query_id, document_id, chunk_index, sum(1.0::DOUBLE / (60 + rank)) AS score, min(l * 1000 + rank) AS seen FROM u GROUP BY ALL),
fu AS (SELECT query_id, document_id, chunk_index, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, seen, document_id, chunk_index) AS BIGINT) AS rank, score FROM f)"""


def _fused(spark, d):
    chunks, asked = _chunks(spark, d), _asked(spark, d)
    w = ranking.Window.partitionBy("document_id").orderBy(F.desc("n"), "chunk_index")
    longest = chunks.select("document_id", "chunk_index", F.length("text").alias("n")).withColumn("rank", F.row_number().over(w).cast("long")).filter("rank <= 10")
    by_length = longest.join(asked.select("query_id", "document_id"), "document_id")
    return ranking.fuse([ranking.bm25(asked, chunks, 10), by_length])


@query(f"WITH {_FUSED} SELECT query_id, document_id, chunk_index, rank, round(score, 6) AS score FROM fu WHERE rank <= 6")
def rrf_fusion(spark, d):
    return ranking.first(_fused(spark, d), 6).withColumn("score", F.round("score", 6))


@query(f"""WITH {_FUSED}, s AS (SELECT fu.query_id, fu.document_id, fu.chunk_index, fu.rank AS before, round({_OV}, 6) AS score FROM fu JOIN b q ON q.query_id = fu.query_id JOIN documents c ON c.doc_id = fu.chunk_index WHERE rank <= 6)
SELECT query_id, document_id, chunk_index, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, before) AS BIGINT) AS rank, score FROM s
UNION ALL SELECT query_id, document_id, chunk_index, rank, round(score, 6) FROM fu WHERE rank > 6""")
def rerank_overlap(spark, d):
    out = ranking.rerank(_fused(spark, d), _asked(spark, d), _chunks(spark, d), keep_rest=True)
    return out.withColumn("score", F.round("score", 6))


@query()
def hybrid_pipeline(spark, d):
    """Hash embeddings and BM25 over each language, fused, reranked, three best."""
    return retrieval.hybrid(_asked(spark, d), _chunks(spark, d))


# ---- stores and uploads ------------------------------------------------------------------------------------------

@query("SELECT lang AS document_id, CAST(count(*) AS BIGINT) AS chunks, left(arg_min(text, doc_id), 150) AS preview FROM documents GROUP BY lang")
def doc_diagnostics(spark, d):
    return store.diagnostics(_chunks(spark, d))


# ---- pages and chunks --------------------------------------------------------------------------------------------

@query(f"WITH {_PAGES} SELECT document_id, page, CAST(count(*) AS BIGINT) AS n_blocks, string_agg(block, '|' ORDER BY pos) AS blocks FROM kept GROUP BY ALL")
def strip_furniture(spark, d):
    p = chunking.strip_repeated(pages_of(spark, d)).filter(F.size("blocks") > 0)
    return p.select("document_id", "page", F.size("blocks").cast("long").alias("n_blocks"), F.array_join("blocks", "|").alias("blocks"))


@query(rf"""WITH {_PAGES}, a AS (SELECT document_id, max(page) AS n, sum(len(regexp_extract_all(block, '[^\s]+'))) AS words, string_agg(CASE WHEN page * 10 - 10 + pos < 15 THEN block END, ' ' ORDER BY page, pos) AS top FROM pg GROUP BY 1),
k AS (SELECT *, CASE WHEN document_id % 5 = 0 AND words / CAST(n AS DOUBLE) <= 150 THEN 'slides' ELSE 'prose' END AS t FROM a)
SELECT document_id, t AS document_type, CASE WHEN t = 'slides' THEN '100% landscape pages' ELSE CAST(n AS VARCHAR) || ' page(s)' END || '; ' || CAST(CAST(round_even(words / CAST(n AS DOUBLE), 0) AS BIGINT) AS VARCHAR) || ' words per page' AS reasons FROM k""")
def classify(spark, d):
    return chunking.classify(pages_of(spark, d)).select("document_id", "document_type", F.array_join("reasons", "; ").alias("reasons"))


_SENT = r"list_filter(string_split(regexp_replace(trim(text, ' ' || chr(10)), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '')"


@query(rf"""WITH RECURSIVE s AS (SELECT doc_id, unnest({_SENT}) AS t, generate_subscripts({_SENT}, 1) AS i FROM documents),
w AS (SELECT doc_id, i, len(regexp_extract_all(t, '[^\s]+')) AS w FROM s),
g AS (SELECT doc_id, i, w, w AS total, 0 AS grp FROM w WHERE i = 1
 UNION ALL SELECT w.doc_id, w.i, w.w, CASE WHEN g.total + w.w > 150 THEN w.w ELSE g.total + w.w END, CASE WHEN g.total + w.w > 150 THEN g.grp + 1 ELSE g.grp END FROM g JOIN w ON w.doc_id = g.doc_id AND w.i = g.i + 1)
SELECT doc_id, CAST(grp AS BIGINT) AS grp, CAST(count(*) AS BIGINT) AS sentences, CAST(sum(w) AS BIGINT) AS words FROM g GROUP BY ALL""")
def pack_units(spark, d):
    marked = F.filter(F.split(F.regexp_replace(T.strip(F.col("text")), r"([.!?])\s+", "$1\u0001"), "\u0001"), lambda x: x != "")
    x = table(spark, d, "documents").select("doc_id", F.transform(marked, T.word_count).alias("w"))
    g = x.select("doc_id", "w", F.posexplode(chunking.pack_ranges(F.col("w"), 150)).alias("grp", "g"))
    size = F.col("g.e") - F.col("g.s") + 1
    return g.select("doc_id", F.col("grp").cast("long").alias("grp"), size.cast("long").alias("sentences"), F.aggregate(F.slice("w", F.col("g.s") + 1, size), F.lit(0).cast("long"), lambda a, b: a + b).alias("words"))


# ---- conversations -----------------------------------------------------------------------------------------------

def _last_users(spark, d):
    c = table(spark, d, "conversations")
    return c.filter("role = 'user'").withColumn("has_history", F.col("turn") > 0)


_OPEN = " OR ".join(f"starts_with(q, {literal(o)})" for o in C.OPENERS)


@query(rf"""WITH u AS (SELECT conv_id, turn, turn > 0 AS h, lower(trim(text, ' ' || chr(10))) AS q FROM conversations WHERE role = 'user'),
w AS (SELECT *, regexp_extract_all(q, '[a-z'']+') AS words FROM u)
SELECT conv_id, turn, h AND (len(words) <= 3 OR {_OPEN} OR list_has_any(words, {literal(list(C.REFERRING))})) AS needs FROM w""")
def needs_rewrite(spark, d):
    return _last_users(spark, d).select("conv_id", "turn", C.needs_rewrite(F.col("text"), F.col("has_history")).alias("needs"))


@query("""SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations WHERE role IN ('user', 'assistant')) WHERE back <= 6""")
def history_window(spark, d):
    return C.history_window(table(spark, d, "conversations")).select("conv_id", "turn", "role", "text")


@query("""WITH h AS (SELECT conv_id, string_agg(upper(role) || ': ' || text, chr(10) ORDER BY turn) FILTER (role IN ('user', 'assistant') AND text <> '') AS history FROM conversations GROUP BY conv_id)
SELECT conv_id, coalesce(history, '') AS history, CAST(length(coalesce(history, '')) AS BIGINT) AS n FROM h""")
def rewrite_prompt(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    h = C.history_text(F.transform("m", lambda x: x["role"]), F.transform("m", lambda x: x["text"]))
    return c.select("conv_id", h.alias("history"), F.length(h).cast("long").alias("n"))


@query("SELECT event_id, 'event: ' || event_type || chr(10) || 'data: ' || props || chr(10) || chr(10) AS frame FROM events")
def sse_encode(spark, d):
    return table(spark, d, "events").select("event_id", C.sse_event(F.col("event_type"), F.col("props")).alias("frame"))


# ---- status ------------------------------------------------------------------------------------------------------

@query("""SELECT user_id, arg_max(event_type, event_id) AS status, max(event_id) AS event_id FROM events GROUP BY user_id""")
def job_status_latest(spark, d):
    e = table(spark, d, "events").select("user_id", F.col("event_type").alias("status"), "event_id")
    return ingest.latest(e.withColumn("seq", F.col("event_id")), "user_id").select("user_id", "status", "event_id")


# ---- evaluation --------------------------------------------------------------------------------------------------

_GOLD = r"gold AS (SELECT DISTINCT b.item_id AS query_id, d.lang AS document_id, d.doc_id AS chunk_index FROM benchmark b JOIN documents d ON contains(regexp_replace(lower(d.text), '[^\p{L}\p{N}]', '', 'g'), regexp_replace(lower(b.text), '[^\p{L}\p{N}]', '', 'g')))"


def _gold(spark, d):
    return evaluation.relevant_chunks(_queries(spark, d).withColumnRenamed("text", "phrase"), _chunks(spark, d))


@query(f"WITH {_GOLD} SELECT * FROM gold")
def relevant_chunks(spark, d):
    return _gold(spark, d)


_JUDGED = f"""{_BM25}, {_GOLD}, {_ASKED},
r AS (SELECT bm.query_id || ':' || bm.document_id AS query_id, bm.chunk_index, bm.rank, gold.query_id IS NOT NULL AS rel FROM bm LEFT JOIN gold ON gold.query_id = bm.query_id AND gold.document_id = bm.document_id AND gold.chunk_index = bm.chunk_index)"""


def _gold_of_asked(spark, d):
    return _gold(spark, d).withColumn("query_id", F.concat_ws(":", "query_id", "document_id"))


@query(rf"""WITH {_JUDGED},
g AS (SELECT query_id || ':' || document_id AS query_id, count(*) AS gold FROM gold GROUP BY 1),
a AS (SELECT b.query_id, coalesce(any_value(gold), 0) AS gold, count(*) FILTER (rel AND rank <= 3) AS h3, count(*) FILTER (rel AND rank <= 10) AS h10, count(*) FILTER (rank <= 3) AS n3, min(rank) FILTER (rel) AS fst,
 coalesce(sum(1 / log2(rank + 1)) FILTER (rel AND rank <= 3), 0) AS g3, coalesce(sum(1 / log2(rank + 1)) FILTER (rel AND rank <= 10), 0) AS g10 FROM b LEFT JOIN r ON r.query_id = b.query_id LEFT JOIN g ON g.query_id = b.query_id GROUP BY b.query_id)
SELECT query_id, round(CASE WHEN gold > 0 THEN h3 / CAST(gold AS DOUBLE) ELSE 0 END, 6) AS recall_3, round(CASE WHEN gold > 0 THEN h10 / CAST(gold AS DOUBLE) ELSE 0 END, 6) AS recall_10, round(CASE WHEN n3 > 0 THEN h3 / CAST(n3 AS DOUBLE) ELSE 0 END, 6) AS precision_3, round(coalesce(1.0::DOUBLE / fst, 0), 6) AS mrr,
 round(CASE WHEN gold > 0 THEN g3 / list_sum(list_transform(range(1, least(3, gold) + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END, 6) AS ndcg_3, round(CASE WHEN gold > 0 THEN g10 / list_sum(list_transform(range(1, least(10, gold) + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END, 6) AS ndcg_10 FROM a""")
def recall_precision_ndcg(spark, d):
    asked = _asked(spark, d)
    return evaluation.ranking_metrics(ranking.bm25(asked, _chunks(spark, d), 10), _gold_of_asked(spark, d), asked)


@query(f"""WITH {_JUDGED},
a AS (SELECT b.query_id, min(rank) FILTER (rel) AS fst, coalesce(bool_or(rank <= 3 AND r.chunk_index % 7 = item_id % 7), FALSE) AS p FROM b LEFT JOIN r ON r.query_id = b.query_id GROUP BY 1)
SELECT query_id, CAST(coalesce(fst <= 1, FALSE) AS BIGINT) AS hit_1, CAST(coalesce(fst <= 3, FALSE) AS BIGINT) AS hit_3, CAST(coalesce(fst <= 10, FALSE) AS BIGINT) AS hit_10, round(coalesce(1.0::DOUBLE / fst, 0), 6) AS mrr, CAST(p AS BIGINT) AS page_hit_3 FROM a""")
def hit_mrr_pagehit(spark, d):
    asked = _asked(spark, d)
    j = evaluation.judged(ranking.bm25(asked, _chunks(spark, d), 10), _gold_of_asked(spark, d)).withColumn("page", F.col("chunk_index") % 7)
    item = F.split_part("query_id", F.lit(":"), F.lit(1)).cast("long")
    return evaluation.hit_metrics(j, asked.withColumn("pages", F.array(item % 7)))


from . import cases_answers, cases_layout, cases_retrieval, cases_status  # noqa: E402, F401
