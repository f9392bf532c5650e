"""Chunks over documents as pages: running headers, headings, sentences, packing; résumés are made from texts' lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import conversation as C
from ..functions import text as T
from ..operators import chunking, evaluation
from ..streaming import ingest
from .cases_text import PHRASES, bullet_sql, heading_sql, resume_heading_sql, section_sql, sentences_sql
from .registry import LINES, literal, query, stripped, table, words


def pages_of(spark, d):
    """Lines as blocks, ten to a page; documents whose id divides by 5 are landscape (synthetic)."""
    b = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.posexplode(T.block_lines(F.col("text"))).alias("pos", "block")).withColumn("page", (F.floor(F.col("pos") / 10) + 1).cast("int"))
    p = b.groupBy("document_id", "page").agg(chunking.ordered(F.col("block"), "pos").alias("blocks"))
    return p.select("document_id", "page", (F.col("document_id") % 5 == 0).alias("landscape"), "blocks", F.lit(None).cast("array<array<string>>").alias("lines"))


def resume_pages(spark, d):
    """Lines with an address in the first, headings, bullets and wrapped lines among them; four to a block, ten blocks to a page."""
    i, line = F.col("i"), F.col("line")
    heading = F.upper(F.get(F.array(*map(F.lit, PHRASES)), ((F.col("doc_id") + i) % 27).cast("int")))
    shaped = (F.when(i == 0, F.concat(F.lit("Ann a@b.co "), line)).when(i % 7 == 1, heading).when((i % 7 == 3) | (i % 7 == 5), F.concat(F.lit("- "), line, F.lit(" • more")))
              .when(i % 7 == 4, F.concat(F.lit("and "), line)).otherwise(line))
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(T.block_lines(F.col("text"))).alias("i", "line")).withColumn("line", shaped)
    blocks = lines.groupBy("doc_id", F.floor(i / 4).alias("b")).agg(chunking.ordered(F.col("line"), "i").alias("lines"))
    p = blocks.groupBy(F.col("doc_id").alias("document_id"), (F.floor(F.col("b") / 10) + 1).cast("int").alias("page")).agg(chunking.ordered(F.col("lines"), "b").alias("lines"))
    return p.select("document_id", "page", F.lit(False).alias("landscape"), F.transform("lines", lambda x: F.array_join(x, " ")).alias("blocks"), "lines")


PAGES = f"""b AS (SELECT doc_id AS document_id, unnest({LINES}) AS block, generate_subscripts({LINES}, 1) - 1 AS nr FROM documents),
pg AS (SELECT document_id, CAST((nr - nr % 10) / 10 + 1 AS INT) AS page, nr % 10 AS pos, block, count(*) OVER (PARTITION BY document_id, nr - nr % 10) AS n FROM b),
nd AS (SELECT document_id, max(page) AS pages FROM pg GROUP BY 1),
ed AS (SELECT *, (pos < 2 OR pos >= n - 2) AS edge, regexp_replace(lower(block), '\\d+', '#', 'g') AS sig FROM pg),
cm AS (SELECT document_id, sig, count(DISTINCT page) AS c FROM ed WHERE edge GROUP BY ALL),
kept AS (SELECT ed.document_id, ed.page, ed.pos, ed.block FROM ed JOIN nd USING (document_id) LEFT JOIN cm ON cm.document_id = ed.document_id AND cm.sig = ed.sig
 WHERE NOT (pages >= 3 AND edge AND (coalesce(c, 0) >= greatest(3, floor(pages / 4)) OR regexp_matches(block, '^\\d{{1,4}}$'))))"""


def packing_sql(name: str, items: str, most: int, overlap: bool) -> str:
    """CTEs that number greedy groups: name(document_id, part_of, i, w, prev, total, grp) from items(document_id, part_of, i from 1, w)."""
    again = "r.w + x.w" if overlap else "x.w"
    return f"""{name} AS (SELECT document_id, part_of, i, w, w AS total, 0 AS grp FROM {items} WHERE i = 1
 UNION ALL SELECT x.document_id, x.part_of, x.i, x.w, CASE WHEN r.total + x.w > {most} THEN {again} ELSE r.total + x.w END, CASE WHEN r.total + x.w > {most} THEN r.grp + 1 ELSE r.grp END
 FROM {name} r JOIN {items} x ON x.document_id = r.document_id AND x.part_of = r.part_of AND x.i = r.i + 1)"""


def _wc(x: str) -> str:
    return f"len({words(x)})"


_KEEPS = rf"(starts_with(block, 'Figure') OR starts_with(block, 'Table') OR contains(block, '=') OR len(list_filter({words('block')}, lambda x: NOT regexp_matches(x, '[A-Za-z]{{2,}}'))) <= 0.5 * {_wc('block')})"
PROSE = f"""hd AS (SELECT *, {heading_sql('block')} AS h FROM kept WHERE block <> ''),
sc AS (SELECT *, sum(CAST(h AS INT)) OVER w AS part_of, coalesce(last_value(CASE WHEN h THEN block END IGNORE NULLS) OVER w, '') AS section FROM hd WINDOW w AS (PARTITION BY document_id ORDER BY page, pos ROWS UNBOUNDED PRECEDING)),
kp AS (SELECT * FROM (SELECT *, {sentences_sql('block')} AS ss FROM sc WHERE NOT h AND {_KEEPS}) WHERE len(ss) > 0),
jn AS (SELECT *, coalesce(regexp_matches(ss[1], '^\\p{{Ll}}') AND NOT regexp_matches(lag(ss[len(ss)]) OVER (PARTITION BY document_id, part_of ORDER BY page, pos), '[.!?]$'), FALSE) AS j FROM kp),
sp AS (SELECT document_id, part_of, section, page, pos, j, unnest(ss) AS t, generate_subscripts(ss, 1) AS ix FROM jn),
sn AS (SELECT *, sum(CASE WHEN j AND ix = 1 THEN 0 ELSE 1 END) OVER (PARTITION BY document_id, part_of ORDER BY page, pos, ix) AS i FROM sp),
st AS (SELECT document_id, part_of, section, i, min(page) AS page, string_agg(t, ' ' ORDER BY page, pos, ix) AS t FROM sn GROUP BY ALL),
si AS (SELECT document_id, part_of, i, {_wc('t')} AS w FROM st),
{packing_sql('pr', 'si', 150, True)},
pu AS (SELECT pr.document_id, pr.part_of, section, pr.i, grp, page, t, max(pr.i) OVER (PARTITION BY pr.document_id, pr.part_of, grp) AS last FROM pr JOIN st USING (document_id, part_of, i)),
pc AS (SELECT document_id, part_of, section, grp, min(page) AS page, string_agg(t, ' ' ORDER BY i) AS t, any_value(last) AS last FROM pu GROUP BY ALL),
pd AS (SELECT pc.document_id, part_of, pc.section, pc.grp, pc.page, CASE WHEN o.t IS NULL THEN pc.t ELSE o.t || ' ' || pc.t END AS t FROM pc LEFT JOIN pu o USING (document_id, part_of) WHERE o.i IS NULL OR (o.grp = pc.grp - 1 AND o.i = o.last)
 UNION ALL SELECT document_id, part_of, section, grp, page, t FROM pc WHERE grp = 0),
prose AS (SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY part_of, grp) - 1 AS chunk_index, page, section, '' AS subsection, 'prose' AS document_type, {stripped('t')} AS text FROM pd)"""


@query(f"WITH RECURSIVE {PAGES}, {PROSE} SELECT * FROM prose")
def prose_chunks(spark, d):
    return chunking.prose_chunks(pages_of(spark, d))


@query()
def prose_chunks_repacked(spark, d):
    return chunking.prose_chunks_repacked(pages_of(spark, d))


SLIDES = f"""s1 AS (SELECT document_id, page, list({stripped('block')} ORDER BY pos) AS bs FROM kept WHERE {stripped('block')} <> '' GROUP BY ALL),
s2 AS (SELECT document_id, page, bs, CASE WHEN {_wc('bs[1]')} <= 12 THEN bs[1] ELSE '' END AS title, array_to_string(bs, ' ') AS t FROM s1),
s3 AS (SELECT *, {_wc('t')} >= 8 AS content, sum(CAST({_wc('t')} >= 8 AS INT)) OVER (PARTITION BY document_id ORDER BY page) - CAST({_wc('t')} >= 8 AS INT) AS island FROM s2),
s4 AS (SELECT *, coalesce(string_agg(t, ' ') OVER (PARTITION BY document_id, island ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS carried FROM s3),
s5 AS (SELECT document_id, page, title, concat_ws(' > ', nullif(carried, ''), nullif(title, '')) AS heading, {sentences_sql("array_to_string(CASE WHEN title <> '' THEN bs[2:] ELSE bs END, ' ')")} AS us FROM s4 WHERE content),
s6 AS (SELECT document_id, page, title, heading, CASE WHEN len(us) = 0 THEN [title] ELSE us END AS us FROM s5),
s7 AS (SELECT document_id, page AS part_of, title, heading, unnest(us) AS t, generate_subscripts(us, 1) AS i FROM s6),
s8 AS (SELECT document_id, part_of, i, {_wc('t')} AS w FROM s7),
{packing_sql('sr', 's8', 150, False)},
s9 AS (SELECT document_id, part_of, title, heading, grp, string_agg(t, ' ' ORDER BY i) AS t FROM sr JOIN s7 USING (document_id, part_of, i) GROUP BY ALL),
slides AS (SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY part_of, grp) - 1 AS chunk_index, part_of AS page, '' AS section, title AS subsection, 'slides' AS document_type, {stripped("CASE WHEN heading <> '' THEN heading || chr(10) || t ELSE t END")} AS text FROM s9)"""


@query(f"WITH RECURSIVE {PAGES}, {SLIDES} SELECT * FROM slides")
def slide_chunks(spark, d):
    return chunking.chunk(pages_of(spark, d), chunking.SLIDES)


_CLASS = f"""ca AS (SELECT document_id, max(page) AS n, sum({_wc('block')}) AS words FROM pg GROUP BY 1),
ck AS (SELECT document_id, CASE WHEN document_id % 5 = 0 AND words / CAST(n AS DOUBLE) <= 150 THEN 'slides' ELSE 'prose' END AS kind FROM ca)"""


@query(f"WITH RECURSIVE {PAGES}, {PROSE}, {SLIDES}, {_CLASS} SELECT x.* FROM (SELECT * FROM prose UNION ALL SELECT * FROM slides) x JOIN ck ON ck.document_id = x.document_id AND ck.kind = x.document_type")
def chunk_dispatch(spark, d):
    return chunking.chunk(pages_of(spark, d))


@query(f"""WITH {PAGES}, {_CLASS}, s AS (SELECT * FROM (VALUES {', '.join(f"({literal(k)}, {i}, {literal(t)})" for k, ts in C.SUGGESTIONS.items() for i, t in enumerate(ts))}) v(kind, suggestion_no, suggestion))
SELECT document_id, suggestion_no, suggestion FROM ck JOIN s USING (kind)""")
def suggestions(spark, d):
    return C.suggestions(chunking.classify(pages_of(spark, d)))


_RESUME_PAGES = f"""rl AS (SELECT doc_id AS document_id, unnest({LINES}) AS line, generate_subscripts({LINES}, 1) - 1 AS i FROM documents),
rs AS (SELECT document_id, CAST(i // 40 + 1 AS INT) AS page, i // 4 % 10 AS pos, i % 4 AS line_pos, i, CASE WHEN i = 0 THEN 'Ann a@b.co ' || line WHEN i % 7 = 1 THEN upper({literal(PHRASES)}[(document_id + i) % 27 + 1])
 WHEN i % 7 IN (3, 5) THEN '- ' || line || ' • more' WHEN i % 7 = 4 THEN 'and ' || line ELSE line END AS line FROM rl)"""
_STARTS_LOWER, _ENDS = r"regexp_matches({}, '^\p{{Ll}}')", r"regexp_matches({}, '[.!?]\s*$')"
_RESUMES = f"""r1 AS (SELECT *, CASE WHEN {resume_heading_sql('line')} THEN 'heading' WHEN {bullet_sql('line')} THEN 'bullet' ELSE 'text' END AS kind FROM rs),
r2 AS (SELECT *, lag(line) OVER w AS before, sum(CAST(kind <> 'text' AS INT)) OVER w AS run FROM r1 WINDOW w AS (PARTITION BY document_id, page, pos ORDER BY line_pos)),
r3 AS (SELECT *, first_value(kind) OVER w AS head, row_number() OVER w AS place, CASE WHEN {_STARTS_LOWER.format('line')} OR NOT {_ENDS.format("coalesce(before, '')")} THEN 0 ELSE 1 END AS new FROM r2 WINDOW w AS (PARTITION BY document_id, page, pos, run ORDER BY line_pos)),
r4 AS (SELECT *, sum(CASE WHEN kind = 'text' THEN new ELSE 0 END) OVER (PARTITION BY document_id, page, pos, run ORDER BY line_pos) AS breaks FROM r3),
r5 AS (SELECT *, CASE WHEN kind <> 'text' THEN TRUE WHEN head = 'bullet' THEN new = 1 AND breaks = 1 WHEN head = 'heading' THEN place = 2 ELSE place = 1 END AS starts FROM r4),
r6 AS (SELECT *, sum(CAST(starts AS INT)) OVER (PARTITION BY document_id, page, pos ORDER BY line_pos) AS unit FROM r5),
u1 AS (SELECT document_id, page, pos, unit, min(line_pos) AS line_pos, arg_min(kind, line_pos) AS kind, string_agg(line, ' ' ORDER BY line_pos) AS text FROM r6 GROUP BY document_id, page, pos, unit),
u2 AS (SELECT *, lag(kind) OVER w AS before, coalesce(last_value(CASE WHEN kind = 'heading' THEN text END IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY page, pos, line_pos ROWS UNBOUNDED PRECEDING), '') AS section FROM u1 WINDOW w AS (PARTITION BY document_id ORDER BY page, pos, line_pos)),
u3 AS (SELECT *, CASE kind WHEN 'bullet' THEN coalesce(before = 'heading', TRUE) WHEN 'text' THEN coalesce(before = 'heading', TRUE) OR before = 'bullet' ELSE FALSE END AS starts FROM u2),
u4 AS (SELECT * FROM (SELECT *, sum(CAST(starts AS INT)) OVER (PARTITION BY document_id ORDER BY page, pos, line_pos) AS entry FROM u3) WHERE kind <> 'heading'),
u5 AS (SELECT *, CASE WHEN kind = 'bullet' THEN list_filter(string_split(regexp_replace(text, '\\s*([{T.SPLIT_BULLETS}])', chr(1) || '\\1', 'g'), chr(1)), lambda x: {stripped('x')} <> '') WHEN starts THEN [] ELSE [text] END AS us FROM u4),
e1 AS (SELECT document_id, entry, min(page) AS page, arg_min(section, page * 1000000 + pos * 1000 + line_pos) AS section, coalesce(max(CASE WHEN kind = 'text' AND starts THEN text END), '') AS title, flatten(list(us ORDER BY page, pos, line_pos)) AS us FROM u5 GROUP BY document_id, entry),
e2 AS (SELECT document_id, entry AS part_of, page, section, title, concat_ws(' > ', nullif(section, ''), nullif(title, '')) AS heading, unnest(CASE WHEN len(us) = 0 THEN [''] ELSE us END) AS t, unnest(range(1, greatest(len(us), 1) + 1)) AS i FROM e1),
e3 AS (SELECT document_id, part_of, i, {_wc('t')} AS w FROM e2),
{packing_sql('er', 'e3', 120, False)},
e4 AS (SELECT document_id, part_of, page, section, title, heading, grp, {stripped("string_agg(t, ' ' ORDER BY i)")} AS t FROM er JOIN e2 USING (document_id, part_of, i) GROUP BY document_id, part_of, page, section, title, heading, grp),
e5 AS (SELECT *, {stripped("CASE WHEN heading <> '' THEN heading || chr(10) || t ELSE t END")} AS text FROM e4),
resumes AS (SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY part_of, grp) - 1 AS chunk_index, page, section, left(title, 120) AS subsection, 'resume' AS document_type, text FROM e5 WHERE text <> '')"""


@query(f"WITH RECURSIVE {_RESUME_PAGES}, {_RESUMES} SELECT * FROM resumes")
def resume_chunks(spark, d):
    return chunking.resume_chunks(resume_pages(spark, d))


@query(rf"""WITH {_RESUME_PAGES}, n AS (SELECT document_id, max(page) AS n, CAST(sum({_wc('line')}) AS BIGINT) AS words FROM rs GROUP BY 1),
s AS (SELECT document_id, list_sort(list(DISTINCT trim(regexp_replace(regexp_replace(lower(line), '[^a-z ]', ' ', 'g'), ' +', ' ', 'g')))) AS s FROM rs WHERE {section_sql('line')} GROUP BY 1)
SELECT document_id, CASE WHEN n <= 3 AND coalesce(len(s), 0) >= 2 THEN 'resume' ELSE 'prose' END AS document_type, CASE WHEN n <= 3 AND coalesce(len(s), 0) >= 2 THEN n || ' page(s); contact details near the top; resume sections: ' || array_to_string(s, ', ')
 ELSE n || ' page(s); ' || CAST(round_even(words / CAST(n AS DOUBLE), 0) AS BIGINT) || ' words per page' END AS reasons FROM n LEFT JOIN s USING (document_id)""")
def classify_resumes(spark, d):
    return chunking.classify(resume_pages(spark, d)).select("document_id", "document_type", F.array_join("reasons", "; ").alias("reasons"))


_DIAGNOSED = f"""dg AS (SELECT *, {_wc('text')} AS w, CASE WHEN {_wc('text')} = 0 THEN 1.0 ELSE len(list_filter({words('text')}, lambda x: NOT regexp_matches(x, '[A-Za-z]{{2,}}'))) / CAST({_wc('text')} AS DOUBLE) END AS noise FROM prose),
dc AS (SELECT document_id, count(*) AS chunks, min(w) AS min_words, median(w) AS median_words, max(w) AS max_words, count(*) FILTER (w < 15) AS fragments, count(*) FILTER (noise > 0.4) AS noisy,
 count(*) FILTER (regexp_matches(text, '^\\p{{Ll}}')) AS starts_lower, count(DISTINCT CASE WHEN section <> '' THEN section END) AS sections, count(DISTINCT CASE WHEN section <> '' AND length(section) <= 3 THEN section END) AS suspicious FROM dg GROUP BY 1),
dn AS (SELECT document_id, count(DISTINCT page) AS pages, count(*) AS blocks FROM pg GROUP BY 1),
db AS (SELECT document_id, block, count(DISTINCT page) AS c FROM pg WHERE length(block) > 10 GROUP BY ALL),
dr AS (SELECT document_id, count(*) AS repeated_blocks FROM db JOIN dn USING (document_id) WHERE c >= greatest(3, floor(pages / 4)) GROUP BY 1)"""


@query(f"""WITH RECURSIVE {PAGES}, {PROSE}, {_DIAGNOSED}
SELECT document_id, dn.pages, blocks, coalesce(chunks, 0) AS chunks, min_words, median_words, max_words, fragments, noisy, starts_lower, sections, suspicious, coalesce(repeated_blocks, 0) AS repeated_blocks FROM dn LEFT JOIN dc USING (document_id) LEFT JOIN dr USING (document_id)""")
def ingestion_diagnostics(spark, d):
    p = pages_of(spark, d)
    return evaluation.ingestion_diagnostics(p, chunking.prose_chunks(p))


@query(f"""WITH RECURSIVE {PAGES}, {PROSE}, c AS (SELECT document_id, count(*) AS chunks FROM prose GROUP BY 1),
p AS (SELECT DISTINCT document_id, page, (document_id + page) % 3 = 0 AS ocr, CASE WHEN (document_id + page) % 3 = 0 THEN 0.8 + 0.02 * (page % 10) END AS conf FROM pg),
a AS (SELECT document_id, max(page) AS pages, count(*) FILTER (ocr) AS ocr_pages, avg(conf) AS m FROM p GROUP BY 1)
SELECT document_id, pages, coalesce(chunks, 0) AS chunks, ocr_pages, CASE WHEN round(m, 9) < 0.9 THEN 'low' WHEN m IS NOT NULL THEN 'good' END AS ocr_quality FROM a LEFT JOIN c USING (document_id)""")
def ready_summary(spark, d):
    p = pages_of(spark, d)
    ocr = (F.col("document_id") + F.col("page")) % 3 == 0
    seen = p.withColumns({"ocr": ocr, "ocr_confidence": F.when(ocr, 0.8 + 0.02 * (F.col("page") % 10))})
    return ingest.ready_summary(seen, chunking.prose_chunks(p))
