"""Text predicates and normalizations over documents: headings, bullets, hyphens and ligatures are made from their words."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from .registry import LINES, literal, query, stripped, table, words

PHRASES = list(T.RESUME_SECTIONS)


def _at(items: list[str], n) -> F.Column:
    return F.get(F.array(*map(F.lit, items)), n.cast("int"))


def _firsts(spark, d):
    """doc_id, w: the words of the text, ASCII letters only."""
    ascii_ = F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z\\s]", "")
    return table(spark, d, "documents").select("doc_id", T.tokens(ascii_).alias("w"))


_ASCII = r"regexp_replace(coalesce(text, ''), '[^A-Za-z\s]', '', 'g')"
_FIRSTS = f"f AS (SELECT doc_id, {words(_ASCII)} AS w FROM documents)"


def heading_sql(x: str) -> str:
    """is_prose_heading of a stripped expression."""
    n = f"len({words(x)})"
    return rf"""(CASE WHEN {x} = '' OR {n} > 15 OR regexp_matches({x}, '[.,;:]$') THEN FALSE
 WHEN regexp_matches({x}, '^\d{{1,3}}(\.\d{{1,3}})*\.?\s+[A-Z]') THEN regexp_matches({x}, '^\d{{1,3}}(\.\d{{1,3}})+\s') OR {n} <= 8
 WHEN regexp_matches({x}, '(?i)^(chapter|appendix|part)\s+[\w.]+') AND {n} <= 10 THEN TRUE
 ELSE upper({x}) = {x} AND lower({x}) <> {x} AND regexp_matches({x}, '[A-Za-z]{{3,}}') AND {n} <= 8 END)"""


@query(f"""WITH {_FIRSTS}, t AS (SELECT doc_id, array_to_string(w[1:6], ' ') AS t, array_to_string(w[1:20], ' ') AS l FROM f),
c AS (SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN upper(t) WHEN 1 THEN '3.2 X' || t WHEN 2 THEN '4 X' || t WHEN 3 THEN 'Chapter 7 ' || t WHEN 4 THEN t WHEN 5 THEN upper(t) || '.'
 WHEN 6 THEN '12. X' || t || ' and more words than eight' WHEN 7 THEN upper(l) ELSE 'A B ' || left(upper(t), 2) END AS line FROM t)
SELECT doc_id, line, {heading_sql(stripped('line'))} AS heading FROM c""")
def heading_prose_kinds(spark, d):
    t, long_ = F.array_join(F.slice("w", 1, 6), " "), F.array_join(F.slice("w", 1, 20), " ")
    kind = F.col("doc_id") % 9
    line = (F.when(kind == 0, F.upper(t)).when(kind == 1, F.concat(F.lit("3.2 X"), t)).when(kind == 2, F.concat(F.lit("4 X"), t)).when(kind == 3, F.concat(F.lit("Chapter 7 "), t))
            .when(kind == 4, t).when(kind == 5, F.concat(F.upper(t), F.lit("."))).when(kind == 6, F.concat(F.lit("12. X"), t, F.lit(" and more words than eight"))).when(kind == 7, F.upper(long_))
            .otherwise(F.concat(F.lit("A B "), F.left(F.upper(t), F.lit(2)))))
    return _firsts(spark, d).select("doc_id", line.alias("line")).withColumn("heading", T.is_prose_heading(F.col("line")))


def section_sql(x: str) -> str:
    parts = rf"list_filter(list_transform(regexp_split_to_array(lower({x}), '\s*(?:&|/|,|\band\b)\s*'), lambda p: trim(regexp_replace(regexp_replace(p, '[^a-z ]', ' ', 'g'), ' +', ' ', 'g'))), lambda p: p <> '')"
    return f"(length({x}) <= 40 AND len({parts}) > 0 AND len(list_filter({parts}, lambda p: NOT list_contains({literal(PHRASES)}, p))) = 0)"


def bullet_sql(x: str) -> str:
    return rf"regexp_matches({x}, '^\s*[-*{T.BULLETS}]')"


def resume_heading_sql(x: str) -> str:
    s = stripped(x)
    return f"({section_sql(s)} OR (length({s}) <= 40 AND length(regexp_replace({s}, '[^A-Za-z]', '', 'g')) >= 4 AND upper({s}) = {s} AND lower({s}) <> {s} AND NOT {bullet_sql(s)}))"


@query(f"""WITH {_FIRSTS}, p AS (SELECT doc_id, {literal(PHRASES)}[doc_id % 27 + 1] AS a, {literal(PHRASES)}[doc_id // 27 % 27 + 1] AS b, coalesce(w[1], '') AS x, array_to_string(w[1:2], ' ') AS y FROM f),
c AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN a WHEN 1 THEN upper(a || ' & ' || b) WHEN 2 THEN a || ' and ' || b WHEN 3 THEN a || ' / ' || x WHEN 4 THEN upper(y) ELSE '- ' || a END AS line FROM p)
SELECT doc_id, line, {section_sql('line')} AS section, {resume_heading_sql('line')} AS heading, trim(regexp_replace(regexp_replace(lower(line), '[^a-z ]', ' ', 'g'), ' +', ' ', 'g')) AS normal FROM c""")
def heading_resume(spark, d):
    a, b = _at(PHRASES, F.col("doc_id") % 27), _at(PHRASES, F.floor(F.col("doc_id") / 27) % 27)
    x, y, kind = F.coalesce(F.get("w", F.lit(0)), F.lit("")), F.array_join(F.slice("w", 1, 2), " "), F.col("doc_id") % 6
    line = F.when(kind == 0, a).when(kind == 1, F.upper(F.concat_ws(" & ", a, b))).when(kind == 2, F.concat_ws(" and ", a, b)).when(kind == 3, F.concat_ws(" / ", a, x)).when(kind == 4, F.upper(y)).otherwise(F.concat(F.lit("- "), a))
    c = _firsts(spark, d).select("doc_id", line.alias("line"))
    return c.select("doc_id", "line", T.is_resume_section(F.col("line")).alias("section"), T.is_resume_heading(F.col("line")).alias("heading"), T.normalize_heading(F.col("line")).alias("normal"))


@query(r"SELECT doc_id, regexp_replace(replace(text, ',', ' . . . . .'), '(?:[ \t]*\.){4,}[ \t]*', ' … ', 'g') AS cleaned FROM documents")
def dot_leaders(spark, d):
    return table(spark, d, "documents").select("doc_id", T.dot_leaders(F.replace("text", F.lit(","), F.lit(" . . . . ."))).alias("cleaned"))


@query(rf"""WITH m AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '- ' ELSE '' END || replace(text, '. ', ' ' || {literal(list(T.SPLIT_BULLETS))}[doc_id % 4 + 1] || ' ') AS t FROM documents)
SELECT doc_id, {bullet_sql('t')} AS bullet, array_to_string(list_transform(list_filter(string_split(regexp_replace(t, '\s*([{T.SPLIT_BULLETS}])', chr(1) || '\1', 'g'), chr(1)), lambda x: {stripped('x')} <> ''), lambda x: {stripped('x')}), '|') AS parts FROM m""")
def bullet_split(spark, d):
    mark = F.concat(F.lit(" "), _at(list(T.SPLIT_BULLETS), F.col("doc_id") % 4), F.lit(" "))
    m = table(spark, d, "documents").select("doc_id", F.concat(F.when(F.col("doc_id") % 3 == 0, "- ").otherwise(""), F.replace("text", F.lit(". "), mark)).alias("t"))
    return m.select("doc_id", T.is_bullet(F.col("t")).alias("bullet"), F.array_join(F.transform(T.split_bullets(F.col("t")), T.strip), "|").alias("parts"))


@query(r"""WITH s AS (SELECT doc_id, string_split(text, ' ') AS w, list_transform(regexp_extract_all(text, '[\p{L}\p{N}_]+'), lambda x: lower(x)) AS v FROM documents)
SELECT doc_id, array_to_string(list_transform(w, lambda x: CASE WHEN regexp_matches(x, '^[a-z]{8,}$') AND NOT (length(x) % 2 = 0 AND list_contains(v, x)) THEN left(x, 4) || '-' || substr(x, 5) ELSE x END), ' ') AS joined FROM s""")
def dehyphenate(spark, d):
    """Words of eight letters or more are broken at a line's end; only those of even length are in the vocabulary given."""
    broken = F.transform(F.split("text", " "), lambda x: F.when(x.rlike("^[a-z]{8,}$"), F.concat(F.left(x, F.lit(4)), F.lit("-\n"), F.substring(x, 5, 1 << 30))).otherwise(x))
    known = F.filter(T.vocabulary(F.col("text")), lambda x: F.length(x) % 2 == 0)
    s = table(spark, d, "documents").select("doc_id", F.array_join(broken, " ").alias("t"), known.alias("v"))
    return s.select("doc_id", T.join_hyphenated(F.col("t"), F.col("v")).alias("joined"))


@query("SELECT doc_id, text AS normal FROM documents")
def nfkc(spark, d):
    """fi as a ligature, 1 in a circle, A in full width: normalized, the texts are as they were."""
    t = F.translate(F.replace("text", F.lit("fi"), F.lit("ﬁ")), "1A", "①Ａ")
    return table(spark, d, "documents").select("doc_id", T.nfkc(t).alias("normal"))


@query(rf"""WITH l AS (SELECT doc_id, unnest({LINES}) AS line FROM documents), n AS (SELECT doc_id, {words('line')} AS t FROM l)
SELECT doc_id, CAST(count(*) AS BIGINT) AS lines, CAST(count(*) FILTER (len(list_filter(t, lambda x: NOT regexp_matches(x, '[A-Za-z]{{2,}}'))) > 0.5 * len(t)) AS BIGINT) AS noisy FROM n GROUP BY doc_id""")
def noisy_lines(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.explode(T.block_lines(F.col("text"))).alias("line"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(T.is_noisy(F.col("line"))).alias("noisy"))


def sentences_sql(x: str) -> str:
    """sentences() of an expression."""
    cut = f"lambda s: list_transform(range(0, greatest(len({words('s')}) + 199, 200) // 200), lambda k: array_to_string(({words('s')})[k * 200 + 1:k * 200 + 200], ' '))"
    return rf"list_filter(flatten(list_transform(string_split(regexp_replace({stripped(x)}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), {cut})), lambda s: s <> '')"


@query(rf"""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN replace(text, '.', '') ELSE text END AS t FROM documents), s AS (SELECT doc_id, {sentences_sql('t')} AS s FROM t)
SELECT doc_id, CAST(i - 1 AS BIGINT) AS n, s[i] AS sentence FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM s)""")
def sentence_pieces(spark, d):
    """Every fourth text without full stops, so that sentences are cut at 200 words."""
    t = F.when(F.col("doc_id") % 4 == 0, F.replace("text", F.lit("."), F.lit(""))).otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.posexplode(T.sentences(t)).alias("n", "sentence")).withColumn("n", F.col("n").cast("long"))
