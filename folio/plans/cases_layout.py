"""Recognized layout over documents: each line becomes a box on a page of 24, in two columns or in rows of two fragments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import layout
from ..providers import render_size, route_pages
from .registry import LINES, query, r6, table, words

WIDTH = 1000.0


def boxes(spark, d):
    """document_id, page, width, text, x0, x1, y0, y1, score."""
    lines = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.posexplode(T.block_lines(F.col("text"))).alias("i", "line"))
    r, two = F.col("i") % 24, F.col("document_id") % 3 == 0
    side, row = r % 2, F.floor(r / 2)
    x0 = F.when(two, 50 + 500 * side).when(side == 1, 700).otherwise(50 + 10 * (F.col("document_id") % 5))
    x1 = F.when(two, 450 + 500 * side).when(side == 1, 900).otherwise(150 + 8 * F.least(F.length("line"), F.lit(50)))
    y0 = F.when(two, 30 * row).otherwise(25 * row + F.when(r >= 12, 40).otherwise(0) + side * (F.col("document_id") % 13))
    text = F.when(r % 8 == 5, F.lit("1 2 3")).otherwise(F.col("line"))
    score = 1 - ((F.col("i") * 7 + F.col("document_id")) % 10) / 12
    number = lambda c: c.cast("double")
    return lines.select("document_id", (F.floor(F.col("i") / 24) + 1).cast("int").alias("page"), F.lit(WIDTH).alias("width"), text.alias("text"), number(x0).alias("x0"), number(x1).alias("x1"),
                        number(y0).alias("y0"), (number(y0) + 20).alias("y1"), number(score).alias("score"))


_BOXES = f"""l AS (SELECT doc_id AS document_id, unnest({LINES}) AS line, generate_subscripts({LINES}, 1) - 1 AS i FROM documents),
g AS (SELECT *, i % 24 AS r, document_id % 3 = 0 AS two FROM l),
b AS (SELECT document_id, CAST(i // 24 + 1 AS INT) AS page, i, two, CASE WHEN r % 8 = 5 THEN '1 2 3' ELSE line END AS text,
 CAST(CASE WHEN two THEN 50 + 500 * (r % 2) WHEN r % 2 = 1 THEN 700 ELSE 50 + 10 * (document_id % 5) END AS DOUBLE) AS x0,
 CAST(CASE WHEN two THEN 450 + 500 * (r % 2) WHEN r % 2 = 1 THEN 900 ELSE 150 + 8 * least(length(line), 50) END AS DOUBLE) AS x1,
 CAST(CASE WHEN two THEN 30 * (r // 2) ELSE 25 * (r // 2) + CASE WHEN r >= 12 THEN 40 ELSE 0 END + (r % 2) * (document_id % 13) END AS DOUBLE) AS y0,
 CAST(1 - CAST((i * 7 + document_id) % 10 AS DOUBLE) / 12 AS DOUBLE) AS score FROM g),
tw AS (SELECT document_id, page, count(*) FILTER (x1 - x0 BETWEEN 300 AND 500 AND x1 <= 550) >= greatest(4, 0.25 * count(*)) AND count(*) FILTER (x1 - x0 BETWEEN 300 AND 500 AND x0 >= 450) >= greatest(4, 0.25 * count(*)) AS two_column FROM b GROUP BY ALL)"""
# A line joins the last row if the centres differ by at most half the smaller height; all are 20 high.
_ROWS = f"""o AS (SELECT b.*, row_number() OVER (PARTITION BY document_id, page ORDER BY y0 + 10, x0, text) AS k FROM b),
rw AS (SELECT document_id, page, k, text, x0, x1, y0, y0 AS anchor, 0 AS row FROM o WHERE k = 1
 UNION ALL SELECT o.document_id, o.page, o.k, o.text, o.x0, o.x1, o.y0, CASE WHEN abs(o.y0 - rw.anchor) > 10 THEN o.y0 ELSE rw.anchor END, CASE WHEN abs(o.y0 - rw.anchor) > 10 THEN rw.row + 1 ELSE rw.row END
 FROM rw JOIN o ON o.document_id = rw.document_id AND o.page = rw.page AND o.k = rw.k + 1),
mr AS (SELECT document_id, page, CAST(row AS INT) AS row, string_agg(text, ' ' ORDER BY x0, k) AS text, min(x0) AS x0, max(x1) AS x1, min(y0) AS y0, max(y0) + 20 AS y1 FROM rw GROUP BY document_id, page, row)"""


def _ordered(spark, d):
    """The boxes of a page come in reading order."""
    return boxes(spark, d).orderBy("document_id", "page", "y0", "x0", "text")


@query(f"WITH {_BOXES} SELECT document_id, page, two_column FROM tw")
def ocr_two_column(spark, d):
    return layout.two_column(boxes(spark, d))


@query(f"WITH RECURSIVE {_BOXES}, {_ROWS} SELECT document_id, page, row, text, x0, x1, y0, y1 FROM mr")
def ocr_merge_rows(spark, d):
    return layout.merge_rows(boxes(spark, d)).select("document_id", "page", "row", "text", "x0", "x1", "y0", "y1")


def _noise(x: str) -> str:
    t = words(x)
    return f"(len({t}) = 0 OR len(list_filter({t}, lambda w: NOT regexp_matches(w, '[A-Za-z]{{2,}}'))) > 0.5 * len({t}))"


_STACKED = f"""pt AS (SELECT b.document_id, b.page, CASE WHEN (x0 + x1) / 2 < 500 THEN 0 ELSE 1 END AS part, text, x0, x1, y0, y0 + 20 AS y1 FROM b JOIN tw USING (document_id, page) WHERE two_column
 UNION ALL SELECT mr.document_id, mr.page, 0, text, x0, x1, y0, y1 FROM mr JOIN tw USING (document_id, page) WHERE NOT two_column),
pk AS (SELECT *, {_noise('text')} AS noise, row_number() OVER (PARTITION BY document_id, page, part ORDER BY y0, x0, text) AS k FROM pt),
sk AS (SELECT document_id, page, part, k, [{{'t': text, 'x0': x0, 'x1': x1, 'y0': y0, 'y1': y1, 'n': noise}}] AS bl FROM pk WHERE k = 1
 UNION ALL SELECT document_id, page, part, k, CASE WHEN ix IS NOT NULL AND bl[ix].n = noise
   THEN list_concat(list_concat(bl[1:ix - 1], [{{'t': bl[ix].t || chr(10) || text, 'x0': least(bl[ix].x0, x0), 'x1': greatest(bl[ix].x1, x1), 'y0': bl[ix].y0, 'y1': greatest(bl[ix].y1, y1), 'n': noise}}]), bl[ix + 1:])
   ELSE list_append(bl, {{'t': text, 'x0': x0, 'x1': x1, 'y0': y0, 'y1': y1, 'n': noise}}) END
 FROM (SELECT pk.*, sk.bl, list_filter(range(len(sk.bl), 0, -1), lambda i: pk.x0 < sk.bl[i].x1 AND pk.x1 > sk.bl[i].x0 AND pk.y0 - sk.bl[i].y1 >= -0.5 * (pk.y1 - pk.y0) AND pk.y0 - sk.bl[i].y1 <= 0.9 * (pk.y1 - pk.y0))[1] AS ix
  FROM sk JOIN pk ON pk.document_id = sk.document_id AND pk.page = sk.page AND pk.part = sk.part AND pk.k = sk.k + 1)),
fin AS (SELECT document_id, page, part, arg_max(bl, k) AS bl FROM sk GROUP BY ALL),
un AS (SELECT document_id, page, part, unnest(range(1, len(bl) + 1)) AS i, bl FROM fin)"""


@query(f"""WITH RECURSIVE {_BOXES}, {_ROWS}, {_STACKED}
SELECT document_id, page, CAST(row_number() OVER (PARTITION BY document_id, page ORDER BY part, bl[i].y0, bl[i].x0, i) - 1 AS INT) AS pos, bl[i].t AS text FROM un""")
def ocr_stack_blocks(spark, d):
    return layout.blocks(boxes(spark, d))


@query(f"""WITH {_BOXES} SELECT document_id, page, CAST(count(*) FILTER (score >= 0.5 AND text <> '') AS BIGINT) AS kept, round(avg(score), 6) AS confidence FROM b GROUP BY ALL""")
def ocr_recognized(spark, d):
    kept, confidence = layout.recognized(boxes(spark, d))
    n = kept.groupBy("document_id", "page").agg(F.count("*").alias("kept"))
    return confidence.join(n, ["document_id", "page"], "left").select("document_id", "page", F.coalesce("kept", F.lit(0).cast("long")).alias("kept"), r6(F.col("confidence"), "confidence"))


@query(f"""WITH {_BOXES}, m AS (SELECT document_id, page, avg(score) AS m FROM b GROUP BY ALL), c AS (SELECT document_id, CASE WHEN (document_id + page) % 3 <> 1 THEN m + 0.3 * (document_id % 2) END AS c FROM m)
SELECT document_id, CASE WHEN avg(c) < 0.9 THEN 'low' WHEN avg(c) IS NOT NULL THEN 'good' END AS quality FROM c GROUP BY document_id""")
def ocr_quality(spark, d):
    """Every third page has a text layer and so no confidence; odd documents are raised above the limit."""
    _, c = layout.recognized(boxes(spark, d))
    own = F.when((F.col("document_id") + F.col("page")) % 3 != 1, F.col("confidence") + 0.3 * (F.col("document_id") % 2))
    return layout.ocr_quality(c.withColumn("ocr_confidence", own))


_SCANNED = f"""l AS (SELECT doc_id AS document_id, unnest({LINES}) AS line, generate_subscripts({LINES}, 1) - 1 AS i FROM documents),
s AS (SELECT document_id, CAST(i // 10 + 1 AS INT) AS page, count(*) AS n, string_agg(line, '|' ORDER BY i) AS blocks, avg(1 - CAST((i * 7 + document_id) % 10 AS DOUBLE) / 12) AS c FROM l GROUP BY ALL)"""


@query(f"""WITH {_SCANNED} SELECT document_id, page, document_id % 4 = 0 AND page % 2 = 1 AS ocr, n AS n_blocks, blocks, CASE WHEN document_id % 4 = 0 AND page % 2 = 1 THEN round(c, 6) END AS confidence
FROM s WHERE NOT (document_id % 8 = 0 AND page % 4 = 3)""")
def ocr_routing(spark, d):
    """Odd pages of every fourth document have no text layer; of every eighth, recognition finds nothing on each fourth page."""
    lines = table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.posexplode(T.block_lines(F.col("text"))).alias("i", "line"))
    score = (1 - ((F.col("i") * 7 + F.col("document_id")) % 10) / 12).cast("double")
    page = (F.floor(F.col("i") / 10) + 1).cast("int")
    text = F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"])
    p = lines.withColumns({"page": page, "score": score}).groupBy("document_id", "page").agg(text.alias("seen"), F.avg("score").alias("c"))
    scanned, blank = (F.col("document_id") % 4 == 0) & (F.col("page") % 2 == 1), (F.col("document_id") % 8 == 0) & (F.col("page") % 4 == 3)
    p = p.withColumn("blocks", F.when(scanned, F.array().cast("array<string>")).otherwise(F.col("seen")))
    recognize = lambda pages: pages.withColumns({"blocks": F.when(blank, F.array().cast("array<string>")).otherwise(F.col("seen")), "ocr_confidence": F.col("c")})
    out = route_pages(p, recognize)
    return out.select("document_id", "page", "ocr", F.size("blocks").cast("long").alias("n_blocks"), F.array_join("blocks", "|").alias("blocks"), F.round("ocr_confidence", 6).alias("confidence"))


@query("""SELECT page_id, CAST(round(w * 1600.0 / greatest(w, h)) AS INT) AS width, CAST(round(h * 1600.0 / greatest(w, h)) AS INT) AS height, w > h AS landscape
FROM (SELECT page_id, 500 + page_id % 700 AS w, 600 + page_id % 300 AS h FROM pages)""")
def page_render_size(spark, d):
    p = table(spark, d, "pages").select("page_id", (500 + F.col("page_id") % 700).alias("w"), (600 + F.col("page_id") % 300).alias("h"))
    return p.select("page_id", F.inline(F.array(render_size(F.col("w"), F.col("h")))), (F.col("w") > F.col("h")).alias("landscape"))
