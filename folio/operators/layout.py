"""Layout of recognized text: lines (document_id, page, width, text, x0, x1, y0, y1) into blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_noisy, let, strip

LOW_CONFIDENCE, MIN_SCORE = 0.9, 0.5


def box_of(points: Column) -> Column:
    """struct<x0, x1, y0, y1> of an array of struct<x, y>."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x0"), F.array_max(xs).alias("x1"), F.array_min(ys).alias("y0"), F.array_max(ys).alias("y1"))


def recognized(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines worth keeping, document_id, page, confidence): the confidence is the mean over all lines, blank and weak ones too."""
    kept = lines.filter((F.col("score") >= MIN_SCORE) & (strip(F.col("text")) != ""))
    return kept, lines.groupBy("document_id", "page").agg(F.avg("score").alias("confidence"))


def two_column(lines: DataFrame) -> DataFrame:
    """document_id, page, two_column: enough half-width lines on either side."""
    half = (F.col("x1") - F.col("x0")).between(0.3 * F.col("width"), 0.5 * F.col("width"))
    a = lines.groupBy("document_id", "page").agg(F.count("*").alias("n"), F.count_if(half & (F.col("x1") <= 0.55 * F.col("width"))).alias("l"), F.count_if(half & (F.col("x0") >= 0.45 * F.col("width"))).alias("r"))
    least = F.greatest(F.lit(4.0), 0.25 * F.col("n"))
    return a.select("document_id", "page", ((F.col("l") >= least) & (F.col("r") >= least)).alias("two_column"))


def merge_rows(lines: DataFrame) -> DataFrame:
    """document_id, page, width, row, text and box of each visual row.

    By centre (ties by left edge, then text), a line joins the last row if their centres differ by at most half the smaller height of the line and the
    row's first line; else it begins a row. A fold over one page's lines that carries that first line's centre and height.
    """
    centre, height = (F.col("y0") + F.col("y1")) / 2, F.col("y1") - F.col("y0")
    line = F.struct(centre.alias("c"), "x0", "text", "x1", "y0", "y1", height.alias("h"))
    p = lines.groupBy("document_id", "page").agg(F.first("width").alias("width"), F.array_sort(F.collect_list(line)).alias("lines"))
    start = F.struct(F.array().cast("array<int>").alias("rows"), F.lit(-1).alias("row"), F.lit(0.0).alias("c"), F.lit(0.0).alias("h"))

    def step(acc: Column, x: Column) -> Column:
        joins = (acc["row"] >= 0) & (F.abs(x["c"] - acc["c"]) <= 0.5 * F.least(x["h"], acc["h"]))
        row = F.when(joins, acc["row"]).otherwise(acc["row"] + 1)
        return F.struct(F.array_append(acc["rows"], row).alias("rows"), row.alias("row"), F.when(joins, acc["c"]).otherwise(x["c"]).alias("c"), F.when(joins, acc["h"]).otherwise(x["h"]).alias("h"))

    numbered = p.select("document_id", "page", "width", F.inline(F.arrays_zip(F.aggregate("lines", start, step)["rows"].alias("row"), F.col("lines").alias("l"))))
    words = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l.x0", "l.c", "l.text"))), lambda x: x["text"]), " ")
    return numbered.groupBy("document_id", "page", "width", "row").agg(words.alias("text"), F.min("l.x0").alias("x0"), F.max("l.x1").alias("x1"), F.min("l.y0").alias("y0"), F.max("l.y1").alias("y1"))


def stack_blocks(rows: DataFrame) -> DataFrame:
    """document_id, page, part, pos, text. part orders columns of one page.

    From the top (ties from the left, then by text) a row looks for the newest block that it overlaps sideways and that ends near its top; it
    joins that block if both are noise or both are not, else it is a block of its own. Blocks then go by their top, ties from the left.
    """
    rows = rows if "part" in rows.columns else rows.withColumn("part", F.lit(0))
    row = F.struct("y0", "x0", "text", "x1", "y1", is_noisy(F.col("text")).alias("noise"))
    p = rows.groupBy("document_id", "page", "part").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    block = "struct<y0:double,x0:double,text:string,x1:double,y1:double,noise:boolean>"

    def step(blocks_: Column, r: Column) -> Column:
        gap = lambda b: r["y0"] - b["y1"]
        h = r["y1"] - r["y0"]
        touches = lambda b: (r["x0"] < b["x1"]) & (r["x1"] > b["x0"]) & (gap(b) >= -0.5 * h) & (gap(b) <= 0.9 * h)
        near = F.array_max(F.transform(blocks_, lambda b, i: F.when(touches(b), i).otherwise(-1)))

        def placed(i: Column) -> Column:
            same = F.get(blocks_, i)["noise"] == r["noise"]
            grown = lambda b: F.struct(b["y0"].alias("y0"), F.least(b["x0"], r["x0"]).alias("x0"), F.concat_ws("\n", b["text"], r["text"]).alias("text"), F.greatest(b["x1"], r["x1"]).alias("x1"),
                                       F.greatest(b["y1"], r["y1"]).alias("y1"), b["noise"].alias("noise"))
            joined = F.transform(blocks_, lambda b, k: F.when(k == i, grown(b)).otherwise(b))
            return F.when((i >= 0) & F.coalesce(same, F.lit(False)), joined).otherwise(F.array_append(blocks_, r))

        return let(F.coalesce(near, F.lit(-1)), placed)

    found = F.aggregate("rows", F.array().cast(f"array<{block}>"), step)
    ordered = F.array_sort(F.transform(found, lambda b, i: F.struct(b["y0"].alias("y0"), b["x0"].alias("x0"), i.alias("i"), b["text"].alias("text"))))
    return p.select("document_id", "page", "part", F.posexplode(F.transform(ordered, lambda b: b["text"])).alias("pos", "text"))


def blocks(lines: DataFrame) -> DataFrame:
    """document_id, page, pos, text: columns left then right where a page has two, else rows merged and stacked."""
    marked = lines.join(two_column(lines), ["document_id", "page"])
    columns = marked.filter("two_column").withColumn("part", F.when((F.col("x0") + F.col("x1")) / 2 < F.col("width") / 2, 0).otherwise(1))
    single = merge_rows(marked.filter("not two_column").drop("two_column")).withColumn("part", F.lit(0))
    names = ["document_id", "page", "part", "text", "x0", "x1", "y0", "y1"]
    found = stack_blocks(columns.select(*names).unionByName(single.select(*names)))
    order = F.struct("part", F.col("pos").alias("at"))
    return found.groupBy("document_id", "page").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), "text"))).alias("b")).select("document_id", "page", F.posexplode(F.transform("b", lambda x: x["text"])).alias("pos", "text"))


def ocr_quality(pages: DataFrame) -> DataFrame:
    """document_id, quality: null without recognized pages, low under a mean confidence of 0.9, else good."""
    a = pages.groupBy("document_id").agg(F.avg("ocr_confidence").alias("c"))
    return a.select("document_id", F.when(F.col("c") < LOW_CONFIDENCE, "low").when(F.col("c").isNotNull(), "good").alias("quality"))
