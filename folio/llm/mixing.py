"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document gets the key -ln(u) / weight, u from a hash of its id, so reruns agree. A source's
documents are taken in complete epochs first; what is left of its budget goes to documents in
ascending key order, by prefix sums. The prefix sums never need a source in one task: sums by key
bucket show in which bucket the budget ends, a finer bucketing of that bucket narrows it again, and
only the few rows of that last bucket are sorted. Only DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Workspace, fresh, pick, text_of

#: Weights of the sources in code-point order, repeating; share of all sizes; cap in epochs.
SOURCE_WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = "mix-1"
#: Buckets for each doubling of the key, coarse and fine.
COARSE, FINE = 32, 1 << 17


def quality_weight(text: str = "text") -> Column:
    """0.1 to 1: the share of letters among the characters of words. Without words: 0.1."""
    t = text_of(text)
    letters, chars = F.length(F.regexp_replace(t, r"[^\p{L}]+", "")), F.length(F.regexp_replace(t, r"[\x20\x09-\x0D]+", ""))
    return F.when(chars > 0, 0.1 + 0.9 * letters / chars).otherwise(F.lit(0.1))


def measures(doc_id: str = "doc_id", text: str = "text") -> tuple[Column, Column]:
    """A row's size (words; null text 0) and its key."""
    code = F.concat_ws("|", F.lit(SEED), F.col(doc_id).cast("string"))
    u = (F.conv(F.substring(F.md5(code), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long"), -F.log(u) / quality_weight(text)


def sizes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source, size, key. The text goes no further than this scan."""
    size, key = measures()
    return pick(docs, doc_id=doc_id, text=text, source=source).select("doc_id", "source", size.alias("size"), key.alias("key"))


def targets(per_source: DataFrame) -> DataFrame:
    """source, source_size -> with target: water-filling by weight under the cap.

    Sources are ordered by cap / weight; with the first k capped, the rest would share at the level
    (total - their caps) / (remaining weight); the first source whose cap lies above it sets the level.
    The windows run over one row for each source.
    """
    everything = Window.orderBy(F.col("source").asc_nulls_last())
    n = len(SOURCE_WEIGHTS)
    at = (F.row_number().over(everything) - 1) % n
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in SOURCE_WEIGHTS)), (at + 1).cast("int"))
    s = per_source.withColumns({"w": weight, "cap": F.col("source_size") * float(MAX_EPOCHS)})
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, all_ = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumns({"cap_before": F.coalesce(F.sum("cap").over(before), F.lit(0.0)), "w_before": F.coalesce(F.sum("w").over(before), F.lit(0.0)), "total": F.sum("source_size").over(all_) * SHARE, "w_all": F.sum("w").over(all_)})
    s = s.withColumn("level", (F.col("total") - F.col("cap_before")) / (F.col("w_all") - F.col("w_before")))
    s = s.withColumn("capped", F.col("cap") <= F.col("level") * F.col("w"))
    s = s.withColumn("level", F.max(F.when(~F.col("capped"), F.col("level"))).over(all_))
    return s.select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("level") * F.col("w")).alias("target"))


def _bucket(per_doubling: int) -> Column:
    return F.floor(F.log2(F.col("key")) * per_doubling)


def _narrow(rows: DataFrame, plan: DataFrame, bucket: str, name: str) -> DataFrame:
    """plan with the bucket in which each source's left budget ends, and the budget left there."""
    sums = rows.groupBy("source", bucket).agg(F.sum("size").alias("s"))
    before = F.sum("s").over(Window.partitionBy("source").orderBy(bucket)) - F.col("s")
    ends = (sums.withColumn("before", before).alias("b").join(plan.alias("p"), F.col("b.source").eqNullSafe(F.col("p.source")))
            .filter((F.col("before") <= F.col("left")) & (F.col("left") < F.col("before") + F.col("s")))
            .select(F.col("p.source").alias("source"), F.col(bucket).alias(name), (F.col("left") - F.col("before")).alias("rest")))
    p, e = plan.alias("p"), ends.alias("e")
    return p.join(e, F.col("p.source").eqNullSafe(F.col("e.source")), "left").select("p.*", F.col("e." + name), F.col("e.rest")).drop("left").withColumnRenamed("rest", "left")


def make_plan(slim: DataFrame, work: Workspace) -> DataFrame:
    """For each source of sizes(): source_size, target, epochs, the bucket (end1, end2) in which its budget ends, and what is left there."""
    per = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = targets(per)
    # the budget is rounded first: so close below a whole epoch it is that epoch, and left is less than the source's size
    budget = F.round("target").cast("long")
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    plan = plan.withColumn("left", budget - F.col("epochs") * F.col("source_size"))
    plan = work.keep(plan, "targets")
    rows = slim.withColumns({"b1": _bucket(COARSE), "b2": _bucket(FINE)})
    plan = work.keep(_narrow(rows, plan, "b1", "end1"), "coarse")
    r, q = rows.alias("r"), plan.alias("q")
    inside = r.join(q, F.col("r.source").eqNullSafe(F.col("q.source")) & (F.col("r.b1") == F.col("q.end1"))).select("r.source", "r.size", "r.b2")
    return work.keep(_narrow(inside, plan, "b2", "end2"), "fine")


def take(rows: DataFrame, plan: DataFrame, whole: bool = False, doc_id: str = "doc_id", source: str = "source", size: str = "size", key: str = "key") -> DataFrame:
    """rows with source_size, target and taken under the names _source_size, _target and _taken.

    Whether a row comes before, in or after its source's last bucket shows from the row itself; only rows in it are sorted.
    """
    r, q = rows.alias("r"), plan.select(*(F.col(c).alias(f"_{c}") for c in plan.columns)).alias("q")
    joined = r.join(q, F.col(f"r.`{source}`").eqNullSafe(F.col("q._source")))
    at = F.log2(F.col(f"`{key}`"))
    b1, b2 = F.floor(at * COARSE), F.floor(at * FINE)
    n = F.col(f"`{size}`")
    last = F.coalesce((b1 == F.col("_end1")) & (b2 == F.col("_end2")), F.lit(False))
    full = F.coalesce((b1 < F.col("_end1")) | ((b1 == F.col("_end1")) & (b2 < F.col("_end2"))), F.lit(False))
    in_order = Window.partitionBy("_source").orderBy(f"`{key}`", f"`{doc_id}`", f"`{size}`")
    done = F.sum(n).over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - n
    left = F.col("_left") - done
    part = F.when(left * 2 >= n, n).otherwise(F.lit(0)) if whole else F.greatest(F.lit(0), F.least(n, left))
    columns = [*(F.col(f"r.`{c}`") for c in rows.columns), "_source_size", "_target"]
    total = lambda extra: (F.col("_epochs") * n + extra).cast("long").alias("_taken")
    sorted_ = joined.filter(last).withColumn("_part", part)
    return (joined.filter(~last).select(*columns, total(F.when(full, n).otherwise(F.lit(0))))
            .unionByName(sorted_.select(*columns, total(F.col("_part")))))


def mix(slim: DataFrame, work: Workspace, whole: bool = False) -> DataFrame:
    """The rows of sizes() with source_size, target and taken.

    taken = epochs * size + the part of the last, incomplete epoch. At the end of the budget one
    document of each source is taken in part (whole=False: its first words), or taken whole if at least half
    of it fits (whole=True). Null sources form one source, the last. Size-0 documents take 0.
    Equal keys (repeated ids) are ordered by size. An empty table gives an empty result.
    """
    slim = work.keep(slim, "sizes")
    out = take(slim, make_plan(slim, work), whole)
    return out.select("doc_id", "source", "size", F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.col("_taken").alias("taken"))


def mix_rows(docs: DataFrame, work: Workspace, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """docs with each row as often as the mix takes it, whole documents only; columns unchanged.

    Rows are written once with their sizes and keys, so that no text is measured twice. Null texts and texts without words have size 0
    and are not taken; null sources form one source; repeated rows are rows of their own. An empty table gives an empty result.
    """
    size_name, key_name = fresh(docs, "_size", "_key")
    size, key = measures(f"`{doc_id}`", f"`{text}`")
    rows = work.keep(docs.withColumns({size_name: size, key_name: key}), "measured")
    slim = rows.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), F.col(f"`{size_name}`").alias("size"), F.col(f"`{key_name}`").alias("key"))
    taken = take(rows, make_plan(slim, work), True, doc_id, source, size_name, key_name).filter(F.col("_taken") > 0)
    copies = F.explode(F.sequence(F.lit(1), (F.col("_taken") / F.col(f"`{size_name}`")).cast("int")))
    return taken.select(*(F.col(f"`{c}`") for c in docs.columns), copies.alias("_copy")).select(*(F.col(f"`{c}`") for c in docs.columns))


def oracle_sql() -> str:
    return rf"""
    WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
        length(regexp_replace(coalesce(text, ''), '[^\p{{L}}]+', '', 'g')) AS letters,
        length(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS chars,
        (CAST(CAST('0x' || substr(md5('{SEED}|' || CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u FROM documents),
    k AS (SELECT doc_id, source, size, -ln(u) / (CASE WHEN chars > 0 THEN CAST(0.1 AS DOUBLE) + CAST(0.9 AS DOUBLE) * letters / chars ELSE CAST(0.1 AS DOUBLE) END) AS key FROM d),
    s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
                 CAST([3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS DOUBLE) AS w FROM k GROUP BY source),
    c AS (SELECT *, 2.0::DOUBLE * source_size AS cap FROM s),
    f AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
                 coalesce(sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_before,
                 1.5::DOUBLE * sum(source_size) OVER () AS total, sum(w) OVER () AS w_all FROM c),
    l AS (SELECT *, (total - cap_before) / (w_all - w_before) AS level FROM f),
    p AS (SELECT *, cap <= level * w AS capped FROM l),
    t AS (SELECT source, source_size, CASE WHEN capped THEN cap ELSE max(CASE WHEN NOT capped THEN level END) OVER () * w END AS target FROM p),
    e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
    j AS (SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, CAST(round(e.target - e.epochs * e.source_size) AS BIGINT) AS budget,
                 sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - k.size AS done
          FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
    SELECT doc_id, size, source_size, round(target, 6) AS target, CAST(epochs * size + greatest(0, least(size, budget - done)) AS BIGINT) AS taken FROM j"""
