"""Connected components by alternating large-star and small-star (Kiveris et al., 2014), as joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace

#: Hubs whose minimum is broadcast: the nodes of highest degree, no more than HUBS of them (a few MB). What is joined by shuffle has
#: then at most a HUBS-th of the edges at one key.
HUBS, HUB_DEGREE = 1 << 16, 64


def _toward(edges: DataFrame, key: str, least: DataFrame) -> DataFrame:
    """edges(u, v) with m: the minimum that least(node, m) has for the node in column key, else that node itself.

    Hubs get theirs by a broadcast, so no task meets all edges of one; degrees and minima are combined before the shuffle.
    """
    hubs = edges.groupBy(F.col(key).alias("node")).agg(F.count("*").alias("degree")).filter(F.col("degree") > HUB_DEGREE).orderBy(F.desc("degree"), "node").limit(HUBS)
    hubs = F.broadcast(hubs.join(least, "node", "left").select(F.col("node").alias(key), F.coalesce("m", "node").alias("hub_m")))
    marked = edges.join(hubs, key, "left")
    own = marked.filter("hub_m is not null").select("u", "v", F.col("hub_m").alias("m"))
    rest = marked.filter("hub_m is null").select("u", "v").join(least.withColumnRenamed("node", key), key, "left")
    return own.unionByName(rest.select("u", "v", F.coalesce("m", key).alias("m")))


def components(links: DataFrame, work: Workspace, label: str = "cc") -> DataFrame:
    """node, root (the smallest node of its component) for every node of links(a, b) with a != b.

    Nodes may be of any type that has an order. Links with a null end and loops join nothing; no links give no rows. Each half-step is a
    written table. Ends when no edge changes.
    """
    spark = links.sparkSession
    edges = work.keep(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("a is not null and b is not null and v <> u").distinct(), f"{label}-0")
    before, step = None, 0
    while True:
        step += 1
        # large-star: the larger end of each edge goes to the smallest neighbour of the other end, which is that end itself unless it has a smaller one
        least = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m"))
        large = work.keep(_toward(edges, "v", least).select("u", F.col("m").alias("v")).distinct(), f"{label}-{step}-l")
        # small-star: u and its smaller neighbours go to the smallest of them
        least = large.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m"))
        small = _toward(large, "u", least).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(least.select(F.col("node").alias("u"), F.col("m").alias("v"))).distinct()
        small = work.keep(small, f"{label}-{step}-s")
        now = small.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        work.drop(f"{label}-{step}-l", *([f"{label}-0"] if step == 1 else [f"{label}-{step - 1}-s"]))
        edges = small
        if now == before or not now[0]:
            break
        before = now
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots) if now[0] else spark.createDataFrame([], edges.select(F.col("u").alias("node"), F.col("v").alias("root")).schema)
