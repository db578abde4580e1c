"""Connected components of a link table by alternating large and small stars; nothing is gathered on the driver."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbstream.llm.common import stage


def _star(links: DataFrame, small: bool) -> DataFrame:
    """One star step. A hot node's rows meet its minimum in a sort-merge join, which can split them."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    other = links.select(F.col("b").alias("u"), F.col("a").alias("v"))
    near = both.union(other) if not small else both.where("v < u").union(other.where("v < u"))
    low = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = near.join(low, "u")
    if small:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
    else:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return out.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(a, b) links to (node, component), the smallest node reachable, for all nodes that have a link."""
    e = stage(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = lambda d: tuple(d.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before = mark(e)
    while before[0]:
        e = stage(_star(_star(e, small=False), small=True), "links")
        now = mark(e)
        if now == before:
            break
        before = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select("b", "b").distinct())
