"""Connected components by alternating large and small stars, on tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import saved


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """edges(u, v), each with v < u."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = both.join(least, "u")
    if large:
        out = linked.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u != v").distinct()


def _starred(edges: DataFrame) -> bool:
    """Whether each node of edges(u, v) hangs on one node that hangs on none."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("root")))
    told = ends.groupBy("node").agg((F.sum("up") + F.max("root") > 1).alias("apart")).filter("apart")
    return not told.agg(F.count(F.lit(1))).first()[0]


def components(edges: DataFrame) -> DataFrame:
    """node and root, the least node of its component, of each node of edges(a, b) that isn't a root."""
    now = saved(edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while not _starred(now):
        now = saved(_stars(_stars(now, True), False), "edges")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots(node, root), as of components, with links(a, b) that came since: only components that these join are gone through."""
    of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias("r" + c))
    both = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    top = components(both.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")))
    moved = roots.join(top.select(F.col("node").alias("root"), F.col("root").alias("now")), "root", "left")
    return moved.select("node", F.coalesce("now", "root").alias("root")).unionByName(top)
