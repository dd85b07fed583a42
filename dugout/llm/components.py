"""Connected components of a graph given by its links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dugout.llm.common import forget, materialize


def _with_least(links: DataFrame, value: Column, tag: str) -> tuple[DataFrame, DataFrame]:
    """Links with m, the least ``value`` of the links of their u; and the table of u and m. That is written first: of a
    join of two tables Spark splits the partition of a node that has very many links."""
    least = materialize(links.groupBy("u").agg(value.alias("m")), tag)
    return links.join(least, "u"), least


def _round(links: DataFrame, tag: str) -> DataFrame:
    """Large star and small star on links u > v; their result again has u > v, and every component stays connected."""
    # large star: each node's larger neighbours are linked to the least node it knows
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    known, first = _with_least(both, F.least(F.min("v"), F.col("u")), tag)
    large = materialize(known.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), tag)
    # small star: each node and its smaller neighbours are linked to the least of them
    known, second = _with_least(large, F.min("v"), tag)
    small = known.select(F.col("v").alias("u"), F.col("m").alias("v")).union(second.select("u", F.col("m").alias("v")))
    small = materialize(small.filter("u <> v").distinct(), tag)
    for done in (links, first, large, second):
        forget(done)
    return small


def _stars(links: DataFrame) -> bool:
    """Whether every node has one link to a smaller one or some to larger ones, not both: then the smaller are roots."""
    ends = links.select(F.col("u").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up"))
    ends = ends.union(links.select("v", F.lit(0), F.lit(1)))
    seen = ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return seen.filter("down > 1 or (down = 1 and up = 1)").isEmpty()


def least_reachable(links: DataFrame, a: str = "a", b: str = "b", tag: str = "links") -> DataFrame:
    """For every node of a component with others: ``node``, and ``root``, the component's least node, but for the root's own row.

    Nodes are of any type with an order. After each step the links are written to the shared folder. The work ends
    when all links are stars.
    """
    now = materialize(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), tag)
    while not _stars(now):
        now = _round(now, tag)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
