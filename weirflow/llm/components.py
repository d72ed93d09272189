"""Connected components of links, by alternating large and small stars (Kiveris and others, 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import cut, lookup, release

#: Bytes of a row that holds two numbers, as a broadcast relation.
PAIR = 32


def _lowest(pairs: DataFrame) -> DataFrame:
    """(u, m, n): the smallest v of each u and how many rows u has; a minimum before the shuffle, so a centre costs one row for each task."""
    return pairs.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))


def _settled(edges: DataFrame) -> bool:
    """Whether every u has one v only, and no v is a u: then v is u's component."""
    if not edges.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return False
    return edges.select("v").distinct().join(edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(id, comp) for every id in links (a, b): comp is the smallest id that it is linked to, however far.

    No group is gathered anywhere: every step is a minimum for each id and a join that deals the
    links of a large star's centre over several tasks. Each round is cut into the shared folder.
    Self-links, null ends and repeated links don't matter; empty in, empty out.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while not _settled(edges):
        most = 2 * edges.count()
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = lookup(both, _lowest(both), ["u"], "n", row_bytes=PAIR, most=most).where("v > u")
        large = large.select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v")
        small = lookup(large, _lowest(large), ["u"], "n", row_bytes=PAIR, most=most)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = cut(small)
        release(links.sparkSession)
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct()
    return cut(edges.select(F.col("u").alias("id"), F.col("v").alias("comp")).unionAll(roots))


def joined(comps: DataFrame, links: DataFrame) -> DataFrame:
    """comps (id, comp) after more links (a, b): the same as components() of all links, by way of links between components only."""
    ends = [comps.select(F.col("id").alias(x), F.col("comp").alias(f"c{x}")) for x in "ab"]
    between = links.select("a", "b").join(ends[0], "a", "left").join(ends[1], "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    new = components(between).select(F.col("id").alias("comp"), F.col("comp").alias("to"))
    # components themselves are among the ids of new: those that weren't in comps stand for single ids
    moved = comps.join(new, "comp", "left").select("id", F.coalesce("to", "comp").alias("comp"))
    fresh_ids = new.join(comps, new["comp"] == comps["id"], "left_anti").select(F.col("comp").alias("id"), F.col("to").alias("comp"))
    return cut(moved.unionAll(fresh_ids))
