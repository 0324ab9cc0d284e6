"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from seqspark.shared import stored


#: Up to this number of links, each step of a round ends in ``TASKS`` tasks, and the least neighbours of nodes (16 bytes for each) are broadcast; more are shuffled.
BROADCAST_LINKS, TASKS = 50_000, 8


def _open(links: DataFrame) -> DataFrame:
    """Nodes of distinct links (a, b), a > b, that have several smaller neighbours, or one and a larger one; without such nodes, links are stars."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(links.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up > 0 AND down > 0")


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links(a, b)``; root is the smallest node of the component.

    Each round replaces links by stars around smaller nodes; the number of rounds follows the
    logarithm of the longest path.  Links stay in the shared folder, only counts reach the driver.
    Links of a node to itself and repeated links do no harm.

    Each shuffle and each stored table costs tasks and files for all partitions, which for many short rounds is
    more than the links; a round of few links shuffles its minima and its new links alone, and ends in few tasks.
    """
    links = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    # links do not become more
    few = links.count() <= BROADCAST_LINKS
    dealt = (lambda df: df.coalesce(TASKS)) if few else (lambda df: df)
    sized = (lambda df: F.broadcast(dealt(df))) if few else (lambda df: df)
    while not dealt(_open(links)).isEmpty():
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(sized(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(sized(least), "a")
            .select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")))).alias("x"))
            .select("x.a", "x.b").where("a <> b").distinct()
        )
        links = stored(dealt(small), "links")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(links.select("b", "b").distinct())


def first_rows(docs: DataFrame, grouped: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id names a component of ``grouped`` (doc_id, component_id); repeated rows, and those with a null id, once each."""
    kept = grouped.where("doc_id = component_id").select("doc_id").distinct()
    again = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    lone = docs.join(kept.join(again, "doc_id", "left_anti"), "doc_id", "left_semi")
    several = docs.join(kept.join(again, "doc_id", "left_semi"), "doc_id", "left_semi").unionByName(docs.where("doc_id IS NULL"))
    return lone.unionByName(several.distinct())
