"""Connected components of a table of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.session import materialize, scratch_path


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One round over rows (a, b) with a > b.

    Large: each node hands its smallest neighbour (or itself) to its larger neighbours.
    Small: each node hands the smallest of its smaller neighbours to the others and to itself.
    A node's smallest neighbour is a plain minimum, so a node with very many links is aggregated before the shuffle,
    and joined back on a side that adaptive execution may split.
    """
    if large:
        both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = links.select("a", "b")
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    joined = both.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            least.select("a", F.col("m").alias("b"))
        )
    return out.where("a > b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): root is the smallest node it can reach.

    Each round is written to the shared folder. Rounds stop when a checksum of the links no longer changes; their
    number grows with the logarithm of the longest chain.
    """
    spark = links.sparkSession
    plain = (
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    marks = {"n": F.count(F.lit(1)), "h": F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))}
    held, seen = materialize(plain, scratch_path(spark, "links"), **marks)
    while seen["n"]:
        held, now = materialize(_star(_star(held, True), False), scratch_path(spark, "links"), **marks)
        if now == seen:
            break
        seen = now
    roots = held.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return held.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
