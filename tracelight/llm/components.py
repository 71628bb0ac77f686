"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelight.llm.tables import stored


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the smallest node reachable) of every node of ``links`` (a, b: long).

    Rounds of two steps over the links: each node's larger neighbours are linked to its smallest
    neighbour, then its smaller ones. Both keep what is connected, and after about log n rounds every
    node is linked to the smallest of its component only. Each round is written to the shared folder.
    """
    links = stored(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links"
    )
    while True:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
            .union(down.select("a", F.col("m").alias("b")))
            .distinct()
        )
        links_next = stored(small, "links")
        same = links_next.exceptAll(links).limit(1).count() == 0 and links.count() == links_next.count()
        links = links_next
        if same:
            break
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
