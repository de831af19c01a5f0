"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placelake.llm.shared import release, write_table


def components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` of longs in any direction -> ``(v, root)``, a row per vertex that isn't the smallest of its component; root is that one.

    Each round hangs the larger neighbours of every vertex, then all its smaller ones, under the
    smallest; rounds grow with the logarithm of the longest chain. Only aggregates that combine on
    the map side and joins that Spark can split are used, so a hub is no hot spot. Self-links and
    repeated links are harmless; an empty table gives an empty one. ``links`` is read several times,
    so it should be a checkpoint or a stored table. What a round leaves is a stored table, whose small files
    are read together: a checkpoint has a task for every partition, however few rows are in it, twice when made and
    in each later read. The caller may release the last one.
    """
    done = []
    e = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = write_table(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "stars")
        # done where each vertex hangs under one other, and none that hangs has others under it
        ends = e.select(F.col("a").alias("v"), F.lit(1).alias("hung"), F.lit(0).alias("holds")).unionByName(e.select(F.col("b").alias("v"), F.lit(0).alias("hung"), F.lit(1).alias("holds")))
        if ends.groupBy("v").agg(F.sum("hung").alias("hung"), F.max("holds").alias("holds")).where("hung > 1 or hung + holds > 1").isEmpty():
            release(*done)
            return e.select(F.col("a").alias("v"), F.col("b").alias("root"))
        done.append(e)
