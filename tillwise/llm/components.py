"""Connected components over a table of links.

Large-star and small-star rounds rewire each node to the smallest node it
knows. Every round is two grouped minima and two joins; the links are cut off
by a reliable checkpoint per round and never pass through the driver. The minima
are cut off as well, before they are joined: so both sides of a join are plain
shuffles, and Spark's skew join deals a hub's links out over several tasks. A
round ends the search when it leaves count and checksum of the links unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.session import checkpointed


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = checkpointed(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = checkpointed(down.groupBy("u").agg(F.min("v").alias("m")))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def _digest(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """``links``: u, v (long). Returns node, component (smallest node of its
    component) for each node that has a link to another one. Null ends, loops
    and repeated links are ignored; without links the result is empty."""
    now = checkpointed(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    seen = _digest(now)
    while seen[0]:
        now = checkpointed(_small_star(_large_star(now).distinct()).distinct())
        new = _digest(now)
        if new == seen:
            break
        seen = new
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
