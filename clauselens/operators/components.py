"""Connected components of distributed edge lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import cut


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that an edge names; root: the smallest node reachable.

    edges: columns u, v of one orderable type. Large-star and small-star rounds, each cut; the rounds
    grow with the logarithm of the longest path. No edge reaches the driver, which sees one count and
    two checksums a round. Loops and repeats are allowed (a node with loops only is its own root); an
    empty table gives an empty table; null ends are dropped.
    """
    print_of = lambda e: tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.shiftright(F.xxhash64("v", "u"), 20))).first())
    keyed = lambda df: df.withColumn("k", F.xxhash64("u"))  # noqa: E731  a second key, so that a hashed join side may be any size
    down = lambda df: df.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    given = cut(down(edges.where("u is not null and v is not null")))
    e = given.where("u <> v")
    seen = print_of(e)
    while seen[0]:
        upward = e.select(F.col("v").alias("u"), F.col("u").alias("v"))
        least = e.union(upward).groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        big = cut(keyed(upward).join(keyed(least), ["k", "u"]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        lowest = big.groupBy("u").agg(F.min("v").alias("m"))
        rest = keyed(big).join(keyed(lowest), ["k", "u"]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(down(rest.union(lowest.select("u", F.col("m").alias("v"))).where("u <> v")))
        now = print_of(e)
        if now == seen:
            break
        seen = now
    alone = given.where("u = v").select(F.col("u").alias("node")).join(e.select(F.col("u").alias("node")).union(e.select("v")).distinct(), "node", "left_anti")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v")).union(alone.select("node", F.col("node").alias("root"))).distinct()


def clusters(items: DataFrame, links: DataFrame, id: str = "id") -> DataFrame:
    """items with root: the smallest id that links (u, v) reach; an item without a link is its own."""
    found = components(links.select("u", "v")).withColumnRenamed("node", id)
    return items.join(found, id, "left").withColumn("root", F.coalesce("root", id))
