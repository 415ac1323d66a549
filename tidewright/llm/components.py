"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Store


def components(store: Store, edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node reachable.

    Each round links every node to the smallest node nearby, so that the number of rounds grows with
    the logarithm of the longest path. Links stay in written tables; the driver sees only counts.
    Self loops and repeated edges do no harm; an empty table gives an empty result."""
    now = store.write(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        # n links have 2n nodes at most, so counting them bounds every table that is sent; beyond it they are shuffled.
        few = 2 * now.limit(BROADCAST_ROWS // 2 + 1).count() <= BROADCAST_ROWS
        sent = F.broadcast if few else lambda df: df
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.join(sent(low), "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = store.write(large.where("a <> b").distinct())
        # Small star: all rows now point down; a's smaller neighbours go to the least of them.
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(sent(low), "a").select(F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e")).select("e.a", "e.b")
        then = store.write(small.where("a <> b").distinct())
        # Done when every node points to one node that points nowhere.
        first = then.groupBy("a").agg(F.count("*").alias("n"))
        unsettled = then.join(sent(first.select(F.col("a").alias("b"), "n")), "b", "left_semi").limit(1).count() or first.where("n > 1").limit(1).count()
        store.drop(now, large)
        now = then
        if not unsettled:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
