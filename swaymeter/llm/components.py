"""Connected components of a large link table, by repeated contraction to the least neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swaymeter.llm.common import cut


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (a, b: long); nodes share a root exactly when links join them.

    In each round every node moves to the neighbour (or itself) that comes first in an order drawn anew for the round
    by hashing, and the links are rewritten between those. A random order shrinks every shape, long chains included,
    by a constant share per round, so the rounds grow with the logarithm of the nodes. The least neighbour is a
    combinable aggregate and the moves are stored before they are joined, so the centre of a star, which may hold a
    third of all links, is split by the adaptive join. Nothing but the number of open links reaches the driver.
    Loops and repeated links change nothing; no links give an empty table.
    """
    open_links = cut(links.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    at = cut(open_links.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("root")))
    turn = 0
    while not open_links.isEmpty():
        turn += 1
        both = open_links.unionByName(open_links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), c.alias("to"))
        moves = both.groupBy("a").agg(F.min(F.least(order(F.col("a")), order(F.col("b")))).alias("best"))
        moves = cut(moves.select(F.col("a").alias("from"), F.col("best.to").alias("to")))
        to_a, to_b = (moves.select(F.col("from").alias(k), F.col("to").alias(f"{k}_to")) for k in ("a", "b"))
        moved = open_links.join(to_a, "a").join(to_b, "b").select(F.col("a_to").alias("a"), F.col("b_to").alias("b"))
        open_links = cut(moved.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        at = cut(at.join(moves.select(F.col("from").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root")))
    return at
