"""Connected groups of a graph given by its links, on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallylens.sources.files import staged


def components(links: DataFrame) -> DataFrame:
    """node and label for every node of ``links`` (x, y); nodes that are connected have one label, one of themselves.

    Local contraction: in each round every node joins the one of lowest rank among itself and its neighbours, and links
    between those that were joined are the next round's. Ranks are hashes that change with every second round, so a chain
    shrinks by a constant share in two rounds, whatever its order. A star takes two: its middle joins the leaf of lowest
    rank, and all other leaves join that leaf, whose rank is still the lowest. Each round is written to the shared folder;
    the joins of the rounds are then followed from the last one back.
    """
    left = staged(links.where("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct(), "links")
    joined: list[DataFrame] = []
    while not left.isEmpty():
        rank = lambda c: F.struct(F.xxhash64(F.lit(len(joined) // 2), c).alias("rank"), F.col(c).alias("to"))
        both = left.unionAll(left.select("y", "x"))
        to = staged(both.groupBy("x").agg(F.min(rank("y")).alias("near")).select(
            F.col("x").alias("node"), F.least(rank("x"), "near")["to"].alias("label")), "joined")
        joined.append(to)
        ends = left.join(to.withColumnsRenamed({"node": "x", "label": "a"}), "x").join(to.withColumnsRenamed({"node": "y", "label": "b"}), "y")
        left = staged(ends.where("a <> b").select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct(), "links")
    if not joined:
        return left.select(F.col("x").alias("node"), F.col("y").alias("label"))
    found = joined.pop()
    while joined:
        before = joined.pop()
        later = found.select(F.col("node").alias("label"), F.col("label").alias("last"))
        found = before.join(later, "label", "left").select("node", F.coalesce("last", "label").alias("label"))
    return staged(found, "groups")
