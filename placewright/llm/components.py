"""Connected components of a links table, by repeated minima and pointer jumps in Spark."""

from pyspark.sql import functions as F

from .common import settle


def components(links):
    """Per node (long) of `links` (columns a, b; any order, repeats and self-links allowed): the
    smallest node it reaches, as `root`.

    Every round each node takes the smallest root among its own and its neighbours', then the root
    of that root. Both are one aggregate with map-side combine and one join, so a hub with a third
    of all links is combined before the shuffle; joins leave their skew to adaptive execution.
    Rounds grow with the logarithm of the longest chain in common shapes; each round's table is
    written to the shared folder.
    """
    ends = links.select("a", "b").where("a <> b")
    edges = settle(ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    roots = settle(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "roots")
    while True:
        other = roots.select(F.col("node").alias("b"), F.col("root").alias("seen"))
        # A neighbour's root also hangs this node's own root below it.
        told = edges.join(other, "b").groupBy("a").agg(F.min("seen").alias("seen"))
        near = roots.join(told.select(F.col("a").alias("node"), "seen"), "node").select("node", "root", F.least("root", "seen").alias("low"))
        hung = near.groupBy("root").agg(F.min("low").alias("hung")).select(F.col("root").alias("old"), "hung")
        hooked = settle(near.join(hung, near["root"] == hung["old"]).select("node", "root", F.least("low", "hung").alias("next")), "hooked")
        jump = hooked.select(F.col("node").alias("next"), F.col("next").alias("far"))
        after = settle(hooked.join(jump, "next").select("node", F.col("root").alias("before"), F.least("next", "far").alias("root")), "roots")
        moved = after.where("root <> before").limit(1).count()
        roots = after.select("node", "root")
        if not moved:
            return roots
