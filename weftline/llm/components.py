"""Connected components of links that never meet on one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import cut


def connected(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for each node of links (a, b): root is the smallest node that can be reached.

    Each round hooks every node, and the root it had, to the smallest root among its neighbours, and then halves all paths, so
    the number of rounds grows with the logarithm of the longest chain. A hub's links are an aggregation with partial sums
    and the split side of a join, never a group in one task. Each round is cut from its lineage.
    """
    rows = 2 * links.count()  # and there are no more nodes than that
    both = cut(links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct(), rows)
    roots = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")), rows)
    total = F.sum(F.col("root").cast("decimal(38,0)"))  # roots only ever get smaller, so it tells whether one did
    held = roots.agg(total).first()[0]
    for _ in range(most_rounds):
        near = both.join(roots.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        seen = roots.join(near, "node").select("node", "root", F.least("root", "near").alias("low"))
        hooked = (
            seen.select("node", "low")
            .union(seen.select(F.col("root").alias("node"), "low"))
            .groupBy("node")
            .agg(F.min("low").alias("up"))
        )
        jumped = hooked.join(hooked.select(F.col("node").alias("up"), F.col("up").alias("root")), "up", "left").select("node", F.least("up", "root").alias("root"))
        roots = cut(jumped, rows)
        before, held = held, roots.agg(total).first()[0]
        if held == before:
            return roots
    raise RuntimeError(f"components have not settled in {most_rounds} rounds")
