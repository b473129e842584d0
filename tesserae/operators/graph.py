"""Connected components of a link table by alternating large-star and small-star steps.

Each step is two shuffles over the links; a node's neighbours are only ever reduced to their minimum, never
gathered, and the driver sees two numbers a round. Rounds grow with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.staging import discard, staged


def _star(links: DataFrame, larger: bool) -> DataFrame:
    """One step. links: a, b with rank order of ids in a < b or b < a; both directions are looked at."""
    both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not larger:
        both = both.filter(F.col("b") < F.col("a"))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    met = both.join(low, "a")
    if larger:
        out = met.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b"))
    else:
        out = met.select(F.col("b").alias("a"), F.col("low").alias("b")).unionAll(low.select("a", F.col("low").alias("b")))
    return out.filter(F.col("a") != F.col("b")).distinct()


def connected_components(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """links: a, b (nodes). nodes: node, id. -> node, component: the smallest id that links reach, of linked nodes.

    Nodes without links are left out. Self links and repeated links do no harm; an empty table gives none.
    """
    now = staged(links.select("a", "b").filter(F.col("a") != F.col("b")).distinct(), "links")
    state = None
    while True:
        then = staged(_star(_star(now, True), False), "links")
        seen = then.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(now)
        now = then
        if tuple(seen) == state:
            break
        state = tuple(seen)
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = roots.unionAll(roots.select("root", "root").distinct())
    least = roots.join(nodes, "node").groupBy("root").agg(F.min("id").alias("component"))
    return roots.join(least, "root").select("node", "component")
