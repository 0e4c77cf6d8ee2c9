"""Connected components of an edge table by alternating large and small stars.

Every round is two aggregations with map-side minima and the joins that hand
the minimum back to the neighbours; a hub's edges meet one row, so skew-join
handling may split them.  Rounds are staged in the shared folder.  Nothing is
collected but a count and a checksum per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """``edges`` (u, v) with u > v.  Large: hang the larger neighbours of each
    node on the least of its neighbourhood; small: hang the smaller ones."""
    flip = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    near = edges.unionAll(flip) if large else edges
    least = near.groupBy("u").agg(F.min("v").alias("m")).select(
        F.col("u").alias("c"), F.least("m", "u").alias("m"))
    if large:
        moved = flip.join(least, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        down = edges.join(least, F.col("u") == F.col("c")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        moved = down.unionAll(least.select(F.col("c").alias("u"), F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a long, b long) -> (node, root): the least node reachable.

    Self loops, nulls and repeats are ignored; nodes without an edge to
    another node do not appear.  An empty table gives an empty one."""
    now = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                .distinct(), "edges")
    state = None
    while True:
        now = stage(_star(_star(now, large=True), large=False), "edges")
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(seen) == state:
            break
        state = tuple(seen)
    # at the fixed point every edge is (node, root)
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots)
