"""Reachability without the closure's pairs (NLP-06, J-07).

Every node keeps one parent (its least), which makes a forest once each cycle
of such pointers is cut at its least node.  An Euler tour ranked by pointer
doubling numbers the nodes so that a node lies below another exactly if its
interval lies inside the other's: two look-ups and a comparison answer most
questions.  What is left runs over the other edges only: from a node straight to
the nearest node above it (or itself) that has such an edge - found by doubling
too - and along it.

All steps are equi-joins; rounds grow with the logarithm of the depth for the
index, and for a question with the non-tree edges on its way.  Written size: a
few rows per node, whatever the depth.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .common import rank_in_group


def _doubled(pointers: DataFrame, combine: dict[str, Column] | None = None) -> DataFrame:
    """(a, p, ...) with ``p`` the end that the pointers lead to, by doubling
    (``p`` of an end is itself).  ``combine`` gives other columns over a step:
    expressions of ``l`` (at ``a``) and ``r`` (at its ``p``)."""
    combine = combine or {}
    now = stage(pointers, "pointers")
    while True:
        r = now.select(F.col("a").alias("b"), F.col("p").alias("q"), *[F.col(c).alias(f"r_{c}") for c in combine])
        step = now.join(r, F.col("p") == F.col("b"))
        moved = stage(step.select("a", F.col("q").alias("p"), *[e.alias(c) for c, e in combine.items()],
                                  (F.col("q") != F.col("p")).alias("moved")), "pointers")
        now = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return now


def _tree(edges: DataFrame) -> DataFrame:
    """(child, parent): the least parent of each node, cycles cut at their least node."""
    up = edges.where("child <> parent").groupBy("child").agg(F.min("parent").alias("parent"))
    up = stage(up, "tree")
    heads = up.select(F.col("parent").alias("child")).distinct().join(up.select("child"), "child", "left_anti")
    now = stage(up.select(F.col("child").alias("a"), F.col("parent").alias("p"), F.col("child").alias("least"))
                .unionByName(heads.select(F.col("child").alias("a"), F.lit(None).cast("string").alias("p"), F.col("child").alias("least"))),
                "tree-pointers")
    n, hops = now.count(), 1
    while hops < 2 * n and not now.where("p IS NOT NULL").isEmpty():
        r = now.select(F.col("a").alias("b"), F.col("p").alias("q"), F.col("least").alias("far"))
        now = stage(now.join(r, F.col("p") == F.col("b"), "left").select(
            "a", F.col("q").alias("p"), F.least("least", F.coalesce("far", "least")).alias("least")), "tree-pointers")
        hops *= 2
    # who still points somewhere points into a cycle, and has gone around it
    cuts = now.where("p IS NOT NULL").select("p").distinct() \
        .join(now.select("a", "least"), F.col("p") == F.col("a")).select(F.col("least").alias("child")).distinct()
    return stage(up.join(cuts, "child", "left_anti"), "tree")


@dataclass
class Reach:
    """Index of a graph: strings as nodes."""

    labels: DataFrame   # node, root, first, last: interval in its root's tour (first falls towards the root's end)
    above: DataFrame    # node, parent: tree edges
    exits: DataFrame    # node, exit: nearest node at or above it with other edges
    others: DataFrame   # child, parent: edges that are not of the tree

    def inside(self, pairs: DataFrame, low: str, high: str) -> DataFrame:
        """``pairs`` with ``within``: ``low`` is ``high`` or lies below it in the tree."""
        l = self.labels.select(F.col("node").alias("ln"), F.col("root").alias("lr"), F.col("first").alias("lf"), F.col("last").alias("ll"))
        h = self.labels.select(F.col("node").alias("hn"), F.col("root").alias("hr"), F.col("first").alias("hf"), F.col("last").alias("hl"))
        j = pairs.join(l, F.col(low) == F.col("ln"), "left").join(h, F.col(high) == F.col("hn"), "left")
        within = (F.col("lr") == F.col("hr")) & (F.col("lf") <= F.col("hf")) & (F.col("ll") >= F.col("hl"))
        return j.select(*pairs.columns, (F.coalesce(within, F.lit(False)) | (F.col(low) == F.col(high))).alias("within"))


def build(edges: DataFrame, child: str = "child", parent: str = "parent") -> Reach:
    """Index of the edges; null ends and repeats do not count."""
    e = stage(edges.select(F.col(child).cast("string").alias("child"), F.col(parent).cast("string").alias("parent"))
              .where("child IS NOT NULL AND parent IS NOT NULL").distinct(), "edges")
    tree = _tree(e)
    others = stage(e.join(tree, ["child", "parent"], "left_anti"), "other-edges")
    nodes = stage(e.select(F.col("child").alias("node")).union(e.select("parent")).distinct(), "nodes")
    # tour: down into the first child, from a child up and down into the next, up to the parent after the last
    kids = stage(rank_in_group(tree, "parent", F.md5("child"), "k", "n"), "kids")
    down, up = (lambda c: F.concat(F.lit("d"), c)), (lambda c: F.concat(F.lit("u"), c))
    first = kids.where("k = 0").select(F.col("parent").alias("node"), F.col("child").alias("kid"))
    into = nodes.join(first, "node", "left").select(down(F.col("node")).alias("a"), F.coalesce(down(F.col("kid")), up(F.col("node"))).alias("p"))
    later = kids.select("parent", (F.col("k") - 1).alias("k"), F.col("child").alias("sibling"))
    out = kids.join(later, ["parent", "k"], "left").select(up(F.col("child")).alias("a"), F.coalesce(down(F.col("sibling")), up(F.col("parent"))).alias("p"))
    ends = nodes.join(tree, F.col("node") == F.col("child"), "left_anti").select(up(F.col("node")).alias("a"), up(F.col("node")).alias("p"))
    arcs = into.unionAll(out).unionAll(ends).withColumn("d", (F.col("a") != F.col("p")).cast("long"))
    ranked = _doubled(arcs, {"d": F.col("d") + F.col("r_d")})
    side = lambda s, name: ranked.where(F.substring("a", 1, 1) == s).select(
        F.expr("substring(a, 2)").alias("node"), F.expr("substring(p, 2)").alias("root"), F.col("d").alias(name))
    labels = stage(side("d", "first").join(side("u", "last"), ["node", "root"]), "labels")
    flagged = others.select(F.col("child").alias("f")).distinct()
    hop = nodes.join(tree, F.col("node") == F.col("child"), "left").join(flagged, F.col("node") == F.col("f"), "left") \
        .select(F.col("node").alias("a"), F.when(F.col("f").isNotNull(), F.col("node")).otherwise(F.coalesce("parent", "node")).alias("p"))
    exits = _doubled(hop).join(flagged, F.col("p") == F.col("f"), "left_semi") if not others.isEmpty() else hop.limit(0)
    return Reach(labels, tree.select(F.col("child").alias("node"), "parent"),
                 stage(exits.select(F.col("a").alias("node"), F.col("p").alias("exit")), "exits"), others)


def reachable(index: Reach, pairs: DataFrame, low: str = "low", high: str = "high") -> DataFrame:
    """Distinct (low, high) of ``pairs`` where edges lead from ``low`` up to
    ``high`` in one step or more: a node reaches itself only around a cycle."""
    asked = stage(pairs.select(F.col(low).cast("string").alias("low"), F.col(high).cast("string").alias("high"))
                  .where("low IS NOT NULL AND high IS NOT NULL").distinct(), "asked")
    first = stage(index.inside(asked, "low", "high").withColumn("hit", F.col("within") & (F.col("low") != F.col("high"))), "asked")
    hits = first.where("hit").select("low", "high")
    x = index.exits.select(F.col("node").alias("n"), F.col("exit").alias("x"))
    at = stage(first.where("not hit").select("low", "high").join(x, F.col("low") == F.col("n")).select("low", "high", "x"), "frontier")
    seen = at
    while not at.isEmpty():
        over = at.join(index.others, F.col("x") == F.col("child")).select("low", "high", F.col("parent").alias("y")).distinct()
        over = stage(index.inside(over, "y", "high"), "crossed")
        found = over.where("within").select("low", "high").distinct()
        hits = hits.unionAll(found)
        onward = over.where("not within").select("low", "high", "y").unionAll(
            at.join(index.above, F.col("x") == F.col("node")).select("low", "high", F.col("parent").alias("y")))
        new = onward.join(found, ["low", "high"], "left_anti").join(x, F.col("y") == F.col("n")).select("low", "high", "x").distinct()
        at = stage(new.join(seen, ["low", "high", "x"], "left_anti"), "frontier")
        seen = seen.unionAll(at)
    return hits.distinct()
