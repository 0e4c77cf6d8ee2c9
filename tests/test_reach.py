"""Reachability index against the closure."""

import random

import pytest
from pyspark.sql import functions as F

from pairsmith.operators import reach


def closure(edges):
    up = {}
    for a, b in edges:
        if a is not None and b is not None:
            up.setdefault(a, set()).add(b)
    out = set()
    for a in up:
        todo, seen = list(up[a]), set()
        while todo:
            b = todo.pop()
            if b not in seen:
                seen.add(b)
                todo += up.get(b, ())
        out |= {(a, b) for b in seen}
    return out


@pytest.mark.parametrize("seed,cyclic", [(1, False), (2, True)])
def test_random_graphs(spark, seed, cyclic):
    rng = random.Random(seed)
    edges = []
    for part in range(6):  # several small graphs at once, tree-like to dense
        n = rng.randint(2, 9)
        for _ in range(rng.randint(1, 2 * n)):
            a, b = rng.randrange(n), rng.randrange(n)
            if cyclic or a < b:
                edges.append((f"{part}.{a}", f"{part}.{b}"))
    edges += edges[:3] + [(None, "0.0"), ("0.0", None)]
    nodes = sorted({x for e in edges for x in e if x is not None}) + ["unknown"]
    pairs = [(a, b) for a in nodes for b in nodes] + [(None, "0.0")]
    index = reach.build(spark.createDataFrame(edges, "child string, parent string"))
    got = reach.reachable(index, spark.createDataFrame(pairs, "low string, high string"))
    found = [tuple(r) for r in got.collect()]
    assert set(found) == closure(edges) and len(found) == len(set(found))


def test_deep_chain_and_wide_star(spark):
    """A chain of 100,000 nodes, whose closure has five thousand million pairs."""
    n = 100_000
    chain = spark.range(n - 1).select(F.concat(F.lit("c"), "id").alias("child"), F.concat(F.lit("c"), F.col("id") + 1).alias("parent"))
    star = spark.range(20_000).select(F.concat(F.lit("s"), "id").alias("child"), F.lit("c99000").alias("parent"))
    extra = spark.createDataFrame([("c50000", "side"), ("side", "top")], "child string, parent string")
    index = reach.build(chain.unionByName(star).unionByName(extra))
    asked = [("c0", "c99999"), ("c99999", "c0"), ("c500", "c499"), ("s7", "c99500"), ("s7", "c98999"), ("s7", "s8"), ("c3", "top"),
             ("c50001", "top"), ("s9", "top"), ("c7", "c7")]
    got = {tuple(r) for r in reach.reachable(index, spark.createDataFrame(asked, "low string, high string")).collect()}
    assert got == {("c0", "c99999"), ("s7", "c99500"), ("c3", "top")}


def test_empty(spark):
    none = spark.createDataFrame([], "child string, parent string")
    index = reach.build(none)
    assert reach.reachable(index, none.toDF("low", "high")).count() == 0
