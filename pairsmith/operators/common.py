"""Shared plan helpers: skew-safe top-k per key, staged look-up tables, ranks in groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage

def top_k_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int,
                  salts: int = 64, rank_col: str = "rk") -> DataFrame:
    """Rows ranked 1..k inside each key by ``order`` (a total order).

    Two levels so a key holding a third of all rows is never ranked in one
    task: rows are first ranked inside (key, salt) and cut to k, which leaves
    at most ``k * salts`` rows per key; the final rank runs on those."""
    hashable = [F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    salt = F.pmod(F.xxhash64(*hashable), F.lit(salts))
    w1 = Window.partitionBy(*keys, "__salt").orderBy(*order)
    pre = (df.withColumn("__salt", salt).withColumn("__r1", F.row_number().over(w1))
           .where(F.col("__r1") <= k).drop("__r1", "__salt"))
    w2 = Window.partitionBy(*keys).orderBy(*order)
    return pre.withColumn(rank_col, F.row_number().over(w2)).where(F.col(rank_col) <= k)


def lookup(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back: the planner then
    knows its bytes and broadcasts it below
    ``spark.sql.autoBroadcastJoinThreshold``; above, the join shuffles with
    skew handling on the larger side.  No count, no second run of its input."""
    return stage(df, "lookup")


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """``df`` dealt out to ``spark.sql.shuffle.partitions`` tasks (by ``cols``, else
    evenly): for costly work on rows of few bytes, which would else be done in the
    few tasks that their bytes fill."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *cols)


def rank_in_group(df: DataFrame, group: str, by: Column, rank: str, total: str) -> DataFrame:
    """0-based ``rank`` of each row in its group by ``by`` (a hash in hex, so
    its first digits split any group evenly) and the group's ``total``.

    Rows are ranked inside (group, first digits) and shifted by the counts of
    the prefixes before: no task sorts a whole group."""
    b = F.substring(by, 1, 3)
    keyed = df.withColumn("__b", b).withColumn("__by", by)
    up = Window.partitionBy(group).orderBy("__b")
    sums = keyed.groupBy(group, "__b").agg(F.count(F.lit(1)).alias("__n")) \
        .withColumn("__off", F.sum("__n").over(up) - F.col("__n")) \
        .withColumn(total, F.sum("__n").over(Window.partitionBy(group))).drop("__n")
    inside = Window.partitionBy(group, "__b").orderBy("__by")
    return keyed.withColumn(rank, F.row_number().over(inside) - 1).join(sums, [group, "__b"]) \
        .withColumn(rank, F.col(rank) + F.col("__off")).drop("__b", "__by", "__off")
