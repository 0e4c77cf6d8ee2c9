"""Label-conflict removal and keep-first de-duplication of sentence pairs.

All operators group on the pair key.  They are written as one aggregate per
pair so that Spark combines rows map-side before the shuffle: a pair that
holds a third of all rows still reaches the reducer as one row per map task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAIR = ("premise", "hypothesis")


def _keys_present(keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    return cond


def label_conflicts(df: DataFrame, keys: Sequence[str] = PAIR,
                    label: str = "label") -> DataFrame:
    """Per pair: number of rows, number of distinct labels, conflict flag.

    Null labels are not counted; pairs with a null key are never conflicting
    (a pandas group-by drops null keys).
    """
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"),
             F.count_distinct(label).cast("bigint").alias("n_labels"))
        .withColumn("is_conflict", (F.col("n_labels") > 1) & _keys_present(keys))
    )


def drop_conflicts_dedup(df: DataFrame, order_by: Sequence[str], keys: Sequence[str] = PAIR,
                         label: str = "label") -> DataFrame:
    """Drop every copy of a pair that carries two labels, then keep the first
    row (by ``order_by``) of each remaining pair.

    One shuffle on the pair key.  ``min`` over a struct led by the order
    columns picks the first row exactly (not ``dropDuplicates``, which keeps
    an arbitrary one); the label range gives the conflict test in the same
    aggregate, so no second pass or anti-join is needed.  Key texts travel as
    the group's key alone: they are equal in all its rows.
    """
    cols = df.columns
    # a number with a fraction may be grouped with another spelling of itself (-0.0): such keys stay in the row
    plain = {f.name for f in df.schema.fields if f.dataType.typeName() in ("string", "long", "integer", "short", "byte", "boolean", "date", "timestamp")}
    at = {k: F.col(f"__k{i}") for i, k in enumerate(keys) if k in plain and k not in order_by}
    rest = [c for c in cols if c not in order_by and c not in at]
    packed = F.struct(*[F.col(c) for c in order_by], *[F.col(c) for c in rest])
    agg = df.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(
        F.min(label).alias("__lo"), F.max(label).alias("__hi"), F.min(packed).alias("__first"))
    conflict = F.coalesce(F.col("__lo") != F.col("__hi"), F.lit(False))
    for i in range(len(keys)):
        conflict = conflict & F.col(f"__k{i}").isNotNull()
    return agg.filter(~conflict).select(*[at.get(c, F.col(f"__first.{c}")).alias(c) for c in cols])


def dedup_report(df: DataFrame, keys: Sequence[str] = PAIR, label: str = "label") -> DataFrame:
    """One row: rows before, rows after conflict drop + dedup, conflicting pairs.

    Computed from the per-pair aggregate alone (rows after = pairs that are not
    conflicting), so the input is read and shuffled once.
    """
    per_pair = (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"), F.min(label).alias("lo"), F.max(label).alias("hi"))
        .withColumn("conflict", F.coalesce(F.col("lo") != F.col("hi"), F.lit(False)) & _keys_present(keys))
    )
    return per_pair.agg(
        F.sum("n").cast("bigint").alias("rows_before"),
        F.sum(F.when(~F.col("conflict"), 1).otherwise(0)).cast("bigint").alias("rows_after"),
        F.sum(F.when(F.col("conflict"), 1).otherwise(0)).cast("bigint").alias("conflicting_pairs"),
    )


def pair_frequency(df: DataFrame, k: int = 5, keys: Sequence[str] = PAIR,
                   label: str = "label") -> DataFrame:
    """Top-``k`` most repeated pairs, plus whole-set counts of distinct pairs,
    distinct (pair, label) triples and the contradiction warning flag.

    ``k`` is the report size (the feature), not a cap on the work: every row
    is counted.  Ties on the count are broken by the key for determinism.
    """
    # a null label is a value of its own in a (pair, label) tally
    per_pair = df.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("bigint").alias("n"),
        (F.count_distinct(label) + F.max(F.col(label).isNull().cast("int"))).cast("bigint").alias("n_labels"))
    totals = per_pair.agg(
        F.count(F.lit(1)).cast("bigint").alias("distinct_pairs"),
        F.sum("n_labels").cast("bigint").alias("distinct_pair_labels"))
    top = per_pair.orderBy(F.desc("n"), *[F.asc(k_) for k_ in keys]).limit(k)
    # ``totals`` is one row: attach it with a join on a constant key (broadcast of one row).
    return (top.withColumn("__one", F.lit(1))
            .join(F.broadcast(totals.withColumn("__one", F.lit(1))), "__one")
            .drop("__one", "n_labels")
            .withColumn("has_contradiction", F.col("distinct_pairs") != F.col("distinct_pair_labels")))
