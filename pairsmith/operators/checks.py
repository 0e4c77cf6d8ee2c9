"""Data-quality invariants written as zero-violation queries.

Each check returns a DataFrame; an empty result (or zero counts) means the
invariant holds.  ``assert_*`` helpers run the query and raise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def split_partition_law(df: DataFrame, group: str, split_col: str = "split") -> DataFrame:
    """One row: groups, groups in more than one part (must be 0), rows with
    no part (must be 0).  Disjoint + covering, in one aggregate."""
    per_group = df.groupBy(group).agg(
        F.count_distinct(split_col).alias("parts"),
        F.sum(F.col(split_col).isNull().cast("int")).alias("unassigned"))
    return per_group.agg(
        F.count(F.lit(1)).cast("bigint").alias("n_groups"),
        F.sum((F.col("parts") > 1).cast("int")).cast("bigint").alias("groups_in_many_parts"),
        F.sum("unassigned").cast("bigint").alias("rows_unassigned"))


def shared_values(df: DataFrame, value_cols: Sequence[str], part_col: str = "split",
                  skip_pairs: Sequence[tuple[str, str]] = (), normalise=None) -> DataFrame:
    """Values found in more than one part (J-17 / SET-03).

    One shuffle on the value with map-side distinct; each value reports the
    set of parts it occurs in.  Several columns are stacked into one value
    set (SET-07), nulls dropped; ``normalise`` (a function on columns, such
    as singular lower case) comes first.  ``skip_pairs`` lists part pairs
    allowed to share (e.g. two test sets); a value is reported if any other
    pair of its parts shares it."""
    clean = normalise or (lambda c: c)
    stacked = df.select(
        F.col(part_col).alias("part"),
        F.explode(F.array(*[clean(F.col(c).cast("string")) for c in value_cols])).alias("value"))
    per_value = (stacked.where(F.col("value").isNotNull())
                 .groupBy("value").agg(F.sort_array(F.collect_set("part")).alias("parts"))
                 .where(F.size("parts") > 1))
    if skip_pairs:
        allowed = F.array(*[F.array(*map(F.lit, sorted(p))) for p in skip_pairs])
        per_value = per_value.where(F.exists("parts", lambda a: F.exists(
            "parts", lambda b: (a < b) & ~F.array_contains(allowed, F.array(a, b)))))
    return per_value


def pair_leaks(df: DataFrame, part_col: str = "split",
               keys: Sequence[str] = ("premise", "hypothesis")) -> DataFrame:
    """(premise, hypothesis) pairs present in more than one part.  One shuffle:
    the set of a pair's parts is combined map-side."""
    return (df.groupBy(*keys).agg(F.sort_array(F.collect_set(part_col)).alias("parts"))
            .where(F.size("parts") > 1))


def worker_subset_guard(df: DataFrame, excluded: Sequence[str], col: str = "worker_id") -> DataFrame:
    """One row: workers present, excluded workers present, and ``ok`` = the
    excluded set is a proper subset of the workers present (SET-06)."""
    ex = sorted(set(excluded))
    return df.agg(
        F.count_distinct(col).cast("bigint").alias("workers"),
        F.count_distinct(F.when(F.col(col).isin(ex), F.col(col))).cast("bigint").alias("excluded_present"),
    ).withColumn("ok", (F.col("excluded_present") == F.lit(len(ex)))
                 & (F.col("workers") > F.col("excluded_present")))


def assert_empty(df: DataFrame, what: str) -> None:
    bad = df.limit(5).collect()
    if bad:
        raise AssertionError(f"{what}: {bad}")
