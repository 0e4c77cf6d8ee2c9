"""Row filters and flag columns (FLT-*, PRJ-05/06)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .checks import worker_subset_guard

DATASET_TYPES = ("dataset_simple", "dataset_creative", "dataset_full")


def exclude_workers(df: DataFrame, excluded: Sequence[str], col: str = "worker_id",
                    check: bool = True) -> DataFrame:
    """Drop rows of excluded workers after checking that the excluded set is a
    proper subset of the workers present.  Rows with a null worker are kept."""
    ex = sorted(set(excluded))
    if check:
        row = worker_subset_guard(df, ex, col).first()
        if not row["ok"]:
            raise ValueError(f"invalid excluded workers: {ex} (present {row['excluded_present']}"
                             f" of {row['workers']} workers)")
    return df.where(F.coalesce(~F.col(col).isin(ex), F.lit(True)))


def dataset_type_flags(df: DataFrame, section: str = "section") -> DataFrame:
    """``dataset_simple`` = section starts with 1-3, ``creative`` = not simple,
    ``full`` = always."""
    simple = F.col(section).rlike("^[1-3]")
    return df.withColumns({"dataset_simple": simple, "dataset_creative": ~simple,
                           "dataset_full": F.lit(True)})


def explode_dataset_types(df: DataFrame, section: str = "section") -> DataFrame:
    """One row per (row, dataset type it belongs to): the long form the
    partitioned writer takes.  Narrow: no shuffle."""
    simple = F.col(section).rlike("^[1-3]")
    types = F.filter(
        F.array(F.when(simple, F.lit("dataset_simple")),
                F.when(~simple, F.lit("dataset_creative")),
                F.lit("dataset_full")),
        lambda x: x.isNotNull())
    return df.withColumn("dataset_type", F.explode(types))


def is_complete(col: str = "Answer.Submit Location"):
    """Completion flag: the trimmed cell is the empty marker ``{}``."""
    return F.trim(F.col(f"`{col}`")) == "{}"


def drop_unlabelled(df: DataFrame, label: str = "label") -> DataFrame:
    """Drop corpus rows whose gold label is ``-`` (FLT-01)."""
    return df.where(F.col(label) != "-")
