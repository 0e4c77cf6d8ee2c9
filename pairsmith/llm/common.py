"""Small helpers shared by the operators: Arrow batch cutting, safe column
names, distributed ranks, span text."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage

#: Words are runs of characters other than these six ASCII blanks.
BLANKS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: Python functions take texts in groups of about this many bytes.
GROUP_BYTES = 4 << 20


def col(name: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(df: DataFrame, *wanted: str) -> list[str]:
    """Column names that clash with none of ``df`` (case-insensitively)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for w in wanted:
        while w.lower() in taken:
            w = "_" + w
        taken.add(w.lower())
        out.append(w)
    return out


def kept_columns(df: DataFrame, keep: Sequence[str] | None, *results: str) -> list[str]:
    """``keep``, or all columns of ``df``, without any that bears the name of a
    result column: the result takes its place."""
    taken = {r.lower() for r in results}
    return [c for c in (df.columns if keep is None else keep) if c.lower() not in taken]


def byte_groups(batch: pa.RecordBatch, text: int, limit: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of an Arrow batch holding about ``limit`` text bytes each
    (one row at least): a batch of long texts is worked off in pieces."""
    import numpy as np
    import pyarrow.compute as pc
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    lo = 0
    while lo < len(sizes):
        base = ends[lo] - sizes[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield lo, hi
        lo = hi


def row_hash(df: DataFrame) -> Column:
    """64-bit hash of a whole row (map columns, which have no hash, left out)."""
    fields = [col(f.name) for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    return F.xxhash64(F.lit(len(fields)), *fields)


def ordered_slots(df: DataFrame, group: str, bucket: Column, order: Sequence[Column], slot: str) -> DataFrame:
    """Number the rows of each group 0, 1, ... in ``order`` without sorting a
    whole group in one task.

    ``bucket`` is an integer that never falls along ``order`` (a prefix of a
    random key).  Rows are numbered inside (group, bucket) and shifted by the
    counts of the buckets before.  ``group`` and ``bucket`` hold no nulls."""
    b, before, n = free_name(df, "bucket_no", "rows_before", "rows_in")
    df = df.withColumn(b, bucket)
    up = Window.partitionBy(col(group)).orderBy(col(b)).rowsBetween(Window.unboundedPreceding, -1)
    starts = df.groupBy(col(group), col(b)).agg(F.count(F.lit(1)).alias(n)) \
        .select(col(group), col(b), F.coalesce(F.sum(col(n)).over(up), F.lit(0)).alias(before))
    inside = Window.partitionBy(col(group), col(b)).orderBy(*order)
    out = df.withColumn(slot, F.row_number().over(inside).cast("long") - 1).join(starts, [group, b])
    return out.withColumn(slot, col(slot) + col(before)).drop(b, before)


def word_count(text: Column) -> Column:
    """Number of words (``WORD``) of a text; 0 for null."""
    body = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.length(body) > 0, F.size(F.split(body, BLANKS + "+"))).otherwise(0).cast("long")


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of an array of (start, rank, kind, end) structs,
    by start, then kind rank, comma-joined; '' for none."""
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


__all__ = ["BLANKS", "WORD", "GROUP_BYTES", "col", "free_name", "kept_columns", "byte_groups", "row_hash", "ordered_slots",
           "word_count", "span_text", "stage"]
