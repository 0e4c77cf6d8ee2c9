"""Writers (SNK-01 .. SNK-04, SNK-07)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def write_splits(df: DataFrame, out: str, partition_by: Sequence[str] = ("dataset", "dataset_type", "split"),
                 fmt: str = "json", mode: str = "overwrite") -> None:
    """One directory per (dataset, type, split) — partition pruning for readers
    that want one split (SNK-01)."""
    df.write.mode(mode).partitionBy(*partition_by).format(fmt).save(out)


def write_jsonl(df: DataFrame, out: str, mode: str = "overwrite", compression: str | None = None) -> None:
    w = df.write.mode(mode)
    if compression:
        w = w.option("compression", compression)
    w.json(out)


def write_csv(df: DataFrame, out: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).csv(out, header=True, escape='"', quoteAll=False)


def write_json_gz(df: DataFrame, out: str, mode: str = "overwrite") -> None:
    """Compressed JSON records (gzip: Spark has no xz writer)."""
    write_jsonl(df, out, mode, compression="gzip")
