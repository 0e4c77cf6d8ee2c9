"""Incremental writes: resume an interrupted run and a memo table (SNK-05,
SNK-06, J-18).  A resume is an anti-join against what is already stored, a
memo look-up reads the parts of its store that may hold a key (``store``); both
append a new batch, so a rerun after a lost executor or a killed job
only computes what is missing.  A batch directory is written completely
before it becomes visible (Spark's commit protocol), so a failed write leaves
no partial batch to be read back."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage
from .store import KeyedStore


def _existing(spark: SparkSession, path: str, fmt: str) -> DataFrame | None:
    """The stored table, or None where no file lies yet.  Any other fault
    (schema, permission) is raised: it must not cause a recompute."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p) or not len(fs.listStatus(p)):
        return None
    return spark.read.format(fmt).load(path)


def _missing(rows: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys are not stored; a null key equals a null key."""
    have = stored.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).distinct()
    on = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    return rows.join(have, on, "left_anti")


def resume_append(new: DataFrame, path: str, keys: Sequence[str], fmt: str = "parquet",
                  order_by: Sequence[Column | str] = ()) -> DataFrame:
    """Append the rows of ``new`` whose keys are not stored yet; return the
    full stored table.  Of rows repeating a key, the first by ``order_by``
    (values, least first; then by all columns) is kept, so a rerun stores the
    same row."""
    spark = new.sparkSession
    old = _existing(spark, path, fmt)
    todo = new if old is None else _missing(new, old, keys)
    rest = [c for c in new.columns if c not in keys]
    order = [F.col(c) if isinstance(c, str) else c for c in order_by]
    first = F.min(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)],
                           F.struct(*[F.col(c) for c in rest]).alias("row"))).alias("first")
    if rest:
        todo = todo.groupBy(*keys).agg(first).select(*keys, "first.row.*")
    else:
        todo = todo.distinct()
    todo.select(*new.columns).write.mode("append").format(fmt).save(path)
    return spark.read.format(fmt).load(path)


def memo_lookup(keys: DataFrame, path: str, key: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Memo table keyed by ``key``: ``compute`` sees only the misses, its rows
    are stored as a new batch, and values come back for every key.  Of the
    stored table only the file groups that may hold a key are read."""
    store = KeyedStore(keys.sparkSession, path, key)
    wanted = stage(keys.select(key).distinct(), "memo-keys")
    hits = store.stored(wanted)
    found = stage(compute(store.missing(wanted, hits)), "memo-misses")
    store.add(found)
    return found.unionByName(hits, allowMissingColumns=True)
