"""Corpus sampling and dataset mixing (SRT-03/05, SET-02, PRJ-03).

Exact-size seeded samples use the same bucket plan as the group split: the
``n``-th smallest hash key is found from per-bucket counts, then the sample
is the rows whose key is below it.  No global sort, no ``limit`` through one
task; several sizes share one hash order, so the samples nest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .split import kth_keys, seeded_order_key

# Corpus column names and their dataset names.
RENAME_COLS = {"sentence1": "premise", "sentence2": "hypothesis", "gold_label": "label"}
SAMPLE_SEED = "42"
# The names a sentence-pair reader gives the two texts.
TEXT_PAIR_COLS = {"sentence1": "text_a", "sentence2": "text_b", "premise": "text_a", "hypothesis": "text_b", "gold_label": "label"}


def harmonise(df: DataFrame, mapping: dict[str, str] = RENAME_COLS) -> DataFrame:
    """Rename corpus columns to dataset names; absent columns are ignored."""
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def _nth_keys(keyed: DataFrame, key: str, ranks: Sequence[int]) -> dict[int, str | None]:
    """Key at each 0-based rank in ascending key order (None past the end)."""
    _, found = kth_keys(keyed, key, ranks, distinct=False)
    return {n: found.get(n) for n in ranks}


def exact_sample(df: DataFrame, n: int, seq: str, seed: str = SAMPLE_SEED) -> DataFrame:
    """Exactly ``min(n, count)`` rows, chosen by a seeded hash of ``seq``
    (unique per row).  Same rows for any partitioning."""
    return nested_samples(df, [n], seq, seed).drop("sample_size")


def nested_samples(df: DataFrame, sizes: Sequence[int], seq: str, seed: str = SAMPLE_SEED) -> DataFrame:
    """One row per (row, size) for every size whose sample holds the row;
    smaller samples are subsets of larger ones."""
    k = "__sk"
    keyed = df.withColumn(k, seeded_order_key(seq, seed))
    bounds = _nth_keys(keyed, k, sorted(set(sizes)))
    arr = F.array(*[F.when(F.lit(bounds[n] is None) | (F.col(k) < F.lit(bounds[n] or "")), F.lit(n))
                    for n in sorted(set(sizes))])
    return (keyed.withColumn("sample_size", F.explode(F.filter(arr, lambda x: x.isNotNull())))
            .drop(k))


def union_fill(base: DataFrame, other: DataFrame) -> DataFrame:
    """Union by name, columns missing on a side filled with null (SET-02)."""
    return base.unionByName(other, allowMissingColumns=True)


def mix_variants(base: DataFrame, corpora: dict[str, DataFrame], split_col: str = "split",
                 train: str = "train") -> DataFrame:
    """Hybrid datasets, one per corpus variant: dev/test rows copied as they
    are, train = base train rows plus the variant's corpus rows.

    Base rows are replicated to every variant with an exploded literal array
    (narrow; no join).  Corpus rows are projected to the base's columns."""
    names = list(corpora)
    cols = [c for c in base.columns if c != split_col]
    out = base.withColumn("variant", F.explode(F.array(*[F.lit(v) for v in names])))
    for v, corpus in corpora.items():
        out = out.unionByName(corpus.select(*cols).withColumn(split_col, F.lit(train))
                              .withColumn("variant", F.lit(v)))
    return out
