"""Dataset registry and preparation (SRC-11, UDF-05, PRJ-01, PRJ-02, SNK-07).

A ``DatasetSpec`` names a dataset's group column, metadata fields, types,
excluded workers and split fractions.  ``prepare_all`` runs every registered
dataset into one long table (dataset, dataset_type, split, ...), which the
partitioned writer lays out as one directory per split.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stage
from . import checks, filters, split

COLUMNS = ("premise", "hypothesis", "label")


@dataclass(frozen=True)
class DatasetSpec:
    """``load(spark, where)`` gives rows with ``COLUMNS`` and a ``metadata``
    struct holding ``metadata_fields`` (the group column among them)."""

    name: str
    load: Callable[[SparkSession, str], DataFrame]
    metadata_fields: tuple[str, ...]
    group: str = "row_id"
    dataset_types: tuple[str, ...] = ("dataset_creative",)
    excluded_workers: tuple[str, ...] = ()
    fractions: tuple[tuple[str, float], ...] = split.FRACTIONS_3WAY
    columns: tuple[str, ...] = field(default=COLUMNS)


_SPECS: dict[str, DatasetSpec] = {}


def register_dataset(spec: DatasetSpec) -> DatasetSpec:
    """Add a dataset under its name; a second one of that name is an error."""
    if spec.name in _SPECS:
        raise ValueError(f"dataset {spec.name} is registered already")
    _SPECS[spec.name] = spec
    return spec


def dataset(name: str) -> DatasetSpec:
    return _SPECS[name]


def all_datasets() -> list[DatasetSpec]:
    return list(_SPECS.values())


def flatten_metadata(df: DataFrame, fields: Iterable[str], struct: str = "metadata") -> DataFrame:
    """The listed fields of the struct as columns, the struct kept (PRJ-01);
    a column of that name is replaced."""
    return df.withColumns({f: F.col(f"{struct}.{f}") for f in fields})


def flatten_all_metadata(df: DataFrame, struct: str = "metadata") -> DataFrame:
    """Every field of the struct as a column, the struct dropped (PRJ-02);
    a column of a field's name gives way to it."""
    names = df.schema[struct].dataType.fieldNames()
    return df.select(*[c for c in df.columns if c != struct and c not in names], f"{struct}.*")


def prepare(spark: SparkSession, spec: DatasetSpec, where: str) -> DataFrame:
    """One dataset's rows: metadata flattened, workers excluded, groups split
    exactly, one row per dataset type; no pair stands in two parts."""
    rows = flatten_metadata(spec.load(spark, where), spec.metadata_fields).drop("metadata")
    rows = split.exact_group_split(stage(rows, f"dataset-{spec.name}"), spec.group, spec.fractions)
    checks.assert_empty(checks.pair_leaks(rows), f"pairs of {spec.name} in two parts")
    if spec.excluded_workers:
        rows = filters.exclude_workers(rows, spec.excluded_workers)
    typed = filters.explode_dataset_types(rows) if "section" in rows.columns else \
        rows.withColumn("dataset_type", F.explode(F.array(*[F.lit(t) for t in spec.dataset_types])))
    return typed.where(F.col("dataset_type").isin(list(spec.dataset_types))) \
        .select(F.lit(spec.name).alias("dataset"), "dataset_type", "split", F.col(spec.group).cast("string").alias("group"),
                *spec.columns)


def prepare_all(spark: SparkSession, where: str, specs: Iterable[DatasetSpec] | None = None) -> DataFrame:
    """All registered datasets (or ``specs``) in one table."""
    out = None
    for spec in (all_datasets() if specs is None else specs):
        rows = prepare(spark, spec, where)
        out = rows if out is None else out.unionByName(rows)
    return out


def write_hybrid(base: DataFrame, corpus: DataFrame, out: str, variant: str, fmt: str = "json") -> None:
    """A hybrid dataset directory: dev and test as they are, train followed by
    the corpus rows cut to the base's columns (SNK-07); one directory per part."""
    cols = [c for c in base.columns if c != "split"]
    rows = base.unionByName(corpus.select(*cols).withColumn("split", F.lit("train")))
    rows.write.mode("error").partitionBy("split").format(fmt).save(f"{out.rstrip('/')}/{variant}")
