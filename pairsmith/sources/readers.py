"""Readers (SRC-01 .. SRC-09).  Always an explicit schema; never inference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import stage
from pyspark.sql import types as T

TSV_COLUMNS = ("sentence1", "sentence2", "gold_label")


def read_json_array(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A file holding one top-level JSON array: one row per record.  Not
    splittable (a file is one task): convert once to Parquet for reuse."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """JSON Lines (splittable; ``.gz`` is decoded natively)."""
    return spark.read.schema(schema).json(path)


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType, header: bool = True,
             multiline: bool = False) -> DataFrame:
    """CSV with a header.  Splittable by default; ``multiline`` for files whose
    quoted fields hold line ends, one task per file then."""
    return spark.read.schema(schema).csv(path, header=header, multiLine=multiline, escape='"')


def read_tsv(spark: SparkSession, path: str, columns=TSV_COLUMNS) -> DataFrame:
    """Tab-separated, quoting off, blanks kept as empty strings, the named
    columns only (by position: the first ``len(columns)`` fields)."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    df = spark.read.schema(schema).csv(path, sep="\t", quote="", header=False, enforceSchema=True)
    return df.fillna("")


def _xz_lines(batches):
    """Executor side: decompress each file in steps.  JSON Lines go out line by
    line in small batches; an array file has to be parsed whole."""
    import io
    import json
    import lzma

    import pandas as pd
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"]):
            with io.TextIOWrapper(lzma.open(io.BytesIO(content)), encoding="utf-8") as text:
                lines = (x for x in text if x.strip()) if path.endswith((".jsonl.xz", ".jl.xz")) else map(json.dumps, json.load(text))
                held = []
                for line in lines:
                    held.append((path, line))
                    if len(held) == 4096:
                        yield pd.DataFrame(held, columns=["path", "value"])
                        held = []
                yield pd.DataFrame(held, columns=["path", "value"])


def read_xz_json(spark: SparkSession, path: str, schema: str | T.StructType,
                 partitions: int | None = None) -> DataFrame:
    """xz-compressed JSON array or JSON Lines files.  Spark has no xz codec:
    files are read as binary, decompressed per file in Arrow batches on the
    executors (one task per file, as the format is not splittable), parsed with
    ``from_json`` and redistributed."""
    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    text = raw.mapInPandas(_xz_lines, "path string, value string")
    st = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    rows = text.select(F.from_json("value", st).alias("r")).select("r.*")
    return rows.repartition(partitions) if partitions else rows


def read_by_extension(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Reader chosen by file extension (SRC-06)."""
    p = path.lower()
    if p.endswith(".tsv") or p.endswith(".tsv.gz"):
        return read_tsv(spark, path)
    if p.endswith(".xz"):
        return read_xz_json(spark, path, schema)
    if p.endswith((".jsonl", ".jsonl.gz", ".jl")):
        return read_jsonl(spark, path, schema)
    if p.endswith((".json", ".json.gz")):
        return read_json_array(spark, path, schema)
    raise ValueError(f"unknown extension: {path}")


def read_glob(spark: SparkSession, root: str, pattern: str, schema: str | T.StructType, name_filter: str | None = None,
              always: str = "test", json_array: bool = True) -> DataFrame:
    """Files matching ``pattern`` under ``root`` with their names (the path
    below ``root``), kept when the name holds ``name_filter`` or ``always``
    (SRC-07)."""
    reader = spark.read.schema(schema).option("multiLine", json_array)
    top = root.rstrip("/") + "/"
    tail = top[top.index("/", top.index("://") + 3):] if "://" in top else top
    name = F.substring_index(F.url_decode(F.col("_metadata.file_path")), tail, -1)
    df = reader.json(top + pattern).withColumn("file", name)
    if name_filter:
        df = df.where(F.col("file").contains(name_filter) | F.col("file").contains(always))
    return df


def read_gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """JSON objects country -> [cities], one or more files, as (country, city)
    rows (SRC-09); a country without cities gives one row with a null city."""
    txt = spark.read.text(path, wholetext=True)
    m = txt.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("country", "cities"))
    return m.select("country", F.explode_outer("cities").alias("city"))


def read_name_list(spark: SparkSession, path: str) -> DataFrame:
    """JSON array of names -> distinct lower-case ``name`` rows."""
    txt = spark.read.text(path, wholetext=True)
    return txt.select(F.explode(F.from_json("value", "array<string>")).alias("name")) \
        .select(F.lower("name").alias("name")).distinct()


def with_file_order(df: DataFrame, out: str = "file_order") -> DataFrame:
    """Number rows as they are read (WIN-01): rising inside a file, unique over
    all files, not gapless.  Call it on the reader's result before anything
    that moves rows; a file cut in splits keeps its order, as splits of a file
    are numbered from its start."""
    return df.withColumn("file", F.col("_metadata.file_path")) \
        .withColumn(out, F.struct(F.col("_metadata.file_block_start").alias("block"),
                                  F.monotonically_increasing_id().alias("row")))


def with_row_numbers(df: DataFrame, out: str = "row_no", in_file: str = "file_idx") -> DataFrame:
    """Number rows 0, 1, ... without gaps as they stand in the files, files by
    path (WIN-01): ``out`` over all files, ``in_file`` inside each ``file``.
    Call it on the reader's result before anything that moves or drops rows.

    Two passes: the rows are written once with their file, the start of their
    file split and a number that rises inside the split, then counts per split
    become offsets.  Only one row per split is ordered over all files (the
    splits of a file in its own window), never the rows."""
    df = stage(df.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__block"),
                         F.monotonically_increasing_id().alias("__at")), "numbered")
    splits = df.groupBy("file", "__block").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    inside = Window.partitionBy("file").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    splits = stage(splits.withColumn("__before", F.coalesce(F.sum("__n").over(inside), F.lit(0))), "splits")
    up = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = splits.groupBy("file").agg(F.sum("__n").alias("__t")) \
        .select("file", F.coalesce(F.sum("__t").over(up), F.lit(0)).alias("__base"))  # one row per file
    offsets = splits.join(files, "file").select("file", "__block", "__first", "__before", "__base")
    in_split = F.col("__at") - F.col("__first")  # rows of a split are read one after the other
    return df.join(offsets, ["file", "__block"]).withColumn(in_file, F.col("__before") + in_split) \
        .withColumn(out, F.col("__base") + F.col(in_file)).drop("__block", "__at", "__first", "__before", "__base")
