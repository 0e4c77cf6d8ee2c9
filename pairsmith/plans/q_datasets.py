"""Dataset registry, metadata flattening, hybrid directories, and the readers
that take whole directories: each query writes the shape Spark derived from
the given tables and reads it back with the reader under test."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import datasets, mixing
from ..operators import runs as R
from ..operators import split as S
from ..session import read_table, scratch_path, stage
from ..sources import readers, writers
from .bindings import DEDUP_SQL, EXCLUDED_SUPPLIERS, split_sql
from .catalog import query
from .q_io import DEDUP_COLS, SAMPLE_SCHEMA
from .q_locations import GAZ_SQL, gazetteer_raw
from .q_mix import CORPUS_SQL, corpus
from .q_prepare import _TYPES_SQL, SPLIT3_SQL, deduped
from .q_runs import LINES_SQL, run_lines

META = ("row_id", "worker_id", "hit_id", "section", "item", "seq")
ARRAY_ROWS = 4096


def nested_samples(spark, sf_dir):
    """Deduplicated pairs in the record shape: text columns and a metadata struct."""
    return deduped(spark, sf_dir).select("premise", "hypothesis", "label", F.struct(*META).alias("metadata"))


def nested_corpus(spark, sf_dir):
    c = corpus(spark, sf_dir).where(F.col("gold_label") != "-")
    c = c.groupBy("sentence1", "sentence2").agg(F.min("seq").alias("seq"), F.min_by("gold_label", "seq").alias("gold_label"))
    return mixing.harmonise(c).select("premise", "hypothesis", "label",
                                      F.struct(F.concat_ws("\u0001", "premise", "hypothesis").alias("pair")).alias("metadata"))


datasets.register_dataset(datasets.DatasetSpec(
    "samples", nested_samples, META, dataset_types=("dataset_simple", "dataset_creative", "dataset_full"),
    excluded_workers=EXCLUDED_SUPPLIERS))
datasets.register_dataset(datasets.DatasetSpec("turns", nested_corpus, ("pair",), group="pair"))


@query("flatten_metadata", "WITH " + DEDUP_SQL + """
SELECT premise, hypothesis, label, row_id, item FROM dedup""", ("PRJ-01",))
def q_flatten_metadata(spark, sf_dir):
    return datasets.flatten_metadata(nested_samples(spark, sf_dir), ("row_id", "item")).drop("metadata")


@query("flatten_all_metadata", "WITH " + DEDUP_SQL + f"\nSELECT {DEDUP_COLS} FROM dedup", ("PRJ-02",))
def q_flatten_all_metadata(spark, sf_dir):
    return datasets.flatten_all_metadata(nested_samples(spark, sf_dir)).select(*DEDUP_COLS.split(", "))


def _prepare_sql():
    corpus_only = CORPUS_SQL[:CORPUS_SQL.index("keyed AS")].rstrip().rstrip(",")
    turns = corpus_only + """,
turns AS (SELECT sentence1 AS premise, sentence2 AS hypothesis, concat_ws(chr(1), sentence1, sentence2) AS pair
          FROM corpus WHERE gold_label <> '-' GROUP BY ALL)""" + split_sql(
        "turns", "pair", S.SEED_3WAY, S.FRACTIONS_3WAY, "turn_rows")
    return "WITH " + SPLIT3_SQL + "," + _TYPES_SQL + "," + turns + """
SELECT 'samples' AS dataset, dataset_type, split, CAST(count(*) AS BIGINT) AS n_rows,
       CAST(count(DISTINCT row_id) AS BIGINT) AS n_groups FROM typed GROUP BY dataset_type, split
UNION ALL
SELECT 'turns', 'dataset_creative', split, CAST(count(*) AS BIGINT), CAST(count(DISTINCT pair) AS BIGINT)
FROM turn_rows GROUP BY split"""


@query("prepare_all_datasets", _prepare_sql(), ("SRC-11", "UDF-05", "SNK-01", "AGG-07"))
def q_prepare_all_datasets(spark, sf_dir):
    """Every registered dataset, written by the partitioned writer, read back."""
    p = scratch_path(spark, "prepared")
    writers.write_splits(datasets.prepare_all(spark, sf_dir), p)
    back = spark.read.schema("group string, premise string, hypothesis string, label string, dataset string, "
                             "dataset_type string, split string").json(p)
    return back.groupBy("dataset", "dataset_type", "split").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_rows"), F.count_distinct("group").cast("bigint").alias("n_groups"))


@query("hybrid_directory", "WITH " + SPLIT3_SQL + "," + CORPUS_SQL + """
SELECT split, premise, hypothesis, label FROM split_rows
UNION ALL SELECT 'train', sentence1, sentence2, gold_label FROM corpus""", ("SNK-07", "SET-01", "PRJ-03"))
def q_hybrid_directory(spark, sf_dir):
    from .q_prepare import split3
    p = scratch_path(spark, "hybrid")
    base = split3(spark, sf_dir).select("premise", "hypothesis", "label", "split")
    datasets.write_hybrid(base, mixing.harmonise(corpus(spark, sf_dir)), p, "full_corpus")
    return spark.read.schema("premise string, hypothesis string, label string, split string").json(f"{p}/full_corpus") \
        .select("split", "premise", "hypothesis", "label")


def _write_arrays(rows, path):
    """JSON array files of at most ``ARRAY_ROWS`` sequence numbers each."""
    part = F.floor(F.col("seq") / ARRAY_ROWS).alias("part")
    arrays = rows.groupBy(part).agg(F.to_json(F.collect_list(F.struct(*rows.columns))).alias("value"))
    arrays.repartition("part").write.partitionBy("part").text(path)


@query("read_json_array", "WITH " + DEDUP_SQL + f"\nSELECT {DEDUP_COLS} FROM dedup", ("SRC-01",))
def q_read_json_array(spark, sf_dir):
    p = scratch_path(spark, "arrays")
    _write_arrays(deduped(spark, sf_dir), p)
    return readers.read_json_array(spark, p, SAMPLE_SCHEMA).select(*DEDUP_COLS.split(", "))


@query("read_by_extension", "WITH " + DEDUP_SQL + """
SELECT ext, premise, hypothesis, label FROM dedup, (VALUES ('jsonl'), ('json'), ('tsv')) AS t(ext)""", ("SRC-06", "SRC-05"))
def q_read_by_extension(spark, sf_dir):
    """The same rows in three formats, each reader chosen by the name's end."""
    p = scratch_path(spark, "ext")
    rows = stage(deduped(spark, sf_dir), "ext-rows")
    three = rows.select("premise", "hypothesis", "label")
    writers.write_jsonl(three, f"{p}/rows.jsonl")
    _write_arrays(rows, f"{p}/rows.json")
    three.write.csv(f"{p}/rows.tsv", sep="\t", quote="", emptyValue="")
    out = None
    for ext in ("jsonl", "json", "tsv"):
        got = readers.read_by_extension(spark, f"{p}/rows.{ext}", "premise string, hypothesis string, label string")
        got = got.select(F.lit(ext).alias("ext"), *[F.col(c).alias(n) for c, n in zip(got.columns, three.columns)])
        out = got if out is None else out.unionByName(got)
    return out


@query("read_glob", "WITH " + SPLIT3_SQL + """
SELECT split, CAST(count(*) AS BIGINT) AS n_rows, true AS one_name_per_split FROM split_rows
WHERE split IN ('dev', 'test') GROUP BY split""", ("SRC-07",))
def q_read_glob(spark, sf_dir):
    """Files of the parts whose names hold 'dev', and the test files always."""
    from .q_prepare import split3
    p = scratch_path(spark, "glob")
    rows = split3(spark, sf_dir).select("premise", "hypothesis", "split")
    rows.withColumn("file", F.concat("split", F.lit("_part"))).drop("split").write.partitionBy("file").json(p)
    got = readers.read_glob(spark, p, "file=*/*.json", "premise string, hypothesis string", "dev", json_array=False)
    got = got.withColumn("split", F.regexp_extract("file", r"file=([a-z]+)_part/", 1))
    return got.groupBy("split").agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"),
                                    (F.count_distinct(F.regexp_extract("file", r"^([^/]*)/", 1)) == 1).alias("one_name_per_split"))


@query("read_logs", "WITH " + LINES_SQL + """
SELECT file, CAST(count(*) AS BIGINT) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars
FROM lines WHERE file NOT LIKE 'evalmnli%' GROUP BY file""", ("SRC-08",))
def q_read_logs(spark, sf_dir):
    """Log directories named as the runs are, scanned with their names."""
    p = scratch_path(spark, "logs")
    named = run_lines(spark, sf_dir).where(~F.startswith("file", F.lit("evalmnli")))
    named.repartition("file").write.partitionBy("file").text(p)
    return R.read_logs(spark, p).groupBy("file").agg(F.count(F.lit(1)).cast("bigint").alias("n_lines"),
                                                     F.sum(F.length("line")).cast("bigint").alias("n_chars"))


@query("read_gazetteer", "WITH " + GAZ_SQL + "\nSELECT country, city FROM gaz_raw", ("SRC-09",))
def q_read_gazetteer(spark, sf_dir):
    """JSON object files country -> cities (a country's cities over many files)."""
    p = scratch_path(spark, "gazetteer")
    raw = gazetteer_raw(spark, sf_dir).withColumn("part", F.coalesce(F.substring(F.md5("city"), 1, 2), F.lit("none")))
    lists = raw.groupBy("part", "country").agg(F.collect_list("city").alias("cities"))
    files = lists.groupBy("part").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("country", "cities")))).alias("value"))
    files.repartition("part").write.partitionBy("part").text(p)
    return readers.read_gazetteer(spark, p).select("country", "city")


@query("file_order", "WITH " + DEDUP_SQL + "\nSELECT seq, premise, hypothesis, true AS in_order FROM dedup", ("WIN-01",))
def q_file_order(spark, sf_dir):
    """Files written in order of seq: the order numbered at ingest agrees."""
    p = scratch_path(spark, "ordered")
    rows = deduped(spark, sf_dir).select("seq", "premise", "hypothesis")
    rows.repartitionByRange("seq").sortWithinPartitions("seq", "premise", "hypothesis").write.json(p)
    got = readers.with_file_order(readers.read_jsonl(spark, p, "seq bigint, premise string, hypothesis string"))
    by = Window.partitionBy("file")  # one written file
    before = F.lag("seq").over(by.orderBy("file_order"))
    return got.select("seq", "premise", "hypothesis", (F.coalesce(before, F.col("seq")) <= F.col("seq")).alias("in_order"))


@query("row_numbers", """
WITH d AS (SELECT doc_id, CAST(floor(doc_id / 400) AS BIGINT) AS part FROM documents WHERE doc_id IS NOT NULL)
SELECT doc_id, CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS row_no,
       CAST(row_number() OVER (PARTITION BY part ORDER BY doc_id) - 1 AS BIGINT) AS file_idx FROM d""", ("WIN-01",))
def q_row_numbers(spark, sf_dir):
    """Documents written to one file per 400 ids, read back and numbered: over all files and inside each."""
    p = scratch_path(spark, "row-numbers")
    d = read_table(spark, sf_dir, "documents").where("doc_id IS NOT NULL").select("doc_id", F.floor(F.col("doc_id") / 400).alias("n"))
    d = d.withColumn("part", F.format_string("%012d", "n")).drop("n")
    d.repartition("part").sortWithinPartitions("part", "doc_id").write.partitionBy("part").json(p)
    got = readers.with_row_numbers(spark.read.schema("doc_id bigint").json(p + "/*"))
    return got.select("doc_id", "row_no", "file_idx")
