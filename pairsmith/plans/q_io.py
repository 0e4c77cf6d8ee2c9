"""Source / sink round trips and incremental writes over derived tables.

Each query writes a table Spark derived from the driver's data into a fresh
folder under the shared checkpoint directory, reads it back with the reader
under test and returns what it read, so the result can be checked against
the same derivation in SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch_path, stage
from ..sources import readers, writers
from ..streaming import incremental
from .bindings import DEDUP_SQL
from .catalog import query
from .q_mix import CORPUS_SQL, corpus
from .q_prepare import SPLIT3_SQL, deduped, split3

SAMPLE_SCHEMA = ("premise string, hypothesis string, label string, row_id bigint, worker_id string, "
                 "hit_id string, section string, item string, seq bigint")
DEDUP_COLS = "premise, hypothesis, label, row_id, worker_id, hit_id, section, item, seq"


def _tmp(spark, what: str) -> str:
    return scratch_path(spark, f"io-{what}")


@query("read_roundtrip_jsonl", "WITH " + DEDUP_SQL + f"\nSELECT {DEDUP_COLS} FROM dedup", ("SRC-02", "SNK-02"))
def q_read_roundtrip_jsonl(spark, sf_dir):
    p = _tmp(spark, "jsonl")
    writers.write_jsonl(deduped(spark, sf_dir), p)
    return readers.read_jsonl(spark, p, SAMPLE_SCHEMA)


@query("read_roundtrip_json_gz", "WITH " + DEDUP_SQL + f"\nSELECT {DEDUP_COLS} FROM dedup", ("SNK-04", "SRC-02"))
def q_read_roundtrip_json_gz(spark, sf_dir):
    p = _tmp(spark, "jsongz")
    writers.write_json_gz(deduped(spark, sf_dir), p)
    return readers.read_jsonl(spark, p, SAMPLE_SCHEMA)


@query("read_roundtrip_csv", "WITH " + CORPUS_SQL + """
SELECT seq, sentence1, sentence2, gold_label, genre FROM corpus""", ("SRC-04", "SNK-03"))
def q_read_roundtrip_csv(spark, sf_dir):
    p = _tmp(spark, "csv")
    writers.write_csv(corpus(spark, sf_dir), p)   # texts hold newlines and quotes
    return readers.read_csv(spark, p, "seq bigint, sentence1 string, sentence2 string, gold_label string, "
                                      "genre string", multiline=True)


@query("read_roundtrip_tsv", "WITH " + CORPUS_SQL + r"""
SELECT regexp_replace(sentence1, '[\t\r\n]', ' ', 'g') AS sentence1,
       regexp_replace(sentence2, '[\t\r\n]', ' ', 'g') AS sentence2, gold_label FROM corpus""", ("SRC-05",))
def q_read_roundtrip_tsv(spark, sf_dir):
    p = _tmp(spark, "tsv")
    c = corpus(spark, sf_dir).select(
        F.regexp_replace("sentence1", r"[\t\r\n]", " ").alias("sentence1"),
        F.regexp_replace("sentence2", r"[\t\r\n]", " ").alias("sentence2"), "gold_label", "genre")
    c.write.mode("overwrite").option("sep", "\t").option("quote", "").option("escape", "") \
        .option("emptyValue", "").csv(p)
    return readers.read_tsv(spark, p)


@query("split_files_write", "WITH " + SPLIT3_SQL + """
SELECT 'samples' AS dataset, split, CAST(count(*) AS BIGINT) AS n_rows FROM split_rows GROUP BY split""",
       ("SNK-01",))
def q_split_files_write(spark, sf_dir):
    p = _tmp(spark, "splits")
    df = split3(spark, sf_dir).withColumn("dataset", F.lit("samples")).withColumn("dataset_type", F.lit("dataset_full"))
    writers.write_splits(df, p)
    back = spark.read.schema(SAMPLE_SCHEMA + ", dataset string, dataset_type string, split string").json(p)
    return back.groupBy("dataset", "split").agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"))


@query("resume_append", "WITH " + DEDUP_SQL + f"\nSELECT {DEDUP_COLS} FROM dedup", ("SNK-05", "J-18"))
def q_resume_append(spark, sf_dir):
    """A first run stored part of the rows and stopped; the resumed run stores
    only the missing keys; the table read back holds every row once."""
    p = _tmp(spark, "resume")
    rows = stage(deduped(spark, sf_dir), "dedup")
    incremental.resume_append(rows.where(F.col("seq") % 3 == 0), p, ["premise", "hypothesis"])
    return incremental.resume_append(rows, p, ["premise", "hypothesis"]).select(*DEDUP_COLS.split(", "))


@query("memo_cache", "WITH " + DEDUP_SQL + """
SELECT DISTINCT to_base64(unhex(md5(premise))) || '|' || to_base64(unhex(md5(hypothesis))) || '|' || 'isa' AS cache_key,
       length(premise) + length(hypothesis) AS value,
       CASE WHEN substr(md5(to_base64(unhex(md5(premise))) || '|' || to_base64(unhex(md5(hypothesis))) || '|' || 'isa'), 1, 1)
            < '8' THEN 1 ELSE 2 END AS run
FROM dedup""", ("SNK-06", "J-18", "STR-16"))
def q_memo_cache(spark, sf_dir):
    """Memo table of per-pair values keyed by the cache key: a first run stores
    half the keys (by hash); in the second those are hits and keep the first
    run's number, only the misses get its own."""
    from ..functions.text import cache_key
    p = _tmp(spark, "memo")
    pairs = stage(deduped(spark, sf_dir).select(cache_key("premise", "hypothesis", F.lit("isa")).alias("cache_key"),
                                                (F.length("premise") + F.length("hypothesis")).alias("value")), "memo-pairs")

    def compute(keys, run):
        return keys.join(pairs.groupBy("cache_key").agg(F.min("value").alias("value")), "cache_key") \
            .withColumn("run", F.lit(run))

    first = pairs.where(F.substring(F.md5("cache_key"), 1, 1) < "8").select("cache_key")
    incremental.memo_lookup(first, p, "cache_key", lambda k: compute(k, 1)).count()
    return incremental.memo_lookup(pairs.select("cache_key"), p, "cache_key", lambda k: compute(k, 2))
