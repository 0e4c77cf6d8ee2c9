"""Run logs and result tables (STR-17..20, AGG-16..18, J-19, SRT-01, SRC-07/08).

Logs are handled as ``(file, line)`` rows — what ``spark.read.text`` gives
with the file name attached — so a huge log is split across tasks and every
per-log figure is a partial aggregate, never a whole file in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import percent2

# Metric line patterns, success marker, name layout.
EVAL_METRIC = r"allennlp.commands.evaluate - accuracy: ([0-9.]+)"
TRAIN_METRIC = r'"best_validation_accuracy": ([0-9.]+)'
SUCCESS_MARKER = '"best_validation_loss": '
ACC_LINES = r'allennlp.commands.evaluate - accuracy:|"validation_accuracy":|"training_accuracy":'
EVAL_TAG = "__eval__"
TRAIN_EVALSET = "best_training_val"


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """(file, line) rows of every log under ``path`` (line mode: splittable).  A
    log is a file, or a directory of part files, whose name ends in ``.log``."""
    name = F.regexp_extract(F.url_decode(F.col("_metadata.file_path")), r"([^/=]+\.log)(?:/[^/]*)?$", 1)
    return spark.read.option("recursiveFileLookup", True).text(path).select(name.alias("file"), F.col("value").alias("line"))


def parse_run_name(file: Column) -> Column:
    """``x__dataset__trainset__epochs__lr[__eval__evalset].log`` -> struct;
    null fields (``ok`` false) when the name has neither 5 nor 7 parts."""
    parts = F.split(file, "__")
    n = F.size(parts)
    strip = lambda c: F.substring_index(c, ".log", 1)  # text before the first ".log"
    is_eval = F.contains(file, F.lit(EVAL_TAG))
    ok = F.when(is_eval, n == 7).otherwise(n == 5)
    get = lambda i: F.try_element_at(parts, F.lit(i))
    return F.struct(
        ok.alias("ok"), is_eval.alias("is_eval"),
        F.when(ok, get(2)).alias("dataset_name"), F.when(ok, get(3)).alias("trainset_name"),
        F.when(ok, get(4)).alias("num_epochs"),
        F.when(ok, F.when(is_eval, get(5)).otherwise(strip(get(5)))).alias("lr"),
        F.when(ok, F.when(is_eval, strip(get(7))).otherwise(F.lit(TRAIN_EVALSET))).alias("evalset_name"))


def metric_matches(file: Column, line: Column) -> Column:
    """Metric values in a line: the evaluate pattern for eval logs, the best
    validation pattern for training logs."""
    return F.when(F.contains(file, F.lit(EVAL_TAG)), F.regexp_extract_all(line, F.lit(EVAL_METRIC), 1)) \
        .otherwise(F.regexp_extract_all(line, F.lit(TRAIN_METRIC), 1))


def parse_runs(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Return (results, quarantine).  A log gives a result row iff its name
    parses and it holds exactly one metric match (AGG-16); accuracy is a
    percent with two decimals (STR-20)."""
    per_line = lines.select("file", F.explode(metric_matches(F.col("file"), F.col("line"))).alias("acc"))
    per_file = per_line.groupBy("file").agg(F.count(F.lit(1)).alias("n_matches"),
                                            F.min("acc").alias("acc"))
    files = lines.select("file").distinct()
    j = files.join(per_file, "file", "left").withColumn("meta", parse_run_name(F.col("file")))
    good = (F.col("meta.ok") & (F.coalesce("n_matches", F.lit(0)) == 1))
    results = j.where(good).select(
        "file", "meta.dataset_name", "meta.trainset_name", "meta.num_epochs", "meta.lr", "meta.evalset_name",
        percent2(F.col("acc").cast("double")).alias("acc"))
    quarantine = j.where(~good).select(
        "file", F.when(~F.col("meta.ok"), F.lit("bad_name")).otherwise(F.lit("metric_count")).alias("reason"),
        F.coalesce("n_matches", F.lit(0)).cast("bigint").alias("n_matches"))
    return results, quarantine


def success_counts(lines: DataFrame, marker: str = SUCCESS_MARKER) -> DataFrame:
    """Per log: lines holding the success marker; zero means a failed run
    (AGG-17).  Logs with no marker line are kept with count 0."""
    return lines.groupBy("file").agg(
        F.sum(F.contains(F.col("line"), F.lit(marker)).cast("int")).cast("bigint").alias("n_success"))


def accuracy_lines(lines: DataFrame) -> DataFrame:
    """Lines reporting train / validation / evaluation accuracy (STR-18)."""
    return lines.where(F.col("line").rlike(ACC_LINES))


def grid(values: dict[str, Sequence[str] | Column]) -> Column:
    """Parameter grid as an exploded array of structs (narrow, no join):
    ``values`` maps a name to literal values."""
    combos = [{}]
    for k, vs in values.items():
        combos = [dict(c, **{k: v}) for c in combos for v in vs]
    return F.explode(F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in c.items()]) for c in combos]))


def run_coverage(expected: DataFrame, success: DataFrame,
                 keys: Sequence[str] = ("dataset_name", "trainset_name", "num_epochs", "lr")) -> DataFrame:
    """Expected runs matched with parsed logs (J-19): ``missing`` (no log),
    ``failed`` (log without the success marker), ``done``."""
    named = success.withColumn("meta", parse_run_name(F.col("file"))).where(
        F.col("meta.ok") & ~F.col("meta.is_eval")).select(
        *[F.col(f"meta.{k}").alias(k) for k in keys], "n_success")
    per_key = named.groupBy(*keys).agg(F.max("n_success").alias("n_success"))
    j = expected.join(per_key, list(keys), "left")
    status = F.when(F.col("n_success").isNull(), "missing").when(F.col("n_success") == 0, "failed") \
        .otherwise("done")
    return j.select(*keys, status.alias("status"))


def eval_coverage(trained: DataFrame, eval_sets: DataFrame, lines: DataFrame,
                  keys: Sequence[str] = ("dataset_name", "trainset_name", "num_epochs", "lr")) -> DataFrame:
    """Evaluations that the runs ask for, two levels on from ``run_coverage``
    (J-19): every run (``trained``: keys, status) times the evaluation sets of
    its dataset (``eval_sets``: dataset_name, evalset_name - a map to sets),
    matched with the evaluation logs.

    ``blocked``: the training is not done; ``missing``: no log; ``failed``: a
    log without an evaluation metric; ``done``.  A log of a blocked run does
    not count.  A dataset without evaluation sets asks for none."""
    logs = lines.withColumn("meta", parse_run_name(F.col("file"))).where(F.col("meta.ok") & F.col("meta.is_eval"))
    seen = logs.groupBy(*[F.col(f"meta.{k}").alias(k) for k in (*keys, "evalset_name")]).agg(
        F.sum(F.size(metric_matches(F.col("file"), F.col("line")))).alias("n_metrics"))
    asked = trained.join(eval_sets.select("dataset_name", "evalset_name").distinct(), "dataset_name")
    j = asked.join(seen, [*keys, "evalset_name"], "left")
    status = F.when(F.col("status") != "done", "blocked").when(F.col("n_metrics").isNull(), "missing") \
        .when(F.col("n_metrics") == 0, "failed").otherwise("done")
    return j.select(*keys, "evalset_name", status.alias("eval_status"))


def train_size(name: Column) -> Column:
    """Last integer among the ``_``-separated parts of a result name."""
    ints = F.filter(F.split(name, "_"), lambda x: x.rlike(r"^-?[0-9]+$"))
    return F.try_element_at(ints, F.lit(-1)).cast("bigint")


def series_name(name: Column) -> Column:
    parts = F.split(name, "_")
    return F.when(F.startswith(name, F.lit("train")), F.element_at(parts, -1)).otherwise(F.element_at(parts, 1))


def result_curves(results: DataFrame) -> DataFrame:
    """Mean accuracies per (series, corpus rows) for the learning curves
    (AGG-18, STR-19, SRT-01), sorted."""
    r = results.withColumn("mnli_train_size", train_size(F.col("filename"))) \
        .withColumn("target_set_name", series_name(F.col("filename")))
    return (r.groupBy("target_set_name", "mnli_train_size")
            .agg(F.avg("mnli_val").alias("mnli_val"), F.avg("target_set_val").alias("target_set_val"),
                 F.count(F.lit(1)).cast("bigint").alias("n"))
            .orderBy("target_set_name", "mnli_train_size"))
