"""Run-log and results queries over ``events``.

One log per (event_type, user, day): the name encodes dataset = event type,
train set and hyper-parameters from the user id, and every fifth day is an
evaluation log; days divisible by 7 give a 3-part name (a bad name).  Each
event is one log line: a metric line, a success marker or an accuracy line,
chosen by its id; the number is the event value as ``0.dddd``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import runs as R
from ..session import read_table
from .catalog import query

TRAINSETS = ("dataset_creative", "mnli_10k_split")
EPOCHS = ("2", "3", "4")
LRS = ("2e-05", "3e-05", "5e-05")
SIZES = (0, 100, 500, 1000, 2000, 5000, 10000, 100000, 400000)


def run_lines(spark, sf_dir):
    e = read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    day = F.dayofmonth("ts")
    u = F.col("user_id")
    trainset = F.element_at(F.array(*[F.lit(x) for x in TRAINSETS]), (u % 2 + 1).cast("int"))
    epochs = F.element_at(F.array(*[F.lit(x) for x in EPOCHS]), (u % 3 + 1).cast("int"))
    lr = F.element_at(F.array(*[F.lit(x) for x in LRS]), (F.floor(u / 3) % 3 + 1).cast("int"))
    base = F.concat_ws("__", F.lit("kbmodel"), "event_type", trainset, epochs, lr)
    name = F.when(day % 7 == 0, F.concat(F.lit("evalmnli__"), F.col("event_type"), F.lit("__"),
                                         u.cast("string"), F.lit(".log"))) \
        .when(day % 5 == 0, F.concat(base, F.lit("__eval__"), F.lit("testset"), F.lpad(day.cast("string"), 2, "0"),
                                     F.lit(".log"))) \
        .otherwise(F.concat(base, F.lit(".log")))
    num = F.concat(F.lit("0."), F.lpad((F.round(F.col("value") * 100).cast("bigint") % 10000).cast("string"), 4, "0"))
    k = F.col("event_id") % 6
    line = F.when(k == 0, F.when(F.contains(name, F.lit("__eval__")),
                                 F.concat(F.lit("allennlp.commands.evaluate - accuracy: "), num))
                  .otherwise(F.concat(F.lit('"best_validation_accuracy": '), num))) \
        .when(k == 1, F.concat(F.lit('"best_validation_loss": '), num)) \
        .when(k == 2, F.concat(F.lit('"training_accuracy": '), num)) \
        .when(k == 3, F.concat(F.lit('"validation_accuracy": '), num)) \
        .otherwise(F.concat(F.lit("step "), F.col("event_id").cast("string")))
    return e.select(name.alias("file"), line.alias("line"))


_DAY = "dayofmonth(ts)"
_BASE = ("'kbmodel__' || event_type || '__' || ['dataset_creative','mnli_10k_split'][user_id % 2 + 1] || '__' || "
         "['2','3','4'][user_id % 3 + 1] || '__' || ['2e-05','3e-05','5e-05'][CAST(floor(user_id / 3) AS BIGINT) % 3 + 1]")
LINES_SQL = f"""
named AS (
  SELECT event_id, value,
    CASE WHEN {_DAY} % 7 = 0 THEN 'evalmnli__' || event_type || '__' || CAST(user_id AS VARCHAR) || '.log'
         WHEN {_DAY} % 5 = 0 THEN {_BASE} || '__eval__testset' || lpad(CAST({_DAY} AS VARCHAR), 2, '0') || '.log'
         ELSE {_BASE} || '.log' END AS file,
    '0.' || lpad(CAST(CAST(round(value * 100) AS BIGINT) % 10000 AS VARCHAR), 4, '0') AS num
  FROM events
),
lines AS (
  SELECT file, CASE event_id % 6
    WHEN 0 THEN CASE WHEN contains(file, '__eval__') THEN 'allennlp.commands.evaluate - accuracy: ' || num
                     ELSE '"best_validation_accuracy": ' || num END
    WHEN 1 THEN '"best_validation_loss": ' || num
    WHEN 2 THEN '"training_accuracy": ' || num
    WHEN 3 THEN '"validation_accuracy": ' || num
    ELSE 'step ' || CAST(event_id AS VARCHAR) END AS line
  FROM named
)"""

_PARSE_SQL = LINES_SQL + r""",
m AS (
  SELECT file, unnest(CASE WHEN contains(file, '__eval__')
                           THEN regexp_extract_all(line, 'allennlp.commands.evaluate - accuracy: ([0-9.]+)', 1)
                           ELSE regexp_extract_all(line, '"best_validation_accuracy": ([0-9.]+)', 1) END) AS acc
  FROM lines
),
per_file AS (SELECT file, count(*) AS n_matches, min(acc) AS acc FROM m GROUP BY file),
files AS (SELECT DISTINCT file FROM lines),
parsed AS (
  SELECT f.file, p.n_matches, p.acc, string_split(f.file, '__') AS parts, contains(f.file, '__eval__') AS is_eval,
         CASE WHEN contains(f.file, '__eval__') THEN len(string_split(f.file, '__')) = 7
              ELSE len(string_split(f.file, '__')) = 5 END AS ok
  FROM files f LEFT JOIN per_file p ON p.file = f.file
)"""


@query("run_parse", "WITH " + _PARSE_SQL + """
SELECT file, parts[2] AS dataset_name, parts[3] AS trainset_name, parts[4] AS num_epochs,
       CASE WHEN is_eval THEN parts[5] ELSE split_part(parts[5], '.log', 1) END AS lr,
       CASE WHEN is_eval THEN split_part(parts[7], '.log', 1) ELSE 'best_training_val' END AS evalset_name,
       round(CAST(acc AS DOUBLE) * 100, 2) AS acc
FROM parsed WHERE ok AND coalesce(n_matches, 0) = 1""", ("STR-17", "STR-18", "STR-20", "AGG-16"))
def q_run_parse(spark, sf_dir):
    return R.parse_runs(run_lines(spark, sf_dir))[0]


@query("run_quarantine", "WITH " + _PARSE_SQL + """
SELECT file, CASE WHEN NOT ok THEN 'bad_name' ELSE 'metric_count' END AS reason,
       CAST(coalesce(n_matches, 0) AS BIGINT) AS n_matches
FROM parsed WHERE NOT (ok AND coalesce(n_matches, 0) = 1)""", ("AGG-16", "STR-17"))
def q_run_quarantine(spark, sf_dir):
    return R.parse_runs(run_lines(spark, sf_dir))[1]


@query("run_failed", "WITH " + LINES_SQL + """
SELECT file, CAST(sum(CASE WHEN contains(line, '"best_validation_loss": ') THEN 1 ELSE 0 END) AS BIGINT) AS n_success
FROM lines GROUP BY file""", ("AGG-17",))
def q_run_failed(spark, sf_dir):
    return R.success_counts(run_lines(spark, sf_dir))


@query("run_accuracy_lines", "WITH " + LINES_SQL + """
SELECT file, line FROM lines
WHERE regexp_matches(line, 'allennlp.commands.evaluate - accuracy:|"validation_accuracy":|"training_accuracy":')""",
       ("STR-18",))
def q_run_accuracy_lines(spark, sf_dir):
    return R.accuracy_lines(run_lines(spark, sf_dir))


_COVERAGE_SQL = """,
succ AS (SELECT file, sum(CASE WHEN contains(line, '"best_validation_loss": ') THEN 1 ELSE 0 END) AS n_success
         FROM lines GROUP BY file),
trainlogs AS (SELECT string_split(file, '__') AS p, n_success FROM succ
          WHERE NOT contains(file, '__eval__') AND len(string_split(file, '__')) = 5),
per_key AS (SELECT p[2] AS dataset_name, p[3] AS trainset_name, p[4] AS num_epochs,
                   split_part(p[5], '.log', 1) AS lr, max(n_success) AS n_success FROM trainlogs GROUP BY ALL),
expected AS (
  SELECT d.event_type AS dataset_name, t.trainset_name, e.num_epochs, l.lr
  FROM (SELECT DISTINCT event_type FROM events) d,
       (SELECT unnest(['dataset_creative', 'mnli_10k_split']) AS trainset_name) t,
       (SELECT unnest(['2', '3', '4']) AS num_epochs) e,
       (SELECT unnest(['2e-05', '3e-05', '5e-05']) AS lr) l)
SELECT x.dataset_name, x.trainset_name, x.num_epochs, x.lr,
       CASE WHEN k.n_success IS NULL THEN 'missing' WHEN k.n_success = 0 THEN 'failed' ELSE 'done' END AS status
FROM expected x LEFT JOIN per_key k USING (dataset_name, trainset_name, num_epochs, lr)"""


@query("run_coverage", "WITH " + LINES_SQL + _COVERAGE_SQL, ("J-19",))
def q_run_coverage(spark, sf_dir):
    lines = run_lines(spark, sf_dir)
    datasets = read_table(spark, sf_dir, "events").select(F.col("event_type").alias("dataset_name")).distinct()
    expected = datasets.select("dataset_name", R.grid({"trainset_name": TRAINSETS, "num_epochs": EPOCHS,
                                                       "lr": LRS}).alias("g")).select("dataset_name", "g.*")
    return R.run_coverage(expected, R.success_counts(lines))


# evaluation sets of a dataset in this binding: three for all, a fourth by the length of its name
EVAL_SETS = ("testset05", "testset10", "testset15")
MORE_SETS = "testset20"


@query("eval_coverage", "WITH " + LINES_SQL + ",\ncov AS (WITH " + _COVERAGE_SQL.lstrip(",\n") + """),
es AS (SELECT DISTINCT event_type AS dataset_name,
              unnest(['testset05', 'testset10', 'testset15'] || CASE WHEN length(event_type) % 2 = 0 THEN ['testset20'] ELSE [] END) AS evalset_name
       FROM events),
ev AS (SELECT p[2] AS dataset_name, p[3] AS trainset_name, p[4] AS num_epochs, p[5] AS lr, split_part(p[7], '.log', 1) AS evalset_name,
              sum(len(regexp_extract_all(line, 'allennlp.commands.evaluate - accuracy: ([0-9.]+)', 1))) AS n_metrics
       FROM (SELECT string_split(file, '__') AS p, line FROM lines WHERE contains(file, '__eval__') AND len(string_split(file, '__')) = 7)
       GROUP BY ALL)
SELECT c.dataset_name, c.trainset_name, c.num_epochs, c.lr, es.evalset_name,
       CASE WHEN c.status <> 'done' THEN 'blocked' WHEN ev.n_metrics IS NULL THEN 'missing' WHEN ev.n_metrics = 0 THEN 'failed'
            ELSE 'done' END AS eval_status
FROM cov c JOIN es USING (dataset_name) LEFT JOIN ev USING (dataset_name, trainset_name, num_epochs, lr, evalset_name)""", ("J-19",))
def q_eval_coverage(spark, sf_dir):
    datasets = read_table(spark, sf_dir, "events").select(F.col("event_type").alias("dataset_name")).distinct()
    more = F.when(F.length("dataset_name") % 2 == 0, F.array(F.lit(MORE_SETS))).otherwise(F.array().cast("array<string>"))
    sets = datasets.select("dataset_name", F.explode(F.concat(F.array(*[F.lit(x) for x in EVAL_SETS]), more)).alias("evalset_name"))
    return R.eval_coverage(q_run_coverage(spark, sf_dir), sets, run_lines(spark, sf_dir))


def results_table(spark, sf_dir):
    """Result rows named like ``<series>_train_<n>`` / ``train_<n>_<series>``."""
    e = read_table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    n = F.element_at(F.array(*[F.lit(x) for x in SIZES]), (F.col("user_id") % len(SIZES) + 1).cast("int"))
    series = F.col("event_type")
    name = F.when(F.col("event_id") % 2 == 0, F.concat(series, F.lit("_train_"), n.cast("string"))) \
        .otherwise(F.concat(F.lit("train_"), n.cast("string"), F.lit("_"), series))
    return e.select(name.alias("filename"), (F.col("value") / 100).alias("mnli_val"),
                    ((F.col("event_id") % 100) / 100.0).alias("target_set_val"))


@query("result_curves", """
WITH r AS (
  SELECT CASE WHEN event_id % 2 = 0
              THEN event_type || '_train_' || CAST([0, 100, 500, 1000, 2000, 5000, 10000, 100000, 400000][user_id % 9 + 1] AS VARCHAR)
              ELSE 'train_' || CAST([0, 100, 500, 1000, 2000, 5000, 10000, 100000, 400000][user_id % 9 + 1] AS VARCHAR) || '_' || event_type END AS filename,
         value / 100 AS mnli_val, (event_id % 100) / 100.0 AS target_set_val
  FROM events),
p AS (
  SELECT *, CAST(list_filter(string_split(filename, '_'), lambda x: regexp_matches(x, '^-?[0-9]+$'))[-1] AS BIGINT) AS mnli_train_size,
         CASE WHEN starts_with(filename, 'train') THEN string_split(filename, '_')[-1]
              ELSE string_split(filename, '_')[1] END AS target_set_name
  FROM r)
SELECT target_set_name, mnli_train_size, avg(mnli_val) AS mnli_val, avg(target_set_val) AS target_set_val,
       CAST(count(*) AS BIGINT) AS n
FROM p GROUP BY target_set_name, mnli_train_size""", ("AGG-18", "STR-19", "SRT-01"))
def q_result_curves(spark, sf_dir):
    return R.result_curves(results_table(spark, sf_dir))
