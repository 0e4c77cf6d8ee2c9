"""Dataset preparation queries: conflicts, dedup, splits, filters, checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import to_singular
from ..operators import checks, dedup, filters, split
from ..session import stage
from .bindings import DEDUP_SQL, EXCLUDED_SUPPLIERS, SAMPLES_SQL, samples, split_sql
from .catalog import query


def deduped(spark, sf_dir):
    return dedup.drop_conflicts_dedup(samples(spark, sf_dir), order_by=["seq"])


def split3(spark, sf_dir):
    # the split reads its input three times (bucket counts, cut keys, rows) and
    # callers add checks on top: the deduplicated pairs are written once as
    # Parquet, the counting passes read the one column they need
    return split.exact_group_split(stage(deduped(spark, sf_dir), "dedup"), "row_id",
                                   split.FRACTIONS_3WAY, split.SEED_3WAY)


SPLIT3_SQL = DEDUP_SQL + split_sql("dedup", "row_id", split.SEED_3WAY, split.FRACTIONS_3WAY)
SPLIT2_SQL = DEDUP_SQL + split_sql("dedup", "row_id", split.SEED_2WAY, split.FRACTIONS_2WAY)


@query("label_conflicts", "WITH " + SAMPLES_SQL + """
SELECT premise, hypothesis, CAST(count(*) AS BIGINT) AS n_rows,
       CAST(count(DISTINCT label) AS BIGINT) AS n_labels,
       (count(DISTINCT label) > 1 AND premise IS NOT NULL AND hypothesis IS NOT NULL) AS is_conflict
FROM samples GROUP BY premise, hypothesis""", ("AGG-01",))
def q_label_conflicts(spark, sf_dir):
    return dedup.label_conflicts(samples(spark, sf_dir))


@query("drop_conflicts_dedup", "WITH " + DEDUP_SQL + "\nSELECT * FROM dedup", ("J-01", "AGG-02"))
def q_drop_conflicts_dedup(spark, sf_dir):
    return deduped(spark, sf_dir)


@query("dedup_report", "WITH " + SAMPLES_SQL + """,
per_pair AS (
  SELECT premise, hypothesis, count(*) AS n,
         (min(label) <> max(label) AND premise IS NOT NULL AND hypothesis IS NOT NULL) AS c
  FROM samples GROUP BY premise, hypothesis)
SELECT CAST(sum(n) AS BIGINT) AS rows_before,
       CAST(sum(CASE WHEN coalesce(c, false) THEN 0 ELSE 1 END) AS BIGINT) AS rows_after,
       CAST(sum(CASE WHEN coalesce(c, false) THEN 1 ELSE 0 END) AS BIGINT) AS conflicting_pairs
FROM per_pair""", ("AGG-03",))
def q_dedup_report(spark, sf_dir):
    return dedup.dedup_report(samples(spark, sf_dir))


@query("pair_frequency_top5", "WITH " + SAMPLES_SQL + """,
per_pair AS (
  SELECT premise, hypothesis, CAST(count(*) AS BIGINT) AS n,
         count(DISTINCT label) + max(CASE WHEN label IS NULL THEN 1 ELSE 0 END) AS n_labels
  FROM samples GROUP BY premise, hypothesis),
totals AS (SELECT CAST(count(*) AS BIGINT) AS distinct_pairs,
                  CAST(sum(n_labels) AS BIGINT) AS distinct_pair_labels FROM per_pair)
SELECT p.premise, p.hypothesis, p.n, t.distinct_pairs, t.distinct_pair_labels,
       t.distinct_pairs <> t.distinct_pair_labels AS has_contradiction
FROM (SELECT * FROM per_pair ORDER BY n DESC, premise, hypothesis LIMIT 5) p, totals t""",
       ("AGG-04", "SRT-02"))
def q_pair_frequency_top5(spark, sf_dir):
    return dedup.pair_frequency(samples(spark, sf_dir), k=5)


@query("group_split_3way", "WITH " + SPLIT3_SQL + "\nSELECT * FROM split_rows",
       ("WIN-02", "J-02"))
def q_group_split_3way(spark, sf_dir):
    return split3(spark, sf_dir)


@query("group_split_2way", "WITH " + SPLIT2_SQL + "\nSELECT * FROM split_rows", ("WIN-02",))
def q_group_split_2way(spark, sf_dir):
    return split.exact_group_split(stage(deduped(spark, sf_dir), "dedup"), "row_id",
                                   split.FRACTIONS_2WAY, split.SEED_2WAY)


@query("split_partition_law", "WITH " + SPLIT3_SQL + """,
per_group AS (SELECT row_id, count(DISTINCT split) AS parts,
                     sum(CASE WHEN split IS NULL THEN 1 ELSE 0 END) AS unassigned
              FROM split_rows GROUP BY row_id)
SELECT CAST(count(*) AS BIGINT) AS n_groups,
       CAST(sum(CASE WHEN parts > 1 THEN 1 ELSE 0 END) AS BIGINT) AS groups_in_many_parts,
       CAST(sum(unassigned) AS BIGINT) AS rows_unassigned
FROM per_group""", ("SET-05",))
def q_split_partition_law(spark, sf_dir):
    return checks.split_partition_law(split3(spark, sf_dir), "row_id")


_TYPES_SQL = """
typed AS (
  SELECT s.*, t.dataset_type FROM split_rows s,
    unnest(list_filter([CASE WHEN regexp_matches(s.section, '^[1-3]') THEN 'dataset_simple' END,
                        CASE WHEN NOT regexp_matches(s.section, '^[1-3]') THEN 'dataset_creative' END,
                        'dataset_full'], lambda x: x IS NOT NULL)) AS t(dataset_type)
  WHERE coalesce(s.worker_id NOT IN ('3', '7'), true)
)"""


@query("split_stats", "WITH " + SPLIT3_SQL + "," + _TYPES_SQL + """
SELECT dataset_type, split, CAST(count(*) AS BIGINT) AS n_rows,
       CAST(count(DISTINCT row_id) AS BIGINT) AS n_hits
FROM typed GROUP BY dataset_type, split""", ("AGG-07", "FLT-02", "PRJ-05"))
def q_split_stats(spark, sf_dir):
    rows = filters.exclude_workers(split3(spark, sf_dir), EXCLUDED_SUPPLIERS)
    return (filters.explode_dataset_types(rows)
            .groupBy("dataset_type", "split")
            .agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"),
                 F.count_distinct("row_id").cast("bigint").alias("n_hits")))


@query("exclude_workers", "WITH " + DEDUP_SQL + """
SELECT * FROM dedup WHERE coalesce(worker_id NOT IN ('3', '7'), true)""", ("FLT-02",))
def q_exclude_workers(spark, sf_dir):
    # the guard and the rows read it: written once
    return filters.exclude_workers(stage(deduped(spark, sf_dir), "dedup"), EXCLUDED_SUPPLIERS)


@query("dataset_type_flags", "WITH " + DEDUP_SQL + """
SELECT *, regexp_matches(section, '^[1-3]') AS dataset_simple,
       NOT regexp_matches(section, '^[1-3]') AS dataset_creative, true AS dataset_full
FROM dedup""", ("PRJ-05",))
def q_dataset_type_flags(spark, sf_dir):
    return filters.dataset_type_flags(deduped(spark, sf_dir))


@query("worker_subset_guard", "WITH " + DEDUP_SQL + """
SELECT CAST(count(DISTINCT worker_id) AS BIGINT) AS workers,
       CAST(count(DISTINCT CASE WHEN worker_id IN ('3', '7') THEN worker_id END) AS BIGINT) AS excluded_present,
       count(DISTINCT CASE WHEN worker_id IN ('3', '7') THEN worker_id END) = 2
         AND count(DISTINCT worker_id) > count(DISTINCT CASE WHEN worker_id IN ('3', '7') THEN worker_id END) AS ok
FROM dedup""", ("SET-06",))
def q_worker_subset_guard(spark, sf_dir):
    return checks.worker_subset_guard(deduped(spark, sf_dir), EXCLUDED_SUPPLIERS)


# --- split on a normalised text key (WIN-03): item word, lower-cased + singular
SPLIT_TEXT_SQL = DEDUP_SQL + """,
keyed AS (SELECT *, {sing} AS split_key FROM dedup)""" + split_sql(
    "keyed", "split_key", split.SEED_3WAY, split.FRACTIONS_3WAY)


@query("split_by_text_key", None, ("WIN-03", "STR-11"))
def q_split_by_text_key(spark, sf_dir):
    keyed = stage(deduped(spark, sf_dir).withColumn("split_key", to_singular(F.lower("item"))), "dedup")
    return split.exact_group_split(keyed, "split_key", split.FRACTIONS_3WAY, split.SEED_3WAY)


def _finish_split_text_sql():
    from ..functions.text import to_singular_sql
    from .catalog import REGISTRY, QueryDef
    d = REGISTRY["split_by_text_key"]
    sql = "WITH " + SPLIT_TEXT_SQL.replace("{sing}", to_singular_sql("lower(item)")) + \
        "\nSELECT * FROM split_rows"
    REGISTRY["split_by_text_key"] = QueryDef(d.name, d.build, sql, d.operators)


_finish_split_text_sql()


# --- leak checks (J-17, SET-03, SET-07) over the 3-way split
def _leak_sql(value_exprs: list[str]) -> str:
    stacked = " UNION ALL ".join(
        f"SELECT split AS part, CAST({e} AS VARCHAR) AS value FROM split_rows" for e in value_exprs)
    return "WITH " + SPLIT3_SQL + f""",
stacked AS ({stacked})
SELECT value, array_to_string(list_sort(list(DISTINCT part)), ',') AS parts
FROM stacked WHERE value IS NOT NULL
GROUP BY value HAVING count(DISTINCT part) > 1"""


def _leaks(spark, sf_dir, cols):
    return (checks.shared_values(split3(spark, sf_dir), cols)
            .select("value", F.array_join("parts", ",").alias("parts")))


@query("leak_premise", _leak_sql(["premise"]), ("J-17", "SET-03"))
def q_leak_premise(spark, sf_dir):
    return _leaks(spark, sf_dir, ["premise"])


def _leak_words_sql():
    from ..functions.text import to_singular_sql
    return _leak_sql([to_singular_sql("lower(item)"), to_singular_sql("lower(split_part(hypothesis, ' ', 2))")])


@query("leak_words", _leak_words_sql(), ("J-17", "SET-07", "STR-11"))
def q_leak_words(spark, sf_dir):
    """Words of two fields stacked, lower-cased and singular."""
    rows = split3(spark, sf_dir).withColumn("type_word", F.split_part("hypothesis", F.lit(" "), F.lit(2)))
    return (checks.shared_values(rows, ["item", "type_word"], normalise=lambda c: to_singular(F.lower(c)))
            .select("value", F.array_join("parts", ",").alias("parts")))


@query("leak_groups", _leak_sql(["hit_id"]), ("J-17",))
def q_leak_groups(spark, sf_dir):
    return _leaks(spark, sf_dir, ["hit_id"])


@query("leak_pairs", "WITH " + SPLIT3_SQL + """
SELECT premise, hypothesis, array_to_string(list_sort(list(DISTINCT split)), ',') AS parts
FROM split_rows GROUP BY premise, hypothesis HAVING count(DISTINCT split) > 1""", ("J-17",))
def q_leak_pairs(spark, sf_dir):
    return (checks.pair_leaks(split3(spark, sf_dir))
            .select("premise", "hypothesis", F.array_join("parts", ",").alias("parts")))
