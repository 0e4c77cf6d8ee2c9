"""Bindings from the driver's TPC-H-style tables to the library's data model.

The reference's raw inputs (answer sheets, corpora) are not shipped, so each
binding derives a stand-in of the right *shape* from the given tables with
Spark, and states the same derivation in SQL for the DuckDB oracle.  Work
grows with the tables: nothing here is a fixed or sampled input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_table

# Returnflag -> NLI label.
FLAG_LABELS = {"A": "entailment", "N": "neutral", "R": "contradiction"}
EXCLUDED_SUPPLIERS = ("3", "7")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical samples view: lineitem x part x orders as labelled pairs.

    ``seq`` is the file order stand-in (order key, then line number); rows that
    tie on it produce equal output columns, so keep-first is deterministic.
    """
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag")
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    label = F.when(F.col("l_returnflag") == "A", "entailment") \
        .when(F.col("l_returnflag") == "N", "neutral") \
        .when(F.col("l_returnflag") == "R", "contradiction")
    # orders first: only keys and numbers travel by order key, the part's texts join last
    return (
        li.join(orders, li.l_orderkey == orders.o_orderkey)
        .join(part, li.l_partkey == part.p_partkey)
        .select(
            F.concat(F.lit("supplier "), F.col("l_suppkey").cast("string"), F.lit(" ships the "),
                     F.col("p_name")).alias("premise"),
            F.concat(F.lit("a "), F.lower("p_type"), F.lit(" part was shipped")).alias("hypothesis"),
            label.alias("label"),
            F.col("l_orderkey").alias("row_id"),
            F.col("l_suppkey").cast("string").alias("worker_id"),
            F.col("o_custkey").cast("string").alias("hit_id"),
            F.col("l_linenumber").cast("string").alias("section"),
            F.element_at(F.split("p_name", " "), 2).alias("item"),
            (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"),
        )
    )


SAMPLES_SQL = """
samples AS (
  SELECT 'supplier ' || CAST(l.l_suppkey AS VARCHAR) || ' ships the ' || p.p_name AS premise,
         'a ' || lower(p.p_type) || ' part was shipped' AS hypothesis,
         CASE l.l_returnflag WHEN 'A' THEN 'entailment' WHEN 'N' THEN 'neutral'
                             WHEN 'R' THEN 'contradiction' END AS label,
         l.l_orderkey AS row_id,
         CAST(l.l_suppkey AS VARCHAR) AS worker_id,
         CAST(o.o_custkey AS VARCHAR) AS hit_id,
         CAST(l.l_linenumber AS VARCHAR) AS section,
         split_part(p.p_name, ' ', 2) AS item,
         l.l_orderkey * 8 + l.l_linenumber AS seq
  FROM lineitem l
  JOIN part p ON l.l_partkey = p.p_partkey
  JOIN orders o ON l.l_orderkey = o.o_orderkey
)"""

# keep-first dedup after dropping conflicting pairs, in SQL
DEDUP_SQL = SAMPLES_SQL + """,
conflicts AS (
  SELECT premise, hypothesis FROM samples
  WHERE premise IS NOT NULL AND hypothesis IS NOT NULL
  GROUP BY premise, hypothesis HAVING count(DISTINCT label) > 1
),
ranked AS (
  SELECT s.*, row_number() OVER (PARTITION BY premise, hypothesis
                                 ORDER BY seq, label, row_id, worker_id, hit_id, section, item) AS rn
  FROM samples s
  WHERE NOT EXISTS (SELECT 1 FROM conflicts c
                    WHERE c.premise = s.premise AND c.hypothesis = s.hypothesis)
),
dedup AS (
  SELECT premise, hypothesis, label, row_id, worker_id, hit_id, section, item, seq
  FROM ranked WHERE rn = 1
)"""


def split_sql(src: str, group_expr: str, seed: str, fractions, name: str = "split_rows") -> str:
    """SQL for an exact group split: global rank of groups by the seeded key."""
    acc, cuts = 0.0, []
    for _, p in fractions[:-1]:
        acc += p
        cuts.append(repr(float(acc)))
    parts = [n for n, _ in fractions]
    cases = " ".join(
        f"WHEN g.rk < floor(g.n * CAST({c} AS DOUBLE)) THEN '{p}'" for c, p in zip(cuts, parts[:-1]))
    key = (f"md5(concat_ws('/', '{seed}', CAST({group_expr} AS VARCHAR))) || '/' || "
           f"CAST({group_expr} AS VARCHAR)")
    return f""",
{name}_keys AS (
  SELECT DISTINCT {key} AS k FROM {src} WHERE {group_expr} IS NOT NULL
),
{name}_groups AS (
  SELECT k, row_number() OVER (ORDER BY k) - 1 AS rk, count(*) OVER () AS n FROM {name}_keys
),
{name} AS (
  SELECT s.*, CASE {cases} ELSE '{parts[-1]}' END AS split
  FROM {src} s JOIN {name}_groups g
    ON g.k = md5(concat_ws('/', '{seed}', CAST(s.{group_expr} AS VARCHAR))) || '/' || CAST(s.{group_expr} AS VARCHAR)
)"""
