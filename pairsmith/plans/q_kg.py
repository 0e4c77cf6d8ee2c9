"""Knowledge-graph queries over the derived snapshot (J-06..J-09, NLP-06)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import kg
from ..operators import locations as L
from ..session import scratch_path, stage
from ..sources import readers
from . import kg_binding as B
from .catalog import query

_INITCAP = ("array_to_string(list_transform(string_split(lower({x}), ' '), "
            "lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ')")
_TOWN = "'Port' || translate(lpad(CAST(s_suppkey % 100 AS VARCHAR), 2, '0'), '0123456789', 'aeioubcdfg')"
TRIPLES_SQL = f"""
nat AS (
  SELECT n.n_nationkey, n.n_regionkey,
         CASE n.n_nationkey WHEN 0 THEN 'United States of America' WHEN 1 THEN 'United Kingdom'
              ELSE {_INITCAP.format(x='n.n_name')} END AS nlabel,
         {_INITCAP.format(x='r.r_name')} AS rlabel
  FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey),
sup AS (SELECT s.*, n.* FROM supplier s JOIN nat n ON s.s_nationkey = n.n_nationkey),
triples AS (
  SELECT 'S' || s_suppkey AS subject, {_TOWN} AS subject_label, 'country' AS predicate,
         'N' || n_nationkey AS object, nlabel AS object_label, s_suppkey AS rank FROM sup
  UNION ALL SELECT 'S' || s_suppkey, {_TOWN}, 'located_in', 'N' || n_nationkey, nlabel, s_suppkey FROM sup
  UNION ALL SELECT 'S' || s_suppkey, {_TOWN}, 'population', CAST(CAST(round(s_acctbal * 100) AS BIGINT) AS VARCHAR),
                   NULL, s_suppkey FROM sup
  UNION ALL SELECT DISTINCT * FROM (
    SELECT 'N' || n_nationkey, nlabel, 'country', 'N' || n_nationkey, nlabel, n_nationkey FROM nat
    UNION ALL SELECT 'N' || n_nationkey, nlabel, 'located_in', 'R' || n_regionkey, rlabel, n_nationkey FROM nat
    UNION ALL SELECT 'N' || n_nationkey, nlabel, 'population', CAST(n_nationkey * 1000000 AS VARCHAR), NULL,
                     n_nationkey FROM nat
    UNION ALL SELECT 'N' || n_nationkey, nlabel, 'instance_of', 'country', 'country', n_nationkey FROM nat
    UNION ALL SELECT 'R' || n_regionkey, rlabel, 'instance_of', 'state', 'state', n_regionkey FROM nat)
  UNION ALL
  SELECT 'P' || p_partkey, split_part(p_name, ' ', 2),
         CASE split_part(p_name, ' ', 1) WHEN 'red' THEN 'color' WHEN 'blue' THEN 'color' WHEN 'small' THEN 'shape'
              WHEN 'large' THEN 'shape' WHEN 'old' THEN 'material' WHEN 'new' THEN 'material' END,
         split_part(p_name, ' ', 1), split_part(p_name, ' ', 1), p_partkey
  FROM part WHERE split_part(p_name, ' ', 1) IN ('red', 'blue', 'small', 'large', 'old', 'new')),
li AS (SELECT subject AS c, object AS p FROM triples WHERE predicate = 'located_in'),
clo(node, anc) AS (
  SELECT c, p FROM li
  UNION SELECT clo.node, li.p FROM clo JOIN li ON clo.anc = li.c),
reach AS (SELECT node, anc FROM clo UNION SELECT DISTINCT subject, subject FROM triples),
states AS (SELECT DISTINCT subject AS st, subject_label AS state_label FROM triples
           WHERE predicate = 'instance_of' AND object = 'state')"""


@query("kg_country", "WITH RECURSIVE " + TRIPLES_SQL + """,
h AS (SELECT lower(subject_label) AS query, lower(object_label) AS c,
             row_number() OVER (PARTITION BY lower(subject_label) ORDER BY rank, subject, object) AS rk
      FROM triples WHERE predicate = 'country')
SELECT query, array_to_string(list_sort(list(DISTINCT c)), '|') AS countries FROM h WHERE rk <= 10 GROUP BY query""", ("J-06", "WIN-06", "SRC-10"))
def q_kg_country(spark, sf_dir):
    return kg.entity_countries(B.triples(spark, sf_dir)).select(
        "query", F.array_join("countries", "|").alias("countries"))


@query("kg_states", "WITH RECURSIVE " + TRIPLES_SQL + """,
hits AS (SELECT DISTINCT subject, lower(subject_label) AS query, rank FROM triples WHERE predicate = 'country'),
r AS (SELECT h.query, h.subject, h.rank, s.st, s.state_label FROM hits h JOIN reach ON reach.node = h.subject
      JOIN states s ON s.st = reach.anc),
k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rank, subject, st) AS rk FROM r)
SELECT query, array_to_string(list_sort(list(DISTINCT state_label)), '|') AS states FROM k WHERE rk <= 10
GROUP BY query""", ("J-07",))
def q_kg_states(spark, sf_dir):
    return kg.entity_states(B.triples(spark, sf_dir)).select(
        "query", F.array_join("states", "|").alias("states"))


_TOP_SQL = """
pop AS (SELECT subject, CAST(object AS DOUBLE) AS population FROM triples WHERE predicate = 'population'),
base AS (SELECT t.subject, lower(t.subject_label) AS query, t.subject_label, t.object_label AS country, p.population
         FROM triples t JOIN pop p ON p.subject = t.subject WHERE t.predicate = 'country'),
rows_ AS (
  SELECT *, NULL::VARCHAR AS state FROM base
  UNION ALL
  SELECT b.*, s.state_label FROM base b JOIN reach ON reach.node = b.subject JOIN states s ON s.st = reach.anc),
k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY population DESC, subject, state NULLS FIRST) AS rk
      FROM rows_),
top AS (SELECT * FROM k WHERE rk <= 10),
picked AS (
  SELECT query,
         arg_min(country, CASE WHEN lower(subject_label) = query THEN rk END) AS country,
         arg_min(state, CASE WHEN state IS NOT NULL THEN rk END) AS first_state
  FROM top GROUP BY query)"""


@query("kg_top_population", "WITH RECURSIVE " + TRIPLES_SQL + "," + _TOP_SQL + """
SELECT query,
       CASE WHEN country = 'United States of America' THEN coalesce(lower(first_state), '')
            WHEN country IS NOT NULL THEN lower(country) ELSE '' END AS places
FROM picked""", ("J-08", "WIN-06"))
def q_kg_top_population(spark, sf_dir):
    return kg.state_or_country(B.triples(spark, sf_dir), B.US_LABEL).select(
        "query", F.array_join("places", "|").alias("places"))


@query("kg_features", "WITH RECURSIVE " + TRIPLES_SQL + """,
t AS (SELECT *, lower(subject_label) AS query FROM triples WHERE predicate IN ('color', 'shape', 'material')),
k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rank, subject, predicate, object) AS rk FROM t)
SELECT DISTINCT query AS noun, predicate AS feature_type,
       CASE WHEN predicate = 'shape' AND object_label = 'round' THEN 'sphere' ELSE object_label END AS feature
FROM k WHERE rk <= 10 AND NOT (predicate = 'color' AND strpos('color', object_label) > 0)""", ("J-09",))
def q_kg_features(spark, sf_dir):
    return kg.noun_features(B.triples(spark, sf_dir))


def _closure_sql():
    from ..functions.text import to_singular_sql
    excl = ", ".join(f"'{x}'" for x in kg.EXCLUDED_CLASSES)
    return f"""WITH RECURSIVE base AS (
  SELECT DISTINCT split_part(p_name, ' ', 2) AS item, lower(p_type) AS typ FROM part),
edges AS (
  SELECT DISTINCT * FROM (
    SELECT item || '.n.01' AS c, typ || '.n.01' AS p FROM base
    UNION ALL SELECT typ || '.n.01', 'machine_part.n.01' FROM base
    UNION ALL SELECT 'machine_part.n.01', 'part.n.01'
    UNION ALL SELECT 'part.n.01', 'object.n.01')),
lemmas AS (SELECT DISTINCT lemma FROM (SELECT item AS lemma FROM base UNION ALL SELECT typ FROM base
                                      UNION ALL SELECT 'part' UNION ALL SELECT 'object')),
clo(node, anc) AS (SELECT c, p FROM edges UNION SELECT clo.node, e.p FROM clo JOIN edges e ON clo.anc = e.c),
named AS (SELECT l.lemma AS word, split_part(c.anc, '.', 1) AS hname
          FROM lemmas l JOIN clo c ON c.node = l.lemma || '.n.01')
SELECT DISTINCT word, {to_singular_sql('hname')} AS hyper FROM named
WHERE hname NOT IN ({excl}) AND NOT contains(hname, '_')"""


@query("kg_closure", _closure_sql(), ("NLP-06", "STR-24"))
def q_kg_closure(spark, sf_dir):
    lemmas, edges = B.taxonomy(spark, sf_dir)
    return kg.hypernym_table(lemmas, edges)


@query("location_cache", "WITH RECURSIVE " + TRIPLES_SQL + """,
keys AS (SELECT DISTINCT subject_label AS location FROM triples WHERE predicate <> 'instance_of'),
names AS (SELECT DISTINCT lower(nlabel) AS name FROM nat),
h AS (SELECT lower(subject_label) AS query, lower(object_label) AS country,
             row_number() OVER (PARTITION BY lower(subject_label) ORDER BY rank, subject, object) AS rk
      FROM triples WHERE predicate = 'country')
SELECT k.location, n.name IS NOT NULL AS is_country, CASE WHEN n.name IS NULL THEN h.country END AS country
FROM keys k LEFT JOIN names n ON n.name = lower(k.location) LEFT JOIN h ON h.query = lower(k.location) AND h.rk = 1
WHERE NOT regexp_matches(k.location, '["?]')""", ("FLT-06", "J-20", "J-06", "SRC-09"))
def q_location_cache(spark, sf_dir):
    """Labels of the graph against the country list (a JSON array of names) and
    the first search hit."""
    t = B.triples(spark, sf_dir)
    p = scratch_path(spark, "names")
    B._nations(spark, sf_dir).agg(F.to_json(F.collect_list("nlabel")).alias("value")).write.text(p)  # 25 names
    keys = t.where(F.col("predicate") != "instance_of").select(F.col("subject_label").alias("location")).distinct()
    return L.location_cache(keys, readers.read_name_list(spark, p), kg.top_country(t))
