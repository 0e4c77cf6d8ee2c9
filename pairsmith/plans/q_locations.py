"""Location-mining queries over documents and conversation pairs.

Gazetteer stand-in: countries are the nations; cities are capitalised words
(``Xxxx`` with 4+ letters) of the documents, each assigned to a nation by a hash of the word; a word whose hash is divisible
by 7 is also listed under the next nation (an ambiguous city), and every
tenth nation's own name is listed as a city elsewhere (an ambiguous
country).  So the dedup rules all fire, and the gazetteer grows with the data.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import locations as L
from ..session import read_table, stage
from . import kg_binding as B
from .catalog import query
from .q_mix import corpus

EXCLUDE_GENRE = "assistant"


def _h(c):
    return F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("bigint")


def gazetteer_raw(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    words = docs.select(F.explode(F.regexp_extract_all("text", F.lit(r"\p{Lu}\p{Ll}{3,}"), 0)).alias("w"))
    words = words.where(F.col("w").rlike(r"^\p{Lu}\p{Ll}{3,}$"))
    freq = words.select(F.lower("w").alias("city")).distinct()
    n = read_table(spark, sf_dir, "nation").select(
        "n_nationkey", B.nation_label(F.col("n_nationkey"), F.col("n_name")).alias("country"))
    k = F.pmod(_h(F.col("city")), F.lit(25))
    assign = freq.select("city", F.explode(F.array(
        k, F.when(F.pmod(_h(F.col("city")), F.lit(7)) == 0, F.pmod(k + 1, F.lit(25))))).alias("nk")) \
        .where(F.col("nk").isNotNull())
    cities = assign.join(F.broadcast(n), assign.nk == n.n_nationkey).select("country", "city")  # nation: 25 rows
    own = n.where(F.col("n_nationkey") % 10 == 0).select(F.col("n_nationkey").alias("src"), F.lower("country").alias("city"))
    own = own.join(F.broadcast(n), F.pmod(own.src + 3, F.lit(25)) == n.n_nationkey).select("country", "city")
    bare = n.select("country", F.lit(None).cast("string").alias("city"))
    return cities.unionByName(own).unionByName(bare)


GAZ_SQL = f"""
words AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '\\p{{Lu}}\\p{{Ll}}{{3,}}')) AS w FROM documents
),
freq AS (
  SELECT DISTINCT lower(w) AS city FROM words WHERE regexp_matches(w, '^\\p{{Lu}}\\p{{Ll}}{{3,}}$')
),
nat AS (
  SELECT n_nationkey, CASE n_nationkey WHEN 0 THEN 'United States of America' WHEN 1 THEN 'United Kingdom'
         ELSE upper(substr(n_name, 1, 1)) || lower(substr(n_name, 2)) END AS country FROM nation
),
hsh AS (SELECT city, ('0x' || substr(md5(city), 1, 8))::BIGINT AS h FROM freq),
assign AS (
  SELECT city, h % 25 AS nk FROM hsh
  UNION ALL SELECT city, (h % 25 + 1) % 25 FROM hsh WHERE h % 7 = 0
),
gaz_raw AS (
  SELECT n.country, a.city FROM assign a JOIN nat n ON n.n_nationkey = a.nk
  UNION ALL
  SELECT n.country, lower(o.country) FROM nat o JOIN nat n ON n.n_nationkey = (o.n_nationkey + 3) % 25
  WHERE o.n_nationkey % 10 = 0
  UNION ALL SELECT country, NULL FROM nat
),
cc AS (SELECT lower(country) AS country, lower(city) AS city FROM gaz_raw),
names AS (SELECT city AS name FROM cc WHERE city IS NOT NULL UNION ALL SELECT DISTINCT country FROM cc),
once AS (SELECT name FROM names GROUP BY name HAVING count(*) = 1),
kept_c AS (SELECT * FROM cc WHERE country IN (SELECT name FROM once)),
kept AS (SELECT country, city FROM kept_c WHERE city IN (SELECT name FROM once)),
gaz AS (SELECT c.country, k.city FROM (SELECT DISTINCT country FROM kept_c) c LEFT JOIN kept k ON k.country = c.country)"""


def gazetteer(spark, sf_dir, raw=None):
    return L.dedup_gazetteer(gazetteer_raw(spark, sf_dir) if raw is None else raw)


@query("gazetteer_dedup", "WITH " + GAZ_SQL + "\nSELECT country, city FROM gaz", ("AGG-06",))
def q_gazetteer_dedup(spark, sf_dir):
    return gazetteer(spark, sf_dir)


def _names(raw):
    return raw.select(F.lower("country").alias("name")).unionByName(
        raw.select(F.lower("city").alias("name"))).where(F.col("name").isNotNull()).distinct()


# names and n-gram hits; ``src`` holds the key columns and ``text``
def _mention_sql(src: str, keys: str) -> str:
    w = "[\\p{L}\\p{N}_]+"
    return f"""
allnames AS (SELECT DISTINCT name FROM (SELECT lower(country) AS name FROM gaz_raw
                                        UNION ALL SELECT lower(city) FROM gaz_raw) WHERE name IS NOT NULL),
nm AS (SELECT DISTINCT p[1] AS first, len(p) AS n, array_to_string(p, ' ') AS location
       FROM (SELECT regexp_extract_all(name, '{w}') AS p FROM allnames) WHERE len(p) > 0),
ws AS (SELECT {keys}, regexp_extract_all(text, '{w}') AS w, regexp_split_to_array(text, '{w}') AS g FROM {src}),
tk AS (SELECT {keys}, w, g, unnest(range(0, len(w))) AS k FROM ws),
hits AS (
  SELECT {keys}, k, n, location,
         list_sum(list_transform(g[1:k + 1], lambda x: length(x)))
           + coalesce(list_sum(list_transform(w[1:k], lambda x: length(x))), 0) AS s,
         list_sum(list_transform(g[1:k + n], lambda x: length(x)))
           + list_sum(list_transform(w[1:k + n], lambda x: length(x))) AS e
  FROM tk JOIN nm ON nm.first = lower(w[k + 1])
       AND array_to_string(list_transform(w[k + 1:k + n], lambda x: lower(x)), ' ') = nm.location),
hl AS (SELECT {keys}, list(struct_pack(k := k, n := n, location := location, s := CAST(s AS BIGINT), e := CAST(e AS BIGINT))
                           ORDER BY k, n DESC) AS h FROM hits GROUP BY ALL)"""


# the fold as a recursion: each step takes the first hit at or after the end of the last one
def _found_sql(src: str, keys: str) -> str:
    head = _mention_sql(src, keys) + ","
    same = " AND ".join(f"h.{k.strip()} = f.{k.strip()}" for k in keys.split(","))
    return head + f"""
pick(g, {keys}, m, nxt) AS (
  SELECT 0, {keys}, []::STRUCT(k BIGINT, n BIGINT, location VARCHAR, s BIGINT, e BIGINT)[], 0::BIGINT FROM hl
  UNION ALL
  SELECT f.g + 1, {", ".join("f." + k.strip() for k in keys.split(","))}, list_append(f.m, x.v), x.v.k + x.v.n
  FROM pick f JOIN hl h ON {same},
       LATERAL (SELECT list_filter(h.h, lambda y: y.k >= f.nxt)[1] AS v) x
  WHERE x.v IS NOT NULL),
found AS (SELECT {keys}, arg_max(m, g) AS m FROM pick GROUP BY {keys})"""


@query("corpus_mentions", "WITH RECURSIVE " + GAZ_SQL + """,
src AS (SELECT doc_id AS id, text FROM documents),""" + _found_sql("src", "id") + """
SELECT x.location AS location, CAST(count(*) AS BIGINT) AS cnt
FROM (SELECT unnest(m) AS x FROM found) GROUP BY x.location""", ("AGG-05", "NLP-04"))
def q_corpus_mentions(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return L.corpus_mentions(docs, _names(stage(gazetteer_raw(spark, sf_dir), "gazetteer")))


# types of this binding: countries GPE; cities GPE, or LOC by a rule; every eleventh city also ORG
def _typed_names(raw):
    h = _h(F.col("name"))
    cities = raw.select(F.lower("city").alias("name")).where(F.col("name").isNotNull()).distinct()
    types = F.array(F.when(F.pmod(h, F.lit(3)) == 0, F.lit("LOC")).otherwise(F.lit("GPE")), F.when(F.pmod(h, F.lit(11)) == 0, F.lit("ORG")))
    return raw.select(F.lower("country").alias("name")).distinct().withColumn("ent", F.lit("GPE")).unionByName(
        cities.select("name", F.explode(types).alias("ent")).where(F.col("ent").isNotNull()))


@query("typed_mentions", "WITH RECURSIVE " + GAZ_SQL + """,
src AS (SELECT doc_id AS id, text FROM documents),""" + _found_sql("src", "id") + """,
ty AS (SELECT DISTINCT lower(country) AS name, 'GPE' AS ent FROM gaz_raw
       UNION SELECT lower(city), CASE WHEN ('0x' || substr(md5(lower(city)), 1, 8))::BIGINT % 3 = 0 THEN 'LOC' ELSE 'GPE' END
             FROM gaz_raw WHERE city IS NOT NULL
       UNION SELECT lower(city), 'ORG' FROM gaz_raw
             WHERE city IS NOT NULL AND ('0x' || substr(md5(lower(city)), 1, 8))::BIGINT % 11 = 0)
SELECT x.location AS location, CAST(count(*) AS BIGINT) AS cnt, CAST(min(x.s) AS INTEGER) AS first_char
FROM (SELECT unnest(m) AS x FROM found)
WHERE EXISTS (SELECT 1 FROM ty WHERE ty.name = x.location AND ty.ent IN ('LOC', 'ORG')) GROUP BY x.location""",
       ("FLT-07", "NLP-04", "AGG-05"))
def q_typed_mentions(spark, sf_dir):
    """Mentions listed as LOC or ORG: count and least start in a document."""
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    names = _typed_names(stage(gazetteer_raw(spark, sf_dir), "gazetteer"))
    found = L.mentions(docs, names, ["id"], entity_types=["LOC", "ORG"]).select(F.explode("m").alias("x"))
    return found.groupBy("x.location").agg(F.count(F.lit(1)).cast("bigint").alias("cnt"), F.min("x.start_char").alias("first_char"))


def _sentences_sql():
    from .q_mix import CORPUS_SQL
    corpus_only = CORPUS_SQL[:CORPUS_SQL.index("keyed AS")].rstrip().rstrip(",")
    return GAZ_SQL + "," + corpus_only + """,
src AS (SELECT seq AS sample_id, 'permise' AS type, genre, sentence1 AS text FROM corpus
        UNION ALL SELECT seq, 'hypothesis', genre, sentence2 FROM corpus),""" + _found_sql("src", "sample_id, type") + """,
ann AS (SELECT f.sample_id, f.type, s.genre, s.text AS sentence, f.m FROM found f
        JOIN src s ON s.sample_id = f.sample_id AND s.type = f.type)"""


def annotated_sentences(spark, sf_dir, raw=None):
    raw = stage(gazetteer_raw(spark, sf_dir), "gazetteer") if raw is None else raw
    names = _names(raw)
    # read for the mentions and again for the texts: the turns are joined once
    rows = stage(L.sentence_rows(corpus(spark, sf_dir).withColumnRenamed("seq", "sample_id")), "sentences")
    return L.annotate_locations(rows, names, names)


@query("location_sentences", "WITH RECURSIVE " + _sentences_sql() + """
SELECT sample_id, type, genre, CAST(len(m) AS INTEGER) AS num_locations,
       array_to_string(list_transform(m, lambda x: x.location), '|') AS locations,
       array_to_string(list_transform(m, lambda x: x.s), ',') AS start_char,
       array_to_string(list_transform(m, lambda x: x.e), ',') AS end_char,
       array_to_string(list_transform(m, lambda x: x.n), ',') AS word_count
FROM ann""", ("EXP-10", "AGG-19", "FLT-07", "NLP-04"))
def q_location_sentences(spark, sf_dir):
    a = annotated_sentences(spark, sf_dir)
    return a.select("sample_id", "type", "genre", "num_locations",
                    F.array_join("locations", "|").alias("locations"),
                    F.array_join(F.transform("start_char", lambda x: x.cast("string")), ",").alias("start_char"),
                    F.array_join(F.transform("end_char", lambda x: x.cast("string")), ",").alias("end_char"),
                    F.array_join(F.transform("word_count", lambda x: x.cast("string")), ",").alias("word_count"))


def pool(spark, sf_dir, raw=None):
    # the gazetteer feeds several size-checked joins: derive it from the
    # documents once and read the written copy for each of them
    raw = stage(gazetteer_raw(spark, sf_dir), "gazetteer") if raw is None else raw
    return L.sentence_pool(annotated_sentences(spark, sf_dir, raw), gazetteer(spark, sf_dir, raw), EXCLUDE_GENRE)


def _pool_sql():
    return _sentences_sql() + f""",
ranked AS (SELECT country, city, row_number() OVER (PARTITION BY country ORDER BY md5(city)) - 1 AS idx,
                  count(*) OVER (PARTITION BY country) AS n
           FROM (SELECT DISTINCT country, city FROM gaz WHERE city IS NOT NULL)),
sizes AS (SELECT DISTINCT g.country AS loc, r.n FROM gaz g LEFT JOIN ranked r ON r.country = g.country),
ok AS (SELECT m[1].location AS loc, sentence, m[1].s AS a, m[1].e AS b,
              CAST(sample_id AS VARCHAR) || '_' || substr(type, 1, 1) AS id
       FROM ann WHERE len(m) = 1 AND m[1].n = 1 AND genre <> '{EXCLUDE_GENRE}'),
placed AS (SELECT ok.*, s.loc IS NOT NULL AS is_country, s.n, CASE WHEN s.loc IS NOT NULL THEN ok.loc ELSE h.country END AS home
           FROM ok LEFT JOIN sizes s ON s.loc = ok.loc LEFT JOIN ranked h ON h.city = ok.loc
           WHERE s.loc IS NOT NULL OR h.country IS NOT NULL),
pool AS (
  SELECT p.sentence AS original_sentence,
         substr(p.sentence, 1, a) || '**' || substr(p.sentence, a + 1, b - a) || '**' || substr(p.sentence, b + 1)
           AS highlighted_sentence,
         p.home AS country, CASE WHEN is_country THEN r.city ELSE p.loc END AS location, is_country,
         CAST(a AS INTEGER) AS start_char, CAST(b AS INTEGER) AS end_char, id
  FROM placed p LEFT JOIN ranked r ON p.is_country AND r.country = p.home
       AND r.idx = ('0x' || substr(md5('{L.POOL_SEED}/' || p.id), 1, 8))::BIGINT % p.n)"""


@query("sentence_pool", "WITH RECURSIVE " + _pool_sql() + "\nSELECT * FROM pool", ("FLT-05", "J-03", "WIN-05", "STR-06", "PRJ-07"))
def q_sentence_pool(spark, sf_dir):
    return pool(spark, sf_dir)


def city_map(spark, sf_dir, raw=None):
    """Fixed map plus, for each kept nation, its first city (a rule)."""
    g = gazetteer(spark, sf_dir, raw).where(F.col("city").isNotNull()).groupBy("country").agg(
        F.min("city").alias("city"))
    derived = g.select(F.initcap("country").alias("country"), F.initcap("city").alias("city"))
    fixed = spark.createDataFrame(sorted(L.COUNTRY_TO_CITY.items()), "country string, city string")
    return derived.unionByName(fixed.join(derived.select("country"), "country", "left_anti"))


def _tagging_sql():
    from .q_kg import _INITCAP
    fixed = ", ".join(f"('{c}', '{t}')" for c, t in sorted(L.COUNTRY_TO_CITY.items()))
    return _pool_sql() + f""",
derived AS (SELECT {_INITCAP.format(x='country')} AS country, {_INITCAP.format(x='city')} AS city
            FROM (SELECT country, min(city) AS city FROM gaz WHERE city IS NOT NULL GROUP BY country)),
cmap AS (SELECT * FROM derived
         UNION ALL SELECT * FROM (VALUES {fixed}) AS t(country, city)
         WHERE t.country NOT IN (SELECT country FROM derived)),
tg AS (SELECT id, original_sentence AS sentence,
              CAST(('0x' || substr(md5(id), 1, 8))::BIGINT % 3 AS INTEGER) AS can_be_entailed,
              {_INITCAP.format(x='country')} AS country, start_char, end_char
       FROM pool WHERE country IN (SELECT lower(country) FROM cmap)),
cities AS (SELECT location, row_number() OVER (ORDER BY md5(location)) - 1 AS idx, count(*) OVER () AS n
           FROM (SELECT DISTINCT city AS location FROM cmap)),
j AS (SELECT t.*, c.city AS location, k.idx, k.n,
             ('0x' || substr(md5('{L.OTHER_SEED}/' || t.id), 1, 8))::BIGINT % (k.n - 1) AS pk
      FROM tg t JOIN cmap c ON c.country = t.country JOIN cities k ON k.location = c.city WHERE t.can_be_entailed IN (0, 1)),
o AS (SELECT j.*, x.location AS other_location,
             row_number() OVER (ORDER BY md5(concat_ws('/', '{L.FINAL_SEED}', j.id)) || '/' || j.id) - 1 AS pos
      FROM j LEFT JOIN cities x ON x.idx = j.pk + CASE WHEN j.pk >= j.idx THEN 1 ELSE 0 END)
SELECT id, substr(sentence, 1, start_char) || '{{{{{{location}}}}}}' || substr(sentence, end_char + 1) AS sentence,
       can_be_entailed, country, start_char, end_char, location, other_location,
       ['Neutral', 'Contradiction'][pos % 2 + 1] AS section2_label,
       ['Country', 'Location'][(pos // 2) % 2 + 1] AS section2_word_type, pos
FROM o"""


@query("finalise_tagging", "WITH RECURSIVE " + _tagging_sql(), ("FLT-04", "J-04", "WIN-04", "WIN-05", "STR-07", "STR-10", "SET-04", "SRT-04"))
def q_finalise_tagging(spark, sf_dir):
    raw = stage(gazetteer_raw(spark, sf_dir), "gazetteer")
    p = pool(spark, sf_dir, raw)
    cmap = stage(city_map(spark, sf_dir, raw), "city-map")
    tagged = p.join(cmap.select(F.lower("country").alias("country")), "country", "left_semi").select(
        "id", F.col("original_sentence").alias("sentence"),
        F.pmod(_h(F.col("id")), F.lit(3)).cast("int").alias("can_be_entailed"),
        "country", "start_char", "end_char")
    return L.finalise_for_tagging(tagged, cmap)
