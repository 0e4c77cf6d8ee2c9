"""Sentence tagger queries: a hidden Markov model trained on tagged sentences
of four fifths of the suppliers, run on those of the others.

The sentences come from lineitem x part: item nouns stand as nouns and as
verbs, sizes as adjectives and as nouns, and the towns of the held-out
suppliers are words that training has not met.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import linking, tagging
from ..session import read_table, stage
from . import kg_binding as B
from .catalog import query

# Fixed values of this binding: sentence frames, as words or fields with their tags.
FRAMES = (
    (("They", "PRON"), ("noun", "VERB"), ("qty", "NUM"), ("adj", "ADJ"), ("typ", "NOUN"), ("to", "ADP"), ("town", "PROPN"), (".", "PUNCT")),
    (("The", "DET"), ("adj", "ADJ"), ("noun", "NOUN"), ("for", "ADP"), ("town", "PROPN"), ("holds", "VERB"), ("qty", "NUM"),
     ("typ", "NOUN"), (".", "PUNCT")),
    (("town", "PROPN"), ("will", "AUX"), ("noun", "VERB"), ("a", "DET"), ("adj", "ADJ"), ("typ", "NOUN"), (".", "PUNCT")),
)
FIELDS = ("noun", "qty", "adj", "typ", "town")


def tagged_sentences(spark, sf_dir):
    """(s, w, p, held): distinct sentences with their words, tags, and whether held out."""
    li = read_table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    j = li.join(part, li.l_partkey == part.p_partkey).select(
        F.split_part("p_name", F.lit(" "), F.lit(2)).alias("noun"), F.col("l_quantity").cast("int").cast("string").alias("qty"),
        F.split_part("p_name", F.lit(" "), F.lit(1)).alias("adj"), F.lower("p_type").alias("typ"),
        B.town(F.col("l_suppkey")).alias("town"), (F.col("l_suppkey") % 5 == 4).alias("held"), (F.col("l_linenumber") % 3).alias("f"))
    words = [F.array(*[F.col(w) if w in FIELDS else F.lit(w) for w, _ in frame]) for frame in FRAMES]
    tags = [F.array(*[F.lit(t) for _, t in frame]) for frame in FRAMES]
    pick = lambda xs: F.when(F.col("f") == 0, xs[0]).when(F.col("f") == 1, xs[1]).otherwise(xs[2])
    d = j.select(pick(words).alias("w"), pick(tags).alias("p"), "held").distinct()
    return d.select(F.array_join("w", " ").alias("s"), "w", "p", "held")


def _held_out(spark, sf_dir):
    """Annotated held-out sentences (s, ann) under the trained model, and the tagged sentences."""
    all_ = stage(tagged_sentences(spark, sf_dir), "tagged")
    rows = all_.where(~F.col("held")).select(F.col("s").alias("sid"), F.posexplode(F.arrays_zip("w", "p")).alias("i", "x")) \
        .select("sid", "i", F.col("x.w").alias("word"), F.col("x.p").alias("tag"))
    model = tagging.train_hmm(rows)
    held = all_.where("held")
    return linking.annotate_sentences(held.select("s"), model), held


def _frames_sql():
    cell = lambda w: w if w in FIELDS else f"'{w}'"
    words = " ".join(f"WHEN {k} THEN [{', '.join(cell(w) for w, _ in f)}]" for k, f in enumerate(FRAMES))
    tags = " ".join(f"WHEN {k} THEN [{', '.join(repr(t) for _, t in f)}]" for k, f in enumerate(FRAMES))
    kind = r"CASE WHEN regexp_matches(t, '^\p{Lu}') THEN 'A' WHEN regexp_matches(t, '\p{N}') THEN '0' ELSE 'a' END"
    eps = tagging.SMOOTH
    milli = lambda x: f"CAST(floor(ln({x}) * 1000 + 0.5) AS INTEGER)"
    ends = " UNION ALL ".join(f"SELECT {kind} || '{n}' || lower(right(t, {n})) AS ending, tag FROM types" for n in tagging.ENDINGS)
    unknown = "coalesce(" + ", ".join(f"e{n}.em" for n in tagging.ENDINGS) + ", 0)"
    joins = "\n     ".join(f"LEFT JOIN ee e{n} ON e{n}.ending = {kind} || '{n}' || lower(right(t, {n})) AND e{n}.tag = g.tag"
                           for n in tagging.ENDINGS)
    return f"""WITH RECURSIVE j AS (
  SELECT split_part(p_name, ' ', 2) AS noun, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS qty, split_part(p_name, ' ', 1) AS adj,
         lower(p_type) AS typ, 'Port' || translate(lpad(CAST(l_suppkey % 100 AS VARCHAR), 2, '0'), '0123456789', 'aeioubcdfg') AS town,
         l_suppkey % 5 = 4 AS held, l_linenumber % 3 AS f
  FROM lineitem JOIN part ON l_partkey = p_partkey),
d AS (SELECT DISTINCT CASE f {words} END AS w, CASE f {tags} END AS p, held FROM j),
s AS (SELECT array_to_string(w, ' ') AS s, w, p, held FROM d),
tok AS (SELECT s, held, unnest(w) AS t, unnest(p) AS tag, generate_subscripts(w, 1) AS i, len(w) AS n FROM s),
tr AS (SELECT s, t, tag, i, n, lag(tag) OVER (PARTITION BY s ORDER BY i) AS before FROM tok WHERE NOT held),
g AS (SELECT tag, row_number() OVER (ORDER BY tag) - 1 AS k, count(*) AS n, count(*) FILTER (i = n) AS ends,
             count(*) FILTER (before IS NULL) AS heads, sum(count(*)) OVER () AS total, count(*) OVER () AS nt
      FROM tr GROUP BY tag),
st AS (SELECT a.k AS a, b.k AS b, {milli(f"(coalesce(x.c, 0) + {eps}) / (a.n - a.ends + {eps} * a.nt)")} AS sc
       FROM g a, g b LEFT JOIN (SELECT before, tag, count(*) AS c FROM tr WHERE before IS NOT NULL GROUP BY ALL) x
            ON x.before = a.tag AND x.tag = b.tag),
hd AS (SELECT k, {milli(f"(heads + {eps}) / ((SELECT sum(heads) FROM g) + {eps} * nt)")} AS sc FROM g),
sp AS (SELECT k, {milli(f"(ends + {eps}) / (n + {eps} * nt)")} AS sc FROM g),
wc AS (SELECT lower(t) AS word, tag, count(*) AS c FROM tr GROUP BY ALL),
we AS (SELECT w.word, g.tag, {milli(f"(coalesce(wc.c, 0) + {eps}) / (g.n + {eps})")} AS em
       FROM (SELECT DISTINCT word FROM wc) w, g LEFT JOIN wc ON wc.word = w.word AND wc.tag = g.tag),
types AS (SELECT DISTINCT t, tag FROM tr),
ec AS (SELECT ending, tag, count(*) AS c FROM ({ends}) GROUP BY ALL),
ea AS (SELECT ending, sum(c) AS a FROM ec GROUP BY ending),
ee AS (SELECT ea.ending, g.tag, {milli(f"(coalesce(ec.c, 0) + {eps}) / (ea.a + {eps} * g.nt) * CAST(g.total AS DOUBLE) / g.n")} AS em
       FROM ea, g LEFT JOIN ec ON ec.ending = ea.ending AND ec.tag = g.tag),
dt AS (SELECT DISTINCT t FROM tok WHERE held),
em AS (SELECT dt.t, g.k, coalesce(we.em, {unknown}) AS em
       FROM dt, g LEFT JOIN we ON we.word = lower(dt.t) AND we.tag = g.tag
     {joins}),
v(s, i, k, sc, back) AS (
  SELECT tok.s, 1, em.k, CAST(hd.sc + em.em AS BIGINT), CAST(NULL AS BIGINT) FROM tok JOIN em ON em.t = tok.t JOIN hd ON hd.k = em.k
  WHERE tok.held AND tok.i = 1
  UNION ALL
  SELECT v.s, v.i + 1, em.k, max(v.sc + st.sc) + any_value(em.em), arg_max(v.k, (v.sc + st.sc, -v.k))
  FROM v JOIN tok ON tok.s = v.s AND tok.held AND tok.i = v.i + 1 JOIN em ON em.t = tok.t JOIN st ON st.a = v.k AND st.b = em.k
  GROUP BY v.s, v.i, em.k),
r(s, i, k, back) AS (
  SELECT v.s, v.i, arg_max(v.k, (v.sc + sp.sc, -v.k)), arg_max(v.back, (v.sc + sp.sc, -v.k))
  FROM v JOIN sp ON sp.k = v.k JOIN tok ON tok.s = v.s AND tok.held AND tok.i = v.i AND tok.n = v.i GROUP BY v.s, v.i
  UNION ALL
  SELECT r.s, r.i - 1, v.k, v.back FROM r JOIN v ON v.s = r.s AND v.i = r.i - 1 AND v.k = r.back),
found AS (SELECT tok.s, tok.i, tok.t, tok.tag AS want, g.tag AS got FROM r JOIN g ON g.k = r.k JOIN tok ON tok.s = r.s AND tok.i = r.i)"""


@query("hmm_tags", _frames_sql() + """
SELECT s, string_agg(got, ' ' ORDER BY i) AS tags FROM found GROUP BY s""", ("NLP-08", "NLP-01", "UDF-03"))
def q_hmm_tags(spark, sf_dir):
    """Tags of every held-out sentence."""
    ann, _ = _held_out(spark, sf_dir)
    return ann.select("s", F.array_join("ann.pos", " ").alias("tags"))


@query("hmm_words", _frames_sql() + """
SELECT lower(t) AS word, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (want = got) AS BIGINT) AS n_right,
       string_agg(DISTINCT got, ',' ORDER BY got) AS tags
FROM found GROUP BY lower(t)""", ("NLP-08",))
def q_hmm_words(spark, sf_dir):
    """Per held-out word: tokens, right tags, and all tags that its sentences gave it."""
    ann, held = _held_out(spark, sf_dir)
    both = ann.join(held, "s").select(F.explode(F.arrays_zip(F.col("ann.l").alias("word"), F.col("ann.pos").alias("got"),
                                                              F.col("p").alias("want"))).alias("x")).select("x.*")
    return both.groupBy("word").agg(
        F.count(F.lit(1)).cast("bigint").alias("n"), F.count_if(F.col("want") == F.col("got")).cast("bigint").alias("n_right"),
        F.array_join(F.array_sort(F.collect_set("got")), ",").alias("tags"))
