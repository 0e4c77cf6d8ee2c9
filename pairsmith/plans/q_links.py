"""Link queries: the four link joins, index folds, cache keys and misses."""

from __future__ import annotations

from functools import cache

from pyspark.sql import functions as F

from ..operators import kg, linking
from ..operators.common import lookup
from ..operators.link_memo import resumed_links
from ..session import scratch_path, stage
from . import kg_binding as B
from .catalog import query


def annotated(spark, sf_dir):
    return linking.annotate(B.pairs(spark, sf_dir), B.lexicon(spark, sf_dir))


def _show(df):
    """Arrays as text so results compare across engines."""
    return df.select("pair_id", "data_type", "object",
                     F.array_join("subjects", ",").alias("subjects"),
                     F.array_join(F.transform("subject_ind", lambda x: x.cast("string")), ",").alias("subject_ind"),
                     F.array_join(F.transform("object_ind", lambda x: x.cast("string")), ",").alias("object_ind"),
                     "feature_type")


def linkers(spark, sf_dir):
    """The four link types of this binding as a registry; what they look up is
    worked out at first use and serves all runs of the registry."""
    triples = cache(lambda: B.triples(spark, sf_dir))
    hypernyms = cache(lambda: lookup(kg.hypernym_table(*B.taxonomy(spark, sf_dir))))
    places = cache(lambda: lookup(kg.state_or_country(triples(), B.US_LABEL)))
    countries = cache(lambda: lookup(kg.entity_countries(triples())))
    features = cache(lambda: lookup(kg.noun_features(triples())))
    names = cache(lambda: lookup(B.country_names(spark, sf_dir)))

    def isa(ann):
        return linking.link_isa(ann, hypernyms())

    def location(ann):
        return linking.link_location(ann, places(), names(), linking.synonyms_table(spark))

    def trademark(ann):
        return linking.link_trademark(ann, countries(), linking.adjectives_table(spark), linking.synonyms_table(spark))

    def color(ann):
        return linking.link_color(ann, features())

    return {"isa": isa, "location": location, "trademark": trademark, "color": color}


def _links(spark, sf_dir, name):
    return linkers(spark, sf_dir)[name](annotated(spark, sf_dir))


def _pairs_lex_sql():
    from ..functions.text import to_singular_sql
    from .q_kg import _INITCAP, _closure_sql
    tok = r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"
    sing = to_singular_sql("x")
    clo = _closure_sql().replace("WITH RECURSIVE ", "")
    hyp_body = clo[:clo.rindex("SELECT DISTINCT word")]
    hyp_sel = clo[clo.rindex("SELECT DISTINCT word"):]
    return f"""WITH RECURSIVE {hyp_body.rstrip()},
hyp AS ({hyp_sel}),
nat AS (SELECT n_nationkey, CASE n_nationkey WHEN 0 THEN 'United States of America' WHEN 1 THEN 'United Kingdom'
               ELSE {_INITCAP.format(x='n.n_name')} END AS nlabel, {_INITCAP.format(x='r.r_name')} AS rlabel
        FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey),
raw AS (
  SELECT DISTINCT
    'The ' || p.p_name || ' from Port' || translate(lpad(CAST(l.l_suppkey % 100 AS VARCHAR), 2, '0'),
        '0123456789', 'aeioubcdfg') || ' was shipped .' AS s1,
    'A ' || lower(p.p_type) || ' part from ' ||
      CASE l.l_linenumber % 4 WHEN 0 THEN lower(n.nlabel) WHEN 1 THEN lower(n.rlabel)
           WHEN 2 THEN coalesce(CASE n.n_nationkey WHEN 0 THEN 'american' WHEN 1 THEN 'british' END, lower(n.nlabel))
           ELSE 'the us' END || ' is ' || split_part(p.p_name, ' ', 1) || ' .' AS s2
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nat n ON s.s_nationkey = n.n_nationkey),
pairs AS (SELECT ('0x' || substr(md5(s1 || chr(1) || s2), 1, 15))::BIGINT AS pair_id, s1, s2 FROM raw),
lexall AS (
  SELECT DISTINCT split_part(p_name, ' ', 1) AS word, 'ADJ' AS pos, 0 AS prio FROM part
  UNION ALL SELECT DISTINCT w, 'NOUN', 1 FROM (SELECT split_part(p_name, ' ', 2) AS w FROM part
                                               UNION SELECT lower(p_type) FROM part UNION SELECT 'part')
  UNION ALL SELECT DISTINCT w, 'PROPN', 0 FROM (
      SELECT lower('Port' || translate(lpad(CAST(s_suppkey % 100 AS VARCHAR), 2, '0'), '0123456789', 'aeioubcdfg')) AS w
      FROM supplier UNION SELECT lower(nlabel) FROM nat)),
lex AS (SELECT word, arg_min(pos, (prio, pos)) AS pos FROM lexall GROUP BY word),
tk AS (
  SELECT pair_id, s1, s2, regexp_extract_all(s1, '{tok}') AS t1, regexp_extract_all(s2, '{tok}') AS t2 FROM pairs),
tagged AS (
  SELECT pair_id, s1, s2, t1, t2,
         list_transform(t1, lambda x: lower(x)) AS l1, list_transform(t2, lambda x: lower(x)) AS l2,
         list_transform(t1, lambda x: {to_singular_sql('lower(x)')}) AS g1,
         list_transform(t2, lambda x: {to_singular_sql('lower(x)')}) AS g2
  FROM tk),
tok1 AS (
  SELECT t.pair_id, t.s1 AS s, u.i, u.tok, coalesce(lx.pos, 'X') AS pos, {to_singular_sql('lower(u.tok)')} AS g
  FROM tagged t, unnest(t.t1) WITH ORDINALITY AS u(tok, i) LEFT JOIN lex lx ON lx.word = lower(u.tok)),
tok2 AS (
  SELECT t.pair_id, t.s2 AS s, u.i, u.tok, coalesce(lx.pos, 'X') AS pos, {to_singular_sql('lower(u.tok)')} AS g
  FROM tagged t, unnest(t.t2) WITH ORDINALITY AS u(tok, i) LEFT JOIN lex lx ON lx.word = lower(u.tok))"""


def _isa_sql():
    return _pairs_lex_sql() + """,
n1 AS (SELECT DISTINCT pair_id, g FROM tok1 WHERE pos IN ('NOUN', 'PROPN', 'ADJ')
       AND NOT (regexp_matches(substr(tok, 1, 1), '\\p{Lu}') AND NOT starts_with(s, tok))),
n2 AS (SELECT DISTINCT pair_id, g FROM tok2 WHERE pos IN ('NOUN', 'PROPN', 'ADJ')
       AND NOT (regexp_matches(substr(tok, 1, 1), '\\p{Lu}') AND NOT starts_with(s, tok))),
j AS (
  SELECT a.pair_id, a.g AS subject, h.hyper AS object FROM n1 a JOIN hyp h ON h.word = a.g
  WHERE EXISTS (SELECT 1 FROM n2 b WHERE b.pair_id = a.pair_id AND b.g = h.hyper)
    AND NOT EXISTS (SELECT 1 FROM n1 c WHERE c.pair_id = a.pair_id AND c.g = h.hyper)
    AND NOT EXISTS (SELECT 1 FROM n2 d WHERE d.pair_id = a.pair_id AND d.g = a.g)),
si AS (SELECT j.pair_id, j.subject, j.object,
              (SELECT list(CAST(t.i - 1 AS INTEGER) ORDER BY t.i) FROM tok1 t WHERE t.pair_id = j.pair_id AND t.g = j.subject) AS s_ind,
              (SELECT list(CAST(t.i - 1 AS INTEGER) ORDER BY t.i) FROM tok2 t WHERE t.pair_id = j.pair_id AND t.g = j.object) AS o_ind
       FROM j),
f AS (SELECT pair_id, object,
             list(struct_pack(first := s_ind[1], subject := subject, s_ind := s_ind, o_ind := o_ind)
                  ORDER BY s_ind[1], subject) AS xs
      FROM si GROUP BY pair_id, object)
SELECT pair_id, 'isa' AS data_type, object,
       array_to_string(flatten(list_transform(xs, lambda x: list_transform(x.s_ind, lambda k: x.subject))), ',') AS subjects,
       array_to_string(flatten(list_transform(xs, lambda x: x.s_ind)), ',') AS subject_ind,
       array_to_string(xs[1].o_ind, ',') AS object_ind,
       NULL::VARCHAR AS feature_type
FROM f"""


@query("link_isa", _isa_sql(), ("J-10", "J-14", "NLP-01", "NLP-02", "NLP-06", "NLP-08", "UDF-03", "AGG-09", "STR-13"))
def q_link_isa(spark, sf_dir):
    return _show(_links(spark, sf_dir, "isa"))


_NOUNS = _isa_sql()[len(_pairs_lex_sql()):].split("j AS (")[0].rstrip().rstrip(",")


@query("isa_reach", _pairs_lex_sql() + _NOUNS + """
SELECT DISTINCT a.g AS word, h.hyper FROM n1 a JOIN n2 b ON b.pair_id = a.pair_id AND a.g <> b.g
JOIN hyp h ON h.word = a.g AND h.hyper = b.g""", ("NLP-06", "J-10"))
def q_isa_reach(spark, sf_dir):
    """Words of s1 under words of s2, by the reachability index: no closure is made."""
    lemmas, edges = B.taxonomy(spark, sf_dir)
    return kg.hypernyms_of(linking.isa_words(annotated(spark, sf_dir)), lemmas, edges)


def hits(word, phrases):
    return f"""(CASE WHEN {phrases} IS NOT NULL THEN list_reduce(
          list_filter(list_transform(range(0, len(tg.l2)), lambda i: {{'i': i,
              'm': len(list_filter({phrases}, lambda ph: tg.l2[i + 1 : i + len(ph)] = ph)[1])}}),
              lambda x: x.m IS NOT NULL),
          lambda acc, x: CASE WHEN x.i >= acc.nxt
                              THEN {{'a': list_append(acc.a, CAST(x.i AS INTEGER)), 'nxt': x.i + x.m + 1}}
                              ELSE acc END,
          {{'a': []::INTEGER[], 'nxt': 0}}).a
        ELSE list_filter(list_transform(range(0, len(tg.l2)), lambda i: CASE WHEN tg.l2[i + 1] = lower({word})
                                        THEN CAST(i AS INTEGER) END), lambda v: v IS NOT NULL) END)"""


def _synonym_rows() -> str:
    from ..operators.linking import COUNTRY_SYNONYMS
    return ", ".join(
        "('" + c + "', [" + ", ".join("[" + ", ".join(f"'{w}'" for w in ph.split()) + "]" for ph in phs) + "])"
        for c, phs in COUNTRY_SYNONYMS.items())


def _trademark_sql():
    from ..operators.linking import COUNTRY_ADJECTIVES
    adj_rows = ", ".join(f"('{c}', '{a}')" for c, a in COUNTRY_ADJECTIVES.items())
    syn_rows = _synonym_rows()
    return _pairs_lex_sql() + f""",
ctr_rows AS (
  SELECT 'S' || s.s_suppkey AS subject,
         'Port' || translate(lpad(CAST(s.s_suppkey % 100 AS VARCHAR), 2, '0'), '0123456789', 'aeioubcdfg') AS label,
         'N' || n.n_nationkey AS object, n.nlabel AS olabel, s.s_suppkey AS rank
  FROM supplier s JOIN nat n ON s.s_nationkey = n.n_nationkey
  UNION ALL SELECT 'N' || n_nationkey, nlabel, 'N' || n_nationkey, nlabel, n_nationkey FROM nat),
ctr_k AS (SELECT lower(label) AS query, lower(olabel) AS c,
                 row_number() OVER (PARTITION BY lower(label) ORDER BY rank, subject, object) AS rk FROM ctr_rows),
countries AS (SELECT query, c AS object FROM ctr_k WHERE rk <= 10 GROUP BY query, c),
adj AS (SELECT * FROM (VALUES {adj_rows}) AS t(country, adjective)),
syn AS (SELECT * FROM (VALUES {syn_rows}) AS t(country, phrases)),
cands AS (SELECT DISTINCT pair_id, lower(tok) AS subject FROM tok1
          WHERE pos IN ('PROPN', 'NOUN', 'X', 'ADJ') AND regexp_matches(tok, '\\p{{Lu}}')),
j AS (
  SELECT c.pair_id, c.subject, k.object,
         lower(a.adjective) AS adjw, s1.phrases AS phrases, s2.phrases AS phrases2
  FROM cands c JOIN countries k ON k.query = c.subject
  LEFT JOIN adj a ON a.country = {_INITCAP_SQL('k.object')}
  LEFT JOIN syn s1 ON s1.country = k.object
  LEFT JOIN syn s2 ON s2.country = lower(a.adjective)),
si AS (
  SELECT j.pair_id, j.subject, j.object,
         (SELECT list(CAST(t.i - 1 AS INTEGER) ORDER BY t.i) FROM tok1 t
          WHERE t.pair_id = j.pair_id AND lower(t.tok) = j.subject) AS s_ind,
         {hits('j.object', 'j.phrases')} AS name_hits,
         CASE WHEN j.adjw IS NOT NULL THEN {hits('j.adjw', 'j.phrases2')} ELSE []::INTEGER[] END AS adj_hits
  FROM j JOIN tagged tg ON tg.pair_id = j.pair_id),
oi AS (SELECT *, list_filter(list_concat(name_hits, adj_hits),
                             lambda v, k: list_position(list_concat(name_hits, adj_hits), v) = k) AS o_ind FROM si),
ok AS (SELECT * FROM oi WHERE len(s_ind) > 0 AND len(o_ind) > 0),
fo AS (SELECT pair_id, object,
              list(struct_pack(subject := subject, s_ind := s_ind, o_ind := o_ind) ORDER BY s_ind[1], subject) AS xs
       FROM ok GROUP BY pair_id, object)
SELECT pair_id, 'trademark' AS data_type, object,
       array_to_string(flatten(list_transform(xs, lambda x: list_transform(x.s_ind, lambda k: x.subject))), ',') AS subjects,
       array_to_string(flatten(list_transform(xs, lambda x: x.s_ind)), ',') AS subject_ind,
       array_to_string(xs[1].o_ind, ',') AS object_ind,
       NULL::VARCHAR AS feature_type
FROM fo"""


def _INITCAP_SQL(x):
    return (f"array_to_string(list_transform(string_split(lower({x}), ' '), "
            f"lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ')")


def _location_sql():
    from .q_kg import TRIPLES_SQL, _TOP_SQL
    picked = "WITH RECURSIVE " + TRIPLES_SQL + "," + _TOP_SQL + "\nSELECT * FROM picked"
    return _pairs_lex_sql() + f""",
places AS (SELECT query, CASE WHEN country = 'United States of America' THEN lower(first_state)
                              WHEN country IS NOT NULL THEN lower(country) END AS object FROM ({picked})),
syn AS (SELECT * FROM (VALUES {_synonym_rows()}) AS t(country, phrases)),
cands AS (SELECT DISTINCT pair_id, lower(tok) AS subject FROM tok1
          WHERE pos = 'PROPN' AND regexp_matches(tok, '^\\p{{L}}+$') AND lower(tok) NOT IN (SELECT lower(nlabel) FROM nat)),
j AS (SELECT c.pair_id, c.subject, p.object, s.phrases FROM cands c JOIN places p ON p.query = c.subject
      LEFT JOIN syn s ON s.country = p.object WHERE p.object IS NOT NULL),
si AS (
  SELECT j.pair_id, j.subject, j.object,
         (SELECT list(CAST(t.i - 1 AS INTEGER) ORDER BY t.i) FROM tok1 t
          WHERE t.pair_id = j.pair_id AND lower(t.tok) = j.subject) AS s_ind,
         {hits('j.object', 'j.phrases')} AS o_ind
  FROM j JOIN tagged tg ON tg.pair_id = j.pair_id),
ok AS (SELECT * FROM si WHERE len(s_ind) > 0 AND len(o_ind) > 0),
fo AS (SELECT pair_id, object,
              list(struct_pack(subject := subject, s_ind := s_ind, o_ind := o_ind) ORDER BY s_ind[1], subject) AS xs
       FROM ok GROUP BY pair_id, object)
SELECT pair_id, 'location' AS data_type, object,
       array_to_string(flatten(list_transform(xs, lambda x: list_transform(x.s_ind, lambda k: x.subject))), ',') AS subjects,
       array_to_string(flatten(list_transform(xs, lambda x: x.s_ind)), ',') AS subject_ind,
       array_to_string(xs[1].o_ind, ',') AS object_ind,
       NULL::VARCHAR AS feature_type
FROM fo"""


@query("link_location", _location_sql(), ("J-11", "J-08", "NLP-04", "STR-15", "STR-22", "AGG-09"))
def q_link_location(spark, sf_dir):
    return _show(_links(spark, sf_dir, "location"))


@query("link_trademark", _trademark_sql(), ("J-13", "J-06", "J-05", "NLP-05", "STR-10", "STR-23", "AGG-09"))
def q_link_trademark(spark, sf_dir):
    return _show(_links(spark, sf_dir, "trademark"))


def _color_sql():
    return _pairs_lex_sql() + """,
nb1 AS (SELECT pair_id, i, g, pos,
               string_agg(CASE pos WHEN 'DET' THEN 'D' WHEN 'ADJ' THEN 'A' WHEN 'NOUN' THEN 'N' WHEN 'PROPN' THEN 'N' ELSE 'x' END, '')
                 OVER (PARTITION BY pair_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest,
               lag(tok) OVER (PARTITION BY pair_id ORDER BY i) AS pt,
               lead(tok) OVER (PARTITION BY pair_id ORDER BY i) AS nt FROM tok1),
heads AS (SELECT DISTINCT pair_id, g FROM nb1
          WHERE regexp_matches(rest, '^N') AND NOT regexp_matches(rest, '^NA*N')
            AND NOT coalesce(pt = '-', false) AND NOT coalesce(nt = '-', false)),
ft AS (
  SELECT split_part(p_name, ' ', 2) AS noun, p_partkey AS rank, 'P' || p_partkey AS subject,
         CASE split_part(p_name, ' ', 1) WHEN 'red' THEN 'color' WHEN 'blue' THEN 'color' WHEN 'small' THEN 'shape'
              WHEN 'large' THEN 'shape' WHEN 'old' THEN 'material' WHEN 'new' THEN 'material' END AS feature_type,
         split_part(p_name, ' ', 1) AS feature
  FROM part WHERE split_part(p_name, ' ', 1) IN ('red', 'blue', 'small', 'large', 'old', 'new')),
ftk AS (SELECT *, row_number() OVER (PARTITION BY noun ORDER BY rank, subject, feature_type, feature) AS rk FROM ft),
feats AS (SELECT DISTINCT noun, feature_type,
                 CASE WHEN feature_type = 'shape' AND feature = 'round' THEN 'sphere' ELSE feature END AS feature
          FROM ftk WHERE rk <= 10 AND NOT (feature_type = 'color' AND strpos('color', feature) > 0)),
nc AS (SELECT noun, count(*) AS ncolors FROM feats WHERE feature_type = 'color' GROUP BY noun),
f AS (SELECT feats.* FROM feats LEFT JOIN nc USING (noun)
      WHERE feature_type <> 'color' OR coalesce(ncolors, 0) <= 1),
j AS (SELECT h.pair_id, h.g AS subject, f.feature AS object, f.feature_type FROM heads h JOIN f ON f.noun = h.g),
si AS (
  SELECT j.*,
    (SELECT list(CAST(t.i - 1 AS INTEGER) ORDER BY t.i) FROM tok1 t WHERE t.pair_id = j.pair_id AND t.g = j.subject) AS s_ind,
    (SELECT list_reduce(
        list_filter(range(0, greatest(len(tg.l2) - len(string_split(j.object, ' ')) + 1, 0)),
                    lambda k: tg.l2[k + 1 : k + len(string_split(j.object, ' '))] = string_split(j.object, ' ')),
        lambda acc, k: CASE WHEN k >= acc.nxt
                            THEN {'a': list_append(acc.a, CAST(k AS INTEGER)), 'nxt': k + len(string_split(j.object, ' ')) + 1}
                            ELSE acc END,
        {'a': []::INTEGER[], 'nxt': 0}).a
     FROM tagged tg WHERE tg.pair_id = j.pair_id) AS o_ind
  FROM j),
ok AS (SELECT * FROM si WHERE len(s_ind) > 0 AND len(o_ind) > 0),
fo AS (SELECT pair_id, object,
              list(struct_pack(subject := subject, s_ind := s_ind, o_ind := o_ind, feature_type := feature_type)
                   ORDER BY s_ind[1], subject, s_ind, o_ind, feature_type) AS xs
       FROM ok GROUP BY pair_id, object)
SELECT pair_id, 'color' AS data_type, object,
       array_to_string(flatten(list_transform(xs, lambda x: list_transform(x.s_ind, lambda k: x.subject))), ',') AS subjects,
       array_to_string(flatten(list_transform(xs, lambda x: x.s_ind)), ',') AS subject_ind,
       array_to_string(xs[1].o_ind, ',') AS object_ind,
       xs[1].feature_type AS feature_type
FROM fo"""


@query("link_color", _color_sql(), ("J-12", "J-09", "NLP-03", "STR-14", "AGG-09"))
def q_link_color(spark, sf_dir):
    return _show(_links(spark, sf_dir, "color"))


def all_links(spark, sf_dir):
    return linking.run_linkers(annotated(spark, sf_dir), linkers(spark, sf_dir))


def _offsets(spark, sf_dir):
    """Word-piece stand-in: each lower-case word in 4-character pieces."""
    p = B.pairs(spark, sf_dir)
    out = p
    for i, side in ((1, "a"), (2, "b")):
        words = F.transform(linking.tokens(F.col(f"s{i}")), lambda x: F.lower(x))
        pieces = F.flatten(F.transform(words, lambda w: F.transform(
            F.sequence(F.lit(0), F.floor((F.length(w) - 1) / 4).cast("int")),
            lambda k: F.concat(F.when(k > 0, F.lit("##")).otherwise(F.lit("")), F.substring(w, k * 4 + 1, 4)))))
        out = out.withColumn(f"pieces_{side}", pieces)
        out = out.withColumn(f"offsets_{side}", F.col(f"pieces_{side}"))
        from ..functions.text import rejoin_pieces
        out = out.withColumn(f"offsets_{side}", rejoin_pieces(f"pieces_{side}")["offsets"])
    return out.select("pair_id", "offsets_a", "offsets_b")


def _index_sql():
    tok = r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"
    pairs_sql = _pairs_lex_sql()
    body = " UNION ALL BY NAME ".join(f"SELECT * FROM ({q})" for q in (_isa_sql(), _location_sql(), _trademark_sql(), _color_sql()))
    ints = "list_transform(string_split({c}, ','), lambda x: CAST(x AS BIGINT))"
    return pairs_sql + f""",
links AS (SELECT pair_id, data_type, object, {ints.format(c='subject_ind')} AS si, {ints.format(c='object_ind')} AS oi
          FROM ({body}) WHERE data_type <> 'color' OR feature_type = 'color'),
wds AS (SELECT pair_id, list_transform(regexp_extract_all(s1, '{tok}'), lambda x: length(x)) AS w1,
               list_transform(regexp_extract_all(s2, '{tok}'), lambda x: length(x)) AS w2 FROM pairs),
offs AS (SELECT pair_id,
                list_transform(range(0, len(w1)), lambda i: coalesce(list_sum(list_transform(w1[1:i], lambda x: (x + 3) // 4)), 0)) AS oa,
                list_transform(range(0, len(w2)), lambda i: coalesce(list_sum(list_transform(w2[1:i], lambda x: (x + 3) // 4)), 0)) AS ob
         FROM wds)"""


def _index_names_sql():
    names = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in linking.LINK_NAMES.items())
    return _index_sql() + f""",
ex AS (SELECT l.pair_id, l.data_type, l.object, u.k, o.oa[u.idx + 1] AS piece
       FROM links l JOIN offs o ON o.pair_id = l.pair_id, unnest(l.si) WITH ORDINALITY AS u(idx, k))
SELECT pair_id, data_type, CAST(piece AS INTEGER) AS piece,
       array_to_string(list(CASE data_type {names} END || ' ' || object ORDER BY object, k), '|') AS links
FROM ex GROUP BY pair_id, data_type, piece"""


def _index_sets_sql():
    return _index_sql() + """,
a AS (SELECT l.pair_id, l.data_type, list_sort(list(DISTINCT o.oa[u.idx + 1])) AS xs
      FROM links l JOIN offs o ON o.pair_id = l.pair_id, unnest(l.si) AS u(idx) GROUP BY ALL),
b AS (SELECT l.pair_id, l.data_type, list_sort(list(DISTINCT o.ob[u.idx + 1])) AS xs
      FROM links l JOIN offs o ON o.pair_id = l.pair_id, unnest(l.oi) AS u(idx) GROUP BY ALL)
SELECT a.pair_id, a.data_type, array_to_string(list_transform(a.xs, lambda x: CAST(x AS BIGINT)), ',') AS a_indices,
       array_to_string(list_transform(b.xs, lambda x: CAST(x AS BIGINT)), ',') AS b_indices
FROM a JOIN b ON b.pair_id = a.pair_id AND b.data_type = a.data_type"""


@query("link_index_names", _index_names_sql(), ("AGG-10", "NLP-07", "UDF-04", "STR-12"))
def q_link_index_names(spark, sf_dir):
    r = linking.index_names(all_links(spark, sf_dir), _offsets(spark, sf_dir).select("pair_id", "offsets_a"))
    return r.select("pair_id", "data_type", F.col("piece").cast("int").alias("piece"),
                    F.array_join("links", "|").alias("links"))


@query("link_index_sets", _index_sets_sql(), ("AGG-11",))
def q_link_index_sets(spark, sf_dir):
    r = linking.index_sets(all_links(spark, sf_dir), _offsets(spark, sf_dir))
    return r.select("pair_id", "data_type",
                    F.array_join(F.transform("a_indices", lambda x: x.cast("string")), ",").alias("a_indices"),
                    F.array_join(F.transform("b_indices", lambda x: x.cast("string")), ",").alias("b_indices"))


def _all_links_sql():
    return "SELECT * FROM (" + ") UNION ALL BY NAME SELECT * FROM (".join(
        (_isa_sql(), _location_sql(), _trademark_sql(), _color_sql())) + ")"


@query("links_resumed", _all_links_sql(), ("SNK-06", "J-18", "NLP-07", "STR-16"))
def q_links_resumed(spark, sf_dir):
    """Links of the four types: a first run over every other pair, then one over
    all pairs that takes the first one's links from the store."""
    pairs = stage(B.pairs(spark, sf_dir), "pairs")
    tagger, path = lookup(B.lexicon(spark, sf_dir)), scratch_path(spark, "link-store")
    types = linkers(spark, sf_dir)
    resumed_links(pairs.where(F.col("pair_id") % 2 == 0), tagger, path, types)
    return _show(resumed_links(pairs, tagger, path, types))
