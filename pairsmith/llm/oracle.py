"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

import math

from .decontam import WINDOW
from .license_scan import MIN_DICE, TEMPLATES, reach, template_bigrams
from .mixing import MAX_COPIES
from . import secret_links as S

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLANKS = r"[\x20\x09-\x0D]+"


def decontam_sql(window: int = WINDOW) -> str:
    words = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    grams = "list_transform(range(1, len(w) - size + 2), lambda k: {{'k': k, 'win': array_to_string(w[k:k + size - 1], ' ')}})"
    grams = grams.replace("{{", "{").replace("}}", "}")
    return f"""
WITH d AS (SELECT doc_id, {words} AS w FROM documents),
b AS (SELECT item_id, {words} AS w FROM benchmark),
bw AS (SELECT item_id, size, unnest({grams}) AS g
       FROM (SELECT *, least({window}, len(w)) AS size FROM b) WHERE size > 0),
wins AS (SELECT DISTINCT item_id, size, g.win AS win FROM bw),
dg AS (SELECT doc_id, size, unnest({grams}) AS g FROM d, (SELECT DISTINCT size FROM wins)),
hits AS (SELECT DISTINCT dg.doc_id, dg.g.k AS k, dg.size, wins.item_id FROM dg JOIN wins ON wins.size = dg.size AND wins.win = dg.g.win),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit
      FROM (SELECT doc_id, unnest(range(k, k + size)) AS p FROM (SELECT DISTINCT doc_id, k, size FROM hits)) GROUP BY doc_id),
i AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS ids FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit,
       CAST(coalesce(len(i.ids), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(i.ids, ','), '')) AS items_sha256,
       h.n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN i ON i.doc_id = d.doc_id"""


def licences_sql() -> str:
    low, high = MIN_DICE / (2 - MIN_DICE) * (1 - 1e-9), (2 - MIN_DICE) / MIN_DICE * (1 + 1e-9)
    grams = [(i, name, template_bigrams(t)) for i, (name, t) in enumerate(TEMPLATES)]
    rows = ", ".join(f"({i}, '{name}', {max(math.ceil(len(g) * low), 1)}, {reach(len(g), high)}, ["
                     + ", ".join(f"'{x}'" for x in g) + "])" for i, name, g in grams)
    words = "list_filter(string_split(translate({x}, chr(10), ' '), ' '), lambda y: y <> '')"
    pairs = "list_distinct(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]))"
    near = MIN_DICE * (1 - 1e-9)
    return rf"""
WITH t AS (SELECT * FROM (VALUES {rows}) AS v(template, licence, need, reach, g)),
d AS (SELECT doc_id, regexp_replace(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g') AS s
      FROM documents),
bl AS (SELECT doc_id, s, regexp_split_to_array(s, '\n[ \n]*\n') AS b FROM d),
parts AS (SELECT doc_id, 0 AS kind, unnest(string_split(s, chr(10))) AS x, generate_subscripts(string_split(s, chr(10)), 1) AS i FROM bl
          UNION ALL SELECT doc_id, 1, unnest(b), generate_subscripts(b, 1) FROM bl
          UNION ALL SELECT doc_id, 2, s, 1 FROM bl WHERE len(b) > 1),
w AS (SELECT doc_id, kind, i, kind <> 1 OR contains(x, chr(10)) AS unit, {words.format(x="x")} AS w FROM parts),
f AS (SELECT *, sum(len(w)) OVER (PARTITION BY doc_id, kind ORDER BY i ROWS UNBOUNDED PRECEDING) - len(w) AS k0 FROM w),
u AS (SELECT doc_id, kind, i, k0, len(w) AS n_words, {pairs} AS g FROM f WHERE unit AND len(w) > 1),
m AS (SELECT u.doc_id, u.kind, u.i, u.k0, u.n_words, t.template, t.licence, 2.0 * len(list_intersect(u.g, t.g)) / (len(u.g) + len(t.g)) AS dice
      FROM u JOIN t ON len(u.g) BETWEEN len(t.g) * {low} AND len(t.g) * {high}
      WHERE 2.0 * len(list_intersect(u.g, t.g)) / (len(u.g) + len(t.g)) >= {MIN_DICE}),
-- places of the templates' bigrams outside matching units
x AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) - 1 AS k, w AS ws
      FROM (SELECT doc_id, {words.format(x="s")} AS w FROM d)),
tb AS (SELECT template, need, reach, len(g) AS n, unnest(g) AS bg FROM t),
h AS (SELECT x.doc_id, x.k, tb.template, tb.need, tb.reach, tb.n, tb.bg FROM x JOIN tb ON tb.bg = x.w || ' ' || x.ws[x.k + 2]
      WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.doc_id = x.doc_id AND x.k >= m.k0 AND x.k + 1 < m.k0 + m.n_words)),
p AS (SELECT *, row_number() OVER (PARTITION BY doc_id, template ORDER BY k) AS x FROM h),
hs AS (SELECT doc_id, template, list(bg ORDER BY k) AS bgs FROM h GROUP BY ALL),
lines AS (SELECT f.doc_id, f.k0, len(f.w) AS n_words, len(u.g) AS size FROM f LEFT JOIN u ON u.doc_id = f.doc_id AND u.kind = 0 AND u.i = f.i
          WHERE f.kind = 0),
e AS (SELECT a.doc_id, a.template, a.n, a.k AS a, b.k AS b, b.x - a.x + 1 AS hits, len(list_distinct(hs.bgs[a.x:b.x])) AS shared,
             coalesce((SELECT max(l.size BETWEEN a.n * {low} AND a.n * {high}) FROM lines l
                       WHERE l.doc_id = a.doc_id AND a.k >= l.k0 AND b.k + 1 < l.k0 + l.n_words), false) AS compared
      FROM p a JOIN p b ON b.doc_id = a.doc_id AND b.template = a.template AND b.x - a.x + 1 BETWEEN a.need AND a.need + a.reach - 1
      JOIN hs ON hs.doc_id = a.doc_id AND hs.template = a.template),
sc AS (SELECT doc_id, template, a, b, 2.0 * shared / (n + CASE WHEN compared THEN greatest(b - a + 1 - hits + shared, n)
                                                           ELSE b - a + 1 - hits + shared END) AS dice FROM e),
best AS (SELECT * FROM sc WHERE dice >= {near} QUALIFY row_number() OVER (PARTITION BY doc_id, template, a ORDER BY -dice, b) = 1),
sweep AS (SELECT doc_id, template, list_reduce(list({{'a': a, 'b': b, 'd': dice, 'out': []::DOUBLE[]}} ORDER BY a), lambda got, y: CASE
            WHEN y.a > got.b THEN {{'a': y.a, 'b': y.b, 'd': y.d, 'out': list_append(got.out, got.d)}}
            WHEN y.d > got.d THEN {{'a': y.a, 'b': y.b, 'd': y.d, 'out': got.out}} ELSE got END) AS r FROM best GROUP BY ALL),
al AS (SELECT doc_id, template, licence, dice FROM m
       UNION ALL SELECT doc_id, template, licence, unnest(list_append(r.out, r.d)) FROM sweep JOIN t USING (template)),
a AS (SELECT doc_id, arg_min(licence, (-dice, template)) AS licence, max(dice) AS dice, count(*) AS n,
             array_to_string(list_sort(list(DISTINCT licence)), ',') AS licences
      FROM al GROUP BY doc_id)
SELECT d.doc_id, a.licence, CAST(a.dice AS DOUBLE) AS dice, CAST(coalesce(a.n, 0) AS BIGINT) AS n_matches,
       coalesce(a.licences, '') AS licences
FROM d LEFT JOIN a ON a.doc_id = d.doc_id"""


def mixing_sql(weights: tuple[int, ...] = (5, 2, 1), max_copies: int = MAX_COPIES) -> str:
    return rf"""
WITH d AS (SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '{_BLANKS}'), lambda x: x <> '')) AS BIGINT) AS size,
                  md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM s),
s2 AS (SELECT *, CAST({list(weights)}[nth % {len(weights)} + 1] AS DOUBLE) AS w, CAST(source_size * {max_copies} AS DOUBLE) AS cap FROM s1),
s3 AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE)
                  - coalesce(sum(cap) OVER (ORDER BY cap / w, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                 / (sum(w) OVER ()
                  - coalesce(sum(w) OVER (ORDER BY cap / w, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM s2),
s4 AS (SELECT source, source_size, least(cap, w * (SELECT arg_min(level, (cap / w, nth)) FROM s3 WHERE cap >= w * level)) AS target FROM s3),
p AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS ratio FROM s4),
plan AS (SELECT *, CAST(floor(ratio) AS BIGINT) AS whole, target - floor(ratio) * source_size AS rest FROM p),
r AS (SELECT d.*, plan.source_size, plan.target, plan.whole, plan.rest, plan.ratio - plan.whole AS pr,
             CAST(sum(size) OVER (PARTITION BY d.source ORDER BY CASE WHEN size > 0 THEN 0 ELSE 1 END, h) AS DOUBLE) AS total,
             sum(size) OVER (PARTITION BY d.source, h) AS grp
      FROM d JOIN plan ON plan.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN pr > 0 AND (total <= rest OR total - rest < rest - (total - grp)) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r"""


def secrets_sql(scope: int = S.SCOPE) -> str:
    mixed = ("(regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]')) OR "
             "regexp_matches(v, '[:=]')")
    kinds = ((S.ASSIGN, 1, "length(v) >= 8"), (S.ACCESS_LONG, 0, "true"), (S.HEX_LONG, 0, "true"), (S.WEAK_ID, 0, "true"),
             (S.WEAK_SECRET, 0, mixed), (S.ENDPOINT, 0, "true"))
    parts = []
    for kind, (pattern, group, ok) in enumerate(kinds):
        p = pattern.replace("'", "''")
        parts.append(f"""
  SELECT doc_id, {kind} AS kind, s, e FROM (
    SELECT doc_id, x.v AS v, x.s AS s, x.s + length(x.m) AS e FROM (
      SELECT doc_id, unnest(list_transform(range(1, len(m) + 1), lambda k: {{'m': m[k], 'v': v[k],
               's': list_sum(list_transform(g[1:k], lambda y: length(y)))
                    + coalesce(list_sum(list_transform(m[1:k - 1], lambda y: length(y))), 0)}})) AS x
      FROM (SELECT doc_id, regexp_split_to_array(text, '{p}') AS g, regexp_extract_all(text, '{p}') AS m,
                   regexp_extract_all(text, '{p}', {group}) AS v FROM documents WHERE regexp_matches(text, '{p}')))) WHERE {ok}""")
    names = " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(S.KINDS))

    def near(kinds_of_role: str) -> str:
        return f"""EXISTS (SELECT 1 FROM q WHERE q.doc_id = p.doc_id AND q.kind IN ({kinds_of_role})
             AND (q.s, q.kind, q.e) <> (p.s, p.kind, p.e)
             AND CASE WHEN (q.s, q.kind, q.e) < (p.s, p.kind, p.e) THEN p.s - q.e ELSE q.s - p.e END <= {scope})"""
    text = "CASE kind " + names + " END || ':' || CAST(CAST(s AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(e AS BIGINT) AS VARCHAR)"
    return f"""
WITH parts AS ({" UNION ALL ".join(parts)}),
q AS (SELECT * FROM parts p WHERE kind < 3 OR NOT EXISTS (
        SELECT 1 FROM parts b WHERE b.doc_id = p.doc_id AND b.kind < 3 AND b.s < p.e AND b.e > p.s)),
rep AS (SELECT * FROM q p WHERE kind < 3 OR (kind = 3 AND {near('0, 2, 4')}) OR (kind = 4 AND {near('1, 3')})
        OR (kind = 5 AND {near('0, 2, 4')} AND {near('1, 3')})),
a AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n0, count(*) FILTER (kind = 1) AS n1, count(*) FILTER (kind = 2) AS n2,
             string_agg({text}, ',' ORDER BY s, kind) FILTER (kind < 3) AS base, string_agg({text}, ',' ORDER BY s, kind) AS spans
      FROM rep GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n0, 0) AS BIGINT) AS n_assign, CAST(coalesce(n1, 0) AS BIGINT) AS n_access,
       CAST(coalesce(n2, 0) AS BIGINT) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN a ON a.doc_id = d.doc_id"""


def hard_negatives_sql() -> str:
    return """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
             CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
      FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT CAST(p.anchor_id AS BIGINT) AS anchor_id, CAST(p.id AS BIGINT) AS positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) AS INTEGER) AS rank,
       CAST(n.id AS BIGINT) AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.score <= 100 * n.score AND n.score <= p.score
QUALIFY rank <= 5"""
