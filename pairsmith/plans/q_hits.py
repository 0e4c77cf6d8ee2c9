"""Answer-sheet queries: expansion per parser, quarantine, review rows.

The sheet stand-in has one row per part: the premise names the part's item
(the hyponym), the hypernym is its type, and the comma lists hold the items
of the next parts (a bounded self-join on computed keys, never a per-brand
collect).  Size-driven variants plant each failure rule of the parsers:
empty cells, a wrong-length label list, a word missing from a text, plurals,
``(1)`` prefixes, single-item lists, stray braces, leading spaces.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import word_position_sql
from ..operators import hits as H
from ..session import read_table
from .catalog import query

LABELS = ("entailment", "neutral", "contradiction")


def _lab(k: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in LABELS]), (k % 3 + 1).cast("int"))


def answer_sheet(spark, sf_dir):
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    item = F.split_part("p_name", F.lit(" "), F.lit(2))
    # neighbour items: row k of the result holds the items of parts k+1 .. k+4
    nbrs = (part.select(F.explode(F.array(*[
        F.struct((F.col("p_partkey") - d).alias("k"), F.lit(d).alias("d"), item.alias("it"))
        for d in (1, 2, 3, 4)])).alias("n")).select("n.*")
        .groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("d", "it"))).alias("nb")))
    s = part.join(nbrs, part.p_partkey == nbrs.k, "left")
    sz = F.col("p_size")
    hyper = F.concat(F.lower("p_type"), F.lit(" part"))
    nb = [F.col("nb").getItem(d) for d in (1, 2, 3, 4)]
    sep = F.when(sz % 5 == 0, F.lit(", ")).otherwise(F.lit(","))
    adj = F.split_part("p_name", F.lit(" "), F.lit(1))
    premise = F.concat(
        F.when(sz % 6 == 0, F.concat(F.lit("The "), adj, F.lit(" "), item, F.lit("s were shipped by "),
                                     F.col("p_brand")))
        .otherwise(F.concat(F.lit("The "), F.col("p_name"), F.lit(" was shipped by "), F.col("p_brand"))),
        F.when(sz % 23 == 0, F.lit(" {x}")).otherwise(F.lit("")))
    two = lambda a, b: F.concat(_lab(sz + a), F.lit(","), _lab(sz + b))
    cols = {
        H.C_PREMISE: premise,
        H.C_WORKER: F.concat(F.lit("W"), (F.col("p_partkey") % 13).cast("string")),
        H.C_HIT: F.concat(F.lit("H"), F.col("p_partkey").cast("string")),
        H.C_SUBMIT: F.when(sz % 2 == 0, "{}").when(sz % 3 == 0, " {} ").otherwise("home"),
        H.C_HYPO: item,
        H.C_HYPER: hyper,
        H.C_L1B: F.when(sz % 17 == 0, F.lit("{}")).otherwise(_lab(sz)),
        H.C_HYPOS: F.call_function("concat_ws", sep, nb[0], nb[1]),
        H.C_L2B2: two(1, 2),
        H.C_L2B1: F.when(sz % 7 == 0, F.concat(two(0, 1), F.lit(","), _lab(sz + 2)))
        .when(sz % 19 == 0, F.lit("{}")).otherwise(two(2, 0)),
        H.C_NON: F.when(sz % 29 == 0, F.lit("{}")).when(sz % 4 == 0, nb[2])
        .otherwise(F.call_function("concat_ws", sep, nb[2], nb[3])),
        H.C_L3B1: F.when(sz % 4 == 0, _lab(sz)).otherwise(two(0, 1)),
        H.C_L3B2: F.when(sz % 4 == 0, _lab(sz + 2)).otherwise(two(2, 1)),
        H.C_P4: F.concat(F.when(sz % 2 == 0, F.lit("")).otherwise(F.lit("(1) ")), F.lit("The "), hyper,
                         F.lit(" arrived")),
        H.C_4A: F.concat(F.lit("A "), item, F.lit(" arrived")),
        H.C_4B: F.when(sz % 11 == 0, F.lit("A thing arrived")).otherwise(
            F.concat(F.lit("A "), nb[2], F.lit(" arrived"))),
        H.C_4AL: _lab(sz + 3), H.C_4BL: _lab(sz + 4),
        H.C_P5: F.concat(F.lit("(2) The "), F.col("p_name"), F.lit(" arrived")),
        H.C_5A: F.concat(F.lit("A "), hyper, F.lit(" came")),
        H.C_5B: F.concat(F.lit("A "), nb[2], F.lit(" came")),
        H.C_5AL: _lab(sz + 5), H.C_5BL: _lab(sz + 6),
    }
    return s.select(F.col("p_partkey").alias("row_id"), *[c.alias(n) for n, c in cols.items()])


def _labsql(k: str) -> str:
    return f"['entailment','neutral','contradiction'][(({k}) % 3) + 1]"


def _two(a: int, b: int) -> str:
    return f"{_labsql(f'p_size + {a}')} || ',' || {_labsql(f'p_size + {b}')}"


SHEET_SQL = f"""
nb AS (
  SELECT p.p_partkey, p.p_name, p.p_brand, p.p_type, p.p_size,
         split_part(p.p_name, ' ', 2) AS item, split_part(p.p_name, ' ', 1) AS adj,
         lower(p.p_type) || ' part' AS hyper,
         CASE WHEN p.p_size % 5 = 0 THEN ', ' ELSE ',' END AS sep,
         split_part(n1.p_name, ' ', 2) AS nb1, split_part(n2.p_name, ' ', 2) AS nb2,
         split_part(n3.p_name, ' ', 2) AS nb3, split_part(n4.p_name, ' ', 2) AS nb4
  FROM part p
  LEFT JOIN part n1 ON n1.p_partkey = p.p_partkey + 1
  LEFT JOIN part n2 ON n2.p_partkey = p.p_partkey + 2
  LEFT JOIN part n3 ON n3.p_partkey = p.p_partkey + 3
  LEFT JOIN part n4 ON n4.p_partkey = p.p_partkey + 4
),
sheet AS (
  SELECT p_partkey AS row_id,
    CASE WHEN p_size % 6 = 0 THEN 'The ' || adj || ' ' || item || 's were shipped by ' || p_brand
         ELSE 'The ' || p_name || ' was shipped by ' || p_brand END
      || CASE WHEN p_size % 23 = 0 THEN ' {{x}}' ELSE '' END AS premise,
    'W' || CAST(p_partkey % 13 AS VARCHAR) AS worker_id,
    'H' || CAST(p_partkey AS VARCHAR) AS hit_id,
    CASE WHEN p_size % 2 = 0 THEN '{{}}' WHEN p_size % 3 = 0 THEN ' {{}} ' ELSE 'home' END AS submit,
    item AS hypo, hyper,
    CASE WHEN p_size % 17 = 0 THEN '{{}}' ELSE {_labsql('p_size')} END AS l1b,
    concat_ws(sep, nb1, nb2) AS hypos_s,
    {_two(1, 2)} AS l2b2,
    CASE WHEN p_size % 7 = 0 THEN {_two(0, 1)} || ',' || {_labsql('p_size + 2')}
         WHEN p_size % 19 = 0 THEN '{{}}' ELSE {_two(2, 0)} END AS l2b1,
    CASE WHEN p_size % 29 = 0 THEN '{{}}' WHEN p_size % 4 = 0 THEN nb3 ELSE concat_ws(sep, nb3, nb4) END AS non_s,
    CASE WHEN p_size % 4 = 0 THEN {_labsql('p_size')} ELSE {_two(0, 1)} END AS l3b1,
    CASE WHEN p_size % 4 = 0 THEN {_labsql('p_size + 2')} ELSE {_two(2, 1)} END AS l3b2,
    CASE WHEN p_size % 2 = 0 THEN '' ELSE '(1) ' END || 'The ' || hyper || ' arrived' AS p4_raw,
    'A ' || item || ' arrived' AS t4a,
    CASE WHEN p_size % 11 = 0 THEN 'A thing arrived' ELSE 'A ' || nb3 || ' arrived' END AS t4b,
    {_labsql('p_size + 3')} AS l4a, {_labsql('p_size + 4')} AS l4b,
    '(2) The ' || p_name || ' arrived' AS p5_raw,
    'A ' || hyper || ' came' AS t5a,
    'A ' || nb3 || ' came' AS t5b,
    {_labsql('p_size + 5')} AS l5a, {_labsql('p_size + 6')} AS l5b
  FROM nb
)"""


def _q(x: str) -> str:
    return x.replace("'", "''")


def _reason(checks) -> str:
    return "(CASE " + " ".join(f"WHEN {c} THEN '{r}'" for c, r in checks) + " END)"


# word positions computed once per sheet row in the ``pos`` CTE (as the Spark side does)
_POS = {("premise", "hypo"): "pos_ph", ("t4a", "hypo"): "pos_4a", ("t4b", "non0"): "pos_4b",
        ("p5", "hypo"): "pos_p5", ("t5b", "non0"): "pos_5b", ("p4", "hyper"): "pos_p4h",
        ("t5a", "hyper"): "pos_5ah"}


def _pos(s: str, old: str) -> str:
    return _POS.get((s, old)) or word_position_sql(s, old)


def _replace_checks(s: str, old: str):
    return [(f"{s} IS NULL OR {old} IS NULL", H.NULL), (f"contains({s}, '{{}}')", H.EMPTY),
            (f"contains({old}, '{{}}')", H.EMPTY), (f"{_pos(s, old)} = 0", H.NOT_FOUND),
            (f"contains({s}, '{{') OR contains({s}, '}}')", H.BRACE)]


def _list_checks(c: str):
    return [(f"{c} IS NULL", H.NULL), (f"contains({c}, '{{}}')", H.EMPTY)]


def _found(s: str, w: str):
    return [(f"{s} IS NULL OR {w} IS NULL", H.NULL), (f"{_pos(s, w)} = 0", H.NOT_FOUND)]


def _repl(s: str, old: str, new: str) -> str:
    pos = _pos(s, old)
    return f"(CASE WHEN {pos} > 0 THEN substr({s}, 1, {pos} - 1) || {new} || substr({s}, {pos} + length({old})) END)"


def _strip(c: str) -> str:
    return f"regexp_replace(substr({c}, strpos({c}, ')') + 1), '^\\s+|\\s+$', '', 'g')"


def _expand_sql() -> str:
    hs = _repl("premise", "hypo", "hyper")
    r = {
        "r1": _reason(_list_checks("l1b") + _replace_checks("premise", "hypo")),
        "r2a": _reason(_list_checks("hypos_s") + _replace_checks("premise", "hypo") + _list_checks("l2b2")
                       + [("len(string_split(l2b2, ',')) <> len(hypos)", H.LENGTH)]),
        "r2b": _reason(_list_checks("l2b1") + [("len(string_split(l2b1, ',')) <> len(hypos)", H.LENGTH)]),
        "r3a": _reason(_list_checks("non_s") + _replace_checks("premise", "hypo") + _list_checks("l3b1")
                       + [("len(string_split(l3b1, ',')) <> len(non)", H.LENGTH)]),
        "r3b": _reason(_list_checks("l3b2") + [("len(string_split(l3b2, ',')) <> len(non)", H.LENGTH)]),
        "r4": _reason(_list_checks("non_s") + [("p4_raw IS NULL", H.NULL)] + _found("p4", "hyper")
                      + _found("t4a", "hypo") + _found("t4b", "non0") + [("contains(p4, '{}')", H.EMPTY)]),
        "r5": _reason(_list_checks("non_s") + [("p5_raw IS NULL", H.NULL)] + _found("p5", "hypo")
                      + _found("t5a", "hyper") + _found("t5b", "non0") + [("contains(p5, '{}')", H.EMPTY)]),
        "r6": _reason([("p4_raw IS NULL OR p5_raw IS NULL", H.NULL)] + _list_checks("hypos_s")
                      + _list_checks("non_s") + _found("p4", "hyper") + _found("p5", "hypo")),
        "r6a": _reason(_replace_checks("t4a", "hypo")),
        "r6b": f"(CASE WHEN len(non) > 1 THEN {_reason(_replace_checks('t4b', 'non0'))} END)",
        "r6c": _reason(_replace_checks("p5", "hypo")),
        "r6d": f"(CASE WHEN len(non) > 1 THEN "
               f"{_reason(_replace_checks('p5', 'hypo') + _replace_checks('t5b', 'non0'))} END)",
    }
    base = """
base AS (
  SELECT *, string_split(hypos_s, ',') AS hypos, string_split(non_s, ',') AS non,
         string_split(non_s, ',')[1] AS non0,
         """ + _strip("p4_raw") + """ AS p4, """ + _strip("p5_raw") + """ AS p5,
         trim(submit) = '{}' AS is_complete
  FROM sheet
),
pos AS MATERIALIZED (
  SELECT *, """ + ",\n         ".join(f"{word_position_sql(a, b)} AS {c}" for (a, b), c in _POS.items()) + """
  FROM base
),
gated AS MATERIALIZED (
  SELECT *, """ + ",\n         ".join(f"{v} AS {k}" for k, v in r.items()) + """,
         """ + hs + """ AS hyper_sentence
  FROM pos
)"""

    def sel(parser, block, prem, hyp, label, pword, hword, ptype, htype, j, src, cond):
        sec = _q(H.SECTIONS[(parser, block)])
        return (f"SELECT {prem} AS premise, {hyp} AS hypothesis, {label} AS label, '{sec}' AS section, "
                f"{pword} AS pword, {hword} AS hword, '{ptype}' AS ptype, '{htype}' AS htype, "
                f"row_id, worker_id, hit_id, is_complete, {parser} AS parser, {block} AS block, "
                f"CAST({j} AS INTEGER) AS j FROM {src} WHERE {cond}")

    def lst(name):  # unnest a list with its 0-based index
        return (f"(SELECT *, unnest({name}) AS w, generate_subscripts({name}, 1) - 1 AS i FROM gated)")

    ok = lambda *rs: " AND ".join(f"{x} IS NULL" for x in rs)
    parts = [
        sel(1, 1, "premise", "hyper_sentence", "l1b", "hypo", "hyper", "hypo", "hyper", "0", "gated", ok("r1")),
        sel(2, 1, "hyper_sentence", _repl("premise", "hypo", "w"), "string_split(l2b2, ',')[i + 1]",
            "hyper", "w", "hyper", "hypo", "i", lst("hypos"), ok("r2a")),
        sel(2, 2, _repl("premise", "hypo", "w"), "hyper_sentence", "string_split(l2b1, ',')[i + 1]",
            "w", "hyper", "hypo", "hyper", "i", lst("hypos"), ok("r2a", "r2b")),
        sel(3, 1, _repl("premise", "hypo", "w"), "hyper_sentence", "string_split(l3b1, ',')[i + 1]",
            "w", "hyper", "nonhypo", "hyper", "i", lst("non"), ok("r3a")),
        sel(3, 2, "hyper_sentence", _repl("premise", "hypo", "w"), "string_split(l3b2, ',')[i + 1]",
            "hyper", "w", "hyper", "nonhypo", "i", lst("non"), ok("r3a", "r3b")),
        sel(4, 1, "p4", "t4a", "l4a", "hyper", "hypo", "hyper", "hypo", "0", "gated", ok("r4")),
        sel(4, 2, "p4", "t4b", "l5b", "hyper", "non0", "hyper", "nonhypo", "1", "gated", ok("r4")),
        sel(5, 1, "p5", "t5a", "l5a", "hypo", "hyper", "hypo", "hyper", "0", "gated", ok("r5")),
        sel(5, 2, "p5", "t5b", "l5b", "hypo", "non0", "hypo", "nonhypo", "1", "gated", ok("r5")),
        sel(6, 1, "p4", _repl("t4a", "hypo", "w"), "l4a", "hyper", "w", "hyper", "hypo", "i",
            lst("hypos"), ok("r6", "r6a")),
        sel(6, 2, "p4", _repl("t4b", "non0", "w"), "l4b", "hyper", "w", "hyper", "nonhypo", "i - 1",
            "(SELECT * FROM " + lst("non") + " WHERE i >= 1)", ok("r6", "r6a", "r6b")),
        sel(6, 3, _repl("p5", "hypo", "w"), "t5a", "l5a", "w", "hyper", "hypo", "hyper", "i",
            lst("hypos"), ok("r6", "r6a", "r6b", "r6c")),
        sel(6, 4, _repl("p5", "hypo", "w"), _repl("t5b", "non0", "nw"), "l5b", "w", "nw", "hypo", "nonhypo",
            "k * len(hypos) + i",
            "(SELECT *, unnest(hypos) AS w, generate_subscripts(hypos, 1) - 1 AS i FROM "
            "(SELECT *, unnest(non) AS nw, generate_subscripts(non, 1) - 2 AS k FROM gated) WHERE k >= 0)",
            ok("r6", "r6a", "r6b", "r6c", "r6d")),
    ]
    quarantine = " UNION ALL ".join(
        f"SELECT row_id, {p} AS parser, {rr} AS reason FROM gated" for p, rr in (
            (1, "r1"), (2, "coalesce(r2a, r2b)"), (3, "coalesce(r3a, r3b)"), (4, "r4"), (5, "r5"),
            (6, "coalesce(r6, r6a, r6b, r6c, r6d)")))
    return SHEET_SQL + "," + base + ",\nexpanded AS (\n" + "\nUNION ALL\n".join(parts) + \
        "\n),\nquarantine AS (SELECT row_id, parser, reason, reason = 'empty_cell' AS silent FROM (" + \
        quarantine + ") WHERE reason IS NOT NULL)"


EXPAND_SQL = _expand_sql()
SAMPLE_COLS = ("premise, hypothesis, label, section, pword, hword, ptype, htype, row_id, worker_id, "
               "hit_id, is_complete, parser, block, j")


def expanded(spark, sf_dir, parsers=None):
    return H.expand_sheet(answer_sheet(spark, sf_dir), parsers=parsers)


@query("hit_expand", f"WITH {EXPAND_SQL}\nSELECT {SAMPLE_COLS} FROM expanded",
       ("EXP-01", "EXP-02", "EXP-03", "EXP-04", "EXP-05", "EXP-06", "EXP-07", "EXP-08",
        "STR-01", "STR-02", "STR-21", "PRJ-06", "FLT-08"))
def q_hit_expand(spark, sf_dir):
    return expanded(spark, sf_dir)[0].drop("sample_idx")


def _per_parser(p):
    def build(spark, sf_dir):
        return expanded(spark, sf_dir, {p: H.PARSERS[p]})[0].drop("sample_idx")
    return build


for _p in range(1, 7):
    query(f"hit_expand_s{_p}", f"WITH {EXPAND_SQL}\nSELECT {SAMPLE_COLS} FROM expanded WHERE parser = {_p}",
          (f"EXP-0{_p}", "UDF-02"))(_per_parser(_p))


@query("hit_quarantine", f"WITH {EXPAND_SQL}\nSELECT * FROM quarantine", ("EXP-07",))
def q_hit_quarantine(spark, sf_dir):
    return expanded(spark, sf_dir)[1]


@query("review_rows", f"""WITH {EXPAND_SQL},
rv AS (
  SELECT 'P' AS type, premise AS text, pword AS word, * EXCLUDE (premise, hypothesis) FROM expanded
  UNION ALL
  SELECT 'H' AS type, hypothesis AS text, hword AS word, * EXCLUDE (premise, hypothesis) FROM expanded)
SELECT type, {_repl('text', 'word', "('**' || word || '**')")} AS text, label,
       '' AS is_label_correct, '' AS is_grammatically, '' AS is_makes_sense,
       ptype || '->' || htype AS ptype_htype, pword || '->' || hword AS from_to, section,
       worker_id AS worker, is_complete AS is_completed, row_id, hit_id, parser, block, j
FROM rv""", ("EXP-09", "STR-03", "PRJ-07"))
def q_review_rows(spark, sf_dir):
    return H.review_rows(expanded(spark, sf_dir)[0]).drop("sample_idx")
