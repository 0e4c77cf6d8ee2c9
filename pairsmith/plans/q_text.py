"""Text-function queries (STR-*) over whole documents and part names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.text import to_singular_sql
from ..operators import suffix_rules
from ..session import read_table, stage
from .catalog import query

W = r"[\p{L}\p{N}_]"
SPACE_SPLIT = r"[ \t\r\n]+"


def _docs(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select("doc_id", "text")


@query("word_count", f"""
SELECT doc_id, CAST(len(regexp_extract_all(text, '{W}+')) AS BIGINT) AS word_count
FROM documents""", ("STR-08", "AGG-19"))
def q_word_count(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.word_count("text").cast("bigint").alias("word_count"))


_BOLD_WORD = f"regexp_extract_all(text, '{W}{{4,}}')[2]"


@query("bold_first", f"""
WITH d AS (SELECT doc_id, text, {_BOLD_WORD} AS w FROM documents),
p AS (SELECT doc_id, text, w, {T.word_position_sql('text', 'w')} AS pos FROM d)
SELECT doc_id, w AS word, CAST(pos AS BIGINT) AS pos,
       CASE WHEN pos > 0 THEN substr(text, 1, pos - 1) || '**' || w || '**' || substr(text, pos + length(w)) END AS bolded
FROM p""", ("STR-01", "STR-03"))
def q_bold_first(spark, sf_dir):
    d = _docs(spark, sf_dir).withColumn(
        "word", F.try_element_at(F.regexp_extract_all("text", F.lit(W + "{4,}"), 0), F.lit(2)))
    return d.select("doc_id", "word", T.word_position("text", F.col("word")).cast("bigint").alias("pos"),
                    T.make_bold("text", F.col("word")).alias("bolded"))


def _marked(spark, sf_dir):
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    item = F.element_at(F.split("p_name", " "), 2)
    a = part.select("p_partkey", F.lit("the").alias("kind"),
                    T.make_bold(F.concat(F.lit("We saw the "), F.col("p_name"), F.lit(" today")),
                                F.col("p_name")).alias("s"))
    b = part.select("p_partkey", F.lit("item").alias("kind"),
                    T.make_bold(F.concat(F.col("p_brand"), F.lit(" makes a "), F.col("p_name")),
                                item).alias("s"))
    return a.unionByName(b)


_MARKED_SQL = f"""
marked AS (
  SELECT p_partkey, 'the' AS kind,
         {T.safe_replace_sql("('We saw the ' || p_name || ' today')", "p_name", "('**' || p_name || '**')")} AS s
  FROM part
  UNION ALL
  SELECT p_partkey, 'item' AS kind,
         {T.safe_replace_sql("(p_brand || ' makes a ' || p_name)", "split_part(p_name, ' ', 2)",
                             "('**' || split_part(p_name, ' ', 2) || '**')")} AS s
  FROM part)"""


@query("fmt_marked_span", "WITH " + _MARKED_SQL + r"""
SELECT p_partkey, kind, s,
  trim(CASE WHEN instr(lower(s), 'the **') > 0
            THEN regexp_replace(regexp_replace(s, '[Tt]he \*\*', '{{{the '), '\*\*', '}}}')
            ELSE regexp_replace(regexp_replace(s, ' ?\*\*', ' {{{'), '\*\*', '}}}') END) AS formatted
FROM marked""", ("STR-05", "STR-03", "STR-02"))
def q_fmt_marked_span(spark, sf_dir):
    return _marked(spark, sf_dir).withColumn("formatted", T.fmt_marked_span("s"))


@query("highlight_span", """
WITH s AS (SELECT p_partkey, 'supplier ships the ' || p_name || ' today' AS s,
                  split_part(p_name, ' ', 2) AS w FROM part),
sp AS (SELECT p_partkey, s, instr(s, w) - 1 AS a, instr(s, w) - 1 + length(w) AS b FROM s)
SELECT p_partkey, CAST(a AS INTEGER) AS start_char, CAST(b AS INTEGER) AS end_char,
       substr(s, 1, a) || '**' || substr(s, a + 1, b - a) || '**' || substr(s, b + 1) AS highlighted,
       substr(s, 1, a) || '{{{location}}}' || substr(s, b + 1) AS placeholder
FROM sp""", ("STR-06", "STR-07"))
def q_highlight_span(spark, sf_dir):
    part = read_table(spark, sf_dir, "part")
    s = F.concat(F.lit("supplier ships the "), F.col("p_name"), F.lit(" today"))
    w = F.element_at(F.split("p_name", " "), 2)
    sp = part.select("p_partkey", s.alias("s"), (F.instr(s, w) - 1).alias("a"), F.length(w).alias("wl")) \
        .withColumn("b", F.col("a") + F.col("wl"))
    return sp.select("p_partkey", F.col("a").cast("int").alias("start_char"),
                     F.col("b").cast("int").alias("end_char"),
                     T.highlight_span("s", "a", "b").alias("highlighted"),
                     T.placeholder_span("s", "a", "b").alias("placeholder"))


@query("md5_cache_key", """
SELECT a.conv_id, a.turn,
       to_base64(unhex(md5(a.text))) || '|' || to_base64(unhex(md5(b.text))) || '|' || a.role AS cache_key
FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1
WHERE b.text IS NOT NULL""", ("STR-16",))
def q_md5_cache_key(spark, sf_dir):
    """Key of each turn and the one after it: an equi-join on (conversation,
    turn), so a long conversation spreads over tasks."""
    conv = read_table(spark, sf_dir, "conversations")
    after = conv.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next_text"))
    return (conv.join(after, ["conv_id", "turn"]).where(F.col("next_text").isNotNull())
            .select("conv_id", "turn", T.cache_key("text", "next_text", "role").alias("cache_key")))


def _pieces(text):
    """Word pieces: each word split in 4-character pieces, later ones ``##``."""
    words = F.filter(F.split(text, SPACE_SPLIT), lambda w: F.length(w) > 0)
    return F.flatten(F.transform(words, lambda w: F.transform(
        F.sequence(F.lit(0), F.floor((F.length(w) - 1) / 4).cast("int")),
        lambda i: F.concat(F.when(i > 0, F.lit("##")).otherwise(F.lit("")),
                           F.substring(w, i * 4 + 1, 4)))))


_PIECES_SQL = f"""
w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '{SPACE_SPLIT}'), lambda x: length(x) > 0) AS words
      FROM documents),
p AS (SELECT doc_id, flatten(list_transform(words, lambda x: list_transform(
          range(0, CAST(floor((length(x) - 1) / 4) AS BIGINT) + 1),
          lambda i: CASE WHEN i > 0 THEN '##' ELSE '' END || substr(x, CAST(i * 4 + 1 AS BIGINT), 4)))) AS t
      FROM w),
s AS (SELECT doc_id, t, list_filter(range(0, len(t)), lambda i: i = 0 OR NOT starts_with(t[i + 1], '##')) AS starts
      FROM p)"""


@query("rejoin_pieces", "WITH " + _PIECES_SQL + """
SELECT doc_id, CAST(len(t) AS BIGINT) AS n_pieces,
       array_to_string(list_transform(starts, lambda st, k:
           array_to_string(list_transform(
               t[st + 1 : coalesce(starts[k + 1], len(t))],
               lambda x, j: CASE WHEN j > 1 THEN regexp_replace(x, '^##', '') ELSE x END), '')), ' ') AS words,
       array_to_string(starts, ',') AS offsets
FROM s""", ("STR-12",))
def q_rejoin_pieces(spark, sf_dir):
    t = _pieces(F.col("text"))
    r = _docs(spark, sf_dir).select("doc_id", t.alias("t")).withColumn("r", T.rejoin_pieces("t"))
    return r.select("doc_id", F.size("t").cast("bigint").alias("n_pieces"),
                    F.array_join("r.words", " ").alias("words"),
                    F.array_join("r.offsets", ",").alias("offsets"))


_TOK_SQL = f"""
tk AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '{SPACE_SPLIT}'), lambda x: length(x) > 0) AS t
       FROM documents)"""


@query("word_positions", "WITH " + _TOK_SQL + """
SELECT doc_id, array_to_string(list_filter(range(0, len(t)), lambda i: t[i + 1] = 'the'), ',') AS positions
FROM tk""", ("STR-13",))
def q_word_positions(spark, sf_dir):
    # project the token array first: an inline array would be rebuilt per lambda call
    t = F.filter(F.split(F.lower("text"), SPACE_SPLIT), lambda x: F.length(x) > 0)
    return _docs(spark, sf_dir).select("doc_id", t.alias("t")).select(
        "doc_id", F.array_join(T.word_positions("t", F.lit("the")), ",").alias("positions"))


@query("phrase_positions", "WITH " + _TOK_SQL + """,
ph AS (SELECT doc_id, t, t[1:2] AS p FROM tk),
cand AS (SELECT doc_id, t, p, list_filter(range(0, greatest(len(t) - len(p) + 1, 0)),
                                     lambda i: len(p) > 0 AND t[i + 1 : i + len(p)] = p) AS c FROM ph)
SELECT doc_id, array_to_string(p, ' ') AS phrase,
       array_to_string(list_reduce(c, lambda acc, i: CASE WHEN i >= acc.nxt
           THEN {'a': list_append(acc.a, i), 'nxt': i + len(p) + 1} ELSE acc END,
           {'a': []::BIGINT[], 'nxt': 0}).a, ',') AS positions
FROM cand""", ("STR-14",))
def q_phrase_positions(spark, sf_dir):
    t = F.filter(F.split(F.lower("text"), SPACE_SPLIT), lambda x: F.length(x) > 0)
    d = _docs(spark, sf_dir).select("doc_id", t.alias("t")).withColumn("p", F.slice("t", 1, 2))
    return d.select("doc_id", F.array_join("p", " ").alias("phrase"),
                    F.array_join(T.phrase_positions("t", "p"), ",").alias("positions"))


@query("singular_words", None, ("STR-11",))
def q_singular_words(spark, sf_dir):
    words = _docs(spark, sf_dir).select(
        F.explode(F.regexp_extract_all(F.lower("text"), F.lit(W + "+"), 0)).alias("word")).distinct()
    return words.select("word", T.to_singular("word").alias("singular"))


def _sing_sql():
    from .catalog import REGISTRY, QueryDef
    d = REGISTRY["singular_words"]
    sql = (f"WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{W}+')) AS word FROM documents)\n"
           f"SELECT word, {T.to_singular_sql('word')} AS singular FROM w")
    REGISTRY["singular_words"] = QueryDef(d.name, d.build, sql, d.operators)


_sing_sql()


@query("token_stats", f"""
SELECT doc_id, CAST(len(regexp_extract_all(text, '{W}{{2,}}')) AS BIGINT) AS n_tokens2,
       CAST(len(regexp_extract_all(text, '\\p{{Lu}}')) AS BIGINT) AS n_capitals,
       md5(upper(substr(text, 1, 1)) || substr(text, 2)) AS capitalised_md5,
       CAST(len(list_filter(string_split(text, ' '), lambda x: regexp_matches(x, '^\\p{{L}}+$'))) AS BIGINT) AS n_alphabetic
FROM documents""", ("STR-09", "STR-10", "STR-22", "STR-23"))
def q_token_stats(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return d.select(
        "doc_id", F.size(T.tokens2("text")).cast("bigint").alias("n_tokens2"),
        F.size(F.regexp_extract_all("text", F.lit(r"\p{Lu}"), 0)).cast("bigint").alias("n_capitals"),
        F.md5(T.capitalize_first("text")).alias("capitalised_md5"),
        F.size(F.filter(F.split("text", " "), T.is_place_candidate)).cast("bigint").alias("n_alphabetic"))


@query("fmt_approved", "WITH " + _MARKED_SQL + r""",
approved AS (SELECT *, CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE 1 END AS approved FROM marked)
SELECT p_partkey, kind, s,
  trim(CASE WHEN instr(lower(s), 'the **') > 0
            THEN regexp_replace(regexp_replace(s, '[Tt]he \*\*', '{{{the '), '\*\*', '}}}')
            ELSE regexp_replace(regexp_replace(s, ' ?\*\*', ' {{{'), '\*\*', '}}}') END) AS formatted_sentence
FROM approved WHERE approved = 1""", ("FLT-03", "STR-05"))
def q_fmt_approved(spark, sf_dir):
    """Only approved sentences are formatted (the review sheet's Approved == 1)."""
    m = _marked(spark, sf_dir).withColumn("approved", F.when(F.col("p_partkey") % 4 == 0, 0).otherwise(1))
    return m.where(F.col("approved") == 1).select(
        "p_partkey", "kind", "s", T.fmt_marked_span("s").alias("formatted_sentence"))


def _rules_sql():
    n = suffix_rules.LONGEST
    ends = f"list_concat(['^' || w], list_transform(range(least(length(w), {n}), -1, -1), lambda n: right(w, n)))"
    return f"""WITH words AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\\p{{L}}]+')) AS w FROM documents),
p AS (SELECT w, {to_singular_sql('w')} AS t, CAST(('0x' || substr(md5(w), 1, 8)) AS BIGINT) % 5 = 4 AS held FROM words),
same AS (SELECT *, list_max(list_filter(range(0, least(length(w), length(t)) + 1), lambda i: left(w, i) = left(t, i))) AS k FROM p),
op AS (SELECT w, t, held, length(w) - k AS cut, substr(t, k + 1) AS add FROM same),
e AS (SELECT cut, add, unnest({ends}) AS ending FROM op WHERE NOT held),
c AS (SELECT ending, cut, add, count(*) AS n FROM e WHERE length(ending) >= cut OR starts_with(ending, '^') GROUP BY ALL),
b AS (SELECT ending, cut, add FROM c QUALIFY row_number() OVER (PARTITION BY ending ORDER BY n DESC, cut, add) = 1),
r AS (SELECT b.* FROM b LEFT JOIN b AS u ON u.ending = CASE WHEN starts_with(b.ending, '^') THEN right(substr(b.ending, 2), {n})
        WHEN b.ending <> '' THEN substr(b.ending, 2) END
      WHERE u.ending IS NULL OR (u.cut, u.add) <> (b.cut, b.add)),
h AS (SELECT w, unnest({ends}) AS ending, generate_subscripts({ends}, 1) AS k FROM op WHERE held),
f AS (SELECT h.w, r.cut, r.add FROM h JOIN r ON r.ending = h.ending QUALIFY row_number() OVER (PARTITION BY h.w ORDER BY h.k) = 1)
SELECT op.w AS word, coalesce(left(op.w, greatest(length(op.w) - f.cut, 0)) || f.add, op.w) AS singular,
       coalesce(left(op.w, greatest(length(op.w) - f.cut, 0)) || f.add, op.w) = op.t AS as_ruled
FROM op LEFT JOIN f ON f.w = op.w WHERE op.held"""


@query("singular_by_table", _rules_sql(), ("STR-11",))
def q_singular_by_table(spark, sf_dir):
    """A rule table learned on four fifths of the documents' words, applied to the rest."""
    d = read_table(spark, sf_dir, "documents")
    w = d.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]+"), 0)).alias("word")).distinct()
    held = F.conv(F.substring(F.md5("word"), 1, 8), 16, 10).cast("bigint") % 5 == 4
    p = stage(w.withColumn("target", T.to_singular(F.col("word"))).withColumn("held", held), "word-pairs")
    rules = suffix_rules.learn(p.where("not held"))
    got = suffix_rules.apply_rules(p.where("held"), rules, out="singular")
    return got.join(p.select("word", "target"), "word").select("word", "singular", (F.col("singular") == F.col("target")).alias("as_ruled"))
