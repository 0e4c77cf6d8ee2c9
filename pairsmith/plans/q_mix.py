"""Corpus sampling, mixing and word-swap queries.

The public-corpus stand-in is consecutive conversation turns: sentence1 =
turn t, sentence2 = turn t+1, built with an equi-join on (conv_id, turn+1)
(unique keys, so a huge conversation does not land in one task as a window
would).  The gold label is derived from the keys; one in four is ``-``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters, mixing, swap
from ..operators import split as S
from ..session import read_table, stage
from .bindings import DEDUP_SQL
from .catalog import query
from .q_prepare import SPLIT3_SQL, split3

SAMPLE_N = 200
NESTED = (50, 100, 200, 400)


def corpus(spark, sf_dir):
    c = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("sentence2"))
    j = c.join(nxt, ["conv_id", "turn"])
    k = (F.col("conv_id") * 7 + F.col("turn")) % 4
    label = F.when(k == 0, "entailment").when(k == 1, "neutral").when(k == 2, "contradiction").otherwise("-")
    return j.select((F.col("conv_id") * 1000000 + F.col("turn")).alias("seq"),
                    F.col("text").alias("sentence1"), "sentence2", label.alias("gold_label"),
                    F.col("role").alias("genre"))


CORPUS_SQL = """
corpus AS (
  SELECT c.conv_id * 1000000 + c.turn AS seq, c.text AS sentence1, n.text AS sentence2,
         CASE (c.conv_id * 7 + c.turn) % 4 WHEN 0 THEN 'entailment' WHEN 1 THEN 'neutral'
              WHEN 2 THEN 'contradiction' ELSE '-' END AS gold_label,
         c.role AS genre
  FROM conversations c JOIN conversations n ON n.conv_id = c.conv_id AND n.turn = c.turn + 1
),
keyed AS (
  SELECT *, md5(concat_ws('/', '42', CAST(seq AS VARCHAR))) || '/' || CAST(seq AS VARCHAR) AS k,
         row_number() OVER (ORDER BY md5(concat_ws('/', '42', CAST(seq AS VARCHAR))) || '/' || CAST(seq AS VARCHAR)) - 1 AS rk
  FROM corpus WHERE gold_label <> '-'
)"""


@query("corpus_sample_n", "WITH " + CORPUS_SQL + f"""
SELECT seq, sentence1, sentence2, gold_label, genre FROM keyed WHERE rk < {SAMPLE_N}""",
       ("SRT-03", "FLT-01", "SRC-02"))
def q_corpus_sample_n(spark, sf_dir):
    labelled = filters.drop_unlabelled(corpus(spark, sf_dir), "gold_label")
    return mixing.exact_sample(labelled, SAMPLE_N, "seq")


@query("nested_samples", "WITH " + CORPUS_SQL + f"""
SELECT seq, sentence1, sentence2, gold_label, genre, CAST(s.n AS INTEGER) AS sample_size
FROM keyed, (SELECT unnest({list(NESTED)}) AS n) s WHERE rk < s.n""", ("SRT-05", "SRT-04"))
def q_nested_samples(spark, sf_dir):
    labelled = corpus(spark, sf_dir).where(F.col("gold_label") != "-")
    return mixing.nested_samples(labelled, NESTED, "seq").withColumn(
        "sample_size", F.col("sample_size").cast("int"))


@query("label_distribution", "WITH " + CORPUS_SQL + """
SELECT gold_label AS label, CAST(count(*) AS BIGINT) AS n FROM corpus GROUP BY gold_label""", ("AGG-08",))
def q_label_distribution(spark, sf_dir):
    return (corpus(spark, sf_dir).groupBy(F.col("gold_label").alias("label"))
            .agg(F.count(F.lit(1)).cast("bigint").alias("n")))


@query("mix_train_variants", "WITH " + SPLIT3_SQL + "," + CORPUS_SQL + f""",
base AS (SELECT premise, hypothesis, label, split FROM split_rows)
SELECT b.*, v.variant FROM base b, (SELECT unnest(['mnli_sample', 'mnli_full']) AS variant) v
UNION ALL
SELECT sentence1, sentence2, gold_label, 'train', 'mnli_sample' FROM keyed WHERE rk < {SAMPLE_N}
UNION ALL
SELECT sentence1, sentence2, gold_label, 'train', 'mnli_full' FROM corpus""", ("SNK-07", "SET-01", "PRJ-03"))
def q_mix_train_variants(spark, sf_dir):
    base = split3(spark, sf_dir).select("premise", "hypothesis", "label", "split")
    c = mixing.harmonise(corpus(spark, sf_dir))
    sample = mixing.exact_sample(c.where(F.col("label") != "-"), SAMPLE_N, "seq")
    # the full variant keeps unlabelled rows, as the hybrid builder does
    return mixing.mix_variants(base, {"mnli_sample": sample, "mnli_full": c})


@query("union_fill_missing", "WITH " + DEDUP_SQL + "," + CORPUS_SQL + """
SELECT premise, hypothesis, label, NULL::BIGINT AS seq, NULL::VARCHAR AS genre FROM dedup
UNION ALL
SELECT sentence1, sentence2, gold_label, seq, genre FROM corpus""", ("SET-02", "PRJ-03"))
def q_union_fill_missing(spark, sf_dir):
    from .q_prepare import deduped
    base = deduped(spark, sf_dir).select("premise", "hypothesis", "label")
    return mixing.union_fill(base, mixing.harmonise(corpus(spark, sf_dir)))


# ---- word swap: trademark-like samples from part and nation names
def trademark_samples(spark, sf_dir):
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    c = nation.select(F.col("n_nationkey").alias("ck"), F.initcap("n_name").alias("country"))
    o = nation.select(F.col("n_nationkey").alias("ok"), F.initcap("n_name").alias("other_country"))
    p = part.withColumn("ck", (F.col("p_size") % 25).cast("int")).withColumn(
        "ok", ((F.col("p_size") + 7) % 25).cast("int"))
    # nation is a 25-row dimension: broadcast of a fixed, proven size
    t = p.join(F.broadcast(c), "ck").join(F.broadcast(o), "ok")
    t = t.select(F.col("p_partkey").alias("row_id"), F.col("p_brand").alias("company"), "country",
                 F.concat(F.col("country"), F.lit("ian")).alias("country_adj"), "other_country",
                 F.concat(F.col("other_country"), F.lit("ian")).alias("other_country_adj"))
    t = t.withColumn("premise", F.concat(F.col("company"), F.lit(" goods are made in "), F.col("country"),
                                         F.lit(" and ") , F.col("other_country")))
    t = t.withColumn("hypothesis", F.concat(F.lit("There is a "), F.col("country_adj"),
                                            F.lit(" company, not an "), F.col("other_country_adj"), F.lit(" one")))
    return stage(S.exact_group_split(stage(t, "trademark"), "row_id", S.FRACTIONS_3WAY, S.SEED_3WAY), "trademark-split")


TRADEMARK_SQL = """
tm AS (
  SELECT p.p_partkey AS row_id, p.p_brand AS company,
         upper(substr(c.n_name, 1, 1)) || lower(substr(c.n_name, 2)) AS country,
         upper(substr(o.n_name, 1, 1)) || lower(substr(o.n_name, 2)) AS other_country
  FROM part p JOIN nation c ON c.n_nationkey = p.p_size % 25
              JOIN nation o ON o.n_nationkey = (p.p_size + 7) % 25
),
tm2 AS (
  SELECT row_id, company, country, country || 'ian' AS country_adj, other_country,
         other_country || 'ian' AS other_country_adj,
         company || ' goods are made in ' || country || ' and ' || other_country AS premise,
         'There is a ' || country || 'ian company, not an ' || other_country || 'ian one' AS hypothesis
  FROM tm
)"""


def _tm_split_sql():
    from .bindings import split_sql
    return TRADEMARK_SQL + split_sql("tm2", "row_id", S.SEED_3WAY, S.FRACTIONS_3WAY, "tms")


OPT = ", ".join(swap.OPTION_FIELDS)


def _opt_key(prefix: str = "") -> str:
    return " || chr(1) || ".join(f"CASE WHEN {prefix}{f} IS NULL THEN '0' ELSE '1' || {prefix}{f} END" for f in swap.OPTION_FIELDS)


def _ranked(split_name: str, seed: str) -> str:
    key = _opt_key()
    return f"""(SELECT {OPT}, row_number() OVER (ORDER BY md5(concat_ws('/', '{seed}', {key})) || '/' || {key}) - 1 AS pos
     FROM (SELECT DISTINCT {OPT} FROM tms WHERE split = '{split_name}'))"""


MAPPING_SQL = _tm_split_sql() + f""",
mapping AS (
  SELECT t.*, {", ".join(f"r.{f} AS new_{f}" for f in swap.OPTION_FIELDS)}
  FROM {_ranked('test', 'test')} t LEFT JOIN {_ranked('train', 'train')} r ON r.pos = t.pos
)"""


@query("swap_options", "WITH " + MAPPING_SQL + "\nSELECT * FROM mapping", ("AGG-12", "J-15"))
def q_swap_options(spark, sf_dir):
    t = trademark_samples(spark, sf_dir)
    return swap.option_mapping(t.where(F.col("split") == "test"), t.where(F.col("split") == "train"))


def _rw_sql(s: str, pairs) -> str:
    out = s
    for old, new in reversed(pairs):
        pat = f"'(?i)(^|[^\\p{{L}}\\p{{N}}_])\\Q' || {old} || '\\E([^\\p{{L}}\\p{{N}}_]|$)'"
        repl = f"regexp_replace({s}, {pat}, '\\1' || {new} || '\\2', 'g')"
        out = f"(CASE WHEN {repl} <> {s} THEN {repl} ELSE {out} END)"
    return out


@query("swap_words", "WITH " + MAPPING_SQL + f"""
SELECT s.row_id, s.split,
       {_rw_sql('s.premise', [('m.company', 'm.new_company'), ('m.country', 'm.new_country')])} AS premise,
       {_rw_sql('s.hypothesis', [('m.country_adj', 'm.new_country_adj'), ('m.other_country', 'm.new_other_country'),
                                 ('m.other_country_adj', 'm.new_other_country_adj')])} AS hypothesis,
       {", ".join(f"m.new_{f} AS {f}" for f in swap.OPTION_FIELDS)}
FROM tms s JOIN mapping m ON {" AND ".join(f"s.{f} IS NOT DISTINCT FROM m.{f}" for f in swap.OPTION_FIELDS)}
WHERE s.split = 'test'""", ("J-16", "STR-04"))
def q_swap_words(spark, sf_dir):
    t = trademark_samples(spark, sf_dir)
    test = t.where(F.col("split") == "test")
    m = swap.option_mapping(test, t.where(F.col("split") == "train"))
    return swap.swap_words(test, m)


@query("text_pairs", "WITH " + CORPUS_SQL + """
SELECT seq, sentence1 AS text_a, sentence2 AS text_b, gold_label AS label, genre FROM corpus""", ("PRJ-03",))
def q_text_pairs(spark, sf_dir):
    return mixing.harmonise(corpus(spark, sf_dir), mixing.TEXT_PAIR_COLS)
