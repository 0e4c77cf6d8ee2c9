"""Word endings rewritten by a learned table of longest endings (STR-11).

From (word, target) pairs, say plurals and singulars, every ending learns the
commonest rewrite of its words - cut so many characters, add so many - and is
kept only where it differs from the next shorter ending: a suffix trie with
exceptions, whole words (``^word``) the longest.  Rules are a table; a word
takes the rule of its longest listed ending by an equi-join on its endings, once
per distinct word.

Words and targets are taken as written; nulls, and the empty word, have no rule
and stay as they are.  Equally common rewrites: the shorter cut, then the lesser
addition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lookup

#: Characters of the longest ending below a whole word.
LONGEST = 6


def endings(word: Column, longest: int = LONGEST) -> Column:
    """Array of a word's endings, the whole word first, '' last."""
    some = F.transform(F.sequence(F.least(F.length(word), F.lit(longest)), F.lit(0), F.lit(-1)), lambda n: F.right(word, n))
    return F.concat(F.array(F.concat(F.lit("^"), word)), some)


def rewrite(word: Column, target: Column) -> Column:
    """(cut, add) that makes ``target`` of ``word``: what follows their common beginning."""
    same = F.size(F.filter(F.sequence(F.lit(0), F.least(F.length(word), F.length(target))),
                           lambda i: F.substr(word, F.lit(1), i) == F.substr(target, F.lit(1), i))) - 1
    return F.struct((F.length(word) - same).alias("cut"), F.substr(target, same + 1).alias("add"))


def learn(pairs: DataFrame, word: str = "word", target: str = "target", longest: int = LONGEST) -> DataFrame:
    """(ending, cut, add): the rules; map-side counts per ending and rewrite."""
    p = pairs.select(F.col(word).alias("w"), F.col(target).alias("t")).where("w IS NOT NULL AND t IS NOT NULL AND w <> ''").distinct()
    each = p.select("w", rewrite(F.col("w"), F.col("t")).alias("op"), F.explode(endings(F.col("w"), longest)).alias("ending"))
    fits = (F.length("ending") >= F.col("op.cut")) | F.startswith("ending", F.lit("^"))
    counts = each.where(fits).groupBy("ending", "op").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("ending").agg(F.min(F.struct((-F.col("n")).alias("neg"), "op")).alias("b")).select("ending", "b.op")
    best = lookup(best)
    # the next shorter ending: a whole word's is its longest proper one
    rest = F.expr("substring(ending, 2)")
    up = F.when(F.startswith("ending", F.lit("^")), F.when(F.length(rest) > longest, F.right(rest, F.lit(longest))).otherwise(rest)) \
        .when(F.length("ending") > 0, rest)
    j = best.withColumn("up", up).join(best.select(F.col("ending").alias("e"), F.col("op").alias("above")), F.col("up") == F.col("e"), "left")
    return j.where(F.col("above").isNull() | (F.col("above") != F.col("op"))).select("ending", "op.cut", "op.add")


def apply_rules(words: DataFrame, rules: DataFrame, word: str = "word", out: str = "target", longest: int = LONGEST) -> DataFrame:
    """Distinct words of ``words`` with ``out``, rewritten by their longest listed ending."""
    w = words.select(F.col(word).alias("w")).distinct()
    each = w.select("w", F.posexplode(endings(F.col("w"), longest)).alias("k", "ending"))
    hit = each.join(lookup(rules), "ending").groupBy("w").agg(F.min(F.struct("k", "cut", "add")).alias("r"))
    new = F.concat(F.expr("substring(w, 1, greatest(length(w) - r.cut, 0))"), F.col("r.add"))
    return w.join(hit, "w", "left").select(F.col("w").alias(word), F.coalesce(new, F.col("w")).alias(out))
