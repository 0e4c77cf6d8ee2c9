"""Sentence taggers: tags that depend on the words around (NLP-01, NLP-08).

``HmmTagger`` is a bigram hidden Markov model.  Its counts - tag after tag,
word under tag, ending under tag - are Spark aggregates over a tagged table;
scores are whole thousandths of a natural logarithm, so sums are exact and ties
are real.  A sentence is decoded by the Viterbi algorithm as a fold over its
array of tokens, in the JVM.  Words that were not met in training take the
scores of their longest known ending (three characters down to one, words
in capitals, with digits and others apart), else the tags' own rates.

``python_tagger`` plugs in any function of whole token lists, run over Arrow
batches of distinct sentences.

Nulls and empty sentences have no tokens and get no row; a model of an empty
table has no tags and leaves every token untagged (``X``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let
from .common import lookup

#: Tags are bounded: their pairs are part of the plan.
MAX_TAGS = 128
#: Lengths of the endings that stand for unknown words, longest first.
ENDINGS = (3, 2, 1)
#: Counts added to every cell.
SMOOTH = 0.01


class SentenceTagger(Protocol):
    """Tags whole sentences: (sid, t array<string>) -> (sid, pos
    array<string>, ent array<string>), arrays as long as ``t`` (``ent``, or an
    element of it, may be null); sentences left out are untagged."""

    def tag(self, sentences: DataFrame) -> DataFrame: ...


def millis(x: Column) -> Column:
    """Whole thousandths of ln(x)."""
    return F.floor(F.log(x) * 1000 + 0.5).cast("int")


def ending(token: Column, size: int) -> Column:
    """Key of a token's ending: its kind (capital, digit, other) and last characters."""
    kind = F.when(token.rlike(r"^\p{Lu}"), F.lit("A")).when(token.rlike(r"\p{N}"), F.lit("0")).otherwise(F.lit("a"))
    return F.concat(kind, F.lit(str(size)), F.lower(F.right(token, F.lit(size))))


@dataclass
class HmmTagger:
    """Tables of a trained model; arrays are by tag number."""

    tags: list[str]
    start: list[int]            # scores of a sentence's first tag
    step: list[list[int]]       # [tag before][tag]
    stop: list[int]             # scores of its last tag
    rates: list[int]            # emission scores of a word nothing is known of
    words: DataFrame            # word (lower case), em array<int>
    endings: DataFrame          # ending, em array<int>

    def emissions(self, tokens: DataFrame) -> DataFrame:
        """(t, em) of distinct tokens ``t``."""
        out = tokens.join(self.words, F.lower("t") == F.col("word"), "left").select("t", "em")
        for size in ENDINGS:
            known = self.endings.select(F.col("ending").alias("__e"), F.col("em").alias("__em"))
            out = out.withColumn("__k", F.when(F.col("em").isNull(), ending(F.col("t"), size))) \
                .join(known, F.col("__k") == F.col("__e"), "left").select("t", F.coalesce("em", "__em").alias("em"))
        return out.select("t", F.coalesce("em", F.array(*[F.lit(x) for x in self.rates])).alias("em"))

    def decode(self, ems: Column) -> Column:
        """Tag numbers of the best path (of equal ones the one whose tags come
        first, from the sentence's end) for an array of emission arrays."""
        ints = lambda xs: F.array(*[F.lit(x) for x in xs])
        by_tag = F.array(*[F.struct(F.lit(t).alias("t"), ints([row[t] for row in self.step]).alias("into"))
                           for t in range(len(self.tags))])
        first = F.zip_with(ints(self.start), F.element_at(ems, 1), lambda a, e: (a + e).cast("long"))

        def step(acc, em):
            best = F.transform(by_tag, lambda x: F.array_max(F.transform(
                F.zip_with(acc["score"], x["into"], lambda s, a: s + a), lambda v, p: F.struct(v.alias("v"), (-p).alias("p")))))
            return let(best, lambda b: F.struct(
                F.zip_with(b, em, lambda x, e: x["v"] + e).alias("score"),
                F.concat(acc["back"], F.array(F.transform(b, lambda x: -x["p"]))).alias("back")))

        none = F.array().cast("array<array<int>>")
        walked = F.aggregate(F.slice(ems, F.lit(2), F.greatest(F.size(ems) - 1, F.lit(0))),
                             F.struct(first.alias("score"), none.alias("back")), step)

        def read(w):
            last = F.array_max(F.transform(F.zip_with(w["score"], ints(self.stop), lambda s, a: s + a),
                                           lambda v, p: F.struct(v.alias("v"), (-p).alias("p"))))
            return F.reverse(F.aggregate(F.reverse(w["back"]), F.array(-last["p"]),
                                         lambda path, b: F.concat(path, F.array(F.element_at(b, F.element_at(path, -1) + 1)))))
        return F.when(F.size(ems) > 0, let(walked, read))

    def tag(self, sentences: DataFrame) -> DataFrame:
        if not self.tags:
            return sentences.select("sid", F.lit(None).cast("array<string>").alias("pos"),
                                    F.lit(None).cast("array<string>").alias("ent")).limit(0)
        tok = sentences.select("sid", F.posexplode("t").alias("i", "t"))
        em = lookup(self.emissions(tok.select("t").distinct()))
        ems = tok.join(em, "t").groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("i", "em"))).alias("x"))
        names = F.array(*[F.lit(t) for t in self.tags])
        path = let(F.transform("x", lambda e: e["em"]), self.decode)
        return ems.select("sid", F.transform(path, lambda t: F.element_at(names, t + 1)).alias("pos"),
                          F.lit(None).cast("array<string>").alias("ent"))


def train_hmm(tagged: DataFrame, sid: str = "sid", place: str = "i", word: str = "word", tag: str = "tag") -> HmmTagger:
    """Model of a table of tagged tokens.  Rows with a null word or tag do not
    count; tokens of a sentence follow each other in order of ``place``.  The
    driver gets tag pairs only (``MAX_TAGS``), words stay distributed."""
    rows = tagged.where(F.col(word).isNotNull() & F.col(tag).isNotNull()).select(
        F.col(sid).alias("sid"), F.col(place).alias("i"), F.col(word).alias("t"), F.col(tag).alias("tag"))
    order = Window.partitionBy("sid").orderBy("i", "t", "tag")
    pairs = rows.select("tag", F.lag("tag").over(order).alias("before"), F.lead("tag").over(order).isNull().alias("last"))
    counts = pairs.groupBy("before", "tag").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("last").cast("long")).alias("ends"))
    got = counts.limit(MAX_TAGS * (MAX_TAGS + 1) + 1).collect()
    tags = sorted({r["tag"] for r in got})
    if len(tags) > MAX_TAGS:
        raise ValueError(f"more than {MAX_TAGS} tags")
    number = {t: k for k, t in enumerate(tags)}
    n_tags, of_tag, heads, ends = len(tags), [0] * len(tags), [0] * len(tags), [0] * len(tags)
    after = [[0] * n_tags for _ in tags]
    for r in got:
        k = number[r["tag"]]
        of_tag[k] += r["n"]
        ends[k] += r["ends"]
        if r["before"] is None:
            heads[k] += r["n"]
        else:
            after[number[r["before"]]][k] += r["n"]
    spark = tagged.sparkSession
    numbers = spark.createDataFrame([(t, number[t], of_tag[number[t]]) for t in tags], "tag string, k int, of_tag bigint")
    seen = rows.join(F.broadcast(numbers), "tag")  # at most MAX_TAGS rows

    def arrays(cells: DataFrame, key: str, score) -> DataFrame:
        """(key, em) from (key, k, n): one score per tag."""
        g = cells.groupBy(key).agg(F.sum("n").alias("all"), F.map_from_entries(F.collect_list(F.struct("k", "n"))).alias("by"))
        one = lambda k: score(F.coalesce(F.try_element_at(F.col("by"), F.lit(k)), F.lit(0)), F.col("all"), k)
        return lookup(g.select(key, F.array(*[one(k) for k in range(n_tags)]).alias("em")))

    per_word = seen.groupBy(F.lower("t").alias("word"), "k").agg(F.count(F.lit(1)).alias("n"))
    words = arrays(per_word, "word", lambda n, all_, k: millis((n + SMOOTH) / F.lit(of_tag[k] + SMOOTH)))
    types = seen.select("t", "k").distinct()
    per_end = types.select(F.explode(F.array(*[ending(F.col("t"), s) for s in ENDINGS])).alias("ending"), "k") \
        .groupBy("ending", "k").agg(F.count(F.lit(1)).alias("n"))
    total = sum(of_tag)
    # Bayes: P(ending | tag) ~ P(tag | ending) / P(tag)
    endings = arrays(per_end, "ending", lambda n, all_, k: millis(
        (n + SMOOTH) / (all_ + SMOOTH * n_tags) * F.lit(float(total)) / F.lit(float(of_tag[k]))))

    import math
    score = lambda n, of: math.floor(math.log((n + SMOOTH) / (of + SMOOTH * n_tags)) * 1000 + 0.5)
    return HmmTagger(tags, [score(h, sum(heads)) for h in heads],
                     [[score(n, of_tag[a] - ends[a]) for n in row] for a, row in enumerate(after)],
                     [score(e, n) for e, n in zip(ends, of_tag)], [0] * n_tags, words, endings)


def python_tagger(tag: Callable[[list[list[str]]], Sequence[Sequence[tuple[str, str | None]]]]) -> SentenceTagger:
    """Plug-in around a function from token lists to (pos, ent) lists of the
    same lengths; it sees each distinct sentence once, whole."""

    class Plugin:
        def tag(self, sentences: DataFrame) -> DataFrame:
            def run(frames: Iterator) -> Iterator:
                import pandas as pd
                for frame in frames:
                    out = [list(x) for x in tag([list(t) for t in frame["t"]])]
                    if [len(x) for x in out] != [len(t) for t in frame["t"]]:
                        raise ValueError("a tagger must give one (pos, ent) per token")
                    yield pd.DataFrame({"sid": frame["sid"], "pos": [[p for p, _ in x] for x in out],
                                        "ent": [[e for _, e in x] for x in out]})
            kind = dict(sentences.dtypes)["sid"]
            return sentences.select("sid", "t").mapInPandas(run, f"sid {kind}, pos array<string>, ent array<string>")

    return Plugin()
