"""Sentence taggers: Viterbi against all paths, tags by context, plug-ins."""

import itertools
import math
import random

from pyspark.sql import functions as F

from pairsmith.operators import linking, tagging

NOUNS = ("ring", "bolt", "gear")
TRAIN = [s for n in NOUNS for s in (
    [("They", "PRON"), (n, "VERB"), ("the", "DET"), ("mayor", "NOUN"), (".", "PUNCT")],
    [("The", "DET"), (n, "NOUN"), ("holds", "VERB"), ("a", "DET"), ("mayor", "NOUN"), (".", "PUNCT")],
    [("We", "PRON"), ("warned", "VERB"), ("the", "DET"), (n, "NOUN"), (".", "PUNCT")])]


def rows(spark, sentences):
    return spark.createDataFrame([(i, k, w, t) for i, s in enumerate(sentences) for k, (w, t) in enumerate(s)],
                                 "sid int, i int, word string, tag string")


def table(spark, sentences):
    return spark.createDataFrame([(s,) for s in sentences], "s string")


def tags_of(ann):
    return {r["s"]: [a["pos"] for a in r["ann"]] for r in ann.collect()}


def test_one_word_two_tags(spark):
    model = tagging.train_hmm(rows(spark, TRAIN))
    got = tags_of(linking.annotate_sentences(table(spark, ["They ring the bolt .", "The ring warned a gear .", "They ring the bolt .",
                                                           "They wanted the Xylo .", "", None]), model))
    assert got == {"They ring the bolt .": ["PRON", "VERB", "DET", "NOUN", "PUNCT"],
                   "The ring warned a gear .": ["DET", "NOUN", "VERB", "DET", "NOUN", "PUNCT"],
                   "They wanted the Xylo .": ["PRON", "VERB", "DET", "NOUN", "PUNCT"]}  # wanted: ends like warned


def test_viterbi_is_the_best_path(spark):
    """Against every path, ties included, on random small models."""
    rng = random.Random(6)
    for n_tags in (1, 2, 4):
        small = lambda: rng.randint(-3, 3)
        model = tagging.HmmTagger([f"T{k}" for k in range(n_tags)], [small() for _ in range(n_tags)],
                                  [[small() for _ in range(n_tags)] for _ in range(n_tags)], [small() for _ in range(n_tags)],
                                  [0] * n_tags, None, None)
        data = [(i, [[small() for _ in range(n_tags)] for _ in range(rng.randint(1, 5))]) for i in range(25)]
        out = spark.createDataFrame(data, "i int, em array<array<int>>").select("i", model.decode(F.col("em")).alias("p")).collect()
        for r in out:
            em = data[r["i"]][1]

            def score(path):
                return model.start[path[0]] + model.stop[path[-1]] + sum(e[t] for e, t in zip(em, path)) \
                    + sum(model.step[a][b] for a, b in zip(path, path[1:]))
            best = max(score(p) for p in itertools.product(range(n_tags), repeat=len(em)))
            ties = [p for p in itertools.product(range(n_tags), repeat=len(em)) if score(p) == best]
            assert tuple(r["p"]) == min(ties, key=lambda p: p[::-1])


def test_scores_of_the_model(spark):
    model = tagging.train_hmm(rows(spark, TRAIN).unionByName(spark.createDataFrame([(1, 9, None, "X"), (1, 9, "x", None)],
                                                                                  "sid int, i int, word string, tag string")))
    assert model.tags == ["DET", "NOUN", "PRON", "PUNCT", "VERB"]
    milli = lambda x: math.floor(math.log(x) * 1000 + 0.5)
    eps = tagging.SMOOTH
    # 12 DET, all followed by NOUN; 9 sentences, 6 start with PRON; 3 of 9 verbs are one of the item words each
    assert model.step[0][1] == milli((12 + eps) / (12 + 5 * eps)) and model.start[2] == milli((6 + eps) / (9 + 5 * eps))
    assert model.stop[3] == milli((9 + eps) / (9 + 5 * eps))
    em = {r["word"]: r["em"] for r in model.words.collect()}
    assert em["ring"][4] == milli((1 + eps) / (9 + eps)) and em["ring"][1] == milli((2 + eps) / (12 + eps))


def test_python_plug_in_sees_sentences(spark):
    def tag(sentences):
        return [[("FIRST" if k == 0 else "LAST" if k == len(s) - 1 else "MID", "GPE" if w == "Paris" else None)
                 for k, w in enumerate(s)] for s in sentences]
    ann = linking.annotate_sentences(table(spark, ["Paris is Paris", "in Paris now", "in Paris now"]), tagging.python_tagger(tag))
    got = {r["s"]: [(a["t"], a["pos"], a["ent"]) for a in r["ann"]] for r in ann.collect()}
    assert got == {"Paris is Paris": [("Paris", "FIRST", "GPE"), ("is", "MID", None), ("Paris", "LAST", "GPE")],
                   "in Paris now": [("in", "FIRST", None), ("Paris", "MID", "GPE"), ("now", "LAST", None)]}


def test_links_under_a_sentence_tagger(spark):
    """The verb 'ring' has no is-a link, the noun has."""
    model = tagging.train_hmm(rows(spark, TRAIN))
    pairs = spark.createDataFrame([(1, "They ring the mayor .", "The gear holds a bolt ."), (2, "The ring holds a mayor .", "We warned the gear ."),
                                   (3, None, "We warned the gear .")], "pair_id long, s1 string, s2 string")
    ann = linking.annotate(pairs, model)
    hyper = spark.createDataFrame([("ring", "gear"), ("ring", "bolt")], "word string, hyper string")
    got = {(r["pair_id"], r["object"]) for r in linking.link_isa(ann, hyper).collect()}
    assert got == {(2, "gear")}
    assert ann.count() == 3


def test_empty_model(spark):
    model = tagging.train_hmm(rows(spark, TRAIN).limit(0))
    assert tags_of(linking.annotate_sentences(table(spark, ["They ring"]), model)) == {"They ring": ["X", "X"]}
