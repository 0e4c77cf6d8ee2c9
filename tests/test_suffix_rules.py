"""Learned endings against a plain trie."""

import random
from collections import Counter

from pyspark.sql import functions as F

from pairsmith.operators import suffix_rules as S


def ends(w):
    return ["^" + w] + [w[len(w) - n:] for n in range(min(len(w), S.LONGEST), -1, -1)]


def learned(pairs):
    counts = {}
    for w, t in {p for p in pairs if p[0] and p[1] is not None}:
        k = max(i for i in range(min(len(w), len(t)) + 1) if w[:i] == t[:i])
        for e in ends(w):
            if len(e) >= len(w) - k or e.startswith("^"):
                counts.setdefault(e, Counter())[(len(w) - k, t[k:])] += 1
    best = {e: min(c, key=lambda op: (-c[op], op)) for e, c in counts.items()}
    up = lambda e: e[1:][-S.LONGEST:] if e.startswith("^") else e[1:] if e else None
    return {e: op for e, op in best.items() if best.get(up(e)) != op}


def applied(rules, w):
    for e in ends(w):
        if e in rules:
            cut, add = rules[e]
            return w[:max(len(w) - cut, 0)] + add
    return w


def test_rules_equal_a_plain_trie(spark):
    rng = random.Random(2)
    pairs = [("horses", "horse"), ("foxes", "fox"), ("boxes", "box"), ("cities", "city"), ("men", "man"), ("women", "woman"), ("geese", "goose"),
             ("bus", "bus"), ("cats", "cat"), ("dogs", "dog"), ("s", ""), (None, "x"), ("x", None), ("", ""), ("cats", "cat")]
    for _ in range(150):
        w = "".join(rng.choice("abces") for _ in range(rng.randint(1, 9)))
        pairs.append((w, w[:-rng.randint(1, 2)] + rng.choice(["", "y", "a"]) if w.endswith("s") else w))
    df = spark.createDataFrame(pairs, "word string, target string")
    rules = S.learn(df)
    want = learned(pairs)
    assert {r["ending"]: (r["cut"], r["add"]) for r in rules.collect()} == want
    words = ["taxes", "parties", "women", "foxes", "", "b", "sses"] + ["".join(rng.choice("abces") for _ in range(rng.randint(1, 9))) for _ in range(150)]
    got = S.apply_rules(spark.createDataFrame([(w,) for w in words + words[:5] + [None]], "word string"), rules).collect()
    assert {r["word"]: r["target"] for r in got} == {w: applied(want, w) for w in words} | {None: None}
    assert len(got) == len(set(words)) + 1
    assert S.apply_rules(df.select("word"), S.learn(df.limit(0))).where(F.col("word") != F.col("target")).count() == 0
