"""Closure without limits, place mentions with spans, seeded picks."""

import pytest
from pyspark.sql import functions as F

from pairsmith.operators import kg, linking, locations


def _pairs(df):
    return {tuple(r) for r in df.collect()}


def test_closure_chain_and_cycle(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(150)], "child int, parent int")
    got = kg.closure(chain)
    assert got.count() == 150 * 151 // 2 and got.where("node = 0 AND anc = 150").count() == 1
    ring = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a"), (None, "a")], "child string, parent string")
    assert _pairs(kg.closure(ring)) == {(x, y) for x in "ab" for y in "ab"} | {("c", "a"), ("c", "b")}
    assert kg.closure(ring.limit(0)).count() == 0


def test_closure_beyond_a_million_edges(spark):
    edges = spark.range(1_100_000).select(F.col("id").alias("child"), (F.col("id") % 1000 + 2_000_000).alias("parent")) \
        .unionByName(spark.range(1000).select((F.col("id") + 2_000_000).alias("child"), F.lit(3_000_000).cast("long").alias("parent")))
    assert kg.closure(edges).count() == 1_100_000 * 2 + 1000


def test_states_over_places_only(spark):
    rows = [("e1", "Town", "located_in", "p1", "P", 1), ("p1", "P", "located_in", "s1", "Stateland", 1),
            ("e1", "Town", "country", "c", "C", 1), ("s1", "Stateland", "instance_of", "state", "state", 1),
            ("s1", "Stateland", "country", "c", "C", 2), ("e2", "Lost", "country", "c", "C", 3)]
    got = kg.entity_states(spark.createDataFrame(rows, kg.TRIPLES_SCHEMA))
    assert {r["query"]: r["states"] for r in got.collect()} == {"town": ["Stateland"], "stateland": ["Stateland"]}
    top = kg.top_country(spark.createDataFrame(rows, kg.TRIPLES_SCHEMA))
    assert dict(_pairs(top)) == {"town": "c", "stateland": "c", "lost": "c"}


def _names(spark, *names):
    return spark.createDataFrame([(n, "GPE" if n != "nile" else "LOC") for n in names], "name string, ent string")


def test_mentions_of_several_words(spark):
    names = _names(spark, "new york", "york", "south korea", "paris", "united states of america", "new", "nile")
    text = "In New  York, not York: South-Korea or paris; the United States of America. New Orleans, Nile"
    df = spark.createDataFrame([(1, text), (2, "nothing here"), (3, None), (4, "")], "id int, text string")
    got = locations.mentions(df, names, ["id"]).collect()
    assert [r["id"] for r in got] == [1]
    assert [(m["location"], m["words"], text[m["start_char"]:m["end_char"]]) for m in got[0]["m"]] == [
        ("new york", 2, "New  York"), ("york", 1, "York"), ("south korea", 2, "South-Korea"), ("paris", 1, "paris"),
        ("united states of america", 4, "United States of America"), ("new", 1, "New"), ("nile", 1, "Nile")]
    only = locations.mentions(df, names, ["id"], entity_types=["LOC"]).collect()
    assert [m["location"] for m in only[0]["m"]] == ["nile"]
    counts = dict(_pairs(locations.corpus_mentions(df, names)))
    assert counts["york"] == 1 and counts["new york"] == 1


def test_mentions_in_a_long_sentence(spark):
    text = " ".join(["word"] * 19_998 + ["new", "york"])
    df = spark.createDataFrame([(1, text)], "id int, text string")
    m = locations.mentions(df, _names(spark, "new york"), ["id"]).collect()[0]["m"]
    assert [(x["k"], x["start_char"], x["end_char"]) for x in m] == [(19_998, 19_998 * 5, 19_998 * 5 + 8)]


def test_pool_and_tagging_picks(spark):
    gaz = spark.createDataFrame([("peru", "lima"), ("peru", "cusco"), ("chad", None)], "country string, city string")
    ann = spark.createDataFrame(
        [(i, "permise", "g", s, 1, [loc], [0], [len(loc)], [True], [1]) for i, (s, loc) in enumerate(
            [("peru is far", "peru"), ("lima is near", "lima"), ("chad is dry", "chad"), ("oslo is cold", "oslo")])],
        "sample_id int, type string, genre string, sentence string, num_locations int, locations array<string>, "
        "start_char array<int>, end_char array<int>, known_location array<boolean>, word_count array<int>")
    got = {r["id"]: r for r in locations.sentence_pool(ann, gaz).collect()}
    assert set(got) == {"0_p", "1_p", "2_p"}
    assert got["0_p"]["location"] in ("lima", "cusco") and got["0_p"]["highlighted_sentence"] == "**peru** is far"
    assert (got["1_p"]["country"], got["1_p"]["location"], got["1_p"]["is_country"]) == ("peru", "lima", False)
    assert got["2_p"]["location"] is None
    cmap = spark.createDataFrame([("Peru", "Lima"), ("Chad", "Sarh"), ("Fiji", "Suva")], "country string, city string")
    tagged = spark.createDataFrame([(f"k{i}", "peru x", i % 3, c, 0, 4) for i, c in enumerate(["peru", "chad"] * 6)],
                                   "id string, sentence string, can_be_entailed int, country string, start_char int, end_char int")
    rows = locations.finalise_for_tagging(tagged, cmap).collect()
    assert len(rows) == 8 and sorted(r["pos"] for r in rows) == list(range(8))
    assert all(r["other_location"] in {"Lima", "Sarh", "Suva"} - {r["location"]} for r in rows)
    assert all(r["sentence"] == "{{{location}}} x" for r in rows)
    with pytest.raises(KeyError):
        locations.finalise_for_tagging(tagged, cmap.where("country <> 'Chad'"))


def test_location_cache_flow(spark):
    """Valid keys only, countries flagged, the rest looked up (FLT-06, J-20, J-06)."""
    rows = spark.createDataFrame([("town",), ("a?b",), ('x"y',), ("PERU",)], "location string")
    names = spark.createDataFrame([("Peru",)], "name string")
    found = spark.createDataFrame([("town", "chad"), ("peru", "x")], "query string, country string")
    assert _pairs(locations.location_cache(rows, names, found)) == {("town", False, "chad"), ("PERU", True, None)}


def test_tagger_plug_in_and_registry(spark):
    pairs = spark.createDataFrame([(1, "Frogs jump high", "An animal rests"), (2, "Frogs jump high", None)],
                                  "pair_id long, s1 string, s2 string")

    def by_length(words):  # any function of the distinct words
        return words.select("word", F.when(F.length("word") > 3, "NOUN").otherwise("X").alias("pos"),
                            F.lit(None).cast("string").alias("ent"))
    ann = linking.annotate(pairs, by_length)
    rows = {r["pair_id"]: r for r in ann.collect()}
    assert rows[1]["g1"] == ["frog", "jump", "high"] and rows[1]["pos2"] == ["X", "NOUN", "NOUN"]
    assert rows[2]["t2"] == [] and rows[2]["t1"] == ["Frogs", "jump", "high"]
    hyper = spark.createDataFrame([("frog", "animal")], "word string, hyper string")
    found = linking.run_linkers(ann, {"isa": lambda a: linking.link_isa(a, hyper), "again": lambda a: linking.link_isa(a, hyper)})
    assert [(r["pair_id"], r["object"], r["subjects"]) for r in found.collect()] == [(1, "animal", ["frog"])] * 2


def test_fold_takes_the_first_feature_type(spark):
    rows = spark.createDataFrame([(1, "gold", "ring", [0], [3], 0, t) for t in ("material", "color")],
                                 "pair_id long, object string, subject string, s_ind array<int>, o_ind array<int>, first int, feature_type string")
    got = linking.fold_links(rows, "color").collect()
    assert [(r["subjects"], r["feature_type"]) for r in got] == [(["ring"], "color")]


def _all_hits(words, names):
    return sorted((k, len(n)) for k in range(len(words)) for n in names if tuple(words[k:k + len(n)]) == n)


def test_trie_finds_what_brute_force_finds():
    import random
    from pairsmith.operators.trie import TokenTrie
    rng = random.Random(4)
    for _ in range(300):
        names = {tuple(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(0, 12))}
        words = [rng.choice("abcd") for _ in range(rng.randint(0, 30))]
        trie = TokenTrie(names)
        hits = _all_hits(words, names)
        assert sorted(trie.hits(words)) == hits
        free, want = 0, []
        for k, n in sorted(hits, key=lambda h: (h[0], -h[1])):
            if k >= free:
                want.append((k, n))
                free = k + n
        assert trie.leftmost_longest(words) == want
    deep = TokenTrie([["a"] * n for n in range(1, 200)] + [["a"] * 300 + ["b"]])
    assert deep.leftmost_longest(["a"] * 1000)[0] == (0, 199)


@pytest.mark.parametrize("trie_bytes", [1 << 20, 0])
def test_mentions_by_trie_and_by_join(spark, trie_bytes):
    names = spark.createDataFrame([("New York", "GPE"), ("york", "GPE"), ("york", "ORG"), ("york minster", "LOC"), ("new york city hall", None),
                                   ("--", "GPE"), (None, "GPE"), ("straße", "LOC")], "name string, ent string")
    texts = [(1, "NEW york minster, YORK\nMinster; Straße"), (2, "new york city hall new york city"), (3, None), (None, "York"), (5, ""),
             (6, "é 😀 york minster york")]
    df = spark.createDataFrame(texts, "id int, text string")
    got = {r["id"]: [(m["location"], m["k"], m["words"], m["ents"]) for m in r["m"]]
           for r in locations.mentions(df, names, ["id"], trie_bytes=trie_bytes).collect()}
    york = ("york", 1, ["GPE", "ORG"])
    place = lambda x, k: (x[0], k, *x[1:])
    assert got == {1: [("new york", 0, 2, ["GPE"]), ("york minster", 3, 2, ["LOC"]), ("straße", 5, 1, ["LOC"])],
                   2: [("new york city hall", 0, 4, []), ("new york", 4, 2, ["GPE"])], None: [place(york, 0)],
                   6: [("york minster", 1, 2, ["LOC"]), place(york, 3)]}
    spans = {r["id"]: r["m"] for r in locations.mentions(df, names, ["id"], trie_bytes=trie_bytes).collect()}
    for i, t in texts:
        for m in spans.get(i, []):
            found = t[m["start_char"]:m["end_char"]].lower()
            assert found.split()[0] == m["location"].split()[0] and found.split()[-1] == m["location"].split()[-1]
    typed = {r["id"]: [m["location"] for m in r["m"]]
             for r in locations.mentions(df, names, ["id"], entity_types=["ORG", "LOC"], trie_bytes=trie_bytes).collect()}
    assert typed == {1: ["york minster", "straße"], None: ["york"], 6: ["york minster", "york"]}
    counts = dict(_pairs(locations.corpus_mentions(df, names, trie_bytes=trie_bytes)))
    assert counts == {"new york": 2, "york minster": 2, "straße": 1, "new york city hall": 1, "york": 2}
    assert locations.corpus_mentions(df, names.limit(0), trie_bytes=trie_bytes).count() == 0


def test_mentions_of_more_names_than_a_trie_holds(spark, monkeypatch):
    """Names beyond the trie's bound are not joined with the words: tasks make tries of those at hand."""
    names = spark.createDataFrame([("New York", "GPE"), ("york", "ORG"), ("york minster", "LOC"), ("new york city hall", None), ("straße", "LOC"),
                                   *((f"Absent{i} place", "GPE") for i in range(50))], "name string, ent string")
    words = ["NEW", "York", "minster", "city", "Hall", "Straße", "of", "Absent7"]
    texts = [(i, " ".join(words[(i * k + k // 3) % 8] for k in range(i % 40)) if i % 9 else None) for i in range(300)]
    df = spark.createDataFrame(texts, "id int, text string").repartition(3)
    want = {types: {r["id"]: r["m"] for r in locations.mentions(df, names, ["id"], entity_types=types).collect()} for types in (None, ("LOC", "ORG"))}
    joined = {r["id"]: r["m"] for r in locations.mentions(df, names, ["id"], trie_bytes=0).collect()}
    assert want[None] == joined and len(joined) > 100
    counts = dict(_pairs(locations.corpus_mentions(df, names)))
    monkeypatch.setattr(locations, "_by_join", None)
    monkeypatch.setattr(locations, "TEXT_BYTES", 2000)
    for types, rows in want.items():
        assert {r["id"]: r["m"] for r in locations.mentions(df, names, ["id"], entity_types=types, trie_bytes=1).collect()} == rows
    assert dict(_pairs(locations.corpus_mentions(df, names, trie_bytes=1))) == counts and counts["new york"] > 0
