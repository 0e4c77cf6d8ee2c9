"""Link joins on the worked examples (hand lexicon, taxonomy and graph)."""

from pyspark.sql import functions as F

from pairsmith.operators import kg, linking


def _ann(spark, pairs, lex):
    p = spark.createDataFrame(pairs, "pair_id long, s1 string, s2 string")
    lx = spark.createDataFrame(lex, "word string, pos string, ent string")
    return linking.annotate(p, lx)


def test_isa_worked_example(spark):
    pairs = [(1, "the frog and the cats playing outside in the sand on chair",
              "i see other animal inside with a furniture")]
    lex = [(w, "NOUN", None) for w in ("frog", "cats", "cat", "sand", "chair", "animal", "furniture")]
    lemmas = spark.createDataFrame([(w, f"{w}.n.01", "n") for w in ("frog", "cat", "chair", "animal", "furniture", "sand")],
                                   "lemma string, sense string, pos string")
    edges = spark.createDataFrame([("frog.n.01", "animal.n.01"), ("cat.n.01", "animal.n.01"),
                                   ("chair.n.01", "furniture.n.01"), ("animal.n.01", "living_thing.n.01")],
                                  "child_sense string, parent_sense string")
    hyp = kg.hypernym_table(lemmas, edges)
    got = {r.object: (r.subjects, r.subject_ind, r.object_ind)
           for r in linking.link_isa(_ann(spark, pairs, lex), hyp).collect()}
    assert got == {"animal": (["frog", "cat"], [1, 4], [3]), "furniture": (["chair"], [11], [7])}


def _triples(spark, rows):
    return spark.createDataFrame(rows, kg.TRIPLES_SCHEMA)


def test_trademark_worked_example(spark):
    pairs = [(1, "Cotral leather goods remain unequalled .",
              "There is an Italian company that produces leather goods .")]
    lex = [("cotral", "PROPN", "ORG"), ("leather", "NOUN", None), ("goods", "NOUN", None)]
    t = _triples(spark, [("Q1", "Cotral", "country", "Q38", "Italy", 1)])
    countries = kg.entity_countries(t)
    out = linking.link_trademark(_ann(spark, pairs, lex), countries, linking.adjectives_table(spark),
                                 linking.synonyms_table(spark)).collect()
    assert [(r.object, r.subjects, r.subject_ind, r.object_ind) for r in out] == [("italy", ["cotral"], [0], [3])]


def test_location_worked_example(spark):
    pairs = [(1, "Although Trussville has its share of pubs , it is not a big city .",
              "Alabama has many pubs , bars , and discos .")]
    lex = [("trussville", "PROPN", "GPE"), ("alabama", "PROPN", "GPE"), ("pubs", "NOUN", None)]
    t = _triples(spark, [
        ("Q1", "Trussville", "country", "Q30", "United States of America", 1),
        ("Q1", "Trussville", "population", "20000", None, 1),
        ("Q1", "Trussville", "located_in", "Q173", "Alabama", 1),
        ("Q173", "Alabama", "instance_of", "state", "state", 2),
    ])
    places = kg.state_or_country(t, "United States of America")
    assert [(r.query, r.places) for r in places.collect()] == [("trussville", ["alabama"])]
    out = linking.link_location(_ann(spark, pairs, lex), places, ["united states of america"],
                                linking.synonyms_table(spark)).collect()
    assert [(r.object, r.subjects, r.subject_ind, r.object_ind) for r in out] == [("alabama", ["trussville"], [1], [0])]


def test_color_worked_example(spark):
    pairs = [(1, "we are sipping on some appletinis before we get to eat", "I sipped on a bright green cocktail")]
    lex = [("appletinis", "NOUN", None), ("appletini", "NOUN", None), ("cocktail", "NOUN", None)]
    t = _triples(spark, [("Q1", "appletini", "color", "Qg", "green", 1)])
    out = linking.link_color(_ann(spark, pairs, lex), kg.noun_features(t)).collect()
    assert [(r.object, r.subjects, r.subject_ind, r.object_ind, r.feature_type) for r in out] == \
        [("green", ["appletini"], [5], [5], "color")]


def test_two_colours_give_no_colour_row(spark):
    pairs = [(1, "some appletinis", "a green thing")]
    lex = [("appletinis", "NOUN", None)]
    t = _triples(spark, [("Q1", "appletini", "color", "Qg", "green", 1), ("Q1", "appletini", "color", "Qr", "red", 1)])
    assert linking.link_color(_ann(spark, pairs, lex), kg.noun_features(t)).count() == 0


def test_color_looks_staged_features_up(spark):
    """Of unknown size, features are streamed past a broadcast of the pairs, or both shuffled by noun."""
    ann = _ann(spark, [(1, "The cup is here .", "a red cup")], [("cup", "NOUN", None)])
    features = kg.noun_features(_triples(spark, [(f"Q{i}", "Cup" if i == 0 else f"Thing{i}", "color", "red", "red", 1) for i in range(300)]))
    out = linking.link_color(ann, features)
    assert [(r.object, r.subjects, r.subject_ind, r.object_ind, r.feature_type) for r in out.collect()] == [("red", ["cup"], [1], [1], "color")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    # below the fold: the candidates and one scan of the look-up, no grouping of features
    assert "noun#" in plan and "__ncolors" not in plan


def test_country_search_is_skipped_only_where_nothing_is_found(spark):
    syn = {"uk": ["u . k .", "great britain", "britain"], "odd": [""], "us": ["the us", "us"]}
    table = linking.synonyms_table(spark, syn).unionByName(spark.createDataFrame([("blank", [[]])], "country string, phrases array<array<string>>"))
    texts = ["great britain", "great hall", "u . k . britain", "the us us", "us", "the end", "FRANCE france", "", "uk", "odd", "blank", "britain great britain"]
    rows = spark.createDataFrame([(i, t.lower().split(" ")) for i, t in enumerate(texts)], "i int, l2 array<string>")
    both = rows.crossJoin(spark.createDataFrame([(c,) for c in ("uk", "odd", "us", "blank", "France")], "c string")) \
        .join(table, F.col("c") == F.col("country"), "left").withColumn("any", linking.first_words(F.col("c"), F.col("phrases")))
    hits = linking.country_positions("l2", F.col("c"), F.col("phrases"))
    got = both.select(hits.alias("plain"), linking._if_held("l2", "any", hits).alias("tested")).collect()
    assert all(r["plain"] == r["tested"] for r in got) and sum(bool(r["plain"]) for r in got) > 10


def test_a_fold_deals_its_rows_out_once(spark):
    rows = spark.createDataFrame([(1, "o", "s", [0], [1], 0), (1, "o", "r", [2], [3], 2)],
                                 "pair_id long, object string, subject string, s_ind array<int>, o_ind array<int>, first int")
    out = linking.fold_links(rows, "isa")
    assert out._jdf.queryExecution().executedPlan().toString().split("Final Plan")[0].count("Exchange hashpartitioning") == 1
    assert [(r.subjects, r.subject_ind, r.object_ind) for r in out.collect()] == [(["s", "r"], [0, 2], [1])]


def test_a_registry_works_its_look_ups_out_once(spark, monkeypatch):
    from pairsmith.plans import q_links
    seen, made = [], q_links.B.triples
    monkeypatch.setattr(q_links.B, "triples", lambda *a: (seen.append(1), made(*a))[1])
    registry = q_links.linkers(spark, "/root/testdata/sf0.001")
    ann = _ann(spark, [(1, "The cup is here .", "a red cup")], [("cup", "NOUN", None)])
    for _ in range(2):
        linking.run_linkers(ann, registry)
    assert len(seen) == 1
