"""Answer-sheet expansion: one hand-made row per rule."""

from pairsmith.operators import hits as H

BASE = {
    H.C_PREMISE: "The dog sat on the mat", H.C_WORKER: "W1", H.C_HIT: "H1", H.C_SUBMIT: " {} ",
    H.C_HYPO: "dog", H.C_HYPER: "animal", H.C_L1B: "entailment",
    H.C_HYPOS: "puppy,hound", H.C_L2B2: "neutral,neutral", H.C_L2B1: "entailment,entailment",
    H.C_NON: "cat,bird", H.C_L3B1: "neutral,neutral", H.C_L3B2: "contradiction,neutral",
    H.C_P4: "(1) The animal ran", H.C_4A: "A dog ran", H.C_4B: "A cat ran",
    H.C_4AL: "neutral", H.C_4BL: "contradiction",
    H.C_P5: "(2) The dog ran", H.C_5A: "An animal ran", H.C_5B: "A cat ran",
    H.C_5AL: "entailment", H.C_5BL: "contradiction",
}


def expand(spark, **changes):
    row = dict(BASE)
    row.update({getattr(H, k): v for k, v in changes.items()})
    schema = ", ".join(f"`{c}` string" for c in H.SHEET_COLUMNS) + ", row_id long"
    df = spark.createDataFrame([tuple(row[c] for c in H.SHEET_COLUMNS) + (0,)], schema)
    s, q = H.expand_sheet(df)
    return s.orderBy("sample_idx").collect(), q.collect()


def counts(samples):
    out = {}
    for r in samples:
        out[(r.parser, r.block)] = out.get((r.parser, r.block), 0) + 1
    return out


def test_complete_sheet(spark):
    s, q = expand(spark)
    assert q == []
    assert counts(s) == {(1, 1): 1, (2, 1): 2, (2, 2): 2, (3, 1): 2, (3, 2): 2, (4, 1): 1, (4, 2): 1,
                         (5, 1): 1, (5, 2): 1, (6, 1): 2, (6, 2): 1, (6, 3): 2, (6, 4): 2}
    first = s[0]
    assert (first.premise, first.hypothesis, first.section) == ("The dog sat on the mat", "The animal sat on the mat", "1")
    assert first.is_complete is True
    p4 = [r for r in s if r.parser == 4]
    assert p4[0].premise == "The animal ran" and p4[1].label == "contradiction"  # 4b takes the 5bl label


def test_empty_cell_skips_silently(spark):
    s, q = expand(spark, C_HYPOS="{}")
    assert (2, 1) not in counts(s) and (6, 1) not in counts(s)
    assert {(r.parser, r.reason, r.silent) for r in q} == {(2, "empty_cell", True), (6, "empty_cell", True)}


def test_wrong_length_keeps_first_block(spark):
    s, q = expand(spark, C_L2B1="entailment")
    c = counts(s)
    assert c[(2, 1)] == 2 and (2, 2) not in c
    assert [(r.parser, r.reason) for r in q] == [(2, "list_length")]


def test_word_absent(spark):
    s, q = expand(spark, C_4A="A puppy ran")
    assert (4, 1) not in counts(s) and (6, 1) not in counts(s)
    assert {(r.parser, r.reason) for r in q} == {(4, "word_not_found"), (6, "word_not_found")}


def test_plural_prefix_match(spark):
    s, _ = expand(spark, C_PREMISE="The dogs sat")
    assert s[0].hypothesis == "The animals sat"


def test_no_number_prefix(spark):
    s, _ = expand(spark, C_P4="The animal ran")
    assert [r.premise for r in s if r.parser == 4][0] == "The animal ran"


def test_single_item_nonhypo_list(spark):
    s, q = expand(spark, C_NON="cat", C_L3B1="neutral", C_L3B2="neutral")
    c = counts(s)
    assert (6, 2) not in c and (6, 4) not in c and c[(6, 3)] == 2 and q == []


def test_brace_goes_to_quarantine(spark):
    s, q = expand(spark, C_PREMISE="The dog {sat}")
    assert 1 not in {r.parser for r in s}
    assert (1, "brace_in_sentence") in {(r.parser, r.reason) for r in q}


def test_leading_space_item_kept(spark):
    s, _ = expand(spark, C_HYPOS="puppy, hound")
    assert "The  hound sat on the mat" in [r.hypothesis for r in s if r.parser == 2 and r.block == 1]


def test_parsers_compose(spark):
    """One parser alone, and a user's parser behind the built-in ones."""
    from pyspark.sql import functions as F
    row = tuple(BASE[c] for c in H.SHEET_COLUMNS) + (0,)
    schema = ", ".join(f"`{c}` string" for c in H.SHEET_COLUMNS) + ", row_id long"
    df = spark.createDataFrame([row, tuple(None if c == H.C_HYPO else BASE[c] for c in H.SHEET_COLUMNS) + (1,)], schema)
    whole, _ = H.expand_sheet(df)
    only, failed = H.expand_sheet(df, parsers={3: H.PARSERS[3]})
    want = [r.asDict() for r in whole.where("parser = 3").drop("sample_idx").orderBy("row_id", "block", "j").collect()]
    assert [r.asDict() for r in only.drop("sample_idx").orderBy("row_id", "block", "j").collect()] == want and len(want) == 4
    assert [(r["row_id"], r["parser"], r["reason"]) for r in failed.collect()] == [(1, 3, H.NULL)]
    plan = only._jdf.queryExecution().optimizedPlan().toString()
    assert H.C_P4 not in plan.split("Project")[1]  # nothing of the other parsers is worked out

    def swapped(c):
        """Hypernym sentence as premise, the original as hypothesis."""
        ok = H._first_reason(*H.replace_checks(c.premise, c.hypo, c.pos["ph"]))
        one = F.array(F.struct(c.hyper_sentence.alias("premise"), c.premise.alias("hypothesis"), F.lit("neutral").alias("label"),
                               F.lit("own").alias("section"), c.hyper.alias("pword"), c.hypo.alias("hword"), F.lit("hyper").alias("ptype"),
                               F.lit("hypo").alias("htype"), F.lit(7).alias("parser"), F.lit(1).alias("block"), F.lit(0).alias("j")))
        return [(ok, one)]
    more, failed = H.expand_sheet(df, parsers=H.PARSERS | {7: swapped})
    own = more.where("parser = 7").collect()
    assert [(r["premise"], r["hypothesis"], r["section"]) for r in own] == [("The animal sat on the mat", "The dog sat on the mat", "own")]
    assert more.where("parser < 7").count() == whole.count()
    assert (1, 7) in {(r["row_id"], r["parser"]) for r in failed.collect()}
