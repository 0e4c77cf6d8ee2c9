"""How often inputs are worked out and shuffled."""

import pytest
from pyspark.sql import functions as F

from pairsmith.operators import checks, dedup
from pairsmith.plans import q_io, q_prepare

ROWS = [(f"p{i}", f"h{i % 7}", "neutral", i, str(i % 5), "1", "1", "x", i) for i in range(40)]
SCHEMA = "premise string, hypothesis string, label string, row_id long, worker_id string, hit_id string, section string, item string, seq long"


@pytest.fixture
def counted(spark):
    """Stands for ``deduped``; and how many of its rows were worked out."""
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    return lambda *_: spark.createDataFrame(ROWS, SCHEMA).mapInArrow(run, SCHEMA), seen


def test_exclude_workers_works_its_rows_out_once(spark, counted, monkeypatch):
    rows, seen = counted
    monkeypatch.setattr(q_prepare, "deduped", rows)
    monkeypatch.setattr(q_prepare, "EXCLUDED_SUPPLIERS", ("3", "4"))
    assert q_prepare.q_exclude_workers(spark, "").count() == 24
    assert seen.value == len(ROWS)


def test_memo_cache_works_its_rows_out_once(spark, counted, monkeypatch):
    rows, seen = counted
    monkeypatch.setattr(q_io, "deduped", rows)
    got = q_io.q_memo_cache(spark, "").collect()
    assert seen.value == len(ROWS)
    assert len({r["cache_key"] for r in got}) == len(got) == len(ROWS) and {r["run"] for r in got} == {1, 2}


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_pair_leaks_take_one_shuffle(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA).withColumn("split", F.when(F.col("seq") < 20, "train").otherwise("test"))
    leaks = checks.pair_leaks(rows.unionByName(rows.where("seq = 3").withColumn("split", F.lit("dev"))))
    assert _exchanges(leaks) == 1  # before it runs: then the adaptive plan is listed too
    assert [tuple(r) for r in leaks.collect()] == [("p3", "h3", ["dev", "train"])]


def test_dedup_keys_travel_once(spark):
    df = spark.createDataFrame([*ROWS, (None, "h", "neutral", 1, "2", "1", "1", "x", 5), (None, "h", "entailment", 1, "2", "1", "1", "x", 4)], SCHEMA)
    out = dedup.drop_conflicts_dedup(df, ["seq"])
    assert out.columns == df.columns and out.count() == 41
    assert out.where("premise IS NULL").first()["label"] == "entailment"
    packed = next(x for x in out._jdf.queryExecution().optimizedPlan().toString().split("min(") if "struct(" in x)
    assert "premise, premise#" not in packed


def test_sheet_rows_are_dealt_out(spark):
    """A sheet in one partition is expanded in as many tasks as a shuffle has."""
    from pairsmith.operators import hits
    sheet = spark.createDataFrame([(i,) + ("x",) * len(hits.SHEET_COLUMNS) for i in range(64)],
                                  "row_id long, " + ", ".join(f"`{c}` string" for c in hits.SHEET_COLUMNS)).coalesce(1)
    got, failed = hits.expand_sheet(sheet)
    assert got.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    assert got.select("row_id").distinct().count() == 64 - failed.groupBy("row_id").count().where("count = 6").count()


def test_review_rows_bold(spark):
    from pairsmith.operators import hits
    cols = "premise, hypothesis, label, section, pword, hword, ptype, htype, row_id, worker_id, hit_id, is_complete"
    df = spark.createDataFrame([("a red car", "a car", "neutral", "1", "red", "bus", "x", "y", "1", "w", "h", "true"),
                                (None, "the car", "neutral", "1", "red", "car", "x", "y", "2", "w", "h", "true")], cols.replace(",", " string,") + " string")
    got = {(r["row_id"], r["type"]): r["text"] for r in hits.review_rows(df).collect()}
    assert got == {("1", "P"): "a **red** car", ("1", "H"): None, ("2", "P"): None, ("2", "H"): "the **car**"}


def test_features_of_repeated_documents(spark):
    """Equal ids are one document, a null id counts as one but has no features; terms are not written."""
    import math
    from pairsmith.operators import baseline_ml
    df = spark.createDataFrame([(1, "red car"), (1, "red"), (2, None), (3, "red bus red"), (None, "car")], "d long, t string")
    out = baseline_ml.tfidf_features(df, "t", "d", 2)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "parquet" not in plan.lower()
    got = {(r["doc_id"], r["term"]): r["weight"] for r in out.collect()}
    idf = lambda df: math.log(5 / (1 + df)) + 1
    want = {1: {"red": 2 * idf(2), "car": idf(2), "red car": idf(1)},
            3: {"red": 2 * idf(2), "bus": idf(1), "red bus": idf(1), "bus red": idf(1)}}
    assert got == {(d, t): pytest.approx(w / math.sqrt(sum(x * x for x in ws.values()))) for d, ws in want.items() for t, w in ws.items()}


def test_terms_are_counted_where_rows_lie(spark):
    from pairsmith.operators import text_features as X
    from pairsmith.operators.common import spread
    rows = spark.createDataFrame([(i, "red car red", "x y") for i in range(20)], "row long, p string, h string")
    counts = X.term_counts(spread(rows, "row"), "row", ["p", "h"], 2)
    assert counts._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1  # the texts, no terms
    assert counts.count() == 20 * 4


def test_sentences_are_joined_once(spark, tmp_path, monkeypatch):
    """Turns and gazetteer are worked out once for the mentions and the texts."""
    from pairsmith.plans import q_locations as Q
    seen = spark.sparkContext.accumulator(0)
    schema = "seq long, sentence1 string, sentence2 string, gold_label string, genre string"

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    turns = spark.createDataFrame([(1, "in Paris", "no place", "x", "user"), (2, "a", "b", "x", "user")], schema).mapInArrow(run, schema)
    monkeypatch.setattr(Q, "corpus", lambda *_: turns)
    monkeypatch.setattr(Q, "gazetteer_raw", lambda *_: spark.createDataFrame([("France", "Paris")], "country string, city string"))
    got = Q.q_location_sentences(spark, "").collect()
    assert [(r["sample_id"], r["type"], r["locations"], r["start_char"]) for r in got] == [(1, "permise", "paris", "3")]
    assert seen.value == 2


def test_lr_features_are_of_the_whole_fit(spark, monkeypatch):
    """No vocabulary or steps cut below those of the baseline, in the code and the SQL."""
    from pairsmith.operators import baseline_ml
    from pairsmith.plans import q_ml
    from pairsmith.plans.catalog import load_all
    words = [f"w{i:03}" for i in range(400)]
    rows = [(i, f"{w} red", "a car", "x", "y", label) for i, w in enumerate(words) for label in ("neutral", "entailment")]
    df = spark.createDataFrame(rows, "row_id long, premise string, hypothesis string, ptype string, htype string, label string")
    monkeypatch.setattr(q_ml, "_lr_parts", lambda *_: (df, df.limit(5)))
    real, seen = baseline_ml.fit, []

    def fit(train, test, cols, label="label", vocab_size=baseline_ml.VOCAB_SIZE, C=1.0, max_iter=baseline_ml.MAX_ITER):
        seen.append((vocab_size, max_iter))
        return real(train, test, cols, label, vocab_size, C, 3)  # few steps: the fit has tests of its own
    monkeypatch.setattr(baseline_ml, "fit", fit)
    got = {(r["col"], r["term"]): r["n_rows"] for r in q_ml.q_lr_features(spark, "").collect()}
    assert seen == [(843_000, 10_000)]
    assert len([t for c, t in got if c == "premise"]) == 801 and got["premise", "red"] == 800 and got["premise", "w007 red"] == 2
    assert "<= 843000)" in load_all()["lr_features"].sql and "<= 300)" in load_all()["lr_optimum"].sql


def test_features_by_parts_equal_those_by_terms(spark, monkeypatch):
    """Hashes and texts travel, no terms: the same weights as by counts dealt out by term."""
    import random
    from pairsmith.operators import baseline_ml, gram_weights
    from pairsmith.operators import text_features as X
    rng = random.Random(6)
    rows = [(rng.choice([None, *range(30)]), " ".join(rng.choice(["a", "red", "car", "é_1", "bus", "of"]) for _ in range(rng.randint(0, 12))) or None)
            for _ in range(60)]
    df = spark.createDataFrame(rows, "d int, t string")
    monkeypatch.setattr(gram_weights, "PART_BYTES", 40)
    out = baseline_ml.tfidf_features(df, "t", "d")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "hashpartitioning(term" not in plan and "hashpartitioning(col" not in plan
    got = {(r["doc_id"], r["term"]): r["weight"] for r in out.collect()}
    want = X.tfidf_all(X.text_terms(df.withColumnRenamed("t", "text"), "d", "text"), df.select("d").distinct().count())
    assert got == {(r["row"], r["term"]): pytest.approx(r["weight"]) for r in want.collect()} and len(got) > 300
    assert baseline_ml.tfidf_features(df.where("d < 0"), "t", "d").count() == 0
