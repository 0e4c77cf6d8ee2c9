"""Term choice, feature vectors and the optimum against plain Python."""

import math
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pairsmith.operators import baseline_ml, metrics
from pairsmith.operators import text_features as X


def test_most_frequent_is_exact(spark):
    rng = random.Random(3)
    data = [(c, f"t{i}", rng.randint(1, 4)) for c in ("a", "b", None) for i in range(60)] + [("c", "only", 1)]
    df = spark.createDataFrame(data, "col string, term string, tf long")
    import hashlib
    key = lambda r: (-r[2], hashlib.md5(r[1].encode()).hexdigest(), r[1])
    for size in (1, 7, 30, 60, 100):
        want = {r[:2] for c in ("a", "b", None, "c") for r in sorted((r for r in data if r[0] == c), key=key)[:size]}
        got = X.most_frequent(df, size).collect()
        assert {(r["col"], r["term"]) for r in got} == want and len(got) == len(want)


def test_numbers_are_gapless_and_vectors_whole(spark):
    rows = spark.createDataFrame([(1, "red car red", "x"), (2, None, ""), (3, "car", None), (4, "one a b two", "car car")],
                                 "row long, p string, h string")
    counts = X.term_counts(rows, "row", ["p", "h"], 2)
    got = {(r["row"], r["col"], r["term"]): r["tf"] for r in counts.collect()}
    assert got == {(1, "p", "red"): 2, (1, "p", "car"): 1, (1, "p", "red car"): 1, (1, "p", "car red"): 1, (3, "p", "car"): 1,
                   (4, "p", "one"): 1, (4, "p", "two"): 1, (4, "p", "one two"): 1, (4, "h", "car"): 2, (4, "h", "car car"): 1}
    vocab = X.vocabulary(counts, 4, 100)
    assert sorted(r["idx"] for r in vocab.collect()) == list(range(9))
    weights = X.tfidf_rows(counts, vocab)
    out = X.vectors(rows, "row", weights, 9).collect()
    assert all(r["features"].size == 9 for r in out) and {r["row"]: r["features"].numNonzeros() for r in out} == {1: 4, 2: 0, 3: 1, 4: 5}
    assert all(abs(r["features"].norm(2) ** 2 - parts) < 1e-9 for r in out for parts in [{1: 1, 2: 0, 3: 1, 4: 2}[r["row"]]])
    idf = {(r["col"], r["term"]): r["idf"] for r in vocab.collect()}
    assert idf["p", "car"] == pytest.approx(math.log(5 / 3) + 1)


@pytest.fixture(scope="module")
def fitted(spark):
    rng = random.Random(5)
    words = {"contradiction": ["never", "not", "red"], "neutral": ["maybe", "some", "red"], "entailment": ["always", "yes", "blue"]}
    data = []
    for i in range(150):
        label = rng.choice([*words, "entailment"])
        data.append((" ".join(rng.choice(words[label] + ["the", "of"]) for _ in range(rng.randint(0, 6))), rng.choice("xy") * 2, label))
    data.append(("always", "xx", "-"))
    df = spark.createDataFrame(data, "p string, h string, label string")
    return data, baseline_ml.fit(df, df.limit(40), ["p", "h"], vocab_size=25)


def test_optimum_by_sql_and_by_numpy(fitted, tmp_path):
    """DuckDB works loss and gradient out again from the written tables, numpy too."""
    data, b = fitted
    assert b.n_train == 150
    checked = baseline_ml.gradient(b).first()
    train = np.array([(r["row"], r["y"], r["weight"]) for r in b.train.select("row", "y", "weight").collect()])
    weights = [(r["row"], r["idx"], r["weight"]) for r in b.weights.collect()]
    beta = {r["idx"]: r["beta"] for r in b.coefficients.collect()}
    place = {int(r): i for i, r in enumerate(train[:, 0])}
    x, coef = np.zeros((len(train), b.size)), np.zeros((b.size, 3))
    for r, i, v in weights:
        x[place[r], i] = v
    for i, v in beta.items():
        if i >= 0:
            coef[i] = v
    y, w = train[:, 1].astype(int), train[:, 2]
    counts = Counter(y.tolist())
    assert all(abs(w[i] - 150 / (3 * counts[int(y[i])])) < 1e-9 for i in range(150))
    s = x @ coef + np.array(beta[-1])
    p = np.exp(s - s.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    loss = (w * -np.log(p[np.arange(150), y])).sum() / w.sum() + b.penalty / 2 * (coef ** 2).sum()
    r = w[:, None] * (p - np.eye(3)[y]) / w.sum()
    norm = math.sqrt(((x.T @ r + b.penalty * coef) ** 2).sum() + (r.sum(axis=0) ** 2).sum())
    assert checked["loss"] == pytest.approx(loss, abs=1e-9) and checked["gradient_norm"] == pytest.approx(norm, abs=1e-9)
    assert norm < 1e-5
    con = duckdb.connect()
    con.execute("CREATE TABLE t(r BIGINT, y INT, w DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?)", [(int(a), int(c), float(d)) for a, c, d in train])
    con.execute("CREATE TABLE x(r BIGINT, i INT, v DOUBLE)")
    con.executemany("INSERT INTO x VALUES (?, ?, ?)", weights)
    con.execute("CREATE TABLE c(i INT, k INT, b DOUBLE)")
    con.executemany("INSERT INTO c VALUES (?, ?, ?)", [(i, k, float(v)) for i, vs in beta.items() for k, v in enumerate(vs)])
    sql_loss, sql_norm = con.execute(f"""
        WITH s AS (SELECT t.r, t.y, t.w, k, (SELECT b FROM c WHERE c.i = -1 AND c.k = q.k) + coalesce((SELECT sum(x.v * c.b) FROM x JOIN c ON c.i = x.i
                          AND c.k = q.k WHERE x.r = t.r), 0) AS s FROM t, (SELECT unnest(range(3)) AS k) q),
        p AS (SELECT *, exp(s) / sum(exp(s)) OVER (PARTITION BY r) AS p FROM s),
        e AS (SELECT *, w * (p - CASE WHEN k = y THEN 1 ELSE 0 END) AS e FROM p),
        g AS (SELECT x.i, e.k, sum(x.v * e.e) / (SELECT sum(w) FROM t) AS g FROM x JOIN e ON e.r = x.r GROUP BY ALL),
        h AS (SELECT coalesce(g.g, 0) + {b.penalty!r} * coalesce(c.b, 0) AS g FROM g FULL JOIN (FROM c WHERE i >= 0) c ON c.i = g.i AND c.k = g.k
              UNION ALL SELECT sum(e) / (SELECT sum(w) FROM t) FROM e GROUP BY k)
        SELECT (SELECT -sum(w * ln(p)) / (SELECT sum(w) FROM t) FROM p WHERE k = y) + {b.penalty!r} / 2 * (SELECT sum(b * b) FROM c WHERE i >= 0),
               (SELECT sqrt(sum(g * g)) FROM h)""").fetchone()
    assert sql_loss == pytest.approx(checked["loss"], abs=1e-9) and sql_norm == pytest.approx(checked["gradient_norm"], abs=1e-8)


def test_predictions_follow_the_coefficients(fitted):
    _, b = fitted
    out = b.model.transform(b.test).select("y", "prediction").collect()
    assert sum(r["y"] == r["prediction"] for r in out) > 0.6 * len(out)
    assert metrics.scores(b.model.transform(b.test), "y", "prediction").first()["n"] == len(out)


def test_gradient_off_the_optimum(fitted):
    from dataclasses import replace
    _, b = fitted
    moved = b.coefficients.withColumn("beta", F.transform("beta", lambda x: x * 1.5))
    assert baseline_ml.gradient(replace(b, coefficients=moved)).first()["gradient_norm"] > 1e-3


def test_entries_are_those_of_the_joins(spark):
    """A text's entries, worked out where it lies, against counts joined with the vocabulary."""
    texts = [("red car red", "x y"), (None, ""), ("car", None), ("one a b two", "car car"), ("car", None), ("é_1 ßß red", "red")]
    rows = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "row long, p string, h string")
    counts = X.term_counts(rows, "row", ["p", "h"], 2)
    tokens = rows.withColumns({c: X.token_text(F.col(c)) for c in "ph"})
    totals = X.term_totals(tokens.withColumn("times", F.lit(3)), ["p", "h"], "times", 2)
    want = counts.groupBy("col", "term").agg((3 * F.sum("tf")).alias("tf"), (3 * F.count(F.lit(1))).alias("df"))
    assert {tuple(r) for r in totals.collect()} == {tuple(r) for r in want.collect()}
    for size in (100, 2):
        vocab = X.vocabulary(counts, len(texts), size)
        want = {(r["row"], r["idx"]): r["weight"] for r in X.tfidf_rows(counts, vocab).collect()}
        got = X.row_entries(tokens, ["row"], ["p", "h"], vocab, 2).collect()
        assert len(got) == len(texts)
        assert {(r["row"], i): v for r in got for i, v in zip(r["idx"], r["value"], strict=True)} == {k: pytest.approx(v) for k, v in want.items()}


def test_equal_rows_are_fitted_once(fitted):
    data, b = fitted
    groups = b.groups.select("y", "weight", "n", "idx").collect()
    assert sum(r["n"] for r in groups) == 150
    assert len(groups) == len({r for r in data if r[2] != "-"}) < 150
    assert sum(r["weight"] for r in groups) == pytest.approx(150)
    assert sum(r["n"] * len(r["idx"]) for r in groups) == b.weights.count()


def test_gradient_travels_by_feature(fitted, spark):
    """Each task adds its rows up: what is shuffled is a row a feature, whatever the rows are."""
    from dataclasses import replace
    _, b = fitted
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch
    counted = b.groups.mapInArrow(run, b.groups.schema)
    got = baseline_ml.gradient(replace(b, groups=counted)).first()
    assert seen.value == b.groups.count() < b.n_train
    assert got["gradient_norm"] < 1e-5 and 0 < got["loss"] < math.log(3)
