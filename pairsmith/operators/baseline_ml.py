"""Bag-of-n-grams baseline classifier as a Spark ML job (AGG-14, ML-01..03).

Per text column: tokens of two or more word characters, 1..3-grams, counts
times the smoothed IDF ``ln((1 + n) / (1 + df)) + 1``, scaled to length 1
(``text_features``); the columns stand side by side, and a
multinomial logistic regression is fitted with balanced class weights
(``logistic``: Newton steps to the loss's one optimum).  That is checked:
``gradient`` works out the regularised loss and its gradient at the written
coefficients as aggregates, apart from the fit.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens2
from ..session import stage
from . import gram_weights, logistic, metrics
from . import text_features as X
from .common import spread

# Vocabulary size and iteration limit of the baseline.
VOCAB_SIZE = 843_000
MAX_ITER = 10_000
#: Relative change of the loss at which the fit ends.
TOLERANCE = 1e-12


def vocabulary(docs: DataFrame, text: str, doc_id: str, min_df: int = 1, max_df: float = 1.0,
               max_features: int | None = None) -> DataFrame:
    """(term, tf, df, idf) over all documents: ``df`` kept in
    [min_df, max_df * n]; the ``max_features`` most frequent terms (ties by
    hash, then term) when given - the vocabulary size is the feature, every
    row is counted."""
    n = docs.select(doc_id).distinct().count()
    per_doc = docs.select(doc_id, F.explode(tokens2(F.col(text))).alias("term")) \
        .groupBy(doc_id, "term").agg(F.count(F.lit(1)).alias("c"))
    v = per_doc.groupBy("term").agg(F.sum("c").cast("bigint").alias("tf"), F.count(F.lit(1)).cast("bigint").alias("df"))
    v = v.where((F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df * n)))
    if max_features:
        v = X.most_frequent(stage(v.withColumn("col", F.lit(text)), "terms"), max_features).drop("col")
    return v.withColumn("idf", F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.col("df"))) + 1)


def tfidf_features(docs: DataFrame, text: str, doc_id: str, ngrams: int = 3, vocab_size: int | None = None) -> DataFrame:
    """(doc_id, term, weight): 1..``ngrams``-grams of tokens of two or more
    word characters, counts times the smoothed IDF, L2-normalised per document
    (ML-01)."""
    n = docs.select(doc_id).distinct().count()
    if not vocab_size:
        return gram_weights.weights(docs, doc_id, X.token_text(F.col(text)), n, ngrams).withColumnRenamed("row", "doc_id")
    counts = X.text_terms(docs.select(doc_id, F.col(text).alias("text")), doc_id, "text", ngrams)
    counts = stage(counts.groupBy("row", "col", "term").agg(F.sum("tf").alias("tf")), "term-counts")
    weights = X.tfidf_rows(counts, X.vocabulary(counts, n, vocab_size))
    return weights.select(F.col("row").alias("doc_id"), "term", "weight")


@dataclass
class Model:
    """Coefficients (features, classes) and intercepts; the class of the highest score is predicted."""

    coefficients: np.ndarray
    intercepts: np.ndarray

    def transform(self, rows: DataFrame) -> DataFrame:
        """``rows`` (idx, value, ...) with ``prediction``."""
        sent = rows.sparkSession.sparkContext.broadcast((self.coefficients, self.intercepts))

        @F.pandas_udf("double")
        def best(idx: pd.Series, value: pd.Series) -> pd.Series:
            beta, own = sent.value
            n = idx.str.len().to_numpy(np.int64)
            at = np.repeat(np.arange(len(n)), n)
            i, v = (np.concatenate([*x, np.empty(0)]) for x in (idx, value))
            scores = [np.bincount(at, v * b[i.astype(np.int64)], len(n)) + c for b, c in zip(beta.T, own)]
            return pd.Series(np.argmax(scores, axis=0).astype(float))
        return rows.withColumn("prediction", best("idx", "value"))


@dataclass
class Baseline:
    """A fitted baseline with all that its check needs."""

    model: Model
    train: DataFrame         # row, y, weight, idx, value
    test: DataFrame          # row, y, idx, value
    weights: DataFrame       # row, col, term, idx, weight of the training rows
    groups: DataFrame        # y, weight (of all its rows), n, idx, value: training rows with equal texts as one
    terms: DataFrame         # col, term, tf, df, idf, idx
    coefficients: DataFrame  # idx, beta array<double> (by class; idx -1: intercepts)
    n_train: int
    size: int
    penalty: float           # factor of half the squared coefficients


def fit(train: DataFrame, test: DataFrame, text_cols: Sequence[str], label: str = "label", vocab_size: int = VOCAB_SIZE,
        C: float = 1.0, max_iter: int = MAX_ITER) -> Baseline:
    """Fit on ``train`` rows with a known label; the loss is the weighted mean of
    the log losses plus ``1 / (2 C n)`` times the squared coefficients."""
    idx = metrics.label_index(label)
    both = []
    for name, df in (("lr-train", train), ("lr-test", test)):
        df = df.withColumn("y", idx.cast("double")).where(F.col("y") >= 0).select("y", *text_cols)
        both.append(stage(df.withColumn("row", F.monotonically_increasing_id()), name))
    tr, te = both
    n = tr.count()

    def tokens(rows):
        return rows.withColumns({c: X.token_text(F.col(c)) for c in text_cols})
    # the loss is a sum over rows: rows with equal texts and label are worked with once, in as many tasks as a shuffle has
    same = stage(tokens(spread(tr.groupBy("y", *text_cols).agg(F.count(F.lit(1)).alias("__n")))), "lr-groups")
    vocab = X.chosen(X.term_totals(same, text_cols, "__n"), n, vocab_size)
    size = max(vocab.count(), 1)
    w = F.broadcast(metrics.class_weights(tr, "y").select(F.col("label").alias("y"), F.col("weight").alias("__w")))  # one row per class: bounded

    def entries(rows, *keys):
        return X.row_entries(rows, keys, text_cols, vocab)
    groups = entries(same.join(w, "y").withColumn("weight", F.col("__w") * F.col("__n")).withColumn("n", F.col("__n")), "y", "weight", "n")
    tr = entries(tokens(tr).join(w, "y").withColumn("weight", F.col("__w")), "row", "y", "weight")
    te = entries(tokens(spread(te)), "row", "y")
    cells = tr.select("row", F.explode(F.arrays_zip("idx", "value")).alias("x")).select("row", "x.idx", F.col("x.value").alias("weight"))
    weights = cells.join(vocab.select("idx", "col", "term"), "idx").select("row", "col", "term", "idx", "weight")
    penalty = 1.0 / (C * max(n, 1))
    classes = int(w.agg(F.max("y")).first()[0] or 0) + 1
    model = Model(*logistic.fit(groups, size, classes, penalty, TOLERANCE, max_iter))
    beta = model.coefficients
    used = abs(beta).sum(axis=1).nonzero()[0]
    rows = [(int(i), [float(b) for b in beta[i]]) for i in used] + [(-1, [float(b) for b in model.intercepts])]
    coefficients = stage(train.sparkSession.createDataFrame(rows, "idx int, beta array<double>"), "coefficients")
    return Baseline(model, tr, te, weights, groups, vocab, coefficients, n, size, penalty)


def gradient(b: Baseline) -> DataFrame:
    """One row (loss, gradient_norm): the regularised loss of the written
    coefficients and the length of its gradient, from the training rows'
    weights alone: each task adds its rows up, nothing travels per row."""
    each = lambda f: [f(j) for j in range(k)]
    written = {r["idx"]: r["beta"] for r in b.coefficients.collect()}  # as many as the model holds
    own = np.array(written.pop(-1))
    k, beta = len(own), np.zeros((b.size, len(own)))
    for i, x in written.items():
        beta[i] = x
    sent = b.groups.sparkSession.sparkContext.broadcast((beta, own))

    def run(batches):
        beta, own = sent.value
        g, head, sums = np.zeros_like(beta), np.zeros_like(own), np.zeros(2)
        for batch in batches:
            y, w = batch.column(0).to_numpy().astype(np.int64), batch.column(1).to_numpy()
            n = batch.column(2).value_lengths().to_numpy()
            at, i, v = np.repeat(np.arange(len(y)), n), *(batch.column(c).flatten().to_numpy() for c in (2, 3))
            s = np.stack([np.bincount(at, v * x[i], len(y)) + c for x, c in zip(beta.T, own)], axis=1)
            s -= s.max(axis=1, keepdims=True)
            p = np.exp(s)
            total = p.sum(axis=1)
            sums += w.sum(), (w * (np.log(total) - s[np.arange(len(y)), y])).sum()
            p /= total[:, None]
            p[np.arange(len(y)), y] -= 1
            r = p * w[:, None]
            g += np.stack([np.bincount(i, v * x[at], len(beta)) for x in r.T], axis=1)
            head += r.sum(axis=0)
        some = abs(g).sum(axis=1).nonzero()[0]
        cells = [*g[some].tolist(), [*head.tolist(), *sums.tolist()]]
        yield pa.RecordBatch.from_arrays([pa.array([*some.tolist(), -1], pa.int32()), pa.array(cells, pa.list_(pa.float64()))], ["idx", "g"])
    parts = b.groups.select("y", "weight", "idx", "value").mapInArrow(run, "idx int, g array<double>")
    # idx -1: the intercepts, the weight and the loss of a task's rows
    parts = stage(parts.groupBy("idx").agg(*[F.sum(F.get("g", F.lit(j))).alias(f"g{j}") for j in range(k + 2)]), "gradient")
    total = parts.where("idx = -1").select(*each(lambda j: F.col(f"g{j}").alias(f"i{j}")), F.col(f"g{k}").alias("w"), F.col(f"g{k + 1}").alias("loss")).first()
    data = parts.where("idx >= 0")
    zero = F.array(*[F.lit(0.0)] * k)
    full = data.join(b.coefficients.where("idx >= 0"), "idx", "full_outer").withColumn("beta", F.coalesce("beta", zero))
    g = F.array(*each(lambda j: F.coalesce(f"g{j}", F.lit(0.0)) / F.lit(total["w"]) + F.lit(b.penalty) * F.col("beta")[j]))
    squares = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x * x)
    own = sum((total[f"i{j}"] / total["w"]) ** 2 for j in range(k))
    out = full.agg(F.coalesce(F.sum(squares(g)), F.lit(0.0)).alias("gg"), F.coalesce(F.sum(squares(F.col("beta"))), F.lit(0.0)).alias("bb"))
    return out.select((F.lit(total["loss"] / total["w"]) + F.lit(b.penalty / 2) * F.col("bb")).alias("loss"),
                      F.sqrt(F.col("gg") + F.lit(own)).alias("gradient_norm"))


def fit_and_score(train: DataFrame, test: DataFrame, text_cols: Sequence[str], label: str = "label",
                  vocab_size: int = VOCAB_SIZE, C: float = 1.0, max_iter: int = MAX_ITER) -> DataFrame:
    """Train on ``train``, predict ``test``; one row of accuracy, macro- and
    micro-F1 (ML-01..03, AGG-13)."""
    b = fit(train, test, text_cols, label, vocab_size, C, max_iter)
    # the scores read the predictions several times
    return metrics.scores(stage(b.model.transform(b.test).select("y", "prediction"), "predictions"), "y", "prediction")
