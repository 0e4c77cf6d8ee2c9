"""Newton steps: the optimum of the loss, in few passes over the rows."""

import math
import random

import numpy as np
import pytest

from pairsmith.operators import logistic


def _rows(n=400, same=6, seed=2):
    """Entries of which many nearly repeat others, as n-grams do."""
    rng = random.Random(seed)
    data = []
    for _ in range(n):
        words = rng.sample(range(12), rng.randint(0, 4))
        cells = sorted((w + 12 * k, 1.0 + (0.01 * rng.random() if k else 0)) for w in words for k in range(same))
        y = (sum(words) + rng.randint(0, 2)) % 3
        data.append((float(y), 0.5 + y, [i for i, _ in cells], [v for _, v in cells]))
    return data, 12 * same


def _gradient(data, size, beta, own, penalty):
    g, total = np.vstack([penalty * beta, np.zeros(3)]), sum(r[1] for r in data)
    for y, w, idx, value in data:
        s = own + (np.asarray(value)[:, None] * beta[idx]).sum(axis=0) if idx else own
        p = np.exp(s - s.max())
        r = w / total * (p / p.sum() - np.eye(3)[int(y)])
        g[idx] += np.asarray(value)[:, None] * r
        g[-1] += r
    return math.sqrt((g * g).sum())


def test_optimum_in_few_passes(spark, monkeypatch):
    data, size = _rows()
    penalty, passes = 1e-5, []
    added = logistic._added
    monkeypatch.setattr(logistic, "_added", lambda *a: passes.append(1) or added(*a))
    rows = spark.createDataFrame(data, "y double, weight double, idx array<int>, value array<double>")
    beta, own = logistic.fit(rows, size, 3, penalty, 1e-12, 10_000)
    assert _gradient(data, size, beta, own, penalty) < 1e-7
    assert abs(beta.sum(axis=1)).max() < 1e-8 and abs(own.sum()) < 1e-8
    assert len(passes) < 60


def test_one_class_and_no_rows(spark):
    schema = "y double, weight double, idx array<int>, value array<double>"
    beta, own = logistic.fit(spark.createDataFrame([(2.0, 1.0, [0], [1.0])], schema), 2, 3, 0.1, 1e-12, 10)
    assert not beta.any() and own.tolist() == [0, 0, math.inf]
    with pytest.raises(ValueError):
        logistic.fit(spark.createDataFrame([], schema), 2, 3, 0.1, 1e-12, 10)
