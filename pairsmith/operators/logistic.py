"""Multinomial logistic regression by Newton steps (ML-02).

The loss - weighted mean of the log losses plus half ``penalty`` times the squared
coefficients, intercepts free - is convex: its one optimum does not depend on the
solver.  N-grams that stand together make it ill-conditioned, so a solver led by
gradients alone makes thousands of passes over the rows.  Here each Newton step is
solved by conjugate gradients, one pass of curvature products a step, led by the
factored curvature among the heaviest features (``BLOCK`` at most; the others by
their own curvature alone).  That leads the steps, not the result.

Rows travel once into blocks of plain arrays; every pass adds up gradients of all
blocks over the executors' tasks (``treeAggregate``).  Coefficients, and the
curvature of at most ``BLOCK`` features, are all that the driver holds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame

from ..session import stage
from .common import spread

# Features whose mutual curvature leads the steps, entries of a
# block of rows, products of entries added up at a time.
BLOCK, ENTRIES, PRODUCTS = 2048, 1 << 18, 1 << 20


def _pack(batches: Iterator) -> Iterator:
    """Arrow batches (y, weight, idx, value) to blocks of about ``ENTRIES`` entries."""
    import pyarrow as pa
    for b in batches:
        ptr = b.column(2).offsets.to_numpy()
        first, lists = ptr[0], [b.column(2).flatten().to_numpy(), b.column(3).flatten().to_numpy()]
        y, w, ptr = b.column(0).to_numpy(), b.column(1).to_numpy(), (ptr - first).astype(np.int64)
        at = 0
        while at < len(y):
            end = max(at + 1, int(np.searchsorted(ptr, ptr[at] + ENTRIES, "right")) - 1)
            parts = [y[at:end].astype(np.int64), w[at:end], np.diff(ptr[at:end + 1]), *(x[ptr[at]:ptr[end]] for x in lists)]
            yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(p).tobytes()], pa.binary()) for p in parts], list("ywniv"))
            at = end


class _Rows:
    """A block as arrays: classes, weights, entries (row, feature, value)."""

    def __init__(self, block):
        self.y, self.w, self.n = (np.frombuffer(block[c], t) for c, t in (("y", np.int64), ("w", np.float64), ("n", np.int64)))
        self.i, self.v = np.frombuffer(block["i"], np.int32).astype(np.intp), np.frombuffer(block["v"], np.float64)
        self.r = np.repeat(np.arange(len(self.y)), self.n)

    def dot(self, theta: np.ndarray) -> np.ndarray:
        """(classes, rows): products with (classes, features and intercept), less the
        last class's: chances and curvature depend on the differences alone."""
        each = [np.bincount(self.r, self.v * t[self.i], len(self.y)) + t[-1] for t in theta[:-1] - theta[-1]]
        return np.stack([*each, np.zeros(len(self.y))])

    def back(self, x: np.ndarray, size: int) -> np.ndarray:
        """(classes, features and intercept): sums of (classes, rows), which add up to
        zero over the classes, over the rows' entries."""
        each = [np.append(np.bincount(self.i, self.v * u[self.r], size), u.sum()) for u in x[:-1]]
        return np.stack([*each, -np.sum(each, axis=0)])

    def chances(self, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(classes, rows) chances, and each row's log loss."""
        s = self.dot(theta)
        s -= s.max(axis=0)
        e = np.exp(s)
        total = e.sum(axis=0)
        return e / total, np.log(total) - s[self.y, np.arange(len(self.y))]


def _gradient(b: _Rows, theta: np.ndarray) -> np.ndarray:
    p, loss = b.chances(theta)
    p[b.y, np.arange(len(b.y))] -= 1
    return np.append(b.back(b.w * p, theta.shape[1] - 1).ravel(), (b.w * loss).sum())


def _product(b: _Rows, both: np.ndarray) -> np.ndarray:
    """Curvature at ``both[0]`` times ``both[1]``."""
    p, t = b.chances(both[0])[0], b.dot(both[1])
    return b.back(b.w * p * (t - (p * t).sum(axis=0)), both.shape[2] - 1)


def _between(classes: int) -> np.ndarray:
    """(classes - 1, classes): orthonormal directions that add up to zero."""
    e = np.tri(classes - 1, classes) - np.eye(classes - 1, classes, 1) * np.arange(1, classes)[:, None]
    return e / np.sqrt((e * e).sum(axis=1, keepdims=True))


def _own(b: _Rows, theta: np.ndarray) -> np.ndarray:
    """Each feature's own curvature, its mean over the directions between classes."""
    p = b.chances(theta)[0]
    q = b.w * (1 - (p * p).sum(axis=0)) / (len(p) - 1)
    return np.append(np.bincount(b.i, b.v * b.v * q[b.r], theta.shape[1] - 1), q.sum())


def _mutual(b: _Rows, args: tuple[np.ndarray, np.ndarray, int]) -> np.ndarray:
    """Curvature among the features with a place from 0 to m - 1 (others: -1): an
    (m * m) row for each pair of directions between classes, with a pair of
    features' share at one of its two cells."""
    theta, place, m = args
    p, e = b.chances(theta)[0], _between(len(theta))
    along = lambda d: (d[:, None] * p).sum(axis=0)
    q = [b.w * (along(e[x] * e[y]) - along(e[x]) * along(e[y])) for x in range(len(e)) for y in range(x, len(e))]
    out, at = np.zeros((len(q), m * m)), place[b.i]
    r = np.append(b.r[at >= 0], np.arange(len(b.y)))  # the intercept is an entry of each row
    order = np.argsort(r, kind="stable")
    r, at, v = r[order], np.append(at[at >= 0], np.full(len(b.y), place[-1]))[order], np.append(b.v[at >= 0], np.ones(len(b.y)))[order]
    n = np.bincount(r, minlength=len(b.y))
    start = np.cumsum(n) - n
    for k in np.unique(n):
        rows = np.flatnonzero(n == k)
        few = max(2 * PRODUCTS // (k * k), 1)
        f, g = np.triu_indices(k)
        for part in (rows[x:x + few] for x in range(0, len(rows), few)):
            cell = start[part][:, None] + np.arange(k)
            a, x = at[cell], v[cell]
            key, xx = (a[:, f] * m + a[:, g]).ravel(), x[:, f] * x[:, g]
            for o, u in zip(out, q):
                np.add.at(o, key, (u[part][:, None] * xx).ravel())
    return out


def _factor(mutual: np.ndarray, ridge: np.ndarray) -> np.ndarray:
    """Lower Cholesky factor of the curvature over (direction, feature), from
    ``_mutual``'s rows.  In numpy's own loops: LAPACK's threads can stop for good
    in a process that has started Spark's JVM by a fork."""
    m = len(ridge)
    k = int(np.sqrt(2 * len(mutual)))
    whole, pairs = np.empty((k, m, k, m)), iter([x + x.T - np.diag(x.diagonal()) for x in mutual.reshape(-1, m, m)])
    for x in range(k):
        for y in range(x, k):
            whole[x, :, y], whole[y, :, x] = (g := next(pairs)), g
        whole[x, :, x] += np.diag(ridge)
    a, wide = whole.reshape(k * m, k * m), 32
    least = 1e-12 * a.diagonal().max()
    for p in range(0, k * m, wide):
        q = min(p + wide, k * m)
        panel = a[p:, p:q] - np.einsum("ik,jk->ij", a[p:, :p], a[p:q, :p])
        for c in range(q - p):
            panel[c:, c] /= np.sqrt(max(panel[c, c], least))
            panel[c + 1:, c + 1:] -= panel[c + 1:, c, None] * panel[c + 1:q - p, c]
            panel[c, c + 1:] = 0
        a[p:, p:q], a[p:q, q:] = panel, 0
    return a


def _solve(lower: np.ndarray, upper: np.ndarray, x: np.ndarray) -> np.ndarray:
    """``lower`` times ``upper`` (its transpose) is the matrix that the result gives ``x`` with."""
    x = x.copy()
    for j in range(len(x)):
        x[j] /= lower[j, j]
        x[j + 1:] -= x[j] * upper[j, j + 1:]
    for j in range(len(x) - 1, -1, -1):
        x[j] /= lower[j, j]
        x[:j] -= x[j] * lower[j, :j]
    return x


def _added(blocks, of: Callable, arg) -> np.ndarray:
    """Sum of ``of(block, arg)`` over all blocks."""
    sent = blocks.context.broadcast(arg)

    def both(a, b):
        return b if a is None else a if b is None else a + b
    out = blocks.treeAggregate(None, lambda a, b: both(a, of(_Rows(b), sent.value)), both)
    sent.destroy()
    return out


def fit(rows: DataFrame, size: int, classes: int, penalty: float, tol: float, max_iter: int) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (size, classes) and intercepts of ``rows`` (y, weight, idx,
    value): ``y`` in 0 .. ``classes`` - 1, ``idx`` and ``value`` the entries of a
    row's vector of ``size`` features.  Ends when a step is to lower the loss by
    less than ``tol`` of it, or after ``max_iter`` conjugate steps; coefficients
    of a feature add up to zero, intercepts too."""
    rows = spread(rows.selectExpr("cast(y as int) y", "weight", "idx", "value"))
    blocks = stage(rows.mapInArrow(_pack, "y binary, w binary, n binary, i binary, v binary"), "blocks").rdd
    mass = _added(blocks, lambda b, k: np.bincount(b.y, b.w, k), classes)
    if mass is None:
        raise ValueError("no training rows")
    total = mass.sum()
    theta = np.zeros((classes, size + 1))
    if (mass > 0).sum() < 2:  # one class alone: nothing to learn
        theta[-1, -1] = np.inf
        return theta[:, :-1].T, theta[:, -1]
    ridge = np.append(np.full(size, penalty), 0.0)

    def loss(x):
        g = _added(blocks, _gradient, x)
        return g[-1] / total + (ridge * x * x).sum() / 2, g[:-1].reshape(x.shape) / total + ridge * x

    def size_of(x):
        return float(np.sqrt((x * x).sum()))

    m = min(size + 1, BLOCK)
    own = _added(blocks, _own, theta) / total
    top = np.append(np.argsort(-own[:-1], kind="stable")[:m - 1], size)
    place = np.full(size + 1, -1)
    place[top] = np.arange(m)
    between, lower, spent, last = _between(classes), None, 0, 0
    f, g = loss(theta)
    first = size_of(g)
    while spent < max_iter and size_of(g) > 0:
        if lower is None or last > 5:  # the curvature has moved
            own = _added(blocks, _own, theta) / total + ridge
            own[own <= 0] = 1.0
            mutual = _added(blocks, _mutual, (theta, place, m)) / total
            lower = _factor(mutual, ridge[top] + 1e-9 * own[top])  # no feature is without curvature
            upper = np.ascontiguousarray(lower.T)

        def lead(x):
            z = x / own
            y = np.einsum("dc,cm->dm", between, x[:, top]).ravel()
            z[:, top] = np.einsum("dc,dm->cm", between, _solve(lower, upper, y).reshape(-1, m))
            return z - z.mean(axis=0)
        # conjugate gradients for curvature * step = -g
        step, r, last = np.zeros_like(theta), -g, 0
        z = lead(r)
        d, rz = z, (r * z).sum()
        goal = rz * min(0.1, size_of(g) / first) ** 2
        while last < max_iter - spent:
            h = _added(blocks, _product, np.stack([theta, d])) / total + ridge * d
            bend = (d * h).sum()
            if bend <= 0:
                break
            step, r, last = step + rz / bend * d, r - rz / bend * h, last + 1
            z = lead(r)
            rz, before = (r * z).sum(), rz
            if rz <= goal:
                break
            d = z + rz / before * d
        spent += max(last, 1)
        slope, by = (g * step).sum(), 1.0
        if slope >= 0:
            break
        now = loss(theta + step)
        while not now[0] <= f + 1e-4 * by * slope and by > 1e-6:
            if -slope <= tol * max(abs(f), 1e-300):
                break  # the change is below what the sum resolves
            by /= 2
            now = loss(theta + by * step)
        theta, (f, g) = theta + by * step, now
        if -slope <= tol * max(abs(f), 1e-300):
            break
    return theta[:, :-1].T, theta[:, -1]
