"""Hard negatives by anchor-clustered shared lists with certified termination.

For every anchor: its positives, the best rows of its own label, and for each
positive the best rows of other labels whose score lies in a band below the
positive's.  Scores are integer inner products of quantised vectors.

Anchors are clustered by angle.  A row's product with any member of a cluster
is at most |anchor| |row| cos(max(0, angle(row, centre) - radius)), the radius
being the largest angle between the centre and a member.  For each cluster the
rows are sorted by this angular bound once; every member walks that shared list
from its top until the bound certifies that no row further down can matter: it
lies below the worst of the member's best so far, or below its bands.

At scale the rows stay where they are.  The anchors, a stated query set, go to
them in passes of about ``PASS_BYTES``, clusters together.  Each task makes the
shared lists of its rows block by block, carries the best few of every anchor
from block to block, and returns those; the merge is a top-k per anchor with
partial limits before the shuffle.  The positives of a pass are merged first:
they fix the bands that the walks for negatives may end at.  Neither clusters,
blocks nor partitions change the result.

Defined results: rows with a null id, a null label, a null vector or a null or
non-finite component (scaled, too) take no part; shorter vectors count as
filled up with zeros; a row with the anchor's id is no positive of it; repeated
rows are candidates each and repeated anchors answer each; where fewer rows fit
than are asked for, all of them; an empty table gives an empty one.  Scores
beyond 64 bits count as the nearest long.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, stage

#: Bytes of anchor vectors that go to the tasks in one pass, about.
PASS_BYTES = 16 << 20
#: Rows of a block, at most, and its bytes.
BLOCK_ROWS, BLOCK_BYTES = 8192, 32 << 20
#: Rows of a list that its members meet at once at first (doubled on the way), and products at once at most.
STEP_ROWS, STEP_CELLS = 256, 1 << 21
#: Anchors that the cluster centres are fitted on, and centres at most.
FIT_ANCHORS, CENTRES = 4096, 64
#: Slack of the cosine bound for rounding.
SLACK = 1e-6

#: Stands for "no row yet"; scores lie strictly between its negative and it.
_NONE = (1 << 63) - 1


def quantised(batch: pa.RecordBatch, at: int, scale: int, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(mask of the rows that take part, their whole-number vectors as floats).

    ``width``: components beyond it are left out (they meet only zeros)."""
    lists = batch.column(at)
    valid = np.asarray(lists.is_valid())
    size = np.where(valid, np.asarray(lists.value_lengths().fill_null(0)), 0).astype(np.int64)
    values = np.floor(np.asarray(lists.flatten().cast(pa.float64()).fill_null(np.nan)) * scale)
    row = np.repeat(np.arange(len(size)), size)
    valid &= np.bincount(row, ~np.isfinite(values), len(size)) == 0
    place = np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)
    width = int(size.max(initial=0)) if width is None else width
    out = np.zeros((len(size), width))
    fits = (place < width) & valid[row]
    out[row[fits], place[fits]] = values[fits]
    return valid, out[valid]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of ``a`` and ``b`` (whole numbers)."""
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(a.shape[1], 1)
    if most < 1 << 53:
        return (a @ b.T).astype(np.int64)
    whole = [[[int(x) for x in r] for r in m] for m in (a, b)]
    return np.array([[max(1 - _NONE, min(_NONE - 1, sum(x * y for x, y in zip(r, s)))) for s in whole[1]] for r in whole[0]],
                    np.int64).reshape(len(a), len(b))


def unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def centres(sample: np.ndarray, rounds: int = 10) -> np.ndarray:
    """Unit centres of a spherical k-means; at least one."""
    points = unit(sample)
    k = max(1, min(CENTRES, round(len(points) ** 0.5)))
    now = points[np.linspace(0, max(len(points) - 1, 0), k).astype(int)] if len(points) else np.zeros((1, sample.shape[1]))
    for _ in range(rounds):
        nearest = np.argmax(points @ now.T, axis=1)
        sums = np.zeros_like(now)
        np.add.at(sums, nearest, points)
        moved = unit(sums)
        now = np.where(np.any(moved != 0, axis=1, keepdims=True), moved, now)
    return now


class Best:
    """The best ``k`` (score, id) of each owner, higher scores first, then smaller ids."""

    def __init__(self, owners: int, k: int):
        self.score = np.full((owners, k), -_NONE, np.int64)
        self.id = np.full((owners, k), _NONE, np.int64)

    def worst(self, owners: np.ndarray) -> np.ndarray:
        """Scores below this cannot enter."""
        return self.score[owners, -1]

    def take(self, owner: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(owner):
            return
        k = self.score.shape[1]
        old = np.unique(owner)
        owner = np.concatenate((np.repeat(old, k), owner))
        score = np.concatenate((self.score[old].ravel(), score))
        ids = np.concatenate((self.id[old].ravel(), ids))
        order = np.lexsort((ids, -score, owner))
        owner, score, ids = owner[order], score[order], ids[order]
        rank = np.arange(len(owner)) - np.searchsorted(owner, owner, "left")
        top = rank < k
        self.score[owner[top], rank[top]] = score[top]
        self.id[owner[top], rank[top]] = ids[top]


@dataclass
class Anchors:
    """The anchors of one pass, clusters together."""

    no: np.ndarray
    id: np.ndarray
    label: np.ndarray
    vector: np.ndarray
    cluster: np.ndarray
    centre: np.ndarray  # unit vectors by cluster

    def __post_init__(self):
        self.norm = np.linalg.norm(self.vector, axis=1)
        cos = np.clip(np.sum(unit(self.vector) * self.centre[self.cluster], axis=1), -1, 1)
        angle = np.where(self.norm > 0, np.arccos(cos), 0.0)
        self.clusters = np.unique(self.cluster)
        self.members = [np.flatnonzero(self.cluster == c) for c in self.clusters]
        self.radius = [angle[m].max() for m in self.members]

    def walk(self, vector: np.ndarray, threshold, absorb) -> None:
        """One block of rows: per cluster one list by the angular bound, which
        all members walk until ``threshold(members)`` certifies their end."""
        norm = np.linalg.norm(vector, axis=1)
        cos = np.divide(vector @ self.centre[self.clusters].T, norm[:, None], where=norm[:, None] > 0,
                        out=np.zeros((len(vector), len(self.clusters))))
        for c, (members, radius) in enumerate(zip(self.members, self.radius)):
            away = np.maximum(np.arccos(np.clip(cos[:, c], -1, 1)) - radius, 0)
            bound = norm * (np.cos(away) + SLACK)
            order = np.argsort(-bound, kind="stable")
            at, step = 0, STEP_ROWS
            while at < len(order):
                members = members[self.norm[members] * bound[order[at]] >= threshold(members)]
                if not len(members):
                    break
                rows = order[at:at + max(1, min(step, STEP_CELLS // len(members)))]
                absorb(members, rows, products(self.vector[members], vector[rows]))
                at += len(rows)
                step *= 2


class Positives:
    """Best rows of the anchor's own label."""

    def __init__(self, anchors: Anchors, k: int):
        self.anchors, self.best = anchors, Best(len(anchors.no), k)

    def block(self, ids: np.ndarray, labels: np.ndarray, vector: np.ndarray) -> None:
        a = self.anchors

        def absorb(members, rows, score):
            fit = (labels[rows] == a.label[members][:, None]) & (ids[rows] != a.id[members][:, None]) \
                & (score >= self.best.worst(members)[:, None])
            m, r = np.nonzero(fit)
            self.best.take(members[m], score[m, r], ids[rows][r])

        a.walk(vector, lambda m: self.best.worst(m).astype(float), absorb)

    def rows(self) -> pa.RecordBatch:
        owner, k = np.nonzero(self.best.id < _NONE)
        return pa.RecordBatch.from_arrays([pa.array(self.anchors.no[owner]), pa.array(self.best.id[owner, k]),
                                           pa.array(self.best.score[owner, k])], ["anchor_no", "positive_id", "positive_score"])


class Negatives:
    """Best rows of other labels in the band of each positive of the anchor."""

    def __init__(self, anchors: Anchors, owner: np.ndarray, ids: np.ndarray, score: np.ndarray, band: tuple[int, int], k: int):
        self.anchors, self.owner, self.id, self.score = anchors, owner, ids, score
        self.high = np.array([max(-_NONE, min(_NONE - 1, band[1] * s // 100)) for s in score.tolist()], np.int64)
        self.low = np.array([min(_NONE, max(1 - _NONE, -(-band[0] * s // 100))) for s in score.tolist()], np.int64)
        self.low[self.low > self.high] = _NONE  # nothing fits
        self.best = Best(len(owner), k)
        self.place = np.argsort(owner, kind="stable")       # positives by anchor
        self.first = np.searchsorted(owner[self.place], np.arange(len(anchors.no) + 1))

    def floor(self, positives: np.ndarray) -> np.ndarray:
        return np.maximum(self.low[positives], self.best.worst(positives))

    def threshold(self, members: np.ndarray) -> np.ndarray:
        out = np.full(len(members), np.inf)
        n = self.first[members + 1] - self.first[members]
        for j in range(int(n.max(initial=0))):
            has = n > j
            out[has] = np.minimum(out[has], self.floor(self.place[self.first[members[has]] + j]).astype(float))
        return out

    def block(self, ids: np.ndarray, labels: np.ndarray, vector: np.ndarray) -> None:
        a = self.anchors

        def absorb(members, rows, score):
            other = labels[rows] != a.label[members][:, None]
            n = self.first[members + 1] - self.first[members]
            for j in range(int(n.max(initial=0))):
                has = np.flatnonzero(n > j)
                mine = self.place[self.first[members[has]] + j]
                fit = other[has] & (score[has] <= self.high[mine][:, None]) & (score[has] >= self.floor(mine)[:, None])
                m, r = np.nonzero(fit)
                self.best.take(mine[m], score[has[m], r], ids[rows][r])

        a.walk(vector, self.threshold, absorb)

    def rows(self) -> pa.RecordBatch:
        p, k = np.nonzero(self.best.id < _NONE)
        owner = self.owner[p]
        return pa.RecordBatch.from_arrays(
            [pa.array(self.anchors.no[owner]), pa.array(p), pa.array(self.anchors.id[owner]), pa.array(self.id[p]),
             pa.array(self.best.id[p, k]), pa.array(self.score[p]), pa.array(self.best.score[p, k])],
            ["anchor_no", "positive_no", "anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"])


def _search(rows: DataFrame, make, width: int, scale: int, schema: str) -> DataFrame:
    """What ``make()`` keeps of the rows of each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = make()
        some = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * max(width, 1))))
        for batch in batches:
            for lo in range(0, batch.num_rows, some):
                part = batch.slice(lo, some)
                valid, vector = quantised(part, 2, scale, width)
                if len(vector):
                    found.block(np.asarray(part.column(0))[valid], np.asarray(part.column(1))[valid], vector)
        yield found.rows()

    return rows.mapInArrow(run, schema)


def _assigned(anchors: DataFrame, centre: np.ndarray, scale: int) -> DataFrame:
    """(id, label, v array<double>, cluster int) of the anchors that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            valid, v = quantised(batch, 2, scale)
            width = max(v.shape[1], centre.shape[1])
            near = np.argmax(_widened(unit(v), width) @ _widened(centre, width).T, axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * v.shape[1], pa.int32()), pa.array(v.ravel()))
            keep = pa.array(valid)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), lists,
                                              pa.array(near, pa.int32())], ["id", "label", "v", "cluster"])

    return anchors.mapInArrow(run, "id long, label long, v array<double>, cluster int")


def _widened(m: np.ndarray, width: int) -> np.ndarray:
    return np.pad(m[:, :width], ((0, 0), (0, max(0, width - m.shape[1]))))


def hard_negatives(rows: DataFrame, anchor: Column, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
                   scale: int = 256, positives: int = 5, negatives: int = 5, band: tuple[int, int] = (80, 100)) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score) for every row that ``anchor`` marks.

    A component x counts as floor(scale * x).  ``positives`` rows of the same
    label per anchor, ``negatives`` rows of other labels per positive with
    band[0] * positive_score <= 100 * negative_score <= band[1] * positive_score."""
    slim = rows.where(col(vec_id).isNotNull() & col(label).isNotNull() & col(vector).isNotNull()) \
        .select(col(vec_id).cast("long").alias("id"), col(label).cast("long").alias("label"),
                col(vector).cast("array<double>").alias("v"), F.coalesce(anchor, F.lit(False)).alias("is_anchor"))
    stated, everything = slim.where("is_anchor").drop("is_anchor"), slim.drop("is_anchor")

    sample = stated.orderBy(F.xxhash64("id", "v")).limit(FIT_ANCHORS).toArrow().combine_chunks()
    centre = centres(quantised(sample.to_batches()[0], 2, scale)[1]) if sample.num_rows else np.zeros((1, 1))
    asked = stage(_assigned(stated, centre, scale).withColumn("no", F.monotonically_increasing_id()), "anchors")
    done = [_one_pass(everything, part, centre, scale, positives, negatives, band) for part in _passes(asked)]
    if not done:
        done = [_one_pass(everything, asked.limit(0), centre, scale, positives, negatives, band)]
    if len(done) > 1:
        done = [stage(d, "hard-negatives") for d in done]
    return reduce(DataFrame.unionAll, done)


def _passes(asked: DataFrame) -> Iterator[DataFrame]:
    """Parts of the anchors that hold about ``PASS_BYTES``, clusters together;
    a larger cluster is dealt to several by a hash of the anchor's number."""
    sizes = asked.groupBy("cluster").agg((F.sum(F.size("v")) * 8 + F.count(F.lit(1)) * 64).alias("n")).orderBy("cluster").collect()
    part, held = [], 0
    for r in sizes:
        if r["n"] > PASS_BYTES:
            shares = -(-2 * r["n"] // PASS_BYTES)
            mine = asked.where(F.col("cluster") == r["cluster"])
            yield from (mine.where(F.pmod(F.xxhash64("no"), F.lit(shares)) == i) for i in range(shares))
            continue
        if part and held + r["n"] > PASS_BYTES:
            yield asked.where(F.col("cluster").isin(part))
            part, held = [], 0
        part.append(r["cluster"])
        held += r["n"]
    if part:
        yield asked.where(F.col("cluster").isin(part))


def _one_pass(rows: DataFrame, part: DataFrame, centre: np.ndarray, scale: int, positives: int, negatives: int,
              band: tuple[int, int]) -> DataFrame:
    spark = rows.sparkSession
    table = part.select("no", "id", "label", "cluster", "v").toArrow().combine_chunks()
    no, ids, label, cluster = (table.column(k).to_numpy() for k in ("no", "id", "label", "cluster"))
    vector = quantised(table.to_batches()[0], 4, 1)[1] if table.num_rows else np.zeros((0, centre.shape[1]))
    width = max(vector.shape[1], centre.shape[1])
    anchors = Anchors(no, ids, label, _widened(vector, width), cluster, _widened(centre, width))
    sent = spark.sparkContext.broadcast(anchors)

    found = _search(rows, lambda: Positives(sent.value, positives), width, scale,
                    "anchor_no long, positive_id long, positive_score long")
    first = Window.partitionBy("anchor_no").orderBy(F.desc("positive_score"), "positive_id")
    merged = found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= positives).drop("rank").toArrow()
    place = {n: i for i, n in enumerate(no.tolist())}
    owner = np.array([place[n] for n in merged.column("anchor_no").to_pylist()], np.int64)
    good = spark.sparkContext.broadcast((owner, merged.column("positive_id").to_numpy(), merged.column("positive_score").to_numpy()))

    fits = _search(rows, lambda: Negatives(sent.value, *good.value, band, negatives), width, scale,
                   "anchor_no long, positive_no long, anchor_id long, positive_id long, negative_id long, "
                   "positive_score long, negative_score long")
    order = Window.partitionBy("anchor_no", "positive_no").orderBy(F.desc("negative_score"), "negative_id")
    return fits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives) \
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
