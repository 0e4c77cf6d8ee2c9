"""Toxicity by the nearest labelled examples under TF-IDF cosine.

Terms are whole words and word beginnings (3 to 7 letters, so that inflected
and compounded forms meet), chosen for their lift among all labelled training
texts, however few of them are examples.  Cosines are over the chosen terms.
Examples are a bounded, hash-chosen sample of labelled training rows
(``max_toxic`` and ``max_clean``); document frequencies come from all texts.
The examples' vectors form a block-max inverted index: per term the postings
by block of examples and the greatest weight in each block.  A query visits
blocks by falling upper bound and stops when no block can beat its k-th best,
so the nearest examples are exact.  Votes are weighted by 1 / (distance +
0.05) and by the sampling rate of the example's class, then calibrated by an
isotonic fit of the examples' own leave-one-out votes.

Only the text makes a score.  Null and empty texts, and texts without a chosen
term, get the rate of toxic examples among such texts.  Null labels and ids
teach nothing; a document labelled more than once is toxic if any label says
so.  Without examples every score is 0.  Ties go to the example of the least
id.  One row out per row in.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_groups, col, free_name, kept_columns, stage

MAX_TOXIC, MAX_CLEAN = 3000, 5000
MAX_TERMS = 2048
MIN_DOCS, MIN_LIFT, MIN_CHI2 = 5, 2.0, 40.0
NEAREST = 15
ID_SLOTS = 1 << 20
BLOCK = 64
#: Tokens, and scored vectors, that a worker remembers.
MEMO = 500_000

_LETTERS = re.compile(r"[^\W\d_]+")


def token_terms(token: str) -> list[str]:
    """Terms of a blank-separated token: its words and their beginnings."""
    out = []
    for word in _LETTERS.findall(token.lower()):
        out.append("=" + word)
        out.extend("^" + word[:n] for n in range(3, min(7, len(word)) + 1))
    return out


class TermCounter:
    """Term numbers with counts of whole texts, tokens remembered."""

    def __init__(self, terms: list[str]):
        self.number = {t: i for i, t in enumerate(terms)}
        self.memo: dict[str, tuple[int, ...]] = {}

    def count(self, text: str | None) -> dict[int, int]:
        out: dict[int, int] = {}
        memo, number = self.memo, self.number
        for token, n in Counter((text or "").split()).items():
            ids = memo.get(token)
            if ids is None:
                if len(memo) >= MEMO:
                    memo.clear()
                ids = memo[token] = tuple(number[t] for t in token_terms(token) if t in number)
            for i in ids:
                out[i] = out.get(i, 0) + n
        return out


class BlockMaxIndex:
    """Exact nearest examples by cosine over sparse unit vectors."""

    def __init__(self, vectors: list[dict[int, float]], n_terms: int):
        # examples with the same heaviest terms share blocks, so that the blocks' maxima are tight
        heavy = [tuple(sorted(v, key=lambda t: (-v[t], t))[:3]) for v in vectors]
        self.place = np.array(sorted(range(len(vectors)), key=lambda i: (heavy[i], i)), np.int64)
        blocks = -(-len(vectors) // BLOCK) or 1
        rows = [(t, d, w) for d, i in enumerate(self.place) for t, w in vectors[i].items()]
        rows.sort()
        self.docs = np.array([d for _, d, _ in rows], np.int64)
        self.weights = np.array([w for _, _, w in rows], np.float64)
        cell = np.array([t * blocks + d // BLOCK for t, d, _ in rows], np.int64)
        self.starts = np.searchsorted(cell, np.arange(n_terms * blocks + 1)).reshape(-1)
        self.maxima = np.zeros(n_terms * blocks)
        np.maximum.at(self.maxima, cell, self.weights)
        self.maxima = self.maxima.reshape(n_terms, blocks)
        self.blocks = blocks

    def nearest(self, vector: dict[int, float], k: int, without: int = -1) -> list[tuple[float, int]]:
        """(cosine, example) of the k nearest with a positive cosine, ties to
        the least example number; ``without`` leaves one out."""
        terms = sorted(vector)
        if not terms or not len(self.place):
            return []
        q = np.array([vector[t] for t in terms])
        bound = q @ self.maxima[terms] + 1e-12
        best: list[tuple[float, int]] = []
        for b in np.argsort(-bound, kind="stable"):
            if bound[b] <= 1e-12 or len(best) == k and bound[b] < -best[-1][0]:
                break
            score = np.zeros(BLOCK)
            for t, w in zip(terms, q):
                lo, hi = self.starts[t * self.blocks + b], self.starts[t * self.blocks + b + 1]
                if hi > lo:
                    score[self.docs[lo:hi] - b * BLOCK] += w * self.weights[lo:hi]
            hits = np.flatnonzero(score > (0 if len(best) < k else -best[-1][0] - 1e-12))
            best.extend((-round(float(score[h]), 12), int(self.place[b * BLOCK + h])) for h in hits)
            best = sorted(x for x in best if x[1] != without)[:k]
        return [(min(1.0, -s), i) for s, i in best]


def vote(near: list[tuple[float, int]], toxic: np.ndarray, weight: np.ndarray) -> float:
    """Distance-weighted share of toxic among the nearest."""
    w = [weight[i] / (1 - c + 0.05) for c, i in near]
    return float(sum(x for x, (_, i) in zip(w, near) if toxic[i]) / sum(w))


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps (least x, value) of the rising least-squares fit (pooled neighbours)."""
    pools: list[list[float]] = []
    for i in np.argsort(x, kind="stable"):
        if pools and pools[-1][3] == x[i]:  # equal votes share a pool
            pools[-1][0] += w[i] * y[i]
            pools[-1][1] += w[i]
        else:
            pools.append([w[i] * y[i], w[i], x[i], x[i]])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            s, n, _, hi = pools.pop()
            pools[-1] = [pools[-1][0] + s, pools[-1][1] + n, pools[-1][2], hi]
    return np.array([p[2] for p in pools]), np.array([p[0] / p[1] for p in pools])


class Model:
    """Terms, their weights, the indexed examples and the calibration."""

    def __init__(self, terms: list[str], idf: np.ndarray, ids: list[str], counts: list[dict[int, int]],
                 toxic: np.ndarray, weight: np.ndarray, k: int = NEAREST):
        self.terms, self.idf, self.ids, self.toxic, self.weight, self.k = terms, idf, ids, toxic, weight, k
        vectors = [self.vector(c) for c in counts]
        self.index = BlockMaxIndex(vectors, len(terms))
        blank = np.array([not v for v in vectors], bool)
        # rate among texts without a chosen term, smoothed by one clean example
        rare = float(weight[~toxic.astype(bool)].mean()) if (toxic == 0).any() else 1.0
        self.blank = float((weight * toxic)[blank].sum() / (weight[blank].sum() + rare)) if len(ids) else 0.0
        near = [(i, self.index.nearest(v, k, without=i)) for i, v in enumerate(vectors) if v]
        known = [(i, vote(n, toxic, weight)) for i, n in near if n]
        at = np.array([i for i, _ in known], np.int64)
        self.steps, self.values = isotonic(np.array([x for _, x in known]), toxic[at].astype(float), weight[at])

    def vector(self, counts: dict[int, int]) -> dict[int, float]:
        v = {t: (1 + math.log(n)) * self.idf[t] for t, n in sorted(counts.items())}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()} if norm else {}

    def score(self, counts: dict[int, int]) -> tuple[float, list[tuple[float, int]]]:
        near = self.index.nearest(self.vector(counts), self.k)
        if not near:
            return self.blank, []
        x = vote(near, self.toxic, self.weight)
        if not len(self.steps):
            return x, near
        return float(self.values[max(0, int(np.searchsorted(self.steps, x, side="right")) - 1)]), near


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: CRC-32 of the id as text leaves 2 by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, text: str, doc_id: str, toxic: str, max_toxic: int, max_clean: int):
    """(staged examples: id, toxic, text ..., class weights, chosen terms)."""
    marks = labels.where(col(toxic).isNotNull() & col(doc_id).isNotNull() & ~held_out(col(doc_id))) \
        .groupBy(col(doc_id).alias("id")).agg(F.max(col(toxic)).cast("int").alias("toxic"))
    marks = stage(marks, "toxic-marks")
    have = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}
    rate = {1: min(1.0, max_toxic / max(1, have.get(1, 0))), 0: min(1.0, max_clean / max(1, have.get(0, 0)))}
    draw = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 30))
    chosen = marks.where(F.when(F.col("toxic") == 1, draw < int(rate[1] * (1 << 30)))
                         .otherwise(draw < int(rate[0] * (1 << 30))))
    # the sample's ids are bounded by max_toxic + max_clean: the texts stay where they are
    examples = stage(docs.select(col(doc_id).alias("doc"), col(text).cast("string").alias("text"))
                     .join(F.broadcast(chosen), F.col("doc") == F.col("id")).select("id", "toxic", "text"), "toxic-examples")
    # terms are counted over all labelled training texts, copies of a text once; most
    # other texts do not travel, at most ID_SLOTS slots of ids with a label are sent to them
    slot = lambda c: F.pmod(F.xxhash64(F.col(c)), F.lit(ID_SLOTS))
    kind = marks.schema["id"].dataType
    labelled = docs.select(col(doc_id).cast(kind).alias("doc"), col(text).cast("string").alias("text")) \
        .join(F.broadcast(marks.select(slot("id").alias("slot")).distinct()), slot("doc") == F.col("slot"), "left_semi") \
        .join(marks, F.col("doc") == F.col("id")).select("text", "toxic")
    once = stage(labelled.groupBy(F.xxhash64("text").alias("h"))
                 .agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")), "toxic-labelled")

    def terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        bad: Counter = Counter()
        memo: dict[str, list[str]] = {}
        for batch in batches:
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                terms: set[str] = set()
                for token in set((t or "").split()):
                    if token not in memo:
                        if len(memo) >= MEMO // 10:
                            memo.clear()
                        memo[token] = token_terms(token)
                    terms.update(memo[token])
                seen.update(terms)
                if y:
                    bad.update(terms)
                if len(seen) > MEMO:
                    yield _term_batch(seen, bad)
                    seen, bad = Counter(), Counter()
        yield _term_batch(seen, bad)

    sizes = {r["toxic"]: r["count"] for r in once.groupBy("toxic").count().collect()}
    n1, n0 = max(1, sizes.get(1, 0)), max(1, sizes.get(0, 0))
    n = float(n1 + n0)
    counts = once.select("text", "toxic").mapInArrow(terms_of, "term string, n long, p long") \
        .groupBy("term").agg(F.sum("n").alias("n"), F.sum("p").alias("p"))
    p, m = F.col("p").cast("double"), F.col("n").cast("double")
    chi2 = n * F.pow(p * (n - n1 - (m - p)) - (m - p) * (n1 - p), F.lit(2.0)) / (m * (n - m + 1e-9) * n1 * n0)
    best = counts.withColumn("chi2", chi2).where((p >= MIN_DOCS) & (p / m >= MIN_LIFT * n1 / n) & (F.col("chi2") >= MIN_CHI2)) \
        .orderBy(F.desc("chi2"), "term").limit(MAX_TERMS).select("term").collect()
    return examples, {k: 1 / v for k, v in rate.items()}, sorted(r["term"] for r in best)


def _term_batch(seen: Counter, bad: Counter) -> pa.RecordBatch:
    terms = list(seen)
    return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([seen[t] for t in terms], pa.int64()),
                                       pa.array([bad[t] for t in terms], pa.int64())], ["term", "n", "p"])


def term_vectors(rows: DataFrame, text: str, terms: list[str]) -> DataFrame:
    """All columns but ``text``, with ``terms`` and ``counts`` arrays; narrow."""
    rest = [c for c in rows.columns if c != text]
    slim = rows.select(*[col(c) for c in rest], col(text).cast("string").alias(text))
    schema = rows.select(*[col(c) for c in rest], F.array().cast("array<int>").alias("terms"),
                         F.array().cast("array<int>").alias("counts")).schema
    at = len(rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TermCounter(terms)
        for batch in batches:
            for lo, hi in byte_groups(batch, at):
                part = batch.slice(lo, hi - lo)
                got = [sorted(counter.count(t).items()) for t in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:at], pa.array([[i for i, _ in g] for g in got], pa.list_(pa.int32())),
                     pa.array([[n for _, n in g] for g in got], pa.list_(pa.int32()))], schema.names)

    return slim.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", toxic: str = "toxic",
             keep: list[str] | None = None, threshold: float = 0.3, max_toxic: int = MAX_TOXIC,
             max_clean: int = MAX_CLEAN) -> DataFrame:
    """``keep`` columns (all by default) with held_out, score (0 to 1),
    predicted (1 if score >= ``threshold``) and evidence: the nearest examples
    as (doc_id, cosine, toxic)."""
    keep = kept_columns(docs, keep, "held_out", "score", "predicted", "evidence", "terms", "counts")
    spark = docs.sparkSession
    examples, weights, terms = fit(docs, labels, text, doc_id, toxic, max_toxic, max_clean)
    body = free_name(docs, "text_of_row")[0]
    rows = stage(term_vectors(docs.select(*[col(c) for c in keep], held_out(col(doc_id)).alias("held_out"),
                                          col(text).alias(body)), body, terms), "toxic-vectors")
    total = rows.count()
    df = {r["t"]: r["count"] for r in rows.select(F.explode("terms").alias("t")).groupBy("t").count().collect()}
    idf = np.array([math.log((1 + total) / (1 + df.get(i, 0))) + 1 for i in range(len(terms))])
    # bounded: max_toxic + max_clean examples (repeats of an id count once), MAX_TERMS terms
    once = examples.groupBy("id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))
    seen = term_vectors(once, "text", terms).orderBy("id").collect()
    model = Model(terms, idf, [str(r["id"]) for r in seen], [dict(zip(r["terms"], r["counts"])) for r in seen],
                  np.array([r["toxic"] for r in seen], np.int64),
                  np.array([weights[r["toxic"]] for r in seen], np.float64))
    shared = spark.sparkContext.broadcast(model)
    evidence = pa.list_(pa.struct([("doc_id", pa.string()), ("cosine", pa.float64()), ("toxic", pa.int32())]))
    schema = rows.drop("terms", "counts").withColumn("score", F.lit(0.0)).withColumn("evidence", F.array().cast(
        "array<struct<doc_id:string,cosine:double,toxic:int>>")).schema
    at = len(keep) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        memo: dict[tuple, tuple[float, list]] = {}
        for batch in batches:
            scores, found = [], []
            for t, n in zip(batch.column(at).to_pylist(), batch.column(at + 1).to_pylist()):
                key = (*t, -1, *n)
                if key not in memo:
                    if len(memo) >= MEMO // 10:
                        memo.clear()
                    s, near = m.score(dict(zip(t, n)))
                    memo[key] = s, [{"doc_id": m.ids[i], "cosine": c, "toxic": int(m.toxic[i])} for c, i in near]
                scores.append(memo[key][0])
                found.append(memo[key][1])
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(scores, pa.float64()), pa.array(found, evidence)],
                                             schema.names)

    out = rows.mapInArrow(run, schema)
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
