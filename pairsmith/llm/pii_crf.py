"""Personal data by a skip-chain conditional random field.

The base patterns (email, ip, card, phone) report on their own.  The field
runs over the tokens of a document that hold a digit or an @: each has a label
(none or a kind), neighbours share a chain potential, and repeated or similar
tokens anywhere in the document - equal after folding marks and case, equal
digits (of one token, or of a run of neighbouring number tokens), equal mail
box - share a skip potential.  Tokens of base spans are observed with their
kind; loopy sum-product messages carry it to the others until no message of
the document changes by more than ``STABLE``, and a token whose belief in a
kind reaches ``MIN_BELIEF`` becomes a span too.  (Messages on loops need not
settle: a document is read off after ``MOST_ROUNDS`` rounds at the latest,
which carry a label as many links far.)

Training is piecewise: node weights by a regularised multinomial logistic fit
on the base labels of a bounded sample (``TRAIN_TOKENS`` tokens, by hash),
chain and skip potentials by the log ratio of joint to independent label rates
over linked pairs of the same sample.  Skip links join consecutive members of
a group only, so a token repeated m times has m - 1 links.

Null and empty texts have no spans; an empty table gives an empty one (and a
field that adds nothing).  Spans are in code points, end exclusive.  One row
out per row in, rows judged each on its own.  A text is worked off whole, in
time and memory in proportion to its length: digit runs and blank-free runs
may be of any length.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_groups, col, free_name, kept_columns, stage

KINDS = ("email", "ip", "card", "phone")
LABELS = 1 + len(KINDS)
TRAIN_TOKENS = 60_000
MIN_BELIEF = 0.9
STABLE = 1e-6
MOST_ROUNDS = 2000
DAMPING = 0.3
#: Texts between which messages run at once, by bytes.
GROUP = 4 << 20

#: The base patterns.
_MAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_BOX = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # what fails at a run's first digit fails at its others
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT_OR_AT = re.compile(r"[0-9@]")
_TOKEN_END = re.compile(r"[0-9@]\S*")
_EDGE = " \t\r\n.,;:!?\"'<>[]{}|*#$%&"


def is_byte(digits: str) -> bool:
    """A decimal number of at most 255, of any length."""
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or "0") <= 255


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        if i % 2:
            x = x * 2 - 9 if x > 4 else x * 2
        total += x
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, leftmost and non-overlapping
    per kind; a match that fails its test is dropped, not tried again."""
    out = []
    done, at = 0, text.find("@")
    while at >= 0:  # the leftmost match through this @ starts with its run of mail characters
        lo = at
        while lo > done and text[lo - 1] in _BOX:
            lo -= 1
        m = _MAIL.match(text, lo) if lo < at else None
        if m:
            out.append((lo, 0, m.end()))
        done = m.end() if m else at + 1
        at = text.find("@", done)
    for m in _IP.finditer(text):
        if all(map(is_byte, m.group().split("."))):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def tokens(text: str) -> list[tuple[int, int]]:
    """Places of the blank-separated tokens with a digit or an @, without the
    marks at their ends."""
    out = []
    end = 0
    for m in _TOKEN_END.finditer(text):
        a, b = m.span()
        while a > end and not text[a - 1].isspace():  # its letters before the first digit or @
            a -= 1
        end = b
        while a < b and text[a] in _EDGE:
            a += 1
        while b > a and text[b - 1] in _EDGE:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


FEATURES = 30


def features(text: str, spans: list[tuple[int, int]]) -> np.ndarray:
    """0/1 features of each token, from its shape and its neighbours' shapes."""
    out = np.zeros((len(spans), FEATURES))
    shapes = []
    for a, b in spans:
        t = text[a:b]
        d = _digits(t)
        shapes.append((t, d))
    for i, ((a, b), (t, d)) in enumerate(zip(spans, shapes)):
        near_left = i > 0 and a - spans[i - 1][1] <= 2
        near_right = i + 1 < len(spans) and spans[i + 1][0] - b <= 2
        left, right = shapes[i - 1][0] if near_left else "", shapes[i + 1][0] if near_right else ""
        n = len(d)
        parts = t.split(".")
        quad = len(parts) == 4 and all(p.isascii() and p.isdigit() for p in parts)
        letters = any(c.isalpha() for c in t)
        row = out[i]
        row[0] = 1
        row[1] = "@" in t
        row[2] = t.count("@") == 1 and "." in t.partition("@")[2]
        row[3] = quad
        row[4] = quad and all(map(is_byte, parts))
        for k, (lo, hi) in enumerate(((0, 0), (1, 1), (2, 3), (4, 6), (7, 9), (10, 13), (14, 19), (20, 10 ** 9))):
            row[5 + k] = lo <= n <= hi
        row[13] = 14 <= n <= 19 and luhn(d) and not letters
        row[14] = 14 <= n <= 19 and not luhn(d)
        row[15] = t.startswith("+")
        row[16] = "(" in t or ")" in t
        row[17] = "-" in t
        row[18] = letters
        row[19] = letters and n > 0 and "@" not in t
        row[20] = near_left
        row[21] = near_right
        row[22] = left.startswith("+")
        row[23] = right.startswith("(")
        row[24] = left.startswith("(")
        row[25] = n == len(t)
        row[26] = bool(left) and i > 1 and a - spans[i - 2][1] < 12 and shapes[i - 2][0].startswith("+")
        row[27] = n == 7 and "-" in t
        row[28] = "." in t
        row[29] = n == 4 and (len(left) == 4 or len(right) == 4)
    return out


def skip_keys(token: str) -> list[str]:
    """Groups a token belongs to; members of a group share skip links."""
    d = _digits(token)
    out = []
    if len(d) >= 7:
        out.append("d" + d)
    folded = "".join(c for c in token.lower() if c.isalnum() or c in "@.")
    if len(folded) >= 5:
        out.append("t" + folded)
    if "@" in token and len(box := token.lower().partition("@")[0]) >= 4:
        out.append("m" + box)
    return out


def number_runs(text: str, spans: list[tuple[int, int]]) -> list[str]:
    """Skip key of the run of neighbouring number tokens (no letter, no @) that
    each token stands in, one object a run; '' for a token that stands alone
    or is no number, and for runs of fewer than 7 digits."""
    out = [""] * len(spans)
    number = [not any(c.isalpha() or c == "@" for c in text[a:b]) for a, b in spans]
    i = 0
    while i < len(spans):
        j = i + 1
        while number[i] and j < len(spans) and number[j] and text[spans[j - 1][1]:spans[j][0]] in (" ", "  "):
            j += 1
        if j > i + 1:
            digits = "".join(_digits(text[a:b]) for a, b in spans[i:j])
            out[i:j] = ["d" + digits if len(digits) >= 7 else ""] * (j - i)
        i = j
    return out


class Graph:
    """Tokens of several texts as one field."""

    def __init__(self, texts: list[str | None]):
        self.owner: list[int] = []
        self.places: list[tuple[int, int]] = []
        self.base: list[list[tuple[int, int, int]]] = []
        chain, skip, feats, seen = [], [], [], []
        for i, text in enumerate(texts):
            if not text or not _DIGIT_OR_AT.search(text):
                self.base.append([])
                continue
            base = base_spans(text)
            self.base.append(base)
            spans = tokens(text)
            first = len(self.places)
            last: dict[str, int] = {}
            starts = [x[0] for x in base]
            reach = list(accumulate((x[2] for x in base), max))
            runs = number_runs(text, spans)
            for k, (a, b) in enumerate(spans):
                node = first + k
                if k and a - spans[k - 1][1] <= 2:
                    chain.append((node - 1, node))
                keys = skip_keys(text[a:b])
                if runs[k] and runs[k] not in keys:
                    keys.append(runs[k])
                for key in keys:
                    if key in last:
                        skip.append((last[key], node))
                    last[key] = node
                j = bisect_left(starts, b) - 1
                while j >= 0 and reach[j] > a and base[j][2] <= a:
                    j -= 1
                seen.append(base[j][1] + 1 if j >= 0 and base[j][2] > a else 0)
            feats.append(features(text, spans))
            self.owner.extend([i] * len(spans))
            self.places.extend(spans)
        self.features = np.concatenate(feats) if feats else np.zeros((0, FEATURES))
        self.labels = np.array(seen, np.int64)
        self.chain = np.array(sorted(set(chain)), np.int64).reshape(-1, 2)
        self.skip = np.array(sorted(set(skip)), np.int64).reshape(-1, 2)


class Field:
    """Node weights and pair potentials, with belief propagation."""

    def __init__(self, weights: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.weights, self.chain, self.skip = weights, chain, skip

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, chain: np.ndarray, skip: np.ndarray, l2: float = 1e-2,
            steps: int = 400) -> "Field":
        """Piecewise: ``chain`` and ``skip`` are counts of label pairs."""
        w = np.zeros((FEATURES, LABELS))
        if len(x):
            target = np.eye(LABELS)[y]
            velocity = np.zeros_like(w)
            for _ in range(steps):
                p = softmax(x @ w)
                grad = x.T @ (p - target) / len(x) + l2 * w / max(1, FEATURES)
                velocity = 0.9 * velocity - 0.5 * grad
                w = w + velocity
        return cls(w, pair_potential(chain), pair_potential(skip))

    def beliefs(self, g: Graph) -> np.ndarray:
        """Marginals of every token by damped loopy sum-product; every text's
        messages run until they are stable, whatever other texts stand in ``g``."""
        node = g.features @ self.weights
        node -= node.max(axis=1, keepdims=True, initial=-1e9)
        observed = g.labels > 0
        node[observed] = -50.0
        node[observed, g.labels[observed]] = 0.0
        edges = np.concatenate((g.chain, g.skip))
        if not len(edges):
            return softmax(node)
        pair = np.exp(np.concatenate((np.broadcast_to(self.chain, (len(g.chain), LABELS, LABELS)),
                                      np.broadcast_to(self.skip, (len(g.skip), LABELS, LABELS)))))
        source = np.concatenate((edges[:, 0], edges[:, 1]))
        target = np.concatenate((edges[:, 1], edges[:, 0]))
        pair = np.concatenate((pair, pair.transpose(0, 2, 1)))
        back = np.concatenate((np.arange(len(edges)) + len(edges), np.arange(len(edges))))
        owner = np.array(g.owner)[source]
        message = np.zeros((len(source), LABELS))
        total = node.copy()
        running = np.arange(len(source))
        for _ in range(MOST_ROUNDS):
            out = total[source[running]] - message[back[running]]
            out = np.exp(out - out.max(axis=1, keepdims=True))
            new = np.log(np.einsum("ea,eab->eb", out, pair[running]) + 1e-300)
            new -= new.max(axis=1, keepdims=True)
            new = DAMPING * message[running] + (1 - DAMPING) * new
            moved = np.abs(np.exp(new) - np.exp(message[running])).max(axis=1) > STABLE
            message[running] = new
            nodes = np.unique(target[running])
            total[nodes] = node[nodes]
            np.add.at(total, target[running], new)
            running = running[np.isin(owner[running], owner[running[moved]])]
            if not len(running):
                break
        return softmax(total)

    def spans(self, texts: list[str | None]) -> list[list[tuple[int, int, int, bool]]]:
        """(start, kind, end, base) of each text, base spans first found."""
        g = Graph(texts)
        out = [[(s, k, e, True) for s, k, e in base] for base in g.base]
        if not len(g.places):
            return out
        belief = self.beliefs(g)
        best = belief[:, 1:].argmax(axis=1)
        sure = np.flatnonzero((g.labels == 0) & (belief[np.arange(len(best)), best + 1] >= MIN_BELIEF))
        last = None
        for i in sure.tolist():
            t, (a, b), k = g.owner[i], g.places[i], int(best[i])
            if last and last[0] == t and last[2] == k and i == last[3] + 1 and a - last[1] <= 2:
                s, _, _, _ = out[t][-1]
                out[t][-1] = (s, k, b, False)  # neighbours of one kind are one span
            else:
                out[t].append((a, k, b, False))
            last = (t, b, k, i)
        return [sorted(s, key=lambda x: (x[0], x[1], x[2])) for s in out]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True, initial=-1e9))
    return e / e.sum(axis=1, keepdims=True)


def pair_potential(counts: np.ndarray) -> np.ndarray:
    """log of joint over independent label rates of linked pairs (both ways),
    smoothed by one pair of each kind with itself and a hundredth of others."""
    joint = counts + counts.T + 0.01 + np.eye(LABELS)
    joint = joint / joint.sum()
    side = joint.sum(axis=1)
    return np.log(joint) - np.log(side[:, None] * side[None, :])


def train(docs: DataFrame, text: str = "text", sample_tokens: int = TRAIN_TOKENS) -> Field:
    """Fit on the tokens of the texts least by hash, about ``sample_tokens``."""
    slim = docs.select(col(text).cast("string").alias("t")).where(F.col("t").rlike("[0-9@]"))
    total = slim.count()
    picked = slim.select("t", F.xxhash64("t", F.lit(5)).alias("h"))
    # at most so many texts: each has a token
    if total > sample_tokens // 8:
        picked = picked.where(F.pmod("h", F.lit(1 << 30)) < int(sample_tokens / 8 / total * (1 << 30)))
    picked = picked.groupBy("h").agg(F.min("t").alias("t")).select("t", "h")  # copies teach once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in byte_groups(batch, 0, GROUP):
                part = batch.slice(lo, hi - lo)
                texts, keys = part.column(0).to_pylist(), part.column(1).to_pylist()
                g = Graph(texts)
                rows = [(0, keys[o], int(y), 0, f.tolist()) for o, y, f in zip(g.owner, g.labels, g.features.astype(np.int8))]
                for kind, edges in ((1, g.chain), (2, g.skip)):
                    count = np.zeros((LABELS, LABELS), np.int64)
                    np.add.at(count, (g.labels[edges[:, 0]], g.labels[edges[:, 1]]), 1)
                    rows.extend((kind, int(count[a, b]), a, b, []) for a, b in zip(*np.nonzero(count)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 5, (
                        pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int8())))], ["what", "n", "a", "b", "x"])

    got = picked.mapInArrow(run, "what int, n long, a int, b int, x array<tinyint>")
    got = stage(got, "pii-train")
    nodes = got.where("what = 0").orderBy("n", F.xxhash64("x", "a")).limit(sample_tokens).select("a", "x").toArrow()
    pairs = got.where("what > 0").groupBy("what", "a", "b").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros((3, LABELS, LABELS))
    for r in pairs:
        counts[r["what"], r["a"], r["b"]] = r["n"]
    x = np.array(nodes.column("x").combine_chunks().flatten(), np.float64).reshape(-1, FEATURES)
    return Field.fit(x, np.array(nodes.column("a"), np.int64), counts[1], counts[2])


def find_personal_data(docs: DataFrame, field: Field, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all by default) and ``spans``: array of (start, rank,
    kind, end, base), by start; a narrow map."""
    keep = kept_columns(docs, keep, "spans")
    body = free_name(docs, "text_of_row")[0]
    slim = docs.select(*[col(c) for c in keep], col(text).cast("string").alias(body))
    schema = docs.select(*[col(c) for c in keep], F.array().cast(
        "array<struct<start:bigint,rank:int,kind:string,end:bigint,base:boolean>>").alias("spans")).schema
    kind = pa.list_(pa.struct([("start", pa.int64()), ("rank", pa.int32()), ("kind", pa.string()), ("end", pa.int64()),
                               ("base", pa.bool_())]))
    at = len(keep)
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in byte_groups(batch, at, GROUP):
                part = batch.slice(lo, hi - lo)
                found = shared.value.spans(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:at], pa.array(
                    [[{"start": s, "rank": k, "kind": KINDS[k], "end": e, "base": b} for s, k, e, b in spans]
                     for spans in found], kind)], schema.names)

    return slim.mapInArrow(run, schema)
