"""Quality rules: a learned decision list over text statistics.

Statistics are column expressions, one pass over the whole texts, no shuffle.
Sequential covering learns from labelled rows: each rule starts empty and
grows by the threshold condition of the best FOIL gain on the growing rows
until it covers no good document (or nothing gains), is pruned to the prefix
of the best (bad - good) / (bad + good) on the pruning rows, and is kept if it
is precise enough there; its rows are then covered and the next rule grows.
Where it is not, a rule grows from the next best first condition; learning
ends when none is left.  The rules become one ordered ``CASE WHEN`` expression.

A threshold can stand between any two neighbouring values of the rows left at
that step, halfway.  The fit reads at most about ``max_labelled`` labelled
documents, chosen by a hash: their statistics, equal rows counted by Spark,
are sorted on the driver.  Everything else covers all rows.

Null and wordless texts have zero words (and fail the base rule).  Null labels
are left out; a document labelled more than once is bad if any label says so;
repeated documents count as often as they stand.  Without usable labels the
list has no rule and keeps what the base rule keeps.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, col, kept_columns, stage

MAX_LABELLED = 200_000
MIN_PRECISION = 0.9
MIN_COVER = 10

#: Statistic -> expression over the base counts, each free of text length.
STATISTICS = {
    "symbols_per_word": "n_symbols / n_words",
    "word_length": "word_chars / n_words",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / n_words",
    "distinct_share": "n_distinct / n_words",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "shout_per_word": "n_shouts / n_words",
    "mark_per_word": "n_marks / n_words",
    "words_per_line": "n_words / greatest(n_lines, 1)",
    "words": "n_words",
}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _without(text: Column, chars: str) -> Column:
    """Number of characters of ``text`` among ``chars``."""
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def text_statistics(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep`` columns and the counts of every whole text."""
    body = F.coalesce(col(text).cast("string"), F.lit(""))
    rows = docs.select(*[col(c) for c in keep], body.alias("_t"))
    trimmed = F.btrim("_t", F.lit(" \t\n\x0b\x0c\r"))
    rows = rows.withColumn("_w", F.when(F.length(trimmed) > 0, F.split(trimmed, BLANKS + "+"))
                           .otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("_l", F.filter(F.split("_t", "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\x0b\x0c\r"))) > 0))
    rows = rows.select(
        *[col(c) for c in keep],
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.translate("_t", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        _without(F.col("_t"), "#*$%&|<>").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size("_l").cast("long").alias("n_lines"),
        F.size(F.array_distinct("_w")).cast("long").alias("n_distinct"),
        (F.length("_t") - F.length(F.regexp_replace("_t", r"\p{Lu}+", ""))).cast("long").alias("n_upper"),
        _without(F.col("_t"), "0123456789").alias("n_digits"),
        _without(F.col("_t"), "!?").alias("n_shouts"),
        _without(F.col("_t"), ".,;:").alias("n_marks"),
        F.when(F.size("_w") >= 3, F.transform(
            F.slice("_w", 1, F.size("_w") - 2),
            lambda w, i: F.xxhash64(w, F.get("_w", i + 1), F.get("_w", i + 2)))).alias("_h"))
    # windows met twice: sort (hash, place) only where a hash repeats
    rows = rows.withColumn("_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array(
        F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("_h")
    rows = rows.withColumn("_d", F.sort_array(F.filter(F.transform("_s", lambda e, k: F.when(
        (e["h"] == F.get("_s", k - 1)["h"]) | (e["h"] == F.get("_s", k + 1)["h"]), e["i"])), lambda i: i.isNotNull())))
    rows = rows.withColumn("n_repeat_words", F.coalesce(F.aggregate(
        F.transform("_d", lambda i, k: F.least(F.lit(3), F.coalesce(F.get("_d", k + 1) - i, F.lit(3)))),
        F.lit(0).cast("long"), lambda n, x: n + x), F.lit(0).cast("long")))
    return rows.drop("_s", "_d")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    statistic: str
    above: bool
    threshold: float

    def column(self) -> Column:
        x = F.expr(STATISTICS[self.statistic]).cast("double")
        return x >= self.threshold if self.above else x < self.threshold

    def holds(self, values: dict[str, np.ndarray]) -> np.ndarray:
        x = values[self.statistic]
        return x >= self.threshold if self.above else x < self.threshold

    def __str__(self) -> str:
        return f"{self.statistic} {'>=' if self.above else '<'} {self.threshold:.6g}"


@dataclass(frozen=True)
class DecisionList:
    """Rules in order; a row that meets all conditions of one is rejected."""

    rules: tuple[tuple[Condition, ...], ...]

    def kept(self) -> Column:
        out = F.when(base_failed(), F.lit(False))
        for rule in self.rules:
            out = out.when(_all(rule), F.lit(False))
        return out.otherwise(F.lit(True))

    def rule_no(self) -> Column:
        """1-based number of the rule that rejects, 0 for the base rule, else null."""
        out = F.when(base_failed(), F.lit(0))
        for i, rule in enumerate(self.rules):
            out = out.when(_all(rule), F.lit(i + 1))
        return out


def _all(rule: tuple[Condition, ...]) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.column()
    return out


def learn(statistics: DataFrame, labels: DataFrame, doc_id: str = "doc_id", quality: str = "quality",
          max_labelled: int = MAX_LABELLED) -> DecisionList:
    """Decision list from the rows of ``statistics`` that ``labels`` covers."""
    marks = labels.where(col(quality).isNotNull() & col(doc_id).isNotNull()) \
        .groupBy(col(doc_id).alias("_id")).agg(F.min(col(quality)).alias("_q"))
    total = marks.count()
    if total > max_labelled:
        marks = marks.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < int(max_labelled / total * (1 << 30)))
    rows = statistics.join(marks, col(doc_id) == F.col("_id")).where(~base_failed())
    fields = [(F.col("_q") == 0).alias("bad"), (F.pmod(F.xxhash64("_id", F.lit(3)), F.lit(3)) == 0).alias("prune"),
              *[F.expr(e).cast("double").alias(k) for k, e in STATISTICS.items()]]
    # repeats of a document are one row with its number
    table = rows.select(*fields).groupBy("bad", "prune", *STATISTICS).agg(F.count(F.lit(1)).alias("rows")).toArrow()
    column = lambda c, t: table.column(c).to_numpy().astype(t)
    return DecisionList(cover({k: column(k, np.float64) for k in STATISTICS}, column("bad", bool), column("prune", bool),
                              column("rows", np.float64)))


def cover(values: dict[str, np.ndarray], bad: np.ndarray, prune: np.ndarray,
          rows: np.ndarray) -> tuple[tuple[Condition, ...], ...]:
    """Rules by sequential covering over rows of statistics with their numbers."""
    order = {k: np.argsort(x, kind="stable") for k, x in values.items()}
    p, n = np.where(bad, rows, 0.0), np.where(bad, 0.0, rows)
    rules: list[tuple[Condition, ...]] = []
    free = np.ones(len(rows), bool)
    failed: set[tuple[str, bool]] = set()  # first conditions that led to no rule on the rows left
    while True:  # a rule takes bad rows away, a failure a first condition: both run out
        rule: list[Condition] = []
        met = [free]
        while True:  # every condition with a gain parts the rows left, until none of them is good
            best = _best_condition(values, order, p, n, met[-1] & ~prune, set() if rule else failed)
            if best is None:
                break
            rule.append(best)
            met.append(met[-1] & best.holds(values))
        if not rule:
            break
        counts = [(float(p[m & prune].sum()), float(n[m & prune].sum())) for m in met[1:]]
        scored = [((pp - nn) / (pp + nn), -k, pp, nn) for k, (pp, nn) in enumerate(counts, 1) if pp]
        _, k, pp, nn = max(scored) if scored else (0, 0, 0.0, 0.0)
        if pp < MIN_COVER / 3 or pp / (pp + nn) < MIN_PRECISION:
            failed.add((rule[0].statistic, rule[0].above))
            continue
        rules.append(tuple(rule[:-k]))
        free = free & ~met[-k]
        failed = set()
    return tuple(rules)


def _best_condition(values, order, p, n, rows, without) -> Condition | None:
    """Condition of the best FOIL gain over all thresholds on the ``rows``."""
    p0, n0 = float(p[rows].sum()), float(n[rows].sum())
    best, best_gain = None, 1e-9
    if not p0 or not n0 or p0 < MIN_COVER:
        return None
    for name, at in order.items():
        at = at[rows[at]]
        x = values[name][at]
        last = np.flatnonzero(x[1:] > x[:-1])  # last row below each threshold
        low, high = x[last], x[last + 1]
        p_low, n_low = np.cumsum(p[at])[last], np.cumsum(n[at])[last]
        for above, pp, nn in ((False, p_low, n_low), (True, p0 - p_low, n0 - n_low)):
            if not len(last) or (name, above) in without:
                continue
            gain = np.where(pp >= MIN_COVER, pp * (np.log2(np.maximum(pp, 1) / np.maximum(pp + nn, 1))
                                                   - np.log2(p0 / (p0 + n0))), 0.0)
            k = int(np.argmax(gain))
            if gain[k] > best_gain:
                middle = low[k] + (high[k] - low[k]) / 2
                best, best_gain = Condition(name, above, float(middle if middle > low[k] else high[k])), gain[k]
    return best


def judged(docs: DataFrame, labels: DataFrame, keep: list[str], text: str = "text", doc_id: str = "doc_id",
           **options) -> tuple[DataFrame, DecisionList]:
    """``keep`` columns, base counts, base_failed, kept and rule_no per row;
    kept columns that bear the name of a result are replaced by it."""
    keep = kept_columns(docs, keep, *BASE, "base_failed", "kept", "rule_no")
    safe = docs.select(*[col(c).alias(f"k{i}") for i, c in enumerate(keep)], col(doc_id).alias("key"), col(text).alias("body"))
    counted = stage(text_statistics(safe, "body", safe.columns[:-1]), "quality-statistics")
    rules = learn(counted, labels.select(col(doc_id).alias("key"), *[col(c) for c in labels.columns if c != doc_id]), "key", **options)
    return counted.select(*[col(f"k{i}").alias(c) for i, c in enumerate(keep)], *BASE, base_failed().alias("base_failed"),
                          rules.kept().alias("kept"), rules.rule_no().alias("rule_no")), rules


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that the base rule and the learned list keep,
    columns unchanged.

    Rows are written once with their statistics; the fit reads the narrow
    columns of that table, the learned expression filters it.  No text is
    shuffled and no statistic is worked out twice."""
    names = docs.columns
    safe = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at, key = f"c{names.index(text)}", f"c{names.index(doc_id)}"
    counted = stage(text_statistics(safe, at, safe.columns), "quality-rows")
    known = labels.select(col(doc_id).alias(key), *[col(c) for c in labels.columns if c != doc_id])
    rules = learn(counted, known, key, **options)
    return counted.where(rules.kept()).select(*safe.columns).toDF(*names)
