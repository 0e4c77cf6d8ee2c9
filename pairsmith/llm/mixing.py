"""Mixing sources to target weights by Pareto order sampling.

Sources share the words of the whole corpus by weight; no source is repeated
more than ``max_copies`` times, and what one can't take is shared among the
others (the level of the shares is found in closed form over the table of
sources).  A document of a source with target / size = 2.3 is certain of two
whole copies; the third is drawn with inclusion probability 0.3: documents are
ranked by their random odds u / (1 - u) over their inclusion odds
p / (1 - p), and the first ones in that order are taken up to the fixed size
of the source's sample, counted in words (the last one only if that comes
nearer).  Inclusion probabilities are unequal: they differ between sources,
and inside one by ``tilt``, a factor on the inclusion odds.

u comes from the MD5 of id and text: reruns agree, rows may move.  The cut in
a source is found from word sums of rank buckets, then inside one bucket; no
source is ever sorted in one task.  DataFrame functions only.

A null text has size 0 and is never taken for words; the null source is a
source of its own, last in order.  Rows equal in id and text are drawn
together.  An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, stage, word_count

#: Rank buckets per source.
BUCKETS = 4096
MAX_COPIES = 3


def source_targets(sizes: DataFrame, weights: Sequence[int], max_copies: int = MAX_COPIES) -> DataFrame:
    """``sizes`` (source, source_size): one row per source -> and ``target``.

    Weights repeat along the sources by code point, null last.  The windows
    here run over sources, not documents."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("nth"), F.lit(len(weights))) + 1))
    rows = sizes.withColumn("nth", (F.row_number().over(by_name) - 1).cast("int")).withColumn("w", w) \
        .withColumn("cap", F.col("source_size") * float(max_copies))
    # sources that stop at their cap come first by cap / w; the level of the rest follows from theirs
    filled = Window.orderBy(F.col("cap") / F.col("w"), "nth")
    before, whole = filled.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / \
        (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    rows = rows.withColumn("level", level)
    stands = F.min(F.when(F.col("cap") >= F.col("w") * F.col("level"), F.struct(F.col("cap") / F.col("w"), "nth",
                                                                                   "level"))).over(whole)
    return rows.withColumn("level", stands["level"]) \
        .select("source", "source_size", F.least("cap", F.col("w") * F.col("level")).alias("target"))


def random_odds(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """(u / (1 - u), MD5 hex): u in (0, 1) is the first 52 bits of the hash."""
    h = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"),
                       F.coalesce(text.cast("string"), F.lit(""))).cast("binary"))
    u = (F.conv(F.substring(h, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return u / (1 - u), h


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), max_copies: int = MAX_COPIES, doc_id: str = "doc_id",
        text: str = "text", source: str = "source", tilt: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, plan): ``rows`` has one row per document - id, source, size,
    random key - and ``plan`` one per source: source, source_size, target,
    whole copies, and the rank (odds ratio, hash) of the last document drawn."""
    odds, h = random_odds(col(doc_id), col(text))
    rows = stage(docs.select(col(doc_id).alias("doc_id"), col(source).cast("string").alias("source"),
                             word_count(col(text).cast("string")).alias("size"), odds.alias("odds"), h.alias("h"),
                             (F.lit(1.0) if tilt is None else tilt.cast("double")).alias("tilt")), "mix")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = source_targets(sizes, weights, max_copies)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = plan.withColumn("whole", F.floor(ratio).cast("int"))
    plan = plan.withColumn("p", ratio - F.col("whole")) \
        .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    plan = stage(plan, "mix-plan")
    ranked = rows.join(plan.select(F.col("source").alias("s"), "p", "rest"), F.col("source").eqNullSafe(F.col("s"))) \
        .where("p > 0 and size > 0").withColumn("q", rank_of("odds", "p", "tilt")) \
        .withColumn("bucket", F.least(F.floor(F.col("q") / (F.col("q") + 1) * BUCKETS),
                                                                                F.lit(BUCKETS - 1)))
    sums = ranked.groupBy("s", "rest", "bucket").agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(Window.partitionBy("s").orderBy("bucket"))
    edge = sums.withColumn("upto", upto).where("upto > rest and upto - words <= rest") \
        .select(F.col("s").alias("e"), F.col("bucket").alias("e_bucket"), (F.col("upto") - F.col("words")).alias("before"))
    inside = Window.partitionBy("s").orderBy("q", "h")
    total = F.col("before") + F.sum("size").over(inside)  # rows of equal rank come together
    near = ranked.join(edge, F.col("s").eqNullSafe(F.col("e")) & (F.col("bucket") == F.col("e_bucket")))
    near = near.withColumn("total", total).withColumn("group", F.sum("size").over(Window.partitionBy("s", "q", "h")))
    taken = near.where((F.col("total") <= F.col("rest")) |
                       (F.col("total") - F.col("rest") < F.col("rest") - (F.col("total") - F.col("group"))))
    last = taken.groupBy("s").agg(F.max(F.struct("q", "h")).alias("last"))
    # nothing of the edge bucket drawn: all buckets before it are
    cuts = edge.join(last, F.col("e").eqNullSafe(F.col("s")), "left").select(
        "e", F.coalesce("last", F.struct((F.col("e_bucket") / (BUCKETS - F.col("e_bucket"))).alias("q"),
                                         F.lit("").alias("h"))).alias("last"))
    plan = plan.join(cuts, F.col("source").eqNullSafe(F.col("e")), "left").drop("e")
    return rows, plan


def rank_of(odds: str, p: str, tilt: str) -> Column:
    """Pareto rank: random odds over inclusion odds."""
    return F.col(odds) / (F.col(p) / (1 - F.col(p)) * F.col(tilt))


def copies() -> Column:
    """Whole copies and the drawn one, over rows joined with their plan row.
    No cut in a source means that its whole sample is drawn (rest is not
    reached) - or that it has none to draw."""
    q = rank_of("odds", "p", "tilt")
    drawn = (F.col("p") > 0) & (F.col("last").isNull() | (F.struct(q.alias("q"), F.col("h")) <= F.col("last")))
    return F.col("whole") + drawn.cast("int")


def mixed_sizes(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words)."""
    rows, plan = mix(docs, **options)
    plan = stage(plan.withColumnRenamed("source", "s"), "mix-plan")  # its size is known: no source's rows meet in one task
    out = rows.join(plan, F.col("source").eqNullSafe(F.col("s")))
    return out.select("doc_id", "size", "source_size", "target", (copies() * F.col("size")).alias("taken"))


def mixed_docs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
               **options) -> DataFrame:
    """The documents of the mix, each as often as it is taken, columns as they
    were.  The texts are not shuffled: each row meets its source's plan row
    and works out its own copies."""
    names = docs.columns
    safe = docs.toDF(*[f"c{i}" for i in range(len(names))])
    of = {k: f"c{names.index(v)}" for k, v in (("doc_id", doc_id), ("text", text), ("source", source))}
    _, plan = mix(safe, **of, **options)
    plan = stage(plan.withColumnRenamed("source", "s"), "mix-cuts")
    odds, h = random_odds(col(of["doc_id"]), col(of["text"]))
    out = safe.withColumns({"odds": odds, "h": h, "tilt": options.get("tilt") or F.lit(1.0)}) \
        .join(plan, col(of["source"]).cast("string").eqNullSafe(F.col("s"))).withColumn("n", copies())
    return out.where("n > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n")))) \
        .select(*safe.columns).toDF(*names)
