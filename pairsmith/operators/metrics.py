"""Label indexing and evaluation metrics (PRJ-08, AGG-08, AGG-13, AGG-15).

Everything is a confusion-table aggregate: one shuffle of (truth, prediction)
keys with map-side counting; per-class figures come from the small table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Label order of the classifiers.
NLI_LABELS = ("contradiction", "neutral", "entailment")


def label_index(label_col: str = "label", labels: Sequence[str] = NLI_LABELS):
    """0-based index of the label; -1 for an unknown label (the reference
    raises there: callers route -1 rows to quarantine)."""
    return F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(label_col)).cast("int") - 1


def confusion(df: DataFrame, y: str, yhat: str) -> DataFrame:
    return df.groupBy(F.col(y).alias("y"), F.col(yhat).alias("yhat")).agg(
        F.count(F.lit(1)).cast("bigint").alias("n"))


def per_class(conf: DataFrame) -> DataFrame:
    """Precision, recall, F1 per class over the classes seen as truth or
    prediction; an empty denominator gives 0 (as sklearn reports)."""
    tp = conf.where(F.col("y") == F.col("yhat")).select(F.col("y").alias("c"), F.col("n").alias("tp"))
    sup = conf.groupBy(F.col("y").alias("c")).agg(F.sum("n").alias("support"))
    pred = conf.groupBy(F.col("yhat").alias("c")).agg(F.sum("n").alias("predicted"))
    classes = sup.select("c").unionByName(pred.select("c")).distinct()
    j = classes.join(tp, "c", "left").join(sup, "c", "left").join(pred, "c", "left").fillna(
        0, ["tp", "support", "predicted"])
    p = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(F.lit(0.0))
    r = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    return j.select("c", p.alias("precision"), r.alias("recall"),
                    F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0)).alias("f1"),
                    F.col("support").cast("bigint").alias("support"))


def scores(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """One row: accuracy, macro-F1, micro-F1 (= accuracy for single-label)."""
    conf = confusion(df, y, yhat)
    pc = per_class(conf).agg(F.avg("f1").alias("macro_f1"))
    acc = conf.agg((F.sum(F.when(F.col("y") == F.col("yhat"), F.col("n")).otherwise(0)) / F.sum("n"))
                   .alias("accuracy"), F.sum("n").cast("bigint").alias("n"))
    # both sides are one row: attach with a one-row broadcast
    return acc.withColumn("__one", F.lit(1)).join(F.broadcast(pc.withColumn("__one", F.lit(1))), "__one") \
        .drop("__one").withColumn("micro_f1", F.col("accuracy"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights ``n / (k * count)`` per class (AGG-15)."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("cnt"))
    from pyspark.sql import Window
    w = Window.partitionBy()  # over the per-class table: k rows, bounded by the classes
    return counts.select("label", F.col("cnt").cast("bigint").alias("cnt"),
                         (F.sum("cnt").over(w) / (F.count(F.lit(1)).over(w) * F.col("cnt"))).alias("weight"))
