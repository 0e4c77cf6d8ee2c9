"""Seen-word swap for test sets (AGG-12, J-15, J-16, STR-04).

Test option tuples are paired one-to-one with train option tuples by
position in two seeded shuffles; test samples then get the train tuple's
words swapped in (whole word, case-blind, first changing pair wins).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import replace_words
from ..session import stage
from .split import seeded_rank

# Option fields of a trademark sample, in mapping order.
OPTION_FIELDS = ("company", "country", "country_adj", "other_country", "other_country_adj")


def distinct_options(df: DataFrame, fields: Sequence[str] = OPTION_FIELDS) -> DataFrame:
    return df.select(*fields).distinct()


def option_mapping(test: DataFrame, train: DataFrame, fields: Sequence[str] = OPTION_FIELDS,
                   seed_test: str = "test", seed_train: str = "train", check: bool = True) -> DataFrame:
    """Pair the i-th test tuple with the i-th train tuple (seeded shuffles).

    Output: the test fields plus ``new_<field>`` for each field.  With
    ``check``, raise when some test tuple has no partner (more test tuples
    than train tuples)."""
    # one key per tuple: null and empty fields are unlike
    key = F.concat_ws("\u0001", *[F.when(F.col(f).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(f)))
                                  for f in fields])
    test, train = stage(distinct_options(test, fields), "options"), stage(distinct_options(train, fields), "options")
    t = seeded_rank(test.withColumn("__key", key), "__key", seed_test, "pos")
    r = seeded_rank(train.withColumn("__key", key), "__key", seed_train, "pos")
    r = r.select("pos", *[F.col(f).alias(f"new_{f}") for f in fields])
    mapping = t.drop("__key").join(r, "pos", "left")
    if check:
        missing = mapping.where(F.col(f"new_{fields[0]}").isNull() & F.col("pos").isNotNull()).limit(1).count()
        if missing:
            raise ValueError("more test option tuples than train option tuples")
    return mapping


def swap_words(samples: DataFrame, mapping: DataFrame, fields: Sequence[str] = OPTION_FIELDS,
               n_premise: int = 2) -> DataFrame:
    """Join samples to the mapping on all option fields and swap words: the
    premise uses the first ``n_premise`` (old, new) pairs, the hypothesis the
    rest; option fields take their new values."""
    m = mapping.select(*[F.col(f).alias(f"__m_{f}") for f in fields],
                       *[F.col(f"new_{f}") for f in fields])
    j = samples.join(m, [F.col(f).eqNullSafe(F.col(f"__m_{f}")) for f in fields], "inner")
    pairs = [(F.col(f), F.col(f"new_{f}")) for f in fields]
    out = j.select(
        *[c for c in samples.columns if c not in ("premise", "hypothesis", *fields)],
        replace_words(F.col("premise"), pairs[:n_premise]).alias("premise"),
        replace_words(F.col("hypothesis"), pairs[n_premise:]).alias("hypothesis"),
        *[F.col(f"new_{f}").alias(f) for f in fields])
    return out
