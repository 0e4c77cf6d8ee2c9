"""Exact, leak-free group splits and seeded orderings.

A group split sorts the distinct groups by a seeded hash, then cuts the
sorted list at ``floor(n * p)`` (cumulative).  A global ``row_number`` over
all groups would run in a single task, so the split is found in two small
steps instead:

1. count distinct groups per hash-prefix bucket (at most 4,096 rows, a
   bounded result), which gives ``n`` and, for every cut rank, the bucket
   that holds it and the rank inside that bucket;
2. rank the groups of only those (at most two) buckets and read the hash
   key at each cut rank.

The split of a row is then a plain comparison of its hash key with the cut
keys: a narrow projection, no join back to the rows and no shuffle of them,
so a group holding a third of all rows costs nothing extra.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_HEX = 3  # 16**3 = 4,096 buckets

# Default seeds (ours) and fractions (fixed values).
SEED_3WAY = "three-way"
SEED_2WAY = "two-way"
FRACTIONS_3WAY = (("train", 0.8), ("dev", 0.1), ("test", 0.1))
FRACTIONS_2WAY = (("train", 0.75), ("test", 0.25))


def seeded_order_key(col: Column | str, seed: str) -> Column:
    """Sort key: 32 hex chars of md5(seed/value), then the value itself, so
    string order of the key is the order (hash, value). DuckDB computes the
    same string with ``md5(concat_ws('/', seed, v)) || '/' || v``."""
    v = (F.col(col) if isinstance(col, str) else col).cast("string")
    return F.concat(F.md5(F.concat_ws("/", F.lit(seed), v)), F.lit("/"), v)


def cut_ranks(n: int, fractions: Sequence[tuple[str, float]]) -> list[int]:
    """Cut positions ``int(n * (p1 + ... + pk))`` for all but the last part,
    with the same float sums a Python splitter makes."""
    cuts, acc = [], 0.0
    for _, p in fractions[:-1]:
        acc += p
        cuts.append(int(n * acc))
    return cuts


RANK_ROWS = 200_000  # a bucket at most this big is ranked in one window task


def kth_keys(df: DataFrame, key: str, ranks, distinct: bool = True) -> tuple[int, dict[int, str | None]]:
    """The key at each 0-based rank in ascending key order (None past the end).
    ``ranks`` is a list, or a function of the key count giving the list.

    Keys start with md5 hex.  Counts per 3-hex-digit prefix (at most 4,096
    rows per level, collected) locate the prefix bucket that holds each rank;
    a bucket larger than ``RANK_ROWS`` is refined by the next 3 digits, so
    the final ranking window only ever sees a small bucket — no task holds a
    fixed share of the data however large it grows."""
    col = F.col(key)
    base = df.select(col.alias("k")).where(F.col("k").isNotNull())
    if distinct:
        base = base.distinct()
    n = None
    pending = None if callable(ranks) else [(r, "", r) for r in sorted(set(ranks))]
    out: dict[int, str | None] = {}
    while pending is None or pending:
        if pending is None:  # first level: the count fixes the ranks
            pending = [("", "", 0)]
        plen = len(pending[0][1])
        prefixes = sorted({p for _, p, _ in pending})
        sub = base if plen == 0 else base.where(F.substring("k", 1, plen).isin(prefixes))
        rows = sub.groupBy(F.substring("k", 1, plen + BUCKET_HEX).alias("b")).agg(
            F.count(F.lit(1)).alias("c")).collect()
        counts = sorted((r["b"], r["c"]) for r in rows)
        if n is None:
            n = sum(c for _, c in counts)
            if pending == [("", "", 0)]:
                pending = [(r, "", r) for r in sorted(set(ranks(n)))]
        nxt, small = [], []
        for r, p, rr in pending:
            off, hit = 0, None
            for b, c in counts:
                if not b.startswith(p):
                    continue
                if rr < off + c:
                    hit = (b, rr - off, c)
                    break
                off += c
            if hit is None:
                out[r] = None
            elif hit[2] <= RANK_ROWS or plen + BUCKET_HEX >= 32:
                small.append((r, hit[0], hit[1]))
            else:
                nxt.append((r, hit[0], hit[1]))
        if small:
            bl = len(small[0][1])
            bs = sorted({b for _, b, _ in small})
            ranked = (base.where(F.substring("k", 1, bl).isin(bs))
                      .withColumn("b", F.substring("k", 1, bl))
                      .withColumn("r", F.row_number().over(Window.partitionBy("b").orderBy("k")) - 1))
            cond = F.lit(False)
            for _, b, rr in small:
                cond = cond | ((F.col("b") == b) & (F.col("r") == rr))
            got = {(row["b"], row["r"]): row["k"] for row in ranked.where(cond).collect()}
            for r, b, rr in small:
                out[r] = got[(b, rr)]
        pending = nxt
    return (n or 0), out


def _cut_keys(keyed: DataFrame, key: str, fractions) -> tuple[int, list[str | None]]:
    n, found = kth_keys(keyed, key, lambda n: [c for c in cut_ranks(n, fractions) if c < n], distinct=True)
    return n, [found.get(c) for c in cut_ranks(n, fractions)]


def exact_group_split(df: DataFrame, group: str, fractions=FRACTIONS_3WAY,
                      seed: str = SEED_3WAY, out: str = "split") -> DataFrame:
    """Add column ``out`` naming the part (``train``/``dev``/``test``…) of each
    row's group.  Parts are exact: ``int(n*p)`` groups, as in the reference.
    Rows with a null group get a null part."""
    key = "__split_key"
    keyed = df.withColumn(key, seeded_order_key(group, seed))
    _, bounds = _cut_keys(keyed, key, fractions)
    names = [name for name, _ in fractions]
    expr = None
    for name, bound in zip(names[:-1], bounds):
        cond = F.lit(True) if bound is None else (F.col(key) < F.lit(bound))
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    expr = F.lit(names[-1]) if expr is None else expr.otherwise(F.lit(names[-1]))
    return keyed.withColumn(out, F.when(F.col(key).isNotNull(), expr)).drop(key)


def seeded_rank(df: DataFrame, key: str, seed: str, out: str = "rank") -> DataFrame:
    """0-based position of each row in a seeded shuffle (SRT-04).

    Rows are bucketed by a hash prefix long enough that a bucket holds about
    ``RANK_ROWS`` rows (the prefix grows with the row count, without limit);
    per-bucket counts become offsets in two levels - within a prefix of three
    digits, then over those 4,096 - and rows are ranked inside their bucket.
    ``key`` must be unique per row."""
    import math
    k = "__rk"
    keyed = df.withColumn(k, seeded_order_key(key, seed))
    n = keyed.count()
    digits = max(BUCKET_HEX, math.ceil(math.log(max(n, 1) / RANK_ROWS, 16)) if n > RANK_ROWS else BUCKET_HEX)
    counts = keyed.groupBy(F.substring(k, 1, digits).alias("__b")).agg(F.count(F.lit(1)).alias("__c"))
    counts = counts.withColumn("__p", F.substring("__b", 1, BUCKET_HEX))
    fine = counts.withColumn("__in", F.sum("__c").over(Window.partitionBy("__p").orderBy("__b")) - F.col("__c"))
    coarse = counts.groupBy("__p").agg(F.sum("__c").alias("__t"))  # 4,096 rows at most
    coarse = coarse.select("__p", (F.sum("__t").over(Window.orderBy("__p")) - F.col("__t")).alias("__base"))
    offsets = fine.join(coarse, "__p").select("__b", (F.col("__in") + F.col("__base")).alias("__off"))
    ranked = keyed.withColumn("__b", F.substring(F.col(k), 1, digits)).join(offsets, "__b")
    ranked = ranked.withColumn(out, (F.col("__off") + F.row_number().over(Window.partitionBy("__b").orderBy(k)) - 1)
                               .cast("bigint"))
    return ranked.drop("__b", "__off", k)
