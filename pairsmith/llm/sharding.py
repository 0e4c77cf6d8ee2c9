"""Uniform shuffle into shards of exact sizes by a hypergeometric
communication matrix.

Rows lie in logical partitions (by a hash of the whole row).  How many rows
partition p sends to shard j is drawn exactly: the rows of p are a sample
without replacement from the places the shards still have free.  Each
partition then permutes its rows (order of a seeded hash) and deals them by
its line of the matrix; after the exchange each shard permutes again, in
buckets of its random key, so no task sorts a whole shard.

The draw depends on row contents, the shard count and the seed alone, so a
task run again after a lost executor deals the same rows.  Partitions follow
the rows (about ``PART_ROWS`` each).  The matrix is drawn in two levels: the
driver draws one for ranges of partitions, of at most ``MAX_CELLS`` numbers
whatever the input, and executors draw each range's partitions from its line
(a sample of a sample without replacement is one); the lines are written and
meet the rows by partition.

Rows equal in every column share a partition and may trade places.  Nulls are
ordinary values; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import col, free_name, kept_columns, ordered_slots, row_hash, stage

#: Ranges of partitions x shards that the driver draws, at most.
MAX_CELLS = 1 << 20
#: Rows per logical partition and per bucket of a shard.
PART_ROWS = 4096
BUCKET_ROWS = 8192


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Good ones among ``draws`` without replacement, by inversion around the
    mode; any size (numpy's own stops at 1e9)."""
    lo, hi = max(0, draws - bad), min(draws, good)
    if lo == hi:
        return lo
    total = good + bad
    mode = min(hi, max(lo, (draws + 1) * (good + 1) // (total + 2)))
    sd = (draws * (good / total) * (bad / total) * ((total - draws) / max(1, total - 1))) ** 0.5
    reach = int(14 * sd) + 20  # beyond lies less than one part in 1e40
    a, b = max(lo, mode - reach), min(hi, mode + reach)
    k = np.arange(a, b, dtype=np.float64)
    step = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1)
    logs = np.concatenate(([0.0], np.cumsum(step)))
    mass = np.cumsum(np.exp(logs - logs.max()))
    return a + int(np.searchsorted(mass, rng.random() * mass[-1], side="right").clip(0, b - a))


def communication_matrix(rows: list[int], shards: int, seed: int) -> list[list[int]]:
    """Rows each partition (of so many rows) sends to each shard; shard sizes
    are at most one apart, columns add up to them exactly."""
    n = sum(rows)
    return list(deal(rows, [n // shards + (j < n % shards) for j in range(shards)], seed))


def deal(rows: list[int], free: list[int], seed) -> Iterator[list[int]]:
    """Lines of the matrix for partitions of so many rows, drawn one after the
    other from the places that the shards have ``free`` (as many as rows)."""
    rng = np.random.default_rng(seed)
    for have in rows:
        line, left = [], have
        rest = sum(free)
        for j in range(len(free)):
            rest -= free[j]
            k = hypergeometric(rng, free[j], rest, left)
            line.append(k)
            left -= k
        free = [f - k for f, k in zip(free, line)]
        yield line


def _lines(spark, counts: DataFrame, parts: int, shards: int, seed: int, p: str, ends: str) -> DataFrame:
    """(part, ends): where each partition's rows of each shard end, from the
    rows of each partition (``counts``: part, n)."""
    ranges = max(1, min(MAX_CELLS // shards, parts))
    width = -(-parts // ranges)
    by_range = counts.groupBy(F.floor(col(p) / width).cast("int").alias("r"))
    have = {r["r"]: r["n"] for r in by_range.agg(F.sum("n").alias("n")).collect()}  # at most MAX_CELLS / shards rows
    order = sorted(have)
    matrix = communication_matrix([have[k] for k in order], shards, seed)
    schema = f"`{p}` int, `{ends}` array<bigint>"
    if width == 1:
        return F.broadcast(spark.createDataFrame([(k, np.cumsum(line).tolist()) for k, line in zip(order, matrix)], schema))
    top = stage(spark.createDataFrame(list(zip(order, matrix)), "r int, free array<bigint>"), "shard-ranges")
    tasks = by_range.agg(F.sort_array(F.collect_list(F.struct(col(p).alias("p"), "n"))).alias("ps")).join(top, "r") \
        .repartition(min(len(order), 1024), "r")

    def run(frames: Iterator) -> Iterator:
        import pandas as pd
        for frame in frames:
            for r, ps, free in zip(frame["r"], frame["ps"], frame["free"]):
                lines = deal([int(x["n"]) for x in ps], [int(f) for f in free], [seed, int(r)])
                for lo in range(0, len(ps), 256):
                    part = [(x["p"], np.cumsum(next(lines)).tolist()) for x in ps[lo:lo + 256]]
                    yield pd.DataFrame(part, columns=[p, ends])

    return stage(tasks.select("r", "ps", "free").mapInPandas(run, schema), "shard-lines")


def shuffle_into_shards(docs: DataFrame, shards: int, seed: int = 7, shard: str = "shard",
                        slot: str = "slot") -> DataFrame:
    """``docs`` with ``shard`` (int, 0 to shards - 1) and ``slot`` (long,
    gapless from 0 in each shard), both uniform over all arrangements."""
    spark = docs.sparkSession
    docs = docs.select(*[col(c) for c in kept_columns(docs, None, shard, slot)])
    h, p, ends, place = free_name(docs, "row_key", "part_no", "part_ends", "part_place")
    rows = docs.withColumn(h, F.xxhash64(F.lit(seed), row_hash(docs)))
    n = docs.count()
    parts = max(1, -(-n // PART_ROWS))
    rows = rows.withColumn(p, F.pmod(col(h), F.lit(parts)).cast("int"))
    table = _lines(spark, rows.groupBy(col(p)).agg(F.count(F.lit(1)).alias("n")), parts, shards, seed, p, ends)
    local = Window.partitionBy(col(p)).orderBy(F.xxhash64(col(h), F.lit("local")), col(h))
    dealt = rows.withColumn(place, F.row_number().over(local)).join(table, p)
    dealt = dealt.withColumn(shard, F.size(F.filter(col(ends), lambda e: e < col(place))).cast("int")) \
        .drop(p, ends, place)
    key = F.xxhash64(col(h), F.lit("shard"))
    bits = max(0, (n // shards // BUCKET_ROWS).bit_length())
    bucket = F.shiftright(key, 64 - bits) if bits else F.lit(0).cast("long")
    return ordered_slots(dealt, shard, bucket, [key, col(h)], slot).drop(h) \
        .select(*[col(c) for c in docs.columns], col(shard), col(slot))
