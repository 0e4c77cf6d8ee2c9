"""A keyed store in shared files: look up keys, add what was missing (SNK-06, J-18).

Rows lie in ``rows/batch=<id>/bucket=<hash of the key>``; a Bloom filter of
every such file group lies in ``bloom/batch=<id>`` as (bucket, word, bits) rows.
A look-up tests every wanted key where it lies against the filters of its bucket
(one array of bits per file group) and reads only the file groups that may hold one.
A batch counts from the moment its filter is there, which is written last: a job
that died half-way leaves files that nothing reads.

A null key is a key.  Filters never miss a stored key; the share of file groups
read in vain grows with the rows of one file group against ``bits``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.common import lookup

WORD_BITS = 64


class KeyedStore:
    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 64, bits: int = 1 << 16, hashes: int = 4):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.buckets, self.bits, self.hashes = buckets, bits, hashes

    def _there(self, name: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return fs.exists(p) and len(fs.listStatus(p)) > 0

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def _position(self, i: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(i), F.col(self.key)), F.lit(self.bits))

    def _positions(self) -> Column:
        """Filter positions of the key: one per hash."""
        return F.array_distinct(F.array(*[self._position(i) for i in range(1, self.hashes + 1)]))

    def _filters(self) -> DataFrame:
        """(batch, bucket, words): the filter of every file group, all its words in order."""
        bloom = self.spark.read.parquet(f"{self.path}/bloom")
        every = bloom.select("batch", "bucket").distinct().select(
            "batch", "bucket", F.explode(F.sequence(F.lit(0), F.lit((self.bits - 1) // WORD_BITS))).alias("word"), F.lit(0).cast("long").alias("bits"))
        dense = bloom.select("batch", "bucket", "word", "bits").unionByName(every).groupBy("batch", "bucket", "word").agg(F.bit_or("bits").alias("bits"))
        return lookup(dense.groupBy("batch", "bucket").agg(F.sort_array(F.collect_list(F.struct("word", "bits")))["bits"].alias("words")))

    def file_groups(self, keys: DataFrame) -> list[str]:
        """Folders that may hold one of ``keys``; their number is bounded by
        the store's batches times buckets, whatever the keys.  ``keys`` are read
        once and not shuffled where the filters can be broadcast."""
        if not self._there("bloom"):
            return []
        ats = [f"__at{i}" for i in range(1, self.hashes + 1)]
        want = keys.select(self._bucket().alias("bucket"), *[self._position(i).alias(at) for i, at in enumerate(ats, 1)])
        hit = want.join(self._filters(), "bucket")
        for at in ats:
            hit = hit.where(F.expr(f"shiftright(get(words, cast({at} div {WORD_BITS} as int)), cast({at} % {WORD_BITS} as int)) & 1") == 1)
        return [f"{self.path}/rows/batch={r['batch']}/bucket={r['bucket']}"
                for r in hit.select("batch", "bucket").distinct().orderBy("batch", "bucket").collect()]

    def batch_rows(self, batch: str, schema: str) -> DataFrame:
        """The rows of one batch, as ``add`` stored them."""
        return self.spark.read.schema(schema).parquet(f"{self.path}/rows/batch={batch}")

    def stored(self, keys: DataFrame, schema=None) -> DataFrame:
        """Stored rows of ``keys``, from the file groups that may hold them.
        Without a ``schema`` the files give it; with no file to read, the keys' one."""
        paths = self.file_groups(keys)
        if not paths:
            return self.spark.createDataFrame([], schema or keys.select(self.key).schema)
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        rows = reader.parquet(*paths)
        want = keys.select(F.col(self.key).alias("__key")).distinct()
        return rows.join(want, F.col(self.key).eqNullSafe(F.col("__key")), "left_semi")

    def missing(self, keys: DataFrame, stored: DataFrame) -> DataFrame:
        """Distinct ``keys`` without a row in ``stored``."""
        have = stored.select(F.col(self.key).alias("__key")).distinct()
        return keys.select(self.key).distinct().join(have, F.col(self.key).eqNullSafe(F.col("__key")), "left_anti")

    def add(self, rows: DataFrame) -> str:
        """Store ``rows`` as a new batch; its id.  Nothing refers to it before it is whole."""
        batch = uuid.uuid4().hex
        place = f"{self.path}/rows/batch={batch}"
        rows.withColumn("bucket", self._bucket()).repartition(F.col("bucket"), F.pmod(F.xxhash64(F.col(self.key)) / self.buckets, F.lit(4)).cast("int")) \
            .write.partitionBy("bucket").parquet(place)
        if not any(f.isDirectory() for f in self._files(place)):  # no rows
            return batch
        at = self.spark.read.parquet(place).select("bucket", F.explode(self._positions()).alias("at"))
        words = at.select("bucket", F.floor(F.col("at") / WORD_BITS).cast("int").alias("word"),
                          F.expr(f"shiftleft(1L, cast(at % {WORD_BITS} as int))").alias("bit"))
        words.groupBy("bucket", "word").agg(F.bit_or("bit").alias("bits")).coalesce(1) \
            .write.parquet(f"{self.path}/bloom/batch={batch}")
        return batch

    def _files(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(p)
