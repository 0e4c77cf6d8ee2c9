"""Sparse TF-IDF features without a vocabulary on the driver (AGG-14, ML-01).

Terms are cut to the most frequent ones exactly - a histogram of frequencies
finds the least one kept, equal ones are ordered by a hash - and numbered by
offsets of hash buckets.  Weights are rows (row, column, idx, weight) worked out by
equi-joins on the term; a row's vector is gathered from its own entries only.

The classifier's rows have short texts and a chosen vocabulary: ``term_totals`` adds
terms up in each task and ``row_entries`` works a text's entries out where it lies
(once for all rows of an Arrow batch that hold it), so no term travels per row.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let, tokens2
from ..session import scratch_path, stage
from .common import rank_in_group
from .split import kth_keys

#: Terms that a task adds up before it hands their sums on.
TERMS = 1 << 18


def grams(text: Column, ngrams: int) -> Column:
    """Array of the 1..``ngrams``-grams of a text's tokens of two or more word characters."""
    def of(t):
        parts = [F.transform(F.when(F.size(t) >= k, F.sequence(F.lit(1), F.size(t) - (k - 1))).otherwise(F.array().cast("array<int>")),
                             _gram(t, k)) for k in range(1, ngrams + 1)]
        return F.flatten(F.array(*parts))
    return F.element_at(F.transform(F.array(tokens2(F.coalesce(text, F.lit("")))), of), 1)


def _gram(t: Column, size: int):
    return lambda i: F.array_join(F.slice(t, i, size), " ")


def _tally(terms: Column) -> Column:
    """Array of (term, tf): the distinct values of an array and how often they stand there."""
    def runs(s):
        first = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return let(first, lambda at: F.zip_with(at, F.concat(F.slice(at, 2, 1 << 30), F.array(F.size(s))), lambda a, b: F.struct(
            F.get(s, a).alias("term"), (b - a).cast("bigint").alias("tf"))))
    none = F.array().cast("array<struct<term:string,tf:bigint>>")
    return let(F.sort_array(terms), lambda s: F.when(F.size(s) > 0, runs(s)).otherwise(none))


def term_counts(rows: DataFrame, row: str, cols: Sequence[str], ngrams: int = 3) -> DataFrame:
    """(row, col, term, tf): one row per distinct term of a row's text column.
    ``row`` is unique; a null text has no terms.  Rows dealt out by ``row``
    before are counted where they lie, with no shuffle of terms."""
    each = rows.select(F.col(row).alias("row"), F.explode(F.array(*[F.struct(
        F.lit(c).alias("col"), grams(F.col(c), ngrams).alias("g")) for c in cols])).alias("x"))
    return each.select("row", "x.col", F.explode("x.g").alias("term")).groupBy("row", "col", "term") \
        .agg(F.count(F.lit(1)).alias("tf"))


def text_terms(rows: DataFrame, row: str, text: str, ngrams: int = 3) -> DataFrame:
    """(row, col, term, tf) of one text column, counted inside each text:
    nothing is shuffled, and texts of a repeated ``row`` are counted apart."""
    each = rows.select(F.col(row).alias("row"), F.lit(text).alias("col"), F.explode(_tally(grams(F.col(text), ngrams))).alias("x"))
    return each.select("row", "col", "x.term", "x.tf")


def order_key(term: Column) -> Column:
    """Order of equally frequent terms: by hash, then by the term."""
    return F.concat(F.md5(term), F.lit("/"), term)


def most_frequent(terms: DataFrame, size: int, group: str = "col", by: str = "tf") -> DataFrame:
    """The ``size`` rows of (group, term, ``by``) with the highest ``by`` in
    each group, ties by ``order_key``: exact, with no global sort.

    A histogram of ``by`` gives the least value kept; only where that value
    has more rows than are left does a key cut among them."""
    up = Window.partitionBy(group).orderBy(F.desc(by))
    hist = terms.groupBy(group, by).agg(F.count(F.lit(1)).alias("n")).withColumn("upto", F.sum("n").over(up))
    edge = hist.where(F.col("upto") >= size).groupBy(group).agg(
        F.min_by(F.struct(F.col(by).alias("least"), (F.lit(size) - F.col("upto") + F.col("n")).alias("left"), "n"), "upto").alias("e")) \
        .select(group, "e.*").collect()  # one row per group that is cut
    keep = F.lit(True)
    for e in edge:
        mine = F.col(group).eqNullSafe(F.lit(e[group]))
        last = F.col(by) == e["least"]
        if e["left"] < e["n"]:
            tied = terms.where(mine & last).select(order_key(F.col("term")).alias("k"))
            _, found = kth_keys(tied, "k", [e["left"]])
            last = last & (order_key(F.col("term")) < F.lit(found[e["left"]]))
        keep = F.when(mine, (F.col(by) > e["least"]) | last).otherwise(keep)
    return terms.where(keep)


def vocabulary(counts: DataFrame, n_rows: int, size: int) -> DataFrame:
    """(col, term, tf, df, idf, idx): the ``size`` most frequent terms of each
    column, numbered 0, 1, ... in hash order over all columns."""
    return chosen(counts.groupBy("col", "term").agg(
        F.sum("tf").cast("bigint").alias("tf"), F.count(F.lit(1)).cast("bigint").alias("df")), n_rows, size)


def chosen(totals: DataFrame, n_rows: int, size: int) -> DataFrame:
    """``vocabulary`` of the terms' totals (col, term, tf, df)."""
    terms = most_frequent(stage(totals, "terms"), size)
    terms = terms.withColumn("idf", F.log((F.lit(1.0) + n_rows) / (F.lit(1.0) + F.col("df"))) + 1)
    numbered = rank_in_group(terms.withColumn("all", F.lit(1)), "all", F.md5(F.concat_ws("\t", "col", "term")), "idx", "n_all")
    return stage(numbered.select("col", "term", "tf", "df", "idf", F.col("idx").cast("int").alias("idx")), "vocabulary")


def token_text(text: Column) -> Column:
    """A text's tokens of two or more word characters, a space between (none: empty):
    texts with equal tokens have equal terms."""
    return F.array_join(tokens2(F.coalesce(text, F.lit(""))), " ")


def _counted(text: str, ngrams: int) -> Counter:
    """1..``ngrams``-grams of a token text, as ``grams`` makes them."""
    t = text.split(" ") if text else []
    return Counter(" ".join(t[i:i + k]) for k in range(1, ngrams + 1) for i in range(len(t) - k + 1))


def term_totals(rows: DataFrame, cols: Sequence[str], times: str, ngrams: int = 3) -> DataFrame:
    """(col, term, tf, df) over rows of token texts that each stand for ``times``
    equal rows: added up in each task, then by term."""
    cols = list(cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[dict[str, list[int]]] = [{} for _ in cols]

        def sums():
            cells = [(c, term, *x) for c, own in zip(cols, found) for term, x in own.items()]
            for own in found:
                own.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*cells), (pa.string(), pa.string(), pa.int64(), pa.int64()))],
                                              ["col", "term", "tf", "df"])
        for batch in batches:
            n = batch.column(len(cols)).to_numpy()
            for j, own in enumerate(found):
                texts = batch.column(j).dictionary_encode()
                held = np.zeros(len(texts.dictionary), np.int64)
                np.add.at(held, texts.indices.to_numpy(), n)
                for text, many in zip(texts.dictionary.to_pylist(), held.tolist()):
                    for term, tf in _counted(text, ngrams).items():
                        x = own.get(term)
                        if x is None:
                            own[term] = [tf * many, many]
                        else:
                            x[0] += tf * many
                            x[1] += many
            if sum(map(len, found)) > TERMS:
                yield sums()
        if any(found):
            yield sums()
    parts = rows.select(*cols, F.col(times).cast("bigint")).mapInArrow(run, "col string, term string, tf bigint, df bigint")
    return parts.groupBy("col", "term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def _of_texts(texts: list[str], terms: pa.Array, idx: np.ndarray, idf: np.ndarray, ngrams: int):
    """(number of entries, idx, weight) of token texts, text after text, each scaled to length 1."""
    counts = [_counted(t, ngrams) for t in texts]
    at = np.repeat(np.arange(len(texts)), [len(c) for c in counts])
    places = pc.index_in(pa.array([t for c in counts for t in c], terms.type), value_set=terms).fill_null(-1).to_numpy(zero_copy_only=False)
    tf = np.array([x for c in counts for x in c.values()], float)
    known = places >= 0
    at, places = at[known], places[known]
    w = tf[known] * idf[places]
    norm = np.sqrt(np.bincount(at, w * w, len(texts)))
    return np.bincount(at, minlength=len(texts)), idx[places], w / norm[at]


def row_entries(rows: DataFrame, keys: Sequence[str], cols: Sequence[str], vocab: DataFrame, ngrams: int = 3) -> DataFrame:
    """``keys``, ``idx`` array<int> and ``value`` array<double> of rows of token
    texts: counts times IDF of the vocabulary's terms, each column's part
    scaled to length 1, column after column.  Every task holds the vocabulary."""
    found = vocab.select("col", "term", "idx", "idf").toArrow()
    own = [found.filter(pc.equal(found["col"], c)) for c in cols]
    sent = rows.sparkSession.sparkContext.broadcast([
        (_ipc(t.select(["term"])), t["idx"].to_numpy().astype(np.int32), t["idf"].to_numpy()) for t in own])
    keys, cols = list(keys), list(cols)
    slim = rows.select(*keys, *cols)
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:len(keys)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [(pa.ipc.open_stream(t).read_all()["term"].combine_chunks(), idx, idf) for t, idx, idf in sent.value]
        for batch in batches:
            parts, size = [], np.zeros(batch.num_rows, np.int64)
            for j, (terms, numbers, idf) in enumerate(known):
                texts = batch.column(len(keys) + j).dictionary_encode()
                n, i, v = _of_texts(texts.dictionary.to_pylist(), terms, numbers, idf, ngrams)
                code = texts.indices.to_numpy()
                parts.append((size.copy(), n[code], (np.cumsum(n) - n)[code], i, v))
                size += n[code]
            ptr = np.append(0, np.cumsum(size))
            idx, value = np.empty(ptr[-1], np.int32), np.empty(ptr[-1])
            for before, n, start, i, v in parts:
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                to, at = np.repeat(ptr[:-1] + before, n) + step, np.repeat(start, n) + step
                idx[to], value[to] = i[at], v[at]
            lists = [pa.ListArray.from_arrays(pa.array(ptr, pa.int32()), pa.array(x)) for x in (idx, value)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keys)], *lists], [*keys, "idx", "value"])
    return slim.mapInArrow(run, out + ", idx array<int>, value array<double>")


def _ipc(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as to:
        to.write_table(table)
    return sink.getvalue().to_pybytes()


def tfidf_rows(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """(row, col, term, idx, weight): counts times IDF of the vocabulary's
    terms, each column's part of a row scaled to length 1."""
    raw = counts.join(vocab.select("col", "term", "idx", "idf"), ["col", "term"])
    return _scaled(raw).select("row", "col", "term", "idx", "weight")


def tfidf_all(counts: DataFrame, n_rows: int) -> DataFrame:
    """(row, col, term, weight) with no cut and no numbers: every term of
    ``counts``, whose ``row`` may repeat (its counts are added up).

    Counts are dealt out by term, where equal rows are merged and a term's rows
    are counted, and by row, where the weights are scaled."""
    merged = counts.repartition("col", "term").groupBy("row", "col", "term").agg(F.sum("tf").alias("tf"))
    df = F.count(F.lit(1)).over(Window.partitionBy("col", "term"))
    raw = merged.withColumn("idf", F.log((F.lit(1.0) + n_rows) / (F.lit(1.0) + df)) + 1)
    return _scaled(raw.select("row", "col", "term", "tf", "idf").repartition("row")).select("row", "col", "term", "weight")


def _scaled(raw: DataFrame) -> DataFrame:
    """``raw`` (row, col, tf, idf, ...) with ``weight``: each column's part of a
    row scaled to length 1.  Rows that lie together by ``row`` stay there."""
    w = raw.where(F.col("row").isNotNull()).withColumn("w", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("row", "col")))
    return w.withColumn("weight", F.col("w") / norm).drop("w")


def entries(rows: DataFrame, row: str, weights: DataFrame) -> DataFrame:
    """``rows`` with the entries of their vectors, in order: ``idx`` array<int> and
    ``value`` array<double> (empty without any)."""
    cells = weights.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("idx", "weight"))).alias("x"))
    none = F.array()
    return rows.join(cells.withColumnRenamed("row", "__row"), F.col(row) == F.col("__row"), "left").select(
        *rows.columns, F.coalesce(F.col("x.idx"), none.cast("array<int>")).alias("idx"),
        F.coalesce(F.col("x.weight"), none.cast("array<double>")).alias("value"))


def vectors(rows: DataFrame, row: str, weights: DataFrame, size: int) -> DataFrame:
    """``rows`` with ``features``: the sparse vector of each row's weights (zero
    without any), written and read back in the vector type's stored form."""
    from pyspark.ml.linalg import VectorUDT
    from pyspark.sql.types import StructField, StructType
    stored = F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(size).cast("int").alias("size"),
                      F.col("idx").alias("indices"), F.col("value").alias("values"))
    out = entries(rows, row, weights).select(*rows.columns, stored.alias("features"))
    path = scratch_path(rows.sparkSession, "vectors")
    out.write.parquet(path)
    schema = StructType([*rows.schema.fields, StructField("features", VectorUDT())])
    return rows.sparkSession.read.schema(schema).parquet(path)
