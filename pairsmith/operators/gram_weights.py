"""TF-IDF weights of every n-gram with no term on the disk (ML-01).

Documents are dealt out once, by id, as token texts in parts of bounded size.  Each
part sends the hashes of its distinct n-grams, with the number of its documents that
hold each, to buckets of hashes; a bucket adds the numbers up and answers each part in
the order of its question; the part then weighs its own n-grams.  What travels is the
texts and, for each distinct n-gram of a part, some seven bytes; hashes are sorted and sent as
differences, byte by byte, so that the shuffle's compression takes out their zeros.

An n-gram is its 64-bit hash: among a thousand million distinct ones two share a hash
with a chance of about 3 in 100.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of token texts in a part.
PART_BYTES = 4 << 20
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _mix(h: np.ndarray) -> np.ndarray:
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(by)
    return h ^ (h >> np.uint64(31))


def _planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _whole(b: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


class _Part:
    """A part's cells, one for each document and distinct n-gram of it, by document:
    ``doc``, ``tf``, place ``at`` of the words and length ``size``; ``hashes`` distinct and
    sorted, ``df`` documents hold each, ``of`` is the cell's place there."""

    def __init__(self, docs: np.ndarray, texts: pa.Array, ngrams: int):
        some = pc.not_equal(texts, "").to_numpy(zero_copy_only=False)
        split = pc.split_pattern(texts.filter(pa.array(some)), " ")
        flat = split.flatten().dictionary_encode()
        self.ids, self.words = flat.indices.to_numpy(), flat.dictionary
        of_word = np.array([int.from_bytes(blake2b(w.encode(), digest_size=8).digest(), "little") for w in self.words.to_pylist()], np.uint64)
        doc = np.repeat(docs[some].astype(np.int32), split.value_lengths().to_numpy())
        text = np.repeat(np.arange(len(split), dtype=np.int32), split.value_lengths().to_numpy())
        parts, h = [], _mix(of_word)[self.ids]
        one = h
        for k in range(1, ngrams + 1):
            if k > 1:
                h = _mix(h[:-1] * _ODD[0] + one[k - 1:] * _ODD[1] + _ODD[2])
            at = np.flatnonzero(text[:len(h)] == text[k - 1:]).astype(np.int32)
            parts.append((doc[at], h[at], at, np.full(len(at), k, np.int8)))
        doc, h, at, size = (np.concatenate(x) for x in zip(*parts))
        self.hashes, of = np.unique(h, return_inverse=True)
        cell = doc.astype(np.int64) * max(len(self.hashes), 1) + of
        order = np.argsort(cell, kind="stable")
        cell = cell[order]
        first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else np.empty(0, np.int64)
        self.tf, order = np.diff(np.append(first, len(cell))), order[first]
        self.doc, self.at, self.size, self.of = doc[order], at[order], size[order], of[order]
        self.df = np.bincount(self.of, minlength=len(self.hashes))

    def terms(self, some: slice) -> pa.Array:
        at, size = self.at[some], self.size[some]
        out = self.words.take(pa.array(self.ids[at]))
        for k in range(1, int(size.max(initial=1))):
            more = self.words.take(pa.array(self.ids[np.minimum(at + k, len(self.ids) - 1)]))
            out = pc.if_else(pa.array(size > k), pc.binary_join_element_wise(out, more, " "), out)
        return out


def _documents(table: pa.Table) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Number of each row's document, the documents' ids (a null one too), the texts."""
    ids = table["row"].combine_chunks().dictionary_encode("encode")
    return ids.indices.to_numpy(), ids.dictionary, table["text"].combine_chunks()


def weights(docs: DataFrame, row: str, tokens: Column, n_rows: int, ngrams: int = 3) -> DataFrame:
    """(row, term, weight) of all 1..``ngrams``-grams of the token texts ``tokens``: rows of equal
    ``row`` are one document; those without one count as a document, but have no weights."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(tokens))).first()[0] or 0
    count = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // PART_BYTES + 1)
    buckets = np.array([(b << 64) // count for b in range(1, count)], np.uint64)
    texts = docs.select(F.pmod(F.xxhash64(row), F.lit(count)).cast("int").alias("part"), F.col(row).alias("row"), tokens.alias("text")) \
        .repartition(count, "part")
    kind = texts.schema["row"].dataType.simpleString()

    def ask(table: pa.Table) -> pa.Table:
        doc, _, text = _documents(table)
        p = _Part(doc, text, ngrams)
        cuts = np.concatenate([[0], np.searchsorted(p.hashes, buckets), [len(p.hashes)]])
        some = np.flatnonzero(np.diff(cuts))
        sent = [(_planes(np.diff(p.hashes[cuts[b]:cuts[b + 1]], prepend=np.uint64(0))), _planes(p.df[cuts[b]:cuts[b + 1]].astype(np.uint32)))
                for b in some]
        part = table["part"][0].as_py()
        return pa.table({"bucket": pa.array(some, pa.int32()), "part": pa.array([part] * len(some), pa.int32()),
                         "h": pa.array([h for h, _ in sent], pa.binary()), "df": pa.array([n for _, n in sent], pa.binary())})

    def answer(table: pa.Table) -> pa.Table:
        hashes = [np.cumsum(_whole(h, np.uint64), dtype=np.uint64) for h in table["h"].to_pylist()]
        distinct, of = np.unique(np.concatenate(hashes), return_inverse=True)
        df = np.bincount(of, np.concatenate([_whole(n, np.uint32) for n in table["df"].to_pylist()]), len(distinct)).astype(np.uint32)[of]
        ends = np.cumsum([len(h) for h in hashes])
        return pa.table({"part": table["part"], "bucket": table["bucket"],
                         "df": pa.array([_planes(x) for x in np.split(df, ends[:-1])], pa.binary())})

    def weigh(table: pa.Table, answers: pa.Table) -> pa.Table:
        doc, ids, text = _documents(table)
        p = _Part(doc, text, ngrams)
        told = answers.sort_by("bucket")["df"].to_pylist()
        df = np.concatenate([_whole(x, np.uint32) for x in told] or [np.empty(0, np.uint32)])
        w = p.tf * (np.log((1.0 + n_rows) / (1.0 + df)) + 1)[p.of]
        norm = np.sqrt(np.bincount(p.doc, w * w, len(ids)))
        out = pa.table({"row": ids.take(pa.array(p.doc)), "term": p.terms(slice(None)), "weight": pa.array(w / norm[p.doc])})
        return out.filter(pc.is_valid(out["row"]))

    asked = texts.groupBy("part").applyInArrow(ask, "bucket int, part int, h binary, df binary")
    told = asked.repartition(count, "bucket").groupBy("bucket").applyInArrow(answer, "part int, bucket int, df binary")
    return texts.groupBy("part").cogroup(told.repartition(count, "part").groupBy("part")) \
        .applyInArrow(weigh, f"row {kind}, term string, weight double")
