"""SimHash near-duplicates by pigeonhole blocks.

A 64-bit fingerprint is the bitwise majority of the XXH64 of a text's word
shingles.  Fingerprints within ``max_bits`` bits agree on at least
``blocks - max_bits`` of ``blocks`` bit blocks, so each distinct fingerprint is
filed under every choice of that many blocks and only fingerprints filed
together are compared.  Equal fingerprints are folded first, so a group of
copies is one row.

Inside one file (one block value) the links are not listed pair by pair: a
search from one fingerprint takes all within reach off the rest, so a dense
file of m fingerprints gives at most m - 1 links, with the same connected
classes as all its pairs.  A file of more than ``FILE_ROWS`` fingerprints is
dealt anew: cut in chunks, every pair of chunks a task group of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_groups, col, free_name, kept_columns, stage
from .components import components

SEED = 42
BITS = 64
#: Fingerprints of one file that one task compares; larger files are dealt anew.
FILE_ROWS = 4096
#: Digests turned into bit counts at once.
FLUSH = 1 << 18
#: Bytes of text split into words at once.
SLICE = 8 << 20


def word_slices(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, at most about ``SLICE`` bytes of it at a time."""
    at = 0
    while at < len(text):
        end = min(len(text), at + SLICE)
        if end < len(text):  # go back to the last blank, or on to the next for a huge word
            cut = max(text.rfind(b, at, end) for b in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            if cut <= at:
                cut = min((p for p in (text.find(b, end) for b in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
                           if p >= 0), default=len(text))
            end = cut
        yield text[at:end].split()
        at = max(end, at + 1)


def shingle_digests(text: bytes, size: int) -> Iterator[list[bytes]]:
    """Big-endian XXH64 digests of all word shingles, in runs; the whole
    sequence when it has fewer than ``size`` words, none when it has none."""
    from xxhash import xxh64_digest as digest
    tail: list[bytes] = []
    any_full = False
    for words in word_slices(text.lower()):  # bytes.lower() touches A-Z only
        words = tail + words
        if len(words) >= size:
            any_full = True
            line = b" ".join(words)
            starts = np.concatenate(([0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1))).tolist()
            yield [digest(line[a:b - 1], SEED) for a, b in zip(starts, starts[size:])]
            words = words[len(words) - size + 1:] if size > 1 else []
        tail = words
    if tail and not any_full:
        yield [digest(b" ".join(tail), SEED)]


def fingerprints(texts: list[bytes | None], size: int) -> np.ndarray:
    """One uint64 per text; no words (or null): zero."""
    ones = np.zeros((len(texts), BITS), np.int64)
    total = np.zeros(len(texts), np.int64)
    held: list[bytes] = []
    owner: list[tuple[int, int]] = []

    def flush() -> None:
        if held:
            bits = np.unpackbits(np.frombuffer(b"".join(held), np.uint8).reshape(-1, 8), axis=1)
            starts = np.cumsum([0] + [n for _, n in owner[:-1]])
            rows = [i for i, _ in owner]
            np.add.at(ones, rows, np.add.reduceat(bits, starts, axis=0, dtype=np.int32))
            np.add.at(total, rows, [n for _, n in owner])
            held.clear()
            owner.clear()

    for i, text in enumerate(texts):
        for run in shingle_digests(text or b"", size):
            held.extend(run)
            owner.append((i, len(run)))
            if len(held) >= FLUSH:
                flush()
    flush()
    return np.packbits(ones * 2 > total[:, None], axis=1).view(">u8")[:, 0].astype(np.uint64)


def with_fingerprint(docs: DataFrame, text: str, size: int, out: str) -> DataFrame:
    """``docs`` with a signed long fingerprint of the whole ``text``; a narrow map."""
    held = free_name(docs, "text_for_print")[0]
    wide = docs.withColumn(held, F.encode(col(text).cast("string"), "UTF-8"))
    schema = docs.withColumn(out, F.lit(0).cast("long")).schema
    at = len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in byte_groups(batch, at):
                part = batch.slice(lo, hi - lo)
                prints = fingerprints(part.column(at).to_pylist(), size).view(np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns[:at], pa.array(prints)], [f.name for f in schema])

    return wide.mapInArrow(run, schema)


def block_masks(blocks: int, max_bits: int) -> list[int]:
    """Masks (as signed longs) of every choice of ``blocks - max_bits`` blocks."""
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    single = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    masks = [sum(c) for c in combinations(single, blocks - max_bits)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def forest(prints: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links that join the same classes as all pairs within ``max_bits``:
    breadth first, each newly reached print taking its reach off the rest."""
    links: list[tuple[int, int]] = []
    rest = prints
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count((rest ^ x).view(np.uint64)) <= max_bits  # of the bits, not of the absolute value
            if near.any():
                found = rest[near]
                links.extend((int(x), int(y)) for y in found)
                queue.extend(found)
                rest = rest[~near]
    return links


def _file_runs(batches: Iterator[pa.RecordBatch], keys: int, file_rows: int) -> Iterator[tuple[tuple, np.ndarray, bool]]:
    """Runs of rows with equal leading ``keys`` columns in sorted batches:
    (key, prints, whole).  A run longer than ``file_rows`` comes in pieces,
    ``whole`` False."""
    key, held, size, cut = None, [], 0, False
    for batch in batches:
        if not batch.num_rows:
            continue
        ks = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        prints = batch.column(keys).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.zeros(len(prints), bool)
        new[0] = True
        for k in ks:
            new[1:] |= k[1:] != k[:-1]
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(prints))
        single = ends - starts == 1
        # runs of one row inside a batch link to nothing; those at its ends may go on
        inner = np.flatnonzero(~single | (np.arange(len(starts)) == 0) | (np.arange(len(starts)) == len(starts) - 1))
        for r in inner:
            a, b = starts[r], ends[r]
            k = tuple(int(x[a]) for x in ks)
            if k != key:
                if size or cut:
                    yield key, np.concatenate(held) if held else np.empty(0, np.int64), not cut
                key, held, size, cut = k, [], 0, False
            for lo in range(a, b, file_rows):
                piece = prints[lo:min(b, lo + file_rows)]
                if size + len(piece) > file_rows:
                    yield key, np.concatenate(held), False
                    held, size, cut = [], 0, True
                held.append(piece)
                size += len(piece)
    if size or cut:
        yield key, np.concatenate(held) if held else np.empty(0, np.int64), not cut


def links(prints: DataFrame, max_bits: int, blocks: int, file_rows: int = FILE_ROWS) -> DataFrame:
    """``prints`` (fp long, distinct) -> links (a, b), staged in the shared folder."""
    masks = block_masks(blocks, max_bits)
    filed = prints.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks]))
                          .alias("choice", "block"))
    filed = filed.select("choice", "block", "fp").repartition("choice", "block") \
        .sortWithinPartitions("choice", "block", "fp")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links of the files that fit; the rows of others with a chunk number."""
        names = ["a", "b", "choice", "block", "chunk"]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32()]
        rows: list[tuple] = []
        last, chunk = None, 0
        for key, fps, whole in _file_runs(batches, 2, file_rows):
            if whole:
                rows.extend((x, y, None, None, None) for x, y in forest(fps, max_bits))
            else:
                chunk = chunk + 1 if key == last else 0
                last = key
                rows.extend((int(x), None, *key, chunk) for x in fps)
            if len(rows) >= 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    out = stage(filed.mapInArrow(compare, "a long, b long, choice int, block long, chunk int"), "simhash-links")
    large = out.where("b is null").select("choice", "block", "chunk", F.col("a").alias("fp"))
    chunks = large.groupBy("choice", "block").agg(F.max("chunk").alias("last"))
    dealt = large.join(chunks, ["choice", "block"]).select(
        "choice", "block", "chunk", "fp", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("other"))
    dealt = dealt.select("choice", "block", F.least("chunk", "other").alias("lo"),
                         F.greatest("chunk", "other").alias("hi"), "fp") \
        .repartition("choice", "block", "lo", "hi").sortWithinPartitions("choice", "block", "lo", "hi", "fp")

    def compare_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Two chunks hold at most 2 x ``file_rows`` prints: read together."""
        held, last = [], None
        for key, fps, _ in _file_runs(batches, 4, file_rows):
            if key != last and held:
                yield _pairs(forest(np.concatenate(held), max_bits))
                held = []
            last = key
            held.append(fps)
        if held:
            yield _pairs(forest(np.concatenate(held), max_bits))

    found = dealt.mapInArrow(compare_chunks, "a long, b long")
    return out.where("b is not null").select("a", "b").unionAll(found)


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*found) if found else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _classes(rows: DataFrame, order: str, fp: str, rid: str, max_bits: int, blocks: int) -> tuple[DataFrame, DataFrame]:
    """(fp, root) of the fingerprints, (root, class_first) with the first row of each class."""
    slim = rows.select(col(fp).alias("fp"), col(order).alias("ord"), col(rid).alias("rid"))
    firsts = stage(slim.groupBy("fp").agg(F.min(F.struct(F.col("ord").isNull().alias("no"), "ord", "rid"))
                                          .alias("first")), "simhash-prints")
    roots = components(links(firsts.select("fp"), max_bits, blocks))
    member = firsts.join(roots, firsts["fp"] == roots["node"], "left") \
        .select("fp", "first", F.coalesce("root", "fp").alias("root"))
    return member.select("fp", "root"), member.groupBy("root").agg(F.min("first").alias("class_first"))


def simhash_classes(docs: DataFrame, text: str = "text", order: str = "doc_id", keep: list[str] | None = None,
                    size: int = 4, max_bits: int = 4, blocks: int = 7) -> DataFrame:
    """``keep`` columns of ``docs`` (all by default) with

    * ``fingerprint``: 16 lowercase hex digits; null and wordless texts: zeros;
    * ``component_id``: least ``order`` value among all rows reachable over
      links of at most ``max_bits`` differing bits (nulls only if all are null);
    * ``is_first``: true for exactly one row of each class - the least
      ``order`` (nulls last), then any one of its repeats.

    One row out per row in, repeated rows included."""
    keep = kept_columns(docs, keep, "fingerprint", "component_id", "is_first", "n_fp", "class_first")
    fp, rid = free_name(docs, "fp_long", "row_no")
    fields = list(dict.fromkeys([*keep, order]))
    printed = with_fingerprint(docs.select(*[col(c) for c in dict.fromkeys([*fields, text])]), text, size, fp)
    rows = stage(printed.select(*[col(c) for c in fields], col(fp), F.monotonically_increasing_id().alias(rid)),
                 "simhash-rows")
    member, classes = _classes(rows, order, fp, rid, max_bits, blocks)
    named = member.join(classes, "root").select(F.col("fp").alias("n_fp"), "class_first")
    out = rows.join(named, col(fp) == F.col("n_fp"))
    return out.select(*[col(c) for c in keep], F.lower(F.lpad(F.hex(col(fp)), 16, "0")).alias("fingerprint"),
                      F.col("class_first.ord").alias("component_id"),
                      (F.col("class_first.rid") == col(rid)).alias("is_first"))


def near_dedup(docs: DataFrame, text: str = "text", order: str = "doc_id", size: int = 4, max_bits: int = 4,
               blocks: int = 7) -> DataFrame:
    """The rows of ``docs`` that come first in their class, columns unchanged.

    Texts meet the classes by row number: a class with any share of the rows
    is no key of a shuffle of them."""
    names = docs.columns
    safe = docs.toDF(*[f"c{i}" for i in range(len(names))])
    text, order = (f"c{names.index(c)}" for c in (text, order))
    rows = stage(with_fingerprint(safe, text, size, "fp_long").withColumn("row_no", F.monotonically_increasing_id()), "simhash-rows")
    _, classes = _classes(rows, order, "fp_long", "row_no", max_bits, blocks)
    first = classes.select(F.col("class_first.rid").alias("row_no"))
    return rows.join(first, "row_no", "left_semi").select(*safe.columns).toDF(*names)
