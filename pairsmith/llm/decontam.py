"""Benchmark decontamination with an FM-index per training shard.

A shard is up to ``SHARD_BYTES`` of whole texts.  Its words become symbols of
the test phrases' vocabulary, any other word a separator; runs too short for a
phrase window are left out, which loses no occurrence.  Backward search over
the wavelet ranks finds every window of every test item, sampled suffix
positions place the occurrences, and per document they merge to removal spans.

Test items are read in blocks of ``BLOCK_BYTES``; every block meets all
documents in a pass of its own, so neither driver nor worker holds more than a
block.  Words are 64-bit hashes of their bytes (random multipliers).

Nulls and wordless texts have no words and no hits; wordless items have no
windows.  Repeated items count once by id; an item without id can hit but is
not listed.  Repeated documents are judged each on its own.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_groups, col, free_name, kept_columns, stage
from .fm_index import FMIndex

WINDOW = 10
SHARD_BYTES = 32 << 20
BLOCK_BYTES = 4 << 20
#: Occurrences placed at once.
PLACES = 1 << 20
#: Bytes of text made into words at once.
SLICE = 1 << 20

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_rng = np.random.default_rng(20)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[ord("A"):ord("Z") + 1] = _BYTE[ord("a"):ord("z") + 1]  # A-Z are lower-cased
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_POWERS = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(4095, 0x9E3779B97F4A7C13, np.uint64))))


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and the number of words per text."""
    hashes, counts = [], np.zeros(len(texts), np.int64)
    held: list[bytes] = []
    owner: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if not held:
            return
        raw = np.frombuffer(b"\0".join(held) + b"\0", np.uint8)
        inside = _IS_WORD[raw]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[0]:
            edge = np.concatenate(([0], edge))
        starts, ends = edge[::2], edge[1::2]
        if len(starts):
            at = np.flatnonzero(inside)
            lengths = ends - starts
            firsts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
            place = np.arange(len(at)) - np.repeat(firsts, lengths)
            if len(_POWERS) <= int(lengths.max()):
                power = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(
                    int(lengths.max()), 0x9E3779B97F4A7C13, np.uint64))))
            else:
                power = _POWERS
            hashes.append(np.add.reduceat(_BYTE[raw[at]] * power[place], firsts))
            text_ends = np.cumsum([len(h) + 1 for h in held])
            np.add.at(counts, np.asarray(owner)[np.searchsorted(text_ends, starts, side="right")], 1)
        held.clear()
        owner.clear()
        size = 0

    for i, text in enumerate(texts):
        text = text or b""
        at = 0
        while at < len(text):
            end = min(len(text), at + SLICE)
            while end < len(text) and _IS_WORD[text[end]]:  # never through a word
                end += 1
            held.append(text[at:end])
            owner.append(i)
            size += end - at
            at = end
            if size >= SLICE:
                flush()
    flush()
    return (np.concatenate(hashes) if hashes else np.empty(0, np.uint64)), counts


class Phrases:
    """Windows of a block of test items over their own vocabulary."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int = WINDOW):
        hashes, counts = word_hashes([t for _, t in items])
        self.vocabulary = np.unique(hashes)
        symbols = np.searchsorted(self.vocabulary, hashes) + 1
        of: dict[bytes, set[str]] = defaultdict(set)
        starts = np.concatenate(([0], np.cumsum(counts)))
        for i, (item, _) in enumerate(items):
            words = symbols[starts[i]:starts[i + 1]].astype(np.int64)
            size = min(window, len(words))
            for k in range(len(words) - size + 1 if size else 0):
                of[words[k:k + size].tobytes()].update([item] if item is not None else [])
        self.items = [sorted(v) for v in of.values()]
        self.lengths = np.array([len(k) // 8 for k in of], np.int64)
        self.windows = np.zeros((len(of), window), np.int64)
        for i, k in enumerate(of):
            w = np.frombuffer(k, np.int64)
            self.windows[i, window - len(w):] = w
        self.shortest = int(self.lengths.min(initial=window))

    def find(self, texts: list[bytes | None]) -> tuple[np.ndarray, dict[int, list[tuple[int, int]]], dict[int, set[str]]]:
        """Per text: number of words; where hit, merged word spans and items."""
        hashes, counts = word_hashes(texts)
        spans: dict[int, list[tuple[int, int]]] = defaultdict(list)
        items: dict[int, set[str]] = defaultdict(set)
        if not len(hashes) or not len(self.windows):
            return counts, spans, items
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        symbol = np.where(self.vocabulary[at] == hashes, at + 1, 0)
        # runs of vocabulary words inside one text, long enough for a window
        text_of = np.repeat(np.arange(len(texts)), counts)
        live = symbol > 0
        same = np.concatenate(([False], live[1:] & live[:-1] & (text_of[1:] == text_of[:-1])))
        begin = np.flatnonzero(live & ~same)
        stop = np.flatnonzero(live & ~np.concatenate((same[1:], [False]))) + 1
        fits = stop - begin >= self.shortest
        begin, stop = begin[fits], stop[fits]
        if not len(begin):
            return counts, spans, items
        size = stop - begin + 1  # and a separator after each run
        base = np.concatenate(([0], np.cumsum(size)))
        source = np.arange(base[-1]) - np.repeat(base[:-1] - begin, size)
        seq = symbol[np.minimum(source, len(symbol) - 1)]
        seq[base[1:] - 1] = 0
        index = FMIndex(seq.astype(np.int64))
        lo, hi = index.search(self.windows, self.lengths)
        text_start = np.concatenate(([0], np.cumsum(counts)))
        hit = np.flatnonzero(hi > lo)
        many = np.cumsum(hi[hit] - lo[hit])
        done = 0
        while done < len(hit):  # windows in groups of a bounded number of occurrences, one window at least
            upto = max(done + 1, int(np.searchsorted(many, (many[done - 1] if done else 0) + PLACES, side="right")))
            group = hit[done:upto]
            n = hi[group] - lo[group]
            which = np.repeat(group, n)
            rows = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[group], n)
            word = source[index.locate(rows)]
            text = text_of[word]
            start = word - text_start[text]
            for t, s, w in zip(text.tolist(), start.tolist(), which.tolist()):
                spans[t].append((s, s + int(self.lengths[w])))
                items[t].update(self.items[w])
            for t in set(text.tolist()):
                spans[t] = merge(spans[t])
            done = upto
        return counts, spans, items


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open spans; touching ones join."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``text`` without the bytes from each span's first word to its last."""
    places = [m.span() for m in _WORD.finditer(text.lower())]
    kept, at = [], 0
    for a, b in spans:
        kept.append(text[at:places[a][0]])
        at = places[b - 1][1]
    return b"".join([*kept, text[at:]])


def phrase_blocks(benchmark: DataFrame, item: str, text: str, window: int) -> Iterator[Phrases]:
    """Test items in blocks of bounded bytes, streamed through the driver.  A
    longer item is cut in pieces that overlap by a window less one word."""
    rows = benchmark.select(col(item).cast("string"), F.encode(col(text).cast("string"), "UTF-8")).toLocalIterator()
    held, size = [], 0
    for name, body in rows:
        body = bytes(body or b"")
        places = None
        if len(body) > BLOCK_BYTES:
            places = [m.span() for m in _WORD.finditer(body.lower())]
        pieces = [body] if not places or len(places) <= window else []
        if not pieces:
            step = max(window, len(places) * BLOCK_BYTES // len(body))
            pieces = [body[places[a][0]:places[min(len(places), a + step + window - 1) - 1][1]]
                      for a in range(0, max(1, len(places) - window + 1), step)]
        for piece in pieces:
            if held and size + len(piece) > BLOCK_BYTES:
                yield Phrases(held, window)
                held, size = [], 0
            held.append((name, piece))
            size += len(piece)
    if held:
        yield Phrases(held, window)


def _passes(rows: DataFrame, blocks: Iterator[Phrases], one_pass) -> tuple[int, DataFrame]:
    """(number of blocks, ``one_pass(rows, phrases)`` for each of them); a
    written table in between."""
    n = 0
    for phrases in blocks:
        rows = one_pass(stage(rows, "decontam") if n else rows, phrases)
        n += 1
    return n, rows


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", keep: list[str] | None = None,
                  item: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """``keep`` columns of ``docs`` (all by default) with n_words, spans
    (merged word spans [start, end) inside any window of a test item) and items
    (sorted ids of items with occurring windows).  A narrow map, no shuffle."""
    keep = kept_columns(docs, keep, "n_words", "spans", "items")
    held = free_name(docs, "text_bytes")[0]
    rows = docs.select(*[col(c) for c in keep], F.encode(col(text).cast("string"), "UTF-8").alias(held),
                       F.lit(0).cast("long").alias("n_words"),
                       F.array().cast("array<struct<start:int,end:int>>").alias("spans"),
                       F.array().cast("array<string>").alias("items"))
    schema, at = rows.schema, len(keep)
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def one_pass(rows: DataFrame, phrases: Phrases) -> DataFrame:
        shared = rows.sparkSession.sparkContext.broadcast(phrases)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo, hi in byte_groups(batch, at, SHARD_BYTES):
                    part = batch.slice(lo, hi - lo)
                    counts, spans, items = shared.value.find(part.column(at).to_pylist())
                    was_spans, was_items = part.column(at + 2).to_pylist(), part.column(at + 3).to_pylist()
                    both = [merge(spans.get(i, []) + [(s["start"], s["end"]) for s in old]) if old or i in spans else []
                            for i, old in enumerate(was_spans)]
                    ids = [sorted(items.get(i, set()).union(old)) for i, old in enumerate(was_items)]
                    yield pa.RecordBatch.from_arrays(
                        [*part.columns[:at + 1], pa.array(counts),
                         pa.array([[{"start": a, "end": b} for a, b in s] for s in both], spans_type),
                         pa.array(ids, pa.list_(pa.string()))], schema.names)
        return rows.mapInArrow(run, schema)

    n, out = _passes(rows, phrase_blocks(benchmark, item, item_text, window), one_pass)
    if not n:  # no test items: count the words all the same
        out = one_pass(rows, Phrases([], window))
    return out.drop(held)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id",
                  item_text: str = "text", window: int = WINDOW, n_chars: str | None = "n_chars") -> DataFrame:
    """``docs`` without the spans that test items share with them: the texts
    are cut again until no window of any item is left - where the items take
    several blocks, rows that a round over all blocks has cut go round again -,
    ``n_chars`` is set anew where the column exists, and a document of which no
    word is left goes.  Documents
    without a hit come out as they were, null and empty ones included."""
    names = docs.columns
    safe = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at, length = names.index(text), names.index(n_chars) if n_chars in names else None
    safe = safe.withColumn(f"c{at}", col(f"c{at}").cast("string"))
    rows = safe.withColumn("cut_in_round", F.lit(False))
    schema = rows.schema

    def one_pass(rows: DataFrame, phrases: Phrases) -> DataFrame:
        shared = rows.sparkSession.sparkContext.broadcast(phrases)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo, hi in byte_groups(batch, at, SHARD_BYTES):
                    part = batch.slice(lo, hi - lo)
                    texts = [t if t is None else t.encode() for t in part.column(at).to_pylist()]
                    todo, changed = list(range(len(texts))), set()
                    while todo:
                        _, spans, _ = shared.value.find([texts[i] for i in todo])
                        for k, s in spans.items():
                            texts[todo[k]] = cut(texts[todo[k]], s)
                        todo = [todo[k] for k in spans]
                        changed.update(todo)
                    if changed:
                        columns = list(part.columns)
                        columns[at] = pa.array([t if t is None else t.decode() for t in texts], part.schema.types[at])
                        columns[-1] = pa.array([i in changed or was for i, was in enumerate(columns[-1].to_pylist())], pa.bool_())
                        if length is not None:
                            sizes = columns[length].to_pylist()
                            for i in changed:
                                sizes[i] = len(texts[i].decode())
                            columns[length] = pa.array(sizes, part.schema.types[length])
                        kept = [i not in changed or bool(_WORD.search(t.lower())) for i, t in enumerate(texts)]
                        part = pa.RecordBatch.from_arrays(columns, schema=part.schema).filter(pa.array(kept))
                    yield part
        return rows.mapInArrow(run, schema)

    blocks, done = 0, []
    while True:
        blocks, rows = _passes(rows, phrase_blocks(benchmark, item, item_text, window), one_pass)
        if blocks < 2:  # a pass leaves no window of its own block
            break
        rows = stage(rows, "decontam")
        done.append(rows.where("not cut_in_round"))
        again = rows.where("cut_in_round")
        if again.isEmpty():
            break
        rows = again.withColumn("cut_in_round", F.lit(False))
    out = reduce(DataFrame.unionAll, done) if done else rows
    return out.drop("cut_in_round").toDF(*names)
