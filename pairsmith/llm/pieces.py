"""SentencePiece encoding and decoding over a distinct-chunk table.

Where no piece of the model holds a whitespace marker after another character,
no merge crosses the place between such a character and the next marker.  A
marked text therefore falls into chunks - a run of markers and the characters
up to the next marker - that are segmented independently.  Every distinct
chunk a worker meets is segmented once, into a table of bounded size; a text's
ids are the table's rows gathered by the chunks' positions.  ``chunked`` tests
the model for it (pieces, marker prefix, identity normaliser); any other model
has each whole text as its one chunk.

Decoding gathers the bytes of the pieces by position in the same way and lets
the library decode what is no plain run of valid UTF-8.

Nulls and empty texts have no ids; null ids decode to null, no ids to ''.
Every input row gives one output row, repeated rows repeat, an empty table
gives an empty one.  A text is worked off whole, in memory in proportion to
its own length.  Input columns that bear the name of a result column are
replaced by it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import byte_groups, col, free_name, kept_columns

MARK = "▁"
#: Chunks that a worker's table holds; beyond it the table starts anew.
TABLE_CHUNKS = 250_000
#: Bytes of texts encoded, and ids decoded, at once.
TEXT_BYTES, IDS_AT_ONCE = 1 << 20, 1 << 17
#: Longer chunks are segmented whenever they are met and leave the table with their group.
LONG_CHUNK = 200

_CHUNK = re.compile(" +[^ ]*")


def gather(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of the runs (start, size) one behind the other."""
    ends = np.cumsum(sizes)
    if not len(ends):
        return np.zeros(0, np.int64)
    return np.arange(ends[-1]) + np.repeat(starts - (ends - sizes), sizes)


class Pieces:
    """A SentencePiece model with what cutting and gathering need."""

    def __init__(self, model_file: str):
        from sentencepiece import SentencePieceProcessor
        self.sp = SentencePieceProcessor(model_file=model_file)
        names = [self.sp.id_to_piece(i) for i in range(self.sp.vocab_size())]
        self.is_byte = np.array([self.sp.is_byte(i) for i in range(len(names))], bool)
        self.plain = np.array([not (self.sp.is_control(i) or self.sp.is_unknown(i)) for i in range(len(names))], bool)
        body = [bytes([int(p[3:5], 16)]) if b else p.replace(MARK, " ").encode() if ok else b""
                for p, b, ok in zip(names, self.is_byte, self.plain)]
        self.sizes = np.fromiter(map(len, body), np.int64, len(body))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(body), np.uint8)
        self.names = list(map(str, range(len(body))))
        self.chunked = self._chunked(names)

    def _chunked(self, names: list[str]) -> bool:
        if MARK not in names or any(MARK in p.lstrip(MARK) for p in names):
            return False
        every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
        marked = every.replace(" ", MARK)
        return self.sp.normalize(every) == MARK + marked and self.sp.normalize(" a  b ") == f"{MARK * 2}a{MARK * 2}b{MARK}" \
            and self.sp.decode(self.sp.encode("  a b ")) == "  a b "

    def segment(self, chunks: list[str]) -> list[list[int]]:
        """Ids of chunks that begin with a marker, written as a space: the
        library sets the first marker itself, but not before an empty text."""
        out = self.sp.encode([c[1:] for c in chunks], num_threads=1)
        for i, c in enumerate(chunks):
            if c == " ":
                out[i] = self.sp.encode("a ")[len(self.sp.encode("a")):]
        return out

    def chunks(self, text: str | None) -> list[str]:
        return _CHUNK.findall(" " + text.replace(MARK, " ")) if text else []

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of the pieces, one behind the other."""
        return self.bytes[gather(self.starts[ids], self.sizes[ids])]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """Texts of the id runs between ``offsets``."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.plain)):
            raise ValueError("an id is not in the model's vocabulary")
        sizes = np.concatenate(([0], np.cumsum(self.sizes[ids])))[offsets].tolist()
        odd = np.concatenate(([0], np.cumsum(~self.plain[ids])))[offsets]
        body = self.joined(ids).tobytes()
        out = []
        for i, (lo, hi) in enumerate(zip(sizes, sizes[1:])):
            try:
                text = body[lo:hi].decode() if self.chunked and odd[i] == odd[i + 1] else None
            except UnicodeDecodeError:
                text = None
            if text is None:
                text = self.sp.decode(ids[offsets[i]:offsets[i + 1]].tolist())
            elif text.startswith(" ") and not self.is_byte[ids[offsets[i]]]:  # the marker that encoding sets
                text = text[1:]
            out.append(text)
        return out


class ChunkTable:
    """Ids of the distinct chunks met so far, as rows of one flat array."""

    def __init__(self, model: Pieces):
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.row: dict[str, int] = {}
        self.starts = self.sizes = self.flat = np.zeros(0, np.int64)

    def _add(self, new: list[str]) -> None:
        ids = self.model.segment(new)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        self.starts = np.concatenate((self.starts, len(self.flat) + np.cumsum(sizes) - sizes))
        self.sizes = np.concatenate((self.sizes, sizes))
        self.flat = np.concatenate((self.flat, np.fromiter((i for x in ids for i in x), np.int64, int(sizes.sum()))))
        self.row.update(zip(new, range(len(self.row), len(self.row) + len(new))))

    def encode(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one behind the other, offsets of the texts)."""
        if not self.model.chunked:
            runs = self.model.sp.encode([t or "" for t in texts], num_threads=1)
            return np.fromiter((i for r in runs for i in r), np.int64), np.cumsum([0, *map(len, runs)])
        cut = [self.model.chunks(t) for t in texts]
        met = set().union(*cut) if cut else set()
        new = sorted(c for c in met if c not in self.row)
        if len(self.row) + len(new) > TABLE_CHUNKS:
            self._clear()
            new = sorted(met)
        short, long = [c for c in new if len(c) <= LONG_CHUNK], [c for c in new if len(c) > LONG_CHUNK]
        self._add(short)
        kept = len(self.row), len(self.flat)
        self._add(long)
        rows = np.fromiter((self.row[c] for run in cut for c in run), np.int64)
        sizes = self.sizes[rows]
        ids = self.flat[gather(self.starts[rows], sizes)]
        at = np.concatenate(([0], np.cumsum(sizes)))[np.cumsum([0, *map(len, cut)])]
        for c in long:
            del self.row[c]
        self.starts, self.sizes, self.flat = self.starts[:kept[0]], self.sizes[:kept[0]], self.flat[:kept[1]]
        return ids, at


_TABLES: dict[str, ChunkTable] = {}


def chunk_table(model_file: str) -> ChunkTable:
    """One table per worker process: it outlives a task."""
    if model_file not in _TABLES:
        _TABLES[model_file] = ChunkTable(Pieces(model_file))
    return _TABLES[model_file]


def _fields(df: DataFrame) -> str:
    return "".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}, " for f in df.schema.fields)


def encode_pieces(docs: DataFrame, model_file: str, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """``keep`` columns (default: all) of ``docs`` and ``ids`` array<int>: the
    whole ``text`` as the library encodes it, without begin or end ids.

    ``model_file`` is a path every executor has.  A narrow map: no shuffle."""
    keep = kept_columns(docs, keep, "ids")
    body, = free_name(docs, "body")
    kept = docs.select(*[col(k) for k in keep])
    slim = docs.select(*[col(k) for k in keep], col(text).cast("string").alias(body))
    at = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = chunk_table(model_file)
        for batch in batches:
            for lo, hi in byte_groups(batch, at, TEXT_BYTES):
                part = batch.slice(lo, hi - lo)
                ids, offsets = table.encode(part.column(at).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns[:at], lists], [*keep, "ids"])

    return slim.mapInArrow(run, _fields(kept) + "ids array<int>")


def decode_pieces(encoded: DataFrame, model_file: str, ids: str = "ids", keep: Sequence[str] | None = None) -> DataFrame:
    """``keep`` columns (default: all) of ``encoded`` and ``decoded`` string:
    the text of ``ids`` (array<int>; null stays null, null elements are left
    out, an id outside the vocabulary is an error) as the library decodes it."""
    keep = kept_columns(encoded, keep, "decoded")
    run_ids, = free_name(encoded, "run_ids")
    kept = encoded.select(*[col(k) for k in keep])
    slim = encoded.select(*[col(k) for k in keep], col(ids).cast("array<int>").alias(run_ids))
    at = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc
        model = chunk_table(model_file).model
        for batch in batches:
            size = pc.fill_null(pc.list_value_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(size)
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - size[lo] + IDS_AT_ONCE, side="right")))
                part = batch.slice(lo, hi - lo)
                lists = part.column(at)
                if lists.flatten().null_count:
                    lists = pa.array([r and [i for i in r if i is not None] for r in lists.to_pylist()], pa.list_(pa.int32()))
                flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                texts = model.decode(flat, np.concatenate(([0], np.cumsum(sizes))))
                texts = [t if ok else None for t, ok in zip(texts, pc.is_valid(lists).to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns[:at], pa.array(texts, pa.string())], [*keep, "decoded"])
                lo = hi

    return slim.mapInArrow(run, _fields(kept) + "decoded string")
