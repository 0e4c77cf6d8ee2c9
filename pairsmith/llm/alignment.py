"""Alignment of two tokenizers by pointer jumping.

A byte-level BPE (A, over a space and the text) and a SentencePiece model (B,
over the text) cut the same bytes.  Every token points to its farthest-right
overlapping token; doubling the successors (``succ = succ[succ]``) until
nothing changes leads each token to the terminal one of its component, which
labels its group: the least runs of A and B tokens that begin and end together.

Both tokenizers break before a plain space that follows a character which is no
blank, so a text falls into chunks whose tokens and groups do not depend on
what stands around them.  Every distinct chunk a worker meets is encoded and
aligned once, all new chunks of a batch in one vectorised run, and a text's
groups are those of its chunks by position.

The texts are read and encoded once; what comes of them - counts, groups and
the linked id pairs of every document - is written to the shared folder, and
links are counted and documents scored from there.  Tokens that end together
are byte suffixes one of the other, so the id pairs that can occur are at most
the lengths of all pieces of A and B added up (``pair_bound``; under a million
for the public vocabularies, whatever the corpus): the count table goes to the
workers whole.

Nulls, empty texts and texts whose joined A or B bytes differ from the space
and the text have no tokens: zeros and ''.  Every input row gives one output
row and counts once, repeated rows repeat; an empty table gives an empty one.
A text is worked off whole, in memory in proportion to its length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_groups, col, free_name, kept_columns, stage
from .pieces import Pieces, _fields, gather

#: Chunks that a worker's table holds; beyond it those met once since the last time leave it.
TABLE_CHUNKS = 120_000
#: Bytes of texts worked off at once.
TEXT_BYTES = 1 << 20
#: Characters of chunks that are encoded as one text.
RUN_CHARS = 1 << 17
#: Links scored at once.
LINKS_AT_ONCE = 1 << 18
#: Longer chunks, and whole texts, leave the table with their group of texts.
LONG_CHUNK = 200

COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")

_CHUNK = re.compile(" +[^ ]*")
_CUT = re.compile(r"(?<=\S)(?= )")
#: A blank other than the space stands before a space: no cut there.
_NO_CUT = re.compile(r"[^\S ] ")


def byte_letters() -> dict[str, int]:
    """Byte-level alphabet: printable Latin-1 characters stand for themselves,
    the other bytes for the code points from 256 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """A byte-level tokenizer with the bytes of its ids."""

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(tokenizer_file)
        self.tok.encode_special_tokens = True  # their strings are ordinary text
        vocab = self.tok.get_vocab(with_added_tokens=True)
        letters = byte_letters()
        body = [b""] * (max(vocab.values()) + 1)
        for entry, i in vocab.items():
            body[i] = bytes(letters[c] for c in entry) if all(c in letters for c in entry) else entry.encode()
        self.sizes = np.fromiter(map(len, body), np.int64, len(body))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(body), np.uint8)
        self.names = list(map(str, range(len(body))))

    def segment(self, chunks: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(chunks, add_special_tokens=False)]

    def run(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)


def successors(ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """Farthest-right overlapping token of every token (A tokens first, then B
    tokens, both in order of place, ends as byte offsets); of two that end
    together the B token, which points to itself."""
    n = len(ends_a)
    over_b = np.searchsorted(ends_b, ends_a, "left")   # the B token over the last byte of each A token
    over_a = np.searchsorted(ends_a, ends_b, "left")
    own = n + np.arange(len(ends_b))
    return np.concatenate((n + over_b, np.where(ends_a[over_a] == ends_b, own, over_a)))


def terminals(succ: np.ndarray) -> np.ndarray:
    """Pointer jumping: the last token that each token's pointers lead to."""
    while True:
        far = succ[succ]
        if np.array_equal(far, succ):
            return succ
        succ = far


class Aligned:
    """Groups of a batch of chunks; chunk ``i`` is sound if both tokenizers
    give back its bytes, and has no tokens otherwise.

    Chunks that end in no blank are encoded as runs of one text, where each
    token falls to a chunk by its place; the others, and runs that do not
    give back their bytes, chunk by chunk."""

    def __init__(self, a: ByteLevel, b: Pieces, chunks: list[str]):
        sides = [[model, np.zeros(len(chunks), np.int64), [np.zeros(0, np.int64)]] for model in (a, b)]  # tokens a chunk, ids
        self.sound = np.zeros(len(chunks), bool)
        lo, ends = 0, [c[-1:].isspace() or not c for c in chunks]
        while lo < len(chunks):  # runs of chunks of either kind
            hi, size = lo, 0
            while hi < len(chunks) and ends[hi] == ends[lo] and size <= RUN_CHARS:
                size += len(chunks[hi])
                hi += 1
            part = chunks[lo:hi]
            found = None if ends[lo] or not b.chunked else self._as_run(a, b, part)
            sound, ids = found or self._one_by_one(a, b, part)
            self.sound[lo:hi] = sound
            for side, (n, flat) in zip(sides, ids):
                side[1][lo:hi] = n
                side[2].append(flat)
            lo = hi
        (_, self.n_a, ids_a), (_, self.n_b, ids_b) = sides
        ids_a, ids_b = np.concatenate(ids_a), np.concatenate(ids_b)
        ends_a, ends_b = np.cumsum(a.sizes[ids_a]), np.cumsum(b.sizes[ids_b])
        label = terminals(successors(ends_a, ends_b)) if len(ends_a) else np.zeros(0, np.int64)
        last = np.zeros(len(ends_a) + len(ends_b), bool)
        last[label] = True
        last_b = np.flatnonzero(last[len(ends_a):])        # one terminal a group, in order of place
        last_a = np.searchsorted(ends_a, ends_b[last_b])   # the A token that ends there too
        self.n_groups = np.diff(np.searchsorted(last_b, np.concatenate(([0], np.cumsum(self.n_b)))))
        self.pairs = ids_a[last_a] << 32 | ids_b[last_b]
        sa, sb = ([*map(m.names.__getitem__, ids.tolist())] for m, ids in ((a, ids_a), (b, ids_b)))
        cut_a, cut_b = [0, *(last_a + 1).tolist()], [0, *(last_b + 1).tolist()]
        texts = [(sa[i] if j == i + 1 else ",".join(sa[i:j])) + "|" + (sb[k] if m == k + 1 else ",".join(sb[k:m]))
                 for i, j, k, m in zip(cut_a, cut_a[1:], cut_b, cut_b[1:])]
        at = np.concatenate(([0], np.cumsum(self.n_groups))).tolist()
        self.groups = [texts[i] if j == i + 1 else ";".join(texts[i:j]) for i, j in zip(at, at[1:])]

    @staticmethod
    def _as_run(a: ByteLevel, b: Pieces, chunks: list[str]):
        text = "".join(chunks)
        body = np.frombuffer(text.encode(), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, chunks), np.int64, len(chunks)))
        if len(text) < len(body):  # characters to bytes
            ends = np.append(np.flatnonzero((body & 0xC0) != 0x80), len(body))[ends]
        out = []
        for model, ids in ((a, a.run(text)), (b, np.array(b.sp.encode(text[1:]), np.int64))):
            sizes = model.sizes[ids]
            if int(sizes.sum()) != len(body) or (model.bytes[gather(model.starts[ids], sizes)] != body).any():
                return None
            at = np.searchsorted(np.cumsum(sizes), ends, "right")
            out.append((np.diff(np.concatenate(([0], at))), ids))
        return np.ones(len(chunks), bool), out

    @staticmethod
    def _one_by_one(a: ByteLevel, b: Pieces, chunks: list[str]):
        body = [c.encode() for c in chunks]
        size = np.fromiter(map(len, body), np.int64, len(body))
        sides = []
        for model, runs in ((a, a.segment(chunks)), (b, b.segment(chunks))):
            n = np.fromiter(map(len, runs), np.int64, len(runs))
            sides.append((model, n, np.fromiter((i for r in runs for i in r), np.int64, int(n.sum())), np.repeat(np.arange(len(n)), n)))
        sound = size > 0
        for model, n, ids, owner in sides:
            sound &= np.bincount(owner, model.sizes[ids], len(n)).astype(np.int64) == size
        text = np.frombuffer(b"".join(c for c, ok in zip(body, sound) if ok), np.uint8)
        place = np.repeat(np.flatnonzero(sound), size[sound])  # chunk of each byte
        wrong = np.zeros(len(size), bool)
        for model, n, ids, owner in sides:
            ids = ids[sound[owner]]
            wrong[place[model.bytes[gather(model.starts[ids], model.sizes[ids])] != text]] = True
        sound &= ~wrong
        return sound, [(n * sound, ids[sound[owner]]) for _, n, ids, owner in sides]


class AlignTable:
    """Distinct chunks met so far with their groups."""

    def __init__(self, a: ByteLevel, b: Pieces):
        self.a, self.b = a, b
        self._clear()

    def _clear(self) -> None:
        self.row: dict[str, int] = {}
        self.groups: list[str] = []
        self.cols = np.zeros((3, 0), np.int64)  # n_a, n_b, n_groups
        self.sound = np.zeros(0, bool)
        self.pair_starts = self.pairs = self.met = np.zeros(0, np.int64)
        self.kept = 0

    def __len__(self) -> int:
        return len(self.groups)

    def _add(self, new: list[str]) -> int:
        """Number of the first new row."""
        got = Aligned(self.a, self.b, new)
        links = np.concatenate(([0], np.cumsum(got.n_groups)))
        first = len(self)
        self.pair_starts = np.concatenate((self.pair_starts, len(self.pairs) + links[:-1]))
        self.pairs = np.concatenate((self.pairs, got.pairs))
        self.cols = np.concatenate((self.cols, [got.n_a, got.n_b, got.n_groups]), axis=1)
        self.sound = np.concatenate((self.sound, got.sound))
        self.met = np.concatenate((self.met, np.zeros(len(new), np.int64)))
        self.groups += got.groups
        return first

    def rows(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(table rows of the chunks of all texts, offsets of the texts); the
        rows from ``kept`` on are valid until ``trim``."""
        cut = [self._cut(t) for t in texts]
        new = set().union(*cut).difference(self.row)
        short, long = [c for c in new if len(c) <= LONG_CHUNK], [c for c in new if len(c) > LONG_CHUNK]
        if short:
            first = self._add(short)
            self.row.update(zip(short, range(first, len(self))))
        self.kept = len(self)
        now = self.row
        if long:
            first = self._add(long)
            now = self.row | dict(zip(long, range(first, len(self))))
        at = np.cumsum([0, *map(len, cut)])
        flat = np.fromiter(map(now.__getitem__, chain.from_iterable(cut)), np.int64, int(at[-1]))
        if not self.sound.all():  # the bytes of a whole text decide
            runs = np.split(flat, at[1:-1])
            for i, run in enumerate(runs):
                if not self.sound[run].all():
                    runs[i] = np.array([self._add([" " + texts[i]])])
            flat, at = np.concatenate(runs), np.cumsum([0, *map(len, runs)])
        self.met += np.bincount(flat, minlength=len(self))
        return flat, at

    @property
    def full(self) -> bool:
        return self.kept > TABLE_CHUNKS

    def trim(self) -> None:
        """Forget long chunks and whole texts, and beyond the bound the chunks
        met once (or all, if that leaves too many)."""
        if not self.full:
            keep = np.arange(self.kept)
            if self.kept == len(self):
                return
        else:
            keep = np.flatnonzero(self.met[:self.kept] > 1)
            if len(keep) > TABLE_CHUNKS // 2:
                self._clear()
                return
            new = np.full(self.kept, -1)
            new[keep] = np.arange(len(keep))
            self.row = {c: k for c, r in self.row.items() if (k := int(new[r])) >= 0}
        n = self.cols[2][keep]
        self.pairs = self.pairs[gather(self.pair_starts[keep], n)]
        self.pair_starts, self.sound, self.cols = np.cumsum(n) - n, self.sound[keep], self.cols[:, keep]
        self.met = self.met[keep] // 2 if self.full else self.met[keep]
        self.groups = [self.groups[k] for k in keep.tolist()]
        self.kept = len(keep)

    def _cut(self, text: str | None) -> list[str]:
        if not text:
            return []
        text = " " + text
        if not self.b.chunked:
            return [text]
        return _CUT.split(text) if _NO_CUT.search(text) else _CHUNK.findall(text)

    def links(self, rows: np.ndarray) -> np.ndarray:
        """Pair keys of the links of table rows, in order."""
        return self.pairs[gather(self.pair_starts[rows], self.cols[2][rows])]


_TABLES: dict[tuple[str, str], AlignTable] = {}


def align_table(a_file: str, b_file: str) -> AlignTable:
    """One table per worker process: it outlives a task."""
    if (a_file, b_file) not in _TABLES:
        _TABLES[a_file, b_file] = AlignTable(ByteLevel(a_file), Pieces(b_file))
    return _TABLES[a_file, b_file]


def pair_bound(a_file: str, b_file: str) -> int:
    """Id pairs that can end together: one token's bytes are a suffix of the
    other's, so there are at most as many as distinct suffixes with an owner."""
    a, b = ByteLevel(a_file), Pieces(b_file)
    owners = max(np.unique([b.bytes[s:s + n].tobytes() for s, n in zip(b.starts, b.sizes)], return_counts=True)[1][1:])
    return int(b.sizes.sum() + a.sizes.sum() * owners)


def aligned(docs: DataFrame, a_file: str, b_file: str, text: str = "text", keep: Sequence[str] | None = None,
            digest: bool = False) -> DataFrame:
    """``keep`` columns (default: all) of ``docs``, n_a, n_b, n_groups (longs),
    ``groups`` and the links ``a_ids``, ``b_ids`` (arrays of int, one pair a
    link, in order).  ``groups``: decimal ids in order as ``a1,a2|b1;a3|b2,b3``,
    or with ``digest`` the SHA-256 of that in hex; '' without tokens."""
    keep = kept_columns(docs, keep, *COLUMNS, "groups", "a_ids", "b_ids")
    body, = free_name(docs, "body")
    kept = docs.select(*[col(k) for k in keep])
    slim = docs.select(*[col(k) for k in keep], col(text).cast("string").alias(body))
    at = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = align_table(a_file, b_file)
        for batch in batches:
            for lo, hi in byte_groups(batch, at, TEXT_BYTES):
                part = batch.slice(lo, hi - lo)
                rows, offsets = table.rows(part.column(at).to_pylist())
                sums = [np.concatenate(([0], np.cumsum(c[rows])))[offsets] for c in table.cols]
                keys = table.links(rows)
                strings, ends = list(map(table.groups.__getitem__, rows.tolist())), offsets.tolist()
                groups = [";".join(strings[i:j]) for i, j in zip(ends, ends[1:])]
                table.trim()
                if digest:
                    groups = [sha256(g.encode()).hexdigest() if g else "" for g in groups]
                pairs = [pa.ListArray.from_arrays(pa.array(sums[2], pa.int32()), pa.array(ids, pa.int32()))
                         for ids in (keys >> 32, keys & 0xFFFFFFFF)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:at], *(pa.array(np.diff(s), pa.int64()) for s in sums), pa.array(groups, pa.string()), *pairs],
                    [*keep, *COLUMNS[:3], "groups", "a_ids", "b_ids"])

    return slim.mapInArrow(run, _fields(kept) + "n_a long, n_b long, n_groups long, groups string, a_ids array<int>, b_ids array<int>")


def link_counts(found: DataFrame) -> DataFrame:
    """(a_id int, b_id int, n long): how many links of all rows of ``aligned``
    hold the pair; added up in each task before the shuffle."""
    return found.select(F.explode(F.arrays_zip("a_ids", "b_ids")).alias("x")).select(
        F.col("x.a_ids").alias("a_id"), F.col("x.b_ids").alias("b_id")).groupBy("a_id", "b_id").agg(F.count(F.lit(1)).alias("n"))


def align(docs: DataFrame, a_file: str, b_file: str, text: str = "text", keep: Sequence[str] | None = None,
          digest: bool = False) -> DataFrame:
    """``keep`` columns (default: all) of ``docs``, n_a, n_b, n_groups,
    n_links, n_best (links whose count is the highest of their B id),
    count_sum (counts over links; all longs) and ``groups`` as in ``aligned``.

    ``a_file`` (tokenizers) and ``b_file`` (sentencepiece) are paths every
    executor has.  Texts are never shuffled."""
    found = stage(aligned(docs, a_file, b_file, text, keep, digest), "aligned")
    table = link_counts(found).toArrow()  # at most pair_bound rows
    a, b, n = (table.column(k).to_numpy().astype(np.int64) for k in ("a_id", "b_id", "n"))
    order = np.argsort(a << 32 | b)
    a, b, n = a[order], b[order], n[order]
    highest = np.zeros(int(b.max(initial=0)) + 1, np.int64)
    np.maximum.at(highest, b, n)
    counts = docs.sparkSession.sparkContext.broadcast((a << 32 | b, n, (n == highest[b]).astype(np.int64)))
    keep = [c for c in found.columns if c not in (*COLUMNS, "groups", "a_ids", "b_ids")]
    plain = found.select(*[col(k) for k in keep], *COLUMNS[:3], "groups", "a_ids", "b_ids")
    fixed = len(keep) + 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _TABLES.clear()  # this worker may have aligned texts before; its table is done with
        keys, n, best = counts.value
        for batch in batches:
            sizes = np.asarray(batch.column(fixed - 2))  # one link a group
            ends = np.concatenate(([0], np.cumsum(sizes)))
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + LINKS_AT_ONCE, "right")) - 1)
                part = batch.slice(lo, hi - lo)
                ids = [np.asarray(part.column(k).flatten()).astype(np.int64) for k in (fixed, fixed + 1)]
                at = np.searchsorted(keys, ids[0] << 32 | ids[1])
                cut = ends[lo:hi + 1] - ends[lo]
                scores = [np.diff(np.concatenate(([0], np.cumsum(x[at])))[cut]) for x in (best, n)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:fixed - 1], part.column(fixed - 2), *(pa.array(s, pa.int64()) for s in scores),
                     part.column(fixed - 1)], [*keep, *COLUMNS, "groups"])
                lo = hi

    return plain.mapInArrow(run, _fields(found.select(*[col(k) for k in keep])) + ", ".join(f"{c} long" for c in COLUMNS)
                            + ", groups string")
