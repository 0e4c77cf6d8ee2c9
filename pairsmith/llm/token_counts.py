"""Token counts of whole texts with a public byte-level BPE tokenizer.

Arrow batches are worked off in groups of about equal bytes.  Each text is cut
at safe boundaries - before a plain space that follows a character which is no
blank - where the byte-level pre-tokenizer starts a new piece whatever stands
around it, so the counts of the pieces add up to the count of the text.  Only
the pieces a worker has not met are encoded, in one batch call that returns
lengths; memory is bounded by the group and by ``MEMO_PIECES``.

Nulls and empty texts have 0 tokens.  Every input row gives one output row;
repeated rows repeat.  Special strings inside texts are encoded as the
tokenizer's file says (they hold no blank, so no cut goes through one).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_groups, col, kept_columns

#: Pieces a worker remembers with their lengths; the memo starts anew beyond it.
MEMO_PIECES = 1_500_000
#: Bytes of new pieces encoded in one batch call.
ENCODE_BYTES = 1 << 20

#: A letter run and the marks after it are separate pre-tokens.
_MARKS = re.compile(r"([A-Za-z])([.,;:!?$%&*#|]+)\Z")
#: Stands for "no cut before the next space": larger than any real sum.
_JOIN = 1 << 60


class PieceCounter:
    """Lengths of text pieces under one tokenizer, remembered between calls.

    ``memo`` holds, for a run of characters without a plain space, the token
    count of the run with a space before it."""

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(tokenizer_file)
        self.memo: dict[str, int] = {}

    def encode(self, pieces: list[str]) -> list[int]:
        """Token counts, a megabyte or so of text per batch call."""
        out: list[int] = []
        lo = 0
        while lo < len(pieces):
            hi, size = lo, 0
            while hi < len(pieces) and (hi == lo or size + len(pieces[hi]) <= ENCODE_BYTES):
                size += len(pieces[hi])
                hi += 1
            out.extend(len(e) for e in self.tok.encode_batch_fast(pieces[lo:hi], add_special_tokens=False))
            lo = hi
        return out

    def learn(self, runs: set[str]) -> None:
        new = [r for r in runs if r not in self.memo]
        if len(self.memo) + len(new) > MEMO_PIECES:
            self.memo = {}
            new = list(runs)
        whole, parts = [], []
        for r in new:
            if not r or r[-1].isspace():
                self.memo[r] = _JOIN
            elif m := _MARKS.search(r):  # letters, then marks: both apart are met far more often
                parts.append((r, r[:m.start(2)], m.group(2)))
            else:
                whole.append(r)
        whole.extend({h for _, h, _ in parts if h not in self.memo})
        self.memo.update(zip(whole, self.encode([" " + r for r in whole])))
        marks = sorted({m for _, _, m in parts})
        of_marks = dict(zip(marks, self.encode(marks)))
        for r, head, m in parts:
            self.memo[r] = self.memo[head] + of_marks[m]

    def counts(self, texts: list[str | None]) -> list[int]:
        cut = [t.split(" ") if t else [""] for t in texts]
        self.learn({r for runs in cut for r in runs[1:]})
        first = self.encode([runs[0] for runs in cut])
        get = self.memo.__getitem__
        out = [n + sum(map(get, runs[1:])) for n, runs in zip(first, cut)]
        # the first run has no count in the memo, but its end matters too
        for i, (n, runs) in enumerate(zip(out, cut)):
            if n >= _JOIN or len(runs) > 1 and (not runs[0] or runs[0][-1].isspace()):
                out[i] = sum(self.encode(safe_pieces(runs)))
        return out


def safe_pieces(runs: list[str]) -> list[str]:
    """Join space-separated runs again unless the left one ends in a character
    that is no blank (in the widest sense, so the cut is safe)."""
    out, held = [], runs[0]
    for r in runs[1:]:
        if held and not held[-1].isspace():
            out.append(held)
            held = " " + r
        else:
            held += " " + r
    out.append(held)
    return out


_COUNTERS: dict[str, PieceCounter] = {}


def _counter(tokenizer_file: str) -> PieceCounter:
    """One counter per worker process, so the memo outlives a task."""
    if tokenizer_file not in _COUNTERS:
        _COUNTERS[tokenizer_file] = PieceCounter(tokenizer_file)
    return _COUNTERS[tokenizer_file]


def count_tokens(docs: DataFrame, tokenizer_file: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
                 limit: int = 512) -> DataFrame:
    """``keep`` columns of ``docs`` with n_bytes, n_tokens and over_limit
    (n_tokens > ``limit``) of the whole ``text``.

    ``tokenizer_file`` is a path every executor has.  A narrow map: no shuffle."""
    keep = kept_columns(docs, keep, "n_bytes", "n_tokens", "over_limit", "__text")
    slim = docs.select(*[col(k) for k in keep], col(text).cast("string").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1])
    at = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        counter = _counter(tokenizer_file)
        names = [*keep, "n_bytes", "n_tokens"]
        for batch in batches:
            for lo, hi in byte_groups(batch, at):
                part = batch.slice(lo, hi - lo)
                texts = part.column(at).to_pylist()
                n_bytes = [len(t.encode()) if t else 0 for t in texts]
                n_tokens = counter.counts(texts)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:at], pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64())], names)

    out = slim.mapInArrow(run, schema + ", n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
