"""Answer sheet -> labelled samples (EXP-01 .. EXP-09).

A sheet row yields samples from six parsers.  Each parser emits *blocks*
(lists of samples built from one comma list); a block either succeeds as a
whole or fails at its first element, because every element shares the same
source sentence and old word.  The rule the reference's generators follow is
kept: block *k* of a parser is emitted iff the parser's checks before it and
block *k*'s own check pass.  A failed parser goes to a quarantine table with
its reason instead of being printed.

Everything is a column expression: one ``array<struct>`` per block, gated,
concatenated and exploded.  The sheet's rows are dealt out evenly first;
no Python.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, word_position
from .common import spread
from .filters import is_complete

# Answer-sheet column names.
C_PREMISE = "Input.premise"
C_WORKER = "WorkerId"
C_HIT = "HITId"
C_SUBMIT = "Answer.Submit Location"
C_HYPO = "Answer.1a. Original_hyponym (hyponym 1)"
C_HYPER = "Answer.1a. Main Hypernym"
C_L1B = "Answer.1b. Label original Hypo->Hyper"
C_HYPOS = "Answer.2a. Hyponyms list"
C_L2B2 = "Answer.2b-2. Label list Hyper->Hypo"
C_L2B1 = "Answer.2b-1. Label list Hypo->Hyper"
C_NON = "Answer.3a. Non-hyponyms list"
C_L3B1 = "Answer.3b-1. Label list Nonhypo->Hyper"
C_L3B2 = "Answer.3b-2. Label list Hyper->Nonhypo"
C_P4 = "Answer.4. Premise (Hyper)"
C_4A = "Answer.4a. Hyper->Hypo text"
C_4B = "Answer.4b. Hyper->Nonhypo text"
C_4AL = "Answer.4al. Hyper->Hypo label"
C_4BL = "Answer.4bl. Hyper->Nonhypo label"
C_P5 = "Answer.5. Premise (Hypo)"
C_5A = "Answer.5a. Hypo->Hyper text"
C_5B = "Answer.5b. Hypo->Nonhypo text"
C_5AL = "Answer.5al. Hypo->Hyper label"
C_5BL = "Answer.5bl. Hypo->Nonhypo label"

SHEET_COLUMNS = (C_PREMISE, C_WORKER, C_HIT, C_SUBMIT, C_HYPO, C_HYPER, C_L1B, C_HYPOS, C_L2B2,
                 C_L2B1, C_NON, C_L3B1, C_L3B2, C_P4, C_4A, C_4B, C_4AL, C_4BL, C_P5, C_5A, C_5B,
                 C_5AL, C_5BL)

# Section names written into sample metadata.
SECTIONS = {
    (1, 1): "1",
    (2, 1): "2 hyper->hypo", (2, 2): "2 hypo->hyper",
    (3, 1): "3 Nonhypo->hyper", (3, 2): "3 Hyper->Nonhypo",
    (4, 1): "4 hyper->hypo freestyle original", (4, 2): "4 hyper->Nonhypo freestyle original",
    (5, 1): "5 hypo->hyper freestyle original", (5, 2): "5 hypo->Nonhypo freestyle original",
    (6, 1): "dataset3 hyper->hypo freestyle substitution",
    (6, 2): "dataset3 hyper->nonhypo freestyle substitution",
    (6, 3): "dataset3 hypo->hyper freestyle substitution",
    (6, 4): "dataset3 hypo->nonhypo freestyle substitution",
}

EMPTY = "empty_cell"      # silently skipped by the reference
NOT_FOUND = "word_not_found"
LENGTH = "list_length"
BRACE = "brace_in_sentence"
NULL = "null_cell"

SAMPLE_TYPE = ("struct<premise:string,hypothesis:string,label:string,section:string,pword:string,"
               "hword:string,ptype:string,htype:string,parser:int,block:int,j:int>")


def col(name: str) -> Column:
    return F.col(f"`{name}`")


def _first_reason(*checks: tuple[Column, str]) -> Column:
    """Reason of the first failing check, or null when all pass."""
    out = None
    for bad, reason in checks:
        out = F.when(bad, F.lit(reason)) if out is None else out.when(bad, F.lit(reason))
    return out


def _chain(*reasons: Column) -> Column:
    return F.coalesce(*reasons)


def _has_empty(c: Column) -> Column:
    return F.contains(c, F.lit("{}"))


def replace_checks(s: Column, old: Column, pos: Column | None = None) -> list[tuple[Column, str]]:
    """Checks of one ``safe_replace(s, old, new)`` in the order they fire;
    ``pos`` is the word position when already computed."""
    pos = word_position(s, old) if pos is None else pos
    return [(s.isNull() | old.isNull(), NULL), (_has_empty(s), EMPTY), (_has_empty(old), EMPTY),
            (pos == 0, NOT_FOUND),
            (F.contains(s, F.lit("{")) | F.contains(s, F.lit("}")), BRACE)]


def replace_at(s: Column, old: Column, pos: Column, new: Column) -> Column:
    """``safe_replace`` with the position of ``old`` already known."""
    return F.when(pos > 0, F.overlay(s, new, pos, F.length(old)))


def list_checks(c: Column) -> list[tuple[Column, str]]:
    return [(c.isNull(), NULL), (_has_empty(c), EMPTY)]


def strip_number(c: Column) -> Column:
    """Drop everything up to the first ``)`` and trim whitespace."""
    cut = F.substring(c, F.locate(")", c) + 1, 1 << 30)
    return F.regexp_replace(cut, r"^\s+|\s+$", "")


def _sample(premise, hypothesis, label, parser, block, pword, hword, ptype, htype, j) -> Column:
    return F.struct(premise.alias("premise"), hypothesis.alias("hypothesis"), label.alias("label"),
                    F.lit(SECTIONS[(parser, block)]).alias("section"), pword.alias("pword"),
                    hword.alias("hword"), F.lit(ptype).alias("ptype"), F.lit(htype).alias("htype"),
                    F.lit(parser).alias("parser"), F.lit(block).alias("block"), j.cast("int").alias("j"))


def _zip_block(words: Column, labels: Column, build) -> Column:
    """One sample per (word, label) position of two equal-length lists."""
    return F.transform(F.arrays_zip(words.alias("w"), labels.alias("l")),
                       lambda z, i: build(z["w"], z["l"], i))


def _gate(ok_reason: Column, arr: Column) -> Column:
    return F.when(ok_reason.isNull(), arr).otherwise(F.array().cast(f"array<{SAMPLE_TYPE}>"))


@dataclass(frozen=True)
class Cells:
    """What parsers build from: cells of a sheet row, their lists, and word
    positions worked out once per row (used by several gates and by every
    element of a block; those that no parser asks for are pruned)."""

    premise: Column
    hypo: Column
    hyper: Column
    hypos: Column       # lists
    non: Column
    non0: Column        # first of the non-hyponyms
    p4: Column          # free premises without their number
    p5: Column
    pos: dict[str, Column]
    fix_section4_label: bool

    @property
    def hyper_sentence(self) -> Column:
        return replace_at(self.premise, self.hypo, self.pos["ph"], self.hyper)


#: A block is (its own reason to fail or null, its samples as an array column).
Block = tuple[Column, Column]
#: A parser builds the blocks of one row, in order: a block is emitted iff its
#: own checks and those of the blocks before it pass.
Parser = Callable[[Cells], list[Block]]


def _size_ne(a: str, b: Column) -> Column:
    return F.size(F.split(col(a), ",")) != F.size(b)


def _found(s: Column, w: Column, pos: Column) -> list[tuple[Column, str]]:
    """Word tests of the free-text parsers (no format test)."""
    return [(s.isNull() | w.isNull(), NULL), (pos == 0, NOT_FOUND)]


def parse_1(c: Cells) -> list[Block]:
    """Hyponym premise, hypernym hypothesis (EXP-01)."""
    ok = _first_reason(*list_checks(col(C_L1B)), *replace_checks(c.premise, c.hypo, c.pos["ph"]))
    return [(ok, F.array(_sample(c.premise, c.hyper_sentence, col(C_L1B), 1, 1, c.hypo, c.hyper, "hypo", "hyper", F.lit(0))))]


def _both_ways(c: Cells, parser: int, words: Column, cell: str, kind: str, first: str, second: str, hyper_first: bool) -> list[Block]:
    """A word list against the hypernym sentence, labels of each way in a cell."""
    other = lambda w: replace_at(c.premise, c.hypo, c.pos["ph"], w)
    down = lambda block: lambda w, lab, i: _sample(c.hyper_sentence, other(w), lab, parser, block, c.hyper, w, "hyper", kind, i)
    up = lambda block: lambda w, lab, i: _sample(other(w), c.hyper_sentence, lab, parser, block, w, c.hyper, kind, "hyper", i)
    one, two = (down(1), up(2)) if hyper_first else (up(1), down(2))
    return [(_first_reason(*list_checks(col(cell)), *replace_checks(c.premise, c.hypo, c.pos["ph"]),
                           *list_checks(col(first)), (_size_ne(first, words), LENGTH)),
             _zip_block(words, F.split(col(first), ","), one)),
            (_first_reason(*list_checks(col(second)), (_size_ne(second, words), LENGTH)),
             _zip_block(words, F.split(col(second), ","), two))]


def parse_2(c: Cells) -> list[Block]:
    """Hypernym against each hyponym, both ways (EXP-02)."""
    return _both_ways(c, 2, c.hypos, C_HYPOS, "hypo", C_L2B2, C_L2B1, True)


def parse_3(c: Cells) -> list[Block]:
    """Hypernym against each non-hyponym, both ways (EXP-03)."""
    return _both_ways(c, 3, c.non, C_NON, "nonhypo", C_L3B1, C_L3B2, False)


def parse_4(c: Cells) -> list[Block]:
    """Free hypernym premise (EXP-04)."""
    label4b = col(C_4BL) if c.fix_section4_label else col(C_5BL)
    ok = _first_reason(*list_checks(col(C_NON)), (col(C_P4).isNull(), NULL), *_found(c.p4, c.hyper, c.pos["p4h"]),
                       *_found(col(C_4A), c.hypo, c.pos["4a"]), *_found(col(C_4B), c.non0, c.pos["4b"]), (_has_empty(c.p4), EMPTY))
    return [(ok, F.array(_sample(c.p4, col(C_4A), col(C_4AL), 4, 1, c.hyper, c.hypo, "hyper", "hypo", F.lit(0)),
                         _sample(c.p4, col(C_4B), label4b, 4, 2, c.hyper, c.non0, "hyper", "nonhypo", F.lit(1))))]


def parse_5(c: Cells) -> list[Block]:
    """Free hyponym premise (EXP-05)."""
    ok = _first_reason(*list_checks(col(C_NON)), (col(C_P5).isNull(), NULL), *_found(c.p5, c.hypo, c.pos["p5"]),
                       *_found(col(C_5A), c.hyper, c.pos["5ah"]), *_found(col(C_5B), c.non0, c.pos["5b"]), (_has_empty(c.p5), EMPTY))
    return [(ok, F.array(_sample(c.p5, col(C_5A), col(C_5AL), 5, 1, c.hypo, c.hyper, "hypo", "hyper", F.lit(0)),
                         _sample(c.p5, col(C_5B), col(C_5BL), 5, 2, c.hypo, c.non0, "hypo", "nonhypo", F.lit(1))))]


def parse_6(c: Cells) -> list[Block]:
    """Substitutions in the free texts (EXP-06); the non-hyponyms' first element is skipped."""
    t4a, t4b, t5a, t5b = col(C_4A), col(C_4B), col(C_5A), col(C_5B)
    rest = F.slice(c.non, 2, 1 << 30)
    common = _first_reason((col(C_P4).isNull() | col(C_P5).isNull(), NULL), *list_checks(col(C_HYPOS)), *list_checks(col(C_NON)),
                           *_found(c.p4, c.hyper, c.pos["p4h"]), *_found(c.p5, c.hypo, c.pos["p5"]))
    a = F.transform(c.hypos, lambda w, i: _sample(c.p4, replace_at(t4a, c.hypo, c.pos["4a"], w), col(C_4AL), 6, 1,
                                                  c.hyper, w, "hyper", "hypo", i))
    b = F.transform(rest, lambda w, i: _sample(c.p4, replace_at(t4b, c.non0, c.pos["4b"], w), col(C_4BL), 6, 2,
                                               c.hyper, w, "hyper", "nonhypo", i))
    up = F.transform(c.hypos, lambda w, i: _sample(replace_at(c.p5, c.hypo, c.pos["p5"], w), t5a, col(C_5AL), 6, 3,
                                                   w, c.hyper, "hypo", "hyper", i))
    each = F.flatten(F.transform(rest, lambda nw, k: F.transform(c.hypos, lambda w, i: _sample(
        replace_at(c.p5, c.hypo, c.pos["p5"], w), replace_at(t5b, c.non0, c.pos["5b"], nw), col(C_5BL), 6, 4, w, nw,
        "hypo", "nonhypo", k * F.size(c.hypos) + i))))
    return [(_chain(common, _first_reason(*replace_checks(t4a, c.hypo, c.pos["4a"]))), a),
            (F.when(F.size(rest) > 0, _first_reason(*replace_checks(t4b, c.non0, c.pos["4b"]))), b),
            (_first_reason(*replace_checks(c.p5, c.hypo, c.pos["p5"])), up),
            (F.when(F.size(rest) > 0, _first_reason(*replace_checks(c.p5, c.hypo, c.pos["p5"]),
                                                    *replace_checks(t5b, c.non0, c.pos["5b"]))), each)]


#: Parser number -> parser, in the order of their samples (UDF-02): run some of
#: them, or a longer list with one's own.
PARSERS: dict[int, Parser] = {1: parse_1, 2: parse_2, 3: parse_3, 4: parse_4, 5: parse_5, 6: parse_6}


def expand_sheet(sheet: DataFrame, row_id: str = "row_id", fix_section4_label: bool = False,
                 parsers: dict[int, Parser] | None = None):
    """Return ``(samples, quarantine)`` DataFrames of the given parsers (all by default).

    ``samples``: premise, hypothesis, label, metadata fields (section, pword,
    hword, ptype, htype, row_id, worker_id, hit_id, is_complete) plus
    ``parser``, ``block``, ``j`` and ``sample_idx`` (order inside the row,
    over the parsers run).
    ``quarantine``: row_id, parser, reason, silent (empty-cell skips).
    """
    non0 = F.element_at(F.split(col(C_NON), ","), 1)
    p4, p5 = strip_number(col(C_P4)), strip_number(col(C_P5))
    places = {"ph": (col(C_PREMISE), col(C_HYPO)), "4a": (col(C_4A), col(C_HYPO)), "4b": (col(C_4B), non0), "p5": (p5, col(C_HYPO)),
              "5b": (col(C_5B), non0), "p4h": (p4, col(C_HYPER)), "5ah": (col(C_5A), col(C_HYPER))}
    # some 40 searches a row: the rows of a sheet, few bytes each, are dealt out to all tasks first
    sheet = spread(sheet).select("*", non0.alias("__non0"), p4.alias("__p4"), p5.alias("__p5"),
                         *[word_position(s, w).alias(f"__pos_{k}") for k, (s, w) in places.items()])
    cells = Cells(col(C_PREMISE), col(C_HYPO), col(C_HYPER), F.split(col(C_HYPOS), ","), F.split(col(C_NON), ","), F.col("__non0"),
                  F.col("__p4"), F.col("__p5"), {k: F.col(f"__pos_{k}") for k in places}, fix_section4_label)
    arrays, reasons = [], []
    for number, parse in (PARSERS if parsers is None else parsers).items():
        so_far = []
        for own, samples in parse(cells):
            so_far.append(own)
            arrays.append(_gate(_chain(*so_far), samples))
        reasons.append((number, _chain(*so_far)))
    failures = F.filter(F.array(*[F.struct(F.lit(p).alias("parser"), r.alias("reason")) for p, r in reasons]),
                        lambda x: x["reason"].isNotNull())

    meta = [F.col(row_id).alias("row_id"), col(C_WORKER).alias("worker_id"), col(C_HIT).alias("hit_id"),
            is_complete(C_SUBMIT).alias("is_complete")]
    staged = sheet.select(*meta, F.concat(*arrays).alias("__s"), failures.alias("__f"))
    # outer generators: the optimizer infers a "non-empty array" filter for a
    # plain explode and copies the whole array expression into it, which makes
    # planning blow up on an expression this size; null rows are dropped instead
    samples = staged.select("row_id", "worker_id", "hit_id", "is_complete",
                            F.posexplode_outer("__s").alias("sample_idx", "s")).where(F.col("s").isNotNull()).select(
        "s.premise", "s.hypothesis", "s.label", "s.section", "s.pword", "s.hword", "s.ptype", "s.htype",
        "row_id", "worker_id", "hit_id", "is_complete", "s.parser", "s.block", "s.j",
        F.col("sample_idx").cast("int").alias("sample_idx"))
    quarantine = staged.select("row_id", F.explode_outer("__f").alias("f")).where(F.col("f").isNotNull()).select(
        "row_id", "f.parser", "f.reason", (F.col("f.reason") == EMPTY).alias("silent"))
    return samples, quarantine


def review_rows(samples: DataFrame) -> DataFrame:
    """Two review rows per sample (premise, hypothesis) with the swapped word
    in bold and three blank review columns (EXP-09)."""
    def one(kind, text_col, word_col):
        bold = let(word_position(F.col(text_col), F.col(word_col)), lambda pos: F.when(pos > 0, F.overlay(
            F.col(text_col), F.concat(F.lit("**"), F.col(word_col), F.lit("**")), pos, F.length(word_col))))
        return F.struct(F.lit(kind).alias("type"), bold.alias("text"))
    rows = samples.select(
        "*", F.explode(F.array(one("P", "premise", "pword"), one("H", "hypothesis", "hword"))).alias("r"))
    return rows.select(
        F.col("r.type").alias("type"), F.col("r.text").alias("text"), "label",
        F.lit("").alias("is_label_correct"), F.lit("").alias("is_grammatically"),
        F.lit("").alias("is_makes_sense"),
        F.concat_ws("->", "ptype", "htype").alias("ptype_htype"),
        F.concat_ws("->", "pword", "hword").alias("from_to"),
        "section", F.col("worker_id").alias("worker"), F.col("is_complete").alias("is_completed"),
        "row_id", "hit_id",
        *[c for c in ("parser", "block", "j", "sample_idx") if c in samples.columns])
