"""SentencePiece ids, tokenizer alignment and hard negatives against brute
force, on rows with nulls, empty and long texts, ties, repeats and clashing names."""

import hashlib
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pairsmith.llm import alignment, hard_negatives, pieces

public = pytest.importorskip("public_tokenizers")
A_FILE, B_FILE = public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")
BITS = list("ab ▁  \n\t<s>é中\x00😀 \x1f.'1  ") + ["<unk>", "▁▁", "the ", "  ", " word", "<|endoftext|>", "\n\n", "\n ", "<0x41>"]


def odd_texts(seed, n, most=16):
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) for _ in range(rng.randint(0, most))) for _ in range(n)]


def library():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(A_FILE)
    tok.encode_special_tokens = True
    return tok, SentencePieceProcessor(model_file=B_FILE)


def texts_of(spark, docs, seed):
    odd = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(odd_texts(seed, 300))], "doc_id long, text string")
    return docs.select("doc_id", "text").unionByName(odd)


# ---------------------------------------------------------------- 13 sentencepiece
def test_pieces_equal_the_library(spark, docs):
    _, sp = library()
    both = texts_of(spark, docs, 1).withColumns({"IDS": F.lit("taken"), "decoded": F.lit(1), "run_ids": F.lit(0), "body": F.lit(0)})
    out = pieces.decode_pieces(pieces.encode_pieces(both, B_FILE), B_FILE)
    assert sorted(out.columns) == ["body", "decoded", "doc_id", "ids", "run_ids", "text"]
    for r in out.collect():
        want = sp.encode(r["text"]) if r["text"] else []
        assert list(r["ids"]) == want and r["decoded"] == sp.decode(want), r["text"]


def test_chunk_table_stays_bounded(monkeypatch):
    _, sp = library()
    monkeypatch.setattr(pieces, "TABLE_CHUNKS", 40)
    monkeypatch.setattr(pieces, "LONG_CHUNK", 5)
    table = pieces.ChunkTable(pieces.Pieces(B_FILE))
    assert table.model.chunked
    for seed in range(30):
        texts = [*odd_texts(seed, 12), None, "y" * 20_000]
        ids, at = table.encode(texts)
        assert [ids[i:j].tolist() for i, j in zip(at, at[1:])] == [sp.encode(t or "") for t in texts]
        assert len(table.sizes) == len(table.row) and all(len(c) <= 5 for c in table.row)


def test_decode_of_any_ids(spark):
    _, sp = library()
    rng = random.Random(4)
    runs = [[rng.randrange(32_000) for _ in range(rng.randint(0, 9))] for _ in range(200)]
    runs += [[rng.randrange(3, 259) for _ in range(4)] for _ in range(100)] + [[0, 300], [1, 2], [28705, 28705], []]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(runs)] + [(-1, None), (-2, [264, None, 264])], "n int, ids array<int>")
    got = {r["n"]: r["decoded"] for r in pieces.decode_pieces(df, B_FILE, keep=["n"]).collect()}
    assert got.pop(-1) is None and got.pop(-2) == sp.decode([264, 264])
    assert got == {i: sp.decode(r) for i, r in enumerate(runs)}


def test_uncut_model(monkeypatch):
    _, sp = library()
    monkeypatch.setattr(pieces.Pieces, "_chunked", lambda self, names: False)
    table = pieces.ChunkTable(pieces.Pieces(B_FILE))
    texts = odd_texts(2, 40)
    ids, at = table.encode(texts)
    assert [ids[i:j].tolist() for i, j in zip(at, at[1:])] == [sp.encode(t) for t in texts]
    assert table.model.decode(ids, at) == [sp.decode(sp.encode(t)) for t in texts]


def test_pieces_empty(empty):
    assert pieces.decode_pieces(pieces.encode_pieces(empty, B_FILE), B_FILE).count() == 0


# ---------------------------------------------------------------- 11 alignment
def aligned(tok, sp, text, entries, letters):
    """(A ids, B ids, groups text, links) by the definition; None without tokens."""
    if not text:
        return None
    full = (" " + text).encode()
    a, b = tok.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
    bytes_a = [bytes(letters[c] for c in entries[i]) for i in a]
    bytes_b = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if b"".join(bytes_a) != full or b"".join(bytes_b) != full:
        return None
    ends_a, ends_b, groups, links = [], [], [], []
    for ends, parts in ((ends_a, bytes_a), (ends_b, bytes_b)):
        for p in parts:
            ends.append((ends[-1] if ends else 0) + len(p))
    i = j = 0
    for end in sorted(set(ends_a) & set(ends_b)):
        left, right = [], []
        while i < len(a) and ends_a[i] <= end:
            left.append(a[i])
            i += 1
        while j < len(b) and ends_b[j] <= end:
            right.append(b[j])
            j += 1
        groups.append(",".join(map(str, left)) + "|" + ",".join(map(str, right)))
        links.append((left[-1], right[-1]))
    return len(a), len(b), ";".join(groups), links


def test_alignment_equals_the_definition(spark, docs, monkeypatch):
    tok, sp = library()
    entries = {i: e for e, i in tok.get_vocab().items()}
    letters = alignment.byte_letters()
    table = texts_of(spark, docs, 7).withColumns({"N_A": F.lit("taken"), "groups": F.lit(1), "body": F.lit(2)})
    rows = table.select("doc_id", "text").collect()
    want = [aligned(tok, sp, r["text"], entries, letters) for r in rows]
    counts = Counter(p for w in want if w for p in w[3])
    highest = {}
    for (_, b), n in counts.items():
        highest[b] = max(highest.get(b, 0), n)
    lines = Counter()
    for r, w in zip(rows, want):
        n = (0, 0, 0, 0, 0, 0, "") if w is None else (
            w[0], w[1], len(w[3]), len(w[3]), sum(counts[p] == highest[p[1]] for p in w[3]), sum(counts[p] for p in w[3]), w[2])
        lines[(r["doc_id"], *n)] += 1
    got = alignment.align(table, A_FILE, B_FILE, keep=["doc_id", "N_A", "body"])
    assert got.columns == ["doc_id", "body", *alignment.COLUMNS, "groups"]
    assert Counter(map(tuple, got.drop("body").collect())) == lines
    digests = alignment.align(table, A_FILE, B_FILE, keep=["doc_id"], digest=True).select("doc_id", "groups")
    assert Counter(map(tuple, digests.collect())) == Counter(
        (r["doc_id"], hashlib.sha256(w[2].encode()).hexdigest() if w else "") for r, w in zip(rows, want))
    pairs = alignment.link_counts(alignment.aligned(table, A_FILE, B_FILE)).collect()
    assert {(r["a_id"], r["b_id"]): r["n"] for r in pairs} == counts
    assert len(counts) <= alignment.pair_bound(A_FILE, B_FILE) < 1_000_000


def test_alignment_table_stays_bounded(monkeypatch):
    tok, sp = library()
    entries = {i: e for e, i in tok.get_vocab().items()}
    letters = alignment.byte_letters()
    monkeypatch.setattr(alignment, "TABLE_CHUNKS", 60)
    monkeypatch.setattr(alignment, "LONG_CHUNK", 4)
    table = alignment.AlignTable(alignment.ByteLevel(A_FILE), pieces.Pieces(B_FILE))
    for seed in range(25):
        texts = [*odd_texts(seed, 20), None, "y" * 3000]
        at_rows, at = table.rows(texts)
        for k, t in enumerate(texts):
            rows = at_rows[at[k]:at[k + 1]]
            want = aligned(tok, sp, t, entries, letters) or (0, 0, "", [])
            assert table.cols[:, rows].sum(axis=1).tolist() == [want[0], want[1], len(want[3])], t
            assert ";".join(table.groups[r] for r in rows if table.groups[r]) == want[2]
            assert [(int(x) >> 32, int(x) & 0xFFFFFFFF) for x in table.links(rows)] == want[3]
        table.trim()
        assert len(table) == table.kept == len(table.row) == len(table.met) <= 60 and all(len(c) <= 4 for c in table.row)


def test_pointer_jumping_on_a_long_group():
    import numpy as np
    n = 5000  # A ends at odd places, B at even ones: one group until both end at 2n + 1
    ends_a = np.concatenate((np.arange(n) * 2 + 1, [2 * n + 1]))
    ends_b = np.concatenate((np.arange(n) * 2 + 2, [2 * n + 1]))
    ends_b.sort()
    label = alignment.terminals(alignment.successors(ends_a, ends_b))
    assert set(label.tolist()) == {len(ends_a) + len(ends_b) - 1}


def test_alignment_empty(empty):
    assert alignment.align(empty, A_FILE, B_FILE).count() == 0


# ---------------------------------------------------------------- 12 hard negatives
VECTORS = "vec_id long, embedding array<float>, label int, score string, id int, v int, is_anchor int, cluster int, no int"


def vectors(seed=3, n=400, dim=6):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        v = [rng.choice([-1.0, -0.5, 0.0, 0.25, 0.26, 0.5, 1.0]) * (1 if i % 3 else 0.01) for _ in range(dim)]
        rows.append((i, v, rng.randrange(4)))
    rows += [(1000 + i, rows[7][1], i % 2) for i in range(60)]  # copies
    rows += [(2000, [0.0] * dim, 1), (2010, [0.5] * (dim - 3), 2), (2020, [0.5] * (dim + 2), 2), (2030, [], 0), (2040, [3e7] * dim, 0),
             (2050, None, 1), (2060, [float("nan")] * dim, 1), (2070, [float("inf")] + [0.0] * (dim - 1), 1), (2080, [None] * dim, 1),
             (2090, [0.5] * dim, None), (None, [0.5] * dim, 1), (2100, [0.25] * dim, 77)]
    return [(*r, "s", 1, 2, 3, 4, 5) for r in rows + rows[10:13] + [rows[0]]]


def mined(rows, anchors, k=5, m=5):
    out = Counter()
    fit = [(i, [math.floor(256 * x) for x in v], l) for i, v, l, *_ in rows if i is not None and l is not None and v is not None
           and all(x is not None and math.isfinite(x) for x in v)]
    for i, v, l in fit:
        if not anchors(i):
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), j, other) for j, w, other in fit]
        for p, pid, _ in sorted(x for x in scored if x[2] == l and x[1] != i)[:k]:
            band = sorted(x for x in scored if x[2] != l and 80 * -p <= 100 * -x[0] <= 100 * -p)[:m]
            out.update((i, pid, rank + 1, nid, -p, -n) for rank, (n, nid, _) in enumerate(band))
    return out


def as_float32(rows):
    import struct
    one = lambda x: x if x is None else struct.unpack("f", struct.pack("f", x))[0]
    return [(r[0], None if r[1] is None else [one(x) for x in r[1]], *r[2:]) for r in rows]


def bag(df):
    return Counter((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"])
                   for r in df.collect())


@pytest.mark.parametrize("blocks", [False, True])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, blocks):
    if blocks:  # several passes, a split cluster, many blocks and steps
        for name, value in (("PASS_BYTES", 3000), ("STEP_ROWS", 4), ("FIT_ANCHORS", 9)):
            monkeypatch.setattr(hard_negatives, name, value)
    rows = as_float32(vectors())
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    every = 10 if not blocks else 25
    got = hard_negatives.hard_negatives(df, anchor=F.col("vec_id") % every == 0)
    assert bag(got) == mined(rows, lambda i: i % every == 0)


def test_walks_end_by_certificate():
    """Members stop well before the end of a list, with the right rows."""
    import numpy as np
    rng = np.random.default_rng(5)
    heads = rng.normal(size=(8, 16))
    near = np.floor(256 * (np.repeat(heads, 400, axis=0) + 0.03 * rng.normal(size=(3200, 16))))
    labels = np.arange(3200) % 2
    who = np.arange(0, 3200, 100)
    centre = hard_negatives.centres(near[who])
    cluster = np.argmax(hard_negatives.unit(near[who]) @ centre.T, axis=1)
    anchors = hard_negatives.Anchors(who, who, labels[who], near[who], cluster, centre)
    found, met = hard_negatives.Positives(anchors, 5), []
    plain = hard_negatives.products
    try:
        hard_negatives.products = lambda a, b: met.append(len(a) * len(b)) or plain(a, b)
        found.block(np.arange(3200), labels, near)
    finally:
        hard_negatives.products = plain
    assert sum(met) < 0.4 * len(who) * 3200
    score = (near[who] @ near.T).astype(int)
    for i, a in enumerate(who):
        best = sorted((-s, j) for j, s in enumerate(score[i]) if j != a and labels[j] == labels[a])[:5]
        assert [(-s, j) for s, j in zip(found.best.score[i], found.best.id[i])] == best


def test_scores_beyond_doubles():
    import numpy as np
    big = np.array([[2.0 ** 31 + 1, 3.0], [2.0 ** 31, 1.0], [2.0 ** 62, 2.0 ** 62]])
    got = hard_negatives.products(big, big)
    assert got[0, 0] == (2 ** 31 + 1) ** 2 + 9 and got[0, 1] == (2 ** 31 + 1) * 2 ** 31 + 3 and got[2, 2] == 2 ** 63 - 2


def test_hard_negatives_empty(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert hard_negatives.hard_negatives(empty, anchor=F.lit(True)).count() == 0
    some = spark.createDataFrame(vectors(), VECTORS)
    assert hard_negatives.hard_negatives(some, anchor=F.lit(None).cast("boolean")).count() == 0
