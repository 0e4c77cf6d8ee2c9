"""One test per fault that the table-level oracles cannot show."""

import lzma

import pytest
from pyspark.sql import functions as F

from pairsmith.functions.text import to_singular
from pairsmith.operators import checks, datasets, split, swap
from pairsmith.sources import readers
from pairsmith.streaming import incremental

SINGULARS = {
    "horses": "horse", "houses": "house", "sizes": "size", "caches": "cache", "movies": "movie", "knives": "knife",
    "men": "man", "boxes": "box", "dishes": "dish", "churches": "church", "glasses": "glass", "cities": "city",
    "parties": "party", "cars": "car", "shoes": "shoe", "heroes": "hero", "potatoes": "potato", "roses": "rose",
    "nurses": "nurse", "prizes": "prize", "buzzes": "buzz", "buses": "bus", "lenses": "lens", "children": "child",
    "feet": "foot", "wolves": "wolf", "leaves": "leaf", "cookies": "cookie", "ties": "tie", "bus": "bus", "glass": "glass",
    "cat": "cat", "gas": "gas", "tables": "table", "keys": "key", "bridges": "bridge", "faces": "face", "waves": "wave",
    "x-rays": "x-rays", "r2s": "r2s",
}


def test_singular_hand_list(spark):
    df = spark.createDataFrame([(k,) for k in SINGULARS], "w string").select("w", to_singular(F.col("w")).alias("s"))
    assert {r["w"]: r["s"] for r in df.collect()} == SINGULARS


def test_resume_with_null_keys_and_ties(spark, tmp_path):
    p = str(tmp_path / "store")
    rows = spark.createDataFrame([(None, 1), (None, 0), ("a", 5), ("a", 4)], "k string, v int")
    for _ in range(3):
        got = incremental.resume_append(rows, p, ["k"])
    assert sorted((r["k"] or "", r["v"]) for r in got.collect()) == [("", 0), ("a", 4)]
    later = incremental.resume_append(rows, str(tmp_path / "other"), ["k"], order_by=[-F.col("v")])
    assert sorted((r["k"] or "", r["v"]) for r in later.collect()) == [("", 1), ("a", 5)]


def test_store_faults_are_raised(spark, tmp_path):
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "part.parquet").write_text("no parquet")
    with pytest.raises(Exception):
        incremental.resume_append(spark.createDataFrame([("a",)], "k string"), str(tmp_path / "bad"), ["k"])


def test_memo_computes_only_misses(spark, tmp_path):
    p, seen = str(tmp_path / "memo"), []

    def compute(keys):
        seen.append({r["k"] for r in keys.collect()})
        return keys.withColumn("v", F.lit(len(seen)))
    keys = lambda *ks: spark.createDataFrame([(k,) for k in ks], "k string")
    incremental.memo_lookup(keys("a", "b", "a"), p, "k", compute)
    got = incremental.memo_lookup(keys("b", "c", None), p, "k", compute)
    assert seen == [{"a", "b"}, {"c", None}]
    assert {(r["k"], r["v"]) for r in got.collect()} == {("b", 1), ("c", 2), (None, 2)}


def test_allowed_pairs_of_three_parts(spark):
    rows = [("x", p) for p in ("t1", "t2", "t3")] + [("y", p) for p in ("t1", "t2", "train")] + [("z", "t1")]
    df = spark.createDataFrame(rows, "w string, split string")
    allowed = [("t1", "t2"), ("t2", "t3"), ("t3", "t1")]
    assert [r["value"] for r in checks.shared_values(df, ["w"], skip_pairs=allowed).collect()] == ["y"]


def test_leak_words_are_normalised(spark):
    df = spark.createDataFrame([("Horses", "train"), ("horse", "dev"), ("cat", "dev")], "w string, split string")
    got = checks.shared_values(df, ["w"], normalise=lambda c: to_singular(F.lower(c))).collect()
    assert [r["value"] for r in got] == ["horse"]


def test_options_tell_null_from_empty(spark):
    rows = [(None, "c", "a", "o", "b"), ("", "c", "a", "o", "b")]
    schema = ", ".join(f"{f} string" for f in swap.OPTION_FIELDS)
    test = spark.createDataFrame(rows, schema)
    train = spark.createDataFrame([(f"k{i}", "c", "a", "o", "b") for i in range(2)], schema)
    got = swap.option_mapping(test, train).collect()
    assert sorted(r["pos"] for r in got) == [0, 1] and len({r["new_company"] for r in got}) == 2


def test_seeded_rank_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(split, "RANK_ROWS", 1)
    df = spark.range(3000).withColumn("k", F.col("id").cast("string"))
    got = split.seeded_rank(df, "k", "s").select("rank").collect()
    assert sorted(r[0] for r in got) == list(range(3000))


def test_registry_and_flattening(spark):
    df = spark.createDataFrame([("p", "h", "l", (1, "s1"))], "premise string, hypothesis string, label string, metadata struct<row_id:int,section:string>")
    assert datasets.flatten_metadata(df, ["section"]).columns == ["premise", "hypothesis", "label", "metadata", "section"]
    assert datasets.flatten_all_metadata(df.withColumn("row_id", F.lit(0))).first()["row_id"] == 1
    spec = datasets.DatasetSpec("t-one", lambda s, w: df, ("row_id", "section"))
    datasets.register_dataset(spec)
    assert datasets.dataset("t-one") is spec
    with pytest.raises(ValueError):
        datasets.register_dataset(spec)
    datasets._SPECS.pop("t-one")


def test_xz_readers(spark, tmp_path):
    (tmp_path / "a.json.xz").write_bytes(lzma.compress(b'[{"x": 1}, {"x": 2}]'))
    (tmp_path / "b.jsonl.xz").write_bytes(lzma.compress(b'{"x": 3}\n\n{"x": 4}\n'))
    for name, want in (("a.json.xz", [1, 2]), ("b.jsonl.xz", [3, 4])):
        got = readers.read_by_extension(spark, str(tmp_path / name), "x int")
        assert sorted(r["x"] for r in got.collect()) == want
