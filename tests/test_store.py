"""Keyed store: reads only what may hold a key; links resume from it."""

import pytest
from pyspark.sql import functions as F

from pairsmith.operators import link_memo, linking
from pairsmith.operators.link_memo import resumed_links
from pairsmith.streaming import incremental
from pairsmith.streaming.store import KeyedStore

SCHEMA = "k string, v long"


def rows(spark, lo, hi, extra=()):
    return spark.createDataFrame([(f"key{i}", i) for i in range(lo, hi)] + list(extra), SCHEMA)


def test_only_file_groups_with_a_key_are_read(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path / "s"), "k", buckets=16)
    assert store.stored(rows(spark, 0, 5), SCHEMA).count() == 0
    first = store.add(rows(spark, 0, 2000, [(None, -1), ("", -2)]))
    second = store.add(rows(spark, 2000, 4000))
    assert len(store.file_groups(rows(spark, 0, 4000))) == 32
    wanted = rows(spark, 100, 101)
    groups = store.file_groups(wanted)
    assert groups and all(f"batch={first}" in g for g in groups) and len(groups) <= 2
    got = store.stored(wanted, SCHEMA)
    read = {"/" + f.rsplit("/", 1)[0].split("file:")[-1].lstrip("/") for f in got.inputFiles()}
    assert read == {g.split("file:")[-1] for g in groups}
    assert [tuple(r) for r in got.collect()] == [("key100", 100)]
    assert second not in "".join(groups)
    odd = spark.createDataFrame([(None,), ("",), ("nothing",)], "k string")
    assert sorted(r["v"] for r in store.stored(odd, SCHEMA).collect()) == [-2, -1]
    assert [r["k"] for r in store.missing(odd, store.stored(odd, SCHEMA)).collect()] == ["nothing"]


def test_a_torn_batch_is_not_read(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path / "s"), "k", buckets=4)
    store.add(rows(spark, 0, 50))
    torn = store.add(rows(spark, 50, 100))
    bloom = tmp_path / "s" / "bloom" / f"batch={torn}"
    bloom.rename(tmp_path / "torn-bloom")  # as if the job had died before its filter was written
    everything = rows(spark, 0, 100)
    assert store.stored(everything, SCHEMA).count() == 50
    assert store.missing(everything, store.stored(everything, SCHEMA)).count() == 50
    store.add(rows(spark, 0, 0))
    assert store.stored(everything, SCHEMA).count() == 50


def test_memo_reads_few_files_for_few_keys(spark, tmp_path):
    seen = []

    def compute(misses):
        seen.append(misses)
        return misses.withColumn("v", F.length("k").cast("long"))
    path = str(tmp_path / "memo")
    incremental.memo_lookup(rows(spark, 0, 500), path, "k", compute)
    got = incremental.memo_lookup(rows(spark, 498, 503), path, "k", compute)
    assert sorted(r["k"] for r in got.collect()) == [f"key{i}" for i in range(498, 503)]
    assert sorted(r["k"] for r in seen[-1].collect()) == ["key500", "key501", "key502"]


@pytest.fixture()
def links(spark):
    calls = []

    def same(ann):
        calls.append(sorted(r["pair_id"] for r in ann.collect()))
        hit = ann.select("pair_id", F.explode(F.array_intersect("l1", "l2")).alias("object"))
        return hit.select("pair_id", F.lit("same").alias("data_type"), "object", F.array("object").alias("subjects"),
                          F.array(F.lit(0)).alias("subject_ind"), F.array(F.lit(1)).alias("object_ind"),
                          F.lit(None).cast("string").alias("feature_type"))

    def never(ann):
        return same(ann).where(F.lit(False)).withColumn("data_type", F.lit("never"))
    return calls, {"same": same, "never": never}


def test_links_resume(spark, tmp_path, links):
    calls, linkers = links
    lexicon = spark.createDataFrame([("a", "NOUN", None)], "word string, pos string, ent string")
    data = [(1, "a b", "b c"), (2, "a b", "b c"), (3, "x y", "z"), (4, None, "z"), (5, "q r", "r q"), (6, "a", "a")]
    pairs = spark.createDataFrame(data, "pair_id long, s1 string, s2 string")
    path = str(tmp_path / "links")
    half = resumed_links(pairs.where("pair_id in (1, 3)"), lexicon, path, linkers)
    assert {(r["pair_id"], r["object"]) for r in half.collect()} == {(1, "b")}
    calls.clear()
    whole = resumed_links(pairs, lexicon, path, linkers)
    want = {(1, "b"), (2, "b"), (5, "q"), (5, "r"), (6, "a")}
    assert {(r["pair_id"], r["object"]) for r in whole.collect()} == want
    assert all(c == [5, 6] for c in calls)  # pair 2 has the texts of pair 1; pair 3 is known to have no link
    calls.clear()
    again = resumed_links(pairs, lexicon, path, linkers)
    assert {(r["pair_id"], r["object"]) for r in again.collect()} == want and not calls
    fresh = linking.run_linkers(linking.annotate(pairs, lexicon), linkers)
    assert {(r["pair_id"], r["object"]) for r in fresh.collect()} == want


def test_a_lookup_does_not_shuffle_its_keys(spark, tmp_path, monkeypatch):
    store = KeyedStore(spark, str(tmp_path / "s"), "k", buckets=8, bits=256, hashes=3)
    first = store.add(rows(spark, 0, 30, [(None, -1)]))
    second = store.add(rows(spark, 30, 60))
    seen, collect = [], type(spark.range(1)).collect
    monkeypatch.setattr(type(spark.range(1)), "collect", lambda df: (seen.append(df._jdf.queryExecution().optimizedPlan().toString()), collect(df))[1])
    groups = store.file_groups(rows(spark, 0, 60, [(None, -1)]))
    monkeypatch.undo()
    assert {g.split("batch=")[1].split("/")[0] for g in groups} == {first, second}
    # the only grouping is that of the (batch, bucket) found
    assert len(seen) == 1 and seen[0].count("Aggregate [") == 1
    assert store.stored(rows(spark, 0, 60, [(None, -1)]), SCHEMA).count() == 61


def test_a_resumed_run_shuffles_pairs_not_types(spark, tmp_path, monkeypatch):
    """One row a pair in what is staged, however many types there are."""
    def kind(name):
        return lambda ann: ann.select("pair_id", F.lit(name).alias("data_type"), F.element_at("l2", 1).alias("object"), F.array(F.element_at("l1", 1)).alias("subjects"),
                                      F.array(F.lit(0)).alias("subject_ind"), F.array(F.lit(0)).alias("object_ind"), F.lit(None).cast("string").alias("feature_type"))
    lexicon = spark.createDataFrame([("a", "NOUN", None)], "word string, pos string, ent string")
    pairs = spark.createDataFrame([(1, "a b", "b c"), (2, "a b", "b c"), (3, "x y", "z"), (2, "a b", "b c")], "pair_id long, s1 string, s2 string")
    staged, some, path = [], {n: kind(n) for n in ("p", "q|r")}, str(tmp_path / "links")
    monkeypatch.setattr(link_memo, "stage", lambda df, name, f=link_memo.stage: (out := f(df, name), staged.append((name, out.count())))[0])
    resumed_links(pairs, lexicon, path, some)
    more = some | {n: kind(n) for n in ("s", "t")}  # a type added later is missing for every pair
    got = sorted((r["pair_id"], r["data_type"], r["object"]) for r in resumed_links(pairs, lexicon, path, more).collect())
    assert got == sorted((i, n, o) for n in more for i, o in ((1, "b"), (2, "b"), (2, "b"), (3, "z")))
    assert staged == [("wanted-links", 4), ("stored-links", 2)] * 2
