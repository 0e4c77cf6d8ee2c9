"""Conflict removal, keep-first dedup, exact group split, checks."""

from pyspark.sql import functions as F

from pairsmith.operators import checks, dedup, filters, split


def _samples(spark):
    rows = [
        ("p1", "h1", "entailment", 1, "w1", 1),
        ("p1", "h1", "entailment", 2, "w2", 2),   # duplicate: keep seq 1
        ("p2", "h2", "neutral", 3, "w1", 3),
        ("p2", "h2", "contradiction", 4, "w3", 4),  # conflict: both copies go
        ("p3", "h3", "neutral", 5, "w3", 5),
        (None, "h4", "neutral", 6, "w2", 6),
        (None, "h4", "entailment", 7, "w2", 7),   # null key: never conflicting, deduped
    ]
    return spark.createDataFrame(rows, "premise string, hypothesis string, label string, row_id long, "
                                       "worker_id string, seq long")


def test_drop_conflicts_keep_first(spark):
    out = dedup.drop_conflicts_dedup(_samples(spark), order_by=["seq"])
    got = sorted(((r.premise, r.hypothesis, r.label, r.seq) for r in out.collect()), key=str)
    assert got == sorted([("p1", "h1", "entailment", 1), ("p3", "h3", "neutral", 5),
                          (None, "h4", "neutral", 6)], key=str)


def test_dedup_report(spark):
    r = dedup.dedup_report(_samples(spark)).first()
    assert (r.rows_before, r.rows_after, r.conflicting_pairs) == (7, 3, 1)


def test_same_result_any_partitioning(spark):
    df = _samples(spark)
    a = sorted(map(tuple, dedup.drop_conflicts_dedup(df.repartition(1), ["seq"]).collect()), key=str)
    b = sorted(map(tuple, dedup.drop_conflicts_dedup(df.repartition(7), ["seq"]).collect()), key=str)
    assert a == b


def test_exact_split_sizes_and_law(spark):
    df = spark.range(0, 5003).select(F.col("id").alias("g"), (F.col("id") % 3).alias("x"))
    df = df.union(df.where(F.col("g") < 100))          # some groups with two rows
    out = split.exact_group_split(df, "g", split.FRACTIONS_3WAY, split.SEED_3WAY)
    per = {r.split: r.n for r in out.select("g", "split").distinct().groupBy("split")
           .agg(F.count("*").alias("n")).collect()}
    n = 5003
    assert per["train"] == int(n * 0.8)
    assert per["dev"] == int(n * (0.8 + 0.1)) - int(n * 0.8)
    assert per["test"] == n - int(n * (0.8 + 0.1))
    law = checks.split_partition_law(out, "g").first()
    assert law.groups_in_many_parts == 0 and law.rows_unassigned == 0


def test_split_matches_global_rank(spark):
    df = spark.range(0, 2000).select(F.col("id").alias("g"))
    out = {r.g: r.split for r in split.exact_group_split(df, "g").collect()}
    keys = sorted(((r.k, r.g) for r in df.select(
        "g", split.seeded_order_key("g", split.SEED_3WAY).alias("k")).collect()))
    cut1, cut2 = split.cut_ranks(2000, split.FRACTIONS_3WAY)
    for i, (_, g) in enumerate(keys):
        want = "train" if i < cut1 else "dev" if i < cut2 else "test"
        assert out[g] == want


def test_seeded_rank_is_a_permutation(spark):
    df = spark.range(0, 3000).select(F.col("id").alias("k"))
    r = split.seeded_rank(df, "k", "s", "pos")
    assert sorted(x.pos for x in r.collect()) == list(range(3000))


def test_exclude_workers_guard(spark):
    df = _samples(spark)
    assert filters.exclude_workers(df, ["w3"]).where(F.col("worker_id") == "w3").count() == 0
    import pytest
    with pytest.raises(ValueError):
        filters.exclude_workers(df, ["w9"])          # not present
    with pytest.raises(ValueError):
        filters.exclude_workers(df, ["w1", "w2", "w3"])  # not a proper subset


def test_leak_values(spark):
    df = spark.createDataFrame([("a", "train"), ("a", "test"), ("b", "train")], "premise string, split string")
    got = [(r.value, r.parts) for r in checks.shared_values(df, ["premise"]).collect()]
    assert got == [("a", ["test", "train"])]


def test_split_refines_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(split, "RANK_ROWS", 3)          # force prefix refinement
    df = spark.range(0, 3000).select(F.col("id").alias("g"))
    out = {r.g: r.split for r in split.exact_group_split(df, "g").collect()}
    keys = sorted((r.k, r.g) for r in df.select("g", split.seeded_order_key("g", split.SEED_3WAY).alias("k")).collect())
    cut1, cut2 = split.cut_ranks(3000, split.FRACTIONS_3WAY)
    assert all(out[g] == ("train" if i < cut1 else "dev" if i < cut2 else "test") for i, (_, g) in enumerate(keys))


def test_exact_sample_nested(spark, monkeypatch):
    from pairsmith.operators import mixing
    monkeypatch.setattr(split, "RANK_ROWS", 5)
    df = spark.range(0, 2000).select(F.col("id").alias("seq"))
    r = mixing.nested_samples(df, [10, 100, 5000], "seq")
    sizes = {}
    for row in r.collect():
        sizes.setdefault(row.sample_size, set()).add(row.seq)
    assert len(sizes[10]) == 10 and len(sizes[100]) == 100 and len(sizes[5000]) == 2000
    assert sizes[10] <= sizes[100] <= sizes[5000]
