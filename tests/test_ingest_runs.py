"""Row numbers at ingest, evaluation coverage, noun chunks, the snapshot reader."""

from pyspark.sql import functions as F

from pairsmith.operators import kg, linking, runs
from pairsmith.sources import readers


def test_row_numbers_over_files_and_splits(spark, tmp_path):
    n = 0
    for name, size in (("b.jsonl", 3000), ("a.jsonl", 700), ("c.jsonl", 0), ("d.jsonl", 1)):
        (tmp_path / name).write_text("".join('{"file_name": "%s", "k": %d, "pad": "%s"}\n' % (name, i, "x" * (i % 90)) for i in range(size)))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        df = spark.read.schema("file_name string, k int, pad string").json(str(tmp_path))
        assert df.rdd.getNumPartitions() > 8
        got = sorted((r["row_no"], r["file_name"], r["k"], r["file_idx"]) for r in readers.with_row_numbers(df).collect())
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    want = [("a.jsonl", i) for i in range(700)] + [("b.jsonl", i) for i in range(3000)] + [("d.jsonl", 0)]
    assert got == [(n, f, k, k) for n, (f, k) in enumerate(want)]
    (tmp_path / "none").mkdir()
    assert readers.with_row_numbers(spark.read.schema("k int").json(str(tmp_path / "none"))).count() == 0


def test_eval_coverage(spark):
    key = ("d1", "t", "2", "lr")
    trained = spark.createDataFrame([(*key, "done"), ("d2", "t", "2", "lr", "failed"), ("d3", "t", "2", "lr", "done")],
                                    "dataset_name string, trainset_name string, num_epochs string, lr string, status string")
    sets = spark.createDataFrame([("d1", "e1"), ("d1", "e2"), ("d1", "e3"), ("d1", "e1"), ("d2", "e1")], "dataset_name string, evalset_name string")
    name = "kb__{}__t__2__lr__eval__{}.log"
    lines = [(name.format("d1", "e1"), "allennlp.commands.evaluate - accuracy: 0.5"), (name.format("d1", "e2"), "started"),
             (name.format("d2", "e1"), "allennlp.commands.evaluate - accuracy: 0.5"), ("kb__d1__t__2__lr.log", "x"), ("bad.log", "x")]
    got = runs.eval_coverage(trained, sets, spark.createDataFrame(lines, "file string, line string")).collect()
    assert {(r["dataset_name"], r["evalset_name"]): r["eval_status"] for r in got} == {
        ("d1", "e1"): "done", ("d1", "e2"): "failed", ("d1", "e3"): "missing", ("d2", "e1"): "blocked"}
    assert len(got) == 4


def test_noun_chunk_heads(spark):
    def heads(*tagged):
        words, tags = zip(*tagged)
        df = spark.createDataFrame([(list(words), list(tags), list(words))], "t1 array<string>, pos1 array<string>, g1 array<string>")
        return df.select(linking.np_heads(1).alias("h")).first()["h"]
    d, a, n, v = "DET", "ADJ", "NOUN", "VERB"
    assert heads(("the", d), ("old", a), ("stone", n), ("bridge", n), ("fell", v)) == ["bridge"]
    assert heads(("stone", n), ("old", a), ("bridge", n)) == ["bridge"]  # one run, one head
    assert heads(("stone", n), ("the", d), ("bridge", n)) == ["stone", "bridge"]  # a determiner begins a run
    assert heads(("stone", n), ("old", a), ("fell", v), ("Rome", "PROPN"), ("red", a)) == ["stone", "Rome"]
    assert heads(("well", n), ("-", "X"), ("known", a), ("poet", n)) == ["poet"]
    assert heads(("fell", v), ("old", a)) == []


def test_snapshot_prunes_by_predicate(spark, tmp_path):
    rows = [(f"e{i}", f"Label {i % 5}", p, f"o{i}", f"O {i}", i) for i in range(40) for p in ("country", "located_in", "color")]
    rows += [("x", None, "color", None, None, None)]
    triples = spark.createDataFrame(rows, kg.TRIPLES_SCHEMA)
    kg.write_snapshot(triples, str(tmp_path / "kg"))
    back = kg.read_snapshot(spark, str(tmp_path / "kg"))
    assert back.columns == triples.columns and back.exceptAll(triples).count() == 0 and back.count() == len(rows)
    one = back.where(F.col("predicate") == "country")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(predicate" in plan and "(predicate#" in plan
    assert one.count() == 40 and kg.entity_countries(back).count() == kg.entity_countries(triples).count()
