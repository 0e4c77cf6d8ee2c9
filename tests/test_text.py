"""Text column functions against hand-worked cases."""

from pyspark.sql import functions as F

from pairsmith.functions import text as T
from pairsmith.operators import linking


def one(spark, col, schema="s string", row=("x",)):
    return spark.createDataFrame([row], schema).select(col.alias("v")).first().v


def test_word_position_prefix_boundary(spark):
    df = spark.createDataFrame([("the dogs ran", "dog"), ("hotdog dog", "dog"), ("cat", "dog")], "s string, w string")
    got = [r.p for r in df.select(T.word_position("s", F.col("w")).alias("p")).collect()]
    assert got == [5, 8, 0]


def test_safe_replace_and_bold(spark):
    df = spark.createDataFrame([("the dogs ran", "dog")], "s string, w string")
    r = df.select(T.safe_replace("s", F.col("w"), F.lit("cat")).alias("a"),
                  T.make_bold("s", F.col("w")).alias("b")).first()
    assert r.a == "the cats ran" and r.b == "the **dog**s ran"


def test_fmt_marked_span(spark):
    df = spark.createDataFrame([("I saw the **Acme** shop",), ("**Acme** rocks",), ("THE **Acme** x",)], "s string")
    got = [r.f for r in df.select(T.fmt_marked_span("s").alias("f")).collect()]
    assert got == ["I saw {{{the Acme}}} shop", "{{{Acme}}} rocks", "THE }}}Acme** x"]


def test_spans(spark):
    df = spark.createDataFrame([("I live in Paris now", 10, 15)], "s string, a int, b int")
    r = df.select(T.highlight_span("s", "a", "b").alias("h"), T.placeholder_span("s", "a", "b").alias("p")).first()
    assert r.h == "I live in **Paris** now" and r.p == "I live in {{{location}}} now"


def test_singular(spark):
    words = ["dogs", "berries", "boxes", "glass", "process", "bus", "cats", "ties", "x1s", "Churches", "appletinis", "this", "analysis"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = [r.s for r in df.select(T.to_singular("w").alias("s")).collect()]
    assert got == ["dog", "berry", "box", "glass", "process", "bus", "cat", "tie", "x1s", "Church", "appletini", "this", "analysis"]


def test_rejoin_pieces(spark):
    df = spark.createDataFrame([(["bro", "##cco", "##li", "and"],)], "t array<string>")
    r = df.select(T.rejoin_pieces("t").alias("r")).first().r
    assert r.words == ["broccoli", "and"] and r.offsets == [0, 3]


def test_phrase_positions_skip(spark):
    df = spark.createDataFrame([("us us us a us".split(), ["us"])], "t array<string>, p array<string>")
    assert df.select(T.phrase_positions("t", "p").alias("x")).first().x == [0, 2, 4]


def test_synonym_positions(spark):
    toks = "i used to live in the u . s . a when the us won".split()
    syn = [p.split() for p in linking.COUNTRY_SYNONYMS["united states of america"]]
    df = spark.createDataFrame([(toks, syn)], "t array<string>, ph array<array<string>>")
    got = df.select(linking.synonym_hits("t", F.col("ph")).alias("x")).first().x
    assert got == [5, 12]


def test_cache_key(spark):
    import base64
    import hashlib
    df = spark.createDataFrame([("a b", "c")], "a string, b string")
    got = df.select(T.cache_key("a", "b", F.lit("color")).alias("k")).first().k
    h = lambda s: base64.b64encode(hashlib.md5(s.encode()).digest()).decode()
    assert got == "|".join([h("a b"), h("c"), "color"])


def test_replace_words_first_changing_pair(spark):
    df = spark.createDataFrame([("Acme is from Italy, italy!",)], "s string")
    pairs = [(F.lit("Nope"), F.lit("X")), (F.lit("ITALY"), F.lit("Spain")), (F.lit("Acme"), F.lit("Foo"))]
    assert df.select(T.replace_words("s", pairs).alias("r")).first().r == "Acme is from Spain, Spain!"
