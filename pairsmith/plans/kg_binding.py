"""Knowledge-graph snapshot, lexicon, taxonomy and sentence pairs derived
from the driver tables (the reference's live graph and tagger are replaced
by tables that Spark builds from the data, so their size grows with it).

* places: every supplier is a town, ``Port`` + letters spelled from the last
  two digits of its key, so towns share names as the data grows; a town is
  in its supplier's nation, a nation in its region, regions are the
  "state"-typed nodes.  Nation 0 and 1 carry the two country names that have
  phrase synonyms, so the synonym rules are exercised.
* features: a part's item gets its adjective as colour / shape / material.
* taxonomy: item -> part type -> machine_part -> part -> object.
* lexicon: items, types and ``part`` are nouns, adjectives are ADJ, towns and
  nations proper nouns with a place entity tag.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import kg
from ..session import read_table, scratch_path

# Fixed values of this binding: feature predicate per part adjective, and the
# two nations named after countries with synonym lists.
FEATURE_OF = {"red": "color", "blue": "color", "small": "shape", "large": "shape",
              "old": "material", "new": "material"}
NAMED_NATIONS = {0: "United States of America", 1: "United Kingdom"}
US_LABEL = "United States of America"


def town(k: Column) -> Column:
    digits = F.lpad(F.pmod(k, F.lit(100)).cast("string"), 2, "0")
    return F.initcap(F.concat(F.lit("port"), F.translate(digits, "0123456789", "aeioubcdfg")))


def nation_label(nk: Column, name: Column) -> Column:
    out = F.initcap(name)
    for k, v in NAMED_NATIONS.items():
        out = F.when(nk == k, F.lit(v)).otherwise(out)
    return out


def _nations(spark, sf_dir):
    n = read_table(spark, sf_dir, "nation")
    r = read_table(spark, sf_dir, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(
        "n_nationkey", "n_regionkey", nation_label(F.col("n_nationkey"), F.col("n_name")).alias("nlabel"),
        F.initcap("r_name").alias("rlabel"))


def derived_triples(spark, sf_dir) -> DataFrame:
    s = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    n = _nations(spark, sf_dir)
    sup = s.join(n, s.s_nationkey == n.n_nationkey)
    S = F.concat(F.lit("S"), F.col("s_suppkey").cast("string"))
    N = F.concat(F.lit("N"), F.col("n_nationkey").cast("string"))
    R = F.concat(F.lit("R"), F.col("n_regionkey").cast("string"))
    t = town(F.col("s_suppkey"))

    def row(subj, label, pred, obj, olabel, rank):
        return F.struct(subj.alias("subject"), label.alias("subject_label"), F.lit(pred).alias("predicate"),
                        obj.alias("object"), olabel.alias("object_label"), rank.cast("bigint").alias("rank"))

    pop = F.round(F.col("s_acctbal") * 100).cast("bigint").cast("string")
    supplier_rows = sup.select(F.explode(F.array(
        row(S, t, "country", N, F.col("nlabel"), F.col("s_suppkey")),
        row(S, t, "located_in", N, F.col("nlabel"), F.col("s_suppkey")),
        row(S, t, "population", pop, F.lit(None).cast("string"), F.col("s_suppkey")),
    )).alias("r")).select("r.*")
    nation_rows = n.select(F.explode(F.array(
        row(N, F.col("nlabel"), "country", N, F.col("nlabel"), F.col("n_nationkey")),
        row(N, F.col("nlabel"), "located_in", R, F.col("rlabel"), F.col("n_nationkey")),
        row(N, F.col("nlabel"), "population", (F.col("n_nationkey") * 1000000).cast("string"),
            F.lit(None).cast("string"), F.col("n_nationkey")),
        row(N, F.col("nlabel"), "instance_of", F.lit("country"), F.lit("country"), F.col("n_nationkey")),
        row(R, F.col("rlabel"), "instance_of", F.lit("state"), F.lit("state"), F.col("n_regionkey")),
    )).alias("r")).select("r.*").distinct()
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name")
    adj = F.split_part("p_name", F.lit(" "), F.lit(1))
    item = F.split_part("p_name", F.lit(" "), F.lit(2))
    fmap = F.create_map(*[x for k, v in FEATURE_OF.items() for x in (F.lit(k), F.lit(v))])
    feat = part.select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("subject"),
                       item.alias("subject_label"), F.try_element_at(fmap, adj).alias("predicate"),
                       adj.alias("object"), adj.alias("object_label"),
                       F.col("p_partkey").cast("bigint").alias("rank")).where(F.col("predicate").isNotNull())
    return supplier_rows.unionByName(nation_rows).unionByName(feat)


def triples(spark, sf_dir) -> DataFrame:
    """The snapshot, written by predicate and read back: every look-up prunes to its predicates."""
    path = scratch_path(spark, "kg-snapshot")
    kg.write_snapshot(derived_triples(spark, sf_dir), path)
    return kg.read_snapshot(spark, path)


def taxonomy(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(lemmas(lemma, sense, pos), edges(child_sense, parent_sense))."""
    part = read_table(spark, sf_dir, "part").select("p_name", "p_type")
    item = F.split_part("p_name", F.lit(" "), F.lit(2))
    typ = F.lower("p_type")
    sense = lambda w: F.concat(w, F.lit(".n.01"))
    base = part.select(item.alias("item"), typ.alias("typ")).distinct()
    edges = base.select(sense(F.col("item")).alias("child_sense"), sense(F.col("typ")).alias("parent_sense"))
    fixed = [("machine_part.n.01", "part.n.01"), ("part.n.01", "object.n.01")]
    spark_fixed = spark.createDataFrame(fixed, "child_sense string, parent_sense string")
    type_up = base.select(sense(F.col("typ")).alias("child_sense"),
                          F.lit("machine_part.n.01").alias("parent_sense"))
    edges = edges.unionByName(type_up).unionByName(spark_fixed).distinct()
    words = base.select(F.col("item").alias("lemma")).unionByName(base.select(F.col("typ").alias("lemma"))) \
        .unionByName(spark.createDataFrame([("part",), ("object",)], "lemma string")).distinct()
    lemmas = words.select("lemma", sense(F.col("lemma")).alias("sense"), F.lit("n").alias("pos"))
    return lemmas, edges


def lexicon(spark, sf_dir) -> DataFrame:
    """(word, pos, ent): one tag per lower-case word; adjectives win over
    type nouns (``small``/``large`` are both)."""
    part = read_table(spark, sf_dir, "part").select("p_name", "p_type")
    adj = part.select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("word")).distinct() \
        .withColumn("pos", F.lit("ADJ")).withColumn("prio", F.lit(0))
    nouns = part.select(F.split_part("p_name", F.lit(" "), F.lit(2)).alias("word")) \
        .unionByName(part.select(F.lower("p_type").alias("word"))) \
        .unionByName(spark.createDataFrame([("part",)], "word string")).distinct() \
        .withColumn("pos", F.lit("NOUN")).withColumn("prio", F.lit(1))
    s = read_table(spark, sf_dir, "supplier").select(F.lower(town(F.col("s_suppkey"))).alias("word")).distinct()
    n = _nations(spark, sf_dir).select(F.lower("nlabel").alias("word"))
    places = s.unionByName(n).distinct().withColumn("pos", F.lit("PROPN")).withColumn("prio", F.lit(0))
    allw = adj.unionByName(nouns).unionByName(places)
    best = allw.groupBy("word").agg(F.min_by("pos", F.struct("prio", "pos")).alias("pos"))
    return best.withColumn("ent", F.when(F.col("pos") == "PROPN", F.lit("GPE")))


def country_names(spark, sf_dir) -> DataFrame:
    """Lower-case country names (the nations)."""
    return _nations(spark, sf_dir).select(F.lower("nlabel").alias("name"))


def pairs(spark, sf_dir) -> DataFrame:
    """Distinct sentence pairs from lineitem x part x supplier x nation."""
    li = read_table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_linenumber")
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    sup = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    n = _nations(spark, sf_dir)
    j = li.join(part, li.l_partkey == part.p_partkey).join(sup, li.l_suppkey == sup.s_suppkey) \
        .join(F.broadcast(n), F.col("s_nationkey") == n.n_nationkey)  # nation: 25 rows
    adj = F.split_part("p_name", F.lit(" "), F.lit(1))
    nadj = F.when(F.col("n_nationkey") == 0, F.lit("american")).when(F.col("n_nationkey") == 1, F.lit("british"))
    place = F.when(F.col("l_linenumber") % 4 == 0, F.lower("nlabel")) \
        .when(F.col("l_linenumber") % 4 == 1, F.lower("rlabel")) \
        .when(F.col("l_linenumber") % 4 == 2, F.coalesce(nadj, F.lower("nlabel"))) \
        .otherwise(F.lit("the us"))
    s1 = F.concat(F.lit("The "), F.col("p_name"), F.lit(" from "), town(F.col("l_suppkey")), F.lit(" was shipped ."))
    s2 = F.concat(F.lit("A "), F.lower("p_type"), F.lit(" part from "), place, F.lit(" is "), adj, F.lit(" ."))
    d = j.select(s1.alias("s1"), s2.alias("s2")).distinct()
    pid = F.conv(F.substring(F.md5(F.concat_ws("\u0001", "s1", "s2")), 1, 15), 16, 10).cast("bigint")
    return d.select(pid.alias("pair_id"), "s1", "s2")
