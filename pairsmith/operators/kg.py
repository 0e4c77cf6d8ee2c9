"""Knowledge-graph look-ups on a triples snapshot (J-06 .. J-09, NLP-06, WIN-06).

The snapshot is a table ``(subject, subject_label, predicate, object,
object_label, rank)``; ``rank`` is the search order of a subject (smaller is
better).  Live graph queries of the reference become joins, closures and
ranked picks over it.  Every ranked pick uses a salted two-level top-k, so a
label shared by a third of all entities is still cut down map-side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import to_singular
from ..session import stage
from . import reach
from .common import lookup, top_k_per_key

TRIPLES_SCHEMA = ("subject string, subject_label string, predicate string, object string, "
                  "object_label string, rank bigint")

# Taxonomy class names never used as hypernyms (reference list).
EXCLUDED_CLASSES = (
    "object", "thing", "attribute", "abstraction", "entity", "object", "whole", "artifact",
    "physical_entity", "substance", "psychological_feature", "matter", "cognitive_state",
    "causal_agent", "living_thing", "event", "act", "being", "state",
)
# The colour value the graph returns for many items, dropped by a
# substring test; feature synonyms (shape round -> sphere).
COLOR_EXCLUDE = "color"
FEATURE_SYNONYMS = {("shape", "round"): "sphere"}
FEATURE_TYPES = ("color", "shape", "material")
SEARCH_LIMIT = 10


def write_snapshot(triples: DataFrame, path: str, files: int = 8) -> None:
    """Snapshot of triples: a folder per predicate, rows clustered by subject
    label, so a look-up reads its predicates only and skips row groups by label.
    ``files`` per predicate, by a hash of the label: a predicate with a third of
    all rows is several tasks' work."""
    span = F.pmod(F.xxhash64("subject_label"), F.lit(files))
    triples.repartition(F.col("predicate"), span).sortWithinPartitions("predicate", "subject_label", "rank", "subject", "object") \
        .write.partitionBy("predicate").parquet(path)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The triples of a snapshot (SRC-10); filters on ``predicate`` prune folders."""
    return spark.read.schema(TRIPLES_SCHEMA).parquet(path).select(*[f.split()[0] for f in TRIPLES_SCHEMA.split(", ")])


def closure(edges: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """All (node, ancestor) pairs; a node is its own ancestor only if a cycle
    leads back to it.

    Each round joins the newest pairs with all known ones, so path lengths
    double and a chain of depth d takes log2(d) rounds; pairs already known
    are dropped by an anti-join, so cycles end.  Rounds are staged in the
    shared folder.  No limit on rows, depth or rounds."""
    new = stage(edges.select(F.col(child).alias("node"), F.col(parent).alias("anc"))
                .where("node IS NOT NULL AND anc IS NOT NULL").distinct(), "closure")
    known = new
    while not new.isEmpty():
        step = new.withColumnRenamed("anc", "mid") \
            .join(known.select(F.col("node").alias("mid"), "anc"), "mid").select("node", "anc").distinct()
        new = stage(step.join(known, ["node", "anc"], "left_anti"), "closure")
        known = known.unionByName(new)
    return known


def sense_name(sense_col) -> F.Column:
    """Lemma part of a sense id ``lemma.pos.nn``."""
    return F.substring_index(sense_col, ".", 1)


def hypernym_table(lemmas: DataFrame, edges: DataFrame, pos: str = "n",
                   excluded: Sequence[str] = EXCLUDED_CLASSES) -> DataFrame:
    """(word, hyper) for every noun sense of ``word`` and every ancestor on
    any path, names cleaned: lemma before the first dot, no ``_``, not an
    excluded class; ``hyper`` is singular (NLP-06, STR-24)."""
    anc = closure(edges, "child_sense", "parent_sense")
    senses = lemmas.where(F.col("pos") == pos).select("lemma", "sense")
    name = sense_name(F.col("anc"))
    return (senses.join(anc, senses.sense == anc.node)
            .select(F.col("lemma").alias("word"), name.alias("hname"))
            .where(~F.col("hname").isin(list(excluded)) & ~F.col("hname").contains("_"))
            .select("word", to_singular(F.col("hname")).alias("hyper")).distinct())


def class_names(edges: DataFrame, excluded: Sequence[str] = EXCLUDED_CLASSES) -> DataFrame:
    """(node, hyper): the classes of a taxonomy that may be named as a
    hypernym, with their cleaned, singular name (STR-24)."""
    name = sense_name(F.col("node"))
    return edges.select(F.col("parent_sense").alias("node")).where("node IS NOT NULL").distinct() \
        .where(~name.isin(list(excluded)) & ~name.contains("_")).select("node", to_singular(name).alias("hyper"))


def hypernyms_of(words: DataFrame, lemmas: DataFrame, edges: DataFrame, pos: str = "n",
                 excluded: Sequence[str] = EXCLUDED_CLASSES) -> DataFrame:
    """The (word, hyper) rows of ``words`` that ``hypernym_table`` holds, by the
    reachability index: only pairs that are asked about are ever rows."""
    senses = lemmas.where(F.col("pos") == pos).select(F.col("lemma").alias("word"), "sense")
    asked = stage(words.select("word", "hyper").distinct().join(senses, "word").join(class_names(edges, excluded), "hyper")
                  .select("word", "hyper", "sense", "node"), "asked-hypernyms")
    index = reach.build(edges, "child_sense", "parent_sense")
    found = reach.reachable(index, asked, "sense", "node")
    return asked.join(found, (F.col("sense") == F.col("low")) & (F.col("node") == F.col("high"))).select("word", "hyper").distinct()


def _search(triples: DataFrame, predicate: str) -> DataFrame:
    return triples.where(F.col("predicate") == predicate).withColumn(
        "query", F.lower("subject_label"))


def entity_countries(triples: DataFrame, k: int = SEARCH_LIMIT) -> DataFrame:
    """Label -> set of country labels over its first ``k`` search hits (J-06).
    Labels lower-cased, as the reference's cache stores them."""
    hits = top_k_per_key(_search(triples, "country"), ["query"],
                         [F.col("rank"), F.col("subject"), F.col("object")], k)
    return hits.groupBy("query").agg(
        F.array_sort(F.collect_set(F.lower("object_label"))).alias("countries"))


def reached_states(triples: DataFrame, state_type: str) -> DataFrame:
    """(node, st, state_label): 'state'-typed nodes reached by located-in, zero
    steps included.  The closure runs over places only (nodes something is
    located in); every entity then takes one join on its direct place."""
    inside = triples.where(F.col("predicate") == "located_in").select(
        F.col("subject").alias("child"), F.col("object").alias("parent")).distinct()
    states = triples.where((F.col("predicate") == "instance_of") & (F.col("object") == state_type)) \
        .select(F.col("subject").alias("st"), F.col("subject_label").alias("state_label")).distinct()
    places = inside.select(F.col("parent").alias("place")).distinct()
    up = closure(inside.join(places, F.col("child") == F.col("place"), "left_semi"))
    above = places.select(F.col("place").alias("node"), F.col("place").alias("anc")).unionByName(up)
    seen = lookup(above.join(states, F.col("anc") == F.col("st")).select(F.col("node").alias("place"), "st", "state_label"))
    via = inside.join(seen, F.col("parent") == F.col("place")).select(F.col("child").alias("node"), "st", "state_label")
    return via.unionByName(states.select(F.col("st").alias("node"), "st", "state_label")).distinct()


def top_country(triples: DataFrame) -> DataFrame:
    """Label -> country of its first search hit (J-06, the location cache's
    look-up): rank, then subject and object, decide."""
    first = top_k_per_key(_search(triples, "country"), ["query"], [F.col("rank"), F.col("subject"), F.col("object")], 1)
    return first.select("query", F.lower("object_label").alias("country"))


def entity_states(triples: DataFrame, state_type: str = "state", k: int = SEARCH_LIMIT) -> DataFrame:
    """Label -> set of 'state' labels reached by located-in (J-07), first
    ``k`` hits by search rank."""
    hits = _search(triples, "country").select("subject", "query", "rank").distinct()
    reach = hits.join(reached_states(triples, state_type), hits.subject == F.col("node"))
    top = top_k_per_key(reach, ["query"], [F.col("rank"), F.col("subject"), F.col("st")], k)
    return top.groupBy("query").agg(F.array_sort(F.collect_set("state_label")).alias("states"))


def state_or_country(triples: DataFrame, us_label: str, state_type: str = "state",
                     k: int = SEARCH_LIMIT) -> DataFrame:
    """Label -> [state] if its first same-named hit is in ``us_label``'s
    country, else [country] (J-08).  Hits are the union of (entity, country,
    population) rows and (entity, country, population, state) rows, the
    ``k`` most populous kept.  A US hit with no state gives no answer."""
    pop = triples.where(F.col("predicate") == "population").select(
        "subject", F.col("object").cast("double").alias("population"))
    ctry = _search(triples, "country").select("subject", "query", "subject_label",
                                              F.col("object_label").alias("country"))
    base = ctry.join(pop, "subject")
    with_state = base.join(reached_states(triples, state_type), base.subject == F.col("node")) \
        .select(*base.columns, F.col("state_label").alias("state"))
    rows = base.withColumn("state", F.lit(None).cast("string")).unionByName(with_state)
    order = [F.col("population").desc(), F.col("subject"), F.col("state").asc_nulls_first()]
    top = top_k_per_key(rows, ["query"], order, k)
    picked = top.groupBy("query").agg(
        F.min_by(F.col("country"), F.when(F.lower("subject_label") == F.col("query"), F.col("rk")))
        .alias("country"),
        F.min_by(F.col("state"), F.when(F.col("state").isNotNull(), F.col("rk"))).alias("first_state"))
    ans = F.when(F.col("country") == us_label,
                 F.when(F.col("first_state").isNotNull(), F.array(F.lower("first_state")))
                 .otherwise(F.array().cast("array<string>"))) \
        .when(F.col("country").isNotNull(), F.array(F.lower("country"))) \
        .otherwise(F.array().cast("array<string>"))
    return picked.select("query", ans.alias("places"))


def noun_features(triples: DataFrame, k: int = SEARCH_LIMIT) -> DataFrame:
    """Noun -> feature lists by type over its first ``k`` hits (J-09):
    one row per (noun, feature_type, feature) with the colour exclusion and
    synonyms applied.  A noun with no features has no rows."""
    t = triples.where(F.col("predicate").isin(list(FEATURE_TYPES))).withColumn(
        "query", F.lower("subject_label"))
    top = top_k_per_key(t, ["query"], [F.col("rank"), F.col("subject"), F.col("predicate"),
                                        F.col("object")], k)
    # a colour is dropped when it is a substring of the excluded word
    top = top.where(~((F.col("predicate") == "color")
                      & (F.instr(F.lit(COLOR_EXCLUDE), F.col("object_label")) > 0)))
    syn = F.col("object_label")
    for (ft, a), b in FEATURE_SYNONYMS.items():
        syn = F.when((F.col("predicate") == ft) & (F.col("object_label") == a), F.lit(b)).otherwise(syn)
    return top.select(F.col("query").alias("noun"), F.col("predicate").alias("feature_type"),
                      syn.alias("feature")).distinct()
