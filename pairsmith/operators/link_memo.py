"""Links kept across runs (NLP-07): finished pairs of sentences are not linked again.

A (sentence, sentence, link type) is stored under its cache key with all its
links, none included, so a killed run resumes with what is missing and a grown
corpus links only its new pairs.  Links depend on the texts alone: pairs with
equal texts share an entry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import cache_key
from ..session import stage
from ..streaming.store import KeyedStore
from .linking import LINKERS, Tagger, annotate, run_linkers
from .tagging import SentenceTagger

LINKS = "array<struct<object:string,subjects:array<string>,subject_ind:array<int>,object_ind:array<int>,feature_type:string>>"
STORED = f"cache_key string, links {LINKS}"


def resumed_links(pairs: DataFrame, tagger: Tagger | SentenceTagger | DataFrame, path: str,
                  linkers: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
    """Link rows of ``pairs`` (pair_id, s1, s2) for all link types given (or
    registered): stored ones as they are, the others worked out and stored.

    Pairs with a null sentence have no links and no entry.  ``tagger`` and
    look-up tables must be those of the earlier runs: the key does not hold them."""
    linkers = LINKERS if linkers is None else linkers
    spark = pairs.sparkSession
    store = KeyedStore(spark, path, "cache_key")
    whole = pairs.where(F.col("s1").isNotNull() & F.col("s2").isNotNull())
    # a cache key is its pair's part, then the type: rows are a pair's, not a type's, wherever they travel
    wanted = stage(whole.select("pair_id", "s1", "s2", cache_key("s1", "s2", F.lit("")).alias("part")), "wanted-links")
    types = F.array(*[F.lit(t) for t in linkers]).cast("array<string>")
    texts = wanted.groupBy("part").agg(F.min(F.struct("pair_id", "s1", "s2")).alias("p"))
    none = F.array().cast(f"array<struct<data_type:string,links:{LINKS}>>")
    paths = store.file_groups(wanted.select(F.explode(types).alias("t"), "part").select(F.concat("part", "t").alias("cache_key")))
    if paths:
        rows = _by_part(spark.read.schema(STORED).parquet(*paths)).where(F.col("data_type").isin(list(linkers)))
        known = rows.join(wanted.select("part").distinct(), "part", "left_semi") \
            .groupBy("part").agg(F.collect_list(F.struct("data_type", "links")).alias("known"))
        texts = texts.join(known, "part", "left").withColumn("known", F.coalesce("known", none))
    else:
        texts = texts.withColumn("known", none)
    texts = texts.withColumn("missing", F.array_except(types, F.col("known.data_type")))
    lack = F.size("missing") > 0
    have = stage(texts.select("part", "known", "missing", *[F.when(lack, F.col(f"p.{c}")).alias(c) for c in ("pair_id", "s1", "s2")]), "stored-links")
    todo = have.where(lack)
    links = have.select("part", F.explode("known").alias("k")).select("part", "k.*")
    if not todo.isEmpty():
        ann = annotate(todo.groupBy("pair_id").agg(F.first("s1").alias("s1"), F.first("s2").alias("s2")), tagger)
        found = run_linkers(ann, linkers).groupBy("pair_id").agg(F.sort_array(F.collect_list(F.struct(
            "data_type", "object", "subjects", "subject_ind", "object_ind", "feature_type"))).alias("found"))
        fresh = todo.select("part", "pair_id", "missing").join(found, "pair_id", "left") \
            .select("part", F.explode("missing").alias("data_type"), "found")
        of_type = F.transform(F.filter("found", lambda x: x["data_type"] == F.col("data_type")), lambda x: x.dropFields("data_type"))
        batch = store.add(fresh.select(F.concat("part", "data_type").alias("cache_key"),
                                       F.coalesce(of_type, F.array().cast(LINKS)).alias("links")))
        links = links.unionByName(_by_part(store.batch_rows(batch, STORED)))
    return wanted.select("pair_id", "part").join(links.where(F.size("links") > 0), "part") \
        .select("pair_id", "data_type", F.explode("links").alias("x")).select("pair_id", "data_type", "x.*")


def _by_part(rows: DataFrame) -> DataFrame:
    """(part, data_type, links) of stored rows: a key's type stands behind its second bar."""
    part = F.concat(F.substring_index("cache_key", "|", 2), F.lit("|"))
    return rows.select(part.alias("part"), F.expr("substring(cache_key, length(substring_index(cache_key, '|', 2)) + 2)").alias("data_type"), "links")
