"""Knowledge links between the two sentences of a pair (J-10 .. J-14,
AGG-09 .. AGG-11, NLP-01 .. NLP-07, STR-12/13/15).

Flow for every link type::

    pairs --tokens+tags (narrow)--> candidates of s1 --join KG--> (pair, subject, object)
          --positions in s1 / s2 (array functions)--> fold per (pair, object)

Every distinct sentence is annotated once; tags come from a plug-in over the
distinct words, or over whole sentences (``tagging``).  The annotated pairs are written once and all link types of
the registry read them.

Output rows: ``pair_id, data_type, object, subjects array<string>,
subject_ind array<int>, object_ind array<int>, feature_type``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, phrase_positions, to_singular, word_positions
from ..session import stage
from . import kg
from .common import lookup, spread
from .tagging import SentenceTagger

TOKEN_RE = r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"

# Country phrase synonyms, in the order they are tried.
COUNTRY_SYNONYMS = {
    "united states of america": [
        "united states of america", "the united states of america", "the united states",
        "united states", "us", "usa", "america", "the us", "the usa", "u . s .", "u . s",
        "the u . s .", "the u . s . a .", "the u . s . a", "u . s . a", "u . s . a ."],
    "united kingdom": [
        "kingdom of england", "england", "the united kingdom", "united kingdom", "uk", "u . k .",
        "the u . k .", "great britain", "britain"],
}

# Country -> adjective.
COUNTRY_ADJECTIVES = {
    "Albania": "Albanian", "Algeria": "Algerian", "Australia": "Australian", "Austria": "Austrian",
    "Belarus": "Belarusian", "Belgium": "Belgian", "Brazil": "Brazilian",
    "Burkina Faso": "Burkina Faso", "Canada": "Canadian", "China": "Chinese",
    "Croatia": "Croatian", "Czech Republic": "Czech", "Denmark": "Danish", "Finland": "Finnish",
    "France": "French", "Germany": "German", "Greece": "Greek", "Indonesia": "Indonesian",
    "Israel": "Israeli", "Italy": "Italian", "Japan": "Japanese", "Latvia": "Latvian",
    "Lithuania": "Lithuanian", "Malaysia": "Malaysian", "Mauritania": "Mauritanian",
    "Morocco": "Moroccan", "Netherlands": "Dutch", "Pakistan": "Pakistani", "Poland": "Polish",
    "Russia": "Russian", "Saudi Arabia": "Saudi Arabian", "Serbia": "Serbian",
    "Singapore": "Singaporean", "Slovakia": "Slovakian", "Slovenia": "Slovenian",
    "South Korea": "South Korean", "Spain": "Spanish", "Sweden": "Swedish",
    "Switzerland": "Swiss", "Taiwan": "Taiwanese", "Turkey": "Turkish", "Ukraine": "Ukrainian",
    "United Kingdom": "British", "United States of America": "American",
    "Venezuela": "Venezuelan", "Vietnam": "Vietnamese", "Zambia": "Zambian",
}

# Link names per data type (index stage).
LINK_NAMES = {"isa": "is a", "location": "located in", "trademark": "located in", "color": "color is"}

LINK_SCHEMA = ("pair_id bigint, data_type string, object string, subjects array<string>, "
               "subject_ind array<int>, object_ind array<int>, feature_type string")


# ------------------------------------------------------------------ tokens and tags
def tokens(s: Column) -> Column:
    """Words and single punctuation marks, case kept."""
    return F.regexp_extract_all(s, F.lit(TOKEN_RE), 0)


#: A word tagger takes the distinct lower-case words (column ``word``) and returns
#: (word, pos, ent) rows, at most one per word; words it leaves out are ``X``.
#: A ``SentenceTagger`` sees sentences: one word may have many tags.
Tagger = Callable[[DataFrame], DataFrame]


def lexicon_tagger(lexicon: DataFrame) -> Tagger:
    """Tagger from a (word, pos, ent) table (NLP-08)."""
    return lambda words: words.join(lexicon.select("word", "pos", "ent"), "word")


def sentence_id(s: Column) -> Column:
    """128-bit id of a sentence: what is shuffled in place of its text."""
    return F.unhex(F.md5(s))


def _annotated(sentences: DataFrame, tagger: Tagger | SentenceTagger) -> DataFrame:
    """(sid, ann) of (sid, s) rows, one per distinct sentence."""
    base = sentences.select("sid", tokens(F.col("s")).alias("t"), "s").where(F.size("t") > 0)
    ex = base.select("sid", F.posexplode(F.transform("t", lambda t: F.struct(
        t.alias("t"), F.startswith(F.col("s"), t).alias("head")))).alias("i", "x")) \
        .select("sid", "i", "x.t", F.lower("x.t").alias("word"), "x.head")
    words = ex.select("word").distinct()
    of_words = callable(tagger)
    tags = words.join(tagger(words), "word", "left") if of_words else words.select(
        "word", F.lit(None).cast("string").alias("pos"), F.lit(None).cast("string").alias("ent"))
    tags = lookup(tags.select("word", to_singular(F.col("word")).alias("g"), F.coalesce("pos", F.lit("X")).alias("pos"), "ent"))
    ann = ex.join(tags, "word").groupBy("sid").agg(F.sort_array(F.collect_list(F.struct(
        "i", "t", F.col("word").alias("l"), "g", "pos", "ent", "head"))).alias("ann"))
    if of_words:
        return ann
    seen = tagger.tag(base.select("sid", "t")).select("sid", F.col("pos").alias("__p"), F.col("ent").alias("__e"))
    own = F.transform("ann", lambda a, k: a.withField("pos", F.coalesce(F.get("__p", k), F.lit("X"))).withField("ent", F.get("__e", k)))
    return ann.join(seen, "sid", "left").select("sid", own.alias("ann"))


def annotate_sentences(sentences: DataFrame, tagger: Tagger | SentenceTagger) -> DataFrame:
    """(s, ann) per distinct sentence with a token (NLP-01): ``ann`` is an array
    of (t token, l lower case, g singular, pos, ent, head) in order, ``head``
    true where the sentence starts with the token.

    Singulars, and tags of a word tagger, are worked out once per distinct
    word, tags of a sentence tagger once per distinct sentence."""
    s = stage(sentences.select(F.col("s")).where(F.col("s").isNotNull()).groupBy(sentence_id(F.col("s")).alias("sid"))
              .agg(F.first("s").alias("s")), "sentences")
    return s.join(_annotated(s, tagger), "sid").select("s", "ann")


def annotate(pairs: DataFrame, tagger: Tagger | SentenceTagger | DataFrame) -> DataFrame:
    """(pair_id, t1, l1, g1, pos1, ent1, head1, t2, ...): annotated pairs, staged,
    so that any number of link types read one table.  ``tagger`` may be a
    lexicon table.  A sentence's text is shuffled once; then its id stands for it."""
    if isinstance(tagger, DataFrame):
        tagger = lexicon_tagger(tagger)
    pairs = stage(pairs.select("pair_id", "s1", "s2", *[sentence_id(F.col(f"s{k}")).alias(f"sid{k}") for k in (1, 2)]), "pairs")
    both = pairs.select(F.explode(F.array(*[F.struct(F.col(f"sid{k}").alias("sid"), F.col(f"s{k}").alias("s")) for k in (1, 2)]))
                        .alias("x")).select("x.*").where(F.col("s").isNotNull())
    ann = stage(_annotated(stage(both.groupBy("sid").agg(F.first("s").alias("s")), "sentences"), tagger), "annotated")
    out = pairs.select("pair_id", "sid1", "sid2")
    for k in (1, 2):
        out = out.join(ann.select(F.col("sid").alias(f"sid{k}"), F.col("ann").alias(f"a{k}")), f"sid{k}", "left")
    cols = [F.coalesce(F.col(f"a{k}.{f}"), F.array().cast(f"array<{'boolean' if f == 'head' else 'string'}>"))
            .alias(f"{f}{k}") for k in (1, 2) for f in ("t", "l", "g", "pos", "ent", "head")]
    return stage(out.select("pair_id", *cols), "annotated-pairs")


#: Link type -> function of the annotated pairs (UDF-04).
LINKERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_linker(name: str, build: Callable[[DataFrame], DataFrame]) -> None:
    """Add (or replace) a link type: ``build`` gets the annotated pairs and
    returns rows of ``LINK_SCHEMA``."""
    LINKERS[name] = build


def run_linkers(annotated: DataFrame, linkers: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
    """Union of all (or the given) link types over one annotated table (NLP-07)."""
    out = None
    for build in (LINKERS if linkers is None else linkers).values():
        rows = build(annotated)
        out = rows if out is None else out.unionByName(rows)
    return out


def _shift(arr: Column, by: int) -> Column:
    """Array of the neighbour ``by`` steps away (null past the ends)."""
    n = F.size(arr)
    pad = F.array(F.lit(None).cast("string"))
    if by > 0:
        return F.slice(F.concat(arr, pad), 2, n)
    return F.slice(F.concat(pad, arr), 1, n)


def isa_candidates(i: int) -> Column:
    """Singular nouns/proper nouns/adjectives, not capitalised mid-sentence
    (a capitalised token equal to the sentence's start is allowed)."""
    z = F.arrays_zip(F.col(f"t{i}").alias("t"), F.col(f"pos{i}").alias("p"), F.col(f"g{i}").alias("g"),
                     F.col(f"head{i}").alias("h"))
    keep = F.filter(z, lambda x: x["p"].isin("NOUN", "PROPN", "ADJ") & ~(
        F.substring(x["t"], 1, 1).rlike(r"\p{Lu}") & ~x["h"]))
    return F.array_distinct(F.transform(keep, lambda x: x["g"]))


#: Noun chunk as a pattern over tag letters: it begins at its determiners, or
#: after any other word, and its head is its last noun.
CHUNK_TAGS = {"DET": "D", "ADJ": "A", "NOUN": "N", "PROPN": "N"}


def np_heads(i: int) -> Column:
    """Heads of the noun chunks (singular, lower-case): the last noun of each
    maximal run of determiners, then adjectives and nouns (NLP-03), with no
    dash next to it.  A determiner behind a noun begins a new chunk; an
    adjective between nouns does not."""
    t, p = F.col(f"t{i}"), F.col(f"pos{i}")
    code = lambda x: F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in CHUNK_TAGS.items() for v in kv]), x), F.lit("x"))
    tags = F.array_join(F.transform(p, code), "")
    z = F.arrays_zip(t.alias("t"), F.col(f"g{i}").alias("g"), _shift(t, -1).alias("pt"), _shift(t, 1).alias("nt"))

    def heads(s):
        last = F.filter(F.transform(z, lambda x, k: F.struct(x.alias("x"), F.substr(s, k + 1).alias("s"))),
                        lambda y: y["s"].rlike("^N(?!A*N)"))
        return F.filter(F.transform(last, lambda y: y["x"]), lambda x: ~F.coalesce(x["pt"] == "-", F.lit(False))
                        & ~F.coalesce(x["nt"] == "-", F.lit(False)))
    return F.array_distinct(F.transform(let(tags, heads), lambda x: x["g"]))


def place_candidates(i: int) -> Column:
    """Place entities: alphabetic, no dot (lower-case)."""
    z = F.arrays_zip(F.col(f"t{i}").alias("t"), F.col(f"ent{i}").alias("e"), F.col(f"l{i}").alias("l"))
    keep = F.filter(z, lambda x: F.coalesce(x["e"].isin("GPE", "LOC", "ORG"), F.lit(False)) & x["t"].rlike(r"^\p{L}+$"))
    return F.array_distinct(F.transform(keep, lambda x: x["l"]))


def isa_words(ann: DataFrame) -> DataFrame:
    """(word, hyper): distinct candidate words of s1 with those of s2, the only
    pairs whose hypernymy decides a link."""
    both = ann.select(F.explode(isa_candidates(1)).alias("word"), isa_candidates(2).alias("n2"))
    return both.select("word", F.explode("n2").alias("hyper")).where("word <> hyper").distinct()


def capital_candidates(i: int) -> Column:
    z = F.arrays_zip(F.col(f"t{i}").alias("t"), F.col(f"pos{i}").alias("p"), F.col(f"l{i}").alias("l"))
    keep = F.filter(z, lambda x: x["p"].isin("PROPN", "NOUN", "X", "ADJ") & x["t"].rlike(r"\p{Lu}"))
    return F.array_distinct(F.transform(keep, lambda x: x["l"]))


# ------------------------------------------------------------------ positions
def phrase_hits(tok: str, phrase: Column) -> Column:
    """0-based starts of a token phrase, scan jumps ``len + 1`` after a hit."""
    return phrase_positions(tok, phrase)


def synonym_hits(tok: str, phrases: Column) -> Column:
    """Country positions with a synonym list (STR-15): at each position the
    first listed phrase that matches wins; after a hit the scan jumps its
    length + 1."""
    def body(tp):
        t, ph = tp["t"], tp["ph"]
        cand = F.filter(F.transform(t, lambda x, i: F.struct(
            i.alias("i"),
            F.size(F.try_element_at(F.filter(ph, lambda q: F.slice(t, i + 1, F.size(q)) == q), F.lit(1))).alias("m"))),
            lambda x: x["m"].isNotNull())
        return F.aggregate(cand, F.struct(F.array().cast("array<int>").alias("a"), F.lit(0).alias("nxt")),
                           lambda acc, x: F.when(x["i"] >= acc["nxt"], F.struct(
                               F.concat(acc["a"], F.array(x["i"])).alias("a"),
                               (x["i"] + x["m"] + 1).alias("nxt"))).otherwise(acc))["a"]
    return let(F.struct(F.col(tok).alias("t"), phrases.alias("ph")), body)


def country_positions(tok: str, country: Column, synonyms: Column) -> Column:
    """``synonyms``: array<array<string>> of the country's phrases (null when
    the country has none: then only single-token equality counts)."""
    return F.when(synonyms.isNotNull(), synonym_hits(tok, synonyms)).otherwise(
        word_positions(tok, country))


def first_words(country: Column, synonyms: Column) -> Column:
    """Words of which one stands wherever ``country_positions`` finds something:
    a cheap test before that search (null: an empty phrase, found everywhere)."""
    return F.when(synonyms.isNotNull(), F.transform(synonyms, lambda p: F.get(p, F.lit(0)))).otherwise(F.array(F.lower(country)))


def _if_held(tok: str, words: str, hits: Column) -> Column:
    """``hits`` if ``tok`` holds one of ``words``, else none: the test is part of the
    value, since a filter on the value may be moved in front of any other filter."""
    return F.when(F.coalesce(F.arrays_overlap(tok, words), F.lit(True)), hits).otherwise(F.array().cast("array<int>"))


# ------------------------------------------------------------------ fold
def fold_links(rows: DataFrame, data_type: str, dedupe_object_ind: bool = False) -> DataFrame:
    """(pair_id, object, subject, s_ind, o_ind, first, [feature_type]) ->
    one row per (pair, object): each subject once, repeated per its index,
    indices concatenated in subject order; object indices (and feature type)
    from the first subject (AGG-09).

    Rows are dealt out by pair once, for both groupings, to all tasks: they are
    few bytes each, so by bytes they would end in one."""
    ft = F.col("feature_type") if "feature_type" in rows.columns else F.lit(None).cast("string")
    per = spread(rows.select("pair_id", "object", "subject", "s_ind", "o_ind", "first", ft.alias("feature_type")), "pair_id")
    # a subject listed under several feature types counts once, under the first of them
    per = per.groupBy("pair_id", "object", "subject").agg(F.min(F.struct(
        "first", F.coalesce(F.array_position(F.array(*[F.lit(t) for t in kg.FEATURE_TYPES]), F.col("feature_type")),
                            F.lit(0)).alias("nth"), "feature_type", "s_ind", "o_ind")).alias("x")) \
        .select("pair_id", "object", "subject", "x.*")
    g = per.groupBy("pair_id", "object").agg(
        F.sort_array(F.collect_list(F.struct("first", "subject", "s_ind", "o_ind", "feature_type"))).alias("xs"))
    o_ind = F.element_at("xs", 1)["o_ind"]
    if dedupe_object_ind:
        o_ind = F.array_distinct(o_ind)
    return g.select(
        F.col("pair_id").cast("bigint").alias("pair_id"), F.lit(data_type).alias("data_type"), "object",
        F.flatten(F.transform("xs", lambda x: F.array_repeat(x["subject"], F.size(x["s_ind"])))).alias("subjects"),
        F.flatten(F.transform("xs", lambda x: x["s_ind"])).alias("subject_ind"),
        o_ind.alias("object_ind"),
        F.element_at("xs", 1)["feature_type"].alias("feature_type"))


def _explode_cands(df: DataFrame, arr: Column, name: str) -> DataFrame:
    return df.select("*", F.explode(arr).alias(name))


# ------------------------------------------------------------------ link joins
def link_isa(ann: DataFrame, hypernyms: DataFrame, filter_repeat: bool = True) -> DataFrame:
    """Word of s1 whose hypernym is a noun of s2 (J-10, J-14)."""
    base = ann.select("pair_id", "l1", "g1", "g2", isa_candidates(1).alias("n1"), isa_candidates(2).alias("n2"))
    c = _explode_cands(base, F.col("n1"), "subject")
    j = c.join(hypernyms, c.subject == hypernyms.word).drop("word")
    j = j.where(F.array_contains("n2", F.col("hyper")))
    if filter_repeat:
        j = j.where(~F.array_contains("n1", F.col("hyper")) & ~F.array_contains("n2", F.col("subject")))
    rows = j.select("pair_id", F.col("hyper").alias("object"), "subject",
                    word_positions("g1", F.col("subject")).alias("s_ind"),
                    word_positions("g2", F.col("hyper")).alias("o_ind"))
    rows = rows.withColumn("first", F.coalesce(F.try_element_at("s_ind", F.lit(1)), F.lit(1 << 30)))
    return fold_links(rows, "isa")


def link_location(ann: DataFrame, places: DataFrame, countries: DataFrame | Sequence[str], synonyms: DataFrame) -> DataFrame:
    """Place in s1, its state/country phrase in s2 (J-11).  ``countries``:
    lower-case country names (a table with column ``name``, or a short list),
    which are no places to link."""
    if not isinstance(countries, DataFrame):
        countries = ann.sparkSession.createDataFrame([(c,) for c in countries], "name string")
    base = ann.select("pair_id", "l1", "l2", place_candidates(1).alias("c1"))
    c = _explode_cands(base, F.col("c1"), "subject")
    c = c.join(lookup(countries.select(F.col("name").alias("__c")).distinct()), F.col("subject") == F.col("__c"), "left_anti")
    named = places.select("query", F.explode("places").alias("object"))
    named = named.join(synonyms.withColumnRenamed("country", "object"), "object", "left")
    named = lookup(named.select("query", "object", "phrases", first_words(F.col("object"), F.col("phrases")).alias("__any")))
    j = c.join(named, c.subject == named.query)
    rows = j.select("pair_id", "object", "subject",
                    word_positions("l1", F.col("subject")).alias("s_ind"),
                    _if_held("l2", "__any", country_positions("l2", F.col("object"), F.col("phrases"))).alias("o_ind"))
    rows = rows.where((F.size("s_ind") > 0) & (F.size("o_ind") > 0))
    rows = rows.withColumn("first", F.try_element_at("s_ind", F.lit(1)))
    return fold_links(rows, "location")


def link_trademark(ann: DataFrame, countries: DataFrame, adjectives: DataFrame, synonyms: DataFrame,
                   reference_compat: bool = False) -> DataFrame:
    """Capitalised word in s1, its country or the country's adjective in s2
    (J-13).  ``reference_compat``: only the first letter is capitalised for
    the adjective look-up, and a missing adjective searches the name twice."""
    base = ann.select("pair_id", "l1", "l2", capital_candidates(1).alias("c1"))
    c = _explode_cands(base, F.col("c1"), "subject")
    # all that a country's search needs is put beside it before the pairs come
    k = countries.select("query", F.explode("countries").alias("object"))
    if reference_compat:
        cap = F.concat(F.upper(F.substring("object", 1, 1)), F.substring("object", 2, 1 << 30))
    else:
        cap = F.initcap("object")
    adj = adjectives.select(F.col("country").alias("__cap"), F.lower("adjective").alias("__adj"))
    k = k.withColumn("__cap", cap).join(adj, "__cap", "left")
    adj_word = F.coalesce(F.col("__adj"), F.col("object")) if reference_compat else F.col("__adj")
    syn = synonyms.select(F.col("country").alias("object"), F.col("phrases"))
    syn2 = synonyms.select(F.col("country").alias("__adjkey"), F.col("phrases").alias("phrases2"))
    k = k.join(syn, "object", "left").withColumn("__adjkey", adj_word).join(syn2, "__adjkey", "left")
    first = F.concat(first_words(F.col("object"), F.col("phrases")), F.when(
        adj_word.isNotNull(), first_words(adj_word, F.col("phrases2"))).otherwise(F.array().cast("array<string>")))
    k = lookup(k.select("query", "object", "__adj", "phrases", "phrases2", first.alias("__any")))
    j = c.join(k, c.subject == k.query)
    name_hits = country_positions("l2", F.col("object"), F.col("phrases"))
    adj_hits = F.when(adj_word.isNotNull(), country_positions("l2", adj_word, F.col("phrases2"))) \
        .otherwise(F.array().cast("array<int>"))
    o_ind = F.concat(name_hits, adj_hits)
    if not reference_compat:
        o_ind = F.array_distinct(o_ind)
    rows = j.select("pair_id", "object", "subject", word_positions("l1", F.col("subject")).alias("s_ind"),
                    _if_held("l2", "__any", o_ind).alias("o_ind"))
    rows = rows.where((F.size("s_ind") > 0) & (F.size("o_ind") > 0))
    rows = rows.withColumn("first", F.try_element_at("s_ind", F.lit(1)))
    return fold_links(rows, "trademark")


def link_color(ann: DataFrame, features: DataFrame) -> DataFrame:
    """Noun-phrase head of s1, its colour/shape/material phrase in s2
    (J-12).  Nouns with more than one colour give no colour row."""
    base = ann.select("pair_id", "g1", "l2", np_heads(1).alias("h1"))
    c = _explode_cands(base, F.col("h1"), "subject")
    ncol = features.where(F.col("feature_type") == "color").groupBy("noun").agg(
        F.count(F.lit(1)).alias("__ncolors"))
    f = features.join(ncol, "noun", "left").where(
        (F.col("feature_type") != "color") | (F.coalesce("__ncolors", F.lit(0)) <= 1)).drop("__ncolors")
    # staged: of unknown size, it is streamed past a broadcast of all pairs, or both are shuffled by noun
    f = lookup(f.withColumn("__any", F.slice(F.split("feature", " "), 1, 1)))
    j = c.join(f, c.subject == f.noun).drop("noun")
    rows = j.select("pair_id", F.col("feature").alias("object"), "subject", "feature_type",
                    word_positions("g1", F.col("subject")).alias("s_ind"),
                    _if_held("l2", "__any", phrase_hits("l2", F.split(F.col("feature"), " "))).alias("o_ind"))
    rows = rows.where((F.size("s_ind") > 0) & (F.size("o_ind") > 0))
    rows = rows.withColumn("first", F.try_element_at("s_ind", F.lit(1)))
    return fold_links(rows, "color")


# ------------------------------------------------------------------ index stage
def index_names(links: DataFrame, offsets: DataFrame) -> DataFrame:
    """Piece index of s1 -> list of link names (AGG-10).  Colour links of
    other feature types are skipped; names in object order."""
    names = F.create_map(*[x for k, v in LINK_NAMES.items() for x in (F.lit(k), F.lit(v))])
    l = links.where((F.col("data_type") != "color") | (F.col("feature_type") == "color"))
    ex = l.select("pair_id", "data_type", "object", F.posexplode("subject_ind").alias("k", "idx"))
    ex = ex.join(offsets, "pair_id").withColumn("piece", F.element_at("offsets_a", F.col("idx") + 1))
    return ex.groupBy("pair_id", "data_type", "piece").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("object", "k"))),
                    lambda x: F.concat(F.element_at(names, F.col("data_type")), F.lit(" "), x["object"]))
        .alias("links"))


def index_sets(links: DataFrame, offsets: DataFrame) -> DataFrame:
    """Sets of linked piece indices on both sides (AGG-11)."""
    l = links.where((F.col("data_type") != "color") | (F.col("feature_type") == "color"))
    j = l.join(offsets, "pair_id")
    a = F.transform("subject_ind", lambda i: F.element_at("offsets_a", i + 1))
    b = F.transform("object_ind", lambda i: F.element_at("offsets_b", i + 1))
    return j.groupBy("pair_id", "data_type").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(a)))).alias("a_indices"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(b)))).alias("b_indices"))


def synonyms_table(spark, extra: dict[str, list[str]] | None = None) -> DataFrame:
    """(country, phrases array<array<string>>) from the fixed table plus
    binding-specific entries."""
    d = dict(COUNTRY_SYNONYMS)
    d.update(extra or {})
    rows = [(c, [p.split(" ") for p in ps]) for c, ps in d.items()]
    return spark.createDataFrame(rows, "country string, phrases array<array<string>>")


def adjectives_table(spark, extra: dict[str, str] | None = None) -> DataFrame:
    d = dict(COUNTRY_ADJECTIVES)
    d.update(extra or {})
    return spark.createDataFrame(sorted(d.items()), "country string, adjective string")


__all__ = ["annotate", "link_isa", "link_location", "link_trademark", "link_color", "fold_links",
           "index_names", "index_sets", "annotate_sentences", "lexicon_tagger", "register_linker", "run_linkers", "kg"]
