"""Location mining (AGG-05/06/19, FLT-05/06/07, J-03/04/20, WIN-04/05, EXP-10,
STR-06/07/10).

Mentions are runs of words that are gazetteer names, leftmost-longest inside a
text, with the name's entity types: a trie with failure links in every task for
a gazetteer of bounded size; of a larger one tasks hold the names as Arrow strings
and make a trie of those that the words at hand can begin; beyond that, a join with
the names' first words.

Random choices of the reference become seeded hashes: a pick from a list is an
equi-join on (group, ``hash(seed, id) mod size``) with the ranked list, and a
shuffle position is the rank by ``md5(seed/id)``; no list is ever one row.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WORD, highlight_span, let, placeholder_span
from ..session import stage
from .common import lookup, rank_in_group
from .split import seeded_rank
from .trie import TokenTrie

# Country -> chosen city for the tagging sheet (the reference's
# 'Dominican' entry holds 'Republic<TAB>Santiago', a slip; the intended pair
# 'Dominican Republic' -> 'Santiago' is used).
COUNTRY_TO_CITY = {
    "Albania": "Durres", "Argentina": "Salta", "Australia": "Sydney",
    "Dominican Republic": "Santiago", "England": "Liverpool", "Finland": "Turku",
    "France": "Lyon", "Germany": "Munich", "Greece": "Thessaloniki", "Guadeloupe": "Lamentin",
    "Indonesia": "Makassar", "India": "Mumbai", "Iraq": "Erbil", "Israel": "Haifa",
    "Japan": "Osaka", "Malaysia": "Malacca", "Martinique": "Ducos", "Nepal": "Pokhara",
    "Netherlands": "Rotterdam", "Nicaragua": "Leon", "Philippines": "Makati",
    "Portugal": "Porto", "Romania": "Oradea", "South Africa": "Durban", "Sweden": "Malmo",
    "United Kingdom": "Bristol", "United States": "Chicago", "Vietnam": "Dalat",
}
# Seeds, review labels, word types, sentence type names.
POOL_SEED = "location location location"
FINAL_SEED = "42"
OTHER_SEED = "locations!!"
SECTION2_LABELS = ("Neutral", "Contradiction")
SECTION2_WORD_TYPES = ("Country", "Location")
SENTENCE_TYPES = (("sentence1", "permise"), ("sentence2", "hypothesis"))
#: Bytes of names that tasks hold as a trie (about a hundred times that in a task's memory).
TRIE_BYTES = 4 << 20
#: Bytes of names that tasks hold as Arrow strings (some two and a half times that in a task's memory).
TABLE_BYTES = 64 << 20
#: Bytes of texts that a trie of the names at hand is made for, and counts that a task adds up before it hands them on.
TEXT_BYTES, COUNTS = 16 << 20, 1 << 18
#: Word places are summed in blocks of this many words.
BLOCK = 64


def pick_number(seed: str, key: Column) -> Column:
    """Seeded 32-bit number of a key: a 'random choice' is this modulo the list's size."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + "/"), key.cast("string"))), 1, 8), 16, 10).cast("bigint")


def ranked_names(df: DataFrame, group: str, name: str) -> DataFrame:
    """(group, name, idx, n): distinct names numbered by md5 in each group."""
    return rank_in_group(df.select(group, name).distinct(), group, F.md5(name), "idx", "n")


def dedup_gazetteer(country_cities: DataFrame) -> DataFrame:
    """(country, city) -> names seen once over all countries and cities kept
    (AGG-06): a country whose name repeats is dropped with all its cities,
    and a city whose name repeats is dropped.  Lower-cased."""
    cc = country_cities.select(F.lower("country").alias("country"), F.lower("city").alias("city"))
    names = cc.select(F.col("city").alias("name")).where(F.col("name").isNotNull()).unionAll(
        cc.select(F.col("country").alias("name")).distinct())
    # one count per (country, city list entry) as in the reference, countries once each
    counts = names.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    once = counts.where(F.col("n") == 1).select("name")
    kept_c = cc.join(once.withColumnRenamed("name", "country"), "country", "left_semi")
    kept = kept_c.join(once.withColumnRenamed("name", "city"), "city", "left_semi").select("country", "city")
    # a kept country whose cities all repeat stays, with no city (null)
    return kept_c.select("country").distinct().join(kept, "country", "left")


def _words(rows: DataFrame, keys: Sequence[str], text_col: str) -> DataFrame:
    """``keys`` and ``ws``: array of (w, s) - the words of a text in order
    with their 0-based char places.  Linear in the number of words: gaps and
    lengths are summed per block, then inside the block."""
    gaps = F.transform(F.split(F.col(text_col), WORD + "+", -1), lambda g: F.length(g))
    d = rows.select(*keys, F.regexp_extract_all(F.col(text_col), F.lit(WORD + "+"), 0).alias("w"), gaps.alias("g"))
    # chars from the start of one word to the start of the next: a gap and the word before it
    step = F.zip_with("g", F.concat(F.array(F.lit(0)), F.transform("w", lambda x: F.length(x))), lambda g, n: g + n)
    add = lambda a: F.aggregate(a, F.lit(0), lambda n, x: n + x)

    def starts(d):
        block = lambda k: F.floor(k / BLOCK).cast("int")
        sums = F.transform(F.sequence(F.lit(0), block(F.size(d))), lambda b: add(F.slice(d, b * BLOCK + 1, BLOCK)))
        before = lambda s: F.transform(s, lambda x, b: add(F.slice(s, F.lit(1), b)))
        return let(let(sums, before), lambda o: F.transform(d, lambda x, k: F.get(o, block(k)) + add(
            F.slice(d, block(k) * BLOCK + 1, k % BLOCK + 1))))

    return d.select(*keys, F.filter(F.zip_with("w", let(step, starts), lambda w, s: F.struct(w.alias("w"), s.alias("s"))),
                                    lambda x: x["w"].isNotNull()).alias("ws"))


MENTION = "struct<k:int,location:string,words:int,start_char:int,end_char:int,ents:array<string>>"


def name_table(names: DataFrame) -> DataFrame:
    """(first, n, location, p, ents), staged: a name's first word, number of
    words, words in a row, and the entity types it is listed under (sorted)."""
    ent = F.col("ent") if "ent" in names.columns else F.lit(None).cast("string")
    parts = F.regexp_extract_all(F.lower("name"), F.lit(WORD + "+"), 0)
    return lookup(names.select(parts.alias("p"), ent.alias("ent")).where(F.size("p") > 0).groupBy("p")
                  .agg(F.array_sort(F.collect_set("ent")).alias("ents"))
                  .select(F.col("p")[0].alias("first"), F.size("p").alias("n"), F.array_join("p", " ").alias("location"), "p", "ents"))


def _hits(known) -> Callable[[list[str]], list[tuple[int, int]]]:
    """Leftmost-longest hits; a text without the first word of a name of several
    words has the names of one word alone."""
    trie, several = TokenTrie(known), {name[0] for name in known if len(name) > 1}
    one = {name[0] for name in known if len(name) == 1}

    def hits(words: list[str]) -> list[tuple[int, int]]:
        if several.isdisjoint(words):
            return [(k, 1) for k, w in enumerate(words) if w in one]
        return trie.leftmost_longest(words)
    return hits


class _Names:
    """A name table in a task: one trie of all names, or (``whole`` not) a trie for
    each group of texts, of the names whose first word stands in one of them."""

    def __init__(self, table: DataFrame, whole: bool):
        rest = F.array_join(F.slice("p", 2, 1 << 30), " ").alias("rest")
        sink = pa.BufferOutputStream()
        found = table.select("first", rest, "ents").toArrow()
        with pa.ipc.new_stream(sink, found.schema) as to:
            to.write_table(found)
        self.sent, self.whole = table.sparkSession.sparkContext.broadcast(sink.getvalue().to_pybytes()), whole

    def over(self, batches: Iterator[pa.RecordBatch], find) -> Iterator:
        """(batch, hits, name -> (location, ents)) of batches whose last column is the text;
        ``hits`` finds the names in a list of words as a trie does."""
        names = pa.ipc.open_stream(self.sent.value).read_all()

        def trie(some):
            known = {(f, *r.split(" ")) if r else (f,): (f"{f} {r}" if r else f, e)
                     for f, r, e in zip(*(some[c].to_pylist() for c in ("first", "rest", "ents")))}
            return _hits(known), known
        if self.whole:
            whole = trie(names)
            yield from ((b, *whole) for b in batches)
            return
        for group in self._groups(batches):
            seen = set()
            for text in (x for b in group for x in b.column(b.num_columns - 1).to_pylist()):
                seen.update(find(text or ""))
            words = pa.array(list({w.lower() for w in seen}), names["first"].type)
            some = trie(names.filter(pc.is_in(names["first"], value_set=words)))
            yield from ((b, *some) for b in group)

    @staticmethod
    def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
        group, size = [], 0
        for b in batches:
            if group and size + b.nbytes > TEXT_BYTES:
                yield group
                group, size = [], 0
            group.append(b)
            size += b.nbytes
        if group:
            yield group


def _by_trie(rows: DataFrame, table: DataFrame, keys: Sequence[str], text_col: str, entity_types: Sequence[str] | None = None,
             whole: bool = True) -> DataFrame:
    """Mentions by one pass per text over a trie that tasks hold: nothing is shuffled."""
    sent, wanted = _Names(table, whole), None if entity_types is None else set(entity_types)
    slim = rows.select(*keys, F.col(text_col).cast("string").alias("__text"))
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1])
    fields = slim.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex
        word = regex.compile(WORD + "+")
        kinds = {"k": pa.int32(), "location": pa.string(), "words": pa.int32(), "start_char": pa.int32(), "end_char": pa.int32(),
                 "ents": pa.list_(pa.string())}
        for batch, find, known in sent.over(batches, word.findall):
            at, ends, cells = [], [0], []
            for i, text in enumerate(batch.column(len(fields)).to_pylist()):
                places = [(m.group().lower(), m.start(), m.end()) for m in word.finditer(text or "")]
                words = [w for w, _, _ in places]
                for k, n in find(words):
                    location, ents = known[tuple(words[k:k + n])]
                    if wanted is None or not wanted.isdisjoint(ents):
                        cells.append((k, location, n, places[k][1], places[k + n - 1][2], ents))
                if len(cells) > ends[-1]:
                    at.append(i)
                    ends.append(len(cells))
            some = batch.take(pa.array(at, pa.int64()))
            each = [pa.array(list(x), t) for x, t in zip(zip(*cells) if cells else [()] * len(kinds), kinds.values())]
            found = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(each, list(kinds)))
            yield pa.RecordBatch.from_arrays([*some.columns[:-1], found], [*fields, "m"])

    return slim.mapInArrow(run, f"{out}, m array<{MENTION}>")


def _count_by_trie(rows: DataFrame, table: DataFrame, text_col: str, entity_types: Sequence[str] | None, whole: bool = True) -> DataFrame:
    """(location, cnt) of each task's texts, added up there: places are not worked out."""
    sent, wanted = _Names(table, whole), None if entity_types is None else set(entity_types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex
        words_of, found = regex.compile(WORD + "+").findall, Counter()

        def sums():
            cells = list(found.items())
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in cells], pa.string()), pa.array([n for _, n in cells], pa.int64())],
                                              ["location", "cnt"])
        for batch, find, known in sent.over(batches, words_of):
            own = Counter()
            for text in batch.column(0).to_pylist():
                words = [w.lower() for w in words_of(text or "")]
                own.update([tuple(words[k:k + n]) for k, n in find(words)])
            for name, n in own.items():
                location, ents = known[name]
                if wanted is None or not wanted.isdisjoint(ents):
                    found[location] += n
            if len(found) > COUNTS:
                yield sums()
        yield sums()

    return rows.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "location string, cnt long")


def _by_join(rows: DataFrame, table: DataFrame, keys: Sequence[str], text_col: str) -> DataFrame:
    """Mentions by a join of the words with the names' first words, for any
    number of names: words travel alone, and only texts with a first word in
    them are met again to compare the words that follow."""
    word = F.posexplode(F.regexp_extract_all(F.lower(text_col), F.lit(WORD + "+"), 0)).alias("k", "__w")
    hit = rows.select(*keys, word).join(table, F.col("__w") == F.col("first"))
    each = hit.groupBy(*keys).agg(F.collect_list(F.struct("k", (-F.col("n")).alias("neg"), "n", "location", "p", "ents")).alias("__h"))
    each = each.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "__h")
    ws = _words(rows.select(*keys, F.col(text_col).alias("__text")), keys, "__text")
    on = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    both = ws.join(each, on).select(*keys, "ws", F.sort_array(F.filter("__h", lambda h: F.transform(
        F.slice("ws", h["k"] + 1, h["n"]), lambda x: F.lower(x["w"])) == h["p"])).alias("h"))

    def mention(h):
        end = F.get("ws", h["k"] + h["n"] - 1)
        return F.struct(h["k"].alias("k"), h["location"].alias("location"), h["n"].alias("words"),
                        F.get("ws", h["k"])["s"].alias("start_char"), (end["s"] + F.length(end["w"])).alias("end_char"),
                        h["ents"].alias("ents"))
    free = F.aggregate("h", F.struct(F.array().cast(f"array<{MENTION}>").alias("a"), F.lit(0).alias("next")),
                       lambda acc, h: F.when(h["k"] >= acc["next"], F.struct(
                           F.concat(acc["a"], F.array(mention(h))).alias("a"), (h["k"] + h["n"]).alias("next"))).otherwise(acc))["a"]
    kept = F.when(F.exists("h", lambda h: h["n"] > 1), free).otherwise(F.transform("h", mention))
    return both.select(*keys, kept.alias("m")).where(F.size("m") > 0)


def mentions(rows: DataFrame, names: DataFrame, keys: Sequence[str], text_col: str = "text",
             entity_types: Sequence[str] | None = None, trie_bytes: int = TRIE_BYTES, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """``keys`` and ``m``: the gazetteer mentions (NLP-04) of a text as an array
    of (k, location, words, start_char, end_char, ents), leftmost-longest,
    texts without one left out.  ``keys`` name each text (repeated rows with
    equal keys are one text to ``_by_join``, so keys should be distinct).

    ``names``: (name[, ent]), a name under any number of types.  All names are
    matched; ``entity_types`` then keeps the mentions of one of those types
    (FLT-07).  A name of several words matches them in a row whatever stands
    between.  Up to ``trie_bytes`` of names go to every task as a trie, up to
    ``table_bytes`` as strings that it makes tries of; more are joined by their
    first words (all, if ``trie_bytes`` is 0)."""
    table = name_table(names)
    size = table.agg(F.sum(F.octet_length("location"))).first()[0] or 0
    if size <= trie_bytes or trie_bytes and size <= table_bytes:
        return _by_trie(rows, table, keys, text_col, entity_types, size <= trie_bytes)
    found = _by_join(rows, table, keys, text_col)
    if entity_types is None:
        return found
    wanted = F.array(*[F.lit(t) for t in entity_types]) if entity_types else F.array().cast("array<string>")
    return found.select(*keys, F.filter("m", lambda x: F.arrays_overlap(x["ents"], wanted)).alias("m")).where(F.size("m") > 0)


def corpus_mentions(sentences: DataFrame, names: DataFrame, text_col: str = "text", id_col: str = "id",
                    entity_types: Sequence[str] | None = None, trie_bytes: int = TRIE_BYTES, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """Mention count per lower-cased location over a corpus (AGG-05)."""
    table = name_table(names)
    size = table.agg(F.sum(F.octet_length("location"))).first()[0] or 0
    if size <= trie_bytes or trie_bytes and size <= table_bytes:
        return _count_by_trie(sentences, table, text_col, entity_types, size <= trie_bytes).groupBy("location").agg(F.sum("cnt").alias("cnt"))
    found = mentions(sentences, names, [id_col], text_col, entity_types, trie_bytes, table_bytes)
    return found.select(F.explode("m.location").alias("location")).groupBy("location") \
        .agg(F.count(F.lit(1)).cast("bigint").alias("cnt"))


def sentence_rows(corpus: DataFrame, sample_id: str = "sample_id") -> DataFrame:
    """Corpus pair -> two sentence rows with their type (EXP-10)."""
    return corpus.select(sample_id, "genre", F.explode(F.array(*[
        F.struct(F.col(c).alias("sentence"), F.lit(t).alias("type")) for c, t in SENTENCE_TYPES])).alias("x")) \
        .select(sample_id, "genre", "x.sentence", "x.type")


def annotate_locations(rows: DataFrame, names: DataFrame, known: DataFrame,
                       entity_types: Sequence[str] | None = None) -> DataFrame:
    """Location annotation per sentence (AGG-19, FLT-07): number of
    mentions, mentions, char spans, known flags, word counts.  Sentences with
    no mention are dropped."""
    key = ["sample_id", "type"]
    found = mentions(rows, names, key, "sentence", entity_types)
    one = found.select(*key, F.posexplode("m").alias("i", "x"))
    sure = lookup(known.select(F.lower("name").alias("__k")).distinct())
    one = one.join(sure, F.col("x.location") == F.col("__k"), "left")
    g = one.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(
        "i", "x", F.col("__k").isNotNull().alias("known")))).alias("m"))
    g = g.join(rows.select(*key, "genre", "sentence"), key)
    return g.select(*key, "genre", "sentence", F.size("m").alias("num_locations"),
                    F.col("m.x.location").alias("locations"), F.col("m.x.start_char").alias("start_char"),
                    F.col("m.x.end_char").alias("end_char"), F.col("m.known").alias("known_location"),
                    F.col("m.x.words").alias("word_count"))


def sentence_pool(annotated: DataFrame, gaz: DataFrame, exclude_genre: str = "telephone",
                  seed: str = POOL_SEED) -> DataFrame:
    """Pool of single-place sentences with the place highlighted (FLT-05,
    J-03, WIN-05, STR-06, PRJ-07).  A country's sentence gets a random one of
    its cities by an equi-join on (country, number); a city's its country."""
    ok = annotated.where((F.col("num_locations") == 1) & F.forall("known_location", lambda x: x)
                         & (F.element_at("word_count", 1) == 1) & (F.col("genre") != exclude_genre))
    rid = F.concat(F.col("sample_id").cast("string"), F.lit("_"), F.substring("type", 1, 1))
    s, e = F.element_at("start_char", 1), F.element_at("end_char", 1)
    ok = ok.select(F.element_at("locations", 1).alias("loc"), F.col("sentence").alias("original_sentence"),
                   highlight_span(F.col("sentence"), s, e).alias("highlighted_sentence"), s.alias("start_char"),
                   e.alias("end_char"), rid.alias("id"))
    ranked = lookup(ranked_names(gaz.where(F.col("city").isNotNull()), "country", "city"))
    sizes = gaz.select(F.col("country").alias("loc"), F.lit(True).alias("is_country")).distinct() \
        .join(ranked.groupBy(F.col("country").alias("loc")).agg(F.max("n").alias("n")), "loc", "left")
    homes = ranked.select(F.col("city").alias("loc"), F.col("country").alias("c_of_city"))
    j = ok.join(sizes, "loc", "left").join(homes, "loc", "left")
    j = j.where(F.col("is_country").isNotNull() | F.col("c_of_city").isNotNull())
    j = j.withColumn("is_country", F.coalesce("is_country", F.lit(False)))
    j = j.withColumn("home", F.when(F.col("is_country"), F.col("loc")).otherwise(F.col("c_of_city"))) \
        .withColumn("idx", F.when(F.col("is_country") & (F.col("n") > 0), F.pmod(pick_number(seed, F.col("id")), F.col("n"))))
    picks = ranked.select(F.col("country").alias("home"), F.col("city").alias("picked"), F.col("idx").cast("bigint").alias("idx"))
    out = j.join(picks, ["home", "idx"], "left")
    return out.select("original_sentence", "highlighted_sentence", F.col("home").alias("country"),
                      F.when(F.col("is_country"), F.col("picked")).otherwise(F.col("loc")).alias("location"),
                      "is_country", "start_char", "end_char", "id")


def finalise_for_tagging(tagged: DataFrame, country_city: DataFrame, seed: str = FINAL_SEED,
                         other_seed: str = OTHER_SEED) -> DataFrame:
    """Tagging sheet (FLT-04, J-04, WIN-04, WIN-05, STR-07, STR-10): rows with
    ``can_be_entailed`` in {0, 1}, seeded order, title-cased country, its
    chosen city (a country missing from the map raises), another city picked
    from the rest (a number modulo n - 1, shifted past the own city), the
    place replaced by a placeholder, and alternating review labels by
    shuffled position."""
    rows = stage(tagged.where(F.col("can_be_entailed").isin(0, 1)).withColumn("country", F.initcap("country")), "tagged")
    cc = lookup(country_city.select(F.col("country").alias("__c"), F.col("city").alias("location")))
    missing = rows.join(cc, rows.country == F.col("__c"), "left_anti").limit(1).collect()
    if missing:
        raise KeyError(f"country not in the city map: {missing[0]['country']}")
    cities = lookup(ranked_names(cc.withColumn("all", F.lit(1)), "all", "location")).drop("all")
    j = rows.join(cc, rows.country == F.col("__c")).drop("__c").join(cities, "location")
    pick = F.when(F.col("n") > 1, F.pmod(pick_number(other_seed, F.col("id")), F.col("n") - 1))
    j = j.withColumn("pick", pick + (pick >= F.col("idx")).cast("int")).drop("idx", "n")
    j = j.join(cities.select(F.col("location").alias("other_location"), F.col("idx").cast("bigint").alias("pick")), "pick",
               "left").drop("pick")
    j = stage(j.withColumn("sentence", placeholder_span(F.col("sentence"), "start_char", "end_char")), "tagging")
    ranked = seeded_rank(j, "id", seed, "pos")
    return ranked.select(
        "id", "sentence", "can_be_entailed", "country", "start_char", "end_char", "location",
        "other_location",
        F.element_at(F.array(*[F.lit(x) for x in SECTION2_LABELS]), (F.col("pos") % 2 + 1).cast("int"))
        .alias("section2_label"),
        F.element_at(F.array(*[F.lit(x) for x in SECTION2_WORD_TYPES]),
                     (F.floor(F.col("pos") / 2) % 2 + 1).cast("int")).alias("section2_word_type"),
        "pos")


def valid_location_keys(df: DataFrame, key: str = "location") -> DataFrame:
    """Keys a look-up may be sent for: no double quote or question mark (FLT-06)."""
    return df.where(~F.col(key).rlike('["?]'))


def flag_countries(df: DataFrame, col: str, countries: DataFrame) -> DataFrame:
    """Case-blind membership in a table of country names (J-20)."""
    listed = lookup(countries.select(F.lower("name").alias("__c")).distinct())
    return df.join(listed, F.lower(F.col(col)) == F.col("__c"), "left") \
        .withColumn("is_country", F.col("__c").isNotNull()).drop("__c")


def location_cache(keys: DataFrame, countries: DataFrame, look_up: DataFrame, key: str = "location") -> DataFrame:
    """The location cache's flow: keys a look-up may be sent for, country names
    flagged, the others with the country of their first search hit
    (``look_up``: query, country)."""
    rows = flag_countries(valid_location_keys(keys, key), key, countries)
    found = look_up.select(F.col("query").alias("__q"), "country")
    return rows.join(found, (F.lower(F.col(key)) == F.col("__q")) & ~F.col("is_country"), "left").drop("__q")
