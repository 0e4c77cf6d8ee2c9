"""Column functions for sentence text (STR-01 .. STR-24).

Every function builds a Spark ``Column`` from built-in expressions: it runs in
the JVM with no Python per row (functions over arrays run interpreted there).
Where a query's DuckDB
oracle needs the same rule, a ``*_sql`` twin returns the SQL text.

Word characters are spelled out as ``[\\p{L}\\p{N}_]`` because Java's and
RE2's ``\\w``/``\\b`` disagree on non-ASCII text; both engines accept the
explicit class.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]"
NON_WORD = r"[^\p{L}\p{N}_]"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` as a lambda variable.

    Spark inlines projected columns into lambda bodies, where an index-based
    lambda would rebuild the whole array per element; binding it through a
    one-element ``transform`` keeps the array computed once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def quote_regex(word) -> Column:
    """``\\Q..\\E`` literal quoting that also survives a ``\\E`` in the word."""
    w = F.replace(_lit(word), F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
    return F.concat(F.lit("\\Q"), w, F.lit("\\E"))


# ---------------------------------------------------------------- STR-01..03
def _prefix_pattern(word) -> Column:
    # (?s) so '.' crosses newlines; group 1 = text before the match.  The word
    # must start at the string start or after a non-word character (a left
    # word boundary for words that begin with a word character).
    return F.concat(F.lit("(?s)^(|.*?" + NON_WORD + ")"), quote_regex(word))


def word_position(s, word) -> Column:
    """1-based start of the first occurrence of ``word`` at a left word
    boundary, with no right boundary (``dog`` matches ``dogs``); 0 when
    absent, null when either input is null."""
    s, pat = _c(s), _prefix_pattern(word)
    return F.when(F.regexp_like(s, pat),
                  F.length(F.call_function("regexp_extract", s, pat, F.lit(1))) + 1).otherwise(
        F.when(s.isNotNull() & _lit(word).isNotNull(), F.lit(0)))


def word_position_sql(s: str, word: str) -> str:
    pat = (f"'(?s)^(|.*?{NON_WORD})\\Q' || replace({word}, '\\E', '\\E\\\\E\\Q') || '\\E'")
    return (f"(CASE WHEN regexp_matches({s}, {pat}) THEN length(regexp_extract({s}, {pat}, 1)) + 1 "
            f"WHEN {s} IS NOT NULL AND {word} IS NOT NULL THEN 0 END)")


def safe_replace(s, old, new) -> Column:
    """Replace the first boundary match of ``old`` by ``new``; null when
    ``old`` is not found (the reference raises there)."""
    s = _c(s)
    pos = word_position(s, old)
    return F.when(pos > 0, F.overlay(s, _lit(new), pos, F.length(_lit(old))))


def safe_replace_sql(s: str, old: str, new: str) -> str:
    pos = word_position_sql(s, old)
    return (f"(CASE WHEN {pos} > 0 THEN substr({s}, 1, {pos} - 1) || {new} || "
            f"substr({s}, {pos} + length({old})) END)")


def make_bold(s, word) -> Column:
    """Wrap the first boundary match of ``word`` in ``**``; null if absent."""
    s = _c(s)
    pos = word_position(s, word)
    return F.when(pos > 0, F.overlay(s, F.concat(F.lit("**"), _lit(word), F.lit("**")),
                                     pos, F.length(_lit(word))))


# ---------------------------------------------------------------- STR-04
def replace_words(s, pairs: list[tuple[Column, Column]]) -> Column:
    """Apply ``(old, new)`` pairs in order, each as whole-word, case-blind,
    replace-all; stop at the first pair that changes the string."""
    s = _c(s)
    out = s
    for old, new in reversed(pairs):
        pat = F.concat(F.lit("(?iU)(?<!" + WORD + ")"), quote_regex(old), F.lit("(?!" + WORD + ")"))
        repl = F.regexp_replace(s, pat, F.replace(F.replace(_lit(new), F.lit("\\"), F.lit("\\\\")),
                                                 F.lit("$"), F.lit("\\$")))
        out = F.when(repl != s, repl).otherwise(out)
    return out


# ---------------------------------------------------------------- STR-05..08
def fmt_marked_span(s) -> Column:
    """``**x**`` -> ``{{{x}}}``, pulling a preceding ``the `` inside.

    The test for "the **" is case-blind but the rewrite only knows ``the`` and
    ``The``: for ``THE **`` only the first ``**`` (which is the opening one)
    becomes ``}}}``; kept as in the reference."""
    s = _c(s)
    has_the = F.instr(F.lower(s), "the **") > 0
    the_pos = F.regexp_instr(s, F.lit(r"[Tt]he \*\*"))
    opened_the = F.when(the_pos > 0, F.overlay(s, F.lit("{{{the "), the_pos, F.lit(6))).otherwise(s)
    sp = F.regexp_instr(s, F.lit(r" ?\*\*"))
    sp_len = F.when(F.substring(s, sp, 1) == " ", 3).otherwise(2)
    opened = F.when(sp > 0, F.overlay(s, F.lit(" {{{"), sp, sp_len)).otherwise(s)
    first = F.when(has_the, opened_the).otherwise(opened)
    close = F.instr(first, "**")
    closed = F.when(close > 0, F.overlay(first, F.lit("}}}"), close, F.lit(2))).otherwise(first)
    return F.trim(closed)


def highlight_span(s, start, end) -> Column:
    """``s[:a] + '**' + s[a:b] + '**' + s[b:]`` with 0-based ``a``, ``b``."""
    s, a, b = _c(s), _c(start), _c(end)
    return F.concat(F.substring(s, F.lit(1), a), F.lit("**"), F.substring(s, a + 1, b - a),
                    F.lit("**"), F.substring(s, b + 1, F.greatest(F.length(s) - b, F.lit(0))))


def placeholder_span(s, start, end, token: str = "{{{location}}}") -> Column:
    s, a, b = _c(s), _c(start), _c(end)
    return F.concat(F.substring(s, F.lit(1), a), F.lit(token),
                    F.substring(s, b + 1, F.greatest(F.length(s) - b, F.lit(0))))


def word_count(s) -> Column:
    """Number of ``\\w+`` runs (Unicode word characters)."""
    return F.size(F.regexp_extract_all(_c(s), F.lit(WORD + "+"), 0))


def tokens2(s) -> Column:
    """Tokens of two or more word characters (``\\b\\w\\w+\\b``)."""
    return F.regexp_extract_all(_c(s), F.lit(WORD + "{2,}"), 0)


# ---------------------------------------------------------------- STR-10/11
def capitalize_first(s) -> Column:
    s = _c(s)
    return F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, 2, F.greatest(F.length(s), F.lit(1))))


# Words that end like plurals but are singular (reference list).
FORCE_SINGULAR = (
    "process", "bedclothes", "address", "compass", "class", "business", "religious",
    "judiciousness", "attentiveness", "access", "cross", "abbess", "relatedness", "illness",
    "sameness", "resoluteness", "gas", "kindness", "orderliness", "trustworthiness",
    "activeness", "inattentiveness", "carelessness", "loss",
)

# Our suffix rules, tried in order (the reference's inflection library is absent).
SINGULAR_KEEP = r"(?i)(ss|us|sis)$"
# Our list: common words that end in s but are not plurals.
NOT_PLURAL = ("is", "this", "his", "was", "has", "does", "yes", "its", "thus", "plus", "always",
              "perhaps", "unless", "whereas", "besides", "gas", "lens", "news", "series", "species")
# Our list: plurals that no suffix rule gets right.
IRREGULAR = {
    "men": "man", "women": "woman", "children": "child", "people": "person", "feet": "foot", "teeth": "tooth",
    "geese": "goose", "mice": "mouse", "oxen": "ox", "knives": "knife", "wives": "wife", "lives": "life",
    "leaves": "leaf", "wolves": "wolf", "shelves": "shelf", "loaves": "loaf", "thieves": "thief", "halves": "half",
    "calves": "calf", "scarves": "scarf", "selves": "self", "elves": "elf", "hooves": "hoof", "movies": "movie",
    "cookies": "cookie", "pies": "pie", "ties": "tie", "lies": "lie", "dies": "die", "zombies": "zombie",
    "calories": "calorie", "rookies": "rookie", "brownies": "brownie", "buses": "bus", "gases": "gas",
    "lenses": "lens", "viruses": "virus", "bonuses": "bonus", "campuses": "campus", "statuses": "status",
    "choruses": "chorus", "quizzes": "quiz", "caches": "cache", "aches": "ache", "headaches": "headache",
    "niches": "niche", "avalanches": "avalanche", "axes": "axe", "shoes": "shoe", "toes": "toe", "canoes": "canoe",
    "foes": "foe", "hoes": "hoe", "crises": "crisis", "analyses": "analysis", "bases": "base", "theses": "thesis",
}
# A final "es" goes only where the singular cannot end in e; else the s alone goes.
SINGULAR_RULES = (
    (r"(?i)^.{2,}ies$", r"(?i)ies$", "y"),
    (r"(?i)(ss|x|zz|ch|sh|o)es$", r"(?i)es$", ""),
    (r"(?i)s$", r"(?i)s$", ""),
)


def to_singular(word) -> Column:
    """Singular of an alphabetic word; other strings pass unchanged.  Words of
    the irregular list come back in lower case."""
    w = _c(word)
    low = F.lower(w)
    known = F.create_map(*[F.lit(x) for kv in IRREGULAR.items() for x in kv])
    out = F.when(low.isin(list(IRREGULAR)), F.try_element_at(known, low))
    # every rule needs a final s: test that first, it settles most words cheaply
    out = out.when(~F.lower(F.substring(w, -1, 1)).eqNullSafe(F.lit("s")), w).when(
        ~w.rlike(r"^\p{L}+$") | w.isin(list(FORCE_SINGULAR)) | low.isin(list(NOT_PLURAL))
        | w.rlike(SINGULAR_KEEP), w)
    for test, pat, repl in SINGULAR_RULES:
        out = out.when(w.rlike(test), F.regexp_replace(w, pat, repl))
    return out.otherwise(w)


def to_singular_sql(w: str) -> str:
    forced = ", ".join(f"'{x}'" for x in FORCE_SINGULAR)
    notpl = ", ".join(f"'{x}'" for x in NOT_PLURAL)
    parts = [f"WHEN lower({w}) = '{p}' THEN '{q}'" for p, q in IRREGULAR.items()]
    parts += [f"WHEN NOT regexp_matches({w}, '^\\p{{L}}+$') OR {w} IN ({forced}) OR lower({w}) IN ({notpl}) "
             f"OR regexp_matches({w}, '{SINGULAR_KEEP}') THEN {w}"]
    for test, pat, repl in SINGULAR_RULES:
        parts.append(f"WHEN regexp_matches({w}, '{test}') THEN regexp_replace({w}, '{pat}', '{repl}')")
    return "(CASE " + " ".join(parts) + f" ELSE {w} END)"


# ---------------------------------------------------------------- STR-12..15
def rejoin_pieces(tokens) -> Column:
    """Rejoin word pieces (``##x`` continues the previous word).

    Returns ``struct(words array<string>, offsets array<int>)`` where
    ``offsets[i]`` is the 0-based index of the token that starts word ``i``.
    Linear in the token count: pieces are glued by one ``array_join`` with a
    separator before each word start, then split; a leading ``##`` piece
    starts a word as it is."""
    sep = "\u0001"

    def body(t):
        glued = F.array_join(F.transform(t, lambda x, i: F.when(i == 0, x)
                                         .when(F.startswith(x, F.lit("##")), F.substring(x, 3, 1 << 30))
                                         .otherwise(F.concat(F.lit(sep), x))), "")
        starts = F.filter(F.transform(t, lambda x, i: F.when((i == 0) | ~F.startswith(x, F.lit("##")), i)),
                          lambda v: v.isNotNull())
        return F.when(F.size(t) > 0, F.struct(F.split(glued, sep).alias("words"), starts.alias("offsets"))) \
            .otherwise(F.struct(F.array().cast("array<string>").alias("words"),
                                F.array().cast("array<int>").alias("offsets")))
    return let(_c(tokens), body)


def word_positions(tokens, word) -> Column:
    """All 0-based positions of ``word`` in ``tokens``, case-blind."""
    w = F.lower(_lit(word))
    return F.filter(F.transform(_c(tokens), lambda x, i: F.when(F.lower(x) == w, i)),
                    lambda v: v.isNotNull())


def phrase_positions(tokens, phrase_tokens) -> Column:
    """0-based starts of a token phrase in ``tokens``; after a hit the scan
    jumps ``len + 1`` tokens, so hits are at least ``len + 1`` apart."""
    def body(tp):
        t, p = tp["t"], tp["p"]
        n, m = F.size(t), F.size(p)
        cand = F.filter(F.transform(t, lambda x, i: F.when(
            (m > 0) & (x == F.get(p, F.lit(0))) & (F.slice(t, i + 1, m) == p), i)),
                        lambda v: v.isNotNull())
        return F.aggregate(cand, F.struct(F.array().cast("array<int>").alias("a"), F.lit(0).alias("nxt")),
                           lambda acc, i: F.when(i >= acc["nxt"], F.struct(
                               F.concat(acc["a"], F.array(i)).alias("a"), (i + m + 1).alias("nxt")))
                           .otherwise(acc))["a"]
    return let(F.struct(_c(tokens).alias("t"), _c(phrase_tokens).alias("p")), body)


# ---------------------------------------------------------------- STR-16..24
def cache_key(a, b, data_type) -> Column:
    """base64(md5(a)) | base64(md5(b)) | type."""
    def b64md5(x):
        return F.base64(F.unhex(F.md5(_c(x))))
    return F.concat_ws("|", b64md5(a), b64md5(b), _c(data_type))


def percent2(x) -> Column:
    """Percent with two decimals, half-even on the decimal text."""
    return F.bround(_c(x) * 100, 2)


def is_place_candidate(s) -> Column:
    """Alphabetic, no dot (country-list test done by a join)."""
    return _c(s).rlike(r"^\p{L}+$")
