"""Secret scans with multipart credential linking, in DataFrame functions.

Base patterns report on their own.  Weak candidates - identifiers, secrets and
endpoints that mean little alone - are reported only when their complement
stands within ``SCOPE`` code points: a weak identifier needs a secret, a weak
secret an identifier, an endpoint both.  Base matches count as parts too.

The interval join runs over the parts of a document in order of place: for
existence in a scope the nearest part before and after decides, so every part
carries the greatest end before it and the least start after it of each role
(windows per document), and no pairs are listed.

Matches of a pattern are placed by the lengths of the text between them (code
points); documents without a match cost one scan per pattern.  Rows are
numbered in the staged table of matches, so null and repeated ids do no harm.
Null and empty texts have no matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, free_name, kept_columns, span_text, stage

SCOPE = 256

#: The base patterns, in the order that breaks ties.
ASSIGN = (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: Runs that long only: the same matches as HEX cut at 32, without listing the short ones.
HEX_LONG = r"[0-9a-f]{32,}"
ACCESS_LONG = r"AKIA[A-Z0-9]{12,}"

#: Weak parts.
WEAK_ID = (r"""(?i:access[_-]?key[_-]?id|client[_-]?id|app[_-]?id|account[_-]?id|username|login)["']?\x20*[:=]\x20*["']?"""
           r"""[A-Za-z0-9@._+-]{3,}|(?:ASIA|AIDA|AROA|AGPA)[A-Z0-9]{12,}""")
WEAK_SECRET = (r"""(?i:passphrase|passcode|pwd|private[_-]?key|client[_-]?key|access[_-]?key|credentials?)["']?\x20*[:=]\x20*"""
               r"""["']?[A-Za-z0-9+/_.=-]{6,}|[A-Za-z0-9+/_-]{24,}={0,2}""")
ENDPOINT = (r"""https?://[^\s"'<>]+|(?i:host|endpoint|server|base_?url|region)["']?\x20*[:=]\x20*["']?"""
            r"""[A-Za-z0-9][A-Za-z0-9.:/_-]{2,}""")
#: A bare run is a weak secret only if it mixes digits and both cases.
MIXED = r"^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z]).*$|[:=]"

KINDS = ("assign", "access", "hex", "id", "secret", "endpoint")


def _matches(text: Column, kind: int, pattern: str, ok) -> Column:
    """Array of (kind, nth, gap before, length, ok) for all matches."""
    both = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"),
                        F.regexp_extract_all(text, F.lit(pattern), F.lit(1 if kind == 0 else 0)).alias("value"))
    rows = F.transform(F.filter(both, lambda z: z["hit"].isNotNull()), lambda z, i: F.struct(
        F.lit(kind).alias("kind"), i.alias("nth"), F.length(z["gap"]).alias("gap"), F.length(z["hit"]).alias("len"),
        ok(z).alias("ok")))
    return F.when(text.rlike(pattern), rows).otherwise(
        F.array().cast("array<struct<kind:int,nth:int,gap:int,len:int,ok:boolean>>"))


def found_parts(docs: DataFrame, text: str, keep: list[str], row_no: str) -> DataFrame:
    """``keep`` columns, a row number and the matches, staged: texts are read once."""
    t = col(text).cast("string")
    yes = lambda z: F.lit(True)
    parts = F.concat(
        _matches(t, 0, ASSIGN, lambda z: F.length(z["value"]) >= 8),
        _matches(t, 1, ACCESS_LONG, yes), _matches(t, 2, HEX_LONG, yes), _matches(t, 3, WEAK_ID, yes),
        _matches(t, 4, WEAK_SECRET, lambda z: z["hit"].rlike(MIXED)), _matches(t, 5, ENDPOINT, yes))
    return stage(docs.select(*[col(c) for c in keep], F.monotonically_increasing_id().alias(row_no),
                             parts.alias("parts")), "secret-parts")


def linked_parts(found: DataFrame, row_no: str, scope: int = SCOPE) -> DataFrame:
    """(row, kind, start, end, reported, id_near, secret_near, endpoint_near):
    every part that passes its own test, with the nearest parts in scope."""
    rows = found.where(F.size("parts") > 0).select(col(row_no).alias("row"), F.inline("parts"))
    run = Window.partitionBy("row", "kind").orderBy("nth")
    end = F.sum(F.col("gap") + F.col("len")).over(run)
    rows = rows.withColumn("end", end).withColumn("start", F.col("end") - F.col("len")).where("ok") \
        .select("row", "kind", "start", "end")
    order = Window.partitionBy("row").orderBy("start", "kind", "end")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    base = F.col("kind") < 3
    # a weak part that shares a character with a base match says nothing new
    rows = rows.withColumn("covered", ~base & (
        (F.coalesce(F.max(F.when(base, F.col("end"))).over(before), F.lit(-1)) > F.col("start")) |
        (F.coalesce(F.min(F.when(base, F.col("start"))).over(after), F.col("end")) < F.col("end"))))
    rows = rows.where(~F.col("covered")).drop("covered")
    roles = {"id": F.col("kind").isin(1, 3), "secret": F.col("kind").isin(0, 2, 4), "endpoint": F.col("kind") == 5}
    near = {}
    for role, is_role in roles.items():
        left = F.max(F.when(is_role, F.struct("end", "start"))).over(before)
        right = F.min(F.when(is_role, F.struct("start", "end"))).over(after)
        left_gap, right_gap = F.col("start") - left["end"], right["start"] - F.col("end")
        near[f"{role}_near"] = F.when((left_gap <= scope) & (right["start"].isNull() | (left_gap <= right_gap)),
                                      F.struct(left["start"].alias("start"), left["end"].alias("end"))) \
            .when(right_gap <= scope, F.struct(right["start"].alias("start"), right["end"].alias("end"))) \
            .when(left_gap <= scope, F.struct(left["start"].alias("start"), left["end"].alias("end")))
    rows = rows.withColumns(near)
    has = {r: F.col(f"{r}_near").isNotNull() for r in roles}
    return rows.withColumn("reported", base | F.when(F.col("kind") == 3, has["secret"]).when(F.col("kind") == 4, has["id"])
                           .otherwise(has["id"] & has["secret"]))


def scan(docs: DataFrame, text: str = "text", keep: list[str] | None = None, scope: int = SCOPE) -> DataFrame:
    """``keep`` columns (all by default) and ``secrets``: array of (start, rank,
    kind, end) of base matches and linked weak parts, code points, end
    exclusive; one row out per row in."""
    keep = kept_columns(docs, keep, "secrets", "parts", "row")
    row_no = free_name(docs, "row_no")[0]
    found = found_parts(docs, text, keep, row_no)
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1)
    spans = linked_parts(found, row_no, scope).where("reported").groupBy("row").agg(F.sort_array(F.collect_list(F.struct(
        "start", F.col("kind").alias("rank"), kind.alias("kind"), "end"))).alias("secrets"))
    out = found.join(spans, col(row_no) == F.col("row"), "left")
    none = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>")
    return out.select(*[col(c) for c in keep], F.coalesce("secrets", none).alias("secrets"))


def digest(scanned: DataFrame, keep: list[str]) -> DataFrame:
    """Counts per base kind, hash of the base spans, all spans as text."""
    base = F.filter("secrets", lambda s: s["rank"] < 3)
    count = lambda k: F.size(F.filter("secrets", lambda s: s["rank"] == k)).cast("long")
    return scanned.select(*[col(c) for c in keep], count(0).alias("n_assign"), count(1).alias("n_access"),
                          count(2).alias("n_hex"), F.sha2(span_text(base), 256).alias("base_sha256"),
                          span_text(F.col("secrets")).alias("spans"))
