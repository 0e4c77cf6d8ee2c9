"""Licence scans: Dice coefficient over word bigrams against templates.

The units of a text are its lines, its paragraphs (between blank lines) of
more than one line, and the whole text if it has several paragraphs.  A unit
and a template are sets of word bigrams after normalisation (A-Z lower-cased,
anything but letters and digits a blank).  Dice >= t needs a size between
t / (2 - t) and (2 - t) / t of the template's, so only templates of such a
size are compared.

A notice among other words is found by windows: runs of words of the text,
over line and paragraph breaks, from one place of a bigram of the template to
another.  (Any window is at most as near to the template as its part between
its first and last bigram of the template.)  Places inside a matching unit are
settled and begin, end or support no window.  A window's size is its number of
bigrams, those of the template counted once, whatever settled.  Inside a line
that was compared with the template a window counts as no smaller than the
template, so that the words which part the line from it are not just left out.
A place begins one window, the nearest one to the template that ends within the
next places (``reach``: two and a half times the template's size beyond those a
match needs; a longer window repeats bigrams of the template), the shorter if
equally near.  From left to right a window gives way to a nearer one that
begins inside it, and bars the others that do.
Only rows that hold enough bigrams of the templates are looked at.

DataFrame functions only, one narrow pass, nothing joined.  Work per row is in
proportion to its words and places, times a bound that only the templates fix.

Null, empty and one-word texts match nothing; an empty table gives an empty
one.  Equal best scores go to the template listed first.  One row out per row
in, of whatever length: a text's words are held in its row.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, kept_columns

MIN_DICE = 0.8

#: Licence names and notice texts.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
            "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
            "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
            "following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except "
                   "in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation, either version 3 of the License, "
                "or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                     "provided that the following conditions are met:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)


def template_bigrams(text: str) -> list[str]:
    words = re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def scan_licences(docs: DataFrame, text: str = "text", keep: list[str] | None = None, templates=TEMPLATES,
                  min_dice: float = MIN_DICE) -> DataFrame:
    """``keep`` columns (all by default) and ``licences``: array of (dice,
    template, licence, unit) of every unit or window and template that match,
    where unit is the number of the line, or null for a paragraph, the whole
    text or a window."""
    keep = kept_columns(docs, keep, "licences", "_t", "_b", "_u", "_v", "_w", "_h", "_e", "_l", "_k", "_p", "_n")
    grams = [(name, template_bigrams(t)) for name, t in templates]
    grams = [(i, name, g) for i, (name, g) in enumerate(grams) if g]
    hashes = lambda g: [F.xxhash64(*map(F.lit, b.split(" "))) for b in g]
    known = F.array(*[F.struct(F.lit(i).alias("template"), F.lit(name).alias("licence"), F.lit(len(g)).alias("n"),
                               F.array(*hashes(g)).alias("g")) for i, name, g in grams])
    low, high = min_dice / (2 - min_dice) * (1 - 1e-9), (2 - min_dice) / min_dice * (1 + 1e-9)  # rounding loses no tie
    least, most = low * min(len(g) for _, _, g in grams), high * max(len(g) for _, _, g in grams)
    clean = F.regexp_replace(F.translate(col(text).cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"),
                             r"[^\p{L}\p{N}\n]+", " ")
    rows = docs.select(*[col(c) for c in keep], F.coalesce(clean, F.lit("")).alias("_t"))
    rows = rows.withColumn("_b", F.split("_t", r"\n[ \n]*\n"))

    def gram_set(u):
        """Distinct bigrams of a unit, null where no template is of such a size."""
        words = F.split(F.trim(F.translate(u, "\n", " ")), " +")
        pairs = lambda w: F.array_distinct(F.transform(F.slice(w, 1, F.size(w) - 1),
                                                       lambda x, k: F.xxhash64(x, F.get(w, k + 1))))
        found = F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > least, pairs(w))), F.lit(0))
        return F.get(F.transform(F.array(found), lambda g: F.when(F.size(g).between(F.lit(least), F.lit(most)), g)), F.lit(0))

    def against(g, i):
        fits = F.filter(known, lambda t: F.size(g).between(t["n"] * F.lit(low), t["n"] * F.lit(high)))
        near = F.transform(fits, lambda t: F.struct(
            (F.lit(2.0) * F.size(F.array_intersect(g, t["g"])) / (F.size(g) + t["n"])).alias("dice"),
            t["template"].alias("template"), t["licence"].alias("licence"), i.alias("unit")))
        return F.when(g.isNotNull(), F.filter(near, lambda m: m["dice"] >= min_dice)).otherwise(nothing)

    nothing = F.array().cast("array<struct<dice:double,template:int,licence:string,unit:int>>")
    no_line = F.lit(None).cast("int")
    # by line, by paragraph: sets of bigrams, then matches
    rows = rows.withColumn("_u", F.transform(F.split("_t", "\n"), gram_set))
    rows = rows.withColumn("_n", F.transform("_u", lambda g: F.when(g.isNotNull(), F.size(g))))
    rows = rows.withColumn("_u", F.transform("_u", lambda g, i: against(g, i)))
    rows = rows.withColumn("_v", F.transform("_b", lambda b: F.when(b.contains("\n"), gram_set(b))))
    rows = rows.withColumn("_v", F.transform("_v", lambda g: against(g, no_line)))
    rows = rows.withColumn("_w", F.when(F.size("_b") > 1, gram_set(F.col("_t"))))
    rows = rows.withColumn("_w", against(F.col("_w"), no_line))
    # bigrams of the whole text, and the places (k) of those that any template holds
    rows = rows.withColumn("_h", F.split(F.trim(F.translate("_t", "\n", " ")), " +"))
    rows = rows.withColumn("_h", F.transform(F.slice("_h", 1, F.greatest(F.size("_h") - 1, F.lit(0))),
                                             lambda w, k: F.xxhash64(w, F.get("_h", k + 1))))
    every = hashes(sorted({b for _, _, g in grams for b in g}))
    rows = rows.withColumn("_e", F.filter(F.transform("_h", lambda h, k: F.when(
        h.isin(every), F.struct(k.alias("k"), h.alias("h")))), lambda e: e.isNotNull())).drop("_h")
    # line and paragraph of each word, only where there may be a window
    n_words = lambda x: F.when(F.length(F.trim(F.translate(x, "\n", " "))) > 0, F.size(
        F.split(F.trim(F.translate(x, "\n", " ")), " +"))).otherwise(0)
    spread = lambda parts: F.flatten(F.transform(parts, lambda x, i: F.array_repeat(i, n_words(x))))
    some = (F.size("_e") >= math.ceil(least)) & (F.size("_w") == 0)
    rows = rows.withColumn("_l", F.when(some, spread(F.split("_t", "\n")))).withColumn("_k", F.when(some, spread(F.col("_b"))))

    def settled(e):
        inside = lambda unit, matches: (F.get(unit, e["k"]) == F.get(unit, e["k"] + 1)) & (
            F.size(F.get(matches, F.get(unit, e["k"]))) > 0)
        return inside("_l", "_u") | inside("_k", "_v")
    rows = rows.withColumn("_e", F.when(some, F.filter("_e", lambda e: ~settled(e)))).drop("_k")
    rows = rows.withColumn("_p", _rich(known, low, F.col("_e"), math.ceil(least)))
    unit_matches = F.concat(F.flatten("_u"), F.flatten("_v"), F.col("_w"))
    return rows.select(*[col(c) for c in keep], F.when(F.size("_p") > 0, F.concat(unit_matches, _windows(min_dice, low, high)))
                       .otherwise(unit_matches).alias("licences"))


def _rich(known: Column, low: float, places: Column, least: int) -> Column:
    """Templates of which a row holds as many bigrams as a match needs, with their places."""
    need = lambda t: F.greatest(F.ceil(t["n"] * F.lit(low)).cast("int"), F.lit(1))
    held = F.transform(known, lambda t: F.struct(
        t["template"], t["licence"], t["n"], need(t).alias("need"),
        F.filter(places, lambda e: F.array_contains(t["g"], e["h"])).alias("p")))
    return F.filter(F.when(F.size(places) >= least, held), lambda t: F.size(t["p"]) >= t["need"])


def reach(n: Column | int, high: float):
    """Places behind those a match needs that a window may end at."""
    return F.ceil(n * F.lit(2 * high)).cast("int") if isinstance(n, Column) else math.ceil(n * 2 * high)


def _windows(min_dice: float, low: float, high: float) -> Column:
    """Matching windows of a row, by template and from left to right."""
    near = min_dice * (1 - 1e-9)

    def scored(t, s, e, y):
        """Window from the hit s to the hit e, the y-th after the least that s needs."""
        hits = y + t["need"]
        length = e["k"] - s["k"] + 1
        line = F.get("_l", s["k"])
        shared = F.size(F.array_distinct(F.transform(F.slice(t["p"], s["x"] + 1, hits), lambda h: h["h"])))
        size = length - hits + shared
        compared = (line == F.get("_l", e["k"] + 1)) & F.get("_n", line).between(t["n"] * F.lit(low), t["n"] * F.lit(high))
        size = F.when(F.coalesce(compared, F.lit(False)), F.greatest(size, t["n"])).otherwise(size)
        # no more bigrams than the hits can be shared: most windows end here
        hope = (2 - near) * F.least(hits, t["n"]) >= near * (length - hits + t["n"])
        return F.when(hope, F.struct((F.lit(-2.0) * shared / (size + t["n"])).alias("d"), length.alias("len"),
                                     s["k"].alias("a"), e["k"].alias("b")))

    def of_template(t):
        # the hits a match needs stand close enough behind its first one
        starts = F.filter(F.transform(t["p"], lambda e, x: F.struct(x.alias("x"), e["k"].alias("k"))), lambda s: (
            F.get(t["p"], s["x"] + t["need"] - 1)["k"] - s["k"] - t["need"]) <= t["n"] * F.lit(high - 1))
        best = F.transform(starts, lambda s: F.array_min(F.transform(  # array_min passes over nulls
            F.slice(t["p"], s["x"] + t["need"], reach(t["n"], high)), lambda e, y: scored(t, s, e, y))))
        found = F.filter(best, lambda w: w.isNotNull() & (w["d"] <= -near))
        none = F.struct(F.slice(found, 1, 0).alias("done"), F.get(F.slice(found, 1, 0), F.lit(0)).alias("now"))
        kept = F.aggregate(found, none, lambda got, w: F.when(got["now"].isNull(), F.struct(got["done"].alias("done"), w.alias("now")))
                           .when(w["a"] > got["now"]["b"], F.struct(F.concat(got["done"], F.array(got["now"])).alias("done"), w.alias("now")))
                           .when(w["d"] < got["now"]["d"], F.struct(got["done"].alias("done"), w.alias("now"))).otherwise(got),
                           lambda got: F.when(got["now"].isNull(), got["done"]).otherwise(F.concat(got["done"], F.array(got["now"]))))
        return F.transform(kept, lambda w: F.struct((-w["d"]).alias("dice"), t["template"].alias("template"),
                                                    t["licence"].alias("licence"), F.lit(None).cast("int").alias("unit")))

    return F.flatten(F.transform("_p", of_template))


def digest(scanned: DataFrame, keep: list[str]) -> DataFrame:
    """Best licence and score, all licences found, number of matches."""
    best = F.array_min(F.transform("licences", lambda m: F.struct((-m["dice"]).alias("d"), m["template"].alias("t"),
                                                                  m["licence"].alias("l"))))
    return scanned.select(
        *[col(c) for c in keep], best["l"].alias("licence"), (-best["d"]).alias("dice"),
        F.size("licences").cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("licences", lambda m: m["licence"]))), ",").alias("licences"))
