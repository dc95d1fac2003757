"""License scan [native]: units and runs of words of normalised text compared to licence templates by Dice over word bigrams."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Licence notices in common public use (fixed values): id, text.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
]
#: The least Dice coefficient of a hit.
THRESHOLD = 0.8


def _template_words(text: str) -> list[str]:
    import re

    return re.sub(r"[^a-z0-9]+", " ", text.lower()).split()


def _template_bigrams(text: str) -> list[str]:
    words = _template_words(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def _bigrams(words: Column) -> Column:
    return F.array_distinct(F.zip_with(F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b)))


def _least(n: int, threshold: float) -> int:
    """Bigrams of a template of n that any unit or run of words at the threshold shares with it."""
    return math.ceil(n * threshold / (2 - threshold) - 1e-9)


def _gate(text: str, threshold: float) -> list[list[str]]:
    """Sets of words of a template; a run at the threshold has a word of each: without all of a set's, too few bigrams are left."""
    grams = [g.split() for g in _template_bigrams(text)]
    spare = len(grams) - _least(len(grams), threshold)
    covers = lambda ws: sum(any(w in g for w in ws) for g in grams) > spare
    words = sorted({w for g in grams for w in g}, key=lambda w: (-len(w), w))
    sets = [[w] for w in words if covers([w])]
    some: list[str] = []
    for w in words:
        if [w] not in sets:
            some.append(w)
            if covers(some):
                sets.append(some)
                some = []
    return sets


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once."""
    return F.transform(F.array(value), then)[0]


_RUNS = "array<struct<d:double,id:string,line:int,first:int,last:int,upto:int>>"


def _runs(clean: Column, templates: list[tuple[str, str]], threshold: float) -> Column:
    """Runs of words at the threshold: d (minus the coefficient), id, line of the first word, first and last bigram, line of the last word.

    A run has at most as many words as the size bound gives for the template's own words, and starts and ends with a
    bigram of the template (any other run gains by leaving its ends off).
    """
    known = F.array(*[
        F.struct(F.lit(i).alias("id"), F.array(*map(F.lit, b)).alias("grams"), F.lit(len(b)).alias("n"), F.lit(_least(len(b), threshold)).alias("least"), F.lit(int(len(_template_words(t)) * (2 - threshold) / threshold)).alias("most"))
        for i, t in templates if (b := _template_bigrams(t))
    ])

    def of_template(t: Column, grams: Column, lines: Column) -> Column:
        at = F.filter(F.sequence(F.lit(1), F.size(grams)), lambda i: F.array_contains(t["grams"], F.get(grams, i - 1)))

        def from_start(at: Column, k: Column) -> Column:
            first = F.get(at, k)
            ends = F.filter(F.slice(at, k + t["least"], t["most"]), lambda last: last - first < t["most"])

            def scored(last: Column) -> Column:
                d = _let(F.slice(grams, first, last - first + 1), lambda g: F.round(2.0 * F.size(F.array_intersect(g, t["grams"])) / (F.size(F.array_distinct(g)) + t["n"]), 12))
                return F.struct((-d).alias("d"), t["id"].alias("id"), F.get(lines, first - 1).alias("line"), first.alias("first"), last.alias("last"), F.get(lines, last).alias("upto"))

            return F.filter(F.transform(ends, scored), lambda h: h["d"] <= -threshold + 1e-12)

        def from_all(at: Column) -> Column:
            starts = F.filter(F.sequence(F.lit(0), F.size(at) - 1), lambda k: F.get(at, k + t["least"] - 1) - F.get(at, k) < t["most"])
            return F.flatten(F.transform(starts, lambda k: from_start(at, k)))

        return _let(at, lambda at: F.when(F.size(at) >= t["least"], from_all(at)).otherwise(F.array().cast(_RUNS)))

    def of_words(words: Column) -> Column:
        def of_grams(grams: Column, lines: Column) -> Column:
            near = F.filter(known, lambda t: F.size(F.array_intersect(grams, t["grams"])) >= t["least"])
            return F.flatten(F.transform(near, lambda t: of_template(t, grams, lines)))

        pairs = F.zip_with(F.slice(words["w"], F.lit(1), F.size(words) - 1), F.slice(words["w"], F.lit(2), F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b))
        return F.when(F.size(words) > 1, _let(F.struct(pairs.alias("g"), words["line"].alias("l")), lambda x: of_grams(x["g"], x["l"]))).otherwise(F.array().cast(_RUNS))

    worded = F.flatten(F.transform(F.split(clean, "\n"), lambda x, i: F.transform(F.filter(F.split(x, " "), lambda w: w != ""), lambda w: F.struct(w.alias("w"), (i + 1).alias("line")))))
    def gate(padded: Column) -> Column:
        return reduce(or_, [reduce(and_, [reduce(or_, [F.contains(padded, F.lit(f" {w} ")) for w in some]) for some in _gate(t, threshold)]) for _, t in templates if _template_bigrams(t)], F.lit(False))

    has = _let(F.concat(F.lit(" "), F.translate(clean, "\n", " "), F.lit(" ")), gate)
    return F.when(has, _let(worded, of_words)).otherwise(F.array().cast(_RUNS))


def _groups(runs: Column) -> Column:
    """Number of groups of runs that overlap."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))
    step = lambda acc, r: F.struct((acc["n"] + F.when(r["first"] > acc["upto"], 1).otherwise(0)).alias("n"), F.greatest(acc["upto"], r["last"]).alias("upto"))
    return F.aggregate(F.array_sort(F.transform(runs, lambda r: F.struct(r["first"], r["last"]))), start, step, lambda acc: acc["n"])


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, windows: bool = False) -> DataFrame:
    """One row per row of docs: id_col, license, dice (rounded to 12 places), line (1-based; 0: the whole text), n_hits.

    Units are each line and the whole text, lower-cased, with runs of characters other than a-z and 0-9 as one blank.
    A unit's distinct word bigrams are compared with each template's: 2|A and B| / (|A| + |B|). A template is compared
    only if |A| lies within |B| t / (2 - t) and |B| (2 - t) / t, outside of which the coefficient is below t.
    license is the best template's id, from the highest dice (ties: the smaller id, then the smaller line); n_hits
    counts the units with any hit. Null or empty texts and texts without hits: license null, dice 0, line null, 0 hits.
    Repeated rows give repeated results; ids may be null; other columns, whatever their names, are not read.
    With windows, runs of consecutive words anywhere in the text are compared too, within lines and across them, of up to
    (2 - t) / t times a template's words. line is then where the run starts; a group of overlapping runs counts as one
    hit more if no unit with a hit touches it.

    Each row is judged on its own in the JVM: no shuffle, no Python, nothing that grows with the table is broadcast.
    Units outside the word bounds of all templates are dropped before any bigram is built.
    """
    sized = [(i, b := _template_bigrams(t), len(b)) for i, t in templates]
    lo = min(n * threshold / (2 - threshold) for _, _, n in sized)
    hi = max(n * (2 - threshold) / threshold for _, _, n in sized)
    known = F.array(*[F.struct(F.lit(i).alias("id"), F.array(*map(F.lit, b)).alias("grams"), F.lit(n).alias("n")) for i, b, n in sized])
    # Distinct bigrams are at most words - 1, and only repetition makes them fewer; so words bound them from above alone,
    # and the exact bounds apply after. A unit with few words can't reach the least size.
    text = F.coalesce(F.col(text_col), F.lit(""))
    clean = F.regexp_replace(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ\r", "abcdefghijklmnopqrstuvwxyz\n"), r"[^a-z0-9\n]+", " ")
    lines = F.split(F.col("_clean"), "\n")
    whole = F.regexp_replace(F.col("_clean"), r"[ \n]+", " ")
    units = F.concat(F.array(F.struct(F.lit(0).alias("line"), whole.alias("unit"))), F.when(F.size(lines) > 1, F.transform(lines, lambda x, i: F.struct((i + 1).alias("line"), x.alias("unit")))).otherwise(F.array().cast("array<struct<line:int,unit:string>>")))
    # Two characters and a blank a bigram at the least: shorter units can't have the least number of bigrams.
    units = F.filter(units, lambda u: F.length(u["unit"]) >= 2 * lo + 1)
    worded = F.transform(units, lambda u: F.struct(u["line"].alias("line"), F.split(F.trim(u["unit"]), " ").alias("words")))
    worded = F.filter(worded, lambda u: F.size(u["words"]) - 1 >= lo)
    grams = F.transform(worded, lambda u: F.struct(u["line"].alias("line"), _bigrams(u["words"]).alias("g")))
    grams = F.filter(grams, lambda u: (F.size(u["g"]) >= lo) & (F.size(u["g"]) <= hi))

    def best(u: Column) -> Column:
        n = F.size(u["g"])
        near = F.filter(known, lambda t: (n >= t["n"] * (threshold / (2 - threshold)) - 1e-9) & (n <= t["n"] * ((2 - threshold) / threshold) + 1e-9))
        scored = F.transform(near, lambda t: F.struct((-F.round(2.0 * F.size(F.array_intersect(u["g"], t["grams"])) / (n + t["n"]), 12)).alias("d"), t["id"].alias("id"), u["line"].alias("line")))
        return F.array_min(scored)

    hits = F.filter(F.transform(F.col("_grams"), best), lambda h: h["d"] <= -threshold + 1e-12)
    got = docs.select(F.col(id_col), clean.alias("_clean"))
    if not windows:
        got = got.select(id_col, grams.alias("_grams")).select(id_col, hits.alias("_hits")).select(id_col, F.array_min("_hits").alias("_top"), F.size("_hits").alias("n_hits"))
    else:
        free = F.filter("_runs", lambda r: ~F.exists("_hits", lambda h: (h["line"] == 0) | h["line"].between(r["line"], r["upto"])))
        every = F.concat("_hits", F.transform("_runs", lambda r: F.struct(r["d"].alias("d"), r["id"].alias("id"), r["line"].alias("line"))))
        got = got.select(id_col, grams.alias("_grams"), _runs(F.col("_clean"), templates, threshold).alias("_runs")).select(id_col, hits.alias("_hits"), "_runs")
        got = got.select(id_col, F.array_min(every).alias("_top"), (F.size("_hits") + _groups(free)).alias("n_hits"))
    return got.select(id_col, F.col("_top.id").alias("license"), F.coalesce(-F.col("_top.d"), F.lit(0.0)).alias("dice"), F.col("_top.line").alias("line"), F.coalesce("n_hits", F.lit(0)).alias("n_hits"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence of every whole text of documents, units and runs of words; see scan_licenses()."""
    return scan_licenses(table(spark, sf_dir, "documents"), windows=True)


def _sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({quote(i)}, [{', '.join(map(quote, _template_bigrams(t)))}])" for i, t in TEMPLATES)
    lo = min(len(_template_bigrams(t)) for _, t in TEMPLATES) * THRESHOLD / (2 - THRESHOLD)
    hi = max(len(_template_bigrams(t)) for _, t in TEMPLATES) * (2 - THRESHOLD) / THRESHOLD
    return f"""
with t(id, grams) as (values {rows}),
d as (select doc_id, row_number() over () rid, regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || chr(13), 'abcdefghijklmnopqrstuvwxyz' || chr(10)), '[^a-z0-9\\n]+', ' ', 'g') clean from documents),
u as (select rid, 0 line, regexp_replace(clean, '[ \\n]+', ' ', 'g') unit from d union all
  select rid, unnest(range(1, len(string_split(clean, chr(10))) + 1)) line, unnest(string_split(clean, chr(10))) unit from d where contains(clean, chr(10))),
w as (select rid, line, string_split(trim(unit), ' ') words from u where length(unit) - length(replace(unit, ' ', '')) between 1 and 100000),
g as (select rid, line, list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) g from w),
h as (select g.rid, g.line, t.id, round(2.0 * len(list_intersect(g.g, t.grams)) / (len(g.g) + len(t.grams)), 12) dice from g, t
  where len(g.g) between {lo} and {hi}
  and len(g.g) between len(t.grams) * {THRESHOLD / (2 - THRESHOLD)} - 1e-9 and len(t.grams) * {(2 - THRESHOLD) / THRESHOLD} + 1e-9),
k as (select rid, line, id, dice, row_number() over (partition by rid order by dice desc, id, line) r, count(*) over (partition by rid) c from h where dice >= {THRESHOLD} - 1e-12),
c as (select rid, count(distinct line) n from k group by 1)
select d.doc_id, k.id as license, coalesce(k.dice, 0.0) as dice, k.line as line, coalesce(c.n, 0) as n_hits from d left join k on d.rid = k.rid and k.r = 1 left join c on d.rid = c.rid
"""


OP1_SQL = _sql().replace("\\\\n", "\\n")
