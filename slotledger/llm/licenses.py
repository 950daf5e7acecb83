"""Licence notices in whole texts, by DataFrame functions only.

A text is normalised (lower case, runs of characters other than letters, digits
and line ends become a space) and cut into units: its lines, its paragraphs, and
itself. A unit matches a template if the Dice coefficient of their sets of word
bigrams reaches the threshold. Two bounds prune, and neither loses a match: a
unit's number of bigrams limits the templates that it can reach, and a unit
without any cue word cannot share enough bigrams with any template (cue words
are chosen from the templates so that this holds).

What no matching unit covers is searched by windows of its words, across line ends,
so a notice within a sentence or wrapped over lines is found too. A window of the
greatest Dice begins and ends with a bigram of its template; such windows are
compared, up to the length that the threshold allows. Of windows that overlap the
best stays (by Dice, then length, then template). The words that are common to text
and template prune without loss here as well. ``scan_sql`` checks the units only.

Nothing is shuffled; every row is scanned on its own.

Edge cases: a null, empty or wordless text has no units and matches nothing; a
unit of one word has no bigrams. Repeated rows and null ids give equal rows.
Ties between templates go to the one listed first. Columns other than id and
text are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Wording of public licence notices.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions:",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at",
    ),
    (
        "Apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is "
        "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or "
        "implied.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, "
        "or (at your option) any later version.",
    ),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    (
        "BSD",
        "Redistribution and use in source and binary forms, with or without modification, are permitted "
        "provided that the following conditions are met:",
    ),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    (
        "CC-BY-4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
    ("Proprietary", "All rights reserved. No part of this work may be reproduced without permission."),
    ("Proprietary", "All rights reserved."),
)

THRESHOLD_PERCENT = 80

#: Words too common in prose to tell a notice; taken as cues only if nothing else is left.
COMMON = frozenset(
    "the and of to in a is be or for this any with under by without work all no as that from at on"
    " are it was which an not you may but can 0 1 2 3 4".split()
)


def plain_words(text: str) -> list[str]:
    return re.sub(r"[\W_]+", " ", text.lower()).split()


def plain_bigrams(text: str) -> list[str]:
    words = plain_words(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


def cue_words(templates=TEMPLATES, percent: int = THRESHOLD_PERCENT) -> list[str]:
    """Words of which a unit must have one to reach the threshold with any template.

    A match shares at least ``t / (2 - t)`` of the template's bigrams. Words are taken,
    rarer ones and those of most templates first, until fewer bigrams than that are free of them.
    """
    sets = [plain_bigrams(text) for _, text in templates]
    needed = [ceil(percent * len(s) / (200 - percent) - 1e-9) for s in sets]
    cues: list[str] = []
    while True:
        free = [[b for b in s if not set(b.split()) & set(cues)] for s in sets]
        open_ = [f for f, n in zip(free, needed, strict=True) if len(f) >= n]
        if not open_:
            return cues
        votes = Counter(w for f in open_ for b in f for w in set(b.split()))
        cues.append(max(votes, key=lambda w: (w not in COMMON, votes[w], len(w), w)))


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}\n]+", " ")


def units(text: Column) -> Column:
    """Lines, paragraphs and the whole of a normalised text, without repeats."""
    lines = F.split(text, "\n", -1)
    paragraphs = F.split(text, r"\n[ \n]*\n", -1)
    every = F.concat(lines, paragraphs, F.array(text))
    return F.array_distinct(F.transform(every, lambda u: F.trim(F.translate(u, "\n", " "))))


def _pairs(words: Column) -> Column:
    pairs = F.transform(
        F.sequence(F.lit(1), F.size(words) - 1),
        lambda i: F.concat_ws(" ", F.element_at(words, i), F.element_at(words, i + 1)),
    )
    return F.when(F.size(words) > 1, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def _bigrams(unit: Column) -> Column:
    # The words are bound once; an expression inside the inner function would be split again for each pair.
    return F.element_at(F.transform(F.array(F.split(unit, " +", -1)), _pairs), 1)


def _template_array(templates) -> Column:
    rows = []
    for number, (name, text) in enumerate(templates):
        bigrams = plain_bigrams(text)
        rows.append(
            F.struct(
                F.lit(number).alias("number"),
                F.lit(name).alias("license"),
                F.array(*[F.lit(b) for b in bigrams]).alias("bigrams"),
                F.lit(len(bigrams)).alias("size"),
            )
        )
    return F.array(*rows)


def _let(value: Column, use) -> Column:
    """``use(value)``, with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


WINDOW = "struct<dice:double,length:int,order:int,start:int,license:string,words:string>"


def _uncovered(text: Column, matched: Column) -> Column:
    """Stretches of a normalised text between the lines and paragraphs that match."""
    flat = lambda u: F.trim(F.translate(u, "\n", " "))
    lines = lambda p: F.array_join(
        F.transform(F.split(p, "\n", -1), lambda u: F.when(F.array_contains(matched, F.trim(u)), "\n").otherwise(u)), " "
    )
    rest = F.transform(
        F.split(text, r"\n[ \n]*\n", -1),
        lambda p: F.when(F.array_contains(matched, flat(p)), "\n").otherwise(lines(p)),
    )
    whole = F.array_contains(matched, flat(text))
    return F.when(whole, F.array().cast("array<string>")).otherwise(
        F.transform(F.split(F.array_join(rest, " "), "\n", -1), lambda u: F.trim(u))
    )


def _windows(stretch: Column, table: Column, every: Column, percent: int) -> Column:
    """Windows of a stretch that match, the best of those that overlap."""

    def of_words(words: Column) -> Column:
        pairs = F.transform(
            F.sequence(F.lit(1), F.size(words) - 1),
            lambda i: F.concat_ws(" ", F.element_at(words, i), F.element_at(words, i + 1)),
        )
        return F.when(F.size(words) > 1, _let(pairs, lambda p: of_pairs(words, p))).otherwise(
            F.array().cast(f"array<{WINDOW}>")
        )

    def of_pairs(words: Column, pairs: Column) -> Column:
        common = F.array_intersect(pairs, every)
        return _let(
            common,
            lambda c: F.flatten(
                F.transform(
                    # A match shares t / (2 - t) of the template's bigrams at least.
                    F.filter(
                        table,
                        lambda t: F.size(F.array_intersect(t["bigrams"], c)) * (200 - percent) >= t["size"] * percent,
                    ),
                    lambda t: of_template(words, pairs, t),
                )
            ),
        )

    def of_template(words: Column, pairs: Column, t: Column) -> Column:
        places = F.filter(
            F.sequence(F.lit(1), F.size(pairs)), lambda i: F.array_contains(t["bigrams"], F.element_at(pairs, i))
        )

        def scored(start: Column, end: Column) -> Column:
            return _let(
                F.array_distinct(F.slice(pairs, start, end - start + 1)),
                lambda b: F.struct(
                    (F.lit(2.0) * F.size(F.array_intersect(b, t["bigrams"])) / (F.size(b) + t["size"])).alias("dice"),
                    (end - start + 1).alias("length"),
                    (-t["number"]).alias("order"),
                    start.alias("start"),
                    t["license"].alias("license"),
                    F.array_join(F.slice(words, start, end - start + 2), " ").alias("words"),
                ),
            )

        def from_place(at: Column, start: Column) -> Column:
            ends = F.filter(
                at,
                lambda e: (e >= start)
                & ((e - start + 1) * (200 - percent) >= t["size"] * percent)
                & ((e - start + 1) * percent <= t["size"] * (200 - percent)),
            )
            return F.transform(ends, lambda e: scored(start, e))

        found = _let(places, lambda at: F.flatten(F.transform(at, lambda start: from_place(at, start))))
        return F.filter(found, lambda w: w["dice"] * 100 >= percent)

    apart = lambda v, w: (
        (v["start"] > w["start"] + w["length"]) | (w["start"] > v["start"] + v["length"])
    )
    found = _let(F.split(stretch, " +", -1), of_words).cast(f"array<{WINDOW}>")
    return F.aggregate(
        F.sort_array(found, asc=False),
        F.array().cast(f"array<{WINDOW}>"),
        lambda kept, w: F.when(F.forall(kept, lambda v: apart(v, w)), F.concat(kept, F.array(w))).otherwise(kept),
    )


def license_matches(
    text: Column, templates=TEMPLATES, percent: int = THRESHOLD_PERCENT
) -> Column:
    """Array of (dice, license, words) of the units that match, each with its best template,
    and of the windows that match elsewhere; equal words count once."""
    cues = F.array(*[F.lit(w) for w in cue_words(templates, percent)])
    hints = lambda u: F.arrays_overlap(F.split(u, " +", -1), cues)
    table = _template_array(templates)
    every = F.array(*[F.lit(b) for b in dict.fromkeys(b for _, t in templates for b in plain_bigrams(t))])

    def score(unit: Column) -> Column:
        size = F.size(unit["bigrams"])
        # Dice >= t needs sizes within a factor of (2 - t) / t.
        fitting = F.filter(
            table,
            lambda t: (size * (200 - percent) >= t["size"] * percent)
            & (t["size"] * (200 - percent) >= size * percent),
        )
        scored = F.transform(
            fitting,
            lambda t: F.struct(
                (
                    F.lit(2.0) * F.size(F.array_intersect(unit["bigrams"], t["bigrams"])) / (size + t["size"])
                ).alias("dice"),
                (-t["number"]).alias("order"),
                t["license"].alias("license"),
                unit["words"].alias("words"),
            ),
        )
        return F.array_max(F.filter(scored, lambda s: s["dice"] * 100 >= percent))

    def matches(clean: Column, likely: Column) -> Column:
        sets = F.transform(likely, lambda u: F.struct(u.alias("words"), _bigrams(u).alias("bigrams")))
        whole = F.filter(F.transform(sets, score), lambda m: m.isNotNull())
        return _let(whole, lambda m: F.concat(_plain(m), inside(clean, F.transform(m, lambda x: x["words"]))))

    def inside(clean: Column, matched: Column) -> Column:
        rest = F.filter(_uncovered(clean, matched), hints)
        found = _plain(F.flatten(F.transform(rest, lambda u: _windows(u, table, every, percent))))
        # Equal words have equal best templates, so whole rows are compared.
        return F.filter(F.array_distinct(found), lambda w: ~F.array_contains(matched, w["words"]))

    def of_text(clean: Column) -> Column:
        return _let(
            F.filter(units(clean), hints),
            lambda likely: F.when(F.size(likely) > 0, matches(clean, likely)).otherwise(
                F.array().cast("array<struct<dice:double,license:string,words:string>>")
            ),
        )

    return _let(normalised(text), of_text)


def _plain(found: Column) -> Column:
    fields = ("dice", "license", "words")
    return F.transform(found, lambda m: F.struct(*[m[f].alias(f) for f in fields]))


def scan_licenses(
    docs: DataFrame, templates=TEMPLATES, percent: int = THRESHOLD_PERCENT
) -> DataFrame:
    """``doc_id, n_matches, licenses, best_dice`` of every row: units and windows that match, the
    distinct licences in order of name, and the highest coefficient (null: none)."""
    found = docs.select("doc_id", license_matches(F.col("text").cast("string"), templates, percent).alias("m"))
    return found.select(
        "doc_id",
        F.size("m").cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("m", lambda m: m["license"]))), ",").alias("licenses"),
        F.array_max(F.transform("m", lambda m: m["dice"])).alias("best_dice"),
    )


def scan_sql(templates=TEMPLATES, percent: int = THRESHOLD_PERCENT) -> str:
    """The matches of units as DuckDB SQL: every unit against every template, nothing pruned."""

    def text(value: str) -> str:
        return "'" + value.replace("'", "''") + "'"

    rows = ", ".join(
        f"({n}, {text(name)}, [{', '.join(map(text, plain_bigrams(wording)))}])"
        for n, (name, wording) in enumerate(templates)
    )
    return f"""
        WITH templates(number, license, bigrams) AS (VALUES {rows}),
        clean AS (
            SELECT doc_id, row_number() OVER () AS line,
                   regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g') AS t
            FROM documents),
        cut AS (
            SELECT doc_id, line, unnest(list_distinct(list_transform(
                list_concat(list_concat(string_split(t, chr(10)),
                                        string_split_regex(t, '\\n[ \\n]*\\n')), [t]),
                lambda u: trim(replace(u, chr(10), ' '))))) AS unit
            FROM clean),
        worded AS (SELECT doc_id, line, unit, string_split_regex(unit, ' +') AS w FROM cut),
        paired AS (
            SELECT doc_id, line, unit, list_distinct(list_transform(
                range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b
            FROM worded WHERE len(w) > 1),
        scored AS (
            SELECT p.doc_id, p.line, p.unit, t.number, t.license,
                   2.0::DOUBLE * len(list_intersect(p.b, t.bigrams)) / (len(p.b) + len(t.bigrams)) AS dice
            FROM paired p JOIN templates t ON list_has_any(p.b, t.bigrams)),
        best AS (
            SELECT line, unit, arg_max(license, [dice, -number]) AS license, max(dice) AS dice
            FROM scored WHERE dice * 100 >= {percent} GROUP BY line, unit),
        found AS (
            SELECT line, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses,
                   max(dice) AS dice
            FROM best GROUP BY line)
        SELECT doc_id, coalesce(n, 0)::BIGINT AS n_matches, coalesce(licenses, '') AS licenses,
               dice AS best_dice
        FROM clean LEFT JOIN found USING (line)
    """
