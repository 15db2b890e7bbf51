"""License scan (DataFrame operations only).

Normalised text is compared with licence templates by the Dice coefficient of the sets of
word bigrams, 2|A & B| / (|A| + |B|).  Since |A & B| is at most the smaller size, a
template can reach the threshold t only if its size is between |A| t / (2 - t) and
|A| (2 - t) / t: the others are pruned before any bigram is compared.

Compared units are the whole text, each of its lines, and word windows of the whole text:
for a template of n words, the n words from every place where one of its bigrams begins,
line ends being spaces.  So a notice inside a longer line or paragraph is found, and so is a
whole licence, wrapped anyhow, by the passage or notice of it that is a template.  Before any
window is made, a template needs t / (2 - t) of its bigrams somewhere in the text: a window of
at least shrink * |B| bigrams with 2|A & B| >= t (|A| + |B|) shares no fewer.  Windows count
only for identifiers that no line and not the whole text has, one match for each identifier.
Normalising lower-cases and turns everything but ASCII letters, digits and line feeds into
single spaces.

Defined cases: a null or empty text and a text of fewer than two words match nothing;
rows map to rows, so repeated rows and ties need no care (equal Dice: the template first
in the given order); an empty table gives an empty result; added names replace clashing ones.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regionpulse.llm.common import let, text_or_empty

#: public licence notices, (identifier, text): fixed values
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
    ("Proprietary", "All rights reserved."),
]

#: passages of whole licences that only windows are compared with, besides the notices above
PASSAGES: list[tuple[str, str]] = [
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
]


def plain_bigrams(text: str) -> list[str]:
    """The distinct word bigrams of a template, by the rule that Spark applies to texts."""
    w = re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:])))


def bigrams(line: Column) -> Column:
    """Distinct word bigrams of a normalised, trimmed line."""
    return let(F.split(line, " "), lambda w: F.when(F.size(w) >= 2, F.array_distinct(
        F.transform(F.slice(w, 1, F.size(w) - 1), lambda x, i: F.concat_ws(" ", x, F.get(w, i + 1))))).otherwise(F.array().cast("array<string>")))


def scan(docs: DataFrame, threshold: float = 0.8, templates: list[tuple[str, str]] | None = None, text: str = "text") -> DataFrame:
    """``docs`` without the text, with ``licenses`` (identifiers that some unit reaches, sorted,
    comma-joined), ``n_matches`` (matching lines and whole text, one line counting once, and
    identifiers that only windows find),
    ``best_license`` and ``best_dice`` (null and 0 without a match)."""
    given = [(k, name, grams) for k, (name, t) in enumerate(templates or TEMPLATES) if (grams := plain_bigrams(t))]
    shrink, grow = threshold / (2 - threshold), (2 - threshold) / threshold
    least, most = min(len(g) for *_, g in given) * shrink, max(len(g) for *_, g in given) * grow
    known = F.array(*[F.struct(F.lit(-k).alias("order"), F.lit(name).alias("name"), F.array(*map(F.lit, g)).alias("grams")) for k, name, g in given])
    nothing = F.lit(None).cast("struct<dice:double,order:int,name:string>")

    def best(grams: Column) -> Column:
        size = F.size(grams)
        near = F.filter(known, lambda t: (F.size(t["grams"]) >= size * F.lit(shrink)) & (F.size(t["grams"]) <= size * F.lit(grow)))
        dice = F.transform(near, lambda t: F.struct(
            (2.0 * F.size(F.array_intersect(grams, t["grams"])) / (size + F.size(t["grams"]))).alias("dice"), t["order"].alias("order"), t["name"].alias("name")))
        return F.when((size >= F.lit(least)) & (size <= F.lit(most)), F.array_max(F.filter(dice, lambda d: d["dice"] >= threshold))).otherwise(nothing)

    passages = [(k, name, grams, len(re.findall("[a-z0-9]+", t.lower()))) for k, (name, t) in enumerate([*(templates or TEMPLATES), *([] if templates else PASSAGES)]) if (grams := plain_bigrams(t))]
    every = F.array(*map(F.lit, sorted({g for _, _, grams, _ in passages for g in grams})))
    sought = F.array(*[F.struct(F.lit(-k).alias("order"), F.lit(name).alias("name"), F.array(*map(F.lit, grams)).alias("grams"), F.lit(n).alias("words")) for k, name, grams, n in passages])
    several = F.array().cast("array<struct<dice:double,at:int,until:int,order:int,name:string>>")

    def windows(line: Column) -> Column:
        """The best window of each template that has one, most alike first."""
        def of_template(row: Column, t: Column) -> Column:
            starts = F.filter(F.sequence(F.lit(1), F.size(row)), lambda i: F.array_contains(t["grams"], F.get(row, i - 1)))
            return F.array_max(F.filter(F.transform(starts, lambda i: let(F.array_distinct(F.slice(row, i, t["words"] - 1)), lambda a: F.struct(
                (2.0 * F.size(F.array_intersect(a, t["grams"])) / (F.size(a) + F.size(t["grams"]))).alias("dice"), (-i).alias("at"), (i + t["words"]).alias("until"), t["order"].alias("order"), t["name"].alias("name")))),
                lambda d: d["dice"] >= threshold))

        def in_text(row: Column) -> Column:
            return let(F.array_intersect(row, every), lambda met: let(
                F.filter(sought, lambda t: F.size(F.array_intersect(met, t["grams"])) >= F.size(t["grams"]) * F.lit(shrink - 1e-9)),
                lambda some: F.when(F.size(some) == 0, several).otherwise(F.filter(F.transform(some, lambda t: of_template(row, t)), lambda m: m.isNotNull()))))

        return let(F.split(line, " "), lambda w: F.when(F.size(w) >= 2, let(
            F.transform(F.slice(w, 1, F.size(w) - 1), lambda x, i: F.concat_ws(" ", x, F.get(w, i + 1))), in_text)).otherwise(several))

    def unlike(seen: Column) -> Column:
        """Windows without those that a more alike template of another identifier overlaps, one of each identifier."""
        free = F.filter(seen, lambda m: ~F.exists(seen, lambda o: (o["name"] != m["name"]) & (-o["at"] < m["until"]) & (-m["at"] < o["until"])
                                                  & ((o["dice"] > m["dice"]) | ((o["dice"] == m["dice"]) & (o["order"] > m["order"])))))
        return F.filter(free, lambda m: ~F.exists(free, lambda o: (o["name"] == m["name"]) & (F.struct(o["dice"], o["order"]) > F.struct(m["dice"], m["order"]))))

    clean = F.regexp_replace(F.lower(text_or_empty(text)), r"[^a-z0-9\n]+", " ")
    # a text of one line is its own only unit
    units = let(clean, lambda c: let(F.split(c, "\n"), lambda ls: F.when(F.size(ls) > 1, F.concat(ls, F.array(F.regexp_replace(c, r"[\n ]+", " ")))).otherwise(ls)))
    # words of a unit are cut only if its length can hold a number of bigrams in bounds
    found = F.filter(F.transform(units, lambda u: let(F.trim(u), lambda line: let(
        F.length(line) - F.length(F.replace(line, F.lit(" "))),
        lambda spaces: F.when(spaces >= F.lit(least), let(bigrams(line), best)).otherwise(nothing)))), lambda m: m.isNotNull())
    inside = let(windows(F.trim(F.regexp_replace(clean, r"[\n ]+", " "))), unlike)
    found = let(found, lambda units: F.concat(units, F.transform(
        F.filter(inside, lambda m: ~F.exists(units, lambda u: (u["name"] == m["name"]))), lambda m: F.struct(
            m["dice"].alias("dice"), m["order"].alias("order"), m["name"].alias("name")))))
    names = ["licenses", "n_matches", "best_license", "best_dice"]
    kept = [c for c in docs.columns if c not in {*names, text}]
    # the kept columns travel in one, so no name can clash
    row = F.struct(*[F.col(f"`{c}`") for c in kept]) if kept else F.struct(F.lit(0))
    return (docs.select(row.alias("row"), found.alias("found"))
            .select(*[F.col("row").getField(c).alias(c) for c in kept],
                    F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda m: m["name"]))), ",").alias("licenses"),
                    F.size("found").cast("long").alias("n_matches"),
                    F.array_max("found")["name"].alias("best_license"),
                    F.round(F.coalesce(F.array_max("found")["dice"], F.lit(0.0)), 6).alias("best_dice")))
