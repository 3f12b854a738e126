"""Licence detection on built-in functions only: Dice coefficients of word bigrams against templates.

A text is compared in units: its sentences, its lines, its paragraphs and itself. A unit is lower-cased and reduced
to words of a-z and 0-9. Its Dice coefficient with a template is 2 * shared bigrams / (bigrams of both), over
distinct bigrams. A template of b bigrams can only reach ``least`` with units of least/(2-least) * b to
(2-least)/least * b bigrams; and as such a unit shares many bigrams, it must hold one of any few of the template's
(its anchors). Both are checked before any coefficient is computed, and neither loses a match.

Licences of one family differ by a few words, so a coefficient alone would take one version for another: a unit is
only given a template's name if it holds all of the template's bigrams that tell versions and families apart. The
coefficient is reported either way, so that a text close to a template of another version shows as such.

Short licences are here in full, paragraph by paragraph; of long ones there are the statements and notices by which files
name them, not their texts. A licence that is another's with a clause more takes the other's place.

Defined results: null and empty texts hold no licence (n_units 0, license null); of equal coefficients the template
first by name wins; a very long text is cut into units like any other, of which only those that hold an anchor are kept;
repeated rows are judged one by one; an empty table gives an empty result; only id and text are read, so other columns
may have any names.
"""

from __future__ import annotations

import functools
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST = 0.8
#: Licence statements, notices and short licence texts.
TEMPLATES = {
    "0BSD": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."],
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3."],
    "AGPL-3.0-or-later": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "BSD-2-Clause": [
        "Licensed under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "CC-BY-3.0": ["Licensed under CC BY 3.0.", "This work is licensed under a Creative Commons Attribution 3.0 Unported License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-3.0": ["Licensed under CC BY-SA 3.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "EPL-2.0": ["Licensed under the Eclipse Public License, version 2.0.", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU General Public License, version 2."],
    "GPL-2.0-or-later": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3."],
    "GPL-3.0-or-later": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "LGPL-2.1": ["Licensed under the GNU Lesser General Public License, version 2.1."],
    "LGPL-2.1-or-later": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, version 3."],
    "LGPL-3.0-or-later": ["This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "MPL-1.1": ["Licensed under the Mozilla Public License, version 1.1.", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the License); you may not use this file except in compliance with the License."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0."],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "Zlib": [
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
    ],
}
#: Licences that hold all of another and a clause more.
FULLER = {"BSD-3-Clause": "BSD-2-Clause", "ISC": "0BSD"}
#: Bigrams that tell versions and families apart.
TELLING = re.compile(r"(version|v|by|sa|nc|license|attribution|sharealike|noncommercial) \d+|\d+ (\d+|clause)|gnu (general|lesser|affero)|provided that")


def words_of(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def bigrams_of(text: str) -> list[str]:
    words = words_of(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def telling(bigrams: list[str]) -> list[str]:
    return [b for b in bigrams if TELLING.fullmatch(b)]


def span(bigrams: int, least: float) -> tuple[int, int]:
    """Fewest and most bigrams of a unit that can reach the coefficient."""
    return math.ceil(least / (2 - least) * bigrams - 1e-9), math.floor((2 - least) / least * bigrams + 1e-9)


def anchors(templates: dict[str, list[str]], least: float) -> list[str]:
    """For each template so many bigrams, those with the longest words, that a match must hold one of them."""
    every = [bigrams_of(t) for texts in templates.values() for t in texts]
    seen: dict[str, int] = {}
    for x in every:
        for b in x:
            seen[b] = seen.get(b, 0) + 1
    found: set[str] = set()
    for x in every:
        shared = math.ceil(least / 2 * (len(x) + span(len(x), least)[0]) - 1e-9)
        found.update(sorted(x, key=lambda b: (-max(map(len, b.split(" "))), seen[b], b))[: len(x) - shared + 1])
    return sorted(found)


def _units(text: Column) -> Column:
    """Sentences, lines, paragraphs and the whole, reduced to words with one space between; repeats once."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    marked = [F.split(lower, p) for p in (r"\n+|(?<=[.!?:;])\s+", r"\n", r"\n\s*\n")]
    return F.array_union(F.array_union(marked[0], marked[1]), F.array_union(marked[2], F.array(lower)))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, list[str]] | None = None, least: float = LEAST) -> DataFrame:
    """One row a document: id, license (of the best match whose telling words agree, or null), dice (the best coefficient),
    n_units (units that match any template), licenses (all that agree, sorted)."""
    templates = TEMPLATES if templates is None else templates
    flat = sorted((name, bigrams_of(t)) for name, texts in templates.items() for t in texts)
    spans = [span(len(b), least) for _, b in flat]
    fewest, most = min(a for a, _ in spans), max(b for _, b in spans)
    # anchors as one pattern over the raw text: what lies between words is anything else
    anchor = "(?i)(?<![a-z0-9])(?:" + "|".join(b.replace(" ", "[^a-z0-9]+") for b in anchors(templates, least)) + ")(?![a-z0-9])"
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # no unit holds an anchor unless the text holds both its words: plain searches before the pattern
    held = lambda w: F.contains(F.col("lower"), F.lit(w))
    by_longer: dict[str, list[str]] = {}
    for longer, shorter in (sorted(b.split(" "), key=len, reverse=True) for b in anchors(templates, least)):
        by_longer.setdefault(longer, []).append(shorter)
    either = lambda conditions: functools.reduce(lambda a, b: a | b, conditions)
    hopeful = either([held(w) & either([held(x) for x in others]) for w, others in sorted(by_longer.items())])
    base = base.withColumn("lower", F.lower("text"))
    units = F.when(hopeful & F.col("text").rlike(anchor), F.filter(_units(F.col("text")), lambda u: u.rlike(anchor)))
    # units of the same words are one
    words = F.array_distinct(F.transform("units", lambda u: F.split(F.trim(F.regexp_replace(u, "[^a-z0-9]+", " ")), " ")))
    found = base.select("id", units.alias("units")).select("id", words.alias("units"))
    # bigrams count repeats here, which only widens the upper bound: distinct ones are counted below
    found = found.select("id", F.filter("units", lambda w: F.size(w) > fewest).alias("units"))
    pairs = lambda w: F.array_distinct(F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat(a, F.lit(" "), b)))
    found = found.select("id", F.filter(F.transform("units", pairs), lambda g: (F.size(g) >= fewest) & (F.size(g) <= most)).alias("units"))

    def dice(g: Column, k: int) -> Column:
        (lo, hi), b = spans[k], flat[k][1]
        fits = (F.size(g) >= lo) & (F.size(g) <= hi)
        return F.when(fits, 2 * F.size(F.array_intersect(g, F.array(*map(F.lit, b)))) / (F.size(g) + len(b))).otherwise(0.0)

    # of each unit the best template, and the best whose telling words it holds
    words = F.array(*[F.array(*map(F.lit, telling(b))).cast("array<string>") for _, b in flat])
    likely = lambda g: F.filter(F.array(*[F.struct(dice(g, k).alias("dice"), F.lit(-k).alias("k")) for k in range(len(flat))]), lambda x: x["dice"] >= least)
    agrees = lambda g, x: F.size(F.array_except(F.get(words, -x["k"]), g)) == 0
    best = lambda g: F.transform(F.array(likely(g)), lambda xs: F.struct(F.array_max(xs)["dice"].alias("dice"), F.array_max(F.filter(xs, lambda x: agrees(g, x))).alias("own")))[0]
    found = found.select("id", F.filter(F.transform("units", best), lambda x: x["dice"].isNotNull()).alias("hits"))
    names = F.array(*[F.lit(name) for name, _ in flat])
    own = F.filter(F.transform("hits", lambda x: x["own"]), lambda x: x.isNotNull())
    held = F.array_distinct(F.transform(own, lambda x: F.get(names, -x["k"])))
    lesser = F.array(*[F.when(F.array_contains(held, more), less) for more, less in FULLER.items()])
    found = found.select("id", "hits", own.alias("own"), F.array_sort(F.filter(held, lambda x: ~F.coalesce(F.array_contains(F.array_compact(lesser), x), F.lit(False)))).alias("held"))
    top = F.array_max(F.filter("own", lambda x: F.array_contains("held", F.get(names, -x["k"]))))
    return found.select(
        F.col("id").alias(id_col),
        F.get(names, -top["k"]).alias("license"),
        F.array_max(F.transform("hits", lambda x: x["dice"])).alias("dice"),
        F.coalesce(F.size("hits"), F.lit(0)).cast("long").alias("n_units"),
        F.coalesce("held", F.array().cast("array<string>")).alias("licenses"),
    )
