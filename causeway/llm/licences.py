"""Licence scans: passages compared with licence templates by Dice coefficient over word bigrams, in DataFrame functions.

A passage is a line of a text, or a paragraph of several lines. Text is normalised to lower-case words of letters and
digits. A and B being the sets of word bigrams of passage and template, their Dice coefficient is 2|A & B| / (|A| + |B|).
It reaches t only if t / (2 - t) * |B| <= |A| <= (2 - t) / t * |B|; other templates are pruned by these sizes.

Everything happens within a row: nothing is shuffled. Templates are literals of the plan and meant to be few.

Cases: null and empty texts and passages of fewer than two words match nothing; repeated rows match alike; ties go to
the smaller template name; very long texts are scanned whole; an empty table stays empty; columns of the input other than
the id are not carried on.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the '
        "specific language governing permissions and limitations under the License."
    ),
    "agpl-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "bsd-2-clause-notice": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list "
        "of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright "
        "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided "
        "with the distribution."
    ),
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc0-1.0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."
    ),
    "gpl-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version."
    ),
    "lgpl-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "mpl-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "mit": "Released under the MIT License.",
    "mit-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
}


def template_bigrams(text: str) -> list[str]:
    words = re.findall(r"[^\W_]+", text.lower())
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def passages(text: Column) -> Column:
    """Lines, and paragraphs (parted by blank lines) that have more than one line."""
    lines = F.split(text, "\n", -1)
    paragraphs = F.filter(F.split(text, r"\n[ \t]*\n", -1), lambda p: F.contains(F.trim(p), F.lit("\n")))
    return F.array_distinct(F.concat(lines, paragraphs))


def bigrams(words: Column) -> Column:
    n = F.size(words) - 1
    pairs = F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.concat_ws(" ", a, b))
    return F.when(n > 0, F.array_distinct(pairs)).otherwise(F.array().cast("array<string>"))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """doc_id and matches: for each passage that reaches the threshold, its best (template, dice, passage)."""
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    shapes = [(name, template_bigrams(text)) for name, text in sorted(templates.items())]
    known = F.array(*[
        F.struct(F.lit(name).alias("name"), F.lit(len(own)).alias("n"), F.array(*map(F.lit, own)).alias("grams"))
        for name, own in shapes if own
    ])
    split = docs.select("doc_id", passages(F.coalesce("text", F.lit(""))).alias("passages"))
    words = lambda p: F.split(F.trim(F.regexp_replace(F.lower(p), r"[^\p{L}\p{Nd}]+", " ")), " ")
    worded = split.withColumn("words", F.transform("passages", words))
    least = int(min((len(own) for _, own in shapes if own), default=1) * low)
    gramed = worded.withColumn(
        "grams", F.transform("words", lambda w: F.when(F.size(w) > least, bigrams(w)).otherwise(F.array().cast("array<string>")))
    ).drop("words")

    def best(grams: Column, i: Column) -> Column:
        size = F.size(grams)
        fits = F.filter(known, lambda t: (size >= low * t.n) & (size <= high * t.n))
        dice = F.transform(
            fits, lambda t: F.struct((F.lit(2.0) * F.size(F.array_intersect(grams, t.grams)) / (size + t.n)).alias("dice"), t["name"].alias("name"))
        )
        over = F.filter(dice, lambda d: d.dice >= threshold)
        return F.transform(over, lambda d: F.struct((-d.dice).alias("loss"), d["name"].alias("template"), i.alias("at")))

    scored = gramed.withColumn("hits", F.flatten(F.transform("grams", lambda g, i: F.slice(F.array_sort(best(g, i)), 1, 1))))
    return scored.select(
        "doc_id",
        F.transform(
            "hits", lambda h: F.struct(h.template.alias("template"), (-h.loss).alias("dice"), F.element_at("passages", h["at"] + 1).alias("passage"))
        ).alias("matches"),
    )
