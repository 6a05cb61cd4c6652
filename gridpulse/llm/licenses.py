"""License scans by DataFrame functions alone: MinHash bands retrieve templates, exact containment verifies.

Templates are cut into five-word shingles. A band is one minimum: the template's shingle with the least hash of that band. Text
windows are as short as can be, one shingle each, so that a band agrees wherever its minimal shingle stands, whatever is
around it. Found means that at least 0.8 of a template's distinct shingles occur, anywhere in the text. A template
gets bands until its distinct minimal shingles are more than such a text may lack: one of them is then in every text that holds
the template, and retrieval misses none, of any length and at any place. Candidates are verified by exact
shingle containment over the whole text.

Texts without a minimal shingle are left out first, by one regular expression for all of them.

Words are runs of ASCII letters and digits and of characters beyond ASCII, A-Z lower-cased; a template of fewer
than five words is one shingle of them all and is looked for at that length.

Defined cases: null and wordless texts hold no template; repeated rows are all reported; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridpulse.llm.common import ready

SHINGLE, CONTAINED = 5, 0.8

# License notices, by public license name.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": (
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed "
        "under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    "MIT": "Released under the MIT License.",
    "MIT-permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    "MIT-warranty": "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def plain_words(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate({b: b + 32 for b in range(0x41, 0x5B)}))


def template_shingles(text: str) -> list[str]:
    """The distinct shingles of a template in order."""
    found = plain_words(text)
    size = min(SHINGLE, len(found))
    return list(dict.fromkeys(" ".join(found[i:i + size]) for i in range(len(found) - size + 1))) if found else []


def lowered(text: Column) -> Column:
    """A-Z in lower case; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_array(text: Column) -> Column:
    """The words of a text; an empty array for none."""
    return F.array_remove(F.split(lowered(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def shingle_at(found: Column, place: Column, size: int) -> Column:
    """The ``size`` words of an array from a place on, counted from 0."""
    return F.concat_ws(" ", *[F.get(found, place + k) for k in range(size)])


def shingle_array(found: Column, first: Column, last: Column, size: int) -> Column:
    """The stretches of ``size`` words that start at ``first`` to ``last``."""
    starts = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: shingle_at(found, i, size))


def minimal_shingles(minima: list[str], shingles: list[str]) -> list[str]:
    """The distinct minimal shingles of as many bands as it takes to be more than a text that holds the template may lack."""
    needed = len(shingles) - math.ceil(CONTAINED * len(shingles)) + 1
    return list(dict.fromkeys([*minima, *shingles]))[:needed]


class Template(NamedTuple):
    name: str
    size: int
    shingles: list[str]
    minimal: list[str]


def prepare(spark: SparkSession, templates: dict[str, str]) -> list[Template]:
    """The templates with their minimal shingles; a table of a few rows."""
    rows = []
    for name, text in sorted(templates.items()):
        if shingles := template_shingles(text):
            rows.append((name, min(SHINGLE, len(plain_words(text))), shingles))
    if not rows:
        return []
    table = spark.createDataFrame(rows, "name string, size int, shingles array<string>").coalesce(1)
    # As many bands as shingles have about 0.63 of them as minima.
    least = F.transform(F.sequence(F.lit(1), F.size("shingles")), lambda b: F.array_min(F.transform(
        "shingles", lambda s: F.struct(F.xxhash64(s, b).alias("h"), s.alias("s")))))
    return [
        Template(r.name, r.size, r.shingles, minimal_shingles([m.s for m in r.least], r.shingles))
        for r in table.withColumn("least", least).collect()
    ]


SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"


def any_of(shingles: list[str]) -> str:
    """A regular expression for any of some shingles between separators, as a tree of their common beginnings."""

    def branch(rest: set[str]) -> str:
        # Runs of one possible character are written out; a fork lists its characters; an end is empty.
        out = ""
        while len(rest) >= 1 and len({r[:1] for r in rest}) == 1:
            first = next(iter(rest))[:1]
            if not first:
                return out
            out += f"{SEPARATOR}+" if first == " " else re.escape(first)
            rest = {r[1:] for r in rest}
        forks = sorted({r[:1] for r in rest})
        return out + "(?:" + "|".join(branch({r for r in rest if r[:1] == c}) for c in forks) + ")"

    return f"(?:^|{SEPARATOR}){branch(set(shingles))}(?:$|{SEPARATOR})"


def texts(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def scan_licenses(documents: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """Per row: doc_id, n_licenses and the sorted, comma-joined names of the templates it holds. No shuffle."""
    known = prepare(ready(documents.sparkSession), TEMPLATES if templates is None else templates)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if not known:
        return rows.select("doc_id", F.lit(0).cast("long").alias("n_licenses"), F.lit("").alias("licenses"))
    likely = lowered(F.col("text")).rlike(any_of([s for t in known for s in t.minimal]))
    rows = rows.select("doc_id", F.when(likely, word_array(F.col("text"))).alias("words"))
    sizes = sorted({t.size for t in known})
    for size in sizes:
        # Where a template's minimal shingle stands; null in all other texts, so that nothing below runs for them.
        minimal = sorted({s for t in known if t.size == size for s in t.minimal})
        last = F.size("words") - size
        starts = F.when(last >= 0, F.sequence(F.lit(0), last))
        hits = F.filter(starts, lambda i: shingle_at(F.col("words"), i, size).isin(minimal))  # noqa: B023
        rows = rows.withColumn(f"hits_{size}", hits)
        rows = rows.withColumn(f"hits_{size}", F.when(F.size(f"hits_{size}") > 0, F.col(f"hits_{size}")))
    for size in sizes:
        rows = rows.withColumn(f"found_{size}", F.transform(f"hits_{size}", lambda p: shingle_at(F.col("words"), p, size)))  # noqa: B023
    for size in sizes:
        rows = rows.withColumn(f"shingles_{size}", F.when(
            F.size(f"hits_{size}") > 0, F.array_distinct(shingle_array(F.col("words"), F.lit(0), F.size("words") - size, size))))

    def held(t: Template) -> Column:
        agrees = F.arrays_overlap(f"found_{t.size}", texts(t.minimal))
        contained = F.size(F.array_intersect(f"shingles_{t.size}", texts(t.shingles)))
        return F.when(agrees & (contained >= F.lit(CONTAINED * len(t.shingles))), F.lit(t.name))

    names = F.array_compact(F.array(*[held(t) for t in known]))
    return rows.select("doc_id", names.alias("licenses")).select(
        "doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.array_join("licenses", ",").alias("licenses"))
