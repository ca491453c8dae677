"""Licence scans: MinHash bands over overlapping windows retrieve templates, exact containment verifies.

Templates are put into classes by size; the block of a class is a power of two that holds its
templates with a quarter more, for words put in between. A text is read in windows of two blocks
that overlap by half, so a notice or a whole licence lies in one window. The sketch of a window or
of a template is its smallest shingle hash in each of `BINS` bins (one permutation, a band per bin),
and the two meet if they agree in any band. The setting makes that near certain: `miss_bound` is
below 1 in 1,000 for a template of which 0.8 lies in a window, whatever its length, and below 1 in
100,000 beyond ten shingles. A template of one shingle is its own band and is never missed.

What meets is verified once: the template's distinct shingles that stand in the window are counted
as text. Templates come from a list or a table and are dealt into passes of about PASS shingles,
which are broadcast; a template is whole in its pass. In each pass only texts with one of the words
that its templates can't do without are looked at (`anchors`), which loses nothing. These texts are
written once, so that retrieval and verification see the same rows; no other text is moved. All
steps are DataFrame operations.
"""

from __future__ import annotations

import math
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskscan.llm.tables import saved, whole

#: Words in a shingle, containment that counts.
WORDS, THRESHOLD = 5, 0.8
#: Bands of a sketch.
BINS = 256
#: Shingles of templates in a pass, about: so many are broadcast.
PASS = 200_000
WORD = "[\\p{L}\\p{N}_]+"

# Notices as licences and their users word them, with SPDX names.
NOTICES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
        "either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License v3.0."),
    ("GPL-2.0", "Licensed under the GNU General Public License v2.0."),
    (
        "GPL",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in "
        "the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ),
    ("LGPL", "Licensed under the GNU Lesser General Public License."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License."),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
        "this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    (
        "BSD",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies.",
    ),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0."),
]

#: Whole licence texts: a file per SPDX name.
TEXTS = Path(__file__).with_name("licence_texts")


def known() -> list[tuple[int, str, str]]:
    """The notices and the whole licence texts, numbered."""
    bodies = [(path.stem, path.read_text(encoding="utf-8")) for path in sorted(TEXTS.glob("*.txt"))]
    return [(n, licence, text) for n, (licence, text) in enumerate([*NOTICES, *bodies])]


def words_of(text: str) -> list[str]:
    return re.findall(r"\w+", text.lower())


def shingles_of(text: str, size: int = WORDS) -> list[str]:
    """Distinct shingles of a template; fewer words are one shingle."""
    words = words_of(text)
    return list(dict.fromkeys(" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))) if words else []


def block_of(shingles: int, threshold: float = THRESHOLD) -> int:
    """The block of a template's class: it holds the template and the words put into it."""
    return 1 if shingles == 1 else 1 << math.ceil(math.log2(shingles / threshold))


def window_of(block: int) -> int:
    return 1 if block == 1 else 2 * block


def miss_bound(shingles: int, threshold: float = THRESHOLD) -> float:
    """Upper bound of the probability that a template with enough shingles in a window is not retrieved.

    Of `all_` different shingles of both, `held` are in both. Taken by rising hash, the i-th is one
    of these with a probability of held / all_, and the first of its bin with at least 1 - (i - 1) / BINS: then
    a band agrees. With few shingles a closer bound: each of those held has to be hidden by a smaller one.
    """
    if shingles <= 1:
        return 0.0
    held = math.ceil(threshold * shingles)
    all_ = window_of(block_of(shingles, threshold)) + shingles - held
    none = math.prod(1 - held / all_ * (1 - i / BINS) for i in range(min(all_, BINS)))
    return min(none, min(1.0, (all_ - 1) / BINS) ** held)


def anchors(templates: list[tuple[int, str, str]], threshold: float = THRESHOLD) -> list[str]:
    """Words of which a text must have one to hold any template.

    For each template, words are taken, the rarest among the templates' letters first (the longest),
    until the shingles without any of them are too few for the threshold.
    """
    taken: set[str] = set()
    for _, _, text in templates:
        own = [set(s.split(" ")) for s in shingles_of(text)]
        for word in sorted(set(words_of(text)), key=lambda w: (w not in taken, -len(w), w)):
            without = sum(not (s & taken) for s in own)
            if not own or without < threshold * len(own):
                break
            taken.add(word)
    return sorted(taken)


def _hash(shingle: Column) -> Column:
    return F.xxhash64(shingle)


def _shingles(words: Column, size: int | Column = WORDS) -> Column:
    last = F.greatest(F.lit(1), F.size(words) - size + 1)
    return F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(words, i, size), " "))


def sketch(hashes: Column) -> Column:
    """The smallest hash of each bin that has any."""
    placed = F.array_sort(F.transform(hashes, lambda h: F.struct((F.shiftrightunsigned(h, 32) % BINS).alias("bin"), h.alias("hash"))))
    # The sorted array is bound to a name, so that it is made once and not for each of its members.
    firsts = F.transform(F.array(placed), lambda s: F.filter(s, lambda x, i: (i == 0) | (F.get(s, i - 1)["bin"] != x["bin"])))
    return F.transform(F.get(firsts, F.lit(0)), lambda x: x["hash"])


def template_table(spark: SparkSession, templates: list[tuple[int, str, str]]) -> DataFrame:
    """template, licence, text."""
    quoted = lambda text: "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"
    rows = [f"({int(number)}, {quoted(licence)}, {quoted(text)})" for number, licence, text in templates] or ["(0, '', '')"]
    return spark.sql(f"select * from values {', '.join(rows)} as t(template, licence, text)")


def template_sketches(templates: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """template, licence, _text, _size, _n, _block, _own, _bands: each template with its distinct shingles and its sketch; saved.

    `_size` is the words of its shingles: five, or all it has if they are fewer.
    """
    words = F.regexp_extract_all(F.lower(whole("text")), F.lit(WORD), F.lit(0))
    own = templates.select("template", "licence", whole("text").alias("_text"), words.alias("_words")).filter(F.size("_words") > 0)
    own = own.withColumn("_size", F.least(F.lit(WORDS), F.size("_words"))).withColumn("_own", F.array_distinct(_shingles(F.col("_words"), F.col("_size"))))
    n = F.size("_own")
    block = F.when(n == 1, 1).otherwise(F.pow(F.lit(2.0), F.ceil(F.log2(n / threshold))).cast("int"))
    bands = sketch(F.transform("_own", _hash))
    return saved(own.select("template", "licence", "_text", "_size", n.alias("_n"), block.alias("_block"), "_own", bands.alias("_bands")), "licence_sketches")


def _any_of(words: list[str]) -> str:
    """A pattern for a text that holds one of the words; words with the same first letter are tried together."""
    starts: dict[str, list[str]] = {}
    for word in words:
        starts.setdefault(word[0], []).append(re.escape(word[1:]))
    return "(?<![\\p{L}\\p{N}_])(?:" + "|".join(f"{re.escape(first)}(?:{'|'.join(rest)})" for first, rest in starts.items()) + ")" if starts else "^$a"


def _retrieved(rows: DataFrame, own: DataFrame, blocks: list[int]) -> DataFrame:
    """_row, _block, _start, licence, template: the windows of classes of several shingles that agree with a template in a band."""
    bands = own.filter("_block > 1").select("_block", "licence", "template", F.explode("_bands").alias("_value"))
    hashes = F.transform(_shingles(F.col("_words")), _hash)
    spans = rows.select("_row", hashes.alias("_hashes")).withColumn("_block", F.explode(F.array(*map(F.lit, blocks))))
    starts = F.sequence(F.lit(1), F.size("_hashes"), F.col("_block"))
    cut = F.transform(starts, lambda i: F.struct(i.alias("start"), sketch(F.slice("_hashes", i, 2 * F.col("_block"))).alias("bands")))
    windows = spans.select("_row", "_block", F.explode(cut).alias("_w")).select("_row", "_block", F.col("_w.start").alias("_start"), F.explode("_w.bands").alias("_value"))
    met = windows.join(F.broadcast(bands), ["_block", "_value"])
    return met.select("_row", "_block", "_start", "licence", "template").distinct()


def _verified(rows: DataFrame, met: DataFrame, own: DataFrame, threshold: float) -> DataFrame:
    """_row, licence, template, _start, _share: what was retrieved and holds enough of the template's shingles, as text."""
    named = own.select(F.col("licence").alias("_l"), F.col("template").alias("_t"), "_own", "_n")
    same = met["licence"].eqNullSafe(F.col("_l")) & met["template"].eqNullSafe(F.col("_t"))
    window = F.slice("_words", F.col("_start"), 2 * F.col("_block") + WORDS - 1)
    share = F.size(F.array_intersect("_own", _shingles(window))) / F.col("_n")
    found = rows.join(met, "_row").join(F.broadcast(named), same).select("_row", "licence", "template", "_start", share.alias("_share"))
    return found.filter(F.col("_share") >= threshold)


def _single(rows: DataFrame, own: DataFrame, sizes: list[int]) -> DataFrame:
    """The same for templates of one shingle, of five words or fewer: the shingle itself is looked up."""
    out = None
    for size in sizes:
        at = F.posexplode(_shingles(F.col("_words"), size)).alias("_at", "_shingle")
        each = rows.filter(F.size("_words") >= size).select("_row", at)
        wanted = own.filter((F.col("_block") == 1) & (F.col("_size") == size)).select("licence", "template", F.get("_own", F.lit(0)).alias("_shingle"))
        found = each.join(F.broadcast(wanted), "_shingle").select("_row", "licence", "template", (F.col("_at") + 1).alias("_start"), F.lit(1.0).alias("_share"))
        out = found if out is None else out.unionByName(found)
    return out


def licensed(
    df: DataFrame, templates: DataFrame | list[tuple[int, str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """doc_id, licence, template, containment, first_word: the templates that a text holds.

    One row per input row and template: the largest share of the template's distinct five-word
    shingles (lower case, words only) in one window, if it is at least the threshold, and the number
    of the word where the first such window begins. A template of fewer than five words is one
    shingle of all its words, held by a text in which they stand in a row. Null and empty texts and
    templates hold nothing and match nothing. Repeated rows are reported each. Only the two named
    columns are read. templates: a table with template, licence and text or a list of these, of any
    number and length; else `known`.
    """
    spark = df.sparkSession
    given = templates if isinstance(templates, DataFrame) else template_table(spark, known() if templates is None else templates)
    sketches = template_sketches(given, threshold)
    passes = max(1, -(-(sketches.agg(F.sum("_n")).first()[0] or 0) // PASS))
    source = df.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("doc_id"), F.lower(whole(text_col)).alias("_text"))
    schema = sketches.schema
    out = None
    for number in range(passes):
        own = sketches.filter(F.pmod(F.xxhash64("template", "licence"), F.lit(passes)) == number)
        # About PASS shingles: the words that its templates need, and which classes there are.
        listed = own.select("template", "licence", "_text", "_block", "_size").collect()
        must = _any_of(anchors([(r["template"], r["licence"], r["_text"]) for r in listed], threshold))
        rows = saved(source.filter(F.col("_text").rlike(must)).select("_row", "doc_id", F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)).alias("_words")), "licence_texts")
        blocks, sizes = sorted({r["_block"] for r in listed if r["_block"] > 1}), sorted({r["_size"] for r in listed if r["_block"] == 1})
        parts = []
        if blocks:
            parts.append(_verified(rows, saved(_retrieved(rows, own, blocks), "licence_windows"), own, threshold))
        if sizes:
            parts.append(_single(rows, own, sizes))
        for matched in parts:
            best = matched.groupBy("_row", "licence", "template").agg(F.max("_share").alias("containment"), F.min("_start").alias("first_word"))
            best = best.join(rows.select("_row", "doc_id"), "_row").select("doc_id", "licence", "template", "containment", "first_word")
            out = best if out is None else out.unionByName(best)
    if out is not None:
        return out
    kinds = f"doc_id {source.schema['doc_id'].dataType.simpleString()}, licence {schema['licence'].dataType.simpleString()}, template {schema['template'].dataType.simpleString()}"
    return spark.createDataFrame([], f"{kinds}, containment double, first_word int")
