"""License scan with column expressions only.

Words of a text are its runs of letters and digits in lower case. Texts are
cut into overlapping windows sized by the templates. MinHash signatures of the
windows' word shingles are banded (one hash a band); the number of bands
follows from the lowest Jaccard similarity that a window with a match can have,
so that a match collides with probability of at least ``certainty``. Windows
that collide with a template are verified by exact shingle containment.

Each text is cut into words once; every word becomes a 64-bit hash, and every
place of the text a hash of its shingle. Only places whose hash belongs to the
templates' set are kept (the set is a parameter, looked up by hash). A match
holds the needed number of a template's shingles, so texts, and then windows,
with fewer such places are left out before MinHash, which loses nothing. What
is left is written once as a narrow table that all window sizes read.

Templates of different licenses may share most of their wording (BSD-2 and
BSD-3, the GNU headers). A template that matches a window beside such a rival
counts unless the window lacks most of what only this template has, and holds
more of what only the rival has. A short notice that is part of a text of
another license (the first BSD sentence) does not count inside that text.

Only the template side is broadcast; its size is the number of templates times
bands, both parameters. Texts are never shuffled: windows that collide leave
the scan as narrow rows.

Defined results: a null or empty text, or a table without rows, matches
nothing. A template of fewer than ``k`` words is one shingle of all its words.
Rows with the same id and text are reported once; null ids are ids like
others. Only id and text are read.
"""

from __future__ import annotations

import functools
import math
import operator
import re
from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillbook.llm.common import document_key, stored

# fixed values: usual one-line license notices
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("all-rights-reserved", "All rights reserved."),
]
# full texts (licenses/*.txt) that name themselves by their file
TEXTS = ["Apache-2.0", "MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Unlicense", "CC0-1.0", "MPL-2.0", "GPL-2.0", "GPL-3.0",
         "LGPL-2.1", "LGPL-3.0", "AGPL-3.0"]
APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable
law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations
under the License."""
MPL_HEADER = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""
GNU_HEADER = """This {noun} is free software; you can redistribute it and/or modify it under the terms of the GNU {kind} {grant}.
This {noun} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} for more details. You should have received a copy of the
GNU {kind} along with this {noun}"""
LATER = "as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version"
ONLY = "version {} as published by the Free Software Foundation"
GNU = [("GPL-2.0", "General Public License", "2"), ("GPL-3.0", "General Public License", "3"),
       ("LGPL-2.1", "Lesser General Public License", "2.1"), ("LGPL-3.0", "Lesser General Public License", "3"),
       ("AGPL-3.0", "Affero General Public License", "3")]
NOT_WORD = "[^\\p{L}\\p{N}]+"


def license_texts() -> list[tuple[str, str]]:
    """The licenses' full texts and standard file headers."""
    folder = files("tillbook.llm") / "licenses"
    return ([(name, (folder / f"{name}.txt").read_text("utf-8")) for name in TEXTS]
            + [("Apache-2.0", APACHE_HEADER), ("MPL-2.0", MPL_HEADER)]
            + [(name, GNU_HEADER.format(noun=noun, kind=kind, grant=grant.format(version)))
               for name, kind, version in GNU for noun in ("program", "library") for grant in (LATER, ONLY)])


def template_words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def words_of(text: Column) -> Column:
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD, " "))
    return F.filter(F.split(plain, " "), lambda w: w != "")


def shingles_of(words: Column, k: int) -> Column:
    last = F.size(words) - (k - 1)
    every = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(words, i, k), " "))
    return F.when(last >= 1, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def signature(shingles: Column, bands: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(bands)),
                       lambda b: F.array_min(F.transform(shingles, lambda s: F.xxhash64(s, b))))


def shingle_set(words: list[str], k: int) -> set[tuple[str, ...]]:
    return {tuple(words[i:i + k]) for i in range(len(words) - k + 1)}


def template_hashes(spark: SparkSession, words: list[list[str]], k: int) -> list[int]:
    """64-bit hashes of the templates' shingles of ``k`` words, as the scan
    computes them."""
    part = spark.createDataFrame([(w,) for w in words], "words array<string>").select(word_hashes(F.col("words")).alias("hashed"))
    return sorted(r[0] for r in part.select(F.explode(F.expr(f"transform(sequence(1, size(hashed) - {k - 1}), i -> {shingle_hash(k)})"))).distinct().collect())


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def shingle_hash(k: int) -> str:
    """Of the shingle at place i (from 1) of the array ``hashed``."""
    return f"xxhash64({', '.join(f'hashed[i + {j - 1}]' for j in range(k))})"


def known_places(hashes: dict[int, list[int]]) -> str:
    """SQL for the words (column ``words``) and, by shingle size k, a string
    ``places_k`` with a 1 for every place whose shingle's hash is in the set and
    a 0 for every other. The words and their hashes are bound by lambdas, so
    that each is computed once a text, and the generator keeps filters on the
    result above it."""
    flags = "".join(
        f", 'places_{k}', if(size(hashed) >= {k}, array_join(transform(sequence(1, size(hashed) - {k - 1}), "
        f"i -> if({shingle_hash(k)} in ({', '.join(map(str, known))}), '1', '0')), ''), '')" for k, known in hashes.items())
    return (f"inline(transform(array(words), words -> transform(array(transform(words, w -> xxhash64(w))), "
            f"hashed -> named_struct('words', words{flags}))[0]))")


def ones(flags: Column) -> Column:
    return F.length(F.translate(flags, "0", ""))


def bands_for(similarity: float, certainty: float) -> int:
    """Bands of one hash each, so that a pair of this similarity collides."""
    return max(1, math.ceil(math.log(1 - certainty) / math.log(1 - min(similarity, 1 - 1e-9))))


def license_scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, id_col: str = "doc_id",
                 text_col: str = "text", k: int = 5, containment: float = 0.8, certainty: float = 1 - 1e-6) -> DataFrame:
    """One row per document and license found: id, license, containment (the
    best window's), first_word (where the first matching window starts, from
    0), n_windows (matching windows)."""
    spark = docs.sparkSession
    known: list[tuple[str, list[str], int, int]] = []  # license, words, window size, shingle size
    for name, text in TEMPLATES + license_texts() if templates is None else templates:
        words = template_words(text)
        if words:
            size = 16
            while size < len(words):
                size *= 2
            known.append((name, words, size, min(k, len(words))))
    sets = [shingle_set(w, own_k) for _, w, _, own_k in known]
    needs = [math.ceil(containment * len(s) - 1e-9) for s in sets]
    groups: dict[tuple[int, int], list[int]] = {}
    for t, (_, _, size, own_k) in enumerate(known):
        groups.setdefault((size, own_k), []).append(t)
    src = docs.select(*document_key(id_col, text_col), F.col(text_col).alias("text"))
    if not known:
        return src.limit(0).select(F.col("k_id").alias("id"), F.lit("").alias("license"), F.lit(0.0).alias("containment"),
                                   F.lit(0).alias("first_word"), F.lit(0).cast("long").alias("n_windows"))
    widths = sorted({own_k for _, own_k in groups})
    hashes = {w: template_hashes(spark, [known[t][1] for (_, own_k), members in groups.items() if own_k == w for t in members], w)
              for w in widths}
    fewest = {w: min(needs[t] for (_, own_k), members in groups.items() if own_k == w for t in members) for w in widths}
    enough = functools.reduce(operator.or_, [ones(F.col(f"places_{w}")) >= fewest[w] for w in widths])
    marked = stored(src.select("k_id", "k_text", words_of(F.col("text")).alias("words"))
                    .selectExpr("k_id", "k_text", known_places(hashes)).filter(enough), "license-places")
    found = None
    for (size, own_k), members in groups.items():
        length, step = 2 * size, size // 2
        need = min(needs[t] for t in members)
        most = max(len(known[t][1]) - own_k + 1 for t in members)
        lowest = min(needs[t] / (length - own_k + 1 + most - needs[t]) for t in members)
        bands = bands_for(lowest, certainty)
        joined = lambda part: [" ".join(s) for s in part]
        rivals = {t: [o for o in members if known[o][0] != known[t][0]
                      and 2 * len(sets[t] & sets[o]) >= min(len(sets[t]), len(sets[o]))] for t in members}
        texts = spark.createDataFrame(
            [(t, known[t][0], joined(sets[t]), [(joined(sets[o]), joined(sets[t] - sets[o]), joined(sets[o] - sets[t])) for o in rivals[t]])
             for t in members],
            "template int, license string, t_shingles array<string>, "
            "rivals array<struct<every:array<string>,mine:array<string>,other:array<string>>>")
        marks = texts.select("template", F.posexplode(signature(F.col("t_shingles"), bands)).alias("band", "hash"))
        places = f"places_{own_k}"
        windows = (marked.filter(ones(F.col(places)) >= need)
                   .withColumn("first_word", F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)), F.lit(step))))
                   .filter(ones(F.substring(places, F.col("first_word") + 1, F.lit(length - own_k + 1))) >= need)
                   .select("k_id", "k_text", "first_word", F.slice("words", F.col("first_word") + 1, length).alias("window")))
        windows = windows.withColumn("shingles", shingles_of(F.col("window"), own_k)).drop("window")
        banded = windows.select("*", F.posexplode(signature(F.col("shingles"), bands)).alias("band", "hash"))

        def share(part: Column) -> Column:
            return F.when(F.size(part) > 0, F.size(F.array_intersect("shingles", part)) / F.size(part)).otherwise(F.lit(0.0))

        outdone = F.exists("rivals", lambda r: (share(r["every"]) >= containment - 1e-9) & (share(r["mine"]) < 0.5)
                           & (share(r["other"]) > share(r["mine"])))
        pairs = (banded.join(F.broadcast(marks), ["band", "hash"])  # templates times bands narrow rows
                 .join(F.broadcast(texts), "template")  # one row per template
                 .withColumn("containment", share(F.col("t_shingles")))
                 .filter(F.col("containment") >= containment - 1e-9))
        if any(rivals.values()):
            pairs = pairs.filter(~outdone)
        pairs = pairs.select("k_id", "k_text", "template", "license", "first_word", F.lit(length).alias("length"),
                             "containment")
        found = pairs if found is None else found.unionByName(pairs)
    # notices that are part of a longer text of another license
    inside = {t: [o for o, (name, w, size, _) in enumerate(known) if name != known[t][0] and size > known[t][2]
                  and len(shingle_set(w, known[t][3]) & sets[t]) >= needs[t]] for t in range(len(known))}
    inside = {t: others for t, others in inside.items() if others}
    if inside:
        hits = found.groupBy("k_id", "k_text").agg(F.collect_set(F.struct(
            "template", "license", "first_word", "length", "containment")).alias("hits"))
        for t, others in inside.items():
            around = F.filter("hits", lambda h: h["template"].isin(*others))
            hits = hits.withColumn("around", around).withColumn("hits", F.filter("hits", lambda h: (h["template"] != t) | ~F.exists(
                "around", lambda o: (h["first_word"] >= o["first_word"] - h["length"])
                & (h["first_word"] < o["first_word"] + o["length"]))))
        found = hits.select("k_id", "k_text", F.explode("hits").alias("h")).select("k_id", "k_text", "h.*")
    return (found.groupBy("k_id", "k_text", "license")
            .agg(F.max("containment").alias("containment"), F.min("first_word").alias("first_word"),
                 F.count_distinct("first_word").alias("n_windows"))
            .select(F.col("k_id").alias("id"), "license", "containment", "first_word", "n_windows"))
