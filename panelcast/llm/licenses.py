"""Licence scan: TF-IDF cosine to templates, inherited along directories."""

from __future__ import annotations

import json
import math
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import BROADCAST_KEYS, matching, saved

# The licences' own wordings.
#: (licence, wording).  Headers, titles and one-paragraph notices; a licence may have several.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the Software), to deal in the Software without restriction"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser "
                 "General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                     "provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
)
_DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT "
    "NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL "
    "THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
    "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
    "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE "
    "OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_TWO_CLAUSES = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
    "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
    "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
    "following disclaimer in the documentation and/or other materials provided with the distribution. ")
#: (licence, wording) of whole licence files.  The long licences are known by
#: their titles; their full texts can be given to :func:`scan`.
WHOLE = (
    ("MIT", "MIT License Copyright (c) Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the Software), to deal in the Software without restriction, including without limitation "
            "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
            "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and "
            "this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "
            "AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
            "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
            "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
            "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("BSD-2-Clause", _TWO_CLAUSES + _DISCLAIMER),
    ("BSD-3-Clause", _TWO_CLAUSES + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse "
                     "or promote products derived from this software without specific prior written permission. " + _DISCLAIMER),
)
#: Names of files whose licence holds for their directory and those below.
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|notice)([._-].*)?$"
_SPLIT = "[^a-z0-9]+"


def _terms(text: str) -> list[str]:
    import re
    return [t for t in re.split(_SPLIT, text.lower()) if t]


def _tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), _SPLIT), lambda t: t != "")


class Weights:
    """TF-IDF of the templates; document frequencies from the whole corpus.

    Only the templates' own terms (some hundred; more with long ``whole``
    texts) reach the driver: they make the templates' vectors and the gate.
    The frequencies of the words of gated headers stay a table (:meth:`best`)."""

    def __init__(self, files: DataFrame, templates: Sequence[tuple[str, str]], whole: Sequence[tuple[str, str]], threshold: float):
        counts = [(name, Counter(_terms(t)), k >= len(templates)) for k, (name, t) in enumerate([*templates, *whole])]
        vocabulary = sorted({t for _, c, _ in counts for t in c})
        # The empty term, which no text has, counts the texts.
        held = F.array_intersect(_tokens(F.col("text")), F.array(*map(F.lit, vocabulary)))
        seen = (files.where("text IS NOT NULL").select(F.explode(F.concat(F.array(F.lit("")), held)).alias("t"))
                .groupBy("t").agg(F.count(F.lit(1)).alias("n")))
        df = {r.t: r.n for r in seen.collect()}  # at most one row per vocabulary term, and one
        self.n = df.get("", 0)
        idf = {t: math.log((1 + self.n) / (1 + df.get(t, 0))) + 1 for t in vocabulary}
        rows = []
        gate: set[str] = set()
        for k, (name, c, is_whole) in enumerate(counts):
            w = {t: many * idf[t] for t, many in c.items()}
            norm = math.sqrt(sum(x * x for x in w.values()))
            rows += [{"t": t, "k": k, "licence": name, "of_whole": is_whole, "share": x / norm} for t, x in w.items()]
            # cosine <= norm of the matched part: a header without any of the
            # heaviest terms that must not all be missing stays below.  Whole
            # texts are compared without a gate.
            left = 1.0
            for t in sorted(w, key=lambda t: (-w[t], t)):
                if is_whole or left < threshold * threshold:
                    break
                gate.add(t)
                left -= (w[t] / norm) ** 2
        self.gate = r"(?i)(?<![a-z0-9])(?:" + "|".join(sorted(gate)) + ")(?![a-z0-9])"
        #: (t, k, licence, of_whole, share): a row per term of each template.
        self.templates = files.sparkSession.range(1).select(F.explode(F.from_json(
            F.lit(json.dumps(rows)), "array<struct<t string, k int, licence string, of_whole boolean, share double>>"))).select("col.*")

    def best(self, files: DataFrame, headers: DataFrame) -> DataFrame:
        """(h, best) for ``headers`` (h, header, whole): the struct (score,
        licence) of the most similar template, the whole ones for whole texts
        only.  Every word weighs by the number of files that hold it; words
        meet by 64-bit hashes."""
        terms = saved(headers.select("h", "whole", F.explode(_tokens(F.col("header"))).alias("t"))
                      .groupBy("h", "whole", "t").agg(F.count(F.lit(1)).alias("tf")).withColumn("w", F.xxhash64("t")), "terms")
        words = (files.where("text IS NOT NULL").select(F.explode(F.array_distinct(_tokens(F.col("text")))).alias("t"))
                 .select(F.xxhash64("t").alias("w")))
        seen = saved(matching(words, saved(terms.select("w").distinct(), "words"), "w")
                     .groupBy("w").agg(F.count(F.lit(1)).alias("df")), "frequencies")
        few = seen.count() <= BROADCAST_KEYS
        weighed = terms.join(F.broadcast(seen) if few else seen, "w").withColumn(
            "x", F.col("tf") * (F.log((1 + self.n) / (1 + F.col("df"))) + 1))
        norms = weighed.groupBy("h").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
        dots = (weighed.join(F.broadcast(self.templates), "t").where("whole OR NOT of_whole")
                .groupBy("h", "k", "licence").agg(F.sum(F.col("x") * F.col("share")).alias("dot")))
        return dots.join(norms, "h").groupBy("h").agg(
            F.max(F.struct(F.round(F.try_divide("dot", "norm"), 6).alias("score"), "licence")).alias("best"))


def spans(text: Column, gate: str, lines: int, length: int) -> Column:
    """The headers of a text: every line that matches ``gate``, and every run
    of up to ``lines`` consecutive lines around one, of at most ``length``
    characters."""

    def of(parts: Column) -> Column:  # the text's lines, split once
        last = F.size(parts) - 1
        hits = F.filter(F.sequence(F.lit(0), last), lambda i: F.get(parts, i).rlike(gate))
        def around(i):  # runs that hold line i, as first line * lines + further lines
            return F.flatten(F.transform(F.sequence(F.greatest(F.lit(0), i - (lines - 1)), i), lambda a: F.transform(
                F.sequence(i, F.least(last, a + (lines - 1))), lambda b: a.cast("long") * lines + (b - a))))
        runs = F.array_distinct(F.flatten(F.transform(hits, around)))
        made = F.transform(runs, lambda c: F.struct(
            (c % lines).alias("more"),
            F.array_join(F.slice(parts, (F.floor(c / lines) + 1).cast("int"), (c % lines + 1).cast("int")), "\n").alias("span")))
        return F.filter(made, lambda x: (x["more"] == 0) | (F.length(x["span"]) <= length))["span"]

    return F.transform(F.array(F.split(text, "\n")), of)[0]


def scan(files: DataFrame, *, templates: Sequence[tuple[str, str]] = TEMPLATES, whole: Sequence[tuple[str, str]] = WHOLE,
         threshold: float = 0.7, lines: int = 6, licence_file: str = LICENCE_FILE, carry: Sequence[str] = ()) -> DataFrame:
    """(carry..., path, licence, score, how, licence_path) for every row of
    ``files`` (path, text, carry...).

    A header is any line of the whole text, or a run of two to ``lines``
    consecutive lines that is at most twice as long as the longest template:
    notices stand in files as several comment lines.  For files named as
    ``licence_file`` the text as one is a header too, and the only one that is
    compared with the ``whole`` licence texts.  The best template at a cosine of at
    least ``threshold`` is the file's own licence (how = 'own'; ties go to the
    later licence name).  Other files inherit from the nearest ancestor
    directory, their own included, that holds a licence file with a licence
    of its own ('inherited'; licence_path names it; in one directory the best
    score, then the smallest path).  The rest have 'none' and null.

    Null or empty text has no own licence; a null path inherits nothing.
    Repeated rows are judged alike.  Only ``path``, ``text`` and ``carry`` are
    read; a result column replaces a carried one of its name.
    """
    carry = [c for c in carry if c.lower() not in ("path", "text", "licence", "score", "how", "licence_path")]
    at = [F.col(c).alias(f"_carry{k}") for k, c in enumerate(carry)]
    named = [F.col(f"_carry{k}").alias(c) for k, c in enumerate(carry)]
    files = files.select(*at, "path", "text")
    kept = [f"_carry{k}" for k in range(len(carry))]
    weights = Weights(files, templates, whole, threshold)
    name = F.element_at(F.split("path", "/"), -1)
    is_file = F.coalesce(name.rlike(licence_file), F.lit(False))
    gated = F.col("text").rlike(weights.gate)
    most = 2 * max((len(t) for _, t in templates), default=0)
    # One pass over the texts: judgements go by the text and whether it is a
    # licence file's.  Texts without a header get keys of their own, so that they spread in a shuffle.
    some = F.when(gated, spans(F.col("text"), weights.gate, lines, most))
    judgeable = F.coalesce(gated | is_file & F.col("text").isNotNull(), F.lit(False))
    key = F.when(judgeable, F.md5("text")).otherwise(F.concat(F.lit("-"), F.xxhash64("path", *kept).cast("string")))
    folder = F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.when(F.col("path").isNotNull(), ""))
    seen = saved(files.select(*kept, "path", folder.alias("dir"), is_file.alias("is_file"), key.alias("key"), some.alias("spans"),
                              F.when(is_file, F.col("text")).alias("whole")), "files")
    # Equal headers are scored once.
    met = saved(seen.select("key", "is_file", F.explode("spans").alias("header"), F.lit(False).alias("whole"))
                .union(seen.where("whole IS NOT NULL").select("key", "is_file", "whole", F.lit(True)))
                .withColumn("h", F.concat(F.md5("header"), F.col("whole").cast("string"))).distinct(), "headers")
    best = weights.best(files, met.groupBy("h").agg(F.any_value("header").alias("header"), F.any_value("whole").alias("whole")))
    judged = saved(met.select("key", "is_file", "h").distinct().join(best, "h")
                   .groupBy("key", "is_file").agg(F.max("best").alias("found")), "judged")
    few = judged.count() <= BROADCAST_KEYS
    own = saved(seen.select(*kept, "path", "dir", "key", "is_file")
        .join(F.broadcast(judged) if few else judged, ["key", "is_file"], "left").select(*kept, "path", "dir", "is_file", "found")
        .withColumn("found", F.when(F.col("found.score") >= threshold, F.col("found"))), "own")
    # One row per directory that holds a licence; min over (-score, path) prefers the best, then the first.
    holders = (own.where("is_file AND found IS NOT NULL AND path IS NOT NULL").groupBy("dir")
               .agg(F.min(F.struct((-F.col("found.score")).alias("neg"), "path", "found.licence")).alias("h"))
               .select(F.col("dir").alias("above"), (-F.col("h.neg")).alias("h_score"), F.col("h.path").alias("h_path"), F.col("h.licence").alias("h_licence")))
    # Distinct directories first: a directory with many files joins once.
    parts = F.split("dir", "/")
    up = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    dirs = own.where("dir IS NOT NULL").select("dir").distinct().withColumn("above", F.explode(F.array_distinct(up)))
    nearest = (dirs.join(holders, "above").groupBy("dir")
               .agg(F.max_by(F.struct("h_licence", "h_score", "h_path"), F.length("above")).alias("near")))
    mine = F.col("found").isNotNull()
    return (own.join(nearest, "dir", "left").select(
        *named, "path",
        F.when(mine, F.col("found.licence")).otherwise(F.col("near.h_licence")).alias("licence"),
        F.when(mine, F.col("found.score")).otherwise(F.col("near.h_score")).alias("score"),
        F.when(mine, "own").when(F.col("near").isNotNull(), "inherited").otherwise("none").alias("how"),
        F.when(mine, F.col("path")).otherwise(F.col("near.h_path")).alias("licence_path")))
