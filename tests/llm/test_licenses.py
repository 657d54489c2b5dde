"""Licence headers over several lines, whole licence texts, and odd rows."""

import os
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.llm import licenses

GPL_NOTICE = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
"""
SYSTEM = "/usr/share/common-licenses"


def wrapped(text, width=70):
    out = [""]
    for w in text.split():
        if len(out[-1]) + len(w) > width:
            out.append("")
        out[-1] += " " * bool(out[-1]) + w
    return "\n".join(out)


def prose(n):
    return [(f"p/{k}.txt", f"the code and the terms of file {k}\nas it is, to any person\nin the work number {k} of all") for k in range(n)]


def test_notices_over_several_lines_and_whole_files(spark):
    whole = dict(licenses.WHOLE)
    rows = prose(300) + [
        ("g/a.py", "import os\n\n" + GPL_NOTICE + "\nprint(1)\n"),
        ("m/LICENSE", "Copyright 2020 Somebody Else\n\n" + wrapped(whole["MIT"])), ("m/src/x.c", "int x;"),
        ("b/COPYING", wrapped(whole["BSD-3-Clause"], 60)), ("b/y.c", "int y;"), ("b2/LICENSE.txt", wrapped(whole["BSD-2-Clause"], 60)),
        ("w/x.txt", "a line\n" + "\n".join("// " + x for x in wrapped(licenses.TEMPLATES[1][1], 40).split("\n")) + "\nmore"),
        ("t/LICENSE", "                 Apache License\n           Version 2.0, January 2004\n        http://www.apache.org/licenses/\n\n"
                      + "\n".join(f"words {k} of terms" for k in range(2000))), ("t/u/v.py", "pass"),
        ("l/COPYING", "  GNU LESSER GENERAL PUBLIC LICENSE\n     Version 3, 29 June 2007\n\n Everyone is here"),
        ("g2/COPYING", "  GNU GENERAL PUBLIC LICENSE\n     Version 2, June 1991\n\n Everyone is here")]
    want = {"g/a.py": ("GPL-3.0", "own"), "m/LICENSE": ("MIT", "own"), "m/src/x.c": ("MIT", "inherited"),
            "b/COPYING": ("BSD-3-Clause", "own"), "b/y.c": ("BSD-3-Clause", "inherited"), "b2/LICENSE.txt": ("BSD-2-Clause", "own"),
            "w/x.txt": ("Apache-2.0", "own"), "t/LICENSE": ("Apache-2.0", "own"), "t/u/v.py": ("Apache-2.0", "inherited"),
            "l/COPYING": ("LGPL-3.0", "own"), "g2/COPYING": ("GPL-2.0", "own")}
    for name, licence in (("Apache-2.0", "Apache-2.0"), ("GPL-3", "GPL-3.0"), ("LGPL-3", "LGPL-3.0"), ("MPL-2.0", "MPL-2.0")):
        if os.path.exists(f"{SYSTEM}/{name}"):  # the files as they are handed out
            with open(f"{SYSTEM}/{name}") as f:
                rows += [(f"sys/{name}/LICENSE", f.read()), (f"sys/{name}/deep/down/z.go", "package z")]
            want |= {f"sys/{name}/LICENSE": (licence, "own"), f"sys/{name}/deep/down/z.go": (licence, "inherited")}
    got = {r.path: (r.licence, r.how) for r in licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert {p: got[p] for p in want} == want
    assert {got[p] for p, _ in rows if p.startswith("p/")} == {(None, "none")}


def test_a_given_whole_text(spark):
    mine = "You may do with these bits as you please on Tuesdays.\nOn other days you ask their keeper.\nNo refunds."
    rows = prose(50) + [("k/LICENSE", mine + "\nKept by K."), ("k/b.txt", "bits"), ("n/readme.txt", mine)]
    got = {r.path: (r.licence, r.how) for r in licenses.scan(
        spark.createDataFrame(rows, "path string, text string"), whole=[("Tuesday", mine)]).collect()}
    # Whole texts are compared with whole licence files only.
    assert got["k/LICENSE"] == ("Tuesday", "own") and got["k/b.txt"] == ("Tuesday", "inherited") and got["n/readme.txt"] == (None, "none")


@pytest.mark.parametrize("lines", [1, 2, 4])
def test_scores_of_runs_by_brute_force(spark, lines):
    texts = [GPL_NOTICE, "the\n" + GPL_NOTICE + "the", "Released under\nthe MIT\nLicense.", "Released\n\nunder the MIT License\n", "Licensed under CC\nBY-NC 4.0.",
             "the License\nthe version", None, "", "\n\n", "Licensed under the Apache License,\nVersion 2.0.\nReleased under the MIT License."] * 2
    files = spark.createDataFrame([(f"d{k}/x.txt", t) for k, t in enumerate(texts)], "path string, text string")
    there = [licenses._terms(t) for t in texts if t is not None]
    idf = lambda w: np.log((1 + len(there)) / (1 + sum(w in t for t in there))) + 1
    vector = lambda t: {w: k * idf(w) for w, k in Counter(licenses._terms(t)).items()}
    size = lambda v: np.sqrt(sum(x * x for x in v.values()))
    known = [(n, vector(t)) for n, t in licenses.TEMPLATES]
    most = 2 * max(len(t) for _, t in licenses.TEMPLATES)

    def score(header):
        v = vector(header)
        return max((round(sum(x * t.get(w, 0) for w, x in v.items()) / size(v) / size(t), 6), n) for n, t in known) if v else (0, "")

    got = {r.path: (r.score, r.licence) for r in licenses.scan(files, lines=lines).collect()}
    for k, t in enumerate(texts):
        parts = (t or "").split("\n")
        runs = ["\n".join(parts[a : a + n]) for n in range(1, lines + 1) for a in range(len(parts) - n + 1)]
        want = max(score(h) for h in runs if "\n" not in h or len(h) <= most)
        assert got[f"d{k}/x.txt"] == ((pytest.approx(want[0], abs=2e-6), want[1]) if want[0] >= 0.7 else (None, None)), t


def test_ties_long_texts_clashing_columns_and_no_rows(spark):
    long_text = "\n".join(f"word {k}" + " license" * (k % 20 == 0) for k in range(60000)) + "\nReleased under the MIT License."
    rows = [("a/LICENSE", "Released under the MIT License.", 1), ("a/COPYING", "Released under the MIT License.", 2), ("a/b/c.txt", "x", 3),
            ("a/b/c.txt", "x", 3), ("e/long.txt", long_text, 4), (None, None, 5), ("f/LICENSE", None, 6), ("f/LICENSE2", "", 7)]
    files = spark.createDataFrame(rows, "path string, text string, doc_id long").select(
        "*", *[F.lit("mine").alias(c) for c in ("licence", "score", "how", "dir", "key", "spans", "whole", "found", "is_file", "near", "h")])
    # A tie within a directory goes to the smallest path.
    out = licenses.scan(files, carry=["doc_id", "licence", "dir", "key", "spans", "whole", "found", "near", "h"])
    assert out.columns == ["doc_id", "dir", "key", "spans", "whole", "found", "near", "h", "path", "licence", "score", "how", "licence_path"]
    got = Counter((r.doc_id, r.licence, r.how, r.licence_path, r.key) for r in out.collect())
    assert got == Counter({(1, "MIT", "own", "a/LICENSE", "mine"): 1, (2, "MIT", "own", "a/COPYING", "mine"): 1,
                           (3, "MIT", "inherited", "a/COPYING", "mine"): 2, (4, "MIT", "own", "e/long.txt", "mine"): 1,
                           (5, None, "none", None, "mine"): 1, (6, None, "none", None, "mine"): 1, (7, None, "none", None, "mine"): 1})
    assert licenses.scan(files.limit(0), carry=["doc_id"]).count() == 0
