"""Spelling variants against counting in plain Python and the edit distance of all pairs."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from panelcast.llm import spelling
from panelcast.llm.common import read
from panelcast.llm.queries import QUERIES


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def neighbours(words):
    """By deleting one code point: words that share what is left."""
    left, out = {}, {w: set() for w in words}
    for w in words:
        for i in range(len(w)):
            left.setdefault(w[:i] + w[i + 1 :], set()).add(w)
        left.setdefault(w, set()).add(w)
    for group in left.values():
        for a in group:
            out[a].update(b for b in group if one_edit(a, b))
    return out


def counted(rows, min_length=7, min_count=2, every=31):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= min_length:
                n[run] += 1
    return {w: c for w, c in n.items() if c >= min_count}


def expected(n, factor=10):
    near, out = neighbours(n), {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        out[w] = best if best is not None and n[best] >= factor * n[w] else None
    rows = set()
    for w in n:
        root = w
        while out[root] is not None:
            root = out[root]
        rows.add((w, n[w], len(near[w]), out[w], None if out[w] is None else n[out[w]], root))
    return rows


def texts(seed, n_docs=80):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(6, 12))) for _ in range(40)]
    docs = []
    for i in range(n_docs):
        words = []
        for _ in range(60):
            w = base[min(int(rng.expovariate(0.2)), 39)]
            if rng.random() < 0.15:
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + "x" + w[k:], w[:k] + "y" + w[k + 1 :]])
            words.append(rng.choice([w, w.upper(), w.title()]))
        docs.append((i, rng.choice([" ", ", ", "_", "中"]).join(words)))
    return docs


@pytest.mark.parametrize("options", [{}, {"every": 3}, {"min_length": 3, "factor": 2, "min_count": 1}, {"every": 0, "factor": 4}])
def test_variants_equal_brute_force(spark, make_docs, options):
    rows = texts(len(options)) + [(None, "Großartig großartig"), (3, None), (4, ""), (5, "aaaaaaa " * 30), (6, "aaaaaab aaaaaac " * 2)]
    rows += rows[:5]
    out = spelling.variants(make_docs(rows).repartition(6), **options)
    factor = options.pop("factor", 10)
    want = expected(counted(rows, **options), factor)
    got = [tuple(r) for r in out.select("word", "n", "n_near", "form", "form_n", "root").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert any(r[3] for r in want) and any(r[2] > 1 for r in want)


def test_large_lists_are_split(spark, make_docs, monkeypatch):
    monkeypatch.setattr(spelling, "GROUP", 3)
    monkeypatch.setattr(spelling, "SCAN_ROWS", 5)
    monkeypatch.setattr(spelling, "HELD", 4)
    monkeypatch.setattr(spelling, "PART_BYTES", 30)
    rng = random.Random(9)
    words = ["prefix" + "".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) + "suffix" for _ in range(150)]
    words += ["aaaaaaaaa", "aaaaaaaaaa", "aaaaaaaaaaa", "aaaaaaaaab", "baaaaaaaaa"]  # one edit in several places
    rows = [(i, " ".join(rng.choices(words, k=40))) for i in range(30)]
    got = {tuple(r) for r in spelling.variants(make_docs(rows)).select("word", "n", "n_near", "form", "form_n", "root").collect()}
    assert got == expected(counted(rows))


@pytest.mark.parametrize("seed", range(20))
def test_scan_of_one_list_equals_all_pairs(seed):
    rng = random.Random(seed)
    alphabet = rng.choice(["ab", "abcé", "abcdefgh"])
    m = rng.randint(2, 8)
    words = sorted({"".join(rng.choice(alphabet) for _ in range(rng.choice([m, m + 1]))) for _ in range(120)})
    a, b = spelling.one_edit_pairs(np.zeros(len(words), np.int64), words, np.full(len(words), m), np.zeros(len(words), np.int64))
    got = list(zip(a.tolist(), b.tolist()))
    assert len(got) == len(set(got))
    assert set(got) == {(i, j) for i, x in enumerate(words) if len(x) == m for j, y in enumerate(words) if one_edit(x, y) and len(y) >= m}


def test_chains_ties_and_no_rows(spark, make_docs):
    rows = [(1, "wordabc " * 1000 + "wordabcd " * 100 + "wordabcde " * 10 + "xordabcd xordabcd " + "tieword " * 40 + "tiewore " * 40 + "tieworx " * 2)]
    got = {r.word: r for r in spelling.variants(make_docs(rows), every=0).collect()}
    assert (got["wordabcde"].form, got["wordabcde"].root) == ("wordabcd", "wordabc")
    assert (got["xordabcd"].form, got["xordabcd"].form_n, got["xordabcd"].root) == ("wordabcd", 100, "wordabc")
    assert (got["tieworx"].form, got["tieword"].form, got["tieword"].n_near, got["wordabc"].root) == ("tieword", None, 2, "wordabc")
    for rows in ([], [(1, None), (2, "short words only")]):
        assert spelling.variants(make_docs(rows)).collect() == []


def test_a_very_long_text_and_word(spark, make_docs):
    rows = [(1, "langewort " * 300_000), (2, "y" * 3000 + " " + "y" * 3001), (3, "y" * 3000 + " " + "y" * 3001),
            (4, " ".join(["z" * 400_000] * 2))]
    got = {r.word: r for r in spelling.variants(make_docs(rows), every=0).collect()}
    assert got["langewort"].n == 300_000 and got["y" * 3000].n_near == 1


def test_registered_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in read(spark, sf, "documents").select("doc_id", "text").collect()]
    got = {tuple(r) for r in QUERIES["op11_spelling_variants"](spark, sf).select("word", "n", "n_near", "form", "form_n", "root").collect()}
    assert got == expected(counted(rows))
