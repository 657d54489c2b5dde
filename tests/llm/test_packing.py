"""Packing against the tokenizer run on whole texts and a best fit over single pieces."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from panelcast.llm import packing
from panelcast.llm.common import read
from panelcast.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")


def whole_ids(texts, end_id=1):
    found = Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)
    return [e.ids + [end_id] for e in found]


def best_fit_one_by_one(lengths, capacity):
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(room) if r >= n]
        if fits:
            room[min(fits, key=room.__getitem__)] -= n
        else:
            room.append(capacity - n)
    return len(room)


def check(rows, texts, capacity, end_id=1):
    """texts: {doc_id: text}, one row each."""
    ids = dict(zip(texts, whole_ids([t or "" for t in texts.values()], end_id)))
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(texts)
    for d, found in by_doc.items():
        found.sort(key=lambda r: r.piece)
        assert [r.piece for r in found] == list(range(len(found)))
        assert [r.start for r in found] == [p * capacity for p in range(len(found))]
        assert sum([np.frombuffer(r.ids, "<u4").tolist() for r in found], []) == ids[d]
        assert all(r.length == capacity for r in found[:-1]) and 0 < found[-1].length <= capacity
        assert all(r.length == len(r.ids) // 4 for r in found)
    for found in by_sequence.values():
        at = 0
        for r in sorted(found, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    assert len(by_sequence) == best_fit_one_by_one([r.length for r in rows], capacity)


ODD = ["", " \t\n", "a", "Hello, WORLD's 123", "<|endoftext|> x<|startoftext|>", "é ́e x y", "天気がいい",
       "a\x0bb\x0cc\x1cd\x85e", "İstanbul ΣΣ ﬁ", "x" * 3000, "don't I'LL we've", "퟿ 가 q"]


def test_words_apart_equal_whole_texts():
    rng = random.Random(3)
    alphabet = [*"abcAB'.,;!?012 \t\n\r\x0b\x0c", "é", "é", "́", " ", " ", "薫", "한", "\U0001f600", "'s", "'ll", "<|endoftext|>", "ͅ", "\x1f", "\x01", " \x01 "]
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    ours = packing.WordTokenizer(PATH)([t.encode() for t in texts])
    assert [np.frombuffer(x, "<u4").tolist() + [1] for x in ours] == whole_ids(texts)


def test_a_long_text_in_parts(monkeypatch):
    text = " ".join(random.Random(2).choices(["alpha", "beta,", "über", "12", "x" * 50], k=400))
    monkeypatch.setattr(packing, "PART_BYTES", 100)
    monkeypatch.setattr(packing, "MEMORY_WORDS", 2)
    monkeypatch.setattr(packing, "AT_ONCE", 3)
    ours = packing.WordTokenizer(PATH)
    for t in (text, "y" * 500, text):
        assert np.frombuffer(ours([t.encode()])[0], "<u4").tolist() == whole_ids([t])[0][:-1]


@pytest.mark.parametrize("seed", range(30))
def test_best_fit_over_counts_equals_best_fit_over_pieces(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 7, 16, 64, 200])
    kinds = [rng.randint(1, capacity) for _ in range(rng.randint(1, 25))]
    counts = {n: rng.choice([1, 2, 3, 50, 700]) for n in kinds}
    runs = packing.best_fit(counts, capacity)
    used, placed = {}, {}
    for length, rank, n, first, per, offset in runs.tolist():
        assert rank == placed.get(length, 0)
        placed[length] = rank + n
        for i in range(n):
            used.setdefault(first + i // per, []).append((offset + i % per * length, length))
    assert placed == counts
    for spans in used.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(used) == best_fit_one_by_one([n for n, k in counts.items() for _ in range(k)], capacity)


@pytest.mark.parametrize("capacity", [1, 5, 64, 4096])
def test_packing_equals_brute_force(spark, make_docs, capacity):
    rng = random.Random(capacity)
    texts = ODD + [" ".join(rng.choice(["one", "two,", "Three's", "4567", "été"]) for _ in range(rng.choice([1, 2, 2, 9, 60]))) for _ in range(120)]
    texts = {i: t for i, t in enumerate([None, *texts])}
    out = packing.packed(make_docs(list(texts.items())).repartition(5), PATH, capacity=capacity)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"]
    check(out.collect(), texts, capacity)


def test_repeated_rows_null_ids_other_end(spark, make_docs):
    docs = make_docs([(1, "a b"), (1, "a b"), (None, "a b"), (None, None), (2, "")])
    rows = packing.packed(docs, PATH, end_id=7, keep=["ids", F.crc32("ids").alias("c")]).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.length) for r in rows if r.doc_id is not None) == [(False, 1, 3), (False, 1, 3), (False, 2, 1)]
    assert sorted(r.length for r in rows if r.doc_id is None) == [1, 3]
    assert {r.sequence_id for r in rows} == {0}
    assert sorted(r.offset for r in rows)[0] == 0 and all(r.c == zlib.crc32(r.ids) for r in rows)


def test_no_rows(spark, make_docs):
    assert packing.packed(make_docs([]), PATH).collect() == []


def test_one_common_length_over_many_tasks(spark, make_docs):
    docs = make_docs([(i, "same words here") for i in range(900)] + [(i, "x " * (i % 50)) for i in range(900, 1400)]).repartition(23)
    rows = packing.packed(docs, PATH, capacity=100).collect()
    check(rows, {r.doc_id: r.text for r in docs.collect()}, 100)


def test_registered_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = QUERIES["op12_best_fit_packing"](spark, sf).collect()
    texts = {r.doc_id: r.text for r in read(spark, sf, "documents").collect()}
    ids = dict(zip(texts, whole_ids([t or "" for t in texts.values()])))
    for r in rows:
        cut = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()
        assert len(cut) == 4 * r.length and zlib.crc32(cut) == r.ids_crc32
    assert sum(r.length for r in rows) == sum(map(len, ids.values()))
    assert len({r.sequence_id for r in rows}) == best_fit_one_by_one([r.length for r in rows], 4096)
