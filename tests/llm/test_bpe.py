"""BPE: stretches of text known from before aren't encoded again, and borders don't change the pieces."""

import random
import re
from array import array
from itertools import chain

import public_tokenizers
import pytest
import regex

from panelcast.llm import bpe

FIND = regex.compile(public_tokenizers.PATTERN).findall
STRETCH, ALONE = map(re.compile, bpe.STRETCHES[public_tokenizers.PATTERN])


@pytest.fixture(scope="module")
def ranks():
    return bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def tables(ranks):
    return bpe.build_tables(ranks)


def odd_texts(many):
    r = random.Random(5)
    white = [" ", " ", "  ", "\n", "\t", "\r\n", "\x1c", "\x85", " ", " ", "　"]
    other = ["'s", "'", "a", "Thing", "é", "中文", "7", "²", "Ⅷ", "!", "_", "-----", "x" * 40, "́", "​", "tokenising"]
    return ["".join(r.choice(white if r.random() < 0.4 else other) for _ in range(r.randrange(14))) for _ in range(many)]


def test_stretches_keep_the_pieces():
    for text in odd_texts(20000):
        cut = STRETCH.findall(text)
        assert list(chain.from_iterable(map(FIND, cut))) == FIND(text), text
        assert all(FIND(x) == [x] for x in cut if ALONE.fullmatch(x)), text


def test_encoder_is_plain_bpe(ranks, tables):
    r, encoder = random.Random(6), bpe.Encoder(ranks, *tables)
    pieces = [bytes(r.choice(b"aeinthorsg -=xyz\xe4\xb8\xad\xff") for _ in range(r.randrange(1, 60))) for _ in range(2000)]
    for piece in pieces + [b" " * 300, b"x" * 300, b"thein" * 60, b"-=" * 90]:
        assert encoder(piece) == [ranks[t] for t in bpe.merged(piece, ranks)], piece


def test_stretches_are_worked_out_once(ranks, tables, monkeypatch):
    cut, encoded = [], []

    class Counted(bpe.Encoder):
        def __call__(self, piece):
            encoded.append(piece)
            return super().__call__(piece)

    known = bpe._Stretches(bpe._Pieces(Counted(ranks, *tables)), lambda x: cut.append(x) or FIND(x), ALONE.fullmatch)
    texts = ["It's qwzzle, qwzzle and 12 qwzzle,\n  then qwzzle."] * 50
    want = array("i", chain.from_iterable(bpe.Encoder(ranks, *tables)(p.encode()) for p in FIND(texts[0]))).tobytes()
    assert all(b"".join(map(known.__getitem__, STRETCH.findall(t))) == want for t in texts)
    assert len(cut) == len(set(cut)) and len(encoded) == len(set(encoded))
    assert encoded.count(b" qwzzle") == 1
    # What is remembered stays within bounds and doesn't change the tokens; what is asked for all the time is not forgotten.
    monkeypatch.setattr(bpe, "REMEMBERED", 8)
    for i in range(200):
        t = f" qwzzle zq{i % 90}x {'long' * 50}"
        want = array("i", chain.from_iterable(bpe.Encoder.__call__(known.pieces.encoder, p.encode()) for p in FIND(t))).tobytes()
        assert b"".join(map(known.__getitem__, STRETCH.findall(t))) == want
        assert len(known) <= 60 and all(len(x) <= bpe.LONGEST for x in known)
    assert encoded.count(b" qwzzle") == 1


def test_other_patterns_are_cut_whole(spark, ranks):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(odd_texts(40) + [None, "", "two  words"])], "doc_id long, text string")
    pattern = r"\S+\s?|\s+"
    assert pattern not in bpe.STRETCHES
    rows = docs.collect()
    for p in (pattern, public_tokenizers.PATTERN):
        got = {r["doc_id"]: r["ids"] for r in bpe.encoded(docs, ranks, p).collect()}
        for r in rows:
            pieces = regex.findall(p, r["text"] or "")
            assert got[r["doc_id"]] == [ranks[t] for x in pieces for t in bpe.merged(x.encode(), ranks)], (p, r)
