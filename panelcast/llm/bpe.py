"""Byte-level BPE encoding by backtracking over longest matches, and decoding."""

from __future__ import annotations

import base64
import re
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import chunks, list_array

#: Distinct stretches of text, and pieces of them, whose tokens a task remembers
#: at least; past it those not asked for again are forgotten.
REMEMBERED = 1 << 18
#: Characters of the longest that it remembers.
LONGEST = 128
#: Patterns of which no match goes over the border between a space with
#: something else than white space behind it and what stands before: a pattern
#: that cuts a text at such borders only (the matches within are those of the
#: whole text), and one of stretches that are one match.
STRETCHES = {
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+": (r" ?[^ ]*(?: (?!\S)[^ ]*)*", r" ?[A-Za-z]+"),
}


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank from a ``.tiktoken`` file (fixed vocabulary size)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """Plain BPE: join the adjacent pair of lowest rank, leftmost first, until
    no pair is a token."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        at = [(ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)]
        rank, i = min(at)
        if rank == 1 << 60:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


def build_tables(ranks: dict[bytes, int]):
    """(stable, halves): the tokens that plain BPE makes from their own bytes,
    and for each of more than one byte the two tokens joined last."""
    halves, stable = {}, set()
    for t in sorted(ranks, key=ranks.get):
        if len(t) == 1:
            stable.add(t)
            continue
        parts = [t[i : i + 1] for i in range(len(t))]
        while len(parts) > 2:
            rank, i = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank >= ranks[t]:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        if len(parts) == 2:
            stable.add(t)
            halves[t] = (parts[0], parts[1])
    return stable, halves


class _Longest(dict):
    """The id of the longest token that a text begins with (none: -1)."""

    def __init__(self, ids: dict[str, int]):
        super().__init__(ids)
        self[""] = -1

    def __missing__(self, text: str) -> int:
        t = self[text] = self[text[:-1]]
        return t


class Encoder:
    """Tokens of a piece in linear time.

    An automaton over the tokens, their bytes mapped to Latin-1, gives the
    longest matches one behind the other, and the longest match at a position
    that they leave out.  The longest match is taken if it is compatible with the token before, else
    the next shorter one; without any left the last token is given up and
    shortened, and the place where it ended is never tried again.  Two adjacent
    tokens are compatible when plain BPE leaves the border between them
    unmerged, which is remembered for each pair.  A tokenization whose adjacent
    pairs are all compatible is the one that plain BPE makes.
    """

    def __init__(self, ranks: dict[bytes, int], stable: set[bytes], halves: dict[bytes, tuple[bytes, bytes]]):
        self.ranks, self.halves = ranks, halves
        #: For two tokens, their ids in one number, the longest one compatible
        #: with the first that is the second or that the second begins with.
        self.memory: dict[int, int] = {}
        ids = {t.decode("latin-1"): ranks[t] for t in stable}
        self.reach = max(map(len, ids))
        self.words: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for t in stable:
            self.words[ranks[t]] = t
        self.size = list(map(len, self.words))
        #: Holds beginnings of tokens only, so it is of the vocabulary's size.
        self.longest = _Longest(ids)
        self.automaton = ahocorasick.Automaton()
        for t, i in ids.items():
            self.automaton.add_word(t, i)
        self.automaton.make_automaton()

    def _fits(self, left: bytes, right: bytes) -> bool:
        """Whether no merge crosses the border of ``left`` and ``right``.

        Undo both tokens' last merges, the later one first; the border holds
        when the pair facing each other is at no point a token that would have
        been merged before the merge just undone."""
        ranks, halves = self.ranks, self.halves
        limit = 1 << 60
        a, b = left, right
        while True:
            if ranks.get(a + b, 1 << 60) < limit:
                return False
            ra = ranks[a] if a in halves else -1
            rb = ranks[b] if b in halves else -1
            if ra < 0 and rb < 0:
                return True
            # Of two merges of one rank the left one came first.
            if ra > rb:
                limit, a = ra, halves[a][1]
            else:
                limit, b = rb + 1, halves[b][0]

    def _shorter(self, t: int) -> int:
        return self.longest[self.words[t][:-1].decode("latin-1")]

    def _fitting(self, last: int, t: int) -> int:
        while t >= 0 and not self._fits(self.words[last], self.words[t]):
            t = self._shorter(t)
        return t

    def __call__(self, piece: bytes) -> list[int]:
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        memory, size, longest, reach, begun = self.memory, self.size, self.longest, self.reach, self.automaton.longest_prefix
        text, n, at = piece.decode("latin-1"), len(piece), 0
        dead: set[int] = set()
        tokens: list[int] = []
        last = -1
        ahead = self.automaton.iter_long(text)  # as long as only longest matches are taken
        while at < n:
            if ahead:
                _, t = next(ahead)
            else:
                rest = text[at : at + reach]
                t = longest[rest[: begun(rest)]]
            while True:
                if t >= 0 and last >= 0:
                    pair = last << 32 | t
                    fit = memory.get(pair)
                    if fit is None:
                        fit = memory[pair] = self._fitting(last, t)
                    if fit != t:
                        t, ahead = fit, None
                if t < 0:
                    # Nothing fits here: give up the last token.
                    dead.add(at)
                    t = tokens.pop()
                    at -= size[t]
                    last = tokens[-1] if tokens else -1
                elif not dead or at + size[t] not in dead:
                    break
                t, ahead = self._shorter(t), None
            tokens.append(t)
            at += size[t]
            last = t
        return tokens


class _Memory(dict):
    """Token ids of texts, as the bytes of C ints, worked out when first asked for."""

    def __init__(self):
        super().__init__()
        self.older: dict[str, bytes] = {}

    def __missing__(self, text: str) -> bytes:
        ids = self.older.get(text)
        if ids is None:
            ids = self.ids(text)
        if len(text) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[text] = ids
        return ids


class _Pieces(_Memory):
    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def ids(self, piece: str) -> bytes:
        if len(self.encoder.memory) >= 4 * REMEMBERED:
            self.encoder.memory.clear()
        return array("i", self.encoder(piece.encode())).tobytes()


class _Stretches(_Memory):
    def __init__(self, pieces: _Pieces, find, alone):
        super().__init__()
        self.pieces, self.find, self.alone = pieces, find, alone

    def ids(self, stretch: str) -> bytes:
        if self.alone(stretch):
            return self.pieces[stretch]
        return b"".join(map(self.pieces.__getitem__, self.find(stretch)))


def encoded(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """(doc_id, ids) for every row: the token ids of the whole text, each
    match of ``pattern`` encoded by itself, no special tokens.  Null text has
    no ids."""
    shared = docs.sparkSession.sparkContext.broadcast((ranks, *build_tables(ranks)))  # of the vocabulary's size

    def run(batches):
        find, known = regex.compile(pattern).findall, _Pieces(Encoder(*shared.value))
        cut = find
        if pattern in STRETCHES:
            stretch, alone = map(re.compile, STRETCHES[pattern])
            cut, known = stretch.findall, _Stretches(known, find, alone.fullmatch)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            ids = batch.column("doc_id")
            for lo, hi in chunks(texts):
                out = [b"".join(map(known.__getitem__, cut(t))) for t in texts[lo:hi]]
                flat = np.frombuffer(b"".join(out), np.intc)
                yield pa.RecordBatch.from_arrays([ids[lo:hi], list_array(flat, [len(x) // flat.itemsize for x in out], pa.int32())], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decoded(tokens: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """``tokens`` (doc_id, ids) with ``bytes``, what the ids stand for."""
    words: list[bytes] = [b""] * (max(ranks.values()) + 1)
    for t, i in ranks.items():
        words[i] = t
    shared = tokens.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        word = shared.value.__getitem__
        for batch in batches:
            ids = batch.column("ids")
            offsets, flat = np.asarray(ids.offsets), np.asarray(ids.values)
            out = [b"".join(map(word, flat[a:b].tolist())) for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, pa.array(out, pa.binary())], names=["doc_id", "ids", "bytes"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, bytes binary")
