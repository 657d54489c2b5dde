"""Best-fit packing of tokenised documents, planned on the histogram of lengths."""

from __future__ import annotations

import os
import re
from bisect import bisect_left, insort
from collections.abc import Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelcast.llm.common import chunks, saved, text_bytes

#: Different words whose ids a Python worker remembers before it starts anew (some 200 MB).
MEMORY_WORDS = 1 << 20
#: Words tokenised at a time.
AT_ONCE = 4096
#: A longer text is tokenised in parts of this many bytes, cut at white space.
PART_BYTES = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
# Letters of ASCII and Latin-1; ASCII punctuation without apostrophes.
_LETTERS, _MARK, _BLANK = "[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+", r"[!-&(-/:-@\[-`{-~]", r"\x20\x09-\x0D"
_LATIN = "".join(c for c in map(chr, range(0xC0, 0x100)) if c.isalpha())
_WORDS = re.compile(f"[^{_BLANK}]+").findall
#: Letters and the punctuation behind them as two, all other words whole.
_PARTS = re.compile(f"{_LETTERS}(?={_MARK}*(?:[{_BLANK}]|\\Z))|{_MARK}+(?=[{_BLANK}]|\\Z)|[^{_BLANK}]+").findall
_STEM = re.compile(f"{_LETTERS}|{_MARK}+").fullmatch
#: Punctuation that a tokenizer is tried out with.
_MARKS = [chr(b) * k for b in range(33, 127) if not chr(b).isalnum() and b != 39 for k in (1, 2)] + [".,", "?!)", "###", "<|>"]


def parts(text: bytes):
    """The text in parts of about PART_BYTES, cut before white space."""
    at = 0
    while at < len(text):
        cut = _SPACE.search(text, at + PART_BYTES)
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


class WordTokenizer:
    """Ids of whole texts by a tokenizer that never joins characters across
    ASCII white space, so that a word's ids are the same in every text: each
    different word is tokenised once and remembered.

    Where the tokenizer also lower-cases, and cuts between letters and
    punctuation (both tried out at the start), a word of letters with ASCII
    punctuation behind them has the ids of its two parts in lower case, and
    the parts are what is remembered.  Texts with combining marks, before
    which case matters, or with "<|", which may begin a special token, go by their words as they are.

    New parts go to the tokenizer's model at once, in its byte alphabet.  Other
    words are tokenised many at a time with U+0001 as a word between them,
    which is one id of its own; a word that holds U+0001 is tokenised alone."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        self.between = self._ids("\x01").tolist()
        if len(self.between) != 1:
            raise ValueError(f"{path}: U+0001 is not one id")
        bytewise = ByteLevel(add_prefix_space=False, use_regex=False)
        self.alphabet = {ord(c): bytewise.pre_tokenize_str(c)[0][0] for c in _LATIN}
        stems = ["Word", "zzqxjyk", "s", "Ünßé", *_LATIN, _LATIN]
        self.apart = all(
            self._ids(a + b).tolist() == [i for x in (a, b) for i in self._part(x)] for a in stems for b in ("", *_MARKS))

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.known) > MEMORY_WORDS:
            self.known.clear()
        known = self.known
        if sum(map(len, texts)) <= PART_BYTES * 4:
            texts = [[self._words(part) for part in parts(t)] for t in texts]
            self._learn(set(chain.from_iterable(chain.from_iterable(texts))).difference(known))
            return [b"".join([known[w] for part in t for w in part]) for t in texts]
        out = []
        for text in texts:
            ids = []
            for part in parts(text):
                words = self._words(part)
                self._learn(set(words).difference(known))
                ids.append(b"".join([known[w] for w in words]))
            out.append(b"".join(ids))
        return out

    def _words(self, text: bytes) -> list[str]:
        if self.apart and not (b"\xcc" in text or b"\xcd" in text or b"<|" in text):
            return _PARTS(text.lower().decode("utf-8", "replace"))
        return _WORDS(text.decode("utf-8", "replace"))

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _part(self, word: str) -> list[int]:
        """Ids of letters, or of punctuation, by the model alone."""
        word = word.lower()
        return [t.id for t in self.tokenizer.model.tokenize(word if word.isascii() else word.translate(self.alphabet))] if word else []

    def _learn(self, new: set[str]) -> None:
        plain = [w for w in new if _STEM(w)] if self.apart else []
        ids = [self._part(w) for w in plain]
        flat = np.fromiter(chain.from_iterable(ids), "<u4")
        end = (4 * np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))).tolist()
        self._keep(plain, flat, [0, *end[:-1]], end)
        new = new.difference(plain)
        for odd in [w for w in new if "\x01" in w]:
            self.known[odd] = self._ids(odd).tobytes()
        new = [w for w in new if "\x01" not in w]
        for at in range(0, len(new), AT_ONCE):
            some = new[at : at + AT_ONCE]
            ids = self._ids(" \x01 ".join(some))
            cut = 4 * np.flatnonzero(ids == self.between[0])
            self._keep(some, ids, [0, *(cut + 4).tolist()], [*cut.tolist(), 4 * len(ids)])

    def _keep(self, words: list[str], ids: np.ndarray, begin: list[int], end: list[int]) -> None:
        if len(end) != len(words):
            raise ValueError("the tokenizer doesn't tell words apart")
        packed = ids.tobytes()
        self.known.update((w, packed[i:j]) for w, i, j in zip(words, begin, end))


def word_tokenizer(path: str) -> WordTokenizer:
    """This Python worker's tokenizer: Spark reuses workers, and what hangs on
    an imported module outlives a task."""
    import tokenizers

    held = vars(tokenizers).setdefault("_word_tokenizers", {})
    if path not in held:
        held[path] = WordTokenizer(path)
    return held[path]


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """(doc_id, piece, start, length, ids, task, nth): every text's ids and
    ``end_id``, cut into pieces of ``capacity`` ids where it is longer.  ``nth``
    numbers the pieces of one length within a task."""

    def run(batches):
        encode, task, seen = word_tokenizer(tokenizer), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        last = np.array([end_id], "<u4").tobytes()
        for b in batches:
            texts, doc_ids = text_bytes(b.column("text")), b.column("doc_id")
            for lo, hi in chunks(texts):
                row, piece, ids = [], [], []
                for i, x in enumerate(encode(texts[lo:hi])):
                    x += last
                    for p in range(0, len(x), 4 * capacity):
                        row.append(lo + i)
                        piece.append(p // (4 * capacity))
                        ids.append(x[p : p + 4 * capacity])
                length = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
                order = np.argsort(length, kind="stable")
                run_of = length[order]
                place = np.arange(len(order))
                head = np.concatenate(([True], run_of[1:] != run_of[:-1]))
                nth = np.empty(len(order), np.int64)
                nth[order] = seen[run_of] + place - np.maximum.accumulate(np.where(head, place, 0))
                seen += np.bincount(length, minlength=capacity + 1)
                piece = np.array(piece, np.int32)
                yield pa.RecordBatch.from_arrays([
                    doc_ids.take(pa.array(row, pa.int64())), pa.array(piece), pa.array(piece.astype(np.int64) * capacity), pa.array(length),
                    pa.array(ids, pa.binary()), pa.array(np.full(len(ids), task, np.int32)), pa.array(nth),
                ], names=["doc_id", "piece", "start", "length", "ids", "task", "nth"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, piece int, start long, length long, ids binary, task int, nth long")


def best_fit(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Runs (length, first rank, pieces, first sequence, pieces per sequence,
    offset) that place ``counts[length]`` pieces of every length.

    Best fit by falling length: each piece goes to the open sequence with the
    least room that holds it, a new one if there is none.  Sequences with the same
    room stand as ranges (first, how many), and a whole range is filled at a
    step: the chosen sequences keep the least room that holds the length until they are too full for it.  The work
    follows the number of different lengths, not of pieces.
    """
    runs, room, ranges, made = [], [], {}, 0

    def keep(r: int, first: int, n: int) -> None:
        if r and n:
            if r not in ranges:
                ranges[r] = []
                insort(room, r)
            ranges[r].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            i = bisect_left(room, length)
            if i == len(room):
                per = capacity // length
                first, n, r = made, -(-left // per), capacity
                made += n
            else:
                r = room[i]
                first, n = ranges[r].pop()
                if not ranges[r]:
                    del ranges[r], room[i]
                per = r // length
            full = min(n, left // per)
            if full:
                runs.append((length, rank, full * per, first, per, capacity - r))
                keep(r - per * length, first, full)
                rank, left, first, n = rank + full * per, left - full * per, first + full, n - full
            if n and left and left < per:
                runs.append((length, rank, left, first, left, capacity - r))
                keep(r - left * length, first, 1)
                rank, left, first, n = rank + left, 0, first + 1, n - 1
            keep(r, first, n)
    return np.array(sorted(runs), np.int64).reshape(-1, 6)


def packed(docs: DataFrame, tokenizer: str, *, capacity: int = 4096, end_id: int = 1,
           keep: Sequence[str | Column] = ("ids",)) -> DataFrame:
    """(doc_id, piece, start, length, ``keep``..., sequence_id, offset): the
    texts of ``docs`` (doc_id, text) as ids, packed into sequences of at most
    ``capacity`` ids.

    A document is its text's ids, by the ``tokenizers`` file at the path
    ``tokenizer`` without special tokens, and ``end_id``.  Only a longer
    document is cut; ``start`` counts its ids before the piece.  ``ids`` is
    little-endian unsigned 32-bit; ``keep`` names columns of the piece, or
    expressions over them, that the result carries.

    The histogram of lengths, ``capacity`` rows at most, is all that the
    driver plans on (:func:`best_fit`).  A piece's rank within its length is
    its number within its task plus the pieces of that length in earlier
    tasks, joined in by (task, length); rank and length find the planned slot.
    So no task holds all pieces of a common length.

    Null and empty texts are documents of ``end_id`` alone.  Every row is a
    document, repeated rows and rows with a null doc_id too.  Pieces of equal
    length take their slots in any order.  An empty table gives no rows.
    Other columns are ignored.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    carried = [F.col(c) if isinstance(c, str) else c for c in keep]
    rows = pieces(docs, tokenizer, capacity, end_id)
    names = rows.select(*carried).columns
    rows = saved(rows.select("doc_id", "piece", "start", "length", *carried, "task", "nth"), "pieces")
    cells = saved(rows.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "cells")
    histogram = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = best_fit(histogram, capacity)
    before = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = rows.join(cells, ["task", "length"]).select(
        "doc_id", "piece", "start", "length", *names, (F.col("before") + F.col("nth")).alias("rank"))

    def place(batches):
        # Runs of one length follow each other; a start is one number for both.
        shift = int(runs[:, 2].max(initial=0) + runs[:, 1].max(initial=0)).bit_length() + 1
        starts = (runs[:, 0] << shift) + runs[:, 1]
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            run = runs[np.searchsorted(starts, (length << shift) + rank, side="right") - 1] if b.num_rows else runs[:0]
            nth = rank - run[:, 1]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("doc_id", "piece", "start", "length", *names)),
                 pa.array(run[:, 3] + nth // run[:, 4]), pa.array(run[:, 5] + nth % run[:, 4] * length)],
                names=["doc_id", "piece", "start", "length", *names, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.drop("rank").schema)
    return ranked.mapInArrow(place, f"{kinds}, sequence_id long, offset long")
