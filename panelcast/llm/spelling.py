"""Spelling variants: words one edit apart, found by scanning sorted lists."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import dropped, saved, text_bytes

_RUN = re.compile(rb"[a-z\xc0-\xff]+")
_OUTSIDE = re.compile(rb"[^a-z\xc0-\xff]")
#: Different words that a task counts before it hands its counts on; bytes of a text taken at a time.
HELD, PART_BYTES = 1 << 18, 1 << 20
#: Words of a group that are compared as one list; a larger group is split by more characters.
GROUP = 4096
#: Rows of lists scanned in one go.
SCAN_ROWS = 1 << 14


def words(docs: DataFrame, min_length: int, every: int) -> DataFrame:
    """(word, n): how often each word of at least ``min_length`` code points
    occurs, counted within tasks first."""

    def run(batches):
        held: Counter = Counter()

        def rows():
            kept = [(w.decode("latin-1"), n) for w, n in held.items()]
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], names=["word", "n"])

        for b in batches:
            ids = b.column("id").to_pylist()
            for doc_id, text in zip(ids, text_bytes(b.column("text"))):
                seed, at = zlib.crc32(f"{doc_id}:".encode()), 0
                # Code points are bytes in Latin-1; all others are outside of words.
                text = text.decode("utf-8", "replace").encode("latin-1", "replace").lower()
                while at < len(text):
                    cut = _OUTSIDE.search(text, at + PART_BYTES)
                    end = cut.start() if cut else len(text)
                    for w, n in Counter(_RUN.findall(text, at, end)).items():
                        if len(w) < min_length:
                            continue
                        h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), seed)
                        if every and h % every == 0:
                            if len(w) == min_length:
                                continue
                            w = w[: h % len(w)] + w[h % len(w) + 1 :]
                        held[w] += n
                    at = end
                    if len(held) > HELD:
                        yield rows()
        yield rows()

    doc_id = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return (docs.where("text IS NOT NULL").select(doc_id.alias("id"), "text").mapInArrow(run, "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")))


def _window(m: int, level: int, i: int) -> tuple[int, int]:
    """The places [start, end) of the i-th of 2^(level + 1) stretches of a word of m."""
    return m * i >> level + 1, m * (i + 1) >> level + 1


def listed(rows: DataFrame, level: int) -> DataFrame:
    """(key, word, n, m, i): the lists that words are on.

    Two words one edit apart, the shorter of m code points, differ in one
    stretch of the m places only (:func:`_window`): before it they share a
    prefix, behind it a suffix.  So they are on the list of (m, i, prefix,
    suffix), known by a 64-bit hash.  A word of length L is on lists of m = L,
    and as the longer word of m = L - 1.  At the first level ``rows`` is the
    vocabulary (word, n); at a further one the words (word, n, m, i) on lists
    that were too large, whose stretches are halved.  A list whose suffix is
    the longer shared part holds reversed words.
    """

    def run(batches):
        for b in batches:
            keys, words, ns, ms, places = [], [], [], [], []
            if level:
                cells = zip(*(b.column(c).to_pylist() for c in ("word", "n", "m", "i")))
            else:
                cells = ((w, n, m, 0) for w, n in zip(b.column("word").to_pylist(), b.column("n").to_pylist())
                         for m in (len(w), len(w) - 1))
            for w, n, m, i in cells:
                for j in (2 * i, 2 * i + 1):
                    start, end = _window(m, level, j)
                    if start < end:
                        keys.append(f"{m} {j} {w[:start]} {w[len(w) - (m - end) :]}")
                        words.append(w[::-1] if m - end > start else w)
                        ns.append(n)
                        ms.append(m)
                        places.append(j)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), pa.array(words, pa.string()), pa.array(ns, pa.int64()), pa.array(ms, pa.int32()), pa.array(places, pa.int32())],
                names=["key", "word", "n", "m", "i"])

    return rows.mapInArrow(run, "key string, word string, n long, m int, i int").withColumn("key", F.xxhash64("key"))


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points padded with -1 and two columns more, lengths)."""
    n = np.fromiter(map(len, words), np.int64, len(words))
    out = np.full((len(words), int(n.max(initial=0)) + 2), -1, np.int32)
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.int32)
    out[np.repeat(np.arange(len(words)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out, n


def one_edit_pairs(group: np.ndarray, words: list[str], m: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): places in the sorted lists ``group`` of all pairs one edit apart
    of which a has m code points, and b as many (a pair both ways) or one more.

    A list is sorted, so the words that share a prefix are a range of it, and
    adjacent words' longest common prefix says where ranges part.  Against a
    query, each range has one band row of the edit matrix, for the query's
    prefixes one shorter, as long and one longer than the range's.  Ranges
    start at the list's shared part (``depth``) and part at each further
    character; a new range goes on from the row of the one that it is a part
    of, and a range whose row exceeds one edit is skipped with all its words.  All
    queries of all lists take a step together.
    """
    code, n = _codes(words)
    total = len(words)
    # Longest common prefix with the word before; a list's first word has none.
    same = np.concatenate(([False], group[1:] == group[:-1]))[:total]
    lcp = np.full(total, -1, np.int64)
    if total > 1:
        lcp[1:] = np.where(same[1:], np.minimum(_common(code[1:], code[:-1]), np.minimum(n[1:], n[:-1])), -1)
    lo = np.flatnonzero(~same)
    hi = np.append(lo[1:], total)
    d = depth[lo].astype(np.int64)
    node = np.cumsum(~same) - 1
    query = np.flatnonzero((n == m) & (hi - lo > 1)[node])
    node = node[query]
    row = [np.ones(len(query), np.int8), np.zeros(len(query), np.int8), np.ones(len(query), np.int8)]
    row[0][d[node] == 0] = 2  # there is no prefix shorter than none
    left, right = [], []
    width = code.shape[1] - 1
    while len(query):
        # A range whose shared part is a whole word has that word first.
        whole = n[lo] == d
        at = np.flatnonzero(whole[node])
        q, c = query[at], lo[node[at]]
        hit = np.where(n[c] == m[q], row[1][at], np.where(n[c] == m[q] + 1, row[0][at], 2)) == 1
        left.append(q[hit])
        right.append(c[hit])
        # Ranges part where a word shares no more than d characters with the one before.
        count = hi - lo - whole
        parent = np.repeat(np.arange(len(lo)), count)
        at = np.arange(len(parent)) - np.repeat(np.cumsum(count) - count, count) + (lo + whole)[parent]
        head = np.flatnonzero((lcp[at] <= d[parent]) | (at == (lo + whole)[parent]))
        parent, begin = parent[head], at[head]
        end = hi[parent]
        end[:-1] = np.where(parent[1:] == parent[:-1], begin[1:], end[:-1])
        character = code[begin, d[parent]]
        parts = np.bincount(parent, minlength=len(lo))
        # Each query goes on with the parts of its ranges.
        count = parts[node]
        of = np.repeat(np.arange(len(query)), count)
        part = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + (np.cumsum(parts) - parts)[node][of]
        q, depth_, x = query[of], d[node][of], character[part]
        one, two, three = (r[of] for r in row)
        new0 = np.minimum(two + 1, one + (code[q, np.maximum(depth_ - 1, 0)] != x))
        new1 = np.minimum(np.minimum(three, new0) + 1, two + (code[q, np.minimum(depth_, width)] != x))
        new2 = np.minimum(new1 + 1, three + (code[q, np.minimum(depth_ + 1, width)] != x))
        # Of a range that is down to the query itself nothing more comes.
        alone = (end - begin == 1)[part] & (begin[part] == q)
        alive = np.flatnonzero((np.minimum(np.minimum(new0, new1), new2) <= 1) & ~alone)
        query, row = q[alive], [np.minimum(r[alive], 2).astype(np.int8) for r in (new0, new1, new2)]
        used, node = np.unique(part[alive], return_inverse=True)
        lo, hi, d = begin[used], end[used], d[parent[used]] + 1
    return np.concatenate([*left, np.zeros(0, np.int64)]), np.concatenate([*right, np.zeros(0, np.int64)])


def _common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many first entries of each row are equal."""
    differ = x != y
    return np.where(differ.any(1), differ.argmax(1), x.shape[1])


def _whole_lists(batches):
    """Tables of whole lists, of about SCAN_ROWS rows (rows come sorted by key)."""
    held, size = [], 0
    for b in batches:
        t = pa.Table.from_batches([b])
        while t.num_rows:
            part, t = t.slice(0, SCAN_ROWS), t.slice(SCAN_ROWS)
            held.append(part)
            size += part.num_rows
            if size >= SCAN_ROWS:
                whole = pa.concat_tables(held).combine_chunks()
                key = whole.column("key").to_numpy()
                cut = int(np.searchsorted(key, key[-1]))
                if cut:
                    yield whole.slice(0, cut).combine_chunks()
                held = [whole.slice(cut)]
                size = whole.num_rows - cut
    if size:
        yield pa.concat_tables(held).combine_chunks()


def near_words(lists: DataFrame, level: int) -> DataFrame:
    """(word, near, n): each word of the lists with each word one edit away
    and that word's n.  A pair that several lists of a level hold comes out of
    the one whose stretch has the first place where the words differ."""

    def run(batches):
        for t in _whole_lists(batches):
            # Lists of words of about one length at a time, as the longest one sets a matrix's width.
            wide = np.ceil(np.log2(np.maximum(t.column("m").to_numpy(), 16))).astype(np.int64)
            for k in np.unique(wide).tolist():
                yield links(t.filter(pa.array(wide == k)).combine_chunks())

    def links(t):
        text, n = t.column("word").to_pylist(), t.column("n").to_numpy()
        key, m, i = (t.column(c).to_numpy() for c in ("key", "m", "i"))
        start, end = _window(m.astype(np.int64), level, i.astype(np.int64))
        back, depth = m - end > start, np.maximum(m - end, start)
        shared = [w[:k] for w, k in zip(text, depth.tolist())]
        new = (key[1:] != key[:-1]) | (m[1:] != m[:-1]) | (i[1:] != i[:-1]) | np.fromiter(map(str.__ne__, shared[1:], shared), bool, len(text) - 1)
        a, b = one_edit_pairs(np.cumsum(np.concatenate(([False], new))), text, m, depth)
        plain = [w[::-1] if r else w for w, r in zip(text, back.tolist())]
        code, size = _codes(plain)
        step = max(1, (1 << 24) // code.shape[1])
        place = np.concatenate([_common(code[a[j : j + step]], code[b[j : j + step]]) for j in range(0, max(len(a), 1), step)])
        place = np.minimum(place, m[a] - 1)
        own = (start[a] <= place) & (place < end[a])
        a, b = a[own], b[own]
        # Words of one length are each other's queries; a longer word gets its link from the shorter's.
        longer = size[b] > size[a]
        x, y = np.concatenate((a, b[longer])), np.concatenate((b, a[longer]))
        plain = pa.array(plain, pa.string())
        return pa.RecordBatch.from_arrays([plain.take(pa.array(x)), plain.take(pa.array(y)), pa.array(n[y])], names=["word", "near", "n"])

    # Hashed lists, sorted within a task: a task gets whole lists.
    rows = lists.select("key", "word", "n", "m", "i").repartition("key").sortWithinPartitions("key", "m", "i", "word")
    return rows.mapInArrow(run, "word string, near string, n long")


def near_pairs(vocabulary: DataFrame, longest: int) -> DataFrame:
    """All (word, near, n) one edit apart, once each; lists of more than GROUP
    words are split, level by level."""
    out, level, rows = None, 0, vocabulary
    while True:
        lists = saved(listed(rows, level), "lists")
        whole, large = lists, None
        if 2 << level < longest:
            large = saved(lists.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > GROUP).select("key"), "large")
            if large.isEmpty():
                large = None
            else:
                whole = lists.join(large, "key", "left_anti")
        found = near_words(whole, level)
        out = found if out is None else out.union(found)
        if large is None:
            return out
        start, end = F.expr(f"shiftright(m * i, {level + 1})"), F.expr(f"shiftright(m * (i + 1), {level + 1})")
        word = F.when(F.col("m") - end > start, F.reverse("word")).otherwise(F.col("word"))
        rows = lists.join(large, "key", "left_semi").select(word.alias("word"), "n", "m", "i")
        level += 1


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for ``forms`` (word, form): the end of the chain of forms
    that starts at the word.  Each round doubles how far a word has looked; as a form is
    commoner than its word, chains end."""
    step = saved(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = step.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = saved(step.join(on, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        moved = not longer.where("moved").isEmpty()
        dropped(step)
        step = longer
        if not moved:
            return step.select("word", "root")


def variants(docs: DataFrame, *, min_length: int = 7, min_count: int = 2, factor: int = 10, every: int = 31) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of the words of ``docs`` (doc_id, text).

    A run is a longest stretch of ``A-Z``, ``a-z`` and U+00C0 to U+00FF, with A-Z in lower case.  With h
    the crc32 of ``<doc_id>:<run>`` in UTF-8, the code point h % length goes
    from a run whose h is divisible by ``every`` (0: from none).  Words are
    the results of at least ``min_length`` code points that occur
    ``min_count`` times or more (n).  Near words are one code point inserted,
    deleted or replaced apart: ``n_near`` of them.  The near word of the largest n, of equals
    the smallest by code points, is the ``form``, if its n is
    ``factor`` times the word's or more; else form and ``form_n`` are null.
    ``root`` follows forms to the last one.

    Two words one edit apart meet on a sorted list (:func:`listed`); a list of more than
    GROUP words is split into lists that share more characters, down to one
    place, so a common beginning or ending is no task's burden.  Counts are
    whole: words are dropped for their length or n alone.

    Null texts have no words; a null doc_id counts as an empty one in h.
    Repeated rows count each.  An empty table gives no rows.  Other columns
    are ignored.
    """
    if factor < 2 or min_length < 3:
        raise ValueError("factor must be at least 2 and min_length at least 3")
    vocabulary = saved(words(docs, min_length, every).where(F.col("n") >= min_count), "words")
    longest = vocabulary.agg(F.max(F.length("word"))).first()[0] or 0
    best = F.min(F.struct((-F.col("n")).alias("minus"), "near"))
    near = (near_pairs(vocabulary, longest).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
            .withColumnRenamed("word", "near_word"))
    rows = vocabulary.join(near, F.col("word") == F.col("near_word"), "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(-F.col("best.minus") >= F.col("n") * factor, F.col("best.near")).alias("form"),
        F.when(-F.col("best.minus") >= F.col("n") * factor, -F.col("best.minus")).alias("form_n"))
    rows = saved(rows, "forms")
    ends = roots(rows.where("form IS NOT NULL")).withColumnRenamed("word", "w")
    return rows.join(ends, F.col("word") == F.col("w"), "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
