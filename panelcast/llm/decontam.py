"""Benchmark decontamination: verbatim pieces of items, gram count, exact edit check."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import BROADCAST_KEYS, chunks, saved, text_bytes

#: Bytes of a piece at most.
PIECE = 16
#: Bytes of benchmark text that a task holds at a time.
BLOCK_BYTES = 1 << 20

#: ASCII letters and digits: no word border stands between two of them.
_WORD = np.array([b < 128 and chr(b).isalnum() for b in range(256)])
_FOLD = bytes(b if b >= 128 or chr(b).isalnum() else 0x20 for b in range(256))


def normal(text: bytes) -> bytes:
    """Lower case, ASCII letters and digits and all bytes outside ASCII kept,
    runs of anything else one space."""
    return b" ".join(text.decode("utf-8", "replace").lower().encode().translate(_FOLD).split())


def pieces(length: int, most: int) -> tuple[int, np.ndarray]:
    """(bytes of a piece, offsets): ``most`` + 1 pieces of an item that don't
    overlap.  Each edit spoils one at most, so a passage within ``most`` edits
    of the item has one of them verbatim."""
    n = most + 1
    return min(length // n, PIECE), np.arange(n) * length // n


def prefix_keys(buf: np.ndarray, start: np.ndarray, widths: list[int]):
    """Yields (width, 64-bit hashes of the ``width`` bytes from each start)."""
    h = np.zeros(len(start), np.uint64)
    for j in range(max(widths, default=0)):
        h = (h + buf[start + j] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        if j + 1 in widths:
            yield j + 1, h * np.uint64(0xBF58476D1CE4E5B9)


def gram_codes(buf: np.ndarray) -> np.ndarray:
    """A 16-bit code of the 4 bytes from each position (fewer positions near the end)."""
    if len(buf) < 4:
        return np.zeros(0, np.uint16)
    b = buf.astype(np.uint32)
    g = b[:-3] | b[1:-2] << 8 | b[2:-1] << 16 | b[3:] << 24
    return (g * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(np.uint16)


def best_match(item: bytes, region: bytes, most: int) -> int | None:
    """Smallest edit distance of ``item`` to any substring of ``region`` if it
    is at most ``most`` (bit-parallel dynamic programme)."""
    if item in region:
        return 0
    m = len(item)
    where: dict[int, int] = {}
    for i, c in enumerate(item):
        where[c] = where.get(c, 0) | 1 << i
    mask, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = mask, 0, m, m
    for c in region:
        eq = where.get(c, 0)
        x = (((eq & up) + up) ^ up) | eq | down
        ph, mh = down | ~(x | up) & mask, up & x
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = ph << 1 & mask, mh << 1 & mask
        up, down = mh | ~((eq | down) | ph) & mask, ph & (eq | down)
        best = min(best, score)
    return best if best <= most else None


class Items:
    """A block of benchmark items with the hashes of their pieces, sorted."""

    def __init__(self, items: list[tuple[int, bytes]], max_edits: float):
        # An item that may be edited away would be everywhere: one byte of it stays.
        self.items = [(i, t, min(int(len(t) * max_edits + 1e-9), len(t) - 1)) for i, t in items]
        by_width: dict[int, list[tuple[int, np.ndarray]]] = {}
        for n, (_, t, most) in enumerate(self.items):
            width, offsets = pieces(len(t), most)
            by_width.setdefault(width, []).append((n, offsets))
        joined = np.frombuffer(b"".join(t for _, t, _ in self.items), np.uint8)
        first = np.concatenate(([0], np.cumsum([len(t) for _, t, _ in self.items])))
        self.tables = {}
        for width, some in sorted(by_width.items()):
            owner = np.concatenate([np.full(len(o), n) for n, o in some])
            offset = np.concatenate([o for _, o in some])
            (_, key), = prefix_keys(joined, first[owner] + offset, [width])
            order = np.argsort(key, kind="stable")
            there = np.zeros(1 << 20, bool)
            there[key >> np.uint64(44)] = True
            self.tables[width] = (key[order], owner[order], offset[order], there)
        self.verbatim = np.array([most == 0 for _, _, most in self.items])
        self.lengths = np.array([len(t) for _, t, _ in self.items])

    def _shared_enough(self, cand: np.ndarray, joined: bytes, base: np.ndarray) -> np.ndarray:
        """Candidates whose region holds enough of the item's 4-grams: each edit
        spoils at most four of them, so no match is lost."""
        codes = gram_codes(np.frombuffer(joined, np.uint8))
        cand = cand[np.lexsort((cand[:, 2], cand[:, 0], cand[:, 1]))]
        keep, marks = [], np.zeros(1 << 16, bool)
        edge = np.flatnonzero(np.diff(cand[:, 1], prepend=-1, append=-1))
        for a, b in zip(edge[:-1], edge[1:]):
            n = cand[a, 1]
            _, item, most = self.items[n]
            own = gram_codes(np.frombuffer(item, np.uint8))
            marks[own] = True
            span = len(item) + 4 * most
            step = max(1, (1 << 21) // span)
            for c in range(a, b, step):
                part = cand[c : min(c + step, b)]
                first = base[part[:, 0]] + part[:, 2] - 2 * most
                at = first[:, None] + np.arange(span)
                inside = (at >= base[part[:, 0]][:, None]) & (at < base[part[:, 0] + 1][:, None])
                shared = (marks[codes[np.clip(at, 0, len(codes) - 1)]] & inside).sum(axis=1)
                keep.append(part[shared >= len(item) - 3 - 4 * most])
            marks[own] = False
        return np.concatenate(keep) if keep else cand[:0]

    def hits(self, texts: list[bytes]):
        """(text number, item number, start, edits) for texts made normal()."""
        # No text or item holds a zero byte, so no piece is found across two texts.
        joined = b"".join(t + b"\0" for t in texts) + bytes(PIECE)
        buf = np.frombuffer(joined, np.uint8)
        base = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
        inner = _WORD[buf]
        found = []
        for width, key in prefix_keys(buf, np.arange(base[-1]), list(self.tables)):
            have, owner, offset, there = self.tables[width]
            row = np.flatnonzero(there[key >> np.uint64(44)])
            lo = np.searchsorted(have, key[row])
            count = np.searchsorted(have, key[row], side="right") - lo
            pick = np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            row = np.repeat(row, count)
            doc = np.searchsorted(base, row, side="right") - 1
            part = np.stack([doc, owner[pick], row - base[doc] - offset[pick]], axis=1)
            # An item that must be verbatim stands between word borders.
            exact = np.flatnonzero(self.verbatim[part[:, 1]])
            at = base[doc[exact]] + part[exact, 2]
            end = np.minimum(at + self.lengths[part[exact, 1]], len(buf) - 1)
            part = np.delete(part, exact[inner[at - 1] & inner[at] | inner[end - 1] & inner[end]], axis=0)
            part = part[np.lexsort((part[:, 2], part[:, 1], part[:, 0]))]
            # One alignment, of an item that must be verbatim the first only, is enough.
            differ = np.diff(part, axis=0, prepend=-1 << 40) != 0
            found.append(part[differ[:, :2].any(axis=1) | differ[:, 2] & ~(self.verbatim[part[:, 1]] & (width < PIECE))])
        done: dict[tuple[int, int], tuple[int, int]] = {}
        if found:
            cand = self._shared_enough(np.concatenate(found), joined, base)
            tried: dict[tuple[int, int], int] = {}
            for d, n, at in cand.tolist():
                _, item, most = self.items[n]
                # The region reaches 2 * most to each side: starts within most of one tried add nothing.
                if done.get((d, n), (1 << 60,))[0] == 0 or at <= tried.get((d, n), -1 << 60) + most:
                    continue
                tried[d, n] = at
                lo = max(0, at - 2 * most)
                edits = best_match(item, texts[d][lo : max(0, at + len(item) + 2 * most)], most)
                if edits is not None and edits < done.get((d, n), (1 << 60,))[0]:
                    done[d, n] = (edits, max(at, 0))
        return [(d, n, at, edits) for (d, n), (edits, at) in sorted(done.items())]


def item_blocks(benchmark: DataFrame):
    """The benchmark's distinct normalised items, null and empty ones left out,
    in blocks of about BLOCK_BYTES; each is fetched by itself.  Repeated rows
    become one before that."""
    items = (benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
             .where("text IS NOT NULL").distinct())
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES)
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        got = sorted({(r.item_id if r.item_id is not None else -1, n) for r in part if (n := normal(r.text.encode()))})
        if got:
            yield got


def _chunk_hits(items: Items, texts: list[bytes]):
    for lo, hi in chunks(texts, 1 << 20):
        for d, n, at, edits in items.hits([normal(t) for t in texts[lo:hi]]):
            yield lo + d, n, at, edits


def find(docs: DataFrame, benchmark: DataFrame, *, max_edits: float = 0.1) -> DataFrame:
    """(doc_id, item_id, start, edits): for every document and benchmark item
    where a passage of the document is within ``max_edits`` * length edits of
    the item; both made :func:`normal`, edits and ``start`` in their bytes.

    A passage within that many edits holds one of the item's :func:`pieces`
    verbatim.  Pieces are looked up at every byte of the documents, and where
    one stands, the item is checked by its grams and then by exact edit
    distance against the text around.  No passage is missed, whatever the
    length of its item, and a hit is never wrong.  An item too short for an edit
    (under 1 / ``max_edits`` bytes) stands verbatim between word borders: not
    with an ASCII letter or digit on both sides of its start or end.  The benchmark
    goes to the tasks in blocks of bounded size, one pass over the documents
    for each.  Null or empty texts match nothing; an item without an id gets
    -1.  Repeated rows give repeated results.  Other columns are ignored.
    """
    parts = []
    for block in item_blocks(benchmark):
        def run(batches, block=block):
            items = Items(block, max_edits)
            for b in batches:
                rows = list(_chunk_hits(items, text_bytes(b.column("text"))))
                ids = b.column("doc_id").to_pylist()
                yield pa.RecordBatch.from_arrays([
                    pa.array([ids[d] for d, _, _, _ in rows], pa.int64()), pa.array([block[n][0] for _, n, _, _ in rows], pa.int64()),
                    pa.array([x[2] for x in rows], pa.int64()), pa.array([x[3] for x in rows], pa.int64())],
                    names=["doc_id", "item_id", "start", "edits"])
        parts.append(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
            run, "doc_id long, item_id long, start long, edits long"))
    if not parts:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(
            F.lit(0).cast("long").alias(c) for c in ("item_id", "start", "edits"))).limit(0)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, *, max_edits: float = 0.1) -> DataFrame:
    """The rows of ``docs``, all columns, in which :func:`find` finds nothing.

    The blocks of the benchmark are looked for one after the other; texts with
    a hit are noted by two hashes of the text, and their rows left out at the
    end, so that a task holds one block at a time."""
    def searched(run):
        key = [F.xxhash64("text").alias("_t1"), F.xxhash64(F.lit("text"), "text").alias("_t2")]
        return docs.where("text IS NOT NULL").select(*key, "text").mapInArrow(run, "_t1 long, _t2 long")

    found = []
    for block in item_blocks(benchmark):
        def run(batches, block=block):
            items = Items(block, max_edits)
            for b in batches:
                rows = pa.array(sorted({d for d, _, _, _ in _chunk_hits(items, text_bytes(b.column("text")))}), pa.int64())
                yield b.select(["_t1", "_t2"]).take(rows)
        found.append(saved(searched(run).distinct(), "leaks"))
    if not found:
        return docs
    gone = found[0]
    for f in found[1:]:
        gone = gone.unionAll(f)
    gone = F.broadcast(gone) if sum(f.count() for f in found) <= BROADCAST_KEYS else gone
    on = [F.xxhash64(docs["text"]) == gone["_t1"], F.xxhash64(F.lit("text"), docs["text"]) == gone["_t2"]]
    return docs.join(gone, on, "left_anti")
