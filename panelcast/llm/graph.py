"""Links within buckets and connected components, as joins and aggregates."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm.common import dropped, matching, mixed, saved

#: Whether two signatures may belong to a link: arrays of rows of bytes in, a mask out.
Alike = Callable[[np.ndarray, np.ndarray], np.ndarray]
#: The same of two signatures that are longs, from their exclusive or.
Near = Callable[[Column], Column]
#: Ids to (id, body), and which pairs (i, j) of a list of bodies make a link.
Bodies = Callable[[DataFrame], DataFrame]
Holds = Callable[[list[bytes], np.ndarray, np.ndarray], np.ndarray]
#: Members on one side of a tile; pairs compared in one go.
TILE, PAIRS_AT_ONCE = 2048, 1 << 15
#: Rows that get a body in one pass: this many, or the number of bodies
#: if that is more, so that the shuffle files of a pass are as large as the texts.
ROWS_A_PASS = 1 << 18
#: Bytes of a packed entry; entries packed in one go; ids for each label of the entries' hash.
ENTRY, ENTRIES_AT_ONCE, IDS_A_LABEL = 6, 1 << 20, 1 << 15
#: Members of a bucket that are looked at pair by pair where buckets are counted.
BUCKET = 1024
#: Blocks of ids at least, and ids in a block, of which the bodies are in memory.
BLOCKS, BLOCK = 8, 1 << 17


def one_by_one(holds: Callable[[bytes, bytes], bool]) -> Holds:
    return lambda bodies, i, j: np.fromiter((holds(bodies[a], bodies[b]) for a, b in zip(i.tolist(), j.tolist())), bool, len(i))


def _parts(rows: DataFrame, ids: DataFrame, least: int = 1) -> int:
    """Passes in which the rows of a stored table get the bodies of these ids."""
    return max(least, -(-rows.count() // max(ROWS_A_PASS, ids.count())))


def _part(rows: DataFrame, key: str, p: int, n: int) -> DataFrame:
    """The rows that the hash of ``key`` has in one of n passes."""
    return rows.where(F.pmod(F.xxhash64(key), F.lit(n)) == p) if n > 1 else rows


def connected_components(links: DataFrame) -> DataFrame:
    """(id, comp) for every node of ``links`` (a, b): comp is the smallest id
    reachable.

    Alternating large-star and small-star steps.  Each round is stored in
    the shared scratch folder; it ends when a round changes nothing.
    """
    def stats(e):
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    e = saved(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    was = stats(e)
    while was[0]:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (both.where("b > a").join(least, "a")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(down, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .union(down.select("a", F.col("m").alias("b"))).distinct())
        after = saved(small, "edges")
        now = stats(after)
        dropped(e)
        e, same, was = after, now == was, now
        if same:
            break
    return e.select(F.col("a").alias("id"), F.col("b").alias("comp")).union(
        e.select(F.col("b").alias("id"), F.col("b").alias("comp")).distinct())


def _binary(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _ids(pairs: DataFrame) -> DataFrame:
    return saved(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "ids")


def _both(pairs: DataFrame, parts: DataFrame, p: int = 0, n: int = 1) -> DataFrame:
    """(a, b, x, y): the pairs, of one of n passes by a, with the parts (id, value) of either side."""
    first = _part(parts, "id", p, n).toDF("a", "x")
    return _part(pairs, "a", p, n).join(first, "a").join(parts.toDF("b", "y"), "b").select("a", "b", "x", "y")


def _verified(pairs: DataFrame, bodies: Bodies, holds: Holds) -> DataFrame:
    """The stored pairs (a, b) whose bodies hold, stored in their place."""
    kind = pairs.schema["a"].dataType.simpleString()

    def exact(batches):
        for b in batches:
            own = np.arange(b.num_rows)
            keep = holds(b.column("x").to_pylist() + b.column("y").to_pylist(), own, own + b.num_rows)
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    ids = _ids(pairs)
    own = saved(bodies(ids), "bodies")
    n = _parts(pairs, ids)
    links = [saved(_both(pairs, own, p, n).mapInArrow(exact, f"a {kind}, b {kind}"), "links") for p in range(n)]
    for x in (pairs, ids, own):
        dropped(x)
    return reduce(DataFrame.union, links)


def _linked(pairs: DataFrame, sigs: DataFrame, alike: Alike, bodies: Bodies, holds: Holds) -> DataFrame:
    """The stored pairs (a, b) that are links.  Signatures, then bodies, are fetched
    for the ids of the pairs only."""
    kind = pairs.schema["a"].dataType.simpleString()

    def likely(batches):
        for b in batches:
            if b.num_rows:
                yield b.select(["a", "b"]).filter(pa.array(alike(_binary(b.column("x")), _binary(b.column("y")))))

    ids = _ids(pairs)
    own = saved(matching(sigs, ids, "id"), "sigs")
    near = saved(_both(pairs, own).mapInArrow(likely, f"a {kind}, b {kind}"), "near")
    for x in (pairs, ids, own):
        dropped(x)
    return _verified(near, bodies, holds)


def _groups(batches):
    """Tables that hold whole runs of equal g (rows come sorted by g)."""
    held = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if held is None else pa.concat_tables([held, t])
        g = t.column("g").to_numpy()
        last = int(np.searchsorted(g, g[-1])) if len(g) else 0
        if last:
            yield t.slice(0, last).combine_chunks()
        held = t.slice(last)
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def _runs(g: np.ndarray):
    edge = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1], [True])))
    return zip(edge[:-1].tolist(), edge[1:].tolist())


def _first_links(bodies: list[bytes], i: np.ndarray, j: np.ndarray, pair: np.ndarray, holds: Holds) -> tuple[np.ndarray, np.ndarray]:
    """One link (i, j) for every value of ``pair`` that has any.  The first
    candidate of each is compared, then four times as many of those without a
    link, and so on."""
    order = np.argsort(pair, kind="stable")
    i, j, pair = i[order], j[order], np.unique(pair, return_inverse=True)[1][order]
    rank = np.arange(len(pair)) - np.searchsorted(pair, pair)
    linked, left, most, found = np.zeros(len(pair), bool), np.arange(len(pair)), 1, []
    while len(left):
        now = left[rank[left] < most]
        for at in range(0, len(now), PAIRS_AT_ONCE):
            some = now[at : at + PAIRS_AT_ONCE]
            some = some[~linked[pair[some]]]
            some = some[holds(bodies, i[some], j[some])]
            some = some[np.unique(pair[some], return_index=True)[1]]
            linked[pair[some]] = True
            found.append(some)
        left = left[(rank[left] >= most) & ~linked[pair[left]]]
        most *= 4
    found = np.concatenate([np.zeros(0, np.int64), *found])
    return i[found], j[found]


def _cross_links(tiles: DataFrame, alike: Alike, bodies: Bodies, holds: Holds, masks: Sequence[int], passes: int, spent: DataFrame) -> DataFrame:
    """Links (a, b) of each tile (g, few, apart, id, comp, sig, table) between a row
    marked ``few`` and another of a different component; of two that are both
    ``apart`` from the main one, the smaller id's row looks for the other.  Signatures, then bodies,
    are compared in memory: a tile gives a row for each of its rows that has
    a candidate, with all of them in one list, and then one link for every two
    components that it finds linked.  Two signatures that agree on the mask of
    a table before the tile's own are left to that table.  A body goes to every
    tile that needs it, in ``passes`` or more by the tiles' hash.  ``spent`` is the stored
    table that the tiles are made of, deleted once they have been read."""
    kind = tiles.schema["id"].dataType.simpleString()

    def met_before(x, y, table):
        differ, out = np.ascontiguousarray(x ^ y).view(">u8").ravel(), np.zeros(len(x), bool)
        for m in masks[:table]:
            out |= differ & np.uint64(m) == 0
        return out

    def likely(batches):
        for t in _groups(batches):
            tables = t.column("table").to_numpy()
            g, few, sig = t.column("g").to_numpy(), t.column("few").to_numpy(), _binary(t.column("sig").combine_chunks())
            apart, order = t.column("apart").to_numpy(), t.column("id").to_numpy()
            ids, comps = t.column("id").to_pylist(), t.column("comp").combine_chunks()
            comp = comps.dictionary_encode().indices.to_numpy()
            at, lists, groups = [], [], []
            for a, b in _runs(g):
                one, two, wanted = a + np.flatnonzero(few[a:b]), a + np.flatnonzero(~few[a:b]), set()
                step = max(1, PAIRS_AT_ONCE // max(len(two), 1))
                for c in range(0, len(one) if len(two) else 0, step):
                    part = one[c : c + step]
                    i, j = np.repeat(part, len(two)), np.tile(two, len(part))
                    # Two rows outside the main component are together in another tile too, the other way round.
                    other = (comp[i] != comp[j]) & ~(apart[j] & (order[i] > order[j]))
                    i, j = i[other], j[other]
                    ok = alike(sig[i], sig[j])
                    i, j = i[ok], j[ok]
                    if tables[a]:
                        ok = ~met_before(sig[i], sig[j], tables[a])
                        i, j = i[ok], j[ok]
                    for x, y in _runs(i) if len(i) else ():
                        at.append(i[x])
                        lists.append([ids[k] for k in j[x:y]])
                        groups.append(g[a])
                    wanted.update(j.tolist())
                for k in sorted(wanted):
                    at.append(k)
                    lists.append(None)
                    groups.append(g[a])
            own, at = t.schema.field("id").type, pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([
                pa.array(groups, pa.int64()), t.column("id").combine_chunks().take(at), comps.take(at),
                pa.array(lists, pa.list_(own))], names=["g", "id", "comp", "others"])

    def exact(batches):
        for t in _groups(batches):
            ids, others = t.column("id").combine_chunks(), t.column("others").combine_chunks()
            if pa.types.is_null(others.type) or not len(others.drop_null().flatten()):
                continue
            wanted = others.drop_null().flatten()
            listed = others.is_valid().to_numpy(zero_copy_only=False)
            i = np.repeat(np.flatnonzero(listed), others.drop_null().value_lengths().to_numpy())
            # Each id of a list is a row of the same tile that has no list.
            name = pa.concat_arrays([ids, wanted]).dictionary_encode()
            code, g = name.indices.to_numpy().astype(np.int64), t.column("g").to_numpy()
            tile = np.cumsum(np.concatenate(([0], g[1:] != g[:-1]))) * len(name.dictionary)
            rows = np.flatnonzero(~listed)
            at = code[: len(ids)][rows] + tile[rows]
            rows, at = rows[np.argsort(at)], np.sort(at)
            if not len(rows):
                continue
            want = code[len(ids) :] + tile[i]
            place = np.minimum(np.searchsorted(at, want), len(at) - 1)
            known = at[place] == want
            i, j = i[known], rows[place[known]]
            comp = t.column("comp").combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
            i, j = _first_links(t.column("body").to_pylist(), i, j, comp[i] * len(t) + comp[j], holds)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(i)), ids.take(pa.array(j))], names=["a", "b"])

    near = saved(tiles.mapInArrow(likely, f"g long, id {kind}, comp {kind}, others array<{kind}>"), "near")
    dropped(spent)
    ids = saved(near.select("id").distinct(), "ids")
    own = saved(bodies(ids), "bodies")
    n = _parts(near, ids, passes)
    links = [saved(_part(near, "g", p, n).join(own.toDF("id", "body"), "id")
                   .repartition("g").sortWithinPartitions("g").mapInArrow(exact, f"a {kind}, b {kind}").distinct(), "links")
             for p in range(n)]
    for x in (near, ids, own):
        dropped(x)
    return reduce(DataFrame.union, links)


def _labelled(entries: np.ndarray, labels: int) -> np.ndarray:
    return (mixed(entries) % np.uint64(labels)).astype(np.int32)


def _packed(signed: DataFrame, labels: int, part: int, parts: int) -> DataFrame:
    """(label, low, high, id, sig) of the entries (44 bits, ENTRY bytes each in ``grams``)
    whose label is one of this part: a row holds the entries of many ids, as bytes of arrays."""

    def run(batches):
        held, size = [], 0

        def flushed():
            entry, ids, sig = (np.concatenate(x) for x in zip(*held))
            label = _labelled(entry, labels)
            mine = label % parts == part
            entry, ids, sig, label = entry[mine], ids[mine], sig[mine], label[mine]
            order = np.lexsort((entry, label))
            entry, ids, sig, label = entry[order], ids[order], sig[order], label[order]
            spans = list(_runs(label)) if len(label) else []
            columns = [(entry & np.uint64(0xFFFFFFFF)).astype(np.uint32), (entry >> np.uint64(32)).astype(np.uint16), ids, sig]
            return pa.RecordBatch.from_arrays(
                [pa.array([label[x] for x, _ in spans], pa.int32()), *[pa.array([c[x:y].tobytes() for x, y in spans], pa.binary()) for c in columns]],
                names=["label", "low", "high", "id", "sig"])

        for b in batches:
            counts = b.column("grams").cast(pa.binary()).to_pylist()
            many = np.fromiter(map(len, counts), np.int64, len(counts)) // ENTRY
            raw = np.zeros((int(many.sum()), 8), np.uint8)
            raw[:, :ENTRY] = np.frombuffer(b"".join(counts), np.uint8).reshape(-1, ENTRY)
            held.append((raw.view(np.uint64).ravel(), *(np.repeat(b.column(c).to_numpy(), many) for c in ("pid", "sim"))))
            size += len(raw)
            if size >= ENTRIES_AT_ONCE:
                yield flushed()
                held, size = [], 0
        if size:
            yield flushed()

    return signed.select("pid", "sim", "grams").mapInArrow(run, "label int, low binary, high binary, id binary, sig binary")


def _met(packed: DataFrame, alike: Alike) -> DataFrame:
    """What the packed entries, sorted by label, give: (tile, pairs) with the pairs
    of ids that share an entry and are ``alike``, and (bucket, n, id, sig) for
    every member of a bucket of over BUCKET ids."""

    def bucketed(entry, ids, sig):
        order = np.argsort(entry, kind="stable")
        entry, ids, sig = entry[order], ids[order], sig[order]
        size = np.diff(np.flatnonzero(np.concatenate(([True], entry[1:] != entry[:-1], [True]))))
        size, of = size[size > 1], np.repeat(size, size)
        entry, ids, sig, of = entry[of > 1], ids[of > 1], sig[of > 1], of[of > 1]
        end, large = np.repeat(np.cumsum(size), size), of > BUCKET
        at, t, found = np.flatnonzero(~large), 0, [np.zeros((2, 0), np.int64)]
        while len(at):
            t += 1
            at = at[at + t < end[at]]
            ok = at[alike(sig[at], sig[at + t])]
            found.append(np.sort(np.stack((ids[ok], ids[ok + t])), axis=0))
        a, b = np.concatenate(found, axis=1)
        yield from tiled(a, b)
        if large.any():
            rows = pa.RecordBatch.from_arrays([
                pa.array((entry[large] << np.uint64(8)).view(np.int64)), pa.array(of[large]), pa.array(ids[large]), pa.array(sig[large])],
                names=["bucket", "n", "id", "sig"])
            yield pa.RecordBatch.from_arrays([pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), pa.binary()), *rows.columns], names=_MET)

    def run(batches):
        for _, *blobs in _grouped(batches, ("label", "low", "high", "id", "sig")):
            low, high, ids, sig = (np.frombuffer(b"".join(x), kind) for x, kind in zip(blobs, (np.uint32, np.uint16, np.int64, np.int64)))
            yield from bucketed(high.astype(np.uint64) << np.uint64(32) | low, ids, sig)

    return packed.mapInArrow(run, "tile long, pairs binary, bucket long, n long, id long, sig long")


_MET = ["tile", "pairs", "bucket", "n", "id", "sig"]


def _grouped(batches, names):
    """(first column, lists of the others' values) of each run of rows alike in the first column."""
    held, last = None, None
    for b in batches:
        for x, *values in zip(*(b.column(c).to_pylist() for c in names)):
            if held is None or x != last:
                if held is not None:
                    yield last, *held
                held, last = [[] for _ in values], x
            for column, value in zip(held, values):
                column.append(value)
    if held is not None:
        yield last, *held


def tiled(a: np.ndarray, b: np.ndarray):
    """Rows (tile, pairs) of pairs of ids, the smaller one first.  An id is its block's
    number and its place there (32 bits each); a tile is two blocks; its pairs, each once, are
    bytes of the steps between the first ids' places, then of the halves of the second
    ones', so that files of them are packed well."""
    tile = a >> 32 << 31 | b >> 32
    order = np.lexsort((b, a, tile))
    a, b, tile = a[order], b[order], tile[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    a, b, tile = a[new].astype(np.uint32), b[new].astype(np.uint32), tile[new]
    spans = list(_runs(tile)) if len(tile) else []
    if spans:
        low, high = b.astype(np.uint16), (b >> np.uint32(16)).astype(np.uint16)
        yield pa.RecordBatch.from_arrays([
            pa.array([tile[x] for x, _ in spans], pa.int64()),
            pa.array([np.diff(a[x:y], prepend=np.uint32(0)).tobytes() + low[x:y].tobytes() + high[x:y].tobytes() for x, y in spans], pa.binary()),
            *[pa.nulls(len(spans), pa.int64())] * 4], names=_MET)


def _untiled(tile: int, blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    a, b = [], []
    for x in blobs:
        n = len(x) // 8
        low, high = np.frombuffer(x, np.uint16, offset=4 * n).astype(np.int64).reshape(2, n)
        a.append(np.cumsum(np.frombuffer(x, np.uint32, n), dtype=np.int64))
        b.append(high << 16 | low)
    a, b = np.concatenate(a), np.concatenate(b)
    return a | tile >> 31 << 32, b | (tile & (1 << 31) - 1) << 32


def _new_links(bodies: list[bytes], i: np.ndarray, j: np.ndarray, holds: Holds):
    """Links among the pairs (i, j) that make the same components as all of them:
    the first pair of each j, then one for every two components that this leaves apart."""
    comp, links = list(range(len(bodies))), []

    def root(k):
        while comp[k] != k:
            comp[k] = k = comp[comp[k]]
        return k

    first = np.unique(j, return_index=True)[1]
    for at in range(0, len(first), 4 * PAIRS_AT_ONCE):
        part = first[at : at + 4 * PAIRS_AT_ONCE]
        links.append(part[holds(bodies, i[part], j[part])])
    links = np.concatenate([np.zeros(0, np.int64), *links])
    for x, y in zip(i[links].tolist(), j[links].tolist()):
        comp[root(x)] = root(y)
    comps = np.fromiter(map(root, range(len(comp))), np.int64, len(comp))
    rest = comps[i] != comps[j]
    rest[first] = False
    x, y = comps[i[rest]], comps[j[rest]]
    a, b = _first_links(bodies, i[rest], j[rest], np.minimum(x, y) * len(comp) + np.maximum(x, y), holds)
    return np.concatenate((i[links], a)), np.concatenate((j[links], b))


def _spread(df: DataFrame, n: int) -> list[int]:
    """n numbers, one for each partition of ``repartition(n, number)`` (nearly, if luck fails)."""
    spark, first = df.sparkSession, {}
    for x in spark.range(32 * n).select("id", F.pmod(F.hash("id"), F.lit(n)).alias("p")).collect():
        first.setdefault(x.p, x.id)
    return [first.get(p, 32 * n + p) for p in range(n)]


def _tile_links(near: DataFrame, own: DataFrame, holds: Holds, passes: int) -> DataFrame:
    """Links (a, b) of the stored rows (tile, pairs), each tile once.  A tile's two blocks
    of bodies (pid, id, body) go to it, in ``passes`` by tile."""
    spark = near.sparkSession
    tiles = sorted(x.tile for x in near.select("tile").distinct().collect())

    def exact(batches):
        for _, tile, blobs, pids, ids, bodies in _grouped(batches, ("label", "tile", "pairs", "pid", "id", "body")):
            many = sum(x is not None for x in blobs)
            if many:
                # Sorted by pid, the rows with pairs come first.
                pids, ids = (np.array(x[many:], np.int64) for x in (pids, ids))
                i, j = (np.searchsorted(pids, x) for x in _untiled(tile[0], blobs[:many]))
                i, j = _new_links(bodies[many:], i, j, holds)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[i], ids[j])), pa.array(np.maximum(ids[i], ids[j]))], names=["a", "b"])

    links = []
    for p in range(passes):
        mine = tiles[p::passes]
        labels = dict(zip(mine, _spread(near, max(len(mine), 1))))
        blocks = sorted({(labels[t], t, b) for t in mine for b in (t >> 31, t & (1 << 31) - 1)})
        table = spark.createDataFrame(blocks, "label long, tile long, block long")
        texts = (own.withColumn("block", F.shiftright("pid", 32)).join(F.broadcast(table), "block")
                 .select("label", "tile", F.lit(None).cast("binary").alias("pairs"), "pid", "id", "body"))
        pairs = near.join(F.broadcast(table.select("label", "tile").distinct()), "tile").select(
            "label", "tile", "pairs", *[F.lit(None).cast(k).alias(c) for c, k in (("pid", "long"), ("id", "long"), ("body", "binary"))])
        rows = pairs.union(texts).repartition(max(len(mine), 1), "label").sortWithinPartitions("label", "pid")
        links.append(saved(rows.mapInArrow(exact, "a long, b long"), "links"))
    out = saved(reduce(DataFrame.union, links), "links")
    for x in links:
        dropped(x)
    return out


def _packed_links(signed: DataFrame, alike: Alike, bodies: Bodies, holds: Holds, passes: int, spent: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, members of large buckets as (bucket, id, sig, n)) of the entries of stored rows (key, sim, grams)."""
    count = signed.count()
    blocks, labels = max(BLOCKS, -(-count // BLOCK)), passes * max(64, count // (passes * IDS_A_LABEL))

    def placed(batches):
        last, n = None, 0
        for b in batches:
            block = b.column("block").to_numpy()
            start = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
            place = np.arange(len(block)) - np.repeat(start, np.diff(np.append(start, len(block))))
            if len(block) and block[0] == last:
                place[block == last] += n
            if len(block):
                last, n = block[-1], int(place[-1]) + 1
            yield pa.RecordBatch.from_arrays([pa.array(block << 32 | place), *(b.column(c) for c in ("key", "sim", "grams"))], names=["pid", "key", "sim", "grams"])

    whole = saved(signed.select(F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("long").alias("block"), "key", "sim", "grams")
                  .repartition("block").sortWithinPartitions("block").mapInArrow(placed, "pid long, key long, sim long, grams binary"), "sketches")
    dropped(spent)
    shared = [saved(_met(_packed(whole, labels, p, passes).repartition("label").sortWithinPartitions("label"), alike), "shared") for p in range(passes)]
    names = saved(whole.select("pid", F.col("key").alias("id")), "names")
    dropped(whole)
    met = reduce(DataFrame.union, shared)

    def once(batches):
        for tile, blobs in _grouped(batches, ("tile", "pairs")):
            for b in tiled(*_untiled(tile, blobs)):
                yield b.select(["tile", "pairs"])

    near = saved(met.where("tile IS NOT NULL").select("tile", "pairs").repartition("tile").sortWithinPartitions("tile")
                 .mapInArrow(once, "tile long, pairs binary"), "near")
    large = saved(met.where("tile IS NULL").withColumnRenamed("id", "pid").join(names, "pid").select("bucket", "id", "sig", "n"), "large")
    for x in shared:
        dropped(x)
    found = saved(bodies(names.select("id")), "bodies")
    own = saved(found.join(names, "id").select("pid", "id", "body"), "bodies")
    dropped(found)
    links = _tile_links(near, own, holds, max(passes, 2 * (blocks - BLOCKS) + 1))
    for x in (near, own):
        dropped(x)
    return links, large


def bucket_components(members: DataFrame, keys: list[str], sigs: DataFrame | None, alike: Alike, bodies: Bodies, holds: Holds,
                      near: Near | None = None, masks: Sequence[int] = (), passes: int = 1,
                      spent: DataFrame | None = None, packed: bool = False) -> DataFrame:
    """Components of the graph that links two ids when they share a bucket,
    their signatures are ``alike`` and their bodies hold.  Returns (id, comp)
    for linked ids only.

    ``members`` holds distinct rows (keys..., id), ``sigs`` (id, sig) with
    signatures of one width (None with ``near``); ``bodies(ids)`` gives (id, body).  A group of
    copies shares many buckets, so pairs are not listed bucket by bucket.
    First each member is checked against its bucket's hub, the member with
    the largest total of bucket sizes (in a group of edited copies, the text
    that the others came from).  Members that this leaves outside their
    bucket's main component are then compared with all members of their bucket
    (without ``near``: of all buckets that share this main component), in
    tiles of bounded size; only links become rows.  Pairs within a component cannot change the result, so no
    link between components is lost.

    With ``near``, the members carry their signature as a long ``sig``, and
    the pairs are tested on it where they meet: ids are longs too, and the
    only pair of a bucket of two comes from the aggregate that counts it.  The
    low byte of a bucket, one long, is then the number of its table, whose members
    agree on ``masks[table]`` of their signature: a pair that meets in
    several tables is compared in the first.  Buckets are counted in ``passes``
    by their hash, so that the shuffle files of one pass are on disk at a time;
    ``spent`` is a stored table that nothing but the members reads, deleted then.
    With ``packed``, members are stored rows (key, sim, grams): the id, its signature and the
    entries of which each makes a bucket (of table 0).  Buckets of up to BUCKET
    members then have all their pairs that are ``near`` compared, each once, over arrays;
    only larger ones have hubs.
    """
    pair = [F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")]
    if near is None:
        sizes = members.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        shared = saved(members.join(sizes, keys), "shared")
        held = [shared]
    else:
        counted, held, links = [], [], None
        if packed:
            links, shared = _packed_links(members, alike, bodies, holds, passes, spent)
            if shared.isEmpty():
                dropped(shared)
                return saved(connected_components(links), "comps")
            held, sizes = [shared], None
        else:
            for p in range(passes):
                mine = members.where(F.pmod(F.xxhash64(*keys), F.lit(passes)) == p)
                counted.append(saved(mine.groupBy(*keys).agg(
                    F.count(F.lit(1)).alias("n"), F.min("id").alias("id"), F.max("id").alias("hub"), F.bit_xor("sig").alias("x"))
                    .where((F.col("n") > 2) | (F.col("n") == 2) & near(F.col("x"))), "sizes"))
                held.append(saved(mine.join(counted[-1].where("n > 2").select(*keys, "n"), keys), "shared"))
            sizes, shared = reduce(DataFrame.union, counted), reduce(DataFrame.union, held)
            if spent is not None:
                dropped(spent)
    score = shared.groupBy("id").agg(F.sum("n").alias("score"))
    hubs = (shared.join(score, "id").groupBy(*keys)
            .agg(F.max(F.struct("score", *[c for c in shared.columns if c in ("id", "sig")])).alias("top"))
            .select(*keys, F.col("top.id").alias("hub"), *[F.col("top.sig").alias("hub_sig")] * (near is not None)))
    if near is not None:
        hubs = saved(hubs, "hubs")
        held.append(hubs)
    met = shared.join(hubs, keys).where("id <> hub")
    if near is None:
        links = _linked(saved(met.select(*pair).distinct(), "pairs"), sigs, alike, bodies, holds)
    else:
        met = met.where(near(F.col("sig").bitwiseXOR(F.col("hub_sig")))).select(*pair)
        pairs = met if packed else met.union(sizes.where("n = 2").select(*pair))
        hubbed = _verified(saved(pairs.distinct(), "pairs"), bodies, holds)
        links = links.union(hubbed) if packed else hubbed
        for x in counted:
            dropped(x)
    comps = saved(connected_components(links), "comps")

    # Buckets of two have had their only pair tested, and with ``near`` hubs all of theirs.
    rest = shared.where("n > 2")
    if near is not None:
        rest = rest.join(hubs.select(*keys, "hub"), keys).where("id <> hub")
    rest = (rest.join(comps, "id", "left")
            .select(*keys, "id", F.coalesce("comp", "id").alias("comp"), *["sig"] * (near is not None)))
    parts = rest.groupBy(*keys, "comp").agg(F.count(F.lit(1)).alias("k"))
    mixed = (parts.groupBy(*keys).agg(F.max(F.struct("k", "comp")).alias("top"), F.count(F.lit(1)).alias("parts"))
             .where("parts > 1").select(*keys, F.col("top.comp").alias("main")))
    # Wide signatures: one group for all buckets of a main component, which often
    # hold the same members.  Longs, compared fast: each bucket by itself, so that
    # members which never met aren't compared.
    open_ = rest.join(mixed, keys)
    if near is None:
        open_ = saved(open_.select(F.col("main").alias("grp"), "main", "id", "comp").distinct(), "open")
    else:
        sig = F.unhex(F.lpad(F.hex("sig"), 16, "0")).alias("sig")
        open_ = saved(open_.select(F.col(*keys).alias("grp"), "main", "id", "comp", sig), "open")
    for x in held:
        dropped(x)
    if open_.isEmpty():
        return comps
    size = open_.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr("comp <> main")).alias("m"))
    rows = open_.join(size, "grp")
    if near is None:
        rows = rows.join(saved(matching(sigs, saved(open_.select("id").distinct(), "ids"), "id"), "sigs"), "id")
    slabs = lambda c: F.ceil(F.col(c) / TILE).cast("int")
    slab = lambda c: F.pmod(F.xxhash64("id"), slabs(c)).cast("int")
    all_slabs = lambda c: F.explode(F.sequence(F.lit(0), slabs(c) - 1))
    table = F.lit(0) if near is None else F.col("grp").bitwiseAND(F.lit(255)).cast("int")
    row = ["grp", "id", "comp", "sig", table.alias("table"), F.expr("comp <> main").alias("apart")]
    every = rows.select(*row, F.lit(False).alias("few"), slab("n").alias("j"), all_slabs("m").alias("i"))
    few = rows.where("comp <> main").select(*row, F.lit(True).alias("few"), all_slabs("n").alias("j"), slab("m").alias("i"))
    tiles = (every.unionByName(few).select(F.xxhash64("grp", "i", "j").alias("g"), "few", "apart", "id", "comp", "sig", "table")
             .repartition("g").sortWithinPartitions("g"))
    more = _cross_links(tiles, alike, bodies, holds, masks, passes, open_)
    if more.isEmpty():
        return comps
    return saved(connected_components(links.union(more)), "comps")
