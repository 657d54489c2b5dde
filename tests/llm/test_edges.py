"""Hot keys, repeated and clashing rows, empty tables; classifiers and the
shard tree against plain loops."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.llm import bpe, decontam, quality, sharding, topk, toxicity
from panelcast.llm.common import WordHasher
from panelcast.llm.queries import GROWN, TREE

LABELS = "doc_id long, quality int, toxic int"


def labelled(make_docs, spark, n=60, extra=()):
    rng = random.Random(3)
    good, bad = "measure result method theorem lemma".split(), "buy!!! $$$ click win a".split()
    rows = [(i, " ".join(rng.choice(good if i % 2 else bad) for _ in range(40))) for i in range(n)]
    labels = [(i, i % 2, 1 - i % 2) for i in range(n)]
    return make_docs(rows + list(extra)), spark.createDataFrame(labels, LABELS)


# ---------------------------------------------------------------- shard tree

def test_shards_by_an_independent_descent(spark):
    """Level by level in SQL: each node draws -ln(u) / weight from its path and the key."""
    nodes = {}
    for s in TREE:
        for path in (f"/{s.region}", f"/{s.region}/{s.rack}", f"/{s.region}/{s.rack}/{s.shard}"):
            nodes[path] = nodes.get(path, 0.0) + s.weight
    table = spark.createDataFrame(sorted(nodes.items()), "path string, weight double")
    keys = spark.range(400).select(F.col("id").alias("doc_id"))
    draws = {(r.doc_id, r.path): -math.log((((r.h & (1 << 64) - 1) >> 11) + 0.5) / (1 << 53)) / r.weight
             for r in keys.join(table, F.lit(True)).withColumn("h", F.xxhash64("path", F.col("doc_id").cast("string"))).collect()}
    got = {r.doc_id: r.shard for r in sharding.sharded(keys, "doc_id", TREE).collect()}
    for i in range(400):
        path = ""
        for _ in range(3):
            below = [p for p in nodes if p.startswith(path + "/") and p.count("/") == path.count("/") + 1]
            path = min(below, key=lambda p: (draws[i, p], p))
        assert got[i] == int(path.rsplit("/", 1)[1])


def test_shards_with_a_hot_key_long_texts_and_clashing_columns(spark, make_docs):
    rows = [(7, f"text {k}") for k in range(3000)] + [(k, "x " * 50_000 if k < 2 else "y") for k in range(600)] + [(None, None)] * 3
    docs = make_docs(rows).withColumns({"slot": F.lit(-1), "grown_shard": F.lit(-1)})
    out = sharding.sharded(docs, "doc_id", TREE, grown=GROWN, carry=["text"])
    assert out.columns == ["doc_id", "text", "shard", "slot", "grown_shard"]
    got = out.collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(rows)
    for s in range(8):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    # The hot key's rows are ordered in many parts, not in one.
    part = F.shiftrightunsigned(F.xxhash64(F.lit("slot"), "doc_id", "text"), 64 - sharding.SLOT_BITS)
    assert max(r["count"] for r in docs.where("doc_id = 7").groupBy(part).count().collect()) < 20


# ---------------------------------------------------------------- classifiers

def test_attention_gradients_and_forward_pass():
    rng = np.random.default_rng(4)
    m = {k: np.asarray(v, float) for k, v in quality._init(rng).items()}
    counts = np.array([1, 3, 2])
    x, y = np.abs(rng.normal(size=(6, quality.FEATURES))), np.array([1.0, 0.0, 1.0])

    def plain(m):
        scores, at = [], 0
        for c in counts:
            h = [np.tanh(x[at + k] @ m["W"] + m["b"]) for k in range(c)]
            e = [math.exp(sum(m["a"][j] * math.tanh(v @ m["V"][:, j]) / (1 + math.exp(-(v @ m["U"][:, j]))) for j in range(len(m["a"])))) for v in h]
            z = sum(w / sum(e) * v for w, v in zip(e, h))
            scores.append(1 / (1 + math.exp(-(z @ m["c"] + m["d"][0]))))
            at += c
        return np.array(scores)

    assert np.allclose(quality.forward(m, x, counts)["p"], plain(m), atol=1e-12)

    def loss(m):
        p = quality.forward(m, x, counts)["p"]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    g = quality._gradients(m, x, counts, y)
    for k, v in m.items():
        flat = np.ravel(g[k])
        for i in range(0, v.size, max(1, v.size // 7)):
            up, down = ({**m, k: v.copy()} for _ in (0, 1))
            up[k].flat[i] += 1e-5
            down[k].flat[i] -= 1e-5
            assert (loss(up) - loss(down)) / 2e-5 == pytest.approx(flat[i], abs=1e-7)


def test_naive_bayes_ratios_and_scores_by_plain_loops():
    texts = [b"you are bad bad", b"nice day", b"bad bad bad", b"a nice nice walk", b"", b"so bad a day"] * 3
    y = np.array([1, 0, 1, 0, 0, 1] * 3, float)
    seen = np.zeros(1 << toxicity.BITS, np.int32)
    bags = [toxicity.features(t, seen) for t in texts]

    def number(gram):
        h = len(gram)
        for b in gram:
            h = (h ^ b) * 0x9E3779B1 & 0xFFFFFFFF
            h ^= h >> 15
        return h >> (32 - toxicity.BITS)

    for t, bag in zip(texts, bags):
        padded = b" " + t.lower() + b" "
        assert sorted(bag.tolist()) == sorted({number(padded[i : i + n]) for n in toxicity.GRAMS for i in range(len(padded) - n + 1)})
    first = toxicity.train(bags, y, epochs=0)
    assert not first["v"].any() and first["bias"] == pytest.approx(0.0)
    model = toxicity.train(bags, y, epochs=12)
    for f in set(np.concatenate(bags).tolist()):
        p = 1 + sum(f in b.tolist() for b, k in zip(bags, y) if k)
        q = 1 + sum(f in b.tolist() for b, k in zip(bags, y) if not k)
        r = math.log(p / (y.sum() + 2)) - math.log(q / ((1 - y).sum() + 2))
        # A feature's weight times its ratio speaks for the class that has it more often.
        if p + q < 5 or abs(r) < 1e-12:
            assert model["v"][f] == 0
    assert all((model["bias"] + sum(float(model["v"][f]) for f in b) > 0) == bool(k) for b, k in zip(bags, y) if len(b))


@pytest.mark.parametrize("module, label", [(quality, "quality"), (toxicity, "toxic")])
def test_classifier_edge_tables(spark, make_docs, module, label):
    odd = [(900, None), (901, ""), (901, ""), (None, "buy!!!"), (902, "word " * 60_000)]
    docs, labels = labelled(make_docs, spark, extra=odd)
    model = module.fit(docs, labels)
    got = module.scored(docs, model).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in docs.select("doc_id").collect())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out is not None for r in got)
    assert module.scored(docs.limit(0), model).count() == 0
    # A doc_id with a third of all rows, labelled twice, is one training row.
    hot = make_docs([(1, f"result {k}") for k in range(300)])
    twice = labels.union(labels)
    sent = quality.training_texts(docs.union(hot), quality.training_ids(twice, label, 5, 0, 3000)).collect()
    assert len({r.doc_id for r in sent}) == len(sent) <= 60
    module.fit(docs.union(hot), twice)
    none = module.fit(docs.limit(0), labels)
    assert {r.score for r in module.scored(docs, none).collect()} == {0.5}


def test_training_bounds_hold_for_long_texts(spark, make_docs):
    long = " ".join(random.Random(8).choices("abcdefghijklmnopqrstuvwxyz0123456789", k=200_000))
    docs, labels = labelled(make_docs, spark, 20, extra=[(21, long)])
    labels = labels.union(spark.createDataFrame([(21, 1, 0)], LABELS))
    seen = np.zeros(1 << toxicity.BITS, np.int32)
    assert len(toxicity.features(long.encode(), seen)) > 1 << 10
    assert len(quality.encode([long.encode()], WordHasher())[0]) > 50
    for model, module in ((quality.fit(docs, labels, max_passages=50), quality), (toxicity.fit(docs, labels, max_features=1 << 10), toxicity)):
        assert "constant" not in model and module.scored(docs, model).count() == 21


# ---------------------------------------------------------------- top-k, BPE

def test_top_k_ties_empty_and_clashing_columns(spark):
    schema = "vec_id long, embedding array<float>, score string, rank string, query_id string"
    vec = spark.createDataFrame([(i, [0.5] * 8, "s", "r", "q") for i in range(120)], schema)
    got = topk.top_k(vec, k=5, every=50).collect()
    want = [(q, k + 1, v, 8 * 128 * 128) for q in (0, 50, 100) for k, v in enumerate([i for i in range(6) if i != q][:5])]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == want
    assert topk.top_k(vec.limit(0), k=5, every=50).count() == 0


# ---------------------------------------------------------------- decontamination

def test_short_items_stand_between_word_borders(spark, make_docs):
    bench = spark.createDataFrame([(1, "cat"), (2, "7"), (3, "北京")], "item_id long, text string")
    docs = make_docs([(1, "banana category"), (2, "a Cat!"), (3, "cat"), (4, "concat 17 77"), (5, "category cat"), (6, "is 7"), (7, "在北京住")])
    assert {(r.doc_id, r.item_id) for r in decontam.find(docs, bench).collect()} == {(2, 1), (3, 1), (5, 1), (6, 2), (7, 3)}
    assert {r.doc_id for r in decontam.clean(docs, bench).collect()} == {1, 4}


def test_several_blocks_and_repeated_items(spark, make_docs, monkeypatch):
    rng = random.Random(2)
    item = lambda: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(12))
    items = [(k, item()) for k in range(40)]
    rows = [(k, f"some {items[k % 40][1] if k % 3 == 0 else item()} text") for k in range(120)] + [(500, None), (501, ""), (None, items[0][1])]
    # One row a third of the benchmark; the same text under two ids; an item twice in one document.
    bench = spark.createDataFrame([*items, *[items[3]] * 20, (77, items[6][1])], "item_id long, text string")
    docs = make_docs([*rows, (600, f"{items[9][1]} {items[9][1]}")])

    def results():
        return (sorted(map(str, decontam.find(docs, bench).collect())), sorted(str(r) for r in decontam.clean(docs, bench).collect()))

    whole = results()
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 500)
    assert sum(1 for _ in decontam.item_blocks(bench)) > 2
    assert results() == whole
    hits = Counter((r.doc_id, r.item_id) for r in decontam.find(docs, bench).collect())
    assert set(hits.values()) == {1} and hits[600, 9] == hits[6, 6] == hits[6, 77] == 1
    assert decontam.clean(docs, bench).columns == docs.columns
    assert {r.doc_id for r in decontam.clean(docs, bench).collect()} == {k for k in range(120) if k % 3} | {500, 501}


def test_many_short_items_in_bounded_memory(spark, make_docs):
    items = spark.range(50_000).selectExpr("id AS item_id", "concat('q', lpad(id, 8, '0'), ' what') AS text")
    docs = make_docs([(1, "before q00012345 what after"), (2, "nothing here"), (3, "q00012346 whet")])
    got = {(r.doc_id, r.item_id) for r in decontam.find(docs, items).collect()}
    assert (1, 12345) in got and (3, 12346) in got and all(d != 2 for d, _ in got)
