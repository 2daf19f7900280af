"""The line store after deletions: filters that deny nothing held, and counts of the documents that are left."""

import collections

import numpy as np
import xxhash
from chromatile.llm import linededup


def test_layers_lose_no_key():
    rng = np.random.default_rng(0)
    k1, k2 = rng.integers(-(2**63), 2**63, (2, 50_000))
    layers, layer, at = linededup.Layers([]), [], 0
    for n in (5_000, 12_000, 33_000):
        layer.append(layers.insert(k1[at : at + n], k2[at : at + n]))
        layers, at = linededup.Layers(layers.dump()), at + n
    layer = np.concatenate(layer)
    assert len(layers.filters) >= 3 and set(layer) == set(range(len(layers.filters)))
    assert layers.contains(k1, k2).all()
    gone = np.zeros(len(k1), bool)
    gone[5_000:17_000] = True
    layers.delete(k1[gone], k2[gone], layer[gone])
    assert layers.contains(k1[~gone], k2[~gone]).all()
    assert layers.contains(k1[gone], k2[gone]).mean() < 0.01
    back = layers.insert(k1[gone], k2[gone])
    assert layers.contains(k1, k2).all()
    layers.delete(k1[gone], k2[gone], back)
    layers.delete(k1[~gone], k2[~gone], layer[~gone])
    assert all(not f.table.any() for f in layers.filters)


def test_full_filter_opens_a_larger_one():
    rng = np.random.default_rng(1)
    k1, k2 = rng.integers(-(2**63), 2**63, (2, 340_000))
    layers = linededup.Layers([])
    layers.insert(k1[:40_000], k2[:40_000])
    layers.insert(k1[40_000:], k2[40_000:])
    assert layers.contains(k1, k2).all() and len(layers.filters) <= 4


def counts(texts):
    """Documents and largest document of every key, over (doc_id, text)."""
    held = collections.defaultdict(set)
    for d, t in texts.items():
        for line in t.encode().split(b"\n"):
            k = linededup.line_key(line)
            if linededup.counted(k, linededup.MIN_CHARS):
                held[tuple(np.frombuffer(xxhash.xxh3_128_digest(k), "<i8").tolist())].add(d)
    return sorted((*k, len(d), max(d)) for k, d in held.items())


def refs(store):
    return sorted(tuple(r) for r in store.refs.select("k1", "k2", "n", "top").collect())


def table(spark, texts):
    return spark.createDataFrame(list(texts.items()), "doc_id long, text string")


def test_insertion_after_deletion(spark):
    one = {1: "\n".join(f"first line number {i:06d} of the store" for i in range(40)), 2: "first line number 000018 of the store"}
    two = {10: "\n".join([*(f"second batch line {i:06d} goes on top" for i in range(200)), "extra line 00019617 with enough chars"])}
    three = {3: "first line number 000018 of the store"}
    store = linededup.LineStore(spark).insert(table(spark, one)).insert(table(spark, two)).delete(table(spark, two).select("doc_id")).insert(table(spark, three))
    assert refs(store) == counts(one | three)
    assert sorted(r["_id"] for r in store.decisions().collect()) == [1, 2]


def test_many_versions_and_more_shards(spark, monkeypatch):
    monkeypatch.setattr(linededup, "SHARD_KEYS", 150)
    rng = np.random.default_rng(2)
    line = lambda i: f"line {i:05d} of a text that grows and shrinks"
    batch = lambda lo, hi, most: {d: "\n".join(line(i) for i in rng.integers(0, most, 30)) for d in range(lo, hi)}
    parts = [batch(0, 8, 200), batch(20, 60, 900), batch(100, 160, 2_000)]
    held, store = {}, linededup.LineStore(spark)
    for part, gone in zip(parts, ([3, 5], [1, 25, 26, 40], [30, *range(100, 130)])):
        store = store.insert(table(spark, part))
        held |= part
        assert refs(store) == counts(held)
        store = store.delete(spark.createDataFrame([(d,) for d in gone], "doc_id long"))
        held = {d: t for d, t in held.items() if d not in gone}
        assert refs(store) == counts(held)
    assert store.shards > 3
    keys = store.refs.select("k1", "k2", "n", "top")
    assert store._known(keys).filter("not maybe").count() == 0
    again = linededup.LineStore(spark).insert(table(spark, held))
    drops = lambda s: sorted((r["_id"], sorted(map(tuple, r["drops"]))) for r in s.decisions().collect())
    assert drops(store) == drops(again) != []
