"""Runs against a plain search of every period."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from chromatile.llm import runs
from chromatile.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plain(w):
    """(start, length, period) of all runs, by trying every period."""
    n, out = len(w), {}
    for q in range(1, n // 3 + 1):
        s = None
        for j in range(n - q + 1):
            equal = j < n - q and w[j] == w[j + q]
            if equal and s is None:
                s = j
            if not equal and s is not None:
                if j + q - s >= max(24, 3 * q):
                    out.setdefault((s, j + q), q)
                s = None
    return sorted((s, e - s, q) for (s, e), q in out.items())


def sample(rng):
    k, n = rng.choice([1, 2, 3, 5, 50]), rng.randint(0, 200)
    letters = lambda m: [rng.randrange(k) for _ in range(m)]
    kind = rng.randrange(6)
    if kind == 0:
        return letters(n)
    if kind == 1:
        return letters(rng.randint(0, 20)) + (letters(rng.randint(1, 30)) * 200)[:n] + letters(rng.randint(0, 20))
    if kind == 2:  # repetitions of repetitions
        part = (letters(rng.randint(1, 6)) * rng.randint(3, 12))[: rng.randint(1, 60)] + letters(1)
        return part * rng.randint(1, 6) + letters(1) * rng.randint(0, 40)
    if kind == 3:  # Fibonacci words
        a, b = [0], [0, 1]
        while len(b) <= n:
            a, b = b, b + a
        return b
    if kind == 4:  # Thue-Morse words
        s = [0]
        while len(s) < n:
            s = s + [1 - x for x in s]
        return s * rng.randint(1, 4)
    return letters(1) * n


@pytest.mark.parametrize("seed", range(6))
def test_block_runs(seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(runs, "BATCH", rng.choice([1, 50, 1 << 18]))
    for _ in range(25):
        docs = [sample(rng) for _ in range(rng.randint(1, 6))]
        if rng.random() < 0.5:
            docs += [list(docs[0]), docs[-1][3:]]
        ids = np.array([x for d in docs for x in d], np.int64)
        got = [[] for _ in docs]
        for d, *r in runs.block_runs(ids, np.cumsum([0, *map(len, docs)])).tolist():
            got[d].append(tuple(r))
        assert got == [plain(d) for d in docs]


def test_grammar_shares_repeats():
    """A long repetition is a logarithmic number of symbols, each searched once."""
    ids = np.tile(np.arange(7), 3000)
    trees = runs.Trees(ids, np.zeros(len(ids), np.int64))
    nodes = np.concatenate(trees.nodes)
    assert len(nodes) == len(ids) - 1
    assert len(np.unique(nodes[:, 0])) < 60
    assert runs.block_runs(ids, np.array([0, len(ids)])).tolist() == [[0, 0, len(ids), 7]]


def digests(w):
    found = plain(w)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    top = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
    text = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (
        len(found), *top, top[0] if top[0] is None else 1000 * top[1] // top[2],
        text("".join(f"{s},{n},{q}\n" for s, n, q in found)), text(" ".join(x for i, x in enumerate(w) if i not in gone)),
    )


def planted(d, text):
    """The query's own words of a document."""
    w = runs.WORD.findall(text or "")
    h = zlib.crc32(str(d).encode())
    if d is None or h % 10 or not w:
        return w
    g, out = h // 10, list(w)
    a = g % len(w)
    p = 1 + (len(w) - a) // (3 + g % 8)
    for i in range(a, len(w)):
        out[i] = w[a + (i - a) % p]
    return out


def test_query(spark):
    got = QUERIES["op13_grammar_runs"](spark, SF)
    kinds = ["bigint"] * 6 + ["string"] * 2
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert [f.dataType.simpleString() for f in got.schema] == kinds
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((d, *digests(planted(d, t))) for d, t in docs if len((t or "").split()) < 3000)
    assert sum(r[1] > 0 for r in want) > 10
    have = {r["doc_id"]: tuple(r) for r in got.collect()}
    assert len(have) == len(docs) and [have[r[0]] for r in want] == want


def test_awkward_rows(spark):
    tail = "x " + "red green blue " * 20 + "y"
    texts = [(1, None), (2, ""), (3, " \t\n "), (None, tail), (4, tail), (4, tail), (5, "w " * 40_000), (6, "é b " * 30), (7, "a\x85 " * 23), (8, " ".join(map(str, range(20_000))))]
    docs = spark.createDataFrame([(*t, "c", "c", "c") for t in texts], "doc_id long, text string, runs string, top string, start string").repartition(2)
    rows = sorted((tuple(r) for r in runs.run_digests(runs.periodic_runs(docs)).collect()), key=repr)
    want = [(d, *digests(runs.WORD.findall(t or ""))) for d, t in texts if d not in (5, 8)]
    flat = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want += [(5, 1, 0, 40_000, 1, 40_000_000, flat("0,40000,1\n"), flat("w")), (8, 0, None, None, None, None, flat(""), flat(texts[-1][1]))]
    assert rows == sorted(want, key=repr)
    assert runs.run_digests(runs.periodic_runs(docs.limit(0))).count() == 0
