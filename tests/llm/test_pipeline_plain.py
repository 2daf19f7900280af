"""The rows of the whole pipeline against its five rules in plain Python, without the operators."""

import hashlib
import itertools
import math
import re

import corpus_pipeline
import pytest

SF = "/root/testdata/sf0.001"
WHITE = " \t\n\v\f\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lines(texts):
    """A line of 20 characters that three documents hold stays in the last of them."""
    key = lambda x: x.strip(WHITE).translate(LOWER)
    held = {}
    for i, t in texts.items():
        for x in t.split("\n"):
            held.setdefault(key(x), set()).add(i)
    gone = lambda i, x: len(key(x).encode()) >= 20 and len(held[key(x)]) >= 3 and max(held[key(x)]) != i
    return {i: "\n".join(x for x in t.split("\n") if not gone(i, x)) for i, t in texts.items()}


def near_copies(texts):
    """The first of each group over pairs of Jaccard similarity 0.8 of five-word shingles."""
    sets, root = {}, {i: i for i in texts}
    for i, t in texts.items():
        w = t.encode().lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    for a, b in itertools.combinations(sorted(texts), 2):
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            low, high = sorted((root[a], root[b]))
            root = {i: low if r == high else r for i, r in root.items()}
    return {i: t for i, t in texts.items() if root[i] == i}


def holds(w, item):
    """Whether some stretch of ``w`` is within a fifth of the item's words of it."""
    k = len(item) // 5
    step = len(item) // (k + 1)  # of k + 1 parts one is free of edits
    parts = {tuple(item[s * step : (s + 1) * step]) for s in range(k + 1)}
    if not any(tuple(w[j : j + step]) in parts for j in range(len(w) - step + 1)):
        return False
    up = list(range(len(item) + 1))
    for v in w:
        row = [0]
        for i, x in enumerate(item, 1):
            row.append(min(up[i] + 1, row[-1] + 1, up[i - 1] + (v != x)))
        up = row
        if up[-1] <= k:
            return True
    return False


def leaks(texts, benchmark):
    words = lambda t: re.findall(rb"[a-z0-9\x80-\xff]+", t.encode().lower())
    items = [words(t) for t in benchmark]
    return {i: t for i, t in texts.items() if not any(holds(words(t), x) for x in items)}


def mix(texts, source):
    """Repeats of each document: water-filling to 1.5 times all words, two epochs at most."""
    size = {i: len(re.findall(r"[^ \t\n\v\f\r]+", t)) for i, t in texts.items()}
    total = {}
    for i, n in size.items():
        total[source[i]] = total.get(source[i], 0) + n
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(total, key=lambda s: (s is None, s or "")))}
    target, open_, left = {}, set(total), 1.5 * sum(size.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] >= 2 * total[s]} or open_
        target |= {s: min(share[s], 2.0 * total[s]) for s in over}
        left -= sum(target[s] for s in over)
        open_ -= over
    out = {}
    for s in total:
        whole = math.floor(target[s] / total[s]) if total[s] else 0
        part, until = max(target[s] - whole * total[s], 0), 0
        for i in sorted((i for i in size if source[i] == s), key=lambda i: hashlib.md5(f"mix-1:{i}".encode()).hexdigest()):
            until += size[i]
            out[i] = min(whole + (until - size[i] / 2 <= part), 2) if size[i] else 0
    return out


@pytest.mark.parametrize("sf", [SF])
def test_rows_of_the_pipeline(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()
    source = {r["doc_id"]: r["source"] for r in rows}
    assert len(source) == len(rows)
    texts = lines({r["doc_id"]: r["text"] for r in rows if r["text"] and any(c.isalpha() for c in r["text"])})
    kept = near_copies(texts)
    assert 3 in kept and 122 not in kept and 177 not in kept
    clean = leaks(kept, [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()])
    assert 0 < len(clean) < len(kept) < len(texts)
    repeats = mix(clean, source)
    want = sorted((i, clean[i], source[i], k) for i, n in repeats.items() for k in range(1, n + 1))
    have = corpus_pipeline.run(spark, sf).select("doc_id", "text", "source", "copy").collect()
    assert sorted(map(tuple, have)) == want
