"""Recall of the benchmark search with all allowed edits, wherever they stand, and items of any size and number."""

import numpy as np
import pytest
from chromatile.llm import decontam

PLACES = ("front", "middle", "end", "spread", "even")


def edited(item, k, place, rng):
    n, w = len(item), item.tolist()
    spots = {
        "front": range(k), "middle": range((n - k) // 2, (n - k) // 2 + k), "end": range(n - k, n),
        "spread": sorted(rng.choice(n, k, replace=False).tolist()), "even": [int((j + 0.5) * n / k) for j in range(k)],
    }[place]
    for p in reversed(list(spots)):
        new = int(rng.integers(1, 2**63))
        w[p : p + 1] = [[], [new], [w[p], new]][rng.integers(3)]
    return w


@pytest.mark.parametrize("place", PLACES)
@pytest.mark.parametrize("n", [6, 9, 15, 24, 40, 100, 300])
def test_recall(n, place):
    rng = np.random.default_rng(n)
    k, trials = decontam.edits_allowed(n), 50
    items = [rng.integers(1, 2**63, n).astype(np.uint64) for _ in range(trials)]
    noise = lambda: rng.integers(1, 2**63, 20).astype(np.uint64)
    texts = [np.concatenate([noise(), np.array(edited(x, k, place, rng), np.uint64), noise()]) for x in items]
    first = np.cumsum([0, *map(len, texts)])
    found = decontam.Index(items, decontam.SIMILARITY).matches(np.concatenate(texts), first)
    assert set(found) <= {(i, i) for i in range(trials)}
    assert len(found) >= 0.98 * trials
    assert all(e <= k and 20 - k <= s <= 20 + k and abs(m - n) <= k for e, s, m in found.values())


def plain_stretch(item, text):
    """Least edits of any stretch, by trying all."""
    best = (len(item) + 1, 0, 0)
    for s in range(len(text) + 1):
        up = list(range(len(item) + 1))
        for j in range(s, len(text)):
            row = [j - s + 1]
            for i, x in enumerate(item, 1):
                row.append(min(up[i] + 1, row[-1] + 1, up[i - 1] + (x != text[j])))
            up = row
            best = min(best, (up[-1], s, j - s + 1))
    return best


def test_best_stretch():
    rng = np.random.default_rng(3)
    for _ in range(60):
        item, text = rng.integers(0, 4, rng.integers(2, 8)), rng.integers(0, 4, rng.integers(1, 14))
        want = plain_stretch(item.tolist(), text.tolist())
        most = len(item) - 1
        assert decontam.best_stretch(item, text, most) == (want if want[0] <= most else (most + 1, 0, 0))


def test_short_equal_and_stem_sharing_items(spark):
    stem = "which of the following statements about the lake in the north is true"
    items = [(1, "Yes"), (2, "forty two"), (3, "a b c d e"), (4, "a B c, d e!"), (5, None), (6, "..."), (None, "forty two")]
    items += [(10 + i, f"{stem} " + " ".join(f"w{i}x{j}" for j in range(30))) for i in range(40)]
    docs = [(1, "oh yes indeed"), (2, "it is forty, two"), (3, "a b c e d"), (4, "x a b c d e y"), (5, stem), (6, "start " + items[12][1] + " end"), (7, None), (8, "")]
    df = spark.createDataFrame([(*d, "c", "c") for d in docs], "doc_id long, text string, key1 string, words string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for words in (decontam.SLICE_WORDS, 60):
        out = decontam.contamination(df, bench, slice_words=words).collect()
        have = sorted(((r["doc_id"], r["item_id"], r["edits"], r["start"], r["length"]) for r in out), key=repr)
        want = [(1, 1, 0, 1, 1), (2, 2, 0, 2, 2), (2, None, 0, 2, 2), (4, 3, 0, 1, 5), (4, 4, 0, 1, 5), (6, items[12][0], 0, 1, 43)]
        assert have == sorted(want, key=repr)
        clean = decontam.keep_clean(df, bench, slice_words=words)
        assert sorted(r["doc_id"] for r in clean.collect()) == [3, 5, 7, 8] and clean.columns == df.columns
    assert decontam.contamination(df, bench.limit(0)).count() == 0 and decontam.keep_clean(df, bench.limit(0)).count() == len(docs)


def test_texts_with_starts_that_no_walk_meets(spark):
    item = [f"w{i}" for i in range(30)]
    near = " ".join(f"w3 w4 w5 x{i}" for i in range(12))  # triples of the item, none where a walk of it starts
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    docs = spark.createDataFrame([(1, near)], "doc_id long, text string")
    assert decontam.contamination(docs, bench).collect() == []
    assert [r["doc_id"] for r in decontam.keep_clean(docs, bench).collect()] == [1]
    both = docs.union(spark.createDataFrame([(2, " ".join(item))], docs.schema)).coalesce(1)
    assert [(r["doc_id"], r["item_id"], r["edits"]) for r in decontam.contamination(both, bench).collect()] == [(2, 7, 0)]
