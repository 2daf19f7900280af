"""Benchmark decontamination by edit distance over words.

Texts and items are read as words (runs of letters and digits, A-Z lower-cased).  A
document leaks an item if some stretch of it turns into the item with at most a fifth
of the item's words inserted, deleted or replaced.

* The CGK embedding walks over a sequence: at each step it writes the current word and
  advances or stays by a random bit of step and word.  Sequences at a small edit
  distance fall into step again after each edit, so their walks agree at most steps:
  edit distance becomes Hamming distance.
* A repetition has a walk of its own and keeps ``SAMPLES`` sampled steps as its hash
  (bit sampling).  Items are walked from several starts, so that the walks cover the whole
  item: whatever the place of the edits, one of these stretches has no more than its share
  of them.  It meets the text in one repetition at least with probability ``RECALL``, taking
  every sampled step to agree with probability ``AGREE`` at that share; copies always meet.
* Windows are started at every word.  By the q-gram lemma a stretch within k edits of an
  item of n words shares at least n - 2 - 3k of its word triples, and one at least when k
  edits leave a run of three; where the words around a start have fewer, nothing is hashed.
  This loses nothing.
* Whatever meets is aligned with the whole item around it by exact edit distance, with both
  ends of the text free.  Items under ``MIN_ITEM`` words have no edits and are looked up.

Items of equal words are one item until the result.  They are broadcast in slices of at most
``SLICE_WORDS`` words (or one item); documents are never shuffled.

Results: null and empty texts leak nothing, and items without words are leaked by nothing; an
item of a word or two is leaked by every text that holds them; null ids stay null; repeated rows are judged alike; other columns are
kept by ``keep_clean`` and ignored elsewhere; empty tables give no matches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from chromatile.llm.text import ODD_A, ODD_B, Rolling, blocks, mixed, word_spans
from chromatile.session import materialize

SIMILARITY = 0.8
MIN_ITEM = 6
SAMPLES = 3
#: Steps of a walk by the size of the item.
STEPS = (6, 12, 24)
RECALL, AGREE = 0.98, 0.5
SLICE_WORDS = 500_000
GRAM = 3

LETTERS = np.zeros(256, bool)
LETTERS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def repetitions(recall: float = RECALL, agree: float = AGREE, samples: int = SAMPLES) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - agree**samples))


def edits_allowed(n: int, similarity: float = SIMILARITY) -> int:
    """Edits that an item of ``n`` words may have; short ones none."""
    return math.floor((1 - similarity) * n + 1e-9) if n >= MIN_ITEM else 0


def words_of(raw: np.ndarray, at: np.ndarray, rolling: Rolling) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and per text the index of its first word."""
    starts, ends, first = word_spans(raw, at, LETTERS)
    return rolling(LOWER[raw], starts, ends), first


#: Costs of an alignment are edits times this plus the place where it starts.
COST = 1 << 32


def best_stretch(item: np.ndarray, text: np.ndarray, most: int) -> tuple[int, int, int]:
    """(edits, start, length) of the stretch of ``text`` with the least edits, then the first, then the shortest; above ``most``: (most + 1, 0, 0)."""
    drop = np.arange(len(item) + 1) * COST
    up, best, end = drop, (most + 1) * COST, 0
    row = np.empty(len(item) + 1, np.int64)
    for j, w in enumerate(text.tolist(), 1):
        row[0] = j
        np.minimum(up[1:] + COST, up[:-1] + COST * (item != w), out=row[1:])
        up = np.minimum.accumulate(row - drop) + drop
        if up[-1] < best:
            best, end = int(up[-1]), j
        if best < COST:
            break
    edits, start = divmod(best, COST)
    return (edits, start, end - start) if end else (most + 1, 0, 0)


class Walks:
    """CGK walks with shared randomness: repetition, step and word give the bit."""

    def __init__(self, reps: int, steps: int = max(STEPS), samples: int = SAMPLES, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.reps, self.steps, self.samples = reps, steps, samples
        self.odd = rng.integers(1, 2**63, (reps, steps), np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        self.order = [rng.permutation(steps) for _ in range(reps)]

    def kept(self, rep: int, reach: int) -> set[int]:
        """The sampled steps among the first ``reach``."""
        return {int(s) for s in [s for s in self.order[rep] if s < reach][: self.samples]}

    def hashes(self, words: np.ndarray, starts: np.ndarray, rep: int, reach: int) -> np.ndarray:
        """Hash of the sampled steps of the walk from each start; a walk of ``reach`` steps reads that many words at most."""
        at, out = starts, np.full(len(starts), reach, np.uint64)
        kept = self.kept(rep, reach)
        for step in range(max(kept) + 1 if kept else 0):
            w = words[at]
            if step in kept:
                out = mixed(out * np.uint64(ODD_A) + w)
            at = at + ((w * self.odd[rep, step]) >> np.uint64(63)).astype(np.int64)
        return out


def stretches(n: int) -> tuple[int, list[int]]:
    """Steps of the walks of an item of ``n`` words, and where they start: a walk reads about half as many words as it has steps."""
    steps = max(k for k in STEPS if k <= n)
    return steps, sorted({*range(0, n - steps + 1, steps // 2), n - steps})


class Index:
    """Hash tables of one slice of the benchmark; built from word hashes in each task."""

    def __init__(self, items: list[np.ndarray], similarity: float):
        self.items = items
        self.limit = [edits_allowed(len(w), similarity) for w in items]
        self.walks = Walks(repetitions(), max(STEPS))
        self.grams = Rolling(ODD_B)
        sizes = np.array([len(w) for w in items], np.int64)
        flat = np.concatenate(items) if items else np.zeros(0, np.uint64)
        begin = np.cumsum(sizes) - sizes
        inside = np.arange(len(flat)) - np.repeat(begin, sizes)
        at = np.flatnonzero((inside + GRAM <= np.repeat(sizes, sizes)) & (np.repeat(sizes, sizes) >= MIN_ITEM))
        grams = self.grams(flat, at, at + GRAM)
        owner = np.repeat(np.arange(len(items)), sizes)[at]
        self.bags = [set(g.tolist()) for g in np.split(grams, np.searchsorted(owner, np.arange(1, len(items))))] if items else []
        self.known = np.unique(grams)
        self.bloom = np.zeros(1 << 22, bool)
        self.bloom[self.known >> np.uint64(42)] = True
        # Per size of items: words around a start that hold the widest match, and how many triples of it must be known.
        need = {}
        for n, k in zip(sizes.tolist(), self.limit):
            if n >= MIN_ITEM:
                size = 1 << (n - 1).bit_length()
                old = need.get(size, (0, n))
                need[size] = max(old[0], n + k), min(old[1], max(1, n - GRAM + 1 - GRAM * k))
        self.need = sorted(need.values())
        self.tables, self.short = {}, {}
        spots: dict[int, list[tuple[int, int]]] = {}
        for i, n in enumerate(sizes.tolist()):
            if n >= MIN_ITEM:
                steps, starts = stretches(n)
                spots.setdefault(steps, []).extend((i, o) for o in starts)
        for steps, places in spots.items():
            member, offset = np.array(places, np.int64).T
            for rep in range(self.walks.reps):
                h = self.walks.hashes(flat, begin[member] + offset, rep, steps)
                order = np.argsort(h)
                self.tables[steps, rep] = h[order], member[order], offset[order]
        for n in range(1, MIN_ITEM):
            own = np.flatnonzero(sizes == n)
            if len(own):
                h = self.grams(flat, begin[own], begin[own] + n)
                order = np.argsort(h)
                self.short[n] = h[order], own[order]

    def _starts(self, h: np.ndarray) -> np.ndarray:
        """Starts with enough of the word triples ``h`` of the benchmark around them."""
        n = len(h)
        hit = self.bloom[h >> np.uint64(42)]
        spots = np.flatnonzero(hit)
        if not len(spots) or not len(self.known):
            return spots[:0]
        place = np.minimum(np.searchsorted(self.known, h[spots]), len(self.known) - 1)
        marks = np.zeros(n, np.int64)
        marks[spots[self.known[place] == h[spots]]] = 1
        total = np.append(0, np.cumsum(marks))
        at = np.arange(n)
        keep = np.zeros(n, bool)
        for width, least in self.need:
            keep |= total[np.minimum(at + width, n)] - total[np.maximum(at - width, 0)] >= least
        return np.flatnonzero(keep)

    def matches(self, words: np.ndarray, first: np.ndarray) -> dict[tuple[int, int], tuple[int, int, int]]:
        """(text, item index) -> (edits, start, length), the least edits and then the first start."""
        found: dict[tuple[int, int], tuple[int, int, int]] = {}
        for n, (table, member) in self.short.items():
            at = np.arange(max(0, len(words) - n + 1))
            d = np.searchsorted(first, at, "right") - 1
            at, d = at[at + n <= first[d + 1]], d[at + n <= first[d + 1]]
            h = self.grams(words, at, at + n)
            spot = np.minimum(np.searchsorted(table, h), len(table) - 1)
            for j in np.flatnonzero(table[spot] == h).tolist():
                i = int(member[spot[j]])
                if (int(d[j]), i) not in found and (words[at[j] : at[j] + n] == self.items[i]).all():
                    found[int(d[j]), i] = 0, int(at[j] - first[d[j]]), n
        at = np.arange(max(0, len(words) - GRAM + 1))
        grams = self.grams(words, at, at + GRAM)
        starts = self._starts(grams)
        if not len(starts):
            return found
        padded = np.concatenate([words, np.zeros(max(STEPS), np.uint64)])
        hits = []
        for (steps, rep), (table, member, offset) in self.tables.items():
            h = self.walks.hashes(padded, starts, rep, steps)
            lo, hi = np.searchsorted(table, h, "left"), np.searchsorted(table, h, "right")
            met = np.flatnonzero(hi > lo)
            n = (hi - lo)[met]
            spot = np.repeat(lo[met], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at = np.repeat(starts[met], n)
            hits.append(np.unique(np.stack([np.searchsorted(first, at, "right") - 1, member[spot], at - offset[spot]], 1), axis=0))
        hits = np.unique(np.concatenate(hits), axis=0)
        if not len(hits):
            return found
        # Of one text and item, places whose surroundings overlap are looked at together.
        bound = np.array(self.limit)
        reach = np.array([len(w) for w in self.items]) + 2 * bound
        lo = np.maximum(hits[:, 2] - 2 * bound[hits[:, 1]], first[hits[:, 0]])
        hi = np.minimum(hits[:, 2] + reach[hits[:, 1]], first[hits[:, 0] + 1])
        new = np.append(True, (np.diff(hits[:, :2], axis=0) != 0).any(1) | (lo[1:] > hi[:-1]))
        head = np.flatnonzero(new)
        for g, e in zip(head.tolist(), np.append(head[1:], len(hits)).tolist()):
            d, i, a, b = int(hits[g, 0]), int(hits[g, 1]), int(lo[g]), int(hi[g:e].max(initial=0))
            item, limit = self.items[i], self.limit[i]
            best = found.get((d, i), (limit + 1, 0, 0))[0]
            # The lemma again, for this item and fewer edits than found so far.
            own = grams[a : max(a, b - GRAM + 1)].tolist()
            if best == 0 or sum(map(self.bags[i].__contains__, own)) < len(item) - GRAM + 1 - GRAM * (best - 1):
                continue
            edits, start, length = best_stretch(item, words[a:b], best - 1)
            if edits < best:
                found[d, i] = (edits, a - int(first[d]) + start, length)
        return found


ITEM = ["key1", "key2"]


def _items(benchmark: DataFrame) -> DataFrame:
    """``(item_id, key1, key2, words)``: hashes of the words of every item with words, and 128 bits that name them."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling(ODD_A)
        for batch in batches:
            words = []
            for _, _, raw, at in blocks(batch.column("text")):
                w, first = words_of(raw, at, rolling)
                words += [w[first[d] : first[d + 1]].view(np.int64).tolist() for d in range(len(at) - 1)]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(words, pa.list_(pa.int64()))], names=["item_id", "words"])

    items = rows.mapInArrow(run, "item_id long, words array<long>").filter(F.size("words") > 0)
    return materialize(items.select("item_id", F.xxhash64("words").alias("key1"), F.xxhash64(F.lit(1), "words").alias("key2"), "words"), "items")


def _slices(items: DataFrame, similarity: float, slice_words: int) -> Iterator:
    """Broadcast distinct items, each time of a bounded number of words."""
    once = items.groupBy(*ITEM).agg(F.first("words").alias("words"))
    total = once.agg(F.sum(F.size("words"))).first()[0] or 0
    n = max(1, -(-total // slice_words))
    # A bucket holds about a slice; running sums in it cut what is more.
    bucket = once.withColumn("bucket", F.pmod("key1", F.lit(n)))
    until = F.sum(F.size("words").cast("long")).over(Window.partitionBy("bucket").orderBy(*ITEM).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cut = materialize(bucket.withColumn("cut", F.floor((until - 1) / slice_words)), "slices")
    for b, c in sorted(tuple(r) for r in cut.select("bucket", "cut").distinct().collect()):
        rows = cut.filter((F.col("bucket") == b) & (F.col("cut") == c)).select(*ITEM, "words").collect()
        packed = [((r["key1"], r["key2"]), np.array(r["words"], np.int64).view(np.uint64)) for r in sorted(rows)]
        yield items.sparkSession.sparkContext.broadcast((packed, similarity))


class Matcher:
    """Finds leaks in Arrow columns of texts, against one slice."""

    def __init__(self, shared):
        self.shared, self.index, self.keys, self.rolling = shared, None, [], Rolling(ODD_A)

    def __call__(self, text: pa.Array) -> list[tuple[int, int, int, int, int]]:
        """(row, item index, edits, start, length) of each leaked item."""
        if self.index is None:
            packed, similarity = self.shared.value
            self.keys, self.index = [k for k, _ in packed], Index([w for _, w in packed], similarity)
        out = []
        for lo, _, raw, at in blocks(text):
            words, first = words_of(raw, at, self.rolling)
            out += [(lo + d, i, *rest) for (d, i), rest in self.index.matches(words, first).items()]
        return out


def contamination(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, slice_words: int = SLICE_WORDS) -> DataFrame:
    """One row per leaked pair: doc_id, item_id, edits, item_words, start (word), length (words), similarity."""
    schema = "doc_id long, key1 long, key2 long, edits int, item_words int, start long, length int"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = _items(benchmark)
    out = items.select(F.lit(None).cast("long").alias("doc_id"), *ITEM, *[F.lit(0).alias(c) for c in ("edits", "item_words", "start", "length")]).limit(0)
    for shared in _slices(items, similarity, slice_words):
        find = Matcher(shared)

        def run(batches: Iterator[pa.RecordBatch], find=find) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, found = batch.column("doc_id").to_pylist(), find(batch.column("text"))
                cells = [(ids[d], *find.keys[i], e, len(find.index.items[i]), s, n) for d, i, e, s, n in found]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32()]
                cols = list(zip(*cells)) if cells else [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in schema.split(", ")])

        out = out.unionByName(rows.mapInArrow(run, schema))
    named = out.join(items.select("item_id", *ITEM), ITEM)
    return named.select("doc_id", "item_id", "edits", "item_words", "start", "length", (1 - F.col("edits") / F.col("item_words")).alias("similarity"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, slice_words: int = SLICE_WORDS) -> DataFrame:
    """The documents that leak no item, in all their columns."""
    for shared in _slices(_items(benchmark), similarity, slice_words):
        find = Matcher(shared)

        def run(batches: Iterator[pa.RecordBatch], find=find) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[[d for d, *_ in find(batch.column("text"))]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
