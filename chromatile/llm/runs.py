"""Runs of repeated words, found on a grammar.

A run is a stretch of words with a smallest period, that no neighbouring word extends, at
least three periods and 24 words long.  The word ids of a block of documents are replaced
by Re-Pair in rounds: a round replaces every pair of neighbours that is repeated and more
frequent than the pairs it overlaps, by one symbol per distinct pair.  When no pair repeats,
the symbols left in a document are joined two by two, so that every document is one tree.
Each replacement is noted with its place, so all derivation positions of a symbol are known.

A run lies whole in the expansion of the lowest symbol that holds it, and crosses the middle
of that symbol.  So per symbol, at one of its places, the runs across its middle are looked
for once: the heavier side of a run begins with four words that stand again one period
further, which leaves few candidate periods, and each is extended both ways.  Extensions
compare names of windows of 1, 2, 4, 8 ... words, which are equal if and only if the windows
are.  The hits of a symbol are moved to all its places, those that a neighbour in the
document extends are dropped, for they lie whole in a symbol above, and of equal intervals
the smallest period is the period.

Results: a null or empty text has no words and no runs; a null ``doc_id`` stays null; every
row is a document of its own; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from chromatile.llm.text import blocks

WORD = re.compile(r"[^\x20\x09-\x0D]+")
MIN_LENGTH, MIN_PERIODS = 24, 3
#: The heavier side of a run repeats a sixth of ``MIN_LENGTH`` words, 4, one period on: windows of 2 to this power.
ANCHOR_LEVEL = 2
#: Candidate periods extended at once.
BATCH = 1 << 18


def window_names(ids: np.ndarray, doc: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Names of the windows of 1, 2, 4 ... words at every position, up to the size where none repeats.

    Two positions of a document have one name if and only if their windows are equal; a
    window that reaches past its document, or stands once in it, has a name of its own.
    """
    n = len(ids)
    alone = -1 - np.arange(n)
    live = np.arange(n)
    names, size = [], 1
    key = doc * np.int64(ids.max(initial=0) + 1) + ids
    while len(live):
        _, inverse = np.unique(key, return_inverse=True)
        repeated = np.bincount(inverse)[inverse] > 1
        live = live[repeated]
        level = alone.copy()
        level[live] = inverse[repeated]
        names.append(level)
        live = live[live + 2 * size <= ends[live]]
        live = live[level[live + size] >= 0]
        key = level[live] * np.int64(n) + level[live + size]
        size *= 2
    return names


def _ahead(names: list[np.ndarray], a: np.ndarray, b: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Words from ``a`` and from ``b`` > ``a`` on that are equal, at most ``room``."""
    far = np.zeros(len(a), np.int64)
    for k in range(len(names) - 1, -1, -1):
        # The largest window that no longer repeats is never equal, so one step a level is enough.
        go = np.flatnonzero(far < room)
        go = go[names[k][a[go] + far[go]] == names[k][b[go] + far[go]]]
        far[go] += 1 << k
    return np.minimum(far, room)


def _behind(names: list[np.ndarray], a: np.ndarray, b: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Words before ``a`` and before ``b`` > ``a`` that are equal, at most ``room``."""
    far = np.zeros(len(a), np.int64)
    for k in range(len(names) - 1, -1, -1):
        go = np.flatnonzero(far + (1 << k) <= room)
        step = far[go] + (1 << k)
        go = go[names[k][a[go] - step] == names[k][b[go] - step]]
        far[go] += 1 << k
    return far


class Trees:
    """Derivation trees of a block of documents: for every node its symbol, start, middle and end."""

    def __init__(self, ids: np.ndarray, doc: np.ndarray):
        self.nodes: list[np.ndarray] = []
        n = len(ids)
        self.rules = np.zeros(0, np.int64)  # sorted pairs, each a symbol of its own
        self.symbols = np.zeros(0, np.int64)
        self.next = int(ids.max(initial=-1)) + 1
        self.most = self.next + 2 * n + 2
        s, at, owner = ids.astype(np.int64), np.arange(n), doc
        ends = np.append(at[1:], n)
        growing = True
        while len(s) > 1:
            inside = owner[:-1] == owner[1:]
            if not inside.any():
                break
            pairs = s[:-1] * np.int64(self.most) + s[1:]
            chosen = self._frequent(pairs, inside) if growing else self._neighbours(owner)
            if growing and not len(chosen):
                growing = False
                continue
            s = s.copy()
            s[chosen] = self._symbol(pairs[chosen])
            self.nodes.append(np.stack([s[chosen], at[chosen], at[chosen + 1], ends[chosen + 1]], 1))
            keep = np.ones(len(s), bool)
            keep[chosen + 1] = False
            ends = ends.copy()
            ends[chosen] = ends[chosen + 1]
            s, at, ends, owner = s[keep], at[keep], ends[keep], owner[keep]

    @staticmethod
    def _frequent(pairs: np.ndarray, inside: np.ndarray) -> np.ndarray:
        """Occurrences of repeated pairs that are more frequent than the pairs they overlap."""
        _, inverse, count = np.unique(np.where(inside, pairs, -1), return_inverse=True, return_counts=True)
        rank = np.where(inside & (count[inverse] > 1), count[inverse] * np.int64(len(count) + 1) + inverse + 1, 0)
        same = np.append(False, rank[1:] == rank[:-1]) & (rank > 0)
        # Of a pair that overlaps itself every second occurrence counts.
        spot = np.arange(len(rank))
        begin = np.maximum.accumulate(np.where(same, -1, spot))
        odd = (spot - begin) % 2 == 1
        left = np.append(0, rank[:-1])
        right = np.append(rank[1:], 0)
        return np.flatnonzero((rank > 0) & ((rank > left) | same) & (rank >= right) & ~odd)

    @staticmethod
    def _neighbours(owner: np.ndarray) -> np.ndarray:
        """Every second place of each document that has a right neighbour."""
        spot = np.arange(len(owner))
        begin = np.maximum.accumulate(np.where(np.append(True, owner[1:] != owner[:-1]), spot, 0))
        return np.flatnonzero(((spot - begin) % 2 == 0)[:-1] & (owner[:-1] == owner[1:]))

    def _symbol(self, pairs: np.ndarray) -> np.ndarray:
        """One symbol per distinct pair, the same in every round."""
        used = np.unique(pairs)
        at = np.searchsorted(self.rules, used)
        known = np.append(self.rules, -1)[at] == used
        at, new = at[~known], used[~known]
        self.rules = np.insert(self.rules, at, new)
        self.symbols = np.insert(self.symbols, at, self.next + np.arange(len(new)))
        self.next += len(new)
        return self.symbols[np.searchsorted(self.rules, pairs)]


def _candidates(keys: np.ndarray, spots: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(node, spot) for the sorted ``keys`` from ``lo`` to ``hi`` of each node, some at a time."""
    first, last = np.searchsorted(keys, lo), np.searchsorted(keys, hi)
    n = np.maximum(last - first, 0)
    until = np.cumsum(n)
    begin = 0
    while begin < len(n):
        done = until[begin - 1] if begin else 0
        stop = max(begin + 1, int(np.searchsorted(until, done + BATCH, "right")))
        part = n[begin:stop]
        node = np.repeat(np.arange(begin, stop), part)
        yield node, spots[first[node] + np.arange(len(node)) - np.repeat(until[begin:stop] - part - done, part)]
        begin = stop


def crossing_runs(nodes: np.ndarray, names: list[np.ndarray]) -> np.ndarray:
    """(node, start, end, period) of stretches across the middle of each node, as far as the node reaches."""
    if len(names) <= ANCHOR_LEVEL or not len(nodes):
        return np.zeros((0, 4), np.int64)
    grams, width = names[ANCHOR_LEVEL], 1 << ANCHOR_LEVEL
    n = np.int64(len(grams) + 1)
    spots = np.flatnonzero(grams >= 0)
    keys = grams[spots] * n + spots
    order = np.argsort(keys)
    keys, spots = keys[order], spots[order]
    left, middle, right = nodes[:, 1], nodes[:, 2], nodes[:, 3]
    reach = (right - left) // MIN_PERIODS  # no longer period fits
    out = []

    def extend(node: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        q = b - a
        before = _behind(names, a, b, a - left[node])
        after = _ahead(names, a, b, right[node] - b)
        length = before + after + q
        good = length >= np.maximum(MIN_LENGTH, MIN_PERIODS * q)
        out.append(np.stack([node, a - before, b + after, q], 1)[good])

    # The right side is the heavier: the words at the middle stand again one period on.
    here = np.flatnonzero((grams[middle] >= 0) & (right - left >= MIN_LENGTH))
    base = grams[middle[here]] * n
    for k, b in _candidates(keys, spots, base + middle[here] + 1, base + np.minimum(middle[here] + reach[here] + 1, right[here])):
        extend(here[k], middle[here[k]], b)
    # The left side is the heavier: the words before the middle stand one period earlier.
    here = np.flatnonzero((middle - left >= width) & (right - left >= MIN_LENGTH))
    here = here[grams[middle[here] - width] >= 0]
    base = grams[middle[here] - width] * n
    for k, a in _candidates(keys, spots, base + np.maximum(middle[here] - width - reach[here], left[here]), base + middle[here] - width):
        extend(here[k], a + width, middle[here[k]])
    return np.concatenate(out) if out else np.zeros((0, 4), np.int64)


def block_runs(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(document, start, length, period) of all runs, in order; ``at`` says where documents begin in ``ids``."""
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    trees = Trees(ids, doc)
    if not trees.nodes:
        return np.zeros((0, 4), np.int64)
    nodes = np.concatenate(trees.nodes)
    nodes = nodes[nodes[:, 3] - nodes[:, 1] >= MIN_LENGTH]
    nodes = nodes[np.argsort(nodes[:, 0], kind="stable")]
    symbol, first, places = np.unique(nodes[:, 0], return_index=True, return_counts=True)
    names = window_names(ids, doc, at[1:][doc])
    found = crossing_runs(nodes[first], names)
    # To all places of the symbol.
    many = places[found[:, 0]]
    hit = np.repeat(np.arange(len(found)), many)
    node = first[found[hit, 0]] + np.arange(len(hit)) - np.repeat(np.cumsum(many) - many, many)
    shift = nodes[node, 1] - nodes[first[found[hit, 0]], 1]
    start, end, q = found[hit, 1] + shift, found[hit, 2] + shift, found[hit, 3]
    d = doc[start]
    more = lambda x, y, inside: inside & (ids[np.where(inside, x, 0)] == ids[np.where(inside, y, 0)])
    whole = ~more(start - 1, start - 1 + q, start > at[d]) & ~more(end, end - q, end < at[d + 1])
    rows = np.stack([d, start, end, q], 1)[whole]
    # The smallest period of each interval.
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1]))]
    rows = rows[np.append(True, (np.diff(rows[:, 1:3], axis=0) != 0).any(1))] if len(rows) else rows
    rows = np.stack([rows[:, 0], rows[:, 1] - at[rows[:, 0]], rows[:, 2] - rows[:, 1], rows[:, 3]], 1)
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


RUNS = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def periodic_runs(docs: DataFrame, rewrite: Callable[[int | None, list[str]], list[str]] | None = None) -> DataFrame:
    """``(doc_id, n_words, runs, collapsed)``: runs by start and period, and the words outside repetitions.

    ``collapsed`` keeps of every run its first period.  ``rewrite`` may change the words
    of a document before the search.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, _, _ in blocks(batch.column("text")):
                keys = batch.column("doc_id").slice(lo, hi - lo)
                words = [WORD.findall(t) for t in batch.column("text").slice(lo, hi - lo).fill_null("").to_pylist()]
                if rewrite:
                    words = [rewrite(k, w) for k, w in zip(keys.to_pylist(), words)]
                size = np.fromiter(map(len, words), np.int64, len(words))
                at = np.append(0, np.cumsum(size))
                ids = pa.array(list(itertools.chain.from_iterable(words)), pa.large_string()).dictionary_encode().indices.to_numpy().astype(np.int64)
                found = block_runs(ids, at)
                cuts = np.searchsorted(found[:, 0], np.arange(len(words) + 1))
                kept = []
                for d, w in enumerate(words):
                    if cuts[d] < cuts[d + 1]:
                        mine = found[cuts[d] : cuts[d + 1]]
                        edge = np.zeros(len(w) + 1, np.int64)
                        np.add.at(edge, mine[:, 1] + mine[:, 3], 1)
                        np.add.at(edge, mine[:, 1] + mine[:, 2], -1)
                        w = list(itertools.compress(w, (np.cumsum(edge[:-1]) == 0).tolist()))
                    kept.append(" ".join(w))
                runs = pa.StructArray.from_arrays([pa.array(found[:, i]) for i in (1, 2, 3)], names=["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [keys, pa.array(size), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), runs), pa.array(kept, pa.string())],
                    names=["doc_id", "n_words", "runs", "collapsed"],
                )

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, RUNS)


def run_digests(found: DataFrame) -> DataFrame:
    """Counts, the run of the greatest exponent, and digests of the rows of ``periodic_runs``."""
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    # Runs come by start and period, so the first of the greatest exponent stays.
    top = F.aggregate("runs", none, lambda a, x: F.when(a.isNull() | (x["length"] * a["period"] > a["length"] * x["period"]), x).otherwise(a))
    lines = F.transform("runs", lambda x: F.concat(F.concat_ws(",", x["start"], x["length"], x["period"]), F.lit("\n")))
    best = F.col("top")
    return found.withColumn("top", top).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.floor((1000 * best["length"]).cast("long") / best["period"]).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
