"""Exact substring de-duplication by level-wise doubling.

Windows are hashed at one length; those found in one document only are dropped, and
the others alone are extended to twice the length, until the wanted length is reached
or no candidate survives.  The first level reads only the windows that are the
smallest by hash in some window of the wanted length (its minimizers): two equal
windows share theirs, so nothing is lost and about a quarter of the positions is
shuffled.  Each batch of windows asks about a window once, for the smallest document
that holds it there; the batch's other holders already know their answer, and it
travels packed, a row per document.  No key has more rows than there are batches.
The last level compares 95 bits of hash.

Results: null and empty texts have no words; texts under the window length lose
nothing; rows of one doc_id are one document and never remove each other's words; a
null doc_id counts as the largest and comes back null; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from chromatile.llm.text import ODD_A, ODD_B, Rolling, blocks, long_hash, mixed, narrow, packed, public_id, unpacked, word_spans
from chromatile.session import materialize

WINDOW = 13
#: Windows compared within a task before they are asked about.
BATCH_WINDOWS = 1_000_000
#: Levels before the last only filter, so 48 bits of their hashes do.
FILTER_BITS = np.uint64(2**48 - 1)


def lengths(window: int) -> list[int]:
    """Window lengths of the levels: halves of the wanted length, down to six words at least."""
    out = [window]
    while -(-out[0] // 2) >= 6:
        out.insert(0, -(-out[0] // 2))
    return out


class _Hasher:
    """Window hashes of a block of texts: 64 bits, and from the other half 31 more."""

    def __init__(self):
        self.last = [None, None]
        self.words = [Rolling(ODD_A), Rolling(ODD_B)]
        self.runs = [Rolling(ODD_B * 3), Rolling(ODD_A * 5)]

    def __call__(self, raw, spans, length: int, half: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash at each word (garbage where no whole window starts) and whether one starts there."""
        starts, ends, first = spans
        w = self.last[half] = self.words[half](raw, starts, ends)
        n = len(w)
        doc_end = np.repeat(first[1:], np.diff(first))
        whole = np.arange(n) + length <= doc_end
        at = np.arange(max(0, n - length + 1))
        h = np.zeros(n, np.uint64)
        h[: len(at)] = self.runs[half](w, at, at + length)
        return h, whole

    def texts(self, spans, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash pairs, the second negative, of the texts of at least ``least`` words of the last call, and which they are."""
        first = spans[2]
        d = np.flatnonzero(np.diff(first) >= least)
        h = self.runs[0](self.last[0], first[d], first[d + 1])
        return h, (-2 - (mixed(h + np.uint64(1) + self.check(first[d], first[d + 1])) >> np.uint64(34)).astype(np.int64)).astype(np.int32), d

    def copies(self, spans, least: int, known: pa.Array) -> np.ndarray:
        """Which texts of the last call have a hash that ``known`` lists for them."""
        out = np.zeros(len(known), bool)
        if any(x.is_valid and len(x.values) for x in known):
            for h, _, d in zip(*self.texts(spans, least)):
                out[d] = known[d].is_valid and bool((np.array(known[d].values) == h.view(np.int64)).any())
        return out

    def check(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """An independent hash of whole runs of words."""
        return self.runs[1](self.last[0], starts, ends)


def _minimizers(h: np.ndarray, whole: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts with ``width`` windows in one text, and the place of the leftmost smallest of them."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low, at = h[:n].copy(), np.zeros(n, np.int8)
    for j in range(1, width):
        better = h[j : n + j] < low
        np.copyto(low, h[j : n + j], where=better)
        at[better] = j
    start = np.flatnonzero(whole[:n] & whole[width - 1 :])
    return start, start + at[start]


def _marked(h: np.ndarray, whole: np.ndarray, first: np.ndarray, marks: pa.Array) -> np.ndarray:
    """Mask of the windows whose hash is among the marks of their text."""
    hit = np.zeros(len(h), bool)
    for d in range(len(first) - 1):
        if marks[d].is_valid:
            own = slice(first[d], first[d + 1])
            hit[own] = np.isin(h[own].view(np.int64), np.array(marks[d].values))
    return hit & whole


def _questions(parts: list[tuple[np.ndarray, ...]], final: bool) -> pa.RecordBatch:
    """Ask about each window once, for its smallest document; its other holders get their answers packed in one row.

    Keys with a negative second part stand for whole texts: only a larger document is answered.
    """
    h, second, doc = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(doc, kind="stable")
    order = order[np.lexsort((second[order], h[order]))]
    h, second, doc = h[order], second[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (second[1:] != second[:-1])
    once = np.ones(len(h), bool)  # a document counts once per window
    once[1:] = new[1:] | (doc[1:] != doc[:-1])
    h, second, doc, new = h[once], second[once], doc[once], new[once]
    known = ~new
    if not final:  # every holder of a window that two documents have is answered
        shared = np.append(new[1:], True)
        known = known | (new & ~shared & (second >= 0))
    mine = np.flatnonzero(known)
    mine = mine[np.argsort(doc[mine], kind="stable")]
    docs, begin = np.unique(doc[mine], return_index=True)
    ask = np.flatnonzero(new)
    offsets = np.concatenate([np.zeros(len(ask), np.int64), begin, [len(mine)]]).astype(np.int32)
    empty = np.arange(len(ask) + len(docs) + 1) < len(ask)

    def answers(values: np.ndarray) -> pa.Array:
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
        return pa.array([None] * 0, lists.type) if not len(lists) else pc.if_else(pa.array(empty[:-1]), pa.scalar(None, lists.type), lists)

    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([long_hash(h[ask]), long_hash(mixed(docs.view(np.uint64)))])),
            pa.array(np.concatenate([second[ask], np.full(len(docs), -1, np.int32)])),
            pa.array(np.concatenate([doc[ask], docs])),
            answers(long_hash(h[mine])),
            answers(second[mine]),
        ],
        names=["k1", "k2", "doc_id", "p1", "p2"],
    )


def _level(docs: DataFrame, length: int, before: int, step: int, final: bool, window: int) -> DataFrame:
    """Questions ``(k1, k2, doc_id)`` and packed answers ``(doc_id, p1, p2)`` for the candidates of one level.

    The first level (``before`` 0) takes the minimizers of windows of ``step`` more
    words, and asks whether a whole text is a copy; the second the windows whose minimizer is marked; later ones those that
    begin and end with a marked window.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _Hasher()
        parts, held = [], 0
        for batch in batches:
            ids = np.array(batch.column("doc_id"))
            for lo, hi, raw, at in blocks(unpacked(batch.column("z")) if before else batch.column("text")):
                spans = word_spans(raw, at)
                first = spans[2]
                h, whole = hasher(raw, spans, length, 0)
                if not final:
                    h &= FILTER_BITS
                if before:
                    old, old_whole = hasher(raw, spans, before, 0)
                    old &= FILTER_BITS
                    hit = _marked(old, old_whole, first, batch.column("m1").slice(lo, hi - lo))
                    if step:
                        start, low = _minimizers(old, old_whole, step + 1)
                        pos = start[hit[low]]
                    else:
                        pos = np.flatnonzero(whole)
                        pos = pos[hit[pos] & hit[pos + length - before]]
                    copies = hasher.copies(spans, window, batch.column("copy").slice(lo, hi - lo))
                    pos = pos[~copies[np.searchsorted(first, pos, "right") - 1]]
                else:
                    mark = np.zeros(len(h), bool)
                    mark[_minimizers(h, whole, step + 1)[1]] = True
                    pos = np.flatnonzero(mark)
                    if step:
                        a, b, d = hasher.texts(spans, window)
                        parts.append((a, b, ids[lo + d]))
                doc = ids[lo + np.searchsorted(first, pos, "right") - 1]
                second = np.zeros(len(pos), np.int32)
                if final:
                    second = (hasher(raw, spans, length, 1)[0][pos] >> np.uint64(33)).astype(np.int32)
                parts.append((h[pos], second, doc))
                held += len(pos)
                if held >= BATCH_WINDOWS:
                    yield _questions(parts, final)
                    parts, held = [], 0
        if held:
            yield _questions(parts, final)

    return docs.mapInArrow(run, "k1 long, k2 int, doc_id long, p1 array<long>, p2 array<int>")


def _repeated(rows: DataFrame, final: bool) -> DataFrame:
    """``(_id, m1, m2)``: windows that another document holds; at the last level, one with a smaller id.

    Before the last level ``copy`` has the hashes of whole texts that a smaller document has.
    """
    group = Window.partitionBy("k1", "k2")
    low = F.min("doc_id").over(group)
    smaller = F.col("doc_id") > low
    other = smaller if final else smaller | ((F.col("k2") >= 0) & (F.max("doc_id").over(group) > low))
    hit = rows.withColumn("_hit", F.col("p1").isNotNull() | other).filter("_hit")
    flat = lambda p, k: F.flatten(F.collect_list(F.coalesce(p, F.array(k))))
    out = hit.groupBy(F.col("doc_id").alias("_id")).agg(flat("p1", "k1").alias("m1"), flat("p2", "k2").alias("m2"))
    if final:
        return out
    pairs = F.arrays_zip("m1", "m2")
    copy = F.transform(F.filter(pairs, lambda x: x["m2"] < 0), lambda x: x["m1"])
    windows = F.transform(F.filter(pairs, lambda x: x["m2"] >= 0), lambda x: x["m1"])
    return out.select("_id", windows.alias("m1"), copy.alias("copy"))


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(_id, m1, m2, copy)``: per document the windows, as hash pairs, that start in a smaller document too.

    ``copy`` has the hashes of its whole texts that a smaller document has as well;
    such a document asks about no window of its own.
    """
    levels = lengths(window)
    marks, copies = None, None
    for n, (before, length) in enumerate(zip([0, *levels], levels)):
        source = narrow(docs)
        if marks is not None:
            source = packed(docs).join(marks.filter(F.size("m1") > 0), F.col("doc_id") == F.col("_id")).select("doc_id", "z", "m1", "copy")
        step = levels[1] - levels[0] if n < 2 and len(levels) > 1 else 0
        final = length == window
        marks = materialize(_repeated(_level(source, length, before, step, final, window), final), "windows")
        if n == 0 and not final:
            copies = marks.filter(F.size("copy") > 0).select("_id", "copy")
    if copies is None:
        return marks.withColumn("copy", F.lit(None).cast("array<long>"))
    both = marks.join(copies.withColumnRenamed("_id", "_copied"), F.col("_id") == F.col("_copied"), "full_outer")
    return both.select(F.coalesce("_id", "_copied").alias("_id"), "m1", "m2", "copy")


def _strip(rows: DataFrame, window: int, with_text: bool) -> DataFrame:
    """Apply the marks: words covered by a marked window go."""
    schema = "doc_id long, n_words long, n_removed long, " + ("text string" if with_text else "kept_sha256 string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _Hasher()
        for batch in batches:
            m1, m2, copy = (batch.column(c) for c in ("m1", "m2", "copy"))
            n_words, n_removed, kept = [], [], []
            for lo, hi, raw, at in blocks(unpacked(batch.column("z"))):
                spans = word_spans(raw, at)
                starts, ends, first = spans
                gone = np.zeros(len(starts), bool)
                marked = [d for d in range(hi - lo) if m1[lo + d].is_valid]
                if marked:
                    h = [hasher(raw, spans, window, half) for half in (0, 1)]
                    whole = h[0][1]
                    for d in marked:
                        own = slice(first[d], first[d + 1])
                        want = np.stack([np.array(m1[lo + d].values), np.array(m2[lo + d].values, np.int64)], 1)
                        want = np.unique(want, axis=0)
                        a, b = h[0][0][own].view(np.int64), (h[1][0][own] >> np.uint64(33)).astype(np.int64)
                        left, right = np.searchsorted(want[:, 0], a, "left"), np.searchsorted(want[:, 0], a, "right")
                        hit = (right > left) & whole[own]
                        single = hit & (right == left + 1)
                        hit[single] &= want[left[single], 1] == b[single]
                        for i in np.flatnonzero(hit & ~single):
                            hit[i] = b[i] in want[left[i] : right[i], 1]
                        edge = np.zeros(len(a) + window, np.int64)
                        edge[np.flatnonzero(hit)] += 1
                        edge[np.flatnonzero(hit) + window] -= 1
                        gone[own] = np.cumsum(edge)[: len(a)] > 0
                if any(copy[lo + d].is_valid for d in range(hi - lo)):
                    hasher(raw, spans, window, 0)
                    gone |= np.repeat(hasher.copies(spans, window, copy.slice(lo, hi - lo)), np.diff(first))
                data = raw.tobytes()
                for d in range(hi - lo):
                    a, b = int(first[d]), int(first[d + 1])
                    stay = np.flatnonzero(~gone[a:b]) + a
                    if len(stay) == b - a:
                        words = data[at[d] : at[d + 1]].split()
                    else:
                        words = [data[x:y] for x, y in zip(starts[stay].tolist(), ends[stay].tolist())]
                    n_words.append(b - a)
                    n_removed.append(b - a - len(stay))
                    text = b" ".join(words)
                    kept.append(text.decode("utf-8", "replace") if with_text else hashlib.sha256(text).hexdigest())
            names = ["doc_id", "n_words", "n_removed", "text" if with_text else "kept_sha256"]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=names
            )

    return rows.mapInArrow(run, schema)


def substring_dedup(docs: DataFrame, window: int = WINDOW, with_text: bool = True) -> DataFrame:
    """Every text without the words of windows that start in a smaller document too.

    Returns doc_id, n_words, n_removed and the kept words joined by a space, as
    ``text`` or as ``kept_sha256``.
    """
    marks = repeated_windows(docs, window)
    rows = packed(docs).join(marks, F.col("doc_id") == F.col("_id"), "left").select("doc_id", "z", "m1", "m2", "copy")
    out = _strip(rows, window, with_text)
    return out.select(public_id(), *[c for c in out.columns if c != "doc_id"])
