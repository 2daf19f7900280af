"""SimHash near-duplicates by anchor-point covering.

Two fingerprints of 64 bits that differ in at most four bits differ in at most two
bits of one of their halves.  The anchors of a half are the words of a perfect
Hamming code on 31 of its bits, times the free 32nd bit: every half lies within the
covering radius of one bit of an anchor.  Of two halves at distance t, the point
midway is at most t/2 from both, so an anchor within the covering radius of that
point is within radius + t/2 of both: each fingerprint is copied to every anchor
that near (17 per half), and fingerprints are compared per anchor only.

Results: a text without words, empty or null has fingerprint zero; a null ``doc_id``
counts as the largest id and comes back null; repeated rows are repeated in the
result; other columns of the input are ignored; empty tables give no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from chromatile.llm.text import NO_ID, buffers, narrow, public_id
from chromatile.operators.regions import components
from chromatile.session import materialize

SHINGLE, MAX_BITS, SEED = 4, 4, 42
CODE_BITS = 31
#: Fingerprints at one anchor compared directly; beyond, the other half is anchored too.
MAX_GROUP = 4096
#: Groups up to this size report each of their links, larger ones a spanning set.
SMALL_GROUP = 24


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Majority bits of the XXH64 of each word shingle; A-Z lower-cased, zero without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    k = min(shingle, len(words))
    starts = (ends - sizes)[: len(words) - k + 1]
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[k - 1 :].tolist())], "<u8"))


def majority(h: np.ndarray) -> int:
    """The bits that over half of the hashes have; zero without hashes."""
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(h), 1 << 16):
        part = h[lo : lo + (1 << 16)].astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, fp)`` of every text; ``fp`` is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = buffers(batch.column("text"))
            data = memoryview(raw)
            fps = [fingerprint(bytes(data[a:b]), shingle) for a, b in itertools.pairwise(at.tolist())]
            fp = pa.array(np.array(fps, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), fp], names=["doc_id", "fp"])

    return narrow(docs).mapInArrow(run, "doc_id long, fp long")


def _cover(radius: int) -> np.ndarray:
    """Per syndrome, the changes that lead to every anchor within ``radius`` bits, as masks."""
    found: list[list[int]] = [[] for _ in range(CODE_BITS + 1)]
    for weight in range(radius + 1):
        for bits in itertools.combinations(range(1, CODE_BITS + 1), weight):
            syndrome = mask = 0
            for b in bits:
                syndrome ^= b
                mask |= 1 << (b - 1)
            found[syndrome] += [mask | free << CODE_BITS for free in (0, 1) if weight + free <= radius]
    width = max(map(len, found))
    return np.array([masks + [-1] * (width - len(masks)) for masks in found], np.int64)


def anchors(half: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the half, anchor) for every anchor within ``radius`` of each 32-bit half."""
    syndrome = np.zeros(len(half), np.int64)
    for k in range(5):
        members = sum(1 << (b - 1) for b in range(1, CODE_BITS + 1) if b >> k & 1)
        syndrome |= (np.bitwise_count(half & np.uint64(members)).astype(np.int64) & 1) << k
    masks = _cover(radius)[syndrome]
    row, col = np.nonzero(masks >= 0)
    return row, half[row].view(np.int64) ^ masks[row, col]


def _replicate(fps: DataFrame, first: int, both: int | None = None) -> DataFrame:
    """``(anchor, fp)``; with ``both``, input rows carry an anchor and get one of the other half as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 4096):
                batch = whole.slice(lo, 4096)
                fp = np.array(batch.column("fp")).view(np.uint64)
                for side in (0, 1):
                    if both is None:
                        row, to = anchors(fp >> np.uint64(32 * side) & np.uint64(0xFFFFFFFF), first)
                        keys = [to | side << 32, np.zeros(len(to), np.int64)]
                    else:
                        at = np.array(batch.column("anchor"))
                        mine = np.flatnonzero(at >> 32 == side)
                        row, to = anchors(fp[mine] >> np.uint64(32 * (1 - side)) & np.uint64(0xFFFFFFFF), both)
                        row = mine[row]
                        keys = [at[row], to + 1]
                    yield pa.RecordBatch.from_arrays([pa.array(k) for k in (*keys, fp[row].view(np.int64))], names=["anchor", "second", "fp"])

    return fps.mapInArrow(run, "anchor long, second long, fp long")


def _spanning(fp: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links that keep every two linked members connected: each member is reached once."""
    left, out = fp, []
    while len(left):
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            at = frontier.pop()
            near = np.bitwise_count(left ^ at) <= bits
            if near.any():
                out += [(int(at), int(x)) for x in left[near]]
                frontier += list(left[near])
                left = left[~near]
    return out


def _compare(rows: DataFrame, bits: int) -> DataFrame:
    """Links within each ``(anchor, second)``; rows of a key meet in one task, sorted."""

    def group_links(fp: np.ndarray) -> list[tuple[int, int]]:
        if len(fp) > SMALL_GROUP:
            return _spanning(fp, bits)
        a, b = np.nonzero(np.triu(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= bits, 1))
        return list(zip(fp[a].tolist(), fp[b].tolist()))

    def pack(links: list[tuple[int, int]]) -> pa.RecordBatch:
        ab = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(ab[:, 0].copy()), pa.array(ab[:, 1].copy())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep: list[np.ndarray] = [np.zeros((0, 3), np.int64)]
        for batch in batches:
            block = np.concatenate([*keep, np.stack([np.array(batch.column(c)) for c in ("anchor", "second", "fp")], 1)])
            if not len(block):
                continue
            cut = np.flatnonzero((block[1:, :2] != block[:-1, :2]).any(axis=1)) + 1
            ends = cut.tolist()
            links = []
            for a, b in itertools.pairwise([0, *ends]):
                if b - a > 1:
                    links += group_links(block[a:b, 2].view(np.uint64))
            keep = [block[ends[-1] if ends else 0 :]]
            yield pack(links)
        last = np.concatenate(keep)
        if len(last) > 1:
            yield pack(group_links(np.ascontiguousarray(last[:, 2]).view(np.uint64)))

    ordered = rows.repartition("anchor", "second").sortWithinPartitions("anchor", "second")
    return ordered.mapInArrow(run, "a long, b long")


def _crowded(rows: DataFrame) -> DataFrame:
    """Rows whose key has two members at least, with the count ``n``.

    The rows are copies, of which Spark knows neither number nor size: unhinted, they may pass the driver.
    """
    n = rows.groupBy("anchor", "second").agg(F.count("*").alias("n")).filter("n > 1")
    return rows.join(n.hint("merge"), ["anchor", "second"])


def links(fps: DataFrame, bits: int = MAX_BITS, max_group: int = MAX_GROUP) -> DataFrame:
    """``(a, b)``: enough pairs of distinct fingerprints within ``bits`` to connect all that are linked.

    At an anchor with more than ``max_group`` fingerprints the other half, which then
    differs in ``bits`` bits at most, is anchored too; a pair of anchors can hold only
    a fixed number of distinct fingerprints.
    """
    per_half = bits // 2
    near = materialize(_crowded(_replicate(fps.select("fp"), 1 + -(-per_half // 2))), "anchors")
    hot = near.filter(F.col("n") > max_group).select("anchor", "fp")
    found = _compare(near.filter(F.col("n") <= max_group).select("anchor", "second", "fp"), bits)
    if hot.limit(1).count():
        deep = _crowded(_replicate(hot, 0, 1 + -(-bits // 2))).select("anchor", "second", "fp")
        found = found.unionByName(_compare(deep, bits))
    return found.distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, bits: int = MAX_BITS) -> DataFrame:
    """``(doc_id, fp, component)`` per row: the smallest doc_id reachable over links.

    Equal fingerprints collapse to one class before anything is compared, so copies
    cost nothing, however many there are.
    """
    fps = materialize(fingerprints(docs, shingle), "fingerprints")
    classes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    edges = materialize(links(classes, bits), "links")
    ends = edges.select(F.col("a").alias("id")).union(edges.select(F.col("b").alias("id"))).distinct()
    roots = components(ends, edges, [])
    linked = roots.join(classes.hint("merge"), roots.id == classes.fp).select("root", "id", "first")
    lowest = linked.groupBy("root").agg(F.min("first").alias("component"))
    merged = linked.join(lowest, "root").select(F.col("id").alias("fp"), "component")
    table = classes.join(merged.hint("merge"), "fp", "left").select("fp", F.coalesce("component", "first").alias("component"))
    return fps.join(materialize(table, "components").hint("merge"), "fp").select("doc_id", "fp", "component")


def simhash_components(docs: DataFrame, shingle: int = SHINGLE, bits: int = MAX_BITS) -> DataFrame:
    """One row per document: doc_id, fingerprint (hex) and the id of its component."""
    return near_duplicates(docs, shingle, bits).select(
        public_id(), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), public_id("component").alias("component_id")
    )


def keep_first(docs: DataFrame, shingle: int = SHINGLE, bits: int = MAX_BITS) -> DataFrame:
    """The documents whose id is the smallest of their group; all rows of that id stay."""
    kept = near_duplicates(docs, shingle, bits).filter("doc_id = component").select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(kept, F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)) == kept["_kept"], "left_semi")
