"""Near copies by true Jaccard similarity of word shingles, the stage rule of the pipeline.

Equal shingle sets collapse to one class.  Classes meet twice, and whoever meets is
compared by whole sets.  First at the SimHash anchors of their fingerprints, which find
what differs in a few bits: most copies with small changes.  Two sets at 0.8 differ in
about ten of 64 bits, which no few anchors cover, so those that the anchors have not
brought into one group meet at keys as well.  Of every class the ``KEYS`` smallest shingle
hashes are keys, and classes meet at a key.  Of the first k shingles in the union of two
sets, in hash order, each is shared with a chance of the similarity, and a shared one is
a key of both: a pair at 0.8 shares fewer than ``SHARED`` of 16 keys with a chance of
about 2.5e-7, and sets whose prefix is shorter than ``KEYS`` share that many for certain.
No pair below the similarity is linked.

Results: texts without words are copies of each other; a null ``doc_id`` counts as the
largest id; all rows of a kept id stay; empty tables give no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from chromatile.llm import simhash
from chromatile.llm.text import NO_ID, blocks, narrow, unpacked
from chromatile.operators.regions import components
from chromatile.session import materialize

SHINGLE, FIFTHS, SEED = 5, 4, 42
KEYS, SHARED = 16, 4
#: Classes at one key up to which all their pairs are listed; larger groups report a spanning set.
SMALL_GROUP = 24
#: Beyond, the classes of a key meet at pairs of keys.
MAX_GROUP = 4096


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct XXH64 of the word shingles; A-Z lower-cased, fewer words are one shingle."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    k = min(shingle, len(words))
    starts = (ends - sizes)[: len(words) - k + 1]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[k - 1 :].tolist())], np.uint64))


def keys(shingle_set: np.ndarray) -> np.ndarray:
    """The smallest hashes; sets of fewer than ``SHARED`` have no near copy but their equals."""
    n = len(shingle_set)
    return shingle_set[: min(KEYS, n + (-n * FIFTHS // 5) + SHARED)] if n >= SHARED else shingle_set[:0]


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Jaccard similarity of 0.8 at least, in whole numbers."""
    if FIFTHS * max(len(a), len(b)) > 5 * min(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * both >= FIFTHS * (len(a) + len(b) - both)


def sketches(docs: DataFrame) -> DataFrame:
    """``(doc_id, cls, n, keys, fp, z)`` of every row; ``cls`` names the set, ``fp`` is its fingerprint, ``z`` the text, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            for lo, hi, raw, at in blocks(batch.column("text")):
                data = memoryview(np.ascontiguousarray(raw))
                texts = [bytes(data[a:b]) for a, b in itertools.pairwise(at.tolist())]
                sets = [shingles(t) for t in texts]
                cls = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
                chosen = pa.array([keys(s).view(np.int64) for s in sets], pa.list_(pa.int64()))
                sizes = pa.array([len(s) for s in sets], pa.int64())
                fps = pa.array(np.array([simhash.majority(s) for s in sets], np.uint64).view(np.int64))
                z = pa.array([pack(t) for t in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(cls), sizes, chosen, fps, z], names=["doc_id", "cls", "n", "keys", "fp", "z"])

    return narrow(docs).mapInArrow(run, "doc_id long, cls long, n long, keys array<long>, fp long, z binary")


def _sets(column: pa.Array) -> list[np.ndarray]:
    return [shingles(t) for t in unpacked(column).to_pylist()]


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    ab = np.array(found, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(ab[:, 0].copy()), pa.array(ab[:, 1].copy())], names=["a", "b"])


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs that are similar as whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                rows = zip(part.column("a").to_pylist(), part.column("b").to_pylist(), _sets(part.column("za")), _sets(part.column("zb")))
                yield _edges([(a, b) for a, b, x, y in rows if similar(x, y)])

    side = lambda c: texts.select(F.col("cls").alias(c), F.col("z").alias(f"z{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "za", "zb").mapInArrow(run, "a long, b long")


def spanning(cls: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that connect all similar members of one group: each member is reached once."""
    chosen = [keys(s) for s in sets]
    flat, owner = np.concatenate(chosen), np.repeat(np.arange(len(sets)), [len(c) for c in chosen])
    _, key = np.unique(flat, return_inverse=True)
    order = np.argsort(key, kind="stable")
    posting = np.split(owner[order], np.cumsum(np.bincount(key))[:-1])
    mine = np.split(key, np.cumsum([len(c) for c in chosen])[:-1])
    left, out = np.ones(len(sets), bool), []
    for root in range(len(sets)):
        if not left[root]:
            continue
        left[root] = False
        frontier = [root]
        while frontier:
            at = frontier.pop()
            met = np.bincount(np.concatenate([posting[k] for k in mine[at]]), minlength=len(sets))
            for other in np.flatnonzero((met >= SHARED) & left).tolist():
                if similar(sets[at], sets[other]):
                    left[other] = False
                    out.append((cls[at], cls[other]))
                    frontier.append(other)
    return out


def _compare(rows: DataFrame) -> DataFrame:
    """Links within each ``(key, second)``; rows of a key meet in one task, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, cls, sets = None, [], []
        for batch in batches:
            heads = zip(batch.column("key").to_pylist(), batch.column("second").to_pylist())
            for head, c, z in zip(heads, batch.column("cls").to_pylist(), batch.column("z")):
                if head != at:
                    if len(cls) > 1:
                        yield _edges(spanning(cls, sets))
                    at, cls, sets = head, [], []
                cls.append(c)
                sets.append(shingles(zstandard.decompress(z.as_py())))
        if len(cls) > 1:
            yield _edges(spanning(cls, sets))

    ordered = rows.select("key", "second", "cls", "z").repartition("key", "second").sortWithinPartitions("key", "second", "cls")
    return ordered.mapInArrow(run, "a long, b long")


def _texts(sketch: DataFrame, asked: DataFrame) -> DataFrame:
    """A text of each asked class."""
    return materialize(sketch.select("cls", "z").join(asked.distinct().hint("merge"), "cls", "left_semi").groupBy("cls").agg(F.first("z").alias("z")), "texts")


def _ends(pairs: DataFrame, name: str = "cls") -> DataFrame:
    return pairs.select(F.col("a").alias(name)).union(pairs.select(F.col("b").alias(name)))


def anchored(sketch: DataFrame) -> DataFrame:
    """``(a, b)``: similar classes with equal fingerprints, or with such as meet at an anchor."""
    classes = materialize(sketch.groupBy("cls").agg(F.first("n").alias("n"), F.first("fp").alias("fp")).filter(F.col("n") >= SHARED).drop("n"), "prints")
    first = materialize(classes.groupBy("fp").agg(F.min("cls").alias("head")), "heads")
    equal = classes.join(first.hint("merge"), "fp").filter("cls <> head").select(F.col("head").alias("a"), F.col("cls").alias("b"))
    near = materialize(simhash.links(first), "near")
    side = lambda c: first.select(F.col("fp").alias(c), F.col("head").alias(f"h{c}"))
    met = near.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b").select(F.col("ha").alias("a"), F.col("hb").alias("b"))
    pairs = materialize(equal.union(met), "anchored")
    return materialize(_verified(pairs, _texts(sketch, _ends(pairs))), "verified")


def _crowded(rows: DataFrame) -> DataFrame:
    """Rows whose key has members of two groups at least, with their count ``members``.

    The rows are exploded, which Spark sizes by the table before: unhinted, they may pass the driver.
    """
    count = rows.groupBy("key", "second").agg(F.count("*").alias("members"), F.min("grp").alias("_lo"), F.max("grp").alias("_hi"))
    count = count.filter("_lo < _hi").drop("_lo", "_hi")
    return rows.join(count.hint("merge"), ["key", "second"])


def links(sketch: DataFrame, small_group: int = SMALL_GROUP, max_group: int = MAX_GROUP) -> DataFrame:
    """``(a, b)``: enough pairs of classes that are similar to connect all that are linked."""
    known = anchored(sketch)
    grouped = components(_ends(known, "id").distinct(), known, []).select(F.col("id").alias("cls"), F.col("root").alias("grp"))
    classes = sketch.groupBy("cls").agg(F.first("n").alias("n"), F.first("keys").alias("keys")).join(grouped.hint("merge"), "cls", "left")
    classes = materialize(classes.withColumn("grp", F.coalesce("grp", "cls")), "classes")
    met = materialize(_crowded(classes.select(F.explode("keys").alias("key"), F.lit(0).cast("long").alias("second"), "cls", "n", "grp")), "met")
    few = met.filter(F.col("members") <= small_group).select("key", "cls", "n", "grp")
    left, right = (few.select("key", F.col("cls").alias(c), F.col("n").alias(f"n{c}"), F.col("grp").alias(f"g{c}")) for c in "ab")
    close = (F.col("a") < F.col("b")) & (F.col("ga") != F.col("gb")) & (5 * F.least("na", "nb") >= FIFTHS * F.greatest("na", "nb"))
    pairs = materialize(left.join(right.hint("merge"), "key").filter(close).select("a", "b").distinct(), "pairs")
    many = met.filter((F.col("members") > small_group) & (F.col("members") <= max_group)).select("key", "second", "cls")
    hot = met.filter(F.col("members") > max_group).select("key", "cls", "grp")
    if hot.limit(1).count():
        deep = hot.join(classes.select("cls", F.explode("keys").alias("second")).hint("merge"), "cls").filter("key <> second")
        deep = deep.select(F.least("key", "second").alias("key"), F.greatest("key", "second").alias("second"), "cls", "grp").distinct()
        many = many.unionByName(_crowded(deep).select("key", "second", "cls"))
    many = materialize(many, "many")
    texts = _texts(sketch, _ends(pairs).union(many.select("cls")))
    return known.union(_verified(pairs, texts)).union(_compare(many.join(texts.hint("merge"), "cls"))).distinct()


def keep_first(docs: DataFrame) -> DataFrame:
    """The documents whose id is the smallest of their group; all rows of that id stay."""
    sketch = materialize(sketches(docs), "sketches")
    edges = materialize(links(sketch), "links")
    ends = edges.select(F.col("a").alias("id")).union(edges.select(F.col("b").alias("id"))).distinct()
    roots = components(ends, edges, [])
    first = sketch.groupBy("cls").agg(F.min("doc_id").alias("first"))
    groups = first.join(roots.hint("merge"), first.cls == roots.id, "left").groupBy(F.coalesce("root", "cls").alias("root"), F.col("root").isNull().alias("alone"))
    kept = groups.agg(F.min("first").alias("_kept")).select("_kept").distinct()
    return docs.join(kept, F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)) == kept["_kept"], "left_semi")
