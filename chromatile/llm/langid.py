"""Language identification by prediction by partial matching.

Per language, a tree of byte contexts of up to three bytes counts the bytes that
follow.  The probability of a byte is its share in the longest context seen; a byte
new to it escapes to the next shorter one (method C with full exclusion), and at last
to a uniform choice.  The trees are frozen after training: every context and byte has
a fixed code length, and a text gets the language whose model codes its bytes shortest.

Training reads a bounded sample: about ``sample_docs`` labelled documents per language
and ``sample_bytes`` of each at most, chosen by a hash of their id.  Scoring reads
every byte of every text.

Results: null texts and texts without a letter are ``und`` with score 0; without any
training text all are; equal code lengths go to the language first by code point;
repeated rows are scored alike; other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from chromatile.llm.text import blocks
from chromatile.session import materialize

ORDER = 3
SAMPLE_DOCS, SAMPLE_BYTES = 1500, 100_000
UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    """One document in five, by the CRC of its id as text."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(labelled: DataFrame, order: int = ORDER, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """Counts ``(lang, depth, context, symbol, n)`` of the sample; a context packs its bytes, the last one lowest."""
    rows = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.filter("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    chance = F.lit(0.0)
    for lang, n in sizes.items():
        chance = F.when(F.col("lang") == lang, min(1.0, sample_docs / n)).otherwise(chance)
    draw = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.lit("ppm")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.filter(draw < chance).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple[str, int], list[np.ndarray]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                data = np.frombuffer(text.encode()[:sample_bytes], np.uint8).astype(np.int64)
                for depth in range(min(order, len(data) - 1) + 1 if len(data) else 0):
                    code = np.zeros(len(data) - depth, np.int64)
                    for j in range(depth + 1):
                        code = code << 8 | data[j : len(data) - depth + j]
                    found.setdefault((lang, depth), []).append(code)
            for (lang, depth), codes in found.items():
                code, n = np.unique(np.concatenate(codes), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(code), pa.string()), pa.array(np.full(len(code), depth, np.int32)), pa.array(code), pa.array(n.astype(np.int64))],
                    names=["lang", "depth", "code", "n"],
                )

    counts = sample.mapInArrow(run, "lang string, depth int, code long, n long").groupBy("lang", "depth", "code").agg(F.sum("n").alias("n"))
    return materialize(counts, "ppm")


class Model:
    """Frozen code lengths: a tree of contexts shared by all languages, and bits per context, symbol and language."""

    def __init__(self, langs: list[str], counts: dict[str, np.ndarray], order: int):
        self.langs, self.order = langs, order
        lang, depth, code, n = (counts[k] for k in ("lang", "depth", "code", "n"))
        seen = np.unique(code & 0xFF)
        self.size = len(seen) + 2  # learned bytes, any other byte, and the start of a text
        self.other, start = len(seen), len(seen) + 1
        self.symbol = np.full(256, self.other, np.int32)
        self.symbol[seen] = np.arange(len(seen))
        self.start = start
        others = 256 - len(seen)
        where = {(0, 0): 0}
        for k in range(1, order + 1):
            for context in np.unique(code[depth == k] >> 8).tolist():
                where[k, context] = len(where)
        shorter = {k: [where[k - 1, c & ((1 << 8 * (k - 1)) - 1)] for d, c in where if d == k] for k in range(1, order + 1)}
        nodes = self.nodes = len(where)
        # a context that is not in the tree stops the walk: node + nodes keeps its place from then on
        stay = np.arange(nodes, dtype=np.int32) + nodes
        self.child = np.concatenate([stay, stay]).repeat(self.size)
        for (k, context), node in where.items():
            if k:
                self.child[where[k - 1, context & ((1 << 8 * (k - 1)) - 1)] * self.size + self.symbol[context >> 8 * (k - 1)]] = node
        begin = np.searchsorted([k for k, _ in where], np.arange(order + 2))
        self.bits = np.zeros((nodes * self.size, len(langs)), np.float32)
        for l in range(len(langs)):
            p = np.zeros((nodes, self.size))
            for k in range(order + 1):
                lo, hi = begin[k], begin[k + 1]
                mine = (lang == l) & (depth == k)
                c = np.zeros((hi - lo, self.size))
                c[[where[k, x] - lo for x in (code[mine] >> 8).tolist()], self.symbol[code[mine] & 0xFF]] = n[mine]
                below = p[shorter[k]] if k else np.full((1, self.size), 1.0 / 256)
                if not k:
                    below[:, start] = 0.0
                new = c == 0
                unseen = (below * new).sum(1, keepdims=True) + (others - 1) * below[:, [self.other]]
                total, kinds = c.sum(1, keepdims=True), self.size - new.sum(1, keepdims=True)
                escape = np.where(total > 0, kinds / np.maximum(total + kinds, 1), 1.0)
                escape[unseen <= 0] = 0.0
                c *= (1 - escape) / np.maximum(total, 1)
                below *= escape / np.maximum(unseen, 1e-300)
                np.copyto(c, below, where=new)
                p[lo:hi] = c
            self.bits[:, l] = -np.log2(np.maximum(p, 1e-300)).ravel()

    def lengths(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Code length in bits of each text under each language."""
        symbols = self.symbol[raw]
        node = np.zeros(len(raw), np.int32)
        for k in range(1, self.order + 1):
            back = np.full(len(raw), self.start, np.int32)
            back[k:] = symbols[: len(raw) - k]
            for j in range(k):  # bytes of the text before do not count
                edge = at[:-1] + j
                back[edge[edge < at[1:]]] = self.start
            node = self.child[node * self.size + back]
        node = np.where(node >= self.nodes, node - self.nodes, node)
        cost = np.take(self.bits, node * self.size + symbols, axis=0)
        out = np.zeros((len(at) - 1, len(self.langs)))
        full = np.flatnonzero(np.diff(at) > 0)
        if len(full):
            out[full] = np.add.reduceat(cost, at[:-1][full], axis=0, dtype=np.float64)
        return out


class Scorer:
    """Predicts Arrow columns of texts; made on the driver, the model is built where it is first used.

    The model is bounded by the training sample.
    """

    def __init__(self, spark: SparkSession, counts: DataFrame, order: int = ORDER):
        table = counts.toPandas()
        langs = sorted(table["lang"].unique())
        packed = {k: table[k].to_numpy() for k in ("depth", "code", "n")}
        packed["lang"] = table["lang"].map({name: i for i, name in enumerate(langs)}).to_numpy()
        self.shared, self.order, self.model = spark.sparkContext.broadcast((langs, packed)), order, None

    def __call__(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Language and score of each text."""
        langs, packed = self.shared.value
        letters = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
        pred, score = np.full(len(text), UNKNOWN, object), np.zeros(len(text))
        if not langs:
            return pred, score
        self.model = self.model or Model(langs, packed, self.order)
        for lo, hi, raw, at in blocks(text, 300_000):
            bits = self.model.lengths(raw, at)
            size = np.maximum(np.diff(at), 1)[:, None]
            share = 1 / np.exp2((bits.min(1, keepdims=True) - bits) / size).sum(1)
            ok = letters[lo:hi]
            pred[lo:hi][ok] = np.array(langs, object)[bits.argmin(1)[ok]]
            score[lo:hi][ok] = share[ok]
        return pred, score


def predict(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """``(doc_id, lang_pred, score)`` per row of ``docs``.

    ``score`` is the share of the winner when each language weighs two to the power of
    minus its bits per byte.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pred, score = scorer(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(pred, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def learned(docs: DataFrame) -> Scorer:
    """A model of the documents that are not held out."""
    return Scorer(docs.sparkSession, train(docs.filter(~held_out(F.col("doc_id")))))


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the documents that are not held out, predict all: doc_id, held_out, lang_pred, score."""
    out = predict(docs, learned(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame) -> DataFrame:
    """The documents that have a language, in all their columns; null texts and those without a letter go."""
    scorer = learned(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(scorer(batch.column("text"))[0] != UNKNOWN))

    return docs.mapInArrow(run, docs.schema)
