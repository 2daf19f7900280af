"""Reversible line de-duplication over sharded cuckoo filters and exact reference counts.

A line's key is the line without white space at its ends, A-Z lower-cased, as a
128-bit hash.  The store holds, on the shared folder,

* ``postings``  which document holds which key, once;
* ``refs``      the exact count of documents per key and the largest of them;
* ``filters``   per shard of the keys, cuckoo filters of all keys in ``refs``.

An insertion counts its own keys first and asks the filters of their shards: keys that
no filter knows are new and skip the join with ``refs``.  A full filter of a shard gets a
larger one above it, and ``refs`` keeps the layer of every key.  A deletion takes its
postings back, lowers the counts and removes keys that reach zero from the filter of their
layer, where a fingerprint of the same buckets and value is as good as their own; so the
filters never deny a key that is held.  Inserting and deleting leaves the decisions that the
remaining documents alone would give.  Before an insertion that would outgrow the shards,
filters of more shards are built from ``refs``.

Every version is written as tables of its own before it counts.  Decisions join lines
with the shared keys; keys so common that one could crowd a task are few by counting
(at most ``HOT_KEYS`` of all postings over ``HOT_KEYS``) and are joined by broadcast.

Results: null and empty texts are one empty line; a null doc_id counts as the largest;
rows of one doc_id are one document, whose lines are judged alike; empty tables give
no rows; other columns are kept by ``dedup_lines`` and ignored elsewhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from chromatile.llm.text import NO_ID, buffers, mixed, narrow, public_id
from chromatile.session import materialize

MIN_CHARS, MIN_DOCS = 20, 3
SHARD_KEYS = 400_000
HOT_KEYS = 4096
WHITE_BYTES = b" \t\n\v\f\r"
SLOTS = 4
#: Share of the slots that a filter may fill.
FULL = 0.85


def line_key(line: bytes) -> bytes:
    return line.strip(WHITE_BYTES).lower()


def counted(key: bytes, min_chars: int) -> bool:
    """Whether the key has enough code points."""
    return len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars)


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; a key lives in one of two buckets."""

    def __init__(self, buckets: int, table: np.ndarray | None = None):
        self.mask = buckets - 1
        self.table = np.zeros((buckets, SLOTS), np.uint16) if table is None else table

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        return cls(1 << max(4, int(np.ceil(np.log2(max(1, keys) / (SLOTS * 0.7))))))

    @classmethod
    def load(cls, blob: bytes) -> CuckooFilter:
        table = np.frombuffer(blob, np.uint16).reshape(-1, SLOTS).copy()
        return cls(len(table), table)

    def dump(self) -> bytes:
        return self.table.tobytes()

    def _places(self, k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mark = (k2.view(np.uint64) >> np.uint64(48)).astype(np.uint16)
        mark[mark == 0] = 1
        return mark, (mixed(k1.view(np.uint64)) & np.uint64(self.mask)).astype(np.int64)

    def _other(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return bucket ^ (mixed(mark.astype(np.uint64)) & np.uint64(self.mask)).astype(np.int64)

    def contains(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        mark, one = self._places(k1, k2)
        two = self._other(one, mark)
        return (self.table[one] == mark[:, None]).any(1) | (self.table[two] == mark[:, None]).any(1)

    def _fill(self, bucket: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """Put what fits into the free slots of the buckets; True where it did not."""
        order = np.argsort(bucket, kind="stable")
        b = bucket[order]
        rank = np.arange(len(b)) - np.searchsorted(b, b, "left")
        free = self.table[b] == 0
        slot = np.argmax(np.cumsum(free, 1) > rank[:, None], axis=1)
        fits = free.sum(1) > rank
        self.table[b[fits], slot[fits]] = mark[order][fits]
        left = np.zeros(len(bucket), bool)
        left[order[~fits]] = True
        return left

    def insert(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        """Insert keys up to ``FULL`` of the slots; True where the filter is too full for a key."""
        room = max(0, int(self.table.size * FULL) - int(np.count_nonzero(self.table)))
        mark, one = self._places(k1, k2)
        left = np.ones(len(mark), bool)
        left[:room] = self._fill(one[:room], mark[:room])
        rest = np.flatnonzero(left[:room])
        left[rest] = self._fill(self._other(one, mark)[rest], mark[rest])
        for i in np.flatnonzero(left[:room]):
            left[i] = not self._kick(int(one[i]), int(mark[i]))
        return left

    def _kick(self, bucket: int, mark: int) -> bool:
        path = []
        for step in range(200):
            slot = step % SLOTS
            path.append((bucket, slot, int(self.table[bucket, slot])))
            self.table[bucket, slot], mark = mark, path[-1][2]
            bucket = int(self._other(np.array([bucket]), np.array([mark], np.uint16))[0])
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = mark
                return True
        for bucket, slot, old in reversed(path):
            self.table[bucket, slot] = old
        return False

    def delete(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        """Take one fingerprint of each key out; True where there was none."""
        mark, one = self._places(k1, k2)
        missing = np.zeros(len(mark), bool)
        for i, (b, m, o) in enumerate(zip(one.tolist(), mark.tolist(), self._other(one, mark).tolist())):
            for bucket in (b, o):
                at = np.flatnonzero(self.table[bucket] == m)
                if len(at):
                    self.table[bucket, at[0]] = 0
                    break
            else:
                missing[i] = True
        return missing


class Layers:
    """The filters of one shard: a full one gets a larger one above it."""

    def __init__(self, blobs: list[bytes]):
        self.filters = [CuckooFilter.load(b) for b in blobs]

    def contains(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        hit = np.zeros(len(k1), bool)
        for f in self.filters:
            hit |= f.contains(k1, k2)
        return hit

    def insert(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        """Insert keys; the layer of each."""
        layer = np.full(len(k1), max(0, len(self.filters) - 1), np.int32)
        todo = np.arange(len(k1))
        if self.filters and len(todo):
            todo = todo[self.filters[-1].insert(k1, k2)]
        while len(todo):
            size = max(len(todo), 2 * SLOTS * len(self.filters[-1].table) if self.filters else 0)
            self.filters.append(CuckooFilter.sized(size))
            layer[todo] = len(self.filters) - 1
            todo = todo[self.filters[-1].insert(k1[todo], k2[todo])]
        return layer

    def delete(self, k1: np.ndarray, k2: np.ndarray, layer: np.ndarray) -> None:
        for i, f in enumerate(self.filters):
            own = layer == i
            if f.delete(k1[own], k2[own]).any():
                raise RuntimeError("a filter has lost a key")

    def dump(self) -> list[bytes]:
        return [f.dump() for f in self.filters]


def postings(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``(k1, k2, doc_id)``: the keys of each row's lines, once per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = buffers(batch.column("text"))
            data = memoryview(raw)
            ids = np.array(batch.column("doc_id"))
            keys, owner = [], []
            for i in range(len(ids)):
                own = {line_key(x) for x in bytes(data[at[i] : at[i + 1]]).split(b"\n")}
                own = [xxhash.xxh3_128_digest(k) for k in own if counted(k, min_chars)]
                keys += own
                owner.append(len(own))
            pair = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy()), pa.array(np.repeat(ids, owner))], names=["k1", "k2", "doc_id"]
            )

    return narrow(docs).mapInArrow(run, "k1 long, k2 long, doc_id long")


KEY = ["k1", "k2"]
REFS = "k1 long, k2 long, n long, top long, layer int"
FILTERS = "shard int, layers array<binary>"
#: A row of either kind: the filters of a shard, or a key with its layer.
UPDATED = f"{FILTERS}, {REFS}"


class LineStore:
    """A version of the store; ``insert`` and ``delete`` return the next one."""

    def __init__(self, spark: SparkSession, min_chars: int = MIN_CHARS, shards: int | None = None):
        self.spark, self.min_chars, self.shards = spark, min_chars, shards or 1
        self.postings = spark.createDataFrame([], "k1 long, k2 long, doc_id long")
        self.refs, self.filters = spark.createDataFrame([], REFS), spark.createDataFrame([], FILTERS)

    def _next(self, held: DataFrame, refs: DataFrame, filters: DataFrame) -> LineStore:
        out = LineStore(self.spark, self.min_chars, self.shards)
        out.postings, out.refs, out.filters = held, refs, filters
        return out

    def _shard(self, df: DataFrame) -> DataFrame:
        return df.withColumn("shard", F.pmod(F.xxhash64("k1"), F.lit(self.shards)).cast("int"))

    def _updated(self, changes: DataFrame) -> DataFrame:
        """Filters after ``changes`` (k1, k2, n, top, layer), written: keys with a layer are taken out of it, others put in."""

        def update(old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
            layers = Layers([b for row in old["layers"] for b in row])
            out = new["layer"].notna().to_numpy()
            k1, k2 = new["k1"].to_numpy(np.int64), new["k2"].to_numpy(np.int64)
            layers.delete(k1[out], k2[out], new["layer"].to_numpy()[out].astype(np.int64))
            put = new[~out].assign(layer=layers.insert(k1[~out], k2[~out]), layers=None)
            shard = old["shard"].iloc[0] if len(old) else new["shard"].iloc[0]
            filters = pd.DataFrame({"shard": [shard], "layers": [layers.dump()]})
            names = ["shard", "layers", "k1", "k2", "n", "top", "layer"]
            return pd.concat([filters.reindex(columns=names).astype({"k1": "Int64", "k2": "Int64", "n": "Int64", "top": "Int64", "layer": "Int32"}), put[names]])

        left, right = self.filters.groupBy("shard"), self._shard(changes).groupBy("shard")
        return materialize(left.cogroup(right).applyInPandas(update, UPDATED), "updated")

    def _known(self, keys: DataFrame) -> DataFrame:
        """``keys`` with ``maybe``: whether a filter of the shard has the key."""

        def ask(filters: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
            layers = Layers([b for row in filters["layers"] for b in row])
            return keys.assign(maybe=layers.contains(keys["k1"].to_numpy(np.int64), keys["k2"].to_numpy(np.int64)))

        schema = "k1 long, k2 long, n long, top long, shard int, maybe boolean"
        return self.filters.groupBy("shard").cogroup(self._shard(keys).groupBy("shard")).applyInPandas(ask, schema)

    def _widened(self, coming: int) -> LineStore:
        """The store with enough shards for ``coming`` more keys; more of them are filled anew from the exact table."""
        held = self.refs.count()
        if held + coming <= 2 * SHARD_KEYS * self.shards:
            return self
        out = self._next(self.postings, self.refs, self.filters.limit(0))
        out.shards = -(-(held + coming) // SHARD_KEYS)
        if held:
            new = out._updated(self.refs.withColumn("layer", F.lit(None).cast("int")))
            out.refs, out.filters = new.filter("k1 is not null").select(*self.refs.columns), new.filter("k1 is null").select("shard", "layers")
        return out

    def insert(self, docs: DataFrame) -> LineStore:
        """Add documents that the store does not hold yet."""
        new = materialize(postings(docs, self.min_chars), "postings")
        counts = new.groupBy(*KEY, "doc_id").agg(F.lit(1).alias("_")).groupBy(*KEY).agg(F.count("*").alias("n"), F.max("doc_id").alias("top"))
        counts = materialize(counts, "counts")
        store = self._widened(counts.count())
        asked = materialize(store._known(counts), "asked")
        no_layer = F.lit(None).cast("int").alias("layer")
        maybe = asked.filter("maybe").select(*KEY, F.col("n").alias("_n"), F.col("top").alias("_top"))
        met = store.refs.join(maybe, KEY, "full_outer")
        met = met.select(*KEY, (F.coalesce("n", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("n"), F.greatest("top", "_top").alias("top"), "layer")
        met = materialize(met, "met")
        added = asked.filter("not maybe").select(*KEY, "n", "top", no_layer).unionByName(met.filter("layer is null"))
        updated = store._updated(added)
        refs = met.filter("layer is not null").unionByName(updated.filter("k1 is not null").select(*KEY, "n", "top", "layer"))
        return store._next(store.postings.unionByName(new), refs, updated.filter("k1 is null").select("shard", "layers"))

    def delete(self, ids: DataFrame) -> LineStore:
        """Take the documents of ``ids`` (doc_id) out again."""
        ids = ids.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id")).distinct()
        held = materialize(self.postings.join(ids, "doc_id", "left_anti").select(*KEY, "doc_id"), "postings")
        gone = self.postings.join(ids, "doc_id", "left_semi").select(*KEY, "doc_id").distinct()
        gone = materialize(gone.groupBy(*KEY).agg(F.count("*").alias("_n"), F.max("doc_id").alias("_top")), "gone")
        left = materialize(self.refs.join(gone, KEY, "left").withColumn("n", F.col("n") - F.coalesce("_n", F.lit(0))), "left")
        lost = left.filter("n > 0 and top = _top").select(*KEY)
        tops = held.join(lost, KEY, "left_semi").groupBy(*KEY).agg(F.max("doc_id").alias("_next"))
        refs = left.filter("n > 0").join(tops, KEY, "left").select(*KEY, "n", F.coalesce("_next", "top").alias("top"), "layer")
        updated = self._updated(left.filter("n = 0").select(*KEY, "n", "top", "layer"))
        return self._next(held, materialize(refs, "refs"), updated.filter("k1 is null").select("shard", "layers"))

    def decisions(self, min_docs: int = MIN_DOCS) -> DataFrame:
        """``(_id, drops)``: per document the keys whose lines it loses."""
        shared = materialize(self.refs.filter(F.col("n") >= min_docs), "shared")
        total = self.postings.count()
        limit = total // HOT_KEYS
        hot = shared.filter(F.col("n") > limit)  # at most HOT_KEYS of them
        few = [self.postings.join(F.broadcast(hot), KEY), self.postings.join(shared.filter(F.col("n") <= limit), KEY)]
        drops = few[0].unionByName(few[1]).filter(F.col("doc_id") < F.col("top"))
        return drops.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set(F.struct(*KEY)).alias("drops"))


def _apply(docs: DataFrame, decisions: DataFrame, min_chars: int, with_text: bool) -> DataFrame:
    schema = "doc_id long, n_lines long, n_dropped long, " + ("text string" if with_text else "kept_sha256 string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = buffers(batch.column("text"))
            data, drops = memoryview(raw), batch.column("drops")
            n_lines, n_dropped, kept = [], [], []
            for i in range(batch.num_rows):
                text = bytes(data[at[i] : at[i + 1]])
                lines = text.split(b"\n")
                stay = lines
                if drops[i].is_valid:
                    own = drops[i].values
                    pair = np.stack([np.array(own.field("k1")), np.array(own.field("k2"))], 1)
                    gone = {row.tobytes() for row in pair}
                    stay = [x for x in lines if xxhash.xxh3_128_digest(line_key(x)) not in gone]
                    text = b"\n".join(stay)
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(stay))
                kept.append(text.decode("utf-8", "replace") if with_text else hashlib.sha256(text).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())],
                names=["doc_id", "n_lines", "n_dropped", "text" if with_text else "kept_sha256"],
            )

    rows = narrow(docs).join(decisions, F.col("doc_id") == F.col("_id"), "left").select("doc_id", "text", "drops")
    return rows.mapInArrow(run, schema)


def loaded(docs: DataFrame, min_chars: int = MIN_CHARS) -> LineStore:
    """A store of all documents, filled as a growing corpus fills it.

    One half goes in first, with a sixteenth of the other half.  That part is taken out again
    and comes back with its own half, whose keys the filters are asked for.
    """
    spot = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))), F.lit(32))
    store = LineStore(docs.sparkSession, min_chars).insert(docs.filter(spot < 17))
    return store.delete(docs.filter(spot == 16)).insert(docs.filter(spot > 15))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, with_text: bool = True) -> DataFrame:
    """Decisions of a store of all documents, applied: doc_id, n_lines, n_dropped, text or kept_sha256."""
    out = _apply(docs, loaded(docs, min_chars).decisions(min_docs), min_chars, with_text)
    return out.select(public_id(), *[c for c in out.columns if c != "doc_id"])


def without_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """The documents with their columns, ``text`` rewritten where it loses lines."""
    decisions = loaded(docs, min_chars).decisions(min_docs)
    decisions = decisions.select("_id", F.col("drops").alias("_drops"))
    names = docs.columns
    joined = docs.join(decisions, F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)) == decisions["_id"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, drops, changed = batch.column(names.index("text")).to_pylist(), batch.column(len(names)), np.zeros(batch.num_rows, bool)
            for i, text in enumerate(texts):
                if drops[i].is_valid and text is not None:
                    own = drops[i].values
                    gone = {row.tobytes() for row in np.stack([np.array(own.field("k1")), np.array(own.field("k2"))], 1)}
                    stay = [x for x in text.encode().split(b"\n") if xxhash.xxh3_128_digest(line_key(x)) not in gone]
                    texts[i], changed[i] = b"\n".join(stay).decode(), True
            columns = {n: batch.column(i) for i, n in enumerate(names)} | {"text": pa.array(texts, pa.string())}
            if "n_chars" in columns:
                old = columns["n_chars"]
                size = pc.cast(pc.utf8_length(columns["text"]), old.type)
                columns["n_chars"] = pc.if_else(pa.array(changed), size, old)
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)

    return joined.select(*[docs[n] for n in names], decisions["_drops"]).mapInArrow(run, docs.schema)
