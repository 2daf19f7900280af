"""Packing by concatenation: all token ids in one line, cut into windows of one size.

The first pass tokenises every partition on its own and writes the ids, each row with its
place in its partition.  The totals of the partitions, one number each, are summed to the
places where partitions begin, so every row knows its place in the line.  The second pass
cuts its rows at the multiples of the window: windows that lie whole in a batch are done,
and the two ends of a batch are boundary records, which meet by their window.  Only those
ends are shuffled.

Ids are memoised by piece: no token crosses a single space between two other characters, so
a text without other spaces is split there and a piece is tokenised when it is new to the task.

Results: the line follows the rows as the table is read, so equal reads pack alike; a null
or empty text has its end id alone; every row is a document of its own, whatever its id; a
null ``doc_id`` stays null; other columns are ignored; an empty table gives no rows.  All
windows are full but the last, which is padded unless its length is a power of two.
"""

from __future__ import annotations

import itertools
import json
import re
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from chromatile.llm.text import blocks
from chromatile.session import materialize

WINDOW, END, PAD = 2048, 1, 0
#: Ids in one row of the token table; longer documents take several rows.
ROW_IDS = 1 << 20
#: Pieces that the memo keeps, the most ids of one of them, and parts of pieces.
MEMO, MEMO_IDS, MEMO_PARTS = 1 << 19, 64, 1 << 17
#: White space of any kind next to a space, or at an end.
ODD_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}] | [\s\x0b\x1c-\x1f\x{85}\p{Z}]|^ | $"
#: Pieces of ASCII that the byte-level pattern cuts at every change of kind, and their parts.
PLAIN = re.compile(r" ?(?:[!-&(-~]|\n(?!\n|\Z))+")
PARTS = re.compile(r" ?[A-Za-z]+| ?[0-9]+| ?[^A-Za-z0-9 \n]+|\n")
#: Space and line feed in the byte-level alphabet of the vocabulary (fixed values).
BYTE_LEVEL = str.maketrans({" ": "\u0120", "\n": "\u010a"})
#: Bytes tokenised at once.
BLOCK = 4_000_000


class Encoder:
    """Ids of whole texts by a tokenizer file, with a bounded memo of pieces.

    Pieces need the byte-level pattern without a normalizer; with other files every text is encoded whole.
    """

    def __init__(self, vocabulary: str):
        self.full = Tokenizer.from_file(vocabulary)
        self.model = self.full.model
        split = json.loads(self.full.pre_tokenizer.__getstate__()) if self.full.pre_tokenizer else {}
        added = self.full.get_added_tokens_decoder().values()
        self.special = [t.content for t in added]
        self.in_pieces = (
            split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and self.full.normalizer is None
            and not any(t.lstrip or t.rstrip or t.single_word or re.search(r"\s", t.content) for t in added)
        )
        self.parts: dict[str, bytes] = {}
        # The memo: pieces, where their ids stand in the pool, and the block that used them last.
        self.pieces, self.tick = pa.array([], pa.large_string()), 0
        self.begin = self.size = self.used = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, np.uint32).tobytes() for e in self.full.encode_batch_fast(texts, add_special_tokens=False)]

    def _part(self, part: str) -> bytes:
        """Ids of what the pattern does not cut."""
        ids = self.parts.get(part)
        if ids is None:
            ids = self.parts[part] = np.array([t.id for t in self.model.tokenize(part.translate(BYTE_LEVEL))], np.uint32).tobytes()
        return ids

    def _new(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces that the memo does not hold."""
        if len(self.parts) > MEMO_PARTS:
            self.parts.clear()
        out = [b"".join(map(self._part, PARTS.findall(p))) if PLAIN.fullmatch(p) and not any(s in p for s in self.special) else None for p in pieces]
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i, ids in zip(rest, self._encode([pieces[i] for i in rest])):
            out[i] = ids
        return out

    def _add(self, pieces: pa.Array, ids: list[bytes]) -> None:
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        self.begin = np.concatenate([self.begin, len(self.pool) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.used = np.concatenate([self.used, np.full(len(ids), self.tick)])
        self.pool = np.concatenate([self.pool, np.frombuffer(b"".join(ids), np.uint32)])
        self.pieces = pa.concat_arrays([self.pieces, pieces])

    def _trim(self) -> None:
        """Forget long pieces, and if there are too many the half that was not used for longest."""
        keep = self.size <= MEMO_IDS
        if keep.sum() > MEMO:
            keep[np.argsort(self.used, kind="stable")[: len(keep) - MEMO // 2]] = False
        if not keep.all():
            at = np.flatnonzero(keep)
            self.pool = self._gather(at)[0]
            self.size, self.used, self.pieces = self.size[at], self.used[at], self.pieces.take(pa.array(at))
            self.begin = np.cumsum(self.size) - self.size

    def _gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces one after another, and where each begins."""
        n = self.size[at]
        ends = np.append(0, np.cumsum(n))
        return self.pool[np.repeat(self.begin[at] - ends[:-1], n) + np.arange(ends[-1])], ends

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and where each begins."""
        texts = texts.fill_null("").cast(pa.large_string())
        odd = np.ones(len(texts), bool)
        if self.in_pieces:
            odd = np.asarray(pc.match_substring_regex(texts, ODD_SPACE).to_numpy(zero_copy_only=False), bool)
        # An odd text is one piece; so is what stands before the first space of another.
        lists = pc.split_pattern(pc.if_else(pa.array(odd), "", texts), " ")
        first = lists.offsets.to_numpy()
        heads = pc.if_else(pa.array(odd), texts, lists.values.take(pa.array(first[:-1])))
        coded = lists.values.dictionary_encode()
        found, codes = coded.dictionary, coded.indices.to_numpy()
        self.tick += 1
        spot = pc.index_in(found, value_set=self.pieces).fill_null(-1).to_numpy().astype(np.int64)
        lost = np.flatnonzero(spot < 0)
        spot[lost] = len(self.pieces) + np.arange(len(lost))
        new = found.take(pa.array(lost))
        self._add(new, self._new([" " + p for p in new.to_pylist()]))
        self.used[spot] = self.tick
        at = spot[codes]
        at[first[:-1]] = len(self.pieces) + np.arange(len(texts))
        self._add(heads, self._encode(heads.to_pylist()))
        out, ends = self._gather(at)
        n = len(self.pieces) - len(texts)  # the heads are not pieces
        self.begin, self.size, self.used, self.pieces = self.begin[:n], self.size[:n], self.used[:n], self.pieces[:n]
        self._trim()
        return out, ends[first]


def worker_encoder(vocabulary: str) -> Encoder:
    """One encoder per Python worker process: its memo, of bounded size, serves all its tasks."""
    held = sys.modules.setdefault("_encoders", types.ModuleType("_encoders")).__dict__
    if vocabulary not in held:
        held[vocabulary] = Encoder(vocabulary)
    return held[vocabulary]


def id_bytes(vocabulary: str, end: int) -> int:
    """Bytes of an id in the token table."""
    return 2 if max(Tokenizer.from_file(vocabulary).get_vocab_size() - 1, end) < 1 << 16 else 4


def _binary(ids: np.ndarray, cuts: np.ndarray, width: int = 4) -> pa.Array:
    """Stretches of ids as bytes, little-endian."""
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((width * cuts).astype(np.int32)), pa.py_buffer(ids.astype(f"<u{width}", copy=False))])


def _numbers(column: pa.Array, width: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a column of such bytes, and where each row begins."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    kind = f"<u{width}"
    ids = np.frombuffer(data, kind, (at[-1] - at[0]) // width, at[0]) if data is not None and at[-1] > at[0] else np.zeros(0, kind)
    return ids, (at - at[0]) // width


TOKENS = "part int, place long, n long, doc_id long, start long, doc_tokens long, ids binary"


def token_table(docs: DataFrame, vocabulary: str, end: int = END) -> DataFrame:
    """Ids, of ``id_bytes`` bytes each, of every document, with the place of each row in its partition; written, so that places stay."""

    width = id_bytes(vocabulary, end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, place = worker_encoder(vocabulary), TaskContext.get().partitionId(), 0
        for batch in batches:
            for lo, hi, _, _ in blocks(batch.column("text"), BLOCK):
                ids, at = encode(batch.column("text").slice(lo, hi - lo))
                ids = np.insert(ids, at[1:], np.uint32(end))
                at = at + np.arange(len(at))
                cuts = np.unique(np.concatenate([at, *(np.arange(a, b, ROW_IDS) for a, b in itertools.pairwise(at.tolist()) if b - a > ROW_IDS)]))
                row = np.searchsorted(at, cuts[:-1], "right") - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(row), part), pa.int32()), pa.array(place + cuts[:-1]), pa.array(np.diff(cuts)),
                        batch.column("doc_id").slice(lo, hi - lo).take(pa.array(row)), pa.array(cuts[:-1] - at[row]),
                        pa.array(np.diff(at)[row]), _binary(ids, cuts, width),
                    ],
                    names=["part", "place", "n", "doc_id", "start", "doc_tokens", "ids"],
                )
                place += int(at[-1])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialize(narrow.mapInArrow(run, TOKENS), "tokens")


PIECE = "doc_at long, doc_id long, start long, length long, offset long, doc_tokens long"
RECORDS = f"sequence_id long, offset long, ids binary, pieces array<struct<{PIECE}>>"


def _cut(ids: np.ndarray, begin: np.ndarray, rows: pa.RecordBatch, window: int, whole: bool) -> pa.RecordBatch:
    """Windows of a run of rows that follow each other in the line: the whole ones, or what is left at its ends."""
    first, last = int(begin[0]), int(begin[-1])
    cuts = np.unique(np.concatenate([[first, last], np.arange(-(-first // window) * window, last, window)]))
    keep = np.flatnonzero((np.diff(cuts) == window) == whole)
    doc_at = begin[:-1] - rows.column("start").to_numpy()
    heads = np.concatenate([begin[:-1][np.concatenate([[True], np.diff(doc_at) > 0])], [last]])
    marks = np.unique(np.concatenate([cuts, heads]))
    row = np.searchsorted(begin, marks[:-1], "right") - 1
    slot = np.searchsorted(cuts, marks[:-1], "right") - 1
    pieces = pa.StructArray.from_arrays(
        [
            pa.array(doc_at[row]), rows.column("doc_id").take(pa.array(row)), pa.array(marks[:-1] - doc_at[row]), pa.array(np.diff(marks)),
            pa.array(marks[:-1] % window), rows.column("doc_tokens").take(pa.array(row)),
        ],
        names=["doc_at", "doc_id", "start", "length", "offset", "doc_tokens"],
    )
    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(slot, np.arange(len(cuts))), pa.int32()), pieces)
    return pa.RecordBatch.from_arrays(
        [pa.array(cuts[:-1] // window), pa.array(cuts[:-1] % window), _binary(ids, cuts - first), lists], names=["sequence_id", "offset", "ids", "pieces"]
    ).take(pa.array(keep))


def sequences(docs: DataFrame, vocabulary: str, window: int = WINDOW, end: int = END, pad: int = PAD) -> DataFrame:
    """``(sequence_id, ids, padding, pieces)``: the packed windows, each with its pieces of documents.

    ``ids`` are little-endian 32-bit numbers, one after another, as token files hold them.
    """
    tokens, width = token_table(docs, vocabulary, end), id_bytes(vocabulary, end)
    totals = tokens.groupBy("part").agg(F.max(F.col("place") + F.col("n")).alias("n")).collect()  # a number a task of the first pass
    size = np.zeros(max((r["part"] for r in totals), default=-1) + 2, np.int64)
    for r in totals:
        size[r["part"] + 1] = r["n"]
    base = docs.sparkSession.sparkContext.broadcast(np.cumsum(size))

    def windows(whole: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids, at = _numbers(batch.column("ids"), width)
                begin = base.value[batch.column("part").to_numpy()] + batch.column("place").to_numpy()
                breaks = np.flatnonzero(begin[1:] != begin[:-1] + np.diff(at)[:-1]) + 1
                # Rows of about ROW_IDS at once.
                full = np.flatnonzero(np.diff(at[:-1] // ROW_IDS)) + 1
                for lo, hi in itertools.pairwise(np.unique([0, *breaks, *full, len(begin)]).tolist()):
                    stop = begin[hi - 1] + at[hi] - at[hi - 1]
                    yield _cut(ids[at[lo] : at[hi]], np.append(begin[lo:hi], stop), batch.slice(lo, hi - lo), window, whole)

        return tokens.select("part", "place", "doc_id", "start", "doc_tokens", "ids").mapInArrow(run, RECORDS)

    # A window of boundary records holds at most as many ids as any other.
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids", "pieces")))
    ends = windows(False).groupBy("sequence_id").agg(parts.alias("p"))
    follows = lambda a, x: (F.size(a) > 0) & (F.element_at(a, -1)["doc_at"] == x["doc_at"])
    longer = lambda a, x: F.element_at(a, -1).withField("length", F.element_at(a, -1)["length"] + x["length"])
    joined = F.aggregate(
        F.flatten(F.col("p.pieces")), F.expr(f"cast(array() as array<struct<{PIECE}>>)"),
        lambda a, x: F.when(follows(a, x), F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(longer(a, x)))).otherwise(F.concat(a, F.array(x))),
    )
    ids = F.aggregate("p.ids", F.lit(b""), lambda a, x: F.concat(a, x))
    full = windows(True).select("sequence_id", "ids", "pieces").union(ends.select("sequence_id", ids.alias("ids"), joined.alias("pieces")))
    n = (F.octet_length("ids") / 4).cast("int")
    padding = F.when(F.bit_count(n) == 1, 0).otherwise(window - n).cast("int")
    pads = F.unhex(F.repeat(F.lit(pad.to_bytes(4, "little").hex()), padding))
    return full.select("sequence_id", F.concat("ids", pads).alias("ids"), padding.alias("padding"), "pieces")


def id_arrays(packed: DataFrame) -> DataFrame:
    """Packed sequences with their ids as an array of numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at = _numbers(batch.column("ids"))
            yield batch.set_column(1, "ids", pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32))))

    schema = f"sequence_id long, ids array<int>, padding int, pieces array<struct<{PIECE}>>"
    return packed.select("sequence_id", "ids", "padding", "pieces").mapInArrow(run, schema)


def piece_digests(packed: DataFrame) -> DataFrame:
    """A row per piece of packed sequences, with the CRC-32 of its ids as little-endian 32-bit numbers."""
    rows = packed.select("sequence_id", "ids", F.explode("pieces").alias("p"))
    part = F.substring("ids", (4 * F.col("p.offset") + 1).cast("int"), (4 * F.col("p.length")).cast("int"))
    return rows.select("p.doc_id", "p.start", "p.length", F.crc32(part).alias("ids_crc32"), "p.doc_tokens", "sequence_id", "p.offset")
