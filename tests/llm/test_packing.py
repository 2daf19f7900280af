"""Packed sequences against ids tokenised document by document."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from chromatile.llm import packing
from chromatile.llm.queries import QUERIES
from tokenizers import Tokenizer

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model():
    return Tokenizer.from_file(VOCABULARY)


def check(packed, texts, model, window, pad=packing.PAD):
    """Every id of every document once, in place, in full windows without gaps; returns the number of pieces."""
    rows = sorted(packed, key=lambda r: r["sequence_id"])
    want = sorted(((d, [*model.encode(t or "", add_special_tokens=False).ids, packing.END]) for d, t in texts), key=repr)
    total = sum(len(ids) for _, ids in want)
    assert [r["sequence_id"] for r in rows] == list(range(-(-total // window)))
    have, n = {}, 0
    for r in rows:
        used = sum(p["length"] for p in r["pieces"])
        assert used == window or r is rows[-1]
        assert r["padding"] == (0 if used & (used - 1) == 0 else window - used)
        assert len(r["ids"]) == used + r["padding"] and set(r["ids"][used:]) <= {pad}
        at = 0
        for p in r["pieces"]:
            assert p["offset"] == at and p["length"] > 0
            have.setdefault((p["doc_at"], p["doc_id"], p["doc_tokens"]), []).append((p["start"], r["ids"][at : at + p["length"]]))
            at, n = at + p["length"], n + 1
    got = []
    for (_, d, size), pieces in have.items():
        pieces.sort()
        ids = [i for _, part in pieces for i in part]
        assert [s for s, _ in pieces] == np.cumsum([0] + [len(x) for _, x in pieces])[:-1].tolist() and len(ids) == size
        got.append((d, ids))
    assert sorted(got, key=repr) == want
    return n


@pytest.mark.parametrize("window, row_ids, parts", [(8, 3, 4), (16, 1 << 20, 1), (2048, 50, 3), (7, 1000, 7)])
def test_every_id_once(spark, model, monkeypatch, window, row_ids, parts):
    monkeypatch.setattr(packing, "ROW_IDS", row_ids)
    rng = random.Random(window)
    words = ["the", "And", "é x", " ", "\n", "  ", "don't", "<|endoftext|>", "stop.", "a" * 50, "12", "日本", "…"]
    texts = [(i, " ".join(rng.choices(words, k=rng.choice([0, 1, 5, 40])))) for i in range(60)]
    texts += [(None, "no id"), (None, None), (60, None), (61, ""), (62, " "), texts[3], texts[3], (63, "long text " * 3000)]
    docs = spark.createDataFrame([(*t, "c", 1, "x") for t in texts], "doc_id long, text string, ids string, place int, offset string").repartition(parts)
    assert check(packing.id_arrays(packing.sequences(docs, VOCABULARY, window)).collect(), texts, model, window) > len(texts)


def test_pieces_of_any_text(model):
    rng = random.Random(2)
    parts = ["a", "b'", " ", "  ", "\n", "\t", ".", "!", "é", "ß", "\x85", "\x1c", " ", "　", "​", "²", "'s", "<|endoftext|>", "😀", "́", "\xa0", "ab", "The", "9", "\n\n", "#", "$x"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(3000)]
    import pyarrow as pa

    encode = packing.Encoder(VOCABULARY)
    for memo in (packing.MEMO, 400, 40):
        packing.MEMO, old = memo, packing.MEMO
        for lo in range(0, 3000, 500):
            ids, at = encode(pa.array(texts[lo : lo + 500]))
            want = model.encode_batch(texts[lo : lo + 500], add_special_tokens=False)
            assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [e.ids for e in want]
        packing.MEMO = old


def test_power_of_two_tail_and_empty(spark, model):
    one = spark.createDataFrame([(1, "")] * 4, "doc_id long, text string")
    (row,) = packing.id_arrays(packing.sequences(one, VOCABULARY)).collect()
    assert row["ids"] == [1, 1, 1, 1] and row["padding"] == 0
    (row,) = packing.id_arrays(packing.sequences(one.limit(3), VOCABULARY)).collect()
    assert row["padding"] == 2045 and len(row["ids"]) == 2048
    none = packing.piece_digests(packing.sequences(one.limit(0), VOCABULARY))
    assert none.count() == 0 and none.columns[0] == "doc_id"


def test_query(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    ids = {d: np.array([*model.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for d, t in docs}
    rows = QUERIES["op11_concat_pack"](spark, SF).collect()
    assert sum(r["length"] for r in rows) == sum(map(len, ids.values()))
    seqs = {}
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and zlib.crc32(part.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in seqs.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0] + [n for _, n in parts])[:-1].tolist()
    assert sorted(sum(n for _, n in p) for p in seqs.values())[1:] == [2048] * (len(seqs) - 1)
    assert [f.dataType.simpleString() for f in QUERIES["op11_concat_pack"](spark, SF).schema] == ["bigint"] * 7
