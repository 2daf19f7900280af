"""Hard negatives against plain products, and packed products against plain ones."""

import duckdb
import numpy as np
import pytest
from chromatile.llm import checks, negatives
from chromatile.llm.queries import QUERIES
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("span, d, n", [(3, 5, 17), (160, 64, 50), (4000, 64, 31), (2**20, 7, 9), (2**29, 3, 20), (0, 4, 6), (5, 0, 4), (200, 1, 1)])
def test_packed_scores(span, d, n):
    rng = np.random.default_rng(d)
    a = rng.integers(-span, span + 1, (6, d)).astype(float)
    c = rng.integers(-span, span + 1, (n, d)).astype(float)
    a[:, :1], c[:, :1] = span, -span
    want = [[sum(int(x) * int(y) for x, y in zip(p, q)) for q in c] for p in a]
    assert negatives.packed_scores(a, c, float(span)).tolist() == want
    bits = negatives.field_bits(span, d)
    assert (2 * span) ** 2 * d < 2**bits


def plain(rows, scale=256):
    """(anchor, positive, rank, negative, two scores) over (vec_id, embedding, label) rows."""
    used = []
    for i, e, g in rows:
        if e is None or g is None or any(x is None or not np.isfinite(x) for x in e):
            continue
        v = [int(np.floor(scale * float(x))) for x in e]
        used.append((i, v, g if i is None or i % 7 else (g + 1) % 10))
    lengths = [len(v) for _, v, _ in used]
    most = min(set(lengths), key=lambda n: (-lengths.count(n), n)) if used else 0
    used = [r for r in used if len(r[1]) == most and sum(x * x for x in r[1]) < 2**62]
    out = []
    last = lambda i: 2**63 if i is None else i
    for k, (i, v, g) in enumerate(used):
        if i is None or i % 50:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), last(j), j, h) for m, (j, w, h) in enumerate(used) if m != k]
        for s, _, j, _ in sorted((r for r in scored if r[3] == g), key=lambda r: r[:2])[:5]:
            fits = sorted((r for r in scored if r[3] != g and -50 * s <= -100 * r[0] <= -95 * s), key=lambda r: r[:2])[:3]
            out += [(i, j, n, r[2], -s, -r[0]) for n, r in enumerate(fits, 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("big", [1.0, 1e6])
def test_hard_negatives(spark, monkeypatch, big):
    monkeypatch.setattr(negatives, "ANCHOR_BLOCK", 3)
    monkeypatch.setattr(negatives, "CANDIDATE_BLOCK", 40)
    rng = np.random.default_rng(4)
    rows = []
    for i in range(220):
        e = [float(x) for x in rng.normal(0, 0.3, 6) * big] if i % 5 else rows[i - 1][1] if i else [0.5] * 6
        rows.append((i, e, int(rng.integers(0, 4))))
    rows += [rows[50], rows[100], (100, rows[3][1], 1), (None, rows[51][1], 0), (300, None, 1), (301, [0.1, None, 0.2, 0.0, 0.0, 0.0], 1)]
    rows += [(302, [float("nan")] + [0.0] * 5, 1), (303, [float("inf")] * 6, 2), (350, rows[2][1], None), (400, [1.0], 2), (450, [1e30] * 6, 2), (-50, rows[9][1], 3)]
    df = spark.createDataFrame([(*r, "c", "c", "c", "c") for r in rows], "vec_id long, embedding array<double>, label int, v string, uid string, slot string, rank string").repartition(3)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = negatives.hard_negatives(df, F.col("vec_id") % 50 == 0, label)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(rows)
    assert len(plain(rows)) > 40
    assert negatives.hard_negatives(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_query(spark):
    got = QUERIES["op12_hard_negatives"](spark, SF)
    assert [(f.name, f.dataType.simpleString()) for f in got.schema] == [
        ("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"), ("negative_id", "bigint"), ("positive_score", "bigint"), ("negative_score", "bigint"),
    ]
    have = sorted(map(tuple, got.collect()))
    table = f"{SF}/embeddings.parquet"
    rows = [tuple(r) for r in spark.read.parquet(table).select("vec_id", "embedding", "label").collect()]
    assert have == sorted(plain(rows))
    want = duckdb.sql(checks.NEGATIVES.replace("FROM embeddings", f"FROM '{table}'")).fetchall()
    assert have == sorted(want)
