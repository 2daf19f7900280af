"""Near copies of the pipeline against true Jaccard similarity, pair by pair."""

import itertools
import random

import corpus_pipeline
import pytest
from chromatile.llm import nearcopies, simhash
from chromatile.session import materialize
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain(rows):
    """(ids kept, similar pairs) of (doc_id, text) rows."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    pairs = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i for i in sets if find(i) == i}, pairs


def edited(words, n, rng):
    out = list(words)
    for i in rng.sample(range(len(out)), n):
        out[i] = f"new{rng.random()}"
    return " ".join(out)


def test_stage_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = corpus_pipeline.lines(spark, corpus_pipeline.language(spark, docs, SF), SF)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    kept, pairs = plain(rows)
    assert (3, 122) in pairs and (1, 177) in pairs  # 5 and 9 bits apart as fingerprints
    assert {r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, SF).collect()} == kept


@pytest.mark.parametrize("small, large", [(24, 4096), (2, 4096), (2, 3)])
def test_groups_of_every_size(spark, small, large):
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(40)]
    texts = []
    for family in range(12):
        words = [f"f{family}w{i}" for i in range((6, 9, 25, 60, 200, 400)[family % 6])]
        texts += [" ".join(words), *(edited(words, rng.randint(0, len(words) // 20 + 1), rng) for _ in range(7)), " ".join(words[1:])]
    texts += [" ".join([*(f"d{d}w{i}" for i in range(60)), *passage]) for d in range(30)]
    texts += [None, "", "one", "one two", "One  TWO", "a b c d e"]
    rows = list(enumerate(texts))
    kept, pairs = plain(rows)
    assert len(pairs) > 100
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sketch = nearcopies.sketches(docs)
    cls = {r["doc_id"]: r["cls"] for r in sketch.select("doc_id", "cls").collect()}
    found = {frozenset((r["a"], r["b"])) for r in nearcopies.links(sketch, small, large).collect()}
    true = {frozenset((cls[a], cls[b])) for a, b in pairs if cls[a] != cls[b]}
    assert found <= true

    def parts(edges):
        seen = {c: c for c in cls.values()}
        for e in edges:
            a, b = (seen[c] for c in e)
            seen = {c: (a if r == b else r) for c, r in seen.items()}
        groups = {}
        for c, r in seen.items():
            groups.setdefault(r, set()).add(c)
        return {frozenset(g) for g in groups.values()}

    assert parts(found) == parts(true)
    assert {r["doc_id"] for r in nearcopies.keep_first(docs).collect()} == kept


def test_empty(spark):
    assert nearcopies.keep_first(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_anchors_bring_small_changes_together(spark):
    """Of copies with one word changed the anchors find some, and only true links; the keys find the rest."""
    rng = random.Random(7)
    texts = []
    for family in range(10):
        words = [f"f{family}w{i}" for i in range(300)]
        texts += [" ".join(words), " ".join([*words[:-1], "end"]), " ".join(edited(words, 1, rng))]
    rows = list(enumerate(texts))
    kept, pairs = plain(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sketch = nearcopies.sketches(docs)
    cls = {r["doc_id"]: r["cls"] for r in sketch.select("doc_id", "cls").collect()}
    near = {frozenset((r["a"], r["b"])) for r in nearcopies.anchored(sketch).collect()}
    assert len(near) > 5 and near <= {frozenset((cls[a], cls[b])) for a, b in pairs}
    assert {r["doc_id"] for r in nearcopies.keep_first(docs).collect()} == kept


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_exploded_rows_do_not_pass_the_driver(spark):
    """Spark sizes them by the table before, which is a small part of them."""
    rows = materialize(spark.range(50).selectExpr("id as cls", "id % 7 as n", "id as grp", "array(id % 3, 10 + id % 5) as keys"), "rows")
    exploded = rows.select(F.explode("keys").alias("key"), F.lit(0).cast("long").alias("second"), "cls", "n", "grp")
    crowded = nearcopies._crowded(exploded)
    assert "Broadcast" not in plan(crowded)
    assert sorted(r["members"] for r in crowded.collect()) == [10] * 50 + [16] * 16 + [17] * 34


def test_copies_at_anchors_do_not_pass_the_driver(spark):
    fps = materialize(spark.range(50).selectExpr("id * 3 as fp"), "fps")
    near = simhash._crowded(simhash._replicate(fps, 2))
    assert "Broadcast" not in plan(near) and near.filter("n < 2").count() == 0 < near.count()
