"""The corpus pipeline, stage by stage, against the plain rules."""

import corpus_pipeline
from chromatile.llm import decontam, langid, linededup, mixing
from chromatile.session import materialize
from test_near_copies import plain

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_copies", "leaks", "mix"]
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, docs, SF), name)
        ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
        if name != "mix":
            assert out.columns == docs.columns
        if name == "language":
            assert ids(docs) - ids(out) == {r["doc_id"] for r in langid.identify(docs).filter("lang_pred = 'und'").collect()}
        if name == "lines":
            assert {r["doc_id"]: r["text"] for r in out.collect()} == {r["doc_id"]: r["text"] for r in linededup.dedup_lines(docs).collect()}
            assert out.filter("n_chars <> length(text)").count() <= docs.filter("n_chars <> length(text)").count()
        if name == "near_copies":
            kept, pairs = plain([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
            assert ids(out) == kept and pairs
        if name == "leaks":
            found = decontam.contamination(docs, spark.read.parquet(f"{SF}/benchmark.parquet"))
            assert ids(docs) - ids(out) == ids(found)
            texts = [r["text"] for r in out.collect()]
            assert not any(b["text"] in t for b in spark.read.parquet(f"{SF}/benchmark.parquet").collect() for t in texts)
        if name == "mix":
            want = {r["doc_id"]: r["repeats"] for r in mixing.mix(docs).collect() if r["repeats"]}
            have = {}
            for r in out.collect():
                have[r["doc_id"]] = have.get(r["doc_id"], 0) + 1
            assert have == want
        docs = out
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()) == sorted(r["doc_id"] for r in docs.collect())
