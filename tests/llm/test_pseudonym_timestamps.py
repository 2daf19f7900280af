"""Dates inside ISO timestamps get the pseudonym of the plain date."""

from chromatile.llm import pii


def test_dates_of_timestamps(spark):
    texts = [
        "2021-03-04", "at 2021-03-04T10:00:00Z,", "2021-03-04T10:00:00.5+01:00 and 2021-03-04", "2021-02-30T10:00:00Z",
        "2021-03-04Tuesday", "12021-03-04T10:00", "x2021-03-04T10:00",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: (r["text"], r["n_replaced"]) for r in pii.pseudonymise(df).collect()}
    new, n = out[0]
    assert n == 1 and new != texts[0]
    assert out[1] == (f"at {new}T10:00:00Z,", 1)
    assert out[2] == (f"{new}T10:00:00.5+01:00 and {new}", 2)
    assert [out[i] for i in range(3, 7)] == [(t, 0) for t in texts[3:]]
