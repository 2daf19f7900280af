"""Streams in several files with late rows against their batch twins, and the state they let go."""

import time

import pytest
from chromatile import fixtures
from chromatile.session import use_state_store
from chromatile.streaming import edits as ed
from conftest import SF
from pyspark.sql import functions as F

EDIT = "user_id long, ts timestamp, event_id long, action string, color int, payload int"


@pytest.fixture(scope="module")
def log(spark):
    use_state_store(spark)
    stream, late = ed.split_table_stream(spark, SF, "events", "ts", "event_id", 4, "3 hours")
    return fixtures.edit_rows(stream), late


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_undo_in_event_order(spark, log):
    progress = []
    out = ed.run_available(ed.undo_redo_stream(*log), "update", "undo", progress)
    assert rows(ed.describe_state(ed.newest(out, ["user_id"]))) == rows(ed.undo_redo(fixtures.edits(spark, SF)))
    # Waiting edits and timers are let go when the watermark passes them; two rows a user stay.
    assert sum(p["removed"] for p in progress) > 500 and sum(p["dropped"] for p in progress) == 0
    assert progress[-1]["state"] <= 2 * 15


def test_undo_drops_what_is_too_late(spark, tmp_path):
    use_state_store(spark)
    at = lambda minute: f"2024-01-01 {10 + minute // 60:02d}:{minute % 60:02d}:00"
    files = [[(1, 0, "set"), (3, 1, "set")], [(2, 2, "set"), (200, 3, "undo")], [(201, 4, "redo")], [(5, 5, "set"), (202, 6, "redo")]]
    for part in files:
        df = spark.createDataFrame([(7, at(m), e, a, e) for m, e, a in part], "user_id long, ts string, event_id long, action string, color int")
        df.withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user_id long, ts timestamp, event_id long, action string, color int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    progress = []
    out = ed.newest(ed.run_available(ed.undo_redo_stream(stream, "10 minutes"), "update", "undo", progress), ["user_id"])
    (row,) = ed.describe_state(out).collect()
    # In event order 0, 2, 1, undo, redo, redo; colour 5 of minute 5 comes after the watermark has passed 03:10.
    assert (row["timeline"], row["current"]) == ("0,2,1", 1) and sum(p["dropped"] for p in progress) == 1


@pytest.mark.parametrize("kind", ["dedupe", "debounce"])
def test_sessions_close_in_append_mode(spark, log, kind):
    edits, late = log
    stream = ed.dedupe_edits(edits, late=late) if kind == "dedupe" else ed.debounce_stream(edits, "2 hours", late)
    progress = []
    out = ed.run_available(stream, "append", kind, progress)
    got = sorted(r["event_id"] for r in out.collect())
    if kind == "debounce":
        assert got == sorted(r["event_id"] for r in ed.debounce(fixtures.edits(spark, SF), 7200.0 - 1e-6).collect())
    else:
        assert len(got) == len(set(got)) and out.filter("user_id is null").count() == 0
    most = max(p["state"] for p in progress)
    assert sum(p["removed"] for p in progress) >= len(got) and progress[-1]["state"] <= 1 < most < len(got)
    assert len({r["batch"] for r in out.select("batch").distinct().collect()}) > 2


def test_recent_colours_expire(spark, tmp_path):
    use_state_store(spark)
    folder, root = str(tmp_path / "in"), str(tmp_path / "out")

    def arrive(*colors):
        table = [(1, f"2024-01-01 00:00:{c:02d}", c, "set", c, 0) for c in colors]
        df = spark.createDataFrame(table, EDIT.replace("timestamp", "string")).withColumn("ts", F.to_timestamp("ts"))
        df.coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(EDIT).parquet(folder)
        out = ed.run_available(ed.recent_colors_stream(stream, ttl_ms=20_000), "update", "recent", root=root, once=True)
        return [r["color"] for r in ed.newest(out, ["user_id"]).orderBy("rank").collect()]

    begun = time.time()
    assert arrive(1, 2) == [2, 1]
    time.sleep(max(0, 14 - (time.time() - begun)))
    assert arrive(3, 2) == [3, 2, 1]  # 2 was set before 1 expired, at the same event time: its life goes on
    time.sleep(max(0, 24 - (time.time() - begun)))
    assert arrive(4) == [4, 3]  # 1 and 2 are twenty seconds old


def test_coverage_counts_what_it_drops(spark):
    use_state_store(spark)
    stream, _ = ed.split_table_stream(spark, SF, "events", "ts", "event_id", 6, far=3)
    progress = []
    kept = ed.run_available(ed.stream_coverage(fixtures.edit_rows(stream), "6 hours", late="6 hours"), "update", "coverage", progress)
    total = ed.newest(kept, ["start", "color"]).agg(F.sum("n")).first()[0]
    assert 0 < sum(p["dropped"] for p in progress) <= 1000 - total


def test_users_share_state_keys(spark, tmp_path):
    """A call of a processor has a fixed price, so many users make few calls; their results stay apart."""
    use_state_store(spark)
    table = [(u if u % 7 else None, 1_000_000 * (100 * u + k), 10 * u + k, a, (u + k) % 5, 0) for u in range(300) for k, a in enumerate(["set", "set", "undo", "set", "redo"])]
    df = spark.createDataFrame(table, EDIT.replace("ts timestamp", "us long")).select("user_id", F.timestamp_micros("us").alias("ts"), "event_id", "action", "color", "payload")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(EDIT).parquet(str(tmp_path / "in"))
    known = df.filter("user_id is not null")
    for name, live, twin in (("recent", ed.recent_colors_stream(stream, buckets=4), ed.recent_colors(df)), ("undo", ed.undo_redo_stream(stream, "1 day", buckets=4), ed.undo_redo(known))):
        out = ed.run_available(live, "update", name).drop("batch")
        out = ed.describe_state(out) if name == "undo" else out.fillna(-1, ["user_id"])
        assert rows(out) == rows(twin.fillna(-1, ["user_id"]))


def test_large_micro_batches_have_several_files(spark, tmp_path, monkeypatch):
    use_state_store(spark)
    with monkeypatch.context() as m:
        m.setattr(ed, "scratch_path", lambda spark, name: str(tmp_path / name))
        stream, late = ed.split_table_stream(spark, SF, "events", "ts", "event_id", 4, "3 hours", file_rows=50)
    assert len(list((tmp_path / "split").glob("*.parquet"))) > 4 + 1
    progress = []
    out = ed.run_available(ed.undo_redo_stream(fixtures.edit_rows(stream), late), "update", "undo", progress)
    assert rows(ed.describe_state(ed.newest(out, ["user_id"]))) == rows(ed.undo_redo(fixtures.edits(spark, SF)))
    assert len([p for p in progress if p["rows"]]) == 5 and sum(p["rows"] for p in progress) == 1001 and sum(p["dropped"] for p in progress) == 0
