"""Edit-log operators: coverage windows, debounce, undo and redo, recent colours."""

from __future__ import annotations

import bisect
import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from chromatile.operators.assign import assign_nearest
from chromatile.session import materialize, scratch_path

# Depth of the undo stack and of the colour history.
DEPTH = 20


def read_table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """File stream over one of the test tables."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def arrivals(table: DataFrame, order: str, key: str, files: int, far: int = 1) -> tuple[DataFrame, int]:
    """``table`` with ``part``, the file that each row arrives in, and the microseconds of a file.

    Files follow ``order``, but rows whose ``key`` is divisible by five come one file late,
    and those divisible by 35 ``far`` files.
    """
    at = F.unix_micros(F.col(order).cast("timestamp"))
    lo, hi = table.agg(F.min(at), F.max(at)).first()
    step = ((hi or 0) - (lo or 0)) // files + 1
    part = F.floor((at - F.lit(lo or 0)) / step) + F.when(F.col(key) % 35 == 0, far).when(F.col(key) % 5 == 0, 1).otherwise(0)
    return table.withColumn("part", F.least(F.lit(files - 1), F.coalesce(part, F.lit(0))).cast("int")), step


def split_table_stream(
    spark: SparkSession, sf_dir: str, name: str, order: str, key: str, files: int = 8, beat: str | None = None, far: int = 1, file_rows: int = 500_000
) -> tuple[DataFrame, str]:
    """The table as a stream of several files, one micro-batch each, and a lateness that drops no row.

    With ``beat`` a last file holds one row, null but for its time, that moves the watermark
    ``beat`` past all others: a heartbeat.  From twice ``file_rows`` rows a micro-batch on, its
    rows are dealt over several files, as many in each micro-batch, so no task writes them all.
    """
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    parts, step = arrivals(table, order, key, files, far)
    sizes = [r["count"] for r in parts.groupBy("part").count().collect()]  # a number a micro-batch
    each = max(1, min(sizes) // file_rows) if len(sizes) == files else 1
    root = scratch_path(spark, "split")
    for k in range(files):  # the stream takes files by age
        rows = parts.filter(F.col("part") == k).drop("part")
        (rows.repartition(each) if each > 1 else rows.coalesce(1)).write.mode("append").parquet(root)
    if beat:
        after = (F.max(order) + F.expr(f"INTERVAL {beat}") + F.make_dt_interval(secs=F.lit(far * step / 1e6 + 1))).alias(order)
        last = [F.col(f.name) if f.name == order else F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema]
        table.agg(after).select(*last).coalesce(1).write.mode("append").parquet(root)
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", each).parquet(root), f"{far * step} microseconds"


def run_available(stream: DataFrame, mode: str = "append", name: str = "stream", progress: list[dict] | None = None, root: str | None = None, once: bool = False) -> DataFrame:
    """Drain a stream into a table in the shared folder and return the table.

    Each micro-batch is written to a folder of its own, replaced on a retry, and
    carries ``batch``, so update-mode readers can keep the newest row per key.
    ``progress`` receives per micro-batch its rows and the state rows kept, removed and
    dropped as too late.  A run with the ``root`` of an earlier one goes on where it ended.
    ``once`` takes all that is there in one micro-batch: state that expires by processing
    time always has another batch to run, and would not let the drain end.
    """
    spark = stream.sparkSession
    root = root or scratch_path(spark, name)

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{root}/rows/batch={batch}")

    q = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(**({"once": True} if once else {"availableNow": True}))
        .foreachBatch(write)
        .start()
    )
    q.awaitTermination()
    for p in map(json.loads, [p.json for p in q.recentProgress] if progress is not None else []):
        kept = {"numRowsTotal": 0, "numRowsRemoved": 0, "numRowsDroppedByWatermark": 0}
        for op in p["stateOperators"]:
            kept = {k: n + op[k] for k, n in kept.items()}
        progress.append({"batch": p["batchId"], "rows": p["numInputRows"], "state": kept["numRowsTotal"], "removed": kept["numRowsRemoved"], "dropped": kept["numRowsDroppedByWatermark"]})
    return spark.read.option("basePath", f"{root}/rows").schema(f"{_ddl(stream)}, batch int").parquet(f"{root}/rows")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def stream_label(stream: DataFrame, centers, weights=None) -> DataFrame:
    """Label arriving pixels with a frozen model; a projection, so it holds no state."""
    return assign_nearest(stream, centers, weights)


def stream_coverage(edits: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Edits per window and colour; rows later than ``late`` behind the stream are dropped."""
    span = F.window("ts", size, slide) if slide else F.window("ts", size)
    return (
        edits.withWatermark("ts", late)
        .groupBy(span.alias("win"), "color")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("win.start").alias("start"), F.col("win.end").alias("end"), "color", "n")
    )


def debounce_stream(edits: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """Last event of every burst whose gaps stay within ``gap``.

    In append mode a burst is emitted, and its state let go, when the watermark has passed
    its end; rows without a user are heartbeats and close bursts of others.
    """
    last = F.max_by(F.struct("ts", "event_id", "action", "color"), F.struct("ts", "event_id"))
    return (
        edits.withWatermark("ts", late)
        .groupBy("user_id", F.session_window("ts", gap).alias("burst"))
        .agg(last.alias("e"))
        .select("user_id", "e.*")
    )


def debounce(edits: DataFrame, gap_seconds: float, bucket_seconds: float = 86400.0) -> DataFrame:
    """Batch twin: events with no successor within the gap.

    A user's log is cut into time buckets, so a huge user spreads over tasks; the
    last event of a bucket looks at the first one of the user's next bucket, found
    on one row per bucket.
    """
    t = F.unix_micros("ts")
    b = edits.withColumns({"_t": t, "_b": F.floor(t / F.lit(bucket_seconds * 1e6))})
    firsts = b.groupBy("user_id", "_b").agg(F.min("_t").alias("_first"))
    after = firsts.withColumn("_after", F.lead("_first").over(Window.partitionBy("user_id").orderBy("_b"))).drop("_first")
    order = Window.partitionBy("user_id", "_b").orderBy("_t", "event_id")
    j = b.withColumn("_next", F.lead("_t").over(order)).join(after, ["user_id", "_b"])
    nxt = F.coalesce("_next", "_after")
    last = nxt.isNull() | (nxt - F.col("_t") > F.lit(gap_seconds * 1e6))
    return j.filter(last).select("user_id", "ts", "event_id", "action", "color")


def dedupe_edits(edits: DataFrame, gap: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Drop an edit if the same user made an identical one less than ``gap`` before it (streaming).

    Identical edits form sessions by event time, and the first of each stays, so the
    answer does not depend on how the stream is cut into batches.  In append mode a
    session is emitted, and its state let go, when the watermark has passed its end; rows
    without a user are heartbeats.
    """
    first = F.min(F.struct("ts", "event_id", "payload"))
    return (
        edits.withWatermark("ts", late)
        .groupBy("user_id", "action", "color", F.session_window("ts", gap).alias("burst"))
        .agg(first.alias("e"))
        .select("user_id", "action", "color", "e.*")
    )


def recent_colors(edits: DataFrame, limit: int = DEPTH) -> DataFrame:
    """Last distinct colours per user, newest first.

    Colours combine before the ranking, which then sees one row per user and colour.
    """
    latest = edits.filter("action = 'set'").groupBy("user_id", "color").agg(F.max(F.struct("ts", "event_id")).alias("m"))
    order = Window.partitionBy("user_id").orderBy(F.col("m.ts").desc(), F.col("m.event_id").desc())
    return (
        latest.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= limit)
        .select("user_id", "rank", "color", F.col("m.ts").alias("ts"))
    )


# --- undo and redo -------------------------------------------------------------
# A user's state is a timeline of at most DEPTH + 1 colours and a position in it:
# what lies before the position can be undone, what lies after can be redone.


def step(line: list[int], pos: int, action: str, color: int) -> tuple[list[int], int]:
    """One edit applied to a timeline; ``pos`` counts from 1, 0 means nothing was set."""
    if action == "undo":
        return line, max(min(pos, 1), pos - 1)
    if action == "redo":
        return line, min(len(line), pos + 1)
    if pos and line[pos - 1] == color:
        return line, pos
    line = [*line[:pos], color][-(DEPTH + 1):]
    return line, len(line)


def _stepped(state: Column, edit: Column) -> Column:
    """``step`` as a column expression on ``struct(line, pos)``."""
    line, pos, color = state["line"], state["pos"], edit["color"]
    known = (pos > 0) & (F.get(line, pos - 1) == color)
    grown = F.slice(F.concat(F.slice(line, F.lit(1), pos), F.array(color)), F.greatest(F.lit(1), pos + 1 - DEPTH), F.lit(DEPTH + 1))
    pushed = F.struct(grown.alias("line"), F.least(pos + 1, F.lit(DEPTH + 1)).alias("pos"))
    moved = F.when(edit["action"] == "undo", F.greatest(F.least(pos, F.lit(1)), pos - 1)).otherwise(F.least(F.size(line), pos + 1))
    return F.when(edit["action"] != "set", F.struct(line.alias("line"), moved.alias("pos"))).when(known, state).otherwise(pushed)


def undo_redo(edits: DataFrame, chunk_rows: int = 4096, task_rows: int = 200_000) -> DataFrame:
    """Final state per user after folding set, undo and redo in (ts, event_id) order.

    The fold is sequential per user, yet no user is folded in one task: the log is
    range-sorted over tasks of about ``task_rows`` and cut into chunks of at most
    ``chunk_rows`` edits.  All chunks fold at once from a guessed entry state; a
    chunk whose predecessor ended elsewhere folds again, until no entry state changes.
    A fold forgets its entry after some twenty edits, so this takes a few rounds, and
    the end result is exact.
    """
    log = edits.filter(F.col("action").isin("set", "undo", "redo"))
    log = materialize(log.select("user_id", "ts", "event_id", "action", F.col("color").cast("int").alias("color")), "log")
    order = ["user_id", "ts", "event_id"]
    spread = log.repartitionByRange(max(1, math.ceil(log.count() / task_rows)), *order).sortWithinPartitions(*order)
    place = F.floor(F.monotonically_increasing_id() / F.lit(chunk_rows))
    edit = F.struct("ts", "event_id", "action", "color")
    cut = spread.withColumn("chunk", place).groupBy("user_id", "chunk").agg(F.sort_array(F.collect_list(edit)).alias("edits"))
    cut = materialize(cut, "chunks")
    prev = F.lag("chunk").over(Window.partitionBy("user_id").orderBy("chunk"))
    chunks = materialize(cut.select("user_id", "chunk", prev.alias("prev")), "order")
    start = F.struct(F.array().cast("array<int>").alias("line"), F.lit(0).alias("pos"))
    entry = chunks.select("user_id", "chunk", start.alias("s"))
    todo, exits = entry, None
    while True:
        out = cut.join(todo, ["user_id", "chunk"]).select("user_id", "chunk", F.aggregate("edits", F.col("s"), _stepped).alias("s"))
        if exits is not None:
            out = exits.join(todo, ["user_id", "chunk"], "left_anti").unionByName(out)
        exits = materialize(out, "exits")
        before = exits.select("user_id", F.col("chunk").alias("prev"), "s")
        want = chunks.filter("prev is not null").join(before, ["user_id", "prev"]).select("user_id", "chunk", "s")
        changed = want.join(entry.withColumnRenamed("s", "_used"), ["user_id", "chunk"]).filter(F.col("s") != F.col("_used"))
        todo = materialize(changed.drop("_used"), "redo")
        if todo.limit(1).count() == 0:
            break
        entry = materialize(entry.join(todo, ["user_id", "chunk"], "left_anti").unionByName(todo), "entry")
    last = exits.groupBy("user_id").agg(F.max_by("s", "chunk").alias("s"))
    return describe_state(last.select("user_id", "s.line", "s.pos"))


def describe_state(states: DataFrame) -> DataFrame:
    """Current colour (-1 when none) and stack depths of ``(user_id, line, pos)``."""
    current = F.coalesce(F.get("line", F.col("pos") - 1), F.lit(-1))
    return states.select(
        "user_id",
        F.when(F.col("pos") > 0, current).otherwise(-1).alias("current"),
        F.greatest(F.lit(0), F.col("pos") - 1).alias("undo_depth"),
        (F.size("line") - F.col("pos")).alias("redo_depth"),
        F.array_join("line", ",").alias("timeline"),
    )


# Users that share a state key: a call for one key costs about ten milliseconds whatever it
# holds, so users are dealt over keys by hash, and a call takes all edits of its users.
BUCKETS = 1024


def _bucket(buckets: int) -> Column:
    """State key of a user; rows without a user have one of their own."""
    return F.when(F.col("user_id").isNull(), -1).otherwise(F.pmod(F.xxhash64("user_id"), F.lit(buckets))).cast("int").alias("bucket")


class _UndoProcessor(StatefulProcessor):
    """Keeps one bounded timeline per user of a bucket, and the edits that the watermark has not passed."""

    def __init__(self, kind: str):
        self.kind = kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getListState("timelines", f"user_id {self.kind}, line array<int>, pos int")
        self.waiting = handle.getListState("waiting", f"us long, event_id long, user_id {self.kind}, action string, color int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if key[0] < 0:
            return
        new = []
        for part in rows:
            new += zip(*[part[c].tolist() for c in ("us", "event_id", "user_id", "action", "color")])
        yield self._fold(new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._fold([], timerValues.getCurrentWatermarkInMs())

    def _fold(self, new: list[tuple], watermark: int) -> pd.DataFrame:
        """Fold what the watermark has passed for good, and show the touched users with the rest on top."""
        waiting = [tuple(e) for e in self.waiting.get()] if self.waiting.exists() else []
        lines = {user: (line, pos) for user, line, pos in self.state.get()} if self.state.exists() else {}
        edits = sorted(waiting + new)
        settled = bisect.bisect_left(edits, (watermark * 1000,))
        rest = edits[settled:]
        for _, _, user, action, color in edits[:settled]:
            lines[user] = step(*lines.get(user, ([], 0)), action, color)
        if settled:
            self.state.put([(user, *line) for user, line in lines.items()])
            if waiting:
                self.waiting.clear()
            if rest:
                self.waiting.put(rest)
        elif new:
            self.waiting.appendList(new)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if rest:
            self.handle.registerTimer(rest[0][0] // 1000 + 1)
        shown = {e[2]: lines.get(e[2], ([], 0)) for e in (new or edits[:settled])}
        for _, _, user, action, color in rest:
            if user in shown:
                shown[user] = step(*shown[user], action, color)
        return pd.DataFrame({"user_id": list(shown), "line": [s[0] for s in shown.values()], "pos": [s[1] for s in shown.values()]})

    def close(self) -> None:
        pass


def undo_redo_stream(edits: DataFrame, late: str = "10 minutes", buckets: int = BUCKETS) -> DataFrame:
    """State after each micro-batch, in event order: ``(user_id, line, pos)`` for users it touched.

    Edits wait in the state until the watermark has passed them, so that they are folded in
    the order of (ts, event_id) however they arrive; what waits is limited by ``late``, and
    later edits are dropped.  A row shows the waiting edits folded too, as far as they are
    known.  Rows without a user are heartbeats.  Users share ``buckets`` state keys.
    """
    kind = dict(edits.dtypes)["user_id"]
    useful = edits.withWatermark("ts", late).filter(F.col("action").isin("set", "undo", "redo") | F.col("ts").isNull())
    useful = useful.select(_bucket(buckets), "user_id", "ts", F.unix_micros("ts").alias("us"), "event_id", "action", "color")
    return useful.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=_UndoProcessor(kind), outputStructType=f"user_id {kind}, line array<int>, pos int", outputMode="Update", timeMode="EventTime"
    )


class _RecentProcessor(StatefulProcessor):
    """Keeps the newest colours of each user of a bucket; with a time-to-live old entries expire."""

    def __init__(self, kind: str, limit: int, ttl_ms: int | None):
        self.kind, self.limit, self.ttl_ms = kind, limit, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getListState("seen", f"user_id {self.kind}, color array<int>, us array<long>, event_id array<long>, until array<long>")

    def _alive(self, now: int) -> tuple[dict, bool]:
        """Per user the entries ``color: (us, event_id, until)`` that have not expired, and whether any has."""
        seen, expired = {}, False
        for user, *entries in self.state.get() if self.state.exists() else []:
            alive = {c: at for c, *at in zip(*entries) if not self.ttl_ms or at[2] > now}
            expired |= len(alive) < len(entries[0])
            if alive:
                seen[user] = alive
        return seen, expired

    def _keep(self, seen: dict) -> None:
        if seen:
            self.state.put([(user, list(of), *map(list, zip(*of.values()))) for user, of in seen.items()])
        else:
            self.state.clear()
        if self.ttl_ms:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            if seen:
                self.handle.registerTimer(min(at[2] for of in seen.values() for at in of.values()))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs() if self.ttl_ms else 0
        until = now + (self.ttl_ms or 0)
        seen, changed = self._alive(now)
        touched = {}
        for part in rows:
            users = part["user_id"].tolist() if key[0] >= 0 else [None] * len(part)
            for user, color, us, event in zip(users, *[part[c].tolist() for c in ("color", "us", "event_id")]):
                of = touched[user] = seen.setdefault(user, {})
                # An entry's time-to-live begins anew only if it is set again, later than before.
                if color not in of or (us, event) > tuple(of[color][:2]):
                    of[color] = [us, event, until]
                    changed = True
            # Only the newest few can still matter, so the buffer stays bounded.
            for of in touched.values():
                for old in sorted(of, key=of.get, reverse=True)[self.limit :]:
                    del of[old]
        if changed:
            self._keep(seen)
        ranked = [(user, rank, c, of[c][0]) for user, of in touched.items() for rank, c in enumerate(sorted(of, key=of.get, reverse=True), 1)]
        yield pd.DataFrame(ranked, columns=["user_id", "rank", "color", "us"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        seen, expired = self._alive(timerValues.getCurrentProcessingTimeInMs())
        if expired:
            self._keep(seen)
        return iter(())

    def close(self) -> None:
        pass


def recent_colors_stream(edits: DataFrame, limit: int = DEPTH, ttl_ms: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Streaming ``recent_colors``: the list of every user a micro-batch touched.

    With ``ttl_ms`` a colour leaves the list that long (of processing time) after it was set last.
    Users share ``buckets`` state keys.
    """
    kind = dict(edits.dtypes)["user_id"]
    sets = edits.filter("action = 'set'").select(_bucket(buckets), "user_id", F.unix_micros("ts").alias("us"), "event_id", "color")
    lists = sets.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=_RecentProcessor(kind, limit, ttl_ms), outputStructType=f"user_id {kind}, rank int, color int, us long",
        outputMode="Update", timeMode="ProcessingTime" if ttl_ms else "None",
    )
    return lists.select("user_id", "rank", "color", F.timestamp_micros("us").alias("ts"))


def newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the newest micro-batch per key."""
    top = rows.groupBy(*keys).agg(F.max("batch").alias("batch"))
    return rows.join(top, [*keys, "batch"], "left_semi").drop("batch")
