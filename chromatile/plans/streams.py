"""Streaming queries; each drains a file stream over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from chromatile import fixtures
from chromatile.plans import common, duck
from chromatile.plans.registry import query
from chromatile.session import use_state_store
from chromatile.streaming import edits as ed

EDITS = duck.EDITS
FILES = 6


def _edit_stream(spark, sf, beat=None, far=1):
    """Edits in several files with late rows, and the lateness that drops none."""
    use_state_store(spark)
    stream, late = ed.split_table_stream(spark, sf, "events", "ts", "event_id", FILES, beat, far)
    return fixtures.edit_rows(stream), late


@query("stream_label", duck.with_(common.LABELLED) + "SELECT image_id, l_orderkey, l_linenumber, label FROM labelled")
def stream_label(spark, sf):
    px = fixtures.px_rows(ed.read_table_stream(spark, sf, "lineitem"))
    out = ed.stream_label(px, common.CENTERS, common.WEIGHTS).select("image_id", "l_orderkey", "l_linenumber", "label")
    return ed.run_available(out, "append", "labels").drop("batch")


@query("stream_coverage", duck.with_(EDITS) + """
SELECT 'tumbling' AS kind, time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS start, color, count(*)::BIGINT AS n FROM edits GROUP BY ALL
UNION ALL SELECT 'sliding', time_bucket(INTERVAL '3 hours', ts, TIMESTAMP '1970-01-01') - to_hours(3*o) AS start, color, count(*) FROM edits, (SELECT unnest([0,1]) AS o) GROUP BY ALL""")
def stream_coverage(spark, sf):
    parts, (edits, late) = [], _edit_stream(spark, sf)
    for kind, slide in (("tumbling", None), ("sliding", "3 hours")):
        rows = ed.run_available(ed.stream_coverage(edits, "6 hours", slide, late), "update", "coverage")
        parts.append(ed.newest(rows, ["start", "color"]).select(F.lit(kind).alias("kind"), fixtures.zoneless("start"), "color", "n"))
    return parts[0].unionByName(parts[1])


# Arrival in files as ``arrivals`` deals it; a micro-batch drops what the watermark of the batch before the last has closed.
@query("stream_coverage_late", duck.with_(EDITS, f"""
st AS (SELECT min(epoch_us(ts)) AS lo, (max(epoch_us(ts)) - min(epoch_us(ts))) // {FILES} + 1 AS step FROM edits),
ar AS (SELECT edits.*, least({FILES - 1}, (epoch_us(ts) - lo) // step + CASE WHEN event_id % 35 = 0 THEN 3 WHEN event_id % 5 = 0 THEN 1 ELSE 0 END) AS part FROM edits, st),
tops AS (SELECT part, max(epoch_ms(ts)) AS top FROM ar GROUP BY part),
marks AS (SELECT p.part, coalesce(max(t.top), 0) - 6*3600*1000 AS mark FROM tops p LEFT JOIN tops t ON t.part < p.part - 1 GROUP BY p.part),
judged AS (SELECT time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS start, color, ar.part,
  epoch_ms(time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01')) + 6*3600*1000 <= mark AS late FROM ar JOIN marks USING (part))""") + """
SELECT 'kept' AS kind, start, color, count(*)::BIGINT AS n FROM judged WHERE NOT late GROUP BY ALL
UNION ALL SELECT 'dropped', NULL, NULL, count(DISTINCT (part, start, color)) FROM judged WHERE late""")
def stream_coverage_late(spark, sf):
    progress = []
    edits, _ = _edit_stream(spark, sf, far=3)
    rows = ed.run_available(ed.stream_coverage(edits, "6 hours", late="6 hours"), "update", "coverage", progress)
    kept = ed.newest(rows, ["start", "color"]).select(F.lit("kept").alias("kind"), fixtures.zoneless("start"), "color", "n")
    dropped = F.lit(sum(p["dropped"] for p in progress)).cast("long").alias("n")
    lost = spark.range(1).select(F.lit("dropped").alias("kind"), F.lit(None).cast("timestamp_ntz").alias("start"), F.lit(None).cast("int").alias("color"), dropped)
    return kept.unionByName(lost)


@query("debounce", duck.with_(EDITS) + """
SELECT user_id, ts, event_id, action, color FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx FROM edits) WHERE nx IS NULL OR nx - ts > INTERVAL '2 hours'""")
def debounce(spark, sf):
    return ed.debounce(fixtures.edits(spark, sf), 7200.0).withColumn("ts", fixtures.zoneless("ts"))


_RECENT = duck.with_(EDITS, "l AS (SELECT user_id, color, max((ts, event_id)) AS m, max(ts) AS ts FROM edits WHERE action = 'set' GROUP BY ALL)") + """
SELECT user_id, rank::INT AS rank, color, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY m DESC) AS rank FROM l) WHERE rank <= 20"""


@query("recent_colors", _RECENT)
def recent_colors(spark, sf):
    return ed.recent_colors(fixtures.edits(spark, sf)).withColumn("ts", fixtures.zoneless("ts"))


@query("recent_colors_stream", _RECENT)
def recent_colors_stream(spark, sf):
    rows = ed.run_available(ed.recent_colors_stream(_edit_stream(spark, sf)[0]), "update", "recent")
    return ed.newest(rows, ["user_id"]).select("user_id", "rank", "color", fixtures.zoneless("ts"))


_UNDO = duck.with_(EDITS, """
ev AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM edits WHERE action IN ('set','undo','redo')),
st AS (SELECT user_id, 0::BIGINT AS i, []::INT[] AS tl, 0::BIGINT AS pos FROM (SELECT DISTINCT user_id FROM ev)
 UNION ALL SELECT st.user_id, ev.i,
  CASE WHEN action <> 'set' OR (pos > 0 AND tl[pos] = color) THEN tl ELSE CASE WHEN pos >= 21 THEN list_append(tl[2:pos], color) ELSE list_append(tl[1:pos], color) END END,
  CASE WHEN action = 'undo' THEN greatest(least(pos, 1), pos-1) WHEN action = 'redo' THEN least(len(tl), pos+1) WHEN pos > 0 AND tl[pos] = color THEN pos ELSE least(21, pos+1) END
 FROM st JOIN ev ON ev.user_id = st.user_id AND ev.i = st.i + 1),
la AS (SELECT user_id, arg_max(tl, i) AS tl, arg_max(pos, i) AS pos FROM st GROUP BY ALL)""", recursive=True) + """
SELECT user_id, (CASE WHEN pos > 0 THEN tl[pos] ELSE -1 END)::INT AS current, greatest(0, pos-1)::INT AS undo_depth, (len(tl)-pos)::INT AS redo_depth,
 coalesce(array_to_string(tl, ','), '') AS timeline FROM la"""


@query("undo_redo", _UNDO)
def undo_redo(spark, sf):
    return ed.undo_redo(fixtures.edits(spark, sf))


@query("undo_redo_stream", _UNDO)
def undo_redo_stream(spark, sf):
    rows = ed.run_available(ed.undo_redo_stream(*_edit_stream(spark, sf)), "update", "undo")
    return ed.describe_state(ed.newest(rows, ["user_id"]))


@query("dedupe_edits", duck.with_(EDITS) + """
SELECT user_id, action, color, ts, event_id, payload FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id, action, color ORDER BY ts, event_id) AS before FROM edits)
WHERE before IS NULL OR ts - before >= INTERVAL '1 hour'""")
def dedupe_edits(spark, sf):
    edits, late = _edit_stream(spark, sf, "2 hours")
    return ed.run_available(ed.dedupe_edits(edits, late=late), "append", "dedupe").drop("batch").withColumn("ts", fixtures.zoneless("ts"))


@query("debounce_stream", duck.with_(EDITS) + """
SELECT user_id, ts, event_id, action, color FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx FROM edits) WHERE nx IS NULL OR nx - ts >= INTERVAL '2 hours'""")
def debounce_stream(spark, sf):
    edits, late = _edit_stream(spark, sf, "3 hours")
    return ed.run_available(ed.debounce_stream(edits, "2 hours", late), "append", "debounce").drop("batch").withColumn("ts", fixtures.zoneless("ts"))
