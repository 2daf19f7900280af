r"""Quotation linking for message threads.

A line that starts with ``>`` marks is quoted, as deep as it has marks; runs of lines
of one depth are passages.  Passages and messages are normalised alike (lower case,
white space squeezed) and hashed: the passage as a whole, and its longest line for
passages that quote only a part.  A passage links to the first message of its
conversation that says it (its whole own text, a paragraph of it, or a line) before
the quoting message.  A message replies to the latest message that its least deep
linked passages quote; replies form threads, named by the turn of their first message,
and ``(thread, turn)`` orders a conversation so that replies follow what they answer.
Messages come back without their quotes.

What messages say is counted before it is joined: one row per conversation and hash, so
a line that everyone repeats makes no large group, and a long conversation spreads over
all tasks.

Results: null text reads as empty; empty passages link to nothing; null conversations
and turns are a value of their own (the last) and come back null; rows of one
conversation and turn are one message for links, and each comes back; other columns are
ignored; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from chromatile.llm.text import NO_ID, public_id
from chromatile.session import materialize

MARKS = r"^[ \t]*(?:>[ \t]*)+"


def normal(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")))


def _hash(text: Column) -> Column:
    return F.when(text != "", F.md5(text))


def _depth(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 0), "[^>]", ""))


def messages(rows: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, lines, own)``: lines of each message, and its text without quoted lines."""
    known = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(NO_ID)).alias(c)
    lines = F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n", -1)
    out = rows.select(known("conv_id"), known("turn"), F.col("role").cast("string").alias("role"), lines.alias("lines"))
    return out.withColumn("own", F.array_join(F.filter("lines", lambda x: ~x.rlike(MARKS)), "\n"))


def quoted_passages(msgs: DataFrame) -> DataFrame:
    """``(conv_id, turn, depth, place, whole, longest)``: hashes of each quoted passage."""
    quoting = msgs.filter(F.exists("lines", lambda x: x.rlike(MARKS)))
    quoting = quoting.select("conv_id", "turn", F.md5(F.array_join("lines", "\n")).alias("_m"), "lines").distinct()
    lines = quoting.select("conv_id", "turn", "_m", F.posexplode("lines").alias("p", "line")).withColumn("depth", _depth(F.col("line")))
    order = Window.partitionBy("conv_id", "turn", "_m").orderBy("p")
    start = F.when(F.coalesce(F.lag("depth").over(order), F.lit(-1)) != F.col("depth"), 1).otherwise(0)
    lines = lines.withColumn("_start", start).withColumn("_run", F.sum("_start").over(order)).filter("depth > 0")
    body = normal(F.regexp_replace("line", MARKS, ""))
    pieces = lines.groupBy("conv_id", "turn", "_m", "depth", "_run").agg(
        F.min("p").alias("place"), F.array_sort(F.collect_list(F.struct("p", body.alias("s")))).alias("s"), F.max(F.struct(F.length(body).alias("n"), body.alias("s")))["s"].alias("l")
    )
    whole = normal(F.array_join(F.transform("s", lambda x: x["s"]), " "))
    return pieces.select("conv_id", "turn", "depth", "place", _hash(whole).alias("whole"), _hash(F.col("l")).alias("longest"))


def links(msgs: DataFrame, passages: DataFrame) -> DataFrame:
    """``(conv_id, turn, depth, place, source)``: the turn that said each passage first."""
    wanted = passages.select("conv_id", F.explode(F.array("whole", "longest")).alias("h")).filter("h is not null").distinct()
    units = F.array_union(F.array(F.col("own")), F.array_union(F.split("own", r"\n[ \t]*\n"), F.split("own", "\n")))
    said = msgs.select("conv_id", "turn", F.explode(F.array_distinct(F.transform(units, lambda u: _hash(normal(u))))).alias("h")).filter("h is not null")
    first = said.groupBy("conv_id", "h").agg(F.min("turn").alias("source")).join(wanted, ["conv_id", "h"], "left_semi")
    first = materialize(first, "said")
    out = passages
    for c in ("whole", "longest"):
        out = out.join(first.select("conv_id", F.col("h").alias(c), F.col("source").alias(f"_{c}")), ["conv_id", c], "left")
    before = lambda c: F.when(F.col(f"_{c}") < F.col("turn"), F.col(f"_{c}"))
    return out.select("conv_id", "turn", "depth", "place", F.coalesce(before("whole"), before("longest")).alias("source"))


def threads(replies: DataFrame) -> DataFrame:
    """``(conv_id, turn, thread)`` of replying messages from ``(conv_id, turn, reply_to)``, by pointer doubling."""
    at = materialize(replies.select("conv_id", "turn", F.col("reply_to").alias("thread")), "threads")
    while True:
        up = at.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("_up"))
        moved = at.join(up, ["conv_id", "thread"], "left").select("conv_id", "turn", F.coalesce("_up", "thread").alias("thread"), F.col("_up").isNotNull().alias("_moved"))
        moved = materialize(moved, "threads")
        at = moved.drop("_moved")
        if not moved.filter("_moved").limit(1).count():
            return at


def reply_ordered(rows: DataFrame) -> DataFrame:
    """One row per message: conv_id, thread, turn, reply_to, role, n_passages, n_linked and the text without quotes."""
    msgs = messages(rows)
    found = materialize(links(msgs, materialize(quoted_passages(msgs), "passages")), "quotes")
    best = F.max(F.when(F.col("source").isNotNull(), F.struct(-F.col("depth"), F.col("source"))))["source"]
    replies = materialize(found.groupBy("conv_id", "turn").agg(F.count("*").alias("n_passages"), F.count("source").alias("n_linked"), best.alias("reply_to")), "replies")
    top = threads(replies.filter("reply_to is not null"))
    out = msgs.select("conv_id", "turn", "role", "own").join(replies, ["conv_id", "turn"], "left").join(top, ["conv_id", "turn"], "left")
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(
        public_id("conv_id"), F.coalesce(F.when(F.col("thread") != NO_ID, F.col("thread")), F.when(F.col("turn") != NO_ID, F.col("turn"))).alias("thread"),
        public_id("turn"), "reply_to", "role", n("n_passages"), n("n_linked"), F.col("own").alias("text"),
    )
