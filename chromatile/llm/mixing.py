"""Mixing sources to target weights by capped water-filling.

Each source has a weight and a cap of so many epochs of its own size.  The budget is
shared by weight; sources above their cap are clamped to it, and the excess goes to
the others by weight, round by round, until no share is above its cap.  A source then
gives whole repetitions of all its documents, and a fractional one: its documents in
the order of a seeded hash, up to the share that is missing (a document is taken if
at least half of it fits).  Built-in functions only.

The order within a source is never sorted as a whole: hash buckets are summed, and
only the one bucket per source that holds the boundary is ordered.

Results: a null or empty text has size 0 and is never taken; a null source is a
source of its own, the last; a source without words has target 0; repeated rows of
one doc_id are ordered by size and text; other columns are kept if asked for;
empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from chromatile.llm.text import NO_ID
from chromatile.session import materialize

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 2
#: The budget as a fraction of all sizes: 150 %.
SHARE = (3, 2)
SEED = "mix-1"
BUCKET_DIGITS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, share: tuple[int, int] = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Add ``target`` to ``(source, source_size, weight)``.

    Only two sums per round reach the driver.  They are exact integers, so a target
    is rounded once.
    """
    total, weights = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    budget = (total or 0) * share[0]  # in units of 1 / share[1] words
    cap = F.col("source_size") * max_epochs
    rest, weight, clamped = budget, weights or 0, -1
    over = F.lit(False)
    while True:
        over = cap * share[1] * F.lit(weight) <= F.lit(rest) * F.col("weight") if weight else F.lit(True)
        n, caps, used = sources.filter(over).agg(F.count("*"), F.sum(cap), F.sum("weight")).first()
        if n == clamped or not weight:
            break
        clamped = n
        rest, weight = max(0, budget - (caps or 0) * share[1]), (weights or 0) - (used or 0)
    level = (F.lit(rest) * F.col("weight")).cast("double") / F.lit(max(1, weight) * share[1]).cast("double")
    return sources.withColumn("target", F.when(over, cap.cast("double")).otherwise(level))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: tuple[int, int] = SHARE, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """Per row: doc_id, size, source, source_size, target, repeats, taken and the key of the row."""
    source, doc = F.col("source").cast("string"), F.col("doc_id").cast("long")
    rows = docs.select(
        doc.alias("doc_id"),
        source.alias("source"),
        word_count(F.col("text").cast("string")).alias("size"),
        F.xxhash64(F.col("text").cast("string")).alias("_text"),
        F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(doc, F.lit(NO_ID)).cast("string"))).alias("_order"),
    ).withColumn("_bucket", F.substring("_order", 1, BUCKET_DIGITS))
    rows = materialize(rows, "sizes")
    buckets = materialize(rows.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum")), "buckets")
    by_source = buckets.groupBy("source").agg(F.sum("_sum").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (rank % len(weights) + 1).cast("int"))
    sources = materialize(by_source.withColumn("weight", weight), "sources")
    filled = materialize(water_fill(sources, share, max_epochs), "targets")
    size, target = F.col("source_size"), F.col("target")
    filled = filled.withColumn("_whole", F.when(size > 0, F.floor(target / size)).otherwise(0).cast("int"))
    filled = filled.withColumn("_part", F.greatest(target - F.col("_whole") * size, F.lit(0.0)))
    below = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("_sum").over(below), F.lit(0))
    same = F.col("source").eqNullSafe(F.col("_source"))
    cut = buckets.withColumn("_start", start).join(filled.withColumnRenamed("source", "_source"), same).drop("_source")
    cut = cut.withColumn("_inside", F.col("_start") + F.col("_sum") <= F.col("_part")).withColumn("_edge", ~F.col("_inside") & (F.col("_start") < F.col("_part")))
    cut = materialize(cut.withColumnsRenamed({"source": "_source", "_bucket": "_b"}), "cut")
    joined = rows.join(cut, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_bucket") == F.col("_b")))
    sums = Window.partitionBy("source", "_bucket", "_edge").orderBy("_order", "size", "_text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = joined.filter("_edge").withColumn("_until", F.col("_start") + F.sum("size").over(sums))
    plain = joined.filter("not _edge").withColumn("_until", F.lit(None).cast("long"))
    fits = F.col("_until") - F.col("size") / 2 <= F.col("_part")
    extra = F.when(F.col("_edge"), fits).otherwise(F.col("_inside")) & (F.col("size") > 0)
    repeats = F.when(F.col("size") > 0, F.col("_whole") + extra.cast("int")).otherwise(0)
    repeats = F.least(repeats, F.lit(max_epochs))
    return plain.unionByName(edge).select(
        "doc_id", "source", "size", "source_size", "target", repeats.cast("int").alias("repeats"), (repeats * F.col("size")).cast("long").alias("taken"), "_text"
    )


def repeat_documents(docs: DataFrame, **settings) -> DataFrame:
    """The mixed corpus itself: each document as often as it is taken, numbered by ``copy``."""
    taken = mix(docs, **settings).filter("repeats > 0")
    taken = taken.groupBy(F.coalesce("doc_id", F.lit(NO_ID)).alias("_id"), F.col("_text").alias("_hash"), "source").agg(F.max("repeats").alias("_repeats"))
    taken = taken.withColumnRenamed("source", "_source")
    same = (
        (F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)) == taken["_id"])
        & (F.xxhash64(docs["text"].cast("string")) == taken["_hash"])
        & docs["source"].cast("string").eqNullSafe(taken["_source"])
    )
    columns = [docs[c] for c in docs.columns if c != "copy"]
    return docs.join(taken, same).select(*columns, F.explode(F.sequence(F.lit(1), taken["_repeats"])).alias("copy"))
