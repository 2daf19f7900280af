"""Image sizes and stride probes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def dims(pixels: DataFrame) -> DataFrame:
    """Width and height per image."""
    return pixels.groupBy("image_id").agg(
        (F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h")
    )


# Parts that the pixels of one image are dealt over when they meet a row of their image.
SPREAD = 32


def beside(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Join of pixel rows with a table of one row per image, when both can be large.

    Rows of small files can take a hundred times their bytes, and a join planned by file
    size would send them through the driver.  The hint keeps them on the executors, and
    the rows of one image are dealt over parts by their line, so none is a task of its own.
    """
    copies = table.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))))
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64("y"), F.lit(SPREAD)))
    return dealt.join(copies.hint("merge"), ["image_id", "_part"]).drop("_part")


def with_dims(pixels: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Add ``w`` and ``h``.  Pass known sizes to save the extra scan."""
    return pixels.join(dims(pixels) if sizes is None else sizes, "image_id")


def stride(w: Column, h: Column, edge: int) -> Column:
    """Step that brings the long side near ``edge`` pixels."""
    return F.greatest(F.lit(1.0), F.rint(F.greatest(w, h) / F.lit(float(edge)))).cast("int")


def probe(pixels: DataFrame, edge: int | None = None, above: int | None = None) -> DataFrame:
    """All pixels, or with ``edge`` every ``step``-th of both axes, re-indexed, with the source size kept.

    Adds ``w``/``h`` (probe size), ``full_w``/``full_h`` and ``step``.  Images whose
    long side is at most ``above`` (default ``edge``) are kept whole.
    """
    sized = with_dims(pixels)
    if edge is None:
        return sized.withColumns({"full_w": F.col("w"), "full_h": F.col("h"), "step": F.lit(1)})
    limit = edge if above is None else above
    step = F.when(F.greatest("w", "h") <= limit, 1).otherwise(stride(F.col("w"), F.col("h"), edge))
    out = sized.withColumn("step", step).filter((F.col("x") % F.col("step") == 0) & (F.col("y") % F.col("step") == 0))
    other = [c for c in pixels.columns if c not in ("x", "y")]
    return out.select(
        *other,
        F.floor(F.col("x") / F.col("step")).cast("int").alias("x"),
        F.floor(F.col("y") / F.col("step")).cast("int").alias("y"),
        F.ceil(F.col("w") / F.col("step")).cast("int").alias("w"),
        F.ceil(F.col("h") / F.col("step")).cast("int").alias("h"),
        F.col("w").alias("full_w"),
        F.col("h").alias("full_h"),
        "step",
    )
