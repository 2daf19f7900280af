"""Neighbourhood operators on dense rasters.

Stencils are separable window passes.  A window covers one line of one block of
an image, not a whole line: each block carries copies of the ``radius`` lines on
either side, so a raster of any height splits into bounded window partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from chromatile.functions import color as C
from chromatile.operators import frame
from chromatile.session import materialize

BLOCK = 512


def along(df: DataFrame, axis: str, radius: int, block: int = BLOCK) -> tuple[DataFrame, Window]:
    """Blocked copy of ``df`` and the window that runs along ``axis`` inside a block.

    Only rows with ``_own`` are results; the rest are neighbours copied from the
    adjoining blocks.
    """
    block = max(block, radius)
    other = "y" if axis == "x" else "x"
    at = F.col(axis)
    home = F.floor(at / block)
    inside = at - home * block
    copies = F.array_compact(
        F.array(
            home,
            F.when(inside < radius, home - 1),
            F.when(inside >= block - radius, home + 1),
        )
    )
    out = df.withColumn("_blk", F.explode(copies)).withColumn("_own", F.col("_blk") == F.floor(at / block))
    return out, Window.partitionBy("image_id", other, "_blk").orderBy(axis)


def _done(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.filter("_own").select(*columns)


def box_mean(pixels: DataFrame, radius: int, value: str = "v", out: str = "mean", block: int = BLOCK) -> DataFrame:
    """Local mean over (2r+1)^2 pixels with replicated edges."""
    r = max(1, int(radius))
    cols = pixels.columns

    def line(df: DataFrame, axis: str, src: str, dst: str, keep: list[str]) -> DataFrame:
        b, w = along(df, axis, r, block)
        total = F.sum(src).over(w.rowsBetween(-r, r))
        before = F.count(F.lit(1)).over(w.rowsBetween(-r, 0)) - 1
        after = F.count(F.lit(1)).over(w.rowsBetween(0, r)) - 1
        first = F.first(src).over(w.rowsBetween(-r, 0))
        last = F.last(src).over(w.rowsBetween(0, r))
        return _done(b.withColumn(dst, total + (r - before) * first + (r - after) * last), keep + [dst])

    s = line(pixels.withColumn("_v", F.col(value).cast("double")), "x", "_v", "_row", cols)
    s = line(s, "y", "_row", "_sum", cols)
    return s.select(*cols, (F.col("_sum") / float((2 * r + 1) ** 2)).alias(out))


def _next(df: DataFrame, w: Window, c: str) -> tuple[Column, Column]:
    """Previous and next value along the window, the own value at the border."""
    return F.coalesce(F.lag(c).over(w), F.col(c)), F.coalesce(F.lead(c).over(w), F.col(c))


def sobel(pixels: DataFrame, value: str = "v", out: str = "mag", block: int = BLOCK) -> DataFrame:
    """3x3 gradient magnitude with replicated edges."""
    cols = pixels.columns
    b, w = along(pixels.withColumn("_v", F.col(value).cast("double")), "x", 1, block)
    prev, nxt = _next(b, w, "_v")
    b = _done(b.withColumns({"_d": nxt - prev, "_s": prev + 2.0 * F.col("_v") + nxt}), cols + ["_d", "_s"])
    b, w = along(b, "y", 1, block)
    up_d, down_d = _next(b, w, "_d")
    up_s, down_s = _next(b, w, "_s")
    gx, gy = up_d + 2.0 * F.col("_d") + down_d, down_s - up_s
    return _done(b.withColumn(out, F.sqrt(gx * gx + gy * gy)), cols + [out])


def smooth(pixels: DataFrame, value: str, sigma: float, block: int = BLOCK) -> DataFrame:
    """Gaussian blur as three passes of a fractional box of radius under one pixel."""
    edge = (((12.0 * sigma * sigma / 3.0 + 1.0) ** 0.5) - 1.0) / 2.0
    if edge >= 1.0:
        raise ValueError("sigma too large for a three-tap pass")
    cols = pixels.columns
    out = pixels
    for axis in ("x", "y"):
        b, w = along(out, axis, 3, block)
        for _ in range(3):
            prev, nxt = _next(b, w, value)
            b = b.withColumn(value, (prev * edge + F.col(value) + nxt * edge) / (1.0 + 2.0 * edge))
        out = _done(b, cols)
    return out


def morphology(mask: DataFrame, op: str, kx: int, ky: int, times: int = 1, value: str = "mask", block: int = BLOCK) -> DataFrame:
    """Rectangular ``dilate``, ``erode`` or ``close`` of a boolean column.

    Even kernels reach one pixel further forward; pixels outside the image never count.
    """
    if op == "close":
        return morphology(morphology(mask, "dilate", kx, ky, times, value, block), "erode", kx, ky, times, value, block)
    pick = F.max if op == "dilate" else F.min
    cols = mask.columns
    out = mask.withColumn(value, F.col(value).cast("int"))
    for axis, k in (("x", max(1, int(kx))), ("y", max(1, int(ky)))):
        if k == 1 or times < 1:
            continue
        reach = (k // 2) * times
        b, w = along(out, axis, reach, block)
        frame_ = w.rowsBetween(-(k - 1 - k // 2) * times, reach)
        out = _done(b.withColumn(value, pick(value).over(frame_)), cols)
    return out.withColumn(value, F.col(value) == 1).select(*cols)


def mask_runs(mask: DataFrame, value: str = "mask") -> DataFrame:
    """Horizontal runs of True pixels: ``(image_id, y, x0, x1)``, x1 exclusive."""
    on = mask.filter(F.col(value)).select("image_id", "y", "x")
    row = Window.partitionBy("image_id", "y").orderBy("x")
    runs = on.withColumn("_g", F.col("x") - F.row_number().over(row))
    return runs.groupBy("image_id", "y", "_g").agg(F.min("x").alias("x0"), (F.max("x") + 1).alias("x1")).drop("_g")


def edge_ramp(pixels: DataFrame, axis: str, mix: float | dict[str, float] = 1.0, columns=("v",), sizes: DataFrame | None = None) -> DataFrame:
    """Add a linear ramp so that opposite-edge means meet half-way.

    ``mix`` is one factor or a factor per column.
    """
    mixes = {c: (mix[c] if isinstance(mix, dict) else mix) for c in columns}
    size = "w" if axis == "x" else "h"
    sizes = materialize(frame.dims(pixels), "sizes") if sizes is None else sizes
    sized = pixels.join(sizes.select("image_id", F.col(size).alias("_n")), "image_id")
    lo, hi = F.col(axis) == 0, F.col(axis) == F.col("_n") - 1
    means = (
        sized.filter(lo | hi)
        .groupBy("image_id")
        .agg(*[F.avg(F.when(s, F.col(c))).alias(f"_{k}_{c}") for c in columns for k, s in (("lo", lo), ("hi", hi))])
    )
    t = F.col(axis) / (F.col("_n") - 1)

    def lifted(c: str) -> Column:
        mid = (F.col(f"_lo_{c}") + F.col(f"_hi_{c}")) * 0.5
        ramp = (1.0 - t) * (mid - F.col(f"_lo_{c}")) + t * (mid - F.col(f"_hi_{c}"))
        return F.when(F.col("_n") < 2, F.col(c)).otherwise(F.col(c) + mixes[c] * ramp)

    out = sized.join(materialize(means, "means"), "image_id")
    return out.select(*[lifted(c).alias(c) if c in columns else F.col(c) for c in pixels.columns])


def luma_raster(pixels: DataFrame) -> DataFrame:
    """``(image_id, y, x, v)`` with v = luma of an RGB raster, or the grey value itself."""
    v = F.col("v").cast("double") if "v" in pixels.columns else C.luma(F.col("r"), F.col("g"), F.col("b"))
    return pixels.select("image_id", "y", "x", v.alias("v"))
