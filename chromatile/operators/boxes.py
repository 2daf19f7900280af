"""Box tables: normalising, mapping between frames, masks and unions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

ZOOM_MAX = 8.0
TILE = 64


def clamp_zoom(zoom: float) -> float:
    return 1.0 if zoom != zoom else min(ZOOM_MAX, max(1.0, float(zoom)))


@dataclass(frozen=True)
class Frame:
    """Centre offset and zoom of an image inside a same-size frame."""

    x: float = 0.0
    y: float = 0.0
    zoom: float = 1.0

    def paste(self, w: Column, h: Column) -> tuple[Column, Column, Column, Column]:
        """Top-left corner and size of the zoomed image in the frame."""
        z = F.lit(clamp_zoom(self.zoom))
        nw = F.greatest(F.lit(1.0), F.rint(w * z))
        nh = F.greatest(F.lit(1.0), F.rint(h * z))
        left = F.rint(w * 0.5 + F.lit(float(self.x)) - nw * 0.5)
        top = F.rint(h * 0.5 + F.lit(float(self.y)) - nh * 0.5)
        return left, top, nw, nh


def normalized(boxes: DataFrame, x0: Column, y0: Column, x1: Column, y1: Column, w: Column, h: Column, drop: bool = True) -> DataFrame:
    """Swap, half-even round and clip the corners; drop boxes thinner than 2 px."""

    def side(pick, a: Column, b: Column, limit: Column) -> Column:
        v = F.rint(pick(a.cast("double"), b.cast("double")))
        return F.least(F.greatest(v, F.lit(0.0)), limit.cast("double")).cast("int")

    out = boxes.withColumns(
        {
            "x0": side(F.least, x0, x1, w),
            "y0": side(F.least, y0, y1, h),
            "x1": side(F.greatest, x0, x1, w),
            "y1": side(F.greatest, y0, y1, h),
        }
    )
    return out.filter(thick()) if drop else out


def thick() -> Column:
    return (F.col("x1") - F.col("x0") >= 2) & (F.col("y1") - F.col("y0") >= 2)


def source_to_display(boxes: DataFrame, view: Frame, dw: int, dh: int) -> DataFrame:
    """Source boxes (with source size ``sw``, ``sh``) onto a framed ``dw`` x ``dh`` preview."""
    left, top, _, _ = view.paste(F.col("sw"), F.col("sh"))
    z = clamp_zoom(view.zoom)

    def px(c: str) -> Column:
        return (F.col(c) * z + left) * dw / F.col("sw")

    def py(c: str) -> Column:
        return (F.col(c) * z + top) * dh / F.col("sh")

    return normalized(boxes, px("x0"), py("y0"), px("x1"), py("y1"), F.lit(dw), F.lit(dh))


def display_to_source(boxes: DataFrame, view: Frame, dw: int, dh: int) -> DataFrame:
    """Preview boxes back to source pixels; each corner is clamped inside the image."""
    left, top, _, _ = view.paste(F.col("sw"), F.col("sh"))
    z = clamp_zoom(view.zoom)

    def point(c: str, size: str, extent: int, origin: Column) -> Column:
        v = F.rint((F.col(c) * F.col(size) / F.lit(float(extent)) - origin) / z)
        return F.least(F.col(size) - 1.0, F.greatest(F.lit(0.0), v))

    return normalized(
        boxes,
        point("x0", "sw", dw, left), point("y0", "sh", dh, top),
        point("x1", "sw", dw, left), point("y1", "sh", dh, top),
        F.col("sw"), F.col("sh"),
    )


def scale_boxes(boxes: DataFrame, dw: int, dh: int) -> DataFrame:
    """Map boxes from ``sw`` x ``sh`` to ``dw`` x ``dh``; a vanishing box becomes 2 x 2 at the origin."""

    def at(c: str, size: str, extent: int) -> Column:
        return F.rint(F.col(c) * extent / F.col(size).cast("double"))

    out = normalized(
        boxes, at("x0", "sw", dw), at("y0", "sh", dh), at("x1", "sw", dw), at("y1", "sh", dh),
        F.lit(dw), F.lit(dh), drop=False,
    )
    stand_in = {"x0": 0, "y0": 0, "x1": min(2, dw), "y1": min(2, dh)}
    ok = thick()
    return out.withColumns({c: F.when(ok, F.col(c)).otherwise(v).cast("int") for c, v in stand_in.items()})


def grown(boxes: DataFrame, pad: int) -> DataFrame:
    """Swap reversed corners and grow every side by ``pad`` (clipped at zero)."""
    p = max(0, int(pad))
    return boxes.withColumns(
        {
            "x0": F.greatest(F.lit(0), F.least("x0", "x1") - p),
            "y0": F.greatest(F.lit(0), F.least("y0", "y1") - p),
            "x1": F.greatest("x0", "x1") + p,
            "y1": F.greatest("y0", "y1") + p,
        }
    )


def with_tiles(boxes: DataFrame, tile: int = TILE) -> DataFrame:
    """One row per ``tile``-pixel square a box touches (``tx``, ``ty``)."""
    span = lambda a, b: F.sequence(F.floor(F.col(a) / tile), F.floor((F.col(b) - 1) / tile))
    solid = boxes.filter((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")))
    return solid.withColumn("tx", F.explode(span("x0", "x1"))).withColumn("ty", F.explode(span("y0", "y1")))


def tile_ids(tile: int = TILE) -> dict[str, Column]:
    return {"tx": F.floor(F.col("x") / tile), "ty": F.floor(F.col("y") / tile)}


def pixels_in_boxes(pixels: DataFrame, boxes: DataFrame, pad: int = 0, tile: int = TILE) -> DataFrame:
    """Pixel-box pairs as an equi-join on a tile id with the exact test on top.

    The hint deals the tiles over the tasks; a small file of boxes would else be one task.
    """
    cells = with_tiles(grown(boxes, pad), tile)
    j = pixels.withColumns(tile_ids(tile)).join(cells.hint("merge"), ["image_id", "tx", "ty"])
    inside = (
        (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1"))
    )
    return j.filter(inside).drop("tx", "ty")


def box_mask(pixels: DataFrame, boxes: DataFrame, pad: int = 2, tile: int = TILE) -> DataFrame:
    """Flag pixels inside any box.

    Boxes become row spans and overlapping spans are merged per (image, row)
    before the join, so a pile of boxes on one spot costs one span, and the
    pixel side meets each span once.
    """
    spans = grown(boxes, pad).filter((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")))
    spans = spans.select("image_id", F.explode(F.sequence(F.col("y0"), F.col("y1") - 1)).alias("y"), "x0", "x1")
    spans = spans.groupBy("image_id", "y", "x0").agg(F.max("x1").alias("x1"))
    row = Window.partitionBy("image_id", "y").orderBy("x0")
    reach = F.max("x1").over(row.rowsBetween(Window.unboundedPreceding, -1))
    runs = spans.withColumn("_new", (F.col("x0") > F.coalesce(reach, F.lit(-1))).cast("int"))
    runs = runs.withColumn("_run", F.sum("_new").over(row.rowsBetween(Window.unboundedPreceding, 0)))
    merged = runs.groupBy("image_id", "y", "_run").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"))
    per_row = merged.groupBy("image_id", "y").agg(F.collect_list(F.struct("x0", "x1")).alias("_spans"))
    j = pixels.join(per_row.hint("merge"), ["image_id", "y"], "left")
    hit = F.exists("_spans", lambda s: (F.col("x") >= s["x0"]) & (F.col("x") < s["x1"]))
    return j.withColumn("mask", F.coalesce(hit, F.lit(False))).select(*pixels.columns, "mask")


def union_detections(*passes: DataFrame) -> DataFrame:
    """All boxes of several detection passes, exact duplicates dropped."""
    out = passes[0]
    for p in passes[1:]:
        out = out.unionByName(p)
    return out.dropDuplicates(["image_id", "x0", "y0", "x1", "y1"])
