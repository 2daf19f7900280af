"""Masks from polygons and ink, and hole filling."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from chromatile.functions.color import q, to_byte
from chromatile.operators import boxes as bx, frame, raster, seams, stencil
from chromatile.session import materialize

KEYS = ["image_id", "y", "x"]


@dataclass(frozen=True)
class Style:
    """Kernel sizes and paddings of a removal mask."""

    close: tuple[int, int]
    dilate: tuple[int, int]
    rounds: int
    pad_x: int
    pad_y_down: int
    crop_pad: int


# Fixed values of the two mask styles, the ring and the ink test.
GEOMETRIC = Style((15, 3), (5, 5), 1, 8, 6, 32)
FLORAL = Style((7, 3), (3, 3), 1, 2, 2, 16)
RING, INK_DELTA, INK_MAD = 14, 14.0, 2.2
NEIGHBOURS = ((-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1))


def by_pixel(left: DataFrame, right: DataFrame, keys: list[str] = KEYS, how: str = "inner") -> DataFrame:
    """Join of two tables that grow with the image.

    Pixel tables encode to a fraction of their rows, so their file sizes let a join
    broadcast them through the driver; the hint keeps both sides on the executors.
    """
    return left.join(right.hint("merge"), keys, how)


def style_of(name: str | None) -> Style:
    return FLORAL if str(name or "").strip().lower() in ("floral", "damask", "tight") else GEOMETRIC


def box_quads(boxes: DataFrame) -> DataFrame:
    """Boxes as corner polygons in ``pts``."""
    p = lambda x, y: F.struct(F.col(x).cast("int").alias("x"), F.col(y).cast("int").alias("y"))
    return boxes.withColumn("pts", F.array(p("x0", "y0"), p("x1", "y0"), p("x1", "y1"), p("x0", "y1")))


def _inflated(quads: DataFrame, style: Style) -> DataFrame:
    """Widen each polygon sideways and add a copy shifted down."""
    xs = F.transform("pts", lambda p: p["x"])
    mid = (F.array_min(xs) + F.array_max(xs)) * 0.5
    grown = F.transform(
        "pts",
        lambda p: F.struct((p["x"] + F.when(p["x"] <= mid, -style.pad_x).otherwise(style.pad_x)).cast("int").alias("x"), p["y"].alias("y")),
    )
    down = F.transform(grown, lambda p: F.struct(p["x"].alias("x"), (p["y"] + style.pad_y_down).alias("y")))
    polys = F.array(grown, down) if style.pad_y_down else F.array(grown)
    return quads.filter(F.size("pts") >= 3).select("image_id", F.explode(polys).alias("pts")).distinct()


def _inside(x: Column, y: Column, pts: Column) -> Column:
    """Crossing-number test; points on an edge count as inside."""
    edges = F.zip_with(
        pts, F.concat(F.slice(pts, 2, F.size(pts)), F.slice(pts, 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    )

    def crosses(e: Column) -> Column:
        ax, ay, bx_, by = e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]
        at = ax + (y - ay) * (bx_ - ax) / F.when(by == ay, F.lit(1)).otherwise(by - ay)
        return ((ay > y) != (by > y)) & (x < at)

    def touches(e: Column) -> Column:
        ax, ay, bx_, by = e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]
        flat = (bx_ - ax) * (y - ay) - (by - ay) * (x - ax) == 0
        return flat & (x >= F.least(ax, bx_)) & (x <= F.greatest(ax, bx_)) & (y >= F.least(ay, by)) & (y <= F.greatest(ay, by))

    odd = F.size(F.filter(edges, crosses)) % 2 == 1
    return odd | F.exists(edges, touches)


def polygon_mask(pixels: DataFrame, quads: DataFrame, style: Style = GEOMETRIC, tile: int = bx.TILE, close: bool = True) -> DataFrame:
    """Removal mask ``(image_id, y, x, mask)`` from polygons ``(image_id, pts)``.

    Pixels meet polygons in tiles by a semi join, which stops at the first cover,
    so overlapping polygons do not multiply rows.
    """
    polys = _inflated(quads, style)
    xs, ys = F.transform("pts", lambda p: p["x"]), F.transform("pts", lambda p: p["y"])
    spans = lambda v: F.sequence(F.floor(F.greatest(F.lit(0), F.array_min(v)) / tile), F.floor(F.greatest(F.lit(0), F.array_max(v)) / tile))
    cells = polys.withColumn("tx", F.explode(spans(xs))).withColumn("ty", F.explode(spans(ys)))
    px = pixels.select(*KEYS).withColumns(bx.tile_ids(tile)).alias("p")
    c = cells.withColumns({"ax": F.array_min(xs), "bx": F.array_max(xs), "ay": F.array_min(ys), "by": F.array_max(ys)}).hint("merge").alias("c")
    same = [F.col(f"p.{k}") == F.col(f"c.{k}") for k in ("image_id", "tx", "ty")]
    # Few pixels of a tile lie in the span of a polygon, and only they need the test by edges.
    span = (F.col("p.x") >= F.col("c.ax")) & (F.col("p.x") <= F.col("c.bx")) & (F.col("p.y") >= F.col("c.ay")) & (F.col("p.y") <= F.col("c.by"))
    hit = span & _inside(F.col("p.x"), F.col("p.y"), F.col("c.pts"))
    inside = px.join(c, same[0] & same[1] & same[2] & hit, "left_semi").select(*KEYS, F.lit(True).alias("mask"))
    raw = by_pixel(pixels.select(*KEYS), inside, how="left").withColumn("mask", F.coalesce("mask", F.lit(False)))
    if not close:
        return raw
    done = stencil.morphology(raw, "close", *style.close)
    return stencil.morphology(done, "dilate", *style.dilate, times=style.rounds)


def ink_mask(gray: DataFrame, boxes: DataFrame, refine: bool = False) -> DataFrame:
    """Ink pixels inside each box: ``(image_id, box_id, y, x)``.

    The ring around a box gives median and MAD; dark or light strokes are chosen
    by count.  Values are counted per box before any percentile.  With ``refine``
    strokes are eroded once and dilated twice inside their box.
    """
    sized = boxes.join(frame.dims(gray), "image_id")
    clip = sized.select(
        "image_id", "box_id",
        F.greatest(F.lit(0), F.least("x0", "x1")).alias("ix0"), F.greatest(F.lit(0), F.least("y0", "y1")).alias("iy0"),
        F.least(F.col("w"), F.greatest("x0", "x1")).alias("ix1"), F.least(F.col("h"), F.greatest("y0", "y1")).alias("iy1"),
    ).filter("ix1 - ix0 >= 2 and iy1 - iy0 >= 2")
    reach = clip.select("*", *[F.col(f"i{c}").alias(c) for c in ("x0", "y0", "x1", "y1")])
    near = bx.pixels_in_boxes(gray.select(*KEYS, "v"), reach, RING)
    inner = (F.col("x") >= F.col("ix0")) & (F.col("x") < F.col("ix1")) & (F.col("y") >= F.col("iy0")) & (F.col("y") < F.col("iy1"))
    near = materialize(near.select("image_id", "box_id", "y", "x", "v", inner.alias("inner"), "ix0", "iy0"), "near")
    key = ["image_id", "box_id"]
    counts = materialize(near.groupBy(*key, "inner", "v").agg(F.count(F.lit(1)).alias("n")), "counts")
    ring_n = counts.groupBy(*key).agg(F.sum(F.when(~F.col("inner"), F.col("n")).otherwise(0)).alias("ring"), F.sum("n").alias("all"))
    # A ring of under eight pixels falls back to the whole surround; under four there is no box.
    use = counts.join(ring_n, key).filter((~F.col("inner") | (F.col("ring") < 8)) & ((F.col("ring") >= 8) | (F.col("all") >= 4)))
    use = use.select(*key, F.col("v").cast("double").alias("v"), "n")
    med = use.groupBy(*key).agg(F.percentile("v", 0.5, F.col("n")).alias("med"))
    dev = use.join(med, key).select(*key, F.abs(F.col("v") - F.col("med")).alias("d"), "n")
    mad = dev.groupBy(*key).agg((F.percentile("d", 0.5, F.col("n")) + 1.0).alias("mad"))
    # Written once: the ring statistics would else be worked out twice, sort by sort, in the stage of the last join.
    level = materialize(med.join(mad, key).withColumn("delta", F.greatest(F.lit(INK_DELTA), INK_MAD * F.col("mad"))), "level")
    is_dark = F.col("v") < F.col("med") - F.col("delta")
    is_light = F.col("v") > F.col("med") + F.col("delta") + 4.0
    tally = counts.filter("inner").join(level.hint("merge"), key).groupBy(*key, "med", "delta").agg(
        F.sum(F.when(is_dark, F.col("n")).otherwise(0)).alias("nd"),
        F.sum(F.when(is_light, F.col("n")).otherwise(0)).alias("nl"),
        F.sum(F.when(is_dark | is_light, F.col("n")).otherwise(0)).alias("nb"),
        F.sum("n").alias("area"),
    )
    floor = F.greatest(F.lit(4), F.floor(F.col("area") / 400))
    side = (
        F.when((F.col("nd") >= F.col("nl")) & (F.col("nd") >= floor), "dark").when(F.col("nl") >= floor, "light").otherwise("both")
    )
    total = F.when(F.col("side") == "dark", F.col("nd")).when(F.col("side") == "light", F.col("nl")).otherwise(F.col("nb"))
    chosen = materialize(tally.withColumn("side", side).filter(total >= 3).select(*key, "med", "delta", "side"), "chosen")
    ink = (is_dark & F.col("side").isin("dark", "both")) | (is_light & F.col("side").isin("light", "both"))
    rows = near.filter("inner").join(chosen.hint("merge"), key).withColumn("mask", ink)
    if not refine:
        return rows.filter("mask").select(*key, "y", "x")
    local = rows.select(
        F.struct(*key).alias("image_id"), (F.col("y") - F.col("iy0")).alias("y"), (F.col("x") - F.col("ix0")).alias("x"), "mask", "ix0", "iy0"
    )
    local = stencil.morphology(stencil.morphology(local, "erode", 3, 3), "dilate", 3, 3, times=2)
    return local.filter("mask").select("image_id.image_id", "image_id.box_id", (F.col("y") + F.col("iy0")).alias("y"), (F.col("x") + F.col("ix0")).alias("x"))


def period_fill(pixels: DataFrame, holes: DataFrame, periods: DataFrame, wrap: bool = False) -> tuple[DataFrame, DataFrame]:
    """Fill holes from known pixels one motif away: (filled rows, holes left).

    ``periods`` is ``(image_id, px, py)``.  Only hole rows are expanded; the first
    offset that lands on a known pixel wins.
    """
    vals = raster.payload(pixels)
    info = frame.dims(pixels).join(periods, "image_id")
    px, py, w, h = (F.col(c) for c in ("px", "py", "w", "h"))
    use_x, use_y = (px >= 4) & (px < F.floor(w / 2)), (py >= 4) & (py < F.floor(h / 2))
    off = lambda on, dx, dy: F.when(on, F.struct((dx + F.lit(0)).cast("int").alias("dx"), (dy + F.lit(0)).cast("int").alias("dy")))
    zero = F.lit(0)
    offsets = [off(use_x, m * px, zero) for m in (1, -1, 2, -2)] + [off(use_y, zero, m * py) for m in (1, -1)]
    offsets += [off(use_x & use_y, sx * px, sy * py) for sx, sy in ((1, 1), (-1, 1), (1, -1), (-1, -1))]
    tries = frame.beside(holes.select(*KEYS), info).select(*KEYS, "w", "h", F.posexplode(F.array_compact(F.array(*offsets))).alias("ord", "o"))
    sx, sy = F.col("x") + F.col("o.dx"), F.col("y") + F.col("o.dy")
    if wrap:
        sx, sy = F.pmod(sx, w), F.pmod(sy, h)
    tries = tries.select(*KEYS, "ord", sx.cast("int").alias("sx"), sy.cast("int").alias("sy"))
    known = by_pixel(pixels, holes.select(*KEYS), how="left_anti")
    hit = raster.gather(tries, known, vals).groupBy(*KEYS).agg(F.min(F.struct("ord", *vals)).alias("m"))
    filled = hit.select(*KEYS, *[F.col(f"m.{c}").alias(c) for c in vals])
    return filled, by_pixel(holes.select(*KEYS), filled.select(*KEYS), how="left_anti")


def frontier_fill(pixels: DataFrame, holes: DataFrame, wrap: bool = False) -> DataFrame:
    """Grow colours into holes ring by ring: filled rows ``(image_id, y, x, values)``.

    Everything that touches a hole pixel when it is reached was filled in the round
    before, so a round joins the remaining holes to the last ring only, never to
    the image.  Rounds are bounded by the hole radius.
    """
    vals = raster.payload(pixels)
    sizes = frame.dims(pixels)
    order = raster.hilbert_order(F.greatest("w", "h"))
    n = F.call_function("shiftleft", F.lit(1).cast("long"), order * 2)
    todo = frame.beside(holes.select(*KEYS).distinct(), sizes).withColumns(
        {"_h": raster.hilbert(F.col("x"), F.col("y"), order), "_span": F.greatest(n - 1, F.lit(1)).cast("double")}
    )
    todo = materialize(todo, "holes")
    steps = F.array(*[F.struct(F.lit(i).alias("o"), F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit((dy * dy + dx * dx) ** 0.5).alias("dist")) for i, (dy, dx) in enumerate(NEIGHBOURS)])

    def around(df: DataFrame) -> DataFrame:
        e = df.select("*", F.explode(steps).alias("s"))
        ny, nx = F.col("y") + F.col("s.dy"), F.col("x") + F.col("s.dx")
        if wrap:
            return e.withColumns({"ny": F.pmod(ny, F.col("h")), "nx": F.pmod(nx, F.col("w"))})
        ok = (ny >= 0) & (ny < F.col("h")) & (nx >= 0) & (nx < F.col("w"))
        return e.filter(ok).withColumns({"ny": ny, "nx": nx})

    halo = around(todo).select("image_id", F.col("ny").alias("y"), F.col("nx").alias("x")).distinct()
    halo = frame.beside(by_pixel(halo, todo.select(*KEYS), how="left_anti"), sizes)
    ring = by_pixel(pixels, halo).select(
        *KEYS, raster.hilbert(F.col("x"), F.col("y"), order).alias("_h"), *[F.col(c).cast("double").alias(c) for c in vals]
    )
    ring = materialize(ring, "ring")
    done = None
    while True:
        src = ring.select("image_id", F.col("y").alias("ny"), F.col("x").alias("nx"), F.col("_h").alias("_nh"), *vals)
        j = by_pixel(around(todo), src, ["image_id", "ny", "nx"])
        weight = 1.0 / (F.col("s.dist") + 0.35) / (1.0 + 6.0 * (F.abs(F.col("_h") - F.col("_nh")) / F.col("_span")))
        j = j.withColumn("_w", weight)
        rank = F.struct(q(F.col("_w"), 12).alias("w"), (-F.col("s.o")).alias("o"), *vals)
        found = j.groupBy(*KEYS, "_h").agg(
            F.max(rank).alias("best"), F.sum("_w").alias("_ws"), *[F.sum(F.col("_w") * F.col(c)).alias(f"_s{c}") for c in vals]
        )
        blend = lambda c: 0.86 * F.col(f"best.{c}") + 0.14 * F.col(f"_s{c}") / F.greatest(F.col("_ws"), F.lit(1e-6))
        ring = materialize(found.select(*KEYS, "_h", *[blend(c).alias(c) for c in vals]), "ring")
        if ring.limit(1).count() == 0:
            break
        done = ring if done is None else done.unionByName(ring)
        todo = materialize(by_pixel(todo, ring.select(*KEYS), how="left_anti"), "holes")
        if todo.limit(1).count() == 0:
            break
    if done is None:
        return pixels.limit(0).select(*KEYS, *vals)
    return done.select(*KEYS, *[to_byte(F.col(c)).alias(c) for c in vals])


def fill_holes(pixels: DataFrame, holes: DataFrame, wrap: bool = False) -> DataFrame:
    """Motif fill, then ring growth for what is left: filled rows."""
    px = seams.axis_period(pixels, "x").withColumnRenamed("period", "px")
    py = seams.axis_period(pixels, "y").withColumnRenamed("period", "py")
    copied, left = period_fill(pixels, holes, px.join(py, "image_id"), wrap)
    copied, left = materialize(copied, "copied"), materialize(left, "left")
    known = by_pixel(pixels, holes.select(*KEYS), how="left_anti").unionByName(copied.select(*pixels.columns))
    # Rows at positions still to fill carry no colour but keep the frame size.
    frame_rows = known.unionByName(by_pixel(pixels, left, how="left_semi"))
    grown = frontier_fill(frame_rows, left, wrap)
    return copied.unionByName(grown.select(*copied.columns))


def remove_regions(pixels: DataFrame, boxes: DataFrame, style: str | None = None, wrap: bool = False) -> DataFrame:
    """Fill the text in each box from its surround.

    Every box becomes a small image of its own (box plus padding), so the boxes of
    all images run through mask, motif fill and growth together.  Crops read the
    source image; where crops overlap the later box wins.
    """
    s = style_of(style)
    vals = ["r", "g", "b"]
    box = boxes.select("image_id", "box_id", *[F.col(c).alias(f"b{c}") for c in ("x0", "y0", "x1", "y1")])
    px = s.crop_pad + s.pad_x
    area = box.select(
        "*",
        F.greatest(F.lit(0), F.least("bx0", "bx1") - px).alias("x0"), F.greatest(F.lit(0), F.least("by0", "by1") - s.crop_pad).alias("y0"),
        (F.greatest("bx0", "bx1") + px).alias("x1"), (F.greatest("by0", "by1") + s.pad_y_down + s.crop_pad).alias("y1"),
    )
    hit = bx.pixels_in_boxes(pixels.select(*KEYS, *vals), area)
    crop_id = F.struct(F.col("image_id").alias("image"), F.col("box_id").alias("box"), F.col("x0").alias("ox"), F.col("y0").alias("oy"))
    crops = hit.select(crop_id.alias("image_id"), (F.col("y") - F.col("y0")).alias("y"), (F.col("x") - F.col("x0")).alias("x"), *vals)
    crops = materialize(crops, "crops")
    local = area.select(
        crop_id.alias("image_id"), *[(F.col(f"b{c}") - F.col(o)).alias(c) for c, o in (("x0", "x0"), ("y0", "y0"), ("x1", "x0"), ("y1", "y0"))]
    )
    mask = polygon_mask(crops, box_quads(local).select("image_id", "pts"), s)
    holes = materialize(mask.filter("mask").select(*KEYS), "mask")
    filled = fill_holes(crops, holes, wrap)
    back = filled.select(
        F.col("image_id.image").alias("image_id"), (F.col("y") + F.col("image_id.oy")).alias("y"), (F.col("x") + F.col("image_id.ox")).alias("x"),
        F.struct(F.col("image_id.box").alias("box"), *vals).alias("m"),
    )
    last = back.groupBy(*KEYS).agg(F.max("m").alias("m"))
    out = by_pixel(pixels, last, how="left")
    return out.select(*[F.coalesce(f"m.{c}", c).alias(c) if c in vals else F.col(c) for c in pixels.columns])
