"""Coordinate re-mapping: crop, resize, tile, blend, warp.

A re-mapping is either a push (each source pixel emits its destinations, a
projection without a join) or a gather (an equi-join of destination rows to
source pixels on the full pixel key).  Neither keys on the image alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from chromatile.functions import color as C
from chromatile.operators import frame, seams, stencil
from chromatile.operators.boxes import Frame, clamp_zoom
from chromatile.session import materialize

KEYS = ("image_id", "y", "x")

# Fixed values of the blend, the warp and the units.
BLEND_SHARE = 0.45
WAVE, STRETCH = 0.12, 1.5
CHROMA_MIX = 0.35
CM_PER_INCH = 2.54


def payload(pixels: DataFrame) -> list[str]:
    return [c for c in pixels.columns if c not in KEYS]


def grid_rows(sizes: DataFrame, w: str = "w", h: str = "h") -> DataFrame:
    """All pixel positions of ``sizes(image_id, w, h, ...)``; rows are spread before columns are made."""
    rows = sizes.withColumn("y", F.explode(F.sequence(F.lit(0), F.col(h) - 1))).repartition("image_id", "y")
    return rows.withColumn("x", F.explode(F.sequence(F.lit(0), F.col(w) - 1)))


def _hits(pos: str, src: Column, dst: Column) -> Column:
    """Destinations i with floor((i + 0.5) * src / dst) = pos (nearest sampling)."""
    scale = src.cast("double") / dst
    guess = F.floor(F.col(pos) / scale)
    span = F.sequence(F.greatest(F.lit(0), guess - 1).cast("int"), F.floor((F.col(pos) + 1) / scale + 1).cast("int"))
    return F.filter(span, lambda i: (i < dst) & (F.floor((i + 0.5) * scale) == F.col(pos)))


def push_nearest(pixels: DataFrame, w: str, h: str, nw: Column, nh: Column) -> DataFrame:
    """Nearest resample from ``w`` x ``h`` (columns of ``pixels``) to ``nw`` x ``nh``."""
    out = pixels.withColumns({"_nx": _hits("x", F.col(w), nw), "_ny": _hits("y", F.col(h), nh)})
    out = out.drop("x", "y").withColumn("y", F.explode("_ny")).withColumn("x", F.explode("_nx"))
    return out.drop("_nx", "_ny")


def push_bilinear(pixels: DataFrame, w: str, h: str, nw: Column, nh: Column, channels: list[str], carry: list[str]) -> DataFrame:
    """Triangle-filter resample, one axis at a time, 8-bit between the passes.

    A source pixel emits the destinations under its triangle; the weighted sums
    meet in one aggregate per axis, keyed by the destination pixel.
    """
    out = pixels
    for axis, src, dst, name in (("x", w, nw, "_nw"), ("y", h, nh, "_nh")):
        other = "y" if axis == "x" else "x"
        scale = F.col(src).cast("double") / dst
        reach = F.greatest(F.lit(1.0), scale)
        centre = F.col(axis) + 0.5
        lo = F.greatest(F.lit(0), F.floor((centre - reach) / scale - 1.0)).cast("int")
        hi = F.least(dst - 1, F.ceil((centre + reach) / scale).cast("int"))
        weight = lambda i: F.greatest(F.lit(0.0), 1.0 - F.abs(centre - (i + 0.5) * scale) / reach)
        taps = F.filter(
            F.transform(F.sequence(lo, hi), lambda i: F.struct(i.cast("int").alias("i"), weight(i).alias("t"))), lambda s: s["t"] > 0
        )
        rows = out.select("image_id", other, *carry, *channels, F.inline(F.when(lo <= hi, taps)))
        out = rows.groupBy("image_id", other, F.col("i").alias(axis), *carry).agg(
            *[
                C.clamp(F.floor(C.q(F.sum(F.col("t") * F.col(c)) / F.sum("t"), 9) + 0.5).cast("double"), 0.0, 255.0).cast("int").alias(c)
                for c in channels
            ]
        )
    return out


def to_pixels(value: float, unit: str, dpi: float) -> int:
    res = max(1.0, float(dpi))
    px = value * res if unit == "in" else value / CM_PER_INCH * res if unit == "cm" else value
    return max(1, round(px))


def output_size(
    w: Column, h: Column, width: float | None, height: float | None, unit: str = "px", dpi: float = 72.0, lock: bool = True
) -> tuple[Column, Column]:
    """Target size per image; a locked aspect fills a missing side, both missing keep the size."""
    has_w, has_h = width is not None and width > 0, height is not None and height > 0
    if not has_w and not has_h:
        return w, h
    tw = F.lit(to_pixels(width, unit, dpi)) if has_w else None
    th = F.lit(to_pixels(height, unit, dpi)) if has_h else None
    ratio = w / h.cast("double")
    if tw is None:
        tw = F.greatest(F.lit(1), F.rint(th * ratio).cast("int")) if lock else w
    if th is None:
        th = F.greatest(F.lit(1), F.rint(tw / ratio).cast("int")) if lock else h
    return tw, th


def fit_edge(w: Column, h: Column, edge: int, rounding: str = "truncate") -> tuple[Column, Column]:
    """Size whose long side is at most ``edge``."""
    scale = F.lit(float(edge)) / F.greatest(w, h)
    cut = (lambda v: F.floor(v)) if rounding == "truncate" else F.rint
    small = lambda v: F.greatest(F.lit(1), cut(v * scale).cast("int"))
    big = F.greatest(w, h) > edge
    return F.when(big, small(w)).otherwise(w).cast("int"), F.when(big, small(h)).otherwise(h).cast("int")


def resize_to(pixels: DataFrame, nw: Column, nh: Column, how: str = "nearest") -> DataFrame:
    """Resample to the size given by expressions over ``w`` and ``h``."""
    sized = frame.with_dims(pixels).withColumns({"_tw": nw, "_th": nh})
    if how == "nearest":
        return push_nearest(sized, "w", "h", F.col("_tw"), F.col("_th")).select(*pixels.columns)
    ch = [c for c in pixels.columns if c in ("r", "g", "b", "a", "v")]
    out = push_bilinear(sized, "w", "h", F.col("_tw"), F.col("_th"), ch, ["w", "h", "_tw", "_th"])
    return out.select(*[c for c in pixels.columns if c in out.columns])


def resize(pixels, width=None, height=None, how="nearest", unit="px", dpi=72.0, lock=True) -> DataFrame:
    if width is None and height is None:
        return pixels
    tw, th = output_size(F.col("w"), F.col("h"), width, height, unit, dpi, lock)
    return resize_to(pixels, tw, th, how)


def crop_zoom(pixels: DataFrame, x: float, y: float, zoom: float, how: str = "nearest", fill: int = 0) -> DataFrame:
    """Place the image in a same-size frame by centre offset and zoom; uncovered pixels take ``fill``."""
    z = clamp_zoom(zoom)
    if abs(z - 1.0) <= 1e-6 and abs(x) < 0.5 and abs(y) < 0.5:
        return pixels
    sizes = frame.dims(pixels)
    left, top, nw, nh = (c.cast("int") for c in Frame(x, y, z).paste(F.col("w"), F.col("h")))
    placed = sizes.withColumns({"_l": left, "_t": top, "_nw": nw, "_nh": nh})
    src = pixels.join(placed, "image_id")
    if how == "nearest":
        big = push_nearest(src, "w", "h", F.col("_nw"), F.col("_nh"))
    else:
        ch = [c for c in payload(pixels) if c in ("r", "g", "b", "a", "v")]
        big = push_bilinear(src, "w", "h", F.col("_nw"), F.col("_nh"), ch, ["w", "h", "_l", "_t", "_nw", "_nh"])
    moved = big.withColumns({"x": (F.col("x") + F.col("_l")).cast("int"), "y": (F.col("y") + F.col("_t")).cast("int")})
    seen = moved.filter("x >= 0 and x < w and y >= 0 and y < h").select(*pixels.columns)
    covered = (
        (F.col("x") >= F.col("_l")) & (F.col("x") < F.col("_l") + F.col("_nw"))
        & (F.col("y") >= F.col("_t")) & (F.col("y") < F.col("_t") + F.col("_nh"))
    )
    blank = grid_rows(placed).filter(~covered)
    types = dict(pixels.dtypes)
    empty = blank.select(*[F.col(c) if c in KEYS else F.lit(fill).cast(types[c]).alias(c) for c in pixels.columns])
    return seen.unionByName(empty)


def crop_window(pixels: DataFrame, x: float, y: float, zoom: float) -> DataFrame:
    """Tight slice at a clamped origin, re-based to zero."""
    z = F.lit(clamp_zoom(zoom))
    sized = frame.with_dims(pixels)
    cut = lambda n: F.greatest(F.lit(1), F.least(F.col(n), F.rint(F.col(n) / z).cast("int")))
    start = lambda v, n: F.greatest(F.lit(0), F.least(F.rint(F.lit(float(v))).cast("int"), F.col(n) - cut(n)))
    s = sized.withColumns({"_x": start(x, "w"), "_y": start(y, "h"), "_cw": cut("w"), "_ch": cut("h")})
    inside = (
        (F.col("x") >= F.col("_x")) & (F.col("x") < F.col("_x") + F.col("_cw"))
        & (F.col("y") >= F.col("_y")) & (F.col("y") < F.col("_y") + F.col("_ch"))
    )
    moved = {"x": F.col("x") - F.col("_x"), "y": F.col("y") - F.col("_y")}
    return s.filter(inside).select(*[moved[c].cast("int").alias(c) if c in moved else F.col(c) for c in pixels.columns])


def seam_offset(pixels: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Roll by half the width and height: a projection on the sized frame."""
    s = frame.with_dims(pixels, sizes)
    moved = {"x": F.pmod(F.col("x") + F.floor(F.col("w") / 2), F.col("w")), "y": F.pmod(F.col("y") + F.floor(F.col("h") / 2), F.col("h"))}
    return s.select(*[moved[c].cast("int").alias(c) if c in moved else F.col(c) for c in pixels.columns])


def tile_repeat(pixels: DataFrame, g: int = 3, sizes: DataFrame | None = None) -> DataFrame:
    """g x g repeat; every pixel emits its g*g copies."""
    s = frame.with_dims(pixels, sizes).withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(g * g - 1))))
    moved = {"x": F.col("x") + F.col("w") * (F.col("_i") % g), "y": F.col("y") + F.col("h") * F.floor(F.col("_i") / g)}
    return s.select(*[moved[c].cast("int").alias(c) if c in moved else F.col(c) for c in pixels.columns])


# Share of the wall that is covered, from the floor up.
COVER = {"full": 1.0, "half": 0.5, "third": 1.0 / 3.0, "quarter": 0.25}


def tile_wall(pixels: DataFrame, wall_w: int, wall_h: int, repeats: float, cover: str = "full") -> DataFrame:
    """Fill a wall with ``repeats`` horizontal repeats; only the lower ``cover`` share is kept."""
    tw = max(8, round(wall_w / max(1.0, float(repeats))))
    th = F.greatest(F.lit(8), F.rint(F.col("h") * (F.lit(float(tw)) / F.greatest(F.lit(1), F.col("w")))).cast("int"))
    cell = frame.with_dims(resize_to(pixels, F.lit(tw), th, "bilinear"))
    copies = lambda n, size: F.sequence(F.lit(0), F.floor(F.lit(n - 1) / F.col(size)).cast("int"))
    out = cell.withColumn("_i", F.explode(copies(wall_w, "w"))).withColumn("_j", F.explode(copies(wall_h, "h")))
    out = out.withColumns({"x": F.col("x") + F.col("_i") * F.col("w"), "y": F.col("y") + F.col("_j") * F.col("h")})
    first = wall_h - round(wall_h * COVER[cover])
    kept = out.filter((F.col("x") < wall_w) & (F.col("y") < wall_h) & (F.col("y") >= first))
    return kept.select(*cell.drop("w", "h").columns)


def hilbert(x: Column, y: Column, order: Column) -> Column:
    """Position of (x, y) on the Hilbert curve over a 2^order square."""
    n = F.call_function("shiftleft", F.lit(1).cast("long"), order)
    start = F.struct(
        F.greatest(F.lit(0).cast("long"), F.least(x.cast("long"), n - 1)).alias("x"),
        F.greatest(F.lit(0).cast("long"), F.least(y.cast("long"), n - 1)).alias("y"),
        F.lit(0).cast("long").alias("d"),
    )

    def step(acc: Column, k: Column) -> Column:
        rx = F.call_function("shiftright", acc["x"], k).bitwiseAND(F.lit(1).cast("long"))
        ry = F.call_function("shiftright", acc["y"], k).bitwiseAND(F.lit(1).cast("long"))
        quad = F.when(rx == 1, 3 - ry).otherwise(ry)
        d = acc["d"] + F.call_function("shiftleft", quad, k * 2)
        flip = (ry == 0) & (rx == 1)
        fx = F.when(flip, n - 1 - acc["x"]).otherwise(acc["x"])
        fy = F.when(flip, n - 1 - acc["y"]).otherwise(acc["y"])
        return F.struct(
            F.when(ry == 0, fy).otherwise(fx).alias("x"), F.when(ry == 0, fx).otherwise(fy).alias("y"), d.alias("d")
        )

    return F.aggregate(F.sequence(order - 1, F.lit(0)), start, step)["d"]


def hilbert_order(span: Column) -> Column:
    """Smallest order whose square covers ``span`` pixels."""
    s = F.greatest(F.lit(2), span)
    bits = F.length(F.conv(s - 1, 10, 2))
    return F.greatest(F.lit(1), bits).cast("int")


def hilbert_index(df: DataFrame, order: int) -> DataFrame:
    return df.withColumn("d", hilbert(F.col("x"), F.col("y"), F.lit(int(order))))


def front_alpha(axis: str, from_low: bool) -> Column:
    """Blend weight of the crinkly front, over columns x, y, w, h."""
    x, y, w, h = (F.col(c) for c in ("x", "y", "w", "h"))
    order = hilbert_order(F.greatest(w, h))
    n = F.call_function("shiftleft", F.lit(1).cast("long"), order)
    ix = F.least(F.floor(x * n / w), n - 1)
    iy = F.least(F.floor(y * n / h), n - 1)
    if axis == "x":
        hx, hy, u = (ix if from_low else n - 1 - ix), iy, x / F.greatest(w - 1, F.lit(1)).cast("double")
    else:
        hx, hy, u = (iy if from_low else n - 1 - iy), ix, y / F.greatest(h - 1, F.lit(1)).cast("double")
    u = u if from_low else 1.0 - u
    t = hilbert(hx, hy, order) / F.greatest(n * n - 1, F.lit(1)).cast("double")
    front = u + (t - u) * (4.0 * u * (1.0 - u))
    a = C.clamp((BLEND_SHARE - front) / BLEND_SHARE, 0.0, 1.0)
    return a * a


def roll_pairs(pixels: DataFrame, axis: str, step: int) -> DataFrame:
    """Each pixel with the values of ``np.roll``-style neighbour as ``_o*`` columns.

    A pixel emits itself to its own and to its neighbour's position; both meet in
    one aggregate on the pixel key.
    """
    vals = [c for c in payload(pixels) if c not in ("w", "h")]
    size = "w" if axis == "x" else "h"
    other = F.pmod(F.col(axis) + step, F.col(size)).cast("int")
    ends = F.array(F.struct(F.col(axis).alias("p"), F.lit(0).alias("s")), F.struct(other.alias("p"), F.lit(1).alias("s")))
    cross = "y" if axis == "x" else "x"
    rows = pixels.select("image_id", cross, "w", "h", *vals, F.inline(ends))
    return rows.groupBy("image_id", cross, F.col("p").alias(axis)).agg(
        F.max("w").alias("w"),
        F.max("h").alias("h"),
        *[F.max(F.when(F.col("s") == 0, F.col(c))).alias(c) for c in vals],
        *[F.max(F.when(F.col("s") == 1, F.col(c))).alias(f"_o{c}") for c in vals],
    )


def _diffuse(sized: DataFrame, axis: str, from_low: bool, nearest: bool) -> DataFrame:
    vals = [c for c in payload(sized) if c not in ("w", "h")]
    pair = roll_pairs(sized, axis, 1 if from_low else -1).withColumn("_t", front_alpha(axis, from_low))

    def mixed(c: str) -> Column:
        if nearest:
            return F.when(F.col("_t") >= 0.5, F.col(f"_o{c}")).otherwise(F.col(c)).alias(c)
        return F.rint(F.col("_t") * F.col(f"_o{c}") + (1.0 - F.col("_t")) * F.col(c)).cast("int").alias(c)

    return pair.select(*[mixed(c) if c in vals else F.col(c) for c in sized.columns])


def pin_axis(sized: DataFrame, axis: str) -> DataFrame:
    """Set opposite edges to their mean.  Only edge pixels are shuffled."""
    vals = [c for c in payload(sized) if c not in ("w", "h")]
    size, cross = ("w", "y") if axis == "x" else ("h", "x")
    is_edge = (F.col(axis) == 0) | (F.col(axis) == F.col(size) - 1)
    mean = lambda c: (F.max(F.when(F.col(axis) == 0, F.col(c))) + F.max(F.when(F.col(axis) == F.col(size) - 1, F.col(c)))) * 0.5
    edges = sized.filter(is_edge).groupBy("image_id", cross, "w", "h").agg(*[F.rint(mean(c)).cast("int").alias(c) for c in vals])
    both = F.array_distinct(F.array(F.lit(0), F.col(size) - 1))
    pinned = edges.withColumn(axis, F.explode(both))
    return sized.filter(~is_edge).unionByName(pinned.select(*sized.columns))


def pin_corners(sized: DataFrame) -> DataFrame:
    """Give the four corners their common mean."""
    vals = [c for c in payload(sized) if c not in ("w", "h")]
    is_corner = F.col("x").isin(0) | (F.col("x") == F.col("w") - 1)
    is_corner = is_corner & ((F.col("y") == 0) | (F.col("y") == F.col("h") - 1))
    means = sized.filter(is_corner).groupBy("image_id").agg(*[F.rint(_corner_mean(c)).cast("int").alias(f"_m{c}") for c in vals])
    corners = sized.filter(is_corner).join(means, "image_id")
    out = corners.select(*[F.col(f"_m{c}").alias(c) if c in vals else F.col(c) for c in sized.columns])
    return sized.filter(~is_corner).unionByName(out)


def _corner_mean(c: str) -> Column:
    total = F.lit(0.0)
    for fx in (F.lit(0), F.col("w") - 1):
        for fy in (F.lit(0), F.col("h") - 1):
            total = total + F.max(F.when((F.col("x") == fx) & (F.col("y") == fy), F.col(c)))
    return total / 4.0


def _pin(sized: DataFrame, h_on: bool, v_on: bool) -> DataFrame:
    out = sized
    if h_on:
        out = pin_axis(materialize(out, "pin"), "x")
    if v_on:
        out = pin_axis(materialize(out, "pin"), "y")
    if h_on and v_on:
        out = pin_corners(materialize(out, "pin"))
    return out


def pin_edges(pixels: DataFrame, h_on: bool = True, v_on: bool = True) -> DataFrame:
    return _pin(frame.with_dims(pixels), h_on, v_on).select(*pixels.columns)


def seal_edges(sized: DataFrame, h_on: bool, v_on: bool) -> DataFrame:
    """Lab ramps on the wrap axes (a*, b* mildly); the mean L* is restored."""
    lab = C.with_lab(sized, lab=("_L0", "_A0", "_B0"))
    cols = ("_L0", "_A0", "_B0")
    mix = {"_L0": 1.0, "_A0": CHROMA_MIX, "_B0": CHROMA_MIX}
    lab = materialize(lab, "lab")
    # Tables of a row per image are written first: planned from their input, they make the joins deal whole images.
    sizes = materialize(lab.groupBy("image_id").agg(F.max("w").alias("w"), F.max("h").alias("h"), F.avg("_L0").alias("_before")), "sizes")
    out = lab
    for axis, on in (("y", v_on), ("x", h_on)):
        if on:
            out = stencil.edge_ramp(out, axis, mix, cols, sizes.select("image_id", "w", "h"))
    after = out.groupBy("image_id").agg(F.avg("_L0").alias("_after"))
    shift = materialize(sizes.select("image_id", "_before").join(after, "image_id"), "shift")
    out = out.join(shift, "image_id").withColumn(
        "_L0", C.clamp(F.col("_L0") + F.col("_before") - F.col("_after"), 0.0, 100.0)
    )
    return C.with_rgb_from_lab(out, cols).select(*sized.columns)


def crinkly_blend(pixels: DataFrame, h_side: str | None = "left", v_side: str | None = None, nearest: bool = False) -> DataFrame:
    """Diffuse each chosen side toward the opposite edge along a Hilbert front, then pin."""
    h_on, v_on = bool(h_side), bool(v_side)
    if not h_on and not v_on:
        return pixels
    out = frame.with_dims(pixels, materialize(frame.dims(pixels), "sizes"))
    if h_on:
        out = pin_axis(materialize(_diffuse(out, "x", h_side == "left", nearest), "blend"), "x")
    if v_on:
        out = pin_axis(materialize(_diffuse(out, "y", v_side == "top", nearest), "blend"), "y")
    if not nearest and {"r", "g", "b"} <= set(pixels.columns):
        out = seal_edges(out, h_on, v_on)
    return _pin(out, h_on, v_on).select(*pixels.columns)


def _axis_map(t: Column, from_low: bool, s: float) -> Column:
    p = F.lit(1.0 + STRETCH * s)
    bent = F.pow(C.clamp(t, 0.0, 1.0), p) if from_low else 1.0 - F.pow(C.clamp(1.0 - t, 0.0, 1.0), p)
    return (1.0 - s) * t + s * bent


def warp_map(h_side: str | None, v_side: str | None, s: float) -> tuple[Column, Column]:
    """Source x and y (floating) of each destination pixel, over x, y, w, h."""
    u = F.col("x") / F.greatest(F.col("w") - 1, F.lit(1)).cast("double")
    v = F.col("y") / F.greatest(F.col("h") - 1, F.lit(1)).cast("double")
    turn = 6.283185307179586
    us = _axis_map(u, h_side == "left", s) + WAVE * s * F.sin(turn * v) if h_side else u
    vs = _axis_map(v, v_side == "top", s) + WAVE * s * F.sin(turn * u) if v_side else v
    return us * F.col("w"), vs * F.col("h")


def gather(dest: DataFrame, source: DataFrame, columns: list[str]) -> DataFrame:
    """Join destination rows ``(image_id, y, x, sy, sx)`` to source pixels on the pixel key."""
    src = source.select("image_id", F.col("y").alias("sy"), F.col("x").alias("sx"), *columns)
    return dest.join(src.hint("merge"), ["image_id", "sy", "sx"])


def mesh_warp(pixels: DataFrame, h_side: str | None, v_side: str | None, strength: float = 1.0, nearest: bool = False) -> DataFrame:
    """Power stretch plus sine cut with periodic wrap."""
    vals = payload(pixels)
    s = min(1.0, max(0.0, float(strength)))
    mx, my = warp_map(h_side, v_side, s)
    dest = frame.with_dims(pixels).select("image_id", "y", "x", "w", "h", mx.alias("_mx"), my.alias("_my"))
    w, h = F.col("w"), F.col("h")
    if nearest:
        to = dest.select(
            *KEYS, F.pmod(F.rint("_mx"), w.cast("double")).cast("int").alias("sx"), F.pmod(F.rint("_my"), h.cast("double")).cast("int").alias("sy")
        )
        return gather(to, pixels, vals).select(*pixels.columns)
    d = dest.withColumns({"_px": F.pmod("_mx", w.cast("double")), "_py": F.pmod("_my", h.cast("double"))})
    d = d.withColumns({"_x0": F.floor("_px").cast("int"), "_y0": F.floor("_py").cast("int")})
    wx, wy = F.col("_px") - F.col("_x0"), F.col("_py") - F.col("_y0")
    corner = lambda dx, dy, t: F.struct(
        F.pmod(F.col("_x0") + dx, w).cast("int").alias("sx"), F.pmod(F.col("_y0") + dy, h).cast("int").alias("sy"), t.alias("t")
    )
    corners = F.array(
        corner(0, 0, (1.0 - wx) * (1.0 - wy)), corner(1, 0, wx * (1.0 - wy)), corner(0, 1, (1.0 - wx) * wy), corner(1, 1, wx * wy)
    )
    to = d.select(*KEYS, F.inline(corners))
    out = gather(to, pixels, vals).groupBy(*KEYS).agg(
        *[C.to_byte(C.q(F.sum(F.col("t") * F.col(c)), 9)).alias(c) for c in vals]
    )
    return out.select(*pixels.columns)


def tile_from_motif(pixels: DataFrame, h_side: str | None = "left", v_side: str | None = "top", nearest: bool = True) -> DataFrame:
    """Rebuild the frame from a whole number of motif repeats.

    At most two leftover lines are copied from the motif by modulo; otherwise the
    whole-repeat core is stretched to the frame.  Images that already repeat pass
    through.
    """
    h_on, v_on = bool(h_side), bool(v_side)
    if not h_on and not v_on:
        return pixels
    vals = payload(pixels)
    sizes = frame.dims(pixels)
    info = sizes.join(seams.already_periodic(pixels, h_on, v_on), "image_id")
    for axis, on, p in (("x", h_on, "px"), ("y", v_on, "py")):
        full = "w" if axis == "x" else "h"
        if on:
            info = info.join(seams.axis_period(pixels, axis).withColumnRenamed("period", p), "image_id")
        else:
            info = info.withColumn(p, F.col(full))

    def core(n: str, p: str, low: bool) -> tuple[Column, Column]:
        span = F.when(F.col(p) >= F.col(n), F.col(n)).otherwise(F.floor(F.col(n) / F.col(p)).cast("int") * F.col(p))
        return (F.lit(0) if low else F.col(n) - span), span

    ox, cw = core("w", "px", h_side != "right")
    oy, ch = core("h", "py", v_side != "bottom")
    info = info.withColumns({"_ox": ox, "_cw": cw, "_oy": oy, "_ch": ch})
    info = info.withColumn("_small", (F.col("w") - F.col("_cw")) + (F.col("h") - F.col("_ch")) <= 2)
    info = materialize(info, "motif")
    x, y = F.col("x"), F.col("y")
    ox, oy, cw, ch = (F.col(c) for c in ("_ox", "_oy", "_cw", "_ch"))
    copy_x = F.when(F.lit(h_on) & ((x < ox) | (x >= ox + cw)), ox + F.pmod(x - ox, cw)).otherwise(x)
    copy_y = F.when(F.lit(v_on) & ((y < oy) | (y >= oy + ch)), oy + F.pmod(y - oy, ch)).otherwise(y)
    near_x = ox + F.floor((x + 0.5) * (cw.cast("double") / F.col("w")))
    near_y = oy + F.floor((y + 0.5) * (ch.cast("double") / F.col("h")))
    todo = info.filter("not periodic")
    by_join = todo if nearest else todo.filter("_small")
    dest = pixels.select(*KEYS).join(by_join, "image_id").select(
        *KEYS,
        "w",
        "h",
        F.when(F.col("_small"), copy_x).otherwise(near_x).cast("int").alias("sx"),
        F.when(F.col("_small"), copy_y).otherwise(near_y).cast("int").alias("sy"),
    )
    cols = [*KEYS, "w", "h", *vals]
    out = gather(dest, pixels, vals).select(*cols)
    if not nearest:
        inner = pixels.join(todo.filter("not _small"), "image_id").filter((x >= ox) & (x < ox + cw) & (y >= oy) & (y < oy + ch))
        inner = inner.withColumns({"x": x - ox, "y": y - oy})
        stretched = push_bilinear(inner, "_cw", "_ch", F.col("w"), F.col("h"), vals, ["w", "h", "_cw", "_ch"])
        out = out.unionByName(stretched.select(*cols))
    done = pixels.join(info.filter("periodic").select("image_id"), "image_id")
    return _pin(out, h_on, v_on).select(*pixels.columns).unionByName(done.select(*pixels.columns))
