"""Detail mosaic and the tessellation dispatcher."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from chromatile.operators import frame, raster, seams, stats, stencil
from chromatile.operators.nearest import nearest_join
from chromatile.session import materialize

# Fixed values of the mosaic.
TILES_MIN, TILES_MAX, TILES_DEFAULT = 16, 20000, 9000
LLOYD_MAX, LLOYD_DEFAULT = 6, 2
BLUR, SIDE_BIAS = 1.2, 1.6


def checked_tiles(count: float) -> int:
    """The tile count; one outside the limits is an error, not another count."""
    n = round(float(count))
    if not TILES_MIN <= n <= TILES_MAX:
        raise ValueError(f"tiles must be {TILES_MIN} to {TILES_MAX}, not {n}")
    return n


def clamp_lloyd(count: float) -> int:
    return min(LLOYD_MAX, max(0, round(float(count))))


def place_sites(work: DataFrame, h_side: str | None, v_side: str | None, tiles: int) -> DataFrame:
    """Edge anchors and density-weighted interior seeds: ``(image_id, site_id, x, y, fixed)``.

    The seeds are a weighted sample without replacement: the pixels with the
    smallest -ln(u) / density, u a hash of the position, so reruns agree.
    """
    sizes = frame.dims(work)
    n = F.least(F.lit(checked_tiles(tiles)), F.greatest(F.lit(TILES_MIN), F.floor(F.col("h") * F.col("w") / 4))).cast("int")
    sizes = sizes.withColumn("n", n).withColumn("n_edge", F.greatest(F.lit(6), F.rint(F.sqrt("n")).cast("int")))
    sides = [("top", None), ("bottom", None), ("left", None), ("right", None)]
    if h_side:
        sides.append((h_side, "extra"))
    if v_side:
        sides.append((v_side, "extra"))
    anchors = sizes.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n_edge") - 1)))
    t = F.col("i") / (F.col("n_edge") - 1)
    right, bottom = F.col("w") - 1.0, F.col("h") - 1.0
    spot = {
        "top": (t * right, F.lit(0.0)), "bottom": (t * right, bottom), "left": (F.lit(0.0), t * bottom), "right": (right + F.lit(0.0), t * bottom),
    }
    rows = [F.struct(F.lit(k).alias("side"), spot[s][0].alias("x"), spot[s][1].alias("y")) for k, (s, _) in enumerate(sides)]
    anchors = anchors.select("image_id", "n_edge", "i", F.inline(F.array(*rows)))
    anchors = anchors.select("image_id", (F.col("side") * F.col("n_edge") + F.col("i")).alias("site_id"), "x", "y", F.lit(True).alias("fixed"))

    mag = stencil.smooth(stencil.sobel(stencil.luma_raster(work)).select("image_id", "y", "x", "mag"), "mag", BLUR)
    d = mag.join(sizes, "image_id")
    u, v = (F.col(a) / F.greatest(F.col(s) - 1, F.lit(1)) for a, s in (("x", "w"), ("y", "h")))
    bias = F.lit(1.0)
    if h_side:
        bias = bias * (1.0 + SIDE_BIAS * ((1.0 - u) if h_side == "left" else u))
    if v_side:
        bias = bias * (1.0 + SIDE_BIAS * ((1.0 - v) if v_side == "top" else v))
    d = materialize(d.withColumn("dens", F.col("mag") * bias), "density")
    peak = d.groupBy("image_id").agg(F.max("dens").alias("peak"))
    n_anchor = F.col("n_edge") * len(sides)
    weight = F.col("dens") + 1e-3 * (F.col("peak") + 1.0)
    unit = (F.abs(F.xxhash64("image_id", "y", "x") % 1000003) + 1) / 1000004.0
    keyed = d.join(peak, "image_id").withColumn("_k", -F.log(unit) / weight)
    order = Window.partitionBy("image_id").orderBy("_k", "y", "x")
    # The literal bound lets Spark drop rows before the shuffle; the exact one follows.
    picked = keyed.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= TILES_MAX).filter(F.col("_r") <= F.col("n") - n_anchor)
    interior = picked.select(
        "image_id", (n_anchor + F.col("_r") - 1).alias("site_id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.lit(False).alias("fixed")
    )
    return anchors.unionByName(interior)


def _assign(points: DataFrame, sites: DataFrame) -> DataFrame:
    """Nearest site of each ``(image_id, y, x)``; the lower site id wins ties."""
    targets = sites.select("image_id", F.col("site_id").alias("ord"), F.col("site_id").alias("id"), "x", "y")
    extent = points.agg(F.max("x").alias("w"), F.max("y").alias("h"), F.count(F.lit(1)).alias("n")).first()
    side = max(2.0, (extent["n"] / max(1, targets.count())) ** 0.5)
    out = nearest_join(points, targets, ["x", "y"], side, 2.0 * max(extent["w"], extent["h"], 1), ["image_id"])
    return out.select("image_id", "y", "x", F.col("m.id").alias("site"))


def lloyd_relax(sites: DataFrame, sizes: DataFrame, rounds: int, edge: int | None = None) -> DataFrame:
    """Move free sites to the centroid of their cell, on the image or on a grid of ``edge``; anchors stay."""
    rounds = clamp_lloyd(rounds)
    if rounds == 0:
        return sites
    scale = F.lit(1.0) if edge is None else F.least(F.lit(1.0), F.lit(float(edge)) / F.greatest("w", "h"))
    small = lambda n: F.when(scale < 1.0, F.greatest(F.lit(2), F.rint(F.col(n) * scale).cast("int"))).otherwise(F.col(n)).cast("int")
    info = materialize(sizes.select("image_id", "w", "h", small("w").alias("gw"), small("h").alias("gh")), "relax")
    to = lambda c, a, b: F.col(c) * (F.col(b) - 1.0) / F.greatest(F.col(a) - 1, F.lit(1))
    s = sites.join(info, "image_id").withColumns({"x": to("x", "w", "gw"), "y": to("y", "h", "gh")})
    points = materialize(raster.grid_rows(info, "gw", "gh").select("image_id", "y", "x"), "points")
    s = materialize(s.select(*sites.columns), "sites")
    for _ in range(rounds):
        mean = _assign(points, s).groupBy("image_id", F.col("site").alias("site_id")).agg(F.avg("x").alias("_mx"), F.avg("y").alias("_my"))
        j = s.join(mean, ["image_id", "site_id"], "left")
        keep = lambda c: F.when(F.col("fixed"), F.col(c)).otherwise(F.coalesce(f"_m{c}", F.lit(0.0))).alias(c)
        s = materialize(j.select("image_id", "site_id", keep("x"), keep("y"), "fixed"), "sites")
    back = s.join(info, "image_id").withColumns({"x": to("x", "gw", "w"), "y": to("y", "gh", "h")})
    return back.select(*sites.columns)


def mosaic_cells(
    pixels: DataFrame, tiles: int = TILES_DEFAULT, lloyd: int = LLOYD_DEFAULT, h_side: str | None = None, v_side: str | None = None, nearest: bool = False,
    edge: int | None = None,
) -> DataFrame:
    """Voronoi mosaic of the image, or of a copy of ``edge`` px, enlarged by nearest sampling."""
    sizes = materialize(frame.dims(pixels), "sizes")
    work = pixels
    if edge is not None:
        tw, th = raster.fit_edge(F.col("w"), F.col("h"), edge, rounding="nearest")
        work = materialize(raster.resize_to(pixels, tw, th, "bilinear"), "work")
    sites = materialize(place_sites(work, h_side, v_side, tiles), "sites")
    sites = materialize(lloyd_relax(sites, frame.dims(work), lloyd), "sites")
    cells = materialize(_assign(work.select("image_id", "y", "x"), sites), "cells")
    if nearest:
        seeds = frame.with_dims(sites, frame.dims(work)).select(
            "image_id", F.col("site_id").alias("site"),
            F.least(F.col("w") - 1, F.greatest(F.lit(0), F.rint("x").cast("int"))).alias("x"), F.least(F.col("h") - 1, F.greatest(F.lit(0), F.rint("y").cast("int"))).alias("y"),
        )
        colors = seeds.join(work, ["image_id", "y", "x"]).select("image_id", "site", "r", "g", "b")
    else:
        colors = stats.cell_means(work.join(cells, ["image_id", "y", "x"]), sites)
    painted = cells.join(colors, ["image_id", "site"]).drop("site")
    small = frame.dims(work).select("image_id", F.col("w").alias("_sw"), F.col("h").alias("_sh"))
    up = painted.join(sizes, "image_id").join(small, "image_id")
    out = raster.push_nearest(up, "_sw", "_sh", F.col("w"), F.col("h")).select("image_id", "y", "x", "r", "g", "b")
    rest = [c for c in pixels.columns if c not in ("r", "g", "b")]
    return pixels.select(*rest).join(out, ["image_id", "y", "x"]).select(*pixels.columns)


# Accepted spellings of each mode.
MODES = {
    "mesh": ("mesh", "mesh_warp", "warp", "escher"),
    "mosaic": ("voronoi", "detail", "detail_mosaic", "mosaic", "cells"),
    "hilbert": ("tessellate", "tessellation", "hilbert", "crinkly", "diffuse"),
    "tile": ("tile", "tile_repeating_design", "repeating", "repeat", "repeat_tile", "pattern", "pattern_tile", "repeating_design"),
}
SPELLINGS = {spelling: mode for mode, spellings in MODES.items() for spelling in spellings}
SIDES = {"left": "left", "l": "left", "right": "right", "r": "right", "top": "top", "t": "top", "up": "top", "bottom": "bottom", "b": "bottom", "down": "bottom"}


def normalize_mode(mode: str | None) -> str:
    """Mode of a spelling: brackets do not count, words may be parted by spaces, dashes or underscores."""
    words = re.findall(r"[^\s_-]+", re.sub(r"[()]", "", mode or "").casefold())
    return SPELLINGS.get("_".join(words), "tile")


def normalize_side(side: str | None, axis: str) -> str | None:
    found = SIDES.get(str(side or "").strip().lower())
    return found if found in (("left", "right") if axis == "x" else ("top", "bottom")) else None


def _unless_wrapped(pixels: DataFrame, h_side, v_side, nearest: bool) -> DataFrame:
    """Hilbert blend for images whose wrap edges do not agree yet."""
    if not h_side and not v_side:
        return pixels
    cost = materialize(seams.seam_mismatch(pixels, bool(h_side), bool(v_side)), "cost")
    open_ = cost.filter(F.col("cost") > seams.MATCH_LIMIT).select("image_id")
    todo = pixels.join(open_, "image_id", "left_semi")
    done = pixels.join(open_, "image_id", "left_anti")
    return raster.crinkly_blend(todo, h_side, v_side, nearest).select(*pixels.columns).unionByName(done)


def tessellate(
    pixels: DataFrame, mode: str | None = "tile", h_side: str | None = None, v_side: str | None = None, built: bool = True,
    nearest: bool = False, tiles: int = TILES_DEFAULT, lloyd: int = LLOYD_DEFAULT,
) -> DataFrame:
    """Make images wrap by the chosen mode.

    Identity unless built; tile, Hilbert and mesh also need a side, the mosaic
    runs without one.
    """
    m, h, v = normalize_mode(mode), normalize_side(h_side, "x"), normalize_side(v_side, "y")
    if not built or (m != "mosaic" and not h and not v):
        return pixels
    if m == "mesh":
        return raster.mesh_warp(pixels, h, v, 1.0, nearest)
    if m == "mosaic":
        return _unless_wrapped(materialize(mosaic_cells(pixels, tiles, lloyd, h, v, nearest), "mosaic"), h, v, nearest)
    if m == "hilbert":
        return _unless_wrapped(pixels, h, v, nearest)
    return raster.tile_from_motif(pixels, h, v, nearest)
