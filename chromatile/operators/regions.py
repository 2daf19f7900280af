"""Contrast masks, connected regions, line merging and text-region detection."""

from __future__ import annotations

import bisect
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from chromatile.operators import boxes as bx, frame, raster, stencil
from chromatile.operators.stats import exact_percentiles
from chromatile.session import materialize

# Fixed values of the detector.
DELTAS = (12.0, 16.0, 28.0)
MIN_AREA, MIN_SIDE = 24, 4
SMALL_AREA, SMALL_SIDE = 12, 3
MAX_SHARE, ASPECTS, FRAME_SHARE = 0.18, (0.12, 28.0), 0.45
UPSCALE = 3
LINE_GAP, SMALL_GAP = 10, 8
RUN_TILE = 64
# Tables of a round of up to so many edges may be broadcast; more of them meet by merge.
SMALL_ROUND = 1 << 16
# Boxes so high join a line in any row: one row is taken as shared, and that is 0.45 of two.
THIN = 2


def contrast_mask(gray: DataFrame, radius: int | None = None, deltas: Sequence[float] = DELTAS) -> DataFrame:
    """True pixels of every contrast pass: ``(image_id, pass, y, x)``.

    Dark and light passes compare with the local mean, the bright pass with the
    image median.  The window radius follows the image size; images are handled
    per distinct radius, of which work copies have at most fifteen.
    """
    if radius is None:
        sizes = frame.dims(gray)
        wanted = sizes.select("image_id", F.greatest(F.lit(4), F.floor(F.least("w", "h") / 50)).cast("int").alias("_r"))
        wanted = materialize(wanted, "radii")
        radii = sorted(r[0] for r in wanted.select("_r").distinct().collect())
        parts = [
            stencil.box_mean(gray.join(wanted.filter(F.col("_r") == r).select("image_id"), "image_id"), r) for r in radii
        ]
        local = parts[0]
        for p in parts[1:]:
            local = local.unionByName(p)
    else:
        local = stencil.box_mean(gray, radius)
    counts = gray.groupBy("image_id", "v").agg(F.count(F.lit(1)).alias("n"))
    median = exact_percentiles(counts, ["image_id"], "v", "n", [0.5], 1.0)
    bright = median.select("image_id", F.greatest(F.lit(150.0), F.col("p")[0] + 36.0).alias("_bright"))
    v, mean = F.col("v"), F.col("mean")
    passes = []
    for d in deltas:
        passes.append(F.when((v + d < mean) & (v < 210), F.lit(f"dark{d:g}")))
        passes.append(F.when((v > mean + d) & (v > 40), F.lit(f"light{d:g}")))
    passes.append(F.when(v >= F.col("_bright"), F.lit("bright")))
    out = local.join(bright, "image_id")
    return out.select("image_id", F.explode(F.array_compact(F.array(*passes))).alias("pass"), "y", "x")


def _runs(on: DataFrame, keys: list[str]) -> DataFrame:
    row = Window.partitionBy(*keys, "y").orderBy("x")
    grouped = on.withColumn("_g", F.col("x") - F.row_number().over(row))
    runs = grouped.groupBy(*keys, "y", "_g").agg(F.min("x").alias("x0"), (F.max("x") + 1).alias("x1"))
    key = F.col("y").cast("long") * F.lit(2**31) + F.col("x0")
    return runs.select(*keys, key.alias("id"), "y", "x0", "x1")


def _run_edges(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of overlapping runs on adjacent rows, joined per column tile.

    A pair is reported by the tile that holds the start of its overlap only.
    """
    tiles = F.sequence(F.floor(F.col("x0") / RUN_TILE), F.floor((F.col("x1") - 1) / RUN_TILE))
    cut = runs.withColumn("t", F.explode(tiles))
    up = cut.select(*keys, "t", (F.col("y") + 1).alias("y"), F.col("id").alias("a"), F.col("x0").alias("a0"), F.col("x1").alias("a1"))
    j = cut.join(up.hint("merge"), [*keys, "t", "y"])
    hit = (F.col("x0") < F.col("a1")) & (F.col("a0") < F.col("x1"))
    home = F.floor(F.greatest("x0", "a0") / RUN_TILE) == F.col("t")
    return j.filter(hit & home).select(*keys, "a", F.col("id").alias("b"))


def components(nodes: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Component label per node: ``(keys, id, root)``; any member can be the root.

    Each round every node joins the neighbour with the lowest random rank and the
    graph contracts to the surviving labels, so long chains shrink by a constant
    factor per round.  Only tables are carried over; the loop ends when no edge
    is left.
    """
    keys = list(keys)
    labels = nodes.select(*keys, "id", F.col("id").alias("root"))
    edges = materialize(edges, "edges")
    labels = materialize(labels, "labels")
    turn = 0
    while (n := edges.count()) > 0:
        # Files of a few bytes a row would let tables through the driver that are many times as large there.
        met = (lambda df: df) if n <= SMALL_ROUND else (lambda df: df.hint("merge"))
        rank = lambda c: F.xxhash64(F.col(c), F.lit(turn))
        both = edges.unionByName(edges.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(*keys, "a").agg(F.min(F.struct(rank("b").alias("k"), F.col("b").alias("v"))).alias("m"))
        own = F.struct(rank("a").alias("k"), F.col("a").alias("v"))
        step = materialize(low.select(*keys, F.col("a").alias("v"), F.least(own, F.col("m"))["v"].alias("p")), "step")
        again = step.select(*keys, F.col("v").alias("p"), F.col("p").alias("pp"))
        jump = materialize(
            step.join(met(again), [*keys, "p"], "left").select(*keys, "v", F.coalesce("pp", "p").alias("p")), "jump"
        )
        for end in ("a", "b"):
            edges = edges.join(met(jump.select(*keys, F.col("v").alias(end), F.col("p").alias(f"_{end}"))), [*keys, end])
        new = edges.select(*keys, F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))
        edges = materialize(new.filter("a <> b").distinct(), "edges")
        moved = jump.select(*keys, F.col("v").alias("root"), "p")
        labels = materialize(
            labels.join(met(moved), [*keys, "root"], "left").select(*keys, "id", F.coalesce("p", "root").alias("root")), "labels"
        )
        turn += 1
    return labels


def connected_boxes(
    on: DataFrame,
    sizes: DataFrame,
    keys: Sequence[str] = ("image_id",),
    min_area: Column | int | None = None,
    max_area: Column | int | None = None,
    min_side: int = MIN_SIDE,
) -> DataFrame:
    """Bounding boxes of 4-connected regions of True pixels ``(keys, y, x)``.

    Works on horizontal runs.  Area limits may be expressions over the image size
    ``w``, ``h``; the defaults scale with the image.
    """
    keys = list(keys)
    runs = materialize(_runs(on, keys), "runs")
    labels = components(runs, _run_edges(runs, keys), keys)
    regions = (
        runs.join(labels.hint("merge"), [*keys, "id"])
        .groupBy(*keys, "root")
        .agg(
            F.sum(F.col("x1") - F.col("x0")).alias("area"),
            F.min("x0").alias("x0"), F.min("y").alias("y0"), F.max("x1").alias("x1"), (F.max("y") + 1).alias("y1"),
        )
        .join(sizes.select("image_id", "w", "h"), "image_id")
    )
    total = F.col("w").cast("long") * F.col("h")
    lo = F.greatest(F.lit(MIN_AREA), F.floor(total / 8000)) if min_area is None else (min_area if isinstance(min_area, Column) else F.lit(min_area))
    hi = F.greatest(lo + 1, F.floor(total * MAX_SHARE)) if max_area is None else (max_area if isinstance(max_area, Column) else F.lit(max_area))
    bw, bh = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    aspect = bw / bh
    keep = (
        (F.col("area") >= lo) & (F.col("area") <= hi) & (bh >= min_side) & (bw >= min_side)
        & (aspect >= ASPECTS[0]) & (aspect <= ASPECTS[1])
        & ~((bh > F.floor(F.col("h") * FRAME_SHARE)) & (bw > F.floor(F.col("w") * FRAME_SHARE)))
        & bx.thick()
    )
    return regions.filter(keep).select(*keys, "x0", "y0", "x1", "y1", F.col("area").cast("long").alias("area"))


def _grow_lines(pdf: pd.DataFrame, gap: int) -> pd.DataFrame:
    """Greedy line growth over one independent cluster, in (y0, x0) order.

    A box that begins below a line shares no row with it, and then joins only if one of
    the two is at most ``THIN`` high.  A pass over the boxes left therefore ends at the
    foot of the line and goes on with thin boxes only.
    """
    left = sorted(zip(pdf["x0"].tolist(), pdf["y0"].tolist(), pdf["x1"].tolist(), pdf["y1"].tolist()), key=lambda b: (b[1], b[0]))
    count = len(left)
    # Next box still left, for all boxes and for the thin ones, with shortcuts over those used.
    following = list(range(count + 1))
    thin = [i for i, b in enumerate(left) if b[3] - b[1] <= THIN]
    thin_following = list(range(len(thin) + 1))

    def find(links: list[int], i: int) -> int:
        at = i
        while links[at] != at:
            at = links[at]
        while links[i] != at:
            links[i], i = at, links[i]
        return at

    place = {i: k for k, i in enumerate(thin)}

    def use(i: int) -> None:
        following[i] = i + 1
        if i in place:
            thin_following[place[i]] = place[i] + 1

    def next_left(i: int, y0: int, y1: int) -> int:
        """The first box from ``i`` on that may join a line of these rows."""
        i = find(following, i)
        if i == count or left[i][1] < y1 or y1 - y0 <= THIN:
            return i
        k = find(thin_following, bisect.bisect_left(thin, i))
        return thin[k] if k < len(thin) else count

    lines = []
    seed = 0
    while (seed := find(following, seed)) < count:
        x0, y0, x1, y1 = left[seed]
        use(seed)
        grew = True
        while grew:
            grew = False
            i = next_left(seed, y0, y1)
            while i < count:
                b = left[i]
                shared = max(1, min(y1, b[3]) - max(y0, b[1]))
                apart = b[0] > x1 + gap or x0 > b[2] + gap
                if not apart and shared >= 0.45 * min(y1 - y0, b[3] - b[1]):
                    x0, y0, x1, y1 = min(x0, b[0]), min(y0, b[1]), max(x1, b[2]), max(y1, b[3])
                    use(i)
                    grew = True
                i = next_left(i + 1, y0, y1)
        lines.append((x0, y0, x1, y1))
    out = pd.DataFrame(lines, columns=["x0", "y0", "x1", "y1"]).astype("int32")
    out.insert(0, "image_id", pdf["image_id"].iloc[0])
    return out


def _chains(boxes: DataFrame, keys: list[str], lo: str, hi: str, gap: int, name: str) -> DataFrame:
    """Number the chains of spans that lie within ``gap``, on one row per distinct start."""
    starts = boxes.groupBy(*keys, lo).agg(F.max(hi).alias("_far"))
    order = Window.partitionBy(*keys).orderBy(lo)
    reach = F.max("_far").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col(lo) > F.coalesce(reach, F.lit(-(2**30))) + gap, 1).otherwise(0)
    chains = starts.withColumn("_new", fresh).withColumn(name, F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return boxes.join(chains.select(*keys, lo, name), [*keys, lo])


def merge_lines(boxes: DataFrame, gap: int = LINE_GAP) -> DataFrame:
    """Join boxes that sit on one text line.

    The growth is order-dependent, so each group must be folded in one place.
    Boxes can only ever meet when their x-spans, widened by the gap, chain
    together, and, unless a chain holds a thin box, when their y-spans do; those
    chains are found first (on one row per distinct start), and each chain is
    folded on its own.  Exact duplicates change nothing and go first.  Boxes and
    chains are written: each is read several times, and a plan that had their own
    plan in every place would grow twelvefold per call.
    """
    distinct = materialize(boxes.select("image_id", "x0", "y0", "x1", "y1").distinct(), "boxes")
    keyed = materialize(_chains(distinct, ["image_id"], "x0", "x1", gap, "_chain"), "chains")
    open_ = keyed.groupBy("image_id", "_chain").agg(F.max((F.col("y1") - F.col("y0") <= THIN)).alias("_thin"))
    keyed = keyed.join(open_.hint("merge"), ["image_id", "_chain"])
    whole = keyed.filter("_thin").withColumn("_row", F.lit(0).cast("long"))
    cut = _chains(keyed.filter("not _thin"), ["image_id", "_chain"], "y0", "y1", 0, "_row")
    keyed = whole.unionByName(cut)
    kind = dict(boxes.dtypes)["image_id"]
    return keyed.groupBy("image_id", "_chain", "_row").applyInPandas(
        lambda pdf: _grow_lines(pdf, gap), f"image_id {kind}, x0 int, y0 int, x1 int, y1 int"
    )


def _contrast_boxes(gray: DataFrame, small: bool) -> DataFrame:
    sizes = frame.dims(gray)
    on = contrast_mask(gray)
    found = connected_boxes(
        on, sizes, ["image_id", "pass"], SMALL_AREA if small else None, None, SMALL_SIDE if small else MIN_SIDE
    )
    return merge_lines(bx.union_detections(found.drop("pass", "area")), SMALL_GAP if small else LINE_GAP)


def _mapped(boxes: DataFrame, scale: Column, w: Column, h: Column) -> DataFrame:
    """Boxes back to the size they were scaled from; at least two pixels a side."""
    inv = lambda c: F.col(c) / scale
    return bx.normalized(
        boxes, inv("x0"), inv("y0"), F.greatest(inv("x0") + 2.0, inv("x1")), F.greatest(inv("y0") + 2.0, inv("y1")), w, h
    )


def detect_regions(pixels: DataFrame, roi: tuple[int, int, int, int] | None = None, edge: int | None = None) -> DataFrame:
    """Text-like boxes by contrast: ``(image_id, x0, y0, x1, y1)``.

    Searches the image, or a copy of ``edge`` px, then all of it at three times the
    size for small glyphs; with ``roi`` only that rectangle, enlarged.
    """
    gray = stencil.luma_raster(pixels)
    sizes = materialize(frame.dims(pixels), "sizes")

    def enlarged(part: DataFrame) -> DataFrame:
        big = raster.resize_to(part, F.col("w") * UPSCALE, F.col("h") * UPSCALE, "nearest")
        found = _contrast_boxes(materialize(big, "enlarged"), small=True)
        j = merge_lines(found).join(frame.dims(part), "image_id")
        return _mapped(j, F.lit(float(UPSCALE)), F.col("w"), F.col("h")).select("image_id", "x0", "y0", "x1", "y1")

    if roi is not None:
        x0, y0, x1, y1 = roi
        part = gray.filter((F.col("x") >= x0) & (F.col("x") < x1) & (F.col("y") >= y0) & (F.col("y") < y1))
        part = part.withColumns({"x": F.col("x") - x0, "y": F.col("y") - y0})
        hits = enlarged(part)
        return hits.withColumns({"x0": F.col("x0") + x0, "x1": F.col("x1") + x0, "y0": F.col("y0") + y0, "y1": F.col("y1") + y0})
    work, scale = gray, F.lit(1.0)
    if edge is not None:
        tw, th = raster.fit_edge(F.col("w"), F.col("h"), edge)
        work = materialize(raster.resize_to(gray, tw, th, "bilinear"), "work")
        scale = F.least(F.lit(1.0), F.lit(float(edge)) / F.greatest("w", "h"))
    j = merge_lines(_contrast_boxes(work, small=False)).join(sizes, "image_id")
    full = _mapped(j, scale, F.col("w"), F.col("h")).select("image_id", "x0", "y0", "x1", "y1")
    return merge_lines(full.unionByName(enlarged(gray)))
