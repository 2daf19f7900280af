"""Wrap cost, motif period and the searches built on them.

Searches build tables of line pairs first: running sums of the differences of two lines
of the image, for the few distances of lines that any candidate needs.  A candidate then
reads two rows per line of its edge strips, whatever the size of its window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from chromatile.functions.color import luma, q
from chromatile.operators import frame
from chromatile.session import materialize

# Fixed values of the search.
BAND = 8
STRUCTURE_WEIGHT, COLOR_WEIGHT = 1.0, 0.15
MATCH_LIMIT = 0.25
PERIOD_MIN, PEAK_MIN, PEAK_SHARE = 4, 0.18, 0.45
ZOOMS = (1.0, 1.08, 1.16, 1.25)
ORIGINS = 7
ZOOM_COST, LEFTOVER_COST = 0.02, 80.0
SHIFT_SHARE = 0.12
# Positions of one piece of a signal; up to so many, products are summed without a transform.
PIECE, DIRECT = 2**16, 64


def band_size(n: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(BAND), F.greatest(F.lit(1), F.floor(n / 4)))).cast("int")


def strip_costs(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Cost of matched strips from rows ``(keys, i, j, side, r, g, b)``.

    The two sides of a position meet in one aggregate.  With d = a - b, the
    zero-mean term is E[d^2] - E[d]^2 per channel, so one more aggregate gives
    the cost.
    """
    side = {c: [F.max(F.when(F.col("side") == s, F.col(c))) for s in (0, 1)] for c in "rgb"}
    diff = pairs.groupBy(*keys, "i", "j").agg(*[(a - b).cast("double").alias(f"d{c}") for c, (a, b) in side.items()])
    raw = sum((F.avg(F.col(f"d{c}") * F.col(f"d{c}")) for c in "rgb"), F.lit(0.0)) / 3.0
    mean2 = sum((F.avg(f"d{c}") * F.avg(f"d{c}") for c in "rgb"), F.lit(0.0)) / 3.0
    return diff.groupBy(*keys).agg((STRUCTURE_WEIGHT * (raw - mean2) + COLOR_WEIGHT * raw).alias("cost"))


def _roles(x: Column, y: Column, w: Column, h: Column, h_on: bool, v_on: bool) -> Column:
    """Strip roles of a window-relative pixel: array of (axis, i, j, side)."""
    bw, bh = band_size(w), band_size(h)

    def role(axis: int, i: Column, j: Column, side: int) -> Column:
        return F.struct(F.lit(axis).alias("axis"), i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(side).alias("side"))

    out = []
    if h_on:
        out += [F.when(x < bw, role(0, x, y, 0)), F.when(x >= w - bw, role(0, x - (w - bw), y, 1))]
    if v_on:
        out += [F.when(y < bh, role(1, y, x, 0)), F.when(y >= h - bh, role(1, y - (h - bh), x, 1))]
    if h_on and v_on:
        # A corner pixel of a one-pixel side plays several corners.
        for cx in (0, 1):
            for cy in (0, 1):
                at = (x == (F.lit(0) if cx == 0 else w - 1)) & (y == (F.lit(0) if cy == 0 else h - 1))
                out.append(F.when(at, role(2, F.lit(cx), F.lit(cy), 0)))
    return F.array_compact(F.array(*out))


def _edge_cost(rows: DataFrame, keys: list[str], h_on: bool, v_on: bool) -> DataFrame:
    """Average of the strip costs and, with both axes on, of the corner variance."""
    strips = strip_costs(rows.filter("axis < 2"), [*keys, "axis"]).select(*keys, "cost")
    terms = int(h_on) + int(v_on)
    if h_on and v_on:
        var = sum((F.var_pop(c) for c in "rgb"), F.lit(0.0)) / 3.0
        corners = rows.filter("axis = 2").groupBy(*keys).agg(var.alias("cost"))
        strips = strips.unionByName(corners)
        terms += 1
    return strips.groupBy(*keys).agg((F.sum("cost") / float(terms)).alias("cost"))


def seam_mismatch(pixels: DataFrame, h_on: bool = True, v_on: bool = True) -> DataFrame:
    """Wrap-edge cost per image, ``(image_id, cost)``.  Only strip pixels are shuffled."""
    sized = frame.with_dims(pixels, materialize(frame.dims(pixels), "sizes"))
    roles = _roles(F.col("x"), F.col("y"), F.col("w"), F.col("h"), h_on, v_on)
    rows = sized.select("image_id", "r", "g", "b", F.inline(roles))
    return _edge_cost(rows, ["image_id"], h_on, v_on)


def profile(pixels: DataFrame, axis: str) -> DataFrame:
    """Mean luma per position, with the length of the axis."""
    p = frame.probe(pixels)
    size = "w" if axis == "x" else "h"
    return p.groupBy("image_id", F.col(axis).alias("pos")).agg(
        F.avg(luma(F.col("r"), F.col("g"), F.col("b"))).alias("m"),
        F.max(size).alias("n"),
        F.max(f"full_{size}").alias("n_full"),
    )


def _cross(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of ``a`` with ``b`` shifted by -(len(a) - 1) .. len(b) - 1, summed."""
    if min(len(a), len(b)) <= DIRECT:
        return np.correlate(b, a, "full")
    size = 1 << (len(a) + len(b) - 2).bit_length()
    return np.fft.irfft(np.fft.rfft(a[::-1], size) * np.fft.rfft(b, size), size)[: len(a) + len(b) - 1]


def _products(signal: DataFrame) -> DataFrame:
    """Sums of the products of a signal with itself, ``(image_id, lag, dot)``, for the lags below ``hi``.

    ``signal`` is ``(image_id, pos, v, hi)``.  It is cut into pieces, and every two pieces
    that a lag can bring together meet in one row, so no row grows with the image.
    """
    kind = signal.schema["image_id"].dataType
    piece = F.floor(F.col("pos") / PIECE)
    cut = signal.groupBy("image_id", "hi", piece.alias("i")).agg(F.sort_array(F.collect_list(F.struct((F.col("pos") - piece * PIECE).cast("int").alias("at"), "v"))).alias("s"))
    cut = materialize(cut.select("image_id", "hi", "i", F.col("s.at").alias("at"), F.col("s.v").alias("v")), "pieces")
    meet = F.sequence(F.col("i"), F.col("i") + F.floor((F.col("hi") + (PIECE - 2)) / PIECE))
    far = cut.select("image_id", F.col("i").alias("j"), F.col("at").alias("at2"), F.col("v").alias("v2"))
    pairs = cut.withColumn("j", F.explode(meet)).join(far.hint("merge"), ["image_id", "j"]).select("image_id", "hi", (F.col("j") - F.col("i")).alias("d"), "at", "v", "at2", "v2")
    out = T.StructType([T.StructField("image_id", kind), T.StructField("first", T.LongType()), T.StructField("dots", T.ArrayType(T.DoubleType()))])

    def dense(at: pa.Scalar, v: pa.Scalar) -> np.ndarray:
        line = np.zeros(at.values[-1].as_py() + 1)
        line[at.values.to_numpy()] = v.values.to_numpy(zero_copy_only=False)
        return line

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column
            for lo in range(0, batch.num_rows, 256):
                first, dots = [], []
                for k in range(lo, min(lo + 256, batch.num_rows)):
                    a, b = dense(col("at")[k], col("v")[k]), dense(col("at2")[k], col("v2")[k])
                    start, end = col("d")[k].as_py() * PIECE - (len(a) - 1), col("hi")[k].as_py()
                    skip = max(0, -start)
                    first.append(start + skip)
                    dots.append(_cross(a, b)[skip : max(skip, end - start)])
                yield pa.RecordBatch.from_arrays([col("image_id").slice(lo, 256), pa.array(first, pa.int64()), pa.array(dots, pa.list_(pa.float64()))], names=out.names)

    parts = pairs.mapInArrow(run, out).select("image_id", "first", F.posexplode("dots").alias("k", "dot"))
    return parts.groupBy("image_id", (F.col("first") + F.col("k")).alias("lag")).agg(F.sum("dot").alias("dot"))


def axis_period(pixels: DataFrame, axis: str = "x") -> DataFrame:
    """Motif period along an axis, ``(image_id, period)``; the full span when not periodic.

    The profile, one row per line of the image, is correlated with itself piece by piece;
    the peaks are found on one row per lag, next to the rows of the lags beside it.
    """
    lo = PERIOD_MIN
    lines = materialize(profile(pixels, axis), "profile")
    size = lines.groupBy("image_id").agg((F.sum("m") / F.max("n")).alias("mean"), F.max("n").alias("n"), F.max("n_full").alias("n_full"))
    # Lags from ``lo`` to below ``hi`` are searched.
    size = size.withColumn("hi", F.greatest(F.lit(lo + 1), F.floor(F.col("n") / 2)).cast("int"))
    signal = lines.select("image_id", "pos", "m").join(size.hint("merge"), "image_id").select("image_id", "pos", (F.col("m") - F.col("mean")).alias("v"), "hi")
    energy = signal.groupBy("image_id").agg(F.sum(F.col("v") * F.col("v")).alias("e"))
    size = materialize(size.join(energy, "image_id").drop("mean"), "signal")
    ac = _products(signal.filter("v is not null")).join(size.select("image_id", "n", "e").hint("merge"), "image_id").filter("lag < n")
    ac = materialize(ac.select("image_id", "lag", q(F.col("dot") / (F.col("e") + 1e-12), 9).alias("ac")), "correlation")
    beside = [F.struct((F.col("lag") + d).alias("lag"), F.lit(d).alias("d")) for d in (-1, 0, 1)]
    met = ac.select("image_id", "ac", F.inline(F.array(*beside))).groupBy("image_id", "lag")
    met = met.agg(*[F.max(F.when(F.col("d") == d, F.col("ac"))).alias(c) for c, d in (("at", 0), ("before", 1), ("after", -1))])
    top = ac.join(size.select("image_id", "hi").hint("merge"), "image_id").filter((F.col("lag") >= lo) & (F.col("lag") < F.col("hi")))
    size = size.join(top.groupBy("image_id").agg(F.max("ac").alias("peak")), "image_id", "left")
    size = materialize(size.withColumn("th", F.greatest(F.lit(PEAK_MIN), PEAK_SHARE * F.col("peak"))), "peak")
    lag, at = F.col("lag"), F.col("at")
    inner = (lag >= lo + 1) & (lag <= F.col("hi") - 2) & (at >= F.col("before")) & (at >= F.col("after")) & (at >= F.col("th"))
    best = (lag >= lo) & (lag < F.col("hi")) & (at == F.col("peak"))
    found = met.join(size.select("image_id", "hi", "peak", "th").hint("merge"), "image_id").filter(inner | best).groupBy("image_id")
    found = found.agg(F.min(F.when(inner, lag)).alias("first"), F.min(F.when(best, lag)).alias("best"))
    c = F.coalesce("first", "best")
    found = materialize(found.select("image_id", c.alias("c"), F.floor(c / 2).alias("half")), "chosen")
    halves = ac.select("image_id", F.col("lag").alias("half"), F.col("ac").alias("at_half"))
    s = size.join(found.join(halves.hint("merge"), ["image_id", "half"], "left"), "image_id", "left")
    n = F.col("n")
    chosen = F.when((F.col("half") >= lo) & (F.col("at_half") >= F.col("th") * 0.85), F.col("half")).otherwise(F.col("c"))
    none = (n < 2 * lo) | (F.col("e") < 1e-6) | (F.col("hi") - lo < 3) | (F.col("peak") < PEAK_MIN)
    s = s.withColumn("k", F.when(none, n).otherwise(F.greatest(F.lit(lo), F.least(n, chosen))))
    scaled = F.rint(F.col("k") * F.col("n_full") / n).cast("int")
    period = F.when((F.col("n_full") < 2 * lo) | (F.col("k") >= F.floor(n / 2)), F.col("n_full")).otherwise(
        F.greatest(F.lit(lo), F.least(F.col("n_full"), scaled))
    )
    return materialize(s.select("image_id", period.cast("int").alias("period")), "period")


def _origins(top: Column, flip: bool) -> Column:
    """Evenly spaced origins 0..top, at most seven, in search order."""
    count = F.least(F.lit(ORIGINS), top + 1)
    spread = F.transform(
        F.sequence(F.lit(0), count - 1), lambda i: F.rint(i * (top / F.greatest(count - 1, F.lit(1)))).cast("int")
    )
    out = F.when(top <= 0, F.array(F.lit(0))).otherwise(spread)
    return F.reverse(out) if flip else out


def _window(n: Column, z: Column) -> Column:
    return F.greatest(F.lit(1), F.least(n, F.rint(n / z).cast("int")))


def _line_sums(pixels: DataFrame, wanted: DataFrame, axis: str) -> DataFrame:
    """Running sums of the differences of lines ``line`` and ``line + lag``: ``(image_id, lag, line, upto, dr, dg, db, dd)``.

    ``wanted`` is ``(image_id, lag, line)``, distinct; ``upto`` counts the positions summed.
    """
    other = "y" if axis == "x" else "x"
    ends = [F.struct((F.col("line") + far).alias(axis), F.lit(s).alias("side")) for s, far in ((0, F.lit(0)), (1, F.col("lag")))]
    pairs = wanted.select("image_id", "lag", "line", F.inline(F.array(*ends)))
    met = pixels.select("image_id", axis, F.col(other).alias("pos"), "r", "g", "b").join(pairs, ["image_id", axis])
    d = _differences(met, ["image_id", "lag", "line", "pos"])
    run = Window.partitionBy("image_id", "lag", "line").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return d.select("image_id", "lag", "line", (F.col("pos") + 1).alias("upto"), *[F.sum(c).over(run).alias(c) for c in SUMS])


#: Sums of the differences per channel, and of their squares over all channels.
SUMS = ("dr", "dg", "db", "dd")


def _differences(sides: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, dr, dg, db, dd)`` of the two sides that meet at ``keys``."""
    at = lambda c, s: F.max(F.when(F.col("side") == s, F.col(c)))
    d = sides.groupBy(*keys).agg(*[(at(c, 0) - at(c, 1)).cast("long").alias(f"d{c}") for c in "rgb"])
    return d.withColumn("dd", F.col("dr") * F.col("dr") + F.col("dg") * F.col("dg") + F.col("db") * F.col("db"))


def _cost_of_sums(n: Column) -> Column:
    """Strip cost from whole sums over ``n`` positions."""
    raw = F.col("dd") / n / 3.0
    mean2 = sum((F.col(c) / n * (F.col(c) / n) for c in SUMS[:3]), F.lit(0.0)) / 3.0
    return STRUCTURE_WEIGHT * (raw - mean2) + COLOR_WEIGHT * raw


def _window_costs(pixels: DataFrame, windows: DataFrame, axis: str) -> DataFrame:
    """Strip cost of every window along one axis, ``(image_id, ord, cost)``."""
    names = ("x0", "cw", "y0", "ch") if axis == "x" else ("y0", "ch", "x0", "cw")
    start, size, base, across = (F.col(c) for c in names)
    band = band_size(size)
    lines = windows.select("image_id", "ord", (size - band).alias("lag"), base.alias("a"), (base + across).alias("z"), (band * across).alias("n"), F.explode(F.sequence(start, start + band - 1)).alias("line"))
    table = _line_sums(pixels, lines.select("image_id", "lag", "line").distinct(), axis)
    marks = F.array(F.struct(F.col("a").alias("upto"), F.lit(-1).alias("sign")), F.struct(F.col("z").alias("upto"), F.lit(1).alias("sign")))
    ends = lines.select("image_id", "ord", "lag", "line", "n", F.inline(marks)).filter("upto > 0")
    sums = ends.join(table, ["image_id", "lag", "line", "upto"]).groupBy("image_id", "ord").agg(*[F.sum(F.col(c) * F.col("sign")).alias(c) for c in SUMS], F.first("n").alias("n"))
    return sums.select("image_id", "ord", _cost_of_sums(F.col("n")).alias("cost"))


def _corner_costs(pixels: DataFrame, windows: DataFrame) -> DataFrame:
    """Variance of the four corners of every window, ``(image_id, ord, cost)``."""
    right, bottom = F.col("x0") + F.col("cw") - 1, F.col("y0") + F.col("ch") - 1
    spots = [F.struct(x.alias("x"), y.alias("y")) for x in (F.col("x0"), right) for y in (F.col("y0"), bottom)]
    met = windows.select("image_id", "ord", F.inline(F.array(*spots))).join(pixels.select("image_id", "x", "y", "r", "g", "b"), ["image_id", "x", "y"])
    var = sum((4 * F.sum(F.col(c) * F.col(c)) - F.sum(c) * F.sum(c) for c in "rgb"), F.lit(0)) / 48.0
    return met.groupBy("image_id", "ord").agg(var.alias("cost"))


def _search(probe: DataFrame, windows: DataFrame, h_on: bool, v_on: bool) -> DataFrame:
    """Cheapest window per image of ``windows`` ``(image_id, ord, zoom, x0, y0, cw, ch, extra)``; ties go to the lowest ``ord``."""
    usable = materialize(windows.filter("cw >= 2 and ch >= 2"), "windows")
    terms = [_window_costs(probe, usable, axis) for axis, on in (("x", h_on), ("y", v_on)) if on]
    if h_on and v_on:
        terms.append(_corner_costs(probe, usable))
    costs = terms[0]
    for t in terms[1:]:
        costs = costs.unionByName(t)
    cost = costs.groupBy("image_id", "ord").agg((F.sum("cost") / float(len(terms))).alias("cost"))
    scored = usable.join(cost, ["image_id", "ord"])
    total = q(F.col("cost") + F.col("extra"), 6)
    return scored.groupBy("image_id").agg(F.min(F.struct(total.alias("cost"), "ord", "zoom", "x0", "y0")).alias("m")).select("image_id", "m.*")


def _to_full(best: DataFrame, sizes: DataFrame) -> DataFrame:
    """Scale an origin back to the image and keep it legal; an image too small for any window keeps all of itself."""
    j = sizes.join(best, "image_id", "left").fillna({"x0": 0, "y0": 0, "zoom": 1.0, "cost": 0.0})

    def back(o: str, p: str, f: str) -> Column:
        top = F.col(f) - _window(F.col(f), F.col("zoom"))
        full = F.rint((F.col(o).cast("double") / F.col(p)) * F.col(f)).cast("int")
        return F.greatest(F.lit(0), F.least(full, top))

    return j.select(
        "image_id", back("x0", "w", "full_w").alias("x"), back("y0", "h", "full_h").alias("y"), "zoom", "cost"
    )


def _probe_sizes(probe: DataFrame) -> DataFrame:
    return probe.groupBy("image_id").agg(*[F.max(c).alias(c) for c in ("w", "h", "full_w", "full_h")])


def _zoom_cost(z: Column) -> Column:
    return ZOOM_COST * (z - 1.0) * 255.0 * 255.0


def _order() -> Column:
    """Search order of a window: by zoom, then row, then column of its origin."""
    return (F.col("zi").cast("long") * 2**21 + F.col("yi")) * 2**21 + F.col("xi")


def best_wrap_crop(pixels: DataFrame, h_side: str | None = "left", v_side: str | None = "top") -> DataFrame:
    """Crop window with the cheapest wrap: ``(image_id, x, y, zoom, cost)``."""
    probe = frame.probe(pixels)
    sizes = _probe_sizes(probe)
    zooms = F.array(*[F.struct(F.lit(i).alias("zi"), F.lit(z).alias("zoom")) for i, z in enumerate(ZOOMS)])
    w = sizes.select("image_id", "w", "h", F.inline(zooms)).withColumns(
        {"cw": _window(F.col("w"), F.col("zoom")), "ch": _window(F.col("h"), F.col("zoom"))}
    )
    zero = F.array(F.lit(0))
    xs = _origins(F.col("w") - F.col("cw"), h_side == "right") if h_side else zero
    ys = _origins(F.col("h") - F.col("ch"), v_side == "bottom") if v_side else zero
    w = w.withColumn("_xs", xs).select("*", F.posexplode(ys).alias("yi", "y0")).select("*", F.posexplode("_xs").alias("xi", "x0"))
    order = _order()
    windows = w.select("image_id", order.alias("ord"), "zoom", "x0", "y0", "cw", "ch", _zoom_cost(F.col("zoom")).alias("extra"))
    return _to_full(_search(probe, windows, bool(h_side), bool(v_side)), sizes)


def best_repeat_crop(pixels: DataFrame, h_side: str | None = "left", v_side: str | None = "top") -> DataFrame:
    """The same over windows that prefer whole motif repeats, at every step of the period."""
    h_on, v_on = bool(h_side), bool(v_side)
    probe = frame.probe(pixels)
    sizes = _probe_sizes(probe)
    plain = probe.select("image_id", "y", "x", "r", "g", "b")
    px = axis_period(plain, "x").withColumnRenamed("period", "px")
    py = axis_period(plain, "y").withColumnRenamed("period", "py")
    s = sizes.join(px, "image_id").join(py, "image_id")
    s = s.withColumns(
        {"px": F.col("px") if h_on else F.col("w"), "py": F.col("py") if v_on else F.col("h")}
    )

    def repeats(n: str, p: str, on: bool) -> Column:
        none = F.array().cast("array<double>")
        if not on:
            return none
        counts = F.sequence(F.greatest(F.lit(1), F.floor(F.col(n) / F.col(p)).cast("int")), F.lit(1))
        zs = F.transform(counts, lambda c: F.col(n).cast("double") / F.greatest(F.lit(1), c * F.col(p)))
        return F.when(F.col(p) >= PERIOD_MIN, F.filter(zs, lambda z: (z >= 1.0) & (z <= 8.0))).otherwise(none)

    zooms = F.sort_array(F.concat(F.array(*[F.lit(z) for z in ZOOMS]), repeats("w", "px", h_on), repeats("h", "py", v_on)))
    rounded = lambda z: F.rint(z * 1e4)
    fresh = F.filter(zooms, lambda z, i: (i == 0) | (rounded(z) != rounded(F.get("_z", i - 1))))
    w = s.withColumn("_z", zooms).withColumn("_z", fresh).select("*", F.posexplode("_z").alias("zi", "zoom"))
    w = w.withColumns({"cw": _window(F.col("w"), F.col("zoom")), "ch": _window(F.col("h"), F.col("zoom"))})

    def starts(n: str, c: str, p: str, on: bool, low: bool) -> Column:
        if not on:
            return F.array(F.lit(0))
        top = F.col(n) - F.col(c)
        steps = F.array_union(F.sequence(F.lit(0), top, F.col(p)), F.array(top))
        ordered = F.array_union(steps if low else F.reverse(steps), F.array(F.lit(0)))
        return F.when(top <= 0, F.array(F.lit(0))).otherwise(ordered)

    def leftover(c: str, p: str, on: bool) -> Column:
        rest = F.col(c) % F.col(p)
        return F.when(F.lit(on) & (F.col(p) >= 2), F.least(rest, F.when(rest != 0, F.col(p) - rest).otherwise(0))).otherwise(0)

    xs = starts("w", "cw", "px", h_on, h_side != "right")
    ys = starts("h", "ch", "py", v_on, v_side != "bottom")
    w = w.withColumn("_xs", xs).select("*", F.posexplode(ys).alias("yi", "y0")).select("*", F.posexplode("_xs").alias("xi", "x0"))
    extra = (leftover("cw", "px", h_on) + leftover("ch", "py", v_on)) * LEFTOVER_COST + _zoom_cost(F.col("zoom"))
    order = _order()
    windows = w.select("image_id", order.alias("ord"), "zoom", "x0", "y0", "cw", "ch", extra.alias("extra"))
    return _to_full(_search(probe, windows, h_on, v_on), sizes)


def best_shift(pixels: DataFrame, axis: str = "x") -> DataFrame:
    """Signed integer roll with the cheapest wrap, ``(image_id, shift)``: all rolls up to 12 % of the side, the smallest first.

    A roll by ``s`` brings lines ``i - s`` and ``i - s - band`` together at the wrap, so one
    table of the differences of lines ``band`` apart, around the end, has the costs of all rolls.
    """
    size, other = ("w", "y") if axis == "x" else ("h", "x")
    sized = frame.with_dims(pixels).withColumnRenamed(size, "n")
    band, n = band_size(F.col("n")), F.col("n")
    sides = [F.struct(F.pmod(F.col(axis) + far, n).cast("int").alias("line"), F.lit(s).alias("side")) for s, far in ((0, F.lit(0)), (1, band))]
    met = sized.select("image_id", F.col(other).alias("pos"), "r", "g", "b", F.inline(F.array(*sides)))
    lines = _differences(met, ["image_id", "line", "pos"]).groupBy("image_id", "line").agg(*[F.sum(c).alias(c) for c in SUMS], F.count("*").alias("m"))
    span = F.greatest(F.lit(1), F.rint(n * SHIFT_SHARE).cast("int"))
    sizes = sized.groupBy("image_id").agg(F.max("n").alias("n")).select("image_id", "n", band.alias("band"), F.explode(F.sequence(-span, span)).alias("s"))
    rolls = sizes.select("image_id", "n", "s", F.explode(F.transform(F.sequence(F.lit(0), F.col("band") - 1), lambda i: F.pmod(i - F.col("s"), n).cast("int"))).alias("line"))
    cost = rolls.join(lines, ["image_id", "line"]).groupBy("image_id", "n", "s").agg(*[F.sum(c).alias(c) for c in SUMS], F.sum("m").alias("m"))
    cost = cost.select("image_id", "n", "s", q(_cost_of_sums(F.col("m")), 6).alias("c"))
    best = cost.groupBy("image_id", "n").agg(F.min_by("s", F.struct("c", F.abs("s"), -F.col("s"))).alias("s"))
    s = F.pmod("s", n)
    return best.select("image_id", F.when(s > F.floor(n / 2), s - n).otherwise(s).cast("int").alias("shift"))


def cells_match(pixels: DataFrame, periods: DataFrame, axis: str) -> DataFrame:
    """Whether the first two motif cells along an axis agree, ``(image_id, same, whole)``."""
    size, other = ("w", "y") if axis == "x" else ("h", "x")
    sized = frame.with_dims(pixels).join(periods, "image_id")
    p, n = F.col("period"), F.col(size)
    usable = (p >= 2) & (p <= F.floor(n / 2))
    rows = sized.filter(usable & (F.col(axis) < 2 * p)).select(
        "image_id", (F.col(axis) % p).alias("i"), F.col(other).alias("j"), F.when(F.col(axis) < p, 0).otherwise(1).alias("side"), "r", "g", "b"
    )
    cost = strip_costs(rows, ["image_id"])
    whole = frame.dims(pixels).join(periods, "image_id").select("image_id", (usable & (n % p == 0)).alias("whole"))
    return whole.join(cost, "image_id", "left").select(
        "image_id", F.coalesce(F.col("cost") <= MATCH_LIMIT, F.lit(False)).alias("same"), "whole"
    )


def already_periodic(pixels: DataFrame, h_on: bool, v_on: bool) -> DataFrame:
    """Whether an image already repeats on the chosen axes, ``(image_id, periodic)``."""
    out = seam_mismatch(pixels, h_on, v_on).select("image_id", (F.col("cost") <= MATCH_LIMIT).alias("edges"))
    cells = F.lit(True)
    for axis, on in (("x", h_on), ("y", v_on)):
        if on:
            m = cells_match(pixels, axis_period(pixels, axis), axis).select("image_id", (F.col("same") & F.col("whole")).alias(f"_{axis}"))
            out = out.join(m, "image_id")
            cells = cells & F.col(f"_{axis}")
    return out.select("image_id", (F.col("edges") | cells).alias("periodic"))


def _cut(pixels: DataFrame, crops: DataFrame) -> DataFrame:
    """The pixels inside each image's crop ``(image_id, x, y, zoom)``, re-based to zero."""
    c = frame.dims(pixels).join(crops, "image_id").select(
        "image_id", F.col("x").alias("_x"), F.col("y").alias("_y"), _window(F.col("w"), F.col("zoom")).alias("_w"), _window(F.col("h"), F.col("zoom")).alias("_h")
    )
    at = {a: (F.col(a) - F.col(f"_{a}")).cast("int") for a in ("x", "y")}
    inside = (at["x"] >= 0) & (at["x"] < F.col("_w")) & (at["y"] >= 0) & (at["y"] < F.col("_h"))
    return pixels.join(c, "image_id").filter(inside).select(*[at[n].alias(n) if n in at else F.col(n) for n in pixels.columns])


def plan_crop(pixels: DataFrame, h_side: str | None = "left", v_side: str | None = "top", tile: bool = True) -> DataFrame:
    """Crop to make an image wrap, ``(image_id, x, y, zoom)``; the identity for one that wraps already.

    ``tile`` keeps whole motif repeats; otherwise the cheapest wrap window, moved by
    the roll that still improves its edges as far as it fits.
    """
    h_on, v_on = bool(h_side), bool(v_side)
    still = lambda ids: ids.select("image_id", F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(1.0).alias("zoom"))
    if not h_on and not v_on:
        return still(frame.dims(pixels))
    if tile:
        wraps = already_periodic(pixels, h_on, v_on).filter("periodic")
    else:
        wraps = seam_mismatch(pixels, h_on, v_on).filter(F.col("cost") <= MATCH_LIMIT)
    wraps = materialize(wraps.select("image_id"), "wraps")
    todo = pixels.join(wraps, "image_id", "left_anti")
    found = best_repeat_crop(todo, h_side, v_side) if tile else best_wrap_crop(todo, h_side, v_side)
    found = materialize(found.select("image_id", "x", "y", "zoom"), "crop")
    if not tile:
        work = _cut(todo, found)
        moved = found.join(frame.dims(todo), "image_id")
        for axis, size, on in (("x", "w", h_on), ("y", "h", v_on)):
            if on:
                top = F.col(size) - _window(F.col(size), F.col("zoom"))
                moved = moved.join(best_shift(work, axis), "image_id")
                moved = moved.withColumn(axis, F.greatest(F.lit(0), F.least(F.col(axis) - F.col("shift"), top))).drop("shift")
        found = moved.select("image_id", "x", "y", "zoom")
    return found.unionByName(still(wraps))
