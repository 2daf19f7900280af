"""Histogram bins on luma or a Lab axis."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from chromatile.functions import color as C
from chromatile.operators.stats import exact_percentiles

# Legal span of each channel.
SPAN = {"luma": (0.0, 255.0), "lab_l": (0.0, 100.0), "lab_a": (-128.0, 127.0), "lab_b": (-128.0, 127.0)}


def channel_values(pixels: DataFrame, channel: str) -> DataFrame:
    """Add ``v``, the channel a split works on."""
    if channel == "luma":
        return pixels.withColumn("v", C.luma(F.col("r"), F.col("g"), F.col("b")))
    lab = pixels if channel in pixels.columns else C.with_lab(pixels)
    return lab.withColumn("v", F.col(channel)).select(*pixels.columns, "v")


def resolved_start(channel: str, start: float | None) -> float:
    lo, hi = SPAN[channel]
    if start is None or start != start:
        return lo
    return max(lo, min(hi, float(start)))


def _linspace(lo: Column, hi: Column, n: int) -> Column:
    step = (hi - lo) / F.lit(float(n))
    return F.array(*[lo + step * F.lit(float(i)) for i in range(n)], hi)


def _values(histogram: DataFrame, channel: str) -> DataFrame:
    return channel_values(histogram, channel).select("image_id", "v", "n")


def bin_edges(
    histogram: DataFrame,
    n: int,
    channel: str = "luma",
    start: float | None = None,
    even: bool = False,
    weights: Sequence[float] | DataFrame | None = None,
) -> DataFrame:
    """N+1 bin edges per image, from an (r, g, b, n) histogram of opaque pixels.

    Equal steps from max(Start, min) to max, or with ``even`` at equal shares of
    the values at or above Start.  ``weights`` (a list, or a table ``(image_id,
    weights array)``) places the edges at cumulative weights instead.
    """
    user = resolved_start(channel, start)
    values = _values(histogram, channel)
    span = values.groupBy("image_id").agg(F.min("v").alias("mn"), F.max("v").alias("hi"))
    span = span.select("image_id", F.greatest(F.lit(user), F.col("mn")).alias("lo"), "hi")
    lo, hi = F.col("lo"), F.col("hi")
    luma = channel == "luma"
    empty = _linspace(lo, lo + F.lit(1.0 if luma else 0.25), n)

    if weights is not None:
        if isinstance(weights, DataFrame):
            cum = _cumulative_shares(weights)
        else:
            w = [max(float(x), 1e-6) for x in weights]
            total, run, shares = sum(w), 0.0, [0.0]
            for x in w:
                run += x / total
                shares.append(run)
            shares[-1] = 1.0
            cum = span.select("image_id", F.array(*[F.lit(s) for s in shares]).alias("fractions"))
        sized = span.join(cum, "image_id")
        if even:
            got = _percentile_edges(values, span, cum)
            pinned = F.concat(F.array(lo), F.slice("p", F.lit(2), F.size("p") - 2), F.array(hi))
            sized = sized.join(got, "image_id", "left")
            span_hi = F.when(hi > lo, hi).otherwise(lo + 1e-3)
            fallback = F.transform("fractions", lambda f: lo + f * (span_hi - lo))
            return sized.select("image_id", F.coalesce(pinned, fallback).alias("edges"))
        span_hi = F.when(hi > lo, hi).otherwise(lo + 1e-3)
        return sized.select("image_id", F.transform("fractions", lambda f: lo + f * (span_hi - lo)).alias("edges"))

    if even:
        got = _percentile_edges(values, span, [i / n for i in range(n + 1)])
        out = span.join(got, "image_id", "left")
        snapped = F.array_distinct(F.transform("p", lambda e: F.rint(e * 1e6) / 1e6))
        out = out.withColumn("_u", snapped)
        pinned = F.when(F.size("_u") < 2, _linspace(lo, hi, n)).otherwise(
            F.concat(F.array(lo), F.slice("_u", F.lit(2), F.greatest(F.size("_u") - 2, F.lit(0))), F.array(hi))
        )
        return out.select("image_id", F.when(hi < lo, empty).otherwise(pinned).alias("edges"))

    pad = 0.5 if luma else 0.25
    return span.select(
        "image_id",
        F.when(hi < lo, empty)
        .when(hi - lo < 1e-3, F.array(lo - pad, hi + pad))
        .otherwise(_linspace(lo, hi, n))
        .alias("edges"),
    )


def _cumulative_shares(weights: DataFrame) -> DataFrame:
    floored = F.transform("weights", lambda w: F.greatest(w, F.lit(1e-6)))
    total = F.aggregate(floored, F.lit(0.0), lambda acc, x: acc + x)
    out = weights.select("image_id", floored.alias("_w"), total.alias("_t"))
    running = F.transform(
        F.sequence(F.lit(0), F.size("_w")),
        lambda i: F.when(i == F.size("_w"), 1.0).otherwise(
            F.aggregate(F.slice("_w", F.lit(1), i), F.lit(0.0), lambda acc, x: acc + x / F.col("_t"))
        ),
    )
    return out.select("image_id", running.alias("fractions"))


def _percentile_edges(values: DataFrame, span: DataFrame, fractions) -> DataFrame:
    above = values.join(span, "image_id").filter(F.col("v") >= F.col("lo"))
    return exact_percentiles(above, ["image_id"], "v", "n", fractions, 1.0)


def label_bins(pixels: DataFrame, edges: DataFrame | Sequence[float], channel: str = "luma") -> DataFrame:
    """Right-closed bins: a value on an inner edge goes to the lower bin.

    Values below the first edge and transparent pixels get -1; values above the
    last edge stay in the last bin.
    """
    valued = channel_values(pixels, channel)
    valid = F.col("a") > 0 if "a" in pixels.columns else F.lit(True)
    v = F.col("v")
    if isinstance(edges, DataFrame):
        joined = valued.join(edges.select("image_id", "edges"), "image_id")
        inner = F.slice("edges", F.lit(2), F.greatest(F.size("edges") - 2, F.lit(0)))
        index = F.size(F.filter(inner, lambda e: e < v))
        first = F.element_at("edges", 1)
    else:
        joined = valued
        index = F.lit(0)
        for e in list(edges)[1:-1]:
            index = index + F.when(v > F.lit(float(e)), 1).otherwise(0)
        first = F.lit(float(edges[0]))
    label = F.when(~valid | (v < first), -1).otherwise(index).cast("int")
    return joined.withColumn("label", label).select(*pixels.columns, "label")
