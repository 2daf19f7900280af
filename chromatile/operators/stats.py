"""Grouped statistics: histograms, coverage, percentiles, extents, white balance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from chromatile.functions import color as C
from chromatile.functions.tone import highlight_weight, shadow_weight, temperature_and_tint
from chromatile.operators import frame
from chromatile.operators.assign import LAB
from chromatile.session import materialize


def color_histogram(pixels: DataFrame) -> DataFrame:
    """Distinct opaque colours with counts: at most 2^24 rows per image.

    Colour-only operators run on this instead of on pixels.  The count combines
    map-side, and the colour is part of the key, so one huge image spreads over
    all tasks.
    """
    rows = pixels.filter(F.col("a") > 0) if "a" in pixels.columns else pixels
    return rows.groupBy("image_id", "r", "g", "b").agg(F.count(F.lit(1)).alias("n"))


def range_stats(labelled: DataFrame, ranges: DataFrame) -> DataFrame:
    """Count, share of opaque pixels and mean colour for every range, empty ones included."""
    opaque = F.sum((F.col("a") > 0).cast("int")) if "a" in labelled.columns else F.count(F.lit(1))
    per_label = labelled.groupBy("image_id", "label").agg(
        F.count(F.lit(1)).alias("n"),
        opaque.alias("opaque"),
        *[F.avg(c).alias(f"m{c}") for c in "rgb"],
    )
    per_image = Window.partitionBy("image_id")
    totals = per_label.withColumn("total", F.sum("opaque").over(per_image))
    wanted = ranges.withColumnRenamed("idx", "label")
    sizes = totals.groupBy("image_id").agg(F.max("total").alias("total"))
    joined = (
        wanted.join(totals.drop("opaque", "total"), ["image_id", "label"], "left")
        .join(sizes, "image_id", "left")
        .withColumns({"n": F.coalesce("n", F.lit(0)), "total": F.coalesce("total", F.lit(0))})
    )
    share = F.when(F.col("total") > 0, F.col("n") / F.col("total")).otherwise(0.0)
    means = [F.coalesce(F.rint(F.col(f"m{c}")), F.lit(128.0)).cast("int").alias(f"mean_{c}") for c in "rgb"]
    return joined.select(
        *[F.col("label").alias("idx") if c == "label" else c for c in wanted.columns],
        "n",
        "total",
        share.alias("share"),
        *means,
    )


def bin_display_key(low: Column, high: Column, channel: str) -> Column:
    """Mid-bin position scaled to 0..1 for the channel."""
    mid = (low + high) * 0.5
    if channel == "luma":
        return C.clamp(mid / 255.0, 0.0, 1.0)
    if channel == "lab_l":
        return C.clamp(mid / 100.0, 0.0, 1.0)
    return C.clamp((mid + 128.0) / 255.0, 0.0, 1.0)


def coverage_rollup(labelled: DataFrame) -> DataFrame:
    """Pixel counts by (image, label), by image and overall."""
    return (
        labelled.rollup("image_id", "label")
        .agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("int").alias("level"))
        .select(F.coalesce("image_id", F.lit(-9)).alias("image_id"), F.coalesce("label", F.lit(-9)).alias("label"), "n", "level")
    )


def exact_percentiles(
    rows: DataFrame,
    keys: Sequence[str],
    value: str,
    freq: str,
    fractions: Sequence[float] | DataFrame,
    width: float,
) -> DataFrame:
    """Exact linearly interpolated percentiles of weighted values, per key.

    Two passes keep a single huge key distributed: bucket counts of ``width``
    locate each wanted rank, then only the buckets that hold a rank are ordered.
    ``fractions`` is a list, or a table ``(keys, fractions array)``.
    Returns ``(keys, p array)``.
    """
    keys = list(keys)
    bucketed = rows.select(
        *keys, F.floor(F.col(value) / F.lit(float(width))).alias("_b"), F.col(value).alias("_v"), F.col(freq).alias("_n")
    )
    along = Window.partitionBy(*keys).orderBy("_b")
    coarse = (
        bucketed.groupBy(*keys, "_b")
        .agg(F.sum("_n").alias("_c"))
        .withColumn("_before", F.sum("_c").over(along.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c"))
        .withColumn("_total", F.sum("_c").over(Window.partitionBy(*keys)))
    )
    if isinstance(fractions, DataFrame):
        coarse = coarse.join(fractions, keys)
        wanted = F.col("fractions")
    else:
        wanted = F.array(*[F.lit(float(f)) for f in fractions])

    def ranks(f: Column, i: Column) -> Column:
        pos = f * (F.col("_total") - 1)
        return F.array(
            F.struct(i.alias("i"), F.lit(0).alias("side"), F.floor(pos).alias("rank"), (pos - F.floor(pos)).alias("t")),
            F.struct(i.alias("i"), F.lit(1).alias("side"), F.ceil(pos).alias("rank"), (pos - F.floor(pos)).alias("t")),
        )

    inside = F.filter(
        F.flatten(F.transform(wanted, ranks)),
        lambda s: (s["rank"] >= F.col("_before")) & (s["rank"] < F.col("_before") + F.col("_c")),
    )
    targets = coarse.select(*keys, "_b", "_before", F.explode(inside).alias("_s")).select(
        *keys, "_b", (F.col("_s.rank") - F.col("_before")).alias("_k"), "_s.i", "_s.side", "_s.t"
    )
    needed = targets.select(*keys, "_b").distinct()
    within = Window.partitionBy(*keys, "_b").orderBy("_v")
    ordered = (
        bucketed.join(needed, [*keys, "_b"], "left_semi")
        .groupBy(*keys, "_b", "_v")
        .agg(F.sum("_n").alias("_n"))
        .withColumn("_end", F.sum("_n").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    )
    hit = ordered.join(targets, [*keys, "_b"]).filter(
        (F.col("_k") >= F.col("_end") - F.col("_n")) & (F.col("_k") < F.col("_end"))
    )
    picked = hit.groupBy(*keys, "i").agg(
        F.max(F.when(F.col("side") == 0, F.col("_v"))).alias("lo"),
        F.max(F.when(F.col("side") == 1, F.col("_v"))).alias("hi"),
        F.max("t").alias("t"),
    )
    point = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("t")
    return (
        picked.groupBy(*keys)
        .agg(F.sort_array(F.collect_list(F.struct("i", point.alias("p")))).alias("_ps"))
        .select(*keys, F.transform("_ps", lambda s: s["p"]).alias("p"))
    )


def range_extents(histogram: DataFrame, centers: DataFrame) -> DataFrame:
    """Ellipsoid of each range in Lab, from a labelled ``(image_id, r, g, b, label, n)`` histogram.

    Semi-axis = max(2 sigma, p95 of the absolute deviation, 2.5); with under four
    members the maximum deviation stands in for p95.  Deviations are about the
    given centre.
    """
    lab = histogram if "lab_l" in histogram.columns else C.with_lab(histogram)
    c = centers.select(
        "image_id", F.col("idx").alias("label"), *[F.col(n).alias(f"_c{n}") for n in LAB]
    )
    # No filter on the label here: -1 has no centre, and a filter would be pushed
    # below the projection and evaluate the whole label expression twice.
    dev = lab.join(c, ["image_id", "label"])
    dev = dev.select("image_id", "label", "n", *[(F.col(n) - F.col(f"_c{n}")).alias(n) for n in LAB])
    dev = materialize(dev, "deviations")
    d2 = C.dist2([F.col(n) for n in LAB], [F.lit(0.0)] * 3)
    total = F.sum("n")

    def sigma(n: str) -> Column:
        mean = F.sum(F.col("n") * F.col(n)) / total
        return F.sqrt(F.greatest(F.lit(0.0), F.sum(F.col("n") * F.col(n) * F.col(n)) / total - mean * mean))

    stats = dev.groupBy("image_id", "label").agg(
        total.alias("n"),
        *[sigma(n).alias(f"sd{n}") for n in LAB],
        *[F.max(F.abs(F.col(n))).alias(f"mx{n}") for n in LAB],
        F.sqrt(F.sum(F.col("n") * d2) / total).alias("rms"),
        F.sqrt(F.max(d2)).alias("r_max"),
    )
    long = dev.select(
        "image_id", "label", "n", F.inline(F.array(*[F.struct(F.lit(n).alias("axis"), F.abs(F.col(n)).alias("d")) for n in LAB]))
    )
    p95 = exact_percentiles(long, ["image_id", "label", "axis"], "d", "n", [0.95], 1.0)
    wide = p95.groupBy("image_id", "label").agg(
        *[F.max(F.when(F.col("axis") == n, F.col("p")[0])).alias(f"p{n}") for n in LAB]
    )
    out = stats.join(wide, ["image_id", "label"])
    radius = {
        f"radius_{n}": F.greatest(
            2.0 * F.col(f"sd{n}"),
            F.when(F.col("n") >= 4, F.col(f"p{n}")).otherwise(F.col(f"mx{n}")),
            F.lit(2.5),
        )
        for n in LAB
    }
    return out.withColumns(radius).select(
        "image_id", "label", "n", *radius, "rms", "r_max"
    )


def gray_world(pixels: DataFrame, weight: Column | None = None) -> DataFrame:
    """Gains that bring each (weighted) channel mean to their common mean."""
    w = F.lit(1.0) if weight is None else weight
    sums = pixels.withColumn("_w", w).groupBy("image_id").agg(
        F.sum("_w").alias("_ws"),
        *[F.sum(F.col("_w") * F.col(c)).alias(f"_s{c}") for c in "rgb"],
        *[F.avg(c).alias(f"_m{c}") for c in "rgb"],
    )
    means = sums.select(
        "image_id",
        *[
            F.when(F.col("_ws") < 1e-12, F.col(f"_m{c}")).otherwise(F.col(f"_s{c}") / F.col("_ws")).alias(f"m{c}")
            for c in "rgb"
        ],
    )
    grey = (F.col("mr") + F.col("mg") + F.col("mb")) / 3.0
    gains = means.select(
        "image_id", *[(grey / F.greatest(F.col(f"m{c}"), F.lit(1e-6))).alias(f"gain_{c}") for c in "rgb"]
    )
    return temperature_and_tint(gains)


def white_patch(pixels: DataFrame, percentile: float = 99.0) -> DataFrame:
    """Gains that bring each channel's high percentile over the highlights to their maximum.

    Channel values are first counted (at most 256 rows per image and channel), so
    the percentile never sees the pixels themselves.
    """
    lit = highlight_weight(C.luma(F.col("r"), F.col("g"), F.col("b")) / 255.0) > 1e-6
    counts = (
        pixels.select(
            "image_id",
            lit.cast("int").alias("lit"),
            F.inline(F.array(*[F.struct(F.lit(c).alias("ch"), F.col(c).alias("v")) for c in "rgb"])),
        )
        .groupBy("image_id", "ch", "v")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("lit").alias("n_lit"))
    )
    p = float(percentile) / 100.0
    peaks = counts.groupBy("image_id", "ch").agg(
        F.when(
            F.sum("n_lit") > 0,
            F.percentile("v", p, F.col("n_lit")),
        )
        .otherwise(F.percentile("v", p, F.col("n")))
        .alias("peak")
    )
    wide = peaks.groupBy("image_id").agg(
        *[F.max(F.when(F.col("ch") == c, F.col("peak"))).alias(f"p{c}") for c in "rgb"]
    )
    white = F.greatest("pr", "pg", "pb")
    gains = wide.select(
        "image_id", *[(white / F.greatest(F.col(f"p{c}"), F.lit(1e-6))).alias(f"gain_{c}") for c in "rgb"]
    )
    return temperature_and_tint(gains)


def tone_fit(src: DataFrame, dst: DataFrame) -> DataFrame:
    """Darks and lights amounts that best explain ``src`` -> ``dst`` (same pixel keys)."""
    keys = ["image_id", "y", "x"]
    pair = src.select(*keys, C.luma(F.col("r"), F.col("g"), F.col("b")).alias("_s")).join(
        dst.select(*keys, C.luma(F.col("r"), F.col("g"), F.col("b")).alias("_d")), keys
    )
    pair = pair.select("image_id", (F.col("_s") / 255.0).alias("s"), ((F.col("_d") - F.col("_s")) / 255.0).alias("y"))
    s, y = F.col("s"), F.col("y")
    parts = {}
    for name, w in (("dark", shadow_weight(s)), ("light", highlight_weight(s))):
        lift, crush = w * (1.0 - s), -(w * s)
        parts[f"{name}_w"] = F.avg(w)
        for kind, basis in (("lift", lift), ("crush", crush)):
            parts[f"{name}_{kind}_yb"] = F.sum(y * basis)
            parts[f"{name}_{kind}_bb"] = F.sum(basis * basis)
    sums = pair.groupBy("image_id").agg(*[v.alias(k) for k, v in parts.items()])

    def mix(name: str) -> Column:
        def amount(kind: str) -> Column:
            bb = F.col(f"{name}_{kind}_bb")
            return F.greatest(F.lit(0.0), F.when(bb < 1e-12, 0.0).otherwise(F.col(f"{name}_{kind}_yb") / bb))

        lift, crush = amount("lift"), amount("crush")
        signed = F.when(lift >= crush, F.least(F.lit(1.0), lift)).otherwise(F.greatest(F.lit(-1.0), -crush))
        return F.when(F.col(f"{name}_w") < 1e-6, 0.0).otherwise(signed)

    return sums.select("image_id", (-mix("dark")).alias("darks"), mix("light").alias("lights"))


def axis_profile(pixels: DataFrame, axis: str = "x") -> DataFrame:
    """Mean luma per column (``axis='x'``) or row (``axis='y'``)."""
    return pixels.groupBy("image_id", axis).agg(
        F.avg(C.luma(F.col("r"), F.col("g"), F.col("b"))).alias("mean_luma")
    )


def light_plane(pixels: DataFrame, value: str = "lab_l", edge: int | None = None) -> DataFrame:
    """Least-squares ``c0 + c1 x + c2 y + c3 xy`` of ``value``, x and y scaled to 0..1.

    On a full rectangle the centred basis is orthogonal, so each coefficient is a
    ratio of two sums and one aggregate per image fits the plane.  ``edge`` asks for
    a strided copy of about that size instead of all pixels.
    """
    work = frame.probe(pixels, edge)
    X = F.when(F.col("w") > 1, F.col("x") / (F.col("w") - 1) - 0.5).otherwise(0.0)
    Y = F.when(F.col("h") > 1, F.col("y") / (F.col("h") - 1) - 0.5).otherwise(0.0)
    v = F.col(value)

    def ratio(basis: Column) -> Column:
        bb = F.sum(basis * basis)
        return F.when(bb < 1e-12, 0.0).otherwise(F.sum(v * basis) / bb)

    fit = work.groupBy("image_id").agg(
        F.avg(v).alias("m"), ratio(X).alias("bx"), ratio(Y).alias("by"), ratio(X * Y).alias("bxy")
    )
    return fit.select(
        "image_id",
        (F.col("m") - 0.5 * F.col("bx") - 0.5 * F.col("by") + 0.25 * F.col("bxy")).alias("c0"),
        (F.col("bx") - 0.5 * F.col("bxy")).alias("c1"),
        (F.col("by") - 0.5 * F.col("bxy")).alias("c2"),
        F.col("bxy").alias("c3"),
    )


def cell_means(pixels: DataFrame, sites: DataFrame) -> DataFrame:
    """Mean colour per cell of pixels labelled ``site``; an empty cell takes its seed pixel."""
    means = pixels.groupBy("image_id", "site").agg(*[F.avg(c).alias(f"m{c}") for c in "rgb"])
    seeds = frame.with_dims(sites, frame.dims(pixels)).select(
        "image_id",
        F.col("site_id").alias("site"),
        C.clamp(F.rint("x"), 0.0, F.col("w") - 1.0).cast("int").alias("x"),
        C.clamp(F.rint("y"), 0.0, F.col("h") - 1.0).cast("int").alias("y"),
    )
    seed_rgb = pixels.select("image_id", "y", "x", "r", "g", "b")
    return (
        seeds.join(means, ["image_id", "site"], "left")
        .join(seed_rgb, ["image_id", "y", "x"], "left")
        .select(
            "image_id", "site", *[C.to_byte(F.coalesce(F.col(f"m{c}"), F.col(c).cast("double"))).alias(c) for c in "rgb"]
        )
    )
