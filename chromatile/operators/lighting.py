"""Large-scale lighting: flatten and its tone estimate."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from chromatile.functions import color as C
from chromatile.operators import frame, raster, stats, stencil
from chromatile.operators.assign import LAB
from chromatile.session import materialize

# Fixed values of the flatten.
FIELD_EDGE = 32
BLUR_SHARE, BLUR_MIN = 0.35, 1.2
CHROMA_MIX, GAIN_FLOOR = 0.35, 1.0


def light_field(pixels: DataFrame, columns) -> DataFrame:
    """Blurred coarse grid per image: ``(image_id, gw, gh, f_<column> array)``.

    Cells are block means, at most 32 x 32 per image, so the blur and the packed
    result stay bounded; the shuffle carries per-cell partial sums only.
    """
    sized = frame.with_dims(pixels)
    scale = F.least(F.lit(1.0), F.lit(float(FIELD_EDGE)) / F.greatest("w", "h"))
    small = lambda n: F.greatest(F.lit(1), F.rint(F.col(n) * scale).cast("int"))
    g = sized.withColumns({"gw": small("w"), "gh": small("h")})
    cells = g.groupBy(
        "image_id", "gw", "gh",
        F.floor(F.col("y") * F.col("gh") / F.col("h")).cast("int").alias("cy"), F.floor(F.col("x") * F.col("gw") / F.col("w")).cast("int").alias("cx"),
    ).agg(*[F.avg(c).alias(c) for c in columns])
    packed = cells.groupBy("image_id", "gw", "gh").agg(F.sort_array(F.collect_list(F.struct("cy", "cx", *columns))).alias("cells"))
    sigma = F.greatest(F.lit(BLUR_MIN), BLUR_SHARE * F.least("gw", "gh"))
    reach = math.ceil(3 * max(BLUR_MIN, BLUR_SHARE * FIELD_EDGE))
    packed = packed.withColumn("_s", sigma).withColumn(
        "_k", F.transform(F.sequence(F.lit(-reach), F.lit(reach)), lambda d: F.exp(-(d * d) / (2.0 * F.col("_s") * F.col("_s"))))
    )
    packed = packed.withColumn("_kt", F.aggregate("_k", F.lit(0.0), lambda a, v: a + v))
    out = materialize(packed, "field")
    gw, gh = F.col("gw"), F.col("gh")

    def blur(src: Column, axis: str) -> Column:
        def at(i: Column) -> Column:
            cx, cy = i % gw, F.floor(i / gw)

            def tap(d: Column) -> Column:
                x = F.least(gw - 1, F.greatest(F.lit(0), cx + d)) if axis == "x" else cx
                y = F.least(gh - 1, F.greatest(F.lit(0), cy + d)) if axis == "y" else cy
                return F.get(src, (y * gw + x).cast("int")) * F.get("_k", (d + reach).cast("int"))

            total = F.aggregate(F.transform(F.sequence(F.lit(-reach), F.lit(reach)), tap), F.lit(0.0), lambda a, v: a + v)
            return total / F.col("_kt")

        return F.transform(F.sequence(F.lit(0), gw * gh - 1), at)

    for axis in ("x", "y"):
        src = {c: F.col(f"cells.{c}") if axis == "x" else F.col(f"f_{c}") for c in columns}
        out = materialize(out.withColumns({f"f_{c}": blur(v, axis) for c, v in src.items()}), "field")
    return out.select("image_id", "gw", "gh", *[f"f_{c}" for c in columns])


def _sample(c: str) -> Column:
    """Bilinear sample of a packed field at a pixel."""
    at = lambda p, g, n: F.least(F.col(g) - 1.0, F.greatest(F.lit(0.0), (F.col(p) + 0.5) * F.col(g) / F.col(n) - 0.5))
    u, v = at("x", "gw", "w"), at("y", "gh", "h")
    x0, y0 = F.floor(u), F.floor(v)
    x1, y1 = F.least(F.col("gw") - 1, x0 + 1), F.least(F.col("gh") - 1, y0 + 1)
    get = lambda y, x: F.get(f"f_{c}", (y * F.col("gw") + x).cast("int"))
    top = get(y0, x0) * (1.0 - (u - x0)) + get(y0, x1) * (u - x0)
    bottom = get(y1, x0) * (1.0 - (u - x0)) + get(y1, x1) * (u - x0)
    return top * (1.0 - (v - y0)) + bottom * (v - y0)


def _divide(df: DataFrame, value: str, field: str) -> DataFrame:
    """Multiply by mean(field) / field and keep the mean of ``value``."""
    df = materialize(df, "divide")
    ref = df.groupBy("image_id").agg(F.avg(field).alias("_ref"), F.avg(value).alias("_src"))
    ref = ref.withColumn("_ref", F.when(F.abs("_ref") < GAIN_FLOOR, F.when(F.col("_ref") >= 0, GAIN_FLOOR).otherwise(-GAIN_FLOOR)).otherwise(F.col("_ref")))
    out = df.join(ref, "image_id").withColumn(value, F.col(value) * (F.col("_ref") / F.greatest(F.col(field), F.lit(GAIN_FLOOR))))
    out = materialize(out.drop("_ref"), "divide")
    mean = out.groupBy("image_id").agg(F.avg(value).alias("_out"))
    gain = F.when(F.abs("_out") > 1e-6, F.col("_src") / F.col("_out")).otherwise(1.0)
    return out.join(mean, "image_id").withColumn(value, F.col(value) * gain).drop("_src", "_out", field)


def _restore(df: DataFrame, value: str, before: DataFrame) -> DataFrame:
    """Shift ``value`` so its mean is the one in ``before(image_id, m)``."""
    df = materialize(df, "restore")
    after = df.groupBy("image_id").agg(F.avg(value).alias("_a")).join(before, "image_id")
    return df.join(after, "image_id").withColumn(value, F.col(value) + F.col("m") - F.col("_a")).drop("m", "_a")


def flatten_lighting(pixels: DataFrame) -> DataFrame:
    """Remove lighting bowls and ramps: L* fully, a* and b* mildly; 8-bit colours out."""
    L, A, B = LAB
    lab = materialize(C.with_lab(pixels), "lab")
    sizes = materialize(frame.dims(lab), "sizes")
    mean_l = materialize(lab.groupBy("image_id").agg(F.avg(L).alias("m")), "mean")
    field = light_field(lab, LAB)
    j = lab.join(sizes, "image_id").join(field, "image_id")
    j = j.select(*lab.columns, *[_sample(c).alias(f"_f{c}") for c in LAB])
    out = _divide(j, L, f"_f{L}")
    chroma = out.groupBy("image_id").agg(*[F.avg(f"_f{c}").alias(f"_m{c}") for c in (A, B)])
    out = out.join(chroma, "image_id")
    out = out.withColumns({c: F.col(c) - CHROMA_MIX * (F.col(f"_f{c}") - F.col(f"_m{c}")) for c in (A, B)}).select(*lab.columns)
    plane = stats.light_plane(materialize(out, "bowl"), L)
    p = out.join(plane, "image_id").join(sizes, "image_id")
    u, v = (F.when(F.col(n) > 1, F.col(a) / (F.col(n) - 1)).otherwise(0.0) for a, n in (("x", "w"), ("y", "h")))
    surface = F.col("c0") + F.col("c1") * u + F.col("c2") * v + F.col("c3") * u * v
    tall = (F.col("w") >= 2) & (F.col("h") >= 2)
    p = p.withColumn("_plane", F.when(tall, surface).otherwise(F.col(L))).select(*lab.columns, "_plane")
    out = _divide(p, L, "_plane")
    for axis in ("y", "x"):
        out = stencil.edge_ramp(materialize(out, "ramp"), axis, 1.0, (L,), sizes)
    out = _restore(out, L, mean_l).withColumn(L, C.clamp(F.col(L), 0.0, 100.0))
    out = materialize(out, "flat")
    again = materialize(out.groupBy("image_id").agg(F.avg(L).alias("m")), "mean")
    mix = {L: 1.0, A: CHROMA_MIX, B: CHROMA_MIX}
    for axis in ("y", "x"):
        out = stencil.edge_ramp(materialize(out, "ramp"), axis, mix, LAB, sizes)
    out = _restore(out, L, again).withColumn(L, C.clamp(F.col(L), 0.0, 100.0))
    return C.with_rgb_from_lab(out).select(*pixels.columns)


def normalize_tone(pixels: DataFrame, edge: int | None = None) -> DataFrame:
    """Darks and lights that imitate the flatten; ``edge`` estimates them on a copy of that size."""
    work = pixels
    if edge is not None:
        tw, th = raster.fit_edge(F.col("w"), F.col("h"), edge, rounding="nearest")
        work = materialize(raster.resize_to(pixels, tw, th, "bilinear"), "work")
    return stats.tone_fit(work, flatten_lighting(work))
