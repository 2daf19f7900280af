"""Colour-space expressions.  All math is DOUBLE and stays in generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Rec. 709 luma weights.
LUMA_R, LUMA_G, LUMA_B = 0.2126, 0.7152, 0.0722

# sRGB to XYZ at D65 (IEC 61966-2-1) and the D65 white point.
SRGB_TO_XYZ = (
    (0.4124564, 0.3575761, 0.1804375),
    (0.2126729, 0.7151522, 0.0721750),
    (0.0193339, 0.1191920, 0.9503041),
)
WHITE_X, WHITE_Y, WHITE_Z = 0.95047, 1.0, 1.08883
LAB_KNEE = 6.0 / 29.0


def _inverse(m):
    (a, b, c), (d, e, f), (g, h, i) = m
    det = a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)
    cof = (
        (e * i - f * h, c * h - b * i, b * f - c * e),
        (f * g - d * i, a * i - c * g, c * d - a * f),
        (d * h - e * g, b * g - a * h, a * e - b * d),
    )
    return tuple(tuple(v / det for v in row) for row in cof)


XYZ_TO_SRGB = _inverse(SRGB_TO_XYZ)


def q(x: Column, digits: int = 4) -> Column:
    """Round to a fixed number of decimals with plain double arithmetic."""
    step = float(10**digits)
    return F.floor(x * F.lit(step) + F.lit(0.5)) / F.lit(step)


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.lit(hi), F.greatest(F.lit(lo), x))


def to_byte(x: Column) -> Column:
    """Half-even round and clamp to 0..255."""
    return clamp(F.rint(x), 0.0, 255.0).cast("int")


def luma(r: Column, g: Column, b: Column) -> Column:
    return F.lit(LUMA_R) * r + F.lit(LUMA_G) * g + F.lit(LUMA_B) * b


def _linear(v: Column) -> Column:
    s = v / F.lit(255.0)
    return F.when(s <= 0.04045, s / F.lit(12.92)).otherwise(
        F.pow((s + F.lit(0.055)) / F.lit(1.055), F.lit(2.4))
    )


def _lab_f(t: Column) -> Column:
    return F.when(t > LAB_KNEE**3, F.cbrt(t)).otherwise(
        t / F.lit(3.0 * LAB_KNEE * LAB_KNEE) + F.lit(4.0 / 29.0)
    )


def with_lab(df: DataFrame, rgb=("r", "g", "b"), lab=("lab_l", "lab_a", "lab_b")) -> DataFrame:
    """Add CIE Lab columns.  Built in stages so no power is computed twice."""
    keep = df.columns
    lin = df.withColumns({f"_l{i}": _linear(F.col(c)) for i, c in enumerate(rgb)})
    white = (WHITE_X, WHITE_Y, WHITE_Z)
    xyz = lin.withColumns(
        {
            f"_t{i}": (F.lit(row[0]) * F.col("_l0") + F.lit(row[1]) * F.col("_l1") + F.lit(row[2]) * F.col("_l2"))
            / F.lit(white[i])
            for i, row in enumerate(SRGB_TO_XYZ)
        }
    )
    f = xyz.withColumns({f"_f{i}": _lab_f(F.col(f"_t{i}")) for i in range(3)})
    fx, fy, fz = F.col("_f0"), F.col("_f1"), F.col("_f2")
    values = (116.0 * fy - 16.0, 500.0 * (fx - fy), 200.0 * (fy - fz))
    return f.select(
        *[c for c in keep if c not in lab], *[v.alias(n) for n, v in zip(lab, values)]
    )


def with_rgb_from_lab(df: DataFrame, lab=("lab_l", "lab_a", "lab_b"), rgb=("r", "g", "b")) -> DataFrame:
    """Add 8-bit sRGB columns computed from Lab columns."""
    keep = [c for c in df.columns if c not in rgb]
    lab_l, lab_a, lab_b = (F.col(c) for c in lab)
    fy = (lab_l + 16.0) / 116.0
    f = df.withColumns({"_f0": fy + lab_a / 500.0, "_f1": fy, "_f2": fy - lab_b / 200.0})

    def back(t: Column) -> Column:
        return F.when(t > LAB_KNEE, t * t * t).otherwise((t - 4.0 / 29.0) * (3.0 * LAB_KNEE * LAB_KNEE))

    xyz = f.withColumns(
        {
            "_x0": back(F.col("_f0")) * WHITE_X,
            "_x1": back(F.col("_f1")) * WHITE_Y,
            "_x2": back(F.col("_f2")) * WHITE_Z,
        }
    )
    lin = xyz.withColumns(
        {
            f"_l{i}": F.greatest(
                F.lit(0.0),
                F.lit(m[0]) * F.col("_x0") + F.lit(m[1]) * F.col("_x1") + F.lit(m[2]) * F.col("_x2"),
            )
            for i, m in enumerate(XYZ_TO_SRGB)
        }
    )

    def gamma(v: Column) -> Column:
        return F.when(v <= 0.0031308, v * 12.92).otherwise(1.055 * F.pow(v, F.lit(1.0 / 2.4)) - 0.055)

    return lin.select(
        *keep, *[to_byte(gamma(F.col(f"_l{i}")) * 255.0).alias(c) for i, c in enumerate(rgb)]
    )


def hsl_lightness(r: Column, g: Column, b: Column) -> Column:
    return (F.greatest(r, g, b) + F.least(r, g, b)) / F.lit(510.0)


def with_hsl(df: DataFrame, rgb=("r", "g", "b"), hsl=("h", "s", "l")) -> DataFrame:
    """Add HSL hue, saturation and lightness in 0..1."""
    keep = [c for c in df.columns if c not in hsl]
    r, g, b = (F.col(c) / F.lit(255.0) for c in rgb)
    t = df.withColumns(
        {"_r": r, "_g": g, "_b": b, "_hi": F.greatest(r, g, b), "_lo": F.least(r, g, b)}
    ).withColumns({"_d": F.col("_hi") - F.col("_lo"), "_sum": F.col("_hi") + F.col("_lo")})
    hi, d, total = F.col("_hi"), F.col("_d"), F.col("_sum")
    light = total / 2.0
    flat = F.col("_hi") == F.col("_lo")
    sat = F.when(flat, 0.0).when(light <= 0.5, d / total).otherwise(d / (2.0 - total))
    rc, gc, bc = ((hi - F.col(c)) / d for c in ("_r", "_g", "_b"))
    turn = (
        F.when(flat, 0.0)
        .when(F.col("_r") == hi, bc - gc)
        .when(F.col("_g") == hi, 2.0 + rc - bc)
        .otherwise(4.0 + gc - rc)
    ) / 6.0
    hue = turn - F.floor(turn)
    return t.select(*keep, *[v.alias(n) for n, v in zip(hsl, (hue, sat, light))])


def with_rgb_from_hsl(df: DataFrame, hsl=("h", "s", "l"), rgb=("r", "g", "b"), clip: bool = True) -> DataFrame:
    """Add 8-bit RGB columns from HSL in 0..1, by sextant.

    Staged, so the generated method stays below the size the JVM compiles.  Values that
    come from ``with_hsl`` need no ``clip``: it takes the last bit off a full saturation
    and so moves channels that lie halfway between two bytes.
    """
    keep = [c for c in df.columns if c not in rgb]
    h, s, l = (F.col(c) for c in hsl)
    unit = (lambda v: clamp(v, 0.0, 1.0)) if clip else (lambda v: v)
    t = df.withColumns({"_hl": unit(l), "_hs": unit(s), "_hp": (h - F.floor(h)) * 6.0})
    t = t.withColumn("_hc", (1.0 - F.abs(2.0 * F.col("_hl") - 1.0)) * F.col("_hs"))
    hp = F.col("_hp")
    t = t.withColumns(
        {
            "_hx": F.col("_hc") * (1.0 - F.abs(hp - 2.0 * F.floor(hp / 2.0) - 1.0)),
            "_hm": F.col("_hl") - F.col("_hc") / 2.0,
            "_six": (F.floor(hp) % 6).cast("int"),
        }
    )
    six, c, x = F.col("_six"), F.col("_hc"), F.col("_hx")

    def channel(full: tuple[int, int], part: tuple[int, int]) -> Column:
        level = F.when(six.isin(*full), c).when(six.isin(*part), x).otherwise(0.0)
        return to_byte((level + F.col("_hm")) * 255.0)

    values = (channel((0, 5), (1, 4)), channel((1, 2), (0, 3)), channel((3, 4), (2, 5)))
    return t.select(*keep, *[v.alias(n) for n, v in zip(rgb, values)])


def hex_color(r: Column, g: Column, b: Column) -> Column:
    return F.format_string("#%02X%02X%02X", r, g, b)


def dist2(a: list[Column], b: list[Column]) -> Column:
    total = None
    for u, v in zip(a, b):
        term = (u - v) * (u - v)
        total = term if total is None else total + term
    return total
