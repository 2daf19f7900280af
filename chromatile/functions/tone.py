"""Tone curve and white-balance expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from chromatile.functions.color import clamp, luma, to_byte

# Fixed values of the grade.
SHADOW_PIVOT = 0.40
HIGHLIGHT_PIVOT = 0.60
BRIGHTNESS_ADD = 0.35
EXPOSURE_STOPS = 1.0
CONTRAST_PIVOT = 0.5
GAIN_SPAN = 0.5
SATURATION_SPAN = 1.0
NEUTRAL = 1e-12

PARAMS = (
    "darks lights brightness lights_reds lights_greens lights_blues contrast exposure"
    " lights_cyan lights_magenta lights_yellow darks_cyan darks_magenta darks_yellow"
    " temperature tint saturation balance_cyan balance_magenta balance_yellow"
).split()


def highlight_weight(luma_n: Column) -> Column:
    return clamp((luma_n - HIGHLIGHT_PIVOT) / F.lit(1.0 - HIGHLIGHT_PIVOT), 0.0, 1.0)


def shadow_weight(luma_n: Column) -> Column:
    return clamp((SHADOW_PIVOT - luma_n) / F.lit(SHADOW_PIVOT), 0.0, 1.0)


def temperature_and_tint(gains: DataFrame) -> DataFrame:
    """Add temperature and tint (both -1..1) derived from mean-normalised gains."""
    mean = F.greatest((F.col("gain_r") + F.col("gain_g") + F.col("gain_b")) / 3.0, F.lit(1e-6))
    temp = (F.col("gain_r") / mean - F.col("gain_b") / mean) / (2.0 * GAIN_SPAN)
    tint = (1.0 - F.col("gain_g") / mean) / GAIN_SPAN
    return gains.withColumns({"temperature": clamp(temp, -1.0, 1.0), "tint": clamp(tint, -1.0, 1.0)})


def apply_tone(pixels: DataFrame, tone: dict[str, float | Column]) -> DataFrame:
    """Grade ``r, g, b``.  Missing parameters are neutral; all-neutral returns the input.

    Each value may be a number (shared) or a Column (per image, joined before).
    Shadow and highlight weights use the luma before temperature.  Highlight ink
    applies only while the three global balances are zero.
    """
    unknown = set(tone) - set(PARAMS)
    if unknown:
        raise ValueError(f"unknown tone parameters: {sorted(unknown)}")
    if all(not isinstance(v, Column) and abs(float(v)) < NEUTRAL for v in tone.values()):
        return pixels
    p = {k: F.lit(0.0) for k in PARAMS}
    p.update({k: v if isinstance(v, Column) else F.lit(float(v)) for k, v in tone.items()})

    work = pixels.withColumn("_n", luma(F.col("r"), F.col("g"), F.col("b")) / 255.0)
    work = work.withColumns({"_sw": shadow_weight(F.col("_n")), "_hw": highlight_weight(F.col("_n"))})
    work = work.withColumns(
        {
            "_r": F.col("r") * (1.0 + p["temperature"] * GAIN_SPAN),
            "_g": F.col("g") * (1.0 - p["tint"] * GAIN_SPAN),
            "_b": F.col("b") * (1.0 - p["temperature"] * GAIN_SPAN),
        }
    ).withColumn("_src", luma(F.col("_r"), F.col("_g"), F.col("_b")))

    dark_mix = F.col("_sw") * F.abs(p["darks"])
    light_mix = F.col("_hw") * F.abs(p["lights"])
    n = F.col("_src") / 255.0
    n = n * (1.0 - dark_mix) + F.when(p["darks"] >= 0.0, 0.0).otherwise(1.0) * dark_mix
    work = work.withColumn("_y", n)
    n = F.col("_y") * (1.0 - light_mix) + F.when(p["lights"] >= 0.0, 1.0).otherwise(0.0) * light_mix
    n = (n + p["brightness"] * BRIGHTNESS_ADD) * F.pow(F.lit(2.0), p["exposure"] * EXPOSURE_STOPS)
    n = (n - CONTRAST_PIVOT) * (1.0 + p["contrast"]) + CONTRAST_PIVOT
    work = work.withColumn("_y", clamp(n, 0.0, 1.0) * 255.0)
    scale = F.col("_y") / F.greatest(F.col("_src"), F.lit(1e-3))
    black = F.col("_src") < 1e-3
    work = work.withColumns({c: F.when(black, F.col("_y")).otherwise(F.col(c) * scale) for c in ("_r", "_g", "_b")})

    def gain(mix: Column, names: tuple[str, str, str], sign: float, on: Column | None = None):
        def one(c: str, k: str) -> Column:
            factor = 1.0 + mix * (p[k] * (sign * GAIN_SPAN))
            return F.col(c) * (factor if on is None else F.when(on, factor).otherwise(1.0))

        return {c: one(c, k) for c, k in zip(("_r", "_g", "_b"), names)}

    inks = ("cyan", "magenta", "yellow")
    no_balance = sum((F.abs(p[f"balance_{i}"]) for i in inks), F.lit(0.0)) < NEUTRAL
    work = work.withColumns(gain(F.col("_hw"), ("lights_reds", "lights_greens", "lights_blues"), 1.0))
    work = work.withColumns(gain(F.lit(1.0), tuple(f"balance_{i}" for i in inks), -1.0))
    work = work.withColumns(gain(F.col("_hw"), tuple(f"lights_{i}" for i in inks), -1.0, no_balance))
    work = work.withColumns(gain(F.col("_sw"), tuple(f"darks_{i}" for i in inks), -1.0))
    work = work.withColumn("_y", luma(F.col("_r"), F.col("_g"), F.col("_b")))
    chroma = 1.0 + p["saturation"] * SATURATION_SPAN
    neutral = None
    for v in p.values():
        z = F.abs(v) < NEUTRAL
        neutral = z if neutral is None else neutral & z
    return work.select(
        *[
            F.when(neutral, F.col(c))
            .otherwise(to_byte(F.col("_y") + (F.col(f"_{c}") - F.col("_y")) * chroma))
            .alias(c)
            if c in ("r", "g", "b")
            else F.col(c)
            for c in pixels.columns
        ]
    )
