"""Colour functions for SQL text: ``register(spark)``, then ``SELECT rgb_to_lab(r, g, b).l FROM ...``.

They are SQL functions, so the optimizer puts their bodies in place of the calls.  A few of
them in one query make a generated method that the JVM does not compile but interprets, so
``register`` lets such a stage run in smaller methods.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from chromatile.functions.color import LAB_KNEE, LUMA_B, LUMA_G, LUMA_R, SRGB_TO_XYZ, WHITE_X, WHITE_Y, WHITE_Z, XYZ_TO_SRGB


def _sum(row: tuple[float, float, float], names: tuple[str, str, str]) -> str:
    return " + ".join(f"({v!r}D) * {n}" for v, n in zip(row, names))


_LAB = "STRUCT<l: DOUBLE, a: DOUBLE, b: DOUBLE>"
_RGB = "STRUCT<r: INT, g: INT, b: INT>"
_HSL = "STRUCT<h: DOUBLE, s: DOUBLE, l: DOUBLE>"
_TOE = 3.0 * LAB_KNEE * LAB_KNEE

#: Name, parameters, result and body; later ones use earlier ones.
FUNCTIONS = (
    ("color_byte", "x DOUBLE", "INT", "CAST(least(255D, greatest(0D, rint(x))) AS INT)"),
    ("round4", "x DOUBLE", "DOUBLE", "floor(x * 10000D + 0.5D) / 10000D"),
    ("rgb_luma", "r DOUBLE, g DOUBLE, b DOUBLE", "DOUBLE", _sum((LUMA_R, LUMA_G, LUMA_B), ("r", "g", "b"))),
    ("srgb_to_linear", "v DOUBLE", "DOUBLE", "CASE WHEN v / 255D <= 0.04045D THEN v / 255D / 12.92D ELSE pow((v / 255D + 0.055D) / 1.055D, 2.4D) END"),
    ("linear_to_srgb", "v DOUBLE", "INT", f"color_byte(255D * CASE WHEN v <= 0.0031308D THEN v * 12.92D ELSE 1.055D * pow(v, {1.0 / 2.4!r}D) - 0.055D END)"),
    ("lab_curve", "t DOUBLE", "DOUBLE", f"CASE WHEN t > {LAB_KNEE**3!r}D THEN cbrt(t) ELSE t / {_TOE!r}D + {4.0 / 29.0!r}D END"),
    ("lab_uncurve", "t DOUBLE", "DOUBLE", f"CASE WHEN t > {LAB_KNEE!r}D THEN t * t * t ELSE (t - {4.0 / 29.0!r}D) * {_TOE!r}D END"),
    ("curves_to_lab", "x DOUBLE, y DOUBLE, z DOUBLE", _LAB, "struct(116D * y - 16D, 500D * (x - y), 200D * (y - z))"),
    ("linear_to_lab", "r DOUBLE, g DOUBLE, b DOUBLE", _LAB,
     "curves_to_lab(" + ", ".join(f"lab_curve(({_sum(row, ('r', 'g', 'b'))}) / {w!r}D)" for row, w in zip(SRGB_TO_XYZ, (WHITE_X, WHITE_Y, WHITE_Z))) + ")"),
    ("rgb_to_lab", "r DOUBLE, g DOUBLE, b DOUBLE", _LAB, "linear_to_lab(srgb_to_linear(r), srgb_to_linear(g), srgb_to_linear(b))"),
    ("xyz_to_rgb", "x DOUBLE, y DOUBLE, z DOUBLE", _RGB, "struct(" + ", ".join(f"linear_to_srgb(greatest(0D, {_sum(row, ('x', 'y', 'z'))}))" for row in XYZ_TO_SRGB) + ")"),
    ("lab_to_rgb", "l DOUBLE, a DOUBLE, b DOUBLE", _RGB,
     f"xyz_to_rgb(lab_uncurve((l + 16D) / 116D + a / 500D) * {WHITE_X!r}D, lab_uncurve((l + 16D) / 116D) * {WHITE_Y!r}D, lab_uncurve((l + 16D) / 116D - b / 200D) * {WHITE_Z!r}D)"),
    ("wrap_turn", "x DOUBLE", "DOUBLE", "x - floor(x)"),
    ("extremes_to_hsl", "r DOUBLE, g DOUBLE, b DOUBLE, hi DOUBLE, lo DOUBLE", _HSL,
     "struct(wrap_turn(CASE WHEN hi = lo THEN 0D WHEN r = hi THEN (hi - b) / (hi - lo) - (hi - g) / (hi - lo) WHEN g = hi THEN 2D + (hi - r) / (hi - lo) - (hi - b) / (hi - lo)"
     " ELSE 4D + (hi - g) / (hi - lo) - (hi - r) / (hi - lo) END / 6D),"
     " CASE WHEN hi = lo THEN 0D WHEN (hi + lo) / 2D <= 0.5D THEN (hi - lo) / (hi + lo) ELSE (hi - lo) / (2D - (hi + lo)) END, (hi + lo) / 2D)"),
    ("rgb_to_hsl", "r DOUBLE, g DOUBLE, b DOUBLE", _HSL, "extremes_to_hsl(r / 255D, g / 255D, b / 255D, greatest(r, g, b) / 255D, least(r, g, b) / 255D)"),
    ("rgb_to_hex", "r INT, g INT, b INT", "STRING", "format_string('#%02X%02X%02X', r, g, b)"),
    ("hex_to_rgb", "text STRING", _RGB,
     "CASE WHEN text RLIKE '^#[0-9A-Fa-f]{6}$' THEN struct(CAST(conv(substr(text, 2, 2), 16, 10) AS INT), CAST(conv(substr(text, 4, 2), 16, 10) AS INT), CAST(conv(substr(text, 6, 2), 16, 10) AS INT)) END"),
)


#: Bytes of a method up to which the JVM compiles it (fixed value).
COMPILED_BYTES = 8000


def register(spark: SparkSession) -> None:
    """Create the functions in the session, and keep its generated methods small enough to be compiled."""
    limit = "spark.sql.codegen.hugeMethodLimit"
    spark.conf.set(limit, min(COMPILED_BYTES, int(spark.conf.get(limit))))
    for name, parameters, result, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
