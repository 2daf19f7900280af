"""Model tables the registered queries share, in Spark and in check SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from chromatile import fixtures
from chromatile.functions import color as C
from chromatile.operators import assign, stats
from chromatile.plans import duck

CENTERS = ((35.0, 30.0, 20.0), (60.0, -10.0, 30.0), (80.0, 5.0, -10.0))
WEIGHTS = (0.5, 0.3, 0.2)


def labelled_px(spark: SparkSession, sf: str, keep_lab: bool = False) -> DataFrame:
    return assign.assign_nearest(fixtures.px(spark, sf), CENTERS, WEIGHTS, keep_lab)


def px_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Three ranges per image, colours derived from the image id."""
    ids = fixtures.px(spark, sf).select("image_id").distinct()
    i, k = F.col("image_id"), F.col("idx")
    base = ids.select("image_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("idx"))
    base = base.select(
        "image_id",
        "idx",
        ((i * 31 + k * 90) % 256).cast("int").alias("repl_r"),
        ((i * 57 + k * 40 + 20) % 256).cast("int").alias("repl_g"),
        ((i * 11 + k * 70 + 200) % 256).cast("int").alias("repl_b"),
        ((i * 13 + k * 80 + 30) % 256).cast("int").alias("match_r"),
        ((i * 29 + k * 60 + 60) % 256).cast("int").alias("match_g"),
        ((i * 7 + k * 50 + 90) % 256).cast("int").alias("match_b"),
        F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), k + 1).alias("weight"),
        F.concat(F.lit("Ink #"), k, F.lit(" of "), i).alias("name"),
        ((i + k) % 3 != 1).alias("visible"),
    )
    return C.with_lab(base, ("match_r", "match_g", "match_b"))


RANGES = """ranges0 AS (
  SELECT image_id, k::INT AS idx, ((image_id*31 + k*90) % 256)::INT AS repl_r,
    ((image_id*57 + k*40 + 20) % 256)::INT AS repl_g, ((image_id*11 + k*70 + 200) % 256)::INT AS repl_b,
    ((image_id*13 + k*80 + 30) % 256)::INT AS match_r, ((image_id*29 + k*60 + 60) % 256)::INT AS match_g,
    ((image_id*7 + k*50 + 90) % 256)::INT AS match_b,
    ([0.5::DOUBLE, 0.3::DOUBLE, 0.2::DOUBLE])[k+1] AS weight,
    'Ink #' || k || ' of ' || image_id AS name, (image_id + k) % 3 <> 1 AS visible
  FROM (SELECT DISTINCT image_id FROM px), (SELECT unnest([0,1,2]) AS k)),
""" + duck.lab_cte("ranges", "ranges0", "match_r", "match_g", "match_b")


def nearest_sql(centers=CENTERS, weights=WEIGHTS, lab_l="lab_l", lab_a="lab_a", lab_b="lab_b") -> str:
    """CASE chain for the literal weighted nearest centre."""
    total = sum(weights)
    parts = []
    for (l, a, b), w in zip(centers, weights):
        s = total / w
        parts.append(duck.q(
            f"(({lab_l}-({l})::DOUBLE)*({lab_l}-({l})::DOUBLE)+({lab_a}-({a})::DOUBLE)*({lab_a}-({a})::DOUBLE)"
            f"+({lab_b}-({b})::DOUBLE)*({lab_b}-({b})::DOUBLE))*{s*s!r}::DOUBLE", 6))
    best = f"least({', '.join(parts)})"
    chain = " ".join(f"WHEN {p} = {best} THEN {i}" for i, p in enumerate(parts))
    return f"CAST(CASE {chain} END AS INT)"


PX_LAB = duck.PX + ",\n" + duck.lab_cte("pxlab", "px")
LABELLED = PX_LAB + f""",
labelled AS (SELECT *, CASE WHEN a > 0 THEN {nearest_sql()} ELSE -1 END AS label FROM pxlab)"""
HIST = """hist AS (
  SELECT image_id, r, g, b, count(*)::BIGINT AS n FROM px WHERE a > 0 GROUP BY ALL)"""


def histogram(spark: SparkSession, sf: str) -> DataFrame:
    return stats.color_histogram(fixtures.px(spark, sf))
