"""Nearest-centre labelling in Lab."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from chromatile.functions.color import dist2, q, with_lab

WEIGHT_FLOOR = 1e-4
LAB = ("lab_l", "lab_a", "lab_b")


def normalized(weights: Sequence[float], floor: float = WEIGHT_FLOOR) -> list[float]:
    w = [max(float(x), floor) for x in weights]
    total = sum(w)
    return [x / total for x in w]


def nearest_of(centers: Sequence[Sequence[float]], weights: Sequence[float] | None = None) -> Column:
    """Index of the nearest literal centre; the lowest index wins ties.

    The comparison is unrolled into one expression, so labelling is a
    projection: no join, no shuffle.
    """
    scales = [1.0] * len(centers) if weights is None else [1.0 / w for w in normalized(weights)]
    scored = []
    for i, (c, s) in enumerate(zip(centers, scales)):
        d2 = dist2([F.col(n) for n in LAB], [F.lit(float(v)) for v in c]) * F.lit(s * s)
        scored.append(F.struct(q(d2, 6).alias("d"), F.lit(i).alias("i")))
    best = scored[0] if len(scored) == 1 else F.least(*scored)
    return best["i"]


def pack_centers(centers: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """One row per model with its (at most 24) centres as an ordered array."""
    weight = F.greatest(F.col("weight"), F.lit(WEIGHT_FLOOR)) if "weight" in centers.columns else F.lit(1.0)
    return (
        centers.withColumn("_w", weight)
        .groupBy(*keys)
        .agg(
            F.sort_array(F.collect_list(F.struct("idx", *LAB, F.col("_w").alias("w")))).alias("centers"),
            F.sum("_w").alias("w_total"),
        )
    )


def nearest_in_array(weighted: bool = True) -> Column:
    """Struct (d, i) of the nearest entry of the ``centers`` array column."""

    def score(c: Column) -> Column:
        d2 = dist2([F.col(n) for n in LAB], [c[n] for n in LAB])
        if weighted:
            scale = F.col("w_total") / c["w"]
            d2 = d2 * scale * scale
        return F.struct(q(d2, 6).alias("d"), c["idx"].alias("i"))

    return F.array_min(F.transform("centers", score))


def assign_nearest(
    pixels: DataFrame,
    centers: Sequence[Sequence[float]] | DataFrame,
    weights: Sequence[float] | None = None,
    keep_lab: bool = False,
) -> DataFrame:
    """Label each pixel with its weighted nearest centre; transparent pixels get -1.

    ``centers`` is a literal list (one model for all images) or a table
    ``(image_id, idx, lab_l, lab_a, lab_b[, weight])``.  The table is packed to one row per
    image and equi-joined; the planner broadcasts it only while its measured
    size allows, otherwise the join shuffles and adaptive execution splits an
    oversized image.
    """
    lab = pixels if set(LAB) <= set(pixels.columns) else with_lab(pixels)
    valid = F.col("a") > 0 if "a" in pixels.columns else F.lit(True)
    if isinstance(centers, DataFrame):
        joined = lab.join(pack_centers(centers), "image_id", "left")
        label = nearest_in_array(weighted="weight" in centers.columns)["i"]
        out = joined.withColumn("label", F.when(valid, F.coalesce(label, F.lit(-1))).otherwise(-1).cast("int"))
        out = out.drop("centers", "w_total")
    else:
        label = nearest_of(centers, weights)
        out = lab.withColumn("label", F.when(valid, label).otherwise(-1).cast("int"))
    return out if keep_lab else out.select(*[c for c in out.columns if c in pixels.columns or c == "label"])


def reassign_pair(
    labelled: DataFrame,
    centers: Sequence[Sequence[float]],
    weights: Sequence[float],
    first: int,
    second: int,
) -> DataFrame:
    """Let only pixels labelled ``first`` or ``second`` switch between the two."""
    lab = labelled if set(LAB) <= set(labelled.columns) else with_lab(labelled)
    w = normalized(weights)

    def score(i: int) -> Column:
        d2 = dist2([F.col(n) for n in LAB], [F.lit(float(v)) for v in centers[i]])
        return q(d2 / F.lit(w[i] * w[i]), 6)

    label = F.when(
        F.col("label").isin(first, second),
        F.when(score(second) < score(first), second).otherwise(first),
    ).otherwise(F.col("label"))
    out = lab.withColumn("label", label.cast("int"))
    return out.select(*labelled.columns)


def nearest_other(centers: DataFrame) -> DataFrame:
    """For each centre of a model, the nearest other centre (lowest index on ties).

    A model has at most 24 centres, so the comparison runs inside its packed
    array instead of as a self join.
    """
    mine = F.col("c")
    packed = pack_centers(centers).select("image_id", "centers", F.explode("centers").alias("c"))

    def score(o: Column) -> Column:
        d2 = dist2([mine[n] for n in LAB], [o[n] for n in LAB])
        return F.struct(q(d2, 6).alias("d"), o["idx"].alias("i"))

    others = F.transform(F.filter("centers", lambda o: o["idx"] != mine["idx"]), score)
    return packed.select(
        "image_id",
        mine["idx"].alias("idx"),
        F.array_min(others)["i"].alias("neighbor"),
        F.array_min(others)["d"].alias("d2"),
    )


def inertia(histogram: DataFrame, centers: Sequence[Sequence[float]] | DataFrame) -> DataFrame:
    """Within-cluster sum of squares per image over an (rgb, n) histogram."""
    lab = histogram if set(LAB) <= set(histogram.columns) else with_lab(histogram)
    if isinstance(centers, DataFrame):
        lab = lab.join(pack_centers(centers), "image_id")
        d2 = nearest_in_array(weighted=False)["d"]
    else:
        d2 = F.least(
            *[q(dist2([F.col(n) for n in LAB], [F.lit(float(v)) for v in c]), 6) for c in centers], F.lit(1e300)
        )
    return lab.groupBy("image_id").agg(F.sum(F.col("n") * d2).alias("inertia"), F.sum("n").alias("n"))
