"""Edits of a fitted model: insert, drop, re-weight, reset, palettes.

A model is a table ``ranges(image_id, idx, lab_l, lab_a, lab_b, match_r/g/b, repl_r/g/b,
weight, name, visible)`` with at most 24 rows per image.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from chromatile.functions.color import q, dist2, with_lab, with_rgb_from_lab
from chromatile.operators import assign, bins, cluster
from chromatile.operators.assign import LAB
from chromatile.session import materialize

FLOOR = 0.03
FLOOR_MAX = 0.40
MODEL = (
    "image_id idx lab_l lab_a lab_b match_r match_g match_b repl_r repl_g repl_b weight name visible"
).split()


def clamp_floor(floor: float | None) -> float:
    if floor is None or floor != floor:
        return FLOOR
    return max(0.0, min(FLOOR_MAX, float(floor)))


def _per_image():
    return Window.partitionBy("image_id")


def floored_weights(ranges: DataFrame, floor: float | None = None) -> DataFrame:
    """Weights clipped to the floor, then normalised (so one may end just under it)."""
    lo = max(clamp_floor(floor), 1e-4) if clamp_floor(floor) > 0 else 1e-4
    w = ranges.withColumn("weight", F.greatest(F.col("weight"), F.lit(lo)))
    return w.withColumn("weight", F.col("weight") / F.sum("weight").over(_per_image()))


def centers_from_match(ranges: DataFrame) -> DataFrame:
    """Rebuild Lab centres from the match swatches."""
    out = with_lab(ranges.drop(*LAB), ("match_r", "match_g", "match_b"))
    return out.select(*[c for c in MODEL if c in out.columns])


def model_from_centers(centers: DataFrame) -> DataFrame:
    """Even-weight model whose swatches are the centre colours."""
    rgb = with_rgb_from_lab(centers, LAB, ("match_r", "match_g", "match_b"))
    n = F.count(F.lit(1)).over(_per_image())
    return rgb.select(
        "image_id", "idx", *LAB, "match_r", "match_g", "match_b",
        *[F.col(f"match_{c}").alias(f"repl_{c}") for c in "rgb"],
        (F.lit(1.0) / n).alias("weight"), F.lit("").alias("name"), F.lit(True).alias("visible"),
    )


def drop_range(ranges: DataFrame, index: int, floor: float | None = None) -> DataFrame:
    """Remove one range, re-index, renormalise; a single range is never removed."""
    n = F.count(F.lit(1)).over(_per_image())
    counted = ranges.withColumn("_n", n)
    gone = F.least(F.greatest(F.lit(int(index)), F.lit(0)), F.col("_n") - 1)
    kept = counted.withColumn("_gone", gone).filter((F.col("_n") <= 1) | (F.col("idx") != F.col("_gone")))
    shifted = kept.withColumn(
        "idx", (F.col("idx") - ((F.col("_n") > 1) & (F.col("idx") > F.col("_gone"))).cast("int")).cast("int")
    )
    total = F.sum("weight").over(_per_image())
    even = shifted.withColumn("weight", F.when(total == 0, F.col("weight")).otherwise(F.col("weight") / total))
    return floored_weights(centers_from_match(even.drop("_n", "_gone")), floor)


def insert_range(histogram: DataFrame, ranges: DataFrame, floor: float | None = None) -> DataFrame:
    """Append a range seeded at the farthest colour; other swatches stay.

    Only the new centre is refined.  Returns the model with one more row per image.
    """
    hist = cluster.lab_histogram(histogram)
    model = centers_from_match(ranges)
    n = F.count(F.lit(1)).over(_per_image())
    old = model.withColumn("_n", n)
    old = old.withColumn("weight", F.greatest(F.col("weight") * (1.0 - 1.0 / (F.col("_n") + 1)), F.lit(1e-4)))
    seed = cluster.farthest_seed(hist, model)
    sizes = old.groupBy("image_id").agg(F.max("_n").alias("_n"))
    new = with_rgb_from_lab(seed, LAB, ("match_r", "match_g", "match_b")).join(sizes, "image_id")
    new = new.select(
        "image_id", F.col("_n").cast("int").alias("idx"), *LAB, "match_r", "match_g", "match_b",
        *[F.col(f"match_{c}").alias(f"repl_{c}") for c in "rgb"],
        (1.0 / (F.col("_n") + 1)).alias("weight"), F.lit("").alias("name"), F.lit(True).alias("visible"),
    )
    both = old.select(*MODEL).unionByName(new.select(*MODEL))
    both = materialize(both.withColumn("weight", F.col("weight") / F.sum("weight").over(_per_image())), "ranges")
    packed = both.groupBy("image_id").agg(
        F.sort_array(F.collect_list(F.struct("idx", *LAB, F.col("weight").alias("w")))).alias("cs"),
        F.sum("weight").alias("w_total"),
    )
    settled = cluster.settle_new_center(hist, packed).select("image_id", F.element_at("cs", -1).alias("c"))
    moved = both.join(settled, "image_id")
    is_new = F.col("idx") == F.col("c.idx")
    moved = moved.select(
        *[F.when(is_new, F.col(f"c.{m}")).otherwise(F.col(m)).alias(m) if m in LAB else m for m in MODEL]
    )
    last = F.col("idx") == F.max("idx").over(_per_image())
    rgb = with_rgb_from_lab(moved.withColumn("_last", last), LAB, ("_r", "_g", "_b"))
    out = rgb.select(
        *[
            F.when(F.col("_last"), F.col(f"_{m[-1]}")).otherwise(F.col(m)).alias(m)
            if m.startswith(("match_", "repl_"))
            else m
            for m in MODEL
        ]
    )
    return floored_weights(out, floor)


def steal_weights(ranges: DataFrame, index: int, target: float, floor: float | None = None, split: str = "lab") -> DataFrame:
    """Give one range ``target`` weight, taken from a single neighbour.

    The neighbour is the Lab-nearest other centre (``split='lab'``) or the right
    neighbour, last takes left (``split='bins'``).  Adds ``steal_a``/``steal_b``.
    """
    lo = clamp_floor(floor)
    n = F.count(F.lit(1)).over(_per_image())
    base = ranges.withColumn("_n", n).withColumn(
        "steal_a", F.least(F.greatest(F.lit(int(index)), F.lit(0)), F.col("_n") - 1).cast("int")
    )
    if split == "lab":
        near = assign.nearest_other(ranges.drop("weight")).select(
            "image_id", F.col("idx").alias("steal_a"), F.col("neighbor").alias("steal_b")
        )
        base = base.join(near, ["image_id", "steal_a"], "left")
    else:
        base = base.withColumn(
            "steal_b",
            F.when(F.col("steal_a") < F.col("_n") - 1, F.col("steal_a") + 1).otherwise(F.col("steal_a") - 1),
        )

    def at(c: str) -> Column:
        return F.max(F.when(F.col("idx") == F.col(c), F.col("weight"))).over(_per_image())

    base = base.withColumn("_pair", at("steal_a") + at("steal_b"))
    cap = F.greatest(F.lit(lo), F.col("_pair") - lo)
    give = F.least(F.greatest(F.lit(float(target)), F.lit(lo)), cap)
    w = (
        F.when(F.col("_n") <= 1, 1.0)
        .when(F.col("idx") == F.col("steal_a"), give)
        .when(F.col("idx") == F.col("steal_b"), F.col("_pair") - give)
        .otherwise(F.col("weight"))
    )
    stolen = base.withColumn("weight", w)
    stolen = stolen.withColumn("weight", F.col("weight") / F.sum("weight").over(_per_image()))
    return floored_weights(stolen.drop("_n", "_pair"), floor)


def reweight_ranges(
    labelled: DataFrame, ranges: DataFrame, index: int, target: float, floor: float | None = None
) -> tuple[DataFrame, DataFrame]:
    """Set one range's coverage on a Lab model: (re-labelled pixels, new ranges).

    Only pixels of the pair may switch sides; all other labels are frozen.  The new model is
    written first: its file size lets the join with the pixels be planned without a shuffle.
    """
    new = materialize(steal_weights(ranges, index, target, floor), "model")
    pair = new.groupBy("image_id").agg(
        F.max("steal_a").alias("_a"),
        F.max("steal_b").alias("_b"),
        *[F.max(F.when(F.col("idx") == F.col(s), F.struct(*LAB, "weight"))).alias(f"_c{t}")
          for s, t in (("steal_a", "a"), ("steal_b", "b"))],
    )
    lab = labelled if set(LAB) <= set(labelled.columns) else with_lab(labelled)
    j = lab.join(pair, "image_id", "left")

    def score(c: str) -> Column:
        w = F.col(f"_c{c}.weight")
        return q(dist2([F.col(n) for n in LAB], [F.col(f"_c{c}.{n}") for n in LAB]) / (w * w), 6)

    moved = F.when(
        F.col("label").isin(-1) | ~((F.col("label") == F.col("_a")) | (F.col("label") == F.col("_b"))),
        F.col("label"),
    ).otherwise(F.when(score("b") < score("a"), F.col("_b")).otherwise(F.col("_a")))
    out = j.withColumn("label", F.coalesce(moved, F.col("label")).cast("int"))
    return out.select(*labelled.columns), new


def reweight_bins(
    pixels: DataFrame,
    histogram: DataFrame,
    ranges: DataFrame,
    index: int,
    target: float,
    n: int,
    channel: str = "luma",
    even: bool = False,
    start: float | None = None,
    floor: float | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Set one bin's coverage by moving its edge with the neighbour: (labelled, edges)."""
    new = steal_weights(ranges, index, target, floor, split="bins")
    packed = new.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("idx", "weight"))).alias("_w"))
    weights = packed.select("image_id", F.transform("_w", lambda s: s["weight"]).alias("weights"))
    edges = bins.bin_edges(histogram, n, channel, start, even, weights)
    return bins.label_bins(pixels, edges, channel), edges


def reset_ranges(histogram: DataFrame, ranges: DataFrame, k: int) -> DataFrame:
    """Re-fit centres on the image and reset swatches, weights and names; eyes stay."""
    fresh = model_from_centers(cluster.kmeans_fit(histogram, k))
    eyes = ranges.select("image_id", "idx", F.col("visible").alias("_eye"))
    out = fresh.join(eyes, ["image_id", "idx"], "left")
    return out.withColumn("visible", F.coalesce("_eye", F.lit(True))).select(*MODEL)


def apply_palette(ranges: DataFrame, presets: DataFrame, snap: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """Paint presets onto models with the same band count: (models, mismatches).

    ``ranges`` carries ``preset_id``; ``presets`` is ``(id, palette_as_centers,
    bands array<struct<name, rgb, match_rgb>>)``.  With snap, match swatches and
    centres move too.
    """
    bands = presets.select(
        F.col("id").alias("preset_id"),
        F.size("bands").alias("_bands"),
        (F.col("palette_as_centers") if snap is None else F.lit(snap)).alias("_snap"),
        F.posexplode("bands").alias("idx", "_band"),
    )
    n = F.count(F.lit(1)).over(_per_image())
    counted = ranges.withColumn("_n", n)
    sizes = bands.select("preset_id", "_bands").distinct()
    sized = counted.join(sizes, "preset_id", "left")
    fits = F.coalesce(F.col("_n") == F.col("_bands"), F.lit(False))
    bad = sized.filter(~fits).select("image_id", "preset_id", F.col("_n").cast("int").alias("ranges"), "_bands").distinct()
    ok = sized.filter(fits).drop("_bands").join(bands, ["preset_id", "idx"])
    match = F.coalesce(F.col("_band.match_rgb"), F.col("_band.rgb"))
    painted = ok.select(
        *[c for c in MODEL if c not in ("name",) and not c.startswith(("match_", "repl_"))],
        F.col("_band.name").alias("name"),
        *[F.when(F.col("_snap"), match[i]).otherwise(F.col(f"match_{c}")).cast("int").alias(f"match_{c}") for i, c in enumerate("rgb")],
        *[F.col("_band.rgb")[i].cast("int").alias(f"repl_{c}") for i, c in enumerate("rgb")],
        "_snap",
    )
    # Cluster centres that were not snapped stay where they were fitted.
    moved = with_lab(painted, ("match_r", "match_g", "match_b"), ("_lab_l", "_lab_a", "_lab_b"))
    out = moved.select(
        *[F.when(F.col("_snap"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in LAB else c for c in MODEL]
    )
    return out, bad.select("image_id", "preset_id", "ranges", F.col("_bands").alias("bands"))
