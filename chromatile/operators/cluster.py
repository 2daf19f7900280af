"""k-means in Lab over colour histograms, for a whole corpus in one job.

Every table is keyed by ``(image_id, k)``, so models of different size and of
different images move through the same rounds together.  Nothing but a single
"still moving" count reaches the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from chromatile.functions.color import dist2, q, with_lab
from chromatile.operators.assign import LAB
from chromatile.session import materialize

# Fixed values of the fit.
ROUNDS = 14
MOVE_EPS = 1e-4
CELL_SIDE = 4.0
K_MIN, K_MAX = 2, 8


def lab_histogram(histogram: DataFrame) -> DataFrame:
    """Histogram with Lab columns, written once because every round reads it."""
    lab = histogram if set(LAB) <= set(histogram.columns) else with_lab(histogram)
    return materialize(lab.select("image_id", "r", "g", "b", "n", *LAB), "histogram")


def _nearest(cs: Column) -> Column:
    """Struct (d, i) of the nearest centre in an array of (lab_l, lab_a, lab_b, idx)."""
    return F.array_min(
        F.transform(
            cs,
            lambda c: F.struct(
                q(dist2([F.col(n) for n in LAB], [c[n] for n in LAB]), 6).alias("d"), c["idx"].alias("i")
            ),
        )
    )


RGB_SPAN = 2**24


def _packed(rank: Column) -> Column:
    """``(rank, r, g, b)`` as one long, so its maximum stays a hash aggregate.

    A maximum over structs would sort every histogram row first.  Squared Lab
    distances in millionths and pixel counts of one image both fit.
    """
    rgb = F.col("r") * 65536 + F.col("g") * 256 + F.col("b")
    return rank.cast("long") * RGB_SPAN + rgb


def _micro(d2: Column) -> Column:
    return F.floor(d2 * 1e6 + 0.5)


def _unpacked(df: DataFrame, key: str) -> DataFrame:
    """Replace a packed key by ``rank``, ``r, g, b`` and Lab."""
    rgb = F.col(key) % RGB_SPAN
    parts = {
        "rank": F.floor(F.col(key) / RGB_SPAN),
        "r": F.floor(rgb / 65536).cast("int"),
        "g": (F.floor(rgb / 256) % 256).cast("int"),
        "b": (rgb % 256).cast("int"),
    }
    return with_lab(df.withColumns(parts).drop(key))


def farthest_seed(histogram: DataFrame, centers: DataFrame) -> DataFrame:
    """Colour with the largest distance to its nearest centre, per image (largest rgb on ties)."""
    lab = histogram if set(LAB) <= set(histogram.columns) else with_lab(histogram)
    packed = centers.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("idx", *LAB))).alias("cs"))
    return _farthest(lab.join(packed, "image_id"), ["image_id"]).select("image_id", "d2", "r", "g", "b", *LAB)


def _farthest(scored: DataFrame, keys: list[str]) -> DataFrame:
    best = scored.groupBy(*keys).agg(F.max(_packed(_micro(_nearest(F.col("cs"))["d"]))).alias("_far"))
    return _unpacked(best, "_far").withColumn("d2", F.col("rank") / 1e6)


def seed_centers(hist: DataFrame, k: int) -> DataFrame:
    """Farthest-first seeds: the most frequent colour, then the farthest colour in turn.

    Returns one row per image: ``(image_id, cs)`` with up to ``k`` centres; an image
    with fewer distinct colours gets fewer.
    """
    first = _unpacked(hist.groupBy("image_id").agg(F.max(_packed(F.col("n"))).alias("_top")), "_top")
    seeds = first.select("image_id", F.array(F.struct(F.lit(0).alias("idx"), *LAB)).alias("cs"))
    for i in range(1, k):
        seeds = materialize(seeds, "seeds")
        far = _farthest(hist.join(seeds, "image_id"), ["image_id"])
        new = F.struct(F.lit(i).alias("idx"), *LAB)
        seeds = seeds.join(far, "image_id").select(
            "image_id", F.when(F.col("d2") > 0, F.concat("cs", F.array(new))).otherwise(F.col("cs")).alias("cs")
        )
    return materialize(seeds, "seeds")


def lloyd(hist: DataFrame, models: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Lloyd rounds on models ``(image_id, k, cs)``; an empty cluster takes the farthest colour.

    A model stops once no coordinate moves by more than 1e-4.  Each round reads the
    histogram and the small model table, and shuffles only per-cluster partial sums.
    """
    models = materialize(models.withColumn("done", F.lit(False)), "models")
    for _ in range(rounds):
        live = models.filter(~F.col("done"))
        labelled = hist.join(live, "image_id").withColumn("_near", _nearest(F.col("cs")))
        parts = labelled.groupBy("image_id", "k", F.col("_near.i").alias("idx")).agg(
            F.sum("n").alias("n"),
            *[F.sum(F.col("n") * F.col(c)).alias(f"s{c}") for c in LAB],
            F.max(_packed(_micro(F.col("_near.d")))).alias("_far"),
        )
        per_model = parts.groupBy("image_id", "k").agg(
            F.collect_list(
                F.struct("idx", *[(F.col(f"s{c}") / F.col("n")).alias(c) for c in LAB])
            ).alias("means"),
            F.max("_far").alias("_far"),
        )
        joined = live.join(_unpacked(per_model, "_far"), ["image_id", "k"])
        far = F.struct(*LAB)

        def moved_to(c: Column) -> Column:
            mine = F.get(F.filter("means", lambda m: m["idx"] == c["idx"]), F.lit(0))
            return F.struct(
                c["idx"].alias("idx"), *[F.coalesce(mine[n], far[n]).alias(n) for n in LAB]
            )

        stepped = joined.withColumn("new", F.transform("cs", moved_to))
        shift = F.array_max(
            F.zip_with(
                "cs", "new", lambda a, b: F.greatest(*[F.abs(a[n] - b[n]) for n in LAB])
            )
        )
        moved = stepped.select("image_id", "k", F.col("new").alias("cs"), (shift <= MOVE_EPS).alias("done"))
        models = materialize(models.filter("done").unionByName(moved), "models")
        if models.filter(~F.col("done")).limit(1).count() == 0:
            break
    return models.select("image_id", "k", "cs")


def unpack(models: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """One row per centre, re-indexed with the darkest L* first."""
    ordered = F.sort_array(
        F.transform("cs", lambda c: F.struct(c["lab_l"].alias("lab_l"), c["idx"].alias("o"), c["lab_a"].alias("lab_a"), c["lab_b"].alias("lab_b")))
    )
    return models.select(*keys, F.posexplode(ordered).alias("idx", "_c")).select(
        *keys, "idx", *[F.col(f"_c.{n}").alias(n) for n in LAB]
    )


def kmeans_fit(histogram: DataFrame, k: int, rounds: int = ROUNDS) -> DataFrame:
    """``k`` Lab centres per image, ``(image_id, idx, lab_l, lab_a, lab_b)``, darkest first."""
    hist = lab_histogram(histogram)
    seeds = seed_centers(hist, k).withColumn("k", F.lit(k))
    return unpack(lloyd(hist, seeds, rounds))


def silhouette_cells(lab: DataFrame, side: float = CELL_SIDE) -> DataFrame:
    """Colours in Lab cells of one size, ``(image_id, n, lab_l, lab_a, lab_b)``: count and mean of each.

    The score is quadratic in its points.  Every pixel weighs in, and the cells that
    8-bit colours can reach, about fourteen thousand, bound the points of any image.
    """
    cells = [F.floor(F.col(c) / side).alias(f"_{c}") for c in LAB]
    means = [(F.sum(F.col("n") * F.col(c)) / F.sum("n")).alias(c) for c in LAB]
    return lab.groupBy("image_id", *cells).agg(F.sum("n").alias("n"), *means).select("image_id", "n", *LAB)


def _silhouette_group(pdf: pd.DataFrame) -> pd.DataFrame:
    pts = pdf[list(LAB)].to_numpy(float)
    n = pdf["n"].to_numpy(float)
    labels = pdf["label"].to_numpy(int)
    out = {c: pdf[c].iloc[:1].to_numpy() for c in pdf.columns if c in ("image_id", "k")}
    used, mine = np.unique(labels, return_inverse=True)
    size = np.bincount(mine, weights=n)
    score = 0.0
    if n.sum() >= 2 and len(used) >= 2:
        onehot = np.zeros((len(n), len(used)))
        onehot[np.arange(len(n)), mine] = n
        sums = np.empty_like(onehot)
        for lo in range(0, len(n), 512):
            diff = pts[lo : lo + 512, None, :] - pts[None, :, :]
            sums[lo : lo + 512] = np.sqrt((diff * diff).sum(-1)) @ onehot
        rows = np.arange(len(n))
        own = size[mine]
        a = np.where(own > 1, sums[rows, mine] / np.maximum(own - 1, 1), 0.0)
        other = sums / size
        other[rows, mine] = np.inf
        b = other.min(axis=1)
        top = np.maximum(a, b)
        ok = np.isfinite(b) & (top > 1e-12)
        if ok.any():
            score = float((n[ok] * (b[ok] - a[ok]) / top[ok]).sum() / n[ok].sum())
    return pd.DataFrame({**out, "silhouette": [score]})


def silhouette(sample: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Mean silhouette (plain Euclidean) of labelled, weighted colours.

    A group is one image's cells, bounded by the gamut; distances are
    summed in blocks inside the task, so no pair ever becomes a row.
    """
    types = dict(sample.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", silhouette double"
    return sample.select(*keys, "n", "label", *LAB).groupBy(*keys).applyInPandas(_silhouette_group, schema)


def elbow_k(inertias: DataFrame) -> DataFrame:
    """k farthest from the chord of the inertia curve; flat curves give the first k."""
    ends = inertias.groupBy("image_id").agg(
        F.min(F.struct("k", "inertia")).alias("a"), F.max(F.struct("k", "inertia")).alias("z")
    )
    j = inertias.join(ends, "image_id")
    span_k = F.col("z.k") - F.col("a.k")
    span_i = F.col("a.inertia") - F.col("z.inertia")
    x = F.when(span_k == 0, 0.0).otherwise((F.col("k") - F.col("a.k")) / span_k)
    y = (F.col("inertia") - F.col("z.inertia")) / span_i
    gap = F.when((F.abs(span_i) < 1e-12) | (span_k == 0), 0.0).otherwise(F.abs(y - (1.0 - x)) / F.lit(2.0**0.5))
    best = j.groupBy("image_id").agg(F.max(F.struct(q(gap, 9).alias("gap"), (-F.col("k")).alias("nk"))).alias("m"))
    return best.select("image_id", (-F.col("m.nk")).cast("int").alias("elbow"))


def ink_gaps(centers: DataFrame, sizes: DataFrame) -> DataFrame:
    """Smallest L* gap between centres and smallest share of the label counts ``(image_id, idx, n)``."""
    order = Window.partitionBy("image_id").orderBy("lab_l")
    gaps = (
        centers.withColumn("_g", F.lead("lab_l").over(order) - F.col("lab_l"))
        .groupBy("image_id")
        .agg(F.coalesce(F.min("_g"), F.lit(0.0)).alias("min_gap"))
    )
    counts = centers.select("image_id", "idx").join(sizes, ["image_id", "idx"], "left")
    shares = counts.groupBy("image_id").agg(
        (F.min(F.coalesce("n", F.lit(0))) / F.greatest(F.sum(F.coalesce("n", F.lit(0))), F.lit(1))).alias("min_share")
    )
    return gaps.join(shares, "image_id")


def hue_spread(centers: DataFrame, chroma_min: float = 8.0) -> DataFrame:
    """Smallest arc, in degrees, that covers the hues of chromatic centres."""
    hue = centers.select(
        "image_id",
        F.degrees(F.atan2("lab_b", "lab_a")).alias("h"),
        (F.sqrt(F.col("lab_a") * F.col("lab_a") + F.col("lab_b") * F.col("lab_b")) >= chroma_min).alias("chromatic"),
    )
    order = Window.partitionBy("image_id", "chromatic").orderBy("h")
    gaps = hue.withColumn("_g", F.lead("h").over(order) - F.col("h"))
    on = F.col("chromatic")
    per = gaps.groupBy("image_id").agg(
        F.count(F.when(on, 1)).alias("c"),
        F.max(F.when(on, F.col("_g"))).alias("g"),
        F.min(F.when(on, F.col("h"))).alias("lo"),
        F.max(F.when(on, F.col("h"))).alias("hi"),
    )
    arc = 360.0 - F.greatest(F.coalesce("g", F.lit(0.0)), F.col("lo") + 360.0 - F.col("hi"))
    return per.select("image_id", F.when(F.col("c") < 2, 0.0).otherwise(arc).alias("spread"))


def choose_k(histogram: DataFrame, k_min: int = K_MIN, k_max: int = K_MAX) -> DataFrame:
    """Cluster count per image from silhouettes, the inertia elbow and the three-ink rule.

    All k are fitted in the same Lloyd rounds; the decision is a query over at
    most ``k_max - k_min + 1`` rows per image.
    """
    hist = lab_histogram(histogram)
    seeds = seed_centers(hist, k_max)
    ks = F.sequence(F.lit(k_min), F.least(F.lit(k_max), F.greatest(F.size("cs"), F.lit(k_min))))
    models = lloyd(
        hist,
        seeds.select("image_id", F.explode(ks).alias("k"), "cs").select(
            "image_id", "k", F.slice("cs", F.lit(1), F.col("k")).alias("cs")
        ),
    )
    near = hist.join(models, "image_id").withColumn("_near", _nearest(F.col("cs")))
    per_label = materialize(
        near.groupBy("image_id", "k", F.col("_near.i").alias("idx")).agg(
            F.sum("n").alias("n"), F.sum(F.col("n") * F.col("_near.d")).alias("sse")
        ),
        "labels",
    )
    inertias = per_label.groupBy("image_id", "k").agg(F.sum("sse").alias("inertia"), F.sum("n").alias("points"))
    sample = (
        silhouette_cells(hist)
        .join(models, "image_id")
        .withColumn("label", _nearest(F.col("cs"))["i"])
    )
    scores = silhouette(sample, ("image_id", "k"))
    # The three-ink facts come from the k = 3 model.
    three = models.filter(F.col("k") == 3).select("image_id", F.inline("cs"))
    sizes = per_label.filter(F.col("k") == 3).select("image_id", "idx", "n")
    chroma = F.sqrt(F.col("lab_a") * F.col("lab_a") + F.col("lab_b") * F.col("lab_b"))
    facts = (
        ink_gaps(three, sizes)
        .join(hue_spread(three), "image_id")
        .join(three.groupBy("image_id").agg(F.percentile(chroma, 0.5).alias("chroma")), "image_id")
    )
    curve = materialize(inertias.join(scores, ["image_id", "k"]), "curve")
    elbow = elbow_k(curve.select("image_id", "k", "inertia"))
    best = curve.groupBy("image_id").agg(F.max("silhouette").alias("best"))
    close = curve.join(best, "image_id").join(elbow, "image_id").filter(F.col("silhouette") >= F.col("best") - 0.02)
    pick = close.groupBy("image_id", "elbow").agg(
        F.min(F.struct(F.abs(F.col("k") - F.col("elbow")).alias("d"), "k")).alias("p")
    )
    at = curve.groupBy("image_id").agg(
        *[F.max(F.when(F.col("k") == k, F.col(c))).alias(f"{c[:3]}{k}") for c in ("inertia", "silhouette") for k in (2, 3)],
        F.max("points").alias("points"),
    )
    j = pick.join(at, "image_id").join(facts, "image_id", "left")
    promote = (
        (F.col("p.k") == 2)
        & (F.col("sil3") >= F.col("sil2") - 0.12)
        & (F.col("ine2") > 1e-12)
        & ((F.col("ine2") - F.col("ine3")) / F.col("ine2") >= 0.25)
        & (F.col("min_gap") >= 10.0)
        & (F.col("min_share") >= 0.03)
        & ((F.col("spread") <= 55.0) | (F.col("chroma") < 8.0))
    )
    chosen = F.when(F.col("points") < 2, F.greatest(F.lit(1), F.col("points"))).otherwise(
        F.when(F.coalesce(promote, F.lit(False)), 3).otherwise(F.col("p.k"))
    )
    return j.select("image_id", chosen.cast("int").alias("k"), "elbow", F.col("sil2").alias("silhouette_2"), F.col("sil3").alias("silhouette_3"))


def settle_new_center(hist: DataFrame, models: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Lloyd rounds that move only the last centre of ``(image_id, cs, w_total)`` models.

    ``cs`` entries carry a weight ``w``; assignment is the weighted nearest centre.
    """
    models = materialize(models.withColumn("done", F.lit(False)), "models")
    for _ in range(rounds):
        live = models.filter(~F.col("done")).withColumn("last", F.size("cs") - 1)

        def score(c: Column) -> Column:
            s = F.col("w_total") / c["w"]
            d2 = dist2([F.col(n) for n in LAB], [c[n] for n in LAB]) * s * s
            return F.struct(q(d2, 6).alias("d"), c["idx"].alias("i"))

        label = F.array_min(F.transform("cs", score))["i"]
        mean = (
            hist.join(live, "image_id")
            .filter(label == F.col("last"))
            .groupBy("image_id")
            .agg(F.sum("n").alias("_n"), *[F.sum(F.col("n") * F.col(c)).alias(f"_s{c}") for c in LAB])
        )
        j = live.join(mean, "image_id", "left")
        old = F.element_at("cs", -1)
        new = F.struct(
            old["idx"].alias("idx"),
            *[F.coalesce(F.col(f"_s{c}") / F.col("_n"), old[c]).alias(c) for c in LAB],
            old["w"].alias("w"),
        )
        shift = F.greatest(*[F.abs(old[c] - F.col(f"_s{c}") / F.col("_n")) for c in LAB])
        moved = j.select(
            "image_id",
            F.concat(F.slice("cs", F.lit(1), F.col("last")), F.array(new)).alias("cs"),
            "w_total",
            F.coalesce(shift <= MOVE_EPS, F.lit(True)).alias("done"),
        )
        models = materialize(models.filter("done").unionByName(moved), "models")
        if models.filter(~F.col("done")).limit(1).count() == 0:
            break
    return models.drop("done")
