"""Plate, job-pack and manifest writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from chromatile.functions.color import hex_color, luma, to_byte
from chromatile.operators import paint
from chromatile.session import materialize

# File stems of the three named seed bands.
NAMED_STEMS = {
    "Dark / Garden Grove": "03_dark_garden_grove",
    "Mid / Surf Green": "02_midtone_surf_green",
    "Light / Verdigreen": "01_light_verdigreen",
}


# Layout of written frames.
BUCKETS, BAND, SALTS = 64, 512, 8


def band_slug(name: Column, index: Column) -> Column:
    """Lower-case alphanumerics with single underscores, else ``band_NN``."""
    raw = F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", "_")
    raw = F.regexp_replace(raw, "^_+|_+$", "")
    return F.when(raw == "", F.format_string("band_%02d", index)).otherwise(raw)


def color_stem(name: Column, index: Column) -> Column:
    return F.concat(F.format_string("%02d_", index + 1), band_slug(name, index))


def mask_stem(name: Column, index: Column) -> Column:
    out = F.concat(F.format_string("%02d_", index), band_slug(name, index), F.lit("_mask"))
    for band, stem in NAMED_STEMS.items():
        out = F.when(name == band, f"{stem}_mask").otherwise(out)
    return out


def plates(master: DataFrame, ranges: DataFrame) -> DataFrame:
    """One RGBA plate per visible range.

    ``master`` is the painted frame with ``label`` and source alpha ``a``.  Each
    pixel lands on the plate of its own label only, so a plate stores its opaque
    part; everything else on it has alpha 0.  Hidden ranges leave a gap.
    """
    eyes = ranges.filter("visible").select(
        "image_id", F.col("idx").alias("label"), color_stem(F.col("name"), F.col("idx")).alias("stem")
    )
    alpha = F.floor(F.lit(255) * F.col("a") / 255).cast("int") if "a" in master.columns else F.lit(255)
    out = master.join(eyes, ["image_id", "label"])
    keep = [c for c in master.columns if c not in ("label", "a")]
    return out.select(*keep, alpha.alias("a"), F.col("label").alias("idx"), "stem")


def _write(rows: DataFrame, path: str) -> str:
    """Write in a fixed number of buckets of images, sorted inside, so row groups prune by image.

    A folder per image would be millions of them.  Bands of rows (of other keys
    where there is no ``y``) keep a large image from being one task.
    """
    order = [c for c in ("image_id", "idx", "y", "x") if c in rows.columns]
    rest = [c for c in rows.columns if c not in ("r", "g", "b", "a", "v", "stem", "idx", "image_id")]
    band = F.floor(F.col("y") / BAND) if "y" in rest else F.pmod(F.xxhash64(*rest), F.lit(SALTS)) if rest else F.lit(0)
    out = rows.withColumns({"bucket": F.pmod(F.xxhash64("image_id"), F.lit(BUCKETS)).cast("int"), "_band": band})
    out = out.repartition("bucket", "_band").sortWithinPartitions("bucket", *order).drop("_band")
    out.write.partitionBy("bucket").parquet(path)
    return path


def write_plates(master: DataFrame, ranges: DataFrame, path: str) -> str:
    return _write(plates(master, ranges), path)


def write_job_pack(labelled: DataFrame, ranges: DataFrame, path: str, strength: float = 1.0, tone: dict | None = None) -> dict[str, str]:
    """Masks, luma plate, exact and grain composites, and the manifest.

    The labelled frame is written once; each output is a narrow pass over it.
    """
    labelled = materialize(labelled, "labelled")
    out = {k: f"{path}/{k}" for k in ("masks", "luma", "exact", "grain", "manifest")}
    keys = [c for c in labelled.columns if c not in ("r", "g", "b", "a", "label")]
    masks = labelled.filter((F.col("a") > 0) & (F.col("label") >= 0)).select(*keys, F.col("label").alias("idx"), F.lit(255).alias("v"))
    _write(masks, out["masks"])
    grey = to_byte(luma(F.col("r"), F.col("g"), F.col("b")))
    _write(labelled.select(*keys, grey.alias("v")), out["luma"])
    for kind, s in (("exact", 0.0), ("grain", strength)):
        _write(paint.render(labelled, ranges, s, tone), out[kind])
    palette_manifest(ranges).write.parquet(out["manifest"])
    return out


def palette_manifest(ranges: DataFrame, split_method: str = "color_closeness", preset_id: str = "") -> DataFrame:
    """JSON manifest per image: model scalars and the ordered layer array.

    ``ranges`` has at most 24 rows per image and may carry ``low``, ``high`` and ``weight``.
    """
    idx, name = F.col("idx"), F.col("name")
    low = F.col("low") if "low" in ranges.columns else F.col("lab_l")
    high = F.col("high") if "high" in ranges.columns else F.col("lab_l")
    shown = F.when(name != "", name).otherwise(F.concat(F.lit("Range "), idx + 1))
    layer = F.struct(
        idx.alias("i"),
        F.struct(
            F.format_string("%02d", idx).alias("id"),
            shown.alias("name"),
            F.lit("Image/Color ranges").alias("parent"),
            F.concat(F.lit("Image/Color ranges/"), shown).alias("path"),
            hex_color(F.col("repl_r"), F.col("repl_g"), F.col("repl_b")).alias("hex"),
            F.array("repl_r", "repl_g", "repl_b").alias("rgb"),
            low.alias("luma_low"),
            high.alias("luma_high"),
            F.col("weight").alias("weight"),
            F.col("visible").alias("visible"),
            F.concat(mask_stem(name, idx), F.lit(".png")).alias("mask"),
            idx.alias("index_darkest_is_zero"),
        ).alias("layer"),
    )
    per_image = ranges.groupBy("image_id").agg(F.sort_array(F.collect_list(layer)).alias("_ls"))
    doc = F.struct(
        F.lit(preset_id).alias("preset_id"),
        F.lit(split_method).alias("split_method"),
        F.size("_ls").alias("range_count"),
        F.transform("_ls", lambda x: x["layer"]).alias("layers"),
    )
    return per_image.select("image_id", F.to_json(doc).alias("manifest"))
