"""Edit-session documents (version 2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from chromatile.functions.tone import PARAMS
from chromatile.session import materialize

_S, _D, _I, _B = T.StringType(), T.DoubleType(), T.IntegerType(), T.BooleanType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


RGB = T.ArrayType(_I)
RANGE = _struct(name=_S, match_rgb=RGB, replacement_rgb=RGB, weight=_D, visible=_B)
LAYER = _struct(
    id=_S, name=_S, type=_S, kind=_S, visible=_B, x=_I, y=_I, scale=_D, role=_S, path=_S, image_path=_S,
    parent_id=_S, range_index=_I, expanded=_B, text=_S,
)
SESSION = _struct(
    version=_I, image_path=_S, preset_id=_S, split_method=_S, assignment_mode=_S, range_count=_I,
    bin_start=_D, min_coverage=_D, ranges=T.ArrayType(RANGE), texture=_struct(strength=_D, enabled=_B),
    tone=_struct(**{p: _D for p in PARAMS}), crop=_struct(x=_I, y=_I, zoom=_D),
    tessellate=_struct(h=_S, v=_S, built=_B, mode=_S, tiles=_I, lloyd=_I, normalize=_B),
    layers=T.ArrayType(LAYER),
)
DEFAULT_RANGES = 4
SCALE_MIN, SCALE_MAX = 0.05, 8.0


def _clamped(rgb: Column) -> Column:
    ok = F.size(rgb) >= 3
    return F.when(ok, F.transform(F.slice(rgb, 1, 3), lambda c: F.least(F.lit(255), F.greatest(F.lit(0), c)))).otherwise(
        F.array(F.lit(0), F.lit(0), F.lit(0))
    )


def load_sessions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(models, ranges, layers) from JSON session files; the file path is the id."""
    docs = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("id"), F.col("value").alias("json"))
    return parse_sessions(docs)


def parse_sessions(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same from a frame ``(id, json)``.  Missing or mistyped fields take their defaults."""
    # Parsed once; the three outputs then read only their own columns.
    parsed = materialize(docs.select("id", F.from_json("json", SESSION).alias("s")), "sessions")
    s = parsed.filter("s is not null").select("id", "s.*")
    ranges = F.coalesce("ranges", F.array().cast(T.ArrayType(RANGE)))
    n = F.coalesce(
        F.when(F.col("range_count") != 0, F.col("range_count")),
        F.when(F.size(ranges) > 0, F.size(ranges)),
        F.lit(DEFAULT_RANGES),
    )
    # The global balances fall back to the older highlight names.
    tone = {p: F.coalesce(f"tone.{p}", F.lit(0.0)) for p in PARAMS if not p.startswith(("balance_", "lights_c", "lights_m", "lights_y"))}
    for ink in ("cyan", "magenta", "yellow"):
        value = F.coalesce(f"tone.balance_{ink}", f"tone.lights_{ink}", F.lit(0.0))
        tone[f"balance_{ink}"] = value
        tone[f"lights_{ink}"] = value
    floor = F.least(F.lit(0.40), F.greatest(F.lit(0.0), F.coalesce("min_coverage", F.lit(0.03))))
    models = s.select(
        "id",
        F.coalesce(F.when(F.col("split_method") != "", F.col("split_method")), F.lit("color_closeness")).alias("split_method"),
        F.coalesce(F.when(F.col("assignment_mode") != "", F.col("assignment_mode")), F.lit("kmeans")).alias("assignment_mode"),
        n.cast("int").alias("range_count"),
        "bin_start",
        floor.alias("min_coverage"),
        F.coalesce("texture.strength", F.lit(1.0)).alias("texture_strength"),
        F.coalesce("texture.enabled", F.lit(True)).alias("texture_enabled"),
        *[v.alias(f"tone_{k}") for k, v in sorted(tone.items())],
        F.coalesce("crop.x", F.lit(0)).alias("crop_x"),
        F.coalesce("crop.y", F.lit(0)).alias("crop_y"),
        F.coalesce("crop.zoom", F.lit(1.0)).alias("crop_zoom"),
    )
    rows = s.select("id", F.posexplode(ranges).alias("idx", "r"))
    range_rows = rows.filter("r is not null").select(
        "id",
        "idx",
        F.coalesce("r.name", F.lit("")).alias("name"),
        *[_clamped(F.col("r.match_rgb"))[i].alias(f"match_{c}") for i, c in enumerate("rgb")],
        *[_clamped(F.col("r.replacement_rgb"))[i].alias(f"repl_{c}") for i, c in enumerate("rgb")],
        F.coalesce("r.weight", F.lit(0.0)).alias("weight"),
        F.coalesce("r.visible", F.lit(True)).alias("visible"),
    )
    kind = F.coalesce(F.when(F.col("l.type") != "", F.col("l.type")), F.col("l.kind"), F.lit("image"))
    layers = s.select("id", F.posexplode("layers").alias("ord", "l")).filter("l is not null")
    layers = layers.withColumn("_k", F.when(kind.isin("image", "label", "group", "range"), kind).otherwise("image"))
    named = F.when(F.col("l.name") != "", F.col("l.name"))
    layer_rows = layers.select(
        F.col("id").alias("doc_id"),
        F.coalesce("l.id", F.lit("")).alias("id"),
        F.coalesce("l.parent_id", F.lit("")).alias("parent_id"),
        "ord",
        F.col("_k").alias("kind"),
        F.coalesce(named, F.when(F.col("_k") == "label", "Label").otherwise("Image")).alias("name"),
        F.coalesce("l.role", F.lit("")).alias("role"),
        F.coalesce("l.visible", F.lit(True)).alias("visible"),
        F.coalesce("l.x", F.lit(0)).alias("x"),
        F.coalesce("l.y", F.lit(0)).alias("y"),
        F.least(F.lit(SCALE_MAX), F.greatest(F.lit(SCALE_MIN), F.coalesce("l.scale", F.lit(1.0)))).alias("scale"),
        F.coalesce("l.range_index", F.lit(-1)).alias("range_index"),
        F.coalesce("l.expanded", F.lit(True)).alias("expanded"),
    )
    return models, range_rows, layer_rows


def _listed(rows: DataFrame, doc: str, body: list[Column], name: str) -> DataFrame:
    """One array per document, each row at its place; places nobody has are null."""
    place = "idx" if "idx" in rows.columns else "ord"
    packed = rows.groupBy(F.col(doc).alias("id")).agg(
        F.map_from_entries(F.collect_list(F.struct(place, F.struct(*body)))).alias("_m"), F.max(place).alias("_top")
    )
    return packed.select("id", F.transform(F.sequence(F.lit(0), "_top"), lambda i: F.try_element_at("_m", i)).alias(name))


def session_documents(models: DataFrame, ranges: DataFrame, layers: DataFrame) -> DataFrame:
    """Session documents ``(id, json)`` of the three tables; ``parse_sessions`` gives the same tables back.

    A document is what one user edits, so its ranges and layers fit into one row.
    """
    rgb = lambda p: F.array(*[F.col(f"{p}_{c}") for c in "rgb"])
    range_body = [F.col("name"), rgb("match").alias("match_rgb"), rgb("repl").alias("replacement_rgb"), F.col("weight"), F.col("visible")]
    layer_body = [F.col(c) for c in ("id", "parent_id", "name", "role", "visible", "x", "y", "scale", "range_index", "expanded")] + [F.col("kind").alias("type")]
    docs = models.join(_listed(ranges, "id", range_body, "ranges"), "id", "left").join(_listed(layers, "doc_id", layer_body, "layers"), "id", "left")
    tone = [F.col(f"tone_{p}").alias(p) for p in PARAMS]
    doc = F.struct(
        F.lit(2).alias("version"), "split_method", "assignment_mode", "range_count", "bin_start", "min_coverage", "ranges",
        F.struct(F.col("texture_strength").alias("strength"), F.col("texture_enabled").alias("enabled")).alias("texture"),
        F.struct(*tone).alias("tone"), F.struct(*[F.col(f"crop_{c}").alias(c) for c in ("x", "y", "zoom")]).alias("crop"), "layers",
    )
    return docs.select("id", F.to_json(doc).alias("json"))


def write_sessions(models: DataFrame, ranges: DataFrame, layers: DataFrame, path: str) -> str:
    """Write the documents as a table ``(id, json)``, which ``parse_sessions`` reads."""
    session_documents(models, ranges, layers).write.parquet(path)
    return path
