"""Palette presets: reading, seeding, upserting and deleting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

# The six seed palettes, (id, name, bands).
SEEDS = (
    ("V6-N", "V6-N", (("Dark / Garden Grove", (94, 127, 87)), ("Mid / Surf Green", (95, 136, 125)), ("Light / Verdigreen", (129, 165, 149)))),
    ("white-and-black", "White and Black", (("White", (255, 255, 255)), ("Black", (0, 0, 0)))),
    ("white-gray-black", "White Gray Black", (("White", (255, 255, 255)), ("Gray", (128, 128, 128)), ("Black", (0, 0, 0)))),
    ("analogous-reds", "Analogous Reds", (("Dark red", (198, 40, 40)), ("Red", (229, 57, 53)), ("Light red", (239, 154, 154)))),
    ("analogous-greens", "Analogous Greens", (("Dark green", (27, 94, 32)), ("Green", (67, 160, 71)), ("Light green", (165, 214, 167)))),
    ("analogous-blues", "Analogous Blues", (("Dark blue", (13, 71, 161)), ("Blue", (30, 136, 229)), ("Light blue", (144, 202, 249)))),
)
LEGACY_SEED_IDS = ("V6-N",)
COLOR_SPLIT = "color_closeness"
SPLITS = (
    COLOR_SPLIT, "equal_lightness", "equal_pixels", "lab_l_equal", "lab_l_pixels",
    "lab_a_equal", "lab_a_pixels", "lab_b_equal", "lab_b_pixels",
)
GENERIC = ("generic", "(none)", "none", "")

BAND = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("rgb", T.ArrayType(T.IntegerType())),
        T.StructField("match_rgb", T.ArrayType(T.IntegerType())),
    ]
)
PRESET = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("split_method", T.StringType()),
        T.StructField("palette_as_centers", T.BooleanType()),
        T.StructField("bands", T.ArrayType(BAND)),
        T.StructField("weights", T.ArrayType(T.DoubleType())),
    ]
)
DOCUMENT = T.StructType(
    [
        T.StructField("seeded_ids", T.ArrayType(T.StringType())),
        T.StructField("presets", T.ArrayType(PRESET)),
    ]
)


def seed_presets_frame(spark: SparkSession) -> DataFrame:
    rows = [
        (pid, name, COLOR_SPLIT, True, [(b, list(c), list(c)) for b, c in bands], [1.0 / len(bands)] * len(bands))
        for pid, name, bands in SEEDS
    ]
    return spark.createDataFrame(rows, PRESET)


def slug(name: Column) -> Column:
    """Lower-case id text with runs of other characters as one dash."""
    lower = F.lower(F.trim(name))
    dashed = F.trim(F.regexp_replace(lower, "[^a-z0-9]+", "-"))
    dashed = F.regexp_replace(dashed, "^-+|-+$", "")
    return F.when(lower.isin("v6-n", "v6n"), "V6-N").when(dashed == "", "preset").otherwise(dashed)


def _clamped(rgb: Column) -> Column:
    return F.when(
        F.size(rgb) == 3, F.transform(rgb, lambda c: F.least(F.lit(255), F.greatest(F.lit(0), c)))
    )


def load_presets(spark: SparkSession, path: str) -> DataFrame:
    """Presets of one or many multi-line JSON documents, keyed by ``document``; ``ord`` is the order inside one."""
    raw = spark.read.schema(DOCUMENT).json(path, multiLine=True).withColumn("document", F.input_file_name())
    rows = raw.select("document", F.posexplode("presets").alias("ord", "p")).select("document", "ord", "p.*")
    return clean_presets(rows)


def parse_presets(docs: DataFrame, text: str = "json") -> DataFrame:
    """Presets from a column of JSON documents, one preset each, with an ``ord`` column.

    The split method is read as text first so a mistyped field spoils that field only.
    """
    rows = docs.select("ord", F.from_json(text, PRESET).alias("p")).select("ord", "p.*")
    return clean_presets(rows)


def clean_presets(rows: DataFrame) -> DataFrame:
    """Drop bad presets and repair bad fields; the first of a repeated id wins, in each document if rows name one."""
    keys = [c for c in ("document",) if c in rows.columns]
    name = F.trim(F.coalesce("name", F.lit("")))
    bands = F.transform(
        "bands",
        lambda b: F.struct(
            F.coalesce(b["name"], F.lit("")).alias("name"),
            _clamped(b["rgb"]).alias("rgb"),
            _clamped(b["match_rgb"]).alias("match_rgb"),
        ),
    )
    kept = rows.withColumns({"name": name, "bands": bands}).filter(
        ~F.lower("name").isin(*GENERIC)
        & (F.size("bands") >= 2)
        & F.forall("bands", lambda b: b["rgb"].isNotNull() & F.forall(b["rgb"], lambda c: c.isNotNull()))
    )
    pid = F.trim(F.coalesce("id", F.lit("")))
    fixed = kept.select(
        *keys,
        "ord",
        F.when(pid == "", slug(F.col("name"))).otherwise(pid).alias("id"),
        "name",
        F.when(F.col("split_method").isin(*SPLITS), F.col("split_method")).otherwise(COLOR_SPLIT).alias("split_method"),
        F.coalesce("palette_as_centers", F.lit(False)).alias("palette_as_centers"),
        "bands",
        F.when(F.size("weights") == F.size("bands"), F.col("weights")).alias("weights"),
    )
    best = Window.partitionBy(*keys, "id").orderBy("ord")
    return fixed.withColumn("_k", F.row_number().over(best)).filter("_k = 1").drop("_k")


def seed_presets(presets: DataFrame, seeded_ids: DataFrame, legacy: bool = True) -> tuple[DataFrame, DataFrame]:
    """Add seed palettes that were never offered: (presets, offered ids).

    A document without recorded ids counts the legacy seed and its own presets as
    offered, so a deleted seed does not come back.
    """
    spark = presets.sparkSession
    seeds = seed_presets_frame(spark)
    if legacy and seeded_ids.limit(1).count() == 0:
        old = spark.createDataFrame([(i,) for i in LEGACY_SEED_IDS], "id string")
        seeded_ids = old.unionByName(presets.select("id")).distinct()
    fresh = (
        seeds.join(seeded_ids.select("id"), "id", "left_anti")
        .withColumns({"_i": F.lower("id"), "_n": F.lower("name")})
        .join(presets.select(F.lower("id").alias("_i")), "_i", "left_anti")
        .join(presets.select(F.lower("name").alias("_n")), "_n", "left_anti")
        .drop("_i", "_n")
    )
    offered = seeded_ids.select("id").union(seeds.select("id")).distinct()
    return presets.unionByName(fresh.select(*[c for c in presets.columns if c in fresh.columns]), allowMissingColumns=True), offered


def upsert_presets(presets: DataFrame, incoming: DataFrame) -> DataFrame:
    """Save incoming presets over stored ones.

    A stored preset with the same name or id (any case) is replaced in place and
    keeps its id; the lowest ``ord`` wins when several match.  Others are appended;
    a taken id becomes the slug of the name with ``-2``, ``-3``, ...
    """
    body = [c for c in presets.columns if c not in ("id", "ord")]
    keyed = presets.select("ord", "id", F.lower("id").alias("_i"), F.lower("name").alias("_n"))
    new = incoming.withColumns({"_i": F.lower("id"), "_n": F.lower("name")}).withColumnRenamed("ord", "_in_ord")
    by_name = keyed.groupBy("_n").agg(F.min(F.struct("ord", "id")).alias("_hit_n"))
    by_id = keyed.groupBy("_i").agg(F.min(F.struct("ord", "id")).alias("_hit_i"))
    hit = new.join(by_name, "_n", "left").join(by_id, "_i", "left")
    hit = hit.withColumn("_hit", F.least("_hit_n", "_hit_i")).withColumnRenamed("id", "_in_id")
    replaced = (
        hit.filter("_hit is not null")
        .groupBy(F.col("_hit.ord").alias("ord"), F.col("_hit.id").alias("id"))
        .agg(F.max_by(F.struct(*body), "_in_ord").alias("_b"))
        .select("ord", "id", "_b.*")
    )
    kept = presets.join(replaced.select("ord"), "ord", "left_anti")
    # New rows: one per name, then one per id; later saves overwrite earlier ones.
    fresh = hit.filter("_hit is null").select("_in_ord", F.col("_in_id").alias("id"), *body)
    latest = (
        fresh.groupBy(F.lower("name").alias("_name"))
        .agg(F.max_by(F.struct(*body), "_in_ord").alias("_b"), F.min(F.struct("_in_ord", "id")).alias("_f"))
        .select("_f._in_ord", "_f.id", "_b.*")
    )
    taken = latest.withColumns(
        {
            "_slug": slug(F.col("name")),
            "_rank": F.row_number().over(Window.partitionBy("id").orderBy("_in_ord")),
        }
    )
    first, clash = taken.filter("_rank = 1"), taken.filter("_rank > 1")
    used = presets.select("id").unionByName(first.select("id")).distinct()
    # Numbers in use after a slug (the slug itself is 1).  Names merge before this
    # point, so a slug is shared only by the few names that spell alike.
    numbered = used.select(
        F.regexp_replace("id", "-[0-9]+$", "").alias("_slug"),
        F.coalesce(F.regexp_extract("id", "-([0-9]+)$", 1).try_cast("int"), F.lit(1)).alias("_no"),
    ).unionByName(used.select(F.col("id").alias("_slug"), F.lit(1).alias("_no")))
    in_use = numbered.join(clash.select("_slug").distinct(), "_slug", "left_semi")
    in_use = in_use.groupBy("_slug").agg(F.collect_set("_no").alias("_nos"))
    step = F.row_number().over(Window.partitionBy("_slug").orderBy("_in_ord"))
    spread = clash.join(in_use, "_slug", "left").withColumn("_step", step)
    taken_nos = F.coalesce("_nos", F.array().cast("array<int>"))
    free = F.array_except(F.sequence(F.lit(1), F.size(taken_nos) + F.col("_step")), taken_nos)
    number = F.get(free, F.col("_step") - 1)
    renamed = spread.withColumn(
        "id", F.when(number <= 1, F.col("_slug")).otherwise(F.concat_ws("-", "_slug", number))
    )
    base = presets.agg(F.max("ord").alias("_max"))
    appended = first.select("_in_ord", "id", *body).unionByName(renamed.select("_in_ord", "id", *body))
    appended = appended.select(
        (F.coalesce(base.scalar(), F.lit(-1)) + 1 + F.col("_in_ord")).cast("long").alias("ord"), "id", *body
    )
    cols = ["ord", "id", *body]
    return kept.select(*cols).unionByName(replaced.select(*cols)).unionByName(appended.select(*cols))


def delete_presets(presets: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove presets whose id or name equals a ``key`` in any case: (kept, misses)."""
    wanted = keys.select("key", F.lower(F.trim("key")).alias("_k")).filter(~F.col("_k").isin(*GENERIC))
    names = presets.select(F.lower("id").alias("_k")).union(presets.select(F.lower("name"))).distinct()
    kept = (
        presets.withColumns({"_a": F.lower("id"), "_b": F.lower("name")})
        .join(wanted.select(F.col("_k").alias("_a")), "_a", "left_anti")
        .join(wanted.select(F.col("_k").alias("_b")), "_b", "left_anti")
        .drop("_a", "_b")
    )
    misses = keys.withColumn("_k", F.lower(F.trim("key"))).join(
        wanted.select("_k").join(names, "_k", "left_semi"), "_k", "left_anti"
    )
    return kept, misses.select("key").distinct()


def write_presets(presets: DataFrame, path: str) -> str:
    """Write one JSON document per ``document`` (one for all without that column), presets in order, for ``load_presets``."""
    body = [f.name for f in PRESET.fields]
    rows = presets if "document" in presets.columns else presets.withColumn("document", F.lit(""))
    listed = F.array_sort(F.collect_list(F.struct("ord", F.struct(*body).alias("p"))), lambda a, b: F.when(a["ord"] < b["ord"], -1).when(a["ord"] > b["ord"], 1).otherwise(0))
    docs = rows.groupBy("document").agg(listed.alias("_l")).select(F.transform("_l", lambda x: x["p"]).alias("presets"))
    docs.write.option("maxRecordsPerFile", 1).json(path)
    return path
