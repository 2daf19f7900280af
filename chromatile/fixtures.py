"""Views that give the test tables a raster shape (definitions in FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

GRID_WIDTH = 21
GRAY_WIDTH = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte(x: Column) -> Column:
    return F.least(F.lit(255), F.greatest(F.lit(0), F.floor(x + F.lit(0.5)))).cast("int")


def px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours without coordinates, eight images."""
    return px_rows(table(spark, sf_dir, "lineitem"))


def px_rows(lineitem: DataFrame) -> DataFrame:
    """The same over the ``lineitem`` columns; also used on the streaming read."""
    return lineitem.select(
        (F.col("l_suppkey") % 8).cast("int").alias("image_id"),
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        byte(F.col("l_quantity") * F.lit(5.1)).alias("r"),
        byte(F.col("l_discount") * F.lit(2550.0)).alias("g"),
        byte(F.col("l_tax") * F.lit(3187.5)).alias("b"),
        F.when(F.col("l_returnflag") == "R", 0).otherwise(255).cast("int").alias("a"),
    )


def _component(index: Column) -> Column:
    return byte((F.element_at("embedding", index + 1).cast("double") + F.lit(0.5)) * F.lit(255.0))


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One RGB raster, 21 pixels wide, a row per vector."""
    x = F.col("x")
    return (
        table(spark, sf_dir, "embeddings")
        .select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(GRID_WIDTH - 1))).alias("x"))
        .select(
            F.lit(0).alias("image_id"),
            F.col("vec_id").cast("int").alias("y"),
            "x",
            _component(x * 3).alias("r"),
            _component(x * 3 + 1).alias("g"),
            _component(x * 3 + 2).alias("b"),
            F.lit(255).alias("a"),
        )
    )


def gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One grey raster, 64 pixels wide."""
    return (
        table(spark, sf_dir, "embeddings")
        .select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(GRAY_WIDTH - 1))).alias("x"))
        .select(
            F.lit(0).alias("image_id"),
            F.col("vec_id").cast("int").alias("y"),
            "x",
            _component(F.col("x")).alias("v"),
        )
    )


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw catalogue rows in input order (``ord``); names repeat."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("ord"),
        F.col("p_name").alias("name"),
        (F.col("p_partkey") * 37 % 256).cast("int").alias("r"),
        (F.col("p_size") * 5 % 256).cast("int").alias("g"),
        (F.floor("p_retailprice") % 256).cast("int").alias("b"),
    )


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_rows(table(spark, sf_dir, "events"))


def instant(df: DataFrame, col: str) -> Column:
    """A zone-less time read as UTC, whatever the session zone; instants pass through."""
    if dict(df.dtypes)[col] != "timestamp_ntz":
        return F.col(col)
    micros = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{col}`)")
    return F.timestamp_micros(micros)


def zoneless(col: str) -> Column:
    """An instant as zone-less UTC time."""
    return F.expr(f"timestampadd(MICROSECOND, unix_micros(`{col}`), TIMESTAMP_NTZ'1970-01-01 00:00:00')").alias(col)


def edit_rows(events: DataFrame) -> DataFrame:
    """Edit log over the ``events`` columns; also used on the streaming read."""
    kind = F.col("event_type")
    action = (
        F.when(kind == "click", "set")
        .when(kind == "view", "select")
        .when(kind == "purchase", "commit")
        .when(kind == "error", "undo")
        .otherwise("redo")
    )
    return events.select(
        "user_id",
        instant(events, "ts").alias("ts"),
        "event_id",
        action.alias("action"),
        (F.floor("value") % 256).cast("int").alias("color"),
        F.get_json_object("props", "$.k").cast("int").alias("payload"),
    )


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layer documents: region = image, nation = group, supplier = range."""
    images = table(spark, sf_dir, "region").select(
        F.col("r_regionkey").cast("int").alias("doc_id"),
        F.concat(F.lit("r"), "r_regionkey").alias("id"),
        F.lit("").alias("parent_id"),
        F.lit(0).alias("ord"),
        F.lit("image").alias("kind"),
        (F.col("r_regionkey") != 1).alias("visible"),
        F.lit(True).alias("expanded"),
    )
    nation = table(spark, sf_dir, "nation")
    groups = nation.select(
        F.col("n_regionkey").cast("int").alias("doc_id"),
        F.concat(F.lit("n"), "n_nationkey").alias("id"),
        F.concat(F.lit("r"), "n_regionkey").alias("parent_id"),
        F.col("n_nationkey").cast("int").alias("ord"),
        F.lit("group").alias("kind"),
        F.lit(True).alias("visible"),
        (F.col("n_nationkey") % 4 != 3).alias("expanded"),
    )
    ranges = (
        table(spark, sf_dir, "supplier")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("n_regionkey").cast("int").alias("doc_id"),
            F.concat(F.lit("s"), "s_suppkey").alias("id"),
            F.concat(F.lit("n"), "s_nationkey").alias("parent_id"),
            F.col("s_suppkey").cast("int").alias("ord"),
            F.lit("range").alias("kind"),
            (F.col("s_acctbal") > 0).alias("visible"),
            F.lit(True).alias("expanded"),
        )
    )
    return images.unionByName(groups).unionByName(ranges)


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes over the ``grid`` raster."""
    rows = table(spark, sf_dir, "embeddings").agg((F.max("vec_id") + 1).alias("rows")).scalar()
    key, size = F.col("p_partkey"), F.col("p_size")
    return (
        table(spark, sf_dir, "part")
        .select(
            F.lit(0).alias("image_id"),
            key.alias("box_id"),
            (size % 18).cast("int").alias("x0"),
            (key % rows).cast("int").alias("y0"),
            rows.cast("int").alias("rows"),
            (key % 3).cast("int").alias("dx"),
            (size % 5).cast("int").alias("dy"),
        )
        .select(
            "image_id",
            "box_id",
            "x0",
            "y0",
            F.least(F.col("x0") + 2 + F.col("dx"), F.lit(GRID_WIDTH)).alias("x1"),
            F.least(F.col("y0") + 2 + F.col("dy"), F.col("rows")).alias("y1"),
        )
    )
