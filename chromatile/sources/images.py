"""Image files and pixel tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from chromatile.functions.headers import image_header
from chromatile.session import materialize

# Accepted suffixes and the pixel guard.
SUFFIXES = ("tif", "tiff", "png", "jpg", "jpeg")
MAX_PIXELS = 1_000_000_000
GLOB = "*.{tif,tiff,png,jpg,jpeg,TIF,TIFF,PNG,JPG,JPEG}"


def _decoded(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("image").option("pathGlobFilter", GLOB).option("recursiveFileLookup", "true").load(path)


def _reason(channels: str, max_pixels: int, bits: Column | None = None) -> Column:
    """Why a file is not read; null if it is."""
    width, height = F.col("width").cast("long"), F.col("height").cast("long")
    out = (
        F.when(width.isNull() | (width <= 0) | height.isNull() | (height <= 0), "not decodable")
        .when(width * height > max_pixels, "too many pixels")
        .when(F.col(channels).isNull() | ~F.col(channels).isin(3, 4), "not RGB or RGBA")
    )
    return out if bits is None else out.when(bits > 8, "over 8 bits a channel")


def image_headers(spark: SparkSession, path: str, max_pixels: int = MAX_PIXELS) -> tuple[DataFrame, DataFrame]:
    """Size audit: (ok, rejects).

    ``ok`` is ``(path, width, height, channels)``.  Rejects carry a reason: no usable
    header, too many pixels, a channel layout other than RGB / RGBA, or deep channels.  Sizes
    come from the headers, so no image is decoded, not even one too large to be; whether the
    pixels behind a good header can be decoded is for the scan to find.  Spark leaves
    zero-length files out of the list.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", GLOB)
        .option("recursiveFileLookup", "true")
        .load(path)
        .select("path", "length", image_header(F.col("content")).alias("h"))
    )
    files = materialize(files, "headers").select("path", "length", "h.*")  # a row per file, for both results
    audited = files.withColumn("reason", _reason("channels", max_pixels, F.col("bits")))
    ok = audited.filter("reason is null").select("path", F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), "channels")
    return ok, audited.filter("reason is not null").select("path", "length", "reason")


def scan_images(spark: SparkSession, path: str, max_pixels: int = MAX_PIXELS) -> tuple[DataFrame, DataFrame]:
    """Folder of TIFF / PNG / JPEG files to ``(pixels, rejects)``.

    The decoder hands over row-major B, G, R[, A] bytes.  A file is first cut into
    rows, which are repartitioned, so one large file does not pin its pixels to
    one task.  RGB files get alpha 255; rejects are ``(path, width, height, channels, reason)``.
    """
    files = _decoded(spark, path).select("image.*").withColumn("reason", _reason("nChannels", max_pixels))
    rejects = files.filter("reason is not null").select(
        F.col("origin").alias("path"), "width", "height", F.col("nChannels").alias("channels"), "reason"
    )
    img = files.filter("reason is null")
    stride = F.col("width") * F.col("nChannels")
    rows = img.select(
        F.col("origin").alias("image_id"),
        "width",
        "nChannels",
        "data",
        F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y"),
    ).select("image_id", "width", "nChannels", "y", F.substring("data", F.col("y") * stride + 1, stride).alias("row"))
    rows = rows.repartition("image_id", "y")
    px = rows.select(
        "image_id", "y", "nChannels", "row", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("x")
    )

    def byte(i: int):
        # sliced from the binary row, so a pixel costs the same in a row of any width
        at = F.col("x") * F.col("nChannels") + (i + 1)
        return F.conv(F.hex(F.substring("row", at, F.lit(1))), 16, 10).cast("int")

    pixels = px.select(
        "image_id", "y", "x", byte(2).alias("r"), byte(1).alias("g"), byte(0).alias("b"),
        F.when(F.col("nChannels") == 4, byte(3)).otherwise(255).alias("a"),
    )
    return pixels, rejects


def write_pixels(pixels: DataFrame, path: str, band: int = 128) -> str:
    """Pixel table in Parquet, partitioned by image, clustered by row band."""
    (
        pixels.withColumn("_band", F.floor(F.col("y") / band))
        .repartition("image_id", "_band")
        .sortWithinPartitions("image_id", "y", "x")
        .drop("_band")
        .write.partitionBy("image_id")
        .parquet(path)
    )
    return path


def scan_pixels(
    source: DataFrame | str,
    image_ids: Sequence | None = None,
    y0: int | None = None,
    y1: int | None = None,
    spark: SparkSession | None = None,
) -> DataFrame:
    """Pixels of chosen images and rows ``y0 <= y < y1``; partition and row filters reach the scan."""
    px = spark.read.parquet(source) if isinstance(source, str) else source
    if image_ids is not None:
        px = px.filter(F.col("image_id").isin(list(image_ids)))
    if y0 is not None:
        px = px.filter(F.col("y") >= y0)
    if y1 is not None:
        px = px.filter(F.col("y") < y1)
    return px
