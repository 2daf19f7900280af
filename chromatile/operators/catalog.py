"""Colour catalogue: cleaning, look-ups, search and nearest colour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from chromatile.functions.color import hex_color, with_lab
from chromatile.operators.assign import LAB
from chromatile.operators.nearest import nearest_join
from chromatile.session import materialize

# Book suffixes and the fashion-code pattern.
SUFFIXES = ("c", "u", "tcx", "tpx", "tpg", "tpn", "tp", "cp", "up")
# Rough volume and diameter of the sRGB gamut in Lab; they only size the cells.
LAB_VOLUME, LAB_SPAN = 8.2e5, 400.0
FASHION = r"\b(\d{2}-\d{4})(?:\s+(tpx|tcx|tpg|tpn|tp))?\b"


def normalize_key(text: Column) -> Column:
    """Collapse space, drop a leading brand word, fold case."""
    flat = F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))
    return F.trim(F.regexp_replace(flat, "^pantone ", ""))


def display_code(key: Column) -> Column:
    """Pretty form of a normalised key: ``186 c`` -> ``186 C``."""
    tokens = F.filter(F.split(key, " "), lambda t: t != "")
    count = F.size(tokens)

    def shown(t: Column, i: Column) -> Column:
        title = F.regexp_replace(F.initcap(F.regexp_replace(t, "([^a-z]+)", " $1 ")), " ", "")
        return (
            F.when((i == count - 1) & t.isin(*SUFFIXES), F.upper(t))
            .when(t.rlike("^[a-z]{1,3}$"), F.upper(t))
            .when(t.rlike("^[a-z]"), title)
            .otherwise(t)
        )

    return F.array_join(F.transform(tokens, shown), " ")


# Forms of the codes.
BOOK_CODE, FASHION_CODE = r"^\d+[a-z]?\s+[cu]$", r"^\d{2}-\d{4}(?:\s+\w+)?$"


def canonical_rank(key: Column) -> Column:
    """0 for numeric book codes, 1 for fashion codes, 2 for names."""
    return F.when(key.rlike(BOOK_CODE), 0).when(key.rlike(FASHION_CODE), 1).otherwise(2)


def load_catalog(raw: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(catalog, alias, by_hex) from raw ``(ord, name, hex)`` rows.

    ``catalog`` has one row per key: its last hex, first position, display code and
    Lab.  ``alias`` maps every extra spelling to the hex that claimed it first.
    ``by_hex`` maps each hex to the key of best canonical rank.
    """
    rows = raw.select(
        "ord",
        normalize_key(F.col("name")).alias("key"),
        F.concat(F.lit("#"), F.upper(F.regexp_replace(F.trim("hex"), "^#+", ""))).alias("hex"),
    ).filter(F.col("key") != "")
    catalog = rows.groupBy("key").agg(F.max_by("hex", "ord").alias("hex"), F.min("ord").alias("ord"))
    catalog = with_lab(
        catalog.withColumn("display", display_code(F.col("key"))).withColumns(
            {c: F.conv(F.substring("hex", 2 * i + 2, 2), 16, 10).cast("int") for i, c in enumerate("rgb")}
        )
    )
    compact = F.regexp_replace("key", " ", "")
    code = F.regexp_extract("key", FASHION, 1)
    suffix = F.regexp_extract("key", FASHION, 2)
    spellings = F.array_compact(
        F.array(
            F.col("key"),
            F.when(compact != F.col("key"), compact),
            F.when(code != "", code),
            F.when((code != "") & (suffix != ""), F.concat_ws(" ", code, suffix)),
        )
    )
    alias = (
        rows.select("ord", "hex", F.explode(spellings).alias("alias"))
        .groupBy("alias")
        .agg(F.min_by("hex", "ord").alias("hex"))
    )
    key = F.col("key")
    by_hex = rows.groupBy("hex").agg(
        F.min(F.struct(canonical_rank(key).alias("rank"), F.length(key).alias("len"), key.alias("key"))).alias("m"),
        F.min("ord").alias("ord"),
    ).select("hex", F.col("m.key").alias("key"), "ord")
    return catalog, alias, by_hex


def catalog_lookup(texts: DataFrame, col: str, catalog: DataFrame, alias: DataFrame) -> DataFrame:
    """Add ``hex``: exact key first, else an alias, else NULL."""
    keyed = texts.withColumn("_key", normalize_key(F.col(col)))
    exact = catalog.select(F.col("key").alias("_key"), F.col("hex").alias("_exact"))
    extra = alias.select(F.col("alias").alias("_key"), F.col("hex").alias("_alias"))
    out = keyed.join(exact, "_key", "left").join(extra, "_key", "left")
    hit = F.when(F.col("_key") != "", F.coalesce("_exact", "_alias"))
    return out.withColumn("hex", hit).drop("_key", "_exact", "_alias")


def search_catalog(catalog: DataFrame, query: str, limit: int = 24) -> DataFrame:
    """Prefix matches, then substring matches, catalogue order in each tier."""
    needle = " ".join(query.split()).lower()
    if not needle or limit <= 0:
        return catalog.limit(0).select(F.lit(0).alias("tier"), "ord", "display")
    folded = F.lower("display")
    hay = F.concat_ws(" ", "key", F.regexp_replace("key", " ", ""), folded)
    tier = F.when(folded.startswith(needle) | hay.startswith(needle), 0).when(
        folded.contains(needle) | hay.contains(needle), 1
    )
    return (
        catalog.select(tier.alias("tier"), "ord", "display").filter("tier is not null").orderBy("tier", "ord").limit(limit)
    )


def nearest_catalog(colors: DataFrame, by_hex: DataFrame) -> DataFrame:
    """Catalogue key for each (r, g, b): exact hex first, else the nearest Lab entry.

    Distinct colours only; cubes of Lab space are sized so one holds a few entries.
    Earlier catalogue rows win ties.
    """
    wanted = colors.select("r", "g", "b").distinct().withColumn("hex", hex_color(F.col("r"), F.col("g"), F.col("b")))
    exact = materialize(wanted.join(by_hex.select("hex", "key"), "hex", "left"), "exact")
    found = exact.filter("key is not null").select("r", "g", "b", "key", F.lit(0.0).alias("d2"))
    entries = with_lab(
        by_hex.withColumns(
            {c: F.conv(F.substring("hex", 2 * i + 2, 2), 16, 10).cast("int") for i, c in enumerate("rgb")}
        )
    ).select(F.col("key").alias("id"), "ord", *LAB)
    entries = materialize(entries, "entries")
    n = entries.count()
    if n == 0:
        return found
    points = with_lab(exact.filter("key is null").select("r", "g", "b"))
    side = max(1.0, (LAB_VOLUME * 2.0 / n) ** (1.0 / 3.0))
    near = nearest_join(points, entries, LAB, side, LAB_SPAN)
    return found.unionByName(near.select("r", "g", "b", F.col("m.id").alias("key"), F.col("m.d2").alias("d2")))
