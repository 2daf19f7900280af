"""Catalogue, preset, session, scan and sink queries."""

from __future__ import annotations

import struct
import zlib

import pandas as pd
from pyspark.sql import functions as F

from chromatile import fixtures
from chromatile.functions import color as C
from chromatile.operators import catalog as cat, paint
from chromatile.plans import common, duck
from chromatile.plans.registry import query
from chromatile.session import posix_path, scratch_path
from chromatile.sources import images, presets as ps, sessions, sinks

LAB = ("lab_l", "lab_a", "lab_b")


def png_tiles(grid, path: str, rows: int = 128):
    """Write the raster as PNG files of ``rows`` image rows each; returns their count.

    A file holds one bounded row band, written by the task that owns the band.
    """
    folder = posix_path(path)

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        band = int(pdf["band"].iloc[0])
        pdf = pdf.sort_values(["y", "x"])
        h, w = pdf["y"].nunique(), pdf["x"].nunique()
        data = pdf[["r", "g", "b"]].to_numpy("uint8").reshape(h, w * 3)
        raw = b"".join(b"\0" + line.tobytes() for line in data)

        def chunk(tag: bytes, body: bytes) -> bytes:
            return struct.pack(">I", len(body)) + tag + body + struct.pack(">I", zlib.crc32(tag + body))

        head = struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)
        with open(f"{folder}/band{band:08d}.png", "wb") as f:
            f.write(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))
        return pd.DataFrame({"band": [band]})

    banded = grid.withColumn("band", F.floor(F.col("y") / rows).cast("int")).select("band", "y", "x", "r", "g", "b")
    return banded.groupBy("band").applyInPandas(write, "band int").count()


_BAND = "concat('band', lpad((y // 128)::VARCHAR, 8, '0'))"


@query("scan_images", duck.with_(duck.GRID) + f"SELECT {_BAND} AS image, (y % 128)::INT AS y, x, r, g, b, a FROM grid")
def scan_images(spark, sf):
    path = scratch_path(spark, "png")
    png_tiles(fixtures.grid(spark, sf), path)
    px, _ = images.scan_images(spark, path)
    return px.select(F.regexp_extract("image_id", r"(band\d+)\.png$", 1).alias("image"), "y", "x", "r", "g", "b", "a")


@query("image_headers", duck.with_(duck.GRID) + f"SELECT {_BAND} AS image, 21::INT AS width, count(DISTINCT y)::INT AS height, 3::INT AS channels FROM grid GROUP BY 1")
def image_headers(spark, sf):
    path = scratch_path(spark, "png")
    png_tiles(fixtures.grid(spark, sf), path)
    ok, _ = images.image_headers(spark, path)
    return ok.select(F.regexp_extract("path", r"(band\d+)\.png$", 1).alias("image"), "width", "height", "channels")


# The grid as three images of every third row; two of them are read, in a band of rows.
@query("scan_pixels", duck.with_(duck.GRID) + "SELECT (y % 3)::INT AS image_id, y, x, r, g, b FROM grid WHERE y >= 100 AND y < 400 AND y % 3 IN (0, 2)")
def scan_pixels(spark, sf):
    three = fixtures.grid(spark, sf).withColumn("image_id", (F.col("y") % 3).cast("int"))
    path = images.write_pixels(three, scratch_path(spark, "pixels"))
    return images.scan_pixels(path, [0, 2], 100, 400, spark).select("image_id", "y", "x", "r", "g", "b")


# Raw names that exercise the brand word, book codes, fashion codes and repeats.
def _raw(spark, sf):
    c = fixtures.catalog(spark, sf)
    k, kind = F.col("ord"), F.col("ord") % 6
    name = (
        F.when(kind == 0, F.format_string("Pantone %d C", k % 400))
        .when(kind == 1, F.col("name"))
        .when(kind == 2, F.format_string("%02d-%04d TCX", k % 100, k * 37 % 10000))
        .when(kind == 3, F.concat(F.lit("  "), F.col("name"), F.lit("   u ")))
        .when(kind == 4, F.upper("name"))
        .otherwise(F.format_string("PANTONE  %d-%s", k % 50, F.col("name")))
    )
    return c.select("ord", name.alias("name"), F.lower(C.hex_color(F.col("r"), F.col("g"), F.col("b"))).alias("hex"))


_RAWSQL = duck.CATALOG + """,
raw AS (SELECT ord, CASE ord % 6 WHEN 0 THEN printf('Pantone %d C', ord % 400) WHEN 1 THEN name
  WHEN 2 THEN printf('%02d-%04d TCX', ord % 100, ord*37 % 10000) WHEN 3 THEN '  ' || name || '   u ' WHEN 4 THEN upper(name)
  ELSE printf('PANTONE  %d-%s', ord % 50, name) END AS name, printf('#%02X%02X%02X', r, g, b) AS hex FROM rawcat),
rws AS (SELECT ord, trim(regexp_replace(lower(trim(regexp_replace(name, '\\s+', ' ', 'g'))), '^pantone ', '')) AS key, hex FROM raw),
cat AS (SELECT key, arg_max(hex, ord) AS hex, min(ord) AS ord FROM rws WHERE key <> '' GROUP BY key),
tok AS (SELECT key, hex, ord, string_split(key, ' ') AS ts FROM cat),
shown AS (SELECT key, hex, ord, list_aggregate(list_transform(ts, lambda t, i:
   CASE WHEN i = len(ts) AND t IN ('c','u','tcx','tpx','tpg','tpn','tp','cp','up') THEN upper(t)
        WHEN regexp_full_match(t, '[a-z]{1,3}') THEN upper(t)
        WHEN regexp_matches(t, '^[a-z]') THEN upper(t[1]) || t[2:] ELSE t END), 'string_agg', ' ') AS display FROM tok),
als AS (SELECT alias, arg_min(hex, ord) AS hex FROM (
   SELECT ord, hex, key AS alias FROM rws UNION ALL SELECT ord, hex, replace(key, ' ', '') FROM rws
   UNION ALL SELECT ord, hex, regexp_extract(key, '\\b(\\d{2}-\\d{4})', 1) FROM rws WHERE regexp_matches(key, '\\b\\d{2}-\\d{4}\\b')
   UNION ALL SELECT ord, hex, regexp_extract(key, '\\b(\\d{2}-\\d{4}) tcx\\b', 1) || ' tcx' FROM rws WHERE regexp_matches(key, '\\b\\d{2}-\\d{4} tcx\\b')) GROUP BY alias),
byhex AS (SELECT hex, key, ord FROM (SELECT hex, key, min(ord) OVER (PARTITION BY hex) AS ord, row_number() OVER (PARTITION BY hex ORDER BY
   CASE WHEN regexp_full_match(key, '\\d+[a-z]?\\s+[cu]') THEN 0 WHEN regexp_full_match(key, '\\d{2}-\\d{4}(\\s+\\w+)?') THEN 1 ELSE 2 END, length(key), key) AS rk FROM rws) WHERE rk = 1)"""


@query("load_catalog", duck.with_(_RAWSQL) + """
SELECT 'key' AS kind, key AS name, hex, display AS extra, ord FROM shown
UNION ALL SELECT 'alias', alias, hex, '', 0 FROM als UNION ALL SELECT 'hex', hex, hex, key, ord FROM byhex""")
def load_catalog(spark, sf):
    catalog, alias, by_hex = cat.load_catalog(_raw(spark, sf))
    a = catalog.select(F.lit("key").alias("kind"), F.col("key").alias("name"), "hex", F.col("display").alias("extra"), "ord")
    b = alias.select(F.lit("alias").alias("kind"), F.col("alias").alias("name"), "hex", F.lit("").alias("extra"), F.lit(0).cast("long").alias("ord"))
    c = by_hex.select(F.lit("hex").alias("kind"), F.col("hex").alias("name"), "hex", F.col("key").alias("extra"), "ord")
    return a.unionByName(b).unionByName(c)


@query("catalog_lookup", duck.with_(_RAWSQL, """
txt AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN ' pantone ' || upper(p_name) WHEN 1 THEN replace(p_name, ' ', '') || 'u'
  WHEN 2 THEN printf('%02d-%04d', p_partkey % 100, p_partkey*37 % 10000) ELSE printf('%dc', p_partkey % 400) END AS txt FROM part),
k AS (SELECT *, trim(regexp_replace(lower(trim(regexp_replace(txt, '\\s+', ' ', 'g'))), '^pantone ', '')) AS key FROM txt)""") + """
SELECT p_partkey, txt, coalesce(cat.hex, als.hex, '') AS hex FROM k LEFT JOIN cat USING (key) LEFT JOIN als ON als.alias = k.key""")
def catalog_lookup(spark, sf):
    catalog, alias, _ = cat.load_catalog(_raw(spark, sf))
    k = F.col("p_partkey")
    text = (
        F.when(k % 4 == 0, F.concat(F.lit(" pantone "), F.upper("p_name")))
        .when(k % 4 == 1, F.concat(F.regexp_replace("p_name", " ", ""), F.lit("u")))
        .when(k % 4 == 2, F.format_string("%02d-%04d", k % 100, k * 37 % 10000))
        .otherwise(F.format_string("%dc", k % 400))
    )
    texts = fixtures.table(spark, sf, "part").select("p_partkey", text.alias("txt"))
    out = cat.catalog_lookup(texts, "txt", catalog, alias)
    return out.select("p_partkey", "txt", F.coalesce("hex", F.lit("")).alias("hex"))


_D2 = duck.q("+".join(f"(c.{n}-e.{n})*(c.{n}-e.{n})" for n in LAB), 6)


@query("nearest_catalog", duck.with_(duck.PX, _RAWSQL,
       "dc0 AS (SELECT DISTINCT r, g, b, printf('#%02X%02X%02X', r, g, b) AS hex FROM px)", duck.lab_cte("dc", "dc0"),
       "en0 AS (SELECT hex, key, ord, CAST('0x'||hex[2:3] AS INT) AS r, CAST('0x'||hex[4:5] AS INT) AS g, CAST('0x'||hex[6:7] AS INT) AS b FROM byhex)",
       duck.lab_cte("en", "en0"), f"""
pr AS (SELECT c.r, c.g, c.b, arg_min(e.key, ({_D2} * 1000000, e.ord)) AS key, min({_D2}) AS d2 FROM dc c, en e WHERE c.hex NOT IN (SELECT hex FROM byhex) GROUP BY ALL)""") + """
SELECT * FROM pr UNION ALL SELECT c.r, c.g, c.b, byhex.key, 0::DOUBLE FROM dc c JOIN byhex USING (hex)""")
def nearest_catalog(spark, sf):
    _, _, by_hex = cat.load_catalog(_raw(spark, sf))
    return cat.nearest_catalog(fixtures.px(spark, sf), by_hex)


@query("search_catalog", duck.with_(_RAWSQL) + """
SELECT tier::INT AS tier, ord, display FROM (SELECT CASE WHEN starts_with(lower(display), 'red') OR starts_with(key, 'red') THEN 0
  WHEN contains(lower(display), 'red') OR contains(key || ' ' || replace(key, ' ', '') || ' ' || lower(display), 'red') THEN 1 END AS tier, ord, display FROM shown)
WHERE tier IS NOT NULL ORDER BY tier, ord LIMIT 24""")
def search_catalog(spark, sf):
    return cat.search_catalog(cat.load_catalog(_raw(spark, sf))[0], " Red ")


def _preset_docs(spark, sf):
    """A JSON preset per part, some short, mistyped, unnamed or repeated."""
    k, s = F.col("p_partkey"), F.col("p_size")
    name = F.when(k % 11 == 0, "Generic").when(k % 13 == 0, "  ").otherwise(F.col("p_name"))
    idx = F.slice(F.array(*[F.lit(i) for i in range(4)]), F.lit(1), (s % 4).cast("int") + 1)

    def band(i):
        rgb = F.array((k * 37 + i * 11) % 400 - 50, (s * 5 + i * 20) % 256, (k + i) % 256)
        rgb = F.when((k % 17 == 0) & (i == 1), F.slice(rgb, 1, 2)).otherwise(rgb)
        match = F.array((k * 3 + i) % 300, s + i, F.lit(7).cast("long"))
        return F.struct(
            F.concat(F.lit("b"), i).alias("name"),
            rgb.alias("rgb"),
            F.when(k % 2 == 0, F.when(k % 6 == 0, F.slice(match, 1, 2)).otherwise(match)).alias("match_rgb"),
        )

    bands = F.transform(idx, band)
    weights = F.transform(F.when(k % 5 < 3, idx).otherwise(F.slice(idx, 1, 1)), lambda i: (i + 1) / F.lit(10.0))
    doc = F.struct(
        F.when(k % 19 != 0, F.concat(F.lit("p"), k % 500)).alias("id"),
        name.alias("name"),
        F.when(k % 3 == 0, "lab_a_equal").when(k % 3 == 1, "bogus").alias("split_method"),
        F.when(k % 7 == 0, True).alias("palette_as_centers"),
        bands.alias("bands"),
        weights.alias("weights"),
    )
    return fixtures.table(spark, sf, "part").select(k.alias("ord"), F.to_json(doc).alias("json"))


_PRESETS = """WITH bd AS (SELECT p_partkey AS k, p_size AS s, p_name, unnest(range(0, (p_size % 4) + 1)) AS i FROM part),
pr AS (SELECT k, s, CASE WHEN k % 11 = 0 THEN 'Generic' WHEN k % 13 = 0 THEN '' ELSE p_name END AS name, (s % 4) + 1 AS nb,
  CASE WHEN k % 19 <> 0 THEN 'p' || (k % 500) ELSE replace(p_name, ' ', '-') END AS id FROM (SELECT DISTINCT k, s, p_name FROM bd)),
ok AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k) AS rk FROM pr WHERE name NOT IN ('Generic', '') AND nb >= 2 AND k % 17 <> 0)
SELECT ok.id, ok.name, CASE WHEN ok.k % 3 = 0 THEN 'lab_a_equal' ELSE 'color_closeness' END AS split_method, ok.k % 7 = 0 AS palette_as_centers,
 i::INT AS idx, 'b' || i AS band, least(255, greatest(0, (ok.k*37+i*11) % 400 - 50))::INT AS r, ((ok.s*5+i*20) % 256)::INT AS g, ((ok.k+i) % 256)::INT AS b,
 CASE WHEN ok.k % 2 = 0 AND ok.k % 6 <> 0 THEN least(255, (ok.k*3+i) % 300) ELSE -1 END::INT AS match_r,
 CASE WHEN ok.k % 5 < 3 THEN (i+1)/10::DOUBLE ELSE -1 END AS weight
FROM ok JOIN bd ON bd.k = ok.k WHERE rk = 1"""


def _preset_rows(p):
    rows = p.select("id", "name", "split_method", "palette_as_centers", "weights", F.posexplode("bands").alias("idx", "x"))
    return rows.select(
        "id", "name", "split_method", "palette_as_centers", "idx", F.col("x.name").alias("band"),
        *[F.col("x.rgb")[i].alias(c) for i, c in enumerate("rgb")],
        F.coalesce(F.col("x.match_rgb")[0], F.lit(-1)).alias("match_r"),
        F.coalesce(F.get("weights", F.col("idx")), F.lit(-1.0)).alias("weight"),
    )


@query("load_presets", _PRESETS)
def load_presets(spark, sf):
    return _preset_rows(ps.parse_presets(_preset_docs(spark, sf)))


@query("write_presets", _PRESETS)
def write_presets(spark, sf):
    presets = ps.parse_presets(_preset_docs(spark, sf)).withColumn("document", F.floor(F.col("ord") / 1000))
    return _preset_rows(ps.load_presets(spark, ps.write_presets(presets, scratch_path(spark, "preset_files"))))


def _named_presets(spark, sf):
    """Stored presets: one per part name, ids from the part key."""
    part = fixtures.table(spark, sf, "part")
    first = part.groupBy("p_name").agg(F.min("p_partkey").alias("ord"), F.max("p_size").alias("size"))
    return first.select("ord", F.concat(F.lit("Id-"), "ord").alias("id"), F.col("p_name").alias("name"), "size")


_NAMED = "named AS (SELECT min(p_partkey) AS ord, 'Id-' || min(p_partkey) AS id, p_name AS name, max(p_size) AS size FROM part GROUP BY p_name)"


# Incoming presets from suppliers: a third match by name, a third by id, the rest are new.
@query("upsert_presets", f"""WITH {_NAMED},
inc AS (SELECT s_suppkey AS k, s_suppkey % 3 AS m, named.ord, CASE WHEN s_suppkey % 3 = 1 THEN 'iD-' || ord ELSE 'new-' || s_suppkey END AS id,
   CASE WHEN s_suppkey % 3 = 0 THEN upper(name) ELSE 'Fresh ' || (s_suppkey // 6) END AS name, s_suppkey + 1000 AS size
  FROM supplier JOIN part ON s_suppkey = p_partkey JOIN named ON named.name = p_name),
hit AS (SELECT inc.*, named.ord AS o2, named.id AS id2 FROM inc JOIN named ON (m = 0 AND lower(named.name) = lower(inc.name)) OR (m = 1 AND lower(named.id) = lower(inc.id))),
rep AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o2 ORDER BY k DESC) AS rk FROM hit) WHERE rk = 1),
fresh AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY k DESC) AS rk, min(k) OVER (PARTITION BY name) AS k0 FROM inc WHERE m = 2) WHERE rk = 1)
SELECT id, name, size::INT AS size FROM named WHERE ord NOT IN (SELECT o2 FROM rep)
UNION ALL SELECT id2, name, size FROM rep UNION ALL SELECT 'new-' || k0, name, size FROM fresh""")
def upsert_presets(spark, sf):
    stored = _named_presets(spark, sf)
    k = F.col("k")
    m = k % 3
    named = fixtures.table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("name")).join(stored.select("name", "ord"), "name")
    src = fixtures.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k")).join(named, k == F.col("p_partkey"))
    inc = src.select(
        k.alias("ord"),
        F.when(m == 1, F.concat(F.lit("iD-"), "ord")).otherwise(F.concat(F.lit("new-"), k)).alias("id"),
        F.when(m == 0, F.upper("name")).otherwise(F.concat(F.lit("Fresh "), F.floor(k / 6))).alias("name"),
        (k + 1000).cast("int").alias("size"),
    )
    return ps.upsert_presets(stored, inc).select("id", "name", "size")


@query("delete_presets", f"""WITH {_NAMED}, ky AS (SELECT CASE s_suppkey % 3 WHEN 0 THEN 'ID-' || s_suppkey WHEN 1 THEN upper(p_name) ELSE 'nobody' || s_suppkey END AS key FROM supplier JOIN part ON s_suppkey = p_partkey)
SELECT 'kept' AS side, id, name FROM named WHERE lower(id) NOT IN (SELECT lower(key) FROM ky) AND lower(name) NOT IN (SELECT lower(key) FROM ky)
UNION ALL SELECT DISTINCT 'miss', key, '' FROM ky WHERE lower(key) NOT IN (SELECT lower(id) FROM named) AND lower(key) NOT IN (SELECT lower(name) FROM named)""")
def delete_presets(spark, sf):
    k = F.col("s_suppkey")
    part = fixtures.table(spark, sf, "part").select("p_partkey", "p_name")
    keys = fixtures.table(spark, sf, "supplier").join(part, k == F.col("p_partkey")).select(
        F.when(k % 3 == 0, F.concat(F.lit("ID-"), k)).when(k % 3 == 1, F.upper("p_name")).otherwise(F.concat(F.lit("nobody"), k)).alias("key")
    )
    kept, misses = ps.delete_presets(_named_presets(spark, sf), keys)
    return kept.select(F.lit("kept").alias("side"), "id", "name").unionByName(
        misses.select(F.lit("miss").alias("side"), F.col("key").alias("id"), F.lit("").alias("name"))
    )


_SEEDSQL = ", ".join(f"('{i}', '{n}', {len(b)})" for i, n, b in ps.SEEDS)


# Stored presets whose names or ids collide with seeds; two seeds were offered before.
@query("seed_presets", f"""WITH sd AS (SELECT * FROM (VALUES {_SEEDSQL}) t(id, name, n)),
st AS (SELECT CASE WHEN ord = 0 THEN 'ANALOGOUS-REDS' ELSE id END AS id, CASE WHEN ord = 1 THEN 'white gray BLACK' ELSE name END AS name FROM (
  SELECT min(p_partkey) AS ord, 'Id-' || min(p_partkey) AS id, p_name AS name FROM part GROUP BY p_name)),
offered AS (SELECT unnest(['V6-N', 'analogous-blues']) AS id)
SELECT 'preset' AS kind, id, name FROM st
UNION ALL SELECT 'preset', id, name FROM sd WHERE id NOT IN (SELECT id FROM offered) AND lower(id) NOT IN (SELECT lower(id) FROM st) AND lower(name) NOT IN (SELECT lower(name) FROM st)
UNION ALL SELECT 'offered', id, '' FROM (SELECT id FROM offered UNION SELECT id FROM sd)""")
def seed_presets(spark, sf):
    stored = _named_presets(spark, sf).select(
        F.when(F.col("ord") == 0, "ANALOGOUS-REDS").otherwise(F.col("id")).alias("id"),
        F.when(F.col("ord") == 1, "white gray BLACK").otherwise(F.col("name")).alias("name"),
    )
    offered = spark.createDataFrame([("V6-N",), ("analogous-blues",)], "id string")
    out, ids = ps.seed_presets(stored, offered)
    return out.select(F.lit("preset").alias("kind"), "id", "name").unionByName(
        ids.select(F.lit("offered").alias("kind"), "id", F.lit("").alias("name"))
    )


def _session_docs(spark, sf):
    """A session document per event; fields come and go with the event."""
    e = fixtures.table(spark, sf, "events")
    k = F.col("event_id")
    p = F.get_json_object("props", "$.k").cast("int")
    n = (k % 4).cast("int")
    idx = F.slice(F.array(*[F.lit(i) for i in range(4)]), F.lit(1), n)
    rows = F.transform(
        idx,
        lambda i: F.struct(
            F.when(k % 2 == 0, F.concat(F.lit("r"), i)).alias("name"),
            F.array(p * 3 + i, p - 10, i * 100).alias("match_rgb"),
            F.when(k % 3 != 0, F.array(p, p)).otherwise(F.array(p, p + i, F.lit(9))).alias("replacement_rgb"),
            F.when(k % 5 != 0, (i + 1) / F.lit(8.0)).alias("weight"),
            F.when(i == 1, False).alias("visible"),
        ),
    )
    layers = F.array(
        F.struct(F.lit("L1").alias("id"), F.when(k % 2 == 0, "widget").otherwise("label").alias("type"), (k % 7 - 3).alias("x"), (k % 90 / F.lit(10.0)).alias("scale"), F.lit(None).cast("string").alias("parent_id")),
        F.struct(F.lit("L2").alias("id"), F.lit("range").alias("type"), F.lit(None).cast("long").alias("x"), F.lit(None).cast("double").alias("scale"), F.lit("L1").alias("parent_id")),
    )
    doc = F.struct(
        F.lit(2).alias("version"),
        F.when(k % 3 == 0, "equal_pixels").when(k % 3 == 1, "").alias("split_method"),
        F.when(k % 5 == 0, 0).when(k % 5 == 1, p).alias("range_count"),
        F.when(k % 2 == 0, p / F.lit(100.0)).alias("min_coverage"),
        rows.alias("ranges"),
        F.when(k % 4 == 0, F.struct(F.lit(0.5).alias("strength"))).alias("texture"),
        F.struct((p / F.lit(200.0)).alias("darks"), F.when(k % 2 == 1, 0.25).alias("balance_cyan"), F.lit(0.5).alias("lights_cyan")).alias("tone"),
        F.when(k % 6 == 0, F.struct(p.alias("x"))).alias("crop"),
        layers.alias("layers"),
    )
    return e.select(k.alias("id"), F.to_json(doc).alias("json"))


_SESSIONS = """WITH e AS (SELECT event_id AS k, CAST(json_extract_string(props, '$.k') AS INT) AS p FROM events)
SELECT 'model' AS kind, k AS id, 0::INT AS idx, CASE WHEN k % 3 = 0 THEN 'equal_pixels' ELSE 'color_closeness' END AS s1, 'kmeans' AS s2,
  (CASE WHEN k % 5 = 1 AND p <> 0 THEN p WHEN k % 4 > 0 THEN k % 4 ELSE 4 END)::INT AS i1, (CASE WHEN k % 6 = 0 THEN p ELSE 0 END)::INT AS i2,
  least(0.4::DOUBLE, greatest(0::DOUBLE, CASE WHEN k % 2 = 0 THEN p/100::DOUBLE ELSE 0.03::DOUBLE END)) AS d1, p/200::DOUBLE AS d2,
  CASE WHEN k % 2 = 1 THEN 0.25::DOUBLE ELSE 0.5::DOUBLE END AS d3, CASE WHEN k % 4 = 0 THEN 0.5::DOUBLE ELSE 1::DOUBLE END AS d4, true AS b1 FROM e
UNION ALL SELECT 'range', k, i::INT, CASE WHEN k % 2 = 0 THEN 'r' || i ELSE '' END, '', least(255, p*3+i)::INT, greatest(0, p-10)::INT,
  CASE WHEN k % 5 <> 0 THEN (i+1)/8::DOUBLE ELSE 0::DOUBLE END, (CASE WHEN k % 3 <> 0 THEN 0 ELSE p END)::DOUBLE, (CASE WHEN k % 3 <> 0 THEN 0 ELSE p + i END)::DOUBLE, (CASE WHEN k % 3 <> 0 THEN 0 ELSE 9 END)::DOUBLE, i <> 1
  FROM (SELECT *, unnest(range(0, k % 4)) AS i FROM e)
UNION ALL SELECT 'layer', k, 0, CASE WHEN k % 2 = 0 THEN 'image' ELSE 'label' END, CASE WHEN k % 2 = 0 THEN 'Image' ELSE 'Label' END, (k % 7 - 3)::INT, -1, least(8::DOUBLE, greatest(0.05::DOUBLE, k % 90 / 10::DOUBLE)), 0::DOUBLE, 0::DOUBLE, 0::DOUBLE, true FROM e
UNION ALL SELECT 'layer', k, 1, 'range', 'Image', 0, -1, 1::DOUBLE, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE, true FROM e"""


def _session_rows(models, ranges, layers):
    zero = F.lit(0.0)
    m = models.select(F.lit("model").alias("kind"), "id", F.lit(0).alias("idx"), F.col("split_method").alias("s1"), F.col("assignment_mode").alias("s2"),
                      F.col("range_count").alias("i1"), F.col("crop_x").alias("i2"), F.col("min_coverage").alias("d1"), F.col("tone_darks").alias("d2"),
                      F.col("tone_balance_cyan").alias("d3"), F.col("texture_strength").alias("d4"), F.col("texture_enabled").alias("b1"))
    r = ranges.select(F.lit("range").alias("kind"), "id", "idx", F.col("name").alias("s1"), F.lit("").alias("s2"), F.col("match_r").alias("i1"), F.col("match_g").alias("i2"),
                      F.col("weight").alias("d1"), *[F.col(f"repl_{c}").cast("double").alias(d) for c, d in zip("rgb", ("d2", "d3", "d4"))], F.col("visible").alias("b1"))
    l = layers.select(F.lit("layer").alias("kind"), F.col("doc_id").alias("id"), F.col("ord").alias("idx"), F.col("kind").alias("s1"), F.col("name").alias("s2"), F.col("x").alias("i1"),
                      F.col("range_index").alias("i2"), F.col("scale").alias("d1"), zero.alias("d2"), zero.alias("d3"), zero.alias("d4"), F.col("visible").alias("b1"))
    return m.unionByName(r).unionByName(l)


@query("load_sessions", _SESSIONS)
def load_sessions(spark, sf):
    return _session_rows(*sessions.parse_sessions(_session_docs(spark, sf)))


@query("write_sessions", _SESSIONS)
def write_sessions(spark, sf):
    path = sessions.write_sessions(*sessions.parse_sessions(_session_docs(spark, sf)), scratch_path(spark, "session_files"))
    return _session_rows(*sessions.parse_sessions(spark.read.parquet(path)))


_STEM = "regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"


@query("palette_manifest", duck.with_(duck.PX, common.RANGES) + f"""
SELECT image_id, idx::INT AS idx, 3::INT AS range_count, name, printf('#%02X%02X%02X', repl_r, repl_g, repl_b) AS hex, repl_g AS g, {duck.q('lab_l')} AS low, weight, visible,
 printf('%02d_', idx) || {_STEM} || '_mask.png' AS mask FROM ranges""")
def palette_manifest(spark, sf):
    docs = sinks.palette_manifest(common.px_ranges(spark, sf))
    schema = "range_count int, layers array<struct<name string, hex string, rgb array<int>, luma_low double, weight double, visible boolean, mask string>>"
    rows = docs.select("image_id", F.from_json("manifest", schema).alias("d")).select("image_id", F.col("d.range_count").alias("range_count"), F.posexplode("d.layers").alias("idx", "x"))
    return rows.select("image_id", "idx", "range_count", "x.name", "x.hex", F.col("x.rgb")[1].alias("g"), C.q(F.col("x.luma_low")).alias("low"), "x.weight", "x.visible", "x.mask")


@query("write_plates", duck.with_(common.LABELLED, common.RANGES) + f"""
SELECT l.image_id, idx::INT AS idx, printf('%02d_', idx + 1) || {_STEM} AS stem, repl_r AS r, repl_g AS g, repl_b AS b, a, count(*)::BIGINT AS n
FROM labelled l JOIN ranges ON l.image_id = ranges.image_id AND label = idx WHERE visible GROUP BY ALL""")
def write_plates(spark, sf):
    ranges = common.px_ranges(spark, sf)
    master = paint.exact_fill(common.labelled_px(spark, sf), ranges)
    path = sinks.write_plates(master, ranges, scratch_path(spark, "plates"))
    return spark.read.parquet(path).groupBy("image_id", "idx", "stem", "r", "g", "b", "a").agg(F.count(F.lit(1)).alias("n"))


@query("write_job_pack", duck.with_(common.LABELLED, common.RANGES) + f"""
SELECT 'masks' AS part, image_id, count(*)::BIGINT AS n, sum(255)::BIGINT AS total FROM labelled WHERE a > 0 AND label >= 0 GROUP BY ALL
UNION ALL SELECT 'luma', image_id, count(*), sum({duck.tobyte(duck.luma())})::BIGINT FROM labelled GROUP BY ALL
UNION ALL SELECT 'exact', l.image_id, count(*), sum(CASE WHEN visible = false THEN 0 ELSE coalesce(repl_r, r) END)::BIGINT FROM labelled l LEFT JOIN ranges ON l.image_id = ranges.image_id AND label = idx GROUP BY ALL
UNION ALL SELECT 'manifest', image_id, 1, 3 FROM ranges GROUP BY ALL""")
def write_job_pack(spark, sf):
    out = sinks.write_job_pack(common.labelled_px(spark, sf), common.px_ranges(spark, sf), scratch_path(spark, "pack"), 0.8)
    read = spark.read.parquet

    def tally(part, col):
        return read(out[part]).groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), F.sum(col).cast("long").alias("total")).select(F.lit(part).alias("part"), "image_id", "n", "total")

    layers = F.size(F.from_json("manifest", "layers array<struct<id string>>")["layers"])
    return tally("masks", "v").unionByName(tally("luma", "v")).unionByName(tally("exact", "r")).unionByName(tally("manifest", layers))
