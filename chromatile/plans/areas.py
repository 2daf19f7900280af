"""Region, mask and fill queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from chromatile import fixtures
from chromatile.functions import color as C
from chromatile.operators import boxes as bx, fill, frame, regions
from chromatile.plans import duck
from chromatile.plans.registry import query
from chromatile.plans.spatial import SZ

GRID, GRAY = duck.GRID, duck.GRAY


def _v(spark, sf):
    return fixtures.gray(spark, sf).withColumn("v", F.col("v").cast("double"))


_PASSES = " UNION ALL ".join(
    [f"SELECT image_id, 'dark{d}' AS pass, y, x FROM lm WHERE v + {d} < mean AND v < 210 UNION ALL SELECT image_id, 'light{d}', y, x FROM lm WHERE v > mean + {d} AND v > 40" for d in (12, 16, 28)]
    + ["SELECT image_id, 'bright', y, x FROM lm JOIN md USING (image_id) WHERE v >= greatest(150, m + 36)"])


@query("contrast_mask", duck.with_(GRAY, SZ.format(s="gray"), "o AS (SELECT unnest(range(-18,19)) AS d)", """
rr AS (SELECT *, greatest(4, least(w,h) // 50) AS r FROM sz),
hx AS (SELECT p.image_id, p.y, p.x, any_value(p.h) AS h, any_value(p.r) AS r, sum(n.v) AS s FROM (SELECT g.image_id, y, x, h, r, least(w-1, greatest(0, x+d)) AS nx FROM gray g JOIN rr USING (image_id), o WHERE abs(d) <= r) p
  JOIN gray n ON n.image_id=p.image_id AND n.y=p.y AND n.x=nx GROUP BY p.image_id, p.y, p.x),
vx AS (SELECT p.image_id, p.y, p.x, sum(n.s)/((2*any_value(p.r)+1)*(2*any_value(p.r)+1))::DOUBLE AS mean FROM (SELECT image_id, y, x, r, least(h-1, greatest(0, y+d)) AS ny FROM hx, o WHERE abs(d) <= r) p
  JOIN hx n ON n.image_id=p.image_id AND n.x=p.x AND n.y=ny GROUP BY p.image_id, p.y, p.x),
lm AS (SELECT vx.*, v FROM vx JOIN gray USING (image_id, y, x)),
md AS (SELECT image_id, median(v) AS m FROM gray GROUP BY ALL)""") + _PASSES)
def contrast_mask(spark, sf):
    return regions.contrast_mask(_v(spark, sf))


@query("connected_boxes", duck.with_(GRAY, SZ.format(s="gray"), """
m AS (SELECT image_id, y, x, x - row_number() OVER (PARTITION BY image_id, y ORDER BY x) AS g FROM gray WHERE v >= 150),
rn AS (SELECT image_id, y, min(x) AS x0, max(x)+1 AS x1, y*100000+min(x) AS id FROM m GROUP BY image_id, y, g),
ed AS (SELECT a.image_id, a.id AS a, b.id AS b FROM rn a JOIN rn b ON a.image_id=b.image_id AND b.y=a.y+1 AND a.x0<b.x1 AND b.x0<a.x1),
sy AS (SELECT image_id, a, b FROM ed UNION ALL SELECT image_id, b, a FROM ed),
reach AS (SELECT image_id, id, id AS root FROM rn UNION SELECT r.image_id, sy.b, r.root FROM reach r JOIN sy ON sy.image_id=r.image_id AND sy.a=r.id WHERE r.root < sy.b),
lb AS (SELECT image_id, id, min(root) AS root FROM reach GROUP BY ALL),
rg AS (SELECT image_id, min(x0) AS x0, min(y) AS y0, max(x1) AS x1, max(y)+1 AS y1, sum(x1-x0) AS area FROM rn JOIN lb USING (image_id, id) GROUP BY image_id, root)""", recursive=True) + """
SELECT image_id, x0::INT AS x0, y0::INT AS y0, x1::INT AS x1, y1::INT AS y1, area::BIGINT AS area FROM rg JOIN sz USING (image_id)
WHERE area >= 3 AND area <= 4000 AND x1-x0 >= 2 AND y1-y0 >= 2 AND (x1-x0)/(y1-y0)::DOUBLE BETWEEN 0.12 AND 28 AND NOT (y1-y0 > floor(0.45*h) AND x1-x0 > floor(0.45*w))""")
def connected_boxes(spark, sf):
    gray = fixtures.gray(spark, sf)
    on = gray.filter("v >= 150").select("image_id", "y", "x")
    return regions.connected_boxes(on, frame.dims(gray), min_area=3, max_area=4000, min_side=2)


@query("merge_lines")
def merge_lines(spark, sf):
    b = fixtures.boxes(spark, sf)
    # Sheets of sixteen boxes, so lines form inside a sheet.
    return regions.merge_lines(b.withColumn("image_id", F.floor(F.col("box_id") / 16).cast("int")), 4)


@query("union_detections", duck.with_(duck.BOXES) + """
SELECT DISTINCT image_id, x0, y0, x1, y1 FROM (SELECT image_id, x0, y0, x1, y1 FROM boxes UNION ALL SELECT image_id, x0, y0, x1, y1 FROM boxes
 UNION ALL SELECT image_id, x0, y0, x1, y0 + 2 FROM boxes)""")
def union_detections(spark, sf):
    b = fixtures.boxes(spark, sf)
    cols = ["image_id", "x0", "y0", "x1", "y1"]
    thin = b.withColumn("y1", F.col("y0") + 2)
    return bx.union_detections(b.select(*cols), b.select(*cols), thin.select(*cols))


@query("detect_regions")
def detect_regions(spark, sf):
    return regions.detect_regions(fixtures.gray(spark, sf))


def marks(spark, sf):
    """Small boxes on the grid, one per supplier."""
    rows = fixtures.table(spark, sf, "embeddings").agg((F.max("vec_id") + 1).cast("int")).scalar()
    k = F.col("s_suppkey")
    s = fixtures.table(spark, sf, "supplier").select(k, (k * 5 % 16).cast("int").alias("x0"), ((k * 37 + 11) % (rows - 6)).cast("int").alias("y0"))
    return s.select(F.lit(0).alias("image_id"), k.alias("box_id"), "x0", "y0", (F.col("x0") + 4).alias("x1"), (F.col("y0") + 5).alias("y1"))


MARKS = """marks AS (SELECT 0::INT AS image_id, s_suppkey AS box_id, CAST(s_suppkey*5 % 16 AS INT) AS x0, CAST((s_suppkey*37+11) % ((SELECT max(vec_id)+1 FROM embeddings) - 6) AS INT) AS y0, 0 AS z FROM supplier)"""


@query("box_mask", duck.with_(GRID, MARKS, """
hit AS (SELECT DISTINCT g.image_id, g.y, g.x FROM grid g JOIN marks b ON b.image_id=g.image_id AND g.x >= greatest(0, b.x0-1) AND g.x < b.x0+5 AND g.y >= greatest(0, b.y0-1) AND g.y < b.y0+6)""") + """
SELECT g.image_id, g.y, g.x, hit.x IS NOT NULL AS mask FROM grid g LEFT JOIN hit ON hit.image_id=g.image_id AND hit.y=g.y AND hit.x=g.x""")
def box_mask(spark, sf):
    return bx.box_mask(fixtures.grid(spark, sf), marks(spark, sf), 1).select("image_id", "y", "x", "mask")


def mark_holes(spark, sf):
    """Pixels of the grid inside any mark."""
    on = bx.box_mask(fixtures.grid(spark, sf), marks(spark, sf), 0)
    return on.filter("mask").select("image_id", "y", "x")


_HOLES = "holes AS (SELECT DISTINCT g.image_id, g.y, g.x FROM grid g JOIN marks b ON g.x >= b.x0 AND g.x < b.x0+4 AND g.y >= b.y0 AND g.y < b.y0+5)"
_OFFS = "(VALUES (0,5,0),(1,-5,0),(2,10,0),(3,-10,0),(4,0,7),(5,0,-7),(6,5,7),(7,-5,7),(8,5,-7),(9,-5,-7)) k(ord,dx,dy)"


@query("period_fill", duck.with_(GRID, MARKS, _HOLES, f"""
kn AS (SELECT grid.* FROM grid ANTI JOIN holes USING (image_id, y, x)),
tr AS (SELECT t.image_id, t.y, t.x, ord, kn.r, kn.g, kn.b, kn.a FROM (SELECT image_id, y, x, ord, x+dx AS sx, y+dy AS sy FROM holes, {_OFFS}) t JOIN kn ON kn.image_id=t.image_id AND kn.x=sx AND kn.y=sy),
ft AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id, y, x ORDER BY ord) AS rk FROM tr) WHERE rk = 1)""") + """
SELECT 'filled' AS side, image_id, y, x, r, g, b, a FROM ft
UNION ALL SELECT 'left', holes.*, -1, -1, -1, -1 FROM holes ANTI JOIN ft USING (image_id, y, x)""")
def period_fill(spark, sf):
    g = fixtures.grid(spark, sf)
    periods = frame.dims(g).select("image_id", F.lit(5).alias("px"), F.lit(7).alias("py"))
    filled, left = fill.period_fill(g, mark_holes(spark, sf), periods)
    none = [F.lit(-1).alias(c) for c in "rgba"]
    return filled.select(F.lit("filled").alias("side"), "image_id", "y", "x", "r", "g", "b", "a").unionByName(
        left.select(F.lit("left").alias("side"), "image_id", "y", "x", *none)
    )


@query("polygon_mask", duck.with_(GRID, MARKS, SZ.format(s="grid"), """
pg AS (SELECT DISTINCT x0-2 AS a0, x0+4+2 AS a1, y0+d AS b0, y0+5+d AS b1 FROM marks, (VALUES (0),(2)) k(d)),
m0 AS (SELECT g.image_id, g.y, g.x, max(CASE WHEN pg.a0 IS NOT NULL THEN 1 ELSE 0 END) AS m FROM grid g LEFT JOIN pg ON g.x BETWEEN a0 AND a1 AND g.y BETWEEN b0 AND b1 GROUP BY ALL),
o AS (SELECT a.d AS dx, b.d AS dy FROM (SELECT unnest(range(-3,4)) AS d) a, (SELECT unnest(range(-1,2)) AS d) b),
m1 AS (SELECT p.image_id, p.y, p.x, max(n.m) AS m FROM (SELECT t.*, x+dx AS nx, y+dy AS ny FROM m0 t, o) p JOIN m0 n ON n.image_id=p.image_id AND n.x=nx AND n.y=ny GROUP BY ALL),
m2 AS (SELECT p.image_id, p.y, p.x, min(n.m) AS m FROM (SELECT t.*, x+dx AS nx, y+dy AS ny FROM m1 t, o) p JOIN m1 n ON n.image_id=p.image_id AND n.x=nx AND n.y=ny GROUP BY ALL)""") + """
SELECT p.image_id, p.y, p.x, max(n.m) = 1 AS mask FROM (SELECT t.*, x+dx AS nx, y+dy AS ny FROM m2 t, o WHERE abs(dx) <= 1) p JOIN m2 n ON n.image_id=p.image_id AND n.x=nx AND n.y=ny GROUP BY p.image_id, p.y, p.x""")
def polygon_mask(spark, sf):
    quads = fill.box_quads(marks(spark, sf)).select("image_id", "pts")
    return fill.polygon_mask(fixtures.grid(spark, sf), quads, fill.FLORAL)


@query("ink_mask", duck.with_(GRAY, SZ.format(s="gray"), """
bb AS (SELECT 0::INT AS image_id, s_suppkey AS box_id, CAST(s_suppkey*5 % 50 AS INT) AS x0, CAST((s_suppkey*37+11) % ((SELECT max(vec_id)+1 FROM embeddings) - 12) AS INT) AS y0 FROM supplier),
nr AS (SELECT g.image_id, box_id, y, x, v, x >= x0 AND x < x0+12 AND y >= y0 AND y < y0+9 AS inr FROM gray g JOIN bb USING (image_id) WHERE x >= x0-14 AND x < x0+26 AND y >= y0-14 AND y < y0+23),
md AS (SELECT image_id, box_id, median(v) AS med FROM nr WHERE NOT inr GROUP BY ALL),
ma AS (SELECT image_id, box_id, any_value(med) AS med, greatest(14::DOUBLE, 2.2::DOUBLE*(median(abs(v-med))+1)) AS dl FROM nr JOIN md USING (image_id, box_id) WHERE NOT inr GROUP BY ALL),
tg AS (SELECT nr.*, v < med-dl AS dk, v > med+dl+4 AS lt FROM nr JOIN ma USING (image_id, box_id) WHERE inr),
ct AS (SELECT image_id, box_id, count(*) FILTER (WHERE dk) AS nd, count(*) FILTER (WHERE lt) AS nl, count(*) FILTER (WHERE dk OR lt) AS nb, greatest(4, count(*) // 400) AS fl FROM tg GROUP BY ALL),
sd AS (SELECT *, CASE WHEN nd >= nl AND nd >= fl THEN 'd' WHEN nl >= fl THEN 'l' ELSE 'b' END AS side FROM ct)""") + """
SELECT image_id, box_id, y, x FROM tg JOIN sd USING (image_id, box_id)
WHERE CASE side WHEN 'd' THEN nd >= 3 AND dk WHEN 'l' THEN nl >= 3 AND lt ELSE nb >= 3 AND (dk OR lt) END""")
def ink_mask(spark, sf):
    rows = fixtures.table(spark, sf, "embeddings").agg((F.max("vec_id") + 1).cast("int")).scalar()
    k = F.col("s_suppkey")
    b = fixtures.table(spark, sf, "supplier").select(k, (k * 5 % 50).cast("int").alias("x0"), ((k * 37 + 11) % (rows - 12)).cast("int").alias("y0"))
    b = b.select(F.lit(0).alias("image_id"), k.alias("box_id"), "x0", "y0", (F.col("x0") + 12).alias("x1"), (F.col("y0") + 9).alias("y1"))
    return fill.ink_mask(fixtures.gray(spark, sf), b)


@query("frontier_fill")
def frontier_fill(spark, sf):
    return fill.frontier_fill(fixtures.grid(spark, sf), mark_holes(spark, sf))


@query("remove_regions")
def remove_regions(spark, sf):
    return fill.remove_regions(fixtures.grid(spark, sf), marks(spark, sf), "floral")
