"""Re-mapping queries on the grid raster."""

from __future__ import annotations

from pyspark.sql import functions as F

from chromatile import fixtures
from chromatile.operators import paint, raster
from chromatile.plans import duck
from chromatile.plans.registry import query
from chromatile.plans.spatial import SZ, _PERIOD
from chromatile.plans.statistics import sized_sql

GRID = duck.GRID
GS = "gs AS (SELECT * FROM grid JOIN sz USING (image_id))"
BASE = (GRID, SZ.format(s="grid"), GS)


# Zoom 1.5, shifted right and up.
@query("crop_zoom", duck.with_(*BASE, f"""
pl AS (SELECT *, {duck.rint('w*1.5::DOUBLE')}::INT AS nw, {duck.rint('h*1.5::DOUBLE')}::INT AS nh FROM gs),
p2 AS (SELECT *, {duck.rint('w*0.5::DOUBLE+4-nw*0.5::DOUBLE')}::INT AS lft, {duck.rint('h*0.5::DOUBLE-90-nh*0.5::DOUBLE')}::INT AS tp FROM pl),
d AS (SELECT image_id, y, x, w, h, x-lft AS ix, y-tp AS iy, nw, nh FROM p2)""") + """
SELECT d.image_id, d.y, d.x, coalesce(s.r,0)::INT AS r, coalesce(s.g,0)::INT AS g, coalesce(s.b,0)::INT AS b, coalesce(s.a,0)::INT AS a FROM d
LEFT JOIN grid s ON s.image_id = d.image_id AND ix >= 0 AND ix < nw AND iy >= 0 AND iy < nh AND s.x = floor((ix+0.5)*(w/nw::DOUBLE)) AND s.y = floor((iy+0.5)*(h/nh::DOUBLE))""")
def crop_zoom(spark, sf):
    return raster.crop_zoom(fixtures.grid(spark, sf), 4.0, -90.0, 1.5)


@query("crop_window", duck.with_(*BASE, f"""
c AS (SELECT *, {duck.rint('w/1.25::DOUBLE')}::INT AS cw, {duck.rint('h/1.25::DOUBLE')}::INT AS ch FROM gs),
o AS (SELECT *, greatest(0, least(3, w-cw)) AS ox, greatest(0, least(40, h-ch)) AS oy FROM c)""") + """
SELECT image_id, y-oy AS y, x-ox AS x, r, g, b, a FROM o WHERE x >= ox AND x < ox+cw AND y >= oy AND y < oy+ch""")
def crop_window(spark, sf):
    return raster.crop_window(fixtures.grid(spark, sf), 3.0, 40.0, 1.25)


_TRI = """greatest(0::DOUBLE, 1 - abs(({p}+0.5) - (i+0.5)*({n}/{m}::DOUBLE))/greatest(1::DOUBLE, {n}/{m}::DOUBLE))"""


# Nearest to 30 wide (aspect kept) and bilinear down to 12 x 200.
@query("resize", duck.with_(*BASE, f"""
t AS (SELECT *, 30 AS tw, greatest(1, {duck.rint('30/(w/h::DOUBLE)')})::INT AS th FROM sz),
dn AS (SELECT image_id, w, h, tw, th, x, unnest(range(0, th)) AS y FROM (SELECT *, unnest(range(0, tw)) AS x FROM t)),
nr AS (SELECT d.image_id, d.y::INT AS y, d.x::INT AS x, s.r, s.g, s.b, s.a FROM (SELECT *, floor((x+0.5)*(w/tw::DOUBLE)) AS qx, floor((y+0.5)*(h/th::DOUBLE)) AS qy FROM dn) d
  JOIN grid s ON s.image_id = d.image_id AND s.x = qx AND s.y = qy),
hx AS (SELECT image_id, y, i, h, {", ".join(f"floor({duck.q(f'sum(t*{c})/sum(t)', 9)}+0.5) AS {c}" for c in "rgba")} FROM (SELECT *, {_TRI.format(p='x', n='w', m='12')} AS t FROM gs, (SELECT unnest(range(0,12)) AS i)) WHERE t > 0 GROUP BY ALL),
vx AS (SELECT image_id, i AS y, x, {", ".join(f"floor({duck.q(f'sum(t*{c})/sum(t)', 9)}+0.5)::INT AS {c}" for c in "rgba")} FROM (SELECT image_id, y, x, j AS i, r, g, b, a, {_TRI.replace('(i+', '(j+').format(p='y', n='h', m='200')} AS t FROM (SELECT image_id, y, i AS x, h, r, g, b, a FROM hx) q, (SELECT unnest(range(0,200)) AS j)) WHERE t > 0 GROUP BY ALL)""") + """
SELECT 'nearest' AS how, * FROM nr UNION ALL SELECT 'bilinear', image_id, y::INT, x::INT, r, g, b, a FROM vx""")
def resize(spark, sf):
    g = fixtures.grid(spark, sf)
    near = raster.resize(g, width=30, how="nearest").withColumn("how", F.lit("nearest"))
    return near.unionByName(raster.resize(g, 12, 200, "bilinear").withColumn("how", F.lit("bilinear")))


@query("seam_offset", duck.with_(*BASE) + "SELECT image_id, ((y + h//2) % h)::INT AS y, ((x + w//2) % w)::INT AS x, r, g, b, a FROM gs")
def seam_offset(spark, sf):
    return raster.seam_offset(fixtures.grid(spark, sf))


@query("tile_repeat", duck.with_(*BASE) + "SELECT image_id, (y + h*(i // 3))::INT AS y, (x + w*(i % 3))::INT AS x, r, g, b, a FROM gs, (SELECT unnest(range(0,9)) AS i)")
def tile_repeat(spark, sf):
    return raster.tile_repeat(fixtures.grid(spark, sf), 3)


def hilbert_sql(src: str, keep: str, x: str, y: str, order: int, pre: str = "z") -> str:
    """CTE chain that walks the curve level by level; the last CTE is ``{pre}0`` with column d."""
    n = 1 << order
    out = [f"{pre}{order} AS (SELECT {keep}, least(greatest({x},0),{n-1})::BIGINT AS hx, least(greatest({y},0),{n-1})::BIGINT AS hy, 0::BIGINT AS d FROM {src})"]
    for k in range(order - 1, -1, -1):
        rx, ry = f"((hx >> {k}) & 1)", f"((hy >> {k}) & 1)"
        fx = f"CASE WHEN {rx}=1 THEN {n-1}-hx ELSE hx END"
        fy = f"CASE WHEN {rx}=1 THEN {n-1}-hy ELSE hy END"
        out.append(f"{pre}{k} AS (SELECT {keep}, CASE WHEN {ry}=0 THEN {fy} ELSE hx END AS hx, CASE WHEN {ry}=0 THEN {fx} ELSE hy END AS hy, d + {4**k}*xor(3*{rx}, {ry}) AS d FROM {pre}{k+1})")
    return ",\n".join(out)


@query("hilbert_index", duck.with_(GRID, hilbert_sql("grid", "image_id, y, x", "x", "y", 9)) + "SELECT image_id, y, x, d FROM z0")
def hilbert_index(spark, sf):
    return raster.hilbert_index(fixtures.grid(spark, sf).select("image_id", "y", "x"), 9)


def _front_sql(order: int) -> str:
    n = 1 << order
    return hilbert_sql("gs", "image_id, y, x, w, h", f"least(floor(x*{n}/w::DOUBLE), {n-1})", f"least(floor(y*{n}/h::DOUBLE), {n-1})", order) + f""",
fa AS (SELECT *, x/greatest(w-1,1)::DOUBLE AS u, d/{n*n-1}::DOUBLE AS t FROM z0),
fb AS (SELECT *, least(1::DOUBLE, greatest(0::DOUBLE, (0.45::DOUBLE-(u+(t-u)*(4::DOUBLE*u*(1::DOUBLE-u))))/0.45::DOUBLE)) AS al FROM fa)"""


# Left side, nearest rule: the front picks one of two neighbours, then the edges are pinned.  Order 11
# covers rasters up to 2048 on the long side, and a finer curve is what larger frames use.
def _blend_sql() -> str:
    parts = []
    for o in range(9, 13):
        n, lo = 1 << o, (1 << (o - 1))
        parts.append((o, n, lo))
    body = ",\n".join(
        hilbert_sql(f"(SELECT * FROM gs WHERE greatest(w,h) > {lo if o > 9 else 0} AND greatest(w,h) <= {n})", "image_id, y, x, w, h",
                    f"least(floor(x*{n}/w::DOUBLE), {n-1})", f"least(floor(y*{n}/h::DOUBLE), {n-1})", o, f"z{o}_") for o, n, lo in parts)
    union = " UNION ALL ".join(f"SELECT *, d/{n*n-1}::DOUBLE AS t FROM z{o}_0" for o, n, lo in parts)
    px = ", ".join(f"CASE WHEN al*al >= 0.5 THEN o.{c} ELSE s.{c} END AS {c}" for c in "rgba")
    pin = ", ".join(f"CASE WHEN x IN (0, w-1) THEN {duck.rint(f'(max(CASE WHEN x=0 THEN {c} END) OVER (PARTITION BY image_id, y) + max(CASE WHEN x=w-1 THEN {c} END) OVER (PARTITION BY image_id, y))*0.5::DOUBLE')}::INT ELSE {c} END AS {c}" for c in "rgba")
    return duck.with_(*BASE, body, f"""
fu AS ({union}),
fa AS (SELECT *, x/greatest(w-1,1)::DOUBLE AS u FROM fu),
fb AS (SELECT *, least(1::DOUBLE, greatest(0::DOUBLE, (0.45::DOUBLE-(u+(t-u)*(4::DOUBLE*u*(1::DOUBLE-u))))/0.45::DOUBLE)) AS al FROM fa),
bl AS (SELECT f.image_id, f.y, f.x, w, {px} FROM fb f JOIN grid s ON s.image_id=f.image_id AND s.x=f.x AND s.y=f.y
  JOIN (SELECT image_id, y, (x+1) % w AS x, r, g, b, a FROM gs) o ON o.image_id=f.image_id AND o.x=f.x AND o.y=f.y)""") + f"SELECT image_id, y, x, {pin} FROM bl"


@query("crinkly_blend", _blend_sql())
def crinkly_blend(spark, sf):
    return raster.crinkly_blend(fixtures.grid(spark, sf), "left", None, nearest=True)


@query("pin_edges", duck.with_(*BASE, f"""
p1 AS (SELECT image_id, y, x, w, h, {", ".join(f"CASE WHEN x IN (0,w-1) THEN {duck.rint(f'(max(CASE WHEN x=0 THEN {c} END) OVER (PARTITION BY image_id, y) + max(CASE WHEN x=w-1 THEN {c} END) OVER (PARTITION BY image_id, y))*0.5::DOUBLE')} ELSE {c} END AS {c}" for c in "rgba")} FROM gs),
p2 AS (SELECT image_id, y, x, w, h, {", ".join(f"CASE WHEN y IN (0,h-1) THEN {duck.rint(f'(max(CASE WHEN y=0 THEN {c} END) OVER (PARTITION BY image_id, x) + max(CASE WHEN y=h-1 THEN {c} END) OVER (PARTITION BY image_id, x))*0.5::DOUBLE')} ELSE {c} END AS {c}" for c in "rgba")} FROM p1),
cm AS (SELECT image_id, {", ".join(f"{duck.rint(f'avg({c})')} AS m{c}" for c in "rgba")} FROM p2 WHERE x IN (0,w-1) AND y IN (0,h-1) GROUP BY ALL)""") + f"""
SELECT p2.image_id, y, x, {", ".join(f"(CASE WHEN x IN (0,w-1) AND y IN (0,h-1) THEN m{c} ELSE {c} END)::INT AS {c}" for c in "rgba")} FROM p2 JOIN cm USING (image_id)""")
def pin_edges(spark, sf):
    return raster.pin_edges(fixtures.grid(spark, sf))


# Vertical only, nearest: stretch or copy the whole-repeat core, then pin top and bottom.
@query("tile_from_motif", duck.with_(*BASE, "pp AS (SELECT image_id, x, y, r, g, b FROM grid)", sized_sql("pp", "r, g, b"), _PERIOD, f"""
pd AS (SELECT image_id, (CASE WHEN k >= n//2 THEN nf ELSE greatest(4, least(nf, {duck.rint('k*nf/n::DOUBLE')})) END)::INT AS p FROM kk),
co AS (SELECT sz.*, CASE WHEN p >= h THEN h ELSE (h // p) * p END AS ch FROM sz JOIN pd USING (image_id)),
ds AS (SELECT gs.image_id, gs.y, gs.x, gs.w, gs.h, (CASE WHEN gs.h - ch <= 2 THEN CASE WHEN gs.y >= ch THEN gs.y % ch ELSE gs.y END ELSE floor((gs.y+0.5)*(ch/gs.h::DOUBLE)) END)::INT AS sy FROM gs JOIN co USING (image_id)),
gt AS (SELECT ds.image_id, ds.y, ds.x, ds.h, s.r, s.g, s.b, s.a FROM ds JOIN grid s ON s.image_id=ds.image_id AND s.x=ds.x AND s.y=ds.sy)""") + f"""
SELECT image_id, y, x, {", ".join(f"(CASE WHEN y IN (0,h-1) THEN {duck.rint(f'(max(CASE WHEN y=0 THEN {c} END) OVER (PARTITION BY image_id, x) + max(CASE WHEN y=h-1 THEN {c} END) OVER (PARTITION BY image_id, x))*0.5::DOUBLE')} ELSE {c} END)::INT AS {c}" for c in "rgba")} FROM gt""")
def tile_from_motif(spark, sf):
    return raster.tile_from_motif(fixtures.grid(spark, sf), None, "top", nearest=True)


_US = "((1-0.6::DOUBLE)*u + 0.6::DOUBLE*pow(u, 1.9::DOUBLE) + 0.12::DOUBLE*0.6::DOUBLE*sin(6.283185307179586::DOUBLE*v))*w"
_VS = "((1-0.6::DOUBLE)*v + 0.6::DOUBLE*(1-pow(1-v, 1.9::DOUBLE)) + 0.12::DOUBLE*0.6::DOUBLE*sin(6.283185307179586::DOUBLE*u))*h"
_MAP = f"mp AS (SELECT *, {_US} AS mx, {_VS} AS my FROM (SELECT *, x/greatest(w-1,1)::DOUBLE AS u, y/greatest(h-1,1)::DOUBLE AS v FROM gs))"
_WR = lambda e, n: f"((({e}) % {n} + {n}) % {n})"


@query("mesh_warp", duck.with_(*BASE, _MAP, f"""
nn AS (SELECT image_id, y, x, {_WR(duck.rint('mx'), 'w')}::INT AS sx, {_WR(duck.rint('my'), 'h')}::INT AS sy FROM mp),
b0 AS (SELECT image_id, y, x, w, h, {_WR('mx', 'w')} AS px, {_WR('my', 'h')} AS py FROM mp),
b1 AS (SELECT *, px-floor(px) AS wx, py-floor(py) AS wy, floor(px)::INT AS x0, floor(py)::INT AS y0 FROM b0),
b2 AS (SELECT image_id, y, x, (x0+dx) % w AS sx, (y0+dy) % h AS sy, (CASE WHEN dx=1 THEN wx ELSE 1-wx END)*(CASE WHEN dy=1 THEN wy ELSE 1-wy END) AS t FROM b1, (VALUES (0,0),(1,0),(0,1),(1,1)) k(dx,dy)),
b3 AS (SELECT b2.image_id, b2.y, b2.x, {", ".join(f"{duck.tobyte(duck.q(f'sum(t*s.{c})', 9))} AS {c}" for c in "rgba")} FROM b2 JOIN grid s ON s.image_id=b2.image_id AND s.x=sx AND s.y=sy GROUP BY ALL)""") + """
SELECT 'nearest' AS how, nn.image_id, nn.y, nn.x, s.r, s.g, s.b, s.a FROM nn JOIN grid s ON s.image_id=nn.image_id AND s.x=sx AND s.y=sy
UNION ALL SELECT 'bilinear', * FROM b3""")
def mesh_warp(spark, sf):
    g = fixtures.grid(spark, sf)
    near = raster.mesh_warp(g, "left", "bottom", 0.6, nearest=True).withColumn("how", F.lit("nearest"))
    return near.unionByName(raster.mesh_warp(g, "left", "bottom", 0.6).withColumn("how", F.lit("bilinear")))


@query("checker_flatten", duck.with_(*BASE, "ga AS (SELECT image_id, y, x, r, g, b, ((x*31 + y*17) % 256)::INT AS a FROM gs)") + f"""
SELECT image_id, y, x, {", ".join(f"floor(({c}*a + (CASE WHEN ((x//8)+(y//8)) % 2 = 1 THEN 204 ELSE 255 END)*(255-a))/255::DOUBLE + 0.5)::INT AS {c}" for c in "rgb")}, 255::INT AS a FROM ga""")
def checker_flatten(spark, sf):
    g = fixtures.grid(spark, sf).withColumn("a", ((F.col("x") * 31 + F.col("y") * 17) % 256).cast("int"))
    return paint.checker_flatten(g)
