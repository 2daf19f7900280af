"""Stencil, seam and search queries on the raster fixtures."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from chromatile import fixtures
from chromatile.functions import color as C
from chromatile.operators import seams, stencil
from chromatile.plans import duck
from chromatile.plans.registry import query
from chromatile.plans.statistics import sized_sql

GRID, GRAY = duck.GRID, duck.GRAY
SZ = "sz AS (SELECT image_id, (max(x)+1)::INT AS w, (max(y)+1)::INT AS h FROM {s} GROUP BY ALL)"


@query("box_mean", duck.with_(GRAY, SZ.format(s="gray"), "o AS (SELECT unnest(range(-4,5)) AS d)") + f"""
SELECT p.image_id, p.y, p.x, {duck.q('sum(n.v)/81::DOUBLE')} AS mean FROM (SELECT g.image_id, y, x, least(w-1, greatest(0, x+dx.d)) AS nx, least(h-1, greatest(0, y+dy.d)) AS ny FROM gray g JOIN sz USING (image_id), o dx, o dy) p
JOIN gray n ON n.image_id = p.image_id AND n.x = nx AND n.y = ny GROUP BY ALL""")
def box_mean(spark, sf):
    out = stencil.box_mean(fixtures.gray(spark, sf), 4)
    return out.select("image_id", "y", "x", C.q(F.col("mean")).alias("mean"))


_K = "(VALUES (-1,-1,-1,-1),(0,-1,0,-2),(1,-1,1,-1),(-1,0,-2,0),(1,0,2,0),(-1,1,-1,1),(0,1,0,2),(1,1,1,1)) k(dx,dy,gx,gy)"


@query("sobel", duck.with_(GRAY, SZ.format(s="gray")) + f"""
SELECT p.image_id, p.y, p.x, {duck.q('sqrt(sum(n.v*gx)*sum(n.v*gx)+sum(n.v*gy)*sum(n.v*gy))')} AS mag FROM (SELECT g.image_id, y, x, gx, gy, least(w-1, greatest(0, x+dx)) AS nx, least(h-1, greatest(0, y+dy)) AS ny FROM gray g JOIN sz USING (image_id), {_K}) p
JOIN gray n ON n.image_id = p.image_id AND n.x = nx AND n.y = ny GROUP BY p.image_id, p.y, p.x""")
def sobel(spark, sf):
    return stencil.sobel(fixtures.gray(spark, sf)).select("image_id", "y", "x", C.q(F.col("mag")).alias("mag"))


def gray_mask(spark, sf, level: int = 150):
    return fixtures.gray(spark, sf).select("image_id", "y", "x", (F.col("v") >= level).alias("mask"))


_OFF = "o AS (SELECT a.d AS dx, b.d AS dy FROM (SELECT unnest(range(-1,3)) AS d) a, (SELECT unnest(range(-1,2)) AS d) b)"


# A 4 x 3 close, then an 8-connected dilate.
@query("morphology", duck.with_(GRAY, "m0 AS (SELECT image_id, y, x, (v >= 160)::INT AS m FROM gray)", _OFF,
       "m1 AS (SELECT p.image_id, p.y, p.x, max(n.m) AS m FROM (SELECT t.*, dx, x+dx AS nx, y+dy AS ny FROM m0 t, o) p JOIN m0 n ON n.image_id=p.image_id AND n.x=nx AND n.y=ny GROUP BY ALL)",
       "m2 AS (SELECT p.image_id, p.y, p.x, min(n.m) AS m FROM (SELECT t.*, dx, x+dx AS nx, y+dy AS ny FROM m1 t, o) p JOIN m1 n ON n.image_id=p.image_id AND n.x=nx AND n.y=ny GROUP BY ALL)") + """
SELECT p.image_id, p.y, p.x, max(n.m) = 1 AS mask FROM (SELECT t.*, dx, x+dx AS nx, y+dy AS ny FROM m2 t, o) p JOIN m2 n ON n.image_id=p.image_id AND n.x=nx AND n.y=ny WHERE dx < 2 GROUP BY p.image_id, p.y, p.x""")
def morphology(spark, sf):
    closed = stencil.morphology(gray_mask(spark, sf, 160), "close", 4, 3)
    return stencil.morphology(closed, "dilate", 3, 3)


@query("mask_runs", duck.with_(GRAY, "m AS (SELECT image_id, y, x, x - row_number() OVER (PARTITION BY image_id, y ORDER BY x) AS g FROM gray WHERE v >= 150)") + """
SELECT image_id, y, min(x)::INT AS x0, (max(x)+1)::INT AS x1 FROM m GROUP BY image_id, y, g""")
def mask_runs(spark, sf):
    return stencil.mask_runs(gray_mask(spark, sf))


@query("edge_ramp", duck.with_(GRAY, SZ.format(s="gray"), """
e AS (SELECT image_id, avg(CASE WHEN y = 0 THEN v END) AS lo, avg(CASE WHEN y = h-1 THEN v END) AS hi FROM gray JOIN sz USING (image_id) GROUP BY ALL)""") + f"""
SELECT image_id, y, x, {duck.q('v + 0.35::DOUBLE*((1-y/(h-1)::DOUBLE)*((lo+hi)/2-lo) + y/(h-1)::DOUBLE*((lo+hi)/2-hi))')} AS v FROM gray JOIN sz USING (image_id) JOIN e USING (image_id)""")
def edge_ramp(spark, sf):
    g = fixtures.gray(spark, sf).withColumn("v", F.col("v").cast("double"))
    return stencil.edge_ramp(g, "y", 0.35).select("image_id", "y", "x", C.q(F.col("v")).alias("v"))


def strip_cost_sql(name: str, src: str, keys: str) -> str:
    """Cost CTE over matched strips ``src(keys, i, j, side, r, g, b)``."""
    d = ", ".join(f"max(CASE WHEN side=0 THEN {c} END)-max(CASE WHEN side=1 THEN {c} END) AS d{c}" for c in "rgb")
    raw = "(avg(dr*dr)+avg(dg*dg)+avg(db*db))/3"
    return f"""{name}_d AS (SELECT {keys}, i, j, {d} FROM {src} GROUP BY {keys}, i, j),
{name} AS (SELECT {keys}, {raw} - (avg(dr)*avg(dr)+avg(dg)*avg(dg)+avg(db)*avg(db))/3 + 0.15::DOUBLE*({raw}) AS cost FROM {name}_d GROUP BY {keys})"""


_BW = "greatest(1, least(8, greatest(1, w // 4)))"
_BH = "greatest(1, least(8, greatest(1, h // 4)))"


def _strips(src: str, keys: str) -> str:
    return f"""sp AS (SELECT {keys}, 0 AS ax, x AS i, y AS j, 0 AS side, r, g, b FROM {src} WHERE x < {_BW}
 UNION ALL SELECT {keys}, 0, x-(w-{_BW}), y, 1, r, g, b FROM {src} WHERE x >= w-{_BW}
 UNION ALL SELECT {keys}, 1, y, x, 0, r, g, b FROM {src} WHERE y < {_BH}
 UNION ALL SELECT {keys}, 1, y-(h-{_BH}), x, 1, r, g, b FROM {src} WHERE y >= h-{_BH}),
{strip_cost_sql('sc', 'sp', keys + ', ax')},
co AS (SELECT {keys}, (var_pop(r)+var_pop(g)+var_pop(b))/3 AS cost FROM {src} WHERE x IN (0, w-1) AND y IN (0, h-1) GROUP BY {keys}),
ec AS (SELECT {keys}, sum(cost)/3 AS cost FROM (SELECT {keys}, cost FROM sc UNION ALL SELECT {keys}, cost FROM co) GROUP BY {keys})"""


@query("seam_mismatch", duck.with_(GRID, SZ.format(s="grid"), "gs AS (SELECT * FROM grid JOIN sz USING (image_id))", _strips("gs", "image_id")) + f"""
SELECT image_id, {duck.q('cost')} AS cost FROM ec""")
def seam_mismatch(spark, sf):
    return seams.seam_mismatch(fixtures.grid(spark, sf)).select("image_id", C.q(F.col("cost")).alias("cost"))


_PERIOD = """pf AS (SELECT image_id, y AS pos, avg({l}) AS m, max(h) AS n, max(full_h) AS nf FROM probe GROUP BY image_id, y),
wk AS (SELECT image_id, pos, n, nf, m - avg(m) OVER (PARTITION BY image_id) AS wv FROM pf),
e0 AS (SELECT image_id, sum(wv*wv) AS e FROM wk GROUP BY ALL),
ac AS (SELECT a.image_id, b.pos - a.pos AS lag, max(a.n) AS n, max(a.nf) AS nf, {ac} AS ac FROM wk a JOIN wk b ON a.image_id = b.image_id AND b.pos >= a.pos
  JOIN e0 ON e0.image_id = a.image_id GROUP BY a.image_id, b.pos - a.pos),
rg AS (SELECT *, max(CASE WHEN lag >= 4 AND lag < n//2 THEN ac END) OVER (PARTITION BY image_id) AS pk, lag(ac) OVER (PARTITION BY image_id ORDER BY lag) AS p1, lead(ac) OVER (PARTITION BY image_id ORDER BY lag) AS n1 FROM ac),
th AS (SELECT *, greatest(0.18::DOUBLE, 0.45::DOUBLE*pk) AS t FROM rg),
ch AS (SELECT image_id, max(n) AS n, max(nf) AS nf, max(pk) AS pk, max(t) AS t, coalesce(min(CASE WHEN lag >= 5 AND lag < n//2-1 AND ac >= p1 AND ac >= n1 AND ac >= t THEN lag END),
   min(CASE WHEN lag >= 4 AND lag < n//2 AND ac = pk THEN lag END)) AS c FROM th GROUP BY ALL),
hf AS (SELECT ch.*, th.ac AS hac FROM ch LEFT JOIN th ON th.image_id = ch.image_id AND th.lag = c // 2),
kk AS (SELECT image_id, n, nf, CASE WHEN pk < 0.18 THEN n WHEN c//2 >= 4 AND hac >= t*0.85 THEN c//2 ELSE c END AS k FROM hf)""".format(
    l=duck.luma(), ac=duck.q("sum(a.wv*b.wv)/(max(e)+1e-12)", 9))


@query("axis_period", duck.with_(GRID, sized_sql("grid", "r, g, b"), _PERIOD) + f"""
SELECT image_id, (CASE WHEN k >= n//2 THEN nf ELSE greatest(4, least(nf, {duck.rint('k*nf/n::DOUBLE')})) END)::INT AS period FROM kk""")
def axis_period(spark, sf):
    return seams.axis_period(fixtures.grid(spark, sf), "y")


_WIN = "greatest(1, least({n}, " + duck.rint("{n}/z") + "))::INT"
_CROP = f"""szp AS (SELECT image_id, max(w) AS pw, max(h) AS ph, max(full_w) AS fw, max(full_h) AS fh FROM probe GROUP BY ALL),
zz AS (SELECT *, {_WIN.format(n='pw')} AS cw, {_WIN.format(n='ph')} AS ch FROM szp, (VALUES (0,1.0::DOUBLE),(1,1.08::DOUBLE),(2,1.16::DOUBLE),(3,1.25::DOUBLE)) v(zi,z)),
nn AS (SELECT *, CASE WHEN pw-cw <= 0 THEN 1 ELSE least(7, pw-cw+1) END AS nx, CASE WHEN ph-ch <= 0 THEN 1 ELSE least(7, ph-ch+1) END AS ny FROM zz),
cd AS (SELECT image_id, (zi::BIGINT*2097152+yi)*2097152+xi AS ord, z, fw, fh, pw, ph, {duck.rint('xi*((pw-cw)/greatest(nx-1,1)::DOUBLE)')}::INT AS x0, {duck.rint('yi*((ph-ch)/greatest(ny-1,1)::DOUBLE)')}::INT AS y0, cw, ch
  FROM nn, (SELECT unnest(range(0,7)) AS xi) a, (SELECT unnest(range(0,7)) AS yi) b WHERE xi < nx AND yi < ny),
ww AS (SELECT p.image_id, ord, p.x-x0 AS x, p.y-y0 AS y, r, g, b, cw AS w, ch AS h FROM probe p JOIN cd USING (image_id) WHERE p.x >= x0 AND p.x < x0+cw AND p.y >= y0 AND p.y < y0+ch)"""


@query("best_wrap_crop", duck.with_(GRID, sized_sql("grid", "r, g, b"), _CROP, _strips("ww", "image_id, ord"), f"""
tc AS (SELECT cd.*, {duck.q('cost + 0.02::DOUBLE*(z-1)*255::DOUBLE*255::DOUBLE', 6)} AS tot FROM cd JOIN ec USING (image_id, ord) WHERE cw >= 2 AND ch >= 2),
bb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY tot, ord) AS rk FROM tc) WHERE rk = 1)""") + f"""
SELECT image_id, greatest(0, least({duck.rint('x0/pw::DOUBLE*fw')}, fw - {_WIN.format(n='fw')}))::INT AS x,
 greatest(0, least({duck.rint('y0/ph::DOUBLE*fh')}, fh - {_WIN.format(n='fh')}))::INT AS y, z AS zoom, {duck.q('tot')} AS cost FROM bb""")
def best_wrap_crop(spark, sf):
    out = seams.best_wrap_crop(fixtures.grid(spark, sf))
    return out.select("image_id", "x", "y", "zoom", C.q(F.col("cost")).alias("cost"))


def _period_sql(axis: str) -> str:
    """The CTEs of the period along one axis, all names with the axis in front, and ``{axis}per(image_id, p)``."""
    size = "w" if axis == "x" else "h"
    text = _PERIOD.replace("y AS pos", f"{axis} AS pos").replace("max(h) AS n, max(full_h)", f"max({size}) AS n, max(full_{size})").replace("GROUP BY image_id, y)", f"GROUP BY image_id, {axis})")
    text = re.sub(r"\b(pf|wk|e0|ac|rg|th|ch|hf|kk)( AS \(|\.)", rf"{axis}\1\2", text)
    text = re.sub(r"\b(JOIN|FROM) (pf|wk|e0|ac|rg|th|ch|hf|kk)\b", rf"\1 {axis}\2", text)
    return text + f""",
{axis}per AS (SELECT image_id, (CASE WHEN k >= n//2 THEN nf ELSE greatest(4, least(nf, {duck.rint('k*nf/n::DOUBLE')})) END)::INT AS p FROM {axis}kk)"""


def _repeats(n: str, p: str) -> str:
    return f"CASE WHEN {p} >= 4 THEN list_filter(list_transform(range(1, greatest(1, {n}//{p})+1), lambda c: {n}::DOUBLE/greatest(1, c*{p})), lambda z: z >= 1 AND z <= 8) ELSE [] END"


def _steps(n: str, c: str, p: str) -> str:
    return f"list_sort(list_distinct(list_append(range(0, {n}-{c}+1, {p}), {n}-{c})))"


def _left(c: str, p: str) -> str:
    return f"CASE WHEN {p} >= 2 AND {c} % {p} <> 0 THEN least({c} % {p}, {p} - {c} % {p}) ELSE 0 END"


_REPEAT = f"""szp AS (SELECT image_id, max(w) AS pw, max(h) AS ph, max(full_w) AS fw, max(full_h) AS fh, any_value(xper.p) AS px, any_value(yper.p) AS py FROM probe JOIN xper USING (image_id) JOIN yper USING (image_id) GROUP BY image_id),
zl AS (SELECT *, unnest(list_sort(list_concat(list_concat([1.0::DOUBLE, 1.08::DOUBLE, 1.16::DOUBLE, 1.25::DOUBLE], {_repeats('pw', 'px')}), {_repeats('ph', 'py')}))) AS z FROM szp),
zf AS (SELECT *, lag(z) OVER (PARTITION BY image_id ORDER BY z) AS before FROM zl),
zz AS (SELECT * EXCLUDE (before), row_number() OVER (PARTITION BY image_id ORDER BY z) - 1 AS zi, {_WIN.format(n='pw')} AS cw, {_WIN.format(n='ph')} AS ch FROM zf
  WHERE before IS NULL OR {duck.rint('z*10000')} <> {duck.rint('before*10000')}),
xx AS (SELECT *, unnest({_steps('pw', 'cw', 'px')})::INT AS x0, generate_subscripts({_steps('pw', 'cw', 'px')}, 1) - 1 AS xi FROM zz),
cd AS (SELECT *, unnest({_steps('ph', 'ch', 'py')})::INT AS y0, generate_subscripts({_steps('ph', 'ch', 'py')}, 1) - 1 AS yi FROM xx),
ce AS (SELECT *, (zi::BIGINT*2097152+yi)*2097152+xi AS ord FROM cd WHERE cw >= 2 AND ch >= 2),
ww AS (SELECT p.image_id, ord, p.x-x0 AS x, p.y-y0 AS y, r, g, b, cw AS w, ch AS h FROM probe p JOIN ce USING (image_id) WHERE p.x >= x0 AND p.x < x0+cw AND p.y >= y0 AND p.y < y0+ch)"""


@query("best_repeat_crop", duck.with_(GRID, sized_sql("grid", "r, g, b"), _period_sql("x"), _period_sql("y"), _REPEAT, _strips("ww", "image_id, ord"), f"""
tc AS (SELECT ce.*, {duck.q(f"cost + ({_left('cw', 'px')} + {_left('ch', 'py')})*80::DOUBLE + 0.02::DOUBLE*(z-1)*255::DOUBLE*255::DOUBLE", 6)} AS tot FROM ce JOIN ec USING (image_id, ord)),
bb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY tot, ord) AS rk FROM tc) WHERE rk = 1)""") + f"""
SELECT image_id, greatest(0, least({duck.rint('x0/pw::DOUBLE*fw')}, fw - {_WIN.format(n='fw')}))::INT AS x,
 greatest(0, least({duck.rint('y0/ph::DOUBLE*fh')}, fh - {_WIN.format(n='fh')}))::INT AS y, z AS zoom, {duck.q('tot')} AS cost FROM bb""")
def best_repeat_crop(spark, sf):
    out = seams.best_repeat_crop(fixtures.grid(spark, sf))
    return out.select("image_id", "x", "y", "zoom", C.q(F.col("cost")).alias("cost"))


@query("plan_crop")
def plan_crop(spark, sf):
    grid = fixtures.grid(spark, sf)
    plans = [seams.plan_crop(grid, "left", "top", tile).withColumn("mode", F.lit("tile" if tile else "wrap")) for tile in (True, False)]
    return plans[0].unionByName(plans[1])


def _shift_rows(src: str, n: str, cand: str) -> str:
    b = f"greatest(1, least(8, greatest(1, {n} // 4)))"
    return f"""SELECT p.image_id, ord, s, ((p.y + s) % {n} + {n}) % {n} AS i, p.x AS j, 0 AS side, r, g, b FROM {src} p JOIN {cand} USING (image_id) WHERE ((p.y + s) % {n} + {n}) % {n} < {b}
 UNION ALL SELECT p.image_id, ord, s, ((p.y + s) % {n} + {n}) % {n} - ({n}-{b}), p.x, 1, r, g, b FROM {src} p JOIN {cand} USING (image_id) WHERE ((p.y + s) % {n} + {n}) % {n} >= {n}-{b}"""


@query("best_shift", duck.with_(GRID, sized_sql("grid", "r, g, b"), f"""
sp0 AS (SELECT image_id, max(full_h) AS fn FROM probe GROUP BY ALL),
c1 AS (SELECT image_id, fn, s::INT AS s, 2*abs(s) + CASE WHEN s < 0 THEN 1 ELSE 0 END AS ord FROM (SELECT *, unnest(range(-greatest(1, {duck.rint('fn*0.12::DOUBLE')}::BIGINT), greatest(1, {duck.rint('fn*0.12::DOUBLE')}::BIGINT) + 1)) AS s FROM sp0)),
r1 AS ({_shift_rows('grid', 'fn', 'c1')})""", strip_cost_sql("k1", "r1", "image_id, ord, s"), f"""
b2 AS (SELECT image_id, s FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY {duck.q('cost', 6)}, ord) AS rk FROM k1) WHERE rk = 1)""") + """
SELECT image_id, (CASE WHEN ((s % fn) + fn) % fn > fn // 2 THEN ((s % fn) + fn) % fn - fn ELSE ((s % fn) + fn) % fn END)::INT AS shift FROM b2 JOIN sp0 USING (image_id)""")
def best_shift(spark, sf):
    return seams.best_shift(fixtures.grid(spark, sf), "y")
