"""Grouped queries: histograms, bins, gains, extents, gradients."""

from __future__ import annotations

from pyspark.sql import functions as F

from chromatile import fixtures
from chromatile.functions import color as C
from chromatile.functions.tone import apply_tone, highlight_weight
from chromatile.operators import bins, frame, stats
from chromatile.plans import common, duck
from chromatile.plans.registry import query

LAB = ("lab_l", "lab_a", "lab_b")
GRID = duck.GRID


@query("color_histogram", duck.with_(duck.PX, common.HIST) + "SELECT * FROM hist")
def color_histogram(spark, sf):
    return common.histogram(spark, sf)


@query("range_stats", duck.with_(common.LABELLED, common.RANGES, """
st AS (SELECT image_id, label, count(*) AS n, avg(r) AS mr, avg(g) AS mg, avg(b) AS mb FROM labelled GROUP BY ALL),
tt AS (SELECT image_id, count(*) AS total FROM px WHERE a > 0 GROUP BY ALL)""") + f"""
SELECT ranges.image_id, idx, weight, {duck.q('lab_l')} AS low, coalesce(n, 0)::BIGINT AS n, total::BIGINT AS total,
 {duck.q('coalesce(n,0)/total::DOUBLE', 6)} AS share,
 coalesce({duck.rint('mr')}, 128)::INT AS mean_r, coalesce({duck.rint('mg')}, 128)::INT AS mean_g, coalesce({duck.rint('mb')}, 128)::INT AS mean_b,
 {duck.q('least(1::DOUBLE, greatest(0::DOUBLE, lab_l/100::DOUBLE))')} AS display_key
FROM ranges LEFT JOIN st ON ranges.image_id = st.image_id AND idx = label LEFT JOIN tt ON ranges.image_id = tt.image_id""")
def range_stats(spark, sf):
    ranges = common.px_ranges(spark, sf).select("image_id", "idx", "weight", F.col("lab_l").alias("low"))
    s = stats.range_stats(common.labelled_px(spark, sf), ranges)
    return s.withColumns(
        {
            "low": C.q(F.col("low")),
            "share": C.q(F.col("share"), 6),
            "display_key": C.q(stats.bin_display_key(F.col("low"), F.col("low"), "lab_l")),
        }
    )


def _edge_rows(edges):
    return edges.select("image_id", F.posexplode("edges").alias("idx", "e")).select(
        "image_id", "idx", C.q(F.col("e"), 6).alias("edge")
    )


_SPAN = f"""lum AS (SELECT image_id, {duck.luma()} AS v FROM px WHERE a > 0),
ab AS (SELECT image_id, lab_a AS v FROM pxlab WHERE a > 0),
sl AS (SELECT image_id, greatest(60::DOUBLE, min(v)) AS lo, max(v) AS hi FROM lum GROUP BY ALL),
sa AS (SELECT image_id, greatest(-128::DOUBLE, min(v)) AS lo, max(v) AS hi FROM ab GROUP BY ALL)"""


@query("bin_edges_equal", duck.with_(common.PX_LAB, _SPAN) + f"""
SELECT 'luma' AS channel, image_id, i::INT AS idx, {duck.q('CASE WHEN i = 5 THEN hi ELSE lo + (hi-lo)/5*i END', 6)} AS edge FROM sl, (SELECT unnest(range(0,6)) AS i)
UNION ALL SELECT 'lab_a', image_id, i::INT, {duck.q('CASE WHEN i = 3 THEN hi ELSE lo + (hi-lo)/3*i END', 6)} FROM sa, (SELECT unnest(range(0,4)) AS i)""")
def bin_edges_equal(spark, sf):
    h = common.histogram(spark, sf)
    a = _edge_rows(bins.bin_edges(h, 5, "luma", start=60.0)).withColumn("channel", F.lit("luma"))
    return a.unionByName(_edge_rows(bins.bin_edges(h, 3, "lab_a")).withColumn("channel", F.lit("lab_a")))


@query("bin_edges_even", duck.with_(common.PX_LAB, _SPAN, """
p AS (SELECT lum.image_id, min(lo) AS lo, min(hi) AS hi, quantile_cont(v, [0.0,0.25,0.5,0.75,1.0]) AS ps FROM lum JOIN sl USING (image_id) WHERE v >= lo GROUP BY ALL),
u AS (SELECT image_id, lo, hi, list_sort(list_distinct(list_transform(ps, lambda e: round_even(e*1000000::DOUBLE,0)/1000000::DOUBLE))) AS es FROM p)""") + f"""
SELECT image_id, i::INT AS idx, {duck.q('CASE WHEN i = 0 THEN lo WHEN i = len(es)-1 THEN hi ELSE es[i+1] END', 6)} AS edge
FROM (SELECT *, unnest(range(0, len(es))) AS i FROM u)""")
def bin_edges_even(spark, sf):
    return _edge_rows(bins.bin_edges(common.histogram(spark, sf), 4, "luma", start=60.0, even=True))


_CUM = "[0.0, 0.5/1.1, 0.8/1.1, 1.0]::DOUBLE[]"


@query("bin_edges_weighted", duck.with_(common.PX_LAB, _SPAN, f"""
p AS (SELECT lum.image_id, min(lo) AS lo, min(hi) AS hi, quantile_cont(v, [0.0, 0.45454545454545453, 0.7272727272727273, 1.0]) AS ps FROM lum JOIN sl USING (image_id) WHERE v >= lo GROUP BY ALL)""") + f"""
SELECT 'span' AS kind, image_id, i::INT AS idx, {duck.q(f'lo + ({_CUM})[i+1]*(hi-lo)', 6)} AS edge FROM sl, (SELECT unnest(range(0,4)) AS i)
UNION ALL SELECT 'share', image_id, i::INT, {duck.q('CASE WHEN i=0 THEN lo WHEN i=3 THEN hi ELSE ps[i+1] END', 6)} FROM p, (SELECT unnest(range(0,4)) AS i)""")
def bin_edges_weighted(spark, sf):
    h, w = common.histogram(spark, sf), (0.5, 0.3, 0.3)
    a = _edge_rows(bins.bin_edges(h, 3, "luma", 60.0, weights=w)).withColumn("kind", F.lit("span"))
    b = _edge_rows(bins.bin_edges(h, 3, "luma", 60.0, even=True, weights=w)).withColumn("kind", F.lit("share"))
    return a.unionByName(b)


@query("label_bins", duck.with_(common.PX_LAB, _SPAN) + f"""
SELECT px.image_id, l_orderkey, l_linenumber, CASE WHEN a = 0 OR {duck.luma()} < lo THEN -1 ELSE
  CAST({duck.luma()} > lo+(hi-lo)/4*1 AS INT) + CAST({duck.luma()} > lo+(hi-lo)/4*2 AS INT) + CAST({duck.luma()} > lo+(hi-lo)/4*3 AS INT) END::INT AS label
FROM px JOIN sl USING (image_id)""")
def label_bins(spark, sf):
    edges = bins.bin_edges(common.histogram(spark, sf), 4, "luma", start=60.0)
    return bins.label_bins(fixtures.px(spark, sf), edges).select("image_id", "l_orderkey", "l_linenumber", "label")


_TT = """SELECT image_id, {g}, {t} AS temperature, {u} AS tint FROM (SELECT *, (gr+gg+gb)/3 AS gm FROM gains)""".format(
    g=", ".join(f"{duck.q('g' + c, 6)} AS gain_{c}" for c in "rgb"),
    t=duck.q("least(1::DOUBLE, greatest(-1::DOUBLE, (gr/gm-gb/gm)))", 6),
    u=duck.q("least(1::DOUBLE, greatest(-1::DOUBLE, (1::DOUBLE-gg/gm)/0.5::DOUBLE))", 6),
)
_HW = "least(1::DOUBLE, greatest(0::DOUBLE, (" + duck.luma() + "/255::DOUBLE - 0.6::DOUBLE)/(1.0::DOUBLE-0.6::DOUBLE)))"


def _gain_cols(df):
    return df.select("image_id", *[C.q(F.col(c), 6).alias(c) for c in ("gain_r", "gain_g", "gain_b", "temperature", "tint")])


@query("gray_world", duck.with_(duck.PX, f"""
s AS (SELECT image_id, sum(w) AS ws, sum(w*r) AS sr, sum(w*g) AS sg, sum(w*b) AS sb FROM (SELECT *, {_HW} AS w FROM px) GROUP BY ALL),
m AS (SELECT image_id, sr/ws AS mr, sg/ws AS mg, sb/ws AS mb FROM s),
gains AS (SELECT image_id, (mr+mg+mb)/3/mr AS gr, (mr+mg+mb)/3/mg AS gg, (mr+mg+mb)/3/mb AS gb FROM m)""") + _TT)
def gray_world(spark, sf):
    px = fixtures.px(spark, sf)
    return _gain_cols(stats.gray_world(px, highlight_weight(C.luma(F.col("r"), F.col("g"), F.col("b")) / 255.0)))


@query("white_patch", duck.with_(duck.PX, f"""
s AS (SELECT image_id, quantile_cont(r, 0.99) AS pr, quantile_cont(g, 0.99) AS pg, quantile_cont(b, 0.99) AS pb
  FROM px WHERE {_HW} > 1e-6 GROUP BY ALL),
gains AS (SELECT image_id, greatest(pr,pg,pb)/pr AS gr, greatest(pr,pg,pb)/pg AS gg, greatest(pr,pg,pb)/pb AS gb FROM s)""") + _TT)
def white_patch(spark, sf):
    return _gain_cols(stats.white_patch(fixtures.px(spark, sf)))


# Source raster against the same raster with its luma lifted in the dark and light tails.
def _graded(spark, sf):
    return apply_tone(fixtures.grid(spark, sf), {"darks": 0.3, "lights": -0.2})


_BASIS = {
    "dl": ("sw*(1-s)", "sw"), "dc": ("-(sw*s)", "sw"), "ll": ("hw*(1-s)", "hw"), "lc": ("-(hw*s)", "hw"),
}


@query("tone_fit", duck.with_(GRID, f"""
a AS (SELECT *, {duck.luma()} AS l0 FROM grid),
b1 AS (SELECT *, least(1::DOUBLE, greatest(0::DOUBLE, (0.4::DOUBLE-l0/255)/0.4::DOUBLE)) AS sw, least(1::DOUBLE, greatest(0::DOUBLE, (l0/255-0.6::DOUBLE)/(1.0::DOUBLE-0.6::DOUBLE))) AS hw FROM a),
c1 AS (SELECT *, (l0/255)*(1-sw*0.3::DOUBLE) AS y0 FROM b1),
d1 AS (SELECT *, least(1::DOUBLE, greatest(0::DOUBLE, y0*(1-hw*0.2::DOUBLE)))*255 AS y1 FROM c1),
e1 AS (SELECT *, {", ".join(f"CASE WHEN l0 < 0.001 THEN {duck.tobyte('y1')} ELSE {duck.tobyte(f'{c}*(y1/l0)')} END AS d{c}" for c in "rgb")} FROM d1),
f1 AS (SELECT image_id, l0/255 AS s, sw, hw, ({duck.luma('dr','dg','db')}-l0)/255 AS y FROM e1),
g1 AS (SELECT image_id, avg(sw) AS ws, avg(hw) AS wh, {", ".join(f"greatest(0::DOUBLE, sum(y*({v}))/sum(({v})*({v}))) AS {k}" for k, (v, _) in _BASIS.items())} FROM f1 GROUP BY ALL)""") + f"""
SELECT image_id, {duck.q("-(CASE WHEN dl>=dc THEN least(1::DOUBLE, dl) ELSE greatest(-1::DOUBLE,-dc) END)", 6)} AS darks,
 {duck.q("CASE WHEN ll>=lc THEN least(1::DOUBLE, ll) ELSE greatest(-1::DOUBLE,-lc) END", 6)} AS lights FROM g1""")
def tone_fit(spark, sf):
    fit = stats.tone_fit(fixtures.grid(spark, sf), _graded(spark, sf))
    return fit.select("image_id", C.q(F.col("darks"), 6).alias("darks"), C.q(F.col("lights"), 6).alias("lights"))


_RAD = ", ".join(
    duck.q(f"greatest(2*sqrt(greatest(0, sd{c})), CASE WHEN n >= 4 THEN p{c} ELSE mx{c} END, 2.5::DOUBLE)") + f" AS radius_lab_{c}"
    for c in "lab"
)


@query("range_extents", duck.with_(common.LABELLED, f"""
cc AS (SELECT * FROM (VALUES {", ".join(f"({i}, {c[0]}::DOUBLE, ({c[1]})::DOUBLE, ({c[2]})::DOUBLE)" for i, c in enumerate(common.CENTERS))}) t(label, cl, ca, cb)),
dv AS (SELECT image_id, label, lab_l-cl AS dl, lab_a-ca AS da, lab_b-cb AS db FROM labelled JOIN cc USING (label) WHERE label >= 0),
ag AS (SELECT image_id, label, count(*) AS n, {", ".join(f"var_pop(d{c}) AS sd{c}, quantile_cont(abs(d{c}), 0.95) AS p{c}, max(abs(d{c})) AS mx{c}" for c in "lab")},
  sqrt(avg(dl*dl+da*da+db*db)) AS rms, sqrt(max(dl*dl+da*da+db*db)) AS r_max FROM dv GROUP BY ALL)""") + f"""
SELECT image_id, label, n::BIGINT AS n, {_RAD}, {duck.q('rms')} AS rms, {duck.q('r_max')} AS r_max FROM ag""")
def range_extents(spark, sf):
    hist = C.with_lab(common.histogram(spark, sf))
    labelled = hist.withColumn("label", stats_label())
    ids = hist.select("image_id").distinct()
    rows = F.array(*[F.struct(F.lit(i).alias("idx"), *[F.lit(v).alias(n) for n, v in zip(LAB, c)]) for i, c in enumerate(common.CENTERS)])
    centers = ids.select("image_id", F.inline(rows))
    out = stats.range_extents(labelled, centers)
    return out.select("image_id", "label", "n", *[C.q(F.col(c)).alias(c) for c in out.columns[3:]])


def stats_label():
    from chromatile.operators.assign import nearest_of

    return nearest_of(common.CENTERS, common.WEIGHTS).cast("int")


@query("coverage_rollup", duck.with_(common.LABELLED) + """
SELECT coalesce(image_id, -9)::INT AS image_id, coalesce(label, -9)::INT AS label, count(*)::BIGINT AS n,
 (grouping(image_id)*2 + grouping(label))::INT AS level FROM labelled GROUP BY ROLLUP (image_id, label)""")
def coverage_rollup(spark, sf):
    return stats.coverage_rollup(common.labelled_px(spark, sf))


@query("axis_profile", duck.with_(GRID) + f"""
SELECT 'x' AS axis, image_id, x AS pos, {duck.q('avg('+duck.luma()+')')} AS mean_luma FROM grid GROUP BY ALL
UNION ALL SELECT 'y', image_id, y, {duck.q('avg('+duck.luma()+')')} FROM grid GROUP BY ALL""")
def axis_profile(spark, sf):
    g = fixtures.grid(spark, sf)
    parts = [
        stats.axis_profile(g, a).select(F.lit(a).alias("axis"), "image_id", F.col(a).alias("pos"), C.q(F.col("mean_luma")).alias("mean_luma"))
        for a in ("x", "y")
    ]
    return parts[0].unionByName(parts[1])



def sized_sql(src: str, cols: str, name: str = "probe") -> str:
    """CTEs ``dims`` and ``name``: all pixels of ``src`` with their image size."""
    return f"""dims AS (SELECT image_id, (max(x)+1)::INT AS w, (max(y)+1)::INT AS h FROM {src} GROUP BY ALL),
{name} AS (SELECT s.image_id, s.x::INT AS x, s.y::INT AS y, {cols}, w, h, w AS full_w, h AS full_h FROM {src} s JOIN dims USING (image_id))"""


@query("light_plane", duck.with_(GRID, duck.lab_cte("gl", "grid"), sized_sql("gl", "lab_l"), """
b0 AS (SELECT *, CASE WHEN w>1 THEN x/(w-1)::DOUBLE-0.5 ELSE 0 END AS ux, CASE WHEN h>1 THEN y/(h-1)::DOUBLE-0.5 ELSE 0 END AS uy FROM probe),
f AS (SELECT image_id, avg(lab_l) AS m, coalesce(sum(lab_l*ux)/nullif(sum(ux*ux),0),0) AS kx, coalesce(sum(lab_l*uy)/nullif(sum(uy*uy),0),0) AS ky,
  coalesce(sum(lab_l*ux*uy)/nullif(sum(ux*uy*ux*uy),0),0) AS kxy FROM b0 GROUP BY ALL)""") + f"""
SELECT image_id, {duck.q('m-0.5*kx-0.5*ky+0.25*kxy')} AS c0, {duck.q('kx-0.5*kxy')} AS c1, {duck.q('ky-0.5*kxy')} AS c2, {duck.q('kxy')} AS c3 FROM f""")
def light_plane(spark, sf):
    fit = stats.light_plane(C.with_lab(fixtures.grid(spark, sf)))
    return fit.select("image_id", *[C.q(F.col(f"c{i}")).alias(f"c{i}") for i in range(4)])


@query("cell_means", duck.with_(GRID, duck.BOXES, """
sites AS (SELECT image_id, box_id AS site_id, x0::DOUBLE AS x, y0::DOUBLE AS y FROM boxes),
cells AS (SELECT *, (x // 4) * 1000000 + (y // 4) AS site FROM grid),
m AS (SELECT image_id, site, avg(r) AS mr, avg(g) AS mg, avg(b) AS mb FROM cells GROUP BY ALL)""") + f"""
SELECT s.image_id, s.site_id AS site, {", ".join(duck.tobyte(f"coalesce(m.m{c}, g.{c})") + f" AS {c}" for c in "rgb")}
FROM sites s LEFT JOIN m ON s.image_id = m.image_id AND s.site_id = m.site
JOIN grid g ON g.image_id = s.image_id AND g.x = s.x AND g.y = s.y""")
def cell_means(spark, sf):
    grid = fixtures.grid(spark, sf)
    sites = fixtures.boxes(spark, sf).select("image_id", F.col("box_id").alias("site_id"), F.col("x0").cast("double").alias("x"), F.col("y0").cast("double").alias("y"))
    cells = grid.withColumn("site", F.floor(F.col("x") / 4) * 1000000 + F.floor(F.col("y") / 4))
    return stats.cell_means(cells, sites)
