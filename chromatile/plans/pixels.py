"""Per-pixel queries: features, fills, tone, text and boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from chromatile import fixtures
from chromatile.functions import color as C, sql
from chromatile.functions.tone import apply_tone
from chromatile.operators import assign, boxes as bx, paint
from chromatile.plans import common, duck
from chromatile.plans.registry import query

KEYS = ("image_id", "l_orderkey", "l_linenumber")
K = ", ".join(KEYS)


_FEATURES = duck.with_(common.PX_LAB, """
f AS (SELECT *, r/255::DOUBLE AS fr, g/255::DOUBLE AS fg, b/255::DOUBLE AS fb FROM pxlab),
m AS (SELECT *, greatest(fr,fg,fb) AS hi, least(fr,fg,fb) AS lo FROM f),
s AS (SELECT *, CASE WHEN hi=lo THEN 0::DOUBLE WHEN fr=hi THEN (hi-fb)/(hi-lo)-(hi-fg)/(hi-lo)
   WHEN fg=hi THEN 2::DOUBLE+(hi-fr)/(hi-lo)-(hi-fb)/(hi-lo) ELSE 4::DOUBLE+(hi-fg)/(hi-lo)-(hi-fr)/(hi-lo) END / 6::DOUBLE AS turn FROM m)
""") + f"""SELECT {K}, r, g, b, {duck.q(duck.luma())} AS luma, {duck.q('lab_l')} AS lab_l, {duck.q('lab_a')} AS lab_a, {duck.q('lab_b')} AS lab_b,
 {duck.q('turn - floor(turn)')} AS hue,
 {duck.q('CASE WHEN hi=lo THEN 0::DOUBLE WHEN (hi+lo)/2 <= 0.5 THEN (hi-lo)/(hi+lo) ELSE (hi-lo)/(2::DOUBLE-(hi+lo)) END')} AS sat,
 {duck.q('(hi+lo)/2::DOUBLE')} AS light FROM s"""


# The same features and the way back, from SQL text alone.
@query("sql_functions", _FEATURES.removesuffix(" FROM s") + ", r AS back_r, g AS back_g, b AS back_b, printf('#%02X%02X%02X', r, g, b) AS hex, g AS hex_g FROM s")
def sql_functions(spark, sf):
    sql.register(spark)
    fixtures.px(spark, sf).createOrReplaceTempView("chromatile_px")
    return spark.sql(f"""
    WITH f AS (SELECT {K}, r, g, b, rgb_to_lab(r, g, b) AS lab, rgb_to_hsl(r, g, b) AS hsl, rgb_to_hex(r, g, b) AS hex FROM chromatile_px),
    e AS (SELECT *, lab_to_rgb(lab.l, lab.a, lab.b) AS back FROM f)
    SELECT {K}, r, g, b, round4(rgb_luma(r, g, b)) AS luma, round4(lab.l) AS lab_l, round4(lab.a) AS lab_a, round4(lab.b) AS lab_b,
      round4(hsl.h) AS hue, round4(hsl.s) AS sat, round4(hsl.l) AS light, back.r AS back_r, back.g AS back_g, back.b AS back_b, hex, hex_to_rgb(hex).g AS hex_g
    FROM e""")


@query("color_features", _FEATURES)
def color_features(spark, sf):
    f = paint.color_features(fixtures.px(spark, sf))
    named = {"luma": "luma", "lab_l": "lab_l", "lab_a": "lab_a", "lab_b": "lab_b", "h": "hue", "s": "sat", "l": "light"}
    return f.select(*KEYS, "r", "g", "b", *[C.q(F.col(c)).alias(n) for c, n in named.items()])


@query("lab_to_rgb", duck.with_(common.PX_LAB, "moved AS (SELECT image_id, l_orderkey, l_linenumber, lab_l*0.9::DOUBLE+4::DOUBLE AS lab_l, lab_a*1.1::DOUBLE AS lab_a, lab_b*0.8::DOUBLE AS lab_b FROM pxlab)",
       duck.unlab_cte("back", "moved")) + f"SELECT {K}, r, g, b FROM back")
def lab_to_rgb(spark, sf):
    lab = C.with_lab(fixtures.px(spark, sf)).select(
        *KEYS, (F.col("lab_l") * 0.9 + 4.0).alias("lab_l"), (F.col("lab_a") * 1.1).alias("lab_a"), (F.col("lab_b") * 0.8).alias("lab_b")
    )
    return paint.lab_to_rgb(lab).select(*KEYS, "r", "g", "b")


@query("opaque_only", duck.with_(duck.PX) + f"SELECT {K}, r, g, b, a FROM px WHERE a > 0")
def opaque_only(spark, sf):
    return paint.opaque_only(fixtures.px(spark, sf)).select(*KEYS, "r", "g", "b", "a")


_TEXT = """CASE p_partkey % 7 WHEN 0 THEN printf('#%02X%02X%02X', p_partkey*37%256, p_size*5%256, p_partkey%256)
 WHEN 1 THEN printf('  %d, %d,%d ', p_partkey%300, p_size*5%256, p_partkey%256)
 WHEN 2 THEN printf('%d %d %d %d', p_partkey%256, p_size*5%256, p_partkey*3%256, p_partkey%270)
 WHEN 3 THEN printf('#%1X%1x%1X', p_partkey%16, p_size%16, p_partkey*7%16)
 WHEN 4 THEN p_name WHEN 5 THEN printf('%02x%02xzz', p_partkey%256, p_size) ELSE printf('%d,%d', p_partkey%256, p_size) END"""


@query("parse_color_text", f"""WITH t AS (SELECT p_partkey, {_TEXT} AS txt FROM part),
h AS (SELECT *, regexp_replace(trim(txt), '^#+', '') AS b0 FROM t),
x AS (SELECT *, CASE WHEN regexp_full_match(b0, '[0-9A-Fa-f]{{3}}') THEN b0[1]||b0[1]||b0[2]||b0[2]||b0[3]||b0[3]
  WHEN regexp_full_match(b0, '[0-9A-Fa-f]{{6}}') THEN b0 END AS hx,
  list_filter(regexp_split_to_array(trim(txt), '[,\\s]+'), lambda p: p <> '') AS parts FROM h),
n AS (SELECT *, CASE WHEN len(parts) IN (3,4) AND len(list_filter(parts, lambda p: regexp_full_match(p, '[0-9]+') AND try_cast(p AS INT) <= 255)) = len(parts)
  THEN list_transform(parts, lambda p: CAST(p AS INT)) END AS nums FROM x),
c AS (SELECT p_partkey, txt,
  CASE WHEN hx IS NOT NULL THEN CAST('0x'||hx[1:2] AS INT) ELSE nums[1] END AS r,
  CASE WHEN hx IS NOT NULL THEN CAST('0x'||hx[3:4] AS INT) ELSE nums[2] END AS g,
  CASE WHEN hx IS NOT NULL THEN CAST('0x'||hx[5:6] AS INT) ELSE nums[3] END AS b,
  CASE WHEN hx IS NOT NULL THEN 255 WHEN nums IS NOT NULL THEN coalesce(nums[4], 255) END AS a FROM n)
SELECT p_partkey, txt, coalesce(r,-1)::INT AS r, coalesce(g,-1)::INT AS g, coalesce(b,-1)::INT AS b, coalesce(a,-1)::INT AS a,
 CASE WHEN r IS NULL THEN '' ELSE printf('#%02X%02X%02X', r, g, b) END AS hex FROM c""")
def parse_color_text(spark, sf):
    part = fixtures.table(spark, sf, "part")
    k, s = F.col("p_partkey"), F.col("p_size")
    kind = k % 7
    text = (
        F.when(kind == 0, F.format_string("#%02X%02X%02X", k * 37 % 256, s * 5 % 256, k % 256))
        .when(kind == 1, F.format_string("  %d, %d,%d ", k % 300, s * 5 % 256, k % 256))
        .when(kind == 2, F.format_string("%d %d %d %d", k % 256, s * 5 % 256, k * 3 % 256, k % 270))
        .when(kind == 3, F.format_string("#%X%x%X", k % 16, s % 16, k * 7 % 16))
        .when(kind == 4, F.col("p_name"))
        .when(kind == 5, F.format_string("%02x%02xzz", k % 256, s))
        .otherwise(F.format_string("%d,%d", k % 256, s))
    )
    out = paint.parse_color_text(part.select("p_partkey", text.alias("txt")), "txt")
    return out.select(
        "p_partkey", "txt", *[F.coalesce(c, F.lit(-1)).alias(c) for c in "rgba"], F.coalesce("hex", F.lit("")).alias("hex")
    )


def _mix(c, start, end):
    return duck.tobyte(f"({start} + ({end} - {start}) * (st / 4::DOUBLE))") + f" AS {c}"


_HLS = """hh AS (SELECT *, greatest(r,g,b)/255::DOUBLE AS hi, least(r,g,b)/255::DOUBLE AS lo FROM rawcat),
hs AS (SELECT *, CASE WHEN hi=lo THEN 0::DOUBLE WHEN r=greatest(r,g,b) THEN (hi-b/255::DOUBLE)/(hi-lo)-(hi-g/255::DOUBLE)/(hi-lo)
  WHEN g=greatest(r,g,b) THEN 2::DOUBLE+(hi-r/255::DOUBLE)/(hi-lo)-(hi-b/255::DOUBLE)/(hi-lo)
  ELSE 4::DOUBLE+(hi-g/255::DOUBLE)/(hi-lo)-(hi-r/255::DOUBLE)/(hi-lo) END / 6::DOUBLE AS turn,
  CASE WHEN hi=lo THEN 0::DOUBLE WHEN (hi+lo)/2<=0.5 THEN (hi-lo)/(hi+lo) ELSE (hi-lo)/(2::DOUBLE-(hi+lo)) END AS sat FROM hh)"""


def hsl_rgb_cte(name: str, src: str, h: str, s: str, l: str) -> str:
    six = {"r": "c x 0 0 x c".split(), "g": "x c c x 0 0".split(), "b": "0 0 x c c x".split()}

    def ch(k):
        chain = " ".join(f"WHEN {i} THEN {('0::DOUBLE' if v == '0' else '_' + v)}" for i, v in enumerate(six[k]))
        return duck.tobyte(f"(CASE _six {chain} END + _m) * 255::DOUBLE") + f" AS {k}"

    return f"""{name} AS (SELECT * EXCLUDE (_h,_c,_hp,_x,_m,_six), {ch('r')}, {ch('g')}, {ch('b')} FROM (
  SELECT *, _c*(1::DOUBLE-abs(_hp - 2::DOUBLE*floor(_hp/2::DOUBLE) - 1::DOUBLE)) AS _x, {l} - _c/2::DOUBLE AS _m, floor(_hp)::INT % 6 AS _six
  FROM (SELECT *, (1::DOUBLE-abs(2::DOUBLE*{l}-1::DOUBLE))*{s} AS _c, _h*6::DOUBLE AS _hp FROM (
    SELECT *, {h} - floor({h}) AS _h FROM {src}))))"""


@query("color_ramps", duck.with_(duck.CATALOG, _HLS,
       "lad AS (SELECT ord, turn, sat, unnest([0.97,0.94,0.86,0.77,0.66,0.58,0.48,0.39,0.30,0.22])::DOUBLE AS light, unnest(range(0,10))::INT AS step FROM hs)",
       hsl_rgb_cte("ladder", "lad", "turn", "sat", "light"),
       "st AS (SELECT *, unnest(range(0,5))::INT AS st FROM rawcat)") + f"""
SELECT ord, 'ladder' AS ramp, step, r, g, b FROM ladder
UNION ALL SELECT ord, 'shade', st, {_mix('r','r::DOUBLE','0::DOUBLE')}, {_mix('g','g::DOUBLE','0::DOUBLE')}, {_mix('b','b::DOUBLE','0::DOUBLE')} FROM st
UNION ALL SELECT ord, 'tint', st, {_mix('r','255::DOUBLE','r::DOUBLE')}, {_mix('g','255::DOUBLE','g::DOUBLE')}, {_mix('b','255::DOUBLE','b::DOUBLE')} FROM st
UNION ALL SELECT ord, 'tone', st, {_mix('r','128::DOUBLE','r::DOUBLE')}, {_mix('g','128::DOUBLE','g::DOUBLE')}, {_mix('b','128::DOUBLE','b::DOUBLE')} FROM st""")
def color_ramps(spark, sf):
    return paint.color_ramps(fixtures.catalog(spark, sf).drop("name"), 5)


@query("exact_fill", duck.with_(common.LABELLED, common.RANGES) + f"""
SELECT l.image_id, l_orderkey, l_linenumber, label, coalesce(repl_r, r) AS r, coalesce(repl_g, g) AS g, coalesce(repl_b, b) AS b
FROM labelled l LEFT JOIN ranges ON l.image_id = ranges.image_id AND label = idx""")
def exact_fill(spark, sf):
    return paint.exact_fill(common.labelled_px(spark, sf), common.px_ranges(spark, sf)).select(*KEYS, "label", "r", "g", "b")


@query("grain_fill", duck.with_(common.LABELLED, common.RANGES,
       duck.lab_cte("rl", "(SELECT image_id, idx, repl_r, repl_g, repl_b FROM ranges)", "repl_r", "repl_g", "repl_b", ("RL", "RA", "RB")),
       """mixed AS (SELECT l.image_id, l_orderkey, l_linenumber, label, r AS r0, g AS g0, b AS b0, RL*0.25::DOUBLE + lab_l*0.75::DOUBLE AS lab_l, RA AS lab_a, RB AS lab_b, idx
  FROM labelled l LEFT JOIN rl ON l.image_id = rl.image_id AND label = idx)""", duck.unlab_cte("done", "mixed")) + f"""
SELECT {K}, label, CASE WHEN idx IS NULL THEN r0 ELSE r END AS r, CASE WHEN idx IS NULL THEN g0 ELSE g END AS g,
 CASE WHEN idx IS NULL THEN b0 ELSE b END AS b FROM done""")
def grain_fill(spark, sf):
    out = paint.grain_fill(common.labelled_px(spark, sf, keep_lab=True), common.px_ranges(spark, sf), 0.75)
    return out.select(*KEYS, "label", "r", "g", "b")


@query("hsl_fill", duck.with_(common.LABELLED, common.RANGES,
       "rawcat AS (SELECT image_id, idx, repl_r AS r, repl_g AS g, repl_b AS b FROM ranges)", _HLS,
       """j AS (SELECT l.image_id, l_orderkey, l_linenumber, label, l.r AS r0, l.g AS g0, l.b AS b0, turn, sat, idx,
   (greatest(l.r,l.g,l.b)+least(l.r,l.g,l.b))/510::DOUBLE AS light FROM labelled l LEFT JOIN hs ON l.image_id = hs.image_id AND label = idx)""",
       hsl_rgb_cte("done", "j", "turn", "sat", "light")) + f"""
SELECT {K}, label, CASE WHEN idx IS NULL THEN r0 ELSE r END AS r, CASE WHEN idx IS NULL THEN g0 ELSE g END AS g,
 CASE WHEN idx IS NULL THEN b0 ELSE b END AS b FROM done""")
def hsl_fill(spark, sf):
    return paint.hsl_fill(common.labelled_px(spark, sf), common.px_ranges(spark, sf)).select(*KEYS, "label", "r", "g", "b")


@query("knockout", duck.with_(common.LABELLED, common.RANGES) + """
SELECT l.image_id, l_orderkey, l_linenumber, label, CASE WHEN visible = false THEN 0 ELSE coalesce(repl_r, r) END::INT AS r,
 CASE WHEN visible = false THEN 0 ELSE coalesce(repl_g, g) END::INT AS g, CASE WHEN visible = false THEN 0 ELSE coalesce(repl_b, b) END::INT AS b,
 CASE WHEN visible = false THEN 0 ELSE a END::INT AS a
FROM labelled l LEFT JOIN ranges ON l.image_id = ranges.image_id AND label = idx""")
def knockout(spark, sf):
    ranges = common.px_ranges(spark, sf)
    painted = paint.exact_fill(common.labelled_px(spark, sf), ranges)
    return paint.knockout(painted, ranges).select(*KEYS, "label", "r", "g", "b", "a")


# Per-image grade, a function of the image id; image 3 is neutral in every parameter.
def _tone(image, lit):
    d = image - 3
    even = image % 2
    return {
        "darks": d * lit(0.1), "lights": d * lit(-0.08), "brightness": d * lit(0.05), "contrast": d * lit(0.07),
        "exposure": d * lit(0.04), "temperature": d * lit(0.06), "tint": d * lit(-0.05), "saturation": d * lit(0.09),
        "lights_reds": d * lit(0.03), "lights_greens": d * lit(-0.02), "lights_blues": d * lit(0.01),
        "balance_cyan": d * even * lit(0.05), "balance_magenta": d * even * lit(-0.03), "balance_yellow": d * even * lit(0.02),
        "lights_cyan": d * lit(0.06), "lights_magenta": d * lit(0.02), "lights_yellow": d * lit(-0.04),
        "darks_cyan": d * lit(-0.03), "darks_magenta": d * lit(0.05), "darks_yellow": d * lit(0.02),
    }


class _Sql(str):
    """String algebra so the grade above also prints as SQL."""

    def __mul__(self, o):
        return _Sql(f"({self} * {o})")

    def __sub__(self, o):
        return _Sql(f"({self} - {o})")

    def __mod__(self, o):
        return _Sql(f"({self} % {o})")


def _tone_sql(source: str = "px", before: tuple = (), last: str | None = None) -> str:
    t = _tone(_Sql("image_id"), lambda v: f"({v})::DOUBLE")
    cols = ", ".join(f"{v} AS {k}" for k, v in t.items())
    lum = lambda s: duck.luma(f"{s}r", f"{s}g", f"{s}b")

    def gain(prev, nxt, mix, names, sign, cond=None):
        out = []
        for c, n in zip("rgb", names):
            f = f"(1::DOUBLE + {mix}*({n}*({sign}0.5)::DOUBLE))"
            if cond:
                f = f"CASE WHEN {cond} THEN {f} ELSE 1::DOUBLE END"
            out.append(f"{prev}{c} * {f} AS {nxt}{c}")
        return ", ".join(out)

    inks = ("cyan", "magenta", "yellow")
    zero = "abs(balance_cyan)+abs(balance_magenta)+abs(balance_yellow) < 1e-12"
    fin = ", ".join(
        "CASE WHEN image_id = 3 THEN {c} ELSE {v} END AS {c}".format(
            c=c, v=duck.tobyte(f"(_yy + (f4{c} - _yy)*(1::DOUBLE+saturation))"))
        for c in "rgb")
    return duck.with_(*(before or (duck.PX,)), f"t0 AS (SELECT *, {cols}, {duck.luma()}/255::DOUBLE AS _n FROM {source})",
        "t1 AS (SELECT *, least(1::DOUBLE, greatest(0::DOUBLE, (0.4::DOUBLE-_n)/0.4::DOUBLE)) AS sw, least(1::DOUBLE, greatest(0::DOUBLE, (_n-0.6::DOUBLE)/(1.0::DOUBLE-0.6::DOUBLE))) AS hw,"
        " r*(1::DOUBLE+temperature*0.5::DOUBLE) AS ar, g*(1::DOUBLE-tint*0.5::DOUBLE) AS ag, b*(1::DOUBLE-temperature*0.5::DOUBLE) AS ab FROM t0)",
        f"t2 AS (SELECT *, {lum('a')} AS src FROM t1)",
        "t3 AS (SELECT *, (src/255::DOUBLE)*(1::DOUBLE-sw*abs(darks)) + (CASE WHEN darks>=0 THEN 0::DOUBLE ELSE 1::DOUBLE END)*(sw*abs(darks)) AS y0 FROM t2)",
        "t4 AS (SELECT *, y0*(1::DOUBLE-hw*abs(lights)) + (CASE WHEN lights>=0 THEN 1::DOUBLE ELSE 0::DOUBLE END)*(hw*abs(lights)) AS y1 FROM t3)",
        "t5 AS (SELECT *, least(1::DOUBLE, greatest(0::DOUBLE, ((y1+brightness*0.35::DOUBLE)*pow(2::DOUBLE, exposure) - 0.5::DOUBLE)*(1::DOUBLE+contrast)+0.5::DOUBLE))*255::DOUBLE AS y2 FROM t4)",
        "t6 AS (SELECT *, " + ", ".join(f"CASE WHEN src<0.001::DOUBLE THEN y2 ELSE a{c}*(y2/greatest(src, 0.001::DOUBLE)) END AS f0{c}" for c in "rgb") + " FROM t5)",
        f"t7 AS (SELECT *, {gain('f0','f1','hw',('lights_reds','lights_greens','lights_blues'),'')} FROM t6)",
        f"t8 AS (SELECT *, {gain('f1','f2','1::DOUBLE',['balance_'+i for i in inks],'-')} FROM t7)",
        f"t9 AS (SELECT *, {gain('f2','f3','hw',['lights_'+i for i in inks],'-',zero)} FROM t8)",
        f"ta AS (SELECT *, {gain('f3','f4','sw',['darks_'+i for i in inks],'-')} FROM t9)",
        f"tb AS (SELECT *, {lum('f4')} AS _yy FROM ta)") + (f"SELECT {K}, {fin} FROM tb" if last is None else last.format(graded=f"(SELECT {K}, label, a, {fin} FROM tb)"))


@query("apply_tone", _tone_sql())
def tone(spark, sf):
    graded = apply_tone(fixtures.px(spark, sf), _tone(F.col("image_id"), F.lit))
    return graded.select(*KEYS, "r", "g", "b")


_PAINTED = (
    common.LABELLED, common.RANGES,
    duck.lab_cte("rl", "(SELECT image_id, idx, repl_r, repl_g, repl_b FROM ranges)", "repl_r", "repl_g", "repl_b", ("RL", "RA", "RB")),
    """mixed AS (SELECT l.image_id, l_orderkey, l_linenumber, label, a, r AS r0, g AS g0, b AS b0, RL*0.25::DOUBLE + lab_l*0.75::DOUBLE AS lab_l, RA AS lab_a, RB AS lab_b, idx
  FROM labelled l LEFT JOIN rl ON l.image_id = rl.image_id AND label = idx)""", duck.unlab_cte("done", "mixed"),
    f"""painted AS (SELECT {K}, label, a, CASE WHEN idx IS NULL THEN r0 ELSE r END AS r, CASE WHEN idx IS NULL THEN g0 ELSE g END AS g, CASE WHEN idx IS NULL THEN b0 ELSE b END AS b FROM done)""",
)


# Label, fill, grade and knock-out in one plan.
@query("render", _tone_sql("painted", _PAINTED, "SELECT p.image_id, l_orderkey, l_linenumber, label, " + ", ".join(f"(CASE WHEN visible = false THEN 0 ELSE {c} END)::INT AS {c}" for c in "rgba")
       + " FROM {graded} p LEFT JOIN ranges ON p.image_id = ranges.image_id AND label = idx"))
def render(spark, sf):
    labelled = common.labelled_px(spark, sf, keep_lab=True)
    return paint.render(labelled, common.px_ranges(spark, sf), 0.75, _tone(F.col("image_id"), F.lit)).select(*KEYS, "label", "r", "g", "b", "a")


def _norm_sql(x0, y0, x1, y1, w, h):
    lo = lambda a, b, m: f"least(greatest({duck.rint(f'least(({a})::DOUBLE,({b})::DOUBLE)')},0),{m})"
    hi = lambda a, b, m: f"least(greatest({duck.rint(f'greatest(({a})::DOUBLE,({b})::DOUBLE)')},0),{m})"
    return (f"CAST({lo(x0,x1,w)} AS INT) AS x0, CAST({lo(y0,y1,h)} AS INT) AS y0, "
            f"CAST({hi(x0,x1,w)} AS INT) AS x1, CAST({hi(y0,y1,h)} AS INT) AS y1")


@query("remap_boxes", duck.with_(duck.BOXES, f"""
sz AS (SELECT 21 AS sw, CAST((SELECT max(vec_id)+1 FROM embeddings) AS INT) AS sh),
fr AS (SELECT b.*, sw, sh, {duck.rint('sw*0.5::DOUBLE + 3 - '+duck.rint('sw*1.5::DOUBLE')+'*0.5::DOUBLE')} AS lft,
  {duck.rint('sh*0.5::DOUBLE - 5 - '+duck.rint('sh*1.5::DOUBLE')+'*0.5::DOUBLE')} AS tp FROM boxes b, sz),
disp AS (SELECT image_id, box_id, sw, sh, lft, tp, {_norm_sql('(x0*1.5::DOUBLE+lft)*42/sw','(y0*1.5::DOUBLE+tp)*300/sh','(x1*1.5::DOUBLE+lft)*42/sw','(y1*1.5::DOUBLE+tp)*300/sh','42','300')} FROM fr),
dk AS (SELECT * FROM disp WHERE x1-x0>=2 AND y1-y0>=2),
pt AS (SELECT *, least(sw-1, greatest(0, {duck.rint('(x0*sw/42::DOUBLE-lft)/1.5::DOUBLE')})) AS sx0, least(sh-1, greatest(0, {duck.rint('(y0*sh/300::DOUBLE-tp)/1.5::DOUBLE')})) AS sy0,
  least(sw-1, greatest(0, {duck.rint('(x1*sw/42::DOUBLE-lft)/1.5::DOUBLE')})) AS sx1, least(sh-1, greatest(0, {duck.rint('(y1*sh/300::DOUBLE-tp)/1.5::DOUBLE')})) AS sy1 FROM dk),
back AS (SELECT image_id, box_id, {_norm_sql('sx0','sy0','sx1','sy1','sw','sh')} FROM pt),
sc AS (SELECT image_id, box_id, {_norm_sql(duck.rint('x0*10/sw::DOUBLE'),duck.rint('y0*100/sh::DOUBLE'),duck.rint('x1*10/sw::DOUBLE'),duck.rint('y1*100/sh::DOUBLE'),'10','100')} FROM fr)""") + """
SELECT 'display' AS kind, image_id, box_id, x0, y0, x1, y1 FROM dk
UNION ALL SELECT 'source', * FROM back WHERE x1-x0>=2 AND y1-y0>=2
UNION ALL SELECT 'scaled', image_id, box_id, CASE WHEN x1-x0>=2 AND y1-y0>=2 THEN x0 ELSE 0 END, CASE WHEN x1-x0>=2 AND y1-y0>=2 THEN y0 ELSE 0 END,
  CASE WHEN x1-x0>=2 AND y1-y0>=2 THEN x1 ELSE 2 END, CASE WHEN x1-x0>=2 AND y1-y0>=2 THEN y1 ELSE 2 END FROM sc""")
def remap_boxes(spark, sf):
    rows = fixtures.table(spark, sf, "embeddings").agg((F.max("vec_id") + 1).cast("int").alias("h")).scalar()
    src = fixtures.boxes(spark, sf).withColumns({"sw": F.lit(fixtures.GRID_WIDTH), "sh": rows})
    view = bx.Frame(3.0, -5.0, 1.5)
    shown = bx.source_to_display(src, view, 42, 300)
    back = bx.display_to_source(shown, view, 42, 300)
    scaled = bx.scale_boxes(src, 10, 100)
    cols = ["image_id", "box_id", "x0", "y0", "x1", "y1"]
    parts = [d.select(F.lit(k).alias("kind"), *cols) for k, d in (("display", shown), ("source", back), ("scaled", scaled))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("assign_nearest", duck.with_(common.LABELLED) + f"SELECT {K}, label FROM labelled")
def assign_nearest(spark, sf):
    return common.labelled_px(spark, sf).select(*KEYS, "label")


@query("coverage_by_color", duck.with_(common.LABELLED) + f"""
SELECT image_id, label, count(*)::BIGINT AS n, {duck.q('avg(lab_l)')} AS mean_l FROM labelled WHERE a > 0 GROUP BY image_id, label""")
def coverage_by_color(spark, sf):
    lab = assign.assign_nearest(paint.opaque_only(fixtures.px(spark, sf)), common.CENTERS, common.WEIGHTS, keep_lab=True)
    return lab.groupBy("image_id", "label").agg(F.count(F.lit(1)).alias("n"), C.q(F.avg("lab_l")).alias("mean_l"))


_PAIR_W = (0.25, 0.55, 0.2)


@query("reassign_pair", duck.with_(common.LABELLED) + f"""
SELECT {K}, CASE WHEN label IN (0,1) THEN {common.nearest_sql(common.CENTERS[:2], _PAIR_W[:2])} ELSE label END::INT AS label FROM labelled""")
def reassign_pair(spark, sf):
    out = assign.reassign_pair(common.labelled_px(spark, sf, keep_lab=True), common.CENTERS, _PAIR_W, 0, 1)
    return out.select(*KEYS, "label")


_D = duck.q("(x.lab_l-y.lab_l)*(x.lab_l-y.lab_l)+(x.lab_a-y.lab_a)*(x.lab_a-y.lab_a)+(x.lab_b-y.lab_b)*(x.lab_b-y.lab_b)", 6)


@query("nearest_other", duck.with_(duck.PX, common.RANGES) + f"""
SELECT image_id, idx, neighbor, d2 FROM (SELECT x.image_id, x.idx, y.idx AS neighbor, {_D} AS d2,
  row_number() OVER (PARTITION BY x.image_id, x.idx ORDER BY {_D}, y.idx) AS rk
  FROM ranges x JOIN ranges y ON x.image_id = y.image_id AND x.idx <> y.idx) WHERE rk = 1""")
def nearest_other(spark, sf):
    return assign.nearest_other(common.px_ranges(spark, sf).select("image_id", "idx", "lab_l", "lab_a", "lab_b"))


@query("hidden_ranges", duck.with_(common.LABELLED, common.RANGES) + """
SELECT l.image_id, label, CASE WHEN coalesce(visible, true) THEN 'kept' ELSE 'removed' END AS side, count(*)::BIGINT AS n
FROM labelled l LEFT JOIN ranges ON l.image_id = ranges.image_id AND label = idx GROUP BY ALL""")
def hidden_ranges(spark, sf):
    kept, removed = paint.split_by_visibility(common.labelled_px(spark, sf), common.px_ranges(spark, sf))
    both = kept.withColumn("side", F.lit("kept")).unionByName(removed.withColumn("side", F.lit("removed")))
    return both.groupBy("image_id", "label", "side").agg(F.count(F.lit(1)).alias("n"))
