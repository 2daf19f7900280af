"""Clustering queries and model edits."""

from __future__ import annotations

from pyspark.sql import functions as F

from chromatile import fixtures
from chromatile.functions import color as C
from chromatile.operators import assign, cluster, paint, ranges as rg
from chromatile.plans import common, duck
from chromatile.plans.registry import query

LAB = ("lab_l", "lab_a", "lab_b")
HL = duck.with_(duck.PX, common.HIST, duck.lab_cte("hl", "hist"))


def _d(c: str, h: str = "h") -> str:
    return duck.q("+".join(f"({h}.{n}-{c}.{n})*({h}.{n}-{c}.{n})" for n in LAB), 6)


def _center_rows(df, k=None):
    cols = [C.q(F.col(c)).alias(c) for c in LAB]
    return df.select("image_id", "idx", *cols)


def _kmeans_sql(k: int, rounds: int) -> str:
    """CTE text: farthest-first seeds ``s{k-1}`` and Lloyd tables ``c0..c{rounds}``."""
    ctes = ["""s0 AS MATERIALIZED (SELECT image_id, 0 AS idx, lab_l, lab_a, lab_b FROM (
  SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY n DESC, r DESC, g DESC, b DESC) AS rk FROM hl) WHERE rk = 1)"""]
    for i in range(1, k):
        ctes.append(f"""s{i} AS MATERIALIZED (SELECT * FROM s{i-1} UNION ALL SELECT image_id, {i}, lab_l, lab_a, lab_b FROM (
  SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY d DESC, r DESC, g DESC, b DESC) AS rk FROM (
    SELECT h.image_id, h.r, h.g, h.b, h.lab_l, h.lab_a, h.lab_b, min({_d('c')}) AS d FROM hl h JOIN s{i-1} c USING (image_id) GROUP BY ALL)) WHERE rk = 1 AND d > 0)""")
    ctes.append(f"c0 AS MATERIALIZED (SELECT *, false AS done FROM s{k-1})")
    for i in range(1, rounds + 1):
        ctes.append(f"""l{i} AS (SELECT h.image_id, h.r, h.g, h.b, h.n, h.lab_l, h.lab_a, h.lab_b, min({_d('c')}) AS d, arg_min(c.idx, {_d('c')} + c.idx*1e-9) AS idx
  FROM hl h JOIN c{i-1} c USING (image_id) GROUP BY ALL),
m{i} AS (SELECT image_id, idx, sum(n*lab_l)/sum(n) AS ml, sum(n*lab_a)/sum(n) AS ma, sum(n*lab_b)/sum(n) AS mb FROM l{i} GROUP BY ALL),
f{i} AS (SELECT image_id, lab_l AS fl, lab_a AS fa, lab_b AS fb FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY d DESC, r DESC, g DESC, b DESC) AS rk FROM l{i}) WHERE rk = 1),
n{i} AS (SELECT c.image_id, c.idx, c.done, c.lab_l AS ol, c.lab_a AS oa, c.lab_b AS ob, coalesce(ml, fl) AS nl, coalesce(ma, fa) AS na, coalesce(mb, fb) AS nb
  FROM c{i-1} c LEFT JOIN m{i} m ON c.image_id = m.image_id AND c.idx = m.idx JOIN f{i} f ON f.image_id = c.image_id),
c{i} AS MATERIALIZED (SELECT image_id, idx, CASE WHEN done THEN ol ELSE nl END AS lab_l, CASE WHEN done THEN oa ELSE na END AS lab_a, CASE WHEN done THEN ob ELSE nb END AS lab_b,
  done OR max(greatest(abs(nl-ol), abs(na-oa), abs(nb-ob))) OVER (PARTITION BY image_id) <= 1e-4 AS done FROM n{i})""")
    return ",\n".join(ctes)


_FIT3 = HL.rstrip() + ",\n" + _kmeans_sql(3, cluster.ROUNDS) + f""",
fit AS (SELECT image_id, (row_number() OVER (PARTITION BY image_id ORDER BY lab_l, idx) - 1)::INT AS idx, lab_l, lab_a, lab_b FROM c{cluster.ROUNDS})
"""


@query("kmeans_fit", _FIT3 + f"SELECT image_id, idx, {', '.join(duck.q(c) + ' AS ' + c for c in LAB)} FROM fit")
def kmeans_fit(spark, sf):
    return _center_rows(cluster.kmeans_fit(common.histogram(spark, sf), 3))


_MODEL = common.RANGES
_CM = "cm AS (SELECT image_id, idx, lab_l, lab_a, lab_b, weight FROM ranges)"


@query("farthest_seed", HL.rstrip() + ",\n" + _MODEL + f""",
dd AS (SELECT h.image_id, h.r, h.g, h.b, min({_d('c')}) AS d2 FROM hl h JOIN ranges c USING (image_id) GROUP BY ALL)
SELECT image_id, d2, r, g, b FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY d2 DESC, r DESC, g DESC, b DESC) AS rk FROM dd) WHERE rk = 1""")
def farthest_seed(spark, sf):
    centers = common.px_ranges(spark, sf).select("image_id", "idx", *LAB)
    return cluster.farthest_seed(common.histogram(spark, sf), centers).select("image_id", "d2", "r", "g", "b")


@query("inertia", HL.rstrip() + ",\n" + _MODEL + f""",
dd AS (SELECT h.image_id, h.r, h.g, h.b, h.n, min({_d('c')}) AS d2 FROM hl h JOIN ranges c USING (image_id) GROUP BY ALL)
SELECT image_id, {duck.q('sum(n*d2)', 2)} AS inertia, sum(n)::BIGINT AS n FROM dd GROUP BY ALL""")
def inertia(spark, sf):
    centers = common.px_ranges(spark, sf).select("image_id", "idx", *LAB)
    out = assign.inertia(common.histogram(spark, sf), centers)
    return out.select("image_id", C.q(F.col("inertia"), 2).alias("inertia"), "n")


@query("silhouette", HL.rstrip() + f""",
smp AS (SELECT image_id, floor(lab_l/4) AS r, floor(lab_a/4) AS g, floor(lab_b/4) AS b, sum(n) AS n, {", ".join(f"sum(n*{c})/sum(n) AS {c}" for c in LAB)} FROM hl GROUP BY ALL),
lb AS (SELECT image_id, r, g, b, n, lab_l, lab_a, lab_b, {common.nearest_sql(common.CENTERS, (1, 1, 1), *LAB)} AS label FROM smp),
pr AS (SELECT h.image_id, h.r, h.g, h.b, h.n, h.label, c.label AS other, sum(c.n*sqrt({"+".join(f"(h.{n}-c.{n})*(h.{n}-c.{n})" for n in LAB)})) AS sd, sum(c.n) AS nc
  FROM lb h JOIN lb c USING (image_id) GROUP BY ALL),
ab AS (SELECT image_id, r, g, b, n, max(CASE WHEN label = other THEN CASE WHEN nc > 1 THEN sd/(nc-1) ELSE 0 END END) AS va, min(CASE WHEN label <> other THEN sd/nc END) AS vb FROM pr GROUP BY ALL)
SELECT image_id, {duck.q('sum(n*(vb-va)/greatest(va,vb))/sum(n)', 6)} AS silhouette FROM ab WHERE vb IS NOT NULL AND greatest(va,vb) > 1e-12 GROUP BY ALL""")
def silhouette(spark, sf):
    cells = cluster.silhouette_cells(C.with_lab(common.histogram(spark, sf)))
    labelled = cells.withColumn("label", assign.nearest_of(common.CENTERS).cast("int"))
    return cluster.silhouette(labelled).select("image_id", C.q(F.col("silhouette"), 6).alias("silhouette"))


def _literal_inertias(spark, sf):
    """Inertia of the first k of six literal centres, k = 1..6."""
    six = (*common.CENTERS, (20.0, -5.0, -30.0), (50.0, 60.0, 40.0), (70.0, -40.0, 50.0))
    hist = C.with_lab(common.histogram(spark, sf))
    d = [C.q(C.dist2([F.col(n) for n in LAB], [F.lit(v) for v in c]), 6) for c in six]
    running = [F.sum(F.col("n") * (F.least(*d[:k]) if k > 1 else d[0])).alias(str(k)) for k in range(1, 7)]
    wide = hist.groupBy("image_id").agg(*running)
    return wide.unpivot("image_id", [str(k) for k in range(1, 7)], "k", "inertia").select(
        "image_id", F.col("k").cast("int").alias("k"), "inertia"
    )


def _inertia_sql():
    six = (*common.CENTERS, (20.0, -5.0, -30.0), (50.0, 60.0, 40.0), (70.0, -40.0, 50.0))
    d = [duck.q("+".join(f"({n}-({v})::DOUBLE)*({n}-({v})::DOUBLE)" for n, v in zip(LAB, c)), 6) for c in six]
    return "ine AS (" + " UNION ALL ".join(
        f"SELECT image_id, {k} AS k, sum(n*{'least(' + ', '.join(d[:k]) + ')' if k > 1 else d[0]}) AS inertia FROM hl GROUP BY ALL" for k in range(1, 7)) + ")"


@query("elbow_k", HL.rstrip() + ",\n" + _inertia_sql() + f""",
en AS (SELECT image_id, min(k) AS k0, max(k) AS k1, arg_min(inertia, k) AS i0, arg_max(inertia, k) AS i1 FROM ine GROUP BY ALL),
gp AS (SELECT image_id, k, {duck.q("abs((inertia-i1)/(i0-i1) - (1-(k-k0)/(k1-k0)::DOUBLE))/sqrt(2::DOUBLE)", 9)} AS gap FROM ine JOIN en USING (image_id))
SELECT image_id, k::INT AS elbow FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY gap DESC, k) AS rk FROM gp) WHERE rk = 1""")
def elbow_k(spark, sf):
    return cluster.elbow_k(_literal_inertias(spark, sf))


@query("choose_k")
def choose_k(spark, sf):
    return cluster.choose_k(common.histogram(spark, sf))


@query("ink_gaps", duck.with_(common.LABELLED, common.RANGES) + f""",
cn AS (SELECT image_id, label, count(*) AS n FROM labelled WHERE label >= 0 GROUP BY ALL),
gp AS (SELECT image_id, idx, lead(lab_l) OVER (PARTITION BY image_id ORDER BY lab_l) - lab_l AS g FROM ranges)
SELECT gp.image_id, {duck.q('min(g)')} AS min_gap, {duck.q('min(coalesce(n,0))/sum(coalesce(n,0))::DOUBLE', 6)} AS min_share
FROM gp LEFT JOIN cn ON gp.image_id = cn.image_id AND idx = label GROUP BY gp.image_id""")
def ink_gaps(spark, sf):
    sizes = assign.assign_nearest(paint.opaque_only(fixtures.px(spark, sf)), common.CENTERS, common.WEIGHTS).groupBy("image_id", F.col("label").alias("idx")).agg(F.count(F.lit(1)).alias("n"))
    out = cluster.ink_gaps(common.px_ranges(spark, sf).select("image_id", "idx", *LAB), sizes)
    return out.select("image_id", C.q(F.col("min_gap")).alias("min_gap"), C.q(F.col("min_share"), 6).alias("min_share"))


@query("hue_spread", duck.with_(duck.PX, common.RANGES) + f""",
hh AS (SELECT image_id, degrees(atan2(lab_b, lab_a)) AS h FROM ranges WHERE sqrt(lab_a*lab_a+lab_b*lab_b) >= 8),
gg AS (SELECT *, lead(h) OVER (PARTITION BY image_id ORDER BY h) - h AS g FROM hh),
ss AS (SELECT image_id, CASE WHEN count(*) < 2 THEN 0 ELSE 360 - greatest(max(g), min(h)+360-max(h)) END AS spread FROM gg GROUP BY ALL)
SELECT i.image_id, {duck.q('coalesce(spread, 0)')} AS spread FROM (SELECT DISTINCT image_id FROM ranges) i LEFT JOIN ss USING (image_id)""")
def hue_spread(spark, sf):
    out = cluster.hue_spread(common.px_ranges(spark, sf).select("image_id", "idx", *LAB))
    return out.select("image_id", C.q(F.col("spread")).alias("spread"))


_FLOORED = "greatest(w0, 0.03::DOUBLE) / sum(greatest(w0, 0.03::DOUBLE)) OVER (PARTITION BY image_id)"


def _near_arr(d="d"):
    return f"arg_min(c.idx, {d} + c.idx*1e-9)"


def _wd(c="c", h="h"):
    return duck.q("(" + "+".join(f"({h}.{n}-{c}.{n})*({h}.{n}-{c}.{n})" for n in LAB) + f")*((wt/{c}.weight)*(wt/{c}.weight))", 6)


def _label_counts(model: str) -> str:
    """Counts per label of the opaque histogram under weighted model CTE ``model``."""
    return f"""
wtt AS (SELECT *, sum(weight) OVER (PARTITION BY image_id) AS wt FROM {model}),
lb AS (SELECT h.image_id, h.r, h.g, h.b, h.n, arg_min(c.idx, {_wd()} + c.idx*1e-9) AS idx FROM hl h JOIN wtt c USING (image_id) GROUP BY ALL),
ct AS (SELECT image_id, idx, sum(n) AS n FROM lb GROUP BY ALL)"""


def _counted(spark, sf, model):
    hist = common.histogram(spark, sf)
    lab = assign.assign_nearest(hist, model.select("image_id", "idx", *LAB, "weight"))
    counts = lab.groupBy("image_id", F.col("label").alias("idx")).agg(F.sum("n").alias("n"))
    return model.join(counts, ["image_id", "idx"], "left")


@query("drop_range", HL.rstrip() + ",\n" + _MODEL + f""",
kp AS (SELECT image_id, CASE WHEN idx > 1 THEN idx-1 ELSE idx END AS idx, lab_l, lab_a, lab_b, weight/sum(weight) OVER (PARTITION BY image_id) AS w0, name FROM ranges WHERE idx <> 1),
md AS (SELECT image_id, idx, lab_l, lab_a, lab_b, name, {_FLOORED} AS weight FROM kp),""" + _label_counts("md") + f"""
SELECT md.image_id, md.idx::INT AS idx, name, {duck.q('weight', 6)} AS weight, coalesce(n, 0)::BIGINT AS n FROM md LEFT JOIN ct ON md.image_id = ct.image_id AND md.idx = ct.idx""")
def drop_range(spark, sf):
    model = rg.drop_range(common.px_ranges(spark, sf), 1)
    return _counted(spark, sf, model).select("image_id", "idx", "name", C.q(F.col("weight"), 6).alias("weight"), F.coalesce("n", F.lit(0)).alias("n"))


def _insert_sql() -> str:
    """A fourth centre at the farthest colour, moved alone for as many rounds as the fit has."""
    ctes = [f"""dd AS (SELECT h.image_id, h.r, h.g, h.b, h.lab_l, h.lab_a, h.lab_b, min({_d('c')}) AS d2 FROM hl h JOIN ranges c USING (image_id) GROUP BY ALL),
sd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY d2 DESC, r DESC, g DESC, b DESC) AS rk FROM dd) WHERE rk = 1),
al AS (SELECT image_id, idx, lab_l, lab_a, lab_b, greatest(weight*(1-1/4::DOUBLE), 1e-4::DOUBLE) AS w FROM ranges UNION ALL SELECT image_id, 3, lab_l, lab_a, lab_b, 1/4::DOUBLE FROM sd),
nw AS (SELECT * EXCLUDE (w), w/sum(w) OVER (PARTITION BY image_id) AS weight FROM al),
v0 AS MATERIALIZED (SELECT *, sum(weight) OVER (PARTITION BY image_id) AS wt, false AS done FROM nw)"""]
    for i in range(1, cluster.ROUNDS + 1):
        ctes.append(f"""u{i} AS (SELECT h.image_id, h.r, h.g, h.b, h.n, h.lab_l, h.lab_a, h.lab_b, arg_min(c.idx, {_wd()} + c.idx*1e-9) AS idx FROM hl h JOIN v{i-1} c USING (image_id) GROUP BY ALL),
x{i} AS (SELECT image_id, sum(n*lab_l)/sum(n) AS ml, sum(n*lab_a)/sum(n) AS ma, sum(n*lab_b)/sum(n) AS mb FROM u{i} WHERE idx = 3 GROUP BY ALL),
v{i} AS MATERIALIZED (SELECT image_id, idx, CASE WHEN idx = 3 AND NOT done THEN coalesce(ml, lab_l) ELSE lab_l END AS lab_l, CASE WHEN idx = 3 AND NOT done THEN coalesce(ma, lab_a) ELSE lab_a END AS lab_a,
  CASE WHEN idx = 3 AND NOT done THEN coalesce(mb, lab_b) ELSE lab_b END AS lab_b, weight, wt,
  done OR coalesce(max(CASE WHEN idx = 3 THEN greatest(abs(ml-lab_l), abs(ma-lab_a), abs(mb-lab_b)) END) OVER (PARTITION BY image_id) <= 1e-4, true) AS done FROM v{i-1} LEFT JOIN x{i} USING (image_id))""")
    last = f"v{cluster.ROUNDS}"
    ctes.append(f"mw AS (SELECT image_id, idx, lab_l, lab_a, lab_b, weight AS w0 FROM {last})")
    ctes.append(f"md AS (SELECT *, {_FLOORED} AS weight FROM mw)")
    ctes.append(duck.unlab_cte("sw", "md"))
    return ",\n".join(ctes)


@query("insert_range", HL.rstrip() + ",\n" + _MODEL + ",\n" + _insert_sql() + "," + _label_counts("md") + f"""
SELECT sw.image_id, sw.idx::INT AS idx, coalesce(o.name, '') AS name, coalesce(o.match_r, sw.r)::INT AS match_r, coalesce(o.match_g, sw.g)::INT AS match_g, coalesce(o.match_b, sw.b)::INT AS match_b,
 {duck.q('sw.weight', 6)} AS weight, coalesce(n, 0)::BIGINT AS n FROM sw LEFT JOIN ranges o ON o.image_id = sw.image_id AND o.idx = sw.idx LEFT JOIN ct ON ct.image_id = sw.image_id AND ct.idx = sw.idx""")
def insert_range(spark, sf):
    model = rg.insert_range(common.histogram(spark, sf), common.px_ranges(spark, sf))
    return _counted(spark, sf, model).select(
        "image_id", "idx", "name", "match_r", "match_g", "match_b", C.q(F.col("weight"), 6).alias("weight"), F.coalesce("n", F.lit(0)).alias("n")
    )


# Raise range 0 to 70 %: the pair re-labels, the third range is frozen.
@query("reweight_ranges", duck.with_(common.LABELLED, common.RANGES) + f""",
nb AS (SELECT image_id, nb FROM (SELECT x.image_id, y.idx AS nb, row_number() OVER (PARTITION BY x.image_id ORDER BY {_d('y','x')}, y.idx) AS rk
   FROM ranges x JOIN ranges y ON x.image_id = y.image_id AND x.idx = 0 AND y.idx <> 0) WHERE rk = 1),
pw AS (SELECT r.*, nb, sum(CASE WHEN idx IN (0, nb) THEN weight END) OVER (PARTITION BY r.image_id) AS pair FROM ranges r JOIN nb USING (image_id)),
w1 AS (SELECT *, CASE WHEN idx = 0 THEN gv WHEN idx = nb THEN pair - gv ELSE weight END AS ww FROM (SELECT *, least(greatest(0.7::DOUBLE,0.03::DOUBLE), greatest(0.03::DOUBLE, pair-0.03::DOUBLE)) AS gv FROM pw)),
w2 AS (SELECT *, ww/sum(ww) OVER (PARTITION BY image_id) AS w0 FROM w1),
w3 AS (SELECT * EXCLUDE (weight), {_FLOORED} AS weight FROM w2),
pr AS (SELECT a.image_id, a.nb, {", ".join(f"a.{n} AS p{n}, b.{n} AS q{n}" for n in (*LAB, "weight"))} FROM w3 a JOIN w3 b ON a.image_id = b.image_id AND a.idx = 0 AND b.idx = b.nb),
rl AS (SELECT l.image_id, CASE WHEN label = 0 OR label = nb THEN CASE WHEN {duck.q("("+"+".join(f"({n}-q{n})*({n}-q{n})" for n in LAB)+")/(qweight*qweight)", 6)} < {duck.q("("+"+".join(f"({n}-p{n})*({n}-p{n})" for n in LAB)+")/(pweight*pweight)", 6)} THEN nb ELSE 0 END ELSE label END AS label
  FROM labelled l JOIN pr USING (image_id)),
cn AS (SELECT image_id, label, count(*) AS n FROM rl GROUP BY ALL)
SELECT w3.image_id, idx, {duck.q('weight', 6)} AS weight, coalesce(n, 0)::BIGINT AS n FROM w3 LEFT JOIN cn ON w3.image_id = cn.image_id AND idx = label""")
def reweight_ranges(spark, sf):
    labelled, model = rg.reweight_ranges(common.labelled_px(spark, sf, keep_lab=True), common.px_ranges(spark, sf), 0, 0.7)
    counts = labelled.groupBy("image_id", F.col("label").alias("idx")).agg(F.count(F.lit(1)).alias("n"))
    out = model.join(counts, ["image_id", "idx"], "left")
    return out.select("image_id", "idx", C.q(F.col("weight"), 6).alias("weight"), F.coalesce("n", F.lit(0)).alias("n"))


# The last of three bins takes from its left neighbour.
_W2 = "[0.5::DOUBLE, 0.5::DOUBLE-0.45::DOUBLE, 0.45::DOUBLE]"


@query("reweight_bins", duck.with_(duck.PX, f"""
lum AS (SELECT *, {duck.luma()} AS v FROM px),
sl AS (SELECT image_id, greatest(0::DOUBLE, min(v)) AS lo, max(v) AS hi FROM lum WHERE a > 0 GROUP BY ALL),
lb AS (SELECT lum.image_id, CASE WHEN a = 0 OR v < lo THEN -1 ELSE CAST(v > lo + 0.5::DOUBLE*(hi-lo) AS INT) + CAST(v > lo + 0.55::DOUBLE*(hi-lo) AS INT) END AS label FROM lum JOIN sl USING (image_id))""") + """
SELECT image_id, label::INT AS label, count(*)::BIGINT AS n FROM lb GROUP BY ALL""")
def reweight_bins(spark, sf):
    labelled, _ = rg.reweight_bins(fixtures.px(spark, sf), common.histogram(spark, sf), common.px_ranges(spark, sf), 2, 0.45, 3)
    return labelled.groupBy("image_id", "label").agg(F.count(F.lit(1)).alias("n"))


@query("reset_ranges", _FIT3.rstrip() + ",\n" + _MODEL + ",\n" + duck.unlab_cte("sw", "fit") + """
SELECT sw.image_id, sw.idx, sw.r AS match_r, sw.g AS match_g, sw.b AS match_b, '' AS name, visible
FROM sw LEFT JOIN ranges ON sw.image_id = ranges.image_id AND sw.idx = ranges.idx""")
def reset_ranges(spark, sf):
    out = rg.reset_ranges(common.histogram(spark, sf), common.px_ranges(spark, sf), 3)
    return out.select("image_id", "idx", "match_r", "match_g", "match_b", "name", "visible")


_SEED3 = {"V6-N": ("Dark / Garden Grove|Mid / Surf Green|Light / Verdigreen", ((94, 127, 87), (95, 136, 125), (129, 165, 149))),
          "analogous-blues": ("Dark blue|Blue|Light blue", ((13, 71, 161), (30, 136, 229), (144, 202, 249)))}
_PAL = ",".join(f"('{pid}', {i}, '{names.split('|')[i]}', {c[0]}, {c[1]}, {c[2]})" for pid, (names, rgb) in _SEED3.items() for i, c in enumerate(rgb))


@query("apply_palette", HL.rstrip() + ",\n" + _MODEL + f""",
pal AS (SELECT * FROM (VALUES {_PAL}) t(pid, idx, band, pr, pg, pb)),
asg AS (SELECT image_id, idx, weight AS w0, CASE image_id % 3 WHEN 0 THEN 'V6-N' WHEN 1 THEN 'analogous-blues' ELSE 'white-and-black' END AS pid FROM ranges),
pt AS (SELECT image_id, idx, band, pr AS r, pg AS g, pb AS b, w0 FROM asg JOIN pal USING (pid, idx)),
""" + duck.lab_cte("pl", "pt") + f""",
md AS (SELECT *, {_FLOORED} AS weight FROM pl),""" + _label_counts("md") + """
SELECT md.image_id, md.idx::INT AS idx, band AS name, md.r::INT AS repl_r, md.g::INT AS repl_g, md.b::INT AS repl_b, coalesce(n, 0)::BIGINT AS n FROM md LEFT JOIN ct ON md.image_id = ct.image_id AND md.idx = ct.idx
UNION ALL SELECT image_id, -1, 'mismatch ' || pid, 3, 2, -1, -1 FROM asg WHERE pid = 'white-and-black' GROUP BY ALL""")
def apply_palette(spark, sf):
    from chromatile.sources.presets import seed_presets_frame

    pick = F.when(F.col("image_id") % 3 == 0, "V6-N").when(F.col("image_id") % 3 == 1, "analogous-blues").otherwise("white-and-black")
    model, bad = rg.apply_palette(common.px_ranges(spark, sf).withColumn("preset_id", pick), seed_presets_frame(spark))
    out = _counted(spark, sf, rg.floored_weights(model)).select(
        "image_id", "idx", "name", "repl_r", "repl_g", "repl_b", F.coalesce("n", F.lit(0)).alias("n"))
    missed = bad.select("image_id", F.lit(-1).alias("idx"), F.concat(F.lit("mismatch "), "preset_id").alias("name"),
                        F.col("ranges").alias("repl_r"), F.col("bands").alias("repl_g"), F.lit(-1).alias("repl_b"), F.lit(-1).cast("long").alias("n"))
    return out.unionByName(missed)
