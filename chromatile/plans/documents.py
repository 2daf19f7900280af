"""Layer-document, lighting, mosaic and sampling queries."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from chromatile import fixtures
from chromatile.functions import color as C
from chromatile.operators import assign, layers as ly, lighting, mosaic
from chromatile.plans import common, duck
from chromatile.plans.registry import query

TREE, GRID = duck.TREE, duck.GRID
STEP = "printf('%010d', ord) || '~' || id"


@query("walk_tree", duck.with_(TREE, f"""
wk AS (SELECT doc_id, id, kind, expanded, 0 AS depth, {STEP} AS path FROM tree WHERE parent_id = ''
 UNION ALL SELECT t.doc_id, t.id, t.kind, t.expanded, depth + 1, path || '/' || printf('%010d', t.ord) || '~' || t.id FROM tree t JOIN wk ON wk.doc_id = t.doc_id AND t.parent_id = wk.id
  WHERE NOT (wk.kind = 'group' AND NOT wk.expanded))""", recursive=True) + "SELECT doc_id, id, depth::INT AS depth, path FROM wk")
def walk_tree(spark, sf):
    return ly.walk_tree(fixtures.tree(spark, sf))


_OWN = """up AS (SELECT doc_id, id, id AS cur, kind AS ck, parent_id AS nxt FROM tree
 UNION ALL SELECT up.doc_id, up.id, t.id, t.kind, t.parent_id FROM up JOIN tree t ON t.doc_id = up.doc_id AND t.id = up.nxt WHERE up.ck <> 'image'),
own AS (SELECT doc_id, id, max(CASE WHEN ck = 'image' THEN cur END) AS image_id FROM up GROUP BY ALL)"""


@query("owning_image", duck.with_(TREE, _OWN, recursive=True) + "SELECT * FROM own")
def owning_image(spark, sf):
    return ly.owning_image(fixtures.tree(spark, sf))


# Every document selects its range rows with an even key; document 4 selects nothing.
@query("correction_targets", duck.with_(TREE, _OWN, """
dir AS (SELECT DISTINCT o.doc_id, o.image_id FROM own o JOIN tree s ON s.doc_id=o.doc_id AND s.id=o.id JOIN tree i ON i.doc_id=o.doc_id AND i.id=o.image_id
  WHERE s.kind = 'range' AND s.ord % 2 = 0 AND s.doc_id <> 4 AND i.visible)""", recursive=True) + """
SELECT * FROM dir UNION ALL SELECT doc_id, id FROM tree WHERE kind = 'image' AND visible AND doc_id NOT IN (SELECT doc_id FROM dir)""")
def correction_targets(spark, sf):
    tree = fixtures.tree(spark, sf)
    return ly.correction_targets(tree, tree.filter("kind = 'range' and ord % 2 = 0 and doc_id <> 4").select("doc_id", "id"))


@query("sync_ranges", duck.with_(TREE, """
ix AS (SELECT *, CASE WHEN kind = 'range' THEN ord % 4 ELSE -1 END AS ri, kind || ' ' || id AS nm FROM tree),
want AS (SELECT doc_id, id AS image, i AS idx, CASE WHEN i = 1 THEN '' ELSE 'ink ' || i END AS nm, i <> 2 AS visible FROM tree, (SELECT unnest(range(0,4)) AS i) WHERE kind = 'image' AND i < 3 + doc_id % 2),
gr AS (SELECT doc_id, parent_id AS image, arg_min(id, ord) AS gid FROM tree WHERE kind = 'group' GROUP BY ALL),
kd AS (SELECT doc_id, parent_id, ri, arg_max(id, ord) AS id FROM ix WHERE kind = 'range' GROUP BY ALL)""") + """
SELECT doc_id, id, parent_id, kind, ri::INT AS range_index, nm AS name, visible FROM ix WHERE kind <> 'range' OR (doc_id, parent_id) NOT IN (SELECT doc_id, gid FROM gr)
UNION ALL SELECT w.doc_id, coalesce(kd.id, gid || ':' || idx), gid, 'range', idx::INT, CASE WHEN w.nm <> '' THEN w.nm ELSE 'Range ' || (idx+1) END, visible
 FROM want w JOIN gr ON gr.doc_id=w.doc_id AND gr.image=w.image LEFT JOIN kd ON kd.doc_id=w.doc_id AND kd.parent_id=gid AND kd.ri=idx""")
def sync_ranges(spark, sf):
    tree = fixtures.tree(spark, sf)
    indexed = tree.withColumns({
        "range_index": F.when(F.col("kind") == "range", F.col("ord") % 4).otherwise(-1).cast("int"),
        "name": F.concat_ws(" ", "kind", "id"),
    })
    want = tree.filter("kind = 'image'").select("doc_id", F.col("id").alias("image"), F.explode(F.sequence(F.lit(0), F.lit(2) + F.col("doc_id") % 2)).alias("idx"))
    want = want.withColumns({"name": F.when(F.col("idx") == 1, "").otherwise(F.concat(F.lit("ink "), "idx")), "visible": F.col("idx") != 2})
    return ly.sync_ranges(indexed, want)


_LAYERS = ((0, "top", 0, True, 5, 40), (0, "mid", 1, True, -3, 10), (0, "off", 2, False, 0, 0), (0, "base", 3, True, 0, 0))
_OVER = ", ".join(f"CASE WHEN oa <= 0 THEN 0 ELSE {duck.rint(f'(n{c}*sa + {c}*da*(1-sa))/oa')} END AS {c}" for c in "rgb")


# The grid three times: full, shifted with a position-dependent alpha, and a hidden copy.
def _layer_step(i: int, prev: str) -> str:
    return f"""b{i} AS (SELECT y, x, {_OVER}, {duck.rint('oa*255')} AS a FROM (SELECT *, sa + da*(1-sa) AS oa FROM (
  SELECT p.y, p.x, p.r, p.g, p.b, p.a/255::DOUBLE AS da, coalesce(q.r,0) AS nr, coalesce(q.g,0) AS ng, coalesce(q.b,0) AS nb, coalesce(q.a,0)/255::DOUBLE AS sa FROM {prev} p LEFT JOIN s{i} q ON q.y=p.y AND q.x=p.x)))"""


def _layer_src(i: int, dx: int, dy: int, k: int) -> str:
    al = f"((x*{k} + y*7) % 256)" if k else "255"
    return f"s{i} AS (SELECT y+({dy}) AS y, x+({dx}) AS x, {', '.join(duck.rint(f'{c}*al/255::DOUBLE') + f' AS {c}' for c in 'rgb')}, {duck.rint('al*al/255::DOUBLE')} AS a FROM (SELECT *, {al} AS al FROM grid))"


@query("stack_composite", duck.with_(GRID, _layer_src(1, 0, 0, 0), _layer_src(2, -3, 10, 31), _layer_src(3, 5, 40, 17), """
cv AS (SELECT y, x, 0::DOUBLE AS r, 0::DOUBLE AS g, 0::DOUBLE AS b, 0::DOUBLE AS a FROM (SELECT DISTINCT y, x FROM (SELECT y, x FROM s1 UNION SELECT y, x FROM s2 UNION SELECT y, x FROM s3)) WHERE x >= 0 AND x < (SELECT max(x) + 1 FROM grid) AND y >= 0 AND y < (SELECT max(y) + 1 FROM grid))""",
       _layer_step(1, "cv"), _layer_step(2, "b1"), _layer_step(3, "b2")) + "SELECT 0::INT AS doc_id, y::INT AS y, x::INT AS x, r::INT AS r, g::INT AS g, b::INT AS b, a::INT AS a FROM b3")
def stack_composite(spark, sf):
    g = fixtures.grid(spark, sf)
    copies = F.array(*[F.struct(F.lit(n).alias("id"), F.lit(k).alias("k")) for n, k in (("top", 17), ("mid", 31), ("off", 3), ("base", 0))])
    alpha = F.when(F.col("k") == 0, 255).otherwise((F.col("x") * F.col("k") + F.col("y") * 7) % 256).cast("int")
    px = g.select(F.col("image_id").alias("doc_id"), "y", "x", "r", "g", "b", F.inline(copies)).withColumn("a", alpha).drop("k")
    table = spark.createDataFrame([(*row, 1.0) for row in _LAYERS], "doc_id int, id string, ord int, visible boolean, x int, y int, scale double")
    return ly.stack_composite(table, px)


@query("sample_pixels", duck.with_(GRID, duck.lab_cte("gl", "grid"), f"""
lb AS (SELECT *, {common.nearest_sql(common.CENTERS, common.WEIGHTS, 'lab_l', 'lab_a', 'lab_b')} AS label FROM gl),
rk AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY md5(y || ',' || x), y, x) AS k FROM lb)""") + f"""
SELECT image_id, y, x, label, r, g, b, {duck.q('lab_l')} AS lab_l, {duck.q('lab_a')} AS lab_a, {duck.q('lab_b')} AS lab_b FROM rk WHERE k <= 6000""")
def sample_pixels(spark, sf):
    from chromatile.operators.sample import sample_pixels as sample

    lab = assign.assign_nearest(fixtures.grid(spark, sf), common.CENTERS, common.WEIGHTS, keep_lab=True)
    out = sample(lab)
    return out.select("image_id", "y", "x", "label", "r", "g", "b", *[C.q(F.col(c)).alias(c) for c in ("lab_l", "lab_a", "lab_b")])


@query("flatten_lighting")
def flatten_lighting(spark, sf):
    return lighting.flatten_lighting(fixtures.grid(spark, sf))


@query("normalize_tone")
def normalize_tone(spark, sf):
    return lighting.normalize_tone(fixtures.grid(spark, sf))


@query("mosaic_cells")
def mosaic_cells(spark, sf):
    return mosaic.mosaic_cells(fixtures.grid(spark, sf), 900, 1)


@query("tessellate")
def tessellate(spark, sf):
    return mosaic.tessellate(fixtures.grid(spark, sf), "Crinkly", "left", "top")
