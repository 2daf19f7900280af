"""Small cases of faults that reviews found."""

import numpy as np
from conftest import raster

from chromatile.operators import boxes, fill, frame, nearest, paint
from chromatile.operators import raster as rs
from chromatile.session import materialize


def test_ladder_keeps_a_saturation_just_over_one(spark):
    colors = raster(spark, [[(255, 200, 57), (255, 65, 27)]])
    rows = paint.color_ramps(colors.select("x", "r", "g", "b")).filter("ramp = 'ladder'").collect()
    got = {(r.x, r.step): (r.r, r.g, r.b) for r in rows}
    # Both have a channel halfway between two bytes, which goes to the even one.
    assert got[0, 5] == (255, 196, 41) and got[1, 2] == (255, 196, 184)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_crops_do_not_pass_the_driver(spark):
    # Small files of many rows: planned by file size they were broadcast.
    pixels = materialize(raster(spark, *[np.full((12, 9, 3), 7 * i) for i in range(3)]), "pixels")
    marks = materialize(spark.createDataFrame([(i, i, 2, 3, 5, 6) for i in range(3)], "image_id int, box_id int, x0 int, y0 int, x1 int, y1 int"), "marks")
    assert "Broadcast" not in plan(boxes.pixels_in_boxes(pixels, marks))
    assert "Broadcast" not in plan(fill.polygon_mask(pixels, fill.box_quads(marks), close=False))
    sized = frame.beside(pixels, materialize(frame.dims(pixels), "sizes"))
    assert "Broadcast" not in plan(sized)
    assert {(r.w, r.h) for r in sized.collect()} == {(9, 12)} and sized.count() == pixels.count()


def test_small_files_of_points_are_dealt_out(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(nearest, "TASK_POINTS", 10)
    monkeypatch.setattr(nearest, "materialize", lambda df, name="stage": seen.setdefault(name, plan(df)) and materialize(df, name))
    points = materialize(spark.range(60).selectExpr("0 as image_id", "int(id % 10) as x", "int(id / 10) as y").coalesce(1), "points")
    sites = spark.createDataFrame([(0, i, i, 4.0 * i, 3.0) for i in range(3)], "image_id int, ord int, id int, x double, y double")
    out = nearest.nearest_join(points, sites, ["x", "y"], 3.0, 20.0, ["image_id"])
    assert "REPARTITION_BY_NUM" in seen["nearest"]
    got = {(r.x, r.y): r.m.id for r in out.collect()}
    assert got == {(x, y): min(range(3), key=lambda i: ((4 * i - x) ** 2, i)) for x in range(10) for y in range(6)}


def test_blend_does_not_deal_whole_images(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(rs, "materialize", lambda df, name="stage": seen.append(plan(df)) or materialize(df, name))
    pixels = materialize(raster(spark, np.arange(90 * 80 * 3).reshape(90, 80, 3) ** 2 % 251), "pixels")
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "8k")  # stands for images over the usual limit
    rs.crinkly_blend(pixels, "left", "top").count()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
    assert not [p for p in seen if "SortMergeJoin" in p]


def test_reweight_ranges_does_not_shuffle_pixels(spark):
    """The packed model is written, so that its size is known and eight images are not eight tasks."""
    from chromatile import fixtures
    from chromatile.operators import ranges as rg
    from chromatile.plans import common
    from conftest import SF

    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "30000")
    try:
        labelled, _ = rg.reweight_ranges(common.labelled_px(spark, SF), common.px_ranges(spark, SF), 0, 0.7)
        text = plan(labelled)
    finally:
        spark.conf.set(limit, before)
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text
    assert labelled.count() == fixtures.px(spark, SF).count()


def test_sql_functions_stay_compiled(spark):
    """Inlined bodies make methods that the JVM would interpret; a limit of the user's that is lower stays."""
    from chromatile.functions import sql

    limit = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(limit)
    try:
        for given, kept in (("65535", 8000), ("4000", 4000)):
            spark.conf.set(limit, given)
            sql.register(spark)
            assert int(spark.conf.get(limit)) == kept
    finally:
        spark.conf.set(limit, before)


def test_ink_mask_meets_its_pixels_once(spark):
    """Ring levels and sides are written, so the last stage holds the sorts of one join."""
    from chromatile import fixtures
    from conftest import SF
    from pyspark.sql import functions as F

    b = fixtures.boxes(spark, SF).select("image_id", "box_id", "x0", "y0", (F.col("x0") + 12).alias("x1"), (F.col("y0") + 9).alias("y1"))
    assert plan(fill.ink_mask(fixtures.gray(spark, SF), b)).count("SortMergeJoin") == 1


def test_small_plans_and_tables_of_regions(spark, monkeypatch):
    """Lines of lines of lines: a plan in which every table stands once a use grows with the calls, not twelvefold by call."""
    from chromatile.operators import regions

    rows = [(0, x, y, x + 6, y + 8) for x in (0, 9, 60) for y in (0, 40)]
    given = spark.createDataFrame(rows, "image_id int, x0 int, y0 int, x1 int, y1 int")
    once = regions.merge_lines(given, 5)
    thrice = regions.merge_lines(regions.merge_lines(once, 5), 5)
    assert len(plan(thrice)) < 2 * len(plan(once))
    want = [(0, 0, 0, 15, 8), (0, 0, 40, 15, 48), (0, 60, 0, 66, 8), (0, 60, 40, 66, 48)]
    assert sorted(map(tuple, thrice.collect())) == want

    runs = materialize(spark.range(40).selectExpr("0 as image_id", "id", "int(id) as y", "0 as x0", "200 as x1"), "runs")
    edges = regions._run_edges(runs, ["image_id"])
    assert "Broadcast" not in plan(edges) and edges.count() == 39

    # Rounds of many edges meet by merge, those of few as planned; labels are the same.
    whole = regions.components(runs, edges, ["image_id"])
    seen = []
    monkeypatch.setattr(regions, "SMALL_ROUND", 0)
    monkeypatch.setattr(regions, "materialize", lambda df, name="stage": seen.append(plan(df)) or materialize(df, name))
    hinted = regions.components(runs, edges, ["image_id"])
    assert seen and not [p for p in seen[2:] if "Broadcast" in p]
    assert sorted(map(tuple, hinted.collect())) == sorted(map(tuple, whole.collect()))
    assert {r.root for r in hinted.select("root").distinct().collect()} == {hinted.first().root}
