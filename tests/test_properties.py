"""Properties of the operators on small synthetic rasters."""

import struct
import zlib

import numpy as np
import pytest
from conftest import SF, plane, raster, to_array
from pyspark.sql import functions as F

from chromatile import fixtures
from chromatile.functions.tone import apply_tone
from chromatile.operators import assign, bins, cluster, fill, frame, layers, lighting, mosaic, paint, ranges, regions, seams, stats, stencil
from chromatile.operators import raster as rs
from chromatile.session import scratch_path
from chromatile.sources import images, presets, sinks
from chromatile.streaming import edits as ed

RNG = np.random.default_rng(11)


def thirds():
    a = np.zeros((36, 54, 3), int)
    a[:, :18], a[:, 18:36], a[:, 36:] = (210, 40, 40), (40, 190, 60), (40, 60, 200)
    return np.clip(a + RNG.integers(-6, 7, a.shape), 0, 255)


def black_white():
    a = np.zeros((24, 32, 3), int)
    a[:, 16:] = 255
    return np.clip(a + RNG.integers(-4, 5, a.shape), 0, 255)


def test_auto_k_and_cluster_recovery(spark):
    px = raster(spark, thirds(), black_white())
    hist = stats.color_histogram(px)
    assert {r.image_id: r.k for r in cluster.choose_k(hist).collect()} == {0: 3, 1: 2}
    centers = cluster.kmeans_fit(hist, 3)
    lab = assign.assign_nearest(px, centers)
    block = lab.filter("image_id = 0 and x < 18").groupBy("label").count().orderBy(F.desc("count")).first()
    assert block["count"] > 0.95 * 36 * 18
    red = centers.filter("image_id = 0").orderBy(F.desc("lab_a")).first()["idx"]
    assert block["label"] == red


def test_transparent_pixels_and_tie_take_the_lowest_index(spark):
    px = raster(spark, np.array([[[10, 10, 10, 0], [10, 10, 10, 255]]]))
    same = [(5.0, 0.0, 0.0), (5.0, 0.0, 0.0)]
    got = {r.x: r.label for r in assign.assign_nearest(px, same).collect()}
    assert got == {0: -1, 1: 0}


def test_bins_are_right_closed_and_start_excludes(spark):
    px = raster(spark, np.array([[[v] * 3 for v in (20, 100, 150, 200)]]))
    got = {r.r: r.label for r in bins.label_bins(px, [80.0, 100.0, 200.0], "luma").collect()}
    assert got == {20: -1, 100: 0, 150: 1, 200: 1}
    flat = stats.color_histogram(raster(spark, np.full((3, 3, 3), 90)))
    assert len(bins.bin_edges(flat, 5).first()["edges"]) == 2


def test_insert_keeps_other_swatches_and_drop_never_empties(spark):
    hist = stats.color_histogram(raster(spark, thirds()))
    two = ranges.model_from_centers(cluster.kmeans_fit(hist, 2))
    grown = ranges.insert_range(hist, two)
    old = {r.idx: (r.match_r, r.match_g, r.match_b) for r in two.collect()}
    new = {r.idx: (r.match_r, r.match_g, r.match_b) for r in grown.collect()}
    assert len(new) == 3 and all(new[i] == c for i, c in old.items())
    assert abs(sum(r.weight for r in grown.collect()) - 1) < 1e-9
    one = ranges.drop_range(ranges.drop_range(two, 0), 0)
    assert one.count() == 1


def test_neutral_tone_is_identity_and_knobs_have_direction(spark):
    px = raster(spark, RNG.integers(20, 230, (8, 9, 3)))
    assert apply_tone(px, {"darks": 0.0}) is px
    mean = lambda df: df.agg(F.avg("r"), F.avg("g"), F.avg("b")).first()
    base = mean(px)
    assert mean(apply_tone(px, {"brightness": 0.3}))[0] > base[0]
    assert mean(apply_tone(px, {"darks": 0.8}))[0] < base[0]
    warm = mean(apply_tone(px, {"temperature": 0.5}))
    assert warm[0] - warm[2] > base[0] - base[2]


def test_tone_fit_recovers_the_grade(spark):
    px = raster(spark, RNG.integers(20, 230, (20, 24, 3)))
    fit = stats.tone_fit(px, apply_tone(px, {"darks": 0.4, "lights": -0.3})).first()
    assert fit["darks"] > 0.15 and fit["lights"] < -0.10


def test_tiled_motif_is_left_alone(spark):
    tiled = np.tile(RNG.integers(0, 256, (8, 8, 3)), (4, 5, 1))
    px = raster(spark, tiled)
    assert seams.axis_period(px, "x").first()["period"] == 8
    out = rs.tile_from_motif(px, "left", "top")
    assert (to_array(out, 32, 40) == tiled).all()


def test_blend_makes_edges_meet_and_keeps_size(spark):
    a = np.zeros((16, 24, 3), int)
    a[:, :12], a[:, 12:] = (200, 30, 30), (30, 30, 200)
    out = to_array(rs.crinkly_blend(raster(spark, a), "left", None), 16, 24)
    assert np.abs(out[:, 0] - out[:, -1]).max() <= 12
    assert rs.crinkly_blend(raster(spark, a), None, None).count() == 16 * 24


def test_resize_nearest_keeps_labels_a_partition(spark):
    a = RNG.integers(0, 4, (10, 13))
    out = rs.resize_to(plane(spark, a, "label", "int"), F.lit(29), F.lit(7), "nearest")
    assert out.count() == 29 * 7 and out.agg(F.max("label")).first()[0] <= 3
    want = a[np.floor((np.arange(7) + 0.5) * 10 / 7).astype(int)][:, np.floor((np.arange(29) + 0.5) * 13 / 29).astype(int)]
    assert (to_array(out, 7, 29, ("label",)) == want).all()


def test_crop_outside_is_transparent(spark):
    out = rs.crop_zoom(raster(spark, np.full((6, 8, 3), 90)), 4, 0, 1.0)
    assert out.count() == 48 and out.filter("a = 0 and x < 4").count() == 24


def test_tile_wall_covers_from_the_floor(spark):
    out = rs.tile_wall(raster(spark, np.full((8, 8, 3), 90)), 24, 20, 3, "half")
    assert out.agg(F.min("y"), F.max("y"), F.count("*")).first()[:] == (10, 19, 240)


def test_plates_fold_back_to_the_composite(spark):
    px = raster(spark, thirds())
    lab = assign.assign_nearest(px, [(50.0, 60.0, 40.0), (65.0, -55.0, 45.0), (35.0, 35.0, -65.0)])
    rg = spark.createDataFrame([(0, i, 10 * i, 20 * i, 30 * i, f"Ink {i}", True) for i in range(3)], "image_id int, idx int, repl_r int, repl_g int, repl_b int, name string, visible boolean")
    master = paint.exact_fill(lab, rg)
    path = sinks.write_plates(master, rg, scratch_path(spark, "plates"))
    back = spark.read.parquet(path)
    assert (to_array(back, 36, 54) == to_array(master, 36, 54)).all() and back.count() == 36 * 54
    hidden = rg.withColumn("visible", F.col("idx") != 1)
    assert sinks.plates(master, hidden).filter("idx = 1").count() == 0


def test_flatten_removes_a_ramp(spark):
    ramp = np.add.outer(np.linspace(60, 200, 24), np.zeros(20))[..., None].repeat(3, 2).round().astype(int)
    out = to_array(lighting.flatten_lighting(raster(spark, ramp)), 24, 20)
    assert np.ptp(out[..., 0]) < 0.35 * np.ptp(ramp[..., 0])


def test_mosaic_has_few_colours_and_keeps_size(spark):
    a = RNG.integers(0, 256, (24, 30, 3))
    out = mosaic.mosaic_cells(raster(spark, a), 60, 2, "left", None)
    assert out.count() == 24 * 30 and out.select("r", "g", "b").distinct().count() <= 60


def test_mode_and_side_aliases(spark):
    assert [mosaic.normalize_mode(m) for m in ("Detail mosaic", "Escher", "Crinkly", "Tile (repeating design)", None, "??")] == ["mosaic", "mesh", "hilbert", "tile", "tile", "tile"]
    px = raster(spark, np.zeros((4, 4, 3), int))
    assert mosaic.tessellate(px, "mesh", None, None) is px and mosaic.tessellate(px, "tile", "l", None, built=False) is px


def glyph():
    a = np.full((80, 120, 3), 40)
    for k in range(3):
        a[10:22, 10 + 10 * k : 16 + 10 * k] = 240
    return a


def test_detects_bright_glyphs_and_removes_them(spark):
    px = raster(spark, glyph())
    found = regions.detect_regions(px).collect()
    assert any(b.x0 <= 12 and b.y0 <= 12 and b.x1 >= 30 for b in found)
    inside = regions.detect_regions(px, roi=(0, 0, 60, 40)).collect()
    assert inside and all(b.x1 <= 60 and b.y1 <= 40 for b in inside)
    boxes = spark.createDataFrame([(0, 1, 9, 9, 37, 23)], "image_id int, box_id int, x0 int, y0 int, x1 int, y1 int")
    out = to_array(fill.remove_regions(px, boxes, "floral"), 80, 120)
    assert out[10:22, 10:36].max() < 120
    assert (out[40:] == glyph()[40:]).all()


def test_layers_composite_hides_and_scales(spark):
    one = raster(spark, np.full((4, 4, 3), 200)).withColumnRenamed("image_id", "doc_id")
    px = one.withColumn("id", F.lit("a")).unionByName(one.withColumn("r", F.lit(10)).withColumn("id", F.lit("b")))
    rows = [(0, "b", 0, True, 0, 0, 0.5), (0, "a", 1, True, 0, 0, 1.0)]
    schema = "doc_id int, id string, ord int, visible boolean, x int, y int, scale double"
    out = layers.stack_composite(spark.createDataFrame(rows, schema), px)
    assert out.filter("r = 10").count() == 4 and out.count() == 16
    rows[0] = (0, "b", 0, False, 0, 0, 0.5)
    assert layers.stack_composite(spark.createDataFrame(rows, schema), px).filter("r = 10").count() == 0


def test_owner_of_a_cycle_is_null(spark):
    rows = [(0, "i", "", 0, "image"), (0, "g", "i", 1, "group"), (0, "p", "q", 2, "range"), (0, "q", "p", 3, "range")]
    df = spark.createDataFrame(rows, "doc_id int, id string, parent_id string, ord int, kind string")
    assert {r.id: r.image_id for r in layers.owning_image(df).collect()} == {"i": "i", "g": "i", "p": None, "q": None}


def png(path, arr):
    h, w, c = arr.shape
    raw = b"".join(b"\0" + arr[y].astype("uint8").tobytes() for y in range(h))
    chunk = lambda t, b: struct.pack(">I", len(b)) + t + b + struct.pack(">I", zlib.crc32(t + b))
    head = struct.pack(">IIBBBBB", w, h, 8, 6 if c == 4 else 2, 0, 0, 0)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_image_files(spark, tmp_path):
    rgb, rgba = RNG.integers(0, 256, (5, 7, 3)), RNG.integers(0, 256, (4, 3, 4))
    png(tmp_path / "a.png", rgb)
    png(tmp_path / "b.png", rgba)
    (tmp_path / "bad.png").write_bytes(b"\x89PNG\r\n\x1a\nbroken")
    (tmp_path / "note.txt").write_text("x")
    px, rejects = images.scan_images(spark, str(tmp_path))
    px = px.cache()
    assert [r.reason for r in rejects.collect()] == ["not decodable"]
    assert (to_array(px.filter(F.col("image_id").endswith("a.png")), 5, 7) == rgb).all()
    assert (to_array(px.filter(F.col("image_id").endswith("b.png")), 4, 3, ("r", "g", "b", "a")) == rgba).all()
    ok, bad = images.image_headers(spark, str(tmp_path))
    assert sorted((r.width, r.height, r.channels) for r in ok.collect()) == [(3, 4, 4), (7, 5, 3)]
    assert sorted(r.reason for r in bad.collect()) == ["not decodable"]


def test_preset_documents_and_taken_ids(spark, tmp_path):
    (tmp_path / "p.json").write_text(
        '{"seeded_ids": [], "presets": [{"id": "a", "name": "One", "bands": [{"rgb": [300, -4, 5]}, {"name": "x", "rgb": [1, 2, 3]}]},'
        ' {"id": "b", "name": "Generic", "bands": []}, {"id": "c", "name": "Short", "bands": [{"rgb": [1, 2, 3]}]}]}'
    )
    p = presets.load_presets(spark, str(tmp_path / "p.json")).collect()
    assert len(p) == 1 and p[0].bands[0].rgb == [255, 0, 5]
    (tmp_path / "q.json").write_text('{"presets": [{"id": "a", "name": "Other", "bands": [{"rgb": [1, 1, 1]}, {"rgb": [1, 2, 3]}]}]}')
    both = presets.load_presets(spark, str(tmp_path)).collect()
    assert sorted(r.name for r in both) == ["One", "Other"] and len({r.document for r in both}) == 2
    stored = spark.createDataFrame([(0, "red-ink", "First"), (1, "red-ink-2", "Second")], "ord long, id string, name string")
    new = spark.createDataFrame([(0, "n1", "Red ink"), (1, "n1", "Red  Ink!")], "ord long, id string, name string")
    assert sorted(r.id for r in presets.upsert_presets(stored, new).collect()) == ["n1", "red-ink", "red-ink-2", "red-ink-3"]


def test_streams_equal_their_batch_twins(spark):
    stream = fixtures.edit_rows(ed.read_table_stream(spark, SF, "events"))
    rows = ed.run_available(ed.debounce_stream(stream, "2 hours"), "complete", "debounce")
    got = sorted(r.event_id for r in ed.newest(rows, ["user_id"]).collect())
    want = sorted(r.event_id for r in ed.debounce(fixtures.edits(spark, SF), 7200.0).collect())
    assert got == want


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_of_the_pixel_path(spark):
    px = fixtures.px(spark, SF)
    label = plan_of(assign.assign_nearest(paint.opaque_only(px), [(1.0, 2.0, 3.0), (4.0, 5.0, 6.0)]))
    assert "Exchange" not in label and "Join" not in label and "Python" not in label
    assert "PushedFilters" in label and "l_shipdate" not in label
    graded = plan_of(apply_tone(px, {"darks": 0.2, "saturation": 0.3}))
    assert "Exchange" not in graded and "Python" not in graded
    blurred = plan_of(stencil.box_mean(fixtures.gray(spark, SF), 4))
    assert "SinglePartition" not in blurred and "Python" not in blurred
    moved = plan_of(rs.seam_offset(fixtures.grid(spark, SF)))
    assert "Python" not in moved and "CartesianProduct" not in moved


def test_written_pixels_prune_partitions_and_rows(spark):
    path = images.write_pixels(raster(spark, np.zeros((6, 5, 3), int), np.ones((6, 5, 3), int)), scratch_path(spark, "px"))
    scan = images.scan_pixels(path, [1], 2, 4, spark)
    assert scan.count() == 10
    text = plan_of(scan)
    assert "PartitionFilters: [image_id" in text.replace("isnotnull(image_id", "image_id") or "image_id" in text.split("PartitionFilters")[1][:80]
    assert "GreaterThanOrEqual(y,2)" in text


@pytest.mark.parametrize("how", ["checker", "plate", "keep"])
def test_flatten_alpha(spark, how):
    px = raster(spark, np.full((2, 2, 4), 255))
    assert paint.checker_flatten(px, how).filter("a = 255").count() == 4
