"""Operators against direct numpy or Python versions on small inputs."""

import random
import time

import numpy as np
import pytest
from conftest import plane, raster, to_array
from pyspark.sql import functions as F

from chromatile.operators import boxes as bx, cluster, fill, frame, regions, seams, stats, stencil
from chromatile.operators import raster as rs
from chromatile.operators.nearest import nearest_join
from chromatile.streaming import edits as ed

RNG = np.random.default_rng(7)


def pad(a, r):
    return np.pad(a, r, mode="edge")


def test_box_mean_across_blocks(spark):
    a = RNG.integers(0, 256, (13, 11)).astype(float)
    got = to_array(stencil.box_mean(plane(spark, a), 3, block=4), 13, 11, ("mean",))
    p = pad(a, 3)
    want = np.array([[p[y : y + 7, x : x + 7].mean() for x in range(11)] for y in range(13)])
    assert np.abs(got - want).max() < 1e-9


def test_sobel_across_blocks(spark):
    a = RNG.integers(0, 256, (9, 10)).astype(float)
    got = to_array(stencil.sobel(plane(spark, a), block=4), 9, 10, ("mag",))
    p = pad(a, 1)
    kx = np.array([[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]])
    want = np.array([[np.hypot((p[y : y + 3, x : x + 3] * kx).sum(), (p[y : y + 3, x : x + 3] * kx.T).sum()) for x in range(10)] for y in range(9)])
    assert np.abs(got - want).max() < 1e-9


@pytest.mark.parametrize("op,kx,ky,times", [("dilate", 4, 3, 1), ("erode", 3, 3, 2), ("dilate", 3, 3, 2)])
def test_morphology_across_blocks(spark, op, kx, ky, times):
    m = RNG.random((12, 9)) < (0.2 if op == "dilate" else 0.8)
    got = to_array(stencil.morphology(plane(spark, m, "mask", "boolean"), op, kx, ky, times, block=4), 12, 9, ("mask",))
    want = m.copy()
    for _ in range(times):
        nxt = want.copy()
        for y in range(12):
            for x in range(9):
                win = want[max(0, y - (ky - 1 - ky // 2)) : y + ky // 2 + 1, max(0, x - (kx - 1 - kx // 2)) : x + kx // 2 + 1]
                nxt[y, x] = win.any() if op == "dilate" else win.all()
        want = nxt
    assert (got.astype(bool) == want).all()


def flood(mask):
    seen, out = np.zeros_like(mask), []
    for y, x in zip(*np.nonzero(mask)):
        if seen[y, x]:
            continue
        stack, cells = [(y, x)], []
        seen[y, x] = True
        while stack:
            cy, cx = stack.pop()
            cells.append((cy, cx))
            for ny, nx in ((cy + 1, cx), (cy - 1, cx), (cy, cx + 1), (cy, cx - 1)):
                if 0 <= ny < mask.shape[0] and 0 <= nx < mask.shape[1] and mask[ny, nx] and not seen[ny, nx]:
                    seen[ny, nx] = True
                    stack.append((ny, nx))
        ys, xs = zip(*cells)
        out.append((min(xs), min(ys), max(xs) + 1, max(ys) + 1, len(cells)))
    return out


def test_connected_boxes_match_flood_fill(spark):
    m = RNG.random((40, 90)) < 0.55
    m[:, 5] = True  # a long vertical stroke: one chain of runs
    px = plane(spark, m, "mask", "boolean")
    got = regions.connected_boxes(px.filter("mask").drop("mask"), frame.dims(px), min_area=1, max_area=10**6, min_side=2)
    want = [
        b for b in flood(m)
        if b[2] - b[0] >= 2 and b[3] - b[1] >= 2 and 0.12 <= (b[2] - b[0]) / (b[3] - b[1]) <= 28
        and not (b[3] - b[1] > int(0.45 * 40) and b[2] - b[0] > int(0.45 * 90))
    ]
    assert sorted(tuple(r)[1:] for r in got.collect()) == sorted(want)


def greedy(items, gap):
    """One sequential pass over all boxes of an image."""
    items, used, out = sorted(items, key=lambda b: (b[1], b[0])), set(), []
    for i in range(len(items)):
        if i in used:
            continue
        used.add(i)
        x0, y0, x1, y1 = items[i]
        again = True
        while again:
            again = False
            for j in range(len(items)):
                if j in used:
                    continue
                a, b, c, d = items[j]
                if max(1, min(y1, d) - max(y0, b)) >= 0.45 * min(y1 - y0, d - b) and a <= x1 + gap and x0 <= c + gap:
                    x0, y0, x1, y1 = min(x0, a), min(y0, b), max(x1, c), max(y1, d)
                    used.add(j)
                    again = True
        out.append((x0, y0, x1, y1))
    return out


def test_merge_lines_equals_one_sequential_pass(spark):
    rnd = random.Random(3)
    items = []
    for _ in range(60):
        x, y = rnd.randrange(300), rnd.randrange(60)
        items.append((x, y, x + rnd.randrange(2, 12), y + rnd.randrange(2, 10)))
    df = spark.createDataFrame([(0, i, *b) for i, b in enumerate(items)], "image_id int, box_id int, x0 int, y0 int, x1 int, y1 int")
    got = sorted(tuple(r)[1:] for r in regions.merge_lines(df, 5).collect())
    assert got == sorted(greedy(sorted(set(items)), 5))


def test_undo_redo_chunks_equal_a_sequential_fold(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(900):
        user = 1 if rnd.random() < 0.6 else rnd.randrange(2, 6)  # one user holds most of the log
        action = rnd.choices(["set", "undo", "redo", "select"], [5, 4, 2, 1])[0]
        rows.append((user, i, i, action, rnd.randrange(4)))
    df = spark.createDataFrame(rows, "user_id long, s int, event_id long, action string, color int")
    df = df.withColumn("ts", F.timestamp_seconds("s")).drop("s")
    want = {}
    for user, _, _, action, color in rows:
        if action != "select":
            line, pos = want.get(user, ([], 0))
            undo, cur, redo = line[: max(0, pos - 1)], (line[pos - 1] if pos else None), line[pos:]
            if action == "set" and color != cur:
                undo, cur, redo = (undo + [cur] if cur is not None else undo)[-20:], color, []
            elif action == "undo" and undo:
                undo, cur, redo = undo[:-1], undo[-1], [cur] + redo
            elif action == "redo" and redo:
                undo, cur, redo = undo + [cur], redo[0], redo[1:]
            line = undo + ([cur] if cur is not None else []) + redo
            want[user] = (line, len(undo) + (cur is not None))
    got = {r.user_id: (r.current, r.undo_depth, r.timeline) for r in ed.undo_redo(df, chunk_rows=40).collect()}
    assert got == {u: (l[p - 1] if p else -1, max(0, p - 1), ",".join(map(str, l))) for u, (l, p) in want.items()}


def test_debounce_hot_user_over_buckets(spark):
    rnd = random.Random(2)
    t, rows = 0, []
    for i in range(400):
        t += rnd.choice([1, 5, 30, 200])
        rows.append((1 if i % 3 else 2, t, i, "set", i % 9))
    df = spark.createDataFrame(rows, "user_id long, s int, event_id long, action string, color int").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    got = sorted(r.event_id for r in ed.debounce(df, 20, bucket_seconds=60).collect())
    want = []
    for user in (1, 2):
        log = [r for r in rows if r[0] == user]
        want += [a[2] for a, b in zip(log, log[1:] + [None]) if b is None or b[1] - a[1] > 20]
    assert got == sorted(want)


def test_exact_percentiles(spark):
    v = RNG.normal(100, 30, 300).round(3)
    n = RNG.integers(1, 5, 300)
    df = spark.createDataFrame([(0, float(a), int(b)) for a, b in zip(v, n)], "k int, v double, n long")
    got = stats.exact_percentiles(df, ["k"], "v", "n", [0.0, 0.1, 0.5, 0.95, 1.0], 5.0).first()["p"]
    assert np.allclose(got, np.percentile(np.repeat(v, n), [0, 10, 50, 95, 100]), atol=1e-9)


def test_nearest_join_is_exact(spark):
    pts, goal = RNG.integers(0, 500, (80, 2)), RNG.integers(0, 60, (12, 2))
    p = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(pts)], "pid int, x double, y double")
    g = spark.createDataFrame([(i, i, float(a), float(b)) for i, (a, b) in enumerate(goal)], "ord int, id int, x double, y double")
    got = {r.pid: r.m["id"] for r in nearest_join(p, g, ["x", "y"], 3.0, 1000.0).collect()}
    d = ((pts[:, None, :] - goal[None]) ** 2).sum(-1)
    assert got == {i: int(k) for i, k in enumerate(d.argmin(1))}


def test_nearest_join_far_points_groups_and_ties(spark):
    """Points far outside the targets, two groups, targets that share a place, and a group without targets."""
    pts = np.concatenate([RNG.integers(-4000, 4000, (60, 3)), RNG.integers(0, 40, (20, 3))]).astype(float)
    goal = RNG.integers(0, 40, (50, 3)).astype(float)
    goal[25:30] = goal[:5]
    p = spark.createDataFrame([(i, i % 3, *map(float, v)) for i, v in enumerate(pts)], "pid int, g int, x double, y double, z double")
    t = spark.createDataFrame([(i, i, i % 2, *map(float, v)) for i, v in enumerate(goal)], "ord int, id int, g int, x double, y double, z double")
    got = {r.pid: r.m and r.m["id"] for r in nearest_join(p, t, ["x", "y", "z"], 2.0, 9000.0, ["g"]).collect()}
    for i, v in enumerate(pts):
        own = [k for k in range(len(goal)) if k % 2 == i % 3]
        assert got[i] == (min(own, key=lambda k: (((goal[k] - v) ** 2).sum(), k)) if own else None)


def test_silhouette(spark):
    pts, n, lab = RNG.normal(0, 10, (40, 3)), RNG.integers(1, 4, 40), RNG.integers(0, 3, 40)
    df = spark.createDataFrame([(0, int(c), int(l), *map(float, p)) for p, c, l in zip(pts, n, lab)], "image_id int, n long, label int, lab_l double, lab_a double, lab_b double")
    got = cluster.silhouette(df).first()["silhouette"]
    full, fl = np.repeat(pts, n, axis=0), np.repeat(lab, n)
    dist = np.sqrt(((full[:, None] - full[None]) ** 2).sum(-1))
    s = []
    for i in range(len(full)):
        own = (fl == fl[i]).sum()
        a = dist[i, fl == fl[i]].sum() / (own - 1) if own > 1 else 0.0
        b = min(dist[i, fl == c].mean() for c in set(fl) - {fl[i]})
        s.append((b - a) / max(a, b))
    assert abs(got - np.mean(s)) < 1e-9


def test_box_mask_with_a_pile_of_boxes(spark):
    rnd = random.Random(1)
    bs = [(0, i, x, y, x + rnd.randrange(1, 9), y + rnd.randrange(1, 9)) for i in range(50) for x, y in [(rnd.randrange(20), rnd.randrange(8))]]
    px = plane(spark, np.zeros((30, 40)))
    got = to_array(bx.box_mask(px, spark.createDataFrame(bs, "image_id int, box_id int, x0 int, y0 int, x1 int, y1 int"), 1), 30, 40, ("mask",))
    want = np.zeros((30, 40), bool)
    for _, _, x0, y0, x1, y1 in bs:
        want[max(0, y0 - 1) : y1 + 1, max(0, x0 - 1) : x1 + 1] = True
    assert (got.astype(bool) == want).all()


def curve(x, y, order):
    d, n = 0, 1 << order
    for k in range(order - 1, -1, -1):
        rx, ry = (x >> k) & 1, (y >> k) & 1
        d += 4**k * ((3 * rx) ^ ry)
        if ry == 0:
            if rx:
                x, y = n - 1 - x, n - 1 - y
            x, y = y, x
    return d


def test_frontier_fill(spark):
    a = RNG.integers(0, 256, (10, 12, 3))
    hole = np.zeros((10, 12), bool)
    hole[2:8, 3:10] = True
    px = raster(spark, a).drop("a")
    holes = spark.createDataFrame([(0, int(y), int(x)) for y, x in zip(*np.nonzero(hole))], "image_id int, y int, x int")
    got = {(r.y, r.x): (r.r, r.g, r.b) for r in fill.frontier_fill(px, holes).collect()}
    known, out, span = ~hole, a.astype(float), 4**4 - 1
    while not known.all():
        new = {}
        for y, x in zip(*np.nonzero(~known)):
            best, acc, total = (-1.0, None), np.zeros(3), 0.0
            for dy, dx in fill.NEIGHBOURS:
                ny, nx = y + dy, x + dx
                if 0 <= ny < 10 and 0 <= nx < 12 and known[ny, nx]:
                    w = 1 / (np.hypot(dy, dx) + 0.35) / (1 + 6 * abs(curve(x, y, 4) - curve(nx, ny, 4)) / span)
                    if w > best[0] + 1e-12:
                        best = (w, out[ny, nx])
                    acc, total = acc + w * out[ny, nx], total + w
            if total:
                new[y, x] = 0.86 * best[1] + 0.14 * acc / total
        for k, v in new.items():
            out[k], known[k] = v, True
    assert len(got) == hole.sum()
    assert all(np.abs(np.array(v) - np.rint(out[k])).max() <= 1 for k, v in got.items())


def test_hilbert_order_one(spark):
    df = spark.createDataFrame([(x, y) for y in range(2) for x in range(2)], "x int, y int")
    got = {(r.y, r.x): r.d for r in rs.hilbert_index(df, 1).collect()}
    assert [[got[0, 0], got[0, 1]], [got[1, 0], got[1, 1]]] == [[0, 3], [1, 2]]


def test_shift_search_recovers_a_roll(spark):
    base = np.add.outer(np.zeros(24), 127 + 100 * np.sin(np.arange(40) * 2 * np.pi / 40))
    arr = np.repeat(base[..., None], 3, axis=2).round().astype(int)
    cost = lambda a: seams.seam_mismatch(raster(spark, a), True, False).first()["cost"]
    shift = seams.best_shift(raster(spark, arr), "x").first()["shift"]
    assert cost(np.roll(arr, shift, axis=1)) <= cost(arr) + 1e-9


def _wrap_cost(a, h_on, v_on):
    """Plain wrap cost of an array (h, w, 3)."""
    h, w = a.shape[:2]
    terms = []
    for on, n, strip in ((h_on, w, lambda s: a[:, s]), (v_on, h, lambda s: a[s])):
        if on:
            band = max(1, min(8, max(1, n // 4)))
            d = strip(slice(0, band)) - strip(slice(n - band, n))
            raw = (d * d).mean(axis=(0, 1)).mean()
            terms.append(raw - (d.mean(axis=(0, 1)) ** 2).mean() + 0.15 * raw)
    if h_on and v_on:
        corners = np.array([a[0, 0], a[0, -1], a[-1, 0], a[-1, -1]])
        terms.append(corners.var(axis=0).mean())
    return float(np.mean(terms))


def _best_roll(a, axis):
    n = a.shape[axis]
    span = max(1, int(np.rint(n * 0.12)))
    cost = lambda s: round(_wrap_cost(np.roll(a, s, axis), axis == 1, axis == 0), 6)
    best = min(range(-span, span + 1), key=lambda s: (cost(s), abs(s), -s)) % n
    return best - n if best > n // 2 else best


@pytest.mark.parametrize("axis, size", [("x", (9, 431)), ("y", (367, 5)), ("x", (3, 2)), ("y", (1, 4))])
def test_shift_search_tries_every_roll(spark, axis, size):
    arr = RNG.integers(0, 256, (*size, 3))
    if max(size) > 300:  # the best roll is far beyond forty pixels
        n = 0 if axis == "y" else 1
        arr = np.roll(np.sort(arr, axis=n), 43, axis=n)
        arr = np.where(np.arange(arr.shape[n]).reshape((-1, 1, 1) if n == 0 else (1, -1, 1)) < 43, 255 - arr, arr)
    got = seams.best_shift(raster(spark, arr), axis).first()["shift"]
    assert got == _best_roll(arr.astype(float), 0 if axis == "y" else 1)


def test_plan_crop_of_wrap_windows(spark):
    images = {0: RNG.integers(0, 256, (31, 26, 3)), 1: np.tile(RNG.integers(0, 256, (1, 1, 3)), (12, 10, 1)), 2: RNG.integers(0, 256, (40, 1, 3))}
    rows = [(k, y, x, *map(int, a[y, x])) for k, a in images.items() for y in range(a.shape[0]) for x in range(a.shape[1])]
    px = spark.createDataFrame(rows, "image_id int, y int, x int, r int, g int, b int")
    got = {r.image_id: (r.x, r.y, r.zoom) for r in seams.plan_crop(px, "left", "top", tile=False).collect()}
    assert got[1] == (0, 0, 1.0)  # wraps already
    assert got[2] == (0, 0, 1.0)  # no window of two columns
    a = images[0].astype(float)
    found = []
    for zi, z in enumerate((1.0, 1.08, 1.16, 1.25)):
        ch, cw = (max(1, min(n, int(np.rint(n / z)))) for n in a.shape[:2])
        for y0 in _origins(a.shape[0] - ch):
            for x0 in _origins(a.shape[1] - cw):
                cost = round(_wrap_cost(a[y0 : y0 + ch, x0 : x0 + cw], True, True) + 0.02 * (z - 1) * 255 * 255, 6)
                found.append((cost, zi, y0, x0, z, ch, cw))
    _, _, y0, x0, z, ch, cw = min(found)
    work = a[y0 : y0 + ch, x0 : x0 + cw]
    x, y = x0 - _best_roll(work, 1), y0 - _best_roll(work, 0)
    assert got[0] == (max(0, min(x, a.shape[1] - cw)), max(0, min(y, a.shape[0] - ch)), z)


def _origins(top):
    if top <= 0:
        return [0]
    count = min(7, top + 1)
    return [int(np.rint(i * (top / (count - 1)))) for i in range(count)]


@pytest.mark.parametrize("rows, missing", [(5, ()), (16, ()), (100, ()), (200, (3, 70, 199))])
def test_correlation_in_pieces(spark, monkeypatch, rows, missing):
    monkeypatch.setattr(seams, "PIECE", 16)
    rng = np.random.default_rng(rows)
    signals = {i: rng.normal(size=rows) for i in range(3)}
    for v in signals.values():
        v[list(missing)] = 0.0
    hi = max(5, rows // 2)
    table = [(i, k, float(x), hi) for i, v in signals.items() for k, x in enumerate(v) if k not in missing]
    got = {(r.image_id, r.lag): r.dot for r in seams._products(spark.createDataFrame(table, "image_id int, pos int, v double, hi int")).collect()}
    for i, v in signals.items():
        for lag in range(min(hi, rows - len([m for m in missing if m == rows - 1]))):
            assert got[i, lag] == pytest.approx(float(v[: rows - lag] @ v[lag:]), abs=1e-9)
    assert max(lag for _, lag in got) < hi


def test_period_of_a_long_image(spark, monkeypatch):
    monkeypatch.setattr(seams, "PIECE", 32)
    motif = np.random.default_rng(1).integers(0, 256, (37, 1, 3))
    tall = np.tile(motif, (12, 2, 1))[:430]
    assert seams.axis_period(raster(spark, tall, motif), "y").orderBy("image_id").collect() == [(0, 37), (1, 37)]


def test_pixel_tables_never_pass_the_driver(spark):
    rows = spark.range(200_000).select(F.lit(0).alias("image_id"), F.col("id").cast("int").alias("y"), F.lit(0).alias("x"))
    on = fill.materialize(rows, "on")
    joined = fill.by_pixel(on, on.select(*fill.KEYS), how="left_semi")
    assert joined.count() == 200_000
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" in plan(on.join(on.select(*fill.KEYS), fill.KEYS, "left_semi")) and "Broadcast" not in plan(joined)


@pytest.mark.parametrize("low", [2, 3])
def test_merge_lines_of_a_tall_image(spark, low):
    rnd = random.Random(low)
    items = set()
    for _ in range(400):
        x, y = rnd.randrange(60), rnd.randrange(3000)
        items.add((x, y, x + rnd.randrange(2, 12), y + rnd.randrange(low, 25)))
    df = spark.createDataFrame([(0, *b) for b in items], "image_id int, x0 int, y0 int, x1 int, y1 int")
    got = sorted(tuple(r)[1:] for r in regions.merge_lines(df, 5).collect())
    assert got == sorted(greedy(sorted(items), 5))


def test_a_line_meets_only_boxes_near_it():
    """Growth of 60,000 boxes in one column: quadratic passes would take hours."""
    rnd = random.Random(1)
    rows = [(0, rnd.randrange(50), y, 0, 0) for y in range(0, 180_000, 3)]
    pdf = regions.pd.DataFrame([(i, x, y, x + 5, y + 4) for i, x, y, _, _ in rows], columns=["image_id", "x0", "y0", "x1", "y1"])
    start = time.monotonic()
    assert len(regions._grow_lines(pdf, 5)) > 20_000
    assert time.monotonic() - start < 60
