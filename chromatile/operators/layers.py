"""Layer documents: tree walks, targets, range rows and compositing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from chromatile.operators import raster
from chromatile.session import materialize


def walk_tree(layers: DataFrame, root: str = "") -> DataFrame:
    """Visible tree rows ``(doc_id, id, depth, path)``; ordering by ``path`` is pre-order.

    One equi-join per tree level.  Children of collapsed groups are left out.  The
    order is a key rather than a rank, so no document is sorted in one task.
    """
    step = F.format_string("%010d", F.col("ord"))
    node = layers.select(
        "doc_id", "id", "parent_id", (~((F.col("kind") == "group") & ~F.col("expanded"))).alias("_open"), F.concat_ws("~", step, "id").alias("_step")
    )
    level = materialize(node.filter(F.col("parent_id") == root).select("doc_id", "id", "_open", F.lit(0).alias("depth"), F.col("_step").alias("path")), "level")
    out = level
    while level.limit(1).count() > 0:
        up = level.filter("_open").select("doc_id", F.col("id").alias("parent_id"), "depth", "path")
        level = node.join(up, ["doc_id", "parent_id"]).select(
            "doc_id", "id", "_open", (F.col("depth") + 1).alias("depth"), F.concat_ws("/", "path", "_step").alias("path")
        )
        level = materialize(level, "level")
        out = out.unionByName(level)
    return out.select("doc_id", "id", "depth", "path")


def owning_image(layers: DataFrame) -> DataFrame:
    """Nearest image of each node, itself included: ``(doc_id, id, image_id)`` or NULL.

    Parent pointers are doubled, so the rounds grow with the logarithm of the depth.
    A cycle never resolves and ends as NULL: once no open pointer has reached an end
    for as many rounds as the nodes have binary digits, only cycles are open.
    """
    is_image = F.col("kind") == "image"
    state = materialize(
        layers.select(
            "doc_id", "id",
            F.when(is_image, F.col("id")).alias("owner"),
            F.when(~is_image & (F.col("parent_id") != ""), F.col("parent_id")).alias("ptr"),
        ),
        "owners",
    )
    for _ in range(max(1, state.count()).bit_length() + 1):
        if state.filter("owner is null and ptr is not null").limit(1).count() == 0:
            break
        up = state.select("doc_id", F.col("id").alias("ptr"), F.col("owner").alias("_o"), F.col("ptr").alias("_p"))
        open_ = state.filter("owner is null and ptr is not null").drop("owner").join(up, ["doc_id", "ptr"], "left")
        moved = open_.select("doc_id", "id", F.col("_o").alias("owner"), F.when(F.col("_o").isNull(), F.col("_p")).alias("ptr"))
        state = materialize(state.filter("owner is not null or ptr is null").unionByName(moved), "owners")
    return state.select("doc_id", "id", F.col("owner").alias("image_id"))


def correction_targets(layers: DataFrame, selected: DataFrame) -> DataFrame:
    """Visible images that own the selected rows ``(doc_id, id)``; else the visible base layer."""
    images = layers.filter("kind = 'image'")
    shown = images.filter("visible").select("doc_id", F.col("id").alias("image_id"))
    owners = owning_image(layers).join(selected.select("doc_id", "id"), ["doc_id", "id"], "left_semi")
    direct = owners.select("doc_id", "image_id").join(shown, ["doc_id", "image_id"], "left_semi").distinct()
    direct = materialize(direct, "targets")
    base_first = F.when(F.col("role") == "base", 0).otherwise(1) if "role" in layers.columns else F.lit(1)
    base = images.groupBy("doc_id").agg(F.min(F.struct(base_first.alias("b"), "ord", "id", "visible")).alias("m"))
    rest = base.filter("m.visible").join(direct.select("doc_id").distinct(), "doc_id", "left_anti")
    return direct.unionByName(rest.select("doc_id", F.col("m.id").alias("image_id")))


def sync_ranges(layers: DataFrame, ranges: DataFrame) -> DataFrame:
    """Bring the range rows of each image in line with its range list.

    ``layers`` has ``range_index``; ``ranges`` is ``(doc_id, image, idx, name,
    visible)``.  Known indices keep their row id, new ones get an id derived from
    the group, rows without a range go away, everything else passes through.
    """
    groups = layers.filter("kind = 'group'").groupBy("doc_id", F.col("parent_id").alias("image")).agg(
        F.min(F.struct("ord", "id")).alias("g")
    )
    wanted = ranges.join(layers.filter("kind = 'image'").select("doc_id", F.col("id").alias("image")), ["doc_id", "image"], "left_semi")
    owners = wanted.select("doc_id", "image").distinct().join(groups, ["doc_id", "image"], "left")
    fresh = F.concat(F.col("image"), F.lit(":ranges"))
    owners = owners.select("doc_id", "image", F.coalesce("g.id", fresh).alias("group_id"), F.col("g").isNull().alias("_new"))
    kids = (
        layers.filter("kind = 'range'")
        .join(owners.select("doc_id", F.col("group_id").alias("parent_id")), ["doc_id", "parent_id"], "left_semi")
        .filter("range_index >= 0")
        .groupBy("doc_id", "parent_id", "range_index")
        .agg(F.max_by("id", "ord").alias("id"))
    )
    names = F.when(F.trim("name") != "", F.col("name")).otherwise(F.concat(F.lit("Range "), F.col("idx") + 1))
    new_kids = (
        wanted.join(owners, ["doc_id", "image"])
        .join(kids.select("doc_id", F.col("parent_id").alias("group_id"), F.col("range_index").alias("idx"), F.col("id").alias("_old")), ["doc_id", "group_id", "idx"], "left")
        .select(
            "doc_id", F.coalesce("_old", F.concat_ws(":", "group_id", "idx")).alias("id"), F.col("group_id").alias("parent_id"),
            F.lit("range").alias("kind"), F.col("idx").alias("range_index"), names.alias("name"), "visible",
        )
    )
    made = owners.filter("_new").select(
        "doc_id", F.col("group_id").alias("id"), F.col("image").alias("parent_id"), F.lit("group").alias("kind"),
        F.lit(-1).alias("range_index"), F.lit("Color ranges").alias("name"), F.lit(True).alias("visible"),
    )
    gone = owners.select("doc_id", F.col("group_id").alias("parent_id"))
    ranges_left = layers.filter("kind = 'range'").join(gone, ["doc_id", "parent_id"], "left_anti")
    others = layers.filter("kind <> 'range'").unionByName(ranges_left).select(*new_kids.columns)
    return others.unionByName(made).unionByName(new_kids)


def stack_composite(layers: DataFrame, layer_pixels: DataFrame) -> DataFrame:
    """Paint visible layers bottom to top onto a clear canvas: ``(doc_id, y, x, r, g, b, a)``.

    The canvas of a document is as large as its lowest visible layer.

    ``layers`` is ``(doc_id, id, ord, visible, x, y, scale)`` with ``ord`` 0 in front;
    ``layer_pixels`` is keyed by ``(doc_id, id)``.  Placing a layer is a projection;
    one aggregate on the canvas pixel gathers its (at most one per layer) samples
    and a fold blends them.  A layer is weighted by its own alpha when placed, so a
    half-transparent sample counts twice, as when pasting through its own mask.
    """
    shown = layers.filter("visible").select("doc_id", "id", "ord", F.col("x").alias("_dx"), F.col("y").alias("_dy"), F.col("scale").alias("_sc"))
    px = layer_pixels.join(shown, ["doc_id", "id"])
    plain = F.abs(F.col("_sc") - 1.0) <= 1e-4
    same = px.filter(plain).select("doc_id", "ord", "_dx", "_dy", "y", "x", "r", "g", "b", "a")
    grown = px.filter(~plain)
    sizes = grown.groupBy("doc_id", "id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    target = lambda n: F.greatest(F.lit(1), F.rint(F.col(n) * F.col("_sc")).cast("int"))
    big = grown.join(sizes, ["doc_id", "id"]).select(
        F.struct("doc_id", "id").alias("image_id"), "y", "x", "r", "g", "b", "a", "ord", "_dx", "_dy", "w", "h", target("w").alias("_nw"), target("h").alias("_nh")
    )
    big = raster.push_bilinear(big, "w", "h", F.col("_nw"), F.col("_nh"), ["r", "g", "b", "a"], ["ord", "_dx", "_dy", "w", "h", "_nw", "_nh"])
    moved = same.unionByName(big.select("image_id.doc_id", "ord", "_dx", "_dy", "y", "x", "r", "g", "b", "a"))
    pre = lambda c: F.rint(F.col(c) * F.col("a") / 255.0)
    placed = moved.select(
        "doc_id", (F.col("x") + F.col("_dx")).alias("x"), (F.col("y") + F.col("_dy")).alias("y"),
        F.struct((-F.col("ord")).alias("o"), *[pre(c).alias(c) for c in ("r", "g", "b", "a")]).alias("s"),
    )
    base = shown.groupBy("doc_id").agg(F.max_by(F.struct("id", "_sc"), F.struct("ord", "id")).alias("_b")).select("doc_id", "_b.*")
    canvas = layer_pixels.join(base, ["doc_id", "id"]).groupBy("doc_id", "_sc").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    canvas = canvas.select("doc_id", *[F.when(F.abs(F.col("_sc") - 1.0) <= 1e-4, F.col(n)).otherwise(target(n)).alias(f"_{n}") for n in ("w", "h")])
    placed = placed.join(canvas, "doc_id").filter((F.col("x") >= 0) & (F.col("x") < F.col("_w")) & (F.col("y") >= 0) & (F.col("y") < F.col("_h")))
    per = placed.groupBy("doc_id", "y", "x").agg(F.sort_array(F.collect_list("s")).alias("ss"))
    clear = F.struct(*[F.lit(0.0).alias(c) for c in ("r", "g", "b", "a")])

    def over(acc: Column, s: Column) -> Column:
        sa, da = s["a"] / 255.0, acc["a"] / 255.0
        out = sa + da * (1.0 - sa)
        mix = lambda c: F.when(out <= 0, F.lit(0.0)).otherwise(F.rint((s[c] * sa + acc[c] * da * (1.0 - sa)) / out))
        return F.struct(*[mix(c).alias(c) for c in ("r", "g", "b")], F.rint(out * 255.0).alias("a"))

    done = per.withColumn("p", F.aggregate("ss", clear, over))
    return done.select("doc_id", "y", "x", *[F.col(f"p.{c}").cast("int").alias(c) for c in ("r", "g", "b", "a")])
