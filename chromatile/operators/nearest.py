"""Exact nearest-neighbour join over square cells."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from chromatile.functions.color import dist2, q
from chromatile.session import materialize

# Cells of one level that make up a cell of the next one, per axis.
FACTOR = 4
# Slack of a bound against rounding; compared distances have six decimals.
SLACK = 1e-5
# Points a task looks up: each is copied to the cells around it and sorted there.
TASK_POINTS = 100_000


def nearest_join(
    points: DataFrame,
    targets: DataFrame,
    axes: Sequence[str],
    side: float,
    span: float,
    group: Sequence[str] = (),
) -> DataFrame:
    """For each point row, the nearest target: ``(points columns, m struct(d2, ord, id))``.

    ``points`` has unique rows with ``axes`` columns; ``targets`` has ``axes``,
    ``ord`` (tie order) and ``id``.  Rows meet only inside the same ``group``.

    Points and targets first meet in cells of ``side``, on the cells around the point.
    A hit closer than one side cannot be beaten from outside them, so it is final.
    The other points go down a tree of occupied cells, from cells of about ``span``: a
    cell is left when its near edge is farther than the one target that stands for
    some other cell.  The result is exact, and a point meets only cells near its answer.
    """
    axes, group, side = list(axes), list(group), float(side)
    t, c = [[f"_{k}{i}" for i in range(len(axes))] for k in "tc"]
    # Targets at one place are one target: the first of them.
    goal = targets.select(*group, "ord", "id", *[F.col(a).cast("double").alias(n) for a, n in zip(axes, t)])
    goal = goal.groupBy(*group, *t).agg(F.min(F.struct("ord", "id")).alias("_m")).withColumn("_g", F.lit(0))
    goal = materialize(goal, "targets")
    found = F.min(F.when(F.col("_m").isNotNull(), F.struct(_distance(axes, t).alias("d2"), "_m.ord", "_m.id"))).alias("m")

    # A small file of many points would be one task; dealt by the point, the aggregate needs no shuffle of its own.
    around = points.repartition(max(1, math.ceil(points.count() / TASK_POINTS)), *points.columns)
    for a, n in zip(axes, c):
        at = F.floor(F.col(a) / F.lit(side))
        around = around.withColumn(n, F.explode(F.sequence(at - 1, at + 1)))
    home = goal.drop("_g").withColumns(_cells(t, c, side))
    tried = around.join(home, [*group, *c], "left").groupBy(*points.columns).agg(found)
    tried = materialize(tried.withColumn("_g", F.lit(0)), "nearest")
    sure = F.coalesce(F.col("m.d2") < F.lit(side**2), F.lit(False))
    out, todo = tried.filter(sure).drop("_g"), tried.filter(~sure).drop("m")
    if todo.limit(1).count() == 0:
        return out
    levels = max(0, math.ceil(math.log(max(1.0, span / side), FACTOR) - 1e-9))
    at_leaf = _descend(todo, points.columns, goal, axes, group, [side * FACTOR**k for k in range(levels + 1)])
    leaf = goal.withColumns(_cells(t, [f"_p{i}" for i in range(len(axes))], side))
    rest = at_leaf.join(leaf, [*group, "_g", *[f"_p{i}" for i in range(len(axes))]], "left").groupBy(*points.columns).agg(found)
    return out.unionByName(rest)


def _cells(coords: Sequence[str], names: Sequence[str], side: float) -> dict:
    return {n: F.floor(F.col(x) / F.lit(side)) for x, n in zip(coords, names)}


def _distance(axes: Sequence[str], other: Sequence[str]):
    return q(dist2([F.col(a) for a in axes], [F.col(o) for o in other]), 6)


def _descend(points: DataFrame, columns: Sequence[str], goal: DataFrame, axes: list[str], group: list[str], sides: list[float]) -> DataFrame:
    """``(columns, _g, _p0..)``: for each point the cells of the lowest level that can hold its nearest target."""
    t, c, p = [[f"_{k}{i}" for i in range(len(axes))] for k in "tcp"]
    frontier, above = points, []
    for side in reversed(sides):
        parents = _cells(t, p, side * FACTOR) if above else {}
        cells = goal.withColumns(_cells(t, c, side) | parents).groupBy(*group, "_g", *above, *c).agg(F.min(F.struct(*t)).alias("_r"))
        kids = cells.groupBy(*group, "_g", *above).agg(F.collect_list(F.struct(*c, *[F.col(f"_r.{x}").alias(x) for x in t])).alias("_kids"))
        met = frontier.join(kids, [*group, "_g", *above], "left").select(*columns, "_g", F.inline_outer("_kids"))
        gaps = [F.greatest(F.col(n) * side - F.col(a), F.col(a) - (F.col(n) + 1) * side, F.lit(0.0)) for a, n in zip(axes, c)]
        met = met.withColumns({"_low": sum((g * g for g in gaps), F.lit(0.0)), "_high": dist2([F.col(a) for a in axes], [F.col(x) for x in t])})
        met = met.withColumn("_best", F.min("_high").over(Window.partitionBy(*columns)))
        near = met.filter(F.coalesce(F.col("_low") <= F.col("_best") + SLACK, F.lit(True)))
        frontier, above = near.select(*columns, "_g", *[F.col(n).alias(x) for n, x in zip(c, p)]), p
    return frontier
