"""Joins by position on a page: nearest, within a distance, inside a rectangle, grid places; hashed into cells, never crossed.

Every join has the page as an equi key and a cell of the plane, so that a page with a third of all rows is spread by its cells.
Ties go to the smaller sequence number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cells(c: Column, size: float) -> Column:
    return F.floor(c / size).cast("long")


def within(points: DataFrame, others: DataFrame, page: list[str], reach: float) -> DataFrame:
    """points (page, pid, x, y) and others (page, oid, ox, oy) at most `reach` apart, with `distance`."""
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    a = points.withColumn("_dx", F.explode(around)).withColumn("_dy", F.explode(around)).withColumn("_cx", cells(F.col("x"), reach) + F.col("_dx")).withColumn("_cy", cells(F.col("y"), reach) + F.col("_dy"))
    b = others.withColumn("_cx", cells(F.col("ox"), reach)).withColumn("_cy", cells(F.col("oy"), reach))
    x = a.join(b, [*page, "_cx", "_cy"]).withColumn("distance", F.hypot(F.col("x") - F.col("ox"), F.col("y") - F.col("oy")))
    return x.filter(F.col("distance") <= reach).drop("_dx", "_dy", "_cx", "_cy")


def nearest(points: DataFrame, others: DataFrame, page: list[str], reach: float, k: int = 1) -> DataFrame:
    """The k nearest others of each point within reach, with rank; the row filter on the rank prunes within the partitions already."""
    w = Window.partitionBy(*page, "pid").orderBy("distance", "oid")
    return within(points, others, page, reach).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def unambiguous(points: DataFrame, others: DataFrame, page: list[str], reach: float, gap: float) -> DataFrame:
    """The nearest other of each point whose runner-up is at least `gap` farther."""
    two = nearest(points, others, page, reach, 2)
    w = Window.partitionBy(*page, "pid").orderBy("rank")
    x = two.withColumn("next", F.lead("distance").over(w)).filter("rank = 1")
    return x.filter(F.col("next").isNull() | (F.col("next") - F.col("distance") >= gap)).drop("next", "rank")


def enclosing(points: DataFrame, rects: DataFrame, page: list[str], size: float) -> DataFrame:
    """The smallest rectangle (rid, x0, y0, x1, y1) around each point; a rectangle is listed in each cell it touches."""
    r = rects.withColumn("_cx", F.explode(F.sequence(cells(F.col("x0"), size), cells(F.col("x1"), size)))).withColumn("_cy", F.explode(F.sequence(cells(F.col("y0"), size), cells(F.col("y1"), size))))
    p = points.withColumn("_cx", cells(F.col("x"), size)).withColumn("_cy", cells(F.col("y"), size))
    x = p.join(r, [*page, "_cx", "_cy"]).filter("x between x0 and x1 and y between y0 and y1").withColumn("area", (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    w = Window.partitionBy(*page, "pid").orderBy("area", "rid")
    return x.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_cx", "_cy")


def spacing(axes: DataFrame, page: list[str]) -> DataFrame:
    """page, kind, gap: upper median of the gaps greater than 1 between neighbouring lines of a kind."""
    w = Window.partitionBy(*page, "kind").orderBy("at")
    g = axes.withColumn("gap", F.col("at") - F.lag("at").over(w)).filter("gap > 1").groupBy(*page, "kind").agg(F.sort_array(F.collect_list("gap")).alias("g"))
    return g.select(*page, "kind", F.element_at("g", (F.floor(F.size("g") / 2) + 1).cast("int")).alias("gap"))


def locate(points: DataFrame, axes: DataFrame, page: list[str]) -> DataFrame:
    """points (page, pid, x, y) and axes (page, kind letter/number, label, at, seq): pid, place, cost. Letters run along x, numbers along y; ties go to the axis drawn first.

    The axes of a page, a few dozen, travel as one sorted array per kind; no point is joined to every axis.
    """
    a = axes.groupBy(*page).agg(
        F.array_sort(F.collect_list(F.when(F.col("kind") == "letter", F.struct("seq", "label", "at")))).alias("letters"),
        F.array_sort(F.collect_list(F.when(F.col("kind") == "number", F.struct("seq", "label", "at")))).alias("numbers"),
    )
    s = spacing(axes, page).groupBy(*page).agg(F.max(F.when(F.col("kind") == "letter", F.col("gap"))).alias("lg"), F.max(F.when(F.col("kind") == "number", F.col("gap"))).alias("ng"))
    near = lambda c, v: F.array_min(F.transform(c, lambda t: F.struct(F.abs(t["at"] - v).alias("d"), t["seq"].alias("seq"), t["label"].alias("label"))))
    x = points.join(a, page).join(s, page, "left").withColumn("l", near("letters", F.col("x"))).withColumn("n", near("numbers", F.col("y")))
    cost = F.least(F.lit(1.0), (F.col("l.d") / F.coalesce("lg", F.lit(1.0)) + F.col("n.d") / F.coalesce("ng", F.lit(1.0))) / 2)
    ok = (F.size("letters") >= 2) & (F.size("numbers") >= 2)
    return x.select(*page, "pid", F.when(ok, F.concat_ws("-", "l.label", "n.label")).alias("place"), F.when(ok, cost).otherwise(1.0).alias("cost"))
