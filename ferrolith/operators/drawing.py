"""Drawn grids and read text: places by intersecting lines, suppression of concentric marks, connected runs of text, majority orientation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrolith.operators.spatial import within
from ferrolith.session import checkpoint

NEAREST = 6  # lines of a kind that are tried for a point
CROSS = 40.0  # how far from its end a line may be crossed
FAR = 300.0  # spacing of a line without a parallel


def line_spacing(lines: DataFrame, page: list[str]) -> DataFrame:
    """lines (page, lid, kind, label, orient, c, lo, hi) with gap: distance to the nearest parallel of its kind more than 1 away and beside it."""
    every = lines.groupBy(*page, "kind", "orient").agg(F.collect_list(F.struct("lid", "c", "lo", "hi")).alias("all"))
    beside = F.filter("all", lambda o: (o["lid"] != F.col("lid")) & (F.abs(o["c"] - F.col("c")) > 1) & (F.least(o["hi"], F.col("hi")) - F.greatest(o["lo"], F.col("lo")) > 0))
    gap = F.array_min(F.transform(beside, lambda o: F.abs(o["c"] - F.col("c"))))
    return lines.join(every, [*page, "kind", "orient"]).withColumn("gap", F.coalesce(gap, F.lit(FAR))).drop("all")


def locate_lines(points: DataFrame, lines: DataFrame, page: list[str], margin: float = 120.0) -> DataFrame:
    """points (page, pid, x, y): pid, place, cost by the pair of crossing lines, one of each kind, that is nearest in their spacings.

    A page's lines, a few dozen, travel as one array per kind: no point is joined to every line. Where nothing crosses, place is null and cost 1.
    """
    whole = F.struct("lid", "label", "orient", "c", "lo", "hi", "gap")
    ls = line_spacing(lines, page)
    a = ls.groupBy(*page).agg(*[F.array_sort(F.collect_list(F.when(F.col("kind") == k, whole))).alias(k) for k in ("letter", "number")])
    x = points.join(a, page)

    def near(kind: str) -> Column:
        perp = lambda t: F.abs(F.when(t["orient"] == "h", F.col("y")).otherwise(F.col("x")) - t["c"])
        along = lambda t: F.when(t["orient"] == "h", F.col("x")).otherwise(F.col("y"))
        able = F.filter(kind, lambda t: along(t).between(t["lo"] - margin, t["hi"] + margin))
        return F.slice(F.array_sort(F.transform(able, lambda t: F.struct(perp(t).alias("perp"), t["lid"].alias("lid"), t.alias("t")))), 1, NEAREST)

    x = x.withColumn("_l", near("letter")).withColumn("_n", near("number"))

    def covers(t: Column, v: Column) -> Column:
        return v.between(t["lo"] - CROSS, t["hi"] + CROSS)

    pairs = F.flatten(F.transform("_l", lambda p: F.transform(
        F.filter("_n", lambda q: (q["t"]["orient"] != p["t"]["orient"]) & covers(p["t"], q["t"]["c"]) & covers(q["t"], p["t"]["c"])),
        lambda q: F.struct((p["perp"] / p["t"]["gap"] + q["perp"] / q["t"]["gap"]).alias("cost"), p["lid"].alias("l"), q["lid"].alias("n"), F.concat_ws("-", p["t"]["label"], q["t"]["label"]).alias("place")))))
    x = x.withColumn("_b", F.array_min(pairs))
    return x.select(*page, "pid", F.col("_b.place").alias("place"), F.when(F.col("_b").isNull(), 1.0).otherwise(F.least(F.lit(1.0), F.col("_b.cost") / 2)).alias("cost"))


def suppress(marks: DataFrame, page: list[str], reach: float, size: str) -> DataFrame:
    """marks (page, pid, x, y, size) without those within `reach` of a greater one that is kept; equal sizes go by pid.

    In rounds over the pairs within reach: a mark with no greater undecided neighbour is kept, its neighbours go. As the order is
    total this is the sequential rule, for pages of any size.
    """
    m = marks.select(*page, "pid", "x", "y", size)
    o = m.select(*page, F.col("pid").alias("oid"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.col(size).alias("osize"))
    # an edge leads from a mark to a greater one close by
    edges = within(m, o, page, reach).filter((F.col("osize") > F.col(size)) | ((F.col("osize") == F.col(size)) & (F.col("oid") < F.col("pid")))).select(*page, "pid", "oid")
    edges, left, gone = checkpoint(edges), checkpoint(m.select(*page, "pid")), None
    kept = None
    while True:
        now = checkpoint(left.join(edges, [*page, "pid"], "left_anti"))
        if now.isEmpty():
            break
        kept = now if kept is None else kept.unionByName(now)
        gone = edges.join(now.select(*page, F.col("pid").alias("oid")), [*page, "oid"], "left_semi").select(*page, "pid").distinct()
        left = checkpoint(left.join(now, [*page, "pid"], "left_anti").join(gone, [*page, "pid"], "left_anti"))
        alive = left.select(*page, F.col("pid").alias("oid"))
        edges = checkpoint(edges.join(left, [*page, "pid"], "left_semi").join(alive, [*page, "oid"], "left_semi"))
    return marks if kept is None else marks.join(kept, [*page, "pid"], "left_semi")


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b): id, component, the smallest id it is connected with. Smallest labels of neighbours, with a jump to the label's label in each round, until nothing changes."""
    e = checkpoint(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    lab = checkpoint(e.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.min("a")).alias("component")))
    while True:
        via = e.join(lab, e.b == lab.id).groupBy("a").agg(F.min("component").alias("m"))
        new = lab.join(via, lab.id == via.a).select("id", F.least("component", "m").alias("c"), F.col("component").alias("old"))
        jump = lab.select(F.col("id").alias("c"), F.col("component").alias("far"))
        new = checkpoint(new.join(jump, "c").select("id", F.least("c", "far").alias("component"), "old"))
        lab = new.select("id", "component")
        if new.filter("component != old").isEmpty():
            return lab


def text_runs(lines: DataFrame, page: list[str], gap: float = 8.0, band: float = 3.0) -> DataFrame:
    """lines (page, pid, x0, x1, y): pid, run: fragments on one band, each beginning at most `gap` after another's end, are one run."""
    a = lines.select(*page, "pid", F.col("x1").alias("x"), "y")
    b = lines.select(*page, F.col("pid").alias("oid"), F.col("x0").alias("ox"), F.col("y").alias("oy"))
    e = within(a, b, page, gap + band).filter((F.col("ox") - F.col("x")).between(0, gap) & (F.abs(F.col("oy") - F.col("y")) <= band) & (F.col("pid") != F.col("oid")))
    c = components(e.select(F.col("pid").alias("a"), F.col("oid").alias("b")))
    return lines.select("pid").join(c, F.col("pid") == F.col("id"), "left").select("pid", F.coalesce("component", "pid").alias("run"))


def majority_orientation(marks: DataFrame, page: list[str]) -> DataFrame:
    """Marks (page, kind, orient, seq) of which letters have the page's most frequent orientation of letters (the first seen on ties) and numbers the other."""
    n = marks.filter("kind = 'letter'").groupBy(*page, "orient").agg(F.count("*").alias("c"), (-F.min("seq")).alias("f"))
    best = n.groupBy(*page).agg(F.max_by("orient", F.struct("c", "f")).alias("_o"))
    return marks.join(best, page).filter((F.col("kind") == "letter") == (F.col("orient") == F.col("_o"))).drop("_o")
