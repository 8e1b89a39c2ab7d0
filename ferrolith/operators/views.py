"""Views of a drawing page: titles and their spans, owners of callouts, lines that belong together, strips, stacks and boxes.

Every input names its page; joins have the page as an equi key and what's compared beside it, so that a page's titles, strokes
or strips, a few dozen, meet its callouts and no page meets another. Ties go to what was drawn first (the smaller id).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrolith.operators.drawing import components
from ferrolith.operators.matching import greedy
from ferrolith.operators.spatial import within

Page = list[str]


def best(rows: DataFrame, key: list[str], *order) -> DataFrame:
    """The first row of each key in an order; the filter on the rank prunes within the partitions already."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def largest(titles: DataFrame, page: Page, size: str, share: float = 0.9) -> DataFrame:
    """Titles of at least `share` of the page's greatest size; smaller ones are references to others."""
    return titles.withColumn("_m", F.max(size).over(Window.partitionBy(*page))).filter(F.col(size) >= share * F.col("_m")).drop("_m")


def body(marks: DataFrame, located: DataFrame, page: Page, width: float, height: float) -> DataFrame:
    """marks (page, pid, x, y) outside margin and title block, and those inside that a drawn view places (located: page, pid, place)."""
    margin = (F.col("x") > 0.82 * width) | ((F.col("x") > 0.60 * width) & (F.col("y") > 0.78 * height))
    seen = located.filter("place is not null").select(*page, "pid", F.lit(True).alias("_seen"))
    return marks.join(seen, [*page, "pid"], "left").filter(~margin | F.col("_seen")).drop("_seen")


def bubbles(tokens: DataFrame, lines: DataFrame, page: Page, across: float = 8.0, past: float = 60.0) -> DataFrame:
    """tokens (page, pid, x, y) that label the end of a grid line (page, lid, orient, c, lo, hi): beside its constant, past one of its ends."""
    v = F.col("orient") == "v"
    off = F.abs(F.when(v, F.col("x")).otherwise(F.col("y")) - F.col("c"))
    along = F.when(v, F.col("y")).otherwise(F.col("x"))
    ends = along.between(F.col("lo") - past, F.col("lo")) | along.between(F.col("hi"), F.col("hi") + past)
    hit = tokens.join(lines.select(*page, "orient", "c", "lo", "hi"), page).filter((off < across) & ends)
    return hit.select(*page, "pid").distinct()


# Words of the details of openings, whose bars aren't those of the slab.
OPENING = r"(?i)H\s*[&8]\s*B\b|HGB|REQUIS|QRT|OUVERTURE|D[ÉE]TAIL"


def spans(titles: DataFrame, strokes: DataFrame, page: Page, above: float = 400.0, least: float = 60.0) -> DataFrame:
    """page, title, lo, hi: the longest horizontal stroke (page, sid, y, lo, hi) above each title (page, title, x, y) that covers its centre and that of no other title of its row."""
    s = titles.join(strokes.filter(F.col("hi") - F.col("lo") >= least).withColumnRenamed("y", "sy"), page)
    s = s.filter(F.col("sy").between(F.col("y") - above, F.col("y") - 10) & F.col("x").between(F.col("lo"), F.col("hi")))
    rivals = titles.select(*page, F.col("title").alias("rival"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    crossed = s.join(rivals, page).filter((F.col("rival") != F.col("title")) & (F.abs(F.col("ry") - F.col("y")) < 60) & (F.col("rx") > F.col("lo")) & (F.col("rx") < F.col("hi")))
    free = s.join(crossed.select(*page, "title", "sid").distinct(), [*page, "title", "sid"], "left_anti")
    return best(free, [*page, "title"], (F.col("lo") - F.col("hi")), "sid").select(*page, "title", "lo", "hi")


def _row_below(callouts: DataFrame, titles: DataFrame, page: Page) -> DataFrame:
    """Callouts (page, pid, x, y) with each title (title, tx, ty) of the nearest row of titles below."""
    t = titles.select(*page, "title", F.col("x").alias("tx"), F.col("y").alias("ty"))
    x = callouts.join(t, page).filter(F.col("ty") > F.col("y") - 5)
    x = x.withColumn("_row", F.min("ty").over(Window.partitionBy(*page, "pid")))
    return x.filter(F.col("ty") - F.col("_row") < 60).drop("_row")


def owners(callouts: DataFrame, titles: DataFrame, extents: DataFrame, page: Page, slack: float = 25.0) -> DataFrame:
    """page, pid, title: the title of the row below whose span (spans()) holds the callout with some slack, by the nearest middle; outside all, by the nearest span (a hundredth of the distance to the title deciding)."""
    x = _row_below(callouts, titles, page).join(extents, [*page, "title"])
    inside = F.col("x").between(F.col("lo") - slack, F.col("hi") + slack)
    out = F.greatest(F.col("lo") - F.col("x"), F.col("x") - F.col("hi"), F.lit(0.0)) + 0.01 * F.abs(F.col("tx") - F.col("x"))
    middle = F.abs((F.col("lo") + F.col("hi")) / 2 - F.col("x"))
    x = x.withColumn("_in", F.when(inside, 0).otherwise(1)).withColumn("_d", F.when(inside, middle).otherwise(out))
    return best(x, [*page, "pid"], "_in", "_d", "title").select(*page, "pid", "title")


def wall_owners(callouts: DataFrame, titles: DataFrame, extents: DataFrame, page: Page) -> DataFrame:
    """page, pid, title: the nearest span of the row below; none where a title of the row has no span or two spans of it overlap, as the strokes found aren't the walls then."""
    x = _row_below(callouts, titles, page).join(extents, [*page, "title"], "left")
    w = Window.partitionBy(*page, "pid").orderBy("lo", "hi")
    x = x.withColumn("_bad", F.col("lo").isNull() | F.coalesce(F.col("lo") < F.lag("hi").over(w), F.lit(False)))
    x = x.withColumn("_bad", F.max("_bad").over(Window.partitionBy(*page, "pid"))).filter(~F.col("_bad"))
    return best(x, [*page, "pid"], F.greatest(F.col("lo") - F.col("x"), F.lit(0.0), F.col("x") - F.col("hi")), "title").select(*page, "pid", "title")


def paired(first: DataFrame, second: DataFrame, page: Page, dy: float = 16.0, dx: float = 40.0, below: bool = True) -> DataFrame:
    """first and second (page, pid, x, y; x the right edge): page, pid, oid of lines of the first kind with the first line of the second, in order of the page, that stands under it (or on either side) and that none before took."""
    e = within(first, second.select(*page, F.col("pid").alias("oid"), F.col("x").alias("ox"), F.col("y").alias("oy")), page, dx + dy)
    gap = F.col("oy") - F.col("y")
    ok = ((gap > 0) & (gap < dy)) if below else ((gap != 0) & (F.abs(gap) < dy))
    e = e.filter(ok & (F.abs(F.col("ox") - F.col("x")) < dx)).select(*page, "pid", "oid")
    order = [F.col("pid"), F.col("oid")] if below else [F.least("pid", "oid"), F.greatest("pid", "oid")]
    return greedy(e, [*page, "pid"], [*page, "oid"], order).select(*page, "pid", "oid")


def spacings(spacers: DataFrame, bars: DataFrame, page: Page, reach: float = 45.0) -> DataFrame:
    """page, pid, oid: each spacing line (page, pid, x, y, orient), in order, takes the nearest bar line of its orientation (page, pid, x, y, orient) less than `reach` away, across and along together, that none before took."""
    e = within(spacers, bars.select(*page, F.col("pid").alias("oid"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("orient").alias("oorient")), page, reach)
    e = e.withColumn("d", F.round(F.abs(F.col("ox") - F.col("x")) + F.abs(F.col("oy") - F.col("y")), 9)).filter((F.col("d") < reach) & (F.col("orient") == F.col("oorient")))
    return greedy(e.select(*page, "pid", "oid", "d"), [*page, "pid"], [*page, "oid"], [F.col("pid"), F.col("d")]).select(*page, "pid", "oid")


def strips(labels: DataFrame, page: Page) -> DataFrame:
    """page, label, x, lo, hi, pitch: mean place across and extent along of each label's instances (page, label, x, y), and the median gap of the page's strips, 120 if there is one only."""
    s = labels.groupBy(*page, "label").agg(F.avg("x").alias("x"), F.min("y").alias("lo"), F.max("y").alias("hi"))
    g = s.withColumn("_g", F.col("x") - F.lag("x").over(Window.partitionBy(*page).orderBy("x", "label")))
    return g.withColumn("pitch", F.coalesce(F.median("_g").over(Window.partitionBy(*page)), F.lit(120.0))).drop("_g")


def on_strips(bars: DataFrame, strips: DataFrame, page: Page) -> DataFrame:
    """page, pid, label: the nearest strip of each bar line along whose extent (60 more) it stands, at most 0.6 of the pitch away."""
    s = strips.select(*page, "label", F.col("x").alias("sx"), "lo", "hi", "pitch")
    x = bars.join(s, page).filter(F.col("y").between(F.col("lo") - 60, F.col("hi") + 60)).withColumn("d", F.round(F.abs(F.col("x") - F.col("sx")), 9))
    return best(x, [*page, "pid"], "d", "label").filter("d <= 0.6 * pitch").select(*page, "pid", "label")


def panels(lines: DataFrame, titles: DataFrame, page: Page) -> DataFrame:
    """page, pid, title: the panel's title nearest in height among those in whose box a line stands: 120 to the left, 230 to the right, 40 above, 640 below."""
    t = titles.select(*page, "title", F.col("x").alias("tx"), F.col("y").alias("ty"))
    dx, dy = F.col("x") - F.col("tx"), F.col("y") - F.col("ty")
    x = lines.join(t, page).filter((dx >= -120) & (dx < 230) & (dy >= -40) & (dy < 640))
    return best(x, [*page, "pid"], F.abs(dy), "title").select(*page, "pid", "title")


def stroke_beside(texts: DataFrame, strokes: DataFrame, page: Page) -> DataFrame:
    """page, pid, sid: the stroke (page, sid, orient, across, start, end) on the baseline side of each text (page, pid, orient, base, t0, t1): along half of it at least, 5 before to 9 behind its base, the least gap first."""
    x = texts.join(strokes, [*page, "orient"])
    lap = F.least("t1", "end") - F.greatest("t0", "start")
    x = x.withColumn("gap", F.col("across") - F.col("base")).filter((lap >= 0.5 * (F.col("t1") - F.col("t0"))) & F.col("gap").between(-5, 9))
    return best(x, [*page, "pid"], "gap", "sid").select(*page, "pid", "sid")


def views_of(bubbles: DataFrame, views: DataFrame, page: Page, reach: float = 250.0) -> DataFrame:
    """page, pid, view: of the views (page, view, x0, y0, x1, y1) that a letter's bubble lies beside in height, the nearest across, at most `reach` away."""
    x = bubbles.join(views, page).filter((F.col("y") > F.col("y0")) & (F.col("y") < F.col("y1"))).withColumn("gap", F.greatest(F.col("x0") - F.col("x"), F.col("x") - F.col("x1"), F.lit(0.0)))
    return best(x, [*page, "pid"], "gap", "view").filter(F.col("gap") <= reach).select(*page, "pid", "view")


def touched(rects: DataFrame, axes: DataFrame, page: Page, slack: float = 8.0) -> DataFrame:
    """page, place, rid: the first rectangle at each intersection of a letter's (x) and a number's (y) axis (page, kind, label, at) that it touches; one rectangle may touch several."""
    near = lambda lo, hi: F.col("at").between(F.col(lo) - slack, F.col(hi) + slack)
    l = rects.join(axes.filter("kind = 'letter'").select(*page, F.col("label").alias("l"), "at"), page).filter(near("x0", "x1")).drop("at")  # noqa: E741
    n = l.join(axes.filter("kind = 'number'").select(*page, F.col("label").alias("n"), "at"), page).filter(near("y0", "y1"))
    return best(n.withColumn("place", F.concat_ws("-", "l", "n")), [*page, "place"], "rid").select(*page, "place", "rid")


def nearest_label(callouts: DataFrame, labels: DataFrame, page: Page, reach: float | None = None, same: list[str] | None = None) -> DataFrame:
    """page, pid, label: the nearest label (page, label, x, y), of equal `same` columns, at most reach away."""
    l = labels.select(*page, "label", F.col("x").alias("lx"), F.col("y").alias("ly"), *(same or []))  # noqa: E741
    x = callouts.join(l, [*page, *(same or [])]).withColumn("d", F.hypot(F.col("x") - F.col("lx"), F.col("y") - F.col("ly")))
    x = x if reach is None else x.filter(F.col("d") <= reach)
    return best(x, [*page, "pid"], F.round("d", 9), "label").select(*page, "pid", "label")


def chosen_grid(coverage: DataFrame, page: Page) -> DataFrame:
    """page, source of the grid that places a page's points. coverage: page, points, by_lines, by_file, by_labels (points placed; null where there is no such grid), agrees (the page's labels are where the file's grid has them).

    Drawn lines if they place half, else the file's grid if it agrees and places half, else the page's labels, else what places most.
    """
    half = lambda c: F.coalesce(F.col(c) >= 0.5 * F.greatest("points", F.lit(1)), F.lit(False))
    source = (
        F.when(half("by_lines"), "page_lines").when(half("by_file") & F.coalesce("agrees", F.lit(False)), "file_shared").when(F.col("by_labels").isNotNull(), "page_labels")
        .otherwise("page_lines"))
    return coverage.select(*page, source.alias("source"))


def first_located(parts: list[tuple[str, DataFrame]], page: Page) -> DataFrame:
    """page, pid, place, source by the first locator of a list (name, rows page, pid, place, cost) that places a point."""
    u = [df.filter("place is not null").select(*page, "pid", "place", F.lit(k).alias("_o"), F.lit(name).alias("source")) for k, (name, df) in enumerate(parts)]
    return best(reduce(DataFrame.unionByName, u), [*page, "pid"], "_o").drop("_o")


def conventions(labels: DataFrame, page: Page) -> DataFrame:
    """page, letters, numbers ('rows', 'columns' or 'undetermined') by labels (page, kind, label, x, y) repeated along one axis."""
    g = labels.groupBy(*page, "kind", "label").agg(F.count("*").alias("n"), (F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h")).filter("n >= 2")
    votes = lambda kind, a, b: F.count_if((F.col("kind") == kind) & (F.col(a) < 40) & (F.col(b) > 200))
    v = g.groupBy(*page).agg(votes("letter", "w", "h").alias("lc"), votes("letter", "h", "w").alias("lr"), votes("number", "w", "h").alias("nc"), votes("number", "h", "w").alias("nr"))
    rows, cols = (F.col("lr") > F.col("lc")) | (F.col("nc") > F.col("nr")), (F.col("lc") > F.col("lr")) | (F.col("nr") > F.col("nc"))
    says = lambda a, b: F.when(rows, a).when(cols, b).otherwise("undetermined")
    return v.select(*page, says("rows", "columns").alias("letters"), says("columns", "rows").alias("numbers"))


def stacks(lines: DataFrame, page: Page, indent: float = 8.0, step: float = 16.0) -> DataFrame:
    """lines (page, pid, x, y, orient) with block: lines under each other with one left edge, the next at most `step` lower, are one. By column of six units (ties to even) and height."""
    w = Window.partitionBy(*page).orderBy(F.bround(F.col("x") / 6), "y", "pid")
    gap = F.col("y") - F.lag("y").over(w)
    on = (F.abs(F.col("x") - F.lag("x").over(w)) < indent) & (gap >= 0) & (gap < step) & (F.col("orient") == F.lag("orient").over(w))
    return lines.withColumn("_new", F.when(F.coalesce(on, F.lit(False)), 0).otherwise(1)).withColumn("block", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def title_rows(titles: DataFrame, page: Page, reach: float = 60.0) -> DataFrame:
    """titles (page, title, y) with row: a title joins the row whose first title is less than reach above it. The titles of a page, a few dozen, are folded in one array."""
    g = titles.groupBy(*page).agg(F.array_sort(F.collect_list(F.struct("y", "title"))).alias("t"))
    start = F.struct(F.lit(None).cast("double").alias("top"), F.lit(0).alias("row"), F.array().cast("array<struct<title:string,row:int>>").alias("out"))

    def put(acc: Column, t: Column) -> Column:
        same = F.coalesce(t["y"] - acc["top"] < reach, F.lit(False))
        row = F.when(same, acc["row"]).otherwise(acc["row"] + 1)
        return F.struct(F.when(same, acc["top"]).otherwise(t["y"].cast("double")).alias("top"), row.alias("row"), F.concat(acc["out"], F.array(F.struct(t["title"].cast("string").alias("title"), row.alias("row")))).alias("out"))

    return g.select(*page, F.explode(F.aggregate("t", start, put)["out"]).alias("o")).select(*page, "o.title", "o.row")


def joined_boxes(boxes: DataFrame, page: Page) -> DataFrame:
    """boxes (page, pid, x0, y0, x1, y1): page, pid, box: boxes that overlap, directly or through others, are joined, until nothing changes; a joined box is the hull of its parts.

    Rounds of components over overlapping pairs, then hulls; hulls may overlap again.
    """
    b = boxes.select(*page, "pid", F.col("pid").alias("box"), "x0", "y0", "x1", "y1")
    while True:
        hulls = b.groupBy(*page, "box").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
        o = hulls.select(*page, F.col("box").alias("other"), F.col("x0").alias("u0"), F.col("y0").alias("v0"), F.col("x1").alias("u1"), F.col("y1").alias("v1"))
        pairs = hulls.join(o, page).filter("box < other and x0 < u1 and u0 < x1 and y0 < v1 and v0 < y1")
        c = components(pairs.select(F.col("box").alias("a"), F.col("other").alias("b")))
        if c.isEmpty():
            return b.select(*page, "pid", "box")
        b = b.join(c, b.box == c.id, "left").select(*page, "pid", F.coalesce("component", "box").alias("box"), "x0", "y0", "x1", "y1")


def strip_pairs(marks: DataFrame, page: Page, common: int = 3, share: float = 0.0, off: float = 8.0, apart: float = 80.0) -> DataFrame:
    """marks (page, strip, label, x, y) of numeric strips: page, top, bottom, labels: strips that are one view's two ends, by labels shared at the same place; each strip is in one pair, the upper one choosing first, by most labels."""
    n = marks.groupBy(*page, "strip").agg(F.countDistinct("label").alias("size"), F.avg("y").alias("sy"))
    m = marks.select(*page, "strip", "label", "x").join(n, [*page, "strip"])
    o = m.select(*page, F.col("strip").alias("bottom"), "label", F.col("x").alias("bx"), F.col("size").alias("bsize"), F.col("sy").alias("by"))
    p = m.join(o, [*page, "label"]).filter((F.col("by") - F.col("sy") >= apart) & (F.abs(F.col("x") - F.col("bx")) < off))
    g = p.groupBy(*page, F.col("strip").alias("top"), "bottom").agg(F.countDistinct("label").alias("labels"), F.max(F.greatest("size", "bsize")).alias("most"))
    g = g.filter((F.col("labels") >= common) & (F.col("labels") >= share * F.col("most")))
    # a strip is in one pair, whether above or below: chosen strips leave on both sides
    out, left = None, g
    from ferrolith.session import checkpoint

    left = checkpoint(left)
    while True:
        ends = left.select(*page, F.col("top").alias("s"), F.struct("top", (-F.col("labels")).alias("l"), "bottom").alias("r")).unionByName(left.select(*page, F.col("bottom").alias("s"), F.struct("top", (-F.col("labels")).alias("l"), "bottom").alias("r")))
        first = ends.groupBy(*page, "s").agg(F.min("r").alias("r"))
        top = left.join(first.select(*page, F.col("s").alias("top"), F.col("r").alias("_a")), [*page, "top"]).join(first.select(*page, F.col("s").alias("bottom"), F.col("r").alias("_b")), [*page, "bottom"])
        me = F.struct("top", (-F.col("labels")).alias("l"), "bottom")
        now = checkpoint(top.filter((me == F.col("_a")) & (me == F.col("_b"))).select(*page, "top", "bottom", "labels"))
        if now.isEmpty():
            return (now if out is None else out).select(*page, "top", "bottom", "labels")
        out = now if out is None else out.unionByName(now)
        gone = now.select(*page, F.col("top").alias("s")).unionByName(now.select(*page, F.col("bottom").alias("s")))
        left = checkpoint(left.join(gone.withColumnRenamed("s", "top"), [*page, "top"], "left_anti").join(gone.withColumnRenamed("s", "bottom"), [*page, "bottom"], "left_anti").select(*left.columns))


def is_circle(points: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Whether the points of a closed path lie on a circle: its box 8 to 32 wide and nearly square, 24 points at least, all within a fifth of the radius."""
    w, h = x1 - x0, y1 - y0
    r = (w + h) / 4
    d = lambda p: F.hypot(p["x"] - (x0 + x1) / 2, p["y"] - (y0 + y1) / 2)
    return (w > 8) & (w < 32) & (w > 0.85 * h) & (w < 1.18 * h) & (F.size(points) >= 24) & F.forall(points, lambda p: (d(p) > 0.8 * r) & (d(p) < 1.2 * r))


def snapped(c: Column) -> Column:
    """A line's constant on halves, ties to even."""
    return F.bround(c * 2) / 2


# ---- beams of both drawings ----


def compare_beams(plan: DataFrame, shop: DataFrame, plan_axes: DataFrame, shop_axes: DataFrame) -> DataFrame:
    """beam, bid, matched, oid: for each plan bar the nearest shop bar that states the same, where the shop's drawing puts it.

    plan (beam, bid, role, diametre, quantite, espacement_mm, x, y, by: the beam's own y) and shop (beam, view, oid, role, diametre, quantite,
    espacement_mm, x, y, by); axes (beam, label, at). Two axis labels in common at least fix scale and shift of a beam (least squares). Bars of the
    shop's whole view are candidates: equal role, size, count and spacing where the plan states them, less than 70 off across (skin bars of the
    same beam anywhere) and, if longitudinal, less than 30 off in height. Two single face bars side by side may stand for two.
    """
    fit = plan_axes.join(shop_axes.select("beam", "label", F.col("at").alias("u")), ["beam", "label"]).groupBy("beam").agg(F.count("*").alias("n"), F.regr_slope("u", "at").alias("scale"), F.regr_intercept("u", "at").alias("shift")).filter("n >= 2 and scale is not null")
    at = shop.groupBy("beam").agg(F.first("view").alias("view"), F.min("by").alias("dy"))
    # pairs of single bars of the two faces
    one = shop.filter("role = 'longitudinale' and quantite = 1")
    two = one.select("view", F.col("beam").alias("beam2"), F.col("oid").alias("oid2"), F.col("diametre").alias("d2"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    both = one.join(two, "view").filter("oid < oid2 and diametre = d2 and abs(x - x2) < 8 and abs(y - y2) < 10").withColumn("quantite", F.lit(2)).withColumn("pair", F.lit(True)).drop("beam2", "oid2", "d2", "x2", "y2")
    pool = shop.withColumn("pair", F.lit(False)).unionByName(both.select(*shop.columns, "pair"))
    pool = pool.select("view", F.col("beam").alias("obeam"), "oid", "pair", "role", "diametre", F.col("quantite").alias("oq"), F.col("espacement_mm").alias("os"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    p = plan.join(fit, "beam").join(at, "beam")
    p = p.withColumn("px", F.col("scale") * F.col("x") + F.col("shift")).withColumn("py", F.col("dy") + F.col("scale") * (F.col("y") - F.col("by")))
    c = p.join(pool, ["view", "role", "diametre"]).filter(
        (F.coalesce("quantite", F.lit(0)) == 0) | (F.col("quantite") == F.col("oq"))
    ).filter(F.col("espacement_mm").isNull() | (F.abs(F.col("espacement_mm") - F.coalesce("os", F.lit(-999.0))) < 0.1))
    c = c.filter(((F.abs(F.col("ox") - F.col("px")) < 70) | ((F.col("role") == "peau") & (F.col("obeam") == F.col("beam")))) & ((F.col("role") != "longitudinale") | (F.abs(F.col("oy") - F.col("py")) < 30)))
    c = best(c.withColumn("d", F.round(F.abs(F.col("ox") - F.col("px")) + F.abs(F.col("oy") - F.col("py")), 6)), ["beam", "bid"], "d", "pair", "oid").select("beam", "bid", "oid")
    return p.select("beam", "bid").join(c, ["beam", "bid"], "left").select("beam", "bid", F.col("oid").isNotNull().alias("matched"), "oid")
