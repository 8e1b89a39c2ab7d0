"""Queries of the operators on views of drawing pages, inventories and saved readings, and the SQL that states the same.

As in reference.py, tables without drawings are read as such by plain arithmetic on their keys: a customer is a callout, a part
a title, a stroke, a label or a rectangle. Pages grow in number with the tables, not in size.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrolith.functions import grammar as G
from ferrolith.operators import dedup, drawing, pages, registry, spatial, views
from ferrolith.plans import reference as R
from ferrolith.plans.reference import BARS, PLAN, SUPPORTS, _LINES, _PTS
from ferrolith.sources.tables import table as t
from ferrolith.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
_Q: dict[str, Query] = {}
_SQL: dict[str, str] = {}
P = ["page"]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _Q[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _k() -> Column:
    return F.col("p_partkey")


def _page() -> Column:
    return F.floor(_k() / 400).alias("page")


_TITLES = "(select p_partkey // 400 as page, 'P' || lpad(p_partkey::varchar, 7, '0') as title, (p_partkey * 53 % 1000)::double as x, (200 + (p_partkey // 20 % 4) * 150)::double as y, p_partkey as k from part where p_partkey % 20 = 0)"
_STROKES = "(select p_partkey // 400 as page, p_partkey as sid, (p_partkey * 31 % 700)::double as y, (p_partkey * 53 % 900)::double as lo, (p_partkey * 53 % 900 + 40 + p_size * 4)::double as hi, case when p_partkey % 2 = 0 then 'h' else 'v' end as orient from part where p_partkey % 20 <> 0)"


def titles(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "part").filter("p_partkey % 20 = 0").select(_page(), F.concat(F.lit("P"), F.lpad(_k().cast("string"), 7, "0")).alias("title"), (_k() * 53 % 1000).cast("double").alias("x"), (200 + (F.floor(_k() / 20) % 4) * 150).cast("double").alias("y"))


def strokes(s: SparkSession, d: str) -> DataFrame:
    lo = _k() * 53 % 900
    return t(s, d, "part").filter("p_partkey % 20 != 0").select(_page(), _k().alias("sid"), (_k() * 31 % 700).cast("double").alias("y"), lo.cast("double").alias("lo"), (lo + 40 + F.col("p_size") * 4).cast("double").alias("hi"), F.when(_k() % 2 == 0, "h").otherwise("v").alias("orient"))


# ---- titles, margins, labels ----


@query("select k from (select p_partkey as k, 5 + p_partkey % 7 as h, max(5 + p_partkey % 7) over (partition by p_partkey // 400) as m from part) where h >= 0.9 * m")
def largest_titles(s, d):
    """titles of nearly the page's greatest size."""
    return views.largest(t(s, d, "part").select(_page(), _k().alias("k"), (5 + _k() % 7).alias("h")), P, "h").select("k")


_LOCATED = lambda margin: f"""g as (select a.*, coalesce((select min(abs(o.c - a.c)) from {_LINES} o where o.kind = a.kind and o.lid <> a.lid and abs(o.c - a.c) > 1 and least(o.hi, a.hi) - greatest(o.lo, a.lo) > 0), 300.0::double) as gap from {_LINES} a),
n as (select pid, lid, kind, label, c, lo, hi, gap, abs(case orient when 'h' then y else x end - c) as perp from {_PTS}, g where case orient when 'h' then x else y end between lo - {margin} and hi + {margin}), k as (select *, row_number() over (partition by pid, kind order by perp, lid) as r from n),
q as (select a.pid, a.label || '-' || b.label as place, row_number() over (partition by a.pid order by a.perp / a.gap + b.perp / b.gap, a.lid, b.lid) as r from k a join k b on a.pid = b.pid and a.kind = 'letter' and b.kind = 'number' and a.r <= 6 and b.r <= 6 and b.c between a.lo - 40 and a.hi + 40 and a.c between b.lo - 40 and b.hi + 40),
located as (select pid, place from q where r = 1)"""  # noqa: E731


@query(f"with {_LOCATED(15)} select p.pid from {_PTS} p left join located l using (pid) where not (x > 820 or (x > 600 and y > 546)) or l.place is not null")
def body_marks(s, d):
    """marks outside the margin, and those inside that a drawn view places."""
    p = R.points(s, d)
    return views.body(p, drawing.locate_lines(p, R.grid(p), P, 15.0), P, 1000.0, 700.0).select("pid")


@query(f"select distinct pid from {_PTS}, {_LINES} g where abs(case orient when 'v' then x else y end - c) < 8 and (case orient when 'v' then y else x end between lo - 60 and lo or case orient when 'v' then y else x end between hi and hi + 60)")
def bubble_labels(s, d):
    """labels past the end of a grid line."""
    p = R.points(s, d)
    return views.bubbles(p, R.grid(p), P).select("pid")


@query(f"""select bar_id from {BARS} where not coalesce(regexp_matches(raw || case when bar_id % 5 = 0 then ' OUVERTURE' when bar_id % 7 = 0 then ' h & b' else '' end, '(?i)H\\s*[&8]\\s*B\\b|HGB|REQUIS|QRT|OUVERTURE|D[ÉE]TAIL'), false)""")
def opening_details(s, d):
    """callouts but those of the details of openings."""
    raw = F.concat(F.col("raw"), F.when(F.col("bar_id") % 5 == 0, " OUVERTURE").when(F.col("bar_id") % 7 == 0, " h & b").otherwise(""))
    return R.bars(s, d).filter(~F.coalesce(raw.rlike(views.OPENING), F.lit(False))).select("bar_id")


@query("""with l as (select p_partkey // 400 as page, case when p_partkey % 2 = 0 then 'letter' else 'number' end as kind, p_partkey % 40 as label, case when (p_partkey // 2) % 3 = 0 then 100 else p_partkey * 7 % 900 end as x, p_partkey * 11 % 700 as y from part), g as (select page, kind, label, max(x) - min(x) as w, max(y) - min(y) as h from l group by all having count(*) >= 2),
v as (select page, count(*) filter (kind = 'letter' and w < 40 and h > 200) as lc, count(*) filter (kind = 'letter' and h < 40 and w > 200) as lr, count(*) filter (kind = 'number' and w < 40 and h > 200) as nc, count(*) filter (kind = 'number' and h < 40 and w > 200) as nr from g group by 1)
select page, case when lr > lc or nc > nr then 'rows' when lc > lr or nr > nc then 'columns' else 'undetermined' end as letters, case when lr > lc or nc > nr then 'columns' when lc > lr or nr > nc then 'rows' else 'undetermined' end as numbers from v""")
def axis_conventions(s, d):
    """Whether letters name rows or columns, by labels repeated along one axis."""
    x = F.when(F.floor(_k() / 2) % 3 == 0, 100).otherwise(_k() * 7 % 900)
    return views.conventions(t(s, d, "part").select(_page(), F.when(_k() % 2 == 0, "letter").otherwise("number").alias("kind"), (_k() % 40).alias("label"), x.alias("x"), (_k() * 11 % 700).alias("y")), P)


# ---- spans and owners ----

_SPANS = f"""c as (select t.page, t.title, t.x, s.sid, s.lo, s.hi, t.y from {_TITLES} t join {_STROKES} s on s.page = t.page and s.hi - s.lo >= 60 and s.y between t.y - 400 and t.y - 10 and t.x between s.lo and s.hi),
f as (select * from c where not exists (select 1 from {_TITLES} r where r.page = c.page and r.title <> c.title and abs(r.y - c.y) < 60 and r.x > c.lo and r.x < c.hi)), sp as (select page, title, lo, hi from (select *, row_number() over (partition by page, title order by lo - hi, sid) as k from f) where k = 1)"""
_BELOW = f"b as (select * from (select p.page, pid, p.x, p.y, title, t.x as tx, t.y as ty, min(t.y) over (partition by p.page, pid) as m from {_PTS} p join {_TITLES} t on t.page = p.page and t.y > p.y - 5) where ty - m < 60)"


@query(f"with {_SPANS} select * from sp")
def title_spans(s, d):
    """Each title's drawn extent, the longest stroke that covers its centre and no rival's."""
    return views.spans(titles(s, d), strokes(s, d), P)


@query(f"""with {_SPANS}, {_BELOW}, j as (select b.*, lo, hi, (x between lo - 25 and hi + 25) as i from b join sp using (page, title)) select pid, title from (select *, row_number() over (partition by page, pid order by case when i then 0 else 1 end, case when i then abs((lo + hi) / 2 - x) else greatest(lo - x, x - hi, 0) + 0.01::double * abs(tx - x) end, title) as k from j) where k = 1""")
def beam_owners(s, d):
    """Callouts to the beams in whose span they stand, or the nearest of their row."""
    ti = titles(s, d)
    return views.owners(R.points(s, d), ti, views.spans(ti, strokes(s, d), P), P).select("pid", "title")


@query(f"""with sp as (select page, title, x - 10 as lo, x + 10 as hi from {_TITLES} where k % 360 <> 0), {_BELOW}, j as (select b.*, lo, hi, lo is null or coalesce(lo < lag(hi) over (partition by b.page, pid order by lo nulls first, hi), false) as bad from b left join sp on sp.page = b.page and sp.title = b.title), w as (select *, bool_or(bad) over (partition by page, pid) as any_bad from j) select pid, title from (select *, row_number() over (partition by page, pid order by greatest(lo - x, 0, x - hi), title) as k from w where not any_bad) where k = 1""")
def wall_owners(s, d):
    """Callouts to the nearest wall of their row, where all of the row were found and none overlap."""
    ti = titles(s, d)
    walls = ti.filter(F.substring("title", 2, 7).cast("long") % 360 != 0).select("page", "title", (F.col("x") - 10).alias("lo"), (F.col("x") + 10).alias("hi"))
    return views.wall_owners(R.points(s, d), ti, walls, P).select("pid", "title")


def _arm() -> Column:
    return F.col("pid") % 2 == 0


@query(None)
def bar_tie_pairs(s, d):
    """Bar lines with the tie lines right under them."""
    p = R.points(s, d)
    return views.paired(p.filter(_arm()), p.filter(~_arm()), P, 60.0, 80.0)


@query(None)
def web_pairs(s, d):
    """Horizontal and vertical web lines stacked on each other."""
    p = R.points(s, d)
    return views.paired(p.filter(_arm()), p.filter(~_arm()), P, 60.0, 80.0, below=False)


@query(None)
def spacing_lines(s, d):
    """Spacing lines to the nearest bar line still without one."""
    p = R.points(s, d).withColumn("orient", F.when(F.floor(F.col("pid") / 2) % 3 == 0, "v").otherwise("h"))
    return views.spacings(p.filter("pid % 4 = 0"), p.filter("pid % 4 != 0"), P)


_LABELS = "(select p_partkey // 400 as page, 'K-' || (p_partkey % 8) as label, ((p_partkey % 8) * 120 + p_partkey % 5)::double as x, (p_partkey * 17 % 700)::double as y from part)"


@query(f"""with s as (select page, label, avg(x) as sx, min(y) as lo, max(y) as hi from {_LABELS} group by 1, 2), g as (select *, sx - lag(sx) over (partition by page order by sx, label) as gap from s), p as (select *, coalesce(median(gap) over (partition by page), 120) as pitch from g),
j as (select pid, p.label, abs(x - sx) as d, pitch, row_number() over (partition by q.page, pid order by round(abs(x - sx), 9), p.label) as k from {_PTS} q join p on p.page = q.page and y between lo - 60 and hi + 60) select pid, label from j where k = 1 and round(d, 9) <= 0.6::double * pitch""")
def strip_owners(s, d):
    """Bar lines to the strips of a column schedule."""
    lab = t(s, d, "part").select(_page(), F.concat(F.lit("K-"), (_k() % 8).cast("string")).alias("label"), ((_k() % 8) * 120 + _k() % 5).cast("double").alias("x"), (_k() * 17 % 700).cast("double").alias("y"))
    return views.on_strips(R.points(s, d), views.strips(lab, P), P).select("pid", "label")


@query(f"""select pid, title from (select pid, title, row_number() over (partition by p.page, pid order by abs(p.y - t.y), title) as k from {_PTS} p join {_TITLES} t on t.page = p.page and p.x - t.x >= -120 and p.x - t.x < 230 and p.y - t.y >= -40 and p.y - t.y < 640) where k = 1""")
def panel_owners(s, d):
    """Lines to the panels in whose box they stand."""
    return views.panels(R.points(s, d), titles(s, d), P).select("pid", "title")


@query(f"""select pid, sid from (select pid, sid, row_number() over (partition by p.page, pid order by s.y - p.y, sid) as k from {_PTS} p join {_STROKES} s on s.page = p.page and s.orient = case when pid % 2 = 0 then 'h' else 'v' end and least(p.x + 60, s.hi) - greatest(p.x, s.lo) >= 30 and s.y - p.y between -5 and 9) where k = 1""")
def stroke_beside(s, d):
    """The bar stroke on the baseline side of a text."""
    tx = R.points(s, d).select("page", "pid", F.when(_arm(), "h").otherwise("v").alias("orient"), F.col("y").alias("base"), F.col("x").alias("t0"), (F.col("x") + 60).alias("t1"))
    st = strokes(s, d).select("page", "sid", "orient", F.col("y").alias("across"), F.col("lo").alias("start"), F.col("hi").alias("end"))
    return views.stroke_beside(tx, st, P).select("pid", "sid")


@query(f"""select pid, view from (select pid, k as view, greatest(t.x - p.x, p.x - t.x - 100, 0) as gap, row_number() over (partition by p.page, pid order by greatest(t.x - p.x, p.x - t.x - 100, 0), k) as n from {_PTS} p join {_TITLES} t on t.page = p.page and p.y > t.y and p.y < t.y + 120) where n = 1 and gap <= 250""")
def bubble_views(s, d):
    """letters' bubbles to the views they stand beside."""
    v = t(s, d, "part").filter("p_partkey % 20 = 0").select(_page(), _k().alias("view"), (_k() * 53 % 1000).cast("double").alias("x0"), (200 + (F.floor(_k() / 20) % 4) * 150).cast("double").alias("y0")).withColumn("x1", F.col("x0") + 100).withColumn("y1", F.col("y0") + 120)
    return views.views_of(R.points(s, d), v, P).select("pid", "view")


@query(f"""with a as {R._AX[0]}, b as {R._AX[1]}, j as (select r.page, rid, a.label || '-' || b.label as place from {R._RECT} r, a, b where a.pos between x0 - 8 and x1 + 8 and b.pos between y0 - 8 and y1 + 8) select page, place, min(rid) as rid from j group by 1, 2""")
def touched_places(s, d):
    """Rectangles to all intersections they touch; the first drawn has each."""
    x, y = (_k() * 53 % 900).cast("double"), (_k() * 17 % 600).cast("double")
    r = t(s, d, "part").select(_page(), _k().alias("rid"), x.alias("x0"), y.alias("y0"), (x + 20 + F.col("p_size")).alias("x1"), (y + 30 + F.col("p_size") % 7).alias("y1"))
    return views.touched(r, axes(r), P)


def axes(marks: DataFrame) -> DataFrame:
    """The same label axes on every page of marks."""
    one = lambda kind, label, at, seq: F.struct(F.lit(kind).alias("kind"), F.lit(label).alias("label"), F.lit(float(at)).alias("at"), F.lit(seq).alias("seq"))
    drawn = [one("letter", chr(65 + i), 30 + i * 66 + i * i, i) for i in range(15)] + [one("number", str(i + 1), 20 + i * 35, i) for i in range(20)]
    return marks.select("page").distinct().select("page", F.explode(F.array(*drawn)).alias("a")).select("page", "a.*")


_NEAREST = lambda extra, on: f"""select pid, label from (select pid, t.title as label, sqrt((p.x - t.x) ** 2 + (p.y - t.y) ** 2) as dist, row_number() over (partition by p.page, pid order by round(sqrt((p.x - t.x) ** 2 + (p.y - t.y) ** 2), 9), t.title) as k from {_PTS} p join {_TITLES} t on t.page = p.page {on}) where k = 1 {extra}"""


@query(_NEAREST("and dist <= 150", ""))
def mat_labels(s, d):
    """Callouts to the nearest mat's label, within a share of the page's width."""
    return views.nearest_label(R.points(s, d), titles(s, d).withColumnRenamed("title", "label"), P, 150.0).select("pid", "label")


@query(_NEAREST("", "and (pid % 2 = 0) = (k // 20 % 2 = 0)"))
def legend_layers(s, d):
    """The layer of the nearest legend entry written in the same direction."""
    entries = titles(s, d).withColumn("orient", F.when(F.substring("title", 2, 7).cast("long") / 20 % 2 == 0, "h").otherwise("v")).withColumnRenamed("title", "label")
    return views.nearest_label(R.points(s, d).withColumn("orient", F.when(_arm(), "h").otherwise("v")), entries, P, None, ["orient"]).select("pid", "label")


# ---- grids ----


@query("""select s_suppkey as page, case when s_suppkey % 11 >= 0.5 * greatest(s_suppkey % 13, 1) then 'page_lines' when s_suppkey % 3 > 0 and s_suppkey % 7 >= 0.5 * greatest(s_suppkey % 13, 1) and s_suppkey % 2 = 0 then 'file_shared' when s_suppkey % 5 > 0 then 'page_labels' else 'page_lines' end as source from supplier""")
def grid_choice(s, d):
    """Which grid places a page's points."""
    k = F.col("s_suppkey")
    c = t(s, d, "supplier").select(k.alias("page"), (k % 13).alias("points"), (k % 11).alias("by_lines"), F.when(k % 3 > 0, k % 7).alias("by_file"), F.when(k % 5 > 0, k % 5).alias("by_labels"), (k % 2 == 0).alias("agrees"))
    return views.chosen_grid(c, P)


@query(f"""with {_LOCATED(15)}, l as (select pid, label from (select pid, label, row_number() over (partition by pid order by abs(pos - x), seq) as k from {_PTS}, {R._AX[0]}) where k = 1), m as (select pid, label from (select pid, label, row_number() over (partition by pid order by abs(pos - y), seq) as k from {_PTS}, {R._AX[1]}) where k = 1)
select l.pid, coalesce(located.place, l.label || '-' || m.label) as place, case when located.place is not null then 'lines' else 'labels' end as source from l join m using (pid) left join located using (pid)""")
def locator_chain(s, d):
    """Places by drawn lines, else by labels."""
    p = R.points(s, d)
    return views.first_located([("lines", drawing.locate_lines(p, R.grid(p), P, 15.0)), ("labels", spatial.locate(p, axes(p), P))], P).select("pid", "place", "source")


# ---- stacks, rows, boxes, strips ----


@query("""with l as (select p_partkey // 400 as page, p_partkey as pid, ((p_partkey % 6) * 40)::double as x, (p_partkey * 37 % 700)::double as y, case when p_partkey % 2 = 0 then 'h' else 'v' end as orient from part), s as (select *, round_even(x / 6, 0) as c from l),
g as (select *, case when abs(x - lag(x) over w) < 8 and y - lag(y) over w >= 0 and y - lag(y) over w < 16 and orient = lag(orient) over w then 0 else 1 end as n from s window w as (partition by page order by c, y, pid)) select pid, (sum(n) over (partition by page order by c, y, pid rows unbounded preceding))::bigint as block from g""")
def line_stacks(s, d):
    """Lines under each other put together in blocks."""
    return views.stacks(t(s, d, "part").select(_page(), _k().alias("pid"), ((_k() % 6) * 40).cast("double").alias("x"), (_k() * 37 % 700).cast("double").alias("y"), F.when(_k() % 2 == 0, "h").otherwise("v").alias("orient")), P).select("pid", "block")


@query(f"""with recursive o as (select page, title, y, row_number() over (partition by page order by y, title) as n from (select page, title, (k * 37 % 700)::double as y from {_TITLES})), r as (select page, title, n, y as top, 1 as row from o where n = 1 union all select o.page, o.title, o.n, case when o.y - r.top < 60 then r.top else o.y end, case when o.y - r.top < 60 then r.row else r.row + 1 end from r join o on o.page = r.page and o.n = r.n + 1) select page, title, row::int as row from r""")
def title_rows(s, d):
    """Titles put together in rows, each begun by its first."""
    k = F.substring("title", 2, 7).cast("long")
    return views.title_rows(titles(s, d).withColumn("y", (k * 37 % 700).cast("double")), P)


@query(None)
def joined_boxes(s, d):
    """Overlapping boxes joined to their hulls until nothing changes."""
    x, y = (_k() * 53 % 900).cast("double"), (_k() * 17 % 600).cast("double")
    return views.joined_boxes(t(s, d, "part").select(_page(), _k().alias("pid"), x.alias("x0"), y.alias("y0"), (x + 4 + F.col("p_size") % 20).alias("x1"), (y + 6).alias("y1")), P)


@query(None)
def strip_pairs(s, d):
    """Numeric strips that are the two ends of a view."""
    strip, label = F.floor(_k() / 10) % 20, _k() % 10
    m = t(s, d, "part").select(_page(), strip.alias("strip"), label.cast("string").alias("label"), (label * 60 + (strip % 4) * 2).cast("double").alias("x"), (strip * 35).cast("double").alias("y"))
    return views.strip_pairs(m, P)


@query("""select p_partkey as k, p_partkey % 3 = 0 and p_size between 5 and 15 as circle, round_even(p_partkey * 0.25::double * 2, 0) / 2 as snapped from part""")
def circle_marks(s, d):
    """Closed paths that are circles; constants on halves."""
    r = F.col("p_size").cast("double")
    wobble = lambda i: F.when((_k() % 3 != 0) & (i % 4 == 0), 0.6).otherwise(1.0)
    pts = F.transform(F.sequence(F.lit(0), F.lit(35)), lambda i: F.struct((100 + r * wobble(i) * F.cos(i * 3.141592653589793 / 18)).alias("x"), (100 + r * wobble(i) * F.sin(i * 3.141592653589793 / 18)).alias("y")))
    return t(s, d, "part").select(_k().alias("k"), views.is_circle(pts, 100 - r, 100 - r, 100 + r, 100 + r).alias("circle"), views.snapped(_k() * 0.25).alias("snapped"))


@query("""select c_custkey as k, round(greatest(0.0, 1.0 - 0.5::double * (c_custkey % 16 / 8) - 0.2::double * (c_custkey % 4 / 4)), 3)::double as confidence, round(sqrt(greatest(100 - c_custkey % 300, 0, c_custkey % 300 - 150) ** 2 + greatest(50 - c_custkey % 200, 0, c_custkey % 200 - 90) ** 2), 6) as distance, greatest(0, least(c_custkey % 300 + 20, 150) - greatest(c_custkey % 300, 100))::double as overlap from customer""")
def scores_and_distances(s, d):
    """Confidences less their costs; distances from rectangles, overlaps."""
    k = F.col("c_custkey")
    x, y = (k % 300).cast("double"), (k % 200).cast("double")
    return t(s, d, "customer").select(k.alias("k"), G.confidence(F.lit(1.0), 0.5 * (k % 16 / 8), 0.2 * (k % 4 / 4)).alias("confidence"), F.round(G.rect_distance(x, y, F.lit(100.0), F.lit(50.0), F.lit(150.0), F.lit(90.0)), 6).alias("distance"), G.overlap(x, x + 20, F.lit(100.0), F.lit(150.0)).alias("overlap"))


# ---- beams, schedules, saved readings ----

_BEAMS = """plan_ as (select p_partkey // 20 as beam, p_partkey as bid, ['longitudinale', 'peau', 'étriers'][1 + p_partkey % 3] as role, '20M' as diametre, case when p_partkey % 3 = 0 then 1 + p_partkey % 2 end as q, case when p_partkey % 3 = 2 then (100 + p_size % 3)::double end as sp, (p_partkey % 20 * 50)::double as x, (100 + p_partkey % 20 * 3)::double as y from part),
shop_ as (select p_partkey // 20 as beam, p_partkey // 100 as view, p_partkey as oid, ['longitudinale', 'peau', 'étriers'][1 + p_partkey % 3] as role, '20M' as diametre, case when p_partkey % 3 = 0 then 1 + p_partkey % 2 end as q, case when p_partkey % 3 = 2 then (100 + p_size % 4)::double end as sp, (p_partkey % 20 * 100 + 30 + p_partkey % 9 * 10)::double as x, (200 + p_partkey % 20 * 6 + p_partkey % 7)::double as y from part)"""


@query(f"""with {_BEAMS}, one as (select *, false as pair from shop_ union all select a.beam, a.view, a.oid, a.role, a.diametre, 2, a.sp, a.x, a.y, true from shop_ a join shop_ b on a.view = b.view and a.role = 'longitudinale' and b.role = 'longitudinale' and a.q = 1 and b.q = 1 and a.oid < b.oid and a.diametre = b.diametre and abs(a.x - b.x) < 8 and abs(a.y - b.y) < 10),
v as (select beam, min(view) as view from shop_ group by 1), e as (select p.*, v.view, 2 * p.x + 30 as px, 200 + 2 * (p.y - 100) as py from plan_ p join v using (beam)), c as (select e.beam, e.bid, o.oid, row_number() over (partition by e.beam, e.bid order by round(abs(o.x - px) + abs(o.y - py), 6), o.pair, o.oid) as k from e join one o on o.view = e.view and o.role = e.role and o.diametre = e.diametre
and (coalesce(e.q, 0) = 0 or e.q = o.q) and (e.sp is null or abs(e.sp - coalesce(o.sp, -999)) < 0.1) and (abs(o.x - px) < 70 or (e.role = 'peau' and o.beam = e.beam)) and (e.role <> 'longitudinale' or abs(o.y - py) < 30))
select e.beam, count(*) as checked, count(c.oid) as matched, sum(c.oid)::bigint as evidence from e left join c on c.beam = e.beam and c.bid = e.bid and c.k = 1 group by 1""")
def beam_compare(s, d):
    """A beam's plan bars found on the shop's drawing by the axes both have, with how many were checked and found."""
    p = t(s, d, "part")
    role = F.element_at(F.array(F.lit("longitudinale"), F.lit("peau"), F.lit("étriers")), (1 + _k() % 3).cast("int"))
    beam, z = F.floor(_k() / 20), F.lit("20M").alias("diametre")
    q = F.when(_k() % 3 == 0, 1 + _k() % 2).cast("int").alias("quantite")
    sp = lambda n: F.when(_k() % 3 == 2, 100 + F.col("p_size") % n).cast("double").alias("espacement_mm")
    a = p.select(beam.alias("beam"), _k().alias("bid"), role.alias("role"), z, q, sp(3), (_k() % 20 * 50).cast("double").alias("x"), (100 + _k() % 20 * 3).cast("double").alias("y"), F.lit(100.0).alias("by"))
    b = p.select(beam.alias("beam"), F.floor(_k() / 100).alias("view"), _k().alias("oid"), role.alias("role"), z, q, sp(4), (_k() % 20 * 100 + 30 + _k() % 9 * 10).cast("double").alias("x"), (200 + _k() % 20 * 6 + _k() % 7).cast("double").alias("y"), F.lit(200.0).alias("by"))
    at = F.explode(F.array(*[F.struct(F.lit(x).alias("label"), F.lit(float(v)).alias("at")) for x, v in (("A", 0), ("B", 500), ("C", 1000))])).alias("l")
    ax = p.select(beam.alias("beam")).distinct().select("beam", at).select("beam", "l.*")
    m = views.compare_beams(a, b, ax, ax.withColumn("at", 2 * F.col("at") + 30))
    return m.groupBy("beam").agg(F.count("*").alias("checked"), F.count_if("matched").alias("matched"), F.sum("oid").alias("evidence"))


@query("""select case when l_linenumber % 2 = 0 then 'VERT' when l_linenumber % 3 = 0 then 'ETRI' else '(sans étiquette)' end as label, count(*) as n from lineitem group by 1""")
def label_census(s, d):
    """The role labels that a drawing's bar lines bear, counted."""
    ln = F.col("l_linenumber")
    text = F.concat(F.when(ln % 2 == 0, "VERT: ").when(ln % 3 == 0, "ÉTRI.: ").otherwise(""), F.col("l_quantity").cast("int").cast("string"), F.lit(" 20M A12"))
    lines = t(s, d, "lineitem").select(G.bar_line(text, F.lit(True)).alias("b"))
    return lines.groupBy(F.coalesce("b.label", F.lit("(sans étiquette)")).alias("label")).agg(F.count("*").alias("n"))


@query("""with r as (select p_partkey // 50 as page, chr((65 + p_partkey % 7)::int) as type, case when p_partkey % 2 = 0 then 'LONG' else 'TRAN' end as role, case when p_partkey % 11 > 0 then (p_partkey // 50) % 3 + (case when p_partkey % 49 = 0 then 1 else 0 end) end as q from part) select page, type, role, case when count(distinct q) = 1 then min(q) end as q, case when count(q) = 0 then 'unread' when count(distinct q) = 1 then 'read' else 'conflicting' end as status from r group by 1, 2, 3""")
def schedule_catalog(s, d):
    """One value per type and direction of a schedule, else conflicting or unread."""
    page = F.floor(_k() / 50)
    q = F.when(_k() % 11 > 0, page % 3 + F.when(_k() % 49 == 0, 1).otherwise(0))
    return dedup.catalog(t(s, d, "part").select(page.alias("page"), F.char(65 + _k() % 7).alias("type"), F.when(_k() % 2 == 0, "LONG").otherwise("TRAN").alias("role"), q.alias("q")), ["page", "type", "role"], ["q"])


@query(f"""select support_id, place from (select *, min(support_id) over (partition by project, coordinate, level, layer, status) as place, row_number() over (partition by project, coordinate, level, layer, status order by confidence desc nulls last, support_id) as k from {SUPPORTS}) where k = 1""")
def strongest_rows(s, d):
    """One row per identity, the surest, in the place of the first."""
    return dedup.strongest(R.supports(s, d), ["project", "coordinate", "level", "layer", "status"], "confidence", "support_id").select("support_id", "place")


@query(f"""select view, arg_max(status, (n, status)) as status, sum(n)::bigint as n from (select view, status, count(*) as n from {SUPPORTS} group by 1, 2) group by 1""")
def view_majority(s, d):
    """The status that most rows of a view have."""
    g = R.supports(s, d).groupBy("view", "status").agg(F.count("*").alias("n"))
    return g.groupBy("view").agg(F.max_by("status", F.struct("n", "status")).alias("status"), F.sum("n").alias("n"))


@query("""with a as (select case p_partkey % 2 when 0 then 'main' else 'V' end as view, ['letter', 'number'][1 + (p_partkey // 2) % 2] as kind, (p_partkey // 4) % 30 as i from part), l as (select distinct view, kind, i, case when view = 'V' and i % 5 = 0 then 'x' || i else i::varchar end as label from a) select view || '/' || label as was, case when view = 'V' then i::varchar else label end as letter, 'main' as view from l where kind = 'letter'""")
def view_aliases(s, d):
    """Places of aligned views under the labels of the main view."""
    i, v = F.floor(_k() / 4) % 30, _k() % 2 == 1
    a = t(s, d, "part").select(F.when(v, "V").otherwise("main").alias("view"), F.when(F.floor(_k() / 2) % 2 == 0, "letter").otherwise("number").alias("kind"), F.when(v & (i % 5 == 0), F.concat(F.lit("x"), i.cast("string"))).otherwise(i.cast("string")).alias("label"), (i * 50 + F.when(v, 700).otherwise(0)).cast("double").alias("at")).distinct()
    rows = a.filter("kind = 'letter'").select(F.concat_ws("/", "view", "label").alias("was"), "view", F.col("label").alias("letter"), F.lit("1").alias("number"))
    return dedup.identified(rows, dedup.aliases(a, "main"), dedup.offsets(a, "main"), "main").select("was", "letter", "view")


# ---- files, inventories, jobs ----


@query(f"""with f as (select distinct project, fichier from {BARS}), l as (select project, fichier, upper(strip_accents(fichier)) as n from f) select fichier, case when regexp_matches(n, 'RADIER') then 'radier' when regexp_matches(n, 'SEMELLE|EMPATTEMENT') then 'semelle' when regexp_matches(n, 'COLONNE') then 'colonne' when regexp_matches(n, 'POUTRE') then 'poutre' when regexp_matches(n, 'DALLE') then 'dalle' when regexp_matches(n, 'MUR|REFEND') then 'mur_refend' when regexp_matches(n, 'FONDATION') then 'semelle' end as kind, count(*) over (partition by project) as files from l""")
def file_inventory(s, d):
    """The files of each project with their kinds."""
    f = R.bars(s, d).select("project", "fichier").distinct()
    n = f.groupBy("project").agg(F.count("*").alias("files"))
    return f.join(n, "project").select("fichier", pages.file_kind(F.col("fichier"), F.col("fichier")).alias("kind"), "files")


@query("""with p as (select s_suppkey // 10 as name, s_suppkey as page, case when s_suppkey % 3 > 0 then 'S-1' else 'UNKNOWN' end as id from supplier) select name, count(*) as pages, case when count(*) filter (id <> 'UNKNOWN') >= greatest(2, count(*) / 2) then 'plan' else 'atelier' end as role from p group by 1""")
def file_roles(s, d):
    """Plans known by the sheet ids of their pages."""
    k = F.col("s_suppkey")
    return pages.files(t(s, d, "supplier").select(F.floor(k / 10).alias("fichier"), k.alias("page"), F.when(k % 3 > 0, "S-1").otherwise("UNKNOWN").alias("feuillet"))).select(F.col("fichier").alias("name"), "pages", "role")


@query(f"""select project, min(fichier) as plan from {PLAN} where starts_with(upper(fichier), upper(project)) group by 1""")
def plan_lookup(s, d):
    """Each project's plan, the first file that begins with its name."""
    p = R.plan(s, d).filter(F.upper("fichier").startswith(F.upper(F.col("project"))))
    return pages.plan_of(p, "project", "fichier", "")


@query("""select 'c' || s_suppkey // 4 || '.pdf' as name, s_suppkey as page, case when s_suppkey % 3 = 0 then 'extracted' when s_suppkey % 5 = 0 then 'unread' when 1 + s_suppkey % 4 > 1 then 'unread' else 'no_callouts' end as status, case when s_suppkey % 3 = 0 then null when s_suppkey % 5 = 0 then 'aucun type d''élément reconnu dans le titre du feuillet' when 1 + s_suppkey % 4 = 2 then 'page faite de glyphes vectoriels' when 1 + s_suppkey % 4 = 3 then 'page image' when 1 + s_suppkey % 4 = 4 then 'page illisible' end as reason, case when s_suppkey % 3 = 0 then 2 else 0 end::bigint as records from supplier""")
def page_reports(s, d):
    """Every page of the inventory reported, read, empty or unread with its reason."""
    k = F.col("s_suppkey")
    x = t(s, d, "supplier").select(F.concat(F.lit("c"), F.floor(k / 4).cast("string"), F.lit(".pdf")).alias("name"), k.alias("page"), (1 + k % 4).alias("tier"), F.when(k % 5 > 0, "colonne").alias("kind"))
    return pages.reports(x, x.filter("page % 3 = 0").select("name", "page", F.explode(F.array(F.lit(1), F.lit(2)))))


@query("""select case when s_suppkey % 4 = 0 then 'dalle' else 'colonne' end as kind, 'f' || s_suppkey || case when s_suppkey % 4 = 0 then '-dalle' else '-col' end as name from supplier where s_suppkey % 4 = 0 or s_suppkey = (select arg_min(s_suppkey, 'f' || s_suppkey || '-col') from supplier where s_suppkey % 4 <> 0)""")
def configured_inputs(s, d):
    """The files a configuration names: every slab file, the first column file."""
    k = F.col("s_suppkey")
    files = t(s, d, "supplier").select(F.concat(F.lit("f"), k.cast("string"), F.when(k % 4 == 0, "-dalle").otherwise("-col")).alias("name"))
    return pages.configured(files, s.createDataFrame([("dalle", "-dalle$", True), ("colonne", "-col$", False)], "kind string, pattern string, every boolean"))


@query("""select o_orderkey as name from orders where o_orderkey % 5 = 0 or o_orderkey % 7 = 0""")
def changed_files(s, d):
    """Files that changed or went while they were read."""
    o = F.col("o_orderkey")
    x = t(s, d, "orders").select(o.alias("name"), F.col("o_orderdate").alias("modified"), (o % 100).alias("length"))
    return incremental.changed(x, x.filter("name % 7 != 0").withColumn("length", F.when(F.col("name") % 5 == 0, F.col("length") + 1).otherwise(F.col("length"))))


@query("""select c_custkey as k, case when c_custkey % 4 = 0 or c_custkey % 6 = 0 then 'read again' else 'kept' end as state from customer""")
def cell_repair(s, d):
    """Cells of an older checkpoint kept where their boundaries haven't moved."""
    k = F.col("c_custkey")
    now = t(s, d, "customer").select(k.alias("k"), (k % 50).cast("double").alias("top"), (k % 50 + 20).cast("double").alias("bottom"))
    old = now.filter("k % 6 != 0").withColumn("top", F.col("top") + F.when(F.col("k") % 4 == 0, 2.0).otherwise(0.5))
    kept, again = incremental.reusable(old, now, ["k"])
    return kept.select("k", F.lit("kept").alias("state")).unionByName(again.select("k", F.lit("read again").alias("state")))


@query("""select c_nationkey as nation, count(*) as files, count(*) filter (c_custkey % 3 = 0) as read, count(*) filter (c_custkey % 3 = 0) / count(*) as share from customer group by 1""")
def reading_progress(s, d):
    """How far the reading of each set of inputs is."""
    x = t(s, d, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), incremental.fingerprint("v1", F.col("c_custkey")).alias("fingerprint"))
    return incremental.progress(x.filter("c_custkey % 3 = 0"), x, ["nation"])


@query(f"""select method, count(*) as n from (select case when type_element in ('colonne', 'mur_refend') then 'vertical' when type_element in ('dalle', 'poutre') then 'floor' when type_element in ('semelle', 'radier') then 'foundation' end as method from {PLAN}) where method is not null group by 1""")
def method_registry(s, d):
    """Records through the registered method of their kind, put together."""
    named = lambda name: lambda df: df.select(F.lit(name).alias("method"), "type_element")
    kinds = {"vertical": ("colonne", "mur_refend"), "floor": ("dalle", "poutre"), "foundation": ("semelle", "radier")}
    r = registry.Registry([registry.Method(n, n, k, named(n)) for n, k in kinds.items()])
    return r.apply(R.plan(s, d)).groupBy("method").agg(F.count("*").alias("n"))


@query(f"""select support_id, '{{"support_id":' || support_id || coalesce(',"status":"' || status || '"', '') || ',"duplicate":' || (coalesce(duplicate_conflict, false))::varchar || '}}' as json from {SUPPORTS}""")
def review_json(s, d):
    """Rows as JSON, null fields left out, false kept."""
    from ferrolith.operators import report

    x = R.supports(s, d).select("support_id", "status", F.coalesce("duplicate_conflict", F.lit(False)).alias("duplicate"))
    return report.review_json(x).select(F.get_json_object("json", "$.support_id").cast("long").alias("support_id"), "json")


@query(f"""select id, len(armature) as n, armature[1].diametre as diametre, 'NUM' as first, 'ALP' as second from (select id, [b, b] as armature from (select id, armature[1] as b from {PLAN} where type_element = 'dalle' and len(armature) > 0))""")
def integrity_pairs(s, d):
    """A circled label stands for two equal bars, NUM and ALP."""
    b = F.try_element_at("armature", F.lit(1))
    x = R.plan(s, d).filter("type_element = 'dalle'").filter(F.size("armature") > 0).select("id", G.integrity(b).alias("b"))
    return x.select("id", F.size("b").cast("long").alias("n"), F.col("b")[0]["diametre"].alias("diametre"), F.col("b")[0]["role"].alias("first"), F.col("b")[1]["role"].alias("second"))


@query("""select c_custkey as k, chr((65 + least(9, greatest(0, floor((c_custkey % 1000 + 49) / 100))))::int) as letter from customer""")
def nearest_axis(s, d):
    """The label whose place in a map is nearest, the first on ties."""
    m = F.create_map(*[F.lit(x) for i in range(10) for x in (chr(65 + i), float(100 * i))])
    return t(s, d, "customer").select(F.col("c_custkey").alias("k"), G.nearest_key(m, (F.col("c_custkey") % 1000).cast("double")).alias("letter"))
