"""Matching entities across two tables without a key: collective graph linkage.

1. Both sides get their attributes in common spelling. What a record leaves out or misreads is taken from its sheet: the
   records of one sheet (one shop file) share type and storey, so that the sheet's majority stands for each of them.
2. Candidate graph: records of the two sides that share an attribute rare within their lot are joined: the place within type
   and storey, all bars together, single bars with their figures, and, from the second round on, the cell of the drawing.
   An edge weighs the logarithm of the inverse block size of what it shares.
3. Meta-blocking: an edge stays if its weight reaches half of the heaviest edge of either end. Blocks of more than RARE
   comparisons have no weight; of these every pair is taken that reaches ACCEPT by place and bars alone: those of one place,
   and those that share enough of their bars, by a prefix-filtered join (`common`). Cells of the drawing are blocks like the
   others: their edges are weighed and pruned with the rest.
4. Collective refinement: an edge's similarity has a part from the pairs accepted around it. Each record has neighbours, those
   next to it along either axis of its drawing; what the pair of a neighbour on one side and a neighbour on the other has been
   accepted with is propagated to the edge (ECHO a pair). And the pairs of one shop file fix how its axes lie in those of the
   plan (scale, turn and shift, by least squares over sums), and a pair is the more similar the nearer its two positions come.
   Pairs are accepted one to one, the most similar first; axes, echoes and similarities are computed anew
   until the accepted pairs no longer change, or come back to what they were in an earlier round.

Each pair has a confidence in (0, 1), the logistic of its similarity beyond the threshold.

Defined results: records without a lot match nothing; null places, storeys, bars or positions say nothing for or against a
pair; records in repeated deliveries count once; equal similarities are settled by the ids; empty tables give no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrolith.functions.places import file_storey_of, layer, lot, place_of, storey_of
from ferrolith.functions.text import fold
from ferrolith.session import checkpoint
from ferrolith.sources.tables import once

ECHO, ECHOES = 0.15, 4  # what an accepted pair of neighbours adds to a similarity, and how many count
RARE = 64  # comparisons in a block up to which what its records share is rare
SALT = 50_000  # comparisons of a block that one join key holds
ACCEPT = 2.0  # similarity from which a pair is accepted
NEAR, FAR = 9.0, 18.0  # plan units within which positions agree, and from which on they disagree; grid lines are 30 and more apart
CELL = 24.0
# Of two records that don't share a place, the share of bar figures in common from which on they can reach ACCEPT without
# positions: 1.5 * (1 + share) - 0.6 + 0.3 >= 2.
ALIKE = 8 / 15
# How file names begin the kinds of elements.
KINDS = {"col": "colonne", "pou": "poutre", "sem": "semelle", "dal": "dalle", "mur": "mur_refend", "rad": "radier"}


def _majority(df: DataFrame, sheet: list[str], value: str) -> DataFrame:
    """sheet, value: the most frequent known value of each sheet, the greatest on ties."""
    n = df.filter(F.col(value).isNotNull()).groupBy(*sheet, value).agg(F.count("*").alias("_c"))
    return n.groupBy(*sheet).agg(F.max(F.struct("_c", value)).alias("_m")).select(*sheet, F.col(f"_m.{value}").alias(value))


def attributes(records: DataFrame, by_sheet: bool) -> DataFrame:
    """One side in common spelling. by_sheet: a file holds sheets of several kinds (plan); else it is of one kind and storey (shop)."""
    r = once(records, "id").filter("id is not null")
    said = F.when(F.col("debug.direction").isNotNull(), F.substring(fold(F.col("debug.direction")), 1, 1))
    one = lambda b: F.filter(F.array(
        F.concat(F.lit("d"), b["diametre"]), F.concat_ws(":", F.lit("q"), b["diametre"], b["quantite"].cast("string")),
        F.when(b["espacement_mm"].isNotNull(), F.concat_ws(":", F.lit("s"), b["diametre"], F.round(b["espacement_mm"]).cast("int").cast("string"))),
        F.when(b["longueur_mm"].isNotNull(), F.concat_ws(":", F.lit("l"), b["diametre"], F.round(b["longueur_mm"]).cast("int").cast("string"))),
    ), lambda t: t.isNotNull())
    whole = lambda b: F.concat_ws("|", F.coalesce(b["diametre"], F.lit("?")), F.coalesce(b["quantite"].cast("string"), F.lit("-")), F.coalesce(F.round(b["espacement_mm"]).cast("int").cast("string"), F.lit("-")))
    sheet = ["lot", "feuillet"] if by_sheet else ["lot", "fichier"]
    r = r.select(
        "id", F.concat_ws("/", F.upper("project"), lot(F.col("fichier"))).alias("lot"), "fichier", "feuillet", F.col("type_element").alias("kind"), place_of("element").alias("place"),
        (storey_of("debug.niveau") if by_sheet else F.coalesce(file_storey_of("fichier"), storey_of("debug.niveau"))).alias("storey"),
        F.coalesce(layer(F.col("debug.layer")), said).alias("part"),
        F.array_sort(F.transform(F.coalesce("armature", F.array().cast(dict(records.dtypes)["armature"])), whole)).alias("bars"),
        F.array_distinct(F.flatten(F.transform(F.coalesce("armature", F.array().cast(dict(records.dtypes)["armature"])), one))).alias("marks"),
        F.col("x"), F.col("y"), lot(F.col("fichier")).alias("_l"),
    ).filter("_l is not null").drop("_l")
    if not by_sheet:  # most shop files are named after their kind
        name = F.lower("fichier")
        told = F.coalesce(*[F.when(name.rlike(rf"(?<![a-z]){stem}"), kind) for stem, kind in KINDS.items()])
        r = r.withColumn("kind", F.coalesce(told, "kind"))
    kinds, storeys = _majority(r, sheet, "kind"), _majority(r, sheet, "storey")
    r = r.withColumnRenamed("kind", "_k").withColumnRenamed("storey", "_s").join(kinds, sheet, "left").join(storeys, sheet, "left")
    r = r.withColumn("storey", F.coalesce("storey", "_s")).withColumn("kind", F.coalesce("kind", "_k")).drop("_k", "_s")
    scope = F.concat_ws("/", "lot", F.coalesce("kind", F.lit("?")), F.coalesce("storey", F.lit("?")))
    return r.select("id", scope.alias("scope"), F.concat_ws("/", "lot", "fichier").alias("sheet"), "place", "part", F.array_join("bars", ";").alias("bars"), "marks", "x", "y")


def _keys(r: DataFrame) -> DataFrame:
    """id, key, what: the attributes by which a record may be found; diameters by themselves ('size') are counted like the other bar figures but weigh nothing."""
    key = lambda what, *c: F.struct(F.concat_ws("\n", "scope", F.lit(what), *c).alias("key"), F.lit(what).alias("what"))
    bars = F.col("bars") != ""
    several = F.transform("marks", lambda m: F.struct(F.concat_ws("\n", F.col("scope"), F.lit("mark"), m).alias("key"), F.when(m.startswith("d"), "size").otherwise("mark").alias("what")))
    all_ = F.concat(
        F.array_compact(F.array(F.when(F.col("place").isNotNull(), key("place", "place")), F.when(bars, key("bars", "bars")), F.when(F.col("place").isNotNull() & bars, key("both", "place", "bars")))),
        several,
    )
    return r.select("id", F.explode(all_).alias("k")).select("id", "k.*")


def _sizes(a: DataFrame, b: DataFrame) -> DataFrame:
    """key, what, c: comparisons of each block that both sides have."""
    n = lambda k, name: k.groupBy("key", "what").agg(F.count("*").alias(name))
    return checkpoint(n(a, "na").join(n(b, "nb"), ["key", "what"]).select("key", "what", (F.col("na") * F.col("nb")).alias("c")))


def _prefixes(r: DataFrame, size: DataFrame) -> DataFrame:
    """id, key: of each record's bar figures the rarest, so many that records with a share of ALIKE in common have one of them in common."""
    k = r.select("id", "scope", F.size("marks").alias("_m"), F.explode("marks").alias("mark")).select("id", "_m", F.concat_ws("\n", "scope", F.lit("mark"), "mark").alias("key"))
    k = k.join(size, "key", "left").withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy(F.coalesce("c", F.lit(0)), "key")))
    return k.filter(F.col("_r") <= F.col("_m") - F.ceil(F.col("_m") * F.lit(ALIKE) - 1e-9) + 1).select("id", "key")


def common(plan: DataFrame, shop: DataFrame, size: DataFrame | None = None) -> DataFrame:
    """plan_id, shop_id of the pairs in blocks of more than RARE comparisons whose similarity reaches ACCEPT without positions.

    Exact: such a pair has its place in common or a share of ALIKE of its bar figures, and then one of the prefix of both.
    Blocks are spread over as many keys as they hold SALT comparisons. size: _sizes of the blocks of both sides, where known.
    """
    place = lambda r: r.filter("place is not null").select("id", F.concat_ws("\n", "scope", F.lit("place"), "place").alias("key"))
    size = _sizes(_keys(plan), _keys(shop)) if size is None else size
    marks = size.filter("what in ('mark', 'size')")
    # sizes stand in no block of `candidates`
    hot = size.filter((F.col("what") == "size") | F.col("what").isin("place", "mark") & (F.col("c") > RARE))
    hot = hot.select("key", F.ceil(F.col("c") / SALT).cast("int").alias("salts"))
    a = place(plan).unionByName(_prefixes(plan, marks)).join(hot, "key").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int"))
    b = place(shop).unionByName(_prefixes(shop, marks)).join(hot, "key").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    said = lambda r, to: r.select("id", *[F.col(c).alias(c + to) for c in ("place", "part", "marks")])
    a = a.join(said(plan, ""), "id").withColumnRenamed("id", "plan_id").drop("salts")
    b = b.join(said(shop, "2"), "id").withColumnRenamed("id", "shop_id").drop("salts")
    e = a.join(b, ["key", "salt"])
    return e.filter(F.round(_stated(), 6) >= ACCEPT).select("plan_id", "shop_id").distinct()


def candidates(plan: DataFrame, shop: DataFrame) -> DataFrame:
    """plan_id, shop_id, weight of the edges that meta-blocking leaves, and, of weight 0, the pairs of `common`."""
    a, b = _keys(plan), _keys(shop)
    size = _sizes(a, b)
    rare = size.filter((F.col("c") <= RARE) & (F.col("what") != "size")).select("key", F.log2(1 + 64.0 / F.col("c")).alias("w"))
    weighs = lambda k, end: k.filter("what != 'size'").select("key", F.col("id").alias(end))
    e = weighs(a, "plan_id").join(rare, "key").join(weighs(b, "shop_id"), "key")
    e = e.groupBy("plan_id", "shop_id").agg(F.sum("w").alias("weight"))
    top = lambda c: F.max("weight").over(Window.partitionBy(c))
    e = e.withColumn("_p", top("plan_id")).withColumn("_s", top("shop_id")).filter("weight * 2 >= least(_p, _s)").drop("_p", "_s")
    return e.unionByName(checkpoint(common(plan, shop, size)).withColumn("weight", F.lit(0.0))).groupBy("plan_id", "shop_id").agg(F.max("weight").alias("weight"))


def _axes(matched: DataFrame) -> DataFrame:
    """Per sheet the similarity a*z + b that takes plan positions to the shop's, by least squares over sums; from two places on."""
    m = matched.filter("x is not null and y is not null and u is not null and v is not null")
    s = m.groupBy("sheet").agg(
        F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.avg("u").alias("mu"), F.avg("v").alias("mv"),
        F.avg(F.col("x") * F.col("x") + F.col("y") * F.col("y")).alias("zz"), F.avg(F.col("x") * F.col("u") + F.col("y") * F.col("v")).alias("re"), F.avg(F.col("x") * F.col("v") - F.col("y") * F.col("u")).alias("im"),
    )
    var = F.col("zz") - F.col("mx") * F.col("mx") - F.col("my") * F.col("my")
    s = s.withColumn("var", var).filter("n >= 2 and var > 400")
    s = s.withColumn("ar", (F.col("re") - F.col("mx") * F.col("mu") - F.col("my") * F.col("mv")) / F.col("var"))
    s = s.withColumn("ai", (F.col("im") - F.col("mx") * F.col("mv") + F.col("my") * F.col("mu")) / F.col("var"))
    s = s.withColumn("det", F.col("ar") * F.col("ar") + F.col("ai") * F.col("ai")).filter("det > 0.01 and det < 100")
    return s.select("sheet", "n", "ar", "ai", "det", "mx", "my", "mu", "mv")


def _back(df: DataFrame) -> DataFrame:
    """With px, py: the shop position in the plan's axes; null where the sheet's axes are unknown."""
    du, dv = F.col("u") - F.col("mu"), F.col("v") - F.col("mv")
    return df.withColumn("px", F.col("mx") + (du * F.col("ar") + dv * F.col("ai")) / F.col("det")).withColumn("py", F.col("my") + (dv * F.col("ar") - du * F.col("ai")) / F.col("det"))


def _stated() -> Column:
    """Similarity by what both records of a row state: place, place2, part, part2, marks, marks2."""
    both = F.size(F.array_intersect("marks", "marks2"))
    small, great = F.least(F.size("marks"), F.size("marks2")), F.size(F.array_union("marks", "marks2"))
    bars = F.when((F.size("marks") > 0) & (F.size("marks2") > 0), 1.5 * both / small + 1.5 * both / great - 0.6).otherwise(0.0)
    same = F.when(F.col("place") == F.col("place2"), 3.0).when(F.col("place").isNull() | F.col("place2").isNull(), 0.0)
    line = lambda c: F.regexp_replace(c, r"[.]\d", "")
    near = F.levenshtein(line("place"), line("place2")) <= 1  # a halved grid line, or one letter
    place = same.otherwise(F.when(near, -0.3).otherwise(-0.9))
    part = F.when(F.col("part").isNull() | F.col("part2").isNull(), 0.0).when(F.col("part") == F.col("part2"), 0.3).otherwise(-1.2)
    return place + bars + part


MOST = 2.4  # what positions add at most


def _placed(off: Column, n: Column) -> Column:
    """Similarity by positions; off: their distance in plan units, null if unknown; n: pairs that fix the axes. Two points fix the axes by themselves and three nearly so: they say little of these points."""
    return F.when(off.isNull() | (n < 3), 0.0).when(off <= NEAR, MOST).when(off <= FAR, 0.0).when(n == 3, -1.0).otherwise(-3.5)


def _edges(pairs: DataFrame, plan: DataFrame, shop: DataFrame) -> DataFrame:
    """pairs with what the rounds need of both ends: base (what they state), same (one place), positions and sheet. Pairs that positions and echoes at their most couldn't bring up to ACCEPT are left out."""
    e = pairs.select("plan_id", "shop_id").join(plan, "plan_id").join(shop, "shop_id").withColumn("base", F.round(_stated(), 6)).filter(F.col("base") + MOST + ECHO * ECHOES >= ACCEPT)
    return e.select("scope", "plan_id", "shop_id", "base", F.coalesce(F.col("place") == F.col("place2"), F.lit(False)).alias("same"), "sheet", "x", "y", "u", "v")


def one_to_one(edges: DataFrame) -> DataFrame:
    """The edges (scope, plan_id, shop_id, s, any others) of a maximal one-to-one choice, taken greedily by (s, ids) within each scope; an end is in one scope only.

    One pass over the edges in that order: it keeps the ends that a scope has taken so far and no edges, and equal records take no pass of their own.
    """

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scope, plans, shops = None, set(), set()
        for b in batches:
            kept = []
            for of, p, s in zip(b.column("scope").to_pylist(), b.column("plan_id").to_pylist(), b.column("shop_id").to_pylist()):
                if of != scope:
                    scope, plans, shops = of, set(), set()
                if free := p not in plans and s not in shops:
                    plans.add(p)
                    shops.add(s)
                kept.append(free)
            yield b.filter(pa.array(kept, pa.bool_()))

    return checkpoint(edges.repartition("scope").sortWithinPartitions("scope", F.desc("s"), "plan_id", "shop_id").mapInArrow(take, edges.schema))


def neighbours(records: DataFrame, sheet: list[str]) -> DataFrame:
    """id, other: the records before and after each along x and along y within its sheet; turning the axes by quarters doesn't change them."""
    r, out = records.filter("x is not null and y is not null").select("id", "x", "y", *sheet), None
    for a, b in (("x", "y"), ("y", "x")):
        w = Window.partitionBy(*sheet).orderBy(F.round(a, 0), b, "id")
        n = r.select("id", F.lead("id").over(w).alias("other")).filter("other is not null")
        n = n.unionByName(n.select(F.col("other").alias("id"), F.col("id").alias("other")))
        out = n if out is None else out.unionByName(n)
    return out.distinct()


def echoes(matched: DataFrame, plan_next: DataFrame, shop_next: DataFrame) -> DataFrame:
    """plan_id, shop_id, echo: the similarity that accepted pairs of neighbours lend a pair."""
    m = matched.join(plan_next.select(F.col("id").alias("plan_id"), F.col("other").alias("p")), "plan_id").join(shop_next.select(F.col("id").alias("shop_id"), F.col("other").alias("s_")), "shop_id")
    return m.groupBy(F.col("p").alias("plan_id"), F.col("s_").alias("shop_id")).agg((F.least(F.count("*"), F.lit(ECHOES)) * ECHO).alias("echo"))


def _heaviest(records: DataFrame, fixed: DataFrame, end: str, *named: str) -> DataFrame:
    """The named columns of records with `top_` and the name of their end: the weight of the heaviest edge, 0 without one."""
    top = fixed.groupBy(end).agg(F.max("weight").alias(f"top_{end}"))
    return checkpoint(records.select(end, *named).join(top, end, "left").fillna(0.0, [f"top_{end}"]))


def _by_cell(plan: DataFrame, shop: DataFrame, axes: DataFrame) -> DataFrame:
    """plan_id, shop_id of the edges by cells of the drawing that meta-blocking leaves: the block of a shop record holds the plan's records around the place that the axes give it.

    Both sides have the heaviest weights of their ends.
    """
    cell = lambda c: F.floor(F.col(c) / CELL).cast("int")
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    here = _back(shop.join(axes, "sheet")).filter("px is not null").select("shop_id", F.col("scope2").alias("scope"), "top_shop_id", "px", "py")
    here = here.withColumn("dx", F.explode(around)).withColumn("dy", F.explode(around)).select("shop_id", "scope", "top_shop_id", (cell("px") + F.col("dx")).alias("cx"), (cell("py") + F.col("dy")).alias("cy"), "px", "py")
    there = plan.select("plan_id", "scope", "top_plan_id", "x", "y", cell("x").alias("cx"), cell("y").alias("cy"))
    e = there.join(here, ["scope", "cx", "cy"]).withColumn("d", F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py"))).filter(F.col("d") <= FAR)
    # a block has one shop record; near places weigh twice
    e = e.withColumn("w", F.log2(1 + 64.0 / F.count("*").over(Window.partitionBy("shop_id"))) * F.when(F.col("d") <= NEAR, 2).otherwise(1))
    return e.filter(F.col("w") * 2 >= F.least("top_plan_id", "top_shop_id")).select("plan_id", "shop_id")


def link(plan_records: DataFrame, shop_records: DataFrame) -> DataFrame:
    """atelier_id, plan_id, similarity, confidence."""
    plan = checkpoint(attributes(plan_records, True))
    shop = checkpoint(attributes(shop_records, False))
    fixed = checkpoint(candidates(plan, shop))
    p = plan.select(F.col("id").alias("plan_id"), "scope", "place", "part", "marks", "x", "y")
    s = shop.select(F.col("id").alias("shop_id"), F.col("scope").alias("scope2"), "sheet", F.col("place").alias("place2"), F.col("part").alias("part2"), F.col("marks").alias("marks2"), F.col("x").alias("u"), F.col("y").alias("v"))
    edges = checkpoint(_edges(fixed, p, s))
    plan_next = shop_next = plan_top = shop_top = matched = None
    seen: set = set()
    while True:
        if matched is None:
            e = edges.withColumn("off", F.lit(None).cast("double")).withColumn("s", F.col("base"))
        else:
            if plan_next is None:
                plan_next, shop_next = checkpoint(neighbours(plan, ["scope"])), checkpoint(neighbours(shop, ["scope", "sheet"]))
                plan_top, shop_top = _heaviest(p, fixed, "plan_id", "scope", "x", "y"), _heaviest(s, fixed, "shop_id", "scope2", "sheet", "u", "v")
            axes = checkpoint(_axes(matched.filter("s >= 3 and (same or off <= 9)")))
            more = _by_cell(plan_top, shop_top, axes).join(fixed.select("plan_id", "shop_id"), ["plan_id", "shop_id"], "left_anti")
            e = _back(edges.unionByName(_edges(more, p, s)).join(axes, "sheet", "left"))
            e = e.withColumn("off", F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py")))
            e = e.join(echoes(matched.select("plan_id", "shop_id"), plan_next, shop_next), ["plan_id", "shop_id"], "left")
            e = e.withColumn("s", F.round(F.col("base") + _placed(F.col("off"), F.col("n")) + F.coalesce("echo", F.lit(0.0)), 6))
        matched = one_to_one(e.filter(F.col("s") >= ACCEPT).select("scope", "plan_id", "shop_id", "s", "off", "same", "sheet", "x", "y", "u", "v"))
        now = matched.agg(F.count("*"), F.sum(F.xxhash64("plan_id", "shop_id").cast("decimal(38,0)"))).first()
        if now in seen:
            break
        seen.add(now)
    sim = F.col("s")
    return matched.select(F.col("shop_id").alias("atelier_id"), "plan_id", sim.alias("similarity"), F.round(1 / (1 + F.exp(-(sim - ACCEPT + 0.5))), 4).alias("confidence"))


def found(plan: DataFrame, atelier: DataFrame) -> DataFrame:
    return link(plan, atelier).select("atelier_id", "plan_id")
