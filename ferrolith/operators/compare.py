"""Comparison of the two sides: exact keys, slabs against both layers, neighbouring places, then bars one to one.

Keys meet by equi-joins, within a project and lot only; neighbours are candidates within a scope (project, lot, kind, level,
layer) by the printed positions of the lot's grid, looked up on the other axis, so that no scope is crossed with itself; they
are chosen greedily in one pass over (stage, distance, not identical, keys).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrolith.functions.grammar import grid_letter, grid_number
from ferrolith.operators.matching import greedy, match_bars
from ferrolith.operators.normalize import KEY, aligned, keyed
from ferrolith.session import checkpoint

SITE = ["project", "lot"]
REACH = 4


def observations(records: DataFrame, plan: bool) -> DataFrame:
    """KEY, spec (bars with roles), seq, id of each observation; the same observation at the same place counts once."""
    r = keyed(aligned(records))
    if plan:  # the shop's slab sheets are those of the integrity steel
        r = r.filter((F.col("kind") != "dalle") | (F.coalesce(F.col("debug.reinforcement_kind"), F.lit("")) == "integrity"))
    said = F.to_json(F.struct("spec", "debug.role", "debug.direction"), {"ignoreNullFields": "false"})
    first = F.min_by(F.struct("seq", "id", "spec"), F.struct("seq", "id")).alias("o")
    return r.groupBy(*KEY, "fichier", "page", F.round("x", 1).alias("_x"), F.round("y", 1).alias("_y"), said.alias("_said")).agg(first).select(*KEY, "o.*")


def groups(records: DataFrame, plan: bool) -> DataFrame:
    """KEY, bars (array, in order of the records), ids. A group holds the observations of one place in one lot."""
    g = observations(records, plan).groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("seq", "id", "spec"))).alias("o"))
    return g.select(*KEY, F.flatten(F.transform("o", lambda x: x["spec"])).alias("bars"), F.array_sort(F.transform("o", lambda x: x["id"])).alias("ids"))


def one_sided(plan: DataFrame, shop: DataFrame) -> DataFrame:
    """KEY and side of the keys that one side only has."""
    a, b = plan.select(*KEY).distinct(), shop.select(*KEY).distinct()
    return a.join(b, KEY, "left_anti").withColumn("side", F.lit("plan")).unionByName(b.join(a, KEY, "left_anti").withColumn("side", F.lit("atelier")))


def steps(keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Printed positions of letters (halves count with the whole letter) and of numbers, over all keys of a project and lot."""
    p = keys.select(*SITE, F.floor(grid_letter(F.col("place"))).alias("letter"), grid_number(F.col("place")).alias("number")).filter("letter is not null")
    rank = lambda c: F.dense_rank().over(Window.partitionBy(*SITE).orderBy(c)) - 1
    return p.select(*SITE, "letter").distinct().select(*SITE, "letter", rank("letter").alias("lp")), p.select(*SITE, "number").distinct().select(*SITE, "number", rank("number").alias("np"))


def _scope(layer: Column, kind: Column) -> Column:
    return F.when((kind == "dalle") & layer.contains("INCONNU"), "HAUT+BAS").otherwise(layer)


def neighbours(plan: DataFrame, shop: DataFrame, all_keys: DataFrame) -> DataFrame:
    """Candidate pairs of lone keys: p_place, s_place, scope columns, stage (1 to 4), distance."""
    letters, numbers = steps(all_keys)
    scope = [*SITE, "kind", "level", "scope"]

    def placed(df: DataFrame, side: str) -> DataFrame:
        x = df.withColumn("l", grid_letter(F.col("place"))).withColumn("number", grid_number(F.col("place"))).filter("l is not null")
        x = x.withColumn("letter", F.floor("l")).join(letters, [*SITE, "letter"]).join(numbers, [*SITE, "number"])
        return x.select(*SITE, "kind", "level", _scope(F.col("layer"), F.col("kind")).alias("scope"), F.col("layer").alias(f"{side}_layer"), F.col("place").alias(f"{side}_place"), F.col("l").alias(f"{side}_l"), F.col("number").alias(f"{side}_n"), F.col("lp").alias(f"{side}_lp"), F.col("np").alias(f"{side}_np"))

    a, b = placed(plan, "p"), placed(shop, "s")
    near = F.sequence(F.lit(-REACH), F.lit(REACH))
    # on one line, at most REACH positions along it; or less than one unit on both axes
    by_l = a.withColumn("k", F.explode(near)).withColumn("at", F.col("p_np") + F.col("k"))
    c1 = by_l.join(b.withColumn("at", F.col("s_np")), [*scope, "at"]).filter("p_lp = s_lp and k != 0").withColumn("stage", F.abs("k"))
    by_n = a.withColumn("k", F.explode(near)).withColumn("at", F.col("p_lp") + F.col("k"))
    c2 = by_n.join(b.withColumn("at", F.col("s_lp")), [*scope, "at"]).filter("p_n = s_n and k != 0").withColumn("stage", F.abs("k"))
    one = F.array(F.lit(-1), F.lit(0), F.lit(1))
    box = a.withColumn("dx", F.explode(one)).withColumn("dy", F.explode(one)).withColumn("bx", F.floor("p_l") + F.col("dx")).withColumn("by", F.floor("p_n") + F.col("dy"))
    c3 = box.join(b.withColumn("bx", F.floor("s_l")).withColumn("by", F.floor("s_n")), [*scope, "bx", "by"]).filter((F.abs(F.col("p_l") - F.col("s_l")) < 1) & (F.abs(F.col("p_n") - F.col("s_n")) < 1)).withColumn("stage", F.lit(1))
    cols = [*scope, "p_layer", "p_place", "s_layer", "s_place", "stage", (F.abs(F.col("p_l") - F.col("s_l")) + F.abs(F.col("p_n") - F.col("s_n"))).alias("distance")]
    u = c1.select(*cols).unionByName(c2.select(*cols)).unionByName(c3.select(*cols))
    return u.groupBy(*scope, "p_layer", "p_place", "s_layer", "s_place").agg(F.min("stage").alias("stage"), F.min("distance").alias("distance"))


def per_diameter(bars: Column) -> Column:
    """Slab totals: per diameter, in order of appearance, the sum of the quantities, a missing one being 0."""
    d = F.array_distinct(F.transform(bars, lambda b: b["diametre"]))
    total = lambda x: F.aggregate(F.filter(bars, lambda b: b["diametre"].eqNullSafe(x)), F.lit(0), lambda s, b: s + F.coalesce(b["quantite"], F.lit(0)))
    none = F.lit(None)
    return F.transform(d, lambda x: F.struct(F.lit("").alias("role"), x.alias("diametre"), total(x).alias("quantite"), none.cast("double").alias("espacement_mm"), none.cast("double").alias("longueur_mm"), none.cast("string").alias("repere")))


def compare(plan_records: DataFrame, shop_records: DataFrame) -> DataFrame:
    """Elements that both sides have and whose bars differ: project, lot, kind, level, layer, plan_element, atelier_element, coordinate_match, matched, missing, extra, bars and ids of both."""
    a = checkpoint(groups(plan_records, True))
    b = groups(shop_records, False)
    # steel that the plan gives no layer is held against both layers of the shop together
    open_ = a.filter("kind = 'dalle' and layer like '%INCONNU%'").select(*SITE, "kind", "level").distinct()
    both = b.filter("layer in ('HAUT', 'BAS')").join(open_, [*SITE, "kind", "level"], "left_semi")
    rest = b.join(both.select(*KEY), KEY, "left_anti")
    union = both.groupBy(*SITE, "kind", "level", "place").agg(F.flatten(F.collect_list("bars")).alias("bars"), F.flatten(F.collect_list("ids")).alias("ids"))
    b = checkpoint(rest.unionByName(union.select(*SITE, "kind", "level", F.lit("HAUT+BAS").alias("layer"), "place", "bars", "ids")))
    pa, pb = a.select(*KEY), b.select(*KEY)
    exact = pa.join(pb, KEY).select(*SITE, "kind", "level", F.col("layer").alias("p_layer"), F.col("place").alias("p_place"), F.col("layer").alias("s_layer"), F.col("place").alias("s_place"), F.lit("exact").alias("coordinate_match"))
    lone_a, lone_b = pa.join(pb, KEY, "left_anti"), pb.join(pa, KEY, "left_anti")
    slabs = lone_a.filter("kind = 'dalle' and layer like '%INCONNU%'").withColumnRenamed("layer", "p_layer").join(lone_b.filter("layer = 'HAUT+BAS'").withColumnRenamed("layer", "s_layer"), [*SITE, "kind", "level", "place"])
    slabs = slabs.select(*SITE, "kind", "level", "p_layer", F.col("place").alias("p_place"), "s_layer", F.col("place").alias("s_place"), F.lit("couche").alias("coordinate_match"))
    used_a = slabs.select(*SITE, "kind", "level", F.col("p_layer").alias("layer"), F.col("p_place").alias("place"))
    used_b = slabs.select(*SITE, "kind", "level", F.col("s_layer").alias("layer"), F.col("s_place").alias("place"))
    cand = checkpoint(neighbours(lone_a.join(used_a, KEY, "left_anti"), lone_b.join(used_b, KEY, "left_anti"), pa.unionByName(pb).distinct()))
    ends = [*SITE, "kind", "level", "p_layer", "p_place", "s_layer", "s_place"]

    def with_bars(pairs: DataFrame, keep: list[str]) -> DataFrame:
        l = a.select(*SITE, "kind", "level", F.col("layer").alias("p_layer"), F.col("place").alias("p_place"), F.col("bars").alias("a"), F.col("ids").alias("plan_ids"))  # noqa: E741
        r = b.select(*SITE, "kind", "level", F.col("layer").alias("s_layer"), F.col("place").alias("s_place"), F.col("bars").alias("b"), F.col("ids").alias("atelier_ids"))
        return pairs.join(l, [*SITE, "kind", "level", "p_layer", "p_place"]).join(r, [*SITE, "kind", "level", "s_layer", "s_place"]).select(*ends, *keep, "a", "b", "plan_ids", "atelier_ids")

    same = match_bars(with_bars(cand.select(*ends), []), ends).select(*ends, "identical")
    near = greedy(cand.join(same, ends), [*SITE, "kind", "level", "p_layer", "p_place"], [*SITE, "kind", "level", "s_layer", "s_place"], [F.col("stage"), F.col("distance"), (~F.col("identical")).cast("int").alias("other")])
    pairs = exact.unionByName(slabs).unionByName(near.select(*ends, F.lit("proche").alias("coordinate_match")))
    x = with_bars(pairs, ["coordinate_match"])
    slab = (F.col("kind") == "dalle") & F.col("p_layer").contains("INCONNU")
    common = F.array_intersect(F.transform("a", lambda v: v["role"]), F.transform("b", lambda v: v["role"]))
    only = lambda c: F.filter(c, lambda v: F.array_contains(common, v["role"]))
    by_role = (F.col("kind") == "dalle") & (F.size("a") > 0) & (F.size("b") > 0)
    x = x.withColumn("_a", F.when(slab, per_diameter(F.col("a"))).when(by_role, only("a")).otherwise(F.col("a"))).withColumn("_b", F.when(slab, per_diameter(F.col("b"))).when(by_role, only("b")).otherwise(F.col("b")))
    x = checkpoint(x.drop("a", "b").withColumnRenamed("_a", "a").withColumnRenamed("_b", "b"))
    m = match_bars(x, ends)
    out = x.join(m, ends).filter((F.size("missing") > 0) | (F.size("extra") > 0))
    layer = F.when(slab, F.col("s_layer")).otherwise(F.col("p_layer"))
    return out.select(*SITE, "kind", "level", layer.alias("layer"), F.col("p_place").alias("plan_element"), F.col("s_place").alias("atelier_element"), "coordinate_match", "matched", "missing", "extra", "a", "b", "plan_ids", "atelier_ids")
