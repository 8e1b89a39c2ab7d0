"""Deduplication with conflicts, supersession, unique ids, correspondence of views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def signature(bars: Column, fields: list[str]) -> Column:
    """What bars state, whatever their order; repeated bars count as often as they come."""
    return F.to_json(F.array_sort(F.transform(bars, lambda b: F.struct(*[b[f].alias(f) for f in fields]))), {"ignoreNullFields": "false"})


def deduplicate(rows: DataFrame, identity: list[str], sign: str, quality: list[Column], seq: str) -> DataFrame:
    """One row per identity and signature, the first of greatest quality; with `removed` (rows it stands for beyond itself) and `duplicate_conflict` (its identity has other signatures)."""
    rows = rows.drop("removed", "duplicate_conflict")  # what an earlier run said of them
    w = Window.partitionBy(*identity, sign)
    x = rows.withColumn("_n", F.row_number().over(w.orderBy(*[q.desc_nulls_last() for q in quality], seq))).withColumn("removed", F.count("*").over(w) - 1).filter("_n = 1").drop("_n")
    many = x.groupBy(*identity).agg(F.count("*").alias("_v"))
    same = [F.col(f"x.{c}").eqNullSafe(F.col(f"m.{c}")) for c in identity]
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    return x.alias("x").join(many.alias("m"), cond).select("x.*", (F.col("m._v") > 1).alias("duplicate_conflict"))


def superseded(rows: DataFrame, by: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """rows without those whose key `by` holds, and these as evidence."""
    k = by.select(*key).distinct()
    return rows.join(k, key, "left_anti"), rows.join(k, key, "left_semi")


def unique_ids(rows: DataFrame, key: str, order: list) -> DataFrame:
    """With uid: the id, and '#k' added from its second occurrence on, in order."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("uid", F.when(n == 1, F.col(key)).otherwise(F.concat(F.col(key), F.lit("#"), n.cast("string"))))


def offsets(axes: DataFrame, main: str, tolerance: float = 3.0, least: int = 3) -> DataFrame:
    """axes (view, kind, label, at): view, kind, offset of the views that shift all of at least `least` labels shared with the main view alike.

    The offset is the upper median of the label's shifts.
    """
    m = axes.filter(F.col("view") == main).select("kind", "label", F.col("at").alias("main_at"))
    s = axes.filter(F.col("view") != main).join(m, ["kind", "label"]).withColumn("shift", F.col("main_at") - F.col("at"))
    g = s.groupBy("view", "kind").agg(F.count("*").alias("n"), F.max("shift").alias("hi"), F.min("shift").alias("lo"), F.sort_array(F.collect_list("shift")).alias("v"))
    return g.filter((F.col("n") >= least) & (F.col("hi") - F.col("lo") <= tolerance)).select("view", "kind", F.element_at("v", (F.floor(F.col("n") / 2) + 1).cast("int")).alias("offset"))


def aliases(axes: DataFrame, main: str, tolerance: float = 3.0) -> DataFrame:
    """view, kind, label, alias: labels of aligned views that lie on exactly one label of the main view, and it on them alone."""
    o = offsets(axes, main, tolerance)
    m = axes.filter(F.col("view") == main).select("kind", F.col("label").alias("alias"), F.col("at").alias("main_at"))
    v = axes.join(o, ["view", "kind"]).withColumn("there", F.col("at") + F.col("offset"))
    cell = lambda c: F.floor(c / tolerance).cast("long")
    v = v.withColumn("c", F.explode(F.array(*[cell(F.col("there")) + d for d in (-1, 0, 1)])))
    p = v.join(m.withColumn("c", cell(F.col("main_at"))), ["kind", "c"]).filter(F.abs(F.col("there") - F.col("main_at")) <= tolerance)
    p = p.withColumn("_a", F.count("*").over(Window.partitionBy("view", "kind", "label"))).withColumn("_b", F.count("*").over(Window.partitionBy("view", "kind", "alias")))
    return p.filter("_a = 1 and _b = 1").select("view", "kind", "label", "alias")


def catalog(rows: DataFrame, key: list[str], value: list[str]) -> DataFrame:
    """key, value, status: the one value that all rows of a key state ('read'), nulls where they differ ('conflicting') or state none ('unread')."""
    known = F.when(F.col(value[0]).isNotNull(), F.struct(*value))
    g = rows.groupBy(*key).agg(F.min(known).alias("lo"), F.max(known).alias("hi"))
    one = F.col("lo").eqNullSafe(F.col("hi"))
    status = F.when(F.col("lo").isNull(), "unread").when(one, "read").otherwise("conflicting")
    return g.select(*key, *[F.when(one, F.col("lo")[v]).alias(v) for v in value], status.alias("status"))


def strongest(rows: DataFrame, identity: list[str], confidence: str, seq: str) -> DataFrame:
    """One row per identity, the first of greatest confidence, with `place`, the place of the identity's first row, by which they're written."""
    w = Window.partitionBy(*identity)
    x = rows.withColumn("place", F.min(seq).over(w)).withColumn("_n", F.row_number().over(w.orderBy(F.col(confidence).desc_nulls_last(), seq)))
    return x.filter("_n = 1").drop("_n")


def identified(rows: DataFrame, aliases: DataFrame, offsets_: DataFrame, main: str) -> DataFrame:
    """rows (view, letter, number) with view and labels of the main view where their view is aligned with it on both axes; else as they are."""
    both = offsets_.groupBy("view").agg(F.countDistinct("kind").alias("_k")).filter("_k = 2").select("view", F.lit(True).alias("_on"))
    of = lambda kind, c: aliases.filter(F.col("kind") == kind).select("view", F.col("label").alias(c), F.col("alias").alias(f"_{c}"))
    x = rows.join(both, "view", "left").join(of("letter", "letter"), ["view", "letter"], "left").join(of("number", "number"), ["view", "number"], "left")
    on = F.coalesce("_on", F.lit(False))
    return x.select(*[c for c in rows.columns if c not in ("view", "letter", "number")], F.when(on, F.lit(main)).otherwise(F.col("view")).alias("view"), F.when(on, F.coalesce("_letter", "letter")).otherwise(F.col("letter")).alias("letter"), F.when(on, F.coalesce("_number", "number")).otherwise(F.col("number")).alias("number"))
