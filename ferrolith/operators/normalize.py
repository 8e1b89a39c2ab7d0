"""Representation of records in one vocabulary: columns, beams, and the shared form of the other kinds.

Everything is DataFrame -> DataFrame over records with `armature` (array of bars) and `debug.roles`. Bars are taken apart
with their position and put together again in order, so no order depends on how rows are spread. All are idempotent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrolith.functions.grammar import coordinate_key, level_key, role
from ferrolith.functions.places import lot
from ferrolith.functions.text import fold


def exploded(records: DataFrame, *keep: str) -> DataFrame:
    """id, keep..., pos, bar fields, label (the role at that place or the record's)."""
    label = F.coalesce(F.try_element_at(F.col("debug.roles"), F.col("pos") + 1), F.col("debug.role"))
    x = records.select("id", *keep, "debug", F.posexplode("armature").alias("pos", "b"))
    return x.select("id", *keep, "pos", "b.*", label.alias("label"))


def column_specs(records: DataFrame) -> DataFrame:
    """Primary specification of each column: id, entry, role, diametre, quantite, espacement_mm.

    Vertical bars are summed per diameter, null as soon as one quantity is; ties are the distinct (diameter, spacing);
    entries come in order of first appearance, verticals first.
    """
    b = exploded(records.filter("type_element = 'colonne'"))
    said = F.coalesce(F.when(F.col("label") != "", F.upper(F.col("label"))), F.when(F.col("espacement_mm").isNotNull(), "ETRI").otherwise("VERT"))
    b = b.withColumn("role", F.when(F.translate(said, "É", "E").startswith("ETRI"), "ETRI").otherwise(said))
    vert = b.filter("role = 'VERT' and espacement_mm is null").groupBy("id", "role", "diametre").agg(
        F.when(F.count("*") == F.count("quantite"), F.sum("quantite")).cast("int").alias("quantite"), F.min("pos").alias("first"))
    ties = b.filter("role = 'ETRI' and espacement_mm is not null").groupBy("id", "role", "diametre", "espacement_mm").agg(F.min("pos").alias("first"))
    x = vert.withColumn("espacement_mm", F.lit(None).cast("double")).unionByName(ties.withColumn("quantite", F.lit(None).cast("int")))
    from pyspark.sql import Window

    w = Window.partitionBy("id").orderBy(F.desc("role"), "first")
    return x.withColumn("entry", F.row_number().over(w)).select("id", "entry", "role", "diametre", "quantite", "espacement_mm")


BEAM_KEY = ["source", "fichier", "feuillet", "page", "niveau", "element", "view"]


def beams(records: DataFrame) -> DataFrame:
    """One row per beam: records of one view, storey and element are put together, exactly repeated observations once; unlocated beams stay alone.

    Returns the key, records, bars, confidence (least), x and y of the first record.
    """
    b = records.filter("type_element = 'poutre'").select(
        "source", "fichier", "feuillet", "page", F.col("debug.niveau").alias("niveau"), "element", F.col("debug.view").alias("view"), "seq", "id", "x", "y", "armature", F.col("debug.confidence").alias("confidence"), F.col("debug.roles").alias("roles"))
    b = b.withColumn("alone", F.when(F.col("element") == "UNKNOWN", F.col("id")).otherwise(""))
    b = b.withColumn("said", F.to_json(F.struct("x", "y", "armature", "roles"), {"ignoreNullFields": "false"}))
    each = b.groupBy(*BEAM_KEY, "alone", "said").agg(F.min_by(F.struct("seq", F.size("armature").alias("n"), "x", "y"), "seq").alias("o"), F.count("*").alias("times"), F.min("confidence").alias("confidence"))
    return each.groupBy(*BEAM_KEY, "alone").agg(
        F.sum("times").alias("records"), F.sum("o.n").alias("bars"), F.min("confidence").alias("confidence"), F.min_by("o.x", "o.seq").alias("x"), F.min_by("o.y", "o.seq").alias("y"))


ORDER = {"semelle": ["LONG", "TRAN"], "dalle": ["NUM", "ALP"], "poutre": ["longitudinale", "peau", "étriers"], "radier": ["horizontal", "vertical"]}


def role_rank(kind: Column, r: Column) -> Column:
    out = None
    for k, names in ORDER.items():
        c = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, names)), r), F.lit(0)), F.lit(len(names) + 1))
        out = F.when(kind == k, c) if out is None else out.when(kind == k, c)
    return out.otherwise(99)


def shared_bars(records: DataFrame) -> DataFrame:
    """Bars of footings, slabs, beams and mats in the shared form: id, kind, entry, role, diametre, quantite, espacement_mm, longueur_mm.

    Marks are left out; pieces are no requirement where a spacing is (mats, skin bars, stirrups). Bars stand in the order of
    roles, within a role as they came.
    """
    from pyspark.sql import Window

    r = records.filter(F.col("type_element").isin(*ORDER))
    b = exploded(r, "type_element").withColumnRenamed("type_element", "kind")
    n = F.count("*").over(Window.partitionBy("id"))
    hint = F.when((F.col("kind") == "semelle") & F.col("label").isNull() & (n == 2), F.when(F.col("pos") == 0, "LONG").otherwise("TRAN"))
    direction = r.select("id", F.col("debug.direction").alias("direction"))
    b = b.join(direction, "id").withColumn("label", F.when(F.col("kind") == "radier", F.col("direction")).otherwise(F.coalesce("label", hint)))
    b = b.withColumn("role", role(F.col("kind"), F.col("label")))
    pieces = ((F.col("kind") == "radier") | ((F.col("kind") == "poutre") & F.col("role").isin("peau", "étriers"))) & F.col("espacement_mm").isNotNull()
    b = b.withColumn("quantite", F.when(~pieces, F.col("quantite")))
    w = Window.partitionBy("id").orderBy(role_rank(F.col("kind"), F.col("role")), "pos")
    return b.withColumn("entry", F.row_number().over(w)).select("id", "kind", "entry", "role", "diametre", "quantite", "espacement_mm", "longueur_mm")


def missing_roles(records: DataFrame) -> DataFrame:
    """id, missing: roles that a footing or a slab of integrity steel should have and hasn't."""
    have = shared_bars(records).groupBy("id", "kind").agg(F.collect_set("role").alias("have"))
    layer = records.select("id", fold(F.coalesce("debug.layer", "debug.reinforcement_kind")).alias("layer"))
    need = F.when(F.col("kind") == "semelle", F.array(F.lit("LONG"), F.lit("TRAN"))).when((F.col("kind") == "dalle") & (F.col("layer") == "INTEGRITE"), F.array(F.lit("NUM"), F.lit("ALP")))
    return have.join(layer, "id").select("id", "kind", F.array_join(F.array_sort(F.array_except(need, "have")), ",").alias("missing")).filter("missing is not null and missing != ''")


BAR = "struct<role:string,diametre:string,quantite:int,espacement_mm:double,longueur_mm:double,repere:string>"


def _struct(r: Column, b: Column, **other: Column) -> Column:
    f = {c: b[c] for c in ("diametre", "quantite", "espacement_mm", "longueur_mm", "repere")} | other
    return F.struct(r.alias("role"), *[v.alias(c) for c, v in f.items()]).cast(BAR)


def _column_bars(bars: Column, roles: Column, own: Column, limit: Column) -> Column:
    """Primary specification of a column as an array: verticals per diameter (quantity null as soon as one is), then ties per diameter and spacing, in order of appearance."""
    none = F.lit(None)
    said = lambda b, i: F.upper(F.coalesce(F.nullif(F.try_element_at(roles, i + 1), F.lit("")), F.nullif(own, F.lit("")), F.when(b["espacement_mm"].isNotNull(), "ETRI").otherwise("VERT")))
    tagged = F.transform(F.slice(bars, 1, F.least(F.size(bars), limit)), lambda b, i: F.struct(F.when(F.translate(said(b, i), "É", "E").startswith("ETRI"), "ETRI").otherwise(said(b, i)).alias("r"), b.alias("b")))
    vert = F.transform(F.filter(tagged, lambda t: (t["r"] == "VERT") & t["b"]["espacement_mm"].isNull()), lambda t: t["b"])
    sizes = F.array_distinct(F.transform(vert, lambda b: b["diametre"]))
    total = lambda d: F.aggregate(F.filter(vert, lambda b: b["diametre"].eqNullSafe(d)), F.lit(0), lambda n, b: n + b["quantite"])
    one = lambda r, d, q, sp: F.struct(F.lit(r).alias("role"), d.alias("diametre"), q.cast("int").alias("quantite"), sp.cast("double").alias("espacement_mm"), none.cast("double").alias("longueur_mm"), none.cast("string").alias("repere")).cast(BAR)
    ties = F.array_distinct(F.transform(F.filter(tagged, lambda t: (t["r"] == "ETRI") & t["b"]["espacement_mm"].isNotNull()), lambda t: F.struct(t["b"]["diametre"].alias("d"), t["b"]["espacement_mm"].alias("s"))))
    return F.concat(F.transform(sizes, lambda d: one("VERT", d, total(d), none)), F.transform(ties, lambda t: one("ETRI", t["d"], none, t["s"])))


def _before_low_wall(raw: Column, source: Column) -> Column:
    """How many bars of a shop column come before the line of a low wall drawn beside it: the bar lines above it; no bound without one."""
    from ferrolith.functions.grammar import BAR_LIKE

    at = F.array_min(F.filter(F.transform(raw, lambda t, i: F.when(t.rlike(r"(?i)^\s*MURET\b"), i)), lambda i: i.isNotNull()))
    lines = F.size(F.filter(F.slice(raw, 1, F.coalesce(at, F.lit(0))), lambda t: t.rlike(BAR_LIKE)))
    return F.when((source == "atelier") & at.isNotNull(), lines).otherwise(F.lit(1 << 30))


def aligned(records: DataFrame) -> DataFrame:
    """Records with spec: their bars in the shared form, as one array each and without any shuffle.

    Columns have their primary specification; footings, slabs, beams and mats their bars in the order of roles, without marks,
    pieces left out where a spacing is the requirement; other kinds their bars as they are. Null armature is as none.
    """
    kind, d = F.col("type_element"), F.col("debug")
    bars = F.coalesce("armature", F.array().cast(dict(records.dtypes)["armature"]))
    roles = F.coalesce(d["roles"], F.array().cast("array<string>"))
    raw = F.coalesce(d["raw"], F.array().cast("array<string>"))
    hints = F.array_compact(F.transform(F.transform(raw, lambda t: fold(t)), lambda t: F.when(t.rlike(r"ARM\.?\s*LONG"), "LONG").when(t.rlike(r"ARM\.?\s*TRANS"), "TRAN")))
    n = F.size(bars)
    told = F.when(F.size(hints) == n, hints).when(n == 2, F.array(F.lit("LONG"), F.lit("TRAN"))).otherwise(F.array().cast("array<string>"))
    labels = F.when(kind == "radier", F.transform(bars, lambda b: d["direction"])).when((kind == "semelle") & (F.size(roles) == 0), told).otherwise(roles)
    label = lambda i: F.coalesce(F.try_element_at(labels, i + 1), d["role"])
    pieces = lambda b, r: F.when(~(((kind == "radier") | ((kind == "poutre") & r.isin("peau", "étriers"))) & b["espacement_mm"].isNotNull()), b["quantite"])
    tagged = F.transform(bars, lambda b, i: F.struct(role(kind, label(i)).alias("r"), i.alias("i"), b.alias("b")))
    ranked = F.array_sort(F.transform(tagged, lambda t: F.struct(role_rank(kind, t["r"]).alias("k"), t["i"].alias("i"), t["r"].alias("r"), t["b"].alias("b"))))
    shared = F.transform(ranked, lambda t: _struct(fold(t["r"]), t["b"], quantite=pieces(t["b"], t["r"]), repere=F.lit(None).cast("string")))
    plain = F.transform(bars, lambda b, i: _struct(F.coalesce(fold(label(i)), F.lit("")), b))
    columns = _column_bars(bars, roles, d["role"], _before_low_wall(raw, F.col("source")))
    spec = F.when(kind == "colonne", columns).when(kind.isin(*ORDER), shared).otherwise(plain)
    stirrup = F.transform(spec, lambda b: b.withField("role", F.when(b["role"].isin("ETRIERS", "ETRIER"), "ETRI").otherwise(b["role"])))
    return records.withColumn("spec", stirrup)


KEY = ["project", "lot", "kind", "level", "layer", "place"]


def keyed(records: DataFrame) -> DataFrame:
    """records with KEY, under which both sides meet: project and lot (as its file names it), kind, storey, layer and place. Only records of one project and lot ever meet.

    A mat without storey is the foundation's, its layer the rang without that word; a slab's layer is HAUT, BAS or INTEGRITE, else INCONNU.
    """
    kind, d = F.col("type_element"), F.col("debug")
    said = F.coalesce(fold(d["layer"]), F.lit(""))
    slab = F.coalesce(F.nullif(said, F.lit("")), fold(d["reinforcement_kind"]))
    slab = F.when(slab.isin("INTEGRITE", "HAUT", "BAS"), slab).otherwise("INCONNU")
    rang = F.coalesce(F.nullif(F.btrim(F.regexp_replace(said, r"^RANGS?\s*", ""), F.lit(" :")), F.lit("")), F.lit("INCONNU"))
    mat = F.concat(rang, F.lit(" · "), fold(role(F.lit("radier"), d["direction"])))
    level = level_key(d["niveau"], kind)
    project = F.coalesce(fold(F.col("project")), F.lit("")) if "project" in records.columns else F.lit("")
    return records.select(
        project.alias("project"), F.coalesce(lot(F.col("fichier")), F.lit("")).alias("lot"), kind.alias("kind"), F.when((kind == "radier") & (level == ""), "FONDATION").otherwise(level).alias("level"),
        F.when(kind == "dalle", slab).when(kind == "radier", mat).otherwise(said).alias("layer"), coordinate_key(F.col("element")).alias("place"), *[c for c in records.columns if c not in KEY])
