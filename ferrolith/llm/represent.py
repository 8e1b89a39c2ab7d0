"""Best representative of each group of duplicates: consistent bundles chosen by branch and bound.

A record is cut into bundles, groups of fields that only make sense together (the drawing: project and file; the statement:
storey, layer and bars; the view: page and view), each with a trust of its own. For each group of duplicates and each bundle
one record supplies the whole bundle. Among all choices that keep the functional dependencies (equal determinants, equal
dependents, across bundles) the one with the greatest trust, compared lexicographically, wins; branch and bound visits the
bundles in order, the best candidate first, and leaves a branch as soon as the trust it can still reach isn't greater than
the best found. The dependencies bear on the result: a statement by itself knows no issue and would be taken from an older one,
a view by itself from another file.

Of candidates that agree in everything a dependency looks at only the most trusted can be in a best choice, so the rest
is dropped by an aggregation before any group is gathered: what reaches the search is bounded by the different
combinations of dependency values (issues and files of a drawing), never by the size of the group, and nothing is lost.

Defined results: trust compares larger first, null and NaN lowest; on equal trust of all bundles the smaller ids are chosen, in the order of the bundles; a record without a
group key (no lot, no place, no storey at all) is a group of its own; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrolith.functions.places import file_storey_of, issue_of, layer, lot, place_of, storey_of
from ferrolith.session import checkpoint
from ferrolith.sources.tables import once


@dataclass(frozen=True)
class Bundle:
    """name; the fields taken together; trust: columns that are compared in order, larger is better; ties: the columns that must agree with those of the same name in other bundles."""

    name: str
    fields: Sequence[str]
    trust: Sequence[Column]
    ties: dict[str, Column] = field(default_factory=dict)


def _search(names: list[str], candidates: dict[str, list]) -> dict[str, tuple] | None:
    """candidates: by bundle, (rank, id, ties) sorted with the best first. The best consistent choice: ranks are tuples, compared part by part, each part over all bundles before the next."""
    if not all(candidates[n] for n in names):
        return None
    first, agreed = {n: candidates[n][0] for n in names}, {}
    if all(agreed.setdefault(t, v) == v for c in first.values() for t, v in c[2].items()):
        return first  # nothing binds the best of each
    best: list = [None, None]
    tops = [tuple(max(c[0][part] for c in candidates[n]) for part in range(len(candidates[n][0][0]))) for n in names]
    sums = lambda ranks: tuple(zip(*ranks))

    def go(k: int, chosen: list, ties: dict) -> None:
        ranks = [c[0] for c in chosen]
        if best[0] is not None and sums([*ranks, *tops[k:]]) <= best[0]:
            return
        if k == len(names):
            best[:] = [sums(ranks), list(chosen)]
            return
        for c in candidates[names[k]]:
            if all(ties.get(t, v) == v for t, v in c[2].items()):
                go(k + 1, [*chosen, c], ties | c[2])

    go(0, [], {})
    return None if best[1] is None else dict(zip(names, best[1]))


def choose(records: DataFrame, group: str, key: str, bundles: Sequence[Bundle]) -> DataFrame:
    """records with a group and a numeric key: per group and bundle the key of the record that supplies it.

    Returns group, n (different keys), first (smallest key) and one column per bundle, `<name>_from`.
    """
    named = Counter(t for b in bundles for t in b.ties)  # what one bundle alone names binds nothing
    ties = {b.name: {t: v for t, v in sorted(b.ties.items()) if named[t] > 1} for b in bundles}
    sizes = records.groupBy(group).agg(F.count("*").alias("n"), F.min(key).alias("first"))
    rows = None
    for b in bundles:
        x = records.select(
            group, F.lit(b.name).alias("bundle"), F.to_json(F.struct(*[v.cast("string").alias(t) for t, v in ties[b.name].items()]), {"ignoreNullFields": "false"}).alias("ties") if ties[b.name] else F.lit("{}").alias("ties"),
            F.struct(F.array(*[F.coalesce(F.nanvl(c.cast("double"), F.lit(float("-inf"))), F.lit(float("-inf"))) for c in b.trust]).alias("trust"), (-F.col(key)).alias("back")).alias("rank"),
        )
        x = x.groupBy(group, "bundle", "ties").agg(F.max("rank").alias("rank"))
        rows = x if rows is None else rows.unionByName(x)
    names = [b.name for b in bundles]
    kind = dict(records.dtypes)[group]

    def pick(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        for p in parts:
            out: dict[str, list] = {group: [], **{f"{n}_from": [] for n in names}}
            for g, c in zip(p[group], p["candidates"]):
                by: dict[str, list] = {n: [] for n in names}
                for x in c:
                    by[x["bundle"]].append(((tuple(x["rank"]["trust"]), x["rank"]["back"]), -x["rank"]["back"], json.loads(x["ties"])))
                for n in names:
                    by[n].sort(key=lambda y: y[0], reverse=True)
                got = _search(names, by)
                out[group].append(g)
                for n in names:
                    out[f"{n}_from"].append(None if got is None else got[n][1])
            yield pd.DataFrame(out)

    gathered = rows.groupBy(group).agg(F.collect_list(F.struct("bundle", "ties", "rank")).alias("candidates"))
    chosen = gathered.mapInPandas(pick, f"`{group}` {kind}, " + ", ".join(f"`{n}_from` long" for n in names))
    return sizes.join(chosen, group)


def build(records: DataFrame, group: str, key: str, bundles: Sequence[Bundle]) -> DataFrame:
    """One surviving record per group: each bundle's fields from the record chosen for it."""
    out = choose(records, group, key, bundles)
    for b in bundles:
        part = records.select(F.col(group).alias("_g"), F.col(key).alias("_k"), *b.fields)
        out = out.join(part, (F.col(group) == F.col("_g")) & (F.col(f"{b.name}_from") == F.col("_k")), "left").drop("_g", "_k")
    return out


# ---- slab supports ----

COLUMNS = ["support_id", "project", "fichier", "page", "view", "coordinate", "level", "layer", "status", "confidence", "bars", "read_at", "loaded_at"]
DAYS = 20  # readings of a file without a stated issue that are further apart than this are of different issues


def _slot_fields(b: Column) -> Column:
    one = lambda x: F.when(x.isNotNull(), 1).otherwise(0)
    return one(b["label"]) + one(b["quantite"]) + one(b["diametre"]) + one(b["longueur_mm"]) + one(b["repere"])


def _marks(bars: Column) -> Column:
    """What a reading says of its bars as short texts, for telling readings of one support from those of another."""
    has = lambda f: F.filter(bars, lambda b: b[f].isNotNull())
    part = lambda f: F.transform(has(f), lambda b: F.concat_ws("|", F.lit(f), F.coalesce(b["label"], F.lit("?")), b[f].cast("string")))
    return F.array_distinct(F.concat(part("quantite"), part("diametre"), part("longueur_mm"), part("repere")))


def readings(supports: DataFrame) -> DataFrame:
    """Each reading once, with its lot, place, storey, layer and issue in common spelling.

    A missing storey is the one the file is named after. A missing layer is taken from the readings of the same lot, place and
    storey: from the layer whose readings share most bar statements with it, at least half of its own.
    """
    s = once(supports.select(*[c for c in COLUMNS if c in supports.columns]), "support_id").filter("support_id is not null")
    bars = F.coalesce(F.col("bars"), F.array().cast(s.schema["bars"].dataType))
    s = s.withColumn("_bars", bars).select(
        "*", F.upper(F.col("project")).alias("_project"), lot(F.col("fichier")).alias("_lot"), place_of("coordinate").alias("_place"),
        F.coalesce(storey_of("level"), file_storey_of("fichier")).alias("_storey"), layer(F.col("layer")).alias("_layer"), issue_of("fichier").alias("_issue"),
        _marks(F.col("_bars")).alias("_marks"),
        F.aggregate("_bars", F.lit(0), lambda a, b: a + _slot_fields(b)).alias("_said"),
    )
    s = checkpoint(s)  # the names are read once
    spot = ["_project", "_lot", "_place", "_storey"]
    lost = s.filter(F.col("_layer").isNull() & F.col("_place").isNotNull()).select(F.col("support_id").alias("_id"), *spot, F.explode_outer("_marks").alias("mark"), F.size("_marks").alias("_of"))
    # of each mark only whether some reading of that layer states it: the join can't multiply readings by readings
    told = s.filter(F.col("_layer").isNotNull()).select(*spot, "_layer", F.explode("_marks").alias("mark")).distinct()
    likely = lost.join(told, [*spot, "mark"]).groupBy("_id", "_layer", "_of").agg(F.count("*").alias("same")).filter("same * 2 >= _of")
    likely = likely.groupBy("_id").agg(F.max(F.struct("same", "_layer")).alias("b")).select("_id", F.col("b._layer").alias("_guess"))
    return s.join(likely, s.support_id == likely["_id"], "left").withColumn("_layer", F.coalesce("_layer", "_guess")).drop("_id", "_guess")


def groups(supports: DataFrame) -> DataFrame:
    """readings() with `_group`, the key of the real support; readings that can't be placed have a group of their own."""
    r = readings(supports)
    known = F.col("_lot").isNotNull() & F.col("_place").isNotNull() & F.col("_storey").isNotNull() & F.col("_layer").isNotNull()
    r = r.withColumn("_group", F.when(known, F.concat_ws("/", F.coalesce("_project", F.lit("")), "_lot", "_place", "_storey", "_layer")).otherwise(F.concat(F.lit("#"), F.col("support_id").cast("string"))))
    last = r.groupBy("_group").agg(F.max("read_at").alias("_last"), F.max("_issue").alias("_top"))
    r = r.join(last, "_group")
    # named issues rank before none; without a name, the readings of the last days are the last issue
    dated = F.when(F.col("_top").isNull() & (F.col("read_at") >= F.col("_last") - F.expr(f"interval {DAYS} days")), 1.0).otherwise(0.0)
    return checkpoint(r.withColumn("_rank", F.coalesce(F.col("_issue"), F.when(F.col("_top").isNull(), dated).otherwise(F.lit(-1.0)))))


def support_bundles() -> list[Bundle]:
    """The drawing is of the last issue; the statement, the fullest and surest, must be of the same issue; the view must be of the drawing's issue and file.

    The issue counts first, then the statement, then the view. Of files of one issue that whose view is stated best is the drawing's.
    """
    one = lambda c: F.when(F.col(c).isNotNull(), 1).otherwise(0)
    issue, file = {"issue": F.col("_rank")}, {"file": F.col("fichier")}
    return [
        Bundle("drawing", ["project", "fichier"], [F.col("_rank")], issue | file),
        Bundle("statement", ["coordinate", "level", "layer", "bars", "status", "confidence"], [F.col("_said") + one("level") + one("layer"), F.col("confidence")], issue),
        Bundle("view", ["page", "view", "read_at"], [one("page") + one("view"), F.col("confidence")], issue | file),
    ]


def found(supports: DataFrame) -> DataFrame:
    """group_id, survivor_id of each real support that has two or more readings."""
    drawing, statement, _ = support_bundles()  # the view follows both
    c = choose(groups(supports), "_group", "support_id", [drawing, statement])
    return c.filter("n >= 2").select(F.col("first").alias("group_id"), F.col("statement_from").alias("survivor_id"))


def survivors(supports: DataFrame) -> DataFrame:
    """The surviving record of every real support, in common spelling where a value is missing."""
    out = build(groups(supports), "_group", "support_id", support_bundles())
    return out.select(F.col("first").alias("group_id"), F.col("n").alias("readings"), F.col("statement_from").alias("survivor_id"), "project", "fichier", "page", "view", "coordinate", "level", "layer", "status", "confidence", F.size(F.coalesce("bars", F.array().cast(dict(out.dtypes)["bars"]))).alias("bars"))
