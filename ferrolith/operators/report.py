"""Answer keys, summaries and sinks."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrolith.functions.grammar import bound, group, spacing, tenth

# ---- answer key ----


# Forms of an answer key's values, blanks left out: count and size; a count with an inner one; a size with a spacing, of a rang or not.
COUNT, INNER, SPACED = r"^(\d+)-(\d{2}M)$", r"^\d+\(\d+\)$", r"^(?:RANG(\d):)?(\d{2}M)@.+$"


def bare(c: Column) -> Column:
    """A text for comparing: capitals, no blanks, one kind of foot and inch signs."""
    return F.upper(F.regexp_replace(F.translate(F.replace(c, F.lit("''"), F.lit('"')), "’", "'"), r"\s+", ""))


def parsed_value(value: Column, imperial: Column) -> Column:
    """form (count, inner, spaced, text), quantite, diametre, rang, mm and the bare text of a value."""
    def parts(v: Column) -> Column:
        form = F.when(v.rlike(COUNT), "count").when(v.rlike(INNER), "inner").when(v.rlike(SPACED), "spaced").otherwise("text")
        return F.struct(
            form.alias("form"), group(v, COUNT, 1).cast("int").alias("quantite"), F.coalesce(group(v, COUNT, 2), group(v, SPACED, 2)).alias("diametre"), group(v, SPACED, 1).alias("rang"),
            spacing(F.replace(value, F.lit("''"), F.lit('"')), imperial).alias("mm"), v.alias("text"))

    return bound(bare(value), parts)


def states(armature: Column, raw: Column, layer: Column, v: Column) -> Column:
    """Whether a record with these bars, lines and layer states a parsed value: its bar, a line beginning with it, its spacing within half a mm (in its rang), or a line holding it."""
    lines = F.transform(F.coalesce(raw, F.array().cast("array<string>")), bare)
    bars = F.coalesce(armature, F.array().cast("array<struct<repere:string,diametre:string,quantite:int,espacement_mm:double,longueur_mm:double>>"))
    bar = lambda b: (b["diametre"] == v["diametre"]) & F.when(v["form"] == "count", b["quantite"] == v["quantite"]).otherwise(F.abs(b["espacement_mm"] - v["mm"]) < 0.5)
    by_bar = F.exists(bars, lambda b: F.coalesce(bar(b), F.lit(False))) & (v["rang"].isNull() | F.contains(F.coalesce(layer, F.lit("")), v["rang"]))
    return F.when(v["form"].isin("count", "spaced"), by_bar).otherwise(F.exists(lines, lambda t: F.when(v["form"] == "inner", t.startswith(v["text"])).otherwise(t.contains(v["text"]))))


def check_key(key_rows: DataFrame, records: DataFrame, imperial: bool, by_sheet: bool = True) -> DataFrame:
    """key_rows (row, feuillet, localisation, value): row, candidates, found, first (id of the first record that states it)."""
    on = ["feuillet", "localisation"] if by_sheet else ["localisation"]
    layer = F.col("debug.layer") if "layer" in records.schema["debug"].dataType.names else F.lit(None).cast("string")
    r = records.select(F.col("element").alias("localisation"), "feuillet", "id", "seq", "armature", F.col("debug.raw").alias("raw"), layer.alias("layer"))
    r = r if by_sheet else r.drop("feuillet")
    k = key_rows.withColumn("v", parsed_value(F.col("value"), F.lit(imperial)))
    x = k.join(r, on, "left").withColumn("ok", F.coalesce(states(F.col("armature"), F.col("raw"), F.col("layer"), F.col("v")) & F.col("id").isNotNull(), F.lit(False)))
    return x.groupBy("row").agg(F.count("id").alias("candidates"), F.max("ok").alias("found"), F.min_by("id", F.when(F.col("ok"), F.col("seq"))).alias("_f")).select("row", "candidates", "found", F.when(F.col("found"), F.col("_f")).alias("first"))


# ---- summaries ----


def summary(rows: DataFrame, kind: str, status: str, statuses: list[str]) -> DataFrame:
    """Rows per kind and status with a Total line."""
    counts = [F.count_if(F.col(status) == s).alias(s) for s in statuses]
    return rows.rollup(kind).agg(*counts, F.count("*").alias("total")).select(F.coalesce(kind, F.lit("Total")).alias(kind), *statuses, "total")


def totals(sheets: DataFrame, records: DataFrame) -> DataFrame:
    """One row: pages, extracted and skipped pages, records, located ones, mean confidence (0 without records)."""
    s = sheets.agg(F.countDistinct("fichier", "page").alias("pages"), F.countDistinct(F.when(F.col("status") == "extracted", F.struct("fichier", "page"))).alias("extracted"), F.count_if(F.col("status") == "skipped").alias("skipped"))
    r = records.agg(F.count("*").alias("records"), F.count_if(F.col("element") != "UNKNOWN").alias("located"), F.coalesce(F.round(F.avg("debug.confidence"), 3), F.lit(0.0)).alias("confidence"))
    return s.join(r)  # two single rows


def histogram(rows: DataFrame, value: str, bins: int = 20) -> DataFrame:
    """Rows per bin of [0, 1]; 1 lies in the last."""
    b = F.least(F.lit(bins), F.floor(F.col(value) * bins) + 1).cast("int")
    return rows.filter(F.col(value).isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


# ---- sinks ----

CONTRACT = ["id", "source", "fichier", "feuillet", "page", "x", "y", "type_element", "element", "armature"]


def contract(records: DataFrame) -> DataFrame:
    """The ten fields of the record contract in their order of writing; places to a tenth, nulls kept."""
    r = records.select("id", "source", "fichier", "feuillet", "page", tenth("x").alias("x"), tenth("y").alias("y"), "type_element", "element", "armature", "seq")
    return r.orderBy("feuillet", "page", "y", "x", "element", "seq")


def write_records(records: DataFrame, path: str) -> int:
    """A JSON array, keys sorted, two blanks, closing newline; rows pass through one at a time, never all at once."""
    rows = contract(records).select(F.to_json(F.struct(*CONTRACT), {"ignoreNullFields": "false"}).alias("j"))
    n = 0
    with Path(path).open("w", encoding="utf-8") as f:
        f.write("[")
        for r in rows.toLocalIterator():
            text = json.dumps(json.loads(r["j"]), ensure_ascii=False, sort_keys=True, indent=2)
            f.write(("," if n else "") + "\n  " + text.replace("\n", "\n  "))
            n += 1
        f.write("\n]\n" if n else "]\n")
    return n


def review_json(rows: DataFrame) -> DataFrame:
    """One JSON text per row: null fields left out, false and 0 kept."""
    return rows.select(F.to_json(F.struct("*")).alias("json"))


def support_csv(supports: DataFrame) -> DataFrame:
    """A row per bar, and one empty row for a support without bars."""
    return supports.select("support_id", "page", "view", "coordinate", "level", "layer", "status", "confidence", F.explode_outer("bars").alias("b")).select("*", "b.label", "b.quantite", "b.diametre", "b.longueur_mm", "b.repere").drop("b")


def markdown(rows: DataFrame, limit: int = 100_000) -> str:
    """A report table as Markdown; reports are summaries, `limit` bounds what the driver holds and is an error beyond."""
    held = rows.limit(limit + 1).collect()
    if len(held) > limit:
        raise ValueError("too many rows for a report")
    line = lambda v: "| " + " | ".join("—" if x in (None, "") else str(x) for x in v) + " |"
    return "\n".join([line(rows.columns), line(["---"] * len(rows.columns)), *map(line, held)]) + "\n"


def manifest(version: str, counts: dict, path: str) -> None:
    import platform
    from datetime import datetime, timezone

    Path(path).write_text(json.dumps({"version": version, "created": datetime.now(timezone.utc).isoformat(timespec="seconds"), "python": platform.python_version(), **counts}, indent=2, sort_keys=True) + "\n", encoding="utf-8")


def bundle(frames: dict[str, DataFrame], path: str, limit: int = 100_000) -> None:
    """A zip of tables: '.csv' with header, '.json' one record a line. Downloads are of reports; `limit` rows a table are an error beyond, nothing is cut off."""
    import csv
    import io
    import zipfile

    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, df in frames.items():
            held = df.limit(limit + 1).collect()
            if len(held) > limit:
                raise ValueError(f"too many rows for a download: {name}")
            text = io.StringIO()
            if name.endswith(".csv"):
                w = csv.writer(text, lineterminator="\n")
                w.writerow(df.columns)
                w.writerows([["" if v is None else v for v in r] for r in held])
            else:
                text.writelines(json.dumps(r.asDict(recursive=True), ensure_ascii=False, sort_keys=True, default=str) + "\n" for r in held)
            z.writestr(name, text.getvalue())


def write_atomically(path: str, data: bytes) -> None:
    """A small file (manifest, state of a job) as a whole or not at all: written beside its place, synced, then renamed."""
    import os

    part = f"{path}.part"
    with open(part, "wb") as f:
        f.write(data)
        f.flush()
        os.fsync(f.fileno())
    os.replace(part, path)
    folder = os.open(os.path.dirname(os.path.abspath(path)), os.O_RDONLY)
    try:
        os.fsync(folder)
    finally:
        os.close(folder)
