"""Record sources: JSON with validation against the contract, quarantine of what violates it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrolith.functions.grammar import DESIGNATORS

BAR = "struct<repere:string,diametre:string,quantite:int,espacement_mm:double,longueur_mm:double>"
RECORD = f"id string, source string, fichier string, feuillet string, page int, x double, y double, type_element string, element string, armature array<{BAR}>"
KINDS = ["colonne", "semelle", "dalle", "poutre", "radier", "mur_refend"]


def errors() -> Column:
    """What is wrong with a record, as an array of messages; empty for a good one."""
    must = [F.when(F.col(c).isNull(), F.lit(f"{c}: missing")) for c in ("id", "source", "fichier", "feuillet", "page", "x", "y", "type_element", "element")]
    return F.array_compact(F.array(
        *must, F.when(~F.col("source").isin("plan", "atelier"), "source: not plan or atelier"), F.when(~F.col("type_element").isin(*KINDS), "type_element: unknown"),
        F.when(F.exists(F.coalesce("armature", F.array().cast(f"array<{BAR}>")), lambda b: b["diametre"].isNotNull() & ~b["diametre"].isin(*DESIGNATORS)), "armature: diametre outside the closed set"),
    ))


def split(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good records, and bad ones with their errors."""
    x = records.withColumn("errors", errors())
    return x.filter(F.size("errors") == 0).drop("errors"), x.filter(F.size("errors") > 0)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A file with a JSON array of records: fields of the contract, `corrupt` for what isn't JSON, `unexpected` for keys that aren't in it."""
    names = [f.name for f in T._parse_datatype_string(RECORD).fields]
    raw = spark.read.text(path, wholetext=True).select(F.explode_outer(F.from_json("value", "array<variant>")).alias("v"), "value")
    text = F.to_json("v")
    x = raw.select(F.from_json(text, T._parse_datatype_string(RECORD)).alias("r"), F.array_except(F.json_object_keys(text), F.array(*map(F.lit, names))).alias("unexpected"), F.when(F.col("v").isNull(), F.col("value")).alias("corrupt"))
    return x.select("r.*", "unexpected", "corrupt")
