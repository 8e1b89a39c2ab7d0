"""Readers of the tables; an absent table is an error, an empty one is not."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def once(df: DataFrame, key: str, last: str = "loaded_at") -> DataFrame:
    """Rows delivered again under the same key count once: the first delivery (smallest `last`) is kept.

    Rows whose key is null are no redeliveries and all stay. Without a `last` column any of the equal rows is kept.
    One shuffle by the key.
    """
    k = F.col(key)
    # rows without a key are spread by what they hold, so that many of them aren't one task's
    plain = [c for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    spread = F.when(k.isNull(), F.xxhash64(*[F.col(f"`{c}`") for c in plain]))
    order = [F.col(last).asc_nulls_last()] if last in df.columns else [F.lit(0)]
    w = Window.partitionBy(k, spread).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter((F.col("_n") == 1) | k.isNull()).drop("_n")
