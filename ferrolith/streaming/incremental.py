"""Ingestion that reads each file once: by fingerprint in batch, by a file stream with checkpoint, with representation upgrades."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def fingerprint(version: str, *parts: Column) -> Column:
    """Of a parser version and what identifies an input (kind, name, content digest)."""
    return F.sha2(F.concat_ws("\n", F.lit(version), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def pending(inputs: DataFrame, done: DataFrame) -> DataFrame:
    """Inputs whose fingerprint isn't among those done."""
    return inputs.join(done.select("fingerprint"), "fingerprint", "left_anti")


def stamp(inputs: DataFrame) -> DataFrame:
    """scope, stamp: one digest over the set of inputs of a scope, in any order; a missing file has digest null and counts."""
    said = F.to_json(F.array_sort(F.collect_list(F.struct("kind", "name", F.coalesce("digest", F.lit("")).alias("digest")))))
    return inputs.groupBy("scope").agg(F.sha2(said, 256).alias("stamp"))


def upgrade(rows: DataFrame, version: str, align: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows of an older representation aligned, those of the current one as they are; doing it again changes nothing."""
    old = F.coalesce(F.col("version"), F.lit("")) != version
    return rows.filter(~old).unionByName(align(rows.filter(old)).withColumn("version", F.lit(version)))


def ingest(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, parse: Callable[[DataFrame], DataFrame]) -> int:
    """Reads what is new under source, once each, parses it and appends it to target; returns the rows of this call.

    The stream's checkpoint holds what was read; a batch that failed is read again as the same batch and replaces its own part.
    """
    rows = [0]

    def put(batch: DataFrame, number: int) -> None:
        out = parse(batch.withColumn("fichier", F.col("_metadata.file_name")))
        out.write.mode("overwrite").parquet(f"{target}/batch={number}")
        rows[0] += spark.read.parquet(f"{target}/batch={number}").count()

    q = spark.readStream.schema(schema).json(source).select("*", "_metadata").writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return rows[0]


class Jobs:
    """Registry of jobs in a Parquet folder: at most one active per project and stamp, states queued, running, completed, failed; survives a restart."""

    SCHEMA = "project string, stamp string, version string, state string, at timestamp"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _log(self) -> DataFrame:
        from pyspark.errors import AnalysisException

        try:
            return self.spark.read.schema(self.SCHEMA).parquet(self.folder)
        except AnalysisException:
            return self.spark.createDataFrame([], self.SCHEMA)

    def states(self) -> DataFrame:
        """The last state of each job."""
        return self._log().groupBy("project", "stamp", "version").agg(F.max_by("state", "at").alias("state"), F.max("at").alias("at"))

    def put(self, project: str, stamp: str, version: str, state: str) -> None:
        row = self.spark.range(1).select(F.lit(project).alias("project"), F.lit(stamp).alias("stamp"), F.lit(version).alias("version"), F.lit(state).alias("state"), F.current_timestamp().alias("at"))
        row.write.mode("append").parquet(self.folder)

    def ensure(self, project: str, stamp: str, version: str, force: bool = False) -> str:
        """'reused' for a completed job, 'active' while one of the project runs, else a new job is queued: 'queued'."""
        s = self.states().filter(F.col("project") == project)
        if not force and not s.filter((F.col("stamp") == stamp) & (F.col("version") == version) & (F.col("state") == "completed")).isEmpty():
            return "reused"
        if not s.filter(F.col("state").isin("queued", "running")).isEmpty():
            return "active"
        self.put(project, stamp, version, "queued")
        return "queued"

    def recover(self) -> int:
        """After a restart nothing runs: active jobs are failed; their number."""
        rows = [(r["project"], r["stamp"], r["version"]) for r in self.states().filter(F.col("state").isin("queued", "running")).toLocalIterator()]
        for r in rows:
            self.put(*r, "failed")
        return len(rows)


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """name of the files (name, modified, length) that another listing, taken after they were read, has differently or no more: what was read of them doesn't count."""
    a = after.select("name", F.col("modified").alias("_m"), F.col("length").alias("_l"))
    same = F.col("modified").eqNullSafe(F.col("_m")) & F.col("length").eqNullSafe(F.col("_l"))
    return before.join(a, "name", "left").filter(~same).select("name")


def reusable(cells: DataFrame, bounds: DataFrame, key: list[str], slack: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Cells of an older checkpoint whose boundaries (top, bottom) haven't moved by more than slack, and the key of the cells that have to be read again."""
    b = bounds.select(*key, F.col("top").alias("_t"), F.col("bottom").alias("_b"))
    kept = cells.join(b, key).filter((F.abs(F.col("top") - F.col("_t")) <= slack) & (F.abs(F.col("bottom") - F.col("_b")) <= slack)).drop("_t", "_b")
    return kept, bounds.join(kept.select(*key), key, "left_anti").select(*key)


def progress(done: DataFrame, inputs: DataFrame, group: list[str]) -> DataFrame:
    """group, files, read, share: how far the reading of a set of inputs is."""
    x = inputs.join(done.select("fingerprint", F.lit(1).alias("_d")).distinct(), "fingerprint", "left")
    return x.groupBy(*group).agg(F.count("*").alias("files"), F.count("_d").alias("read"), (F.count("_d") / F.count("*")).alias("share"))
