"""Exact nearest vectors of a stated set of queries: queries in blocks of bounded size against all rows, partial results per partition merged."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_BYTES = 32_000_000


def top_k(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """queries (query_id, embedding) and rows (vec_id, embedding): query_id, rank, vec_id, similarity by cosine; a row isn't its own neighbour, ties go to the smaller id.

    Null and zero vectors are like nothing. Each block of queries is one pass over the rows, of which each batch sends on k rows a query.
    """
    spark, out = rows.sparkSession, None
    for block in _blocks(queries):
        held = spark.sparkContext.broadcast(block)

        def run(parts: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            ids, q = held.value
            q = q / np.linalg.norm(q, axis=1, keepdims=True)
            for p in parts:
                p = p[[e is not None and len(e) == q.shape[1] for e in p["embedding"]]]
                if not len(p):
                    continue
                m = np.stack(p["embedding"].to_numpy()).astype(float)
                n = np.linalg.norm(m, axis=1)
                m, v = m[n > 0], p["vec_id"].to_numpy()[n > 0]
                sim = np.round(q @ (m / n[n > 0, None]).T, 7)
                sim[ids[:, None] == v[None, :]] = -np.inf
                take = np.lexsort((np.broadcast_to(v, sim.shape), -sim), axis=1)[:, :k]
                best = np.take_along_axis(sim, take, 1)
                out = pd.DataFrame({"query_id": np.repeat(ids, take.shape[1]), "vec_id": v[take].ravel(), "similarity": best.ravel()})
                yield out[np.isfinite(out["similarity"])]

        x = rows.select("vec_id", "embedding").mapInPandas(run, "query_id long, vec_id long, similarity double")
        out = x if out is None else out.unionByName(x)
    if out is None:
        out = spark.createDataFrame([], "query_id long, vec_id long, similarity double")
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _blocks(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    ids: list[int] = []
    vecs: list[list[float]] = []
    for r in queries.filter("embedding is not null and query_id is not null").toLocalIterator():
        if not any(r["embedding"]):
            continue
        ids.append(r["query_id"])
        vecs.append(r["embedding"])
        if len(vecs) * len(vecs[0]) * 8 >= BLOCK_BYTES:
            yield np.array(ids), np.array(vecs, float)
            ids, vecs = [], []
    if ids:
        yield np.array(ids), np.array(vecs, float)
