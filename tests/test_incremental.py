import json

import pytest

from ferrolith.operators.registry import Method, Registry
from ferrolith.streaming import incremental as I
from pyspark.sql import functions as F


def test_each_file_once(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    (tmp_path / "in").mkdir()

    def put(name, n):
        (tmp_path / "in" / name).write_text("\n".join(json.dumps({"id": f"{name}-{i}"}) for i in range(n)))

    run = lambda: I.ingest(spark, src, "id string", out, ck, lambda df: df.select("id", "fichier"))
    put("a.json", 2), put("b.json", 3)
    assert run() == 5
    assert run() == 0
    put("c.json", 1)
    assert run() == 1
    assert spark.read.parquet(out).select("id").distinct().count() == 6


def test_jobs(spark, tmp_path):
    j = I.Jobs(spark, str(tmp_path / "jobs"))
    assert j.ensure("p", "s", "v") == "queued"
    assert j.ensure("p", "s", "v") == "active" and j.ensure("q", "s", "v") == "queued"
    j.put("p", "s", "v", "completed")
    assert j.ensure("p", "s", "v") == "reused" and j.ensure("p", "s", "v2") == "queued"
    assert I.Jobs(spark, str(tmp_path / "jobs")).recover() == 2
    assert j.ensure("p", "s", "v2") == "queued"


def test_fingerprints_and_stamps(spark):
    x = spark.createDataFrame([("a", "1"), ("b", None)], "name string, digest string").withColumn("fingerprint", I.fingerprint("v1", F.col("name"), F.col("digest")))
    assert I.pending(x, x.filter("name = 'a'")).count() == 1
    assert I.pending(x, x.withColumn("fingerprint", I.fingerprint("v2", F.col("name"), F.col("digest")))).count() == 2
    s = lambda rows: I.stamp(spark.createDataFrame(rows, "scope string, kind string, name string, digest string")).first()["stamp"]
    assert s([("p", "k", "a", "1"), ("p", "k", "b", None)]) == s([("p", "k", "b", None), ("p", "k", "a", "1")]) != s([("p", "k", "a", "2"), ("p", "k", "b", None)])


def test_registry(spark):
    r = Registry([Method("double", "twice", ("a",), lambda df: df.withColumn("v", F.col("v") * 2)), Method("keep", "as is", ("b",), lambda df: df)])
    df = spark.createDataFrame([("a", 1), ("b", 5), ("c", 9)], "type_element string, v int")
    assert {(x["type_element"], x["v"]) for x in r.apply(df).collect()} == {("a", 2), ("b", 5)}
    with pytest.raises(KeyError):
        r.get("none")
    with pytest.raises(ValueError):
        r.add(Method("keep", "", (), lambda df: df))
