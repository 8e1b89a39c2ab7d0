"""Queries over whole tables, among them values on which roundings part: against brute force."""

from statistics import median

import pytest
from ferrolith.plans import reference


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i,) for i in range(1, 301)], "p_partkey long").write.parquet(f"{d}/part.parquet")
    spark.createDataFrame([(i,) for i in range(1, 91)], "c_custkey long").write.parquet(f"{d}/customer.parquet")
    bars = "array<struct<repere:string,diametre:string,quantite:int,espacement_mm:double,longueur_mm:double>>"
    rows = [(f"r{i}", i, "S-1", f"A-{i % 3}", [(None, "25M", i, None, None)], ([],)) for i in range(20)]
    spark.createDataFrame(rows, f"id string, seq long, feuillet string, element string, armature {bars}, debug struct<raw:array<string>>").selectExpr("*", "timestamp'2030-01-01' as loaded_at").write.parquet(f"{d}/records_plan.parquet")
    return d


def test_scale_of_all_pairs(spark, tables):
    ratios: dict = {}
    for p in range(1, 301):
        for c in range(1, 91):
            if p // 400 == c // 300:
                w, h, v, g = p * 7 % 50 + 1, p * 11 % 40 + 1, c * 13 % 500 + 100, c * 29 % 400 + 100
                a, b = max(w, h) / min(w, h), max(v, g) / min(v, g)
                if abs(a - b) < 0.06 * b:
                    ratios.setdefault(p // 400, []).append(max(w, h) / max(v, g))
    got = {r["page"]: (r["scale"], r["n"]) for r in reference.queries()["scale_calibration"](spark, tables).collect()}
    assert got == {k: (pytest.approx(median(v), abs=1e-6), len(v)) for k, v in ratios.items() if len(v) >= 3}


def test_every_record_is_an_answer(spark, tables):
    got = {r["row"]: (r["candidates"], r["found"]) for r in reference.queries()["answer_key"](spark, tables).collect()}
    assert got == {i: (len(range(i % 3, 20, 3)), i % 2 == 0) for i in range(20)}


def test_offsets_of_all_parts(spark, tables):
    seen = reference.queries()["view_offsets"](spark, tables).collect()
    assert [(r["view"], r["kind"], r["offset"]) for r in seen] == [("V1", "number", -500.0)]


def test_every_bar_and_record_rounded_as_the_reference_does(spark, tmp_path):
    d, values = str(tmp_path), [114.25, 114.35, 0.15, 0.25, 150.0, 1234567.5, 0.04, -7.75, None]
    spark.createDataFrame([(i, 4, "25M", v, None) for i, v in enumerate(values)], "bar_id long, quantite int, diametre string, espacement_mm double, raw string").selectExpr("*", "timestamp'2030-01-01' as loaded_at").write.parquet(f"{d}/bars.parquet")
    got = {r["bar_id"]: r["text"] for r in reference.queries()["formatting"](spark, d).collect()}
    assert got == {i: "4-25M" + ("" if v is None else f" @{v:g} mm") for i, v in enumerate(values)}
    cols = "id string, seq long, source string, fichier string, feuillet string, page int, x double, y double, type_element string, element string, armature array<string>"
    spark.createDataFrame([(f"r{i}", i, "plan", "f", "S", 1, v, v, "dalle", "A-1", []) for i, v in enumerate(values)], cols).selectExpr("*", "timestamp'2030-01-01' as loaded_at").write.parquet(f"{d}/records_plan.parquet")
    got = {r["id"]: (r["x"], r["y"]) for r in reference.queries()["record_contract"](spark, d).collect()}
    assert got == {f"r{i}": (None, None) if v is None else (round(v, 1), round(v, 1)) for i, v in enumerate(values)}
