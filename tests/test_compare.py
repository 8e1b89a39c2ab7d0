"""The comparison on the small cases that define it."""

import pytest

from ferrolith.operators import compare as C
from ferrolith.operators import dedup, normalize, report
from ferrolith.sources import records as R
from pyspark.sql import functions as F

BAR = "struct<repere:string,diametre:string,quantite:int,espacement_mm:double,longueur_mm:double>"
DEBUG = "struct<niveau:string,raw:array<string>,roles:array<string>,role:string,layer:string,direction:string,reinforcement_kind:string,view:string,confidence:double>"
SCHEMA = f"id string, seq long, source string, fichier string, feuillet string, page int, x double, y double, type_element string, element string, armature array<{BAR}>, debug {DEBUG}"


def rec(i, element, bars, kind="semelle", level="FONDATION", layer=None, x=0.0, roles=None, direction=None, integrity=None, source="plan"):
    b = [(None, d, q, s, n) for d, q, s, n in bars]
    return (f"r{i}", i, source, "f", "S-1", 1, x, 0.0, kind, element, b, (level, [], roles or [], None, layer, direction, integrity, None, 0.9))


def run(spark, plan, shop):
    f = lambda rows: spark.createDataFrame(rows, SCHEMA)
    return {(r["plan_element"], r["atelier_element"]): r["coordinate_match"] for r in C.compare(f(plan), f(shop)).collect()}


def f9(e, i, q=9, **k):
    return rec(i, e, [("25M", q, None, None)], **k)


def test_changed_only(spark):
    assert run(spark, [f9("L-13", 1), f9("A-1", 2), f9("B-2", 3)], [f9("L-13", 4, 11), f9("A-1", 5), f9("C-9", 6)]) == {("L-13", "L-13"): "exact"}


def test_neighbours(spark):
    assert run(spark, [f9("G-8", 1)], [f9("G.5-8", 2, 11)]) == {("G-8", "G.5-8"): "proche"}
    assert run(spark, [f9("E-12.7", 1)], [f9("E-13", 2, 11)]) == {("E-12.7", "E-13"): "proche"}
    assert run(spark, [f9("H-12.7", 1)], [f9("G.5-12.5", 2, 11)]) == {("H-12.7", "G.5-12.5"): "proche"}
    # five printed positions apart, and another storey
    others = [f9(f"G-{n}", 10 + n) for n in (7, 8, 9, 10)]
    assert run(spark, [f9("G-6", 1), *others], [f9("G-11", 2, 11), *[f9(f"G-{n}", 20 + n) for n in (7, 8, 9, 10)]]) == {}
    assert run(spark, [f9("G-8", 1)], [f9("G.5-8", 2, 11, level="RDC")]) == {}


def test_three_positions(spark):
    between = [f9("G-8", 10), f9("G-9", 11)]
    assert run(spark, [f9("G-7", 1), *between], [f9("G-10", 2, 11), *[f9("G-8", 20), f9("G-9", 21)]]) == {("G-7", "G-10"): "proche"}


def test_lengths_and_repeats(spark):
    a = rec(1, "A-1", [("25M", 4, None, 3429.0)])
    assert run(spark, [a], [rec(2, "A-1", [("25M", 4, None, None)])]) == {}
    assert run(spark, [a], [rec(2, "A-1", [("25M", 4, None, 3000.0)])]) == {("A-1", "A-1"): "exact"}
    twice = [f9("A-1", 1), f9("A-1", 2)]
    assert run(spark, twice, [f9("A-1", 3)]) == {}
    moved = [f9("A-1", 1), f9("A-1", 2, x=50.0)]
    assert run(spark, moved, [f9("A-1", 3)]) == {("A-1", "A-1"): "exact"}


def test_slab_layers(spark):
    p = rec(1, "A-1", [("10M", 4, None, None)], "dalle", "NIVEAU 2", integrity="integrity", layer="INCONNU")
    both = [rec(2, "A-1", [("10M", 2, None, None)], "dalle", "NIVEAU 2", "haut"), rec(3, "A-1", [("10M", 3, None, None)], "dalle", "NIVEAU 2", "bas")]
    assert run(spark, [p], both) == {("A-1", "A-1"): "couche"}
    q = rec(1, "A-1", [("10M", 5, None, None)], "dalle", "NIVEAU 2", integrity="integrity", layer="INCONNU")
    assert run(spark, [q], both) == {}


def test_empty_tables(spark):
    assert run(spark, [], []) == {}
    assert run(spark, [f9("A-1", 1)], []) == {}


def test_column_specs(spark):
    r = spark.createDataFrame([rec(1, "A-1", [("20M", 4, None, None), ("20M", 2, None, None), ("10M", None, 200.0, None), ("10M", None, 200.0, None)], "colonne", "RDC")], SCHEMA)
    assert [(x["role"], x["diametre"], x["quantite"], x["espacement_mm"]) for x in normalize.column_specs(r).orderBy("entry").collect()] == [("VERT", "20M", 6, None), ("ETRI", "10M", None, 200.0)]
    r = spark.createDataFrame([rec(1, "A-1", [("20M", 4, None, None), ("20M", None, None, None)], "colonne", "RDC")], SCHEMA)
    assert normalize.column_specs(r).first()["quantite"] is None


def test_footing_roles(spark):
    r = spark.createDataFrame([rec(1, "A-1", [("25M", 9, None, None), ("25M", 7, None, None)], roles=["TRANS", "LONG"])], SCHEMA)
    assert [(x["role"], x["quantite"]) for x in normalize.shared_bars(r).orderBy("entry").collect()] == [("LONG", 7), ("TRAN", 9)]
    r = spark.createDataFrame([rec(1, "A-1", [("25M", 7, None, None)], roles=["TRANS"])], SCHEMA)
    assert normalize.missing_roles(r).first()["missing"] == "LONG"


def test_beams(spark):
    a = [rec(1, "P1", [("25M", 2, None, None)], "poutre"), rec(2, "P1", [("15M", 2, None, None)], "poutre", x=5.0), rec(3, "P1", [("25M", 2, None, None)], "poutre"), rec(4, "UNKNOWN", [("25M", 2, None, None)], "poutre"), rec(5, "UNKNOWN", [("25M", 2, None, None)], "poutre")]
    g = {(x["element"], x["alone"]): (x["records"], x["bars"]) for x in normalize.beams(spark.createDataFrame(a, SCHEMA)).collect()}
    assert g == {("P1", ""): (3, 2), ("UNKNOWN", "r4"): (1, 1), ("UNKNOWN", "r5"): (1, 1)}


def test_deduplicate(spark):
    rows = spark.createDataFrame([("A-6", "x", 0.5, 1), ("A-6", "x", 0.9, 2), ("A-7", "x", 0.9, 3), ("A-6", "y", 0.1, 4), (None, None, None, 5), (None, None, None, 6)], "place string, sign string, confidence double, seq int")
    x = dedup.deduplicate(rows, ["place"], "sign", [F.col("confidence")], "seq").collect()
    assert {(r["place"], r["sign"], r["seq"], r["removed"], r["duplicate_conflict"]) for r in x} == {("A-6", "x", 2, 1, True), ("A-6", "y", 4, 0, True), ("A-7", "x", 3, 0, False), (None, None, 5, 1, False)}


def test_aliases(spark):
    axes = [("G", "number", str(n), 100.0 * n) for n in range(1, 5)] + [("Q", "number", str(n), 100.0 * n - 500) for n in range(1, 5)] + [("G", "number", "9", 900.0), ("Q", "number", "R", 400.0)]
    x = spark.createDataFrame(axes, "view string, kind string, label string, at double")
    assert dedup.offsets(x, "G").first()["offset"] == 500.0
    assert ("R", "9") in {(r["label"], r["alias"]) for r in dedup.aliases(x, "G").collect()}


def test_json_sink_and_validation(spark, tmp_path):
    r = spark.createDataFrame([rec(1, "A-1", [("25M", 9, None, None)]), rec(2, "A-2", [("25H", 9, None, None)])], SCHEMA)
    good, bad = R.split(r)
    assert [x["id"] for x in good.collect()] == ["r1"] and "closed set" in bad.first()["errors"][0]
    path = str(tmp_path / "r.json")
    assert report.write_records(r, path) == 2
    first = (tmp_path / "r.json").read_bytes()
    report.write_records(r, path)
    assert (tmp_path / "r.json").read_bytes() == first
    back = R.read_json(spark, path)
    assert {x["id"] for x in back.collect()} == {"r1", "r2"} and all(x["unexpected"] == [] for x in back.collect())
    assert report.write_records(r.limit(0), path) == 0 and (tmp_path / "r.json").read_text() == "[]\n"


@pytest.mark.parametrize(("value", "ok"), [("9-25M", True), ("8-25M", False), ("25M@150", False)])
def test_answer_key(spark, value, ok):
    r = spark.createDataFrame([rec(1, "A-1", [("25M", 9, None, None)])], SCHEMA)
    k = spark.createDataFrame([(1, "S-1", "A-1", value)], "row int, feuillet string, localisation string, value string")
    assert report.check_key(k, r, False).first()["found"] is ok
