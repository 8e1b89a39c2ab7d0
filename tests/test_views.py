"""Operators on views of a page that SQL doesn't state, against the rule applied one by one."""

import random
import zipfile

from ferrolith.operators import dedup, pages, report, views
from ferrolith.streaming import incremental

LINE = "page long, pid long, x double, y double, orient string"


def lines(seed, n=60, pages_=2):
    r = random.Random(seed)
    return [(p, p * 1000 + i, float(r.randrange(0, 200)), float(r.randrange(0, 120)), r.choice("hv")) for p in range(pages_) for i in range(n)]


def test_lines_under_each_other_are_paired_in_order(spark):
    rows = lines(3)
    a, b = [x for x in rows if x[1] % 2 == 0], [x for x in rows if x[1] % 2]
    used, want = set(), set()
    for p, i, x, y, _ in a:
        for q, j, u, v, _ in b:
            if p == q and j not in used and 0 < v - y < 16 and abs(u - x) < 40:
                used.add(j)
                want.add((i, j))
                break
    f = lambda r: spark.createDataFrame(r, LINE)
    assert {(r["pid"], r["oid"]) for r in views.paired(f(a), f(b), ["page"]).collect()} == want and want
    used, want = set(), set()
    for p, i, x, y, _ in rows:
        if i in used:
            continue
        used.add(i)
        for q, j, u, v, _ in rows:
            if p == q and j not in used and (i + j) % 2 and 0 < abs(v - y) < 16 and abs(u - x) < 40:
                used.add(j)
                want.add((i, j) if i % 2 == 0 else (j, i))
                break
    assert {(r["pid"], r["oid"]) for r in views.paired(f(a), f(b), ["page"], below=False).collect()} == want
    assert views.paired(f(a), f([]), ["page"]).count() == 0


def test_spacing_lines_take_the_nearest_bar_left(spark):
    rows = lines(5, 40)
    s, b = [x for x in rows if x[1] % 3 == 0], [x for x in rows if x[1] % 3]
    used, want = set(), set()
    for p, i, x, y, o in s:
        near = sorted((abs(u - x) + abs(v - y), j) for q, j, u, v, w in b if q == p and w == o and j not in used)
        if near and near[0][0] < 45:
            used.add(near[0][1])
            want.add((i, near[0][1]))
    f = lambda r: spark.createDataFrame(r, LINE)
    assert {(r["pid"], r["oid"]) for r in views.spacings(f(s), f(b), ["page"]).collect()} == want and want


def test_boxes_join_until_nothing_changes(spark):
    r = random.Random(8)
    boxes = [(1, i, x := float(r.randrange(300)), y := float(r.randrange(300)), x + r.randrange(5, 40), y + r.randrange(5, 20)) for i in range(70)]
    groups = [[{b[1]}, *b[2:]] for b in boxes]
    again = True
    while again:
        again = False
        for i in range(len(groups)):
            for j in range(i + 1, len(groups)):
                a, b = groups[i], groups[j]
                if a[1] < b[3] and b[1] < a[3] and a[2] < b[4] and b[2] < a[4]:
                    groups[i] = [a[0] | b[0], min(a[1], b[1]), min(a[2], b[2]), max(a[3], b[3]), max(a[4], b[4])]
                    del groups[j]
                    again = True
                    break
            if again:
                break
    df = spark.createDataFrame(boxes, "page long, pid long, x0 double, y0 double, x1 double, y1 double")
    got: dict = {}
    for x in views.joined_boxes(df, ["page"]).collect():
        got.setdefault(x["box"], set()).add(x["pid"])
    assert sorted(map(sorted, got.values())) == sorted(sorted(g[0]) for g in groups)
    assert views.joined_boxes(df.limit(0), ["page"]).count() == 0


def test_strips_pair_from_the_top(spark):
    strip = lambda k, y, labels: [(1, k, lb, x, float(y)) for lb, x in labels]
    cols = [("3", 100.0), ("2", 170.0), ("1", 200.0)]
    m = [*strip(0, 40, cols), *strip(1, 90, cols), *strip(2, 300, cols[:2] + [("9", 400.0)]), *strip(3, 500, cols), *strip(4, 700, cols), *strip(5, 900, [("7", 1.0), ("8", 2.0)])]
    df = spark.createDataFrame(m, "page long, strip long, label string, x double, y double")
    # the upper strip takes the partner with most labels; 1 is too near to 0, 2 shares two labels only
    assert {(r["top"], r["bottom"]) for r in views.strip_pairs(df, ["page"]).collect()} == {(0, 3), (1, 4)}


def test_small_rules(spark):
    d = spark.createDataFrame([("a", 1, 1), ("a", 1, 2), ("b", None, 3), ("c", 1, 4), ("c", 2, 5), (None, 3, 6)], "k string, v int, n int")
    assert {(r["k"], r["v"], r["status"]) for r in dedup.catalog(d, ["k"], ["v"]).collect()} == {("a", 1, "read"), ("b", None, "unread"), ("c", None, "conflicting"), (None, 3, "read")}
    x = spark.createDataFrame([(1, "p", 0.5), (2, "p", 0.9), (3, "q", None)], "n int, k string, c double")
    assert {(r["n"], r["place"]) for r in dedup.strongest(x, ["k"], "c", "n").collect()} == {(2, 1), (3, 3)}
    f = spark.createDataFrame([("Fondations", "CLP_RADIERS.pdf"), ("Colonnes", "x.pdf"), (None, None)], "folder string, name string")
    assert [r[0] for r in f.select(pages.file_kind(f.folder, f.name)).collect()] == ["radier", "colonne", None]
    b = spark.createDataFrame([("a", 1, 5), ("b", 1, 5), ("c", 1, 5)], "name string, modified long, length long")
    a = spark.createDataFrame([("a", 1, 5), ("b", 2, 5)], "name string, modified long, length long")
    assert {r["name"] for r in incremental.changed(b, a).collect()} == {"b", "c"}


def test_downloads(spark, tmp_path):
    d = spark.createDataFrame([(1, "é"), (2, None)], "a int, b string")
    report.bundle({"x.csv": d, "y.json": d}, str(tmp_path / "z.zip"))
    with zipfile.ZipFile(tmp_path / "z.zip") as z:
        assert z.read("x.csv").decode() == "a,b\n1,é\n2,\n" and z.read("y.json").decode() == '{"a": 1, "b": "é"}\n{"a": 2, "b": null}\n'
    report.write_atomically(str(tmp_path / "m.json"), b"{}")
    assert (tmp_path / "m.json").read_bytes() == b"{}" and not (tmp_path / "m.json.part").exists()


def test_projects_never_meet(spark):
    from ferrolith.operators import compare as C
    from tests.test_compare import SCHEMA, f9

    other = lambda rows, p: spark.createDataFrame(rows, SCHEMA).selectExpr("*", f"'{p}' as project")
    a, b = other([f9("L-13", 1)], "A").unionByName(other([f9("L-13", 2)], "B")), other([f9("L-13", 3, 11)], "A").unionByName(other([f9("M-13", 4, 11)], "C"))
    assert [(r["project"], r["plan_element"]) for r in C.compare(a, b).collect()] == [("A", "L-13")]
