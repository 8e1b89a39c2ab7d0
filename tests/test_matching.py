import itertools
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ferrolith.operators import islands, matching, spatial
from ferrolith.operators.matching import contiguous, least_cost, maximum_matching


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.integers(0, 10**6))
def test_least_cost(n, m, seed):
    c = np.random.default_rng(seed).integers(0, 9, (n, m)).astype(float)
    k = min(n, m)
    best = min(sum(c[i, j] for i, j in zip(r, q)) for r in itertools.permutations(range(n), k) for q in itertools.combinations(range(m), k))
    got = least_cost(c)
    assert len(got) == k and abs(sum(c[i, j] for i, j in got) - best) < 1e-9


def test_infeasible_pairs_are_left_out():
    assert least_cost(np.array([[1e6, 1e6], [1.0, 1e6]])) == [(1, 0)]
    assert least_cost(np.zeros((0, 3))) == []


def bar(**x):
    return {"role": "VERT", "diametre": None, "quantite": None, "espacement_mm": None, "longueur_mm": None, "repere": None} | x


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([None, "10M", "15M"]), st.sampled_from([None, 1, 2])), max_size=5), st.lists(st.tuples(st.sampled_from([None, "10M", "15M"]), st.sampled_from([None, 1, 2])), max_size=5))
def test_maximum_matching(a, b):
    left, right = [bar(diametre=d, quantite=q) for d, q in a], [bar(diametre=d, quantite=q) for d, q in b]
    agree = lambda x, y: all(x[f] is None or y[f] is None or x[f] == y[f] for f in ("diametre", "quantite"))
    ok = [[agree(x, y) for y in right] for x in left]
    if left and right:
        assert matching.agreement(left, right)[0].tolist() == ok
    most = 0
    for n in range(min(len(left), len(right)), 0, -1):
        if any(all(ok[i][j] for i, j in zip(r, q)) for r in itertools.permutations(range(len(left)), n) for q in itertools.combinations(range(len(right)), n)):
            most = n
            break
    m = maximum_matching(left, right)
    assert len(m) == most and len(set(m.values())) == most and all(ok[i][j] for i, j in m.items())


def test_agreement_of_bars():
    a, b = bar(espacement_mm=150.0, repere="A"), bar(espacement_mm=150.5)
    able, differ = matching.agreement([a, bar(role="ETRI")], [b, bar(espacement_mm=150.6), bar(longueur_mm=1.0)])
    assert able.tolist() == [[True, False, True], [False, False, False]] and differ[0].tolist() == [2, 2, 3]


def test_contiguous():
    assert contiguous([1, 2, 10, 11, 30], [1.5, 10.5, 29]) == [0, 0, 1, 1, 2]
    assert contiguous([], [1.0]) == [] and contiguous([1.0], []) == [-1]
    # the seam: nearer to the left title, but the right end of the right group's span
    assert contiguous([0, 800, 850, 1500], [400, 1190]) == [0, 0, 1, 1]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 6), st.integers(1, 4), st.integers(0, 10**6))
def test_contiguous_groups_are_the_best(n, m, seed):
    r = np.random.default_rng(seed)
    c, t = sorted(map(float, r.integers(0, 900, n))), sorted(map(float, r.choice(900, m, replace=False)))
    gaps = sorted(b - a for a, b in zip(t, t[1:]))
    empty = (gaps[len(gaps) // 2] if gaps else 400.0) / 2
    cost = lambda g: sum(empty if not (x := [v for v, k in zip(c, g) if k == j]) else abs((x[0] + x[-1]) / 2 - t[j]) for j in range(m))
    best = min(cost(g) for g in itertools.combinations_with_replacement(range(m), n))
    assert abs(cost(contiguous(c, t)) - best) < 1e-6


def test_views_by_rows_and_columns(spark):
    c = spark.createDataFrame([("p", 1, 10.0, 50.0), ("p", 2, 20.0, 60.0), ("p", 3, 300.0, 40.0), ("p", 4, 15.0, 400.0), ("q", 5, 1.0, 1.0)], "page string, seq long, x double, y double")
    t = spark.createDataFrame([("p", "A", 15.0, 100.0), ("p", "B", 290.0, 130.0), ("p", "C", 100.0, 500.0)], "page string, title string, x double, y double")
    assert {r["seq"]: r["title"] for r in matching.assign_views(c, t, "page").collect()} == {1: "A", 2: "A", 3: "B", 4: "C", 5: None}


def test_components_are_assigned_as_a_whole(spark):
    e = spark.createDataFrame([(1, 11, 1.0), (1, 12, 2.0), (2, 11, 1.5), (3, 13, 4.0)], "a long, b long, d double")
    assert {(r["a"], r["b"]) for r in matching.assign_components(e, "a", "b", "d").collect()} == {(1, 12), (2, 11), (3, 13)}


def test_greedy_is_sequential_greedy(spark):
    r = random.Random(4)
    e = list({(r.randrange(12), r.randrange(12)): r.randrange(5) for _ in range(70)}.items())
    rows = [(a, b, d) for (a, b), d in e]
    got = {(x["a"], x["b"]) for x in matching.greedy(spark.createDataFrame(rows, "a long, b long, d long"), ["a"], ["b"], [F.col("d")]).collect()}
    left, right, want = set(), set(), set()
    for d, a, b in sorted((d, a, b) for a, b, d in rows):
        if a not in left and b not in right:
            left.add(a), right.add(b), want.add((a, b))
    assert got == want


def test_match_bars_and_empty(spark):
    kind = f"k long, a array<{matching.BAR_TYPE}>, b array<{matching.BAR_TYPE}>"
    t = lambda **x: tuple(bar(**x)[f] for f in ("role", "diametre", "quantite", "espacement_mm", "longueur_mm", "repere"))
    df = spark.createDataFrame([(1, [t(diametre="10M", longueur_mm=3000.0)], [t(diametre="10M")]), (2, [t(diametre="10M", quantite=9)], [t(diametre="10M", quantite=11)]), (3, [], [])], kind)
    got = {x["k"]: (x["matched"], len(x["missing"]), len(x["extra"]), x["identical"]) for x in matching.match_bars(df, ["k"]).collect()}
    assert got == {1: (1, 0, 0, True), 2: (0, 1, 1, False), 3: (0, 0, 0, False)}


def test_storeys_are_filled_from_their_neighbours(spark):
    cases = {
        "a": ([("NIVEAU 5", None), (None, None), (None, None), ("NIVEAU 2", None)], ["NIVEAU 5", "NIVEAU 4", "NIVEAU 3", "NIVEAU 2"]),
        "b": ([("TOIT", None), (None, None), ("NIVEAU 2", None)], ["TOIT", "NIVEAU 3", "NIVEAU 2"]), "c": ([("NIVEAU 5", None), (None, None)], ["NIVEAU 5", "NIVEAU 4 ?"]),
        "d": ([("NIVEAU 4", None), (None, "NIVE AL 7"), ("NIVEAU 2", None)], ["NIVEAU 4", "NIVEAU 3 ?", "NIVEAU 2"]), "e": ([(None, None)], [None]),
        "f": ([(None, None), ("SOUS-SOL S1", None), (None, None)], ["REZ-DE-CHAUSSÉE", "SOUS-SOL S1", None]), "g": ([("NIVEAU 2", None)] + [(None, None)] * 3, ["NIVEAU 2", "REZ-DE-CHAUSSÉE ?", None, None]),
        "h": ([("NIVEAU 3", None), (None, "NIVEAU 2"), (None, None), ("TRÉFOND", None)], ["NIVEAU 3", "NIVEAU 2", "REZ-DE-CHAUSSÉE", "TRÉFOND"])}
    d = spark.createDataFrame([(g, i, lv, h) for g, (rows, _) in cases.items() for i, (lv, h) in enumerate(rows)], "g string, seq long, level string, hint string")
    got: dict = {}
    for r in islands.storeys(d, "g").orderBy("g", "seq").collect():
        got.setdefault(r["g"], []).append(r["level"])
        assert r["inferred"] == (cases[r["g"]][0][r["seq"]][0] is None and r["level"] is not None)
    assert got == {g: want for g, (_, want) in cases.items()}
    assert islands.storeys(d.limit(0), "g").count() == 0



def test_within_is_brute_force(spark):
    r = random.Random(1)
    p = [(0, i, r.random() * 100, r.random() * 100) for i in range(80)]
    o = [(0, i, r.random() * 100, r.random() * 100) for i in range(80)]
    x = spatial.within(spark.createDataFrame(p, "page int, pid int, x double, y double"), spark.createDataFrame(o, "page int, oid int, ox double, oy double"), ["page"], 9.0)
    want = {(a[1], b[1]) for a in p for b in o if ((a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2) ** 0.5 <= 9}
    rows = x.collect()
    assert {(v["pid"], v["oid"]) for v in rows} == want and len(rows) == len(want)


def test_suppression_is_sequential(spark):
    from ferrolith.operators import drawing

    r = random.Random(7)
    m = [(0, i, r.random() * 60, r.random() * 60, r.randrange(4)) for i in range(90)]
    kept: list = []
    for p in sorted(m, key=lambda v: (-v[4], v[1])):
        if all(((p[2] - k[2]) ** 2 + (p[3] - k[3]) ** 2) ** 0.5 > 9 for k in kept):
            kept.append(p)
    df = spark.createDataFrame(m, "page int, pid int, x double, y double, size int")
    assert {v["pid"] for v in drawing.suppress(df, ["page"], 9.0, "size").collect()} == {k[1] for k in kept}
    assert drawing.suppress(df.limit(0), ["page"], 9.0, "size").count() == 0


def test_components(spark):
    from ferrolith.operators import drawing

    r = random.Random(9)
    e = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)]
    parent: dict = {}

    def find(v):
        while parent.setdefault(v, v) != v:
            v = parent[v]
        return v

    for a, b in e:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {v["id"]: v["component"] for v in drawing.components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert got == {v: find(v) for v in parent}


def test_top_k(spark):
    from ferrolith.operators import search

    g = np.random.default_rng(3)
    v = g.random((80, 6)).round(3)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(500, None), (501, [0.0] * 6), (502, v[3].tolist())], "vec_id long, embedding array<double>")
    q = rows.filter("vec_id % 20 = 0").selectExpr("vec_id as query_id", "embedding")
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in search.top_k(q, rows, 4).collect()}
    every = {i: x for i, x in enumerate(v)} | {502: v[3]}
    for i in range(0, 80, 20):
        cos = lambda j: round(float(every[i] @ every[j] / np.linalg.norm(every[i]) / np.linalg.norm(every[j])), 7)  # noqa: E731, B023
        want = sorted((j for j in every if j != i), key=lambda j: (-cos(j), j))[:4]
        assert [got[i, k] for k in range(1, 5)] == want
    assert search.top_k(q.limit(0), rows, 4).count() == 0
