"""Units by changepoint search and reconciliation of two copies, against brute force and on odd tables."""

import itertools
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ferrolith.operators import reconcile as R
from ferrolith.operators import units as U

NOW = datetime(2030, 1, 1)
BARS = "bar_id long, fichier string, espacement_mm double, longueur_mm double, raw string, read_at timestamp, loaded_at timestamp"


# ---- units ----


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(2, 4), st.integers(0, 10**6))
def test_segmentation_is_optimal(n, k, seed):
    r = np.random.default_rng(seed)
    cost, change = r.random((n, k)) * 3, r.random((k, k))
    total = lambda s: sum(cost[i, x] for i, x in enumerate(s)) + sum(change[a, b] for a, b in zip(s, s[1:]))
    assert abs(total(U.segment(cost, change)) - min(map(total, itertools.product(range(k), repeat=n)))) < 1e-9


@pytest.mark.parametrize(("raw", "field", "want"), [
    ("28-10M@4.5 lg 18 pi 9 po", "espacement_mm", (4.5, None)), ("28-10M@4.5 lg 18 pi 9 po", "longueur_mm", (225.0, "in")), ("15M @ 150 mm E.F.; L=5.10 m", "longueur_mm", (5.1, "m")), ("ARM.: 9-15M esp. 0,2 m", "espacement_mm", (0.2, "m")),
    ("33-45M  37-06 B4574", "longueur_mm", (450.0, "in")), ("26-15M@ 16''", "espacement_mm", (16.0, "in")), ("10-10M lg 267 po", "longueur_mm", (267.0, "in")), ("30-20M 25' - 9\"", "longueur_mm", (309.0, "in")), ("ALP. 10-M; L=10.15 m", "longueur_mm", (10.15, "m")),
    ("2-35M L=35'", "longueur_mm", (35.0, "ft")), ("14-30M P3029", "longueur_mm", None), (None, "longueur_mm", None), ("", "espacement_mm", None)])
def test_callouts(raw, field, want):
    assert U.parse_callout(raw).get(field) == want


def history(system, unit, n, start, f="espacement_mm", seed=0):
    r = random.Random(seed)
    step, lo, hi = ((25.0, 3, 24) if system == "metric" else (25.4, 3, 24)) if f == "espacement_mm" else ((50.0, 30, 240) if system == "metric" else (76.2, 20, 160))
    return [(start + i, step * r.randrange(lo, hi + 1), unit) for i in range(n)]


@pytest.mark.parametrize("system", ["metric", "imperial"])
def test_level_shifts_are_reversed(spark, system):
    other = "cm" if system == "metric" else "in"
    h = history(system, "mm", 30, 0) + history(system, other, 30, 30, seed=1) + history(system, "mm", 20, 60, seed=2)
    rows = [(i, "f", round(v / U.FACTORS[u], 4), None, None, NOW + timedelta(hours=i), NOW) for i, v, u in h]
    got = {r["bar_id"]: r["mm_tenths"] for r in U.found(spark.createDataFrame(rows, BARS)).collect()}
    assert got == {i: round(v * 10) for i, v, u in h if u != "mm"}


def test_pieces_are_the_whole(spark, monkeypatch):
    h = history("metric", "mm", 300, 0) + history("metric", "cm", 200, 300, seed=4)
    rows = [(i, "f", v / U.FACTORS[u], None, None, NOW + timedelta(hours=i), NOW) for i, v, u in h]
    df = spark.createDataFrame(rows, BARS)
    whole = sorted(map(tuple, U.in_millimetres(df).collect()))
    monkeypatch.setattr(U, "PIECE", 64)
    assert sorted(map(tuple, U.in_millimetres(df).collect())) == whole and len(whole) == 500


def test_text_states_what_the_column_lacks(spark):
    rows = [(1, "f", None, 2500.0, "10M@20 cm", NOW, NOW), (2, "f", 150.0, None, "10M L=5.10 m", NOW, NOW), (2, "f", 150.0, None, "10M L=5.10 m", NOW, NOW + timedelta(days=9)), (3, None, None, None, None, None, None), (4, "f", 0.0, -1.0, "", NOW, NOW), (None, "f", 15.0, None, None, NOW, NOW)]
    got = {(r["bar_id"], r["field"], r["mm_tenths"]) for r in U.found(spark.createDataFrame(rows, BARS)).collect()}
    assert got == {(1, "espacement_mm", 2000), (2, "longueur_mm", 51000)}
    e = spark.createDataFrame([], BARS)
    assert U.found(e).count() == 0 and U.report(e).count() == 0


def test_extra_columns(spark):
    df = spark.createDataFrame([(1, "f", 15.0, None, "10M@15 cm", NOW, NOW)], BARS)
    df = df.withColumns({c: F.lit("x") for c in ("value", "unit", "mm", "n", "piece", "part", "h", "field", "key", "_n")})
    assert [tuple(r) for r in U.found(df).collect()] == [(1, "espacement_mm", 1500)]


# ---- reconciliation ----


@settings(max_examples=200, deadline=None)
@given(st.integers(0, R.P - 1), st.integers(0, R.P - 1))
def test_mul(a, b):
    assert int(R.mul61(np.array([a], np.uint64), np.array([b], np.uint64))[0]) == a * b % R.P


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 5), st.integers(0, 5), st.integers(0, 20), st.integers(0, 10**6))
def test_interpolation_recovers_differences(na, nb, shared, seed):
    r = random.Random(seed)
    pick = lambda n: {r.randrange(R.P) for _ in range(n)}
    a, b, s = pick(na), pick(nb), pick(shared)
    z = [int(x) for x in R.points(2 * 8 + 1 + R.CHECKS)]

    def value(elements, x):
        out = 1
        for e in elements:
            out = out * (x - e) % R.P
        return out

    ratio = [value(a | s, x) * pow(value(b | s, x), -1, R.P) % R.P for x in z]
    found = None
    for d in (1, 2, 4, 8, 16):
        found = R.interpolate(ratio, z, len(a) - len(b), d)
        if found:
            break
    num, den = found
    at = lambda p, e: int(R.evaluate(p, np.array([e], np.uint64))[0])
    assert len(num) == len(a) + 1 and len(den) == len(b) + 1
    assert all(at(num, e) == 0 for e in a) and all(at(den, e) == 0 for e in b)


@pytest.mark.parametrize(("n", "changed", "buckets"), [(60, 3, 4), (400, 150, 4), (50, 50, 1), (40, 0, 3)])
def test_differing_is_the_set_difference(spark, n, changed, buckets):
    r = random.Random(n)
    a = {f"k{i}": r.randrange(R.P) for i in range(n)}
    b = dict(a)
    for k in r.sample(sorted(a), changed):
        if r.random() < 0.3:
            del b[k]
        else:
            b[k] = r.randrange(R.P)
    b |= {f"new{i}": r.randrange(R.P) for i in range(changed // 3)}
    f = lambda x: spark.createDataFrame([(k, e, NOW) for k, e in sorted(x.items())], "key string, element long, at timestamp")
    got = [(x["side"], x["key"]) for x in R.differing(f(a), f(b), buckets).collect()]
    want = {(0, k) for k, e in a.items() if b.get(k) != e} | {(1, k) for k, e in b.items() if a.get(k) != e}
    assert len(got) == len(want) and set(got) == want


def test_recover_halves_what_differs_too_much():
    r = np.random.default_rng(5)
    a, b = r.integers(0, R.P, 700).astype(np.uint64), r.integers(0, R.P, 300).astype(np.uint64)
    both = r.integers(0, R.P, 500).astype(np.uint64)
    x, y = R.recover(np.r_[a, both], np.r_[both, b])
    assert x[:700].all() and not x[700:].any() and y[500:].all() and not y[:500].any()
    x, y = R.recover(a, a[:0])
    assert x.all() and not len(y)


def test_an_empty_or_small_side_makes_no_single_bucket(spark):
    rows = [rec(f"{i:05d}") for i in range(900)]
    assert len(differences(spark, [], rows)) == 900
    assert differences(spark, rows[:3], rows) == {(r[0], "missing_in_records") for r in rows[3:]}
    tenth = [rec(r[0], page=2) if i % 10 == 0 else r for i, r in enumerate(rows)]
    assert differences(spark, rows, tenth) == {(r[0], "page") for r in rows[::10]}


BAR = "struct<repere:string,diametre:string,quantite:int,espacement_mm:double,longueur_mm:double>"
REC = f"id string, source string, project string, fichier string, feuillet string, page int, x double, y double, type_element string, element string, armature array<{BAR}>, loaded_at timestamp"


def rec(i, **k):
    base = {"id": i, "source": "plan", "project": "P", "fichier": "f", "feuillet": "S-1", "page": 1, "x": 10.04, "y": 20.0, "type_element": "colonne", "element": "É-1", "armature": [("A", "10M", 4, 150.0, None), ("B", "15M", 2, None, 3000.0)], "loaded_at": NOW}
    return tuple((base | k).values())


def differences(spark, a, b):
    f = lambda rows: spark.createDataFrame(rows, REC)
    return {(r["id"], r["difference"]) for r in R.compare(f(a), f(b)).collect()}


def test_only_what_states_something_else(spark):
    same = [
        ("1", {"x": 10.0}), ("2", {"element": " É-1 "}), ("3", {"armature": [("B", "15M", 2, None, 3000.0049), ("A ", "10M", 4, 150.0, None)]}), ("4", {"armature": None}), ("5", {"loaded_at": None})]
    a = [rec(i, **({"armature": []} if i == "4" else {})) for i, _ in same]
    b = [rec(i, **k) for i, k in same]
    assert differences(spark, a, b) == set()
    other = [("1", {"x": 10.2}, "x"), ("2", {"element": "é-1"}, "element"), ("3", {"armature": [("A", "10M", 5, 150.0, None), ("B", "15M", 2, None, 3000.0)]}, "armature"), ("4", {"armature": [("A", "10M", 4, 150.02, None), ("B", "15M", 2, None, 3000.0)]}, "armature"),
             ("5", {"page": None}, "page"), ("6", {"source": "atelier"}, "source"), ("7", {"armature": [("A", "10M", 4, 150.0, None)]}, "armature"), ("8", {"fichier": None}, "fichier")]
    got = differences(spark, [rec(i) for i, _, _ in other] + [rec("9")], [rec(i, **k) for i, k, _ in other] + [rec("10"), rec("10", loaded_at=NOW + timedelta(days=1))])
    assert got == {(i, d) for i, _, d in other} | {("9", "missing_in_mirror"), ("10", "missing_in_records")}


def test_nothing_and_nulls(spark):
    assert differences(spark, [], []) == set()
    assert differences(spark, [rec("1")], []) == {("1", "missing_in_mirror")}
    none = tuple([None] * 12)
    assert differences(spark, [none], [none]) == set()
    bare = rec(None)
    assert differences(spark, [bare, bare], [bare]) == {("", "missing_in_mirror")}
    assert differences(spark, [bare], [bare, rec(None, page=7)]) == {("", "missing_in_records")}


def test_pieces_give_the_search_over_the_whole_history(spark, monkeypatch):
    r = random.Random(11)
    k = len(U.STATES)
    cost = np.array([[r.random() * 9 for _ in range(k)] for _ in range(60)])
    total = lambda path: sum(cost[i, s] + (U._CHANGE[path[i - 1], s] if i else 0) for i, s in enumerate(path))
    whole = U.segment(cost)
    cuts = [cost[i : i + 7] for i in range(0, 60, 7)]
    bounds = U.ends([U.passage(c) for c in cuts], None, None)
    parts = np.concatenate([U.segment(c, U._CHANGE, None if i == 0 else a, b) for i, (c, (a, b)) in enumerate(zip(cuts, bounds))])
    assert abs(total(parts) - total(whole)) < 1e-9
    # the same through tables, with several levels of blocks; runs of centimetres and inches in a source of millimetres
    rows, i = [], 0
    for src, n in (("a", 160), ("b", 5), ("c", 33)):
        for j in range(n):
            unit = "cm" if 40 <= j < 70 else "in" if 100 <= j < 130 else "mm"
            mm = r.choice([100.0, 150.0, 200.0, 250.0, 300.0])
            rows.append((src, i, j, mm / U.FACTORS[unit], None))
            i += 1
    d = spark.createDataFrame(rows, "f string, k long, t int, espacement_mm double, raw string")
    read = lambda: {(x["k"], x["unit"], x["mm"]) for x in U.histories(d, "f", ["t"], "espacement_mm", "k", "raw").collect()}
    want = read()
    assert len(want) == 198 and {u for _, u, _ in want} == {"mm", "cm", "in"}
    monkeypatch.setattr(U, "PIECE", 6)
    monkeypatch.setattr(U, "FAN", 3)
    assert read() == want


def test_a_stated_unit_decides(spark):
    d = spark.createDataFrame([("f", i, i, v, raw) for i, (v, raw) in enumerate([(1200.0, "4-15M L=1200 mm"), (700.0, "4-15M L=700 mm"), (3000.0, "4-15M L=3000 mm")])], "f string, k long, t int, longueur_mm double, raw string")
    assert {(x["k"], x["unit"], x["mm"]) for x in U.histories(d, "f", ["t"], "longueur_mm", "k", "raw").collect()} == {(0, "mm", 1200.0), (1, "mm", 700.0), (2, "mm", 3000.0)}
