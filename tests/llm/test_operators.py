"""Training-data operators against brute force, on cases of their own, and on tables that are empty, null or oddly named."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ferrolith.llm import canonical, leakage, linkage, packing, represent, residue

BAR = "struct<repere:string,diametre:string,quantite:int,espacement_mm:double,longueur_mm:double>"
DEBUG = "struct<niveau:string,raw:array<string>,roles:array<string>,role:string,layer:string,direction:string,reinforcement_kind:string,view:string,confidence:double>"
RECORD = f"id string, seq long, source string, project string, fichier string, feuillet string, page int, x double, y double, type_element string, element string, armature array<{BAR}>, debug {DEBUG}, read_at timestamp, loaded_at timestamp"
SUPPORT = "support_id long, project string, fichier string, page int, view string, coordinate string, level string, layer string, status string, confidence double, duplicate_conflict boolean, reason string, bars array<struct<label:string,quantite:int,diametre:string,longueur_mm:double,repere:string>>, read_at timestamp, loaded_at timestamp"
BARS = "bar_id long, project string, fichier string, niveau string, diametre string, loaded_at timestamp"
REF = "ref_id int, field string, label string"
DOC, ITEM = "doc_id long, text string, lang string", "item_id long, text string, task string"
NOW = datetime(2030, 1, 1)


# ---- 1 ----


def reading(i, coordinate="A-1", fichier="DA_X_L00001_DALLE-NIV-3 rev A.pdf", level="NIVEAU 3", layer="haut", bars=(("NUM", 4, "25M", 3000.0),), confidence=0.9, day=0):
    b = [(*x, None) for x in bars] if bars is not None else None
    return (i, "X", fichier, 1, "main", coordinate, level, layer, "read", confidence, False, None, b, NOW + timedelta(days=day), NOW)


def survivors(spark, rows):
    return {(r["group_id"], r["survivor_id"]) for r in represent.found(spark.createDataFrame(rows, SUPPORT)).collect()}


def test_last_issue_then_fullest_then_surest(spark):
    b = "DA_X_L00001_DALLE-NIV-3 rev B.pdf"
    assert survivors(spark, [reading(1, confidence=0.99), reading(2, "a–1", b, "N3", "HAUT", confidence=0.4)]) == {(1, 2)}
    assert survivors(spark, [reading(1), reading(2, level=None, confidence=0.99)]) == {(1, 1)}
    assert survivors(spark, [reading(1, confidence=0.5), reading(2, confidence=0.6)]) == {(1, 2)}
    assert survivors(spark, [reading(3, confidence=0.5), reading(7, confidence=0.5)]) == {(3, 3)}


def test_what_is_one_support(spark):
    assert survivors(spark, [reading(1), reading(2, layer="bas"), reading(3, "A-2"), reading(4, fichier="DA_X_L00002_DALLE-NIV-3.pdf"), reading(5, level="NIVEAU 4")]) == set()
    # a reading without a layer goes to the layer that states its bars; with other bars it stays alone
    assert survivors(spark, [reading(1), reading(2, layer=None)]) == {(1, 1)}
    assert survivors(spark, [reading(1), reading(2, layer=None, bars=(("NUM", 9, "10M", 5000.0),))]) == set()
    assert survivors(spark, [reading(1), reading(1)]) == set()


def test_without_issue_days_tell(spark):
    f = "DA_X_L00001_DALLE-NIV-3.pdf"
    assert survivors(spark, [reading(1, fichier=f, confidence=0.9), reading(2, fichier=f, day=60, bars=None, confidence=0.2), reading(3, fichier=f, day=58, confidence=0.1)]) == {(1, 3)}


def test_bundles_have_trust_of_their_own_and_dependencies_bind_them(spark):
    a, b = (f"DA_X_L00001_DALLE-NIV-3 rev {x}.pdf" for x in "AB")
    b2 = b.replace("DA_X_L", "DA_X_copy_L")
    place = lambda r, page, view: (*r[:3], page, view, *r[5:])
    # the fullest statement and the best view are of an older issue; of the last one, 2 states more and 3 has the view
    rows = [place(reading(1, fichier=a, confidence=0.99), 7, "old"), place(reading(2, fichier=b), None, None), place(reading(3, fichier=b, bars=None, confidence=0.3), 2, "main")]
    s = spark.createDataFrame(rows, SUPPORT)
    got = represent.survivors(s).collect()
    assert [(r["survivor_id"], r["fichier"], r["page"], r["view"], r["bars"]) for r in got] == [(2, b, 2, "main", 1)]
    # without dependencies each bundle would be the best by itself: the search decides
    free = [represent.Bundle(x.name, x.fields, x.trust) for x in represent.support_bundles()]
    groups = represent.groups(s)
    froms = lambda bundles: [tuple(r[f"{x.name}_from"] for x in bundles) for r in represent.choose(groups, "_group", "support_id", bundles).collect()]
    assert froms(represent.support_bundles()) == [(2, 2, 3)] and froms(free) == [(2, 1, 1)]
    assert survivors(spark, rows) == {(1, 2)}
    # two files of one issue: page and view are of the file they are given with
    rows = [place(reading(4, fichier=b), None, None), place(reading(5, fichier=b2), 9, "other")]
    got = represent.survivors(spark.createDataFrame(rows, SUPPORT)).collect()
    assert [(r["survivor_id"], r["fichier"], r["page"], r["view"]) for r in got] == [(4, b2, 9, "other")]


def test_search_is_exhaustive():
    r = random.Random(3)
    for _ in range(200):
        by = {}
        for n in "abc":
            by[n] = sorted((((r.randrange(4),), i, {t: r.randrange(2) for t in r.sample("xy", r.randrange(3))}) for i in range(r.randrange(1, 5))), key=lambda c: c[0], reverse=True)
        best = None
        for x in by["a"]:
            for y in by["b"]:
                for z in by["c"]:
                    ties: dict = {}
                    if all(ties.setdefault(k, v) == v for c in (x, y, z) for k, v in c[2].items()):
                        best = max(best or (), (x[0], y[0], z[0])) if best else (x[0], y[0], z[0])
        got = represent._search(list("abc"), by)
        assert (None if got is None else tuple(got[n][0] for n in "abc")) == best


# ---- 2 ----


def record(i, plan, element, level, bars, x, y, kind="colonne", lot="00001", sheet="S-501"):
    f = f"STR_X_L{lot}.pdf" if plan else f"X-L{lot}_COL_NIV-{level}.pdf"
    b = [(None, d, q, s, None) for d, q, s in bars]
    return (f"{'PL' if plan else 'DA'}{i:04d}", i, "plan" if plan else "atelier", "X", f, sheet + str(level), 1, x, y, kind, element, b, (f"NIVEAU {level}", [], [], None, None, None, None, None, 0.9), NOW, NOW)


def test_linkage_by_place_bars_and_axes(spark):
    r = random.Random(5)
    spots = [(c, n) for c in "ABCDEF" for n in range(1, 6)]
    plan, shop, want = [], [], set()
    for i, (c, n) in enumerate(spots):
        bars = [("25M", r.randrange(2, 30), None), ("10M", None, float(r.randrange(100, 400)))]
        x, y = (ord(c) - 64) * 70.0, n * 55.0
        plan.append(record(i, True, f"{c}-{n}", 3, bars, x, y))
        if i % 9 == 4:
            continue  # not in the shop's drawings
        name = "UNKNOWN" if i % 7 == 2 else f"AXES {n}/{c}" if i % 2 else f"({c}-{n})"
        if i % 5 == 1:
            bars = [("25M", 77, None), bars[1]]
        shop.append(record(100 + i, False, name, 3, bars, 500 + 0.8 * x - 0.02 * y, 90 + 0.8 * y + 0.02 * x))
        want.add((f"DA{100 + i:04d}", f"PL{i:04d}"))
    # the same labels in another lot and storey
    plan.append(record(500, True, "A-1", 4, [("25M", 3, None)], 70.0, 55.0))
    shop.append(record(600, False, "A-1", 3, [("25M", 3, None)], 1.0, 1.0, lot="00002"))
    got = {(x["atelier_id"], x["plan_id"]) for x in linkage.found(spark.createDataFrame(plan, RECORD), spark.createDataFrame(shop, RECORD)).collect()}
    assert got == want


def test_linkage_of_crowded_places_without_positions(spark):
    # 10 records of each side at one place, 100 comparisons: bars and positions of no help but for the figures
    plan = [record(i, True, "A-1", 3, [("25M", 4 + i, None), ("10M", None, 300.0)], None, None) for i in range(10)]
    shop = [record(100 + i, False, "A-1", 3, [("25M", 4 + i, None), ("10M", None, 300.0)], None, None) for i in range(10)]
    # 9 of each side with the same bars, without a place on one side
    plan += [record(200 + i, True, f"B-{i + 1}", 4, [("20M", 6, None)], None, None) for i in range(9)]
    shop += [record(300 + i, False, "UNKNOWN", 4, [("20M", 6, None)], None, None) for i in range(9)]
    # hot in place and in all bars
    plan += [record(400 + i, True, "C-1", 5, [("15M", 8, None)], None, None) for i in range(9)]
    shop += [record(500 + i, False, "C-1", 5, [("15M", 8, None)], None, None) for i in range(9)]
    got = {(x["atelier_id"], x["plan_id"]) for x in linkage.found(spark.createDataFrame(plan, RECORD), spark.createDataFrame(shop, RECORD)).collect()}
    assert got >= {(f"DA{100 + i:04d}", f"PL{i:04d}") for i in range(10)}
    assert len(got) == 28 and len({a for a, _ in got}) == len({p for _, p in got}) == 28


def test_common_pairs_are_all_pairs_that_reach_the_threshold(spark):
    r = random.Random(11)
    bars = lambda: [(r.choice(["15M", "25M"]), r.choice([2, 3, None]), r.choice([None, 200.0])) for _ in range(r.randrange(0, 4))]
    name = lambda: r.choice(["A-1", "A-2", "B-7", "UNKNOWN"])
    plan = linkage.attributes(spark.createDataFrame([record(i, True, name(), 3, bars(), None, None) for i in range(40)], RECORD), True).cache()
    shop = linkage.attributes(spark.createDataFrame([record(100 + i, False, name(), 3, bars(), None, None) for i in range(40)], RECORD), False).cache()
    full = plan.select("scope", F.col("id").alias("plan_id"), "place", "part", "marks").join(shop.select("scope", F.col("id").alias("shop_id"), *[F.col(c).alias(c + "2") for c in ("place", "part", "marks")]), "scope").withColumn("n", F.lit(0))
    pairs = lambda df: {(x["plan_id"], x["shop_id"]) for x in df.select("plan_id", "shop_id").collect()}
    want = pairs(full.filter(F.round(linkage._stated(), 6) >= linkage.ACCEPT))
    old, linkage.RARE, linkage.SALT = (linkage.RARE, linkage.SALT), 0, 7
    try:
        assert want and pairs(linkage.common(plan, shop)) == want
    finally:
        linkage.RARE, linkage.SALT = old


def test_pairs_are_taken_greedily_in_one_pass(spark):
    r = random.Random(5)
    rows = [("equal", f"p{i:02d}", f"s{j:02d}", 2.5) for i in range(25) for j in range(25)]
    rows += [("mixed", f"P{i:02d}", f"S{j:02d}", r.choice([2.0, 2.5, 3.0])) for i in range(30) for j in range(30) if r.random() < 0.3]
    plans, shops, want = set(), set(), set()
    for _, p, s, _ in sorted(rows, key=lambda e: (-e[3], e[1], e[2])):
        if p not in plans and s not in shops:
            plans.add(p)
            shops.add(s)
            want.add((p, s))
    edges = spark.createDataFrame(r.sample(rows, len(rows)), "scope string, plan_id string, shop_id string, s double").repartition(3)
    jobs = lambda: spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs()
    before = jobs()
    got = linkage.one_to_one(edges)
    assert jobs() - before <= 6  # each job leaves something in the driver's memory; equal records took a round of jobs each
    assert {(x["plan_id"], x["shop_id"]) for x in got.collect()} == want


def test_linkage_of_nothing(spark):
    e = spark.createDataFrame([], RECORD)
    assert linkage.found(e, e).count() == 0
    n = spark.createDataFrame([tuple([None] * 15), ("DA1", *[None] * 14)], RECORD)
    assert linkage.found(n, n).count() == 0


# ---- 4 ----


@pytest.fixture(scope="module")
def ref(spark):
    labels = [("diametre", f"{n}M") for n in (10, 15, 20, 25)] + [("niveau", x) for x in ("FONDATION", "TRÉFOND", "SOUS-SOL S2", "RDC", "NIVEAU 2", "NIVEAU 12", "TOIT", "APPENTIS")]
    return spark.createDataFrame([(i + 1, *x) for i, x in enumerate(labels)], REF)


def test_values(spark, ref):
    cases = [("diametre", "2SM", "25M"), ("diametre", "barre 10", "10M"), ("diametre", "VOIR DÉTAIL 2", None), ("diametre", "M15", "15M"), ("diametre", "lisse", None), ("niveau", "FOND.", "FONDATION"), ("niveau", "FNODATION", "FONDATION"),
             ("niveau", "ss-2", "SOUS-SOL S2"), ("niveau", "NIVEAU I2", "NIVEAU 12"), ("niveau", "NIV. 39", None), ("niveau", "?", None), ("niveau", "", None), ("niveau", "x" * 50_000, None), ("niveau", "R D C", "RDC")]
    rows = [(i, "X", "f", v if f == "niveau" else None, v if f == "diametre" else None, NOW) for i, (f, v, _) in enumerate(cases)]
    rows += [(900, "X", "f", "RDC", "10M", NOW), (0, *rows[0][1:5], NOW + timedelta(days=1)), (901, None, None, None, None, None)]
    ids = {(r["field"], r["label"]): r["ref_id"] for r in ref.collect()}
    got = {(r["bar_id"], r["field"], r["ref_id"]) for r in canonical.found(spark.createDataFrame(rows, BARS), ref).collect()}
    assert got == {(i, f, ids.get((f, w), 0)) for i, (f, _, w) in enumerate(cases)}


def test_prefix_join_is_the_full_join(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abc") for _ in range(r.randrange(2, 7)))
    v = [("f", word(), "") for _ in range(60)]
    e = [("f", i + 1, word(), "") for i in range(40)]
    tok = lambda w: sorted(canonical.grams(w))
    vals = spark.createDataFrame(sorted({(f, w, n, tuple(tok(w))) for f, w, n in v}), "field string, value string, number string, tokens array<string>")
    ents = spark.createDataFrame([(f, i, n, tok(w)) for f, i, w, n in e], "field string, ref_id int, number string, tokens array<string>")
    for t in (0.34, 0.6, 0.9):
        want, best = set(), {}
        for _, w, _ in v:
            s = [(len(canonical.grams(w) & canonical.grams(x)) / len(canonical.grams(w) | canonical.grams(x)), -i) for _, i, x, _ in e]
            want |= {(w, -i) for j, i in s if j >= t - 1e-12}
            if max(s)[0] >= t - 1e-12:
                best[w] = -max(s)[1]
        got = canonical.similar_entries(vals, ents, t)
        assert sorted((x["value"], x["ref_id"]) for x in got.collect()) == sorted(want)
        assert {x["value"]: x["ref_id"] for x in canonical.best_entries(got).collect()} == best


def test_pairs_of_other_numbers_are_seen_but_not_mapped(spark, ref):
    vals = canonical.tokenised(spark.createDataFrame([("niveau", "NIVEAU 99"), ("city", "Sankt-Gallen 1")], "field string, value string"))
    ents = canonical.tokenised(ref.select("field", F.col("label").alias("value"), "ref_id").unionByName(spark.createDataFrame([("city", "SANKT GALLEN 1", 77)], "field string, value string, ref_id int")))
    got = canonical.similar_entries(vals, ents)
    assert got.filter("value = 'NIVEAU 99' and not agree").count() > 0
    assert {(r["value"], r["ref_id"]) for r in canonical.best_entries(got).collect()} == {("Sankt-Gallen 1", 77)}


def test_values_of_nothing(spark, ref):
    assert canonical.found(spark.createDataFrame([], BARS), ref).count() == 0
    assert {r["ref_id"] for r in canonical.found(spark.createDataFrame([(1, "X", "f", "RDC", None, NOW)], BARS), ref.limit(0)).collect()} == {0}


# ---- 6 ----


def check_packing(rows, sizes, caps):
    held: dict = {}
    pieces: dict = {}
    for r in rows:
        held[r["size_name"], r["container"]] = held.get((r["size_name"], r["container"]), 0) + r["tokens"]
        pieces.setdefault((r["size_name"], r["doc_id"]), []).append((r["piece"], r["tokens"]))
    assert all(v <= caps[n] for (n, _), v in held.items())
    for n, c in caps.items():
        for d, t in sizes.items():
            p = sorted(pieces[n, d])
            assert [x for x, _ in p] == list(range(len(p))) and sum(x for _, x in p) == t
            assert len(p) == max(1, -(-t // c))
    return held


def test_packing(spark):
    r = random.Random(6)
    sizes = {i: int(min(3000, r.expovariate(1 / 150))) for i in range(3000)} | {5000: 0, 5001: 100, 5002: 2300}
    caps = {"a": 100, "b": 1000}
    t = spark.createDataFrame(list(sizes.items()), "doc_id long, tokens long")
    c = spark.createDataFrame([*caps.items(), ("none", 0), ("null", None)], "size_name string, capacity_tokens int")
    rows = packing.pack(t, c, open_=32, per_part=400).collect()
    held = check_packing(rows, sizes, caps)
    for n, cap in caps.items():
        k = [v for (m, _), v in held.items() if m == n]
        assert sum(k) / (len(k) * cap) > 0.93
    again = packing.pack(t.repartition(7), c, open_=32, per_part=400).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_packing_of_nothing(spark):
    d = spark.createDataFrame([], DOC)
    c = spark.createDataFrame([("a", 10)], "size_name string, capacity_tokens int")
    assert packing.packing(d, c).count() == 0
    d = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, "word " * 40, None), (3, "word " * 40, None)], DOC)
    got = packing.packing(d, c).groupBy("doc_id").agg(F.sum("tokens").alias("t")).collect()
    assert {r["doc_id"] for r in got} == {2, 3}


# ---- 7 ----


def items_of(n=12, seed=1):
    r = random.Random(seed)
    name = lambda: "".join(r.choice(["ba", "ko", "ri", "tu", "zel", "mor", "dan"]) for _ in range(3)).title()
    return [f"According to ledger {r.randrange(100, 999)}-{r.randrange(10, 99)}, {name()}-{name()} shipped {r.randrange(1000, 9999)} linen sails in late harvest, {r.randrange(10, 99)} fewer than {name()} {name()} had forecast for {name()}." for _ in range(n)]


def test_leaks(spark):
    it = items_of()
    other = items_of(seed=9)[0]  # made after the same pattern, but another
    w = it[0].split()
    filler = "The debate on the dairy quota has lasted five years and nobody in the valley believes that any longer."
    docs = {
        1: f"{filler} {it[0]} {filler}", 2: it[1].upper().replace(" ", "\n"), 3: other, 4: filler, 5: " ".join(w[:9]), 6: " ".join([*w[:10], filler, *w[10:]]), 7: it[2].replace("i", "1").replace("o", "0"),
        8: " ".join(x if i % 6 != 3 else "indeed" for i, x in enumerate(it[3].split())), 9: None, 10: "", 11: filler * 3000 + it[4], 12: " ".join(reversed(w))}
    d = spark.createDataFrame([(k, v, "en") for k, v in docs.items()], DOC)
    i = spark.createDataFrame([(k, t, "q") for k, t in enumerate(it)] + [(50, None, "q"), (51, "", "q")], ITEM)
    got = {(r["item_id"], r["doc_id"]) for r in leakage.found(d, i).collect()}
    assert got == {(0, 1), (1, 2), (0, 6), (2, 7), (3, 8), (4, 11)}


def leaked(spark, docs, items):
    return {(r["item_id"], r["doc_id"]) for r in leakage.found(spark.createDataFrame([(*d, "en") for d in docs], DOC), spark.createDataFrame([(*i, "q") for i in items], ITEM)).collect()}


def test_leaks_of_repeated_items_and_shared_passages(spark):
    it = items_of()
    w = it[0].split()
    items = [*enumerate(it), (0, it[0]), (70, it[0].upper())]  # delivered twice, and under another id
    altered = " ".join(x if i % 6 != 3 else "indeed" for i, x in enumerate(w))
    assert leaked(spark, [(1, f"so {it[0]} so"), (2, altered), (3, " ".join(w[:9]))], items) == {(0, 1), (70, 1), (0, 2), (70, 2)}
    # a passage that two items share, alone and inside more of one of them
    shared = " ".join(f"passage{chr(97 + i)}" for i in range(18))
    items = [*enumerate(it), (80, f"{it[1]} {shared} {it[2]}"), (81, f"{it[3]} {shared} {it[4]}")]
    got = leaked(spark, [(1, f"so {shared} so"), (2, f"Autumn passed quietly. {' '.join(it[1].split()[-4:])} {shared} {' '.join(it[2].split()[:4])}")], items)
    assert {x for x in got if x[0] >= 80} == {(80, 1), (81, 1), (80, 2), (81, 2)}


@pytest.mark.parametrize("n", [1, 2, 3, 6, 7])
def test_leaks_of_few_items(spark, n):
    it = items_of(n)
    docs = [(k, f"so {' '.join(x if i % 6 != 3 else 'indeed' for i, x in enumerate(t.split()))} so") for k, t in enumerate(it)]
    assert leaked(spark, [*docs, (90, items_of(seed=9)[0])], [*enumerate(it)]) == {(k, k) for k in range(n)}


def test_leaks_do_not_depend_on_blocks(spark, monkeypatch):
    it = items_of(16)
    docs = [(k, f"so {' '.join(x if i % 6 != 3 else 'indeed' for i, x in enumerate(t.split()))} so") for k, t in enumerate(it)]
    docs += [(100 + k, x) for k, x in enumerate(items_of(30, seed=9))]
    whole = leaked(spark, docs, [*enumerate(it)])
    assert whole == {(k, k) for k in range(16)}
    monkeypatch.setattr(leakage, "ITEMS_BYTES", 900)
    assert leaked(spark, docs, [*enumerate(it)]) == whole


def test_spans_are_taken_out(spark):
    it = items_of()
    long = " ".join(items_of(12, seed=9)[6:8])
    docs = [(1, f"Zuerst das. {it[0]} {long}"), (2, it[1]), (3, long), (4, None), (5, "")]
    d = spark.createDataFrame([(*x, "en") for x in docs], DOC)
    got = {r["doc_id"]: (r["text"], r["removed"]) for r in leakage.cleaned(d, spark.createDataFrame([(*i, "q") for i in enumerate(it)], ITEM)).collect()}
    assert got[3] == (long, 0) and got[4] == (None, 0) and got[5] == ("", 0)
    assert got[2][0] is None and got[2][1] >= 15
    rest, n = leakage.without(docs[0][1], [(2, 2 + len(it[0].split()) - 1)])
    assert rest.startswith("Zuerst das.") and rest.endswith(long) and n == len(it[0].split())
    assert leakage.without("a b c d e", [(1, 2), (2, 3)]) == ("a e", 3)
    assert got[1][1] >= 15 and got[1][0].startswith("Zuerst das.") and got[1][0].endswith(long)


def test_automaton_matches_brute_force():
    r = random.Random(8)
    texts = [[r.choice("abc") for _ in range(r.randrange(1, 14))] for _ in range(6)]
    sam = leakage.Automaton(texts)
    subs: dict = {}
    for k, t in enumerate(texts):
        for i in range(len(t)):
            for j in range(i, len(t)):
                subs.setdefault(tuple(t[i : j + 1]), set()).add((k, j))
    for _ in range(60):
        doc = [r.choice("abcd") for _ in range(20)]
        longest = [max((n for n in range(1, e + 2) if tuple(doc[e - n + 1 : e + 1]) in subs), default=0) for e in range(len(doc))]
        want = {(longest[e], e) for e in range(len(doc)) if longest[e] and (e + 1 == len(doc) or longest[e + 1] != longest[e] + 1)}
        got = set()
        for state, n, e in sam.runs(doc):
            got.add((n, e))
            assert set(sam.ends(state)) == subs[tuple(doc[e - n + 1 : e + 1])]
        assert got == want


def test_leaks_of_nothing(spark):
    d, i = spark.createDataFrame([], DOC), spark.createDataFrame([], ITEM)
    assert leakage.found(d, i).count() == 0
    assert leakage.found(spark.createDataFrame([(1, "a b c", "en")], DOC), i).count() == 0


# ---- 8 ----


@pytest.mark.parametrize("text", [
    "We agree {{ member_name }} on the aim.", "Dear ${NAME}, thanks", "the #{party} said", "%(vote_result)s in favour", "[[DATE]] we met", "[insert speaker here] rose", "[date TBC]", "on XX.XX.20XX we", "Mr/Mrs XXXXX said", "My group {2} tabled", "@@groupe@@",
    "__DATUM__", "&lt;datum&gt;", "<%= date %>", "<<speaker>>", "[À REMPLIR]", "[BITTE AUSFÜLLEN]", "Lorem ipsum fauci", "Blindtext für das Layout.", "Body copy here. Body copy here. Body copy here.", "xxxx xxxx xxxx xxxx", "Error 504 | bad gateway", "404\nce dossier est introuvable",
    "Oops! the request timed out", "The page has moved or no longer exists", "Please enable JavaScript to continue.", "DIESE ANSICHT BENÖTIGT JAVASCRIPT", "Votre navigateur bloque les scripts utiles Ã  cette page", "ZurÃ¼ck. Interner Serverfehler.",
    "Dear [Your Name], hello", "Order [ORDER_NUMBER] is done", "Please enable cookies to continue.", "Checking your browser before accessing the site.", "Something went wrong. Please reload the page.", "sed do eiusmod tempor incididunt ut labore et dolore magna aliqua",
    "Error 404. Página no encontrada.", "Noscript fallback: content hidden.", "bla " * 9, "asdf qwer " * 4, "Please enable script.", "Mr/Mrs X said"])
def test_residue(text):
    assert residue.kinds(text)


@pytest.mark.parametrize("text", [
    None, "", "He said [sic] so.", "[inaudible] I spoke of this", "[Kelovac: That is wrong!]", "I refer to Chapter XX, article 13[b], and to the set {1, 2, 3} of annexes.", "When citizens of Drosk open the portal they read error 404, page not found, and nothing else, Minister!",
    "The ministry's form demanded JavaScript, and half of Velmora could not file.", "A service unavailable since 12 weeks is no service.", "Use `{{name}}` here.", "The draft still had blanks where names should stand.", "The sitting is resumed. The sitting is resumed. The sitting is resumed.",
    "On lit erreur 404, page introuvable, madame la ministre !", "dans ma circonscription, cela ne suffit pas", "50% of <b>it</b>",
    "Hear, hear! Hear, hear! Hear, hear!", "Nein, nein, nein! Never, never, never again.", "In my circonscription the transcript is ready."])
def test_no_residue(text):
    assert residue.kinds(text) == []


def test_residue_table(spark):
    d = spark.createDataFrame([(1, "Lorem ipsum", "en"), (2, None, None), (3, "fine", "en"), (None, "Lorem ipsum", "en"), (4, "fine. " * 200_000 + "{{x}}", "en")], DOC)
    assert {r["doc_id"] for r in residue.found(d).collect()} == {1, 4}
    assert residue.found(d.limit(0)).count() == 0


# ---- odd tables ----


def test_clashing_columns_and_nulls(spark, ref):
    odd = lambda df: df.withColumns({c: F.lit("x") for c in ("_n", "_lot", "_group", "key", "value", "n", "n_", "number", "tokens", "bucket", "scope", "marks", "size", "kind", "_s", "lot", "h", "item") if c not in df.columns})
    nulls = lambda schema: spark.createDataFrame([], schema).unionByName(spark.range(2).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in spark.createDataFrame([], schema).schema]))
    s = odd(nulls(SUPPORT).unionByName(spark.createDataFrame([reading(1), reading(2)], SUPPORT)))
    assert represent.found(s).count() == 1
    assert represent.survivors(s).count() == 1
    b = odd(nulls(BARS).unionByName(spark.createDataFrame([(1, "X", "f", "rdc", "10m", NOW)], BARS)))
    assert canonical.found(b, odd(ref)).count() == 2
    p = odd(nulls(RECORD).unionByName(spark.createDataFrame([record(1, True, "A-1", 3, [("25M", 4, None)], 1.0, 1.0)], RECORD)))
    h = odd(nulls(RECORD).unionByName(spark.createDataFrame([record(2, False, "A-1", 3, [("25M", 4, None)], 1.0, 1.0)], RECORD)))
    assert linkage.found(p, h).count() == 1
    d = odd(nulls(DOC).unionByName(spark.createDataFrame([(1, "Lorem ipsum", "en")], DOC)))
    assert residue.found(d).count() == 1
    assert leakage.found(d, odd(nulls(ITEM))).count() == 0
    assert packing.packing(d, spark.createDataFrame([("a", 10)], "size_name string, capacity_tokens int")).count() == 1
