import pytest
from pyspark.sql import functions as F

from ferrolith.functions import barlines as B
from ferrolith.functions import grammar as G
from ferrolith.functions import places as P
from ferrolith.operators import pages
from ferrolith.functions.text import fold, py_fold, strip_space, unscramble


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("text", "mm"), [("157' - 9\"", 48082.2), ('6"', 152.4), ('16 1/4"', 412.8), ("100", None), ("9'", 2743.2), (None, None)])
def test_imperial_length(spark, text, mm):
    assert one(spark, G.imperial_length(F.lit(text).cast("string"))) == mm


@pytest.mark.parametrize(("text", "imperial", "mm"), [('10M@6" c/c', True, 152.4), ("10M@100 c/c", False, 100.0), ("ARM.: 4-25M", False, None), ("10M@6", True, 152.4), ("10M@6 mm", True, 6.0)])
def test_spacing(spark, text, imperial, mm):
    assert one(spark, G.spacing(F.lit(text), F.lit(imperial))) == mm


@pytest.mark.parametrize(("place", "at"), [("G.5-8", (6.5, 8.0)), ("A-12.7", (0.0, 12.7)), ("UNKNOWN", (None, None))])
def test_grid_position(spark, place, at):
    assert (one(spark, G.grid_letter(F.lit(place))), one(spark, G.grid_number(F.lit(place)))) == at


def test_bar_line(spark):
    b = one(spark, G.bar_line(F.lit("VERT: :4 25M 17-06"), F.lit(True)))
    assert (b["label"], b["quantite"], b["diametre"], b["longueur_mm"], b["repere"], b["repaired"]) == ("VERT", 4, "25M", 5334.0, None, True)
    b = one(spark, G.bar_line(F.lit("415J5-06"), F.lit(True)))
    assert (b["quantite"], b["diametre"], b["repere"]) == (4, "15M", "15J5-06")
    assert one(spark, G.bar_line(F.lit("4 12M"), F.lit(True))) is None
    assert one(spark, G.bar_line(F.lit(None).cast("string"), F.lit(True))) is None


@pytest.mark.parametrize(("text", "want"), [
    ("NUM. 3 15J15-03", ("NUM", 3, "15M", "15J15-03", None, None, True)), ("-3 15J15-03", (None, 3, "15M", "15J15-03", None, None, True)), ("15.15M 17-06", (None, 15, "15M", None, None, 5334.0, True)), ("4 25M @6\"", (None, 4, "25M", None, 152.4, None, False)),
    ("ÉTRI: 25 10M 10ET13X21 @ 6 1/2\" c/c", ("ETRI", 25, "10M", "10ET13X21", 165.1, None, False)), ("● 4 25M", (None, 4, "25M", None, None, None, True)), ("ATT-LAT.: 15J3-00", ("ATT-LAT", None, None, "15J3-00", None, None, False)), ("4 15MX", (None, 4, "15M", "15MX", None, None, True)), ("VOIR COUPE", None), ("", None),
    ("VERT: 4 25M A12 voir", ("VERT", 4, "25M", "A12", None, None, False)), ("4 35M 7-00", (None, 4, "35M", None, None, 2133.6, False))])
def test_forms_of_bar_lines(text, want):
    assert B.read_bar(text, True) == want


MAT = dict(zip([f.split(" ")[0] for f in B.SPEC.split(", ")], range(11)))


def test_mat_bars():
    get = lambda t, *f: tuple(B.read_mat(t)[MAT[x]] for x in f)
    assert get('LONG: 2x22 25M 25RL22-00 @8"HAUT', "label", "sets", "quantite", "diametre", "repere", "espacement_mm", "face", "issues", "repaired") == ("LONG", 2, 44, "25M", "25RL22-00", 203.2, "HAUT", [], False)
    assert get('LONG: 9 35M 42-09 @8"BAS', "repere", "longueur_mm", "issues") == (None, 13030.2, [])
    assert get('L: 5 25RU8-04 @8"HAUT', "label", "quantite", "diametre", "repaired") == ("L", 5, "25M", False)
    assert get('LONG: 2x7 30M 35RU22-07 @11"BAS trailing junk', "diametre", "repere", "issues", "notes") == ("30M", "35RU22-07", [], ["mark 35RU22-07 carries a different size than 30M"])
    for t in ('LONG: 24 35M 42-09 07"BAS', 'LONG: 11 25M 25RU12-09 a10"BAS', 'TRAN: 16 30M 30RL17-00 @8."BAS', 'LONG: 44 35M 35RL40-00 @7"BA5', 'L0NG: 9 30M 26-03 @8"HAUT', 'TRAN: 44 25 25RU24-10 @8"BAS', 'LONG: 20 25M 255U16-06 @9"BAS', 'LONG: 9 3QM 30RU19-09 @8"BAS'):
        assert get(t, "issues", "repaired") == ([], True), t
    assert get('TRAN: 20 30M 30RL23-09@8"HAUT', "espacement_mm", "issues", "repaired") == (203.2, [], False)
    assert get('LONG: 24 35M 42-09 07"BAS', "espacement_mm") == (177.8,) and get('LONG: 20 25M 255U16-06 @9"BAS', "repere") == ("25SU16-06",)
    for t in ('TRAN: 20 25M 25RL16 06 @8"BAS', 'LONG: 10 25M 25RU21-0.0 @8"HAUT'):
        assert get(t, "repere", "longueur_mm") == (None, None) and get(t, "issues")[0]
    assert get("TRAN: 12 25M 25RU19-09", "issues") == (["spacing unread", "face (HAUT/BAS) unread"],)
    assert B.read_mat("COLONNE J.5-12, 10X30:") is None and B.read_mat('ATT: 22 15M 7-00 @8"BAS') is None and B.read_mat("") is None


@pytest.mark.parametrize(("text", "want"), [("16(8)", (16, 8, "15M")), ("12(9)-20M", (12, 9, "20M")), ("5 (3) - 15M", (5, 3, "15M")), ("5(3)20M", (5, 3, "20M")), ("5(3-20M)", (5, 3, "20M")), ("4 - 20 M LG 3000", (4, None, "20M")), ("4-22M", None), ("PLAN", None), (None, None)])
def test_slab_callouts(spark, text, want):
    b = one(spark, G.slab_callout(F.lit(text).cast("string"), F.lit("15M")))
    assert (b and tuple(b)) == want


@pytest.mark.parametrize(("text", "want"), [
    ("4 - 20M", ("longitudinale", 4, "20M", None)), ("LIT 1: 4-20M", ("lit 1", 4, "20M", None)), ("1ER LIT: 4-20M", ("lit 1", 4, "20M", None)), ("2e lit 4-20m", ("lit 2", 4, "20M", None)), ("ARM. DE PEAU 10M@300", ("peau", None, "10M", 300.0)), ("12 ETRIERS 10M", ("étriers", 12, "10M", None)),
    ("10M @ 12\" c/c", ("étriers", None, "10M", 304.8)), ("_4-25M CONT.", ("longitudinale", 4, "25M", None)), ("P101 - 12x24", None)])
def test_beam_callouts(spark, text, want):
    b = one(spark, G.beam_callout(F.lit(text), F.lit(False)))
    assert (b and tuple(b)) == want


@pytest.mark.parametrize(("text", "want"), [
    ('RANG 1 & 2: 25M @ 8"', ("1 & 2", None, "25M", 203.2)), ('1ER RANG 25M @ 8"', ("1", None, "25M", 203.2)), ("2 RANGS DE 20M @ 300", ("2 lits", None, "20M", 300.0)), ("12-25M E.F.", (None, 12, "25M", None)), ("RANG 3: 20M@300", ("3", None, "20M", 300.0)), ("RANG 3", None)])
def test_mat_callouts(spark, text, want):
    b = one(spark, G.mat_callout(F.lit(text), F.lit(False)))
    assert (b and tuple(b)) == want


@pytest.mark.parametrize(("text", "want"), [("ARM.: 8-20M", ("ARM", 8, "20M", None)), ("LIG.: 3-10M@200 c/c", ("LIG", 3, "10M", 200.0)), ("LIG : 10M @ 7\"", ("LIG", None, "10M", 177.8)), ("H.: 15M @ 300", ("H", None, "15M", 300.0)), ("V : 15M@250 c/c", ("V", None, "15M", 250.0)), ("ARM. & LIG.", None)])
def test_wall_callouts(spark, text, want):
    b = one(spark, G.wall_callout(F.lit(text), F.lit(False)))
    assert (b and tuple(b)) == want


@pytest.mark.parametrize(("title", "kind", "level"), [
    ("Détails typiques colonnes", None, None), ("Plan des colonnes - Niveau 3", "colonne", "NIVEAU 3"), ("ÉLÉVATIONS DES POUTRES RDC", "poutre", "RDC"), ("Murs de refend", "mur_refend", None), ("ARMATURE DU NIV. 4", "dalle", "NIV. 4"), ("COLLECTEURS TOIT APPENTIS", "dalle", "TOIT APPENTIS"),
    ("CONTREVENTEMENT", "mur_refend", None), ("PLAN AGRANDI DES RADIERS", "radier", None), ("Plan des fondations", "semelle", "FONDATIONS"), ("Plan du niveau 2", None, "NIVEAU 2")])
def test_titles(spark, title, kind, level):
    assert (one(spark, pages.kind_of(F.lit(title))), one(spark, pages.level_of(F.lit(title)))) == (kind, level)


def test_sheet_ids(spark):
    words = [("f", 1, "S-600A", 20.0), ("f", 1, "S-201", 9.0), ("f", 2, "S103.a", 20.0), ("f", 3, "AB-123", 20.0), ("f", 3, "X-100", 20.0)]
    t = spark.createDataFrame([(f, p, i, w, 900.0, 640.0, 950.0, 640.0 + h) for i, (f, p, w, h) in enumerate(words)], "fichier string, page int, seq int, text string, x0 double, y0 double, x1 double, y1 double")
    p = spark.createDataFrame([("f", k, 1000.0, 700.0) for k in (1, 2, 3, 4)], "fichier string, page int, width double, height double")
    assert {r["page"]: r["feuillet"] for r in pages.sheet_ids(t, p).collect()} == {1: "S-600A", 2: "S-103.a", 3: "UNKNOWN", 4: "UNKNOWN"}


@pytest.mark.parametrize(("text", "wh"), [('16"x24"', (406.4, 609.6)), ("300x300", (300.0, 300.0)), ("500mmØ", (500.0, 500.0)), ("300 by 300", None)])
def test_dimensions(spark, text, wh):
    d = one(spark, G.dimensions(F.lit(text)))
    assert (d and (round(d["w"], 1), round(d["h"], 1))) == wh


def test_roles_and_cells(spark):
    assert one(spark, G.role(F.lit("semelle"), F.lit("trans."))) == "TRAN"
    assert one(spark, G.role(F.lit("poutre"), F.lit("Étriers"))) == "étriers"
    assert one(spark, G.role(F.lit("dalle"), F.lit(None).cast("string"))) == "INCONNU"
    c = one(spark, G.cell_bars(F.lit("4-25M foo 10M@150"), F.lit(False)))
    assert [(x["quantite"], x["diametre"], x["espacement_mm"]) for x in c] == [(4, "25M", None), (None, "10M", 150.0)]


def test_fold_is_the_same_in_both_worlds(spark):
    for t in ("Rez-de-chaussée", "  NIV  3 ", "étage", "a–b"):
        assert one(spark, fold(F.lit(t))) == py_fold(t)
    for sp in "\u00a0\u2003\u200b\u3000\ufeff\u202f\u0085\t\n":
        assert one(spark, strip_space(F.lit(f"{sp}x y{sp}{sp}"))) == "x y"
    assert one(spark, fold(F.lit("e\u0301tage"))) == "ETAGE"
    assert one(spark, strip_space(F.lit("  x y\t"))) == "x y"
    assert unscramble("ZurÃ¼ck, fÃ»ts") == "Zurück, fûts"


@pytest.mark.parametrize(("text", "name"), [
    ("N1VEAU I3", "NIVEAU 13"), ("ss-2", "SOUS-SOL S2"), ("12e niveau", "NIVEAU 12"), ("Rez-de-ch.", "RDC"), ("FOND.", "FONDATION"), ("TOIT APPENTIS", "APPENTIS"), ("RDC @ 2", "RDC"),
    ("11 @ TOIT", "NIVEAU 11"), ("VOIR COUPE", None), ("", None), (None, None), ("?", None), ("NIVEAU VII", "NIVEAU 7"), ("S0US-SOL S1", "SOUS-SOL S1"), ("x" * 100_000, None)])
def test_storey(text, name):
    assert P.storey(text) == name


@pytest.mark.parametrize(("text", "name"), [("(E-13)", "E-13"), ("8-J", "J-8"), ("AXES 9/H", "H-9"), ("Q - 6", "Q-6"), ("J14", "J-14"), ("a.5–15", "A.5-15"), ("E-l0", "E-10"), ("17-L", "L-17"), ("AXES 2/L", "L-2"), ("L-1", "L-1"), ("UNKNOWN", None), (None, None)])
def test_place(text, name):
    assert P.place(text) == name


def test_issue_and_file_storey():
    assert [P.issue(x) for x in ("d-NIV-6 rev C.pdf", "d-rév.2.pdf", "d_R3.pdf", "d_indB.pdf", "d.pdf", None)] == [3.0, 2.0, 3.0, 2.0, None, None]
    assert P.file_storey("X_00005_atelier_NIV-9_dalle.pdf") == "NIVEAU 9"


def test_unit_census(spark):
    i, m = G.unit_tokens(F.lit("LIG.: 10M@6\" c/c EL.: 157' - 9\""))
    assert (one(spark, i), one(spark, m)) == (2, 0)
    i, m = G.unit_tokens(F.lit("LIG.: 10M@100 c/c COL. 300x300"))
    assert (one(spark, i), one(spark, m)) == (0, 2)
