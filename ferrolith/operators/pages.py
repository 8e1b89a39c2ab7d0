"""Pages from their primitives (tokens, lines, paths): sheet ids, titles, kinds, tiers, files, filters on marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A sheet id (S-502, S502, S-600A, S-103.a); kinds by title, first match first; the first rule means no kind.
SHEET = r"^S-?\d{3}(\.?[A-Za-z])?$"
TITLES = [
    (r"D[ÉE]TAILS? TYPIQUES?", None), (r"PLAN DES COLONNES", "colonne"), (r"[ÉE]L[ÉE]VATIONS? (DES )?POUTRES", "poutre"), (r"CONTREVENTEMENT|MURS? DE REFEND|CISAILLEMENT", "mur_refend"),
    (r"PLAN (AGRANDI )?DES RADIERS|VUE EN PLAN DES RADIERS", "radier"), (r"PLAN DES FONDATIONS", "semelle"), (r"\bARMATURE DU\b|COLLECTEURS", "dalle")]
LEVEL = r"\b(NIVEAU\s*\d+|NIV\.?\s*\d+|RDC|REZ-DE-CHAUSSÉE|SOUS-SOL|SS\d|TOIT(?:\s+APPENTIS)?|TRÉFOND|FONDATION\w*|RADIER|EMPATTEMENT)\b"
TITLE_MARK = r"TITRE DU DESSIN\s+(.*?)(?:N°|$)"
# Why a page without a kind is passed over, by words of its title.
SKIPPED = [
    (r"TYPIQUE", "détails typiques : aucun élément localisable sur la grille"),
    (r"PLAN DU|PLAN DE LA|PLAN DES", "plan général d'aménagement : l'armature des dalles est sur la série S-600, celle des colonnes sur la série S-500")]
NO_KIND = "aucun type d'élément reconnu dans le titre du feuillet"


def kind_of(title: Column) -> Column:
    out = F.lit(None).cast("string")
    for p, k in reversed(TITLES):
        out = F.when(F.upper(title).rlike(p), F.lit(k)).otherwise(out)
    return out


def level_of(title: Column) -> Column:
    return F.regexp_substr(F.upper(title), F.lit(LEVEL))


def skip_reason(title: Column) -> Column:
    """Why a page whose title names no kind is passed over; null for one that has a kind."""
    out = F.lit(NO_KIND)
    for p, why in reversed(SKIPPED):
        out = F.when(F.upper(title).rlike(p), F.lit(why)).otherwise(out)
    return F.when(kind_of(title).isNull(), out)


def stated_title(text: Column) -> Column:
    """What follows the title mark in the title block's text, up to the number's label; all of it without a mark."""
    return F.trim(F.coalesce(F.when(text.rlike(TITLE_MARK), F.regexp_extract(text, TITLE_MARK, 1)), text))


def sheet_ids(tokens: DataFrame, pages: DataFrame) -> DataFrame:
    """fichier, page, feuillet: the largest token of the title block (of the wider corner, if none is there) that reads as a sheet id; S502 becomes S-502; else UNKNOWN."""
    t = tokens.join(pages.select("fichier", "page", "width", "height"), ["fichier", "page"]).filter(F.col("text").rlike(SHEET))
    inner = (F.col("x0") > 0.60 * F.col("width")) & (F.col("y0") > 0.78 * F.col("height"))
    wide = (F.col("x0") > 0.45 * F.col("width")) & (F.col("y0") > 0.70 * F.col("height"))
    rank = F.struct(inner.alias("i"), F.round(F.col("y1") - F.col("y0"), 1).alias("h"), "x0", "y0", "seq")
    best = t.filter(wide).groupBy("fichier", "page").agg(F.max_by("text", rank).alias("t"))
    return pages.join(best, ["fichier", "page"], "left").select("fichier", "page", F.coalesce(F.regexp_replace("t", r"^S(?=\d)", "S-"), F.lit("UNKNOWN")).alias("feuillet"))


def titles(tokens: DataFrame, pages: DataFrame) -> DataFrame:
    """fichier, page, title: tokens of the title block in reading order."""
    t = tokens.join(pages.select("fichier", "page", "width", "height"), ["fichier", "page"]).filter((F.col("x0") > 0.60 * F.col("width")) & (F.col("y0") > 0.78 * F.col("height")))
    return t.groupBy("fichier", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y0", "x0", "seq", "text"))), lambda s: s["text"]), " ").alias("title"))


def tier(words: Column, fills: Column, images: Column) -> Column:
    """How a page can be read: 1 by its text, 2 by its outlines, 3 by its image, 4 not at all."""
    return F.when(words > 20, 1).when(fills > 200, 2).when(images > 0, 3).otherwise(4)


def files(pages: DataFrame) -> DataFrame:
    """fichier, pages, role: a plan where at least two pages, and half of them, bear a sheet id."""
    g = pages.groupBy("fichier").agg(F.count("*").alias("pages"), F.count_if(F.col("feuillet") != "UNKNOWN").alias("ids"))
    return g.select("fichier", "pages", F.when(F.col("ids") >= F.greatest(F.lit(2.0), F.col("pages") / 2), "plan").otherwise("atelier").alias("role"))


def rare(tokens: DataFrame, most: int = 6) -> DataFrame:
    """Tokens whose text isn't on the page more than `most` times."""
    return tokens.withColumn("_n", F.count("*").over(Window.partitionBy("fichier", "page", "text"))).filter(F.col("_n") <= most).drop("_n")


def modal_height(tokens: DataFrame, share: float = 0.25) -> DataFrame:
    """Tokens within a share of the page's most frequent rounded height, the greater on ties."""
    h = F.round(F.col("y1") - F.col("y0"))
    n = tokens.groupBy("fichier", "page", h.alias("h")).agg(F.count("*").alias("c"))
    m = n.groupBy("fichier", "page").agg(F.max_by("h", F.struct("c", "h")).alias("mode"))
    return tokens.join(m, ["fichier", "page"]).filter(F.abs(F.col("y1") - F.col("y0") - F.col("mode")) <= share * F.col("mode")).drop("mode")


def median_height(tokens: DataFrame, lo: float = 0.6, hi: float = 1.6) -> DataFrame:
    h = F.col("y1") - F.col("y0")
    m = tokens.groupBy("fichier", "page").agg(F.median(h).alias("m"))
    return tokens.join(m, ["fichier", "page"]).filter(h.between(lo * F.col("m"), hi * F.col("m"))).drop("m")


def typical_offset(offsets: DataFrame, group: list[str], tolerance: float = 8.0, share: float = 0.7, least: int = 10) -> DataFrame:
    """group, dx, dy: median offsets that at least `share` of at least `least` offsets come within tolerance of."""
    m = offsets.groupBy(*group).agg(F.median("dx").alias("mx"), F.median("dy").alias("my"))
    close = (F.abs(F.col("dx") - F.col("mx")) <= tolerance) & (F.abs(F.col("dy") - F.col("my")) <= tolerance)
    g = offsets.join(m, group).groupBy(*group, "mx", "my").agg(F.count("*").alias("n"), F.avg(close.cast("int")).alias("share"))
    return g.filter((F.col("n") >= least) & (F.col("share") >= share)).select(*group, F.col("mx").alias("dx"), F.col("my").alias("dy"), "n")


def collinear(marks: DataFrame, page: list[str], at: str, tolerance: float = 14.0, least: int = 3, spread: float = 150.0, along: str = "y") -> DataFrame:
    """page, bucket, labels, spread of the fullest bucket of labels on one line (banker's rounding, the last place of a label counts)."""
    b = F.bround(F.col(at) / tolerance).cast("long")
    last = marks.groupBy(*page, b.alias("bucket"), "label").agg(F.max_by(along, "seq").alias("v"))
    g = last.groupBy(*page, "bucket").agg(F.count("*").alias("labels"), (F.max("v") - F.min("v")).alias("spread")).filter((F.col("labels") >= least) & (F.col("spread") >= spread))
    w = Window.partitionBy(*page).orderBy(F.desc("labels"), "bucket")
    return g.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def calibrate(symbols: DataFrame, stated: DataFrame, page: list[str]) -> DataFrame:
    """page, scale, n: median ratio of symbol to stated size over pairs whose aspects agree within 6 %; three pairs at least.

    Symbols and sizes are grouped by a bucket of the logarithm of their aspect, with the neighbouring buckets, before they meet;
    equal ones meet once, with their numbers.
    """
    aspect = lambda a, b: F.greatest(a, b) / F.least(a, b)
    equal = lambda df, w, h, n: df.filter(f"{w} > 0 and {h} > 0").groupBy(*page, w, h).agg(F.count("*").alias(n))
    s = equal(symbols, "w", "h", "_ns").withColumn("a", aspect(F.col("w"), F.col("h"))).withColumn("size", F.greatest("w", "h"))
    d = equal(stated, "w_mm", "h_mm", "_nd").withColumn("want", aspect(F.col("w_mm"), F.col("h_mm"))).withColumn("mm", F.greatest("w_mm", "h_mm"))
    bucket = lambda c: F.floor(F.log(c) / 0.0625).cast("int")
    d = d.withColumn("k", F.explode(F.array(*[bucket(F.col("want")) + i for i in (-1, 0, 1)])))
    x = s.withColumn("k", bucket(F.col("a"))).join(d, [*page, "k"]).filter(F.abs(F.col("a") - F.col("want")) < 0.06 * F.col("want"))
    times = F.col("_ns") * F.col("_nd")
    g = x.groupBy(*page).agg(F.percentile(F.col("size") / F.col("mm"), 0.5, times).alias("m"), F.sum(times).alias("n"))
    return g.filter("n >= 3").select(*page, F.round("m", 6).alias("scale"), "n")


def tiles(width: int, height: int, size: int = 1280, lap: int = 192) -> Column:
    """Array of (x, y): corners of overlapping tiles over an image."""
    step = size - lap
    xs = F.sequence(F.lit(0), F.lit(max(0, width - lap - 1)), F.lit(step))
    ys = F.sequence(F.lit(0), F.lit(max(0, height - lap - 1)), F.lit(step))
    return F.flatten(F.transform(ys, lambda y: F.transform(xs, lambda x: F.struct(x.alias("x"), y.alias("y")))))


def right_of(tokens: DataFrame, labels: DataFrame, page: list[str], dx: float = 60.0, dy: float = 3.0) -> DataFrame:
    """labels (page, pid, x, y) and tokens (page, oid, ox, oy, text): pid, value: texts on the label's row, at most dx to its right, in order."""
    from ferrolith.operators.spatial import within

    x = within(labels, tokens, page, dx + dy).filter((F.col("ox") > F.col("x")) & (F.col("ox") - F.col("x") <= dx) & (F.abs(F.col("oy") - F.col("y")) <= dy))
    v = x.groupBy(*page, "pid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ox", "oid", "text"))), lambda s: s["text"]), " ").alias("value"))
    return labels.select(*page, "pid").join(v, [*page, "pid"], "left")


def sheet_identity(lines: DataFrame, files: DataFrame, page: list[str]) -> DataFrame:
    """lines (page, seq, x, y, text) and files (page, stem, number): the drawing number in the box under its label, else '<stem> p<n>'."""
    label = lines.filter(F.upper(F.trim("text")).isin("DESSIN NO.", "DESSIN NO", "DWG NO."))
    from ferrolith.operators.spatial import within

    below = within(label.select(*page, F.col("seq").alias("pid"), "x", "y"), lines.select(*page, F.col("seq").alias("oid"), F.col("x").alias("ox"), F.col("y").alias("oy"), "text"), page, 50.0)
    ok = (F.col("oid") != F.col("pid")) & (F.col("oy") - F.col("y")).between(0, 29.999) & (F.abs(F.col("ox") - F.col("x")) < 40) & F.trim("text").rlike(r"^[A-Z0-9][A-Z0-9\-_.]{1,15}$") & ~F.trim("text").endswith(".")
    best = below.filter(ok).groupBy(*page).agg(F.min_by(F.trim("text"), F.struct("oy", "oid")).alias("stated"))
    return files.join(best, page, "left").select(*page, F.coalesce("stated", F.concat(F.col("stem"), F.lit(" p"), F.col("number").cast("string"))).alias("feuillet"))


def page_layer(lines: DataFrame, page: list[str]) -> DataFrame:
    """page, layer: of the first line that names one."""
    from ferrolith.functions.places import layer

    return lines.withColumn("_l", layer(F.col("text"))).filter("_l is not null").groupBy(*page).agg(F.min_by("_l", "seq").alias("layer"))


# Kinds by words of a file's name, then of its folder, first match first.
FILE_KINDS = [("RADIER", "radier"), ("SEMELLE|EMPATTEMENT", "semelle")]
FOLDER_KINDS = [("COLONNE", "colonne"), ("POUTRE", "poutre"), ("DALLE", "dalle"), ("MUR|REFEND", "mur_refend"), ("RADIER", "radier"), ("SEMELLE|FONDATION", "semelle")]
UNREADABLE = {2: "page faite de glyphes vectoriels", 3: "page image", 4: "page illisible"}


def file_kind(folder: Column, name: Column) -> Column:
    """Kind of element of a shop file: by its name first, as a folder may hold several, then by its folder."""
    from ferrolith.functions.text import fold

    out = F.lit(None).cast("string")
    for c, rules in ((folder, reversed(FOLDER_KINDS)), (name, reversed(FILE_KINDS))):
        for p, k in rules:
            out = F.when(F.coalesce(fold(c), F.lit("")).rlike(p), F.lit(k)).otherwise(out)
    return out


def inventory(listing: DataFrame) -> DataFrame:
    """listing (folder, name, page, tier) of shop files: folder, name, kind, pages, tiers (in order of pages), by folder and name."""
    g = listing.filter(F.lower("name").endswith(".pdf")).groupBy("folder", "name").agg(F.count("*").alias("pages"), F.transform(F.array_sort(F.collect_list(F.struct("page", "tier"))), lambda s: s["tier"]).alias("tiers"))
    return g.withColumn("kind", file_kind(F.col("folder"), F.col("name")))


def reports(listing: DataFrame, parsed: DataFrame) -> DataFrame:
    """name, page, status, reason of every page of an inventory (name, page, tier, kind): extracted with records in `parsed` (name, page), empty, or unread with the reason."""
    n = parsed.groupBy("name", "page").agg(F.count("*").alias("records"))
    x = listing.join(n, ["name", "page"], "left")
    why = F.when(F.col("kind").isNull(), NO_KIND)
    for t, text in UNREADABLE.items():
        why = why.when(F.col("tier") == t, F.lit(text))
    status = F.when(F.col("records") > 0, "extracted").when(why.isNotNull(), "unread").otherwise("no_callouts")
    return x.select("name", "page", status.alias("status"), F.when(status == "unread", why).alias("reason"), F.coalesce("records", F.lit(0)).alias("records"))


def plan_of(listing: DataFrame, project: str, name: str, prefix: str) -> DataFrame:
    """project, plan: the first file, in order of names, that begins like a plan."""
    return listing.filter(F.upper(name).startswith(prefix)).groupBy(project).agg(F.min(name).alias("plan"))


def configured(listing: DataFrame, wanted: DataFrame) -> DataFrame:
    """kind, name of the inputs that a configuration (kind, pattern, every) names: of each pattern every file that matches, in order of lower-cased names, or the first; a file counts once per kind."""
    x = listing.select("name").distinct().join(wanted, F.expr("name rlike pattern"))
    n = F.row_number().over(Window.partitionBy("kind", "pattern").orderBy(F.lower("name"), "name"))
    return x.withColumn("_n", n).filter("every or _n = 1").select("kind", "name").distinct()
