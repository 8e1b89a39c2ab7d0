"""Queries of the analytics operators over the given tables, and the SQL that states the same.

Tables without drawings are read as such by plain arithmetic on their keys: a line item is a token, a point or a callout, an
event a place along a line. SQL is for DuckDB; where there is none, the query is iterative or a kernel and is held against
brute force in tests/.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferrolith.functions import grammar as G
from ferrolith.functions.text import fold
from ferrolith.operators import compare as C
from ferrolith.operators import dedup, drawing, islands, matching, normalize, pages, report, search, spatial
from ferrolith.sources import records as R
from ferrolith.sources.tables import once
from ferrolith.sources.tables import table as t
from ferrolith.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
_Q: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _Q[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def plan(s: SparkSession, d: str) -> DataFrame:
    return once(t(s, d, "records_plan"), "id")


def shop(s: SparkSession, d: str) -> DataFrame:
    return once(t(s, d, "records_atelier"), "id")


def bars(s: SparkSession, d: str) -> DataFrame:
    return once(t(s, d, "bars"), "bar_id")


def supports(s: SparkSession, d: str) -> DataFrame:
    return once(t(s, d, "supports"), "support_id")


def _once(name: str, key: str) -> str:
    return f"(select * exclude (_n) from (select *, row_number() over (partition by {key} order by loaded_at) _n from {name}) where _n = 1)"


PLAN, SHOP, BARS, SUPPORTS = _once("records_plan", "id"), _once("records_atelier", "id"), _once("bars", "bar_id"), _once("supports", "support_id")
_FOLD = lambda c: rf"trim(regexp_replace(upper(strip_accents({c})), '\s+', ' ', 'g'))"
SIZES = "['10M','15M','20M','25M','30M','35M','45M','55M']"

# ---- scalars and grammars ----

_LENGTH = """case l_linenumber % 3 when 0 then cast(cast(l_quantity as int) as varchar) || ''' - ' || cast(l_partkey % 12 as varchar) || '"' when 1 then cast(1 + l_partkey % 40 as varchar) || ' 1/2"' else cast(l_partkey as varchar) end"""


def _length_text() -> F.Column:
    q = F.col("l_quantity").cast("int").cast("string")
    return F.when(F.col("l_linenumber") % 3 == 0, F.concat(q, F.lit("' - "), (F.col("l_partkey") % 12).cast("string"), F.lit('"'))).when(F.col("l_linenumber") % 3 == 1, F.concat((1 + F.col("l_partkey") % 40).cast("string"), F.lit(' 1/2"'))).otherwise(F.col("l_partkey").cast("string"))


@query("""select l_orderkey, l_linenumber, case l_linenumber % 3 when 0 then round(cast(l_quantity as int) * 304.8::double + (l_partkey % 12) * 25.4::double, 1) when 1 then round((1 + l_partkey % 40) * 25.4::double + 12.7::double, 1) end as mm from lineitem""")
def parse_length(s, d):
    """Imperial lengths in text to mm."""
    return t(s, d, "lineitem").select("l_orderkey", "l_linenumber", G.imperial_length(_length_text()).alias("mm"))


@query(rf"""with b as (select bar_id, bar_id % 2 = 0 as imp, nullif(regexp_extract(raw, '@\s*(\d+(?:\s+\d+/\d+)?)\s*("|mm)?', 1), '') as v, nullif(regexp_extract(raw, '@\s*(\d+(?:\s+\d+/\d+)?)\s*("|mm)?', 2), '') as u from {BARS} where raw is not null)
select bar_id, case when v is null then null when u = '"' or (u is null and imp) then round(v::double * 25.4::double, 1) else v::double end as spacing from b""")
def parse_spacing(s, d):
    """Spacing after '@', by suffix or by the drawing's system."""
    return bars(s, d).filter("raw is not null").select("bar_id", G.spacing(F.col("raw"), F.col("bar_id") % 2 == 0).alias("spacing"))


@query("""select p_partkey, case p_partkey % 4 when 0 then round((p_size % 30 + 1) * 25.4::double, 2) when 1 then (300 + p_size)::double when 2 then (400 + p_size)::double end as w, case p_partkey % 4 when 0 then round((p_size % 20 + 1.5::double) * 25.4::double, 2) when 1 then (500 + p_size)::double when 2 then (400 + p_size)::double end as h from part""")
def section_dimensions(s, d):
    """Stated section sizes."""
    p = t(s, d, "part")
    st = lambda c: c.cast("string")
    k = F.col("p_partkey") % 4
    text = F.when(k == 0, F.concat(st(F.col("p_size") % 30 + 1), F.lit('"x'), st(F.col("p_size") % 20 + 1), F.lit(' 1/2"'))).when(k == 1, F.concat(st(300 + F.col("p_size")), F.lit("x"), st(500 + F.col("p_size")))).when(k == 2, F.concat(st(400 + F.col("p_size")), F.lit("mmØ"))).otherwise(F.lit("voir plan"))
    return p.select("p_partkey", G.dimensions(text).alias("x")).select("p_partkey", F.round("x.w", 2).alias("w"), F.round("x.h", 2).alias("h"))


@query(f"""select l_orderkey, l_linenumber, case when l_linenumber % 2 = 0 then 'VERT' end as label, cast(l_quantity as int) as quantite, {SIZES}[1 + l_partkey % 8] as diametre, case l_suppkey % 3 when 1 then 'A' || (l_partkey % 90 + 10) end as repere, case when l_suppkey % 3 = 2 then round((4 + l_orderkey % 9) * 25.4::double, 1) end as espacement_mm, case when l_suppkey % 3 = 0 then round(((5 + l_partkey % 20) * 12 + 6) * 25.4::double, 1) end as longueur_mm from lineitem""")
def bar_grammar(s, d):
    """Bar lines written and read back, with a reader's noise."""
    li = t(s, d, "lineitem")
    st = lambda c: c.cast("string")
    size = F.element_at(F.array(*map(F.lit, G.DESIGNATORS)), (1 + F.col("l_partkey") % 8).cast("int"))
    k = F.col("l_suppkey") % 3
    tail = F.when(k == 1, F.concat(F.lit(" A"), st(F.col("l_partkey") % 90 + 10))).when(k == 2, F.concat(F.lit(" @"), st(4 + F.col("l_orderkey") % 9), F.lit('"'))).otherwise(F.concat(F.lit(" "), st(5 + F.col("l_partkey") % 20), F.lit("-06")))
    text = F.concat(F.when(F.col("l_linenumber") % 2 == 0, F.lit("VERT: :")).otherwise(F.lit("-")), st(F.col("l_quantity").cast("int")), F.lit(" "), size, tail)
    # the struct is a column of its own first, else each of its fields would parse the text again
    return li.select("l_orderkey", "l_linenumber", G.bar_line(text, F.lit(True)).alias("b")).select("l_orderkey", "l_linenumber", *[f"b.{c}" for c in ("label", "quantite", "diametre", "repere", "espacement_mm", "longueur_mm")])


@query(f"""with b as (select l_orderkey, l_linenumber, l_linenumber % 4 as f, cast(l_quantity as int) as q, {SIZES}[1 + l_partkey % 8] as z, l_orderkey % 9 as o from lineitem)
select l_orderkey, l_linenumber, 'slab' as kind, null as role, q as quantite, case when f = 0 then '15M' else z end as diametre, null::double as spacing from b
union all select l_orderkey, l_linenumber, 'beam', case f when 0 then 'lit ' || (1 + o % 3) when 1 then 'peau' when 2 then 'étriers' else 'lit ' || (2 + o % 2) end, case when f <> 1 then q end, z, case when f = 1 then (100 + o)::double end from b
union all select l_orderkey, l_linenumber, 'mat', case f when 0 then (1 + o % 3) || ' & ' || (2 + o % 3) when 1 then '2' when 2 then (2 + o % 3) || ' lits' end, case when f = 3 then q end, z, case when f = 3 then null when f = 1 then round((6 + o) * 25.4::double, 1) else (200 + o)::double end from b
union all select l_orderkey, l_linenumber, 'wall', case f when 0 then 'ARM' when 1 then 'LIG' when 2 then 'H' else 'LIG' end, case when f in (0, 1) then q end, z, case when f = 0 then null else (150 + o)::double end from b""")
def plan_callouts(s, d):
    """Callouts of slabs, beams, mats and walls in all forms in which they're written."""
    st = lambda c: c.cast("string")
    z = F.element_at(F.array(*map(F.lit, G.DESIGNATORS)), (1 + F.col("l_partkey") % 8).cast("int"))
    q, f, o = st(F.col("l_quantity").cast("int")), F.col("l_linenumber") % 4, F.col("l_orderkey") % 9
    form = lambda *parts: F.when(f == 0, F.concat(*parts[0])).when(f == 1, F.concat(*parts[1])).when(f == 2, F.concat(*parts[2])).otherwise(F.concat(*parts[3]))
    L = F.lit
    slab = form([q, L("("), st(o), L(")")], [q, L(" ("), st(o), L(") - "), z], [q, L("("), st(o), L("-"), z, L(")")], [q, L(" - "), z, L(" LG 3000")])
    beam = form([L("LIT "), st(1 + o % 3), L(": "), q, L("-"), z], [L("ARM. DE PEAU "), z, L("@"), st(100 + o)], [q, L(" ETRIERS "), z], [st(2 + o % 2), L("e lit "), q, L(" - "), z])
    mat = form([L("RANG "), st(1 + o % 3), L(" & "), st(2 + o % 3), L(": "), z, L(" @"), st(200 + o), L(" mm")], [L("2E RANG "), z, L(" @ "), st(6 + o), L('"')], [st(2 + o % 3), L(" RANGS DE "), z, L(" @ "), st(200 + o)], [q, L("-"), z, L(" E.F.")])
    wall = form([L("ARM.: "), q, L("-"), z], [L("LIG.: "), q, L("-"), z, L("@"), st(150 + o), L(" c/c")], [L("H.: "), z, L(" @ "), st(150 + o)], [L("LIG.: "), z, L("@"), st(150 + o)])
    li = t(s, d, "lineitem").select("l_orderkey", "l_linenumber", G.slab_callout(slab, F.lit("15M")).alias("slab"), G.beam_callout(beam, F.lit(False)).alias("beam"), G.mat_callout(mat, F.lit(False)).alias("mat"), G.wall_callout(wall, F.lit(False)).alias("wall"))
    none = F.lit(None)
    row = lambda k, r, c, sp: F.struct(F.lit(k).alias("kind"), r.cast("string").alias("role"), F.col(k)["quantite"].alias("quantite"), F.col(k)["diametre"].alias("diametre"), sp.cast("double").alias("spacing"))
    sp = lambda k: F.col(k)["espacement_mm"]
    x = F.explode(F.array(row("slab", none, 0, none), row("beam", F.col("beam")["role"], 0, sp("beam")), row("mat", F.col("mat")["rang"], 0, sp("mat")), row("wall", F.col("wall")["role"], 0, sp("wall"))))
    return li.select("l_orderkey", "l_linenumber", x.alias("x")).select("l_orderkey", "l_linenumber", "x.*")


@query("""select l_orderkey, l_linenumber, 2 as n, cast(l_quantity as int) as quantite, (100 + l_partkey % 50)::double as spacing from lineitem""")
def schedule_cells(s, d):
    """Bars and ties of a schedule cell."""
    text = F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("-20M x "), F.lit("10M@"), (100 + F.col("l_partkey") % 50).cast("string"))
    return t(s, d, "lineitem").select("l_orderkey", "l_linenumber", G.cell_bars(text, F.lit(False)).alias("c")).select("l_orderkey", "l_linenumber", F.size("c").alias("n"), F.col("c")[0]["quantite"].alias("quantite"), F.col("c")[1]["espacement_mm"].alias("spacing"))


_LEVEL = rf"""case when t in ('FONDATION','FONDATIONS') or (t = '' and type_element = 'semelle') then 'FONDATION' when t in ('REZ-DE-CHAUSSEE','RDC','NIVEAU RDC','NIV RDC') then 'RDC' when starts_with(t, 'NIVEAU') then t else regexp_replace(t, '^NIV\.?\s*', 'NIVEAU ') end"""


@query(f"""select type_element, {_LEVEL} as level, count(*) as n from (select type_element, {_FOLD("coalesce(debug.niveau, '')")} as t from {PLAN} union all select type_element, {_FOLD("coalesce(debug.niveau, '')")} from {SHOP}) group by all""")
def level_normalize(s, d):
    """Storeys in the comparison's spelling, counted."""
    r = plan(s, d).select("type_element", "debug").unionByName(shop(s, d).select("type_element", "debug"))
    return r.groupBy("type_element", G.level_key(F.col("debug.niveau"), F.col("type_element")).alias("level")).agg(F.count("*").alias("n"))


@query(f"""select label, case when starts_with(n, 'NIVEAU') then split_part(n, ' ', -1) when starts_with(n, 'REZ') or n = 'RDC' then 'RDC' when starts_with(n, 'SOUS-SOL') then split_part(n, ' ', 2) when contains(n, 'APPENTIS') then 'APPENTIS' when starts_with(n, 'TOIT') then 'TOIT' else n end as short from (select label, upper(label) as n from ref_values where field = 'niveau')""")
def short_levels(s, d):
    """Storeys as an answer key writes them."""
    return t(s, d, "ref_values").filter("field = 'niveau'").select("label", G.short_level(F.col("label")).alias("short"))


@query(rf"""with r as (select type_element as k, regexp_replace({_FOLD("coalesce(unnest(debug.roles), '')")}, '^[ .:_-]+|[ .:_-]+$', '', 'g') as v from {SHOP} where type_element in ('radier','poutre','semelle','dalle'))
select k as kind, case when k = 'radier' then (case when v in ('HORIZONTAL','HORIZONTALE') then 'horizontal' when v in ('VERTICAL','VERTICALE') then 'vertical' else 'INCONNU' end) when k = 'poutre' then (case when v in ('LONG','LONGITUDINALE') then 'longitudinale' when v in ('PEAU','SKIN') then 'peau' when v in ('ETRI','ETRIER','ETRIERS') then 'étriers' else 'INCONNU' end)
when k = 'semelle' then (case when v in ('LONG','LONGITUDINALE','LONGITUDINAL') then 'LONG' when v in ('TRAN','TRANS','TRANSVERSALE','TRANSVERSAL') then 'TRAN' else 'INCONNU' end) else (case when v in ('NUM','ALP') then v else 'INCONNU' end) end as role, count(*) as n from r group by all""")
def role_normalize(s, d):
    """Roles by kind, counted."""
    r = shop(s, d).filter(F.col("type_element").isin("radier", "poutre", "semelle", "dalle")).select(F.col("type_element").alias("kind"), F.explode("debug.roles").alias("v"))
    return r.groupBy("kind", G.role(F.col("kind"), F.col("v")).alias("role")).agg(F.count("*").alias("n"))


_KEY = rf"""replace(replace(regexp_replace(regexp_replace({_FOLD("replace(replace(coalesce(element, ''), '–', '-'), '—', '-')")}, '\s', '', 'g') || '|', '(\d)\.0(-|\|)', '\1\2', 'g'), '|', ''), '~', '')"""


@query(rf"""with r as (select id, {_KEY} as place from {PLAN}) select id, place, case when regexp_full_match(place, '[A-Z](\.\d+)?-\d+(\.\d+)?') then ascii(place) - 65 + coalesce(try_cast('0' || nullif(regexp_extract(place, '^[A-Z](\.\d+)?-', 1), '') as double), 0) end as letter, try_cast(nullif(regexp_extract(place, '^[A-Z](?:\.\d+)?-(\d+(?:\.\d+)?)$', 1), '') as double) as number from r""")
def coordinate_position(s, d):
    """Places canonical and as numbers."""
    k = G.coordinate_key(F.col("element"))
    return plan(s, d).select("id", k.alias("place")).select("id", "place", G.grid_letter(F.col("place")).cast("double").alias("letter"), G.grid_number(F.col("place")).alias("number"))


@query(f"""select bar_id, case when quantite is null then '' else quantite || '-' end || coalesce(diametre, '?') || coalesce(' @' || format('{{:g}}', espacement_mm) || ' mm', '') as text, replace(replace(replace(coalesce(nullif(raw, ''), '—'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') as html from {BARS}""")
def formatting(s, d):
    """Bars as text, spacings as '%g' writes them, text for HTML."""
    b, sp = bars(s, d), F.col("espacement_mm")
    head = F.concat(F.when(F.col("quantite").isNotNull(), F.concat(F.col("quantite").cast("string"), F.lit("-"))).otherwise(""), F.coalesce("diametre", F.lit("?")))
    text = F.concat_ws(" ", head, F.when(sp.isNotNull(), F.concat(F.lit("@"), G.general(sp), F.lit(" mm"))))
    return b.select("bar_id", text.alias("text"), G.escaped(F.col("raw")).alias("html"))


@query("""select doc_id, sha256(text) as digest from documents where text is not null""")
def content_digest(s, d):
    """Digest of contents."""
    return t(s, d, "documents").filter("text is not null").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))


@query(f"""select project, sum(i)::bigint as imperial_tokens, sum(m)::bigint as metric_tokens, case when sum(i) > sum(m) then 'imperial' else 'metric' end as unit_system from (select project, len(regexp_extract_all(raw, '@\\s?\\d{{1,2}}"')) + len(regexp_extract_all(raw, '\\d+''\\s*-')) as i, len(regexp_extract_all(raw, '@\\s?\\d{{2,3}}\\b')) + len(regexp_extract_all(raw, '\\b\\d{{3}}x\\d{{3}}\\b')) as m from {BARS} where raw is not null) group by project""")
def unit_census(s, d):
    """Unit system of a project by its tokens."""
    i, m = G.unit_tokens(F.col("raw"))
    g = bars(s, d).filter("raw is not null").groupBy("project").agg(F.sum(i).alias("imperial_tokens"), F.sum(m).alias("metric_tokens"))
    return g.withColumn("unit_system", F.when(F.col("imperial_tokens") > F.col("metric_tokens"), "imperial").otherwise("metric"))


# ---- records ----


@query(f"""select coalesce(diametre is null or diametre in {tuple(G.DESIGNATORS)}, false) as valid, count(*) as n from {BARS} group by 1""")
def validate_quarantine(s, d):
    """Rows inside and outside the closed vocabulary."""
    ok = F.coalesce(F.col("diametre").isNull() | F.col("diametre").isin(*G.DESIGNATORS), F.lit(False))
    return bars(s, d).groupBy(ok.alias("valid")).agg(F.count("*").alias("n"))


@query(f"""select source, count(*) as n from (select source from {PLAN} where page is not null and x is not null and not list_contains([true], len(list_filter(coalesce(armature, []), lambda b: b.diametre is not null and b.diametre not in {tuple(G.DESIGNATORS)})) > 0)) group by 1""")
def contract_valid(s, d):
    """Records that keep the contract."""
    good, _ = R.split(plan(s, d))
    return good.groupBy("source").agg(F.count("*").alias("n"))


@query(f"""with b as (select id, p - 1 as pos, unnest.diametre as dm, unnest.quantite as q, unnest.espacement_mm as sp, debug.roles[p] as r, debug.role as r1 from (select id, debug, unnest(armature) as unnest, unnest(range(1, len(armature) + 1)) as p from {SHOP} where type_element = 'colonne')),
c as (select *, upper(coalesce(nullif(coalesce(r, r1), ''), case when sp is not null then 'ETRI' else 'VERT' end)) as w from b), e as (select *, case when starts_with(replace(w, 'É', 'E'), 'ETRI') then 'ETRI' else w end as role from c),
g as (select id, role, dm, case when count(*) = count(q) then sum(q)::int end as q, null::double as sp, min(pos) as f from e where role = 'VERT' and sp is null group by 1, 2, 3 union all select id, role, dm, null, sp, min(pos) from e where role = 'ETRI' and sp is not null group by 1, 2, 3, 5)
select id, row_number() over (partition by id order by role desc, f)::int as entry, role, dm as diametre, q as quantite, sp as espacement_mm from g""")
def column_primary_spec(s, d):
    """A3: primary specification of columns."""
    return normalize.column_specs(shop(s, d))


@query(f"""with r as (select source, fichier, feuillet, page, debug.niveau as niveau, element, debug.view as view, case when element = 'UNKNOWN' then id else '' end as alone, seq, x, y, armature, debug.roles as roles, debug.confidence as c from {SHOP} where type_element = 'poutre'),
e as (select source, fichier, feuillet, page, niveau, element, view, alone, x, y, armature, roles, min(seq) as seq, count(*) as times, min(c) as c from r group by all)
select source, fichier, feuillet, page, niveau, element, view, alone, sum(times)::bigint as records, sum(coalesce(len(armature), 0))::bigint as bars, min(c) as confidence, arg_min(x, seq) as x, arg_min(y, seq) as y from e group by all""")
def beam_regroup(s, d):
    """A2, A10: beams put together from repeated and split observations."""
    return normalize.beams(shop(s, d))


_ROLES = rf"""b as (select id, kind, pos, diametre, quantite, espacement_mm, longueur_mm, layer_, regexp_replace({_FOLD("coalesce(label, '')")}, '^[ .:_-]+|[ .:_-]+$', '', 'g') as v from (select id, type_element as kind, p - 1 as pos, a.diametre as diametre, a.quantite as quantite, a.espacement_mm as espacement_mm, a.longueur_mm as longueur_mm, {_FOLD("coalesce(debug.layer, debug.reinforcement_kind)")} as layer_,
case when type_element = 'radier' then debug.direction else coalesce(debug.roles[p], debug.role, case when type_element = 'semelle' and n = 2 then (case p when 1 then 'LONG' else 'TRAN' end) end) end as label from (select *, len(armature) as n, unnest(armature) as a, unnest(range(1, len(armature) + 1)) as p from {SHOP} where type_element in ('radier', 'poutre', 'semelle', 'dalle')))),
r as (select *, case when kind = 'radier' then (case when v in ('HORIZONTAL','HORIZONTALE') then 'horizontal' when v in ('VERTICAL','VERTICALE') then 'vertical' else 'INCONNU' end) when kind = 'poutre' then (case when v in ('LONG','LONGITUDINALE') then 'longitudinale' when v in ('PEAU','SKIN') then 'peau' when v in ('ETRI','ETRIER','ETRIERS') then 'étriers' else 'INCONNU' end)
when kind = 'semelle' then (case when v in ('LONG','LONGITUDINALE','LONGITUDINAL') then 'LONG' when v in ('TRAN','TRANS','TRANSVERSALE','TRANSVERSAL') then 'TRAN' else 'INCONNU' end) else (case when v in ('NUM','ALP') then v else 'INCONNU' end) end as role from b)"""


@query(f"""with {_ROLES} select id, kind, row_number() over (partition by id order by coalesce(list_position(['LONG', 'TRAN', 'NUM', 'ALP', 'longitudinale', 'peau', 'étriers', 'horizontal', 'vertical'], role), 99), pos)::int as entry, role, diametre, case when espacement_mm is not null and (kind = 'radier' or (kind = 'poutre' and role in ('peau', 'étriers'))) then null else quantite end as quantite, espacement_mm, longueur_mm from r""")
def shared_roles(s, d):
    """Bars of the shared kinds in their order."""
    return normalize.shared_bars(shop(s, d))


@query(f"""with {_ROLES}, h as (select id, kind, any_value(layer_) as l, bool_or(role = 'LONG') as a, bool_or(role = 'TRAN') as b, bool_or(role = 'NUM') as c, bool_or(role = 'ALP') as d from r group by 1, 2)
select * from (select id, kind, case when kind = 'semelle' then concat_ws(',', case when not a then 'LONG' end, case when not b then 'TRAN' end) when kind = 'dalle' and l = 'INTEGRITE' then concat_ws(',', case when not d then 'ALP' end, case when not c then 'NUM' end) end as missing from h) where missing <> ''""")
def missing_role(s, d):
    """Roles that are missing."""
    return normalize.missing_roles(shop(s, d))


@query(f"""select feuillet, id, case when n = 1 then feuillet else feuillet || '#' || n end as uid from (select feuillet, id, row_number() over (partition by feuillet order by page, y, x, seq, id) as n from {PLAN})""")
def unique_ids(s, d):
    """Ids made unique in order."""
    return dedup.unique_ids(plan(s, d), "feuillet", ["page", "y", "x", "seq", "id"]).select("feuillet", "id", "uid")


@query(f"""select id, diametre, sum(coalesce(quantite, 0))::bigint as quantite from (select id, unnest(armature, recursive := true) from {PLAN}) group by all""")
def per_diameter(s, d):
    """A4: totals per diameter."""
    return plan(s, d).select("id", F.explode("armature").alias("b")).groupBy("id", F.col("b.diametre").alias("diametre")).agg(F.sum(F.coalesce("b.quantite", F.lit(0))).alias("quantite"))


@query(f"""select count(distinct (fichier, page)) as pages, count(*) as records, count(*) filter (element <> 'UNKNOWN') as located, round(avg(debug.confidence), 3) as confidence from {PLAN}""")
def project_totals(s, d):
    """Totals of a project."""
    r = plan(s, d)
    return report.totals(r.select("fichier", "page", F.lit("extracted").alias("status")), r).select("pages", "records", "located", "confidence")


@query(f"""select id, source, fichier, feuillet, page, format('{{:.1f}}', x)::double as x, format('{{:.1f}}', y)::double as y, type_element, element, to_json(armature)::varchar as armature from {PLAN}""")
def record_contract(s, d):
    """K1, O1: the ten fields of every record, places to a tenth."""
    return report.contract(plan(s, d)).drop("seq").withColumn("armature", F.to_json("armature", {"ignoreNullFields": "false"}))


# ---- comparison ----


def _keys(records: DataFrame, is_plan: bool) -> DataFrame:
    return C.observations(records, is_plan)


_SAID = _FOLD("coalesce(debug.layer, '')")
_DIRECTION = rf"regexp_replace({_FOLD("coalesce(debug.direction, '')")}, '^[ .:_-]+|[ .:_-]+$', '', 'g')"
_LAYER = rf"""case type_element when 'dalle' then (case when coalesce(nullif({_SAID}, ''), {_FOLD("debug.reinforcement_kind")}) in ('INTEGRITE', 'HAUT', 'BAS') then coalesce(nullif({_SAID}, ''), {_FOLD("debug.reinforcement_kind")}) else 'INCONNU' end)
when 'radier' then coalesce(nullif(trim(regexp_replace({_SAID}, '^RANGS?\s*', ''), ' :'), ''), 'INCONNU') || ' · ' || (case when {_DIRECTION} in ('HORIZONTAL', 'HORIZONTALE') then 'HORIZONTAL' when {_DIRECTION} in ('VERTICAL', 'VERTICALE') then 'VERTICAL' else 'INCONNU' end) else {_SAID} end"""
_LOT = "coalesce(regexp_extract(fichier, '(?:^|[^0-9])([0-9]{5})(?:[^0-9]|$)', 1), '')"
_K = "project, lot, kind, level, layer, place"
_SIDE = lambda src, where: rf"""(select {_FOLD("coalesce(project, '')")} as project, {_LOT} as lot, type_element as kind, case when type_element = 'radier' and {_LEVEL} = '' then 'FONDATION' else {_LEVEL} end as level, {_LAYER} as layer, {_KEY} as place, armature from (select *, {_FOLD("coalesce(debug.niveau, '')")} as t from {src}) {where})"""
_INTEGRITY = "where type_element <> 'dalle' or coalesce(debug.reinforcement_kind, '') = 'integrity'"
_SIDES = f"p as {_SIDE(PLAN, _INTEGRITY)}, s as {_SIDE(SHOP, '')}"


_COUNTS = f"""u as (select {_K}, a, 1 as l, 0 as r from (select {_K}, unnest(armature) as a from p) union all select {_K}, a, 0, 1 from (select {_K}, unnest(armature) as a from s)),
g as (select {_K}, a.diametre as dm, a.quantite as q, round(a.espacement_mm) as sp, sum(l) as l, sum(r) as r from u group by all),
x as (select {_K}, sum(greatest(l - r, 0))::bigint as plan_only, sum(greatest(r - l, 0))::bigint as atelier_only from g group by all having sum(greatest(l - r, 0)) + sum(greatest(r - l, 0)) > 0),
both_ as (select {_K} from p intersect select {_K} from s)"""


@query(f"with {_SIDES}, {_COUNTS} select x.* from x join both_ using ({_K})")
def exact_compare(s, d):
    """Elements under the same key, of one project and lot, whose bars differ as multisets (all observations)."""
    a = normalize.keyed(plan(s, d)).filter("kind != 'dalle' or coalesce(debug.reinforcement_kind, '') = 'integrity'")
    b = normalize.keyed(shop(s, d))
    side = lambda df, n: df.select(*C.KEY, F.explode_outer("armature").alias("b"), F.lit(n).alias("l"), F.lit(1 - n).alias("r"))
    # both sides' counts meet by one aggregation instead of joins; a key's bars are counted before they're put together
    u = side(a, 1).unionByName(side(b, 0)).groupBy(*C.KEY, "b.diametre", "b.quantite", F.round("b.espacement_mm").alias("sp"), F.col("b").isNull().alias("none")).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    l, r = F.col("l"), F.col("r")  # noqa: E741
    more = lambda x, y: F.sum(F.when(~F.col("none"), F.greatest(x - y, F.lit(0))).otherwise(0))
    g = u.groupBy(*C.KEY).agg(more(l, r).alias("plan_only"), more(r, l).alias("atelier_only"), F.max(l > 0).alias("p"), F.max(r > 0).alias("s"))
    return g.filter("p and s and plan_only + atelier_only > 0").drop("p", "s")


@query(f"""with {_SIDES} select {_K}, 'plan' as side from (select {_K} from p except select {_K} from s) union all select {_K}, 'atelier' from (select {_K} from s except select {_K} from p)""")
def coverage_one_sided(s, d):
    """Keys of one side only."""
    return C.one_sided(_keys(plan(s, d), True), _keys(shop(s, d), False))


_AT = r"""k as (select {k} from p union select {k} from s), v as (select *, ascii(place) - 65 + coalesce(try_cast('0' || nullif(regexp_extract(place, '^[A-Z](\.\d+)?-', 1), '') as double), 0) as l, regexp_extract(place, '-(\d+(\.\d+)?)$', 1)::double as n from k where regexp_full_match(place, '[A-Z](\.\d+)?-\d+(\.\d+)?')),
ll as (select project, lot, letter, dense_rank() over (partition by project, lot order by letter) - 1 as lp from (select distinct project, lot, floor(l) as letter from v)), nn as (select project, lot, n, dense_rank() over (partition by project, lot order by n) - 1 as np from (select distinct project, lot, n from v))""".replace("{k}", _K)


@query(f"""with {_SIDES}, {_AT} select project, lot, 'letter' as axis, letter::double as v, lp::int as step from ll union all select project, lot, 'number', n, np::int from nn""")
def grid_steps(s, d):
    """Printed positions of each lot's grid."""
    keys = _keys(plan(s, d), True).select(*C.SITE, "place").unionByName(_keys(shop(s, d), False).select(*C.SITE, "place"))
    a, b = C.steps(keys)
    return a.select(*C.SITE, F.lit("letter").alias("axis"), F.col("letter").cast("double").alias("v"), F.col("lp").alias("step")).unionByName(b.select(*C.SITE, F.lit("number").alias("axis"), F.col("number").alias("v"), F.col("np").alias("step")))


@query(f"""with {_SIDES}, {_AT}, w as (select v.*, lp, np, case when kind = 'dalle' and contains(layer, 'INCONNU') then 'HAUT+BAS' else layer end as scope from v join ll on v.project = ll.project and v.lot = ll.lot and floor(l) = letter join nn on v.project = nn.project and v.lot = nn.lot and v.n = nn.n),
la as (select {_K} from p except select {_K} from s), lb as (select {_K} from s except select {_K} from p), a as (select w.* from w join la using ({_K})), b as (select w.* from w join lb using ({_K})),
c as (select a.project, a.lot, a.kind, a.level, a.scope, a.layer as p_layer, a.place as p_place, b.layer as s_layer, b.place as s_place, abs(a.l - b.l) + abs(a.n - b.n) as distance, case when abs(a.l - b.l) < 1 and abs(a.n - b.n) < 1 then 1 when a.lp = b.lp then abs(a.np - b.np) else abs(a.lp - b.lp) end as stage
from a join b on a.project = b.project and a.lot = b.lot and a.kind = b.kind and a.level = b.level and a.scope = b.scope and ((a.lp = b.lp and abs(a.np - b.np) between 1 and 4) or (a.n = b.n and abs(a.lp - b.lp) between 1 and 4) or (abs(a.l - b.l) < 1 and abs(a.n - b.n) < 1)))
select * replace (round(distance, 6) as distance, stage::int as stage) from c""")
def neighbor_candidates(s, d):
    """Candidates of lone keys within four printed positions of their lot's grid."""
    a, b = _keys(plan(s, d), True).select(*C.KEY).distinct(), _keys(shop(s, d), False).select(*C.KEY).distinct()
    return C.neighbours(a.join(b, C.KEY, "left_anti"), b.join(a, C.KEY, "left_anti"), a.unionByName(b).distinct()).withColumn("distance", F.round("distance", 6))


@query(None)
def compare_full(s, d):
    """The comparison, all passes."""
    c = C.compare(plan(s, d), shop(s, d))
    return c.select(*C.SITE, "kind", "level", "layer", "plan_element", "atelier_element", "coordinate_match", "matched", F.size("missing").alias("missing"), F.size("extra").alias("extra"))


@query(None)
def bar_match(s, d):
    """Bars of both sides under the same key, one to one."""
    a, b = C.groups(plan(s, d), True).select(*C.KEY, F.col("bars").alias("a")), C.groups(shop(s, d), False).select(*C.KEY, F.col("bars").alias("b"))
    m = matching.match_bars(a.join(b, C.KEY), C.KEY)
    return m.select(*C.KEY, "matched", F.size("missing").alias("missing"), F.size("extra").alias("extra"), "identical")


@query(f"""with {_SIDES}, {_COUNTS}, n as (select kind, count(*) as compared from both_ group by 1), m as (select kind, count(*) as differ from x join both_ using ({_K}) group by 1) select kind, compared, coalesce(differ, 0) as differ, round_even(100.0 * coalesce(differ, 0) / compared, 0)::double as percent from n left join m using (kind)""")
def compared_share(s, d):
    """Elements compared and differing per kind."""
    a, b = _keys(plan(s, d), True).select(*C.KEY).distinct(), _keys(shop(s, d), False).select(*C.KEY).distinct()
    n = a.join(b, C.KEY).groupBy("kind").agg(F.count("*").alias("compared"))
    x = exact_compare(s, d).groupBy("kind").agg(F.count("*").alias("differ"))
    return n.join(x, "kind", "left").select("kind", "compared", F.coalesce("differ", F.lit(0)).alias("differ"), F.bround(100 * F.coalesce("differ", F.lit(0)) / F.col("compared")).alias("percent"))


@query(f"""with k as (select seq as row, feuillet, element, armature[1].quantite as q, armature[1].diametre as dm from {PLAN} where armature[1].quantite is not null and armature[1].diametre is not null)
select k.row, count(r.id) as candidates, coalesce(bool_or(k.row % 2 = 0 and len(list_filter(r.armature, lambda b: b.quantite = k.q and b.diametre = k.dm)) > 0), false) as found from k left join {PLAN} r on r.feuillet = k.feuillet and r.element = k.element group by 1""")
def answer_key(s, d):
    """Values of an answer key, one of every record, among the records of their sheet and place."""
    p = plan(s, d)
    return _answers(p, p)


def _answers(asked: DataFrame, p: DataFrame) -> DataFrame:
    b = F.try_element_at("armature", F.lit(1))
    k = asked.filter(b["quantite"].isNotNull() & b["diametre"].isNotNull())
    v = F.when(F.col("seq") % 2 == 0, F.concat_ws("-", b["quantite"].cast("string"), b["diametre"])).otherwise("999-10M")
    return report.check_key(k.select(F.col("seq").alias("row"), "feuillet", F.col("element").alias("localisation"), v.alias("value")), p, False).select("row", "candidates", "found")


# ---- deduplication and grouping ----

_BARKEY = "list_sort(list_transform(coalesce(bars, []), lambda b: {l: coalesce(b.label, ''), q: coalesce(b.quantite, -1), d: coalesce(b.diametre, ''), m: coalesce(b.longueur_mm, -1), r: coalesce(b.repere, '')}))"


@query(f"""with s as (select *, {_BARKEY} as sign from {SUPPORTS}), n as (select *, row_number() over (partition by project, coordinate, level, layer, sign order by confidence desc nulls last, support_id) as k, count(*) over (partition by project, coordinate, level, layer, sign) - 1 as removed from s), f as (select * from n where k = 1), m as (select project, coordinate, level, layer, count(*) as v from f group by all)
select f.support_id, f.removed, m.v > 1 as duplicate_conflict from f join m on f.project is not distinct from m.project and f.coordinate is not distinct from m.coordinate and f.level is not distinct from m.level and f.layer is not distinct from m.layer""")
def signature_dedup(s, d):
    """One row per identity and signature, conflicts marked."""
    x = supports(s, d)
    none = F.array().cast(x.schema["bars"].dataType)
    sign = dedup.signature(F.coalesce("bars", none), ["label", "quantite", "diametre", "longueur_mm", "repere"])
    return dedup.deduplicate(x.withColumn("sign", sign), ["project", "coordinate", "level", "layer"], "sign", [F.col("confidence")], "support_id").select("support_id", "removed", "duplicate_conflict")


@query(f"""select support_id, view from {SUPPORTS} where view = 'V2' and (project, coordinate) not in (select (project, coordinate) from {SUPPORTS} where view = 'main' and project is not null and coordinate is not null)""")
def supersede(s, d):
    """rows of a supplement whose place the main view has are dropped."""
    x = supports(s, d)
    return dedup.superseded(x.filter("view = 'V2'"), x.filter("view = 'main'"), ["project", "coordinate"])[0].select("support_id", "view")


@query(f"""select repere, min(diametre) as diametre, count(*) as n from {BARS} where repere is not null and diametre is not null group by 1 having count(distinct diametre) = 1""")
def catalog_conflicts(s, d):
    """Marks defined alike everywhere; conflicting ones are withheld."""
    g = bars(s, d).filter("repere is not null and diametre is not null").groupBy("repere").agg(F.min("diametre").alias("diametre"), F.max("diametre").alias("hi"), F.count("*").alias("n"))
    return g.filter("diametre = hi").drop("hi")


@query("""select l_orderkey, l_linenumber, p_brand, p_size from lineitem left join part on p_partkey = l_partkey and p_size > 10""")
def schedule_dictionary(s, d):
    """Marks looked up in a schedule; what it hasn't stays unresolved."""
    p = t(s, d, "part").filter("p_size > 10").select("p_partkey", "p_brand", "p_size")
    return t(s, d, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey"), "left").select("l_orderkey", "l_linenumber", "p_brand", "p_size")


@query(f"""select project, coordinate, level, case when count(distinct layer) = 1 then min(layer) end as layer, count(*) as n from {SUPPORTS} group by 1, 2, 3""")
def unanimous_layer(s, d):
    """A value is inferred where all readings agree."""
    g = supports(s, d).groupBy("project", "coordinate", "level").agg(F.min("layer").alias("lo"), F.max("layer").alias("hi"), F.count("*").alias("n"))
    return g.select("project", "coordinate", "level", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("layer"), "n")


@query(f"""with v as (select project, coordinate, status, count(*) as votes, max(confidence) as best from {SUPPORTS} group by 1, 2, 3), r as (select *, row_number() over (partition by project, coordinate order by votes desc, best desc, status) as k from v) select project, coordinate, status, votes, round(case when votes = 1 then best * 0.6::double else best end, 6) as score from r where k = 1""")
def reading_vote(s, d):
    """The reading with most votes, by best score on ties; a single vote counts less."""
    v = supports(s, d).groupBy("project", "coordinate", "status").agg(F.count("*").alias("votes"), F.max("confidence").alias("best"))
    w = Window.partitionBy("project", "coordinate").orderBy(F.desc("votes"), F.desc("best"), "status")
    x = v.withColumn("k", F.row_number().over(w)).filter("k = 1")
    return x.select("project", "coordinate", "status", "votes", F.round(F.when(F.col("votes") == 1, F.col("best") * 0.6).otherwise(F.col("best")), 6).alias("score"))


@query(f"""select coalesce(layer, 'Total') as layer, count(*) filter (status = 'read') as read, count(*) filter (status = 'partial') as partial, count(*) as total from {SUPPORTS} where layer is not null group by rollup (layer)""")
def status_rollup(s, d):
    """Rows per kind and status with a Total line."""
    return report.summary(supports(s, d).filter("layer is not null"), "layer", "status", ["read", "partial"])


@query(f"""with g as (select type_element, count(*) filter (element <> 'UNKNOWN') as located, count(*) filter (element = 'UNKNOWN') as unlocated from {PLAN} group by 1) select type_element, 'located' as state, located as n from g union all select type_element, 'unlocated', unlocated from g""")
def melt_located(s, d):
    """Wide to long."""
    g = plan(s, d).groupBy("type_element").agg(F.count_if(F.col("element") != "UNKNOWN").alias("located"), F.count_if(F.col("element") == "UNKNOWN").alias("unlocated"))
    return g.unpivot(["type_element"], ["located", "unlocated"], "state", "n")


@query(f"""select least(20, floor(confidence * 20) + 1)::int as bin, count(*) as n from {SUPPORTS} where confidence is not null group by 1""")
def confidence_hist(s, d):
    """Histogram."""
    return report.histogram(supports(s, d), "confidence")


@query(f"""select project, count(*) as bars, sum(quantite)::bigint as pieces, count(distinct fichier) as files, count(distinct element) as places, median(longueur_mm) as median_mm from {BARS} group by 1""")
def group_bys(s, d):
    """Counts, sums, distinct counts, medians per group."""
    return bars(s, d).groupBy("project").agg(F.count("*").alias("bars"), F.sum("quantite").alias("pieces"), F.countDistinct("fichier").alias("files"), F.countDistinct("element").alias("places"), F.median("longueur_mm").alias("median_mm"))


@query(f"""select element, count(*) as n, string_agg(distinct type_element, ',' order by type_element) as kinds from {PLAN} where element <> 'UNKNOWN' group by 1 having count(*) > 1""")
def duplicate_locators(s, d):
    """Places that occur more than once."""
    g = plan(s, d).filter("element != 'UNKNOWN'").groupBy("element").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("type_element")), ",").alias("kinds"))
    return g.filter("n > 1")


@query(f"""with p as (select distinct element as k from {PLAN}), s as (select distinct element as k from {SHOP}) select 'union' as op, count(*) as n from (select k from p union select k from s) union all select 'intersect', count(*) from (select k from p intersect select k from s) union all select 'except', count(*) from (select k from p except select k from s) union all select 'bag', (select count(*) from {PLAN}) + (select count(*) from {SHOP})""")
def set_operations(s, d):
    """Bag union, union, intersection, difference of keys."""
    p, h = plan(s, d).select("element"), shop(s, d).select("element")
    n = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("op"), "n")
    return n(p.union(h).distinct(), "union").union(n(p.intersect(h), "intersect")).union(n(p.distinct().join(h, "element", "left_anti"), "except")).union(n(p.unionByName(h), "bag"))


@query(f"""select support_id, b.label as label, b.quantite as quantite, b.diametre as diametre, b.longueur_mm as longueur_mm from (select support_id, unnest(case when coalesce(len(bars), 0) = 0 then [null] else bars end) as b from {SUPPORTS})""")
def support_csv(s, d):
    """K5: a row per bar, an empty one for a support without."""
    return report.support_csv(supports(s, d)).select("support_id", "label", "quantite", "diametre", "longueur_mm")


@query(f"""select support_id, case when layer is null then 'unread' when status = 'partial' or reason is not null then 'partial' else 'read' end as state, concat_ws('; ', case when layer is null then 'no layer' end, case when level is null then 'no level' end, reason) as issues from {SUPPORTS}""")
def status_derivation(s, d):
    """state and issues of readings."""
    state = F.when(F.col("layer").isNull(), "unread").when((F.col("status") == "partial") | F.col("reason").isNotNull(), "partial").otherwise("read")
    return supports(s, d).select("support_id", state.alias("state"), F.concat_ws("; ", F.when(F.col("layer").isNull(), "no layer"), F.when(F.col("level").isNull(), "no level"), "reason").alias("issues"))


@query(f"""select type_element, element, debug.confidence as confidence from {PLAN} where type_element in ('colonne', 'dalle') order by debug.confidence nulls last, id limit 50""")
def least_certain(s, d):
    """Filtered, the least certain first, as many as are shown."""
    return plan(s, d).filter(F.col("type_element").isin("colonne", "dalle")).orderBy(F.col("debug.confidence").asc_nulls_last(), "id").limit(50).select("type_element", "element", F.col("debug.confidence").alias("confidence"))


# ---- pages and positions ----

_TOKENS = "(select l_suppkey as page, l_orderkey * 10 + l_linenumber as seq, (l_partkey * 37) % 1000 as x0, (l_orderkey * 91) % 700 as y0, 5 + l_partkey % 7 as h, case when l_partkey % 5 = 0 then 'S' || (100 + l_partkey % 700) else 'T' || (l_partkey % 60) end as text from lineitem)"


def tokens(s: SparkSession, d: str) -> DataFrame:
    c = F.col
    h = 5 + c("l_partkey") % 7
    y = (c("l_orderkey") * 91) % 700
    x = (c("l_partkey") * 37) % 1000
    text = F.when(c("l_partkey") % 5 == 0, F.concat(F.lit("S"), (100 + c("l_partkey") % 700).cast("string"))).otherwise(F.concat(F.lit("T"), (c("l_partkey") % 60).cast("string")))
    return t(s, d, "lineitem").select(F.lit("f").alias("fichier"), c("l_suppkey").alias("page"), (c("l_orderkey") * 10 + c("l_linenumber")).alias("seq"), x.alias("x0"), y.alias("y0"), (x + 10).alias("x1"), (y + h).alias("y1"), text.alias("text"))


def page_sizes(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "supplier").select(F.lit("f").alias("fichier"), F.col("s_suppkey").alias("page"), F.lit(1000.0).alias("width"), F.lit(700.0).alias("height"))


@query(f"""with c as (select page, text, (x0 > 600 and y0 > 546) as i, h, x0, y0, seq from {_TOKENS} where x0 > 450 and y0 > 490 and regexp_full_match(text, 'S\\d{{3}}')), b as (select *, row_number() over (partition by page order by i desc, h desc, x0 desc, y0 desc, seq desc) as k from c)
select s_suppkey as page, coalesce('S-' || text[2:], 'UNKNOWN') as feuillet from supplier left join (select * from b where k = 1) b on page = s_suppkey""")
def sheet_ids(s, d):
    """S3: sheet ids out of the title block."""
    return pages.sheet_ids(tokens(s, d), page_sizes(s, d)).select("page", "feuillet")


@query(f"""select page, string_agg(text, ' ' order by y0, x0, seq) as title from {_TOKENS} where x0 > 600 and y0 > 546 group by 1""")
def page_titles(s, d):
    """Titles in reading order."""
    return pages.titles(tokens(s, d), page_sizes(s, d)).select("page", "title")


@query("""select p_partkey, case p_partkey % 9 when 1 then 'colonne' when 2 then 'poutre' when 3 then 'radier' when 4 then 'semelle' when 5 then 'dalle' when 6 then 'mur_refend' when 7 then 'dalle' end as kind, case p_partkey % 3 when 0 then 'NIVEAU ' || p_size when 1 then 'TOIT APPENTIS' end as level,
case p_partkey % 9 when 0 then 'détails typiques : aucun élément localisable sur la grille' when 8 then 'plan général d''aménagement : l''armature des dalles est sur la série S-600, celle des colonnes sur la série S-500' end as skipped,
case when p_size > 20 then 1 when p_partkey % 300 > 200 then 2 when p_partkey % 2 > 0 then 3 else 4 end as tier from part""")
def page_kinds(s, d):
    """Kinds, storeys, reasons for passing over, and reading tiers of pages by their titles."""
    k = F.col("p_partkey")
    head = F.element_at(F.array(*map(F.lit, ["Détails typiques des colonnes", "Plan des colonnes", "Élévations des poutres", "Plan agrandi des radiers", "Plan des fondations", "Armature du plancher", "Contreventement", "Collecteurs", "Plan du plancher"])), (k % 9 + 1).cast("int"))
    title = F.concat(F.lit("TITRE DU DESSIN "), head, F.lit(" "), F.when(k % 3 == 0, F.concat(F.lit("Niveau "), F.col("p_size").cast("string"))).when(k % 3 == 1, "Toit appentis").otherwise("etc"), F.lit(" N° 12"))
    p = t(s, d, "part").withColumn("title", pages.stated_title(title))
    # the kinds' own names are read as storeys where nothing else is
    level = F.when(k % 3 != 2, pages.level_of(F.regexp_replace(F.col("title"), "(?i)radiers|fondations", "")))
    return p.select("p_partkey", pages.kind_of(F.col("title")).alias("kind"), level.alias("level"), pages.skip_reason(F.col("title")).alias("skipped"), pages.tier(F.col("p_size"), k % 300, k % 2).alias("tier"))


@query(f"""select page, count(*) as n from (select *, count(*) over (partition by page, text) as k from {_TOKENS}) where k <= 2 group by 1""")
def rare_tokens(s, d):
    """labels that aren't on the page too often."""
    return pages.rare(tokens(s, d), 2).groupBy("page").agg(F.count("*").alias("n"))


@query(f"""with m as (select page, arg_max(h, (c, h)) as mode from (select page, h, count(*) as c from {_TOKENS} group by 1, 2) group by 1) select t.page, count(*) as n from {_TOKENS} t join m using (page) where abs(h - mode) <= 0.25 * mode group by 1""")
def modal_height(s, d):
    """marks near the most frequent height."""
    return pages.modal_height(tokens(s, d)).groupBy("page").agg(F.count("*").alias("n"))


@query(f"""with m as (select page, median(h) as m from {_TOKENS} group by 1) select page, count(*) as n from {_TOKENS} join m using (page) where h between 0.8 * m and 1.2 * m group by 1""")
def median_height(s, d):
    """marks near the median height."""
    return pages.median_height(tokens(s, d), 0.8, 1.2).groupBy("page").agg(F.count("*").alias("n"))


@query(f"""with t as (select page, seq, x0 as x, y0 as y, text from {_TOKENS}), l as (select * from t where starts_with(text, 'S1')) select l.page, l.seq, v.value from l left join (select l.page, l.seq, l.x as lx, l.y as ly, string_agg(t.text, ' ' order by t.x, t.seq) as value from l join t on t.page = l.page and t.x > l.x and t.x - l.x <= 60 and abs(t.y - l.y) <= 3 group by 1, 2, 3, 4) v on v.page = l.page and v.seq = l.seq and v.lx = l.x and v.ly = l.y""")
def values_right_of(s, d):
    """What stands to the right of a label, on its row."""
    k = tokens(s, d).select("page", "seq", "x0", "y0", "text")
    # seq isn't a key of line items: the label is known by its place too
    lab = k.filter("text like 'S1%'").select("page", F.struct("seq", "x0", "y0").alias("pid"), F.col("x0").cast("double").alias("x"), F.col("y0").cast("double").alias("y"))
    tok = k.select("page", F.col("seq").alias("oid"), F.col("x0").cast("double").alias("ox"), F.col("y0").cast("double").alias("oy"), "text")
    return pages.right_of(tok, lab, ["page"]).select("page", F.col("pid.seq").alias("seq"), "value")


@query("""select s_suppkey as page, case when s_suppkey % 3 = 0 then 'D-' || s_suppkey else 'plan p' || s_suppkey end as feuillet, case s_suppkey % 4 when 0 then 'HAUT' when 1 then 'BAS' when 2 then 'INTEGRITE' end as layer from supplier""")
def sheet_identities(s, d):
    """Drawing numbers under their labels, layers by the first line that names one."""
    k = F.col("s_suppkey")
    line = lambda n, x, y, text: F.struct(F.lit(n).alias("seq"), F.lit(x).alias("x"), F.lit(y).alias("y"), text.alias("text"))
    drawn = F.element_at(F.array(F.lit("Lit haut"), F.lit("ARM. BAS"), F.lit("Intégrité"), F.lit("Notes")), (k % 4 + 1).cast("int"))
    lines = [
        line(1, 100.0, 50.0, F.lit("DESSIN NO.")), line(2, 110.0, 70.0, F.when(k % 3 == 0, F.concat(F.lit("D-"), k.cast("string"))).otherwise("voir liste")),
        line(3, 400.0, 70.0, drawn), line(4, 400.0, 90.0, F.when(k % 4 == 3, "notes").otherwise("lit bas"))]
    x = t(s, d, "supplier").select(k.alias("page"), F.explode(F.array(*lines)).alias("v")).select("page", "v.*")
    ids = pages.sheet_identity(x, t(s, d, "supplier").select(k.alias("page"), F.lit("plan").alias("stem"), k.alias("number")), ["page"])
    return ids.join(pages.page_layer(x, ["page"]), "page", "left")


@query("""with r as (select p_partkey // 12 as g, p_partkey as seq, case when p_partkey % 3 <> 1 then chr(65 + (p_partkey % 12)::int) end as label, p_partkey % 5 <> 0 as seen from part), w as (select *, ascii(lag(label) over (partition by g order by seq)) as a, ascii(lead(label) over (partition by g order by seq)) as b from r)
select seq, coalesce(label, case when b - a = 2 and seen then chr(a + 1) end) as label from w""")
def middle_letters(s, d):
    """An unread letter between two that are two apart, if it was seen."""
    k = F.col("p_partkey")
    here = F.char(65 + k % 12)
    r = t(s, d, "part").select(F.floor(k / 12).alias("g"), k.alias("seq"), F.when(k % 3 != 1, here).alias("label"), F.when(k % 5 != 0, F.array(here)).otherwise(F.array(F.lit("?"))).alias("options"))
    return islands.middle_letters(r, ["g"], "seq").select("seq", "label")


_PTS = "(select c_custkey // 300 as page, c_custkey as pid, (c_custkey * 37 % 1000)::double as x, (c_custkey * 91 % 700)::double as y from customer)"
_SYM = "(select p_partkey // 400 as page, p_partkey as oid, (p_partkey * 53 % 1000)::double as ox, (p_partkey * 17 % 700)::double as oy from part)"


def points(s: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return t(s, d, "customer").select(F.floor(k / 300).alias("page"), k.alias("pid"), (k * 37 % 1000).cast("double").alias("x"), (k * 91 % 700).cast("double").alias("y"))


def symbols(s: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return t(s, d, "part").select(F.floor(k / 400).alias("page"), k.alias("oid"), (k * 53 % 1000).cast("double").alias("ox"), (k * 17 % 700).cast("double").alias("oy"))


_NEAR = f"""n as (select p.page, pid, oid, sqrt((x - ox) ** 2 + (y - oy) ** 2) as dist from {_PTS} p join {_SYM} s on p.page = s.page and sqrt((x - ox) ** 2 + (y - oy) ** 2) <= 60), r as (select *, row_number() over (partition by page, pid order by round(dist, 9), oid) as k, lead(dist) over (partition by page, pid order by round(dist, 9), oid) as nx from n)"""


@query(f"with {_NEAR} select pid, oid, k::int as rank, round(dist, 6) as distance from r where k <= 6")
def nearest_symbols(s, d):
    """The nearest six symbols of each point within reach."""
    return spatial.nearest(points(s, d), symbols(s, d), ["page"], 60.0, 6).select("pid", "oid", "rank", F.round("distance", 6).alias("distance"))


@query(f"with {_NEAR} select pid, oid, round(dist, 6) as distance from r where k = 1 and (nx is null or nx - dist >= 2)")
def ambiguity_reject(s, d):
    """The nearest symbol unless the runner-up is as near."""
    return spatial.unambiguous(points(s, d), symbols(s, d), ["page"], 60.0, 2.0).select("pid", "oid", F.round("distance", 6).alias("distance"))


@query(f"""select pid from {_PTS} p where not exists (select 1 from {_SYM} s where s.page = p.page and abs(s.ox - p.x) <= 10 and abs(s.oy - p.y) <= 10)""")
def neighbour_anti(s, d):
    """F8: marks that no other token stands beside."""
    p = points(s, d)
    close = spatial.within(p, symbols(s, d), ["page"], 15.0).filter("abs(ox - x) <= 10 and abs(oy - y) <= 10").select("pid")
    return p.select("pid").join(close, "pid", "left_anti")


_RECT = "(select p_partkey // 400 as page, p_partkey as rid, (p_partkey * 53 % 900)::double as x0, (p_partkey * 17 % 600)::double as y0, (p_partkey * 53 % 900 + 20 + p_size)::double as x1, (p_partkey * 17 % 600 + 30 + p_size % 7)::double as y1 from part)"


@query(f"""select pid, rid from (select pid, rid, row_number() over (partition by pid order by (x1 - x0) * (y1 - y0), rid) as k from {_PTS} p join {_RECT} r on p.page = r.page and x between x0 and x1 and y between y0 and y1) where k = 1""")
def smallest_outline(s, d):
    """The smallest rectangle around each point."""
    k = F.col("p_partkey")
    x, y = (k * 53 % 900).cast("double"), (k * 17 % 600).cast("double")
    r = t(s, d, "part").select(F.floor(k / 400).alias("page"), k.alias("rid"), x.alias("x0"), y.alias("y0"), (x + 20 + F.col("p_size")).alias("x1"), (y + 30 + F.col("p_size") % 7).alias("y1"))
    return spatial.enclosing(points(s, d), r, ["page"], 64.0).select("pid", "rid")


_AX = "(select 'letter' as kind, chr(65 + i::int) as label, (30 + i * 66 + i * i)::double as pos, i as seq from range(15) r(i))", "(select 'number' as kind, (i + 1)::varchar as label, (20 + i * 35)::double as pos, i as seq from range(20) r(i))"


@query(f"""with l as (select pid, label, d from (select pid, label, abs(pos - x) as d, row_number() over (partition by pid order by abs(pos - x), seq) as k from {_PTS}, {_AX[0]}) where k = 1), n as (select pid, label, d from (select pid, label, abs(pos - y) as d, row_number() over (partition by pid order by abs(pos - y), seq) as k from {_PTS}, {_AX[1]}) where k = 1)
select pid, l.label || '-' || n.label as place, round(least(1.0::double, (l.d / 81 + n.d / 35) / 2), 6) as cost from l join n using (pid)""")
def grid_locate(s, d):
    """Places of points on a page's grid, with their cost by the upper median spacing."""
    axis = lambda kind, label, at, seq: F.struct(F.lit(kind).alias("kind"), F.lit(label).alias("label"), F.lit(float(at)).alias("at"), F.lit(seq).alias("seq"))
    drawn = [axis("letter", chr(65 + i), 30 + i * 66 + i * i, i) for i in range(15)] + [axis("number", str(i + 1), 20 + i * 35, i) for i in range(20)]
    axes = points(s, d).select("page").distinct().select("page", F.explode(F.array(*drawn)).alias("a")).select("page", "a.*")
    return spatial.locate(points(s, d), axes, ["page"]).select("pid", "place", F.round("cost", 6).alias("cost"))


_LINES = "(select i as lid, 'letter' as kind, chr(65 + i::int) as label, 'v' as orient, (30 + i * 66 + i * i)::double as c, (100 * (i % 3))::double as lo, (500 + 50 * (i % 4))::double as hi from range(15) r(i) union all select 100 + i, 'number', (i + 1)::varchar, 'h', (20 + i * 35)::double, (200 * (i % 2))::double, (700 + 60 * (i % 5))::double from range(20) r(i))"


@query(f"""with g as (select a.*, coalesce((select min(abs(o.c - a.c)) from {_LINES} o where o.kind = a.kind and o.lid <> a.lid and abs(o.c - a.c) > 1 and least(o.hi, a.hi) - greatest(o.lo, a.lo) > 0), 300.0::double) as gap from {_LINES} a),
n as (select pid, lid, kind, label, c, lo, hi, gap, abs(case orient when 'h' then y else x end - c) as perp from {_PTS}, g where case orient when 'h' then x else y end between lo - 120 and hi + 120), k as (select *, row_number() over (partition by pid, kind order by perp, lid) as r from n),
p as (select a.pid, a.label || '-' || b.label as place, a.perp / a.gap + b.perp / b.gap as cost, row_number() over (partition by a.pid order by a.perp / a.gap + b.perp / b.gap, a.lid, b.lid) as r from k a join k b on a.pid = b.pid and a.kind = 'letter' and b.kind = 'number' and a.r <= 6 and b.r <= 6 and b.c between a.lo - 40 and a.hi + 40 and a.c between b.lo - 40 and b.hi + 40)
select q.pid, p.place, round(coalesce(least(1.0::double, p.cost / 2), 1.0::double), 6) as cost from {_PTS} q left join p on p.pid = q.pid and p.r = 1""")
def grid_lines(s, d):
    """Places of points by the nearest pair of crossing grid lines."""
    return drawing.locate_lines(points(s, d), grid(points(s, d)), ["page"]).select("pid", "place", F.round("cost", 6).alias("cost"))


def grid(marks: DataFrame) -> DataFrame:
    """The same drawn grid on every page of marks."""
    line = lambda lid, kind, label, orient, c, lo, hi: F.struct(F.lit(lid).alias("lid"), F.lit(kind).alias("kind"), F.lit(label).alias("label"), F.lit(orient).alias("orient"), F.lit(float(c)).alias("c"), F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi"))
    drawn = [line(i, "letter", chr(65 + i), "v", 30 + i * 66 + i * i, 100 * (i % 3), 500 + 50 * (i % 4)) for i in range(15)] + [line(100 + i, "number", str(i + 1), "h", 20 + i * 35, 200 * (i % 2), 700 + 60 * (i % 5)) for i in range(20)]
    return marks.select("page").distinct().select("page", F.explode(F.array(*drawn)).alias("a")).select("page", "a.*")


@query(None)
def concentric_marks(s, d):
    """The greatest of the marks close together, greedily."""
    return drawing.suppress(points(s, d).withColumn("size", F.col("pid") * 7 % 50), ["page"], 12.0, "size").select("page", "pid", "size")


@query(None)
def text_runs(s, d):
    """Fragments of text joined to runs."""
    x = points(s, d)
    return drawing.text_runs(x.select("page", "pid", F.col("x").alias("x0"), (F.col("x") + 12).alias("x1"), "y"), ["page"])


@query(f"""with m as (select page, case when pid % 3 = 0 then 'letter' else 'number' end as kind, case when (pid // 5) % 7 < 3 then 'h' else 'v' end as orient, pid as seq from {_PTS}), c as (select page, orient, count(*) as c, min(seq) as f from m where kind = 'letter' group by 1, 2), o as (select page, orient as best from (select *, row_number() over (partition by page order by c desc, f) as k from c) where k = 1)
select page, kind, orient, count(*) as n from m join o using (page) where (kind = 'letter') = (orient = best) group by all""")
def majority_orientation(s, d):
    """letters in the orientation most of them have, numbers in the other."""
    m = points(s, d).select("page", F.when(F.col("pid") % 3 == 0, "letter").otherwise("number").alias("kind"), F.when(F.floor(F.col("pid") / 5) % 7 < 3, "h").otherwise("v").alias("orient"), F.col("pid").alias("seq"))
    return drawing.majority_orientation(m, ["page"]).groupBy("page", "kind", "orient").agg(F.count("*").alias("n"))


@query("""select p_partkey as k, 2 as fragments, case when p_size % 2 = 0 then 'LONG' else 'TRAN' end as label, 1 + p_size % 3 as sets, p_size * (1 + p_size % 3) as quantite, '25RL' || (10 + p_partkey % 50) || '-0' || (p_size % 10) as repere, round((1 + p_size) * 25.4::double, 1) as spacing, case when p_partkey % 2 = 0 then 'HAUT' else 'BAS' end as face, 'I-' || p_size as place, 'NIVEAU ' || p_size as level, p_size || ' @ ' || (p_size + 1) as span, '20M' as size, case when p_partkey % 40 between 12 and 39 then 'inches above 11' end as issue, p_size || '-25M · 10M@' || (100 + p_size) || 'mm' as summary from part""")
def shop_readings(s, d):
    """Grammars and repairs of read shop drawings, written and read back."""
    k, z = F.col("p_partkey"), F.col("p_size")
    st = lambda c: c.cast("string")
    spec = F.concat(F.when(z % 2 == 0, "LONG: ").otherwise("TRAN: "), st(1 + z % 3), F.lit("x"), st(z), F.lit(" 25M 25RL"), st(10 + k % 50), F.lit("-0"), st(z % 10), F.lit(" @"), st(1 + z), F.lit('"'), F.when(k % 2 == 0, "HAUT").otherwise("BAS"))
    kind = "struct<quantite:int,diametre:string,espacement_mm:double>"
    bars = F.array(F.struct(z.alias("quantite"), F.lit("25M").alias("diametre"), F.lit(None).cast("double").alias("espacement_mm")).cast(kind), F.struct(F.lit(None).cast("int").alias("quantite"), F.lit("10M").alias("diametre"), (100 + z).cast("double").alias("espacement_mm")).cast(kind))
    x = t(s, d, "part").select(
        k.alias("k"), F.size(G.fragments(F.concat(st(z), F.lit("-25M A.S. "), st(z), F.lit("-15M")))).alias("fragments"), G.mat_spec(spec).alias("m"), G.place_repair(F.concat(F.lit("1-"), st(z))).alias("place"),
        G.last_level(F.concat(F.lit("Rez-de-chaussée au niveau "), st(z), F.lit(" - toit"))).alias("level"), G.span_of_name(F.concat(F.lit("COL_NIV-"), st(z), F.lit("@"), st(z + 1), F.lit(".pdf"))).alias("span"), G.size_repair(F.element_at(F.array(F.lit("2OM"), F.lit("20H"), F.lit("2OW")), (k % 3 + 1).cast("int"))).alias("size"),
        G.length_issues(F.concat(st(z), F.lit("-"), F.lpad(st(k % 40), 2, "0"))).alias("issue"), G.column_summary(bars).alias("summary"))
    return x.select("k", "fragments", "m.label", "m.sets", "m.quantite", "m.repere", F.col("m.espacement_mm").alias("spacing"), "m.face", "place", "level", "span", "size", "issue", "summary")


@query("""with m as (select l_suppkey as g, median(l_quantity - 25) as mx, median(l_tax * 100) as my from lineitem group by 1) select g, mx as dx, my as dy, count(*) as n from lineitem join m on g = l_suppkey group by 1, 2, 3 having count(*) >= 10 and avg(case when abs(l_quantity - 25 - mx) <= 18 and abs(l_tax * 100 - my) <= 18 then 1 else 0 end) >= 0.7""")
def typical_offset(s, d):
    """The offset that most marks share."""
    o = t(s, d, "lineitem").select(F.col("l_suppkey").alias("g"), (F.col("l_quantity") - 25).alias("dx"), (F.col("l_tax") * 100).alias("dy"))
    return pages.typical_offset(o, ["g"], 18.0)


@query(f"""with b as (select page, (x / 14) as q, pid % 40 as label, pid as seq, y, case when x / 14 - floor(x / 14) = 0.5 then 2 * round(x / 28) else round(x / 14) end as bucket from {_PTS}), l as (select page, bucket, label, arg_max(y, seq) as v from b group by 1, 2, 3), g as (select page, bucket::bigint as bucket, count(*) as labels, max(v) - min(v) as spread from l group by 1, 2 having count(*) >= 3 and max(v) - min(v) >= 150) select page, bucket, labels, spread from (select *, row_number() over (partition by page order by labels desc, bucket) as k from g) where k = 1""")
def collinear_axis(s, d):
    """Labels on one line."""
    return pages.collinear(points(s, d).withColumn("label", F.col("pid") % 40).withColumn("seq", F.col("pid")), ["page"], "x")


@query("""with s as (select p_partkey // 400 as page, (p_partkey * 7 % 50 + 1)::double as w, (p_partkey * 11 % 40 + 1)::double as h from part), d as (select c_custkey // 300 as page, (c_custkey * 13 % 500 + 100)::double as w_mm, (c_custkey * 29 % 400 + 100)::double as h_mm from customer)
select page, round(median(greatest(w, h) / greatest(w_mm, h_mm)), 6) as scale, count(*) as n from s join d using (page) where abs(greatest(w, h) / least(w, h) - greatest(w_mm, h_mm) / least(w_mm, h_mm)) < 0.06 * greatest(w_mm, h_mm) / least(w_mm, h_mm) group by 1 having count(*) >= 3""")
def scale_calibration(s, d):
    """Scale of a sheet from drawn and stated sizes."""
    part, customer = t(s, d, "part"), t(s, d, "customer")
    p, c = F.col("p_partkey"), F.col("c_custkey")
    sy = part.select(F.floor(p / 400).alias("page"), (p * 7 % 50 + 1).cast("double").alias("w"), (p * 11 % 40 + 1).cast("double").alias("h"))
    st = customer.select(F.floor(c / 300).alias("page"), (c * 13 % 500 + 100).cast("double").alias("w_mm"), (c * 29 % 400 + 100).cast("double").alias("h_mm"))
    return pages.calibrate(sy, st, ["page"])


_VIEWS = "(select case p_partkey % 3 when 0 then 'main' else 'V' || (p_partkey % 3) end as view, 'number' as kind, ((p_partkey // 3) % 40)::varchar as label, min((p_partkey // 3) % 40 * 50 + case p_partkey % 3 when 0 then 0 when 1 then 500 else ((p_partkey // 3) % 40) * 3 end)::double as at from part group by 1, 2, 3)"


@query(f"""with v as {_VIEWS}, s as (select a.view, a.kind, m.at - a.at as shift from v a join v m on m.view = 'main' and a.view <> 'main' and a.kind = m.kind and a.label = m.label) select view, kind, list_sort(list(shift))[(count(*) // 2 + 1)::int] as offset from s group by 1, 2 having count(*) >= 3 and max(shift) - min(shift) <= 3""")
def view_offsets(s, d):
    """Views that are the main view shifted."""
    return dedup.offsets(_views(t(s, d, "part")), "main")


def _views(part: DataFrame) -> DataFrame:
    k = F.col("p_partkey")
    i = F.floor(k / 3) % 40
    at = i * 50 + F.when(k % 3 == 0, 0).when(k % 3 == 1, 500).otherwise(i * 3)
    return part.groupBy(F.when(k % 3 == 0, "main").otherwise(F.concat(F.lit("V"), (k % 3).cast("string"))).alias("view"), F.lit("number").alias("kind"), i.cast("string").alias("label")).agg(F.min(at).cast("double").alias("at"))


@query("""select s_suppkey as page, x::int as x, y::int as y from supplier, (select unnest(range(0, 5000 - 193 + 1, 1088)) as x) a, (select unnest(range(0, 3000 - 193 + 1, 1088)) as y) b""")
def tile_grid(s, d):
    """Overlapping tiles of every page's image."""
    return t(s, d, "supplier").select(F.col("s_suppkey").alias("page"), F.explode(pages.tiles(5000, 3000)).alias("t")).select("page", "t.x", "t.y")


# ---- ordered ----

_EV = "(select event_id, user_id, floor(epoch(ts))::bigint as s, (1 + event_id % 500) as len, event_type from events)"


def events(s: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    return t(s, d, "events").select("event_id", "user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"), (1 + e % 500).alias("len"), "event_type")


@query(f"""with f as (select *, max(s + len) over (partition by user_id order by s, s + len, event_id rows between unbounded preceding and 1 preceding) as far from {_EV}), i as (select *, sum(case when s - far > 15 then 1 else 0 end) over (partition by user_id order by s, s + len, event_id rows unbounded preceding) as k from f) select user_id, min(s) as lo, max(s + len) as hi, count(*) as pieces from i group by user_id, k""")
def interval_merge(s, d):
    """Intervals merged over small gaps."""
    return islands.merge_intervals(events(s, d).withColumn("e", F.col("s") + F.col("len")), ["user_id"], "s", "e", 15, "event_id")


@query(f"""with f as (select *, s - lag(s) over (partition by user_id order by s, event_id) as gap from {_EV}), i as (select *, sum(case when gap > 3600 then 1 else 0 end) over (partition by user_id order by s, event_id rows unbounded preceding) as island from f) select user_id, island::bigint as island, count(*) as n, min(s) as lo from i group by 1, 2""")
def gap_cluster(s, d):
    """Clusters along a line."""
    return islands.cluster(events(s, d), ["user_id"], "s", 3600, "event_id").groupBy("user_id", "island").agg(F.count("*").alias("n"), F.min("s").alias("lo"))


@query(f"""with l as (select user_id, s, event_id::varchar as label from {_EV} where event_id % 10 = 0), p as (select user_id, s, event_id as pid from {_EV} where event_id % 10 <> 0)
select pid, (select max_by(label, (s, label)) from l where l.user_id = p.user_id and l.s <= p.s) as top, (select min_by(label, (s, label)) from l where l.user_id = p.user_id and l.s > p.s) as bottom from p""")
def storey_bands(s, d):
    """The labels before and after, in one pass."""
    e = events(s, d)
    return islands.bands(e.filter("event_id % 10 != 0").withColumnRenamed("event_id", "pid"), e.filter("event_id % 10 = 0").select("user_id", "s", F.col("event_id").cast("string").alias("label")), ["user_id"], "s").select("pid", "top", "bottom")


@query(f"""with o as (select *, row_number() over (partition by user_id order by s, event_id) - row_number() over (partition by user_id, event_type order by s, event_id) as k from {_EV}), g as (select user_id, event_type, k, count(*) as n from o group by 1, 2, 3) select user_id, count(*) as runs, max(n) as longest from g group by 1""")
def equal_runs(s, d):
    """Runs of equal rows."""
    r = islands.runs(events(s, d), ["user_id"], ["s", "event_id"], ["event_type"]).groupBy("user_id", "run").agg(F.count("*").alias("n"))
    return r.groupBy("user_id").agg(F.count("*").alias("runs"), F.max("n").alias("longest"))


@query(f"""select event_id, coalesce((lag(s) over w + s) / 2, 0)::double as lo, coalesce((lead(s) over w + s) / 2, 4e9)::double as hi, coalesce(lead(s) over w < s + len, false) as overlaps from {_EV} window w as (partition by user_id order by s, event_id)""")
def title_midpoints(s, d):
    """Limits halfway to the neighbours, and whether the next begins before the end."""
    w = Window.partitionBy("user_id").orderBy("s", "event_id")
    c = F.col("s")
    return events(s, d).select("event_id", F.coalesce((F.lag("s").over(w) + c) / 2, F.lit(0.0)).alias("lo"), F.coalesce((F.lead("s").over(w) + c) / 2, F.lit(4e9)).alias("hi"), F.coalesce(F.lead("s").over(w) < c + F.col("len"), F.lit(False)).alias("overlaps"))


@query(f"""with b as (select id, type_element, len(armature) as n, unnest(range(1, len(armature) + 1)) as k from {SHOP} where type_element = 'dalle') select id, k::int as k, case when n = 2 then (case k when 1 then 'NUM' else 'ALP' end) end as role from b""")
def num_alp_order(s, d):
    """Two unnamed bars are NUM and ALP in reading order."""
    b = shop(s, d).filter("type_element = 'dalle'").select("id", F.size("armature").alias("n"), F.posexplode("armature").alias("p", "b"))
    return b.select("id", (F.col("p") + 1).alias("k"), F.when(F.col("n") == 2, F.when(F.col("p") == 0, "NUM").otherwise("ALP")).alias("role"))


_STD = lambda k: f"case when {k} = 1 then 'REZ-DE-CHAUSSÉE' else 'NIVEAU ' || ({k})::int end"


@query(rf"""with r as (select fichier as g, seq, case when seq % 3 <> 0 then debug.niveau end as level, try_cast(nullif(regexp_extract(debug.niveau, '(\d{{1,2}})\s*$', 1), '') as int) as said from {SHOP} where debug.niveau like 'NIVEAU %'),
h as (select *, count(level) over (partition by g order by seq) as run, nullif(regexp_extract(last_value(level ignore nulls) over (partition by g order by seq rows between unbounded preceding and 1 preceding), '^NIVEAU (\d+)', 1), '')::double as hi, nullif(regexp_extract(first_value(level ignore nulls) over (partition by g order by seq rows between 1 following and unbounded following), '^NIVEAU (\d+)', 1), '')::double as lo from r),
n as (select *, row_number() over (partition by g, run, level is null order by seq) as k, count(*) over (partition by g, run, level is null) as n from h),
f as (select *, case when hi > 1 then greatest(0, hi - 1 - coalesce(lo, 0)) else 0 end as free from n), q as (select *, case when lo is not null and free = n then hi - k when lo is not null and hi is null then lo + 1 + n - k end as sure from f)
select g, seq, coalesce(level, case when sure is not null then {_STD("sure")} || (case when said is not null and ({_STD("sure")}) <> 'NIVEAU ' || said then ' ?' else '' end) when k <= free then {_STD("(hi - k)")} || ' ?' end) as level, level is null and (sure is not null or k <= free) as inferred from q""")
def storey_fill(s, d):
    """Unread storeys of schedules filled from their neighbours; every third storey of a file's column is taken as unread."""
    x = shop(s, d).filter("debug.niveau like 'NIVEAU %'").select(F.col("fichier").alias("g"), "seq", F.when(F.col("seq") % 3 != 0, F.col("debug.niveau")).alias("level"), F.col("debug.niveau").alias("hint"))
    return islands.storeys(x, "g")


# ---- assignment, search ----


@query(None)
def least_cost(s, d):
    """Callouts assigned to symbols at least total cost, component by component of the pairs within reach."""
    w = spatial.within(points(s, d), symbols(s, d), ["page"], 40.0).withColumn("distance", F.round("distance", 6))
    return matching.assign_components(w.select("pid", "oid", "distance"), "pid", "oid", "distance").withColumn("ratio", F.round("ratio", 6))


@query(None)
def greedy_pairs(s, d):
    """Pairs chosen greedily, nearest first."""
    w = spatial.within(points(s, d), symbols(s, d), ["page"], 40.0).withColumn("distance", F.round("distance", 6))
    return matching.greedy(w.select("pid", "oid", "distance"), ["pid"], ["oid"], [F.col("distance")]).select("pid", "oid", "distance")


@query(None)
def view_groups(s, d):
    """Callouts split into contiguous groups, one per title."""
    p = points(s, d)
    c = p.filter("pid % 7 != 0").select("page", F.col("pid").alias("seq"), "x", "y")
    ti = p.filter("pid % 7 = 0").select("page", F.col("pid").cast("string").alias("title"), "x", F.floor(F.col("y") / 100).cast("double").alias("band"), "y")
    ti = ti.select("page", "title", "x", (F.col("band") * 100 + 90).alias("y"))
    return matching.assign_views(c, ti, "page")


@query("""with q as (select vec_id as query_id, embedding::double[] as e from embeddings where vec_id % 20 = 0), c as (select query_id, vec_id, list_cosine_similarity(q.e, v.embedding::double[]) as sim from q, embeddings v where vec_id <> query_id), r as (select *, row_number() over (partition by query_id order by round(sim, 7) desc, vec_id) as k from c) select query_id, k::int as rank, vec_id from r where k <= 5""")
def topk_cosine(s, d):
    """The five likest vectors of every query, all rows searched."""
    e = t(s, d, "embeddings")
    return search.top_k(e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), e.select("vec_id", "embedding"), 5).select("query_id", "rank", "vec_id")


# ---- incremental ----


@query("""select o_orderkey from orders where o_orderkey % 3 <> 0""")
def incremental_pending(s, d):
    """Inputs without a checkpoint under their fingerprint."""
    o = t(s, d, "orders").withColumn("fingerprint", incremental.fingerprint("v1", F.col("o_orderkey"), F.col("o_orderdate")))
    done = o.filter("o_orderkey % 3 = 0").select("fingerprint")
    return incremental.pending(o, done).select("o_orderkey")


@query("""select count(*) as scopes, count(*) as stamps from (select distinct c_nationkey from customer)""")
def input_stamp(s, d):
    """One stamp per set of inputs, all different."""
    x = t(s, d, "customer").select(F.col("c_nationkey").alias("scope"), F.lit("k").alias("kind"), F.col("c_name").alias("name"), F.sha2("c_mktsegment", 256).alias("digest"))
    return incremental.stamp(x).agg(F.count("*").alias("scopes"), F.countDistinct("stamp").alias("stamps"))


@query(f"""select 'v2' as version, count(*) as n, sum(case when {_FOLD("coalesce(debug.niveau, '')")} = '' then 0 else 1 end)::bigint as levels from {PLAN}""")
def representation_upgrade(s, d):
    """Rows of an older representation aligned, the others kept; twice is as once."""
    x = plan(s, d).select("id", F.col("debug.niveau").alias("niveau"), F.when(F.col("seq") % 2 == 0, "v1").otherwise("v2").alias("version"))
    align = lambda df: df.withColumn("niveau", fold(F.col("niveau")))
    y = incremental.upgrade(incremental.upgrade(x, "v2", align), "v2", align)
    return y.groupBy("version").agg(F.count("*").alias("n"), F.sum(F.when(F.coalesce(F.trim("niveau"), F.lit("")) == "", 0).otherwise(1)).alias("levels"))
