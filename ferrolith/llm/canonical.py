"""Mapping free-entered values to a canonical list by a prefix-filter set-similarity join.

Every distinct value and every list entry becomes a set of tokens. Tokens are ordered by global rarity (frequency over
values and list together, then the token). Two sets with Jaccard >= t must share a token within their first
n - ceil(t*n) + 1 tokens, so only these rare prefixes are joined; the length filter and the positional filter drop
pairs that can't reach t; what is left is verified exactly. `similar_entries` gives every pair at t or above. Of these the
mapping keeps, after a check that value and entry state the same number or both none, the best.

Defined results: a null value is no value and yields no row; a value that is an entry character for character maps to
it; a value without tokens (blank, '?') or without an entry at t is unmatched (0); among equally similar entries the
one with the smallest id wins; repeated rows give repeated results; an empty list leaves every value unmatched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrolith.functions.places import grams, words_and_number
from ferrolith.functions.text import py_fold
from ferrolith.sources.tables import once

THRESHOLD = 0.34
_DESIGNATOR = str.maketrans({"O": "0", "I": "1", "L": "1", "S": "5", "|": "1"})
# Words before a bar size, and letters read for the closing M.
_BEFORE = r"^(?:NO|NUMERO|BARRES?|ARM|DIAM|D|#)?[ .:]*"
_SIZE_LETTER = {"", "M", "N", "H"}


def designator_parts(text: str) -> tuple[str, str]:
    """(letters, number) of a typed bar size: '2OM' -> ('M', '20'), 'barre 15' -> ('M', '15'), 'M25' -> ('M', '25'), 'lisse' -> ('LISSE', '')."""
    s = re.sub(_BEFORE, "", re.sub(r"[Øø()*\[\]]", " ", text.replace("l", "L")).strip() and py_fold(re.sub(r"[Øø()*\[\]#]", " ", text.replace("l", "L"))))
    x = re.sub(r"[ .\-]+", "", s)
    m = re.fullmatch(r"M?([0-9OILS|]{2})([MNH]?)", x)
    if m and (n := m[1].translate(_DESIGNATOR)).isdigit() and any(ch.isdigit() for ch in m[1]):
        return "M", n
    n = re.findall(r"\d+", s)
    return re.sub(r"[^A-Z]", "", s), n[0] if n else ""


def plain_parts(text: str) -> tuple[str, str]:
    """(letters, number) of any other value: letters folded, the first number as it stands."""
    s = py_fold(text)
    n = re.findall(r"\d+", s)
    return re.sub(r"[^A-Z]", "", s), n[0].lstrip("0") or "0" if n else ""


READ = {"diametre": designator_parts, "niveau": words_and_number}  # how a field's values are read; others plainly


def value_parts(field: str, value: str) -> tuple[str, str]:
    """(letters, number) by field."""
    letters, number = READ.get(field, plain_parts)(value)
    return letters.replace(" ", ""), number


def _token_rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in parts:
        number, tokens = [], []
        for field, value in zip(p["field"], p["value"]):
            letters, n = value_parts(field, value)
            number.append(n)
            tokens.append(sorted(grams(letters) if letters else set()) + ([f"#{n}"] if n else []))
        yield p.assign(number=pd.Series(number, index=p.index, dtype=object), tokens=pd.Series(tokens, index=p.index, dtype=object))


def tokenised(df: DataFrame) -> DataFrame:
    """(..., field, value) with the number a value states and its tokens; to be given distinct values."""
    return df.mapInPandas(_token_rows, ", ".join(f"`{c}` {k}" for c, k in df.dtypes) + ", number string, tokens array<string>")


def similar_entries(values: DataFrame, entries: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """values (field, value, number, tokens) and entries (field, ref_id, number, tokens): field, value, ref_id, similarity, agree of all pairs at threshold or above.

    agree: whether both state the same number, or none.
    """
    t = threshold
    v = values.filter(F.size("tokens") > 0)
    e = entries.filter(F.size("tokens") > 0)
    seen = v.select("field", "tokens").unionByName(e.select("field", "tokens"))
    rarity = seen.select("field", F.explode("tokens").alias("token")).groupBy("field", "token").agg(F.count("*").alias("df"))

    def prefixes(df: DataFrame, key: str) -> DataFrame:
        x = df.select("field", key, "number", F.size("tokens").alias("n"), F.explode("tokens").alias("token")).join(rarity, ["field", "token"])
        x = x.groupBy("field", key, "number", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("o"))
        x = x.withColumn("o", F.transform("o", lambda s: s["token"])).withColumn("keep", F.col("n") - F.ceil(F.col("n") * t) + 1)
        return x.select("field", key, "number", "n", F.col("o").alias("all"), F.posexplode(F.slice("o", 1, F.col("keep").cast("int"))).alias("at", "token"))

    a = prefixes(v, "value")
    b = prefixes(e, "ref_id").select("field", "token", "ref_id", "number", F.col("n").alias("m"), F.col("all").alias("other"), F.col("at").alias("bt"))
    need = F.ceil((F.col("n") + F.col("m")) * (t / (1 + t)))
    c = a.join(b.withColumnRenamed("number", "other_number"), ["field", "token"]).filter((F.col("m") >= F.col("n") * t) & (F.col("n") >= F.col("m") * t))
    c = c.filter(1 + F.least(F.col("n") - F.col("at"), F.col("m") - F.col("bt")) - 1 >= need)
    c = c.dropDuplicates(["field", "value", "ref_id"])
    both = F.size(F.array_intersect("all", "other"))
    c = c.withColumn("similarity", both / (F.col("n") + F.col("m") - both)).filter(F.col("similarity") >= t)
    return c.select("field", "value", "ref_id", "similarity", F.col("number").eqNullSafe(F.col("other_number")).alias("agree"))


def best_entries(pairs: DataFrame) -> DataFrame:
    """Per value the likest entry whose number agrees, the smallest id on ties."""
    best = F.max(F.struct("similarity", (-F.col("ref_id")).alias("back"))).alias("b")
    return pairs.filter("agree").groupBy("field", "value").agg(best).select("field", "value", (-F.col("b.back")).alias("ref_id"), "b.similarity")


def map_values(rows: DataFrame, entries: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """rows (any columns, field, value) and entries (ref_id, field, label): rows with ref_id (0: none) and similarity.

    Only distinct values are compared; the result is joined back to the rows. Values occurring in a great part of the rows
    are pre-aggregated by distinct(), and the join back leaves splitting of a hot value to AQE or to a broadcast of the
    small side by its measured size.
    """
    ref = tokenised(entries.select("field", F.col("label").alias("value"), "ref_id").filter("value is not null and field is not null"))
    ref = ref.withColumn("number", F.coalesce("number", F.lit("")))
    distinct = tokenised(rows.select("field", "value").filter("value is not null and field is not null").distinct())
    exact = entries.select("field", F.col("label").alias("value"), F.col("ref_id").alias("exact")).groupBy("field", "value").agg(F.min("exact").alias("exact"))
    found = best_entries(similar_entries(distinct, ref, threshold)).withColumnRenamed("ref_id", "near")
    known = distinct.select("field", "value").join(found, ["field", "value"], "left").join(exact, ["field", "value"], "left")
    known = known.select("field", "value", F.coalesce("exact", "near", F.lit(0)).cast("int").alias("ref_id"), F.when(F.col("exact").isNotNull(), 1.0).otherwise(F.col("similarity")).alias("similarity"), F.col("exact").isNotNull().alias("verbatim"))
    return rows.filter("value is not null").join(known, ["field", "value"], "left").withColumn("ref_id", F.coalesce("ref_id", F.lit(0)))


def typed_values(bars: DataFrame) -> DataFrame:
    """bar_id, field, value of each non-null diametre and niveau; an id delivered twice counts once."""
    pair = lambda c: F.struct(F.lit(c).alias("field"), F.col(c).alias("value"))
    b = bars.select("bar_id", "diametre", "niveau", "loaded_at") if "loaded_at" in bars.columns else bars.select("bar_id", "diametre", "niveau")
    return once(b, "bar_id").select("bar_id", F.explode(F.array(pair("diametre"), pair("niveau"))).alias("x")).select("bar_id", "x.*").filter("value is not null")


def found(bars: DataFrame, ref_values: DataFrame) -> DataFrame:
    """bar_id, field, ref_id of each typed value that is no entry character for character."""
    m = map_values(typed_values(bars), ref_values)
    return m.filter(~F.coalesce(F.col("verbatim"), F.lit(False))).select("bar_id", "field", "ref_id")


def report(bars: DataFrame, ref_values: DataFrame) -> DataFrame:
    """Per field: typed values, those verbatim, mapped and unmatched."""
    m = map_values(typed_values(bars), ref_values)
    one = lambda c: F.sum(F.when(c, 1).otherwise(0)).alias
    v = F.coalesce(F.col("verbatim"), F.lit(False))
    return m.groupBy("field").agg(F.count("*").alias("values"), one(v)("verbatim"), one(~v & (F.col("ref_id") > 0))("mapped"), one(F.col("ref_id") == 0)("unmatched"))
