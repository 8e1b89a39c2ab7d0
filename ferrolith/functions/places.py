"""Names of lots, storeys, places, layers and drawing issues, as plain functions and as Column expressions.

A storey is written as its canonical label of the reference list ("NIVEAU 4", "SOUS-SOL S1", "RDC"), a place as
LETTER-NUMBER ("A.5-12"), a layer as HAUT / BAS / INTEGRITE. What can't be read is null.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrolith.functions.text import fold, py_fold

# Number words up to twenty and Roman numerals, as storeys are written.
WORDS = ("ZERO UN DEUX TROIS QUATRE CINQ SIX SEPT HUIT NEUF DIX ONZE DOUZE TREIZE QUATORZE QUINZE SEIZE "
         "DIX-SEPT DIX-HUIT DIX-NEUF VINGT").split()  # fmt: skip
ROMAN = "- I II III IV V VI VII VIII IX X XI XII XIII XIV XV XVI XVII XVIII XIX XX".split()
NUMBER = {w: i for i, w in enumerate(WORDS)} | {w: i for i, w in enumerate(ROMAN) if i}
# Short forms of storey names that share too few letters with the name.
SHORT = {"FDN": "FONDATION", "FOND": "FONDATION", "RDC": "RDC", "RC": "RDC", "SS": "SOUS SOL", "SSOL": "SOUS SOL", "SOUSSOL": "SOUS SOL", "N": "NIVEAU", "NV": "NIVEAU",
         "NIV": "NIVEAU", "LEVEL": "NIVEAU", "LVL": "NIVEAU", "TOITURE": "TOIT"}
NOISE = {"LA", "LE", "DU", "DE", "NO", "NUMERO"}
LOOKALIKE = str.maketrans({"O": "0", "I": "1", "L": "1", "S": "5", "|": "1", "B": "8"})
LETTERLIKE = str.maketrans({"0": "O", "1": "I", "5": "S", "8": "B", "|": "I"})

_LOT = r"(?:^|[^0-9])([0-9]{5})(?:[^0-9]|$)"


def lot(fichier: Column) -> Column:
    """The five-digit lot in a file name, null if there is none."""
    return F.nullif(F.regexp_extract(fichier, _LOT, 1), F.lit(""))


def words_and_number(text: str) -> tuple[str, str]:
    """(letters, number) of a typed storey: 'N1VEAU I3' -> ('NIVEAU', '13'), 'ss-2' -> ('SOUS SOL', '2'), '12e niveau' -> ('NIVEAU', '12').

    Letters come without accents, digits misread inside a word as letters, letters misread inside a number as digits.
    """
    s = re.sub(r"N ?[°º]", " ", py_fold(text.replace("°", " ").replace("l", "L").replace("º", " ")))
    s = re.sub(r"R[ .\-]*D[ .\-]*C\b\.?", "RDC", s)
    s = re.sub(r"\bREZ[ \-]+DE[ \-]+CH[A-Z0-9]*\.?", "RDC", s)
    s = re.sub(r"\bS\.?[ \-]?SOL\b", "SOUS SOL", s)
    s = re.sub(r"([A-Z]{2,})(\d{1,2})$", r"\1 \2", s)
    s = re.sub(r"^(N|S)[ \-.]?(\d{1,2})$", lambda m: ("NIVEAU " if m[1] == "N" else "SOUS SOL ") + m[2], s)
    words: list[str] = []
    number = ""
    tokens = [x for x in re.split(r"[^A-Z0-9|]+", s) if x]
    for i, t in enumerate(tokens):
        last = i == len(tokens) - 1
        core = re.fullmatch(r"(\d{1,2})(?:E|EME|ER|RE|TH|ND|RD|ST)", t)
        if core:
            number = core[1]
        elif t.isdigit():
            number = t
        elif i and last and t in NUMBER:
            number = str(NUMBER[t])
        elif re.fullmatch(r"S\d", t):
            number = t[1]
        elif i and last and len(t) <= 2 and t.translate(LOOKALIKE).isdigit():
            number = t.translate(LOOKALIKE)
        elif t not in NOISE:
            t = t.translate(LETTERLIKE)
            words += SHORT.get(t, t).split()
    if number:
        number = str(int(number))
    if len(words) > 1 and words[0] == "NIVEAU" and not number:
        words = words[1:]
    return " ".join(words), number


def storey(text: str | None) -> str | None:
    """Canonical storey of a well known spelling: the lower end of a span ('RDC @ 2'), null where it can't be told."""
    if text is None or not text.strip():
        return None
    if "@" in text:
        text = text.split("@")[0]
    w, n = words_and_number(text)
    if not w and n:
        w = "NIVEAU"
    w = w.replace(" ", "")
    if not w:
        return None
    best = max(_FORMS, key=lambda k: (_alike(w, k), k))
    if _alike(w, best) < 0.34:
        return None
    name = _FORMS[best]
    if name == "NIVEAU":
        return f"NIVEAU {n}" if n else None
    if name == "SOUS-SOL":
        return f"SOUS-SOL S{n}" if n else None
    return name


# The storey names of the reference list, letters only.
_FORMS = {"NIVEAU": "NIVEAU", "SOUSSOL": "SOUS-SOL", "FONDATION": "FONDATION", "TREFOND": "TREFOND", "RDC": "RDC", "MEZZANINE": "MEZZANINE",
          "TOIT": "TOIT", "APPENTIS": "APPENTIS", "PASSERELLE": "PASSERELLE"}


def grams(word: str) -> set[str]:
    """Letter pairs with marked ends."""
    x = f"^{word}$"
    return {x[i : i + 2] for i in range(len(x) - 1)}


def _alike(a: str, b: str) -> float:
    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y)


def file_storey(name: str | None) -> str | None:
    """The storey that a file name ends with: '..._COL_NIV-4.pdf', 'colonnes ss1', 'DALLE-NIV-6 rev C', 'POU_TOIT', 'SEMELLE-FDN'."""
    if name is None:
        return None
    s = py_fold(name)
    m = re.findall(r"(?:^|[^A-Z])(NIV[ \-.]?\d{1,2}|SS[ \-]?\d|FDN|RDC|TOIT|MEZZ[A-Z]*|TREF[A-Z]*|APPENTIS|PASSERELLE)(?=[^A-Z0-9]|$)", s)
    return storey(m[-1]) if m else None


def place(text: str | None) -> str | None:
    """LETTER-NUMBER of a typed grid place: '(E-13)', '8-J', 'AXES 9/H', 'Q - 6', 'J14', 'a.5–15'; null for UNKNOWN and the like."""
    if text is None:
        return None
    s = re.sub(r"^(AXES?|AX\.?)\b", " ", re.sub(r"[()\[\]]", " ", py_fold(text))).strip()
    s = re.sub(r"^([A-Z](?:\.\d+)?'?[-/_])([0-9OIL|]{1,2})$", lambda x: x[1] + x[2].translate(LOOKALIKE), s)
    m = re.fullmatch(r"([A-Z](?:\.\d+)?'?)[ ]*[-/_ .]?[ ]*(\d{1,3}(?:[.,]\d+)?)", s)
    if m is None and (r := re.fullmatch(r"(\d{1,3}(?:[.,]\d+)?)[ ]*[-/_ .]?[ ]*([A-Z](?:\.\d+)?'?)", s)):
        m = re.fullmatch(r"(.*)\n(.*)", f"{r[2]}\n{r[1]}")
    if m is None:
        return None
    number = m[2].replace(",", ".")
    number = re.sub(r"\.0+$", "", number).lstrip("0") or "0"
    return f"{re.sub(r'[.]0+$', '', m[1])}-{number}"


def layer(c: Column) -> Column:
    """HAUT, BAS or INTEGRITE of a typed layer, else null."""
    x = fold(c)
    return F.when(x.rlike(r"INT.?GR"), "INTEGRITE").when(x.rlike(r"\bHAUT"), "HAUT").when(x.rlike(r"\bBAS"), "BAS")


def issue(name: str | None) -> float | None:
    """Rank of the issue that a file name states ('rev C', 'rév.2', '_R3', '_indB'), null if it states none."""
    if name is None:
        return None
    s = re.sub(r"\.[A-Z]{3,4}$", "", py_fold(name))
    m = re.search(r"(?:^|[^A-Z])(?:REV(?:ISION)?|IND(?:ICE)?|EMISSION|ISSUE|VERSION)[ ._\-]*([A-Z]|\d{1,2})$|[ _\-](?:R|V)(\d{1,2})$", s)
    if not m:
        return None
    x = m[1] or m[2]
    return float(x) if x.isdigit() else float(ord(x) - 64)


def _udf(f, kind: T.DataType):
    @F.pandas_udf(kind)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        seen: dict = {}
        for s in parts:
            if len(seen) > 200_000:  # a memory bound on the cache only
                seen.clear()
            for v in s.unique():
                if v not in seen:
                    seen[v] = None if v is None or (isinstance(v, float) and v != v) else f(v)
            yield s.map(seen)

    return run


storey_of = _udf(storey, T.StringType())
file_storey_of = _udf(file_storey, T.StringType())
place_of = _udf(place, T.StringType())
issue_of = _udf(issue, T.DoubleType())
