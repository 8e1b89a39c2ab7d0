"""Text normalisation: as Column expressions where the closed set of the corpus allows it, as plain functions for Arrow kernels."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters with diacritics of the corpus languages and their base letters; dashes; white space.
ACCENTED = "ÀÂÄÁÃÅÇÉÈÊËÎÏÍÌÔÖÓÒÕÛÜÙÚÑÝŸàâäáãåçéèêëîïíìôöóòõûüùúñýÿ"
BASE = "AAAAAACEEEEIIIIOOOOOUUUUNYYaaaaaaceeeeiiiiooooouuuunyy"
DASHES = "‐‑‒–—―−"
SPACES = r"[\s\u0085\u00a0\u1680\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]+"


def fold(c: Column) -> Column:
    """Upper case without diacritics, dashes made '-', white space runs made one blank; null stays null."""
    x = F.translate(c, ACCENTED + DASHES, BASE + "-" * len(DASHES))
    # a decomposed letter keeps its base letter: the combining mark is removed
    x = F.regexp_replace(x, r"[\u0300-\u036f]", "")
    return F.trim(F.regexp_replace(F.upper(x), SPACES, " "))


def strip_space(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, f"^{SPACES}|{SPACES}$", "")


def py_fold(s: str) -> str:
    """The same for Arrow kernels, over any diacritic."""
    s = "".join(ch for ch in unicodedata.normalize("NFKD", s) if not unicodedata.combining(ch))
    s = re.sub(f"[{DASHES}]", "-", s)
    return re.sub(SPACES, " ", s).strip().upper()


_MOJIBAKE = re.compile("[ÂÃ][\u0080-¿ŒœŠšŸŽžƒˆ˜–-›€™]|â€.")


def unscramble(s: str) -> str:
    """Repairs UTF-8 read as a one-byte code page; anything else stays."""

    def one(m: re.Match) -> str:
        x = m.group(0)
        for code in ("cp1252", "latin-1"):
            try:
                return x.encode(code).decode("utf-8")
            except UnicodeError:
                pass
        return x

    return _MOJIBAKE.sub(one, s) if ("Ã" in s or "Â" in s or "â€" in s) else s
