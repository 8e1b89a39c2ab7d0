"""Differences between two copies of a table by characteristic-polynomial set reconciliation.

Each row becomes an element of the field of integers modulo 2^61 - 1: a hash of its key and of its normalised fields. The
elements fall into buckets by the hash of the key, BUCKET rows of a side to a bucket on average; keys and elements, nothing
else of the rows, are partitioned by bucket once, which also drops redeliveries. The characteristic polynomial of a bucket's
set, the product of (z - element), is evaluated at agreed points for both sides. The quotient of both values is the quotient
of the polynomials of what is on one side only, as the common factors cancel. It is interpolated as a rational function whose
degrees are bounded by d, and checked at further points; where the check fails, d is doubled, until it holds. The roots, found
by testing the bucket's own elements, are the differing rows. A bucket with more than LAST differences is halved by one more
bit of its elements and each half reconciled by itself, so that no bucket is ever compared in another way. Only rows with
differing elements are then fetched, and their fields compared.

No bucket is hot, as buckets are by hash of the key and a key delivered again counts once; rows without a key are counted by
what they hold and bucketed by that.

Defined results: rows without a key are reported under the id '' and only as missing, once for each different content that one
side has more often than the other; a null field differs from any value but null (an empty list is as good as null); nan equals
nan; empty tables differ in all rows of the other side.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrolith.session import checkpoint
from ferrolith.sources.tables import once

P = (1 << 61) - 1
_M31, _M30 = np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)
BUCKET = 64  # rows of a side to a bucket
FIRST, LAST = 4, 64  # the first bound on the degrees, and the one beyond which a bucket is halved
BROADCAST = 32_000_000  # bytes of differing keys up to which they're sent to every executor
CHECKS = 2  # points beyond those that the interpolation needs


def reduce61(x: np.ndarray) -> np.ndarray:
    x = (x & np.uint64(P)) + (x >> np.uint64(61))
    return np.where(x >= np.uint64(P), x - np.uint64(P), x)


def mul61(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo 2^61 - 1, elementwise."""
    au, al, bu, bl = a >> np.uint64(31), a & _M31, b >> np.uint64(31), b & _M31
    mid = al * bu + au * bl
    return reduce61(reduce61(au * bu * np.uint64(2) + (mid >> np.uint64(30)) + ((mid & _M30) << np.uint64(31))) + reduce61(al * bl))


@cache
def points(n: int) -> np.ndarray:
    """Agreed points of evaluation."""
    return np.array([xxhash.xxh3_64_intdigest(f"point {i}") % P for i in range(n)], np.uint64)


def element(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) % P


# ---- polynomials over the field, lists of coefficients from the constant on ----


def _trim(a: list[int]) -> list[int]:
    while a and a[-1] == 0:
        a.pop()
    return a


def _mod(a: list[int], b: list[int]) -> list[int]:
    a, inv = list(a), pow(b[-1], -1, P)
    while len(a) >= len(b):
        q = a[-1] * inv % P
        if q:
            off = len(a) - len(b)
            for i, y in enumerate(b):
                a[off + i] = (a[off + i] - q * y) % P
        a.pop()
    return _trim(a)


def _divide(a: list[int], b: list[int]) -> list[int]:
    a, inv, out = list(a), pow(b[-1], -1, P), [0] * (len(a) - len(b) + 1)
    for k in range(len(out) - 1, -1, -1):
        q = out[k] = a[k + len(b) - 1] * inv % P
        for i, y in enumerate(b):
            a[k + i] = (a[k + i] - q * y) % P
    return out


def evaluate(a: Sequence[int], z: np.ndarray) -> np.ndarray:
    out = np.zeros(len(z), np.uint64)
    for c in reversed(a):
        out = reduce61(mul61(out, z) + np.uint64(c))
    return out


def _solve(rows: list[list[int]], n: int) -> list[int] | None:
    """Some solution of the linear system (last column: right side), free unknowns 0; None without any."""
    pivots, r = [], 0
    for c in range(n):
        p = next((i for i in range(r, len(rows)) if rows[i][c]), None)
        if p is None:
            continue
        rows[r], rows[p] = rows[p], rows[r]
        inv = pow(rows[r][c], -1, P)
        rows[r] = [x * inv % P for x in rows[r]]
        for i in range(len(rows)):
            if i != r and (f := rows[i][c]):
                rows[i] = [(x - f * y) % P for x, y in zip(rows[i], rows[r])]
        pivots.append(c)
        r += 1
    if any(row[n] for row in rows[r:]):
        return None
    out = [0] * n
    for i, c in enumerate(pivots):
        out[c] = rows[i][n]
    return out


def interpolate(ratio: Sequence[int], z: Sequence[int], more: int, bound: int) -> tuple[list[int], list[int]] | None:
    """Numerator and denominator, without common factor, of the monic rational function through ratio(z); more: rows of the first side
    beyond those of the second; bound on the degrees together. None if it doesn't hold at the check points."""
    bound += (bound + more) % 2  # the degrees' sum and difference have one parity
    a, b = (bound + more) // 2, (bound - more) // 2
    if a < 0 or b < 0 or len(z) < a + b + CHECKS:
        return None
    rows = []
    for f, x in list(zip(ratio, z))[: a + b]:
        row, y = [], 1
        for _ in range(a):
            row.append(y)
            y = y * x % P
        top, y = y, 1
        for _ in range(b):
            row.append(-f * y % P)
            y = y * x % P
        row.append((f * y - top) % P)
        rows.append(row)
    s = _solve(rows, a + b)
    if s is None:
        return None
    num, den = [*s[:a], 1], [*s[a:], 1]
    for f, x in list(zip(ratio, z))[a + b :]:
        n = d = 0
        for c in reversed(num):
            n = (n * x + c) % P
        for c in reversed(den):
            d = (d * x + c) % P
        if n != f * d % P:
            return None
    g, h = num, den
    while h:
        g, h = h, _mod(g, h)
    inv = pow(g[-1], -1, P)
    g = [x * inv % P for x in g]
    return _divide(num, g), _divide(den, g)


def products(e: np.ndarray, start: np.ndarray, size: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Runs x points: the product of (z - element) over each run of elements, multiplied up pairwise; 1 for an empty run."""
    vals = np.where(z[None, :] >= e[:, None], z[None, :] - e[:, None], z[None, :] + np.uint64(P) - e[:, None])
    out = np.ones((len(start), len(z)), np.uint64)
    full = np.flatnonzero(size)
    start, left = start[full], size[full]
    while (left > 1).any():
        half = (left + 1) // 2
        one = np.repeat(start - np.r_[0, np.cumsum(half)[:-1]] * 2, half) + 2 * np.arange(half.sum())
        two = one + 1 < np.repeat(start + left, half)
        new = vals[one]
        new[two] = mul61(new[two], vals[one[two] + 1])
        vals, start, left = new, np.r_[0, np.cumsum(half)[:-1]], half
    if len(full):
        out[full] = vals[start]
    return out


def _whole(e: np.ndarray, z: np.ndarray) -> np.ndarray:
    return products(e, np.zeros(1, np.int64), np.array([len(e)]), z)[0]


def recover(a: np.ndarray, b: np.ndarray, bit: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Of two sets of elements: which of a aren't in b, and which of b aren't in a. Doubles the degree bound until it's verified; beyond LAST the sets are halved."""
    bound, ratio = FIRST, []
    while bound <= LAST:
        z = points(bound + 1 + CHECKS)
        new = z[len(ratio) :]
        ratio += [int(u) * pow(int(v), -1, P) % P for u, v in zip(_whole(a, new), _whole(b, new))]
        got = interpolate(ratio, [int(x) for x in z], len(a) - len(b), bound)
        if got is not None:
            hit = evaluate(got[0], a) == 0, evaluate(got[1], b) == 0
            if hit[0].sum() == len(got[0]) - 1 and hit[1].sum() == len(got[1]) - 1:
                return hit
        bound *= 2
    u, v = (a >> np.uint64(bit)) & np.uint64(1) == 1, (b >> np.uint64(bit)) & np.uint64(1) == 1
    out = np.zeros(len(a), bool), np.zeros(len(b), bool)
    for x, y in ((u, v), (~u, ~v)):
        out[0][x], out[1][y] = recover(a[x], b[y], bit + 1)
    return out


# ---- on tables ----


def _buckets(p: pd.DataFrame) -> pd.DataFrame:
    """Differing rows of whole buckets, sorted by bucket and side."""
    b, s, e = p["bucket"].to_numpy(), p["side"].to_numpy(), p["element"].to_numpy().astype(np.uint64)
    first = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
    last = np.r_[first[1:], len(b)]
    turn = first + np.add.reduceat(s == 0, first)  # where the second side begins
    z = points(FIRST + 1 + CHECKS)
    same = (products(e, first, turn - first, z) == products(e, turn, last - turn, z)).all(1) & (turn - first == last - turn)
    hit = np.zeros(len(p), bool)
    for i in np.flatnonzero(~same):
        x, y, w = first[i], turn[i], last[i]
        hit[x:y], hit[y:w] = recover(e[x:y], e[y:w])
    return p.loc[hit, ["side", "key"]]


def _reconciled(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: pd.DataFrame | None = None  # the rows of the last bucket, which the next batch may continue
    for p in parts:
        p = p if held is None else pd.concat([held, p], ignore_index=True)
        if not len(p):
            continue
        cut = int(np.searchsorted(p["bucket"].to_numpy(), p["bucket"].iat[-1]))
        held = p.iloc[cut:]
        if cut:
            yield _buckets(p.iloc[:cut].reset_index(drop=True))
    if held is not None and len(held):
        yield _buckets(held.reset_index(drop=True))


def differing(a: DataFrame, b: DataFrame, buckets: int) -> DataFrame:
    """a and b: key string, element long, at (time of delivery; of a key the first counts): side (0, 1) and key of what one side has and the other hasn't.

    One shuffle, of keys and elements only: the window that drops redeliveries asks for no other partitioning than that by bucket,
    and leaves each partition sorted.
    """
    rows = a.withColumn("side", F.lit(0)).unionByName(b.withColumn("side", F.lit(1)))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets))).repartition("bucket")
    w = Window.partitionBy("bucket", "side", "key").orderBy(F.col("at").asc_nulls_last())
    rows = rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select("bucket", "side", "key", "element")
    return rows.sortWithinPartitions("bucket", "side").mapInPandas(_reconciled, "side int, key string")  # sorted so already: no further sort


# ---- records ----

AMOUNT = 0.01  # mm that say nothing
PLAIN = ["source", "project", "fichier", "feuillet", "type_element", "element"]
FIELDS = [*PLAIN, "page", "x", "y", "armature"]


def _compose(s: pd.Series) -> pd.Series:
    import unicodedata

    return s.map(lambda v: v if v is None or v.isascii() else unicodedata.normalize("NFC", v))


def normal_form(records: DataFrame) -> DataFrame:
    """id and fields in the form in which they are compared: strings composed and without white space at the ends, amounts as they are, bars sorted, an empty list null."""
    from pyspark.sql.types import StringType

    from ferrolith.functions.text import strip_space

    composed = F.pandas_udf(_compose, StringType())
    text = strip_space
    bar = lambda b: F.struct(text(b["repere"]).alias("repere"), text(b["diametre"]).alias("diametre"), b["quantite"].alias("quantite"), b["espacement_mm"].alias("espacement_mm"), b["longueur_mm"].alias("longueur_mm"))
    strings = F.to_json(F.struct(*[F.col(c) for c in PLAIN], F.transform("armature", lambda b: F.struct(b["repere"].alias("r"), b["diametre"].alias("d"))).alias("bars")))
    shape = "struct<" + ",".join(f"{c}:string" for c in PLAIN) + ",bars:array<struct<r:string,d:string>>>"
    x = records.withColumn("_s", F.from_json(composed(strings), shape))
    bars = F.transform("armature", lambda b, i: b.withField("repere", F.element_at(F.col("_s.bars"), i + 1)["r"]).withField("diametre", F.element_at(F.col("_s.bars"), i + 1)["d"]))
    order = F.array_sort(F.transform(bars, bar))
    return x.select(
        "id", *[text(F.col(f"_s.{c}")).alias(c) for c in PLAIN], "page",
        F.round("x", 1).alias("x"), F.round("y", 1).alias("y"), F.when(F.size("armature") > 0, order).alias("armature"),
    )


# White space of any kind.
WHITE = " \t\n\x0b\f\r\u0085\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200C))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
_NULL, _NEXT, _NO_KEY = "\u0001", "\u0002", "\u0000"


def _hashed(records: DataFrame) -> DataFrame:
    """key, element, at of raw rows. Amounts count in hundredths: what rounding separates wrongly, or an order of bars that composition changes, is fetched and found
    equal; what differs by AMOUNT or more is never hashed alike. Rows without a key: one for each different content, with its number."""
    from pyspark.sql.types import StringType

    q = lambda c: F.floor(c / AMOUNT + 0.5)
    text = lambda c: F.btrim(c, F.lit(WHITE))
    said = lambda c: F.coalesce(c.cast("string"), F.lit(_NULL))
    bar = lambda b: F.concat_ws("|", *map(said, (text(b["repere"]), text(b["diametre"]), b["quantite"], q(b["espacement_mm"]), q(b["longueur_mm"]))))
    bars = F.array_join(F.array_sort(F.transform(F.coalesce("armature", F.array().cast(dict(records.dtypes)["armature"])), bar)), _NEXT)
    tenth = lambda c: F.floor(F.col(c) * 10 + 0.5)
    line = F.concat_ws(_NEXT, said(F.col("id")), *[said(text(F.col(c))) for c in PLAIN], said(F.col("page")), said(tenth("x")), said(tenth("y")), bars)
    x = records.select("id", (F.col("loaded_at") if "loaded_at" in records.columns else F.lit(None)).cast("timestamp").alias("at"), line.alias("line"))
    # below U+0300 every text is composed already
    composed = F.pandas_udf(_compose, StringType())(F.when(F.col("line").rlike("[^\\x{0}-\\x{2ff}]"), F.col("line")))
    x = x.select("id", "at", F.pmod(F.xxhash64(F.coalesce(composed, F.col("line"))), F.lit(P)).alias("element"))
    keyed = x.filter("id is not null").select(F.col("id").alias("key"), "element", "at")
    bare = x.filter("id is null").groupBy("element").agg(F.count("*").alias("n")).select(F.concat(F.lit(_NO_KEY), F.concat_ws("/", "element", "n")).alias("key"))
    return keyed.unionByName(bare.select("key", F.pmod(F.xxhash64("key"), F.lit(P)).alias("element"), F.lit(None).cast("timestamp").alias("at")))


def _bars_differ(a: Column, b: Column) -> Column:
    same = lambda u, v: (u.isNull() & v.isNull()) | F.coalesce(F.abs(u - v) < AMOUNT, F.lit(False))
    one = F.forall(
        F.zip_with(a, b, lambda u, v: u["repere"].eqNullSafe(v["repere"]) & u["diametre"].eqNullSafe(v["diametre"]) & u["quantite"].eqNullSafe(v["quantite"]) & same(u["espacement_mm"], v["espacement_mm"]) & same(u["longueur_mm"], v["longueur_mm"])),
        lambda z: z,
    )
    return F.when(a.isNull() & b.isNull(), False).when(a.isNull() | b.isNull() | (F.size(a) != F.size(b)), True).otherwise(~one)


def _tenths_differ(a: Column, b: Column) -> Column:
    return F.when(a.isNull() & b.isNull(), False).when(a.isNull() | b.isNull(), True).otherwise(~F.coalesce((F.isnan(a) & F.isnan(b)) | (F.abs(a - b) < 0.05), F.lit(False)))


def compare(records: DataFrame, mirror: DataFrame, buckets: int | None = None) -> DataFrame:
    """id, difference: 'missing_in_mirror', 'missing_in_records' or the name of a field that states something else.

    An id delivered again counts once. buckets: about the rows of the larger side / BUCKET; taken from the tables if not given.
    """
    if buckets is None:
        buckets = max(1, max(records.count(), mirror.count()) // BUCKET)
    lines = checkpoint(differing(_hashed(records), _hashed(mirror), buckets))
    # rows without a key: contents that one side has more often
    bare = lines.filter(F.col("key").startswith(_NO_KEY)).select("side", F.split(F.substring("key", 2, 100), "/").alias("k"))
    side = lambda n: F.coalesce(F.max(F.when(F.col("side") == n, F.col("k")[1].cast("long"))), F.lit(0))
    bare = bare.groupBy(F.col("k")[0].alias("element")).agg((side(0) > side(1)).alias("more"))
    bare = bare.select(F.lit("").alias("id"), F.when(F.col("more"), "missing_in_mirror").otherwise("missing_in_records").alias("difference"))
    lines = lines.filter(~F.col("key").startswith(_NO_KEY))
    size = lines.agg(F.coalesce(F.sum(F.octet_length("key") + 64), F.lit(0))).first()[0]

    def fetched(rows: DataFrame, n: int) -> DataFrame:
        keys = lines.filter(F.col("side") == n).select(F.col("key").alias("id"))
        return normal_form(once(rows.join(F.broadcast(keys) if size <= BROADCAST else keys, "id", "left_semi"), "id"))

    left, right = fetched(records, 0), fetched(mirror, 1)
    l, r = left.alias("l"), right.alias("r")  # noqa: E741
    both = l.join(r, F.col("l.id") == F.col("r.id"), "full")
    diffs = [F.when(F.col("r.id").isNull(), F.lit("missing_in_mirror")), F.when(F.col("l.id").isNull(), F.lit("missing_in_records"))]
    here = F.col("l.id").isNotNull() & F.col("r.id").isNotNull()
    for c in FIELDS:
        u, v = F.col(f"l.{c}"), F.col(f"r.{c}")
        d = _bars_differ(u, v) if c == "armature" else _tenths_differ(u, v) if c in ("x", "y") else ~u.eqNullSafe(v)
        diffs.append(F.when(here & d, F.lit(c)))
    x = both.select(F.coalesce("l.id", "r.id").alias("id"), F.explode(F.array_compact(F.array(*diffs))).alias("difference"))
    return x.unionByName(bare)


def found(plan: DataFrame, atelier: DataFrame, mirror: DataFrame) -> DataFrame:
    cols = ["id", *FIELDS, "loaded_at"]
    return compare(plan.select(*cols).unionByName(atelier.select(*cols)), mirror.select(*cols))
