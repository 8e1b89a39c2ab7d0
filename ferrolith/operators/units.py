"""Quantities recorded in different units: exact penalised changepoint search on the history of each source.

The history of a source (a file, in order of reading) is a series of log values. Recorded in another unit, a value is
shifted by the logarithm of a known factor, so each value is explained by a level per unit, and the search looks for the
segmentation, with one unit per segment, of least cost: sum of squared deviations of the log values from the level of
their unit (in units of its spread), what a value says of itself (a unit written beside it; lying on the steps in which
such a quantity is drawn), and a penalty for each change. The level of a source is estimated from its own values, each taken
to the known factor that brings it nearest to what such quantities usually measure, and shrunk towards that where the values
are few. With the levels apart by the known factors the optimum over all 2^(n-1) segmentations is found exactly by dynamic
programming in n * units^2 steps, without pruning. Level shifts are then reversed by the factor of the segment's unit.

A series is cut into pieces of PIECE values, each piece being its own task row, so that a source with a third of all rows
isn't one task's. The search stays exact: of each piece the least costs from every state before it to every state at its end
are found, these matrices are put together (least sums, FAN at a time, level by level), the best states at the ends of all
pieces follow from the whole, and each piece is then traced back between them.

Defined results: null values have no unit and stay null unless the text states the quantity; zero, negative and not finite
values stay unconverted (unit null); ties in the cost go to the unit named first; repeated rows are repeated values of the
series; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferrolith.session import checkpoint
from ferrolith.sources.tables import once

# Millimetres per unit.
FACTORS = {"mm": 1.0, "cm": 10.0, "m": 1000.0, "in": 25.4, "ft": 304.8}
UNITS = list(FACTORS)
# What spacings and lengths are drawn in. Range in mm, steps in mm when drawn metric and when drawn in inches.
RANGES = {"espacement_mm": (70.0, 640.0), "longueur_mm": (1400.0, 12600.0)}
STEPS = {"espacement_mm": {"metric": (25.0, 20.0, 10.0), "imperial": (12.7,)}, "longueur_mm": {"metric": (50.0,), "imperial": (76.2,)}}
PENALTY = 5.0  # for each change of unit along a history
SYSTEM_PENALTY = 9.0  # for a change between metric and imperial drawing
OFF_STEP, OFF_RANGE = 6.0, 40.0
STATED = 100.0  # against the unit that a callout writes: decisive
PIECE, FAN = 4000, 256
SHRINK = 20  # values that weigh as much as what is usual

_N = r"(\d+(?:[.,]\d+)?)"
# How callouts write a unit.
_UNIT = r"(mm|cm|centim\.|m(?![a-zA-Z])|po(?:uces?)?\b|in\b|\"|''|ft\b|pi\b|')?"


def parse_callout(raw: str | None) -> dict[str, tuple[float, str | None]]:
    """field -> (value, unit or None where none is written) of a callout such as '28-10M@4.5 lg 18 pi 9 po' or '15M @ 150 mm E.F.; L=5.10 m'.

    Feet with inches ('25' - 9"', '31-00', '18 pi 9 po') come in inches.
    """
    import re

    out: dict[str, tuple[float, str | None]] = {}
    if not raw:
        return out
    num = lambda x: float(x.replace(",", "."))
    names = {"po": "in", "pouce": "in", "pouces": "in", '"': "in", "''": "in", "in": "in", "centim.": "cm", "ft": "ft", "pi": "ft", "'": "ft"}
    s = raw.strip()
    if m := re.search(rf"(?:@|\besp\.)\s*{_N}\s*{_UNIT}", s):
        out["espacement_mm"] = (num(m[1]), names.get(m[2], m[2]))
        rest = s[m.end() :]
    else:
        # the size is '25M', '(25M)', 'barre 25' ...: what follows the first blank or ';' can state a length
        cut = re.search(r"[;\s]", re.sub(r"^(?:[A-Z]{3}\.:?\s*)", lambda x: "_" * len(x[0]), s))
        rest = s[cut.start() :] if cut else ""
    told = re.search(r"(?:\bL\s*=|\blg\.?|\blong\.?)\s*(.*)$", s)
    t = told[1] if told else rest
    if m := re.search(rf"(?<![\d.,-])(\d+)\s*(?:'(?!')|pi\b|ft\b)\s*-?\s*(\d+(?:\.\d+)?)\s*(?:\"|''|po\b|in\b)", t):
        out["longueur_mm"] = (12 * num(m[1]) + num(m[2]), "in")
    elif told and (m := re.match(rf"{_N}\s*{_UNIT}", t)):
        out["longueur_mm"] = (num(m[1]), names.get(m[2], m[2]))
    elif m := re.search(r"(?:^|[\s;])(\d{1,2})-(\d{2})(?=\s|;|$)", t):
        out["longueur_mm"] = (12 * num(m[1]) + num(m[2]), "in")
    elif not told and (m := re.search(rf"(?:^|[\s;])(\d+(?:[.,]\d+)?)\s*(mm|cm|m|po|in|\"|''|ft|pi|')(?=\s|;|$)", t)):
        out["longueur_mm"] = (num(m[1]), names.get(m[2], m[2]))
    return out


def _on_step(mm: np.ndarray, steps: tuple[float, ...], rough: np.ndarray) -> np.ndarray:
    """Whether values lie on a step; rough: half the last written digit, in mm."""
    ok = np.zeros(len(mm), bool)
    for s in steps:
        ok |= np.abs(mm - np.round(mm / s) * s) <= np.maximum(0.06, rough)
    return ok


# A state of the search is a unit in which the column is held and a system in which the drawing was made.
STATES = [(u, s) for s in ("metric", "imperial") for u in UNITS]
_CHANGE = np.array([[0.0 if a == b else (SYSTEM_PENALTY if a[1] != b[1] else 0.0) + (PENALTY if a[0] != b[0] else 0.0) for b in STATES] for a in STATES])


def usual(field: str) -> float:
    """Log of what such a quantity usually measures."""
    lo, hi = RANGES[field]
    return math.log(lo * hi) / 2


def costs(field: str, values: np.ndarray, told: list[tuple[float, str | None] | None], level: float | None = None) -> np.ndarray:
    """values x STATES: cost of each value under each state; told: value and unit of the callout, where it states the quantity; level: of the source, in log mm."""
    lo, hi = RANGES[field]
    level, spread = usual(field) if level is None else level, math.log(hi / lo) / 4
    out = np.zeros((len(values), len(STATES)))
    with np.errstate(divide="ignore", invalid="ignore"):
        logs = np.log(values)
    # digits written after the point bound the rounding of the value
    digits = np.array([len(f"{v:.4f}".rstrip("0").split(".")[1]) for v in values])
    for k, (u, s) in enumerate(STATES):
        f = FACTORS[u]
        mm = values * f
        # a column in metres holds 0.075 and may cut to two or three places
        rough = np.where(digits >= 2, 0.5 * f * 10.0 ** -digits.clip(2), 0.0)
        c = ((logs - (level - math.log(f))) / spread) ** 2 * 0.25
        c = c + np.where((mm < lo) | (mm > hi), OFF_RANGE, 0.0) + np.where(_on_step(mm, STEPS[field][s], rough), 0.0, OFF_STEP)
        if (u in ("in", "ft")) != (s == "imperial") and u != "mm":
            c = c + 3.0
        for i, t in enumerate(told):
            if t and t[1]:
                true = t[0] * FACTORS[t[1]]
                c[i] += 0.0 if abs(mm[i] - true) <= max(0.6, 0.01 * true) else STATED
        out[:, k] = c
    return out


def segment(cost: np.ndarray, change: np.ndarray = _CHANGE, entry: int | None = None, end: int | None = None) -> np.ndarray:
    """State per value of the segmentation of least cost: exact dynamic programming over all segmentations. entry, end: the state before the first value and that of the last, where they're given."""
    n, k = cost.shape
    best = cost[0] + (0.0 if entry is None else change[entry])
    back = np.zeros((n, k), np.int16)
    for i in range(1, n):
        step = best[:, None] + change
        back[i] = step.argmin(0)
        best = step[back[i], np.arange(k)] + cost[i]
    out = np.empty(n, np.int64)
    out[-1] = best.argmin() if end is None else end
    for i in range(n - 1, 0, -1):
        out[i - 1] = back[i, out[i]]
    return out


def least_sums(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of two cost matrices, sums for products and the least for sums."""
    return (a[:, :, None] + b[None]).min(1)


_STAY = np.where(np.eye(len(STATES), dtype=bool), 0.0, np.inf)  # of a piece without values


def passage(cost: np.ndarray, change: np.ndarray = _CHANGE) -> np.ndarray:
    """Least cost through a piece from each state before it to each state at its end."""
    out = _STAY
    for c in cost:
        out = least_sums(out, change) + c
    return out


def ends(matrices: list[np.ndarray], entry: int | None, end: int | None) -> list[tuple[int | None, int]]:
    """(state before, state at the end) of consecutive pieces on the least path through them."""
    best, back = (np.where(np.arange(len(STATES)) == entry, 0.0, np.inf) if entry is not None else np.zeros(len(STATES))), []
    for m in matrices:
        step = best[:, None] + m
        back.append(step.argmin(0))
        best = step.min(0)
    at, out = int(best.argmin()) if end is None else end, []
    for b in reversed(back):
        out.append((int(b[at]), at))
        at = int(b[at])
    return out[::-1]


def _prepared(field: str, value: np.ndarray, told: list, level: float | None) -> tuple[list[int], np.ndarray]:
    """Places of a history that tell of a unit, and their costs."""
    known = np.isfinite(value) & (value > 0)
    # a text without column value tells of the system too: it joins the series as a value in its own unit
    series = [i for i in range(len(value)) if known[i] or told[i]]
    if not series:
        return series, np.zeros((0, len(STATES)))
    v = np.array([value[i] if known[i] else told[i][0] for i in series])
    c = costs(field, v, [told[i] if known[i] else None for i in series], level)
    for r, i in enumerate(series):
        if not known[i]:  # its unit says nothing of the column's
            u = told[i][1]
            for s in ("metric", "imperial"):
                rows = [k for k, x in enumerate(STATES) if x[1] == s]
                own = min(c[r, k] for k in rows if u is None or STATES[k][0] == u)
                c[r, rows] = min(own, 6.0)
    return series, c


def _series(field: str, value: np.ndarray, told: list, level: float | None = None, entry: int | None = None, end: int | None = None) -> tuple[list[str | None], list[float | None]]:
    """Unit of each value of a history and the quantity in mm, that of the callout where the column has none."""
    known = np.isfinite(value) & (value > 0)
    unit: list[str | None] = [None] * len(value)
    mm: list[float | None] = [None] * len(value)
    series, c = _prepared(field, value, told, level)
    if not series:
        return unit, mm
    states = segment(c, _CHANGE, entry, end)
    for r, i in enumerate(series):
        u, s = STATES[states[r]]
        if known[i]:
            unit[i] = u
            true = told[i] and told[i][1] and told[i][0] * FACTORS[told[i][1]]
            x = value[i] * FACTORS[u]
            mm[i] = true if true and abs(x - true) <= max(0.6, 0.01 * true) else snapped(field, x, value[i], u, s)
        else:
            n, tu = told[i]
            if tu is None:
                lo, hi = RANGES[field]
                order = ("mm", "in", "cm", "m", "ft") if s == "metric" else ("in", "mm", "ft", "cm", "m")
                fit = [x for x in order if lo <= n * FACTORS[x] <= hi]
                good = [x for x in fit if _on_step(np.array([n * FACTORS[x]]), STEPS[field]["imperial" if x in ("in", "ft") else s], np.array([0.0]))[0]]
                tu = (good or fit or [None])[0]
            mm[i] = n * FACTORS[tu] if tu else None
    return unit, mm


def snapped(field: str, mm: float, value: float, unit: str, system: str) -> float:
    """mm, taken to the step it was rounded from where the column cut digits ('0.07' m of 75 mm)."""
    digits = len(f"{value:.4f}".rstrip("0").split(".")[1])
    if unit in ("m", "ft") and digits >= 2 and not _on_step(np.array([mm]), STEPS[field][system], np.array([0.0]))[0]:
        rough = 0.5 * FACTORS[unit] * 10.0**-digits
        near = [round(mm / s) * s for s in STEPS[field][system][:1]]
        near = [x for x in near if 0 < abs(x - mm) <= rough + 1e-9]
        if near:
            return near[0]
    return mm


def histories(rows: DataFrame, source: str, order: list[str], field: str, key: str, text: str) -> DataFrame:
    """rows of several sources with a quantity `field` and callouts `text`: key, value, unit of the column, mm."""
    x = rows.select(source, key, *order, F.col(field).cast("double").alias("value"), F.col(text).alias("raw")).filter("value is not null or raw is not null")
    # numbers along each source, without one task for a source: ranges of the whole order are numbered by themselves, and begin
    # where the ranges before them end
    x = checkpoint(x.repartitionByRange(source, *order, key).withColumn("range", F.spark_partition_id()))
    before = F.sum("c").over(Window.partitionBy(source).orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    starts = x.groupBy(source, "range").agg(F.count("*").alias("c")).select(source, "range", F.coalesce(before, F.lit(0)).alias("start"))
    own = F.row_number().over(Window.partitionBy(source, "range").orderBy(*order, key))
    x = x.withColumn("own", own).join(starts, [source, "range"]).withColumn("n", F.col("start") + F.col("own") - 1).drop("own", "start", "range")
    x = x.withColumn("piece", F.floor(F.col("n") / PIECE).cast("long"))
    kind, skind = dict(rows.dtypes)[key], dict(rows.dtypes)[source]
    about = checkpoint(_levels(x, source, field))  # a row for each source
    h = x.groupBy(source, "piece").agg(F.array_sort(F.collect_list(F.struct("n", F.col(key).alias("key"), "value", "raw"))).alias("h")).join(about, source, "left")
    cut_up = not about.filter("last > 0").isEmpty()
    h = checkpoint(h) if cut_up else h

    def costed(r) -> np.ndarray:
        value = np.array([np.nan if y["value"] is None else y["value"] for y in r["h"]], float)
        return _prepared(field, value, [parse_callout(y["raw"]).get(field) for y in r["h"]], r["level"])[1]

    def matrices(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in frames:
            m = [passage(costed({"h": y, "level": None if v != v else v})).ravel().tolist() for y, v in zip(p["h"], p["level"])]
            yield pd.DataFrame({"source": p[source], "at": p["piece"], "m": pd.Series(m, index=p.index, dtype=object)})

    long = h.filter("last > 0").select(source, "piece", "h", "level").mapInPandas(matrices, f"source {skind}, at long, m array<double>")
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        none = lambda v: None if v != v else int(v)
        for p in frames:
            ids, vals, units, mms = [], [], [], []
            for y, v, a, b in zip(p["h"], p["level"], p["entry"], p["end"]):
                value = np.array([np.nan if r["value"] is None else r["value"] for r in y], float)
                told = [parse_callout(r["raw"]).get(field) for r in y]
                unit, mm = _series(field, value, told, None if v != v else v, none(a), none(b))
                for r, w, u, q in zip(y, value, unit, mm):
                    if u is not None or q is not None:
                        ids.append(r["key"])
                        vals.append(None if w != w else w)
                        units.append(u)
                        mms.append(q)
            yield pd.DataFrame({key: pd.Series(ids, dtype=object), "value": pd.Series(vals, dtype=float), "unit": pd.Series(units, dtype=object), "mm": pd.Series(mms, dtype=float)})

    free = F.lit(None).cast("double")
    out = h.filter("coalesce(last, 0) = 0").select("h", "level", free.alias("entry"), free.alias("end"))
    if cut_up:
        bounds = _bounds(long).withColumnRenamed("source", source).withColumnRenamed("at", "piece")
        out = out.unionByName(h.filter("last > 0").join(bounds, [source, "piece"]).select("h", "level", F.col("entry").cast("double").alias("entry"), F.col("end").cast("double").alias("end")))
    return out.mapInPandas(run, f"`{key}` {kind}, value double, unit string, mm double")


def _levels(x: DataFrame, source: str, field: str) -> DataFrame:
    """source, level, last: the log of what the source's values measure, each by the factor that brings it nearest to what is usual, shrunk towards that; its last piece."""
    mean = usual(field)
    off = F.transform(F.array(*[F.lit(math.log(f)) for f in FACTORS.values()]), lambda f: F.struct(F.abs(F.log("value") + f - mean).alias("d"), (F.log("value") + f - mean).alias("r")))
    near = F.when((F.col("value") > 0) & (F.col("value") < float("inf")), F.array_min(off)["r"])
    g = x.groupBy(source).agg(F.percentile_approx(near, 0.5, 1000).alias("r"), F.count(near).alias("c"), F.max("piece").alias("last"))
    return g.select(source, "last", (F.lit(mean) + F.coalesce("r", F.lit(0.0)) * F.col("c") / (F.col("c") + SHRINK)).alias("level"))


def _bounds(matrices: DataFrame) -> DataFrame:
    """matrices (source, at, m): source, at, entry, end of the pieces of each source on its least path; entry is null for the first.

    FAN neighbours are put together at a time, level by level, until each source has one block of them; the ends are found there and
    handed down the levels again.
    """
    kind, n = dict(matrices.dtypes)["source"], len(STATES)
    of = lambda m: np.array([np.nan if v is None else v for v in m], float).reshape(n, n)
    levels = [checkpoint(matrices)]

    def blocks(df: DataFrame) -> DataFrame:
        return df.groupBy("source", F.floor(F.col("at") / FAN).cast("long").alias("block")).agg(F.array_sort(F.collect_list(F.struct("at", "m"))).alias("ms"))

    def up(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in frames:
            out = []
            for ms in p["ms"]:
                t = _STAY
                for r in ms:
                    t = least_sums(t, of(r["m"]))
                out.append(t.ravel().tolist())
            yield pd.DataFrame({"source": p["source"], "at": p["block"], "m": pd.Series(out, index=p.index, dtype=object)})

    def down(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        none = lambda v: None if v is None or v != v else int(v)
        for p in frames:
            rows = []
            for g, ms, a, b in zip(p["source"], p["ms"], p["entry"], p["end"]):
                for r, (x, y) in zip(ms, ends([of(r["m"]) for r in ms], none(a), none(b))):
                    rows.append((g, r["at"], None if r["at"] == 0 else x, y))
            yield pd.DataFrame(rows, columns=["source", "at", "entry", "end"]).astype({"entry": "Int64"})

    while not levels[-1].filter(F.col("at") >= FAN).isEmpty():
        levels.append(checkpoint(blocks(levels[-1]).mapInPandas(up, f"source {kind}, at long, m array<double>")))
    out = None
    for level in reversed(levels):
        b = blocks(level)
        b = b.withColumn("entry", F.lit(None).cast("double")).withColumn("end", F.lit(None).cast("double")) if out is None else b.join(out.select("source", F.col("at").alias("block"), F.col("entry").cast("double").alias("entry"), F.col("end").cast("double").alias("end")), ["source", "block"])
        out = checkpoint(b.select("source", "ms", "entry", "end").mapInPandas(down, f"source {kind}, at long, entry long, end long"))
    return out


FIELDS = ("espacement_mm", "longueur_mm")


def in_millimetres(bars: DataFrame) -> DataFrame:
    """bar_id, field, value (as held), unit (of the column; null where the column has none), mm. An id delivered twice counts once."""
    b = once(bars.select("bar_id", "fichier", "read_at", "raw", *FIELDS, *(["loaded_at"] if "loaded_at" in bars.columns else [])), "bar_id").filter("bar_id is not null")
    b = b.withColumn("fichier", F.coalesce("fichier", F.lit("")))
    out = None
    for f in FIELDS:
        x = histories(b, "fichier", ["read_at"], f, "bar_id", "raw").withColumn("field", F.lit(f))
        out = x if out is None else out.unionByName(x)
    return out


def found(bars: DataFrame) -> DataFrame:
    """bar_id, field, mm_tenths of each stated quantity that the column doesn't hold in millimetres."""
    q = in_millimetres(bars).filter("mm is not null and (unit is null or unit != 'mm')")
    return q.select("bar_id", "field", F.round(F.col("mm") * 10).cast("long").alias("mm_tenths"))


def report(bars: DataFrame) -> DataFrame:
    """Values per field and unit of the column ('text': stated by the callout only)."""
    q = in_millimetres(bars).filter("mm is not null")
    return q.groupBy("field", F.coalesce("unit", F.lit("text")).alias("unit")).agg(F.count("*").alias("n"), F.round(F.min("mm"), 1).alias("least_mm"), F.round(F.max("mm"), 1).alias("most_mm"))
