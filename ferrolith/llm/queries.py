"""Queries of the training-data operators, each over its whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ferrolith.llm import canonical, leakage, linkage, packing, represent, residue
from ferrolith.sources.tables import table as t


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": lambda s, d: represent.found(t(s, d, "supports")),
        "p1_survivors": lambda s, d: represent.survivors(t(s, d, "supports")),
        "p2_found": lambda s, d: linkage.found(t(s, d, "records_plan"), t(s, d, "records_atelier")),
        "p2_confidence": lambda s, d: linkage.link(t(s, d, "records_plan"), t(s, d, "records_atelier")),
        "p4_found": lambda s, d: canonical.found(t(s, d, "bars"), t(s, d, "ref_values")),
        "p4_report": lambda s, d: canonical.report(t(s, d, "bars"), t(s, d, "ref_values")),
        "p6_packing": lambda s, d: packing.packing(t(s, d, "documents"), t(s, d, "pack_sizes")),
        "p6_report": lambda s, d: packing.report(t(s, d, "documents"), t(s, d, "pack_sizes")),
        "p7_found": lambda s, d: leakage.found(t(s, d, "documents"), t(s, d, "eval_items")),
        "p7_report": lambda s, d: leakage.report(t(s, d, "documents"), t(s, d, "eval_items")),
        "p7_cleaned": lambda s, d: leakage.cleaned(t(s, d, "documents"), t(s, d, "eval_items")),
        "p8_found": lambda s, d: residue.found(t(s, d, "documents")),
        "p8_report": lambda s, d: residue.report(t(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    """None: fuzzy matching, automata, grammars and packing are beyond SQL; tests/llm holds them against brute force."""
    return {}
