"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib

#: operator number -> (module, query)
OPERATORS = {
    1: ("line_dedup", "op1_line_dedup"),
    2: ("packing", "op2_packing"),
    3: ("secret_scan", "op3_secret_scan"),
    4: ("quality", "op4_quality_rules"),
    5: ("decontamination", "op5_decontamination"),
    6: ("simhash", "op6_simhash"),
    7: ("html_text", "op7_html_text"),
    8: ("language_id", "op8_language_id"),
    9: ("lm_scoring", "op9_lm_scoring"),
    10: ("sharding", "op10_sharding"),
    11: ("spelling", "op11_spelling_variants"),
    12: ("hard_negatives", "op12_hard_negatives"),
    13: ("personal_data", "op13_personal_data"),
}


def part(n: int) -> tuple[dict, dict[str, str]]:
    """The query of operator n and its SQL, if it has one."""
    module, name = OPERATORS[n]
    found = importlib.import_module(f"{__package__}.{module}")
    return {name: getattr(found, name)}, found.ORACLE


def queries() -> dict:
    return {name: f for n in sorted(OPERATORS) for name, f in part(n)[0].items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for n in sorted(OPERATORS) for name, sql in part(n)[1].items()}
