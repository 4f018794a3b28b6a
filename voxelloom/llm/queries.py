"""The queries of this subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

import importlib

_MODULES = ("op1_mcd", "op2_dac", "op3_parity", "op4_license", "op5_decontam", "op6_substring", "op7_bpe", "op8_kdtree", "op9_linedist", "op10_url_filter")


def queries() -> dict:
    out = {}
    for name in _MODULES:
        out[name] = getattr(importlib.import_module(f"{__package__}.{name}"), name)
    return out


def oracle_sql() -> dict[str, str]:
    return {name: sql for name in _MODULES if (sql := getattr(importlib.import_module(f"{__package__}.{name}"), "ORACLE", None))}
