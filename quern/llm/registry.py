"""The queries of this package and the SQL that says what they return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import op1_fingerprint, op2_revisits, op3_mixing, op4_url_rules, op5_licenses, op6_pii, op7_toxicity, op8_near_dedup, op9_decontaminate, op10_token_counts

_MODULES = {
    "op1_fingerprint": op1_fingerprint,
    "op2_revisits": op2_revisits,
    "op3_mixing": op3_mixing,
    "op4_url_rules": op4_url_rules,
    "op5_licenses": op5_licenses,
    "op6_pii": op6_pii,
    "op7_toxicity": op7_toxicity,
    "op8_near_dedup": op8_near_dedup,
    "op9_decontaminate": op9_decontaminate,
    "op10_token_counts": op10_token_counts,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: module.query for name, module in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: module.ORACLE_SQL for name, module in _MODULES.items() if getattr(module, "ORACLE_SQL", None)}
