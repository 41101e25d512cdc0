"""Results out: JSON objects and lines of text."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.values import field, shown_number


def plain(value: object) -> object:
    """A cell as JSON has it; whole numbers lose their point."""
    if isinstance(value, float):
        return int(value) if math.isfinite(value) and value == int(value) else value if math.isfinite(value) else None
    if value is None or isinstance(value, (bool, int, str)):
        return value
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if hasattr(value, "toPython"):
        return plain(value.toPython())
    return str(value)


def documents(df: DataFrame):
    """Rows as dictionaries without missing fields, streamed by partition."""
    for row in df.toLocalIterator():
        yield {k: plain(v) for k, v in zip(df.columns, row, strict=True) if v is not None}


def save(df: DataFrame, path: str) -> None:
    """Rows as JSON Lines files, written by the tasks: for results of any size."""
    df.select(F.to_json(F.struct(*[field(c) for c in df.columns])).alias("value")).write.text(path)


def as_json(result) -> str:
    """The whole result as one text, which the driver must hold: cut it to a page, or ``save`` it."""
    if not result.ok:
        return json.dumps({"ok": False, "err_code": result.code, "err_msg": result.message}, ensure_ascii=False)
    docs = list(documents(result.df)) if result.df is not None else []
    out = {"ok": True, "count": result.count if result.df is None else len(docs)}
    if result.info:
        out["info"] = result.info
    return json.dumps(out | {"docs": docs}, ensure_ascii=False)


def _shown(value: object) -> str:
    if isinstance(value, str):
        return f'"{value}"'
    if isinstance(value, bool):
        return str(value).lower()
    return shown_number(float(value)) if isinstance(value, (int, float)) else str(value)


def as_text(result) -> str:
    if not result.ok:
        return f'err {result.code} "{result.message}"'
    docs = list(documents(result.df)) if result.df is not None else []
    if not docs:
        return f"ok {result.info or f'{result.count} documents'}"
    lines = [f"ok {len(docs)} document{'s' * (len(docs) != 1)}"]
    return "\n".join(lines + ["{ " + ", ".join(f"{k}: {_shown(v)}" for k, v in d.items()) + " }" for d in docs])
