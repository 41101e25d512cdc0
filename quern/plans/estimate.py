"""What a condition is expected to keep, from the statistics that ``analyze`` left.

A field's values are taken to be spread evenly between its least and greatest
one, and fields to be independent of one another.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Row

from .syntax import Both, Compare, Condition, Either, Exists, Member, Not

#: For conditions of which the statistics say nothing.
UNKNOWN = 1 / 3


def share(c: Condition | None, fields: Mapping[str, Row]) -> float:
    """The expected share of rows, from 0 to 1; ``fields`` are the rows of a profile by field."""
    match c:
        case None:
            return 1.0
        case Both(a, b):
            return share(a, fields) * share(b, fields)
        case Either(a, b):
            x, y = share(a, fields), share(b, fields)
            return x + y - x * y
        case Not(of):
            return 1.0 - share(of, fields)
        case Exists(name):
            return _present(fields.get(name))
        case Member(name, values, wanted):
            found = fields.get(name)
            hit = min(1.0, len(set(values)) * _one(found))
            return _present(found) * (hit if wanted else 1.0 - hit)
        case Compare(name, op, value):
            return _present(fields.get(name)) * _compared(fields.get(name), op, value)
    return UNKNOWN


def _present(found: Row | None) -> float:
    if found is None:
        return 0.0
    return found["present"] / max(1, found["present"] + found["missing"])


def _one(found: Row | None) -> float:
    return 1.0 / max(1, found["distinct"]) if found else UNKNOWN


def _compared(found: Row | None, op: str, value: object) -> float:
    if op in ("$bg", "$kc"):
        return _one(found) if op == "$bg" else 1.0 - _one(found)
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    if found is None or not number or found["low"] is None or op == "$xau":
        return UNKNOWN
    wide = found["high"] - found["low"]
    below = min(1.0, max(0.0, (value - found["low"]) / wide if wide else float(value > found["low"])))
    return below if op in ("$lh", "$lhb") else 1.0 - below


def cheapest_first(c: Condition | None, fields: Mapping[str, Row]) -> Condition | None:
    """The same condition with the parts of each ``$vand`` in order of what they keep, so that most rows fail early."""
    match c:
        case Both():
            parts = sorted((cheapest_first(p, fields) for p in _parts(c)), key=lambda p: share(p, fields))
            out = parts[0]
            for p in parts[1:]:
                out = Both(out, p)
            return out
        case Either(a, b):
            return Either(cheapest_first(a, fields), cheapest_first(b, fields))
    return c


def _parts(c: Condition) -> list[Condition]:
    return [*_parts(c.left), *_parts(c.right)] if isinstance(c, Both) else [c]
