"""Conditions to columns and queries to DataFrames, without running anything.

A condition is two-valued: what is missing or of another type is false. Spark's
null does the same in a filter, so only ``$vnot`` needs care: it becomes the
opposite comparison or a null test, which still reaches the Parquet reader.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.errors import EngineError
from quern.functions.values import field, operands, type_of
from quern.operators import relational as R

from .syntax import Both, Compare, Condition, Either, Exists, Member, Not, Query

_COMPARE: dict[str, Callable[[Column, Column], Column]] = {
    "$bg": lambda a, b: a == b,
    "$kc": lambda a, b: a != b,
    "$lh": lambda a, b: a < b,
    "$bh": lambda a, b: a > b,
    "$lhb": lambda a, b: a <= b,
    "$bhb": lambda a, b: a >= b,
    "$xau": F.contains,
}
_OPPOSITE = {"$bg": "$kc", "$kc": "$bg", "$lh": "$bhb", "$bh": "$lhb", "$lhb": "$bh", "$bhb": "$lh"}


def condition(df: DataFrame, c: Condition) -> Column:
    match c:
        case Both(left, right):
            return condition(df, left) & condition(df, right)
        case Either(left, right):
            return condition(df, left) | condition(df, right)
        case Not(of):
            return _negated(df, of)
        case Exists(name):
            return field(name).isNotNull() if type_of(df, name) is not None else F.lit(False)
        case Compare(name, op, value):
            sides = operands(df, name, value)
            if not sides or (op == "$xau" and not isinstance(value, str)):
                return F.lit(False)
            return _COMPARE[op](*sides)
        case Member(name, values, wanted):
            return _member(df, name, values, wanted)
    raise EngineError("PARSE", f"no such condition: {c}")


def _sides(df: DataFrame, name: str, values: tuple) -> tuple[list[Column], Column | None]:
    found = [x for v in values if (x := operands(df, name, v))]
    return [x[1] for x in found], found[0][0] if found else None


def _member(df: DataFrame, name: str, values: tuple, wanted: bool) -> Column:
    if type_of(df, name) is None:
        return F.lit(False)
    if type_of(df, name).typeName() == "variant":
        hit = F.lit(False)
        for v in values:
            if sides := operands(df, name, v):
                hit = hit | F.coalesce(sides[0] == sides[1], F.lit(False))
        return hit if wanted else field(name).isNotNull() & ~hit
    literals, column = _sides(df, name, values)
    if column is None:  # nothing comparable: in none, outside all
        return F.lit(False) if wanted else field(name).isNotNull()
    return column.isin(*literals) if wanted else ~column.isin(*literals)


def _negated(df: DataFrame, c: Compare | Member | Exists) -> Column:
    """True wherever the condition isn't, missing fields included."""
    match c:
        case Exists(name):
            return field(name).isNull() if type_of(df, name) is not None else F.lit(True)
        case Compare(name, op, value):
            sides = operands(df, name, value)
            if not sides or (op == "$xau" and not isinstance(value, str)):
                return F.lit(True)
            if op in _OPPOSITE:
                return _COMPARE[_OPPOSITE[op]](*sides) | sides[0].isNull()
            return ~_COMPARE[op](*sides) | sides[0].isNull()
        case Member(name, values, wanted):
            if type_of(df, name) is None:
                return F.lit(True)
            return _member(df, name, values, not wanted) | field(name).isNull()


def rows(query: Query, df: DataFrame, target: Callable[[str], tuple[DataFrame, str] | None]) -> DataFrame:
    """``funden`` and ``gomail`` over ``df``.

    ``target`` gives a collection and the field that orders its documents.
    """
    if query.where is not None:
        df = df.filter(condition(df, query.where))
    if query.verb == "gomail":
        if query.group is None and not query.aggregates:
            raise EngineError("NO_GROUP", "gomail needs gremb bi")
        df = R.grouped(df, query.group, query.aggregates)
    df = R.ordered(df, query.order)
    df = R.cut(df, query.limit, query.offset)
    if query.lookup:
        found = target(query.lookup.target)
        if found:
            df = R.lookup_first(df, found[0], query.lookup.local, query.lookup.foreign, query.lookup.alias, found[1])
    return df
