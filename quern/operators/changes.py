"""Writes as dataflow: the collection after an update, a delete or an insert."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.values import Value, field, is_number, number, pull, push, shown, type_of
from quern.plans.syntax import Change


def _literal(value: Value) -> Column:
    return F.lit(value) if value is not None else F.lit(None).cast("string")


def _text(df: DataFrame, name: str) -> Column:
    """A list field as text; a number that stands there is no list."""
    return field(name) if isinstance(type_of(df, name), T.StringType) else F.lit(None).cast("string")


def _set(df: DataFrame, hit: Column, name: str, value: Value) -> DataFrame:
    kind = type_of(df, name)
    if kind is None or value is None:
        blank = F.lit(None).cast(kind or _kind_of(value))
        new = blank if value is None else _literal(value)
        old = field(name) if kind is not None else blank
        return df.withColumn(name, F.when(hit, new).otherwise(old))
    if isinstance(value, float) and is_number(kind):
        whole = isinstance(kind, T.IntegralType) and value == int(value)
        return df.withColumn(name, F.when(hit, number(value, kind).cast(kind) if whole else F.lit(value)).otherwise(field(name)))
    if _kind_of(value) == kind.simpleString():
        return df.withColumn(name, F.when(hit, _literal(value)).otherwise(field(name)))
    old = field(name) if isinstance(kind, T.VariantType) else field(name).cast("variant")
    return df.withColumn(name, F.when(hit, _literal(value).cast("variant")).otherwise(old))


def _kind_of(value: Value) -> str:
    return "boolean" if isinstance(value, bool) else "double" if isinstance(value, float) else "string"


def updated(df: DataFrame, where: Column | None, changes: Iterable[Change]) -> DataFrame:
    """Apply the changes, one after another, to the rows where ``where`` holds.

    A field that isn't there is made. A field given a value of another type
    holds both from then on, as a variant.
    """
    df = df.withColumn("_hit", F.coalesce(where, F.lit(False)) if where is not None else F.lit(True))
    hit = F.col("_hit")
    for c in changes:
        if c.op == "$quy":
            df = _set(df, hit, c.field, c.value)
        elif c.op == "$don":
            old = field(c.field) if type_of(df, c.field) is not None else F.lit(None).cast("string")
            keep = old if isinstance(type_of(df, c.field), T.StringType) else (shown(old) if is_number(type_of(df, c.field)) else old.cast("string"))
            df = df.withColumn(c.field, F.when(hit, push(_text(df, c.field), c.value)).otherwise(keep))
        elif isinstance(type_of(df, c.field), T.StringType):
            df = df.withColumn(c.field, F.when(hit, pull(field(c.field), c.value)).otherwise(field(c.field)))
    return df.drop("_hit")


def deleted(df: DataFrame, where: Column | None) -> DataFrame:
    """The rows that a delete leaves; without a condition none."""
    return df.where(~F.coalesce(where, F.lit(False))) if where is not None else df.limit(0)


def inserted(df: DataFrame, new: DataFrame) -> DataFrame:
    """Both together; a field that one side lacks is missing there."""
    return df.unionByName(new, allowMissingColumns=True)
