"""Fields, literals and the value-level functions of the language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Value = float | str | bool | None


def field(name: str) -> Column:
    """A column by its flat name, points included."""
    return F.col("`" + name.replace("`", "``") + "`")


def type_of(df: DataFrame, name: str) -> T.DataType | None:
    return next((f.dataType for f in df.schema.fields if f.name == name), None)


def is_number(kind: T.DataType | None) -> bool:
    return isinstance(kind, T.NumericType)


def number(value: float, kind: T.DataType) -> Column:
    """A whole number against a whole column is compared as one, exactly."""
    if isinstance(kind, T.IntegralType) and value == int(value):
        return F.lit(int(value))
    return F.lit(float(value))


def variant_part(column: Column, value: Value) -> Column:
    """What a value of varying type is as the type of ``value``; null for any other."""
    kind = F.schema_of_variant(column)
    if isinstance(value, bool):
        return F.when(kind == "BOOLEAN", F.try_variant_get(column, "$", "boolean"))
    if isinstance(value, str):
        return F.when(kind == "STRING", F.try_variant_get(column, "$", "string"))
    return F.when(kind.rlike("^(DOUBLE|FLOAT|BIGINT|DECIMAL)"), F.try_variant_get(column, "$", "double"))


def operands(df: DataFrame, name: str, value: Value) -> tuple[Column, Column] | None:
    """Both sides of a comparison, or None where their types never compare."""
    kind = type_of(df, name)
    if kind is None or value is None:
        return None
    if isinstance(kind, T.VariantType):
        return variant_part(field(name), value), F.lit(value)
    if isinstance(value, bool):
        if isinstance(kind, T.BooleanType):
            return field(name), F.lit(value)
        return (field(name), F.lit(str(value).lower())) if isinstance(kind, T.StringType) else None
    if isinstance(value, str):
        return (field(name), F.lit(value)) if isinstance(kind, T.StringType) else None
    return (field(name), number(value, kind)) if is_number(kind) else None


def shown(column: Column) -> Column:
    """A number as text: whole ones without a point, others with six digits."""
    whole = (column == F.floor(column)) & (F.abs(column) < 1e15)
    digits = F.regexp_replace(F.format_string("%.6g", column.cast("double")), r"(\.[0-9]*?)0+($|e)", "$1$2")
    return F.when(whole, column.cast("long").cast("string")).otherwise(F.regexp_replace(digits, r"\.($|e)", "$1"))


def shown_number(value: float) -> str:
    return str(int(value)) if value == int(value) else f"{value:g}"


def push(column: Column, value: Value) -> Column:
    """Append to a comma-joined list; an empty or missing one becomes the value."""
    item = F.lit(shown_number(value) if isinstance(value, float) else str(value))
    return F.when(column.isNull() | (column == ""), item).otherwise(F.concat_ws(",", column, item))


def pull(column: Column, value: Value) -> Column:
    """Drop all equal and all empty members of a comma-joined list."""
    item = F.lit(shown_number(value) if isinstance(value, float) else str(value))
    members = F.transform(F.split(column, ","), lambda x: F.ltrim(x))
    return F.array_join(F.filter(members, lambda x: (x != item) & (x != "")), ",")
