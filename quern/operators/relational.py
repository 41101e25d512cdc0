"""Grouping, order, limits and joins.

All are compositions of built-in operators: aggregates combine on the map side,
an order with a limit becomes a top-k, joins are left to Catalyst and AQE, which
broadcast a side by its measured size and split skewed partitions.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quern.functions.values import field, is_number, type_of
from quern.plans.syntax import Aggregate, Order


def _numeric(df: DataFrame, name: str) -> Column:
    kind = type_of(df, name)
    if is_number(kind):
        return field(name).cast("double")
    if isinstance(kind, T.VariantType):
        return F.when(F.schema_of_variant(field(name)).rlike("^(DOUBLE|FLOAT|BIGINT|DECIMAL)"), F.try_variant_get(field(name), "$", "double"))
    return F.lit(None).cast("double")


def aggregate(df: DataFrame, a: Aggregate, average: str = "star") -> Column:
    """One aggregate column; what is no number counts as nothing, and nothing as 0.

    average: ``star`` divides by all rows of the group, ``present`` by those
    with a number.
    """
    zero, x = F.lit(0.0), _numeric(df, a.field)
    out = {
        "pou": lambda: F.count(F.lit(1)),
        "sep": lambda: F.coalesce(F.sum(x), zero),
        "awr": lambda: F.coalesce(F.sum(x), zero) / F.count(F.lit(1)) if average == "star" else F.coalesce(F.avg(x), zero),
        "mie": lambda: F.coalesce(F.min(x), zero),
        "maf": lambda: F.coalesce(F.max(x), zero),
    }[a.function]()
    return out.alias(a.name)


def grouped(df: DataFrame, key: str | None, aggregates: Iterable[Aggregate], average: str = "star", nulls: str = "group") -> DataFrame:
    """Group by one field. Rows without it are one group, or left out with nulls="drop".

    Without a key all rows are one group.
    """
    columns = [aggregate(df, a, average) for a in aggregates]
    if key is None:
        return df.agg(*columns)
    if type_of(df, key) is None:
        df = df.withColumn(key, F.lit(None).cast("string"))
    elif isinstance(type_of(df, key), T.VariantType):
        df = df.withColumn(key, F.to_json(field(key)))
    if nulls == "drop":
        df = df.where(field(key).isNotNull())
    by = df.groupBy(field(key))
    return by.agg(*columns) if columns else by.agg(F.count(F.lit(1)).alias("n")).drop("n")


def ordered(df: DataFrame, order: Iterable[Order]) -> DataFrame:
    """Missing values come first upwards and last downwards; unknown fields order nothing."""
    keys = []
    for o in order:
        kind = type_of(df, o.field)
        if kind is None:
            continue
        parts = [field(o.field)]
        if isinstance(kind, T.VariantType):  # by type, then by value
            parts = [F.schema_of_variant(field(o.field)), _numeric(df, o.field), F.try_variant_get(field(o.field), "$", "string")]
        keys += [p.desc_nulls_last() if o.descending else p.asc_nulls_first() for p in parts]
    return df.orderBy(*keys) if keys else df


def cut(df: DataFrame, limit: int | None, offset: int = 0) -> DataFrame:
    """Skip, then take."""
    df = df.offset(offset) if offset else df
    return df.limit(limit) if limit is not None else df


def sortable(df: DataFrame, but: Iterable[str] = ()) -> list[Column]:
    """The columns that have an order, to break ties by."""
    left_out = {*but}
    return [field(f.name) for f in df.schema.fields if f.name not in left_out and not isinstance(f.dataType, (T.MapType, T.VariantType))]


def first_of(df: DataFrame, key: Column, *order: Column) -> DataFrame:
    """One row of each key, the first by ``order``; rows without a key are left out.

    A row number with a limit of one: each task keeps one row a key before the
    shuffle, so a key with most rows sends no more than any other.
    """
    nth = "_nth"
    while nth in df.columns:
        nth = f"_{nth}"
    ranked = df.where(key.isNotNull()).withColumn(nth, F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.where(F.col(nth) == 1).drop(nth)


def first_by(df: DataFrame, key: str, order: str | tuple[str, ...]) -> DataFrame:
    """The row of least ``order`` (one field or more) of each key.

    Ties go by the other columns, as they stand; rows without an order come last.
    """
    fields = (order,) if isinstance(order, str) else order
    return first_of(df, field(key), *[field(o).asc_nulls_last() for o in fields], *sortable(df, (key, *fields)))


def _prefixed(df: DataFrame, alias: str) -> DataFrame:
    return df.select(*[field(c).alias(f"{alias}.{c}") for c in df.columns])


def _comparable(left: DataFrame, right: DataFrame, a: str, b: str) -> bool:
    x, y = type_of(left, a), type_of(right, b)
    return x is not None and y is not None and (x == y or (is_number(x) and is_number(y)))


def lookup_first(left: DataFrame, right: DataFrame, local: str, foreign: str, alias: str, order: str | tuple[str, ...] = "id", how: str = "left") -> DataFrame:
    """Each left row with the first match of the right side, as ``alias.field``.

    how: ``left`` keeps rows without a match, ``inner`` drops them. Without
    comparable fields nothing matches.
    """
    if not _comparable(left, right, local, foreign):
        return left if how == "left" else left.limit(0)
    firsts = _prefixed(first_by(right, foreign, order), alias)
    return left.join(firsts, field(local) == field(f"{alias}.{foreign}"), how)


def lookup_all(left: DataFrame, right: DataFrame, local: str, foreign: str, alias: str, how: str = "left") -> DataFrame:
    """Each left row with every match (how: any join type of Spark)."""
    right = _prefixed(right, alias)
    return left.join(right, field(local) == field(f"{alias}.{foreign}"), how)


def collected(left: DataFrame, right: DataFrame, local: str, foreign: str, name: str) -> DataFrame:
    """Each left row with the array ``name`` of all its matches, empty without any."""
    grouped_ = right.where(field(foreign).isNotNull()).groupBy(field(foreign).alias("_key")).agg(F.collect_list(F.struct(*[field(c) for c in right.columns])).alias(name))
    out = left.join(grouped_, field(local) == F.col("_key"), "left").drop("_key")
    return out.withColumn(name, F.coalesce(field(name), F.array().cast(grouped_.schema[name].dataType)))


def rolled_up(df: DataFrame, keys: list[str], aggregates: Iterable[Aggregate], kind: str = "rollup") -> DataFrame:
    """Several keys with subtotals; kind: rollup, cube or group."""
    by = {"rollup": df.rollup, "cube": df.cube, "group": df.groupBy}[kind](*[field(k) for k in keys])
    return by.agg(*[aggregate(df, a) for a in aggregates])


def distinct_values(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[field(n) for n in names]).distinct()
