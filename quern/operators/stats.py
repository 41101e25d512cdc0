"""Column statistics, histograms and frequent values.

``profile`` is one pass of mergeable aggregates. The exact equi-depth histogram
counts distinct values first and ranks these counts over ranges of the value,
so no task sees all rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quern.functions.values import field, is_number

HISTOGRAM = 32
FREQUENT = 10
RANGES = 64


def profile(df: DataFrame, exact: bool = False) -> DataFrame:
    """field, present, missing, distinct, low, high and mean of each plain column.

    low, high and mean are of numbers only; distinct is by HyperLogLog++ unless
    ``exact``, which counts each value first.
    """
    plain = [f for f in df.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType, T.BinaryType))]
    whole = F.count(F.lit(1))
    parts = []
    for f in plain:
        x = field(f.name)
        value = x.cast("double") if is_number(f.dataType) else F.lit(None).cast("double")
        parts.append(F.struct(F.lit(f.name).alias("field"), F.count(x).alias("present"), (whole - F.count(x)).alias("missing"), (F.lit(0).cast("long") if exact else F.approx_count_distinct(x)).alias("distinct"), F.min(value).alias("low"), F.max(value).alias("high"), F.avg(value).alias("mean")))
    if not parts:
        return df.sparkSession.createDataFrame([], "field string, present long, missing long, distinct long, low double, high double, mean double")
    out = df.agg(F.array(*parts).alias("all")).select(F.inline("all"))
    if not exact:
        return out
    # One hash aggregate a column over its values, instead of one over all rows once a column.
    counts = reduce(DataFrame.unionAll, [df.select(field(f.name)).distinct().agg(F.lit(f.name).alias("field"), F.count(field(f.name)).alias("distinct")) for f in plain])
    return out.drop("distinct").join(F.broadcast(counts), "field").select(*out.columns)  # one row a column


def sizes(df: DataFrame) -> DataFrame:
    """rows and mean bytes of a row as JSON, in one row."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.avg(F.octet_length(F.to_json(F.struct(*[field(c) for c in df.columns])))).alias("row_bytes"))


def histogram(df: DataFrame, name: str, buckets: int = HISTOGRAM, ranges: int = RANGES) -> DataFrame:
    """bucket and bound: the exact upper bounds of ``buckets`` equally full buckets.

    Bound i is the value of rank ((i + 1) * n) div buckets, from 1; missing
    values are left out. Approximate quantiles deal the distinct values to
    ranges: they shape the work, the ranks are counted.
    """
    counts = df.where(field(name).isNotNull()).groupBy(field(name).cast("double").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    marks = df.agg(F.percentile_approx(field(name).cast("double"), [i / ranges for i in range(1, ranges)], 1000)).first()[0] or []
    marks = sorted(set(marks))

    def range_of(lo: int, hi: int) -> Column:  # the number of marks below the value, by halves
        if lo == hi:
            return F.lit(lo)
        middle = (lo + hi) // 2
        return F.when(F.col("value") > marks[middle], range_of(middle + 1, hi)).otherwise(range_of(lo, middle))

    at = range_of(0, len(marks))
    values = df.where(field(name).isNotNull()).select(field(name).cast("double").alias("value"))
    sizes = {r["at"]: r["n"] for r in values.groupBy(at.alias("at")).agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``ranges`` rows
    bases = [sum(n for i, n in sizes.items() if i < k) for k in range(len(marks) + 1)]
    total = sum(sizes.values())
    within = Window.partitionBy("at").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counts.withColumn("at", at).withColumn("upto", F.get(F.lit(bases), F.col("at")) + F.sum("n").over(within))
    # A value knows its ranks, and so the buckets that end at one of them: no join with these.

    def ended(rank: str) -> Column:  # buckets that end at a rank or before
        return F.least(F.lit(buckets), F.expr(f"(({rank} + 1) * {buckets} - 1) div {max(1, total)}").cast("int"))

    spans = ranked.withColumns({"from": F.when(F.col("upto") == F.col("n"), 0).otherwise(ended("(upto - n)")), "to": ended("upto")})
    return spans.where("from < to").select(F.explode(F.sequence(F.col("from"), F.col("to") - 1)).alias("bucket"), F.col("value").alias("bound"))


def quick_histogram(df: DataFrame, name: str, buckets: int = HISTOGRAM, accuracy: int = 10_000) -> DataFrame:
    """As ``histogram`` from one mergeable sketch."""
    shares = [(i + 1) / buckets for i in range(buckets)]
    return df.agg(F.percentile_approx(field(name).cast("double"), shares, accuracy).alias("all")).select(F.posexplode("all").alias("bucket", "bound"))


def frequent(df: DataFrame, name: str, k: int = FREQUENT) -> DataFrame:
    """value and n of the k most frequent values, ties by value."""
    return df.where(field(name).isNotNull()).groupBy(field(name).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(k)


def quick_frequent(df: DataFrame, name: str, k: int = FREQUENT) -> DataFrame:
    """As ``frequent`` from one sketch; counts may be estimates."""
    return df.agg(F.expr(f"approx_top_k(`{name}`, {k})").alias("all")).select(F.inline("all")).toDF("value", "n")


def selectivity(df: DataFrame, condition: Column) -> DataFrame:
    """The share of rows that a condition keeps, measured."""
    return df.agg(F.coalesce(F.avg(F.coalesce(condition, F.lit(False)).cast("double")), F.lit(0.0)).alias("selectivity"))


def join_size(left: DataFrame, right: DataFrame, a: str, b: str, exact: bool = False) -> DataFrame:
    """Estimated rows of an equi-join: the product of both over the greater distinct count (a sketch's unless ``exact``)."""
    different = F.count_distinct if exact else F.approx_count_distinct
    x = left.agg(F.count(F.lit(1)).alias("l"), different(field(a)).alias("ld"))
    y = right.agg(F.count(F.lit(1)).alias("r"), different(field(b)).alias("rd"))
    return x.crossJoin(y).select((F.col("l") * F.col("r") / F.greatest("ld", "rd", F.lit(1))).alias("rows"))
