"""JSON Lines in: from files of any store, from a buffer, or as one variant column.

Blank lines and lines that begin with ``#`` are skipped, a broken line is
counted and left out, nested values are dropped, numbers become doubles. A field
that has values of two types keeps each one's type, as a variant. A document
whose ``id`` is no number can't be inserted; it is counted and left out.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.values import field, is_number

_BROKEN = "_broken"
_NUMBER = "^(DOUBLE|FLOAT|BIGINT|DECIMAL)"


@dataclass
class ImportStats:
    lines_read: int = 0
    docs_inserted: int = 0
    parse_errors: int = 0
    insert_errors: int = 0
    bytes: int = 0
    elapsed: float = 0.0


def _wanted(lines: DataFrame) -> DataFrame:
    return lines.where((F.trim("value") != "") & ~F.ltrim("value").startswith("#"))


def _survey(lines: DataFrame) -> tuple[T.StructType, int, int]:
    """Fields with their types, the number of lines and of bytes, in one reading.

    What Spark calls a schema of variants keeps a field of two types apart from
    one of strings; only this schema reaches the driver.
    """
    wanted = (F.trim("value") != "") & ~F.ltrim("value").startswith("#")
    doc = F.when(wanted, F.try_parse_json("value"))
    doc = F.when(F.schema_of_variant(doc).startswith("OBJECT"), doc)
    shape, n, size = lines.agg(F.schema_of_variant_agg(doc), F.count(F.lit(1)), F.sum(F.octet_length("value") + 1)).first()
    if not shape or not shape.startswith("OBJECT<"):
        return T.StructType([]), n, size or 0
    parsed = T._parse_datatype_string(shape.replace("OBJECT<", "STRUCT<"))
    return T.StructType([T.StructField(f.name, _stored(f.dataType)) for f in parsed.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]), n, size or 0


def _stored(kind: T.DataType) -> T.DataType:
    return T.DoubleType() if is_number(kind) else kind if isinstance(kind, (T.BooleanType, T.VariantType)) else T.StringType()


def _flat(name: str, kind: T.DataType) -> Column:
    """A field without nested values."""
    x = field(name)
    return F.when(~F.schema_of_variant(x).rlike("^(OBJECT|ARRAY|VOID)"), x).alias(name) if isinstance(kind, T.VariantType) else x


def _parsed(lines: DataFrame, schema: T.StructType) -> tuple[DataFrame, int, int]:
    """The good documents of the wanted lines, the number of broken ones and of those with an id that is none."""
    whole = T.StructType([*schema.fields, T.StructField(_BROKEN, T.StringType())])
    docs = _wanted(lines).select(F.from_json("value", whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BROKEN}).alias("doc"))
    bad = F.col("doc").isNull() | F.col(f"doc.{_BROKEN}").isNotNull()
    good = docs.where(~bad).select("doc.*").drop(_BROKEN)
    kind = next((f.dataType for f in schema.fields if f.name == "id"), None)
    refused = F.lit(False)
    if kind is not None and not is_number(kind):
        own = field("id")
        refused = own.isNotNull() & (~F.schema_of_variant(own).rlike(f"{_NUMBER}|VOID") if isinstance(kind, T.VariantType) else F.lit(True))
    broken = docs.agg(F.count_if(bad)).first()[0]
    lost = good.agg(F.count_if(refused)).first()[0] if kind is not None and not is_number(kind) else 0
    good = good.where(~refused)
    if lost or (kind is not None and not is_number(kind)):
        number = F.try_variant_get(field("id"), "$", "double") if isinstance(kind, T.VariantType) else F.lit(None).cast("double")
        good = good.withColumn("id", number)
    kept = [_flat(f.name, f.dataType) if f.name != "id" else field("id") for f in schema.fields]
    return (good.select(*kept) if kept else good.select(F.lit(None).cast("double").alias("id"))), broken, lost


def read_file(spark: SparkSession, path: str) -> tuple[DataFrame, ImportStats]:
    """The good rows of a file or folder, and what was read."""
    begun = time.time()
    return _read(spark.read.text(path), begun)


def read_buffer(spark: SparkSession, text: str) -> tuple[DataFrame, ImportStats]:
    """The same of a text that the driver holds, such as a request's body."""
    begun = time.time()
    return _read(spark.createDataFrame([(x,) for x in text.split("\n")], "value string").coalesce(1), begun, len(text.encode()))


def _read(lines: DataFrame, begun: float, size: int | None = None) -> tuple[DataFrame, ImportStats]:
    schema, n, seen = _survey(lines)
    df, broken, lost = _parsed(lines, schema)
    return df, ImportStats(n, 0, broken, lost, seen if size is None else size, time.time() - begun)


def read_variant(spark: SparkSession, path: str) -> DataFrame:
    """One variant column ``doc`` a line: strict schemaless mode, missing and null told apart."""
    return _wanted(spark.read.text(path)).select(F.try_parse_json("value").alias("doc")).where("doc is not null")


def stage(df: DataFrame, path: str) -> T.StructType:
    """Write rows to be numbered, those with an id and those without apart; their fields."""
    own = field("id").cast("double") if "id" in df.columns else F.lit(None).cast("double")
    placed = df.withColumn("id", own)
    placed.withColumn("_own", field("id").isNotNull()).write.partitionBy("_own").parquet(path)
    return placed.schema


def numbered(spark: SparkSession, path: str, schema: T.StructType, first: int) -> DataFrame:
    """Staged rows; those without an id are numbered from ``first`` on, in order, without one task for all.

    A row's number is the sum of the files before its own and its place in this
    one, so it is the same in every reading; a count a file reaches the driver.
    """
    whole = spark.read.schema(T.StructType([*schema.fields, T.StructField("_own", T.BooleanType())])).parquet(path)
    lacking, owned = whole.where("not _own"), whole.where("_own").drop("_own")
    name = F.regexp_extract("_metadata.file_path", "([^/]*)$", 1)
    counts = sorted((r["name"], r["n"]) for r in lacking.groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("n")).collect())
    if not counts:
        return owned
    bases, at = [], first
    for file, n in counts:
        bases.append((file, at))
        at += n
    base = spark.createDataFrame(bases, "_file string, _base long")  # one row a file
    placed = lacking.withColumns({"_name": name, "_row": F.col("_metadata.row_index")}).join(F.broadcast(base), F.col("_name") == F.col("_file"))
    return placed.withColumn("id", (F.col("_base") + F.col("_row")).cast("double")).select(*[field(c) for c in owned.columns]).unionByName(owned)
