"""Small helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One word: a longest run of anything but the six ASCII space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Only a session without ``spark.checkpoint.dir`` (a test in local mode) gets
    a folder of its own.
    """
    there = spark.conf.get("spark.checkpoint.dir", None)
    if there:
        return there
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "quern-checkpoints")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm, hadoop = spark._jvm, spark._jsc.hadoopConfiguration()
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(hadoop).delete(where, True)
    except Exception:  # the session may have ended before the interpreter does
        pass


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write to the shared folder as Parquet and read back.

    A lost executor then costs a re-read instead of a recomputation, and no
    block lives on one machine only. The files go when the driver exits.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quern/{label}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(schema).parquet(path)


#: Keys with so many rows, and at least a thousandth of all, are joined apart.
HOT_ROWS = 10_000


def join_skewed(left: DataFrame, right: DataFrame, keys: list[str], many: str = "n") -> DataFrame:
    """Inner join to a side with one row a key and in ``many`` the rows of ``left`` that it has, or more.

    The rows of a hot key stay where they are: hot keys are a thousand at most,
    as each has a thousandth of the rows, and go to all tasks. ``many`` is dropped.
    """
    total = right.agg(F.sum(many)).first()[0] or 0
    if total < HOT_ROWS:
        return left.join(right.drop(many), keys)
    hot = F.col(many) >= max(HOT_ROWS, -(-total // 1000))
    few, others = right.where(hot).drop(many), right.where(~hot).drop(many)
    rest = left.join(F.broadcast(few.select(*keys)), keys, "left_anti")
    return left.join(F.broadcast(few), keys).unionByName(rest.join(others, keys))


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = f"_{base}"
    return base


#: Rows of a batch that goes to a Python worker. Spark's own 10,000 rows of
#: whole texts would take hundreds of megabytes on either side.
BATCH_ROWS = 256


def small_batches(spark: SparkSession) -> None:
    """Have the session send texts to Python workers in small batches from now on."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if not 0 < now <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


def reached(bounds: list[tuple[int, ...]], values: list[Column]) -> Column:
    """How many of some ascending bounds are not above the row's values, by halves; an array of longs each on every task."""
    parts = [F.lit([b[i] for b in bounds]) for i in range(len(values))]

    def step(acc: Column, _: Column) -> Column:
        middle = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        below = F.lit(True)
        for part, value in reversed(list(zip(parts, values, strict=True))):
            at = F.get(part, middle)
            below = (at < value) | ((at == value) & below)
        open_ = acc["lo"] < acc["hi"]
        return F.struct(F.when(open_ & below, middle + 1).otherwise(acc["lo"]).alias("lo"), F.when(open_ & ~below, middle).otherwise(acc["hi"]).alias("hi"))

    if not bounds:
        return F.lit(0)
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(len(bounds).bit_length())), start, step, lambda acc: acc["lo"])


def n_words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
