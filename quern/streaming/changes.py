"""Streams of documents and of changes.

Every function takes and gives streaming DataFrames and keeps its state in
Spark's own stores; watermarks bound it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quern.operators.versions import merged


def documents(spark: SparkSession, folder: str, schema: str, per_trigger: int = 1000) -> DataFrame:
    """JSON Lines files as they come; blank, note and broken lines are left out."""
    lines = spark.readStream.option("maxFilesPerTrigger", per_trigger).text(folder)
    kept = lines.where((F.trim("value") != "") & ~F.ltrim("value").startswith("#"))
    parsed = kept.select(F.from_json("value", f"{schema}, _broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}).alias("doc"))
    return parsed.where("doc is not null and doc._broken is null").select("doc.*").drop("_broken")


def tables(spark: SparkSession, path: str, schema, per_trigger: int = 1) -> DataFrame:
    """Parquet files of a folder (or pattern) as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def windowed(stream: DataFrame, time: str, keys: list[str], size: str, late: str, *aggregates: Column, slide: str | None = None) -> DataFrame:
    """Aggregates by tumbling or sliding windows; rows later than ``late`` are dropped."""
    by = F.window(time, size, slide) if slide else F.window(time, size)
    out = stream.withWatermark(time, late).groupBy(by, *keys).agg(*aggregates)
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *[c for c in out.columns if c != "window"])


def sessions(stream: DataFrame, time: str, keys: list[str], gap: str, late: str, *aggregates: Column) -> DataFrame:
    """Aggregates by sessions: runs of rows of a key with no pause of ``gap``."""
    out = stream.withWatermark(time, late).groupBy(F.session_window(time, gap), *keys).agg(*aggregates)
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *[c for c in out.columns if c != "session_window"])


def first_seen(stream: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """One row of each key within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def _compactions(spark: SparkSession, path: str) -> list[int]:
    """The last levels that finished compactions hold, ascending."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}-compacted")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    done = [f.getPath() for f in files.listStatus(folder)]
    done = [p for p in done if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName().removeprefix("upto=")) for p in done)


def _remove_merged(spark: SparkSession, path: str) -> None:
    """Delete what the compaction before the last holds already: readers of that one can still end."""
    done = _compactions(spark, path)
    if len(done) < 2:
        return
    fs = spark._jvm.org.apache.hadoop.fs
    folder = fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for upto in done[:-2]:
        files.delete(fs.Path(f"{path}-compacted/upto={upto}"), True)
    for f in files.listStatus(folder):
        name = f.getPath().getName()
        if name.startswith("level=") and int(name.removeprefix("level=")) <= done[-2]:
            files.delete(f.getPath(), True)


def _levels(spark: SparkSession, path: str) -> DataFrame:
    """The last compaction and the levels after it."""
    done, levels = _compactions(spark, path), spark.read.parquet(path)
    if not done:
        return levels.drop("level")
    upto = done[-1]
    older = spark.read.parquet(f"{path}-compacted/upto={upto}")
    return older.unionByName(levels.where(F.col("level") > upto).drop("level"))


def merge_into(stream: DataFrame, path: str, key: str, seq: str, gone: str, checkpoint: str, every: int = 10) -> StreamingQuery:
    """Keep a log-structured table: each batch is a level, every few batches they are merged.

    A batch writes under its own number, so one that is repeated after a
    failure replaces itself. What two compactions hold is deleted. ``gone`` is an SQL condition for deletions; their
    rows stay in compactions, as older levels may come late.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{path}/level={number}")
        if number and number % every == 0:
            merged(_levels(spark, path), key, seq, F.expr(gone), keep_tombstones=True).write.mode("overwrite").parquet(f"{path}-compacted/upto={number}")
            _remove_merged(spark, path)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged_table(spark: SparkSession, path: str, key: str, seq: str, gone: str) -> DataFrame:
    """The current rows of such a table."""
    return merged(_levels(spark, path), key, seq, F.expr(gone))


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write what there is to Parquet, exactly once, and stop."""
    return stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
