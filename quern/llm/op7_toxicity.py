"""Toxicity: a bidirectional gated recurrent network over overlapping windows.

The network (see ``bigru``) is trained in numpy on the driver, on a bounded
sample: at most ``TRAIN_TOXIC`` toxic and ``TRAIN_CLEAN`` clean labelled texts,
the first ones by a hash of doc_id that together have no more than
``TRAIN_CHARS`` characters; each of them is read whole. The rate of toxic texts among all usable
labels calibrates the scores. Scoring reads every window of every whole text,
in the order in which the partitions come, without a shuffle.

Labels of documents with crc32(doc_id) mod 3 = 1 are never learned from. Only
the text is an input. Null and empty texts get the score of a window without
words. Where usable labels lack one of the classes, all texts get their smoothed
rate. A null label is no label; a doc_id that repeats in ``labels`` counts by
its highest label. Rows and columns of the input stay as they are; a column of
the same name as a new one is replaced.
"""

from __future__ import annotations

import ctypes
import gc
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bigru import Model, train
from .common import small_batches, table

TRAIN_TOXIC, TRAIN_CLEAN = 1000, 2400
TRAIN_CHARS = 8_000_000
THRESHOLD = 0.7
SEED = 11


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _interleaved(label_of: dict[int, int]) -> dict[int, float]:
    """A place from 0 to 1 for each doc_id, such that both labels are spread evenly."""
    out: dict[int, float] = {}
    for label in (0, 1):
        some = [k for k, v in label_of.items() if v == label]
        out |= {k: (i + 0.5) / len(some) for i, k in enumerate(some)}
    return out


def fit(docs: DataFrame, labels: DataFrame, toxic: int = TRAIN_TOXIC, clean: int = TRAIN_CLEAN, chars: int = TRAIN_CHARS) -> Model:
    """Train on a bounded sample of the labels that may be learned from."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(~held_out(F.col("doc_id"))).join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64("doc_id", F.lit(SEED))
    picked = [r for k, n in ((1, toxic), (0, clean)) for r in known.where(F.col("toxic") == k).orderBy(order, "doc_id").limit(n).collect()]
    total = sum(counts.values())
    if not picked:
        return train([], np.zeros(0))
    label_of = {r["doc_id"]: r["toxic"] for r in picked}
    chosen = docs.sparkSession.createDataFrame([(k,) for k in label_of], "picked long")  # as many as the sample has at most
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("picked"), "left_semi")
    texts = texts.groupBy("doc_id").agg(F.min("text").alias("text"))  # a doc_id that repeats counts once
    place = _interleaved(label_of)
    size, fit_in = 0, []
    for k, n in sorted(texts.select("doc_id", F.char_length("text")).collect(), key=lambda r: place[r[0]]):
        if size + n <= chars:
            fit_in.append(k)
            size += n
    rows = sorted((r["doc_id"], r["text"]) for r in texts.where(F.col("doc_id").isin(fit_in)).collect()) if fit_in else []
    model = train([t for _, t in rows], np.array([label_of[k] for k, _ in rows]), share=max(1, counts.get(1, 0)) / total)
    del rows, texts, picked
    _give_back()
    return model


def _give_back() -> None:
    """Return what training took to the system, where the C library can: the driver goes on to other stages."""
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if os.name == "posix" else None
    if trim:
        trim(0)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with the column ``score``."""
    small_batches(docs.sparkSession)
    kept = docs.drop("score")
    at = kept.columns.index(text)
    shape = T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 1024):
                batch = whole.slice(a, 1024)
                values = model.scores(batch.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())], names=[*batch.schema.names, "score"])

    return kept.mapInArrow(run, shape)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with score and predicted (1: toxic)."""
    return score(docs, fit(docs, labels)).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    judged = judge(docs.select("doc_id", "text"), labels)
    return judged.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
