"""Corpus cleaning in five stages.

toxicity          drops documents that are scored as toxic
near_duplicates   keeps the least doc_id of each group (five words, 0.8)
decontamination   drops documents that hold a benchmark item
pii               masks personal data and counts the characters anew
mixing            says how many words of each document the mix takes

Each stage takes (spark, docs, sf_dir); docs are what the stage before kept,
with the columns of ``documents``. The last returns the plan of the mix.

Null and empty texts go through all stages: nothing is toxic, near to another
text, leaked or personal in them, and the mix takes no word of them. Texts are
read whole, however long. An empty table gives empty results. Columns beside
those of ``documents`` stay as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quern.llm import op3_mixing, op6_pii, op7_toxicity, op8_near_dedup, op9_decontaminate
from quern.llm.common import free_name, materialize, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that score less than 0.7; a repeated row is scored like the first."""
    judged = op7_toxicity.judge(docs, table(spark, sf_dir, "labels"))
    return judged.where("predicted = 0").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked texts.

    Texts that share a doc_id are documents of their own; of rows that repeat a
    text under its doc_id one stays (the least by its other columns). Rows
    without a doc_id all stay.
    """
    key, own, nth = (free_name(docs, x) for x in ("text_key", "own_id", "nth"))
    keyed = docs.withColumns({key: op8_near_dedup.text_key(), own: F.col("doc_id").cast("long")})
    kept = materialize(op8_near_dedup.kept_texts(docs).select(F.col("doc_id").alias(own), F.col("text_key").alias(key)), "kept")
    left = keyed.join(kept, [own, key], "left_semi")
    again = left.groupBy(own, key).count().where("count > 1").select(own, key)
    if not again.isEmpty():
        sortable = [F.col(f"`{f.name}`") for f in docs.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
        ranked = left.join(again, [own, key], "left_semi").withColumn(nth, F.row_number().over(Window.partitionBy(own, key).orderBy(*sortable)))
        left = left.join(again, [own, key], "left_anti").select(docs.columns).unionByName(ranked.where(F.col(nth) == 1).select(docs.columns))
    return left.select(docs.columns).unionByName(docs.where("doc_id is null"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no item of the benchmark; repeated rows share their fate."""
    found = op9_decontaminate.with_leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.where(F.size("leaks") == 0).select(docs.columns)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by the name of its kind; n_chars of a null text is null."""
    masked = op6_pii.masked(docs)
    return masked.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target and taken of all documents; repeated rows are documents of their own."""
    return op3_mixing.mix(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("pii", pii),
    ("mixing", mixing),
]

#: SQL says neither the network of the first stage nor the links of the second.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
