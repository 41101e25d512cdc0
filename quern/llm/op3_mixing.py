"""Mixing sources to target weights by a low-discrepancy schedule.

The documents of a source, in the order of a hash of their ids, form one
stream of words that is cut into blocks of ``BLOCK`` words, the last one what is
left. Slot i of the mix takes the golden-ratio point frac((i + 1/2) / phi), maps
it through the cumulative weights to a source, and the n-th slot of a source
takes that source's n-th block, beginning again after the last one. A source's
slots end when its target is reached, the last of them cut short, so each source
gives its target to the word and the mix stays in proportion all along; the few
blocks that the points have left over come at the end.

Targets: sources by code point, null last, have the weights 1, 2, 3 repeating
and share the words of all sources; a target is at most ``MOST`` times its
source, and what is cut off goes to the others by weight.

A source can hold most rows: its documents are dealt by hash over many shards
and its slots over chunks, and only sums a shard or chunk meet per source. The
plan, a row a source, is a table: only its sums reach the driver. Up to ``FEW``
sources it goes to all tasks; with more, points and sources meet in ranges.

Null and empty texts have size 0 and give nothing. Repeated rows are separate
documents. An empty table gives an empty mix. Columns other than doc_id, source
and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import join_skewed, materialize, n_words, reached, table

MOST = 3
BLOCK = 2048
SEED = 20011
CHUNK = 1 << 14
FEW = 20_000
#: Positions of a range in which points and sources meet if the sources are many.
RANGE = 64
#: 2**64 times the golden ratio's fraction.
GOLDEN = 0x9E3779B97F4A7C15
WEIGHTS = (1, 2, 3)


def _name(source: Column) -> Column:
    """A source as a text that null has too."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("none"))


def _whole(x: Column | int) -> Column:
    return (F.lit(str(x)) if isinstance(x, int) else x).cast("decimal(20,0)")


def _before(df: DataFrame, value: Column, name: str) -> DataFrame:
    """``df`` (part, at, ...) with the sum of ``value`` over all rows before, by at; a sum a part meets."""
    sums = df.groupBy("part").agg(F.sum(value).alias("_sum"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    bases = sums.select("part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    within = Window.partitionBy("part").orderBy("source_is_null", "source").rowsBetween(Window.unboundedPreceding, -1)
    summed = df.withColumn("_own", F.coalesce(F.sum(value).over(within), F.lit(0))).join(F.broadcast(bases), "part")
    return summed.withColumn(name, (F.col("_base") + F.col("_own")).cast("long")).drop("_base", "_own")


def plan(sized: DataFrame, block: int = BLOCK, most: int = MOST) -> DataFrame:
    """A row a source: at, name, source, size, rows, target, words (whole), blocks, need (slots) and lo (slots before)."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("rows")).withColumn("source_is_null", F.col("source").isNull())
    ranged = sums.repartitionByRange("source_is_null", "source").withColumn("part", F.spark_partition_id())
    ordered = materialize(ranged, "sources")
    placed = materialize(_before(ordered, F.lit(1), "at").withColumn("weight", F.get(F.lit(list(WEIGHTS)), F.pmod("at", F.lit(len(WEIGHTS))).cast("int"))), "weights")
    total, rest, whole = (int(x or 0) for x in placed.agg(F.sum("size"), F.sum("size"), F.sum("weight")).first())
    full = F.lit(False)
    while whole:  # what each point of weight gets grows, and with it the sources that are full
        full = _whole(F.col("weight")) * _whole(rest) > _whole(F.col("size")) * _whole(most * whole)
        kept, left = placed.agg(F.sum(F.when(full, F.col("size") * most)), F.sum(F.when(~full, F.col("weight")))).first()
        now = (total - int(kept or 0), int(left or 0))
        if now == (rest, whole) or not now[1]:
            break
        rest, whole = now
    target = F.when(full, (F.col("size") * most).cast("double")).otherwise((F.col("weight").cast("long") * F.lit(rest)).cast("double") / float(max(1, whole)))
    words = F.least(F.round("target").cast("long"), F.col("size") * most)
    blocks = F.expr(f"(size + {block - 1}) div {block}")
    need = F.when(F.col("words") > 0, F.expr(f"(words div size) * blocks + (words % size + {block - 1}) div {block}")).otherwise(0).cast("long")
    made = placed.withColumn("target", target).withColumn("words", words).withColumn("blocks", blocks).withColumn("need", need).withColumn("name", _name(F.col("source")))
    return materialize(_before(made, F.col("need"), "lo").drop("part", "source_is_null", "weight"), "plan")


def with_plan(df: DataFrame, sources: DataFrame, columns: list[str], n: int, key: str = "at", many: str = "need") -> DataFrame:
    """``df`` with columns of its source's row of the plan."""
    some = sources.select(key, *columns)
    if n <= FEW:
        return df.join(F.broadcast(some), key)
    return join_skewed(df, sources.select(key, *columns, F.col(many).alias("_many")), [key], "_many")


def _sources_of(points: DataFrame, sources: DataFrame, n: int) -> DataFrame:
    """``points`` with ``at``, the source whose slots hold the position ``p``."""
    live = sources.where("need > 0")
    if n <= FEW:
        rows = sorted((r["lo"], r["at"]) for r in live.select("lo", "at").collect())
        nth = reached([(lo,) for lo, _ in rows], [F.col("p")]) - 1
        return points.withColumn("at", F.get(F.lit([at for _, at in rows]), nth).cast("long"))
    first, last = F.expr(f"lo div {RANGE}"), F.expr(f"(lo + need - 1) div {RANGE}")
    ranges = live.select("at", "lo", (F.col("lo") + F.col("need")).alias("hi"), F.explode(F.sequence(first, last)).alias("range"))
    met = points.withColumn("range", F.expr(f"p div {RANGE}")).join(ranges, "range")
    return met.where("lo <= p and p < hi").drop("range", "lo", "hi")


def schedule(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """slot, at, turn, block and words: the mix in order of slots."""
    spark = sources.sparkSession
    n, whole = sources.agg(F.count("*"), F.coalesce(F.sum("need"), F.lit(0))).first()
    if not whole:
        return spark.createDataFrame([], "slot long, at long, turn long, block long, words long")
    # In whole numbers, as the points are closer than doubles can tell: frac((2 slot + 1) g / 2) of all positions.
    point = F.pmod(_whole(F.col("slot") * 2 + 1) * _whole(GOLDEN), _whole(1 << 65)).cast("decimal(20,0)")
    position = F.floor((point * F.lit(whole).cast("decimal(15,0)")) / _whole(1 << 65))
    points = spark.range(whole).select(F.col("id").alias("slot"), F.expr(f"id div {CHUNK}").alias("chunk")).withColumn("p", F.least(position.cast("long"), F.lit(whole - 1)))
    slots = _sources_of(points, sources, n).select("slot", "chunk", "at")
    counts = slots.groupBy("at", "chunk").count()
    before = Window.partitionBy("at").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    earlier = counts.select("at", "chunk", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("earlier"))
    within = Window.partitionBy("at", "chunk").orderBy("slot")
    ranked = slots.withColumn("nth", F.row_number().over(within)).join(earlier, ["at", "chunk"]).select("slot", "at", (F.col("earlier") + F.col("nth") - 1).alias("turn"))
    had = counts.groupBy("at").agg(F.sum("count").alias("had"))
    late = sources.select("at", "need", "lo").join(had, "at", "left").withColumn("had", F.coalesce("had", F.lit(0))).where("had < need")
    late = late.select("at", "lo", F.explode(F.sequence(F.col("had"), F.col("need") - 1)).alias("turn"))
    every = ranked.unionByName(late.select((F.col("lo") + F.col("turn") + whole).alias("slot"), "at", "turn"))
    used = with_plan(every, sources, ["size", "words", "blocks", "need"], n).where("turn < need").withColumn("block", F.expr("turn % blocks")).withColumnRenamed("words", "target")
    begun = F.expr(f"(turn div blocks) * size + block * {block}")
    taken = F.least(F.lit(block).cast("long"), F.expr(f"size - block * {block}"), F.col("target") - begun)
    return used.select("slot", "at", "turn", "block", taken.cast("long").alias("words"))


def streams(sized: DataFrame, sources: DataFrame, n: int, per_shard: int) -> DataFrame:
    """at, shard, nth, doc_id, size and start: each document's place in its source's stream."""
    rows = sources.agg(F.max("rows")).first()[0]
    placed = with_plan(sized.withColumn("name", _name(F.col("source"))).drop("source"), sources, ["at"], n, "name", "rows").drop("name")
    shards = max(64, -(-rows // per_shard))
    key = F.xxhash64(F.col("doc_id"), F.lit(SEED))
    placed = placed.withColumns({"key": key, "shard": F.pmod(F.shiftright(key, 20), F.lit(shards)).cast("int")})
    earlier = Window.partitionBy("at").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = placed.groupBy("at", "shard").agg(F.sum("size").alias("n")).select("at", "shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    order = Window.partitionBy("at", "shard").orderBy("key", "doc_id", "size")
    inner = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.withColumns({"inner": inner, "nth": F.row_number().over(order)}).join(bases, ["at", "shard"]).select("at", "shard", "nth", "doc_id", "size", (F.col("base") + F.col("inner")).alias("start"))


def _pieces(docs: DataFrame, block: int, per_shard: int) -> tuple[DataFrame, DataFrame, int]:
    """What each document has of each block of its source (words low to high of the block), the plan and its length."""
    sized = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size")), "sizes")
    sources = plan(sized, block)
    n = sources.count()
    first, last = F.expr(f"start div {block}"), F.expr(f"(start + greatest(size, 1L) - 1) div {block}")
    cut = streams(sized, sources, n, per_shard).withColumn("block", F.explode(F.sequence(first, last)))
    low = F.greatest(F.col("start") - F.col("block") * block, F.lit(0))
    high = F.least(F.col("start") + F.col("size") - F.col("block") * block, F.lit(block))
    return cut.withColumns({"low": low, "high": high}), sources, n


def mix(docs: DataFrame, block: int = BLOCK, per_shard: int = 20_000) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    if docs.isEmpty():
        return docs.sparkSession.createDataFrame([], "doc_id long, size long, source_size long, target double, taken long")
    pieces, sources, n = _pieces(docs, block, per_shard)
    slots = schedule(sources, block).select("at", "block", "words")
    got = F.greatest(F.least(F.col("high"), F.coalesce("words", F.lit(0))) - F.col("low"), F.lit(0))
    taken = pieces.join(slots, ["at", "block"], "left").groupBy("at", "shard", "nth", "doc_id", "size").agg(F.coalesce(F.sum(got), F.lit(0)).cast("long").alias("taken"))
    named = sources.withColumnRenamed("size", "source_size")
    return with_plan(taken, named, ["source_size", "target"], n, "at", "rows").select("doc_id", "size", "source_size", "target", "taken")


def scheduled(docs: DataFrame, block: int = BLOCK, per_shard: int = 20_000) -> DataFrame:
    """The mix itself: slot, at, doc_id, nth, first_word and end_word, the words of a document that a slot takes.

    In order of slot and place (``place``) these are the words of the mix; sums
    by doc_id are what ``mix`` says. Documents of size 0 are in no slot.
    """
    pieces, sources, _ = _pieces(docs, block, per_shard)
    met = schedule(sources, block).join(pieces, ["at", "block"]).withColumn("upto", F.least("high", "words")).where("low < upto")
    begin = F.col("block") * block + F.col("low") - F.col("start")
    return met.select("slot", "at", "doc_id", F.col("low").alias("place"), begin.alias("first_word"), (begin + F.col("upto") - F.col("low")).alias("end_word"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
