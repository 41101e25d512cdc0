"""Document fingerprints by consistent weighted sampling (native).

A text is a bag of lower-cased words; the weight of a word is its count. For
each word and each of ``k`` samples, the word's hash yields r, c ~ Gamma(2, 1)
and beta ~ U(0, 1). With S the weight,

    t = floor(ln S / r + beta),  ln y = r (t - beta),  ln a = ln c - ln y - r,

and the sample of the text is the pair (word, t) of the least ``a``. Two texts
agree in a sample with the probability of their generalised Jaccard similarity
sum(min) / sum(max), so the share of equal samples estimates it.

Everything is an expression of Spark SQL. Words stay in the task that reads
their text: one hash aggregate keeps ``k`` bigint minima a text, whose high 31
bits order ``ln a`` and whose low 32 name the pair.

Null and empty texts, and texts of spaces only, are the bag of one empty word;
they equal each other and nothing else. Repeated rows each give a row. An empty
table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import reached, shuffle_partitions, table

K = 32
SEED = 7919
SPACES = r"[\x20\x09-\x0D]+"
_EDGES = "\t\n\x0b\f\r "


def bag(text: Column) -> Column:
    """array<struct<h: bigint, w: bigint>>: word hashes and counts, h ascending.

    Hashes are sorted as primitive longs, then the run starts give the counts.
    """
    words = F.split(F.lower(F.trim(F.coalesce(text, F.lit("")), F.lit(_EDGES))), SPACES)
    hashes = F.sort_array(F.transform(words, lambda x: F.xxhash64(x)))
    runs = F.transform(
        F.array(hashes),
        lambda h: F.struct(
            h.alias("h"),
            F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda i: (i == 0) | (F.get(h, i) != F.get(h, i - 1))).alias("at"),
        ),
    )
    return F.flatten(
        F.transform(
            runs,
            lambda s: F.transform(
                s["at"],
                lambda i, k: F.struct(
                    F.get(s["h"], i).alias("h"),
                    (F.coalesce(F.get(s["at"], k + 1), F.size(s["h"])) - i).cast("long").alias("w"),
                ),
            ),
        )
    )


def _unit(bits: Column, n: int) -> Column:
    """n random bits as a number strictly between 0 and 1."""
    return (bits.cast("double") + 0.5) / float(1 << n)


def sample_key(h: Column, log_weight: Column, j: int) -> Column:
    """bigint of one word in sample j: the order of ln a above, its name below."""
    x, z = F.xxhash64(h, F.lit(SEED + 2 * j)), F.xxhash64(h, F.lit(SEED + 2 * j + 1))
    m21, m32 = F.lit((1 << 21) - 1), F.lit((1 << 32) - 1)
    r = -F.log(_unit(F.shiftrightunsigned(x, 43), 21) * _unit(F.shiftrightunsigned(x, 22).bitwiseAND(m21), 21))
    beta = _unit(x.bitwiseAND(m21), 21)
    log_c = F.log(-F.log(_unit(F.shiftrightunsigned(z, 32), 32) * _unit(z.bitwiseAND(m32), 32)))
    t = F.floor(log_weight / r + beta)
    log_a = log_c - r * (t.cast("double") - beta) - r
    rank = ((log_a + 96.0) * float(1 << 24)).cast("long")
    name = z.bitwiseXOR(F.shiftleft(t, 11)).bitwiseAND(m32)
    return F.shiftleft(rank, 32).bitwiseOR(name)


def fingerprints(df: DataFrame, keys: list[str], text: str, k: int = K) -> DataFrame:
    """``keys`` and ``signature``, an array of k bigint names, one row a key.

    The keys must tell the rows apart. Where ``df`` is already dealt by some of
    the keys, nothing is shuffled; otherwise k longs a text are.
    """
    words = df.select(*keys, F.inline(bag(F.col(text)))).withColumn("lw", F.log(F.col("w").cast("double")))
    least = [F.min(sample_key(F.col("h"), F.col("lw"), j)).alias(f"s{j}") for j in range(k)]
    low = F.lit((1 << 32) - 1)
    return words.groupBy(*keys).agg(*least).select(*keys, F.array(*[F.col(f"s{j}").bitwiseAND(low) for j in range(k)]).alias("signature"))


def likeness(a: Column, b: Column, k: int = K) -> Column:
    """Share of equal samples of two signatures."""
    same = reduce(lambda x, y: x + y, [(F.get(a, F.lit(j)) == F.get(b, F.lit(j))).cast("int") for j in range(k)])
    return same.cast("double") / float(k)


def as_text(signature: Column) -> Column:
    """Eight hexadecimal digits a sample."""
    return F.array_join(F.transform(signature, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def ordered_buckets(df: DataFrame, key: str, tie: str, parts: int) -> DataFrame:
    """Deal rows to buckets that are ranges of (``key``, ``tie``), each with its follower.

    Adds ``bucket`` and ``guest``; a row that begins a bucket also goes, as a
    guest, to the bucket before it, and the very first one to the last. A
    window within a bucket then sees every row's successor without one task
    holding all rows. Spark's own range partitioning of the two numbers, by a
    sample, makes the buckets about equal whatever the values are; the first
    pair of each, one a bucket, reaches the driver. No two rows may share both.
    """
    ranged = df.select(key, tie).repartitionByRange(parts, key, tie).groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct(key, tie)).alias("first"))
    firsts = sorted((r["first"][0], r["first"][1]) for r in ranged.collect())
    if not firsts:
        return df.withColumns({"bucket": F.lit(0), "guest": F.lit(0)})
    homed = df.withColumn("bucket", F.greatest(reached(firsts, [F.col(key), F.col(tie)]) - 1, F.lit(0)))
    at = F.col("bucket")
    begins = (F.col(key) == F.get(F.lit([f[0] for f in firsts]), at)) & (F.col(tie) == F.get(F.lit([f[1] for f in firsts]), at))
    before = F.when(at == 0, F.lit(len(firsts) - 1)).otherwise(at - 1)
    own, guest = F.struct(at.alias("b"), F.lit(0).alias("guest")), F.struct(before.alias("b"), F.lit(1).alias("guest"))
    placed = homed.withColumn("place", F.explode(F.when(begins, F.array(own, guest)).otherwise(F.array(own))))
    return placed.withColumns({"bucket": F.col("place.b"), "guest": F.col("place.guest")}).drop("place")


def edited_likeness(docs: DataFrame, k: int = K, parts: int | None = None) -> DataFrame:
    """Each text against an edited copy and against its successor by doc_id.

    A null doc_id comes before all others; texts that share a doc_id are ordered
    by a hash. Texts are shuffled once, by ranges of doc_id and hash; rows that
    repeat a text under its doc_id, if there are any, are counted before, in one
    shuffle more, as each but the last is followed by its like. Columns other
    than doc_id and text are not read.
    """
    parts = parts or 4 * shuffle_partitions(docs.sparkSession)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(key.alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text", F.col("doc_id").isNull()))
    again = not rows.groupBy("key", "tie").count().where("count > 1").isEmpty()
    if again:
        rows = rows.groupBy("key", "doc_id", "tie").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    else:
        rows = rows.withColumn("copies", F.lit(1).cast("long"))
    placed = ordered_buckets(rows, "key", "tie", parts)
    order = Window.partitionBy("bucket").orderBy("guest", "key", "tie")
    n = F.char_length("text")
    edited = lambda after: F.concat(F.expr("substring(text, 1, char_length(text) - char_length(text) div 2)"), F.expr(f"substring({after}, 1, int(char_length(text) div 2))"))
    seen = placed.withColumns({"next_text": F.lead("text").over(order), "at": F.row_number().over(order), "n_chars": n.cast("long")})
    shape = ["bucket", "guest", "at", "doc_id", "n_chars", "copies"]
    plain = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("t"))
    texts = F.when(F.col("guest") == 1, F.array(plain(0, F.col("text"))))
    if again:  # the edited text of a row that its like follows
        texts = texts.when(F.col("copies") > 1, F.array(plain(0, F.col("text")), plain(1, edited("next_text")), plain(3, edited("text"))))
    texts = texts.otherwise(F.array(plain(0, F.col("text")), plain(1, edited("next_text"))))
    flat = seen.select(*shape, F.explode(texts).alias("x")).select(*shape, F.col("x.kind").alias("kind"), F.when(F.col("x.kind") > 0, F.sha2(F.col("x.t"), 256)).alias("sha"), F.col("x.t").alias("t"))
    signed = fingerprints(flat, [*shape, "kind", "sha"], "t", k)
    by_place = Window.partitionBy("bucket").orderBy("at", "kind")
    ahead = lambda name, by: F.lead(name, by).over(by_place)
    found = signed.withColumns({"edited": ahead("signature", 1), "edited_sha256": ahead("sha", 1), "one": ahead("signature", 2), "one_kind": ahead("kind", 2), "one_sha": ahead("sha", 2), "two": ahead("signature", 3)})
    found = found.where("guest = 0 and kind = 0")
    like = F.coalesce(F.col("one_kind") == 3, F.lit(False)) & (F.col("copies") > 1)
    followed = F.when(like, F.col("two")).otherwise(F.col("one"))

    def out(df: DataFrame, edited_signature: Column, next_signature: Column, sha: Column) -> DataFrame:
        return df.select(
            "doc_id",
            "n_chars",
            sha.alias("edited_sha256"),
            as_text(F.col("signature")).alias("fingerprint"),
            as_text(edited_signature).alias("edited_fingerprint"),
            likeness(F.col("signature"), edited_signature, k).alias("near_edited"),
            likeness(F.col("signature"), next_signature, k).alias("near_next"),
        )

    if not again:
        return out(found, F.col("edited"), F.col("one"), F.col("edited_sha256"))
    cases = F.array(F.struct(F.col("edited").alias("e"), followed.alias("n"), F.col("edited_sha256").alias("s")))
    inner = F.array_repeat(F.struct(F.col("one").alias("e"), F.col("signature").alias("n"), F.col("one_sha").alias("s")), (F.col("copies") - 1).cast("int"))
    every = found.withColumn("case", F.explode(F.when(like, F.concat(cases, inner)).otherwise(cases)))
    return out(every, F.col("case.e"), F.col("case.n"), F.col("case.s"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_likeness(table(spark, sf_dir, "documents"))
