"""URL filters by a sort-merge range join over reversed hosts.

A host's canonical key is its labels in reverse, each closed by a point:
``www.example.org`` is ``org.example.www.``. The keys of a host and all its
subdomains are one interval, and two such intervals are nested or disjoint.
Pages and rules are sorted by key together; a sweep keeps the stack of rule
hosts whose interval holds the current key, innermost last, and a page takes
the longest path rule of the innermost host that has one that fits.

Both sides are dealt to ranges of the key. A rule whose interval spans several
ranges goes to each of them, and equal page keys may spread over ranges, so a
hot host is no single task. Range bounds come from a bounded sample of keys:
they shape the work, never the result.

A null URL or one without ``://`` has an empty host and path. Rows repeat as
they come; a rule that repeats counts once, and of two rules for one host and
path the later one in the list holds. An empty table gives an empty result. URLs
may be of any length; columns that are not named are not read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, shuffle_partitions, table

#: What a URL gets that no rule fits.
DEFAULT = "allow"
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
SAMPLE_PER_RANGE = 64
SEED = 31


def host(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return lower_ascii(rest)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_key(name: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(name, r"\.")), "."), F.lit("."))


def _bounds(pages: DataFrame, parts: int) -> list[str]:
    """At most parts - 1 keys that cut a sample of the pages into equal shares."""
    n = pages.count()
    want = parts * SAMPLE_PER_RANGE
    some = pages.select("key") if n <= want else pages.select("key").sample(min(1.0, 1.2 * want / n), SEED)
    keys = sorted(r["key"] for r in some.limit(2 * want).collect())
    return [keys[len(keys) * i // parts] for i in range(1, parts)] if keys else []


def sweep(rows: Iterable[tuple]) -> Iterator[tuple]:
    """rows: (range, key, kind, id, host, path, verdict) in that order, rules (kind 0) first.

    Yields (id, host, path, rule, verdict) of each page. The stack holds, for
    each open host, its rules by path and the lengths of these paths.
    """
    stack: list[tuple[str, dict, list]] = []
    at = None
    for part, key, kind, ident, name, where, verdict in rows:
        if part != at:
            at, stack = part, []
        while stack and not key.startswith(stack[-1][0]):
            stack.pop()
        if kind == 0:
            if not stack or stack[-1][0] != key:
                stack.append((key, {}, []))
            by_path, lengths = stack[-1][1:]
            by_path[where] = (f"{name}{where}", verdict)
            if len(where) not in lengths:
                lengths.append(len(where))
                lengths.sort(reverse=True)
            continue
        rule = next((by_path[where[:n]] for _, by_path, lengths in reversed(stack) for n in lengths if n <= len(where) and where[:n] in by_path), None)
        yield (ident, name, where, *(rule or (None, DEFAULT)))


def judge(pages: DataFrame, rules: DataFrame, ident: str = "page_id", url: str = "url", parts: int | None = None) -> DataFrame:
    """``ident``, host, path, rule and verdict of each row of ``pages``.

    rules: verdict, host, path. The innermost host wins, then the longest path.
    """
    spark = pages.sparkSession
    parts = parts or shuffle_partitions(spark)
    kind = pages.schema[ident].dataType
    seen = pages.select(F.col(ident).alias("ident"), host(F.col(url)).alias("host"), path(F.col(url)).alias("path")).withColumn("key", host_key(F.col("host")))
    bounds = _bounds(seen, parts)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Put each page in a range; a key that is a bound several times has several."""
        for batch in batches:
            keys = batch.column("key").to_pylist()
            salt = batch.column("salt").to_pylist()
            out = []
            for k, s in zip(keys, salt, strict=True):
                lo, hi = bisect_left(bounds, k), bisect_right(bounds, k)
                out.append(lo + 1 + s % (hi - lo) if hi > lo else lo)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int32()), *batch.columns[:-1]], names=["part", *batch.schema.names[:-1]])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Put each rule in all ranges that its interval meets."""
        for batch in batches:
            keys = batch.column("key").to_pylist()
            parts_of, index = [], []
            for i, k in enumerate(keys):
                for p in range(bisect_left(bounds, k), bisect_left(bounds, k + "\U0010ffff") + 1):
                    parts_of.append(p)
                    index.append(i)
            taken = batch.take(pa.array(index, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(parts_of, pa.int32()), *taken.columns], names=["part", *taken.schema.names])

    named = rules.select(lower_ascii(F.col("host")).alias("host"), "path", "verdict").dropna()
    named = named.select(host_key(F.col("host")).alias("key"), F.lit(0).alias("kind"), F.lit(None).cast(kind).alias("ident"), "host", "path", "verdict")
    asked = seen.select("key", F.lit(1).alias("kind"), "ident", "host", "path", F.lit(None).cast("string").alias("verdict"), F.pmod(F.xxhash64("ident", "path"), F.lit(1 << 20)).alias("salt"))
    shape = f"part int, key string, kind int, ident {kind.simpleString()}, host string, path string, verdict string"
    both = asked.mapInArrow(deal, shape).unionByName(named.mapInArrow(spread, shape))
    dealt = both.repartition(parts, "part").sortWithinPartitions("part", "key", "kind")
    result = f"{ident} {kind.simpleString()}, host string, path string, rule string, verdict string"
    arrow = [pa.field(n, pa.string()) for n in ("host", "path", "rule", "verdict")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_type: list[pa.DataType] = []

        def rows() -> Iterator[tuple]:
            for batch in batches:
                id_type[:] = [batch.schema.field("ident").type]
                yield from zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True)

        held: list[tuple] = []

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*held, strict=True))
            fields = [pa.field(ident, id_type[0]), *arrow]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=pa.schema(fields))

        for row in sweep(rows()):
            held.append(row)
            if len(held) >= 8192:
                yield batch_of()
                held.clear()
        if held:
            yield batch_of()

    return dealt.mapInArrow(run, result)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(RULES), "verdict string, host string, path string")
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules)


ORACLE_SQL = r"""
WITH parts AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), rules(verdict, rhost, rpath) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
         ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), hits AS (
  SELECT p.page_id, p.host, p.path, r.rhost || r.rpath AS rule, r.verdict,
    row_number() OVER (PARTITION BY p.page_id, p.host, p.path ORDER BY length(r.rhost) DESC NULLS LAST, length(r.rpath) DESC) AS n
  FROM parts p LEFT JOIN rules r
    ON (p.host = r.rhost OR p.host LIKE '%.' || r.rhost) AND starts_with(p.path, r.rpath)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM hits WHERE n = 1
"""
