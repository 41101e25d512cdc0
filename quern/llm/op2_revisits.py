"""WARC: resolution of not-modified revisits by an as-of join.

A revisit says that a URL still had what an earlier capture holds. It goes with
the latest full response of its canonical URL that is strictly earlier, if the
validators agree: entity tags by weak comparison where the revisit names one,
else the date of the last change. The headers of the answer are the stored ones
updated by those that a 304 response may change (RFC 9110, 15.4.5; RFC 9111,
3.2); fields that describe the body stay as stored.

A URL may hold most captures. Time is cut into spans of about equally many
responses, ``CHUNKS`` or as many as leave ``SPAN_ROWS`` rows to each; captures
are dealt by URL and span, and only the last response of each span travels on
to the spans after it, at most a row a span and URL.

Status: ``resolved``; ``changed`` (an earlier response, other validators);
``unchecked`` (no validator to compare, no match claimed); ``orphan`` (no
earlier response). Captures without URL or time are orphans, which no window
sees, or ignored responses; null headers are none. Of responses at one time the
greatest id counts; repeated revisits each get a row. An empty table gives an
empty result. Only the columns named are read; URLs and headers may be of any
length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import lower_ascii, reached, table

CHUNKS = 64
SPAN_ROWS = 1_000_000
#: Header fields that a not-modified response never changes.
BODY_FIELDS = ("content-encoding", "content-length", "content-md5", "content-range", "content-type", "connection", "keep-alive", "set-cookie", "trailer", "transfer-encoding", "upgrade")
#: Query parameters that only say where a visitor came from.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "ref", "gclid", "fbclid")


def canonical_url(url: Column) -> Column:
    """Without scheme, fragment, default port, tracking fields and last slash; host lower-cased."""
    rest = F.regexp_replace(url, r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://|#.*$", "")
    rest = F.regexp_replace(rest, r"^([^/?]*?):(?:80|443)(?=[/?]|$)", "$1")
    host = lower_ascii(F.regexp_extract(rest, r"^[^/?]*", 0))
    path = F.regexp_replace(F.regexp_extract(rest, r"(?s)^[^/?]*([^?]*)", 1), r"/$", "")
    fields = F.filter(F.split(F.regexp_extract(rest, r"(?s)^[^?]*\?(.*)$", 1), "&"), lambda f: (f != "") & ~F.split_part(f, F.lit("="), F.lit(1)).isin(*TRACKING))
    query_ = F.array_join(F.array_sort(fields), "&")
    return F.concat(host, path, F.when(query_ != "", F.concat(F.lit("?"), query_)).otherwise(F.lit("")))


def _weak(tag: Column) -> Column:
    return F.regexp_replace(tag, r"^W/", "")


def merged_headers(stored: Column, sent: Column) -> Column:
    """map<string, string> with lower-case names."""
    allowed = F.map_filter(sent, lambda k, v: ~k.isin(*BODY_FIELDS) & v.isNotNull())
    return F.map_concat(F.map_filter(stored, lambda k, _: ~F.map_contains_key(allowed, k)), allowed)


def resolve(responses: DataFrame, revisits: DataFrame, chunks: int | None = None) -> DataFrame:
    """One row a revisit: id, url, time, status, response_id, response_time, headers.

    Both take (id long, url string: canonical, time long, headers map with
    lower-case names).
    """
    none = F.create_map().cast("map<string,string>")
    placed = F.col("url").isNotNull() & F.col("time").isNotNull()
    full = responses.where(placed).select("url", "time", F.lit(1).alias("kind"), "id", F.coalesce("headers", none).alias("headers"))
    asked = revisits.where(placed).select("url", "time", F.lit(0).alias("kind"), "id", F.coalesce("headers", none).alias("headers"))
    chunks = chunks or max(CHUNKS, -(-full.count() // SPAN_ROWS))
    marks = full.agg(F.percentile_approx("time", [i / chunks for i in range(1, chunks)], 100 * chunks)).first()[0] if chunks > 1 else None
    span = reached([(m,) for m in sorted(set(marks or []))], [F.col("time")])
    both = full.union(asked).withColumn("chunk", span)
    found = F.when(F.col("kind") == 1, F.struct("id", "time", "headers"))
    # A revisit comes before the responses of its own moment: these are not earlier.
    upto = Window.partitionBy("url", "chunk").orderBy("time", "kind", "id").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("near", F.last(found, ignorenulls=True).over(upto))
    latest = Window.partitionBy("url", "chunk").orderBy(F.desc("time"), F.desc("id"))
    lasts = both.where("kind = 1").withColumn("n", F.row_number().over(latest)).where("n = 1").select("url", "chunk", F.struct("id", "time", "headers").alias("last"))
    spans = both.where("kind = 0").select("url", "chunk").distinct().join(lasts, ["url", "chunk"], "full")
    earlier = Window.partitionBy("url").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.select("url", "chunk", F.last("last", ignorenulls=True).over(earlier).alias("far")).where("far is not null")
    met = seen.where("kind = 0").join(carried, ["url", "chunk"], "left").withColumn("hit", F.when(F.col("time").isNotNull(), F.coalesce("near", "far")))
    had, got = F.col("hit.headers"), F.col("headers")
    tag, date = F.get(F.map_values(F.map_filter(got, lambda k, _: k == "etag")), F.lit(0)), F.get(F.map_values(F.map_filter(got, lambda k, _: k == "last-modified")), F.lit(0))
    had_tag, had_date = F.try_element_at(had, F.lit("etag")), F.try_element_at(had, F.lit("last-modified"))
    same = F.when(tag.isNotNull(), _weak(tag) == _weak(had_tag)).when(date.isNotNull(), date == had_date)
    status = F.when(F.col("hit").isNull(), "orphan").when(tag.isNull() & date.isNull(), "unchecked").when(F.coalesce(same, F.lit(False)), "resolved").otherwise("changed")
    out = met.withColumn("status", status)
    resolved = F.col("status") == "resolved"
    shape = out.select("id", "url", "time", "status", F.when(resolved, F.col("hit.id")).alias("response_id"), F.when(resolved, F.col("hit.time")).alias("response_time"), F.when(resolved, merged_headers(had, got)).alias("headers"))
    void = lambda name: F.lit(None).cast(shape.schema[name].dataType).alias(name)
    lost = revisits.where(~placed).select("id", "url", "time", F.lit("orphan").alias("status"), void("response_id"), void("response_time"), void("headers"))
    return shape.unionByName(lost)


def header_map(block: Column) -> Column:
    """The fields of an HTTP or WARC header block: names lower-cased, of a name that repeats the last value.

    The block ends at the first empty line; its first line is no field. A line
    that begins with a space continues the one before.
    """
    head = F.regexp_extract(F.coalesce(block, F.lit("")), r"(?s)^(.*?)(?:\r?\n\r?\n|$)", 1)
    lines = F.split(F.regexp_replace(F.regexp_replace(head, r"\r\n", "\n"), r"\n[\t ]+", " "), "\n")
    fields = F.filter(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: F.instr(x, ":") > 1)
    pairs = F.transform(fields, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("key"), F.trim(F.regexp_extract(x, r"(?s)^[^:]*:(.*)$", 1)).alias("value")))
    last = F.filter(pairs, lambda e, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda x: x["key"] == e["key"]))
    return F.map_from_entries(last)


def from_records(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Responses and revisits for ``resolve`` from WARC records.

    records: id long, warc (the record's header block) and http (that of its
    payload). A response counts as full unless its status is 304; a revisit
    counts if its profile is server-not-modified or its status 304. Times are
    microseconds of WARC-Date.
    """
    status = F.regexp_extract("http", r"^HTTP/[0-9.]+ ([0-9]{3})", 1)
    seen = records.select("id", header_map(F.col("warc")).alias("w"), header_map(F.col("http")).alias("headers"), status.alias("status"))
    of = lambda name: F.try_element_at(F.col("w"), F.lit(name))
    made = seen.select(
        "id",
        canonical_url(F.regexp_replace(of("warc-target-uri"), r"^<|>$", "")).alias("url"),
        F.unix_micros(F.try_to_timestamp(of("warc-date"))).alias("time"),
        "headers",
        F.lower(of("warc-type")).alias("type"),
        F.coalesce(F.contains(of("warc-profile"), F.lit("server-not-modified")) | (F.col("status") == "304"), F.lit(False)).alias("unmodified"),
    )
    shape = ("id", "url", "time", "headers")
    return made.where("type = 'response' and not unmodified").select(*shape), made.where("type = 'revisit' and unmodified").select(*shape)


#: The crawl that the query makes of ``pages``: each page is a full response at
#: twice its id, and is asked for again LAG captures later with a validator.
LAG = 5000
#: First digits of a page's digest: who asks again by date, without a validator, before the page was there.
BY_DATE, UNCHECKED, EARLY = "0123", "45", "f"


def captures(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    body = F.coalesce("html", F.lit(""))
    tag = F.concat(F.lit('"'), F.substring(F.md5(body.cast("binary")), 1, 16), F.lit('"'))
    digit = F.substring(F.md5(body.cast("binary")), 1, 1)
    date = F.concat(F.lit("day "), (F.octet_length(body) % 1000).cast("string"))
    made = pages.select(F.col("page_id").alias("id"), canonical_url(F.col("url")).alias("url"), tag.alias("tag"), F.octet_length(body).cast("string").alias("long"), digit.alias("digit"), date.alias("day"))
    headers = lambda *x: F.map_filter(F.create_map(*[F.lit(v) if isinstance(v, str) else v for v in x]), lambda _, v: v.isNotNull())
    by_date, unchecked = F.col("digit").isin(*BY_DATE), F.col("digit").isin(*UNCHECKED)
    time = F.col("id") * 2
    responses = made.select("id", "url", time.alias("time"), headers("etag", F.col("tag"), "content-type", "text/html", "content-length", F.col("long"), "last-modified", F.col("day"), "date", time.cast("string")).alias("headers"))
    again = F.when(F.col("digit").isin(*EARLY), time - 1).otherwise(time + 2 * LAG + 1)
    named, dated = F.when(~by_date & ~unchecked, F.concat(F.lit("W/"), F.col("tag"))), F.when(by_date, F.col("day"))
    revisits = made.select("id", "url", again.alias("time"), headers("etag", named, "last-modified", dated, "content-length", "0", "date", again.cast("string"), "cache-control", "max-age=600").alias("headers"))
    return responses, revisits


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve(*captures(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
    return found.select(F.col("id").alias("page_id"), "url", "status", F.col("response_id"), shown.alias("headers"))


ORACLE_SQL = rf"""
WITH p AS (
  SELECT page_id, regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#(?s:.*)$', '') AS rest,
    '"' || substr(md5(coalesce(html, '')), 1, 16) || '"' AS tag, octet_length(encode(coalesce(html, ''))) AS long,
    substr(md5(coalesce(html, '')), 1, 1) AS digit
  FROM pages
), q AS (
  SELECT page_id, tag, long, digit, regexp_replace(rest, '^([^/?]*?):(?:80|443)([/?]|$)', '\1\2') AS rest FROM p
), c AS (
  SELECT page_id, tag, long, digit,
    lower(regexp_extract(rest, '^[^/?]*')) || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/$', '') AS base,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '^[^?]*\?((?s:.*))$', 1), '&'),
      lambda f: f <> '' AND split_part(f, '=', 1) NOT IN ({", ".join(f"'{t}'" for t in TRACKING)}))), '&') AS args
  FROM q
), u AS (
  SELECT page_id, tag, long, digit, 'day ' || (long % 1000) AS day, base || CASE WHEN args <> '' THEN '?' || args ELSE '' END AS url FROM c
), r AS (SELECT page_id, url, tag, long, day, page_id * 2 AS t FROM u),
v AS (
  SELECT page_id, url, tag, day, contains('{BY_DATE}', digit) AS by_date, contains('{UNCHECKED}', digit) AS unchecked,
    page_id * 2 + CASE WHEN contains('{EARLY}', digit) THEN -1 ELSE {2 * LAG + 1} END AS t
  FROM u
), j AS (
  SELECT v.page_id, v.url, v.t, v.tag, v.by_date, r.page_id AS rid, r.tag AS rtag, r.long AS rlong, r.day AS rday,
    CASE WHEN rid IS NULL THEN 'orphan' WHEN v.unchecked THEN 'unchecked' WHEN CASE WHEN v.by_date THEN v.day = r.day ELSE v.tag = r.tag END THEN 'resolved' ELSE 'changed' END AS status
  FROM v ASOF LEFT JOIN r ON v.url = r.url AND v.t > r.t
)
SELECT page_id, url, status,
  CASE WHEN status = 'resolved' THEN rid END AS response_id,
  CASE WHEN status = 'resolved' THEN 'cache-control: max-age=600' || chr(10) || 'content-length: ' || rlong || chr(10) ||
    'content-type: text/html' || chr(10) || 'date: ' || t || chr(10) || 'etag: ' || CASE WHEN by_date THEN rtag ELSE 'W/' || tag END || chr(10) || 'last-modified: ' || rday END AS headers
FROM j
"""
