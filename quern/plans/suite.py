"""Named queries over the driver's tables, each with SQL that says the same.

Most are statements of the language; the rest call the operators that have no
statement. Sums of fractions are rounded on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.values import field
from quern.operators import changes as C
from quern.operators import relational as R
from quern.operators import stats, versions
from quern.sources import jsonl
from quern.sources.scratch import scratch
from quern.streaming import changes as S

from .lower import condition
from .parser import parse
from .session import Session
from .syntax import Aggregate, Change

#: Tables and the fields that order their documents.
TABLES: dict[str, str | tuple[str, ...]] = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "lineitem": ("l_orderkey", "l_linenumber"), "events": "event_id", "documents": "doc_id", "pages": "page_id", "conversations": ("conv_id", "turn"), "labels": "doc_id", "benchmark": "item_id"}

Build = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Build] = {}
_ORACLES: dict[str, str] = {}

#: ``events`` with a field that is missing in some rows.
SPARSE_SQL = "(SELECT event_id, user_id, value, nullif(event_type, 'view') AS note FROM events)"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def session(spark: SparkSession, sf_dir: str) -> Session:
    """All driver tables as read-only collections, and ``sparse``."""

    class Lazy(dict):
        def __missing__(self, name: str):
            self[name] = (sparse(spark, sf_dir), "event_id") if name == "sparse" else (read(spark, sf_dir, name), TABLES[name])
            return self[name]

        def __contains__(self, name: object) -> bool:
            return name in TABLES or name == "sparse"

    return Session(spark, tables=Lazy())


def sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", "user_id", "value", F.nullif("event_type", F.lit("view")).alias("note"))


def add(name: str, build: Build, sql: str | None) -> None:
    _QUERIES[name] = build
    if sql:
        _ORACLES[name] = sql


def say(name: str, statement: str, sql: str, rounded: tuple[str, ...] = ()) -> None:
    """Register a statement; ``rounded`` columns to two places."""

    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = session(spark, sf_dir).sql(statement)
        df = df.toDF(*[c.replace(".", "_") for c in df.columns])
        for c in rounded:
            df = df.withColumn(c, F.round(c, 2))
        return df

    add(name, build, sql)


FLAGSHIP = 'funden lineitem haar l_quantity $bh 45 $vand l_returnflag $bg "R" orange bi l_extendedprice desc, l_orderkey, l_linenumber lime 10'


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session(spark, sf_dir).sql(FLAGSHIP)


# Scans, order, limits.
say("flagship", FLAGSHIP, "SELECT * FROM lineitem WHERE l_quantity > 45 AND l_returnflag = 'R' ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 10")
say("scan_nation", "funden nation", "SELECT * FROM nation")
say("point_read", "funden orders haar o_orderkey $bg 7", "SELECT * FROM orders WHERE o_orderkey = 7")
say("limit_offset_orders", "funden orders orange bi o_orderkey lime 20 skopan 40", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 40")
say("sort_asc", "funden supplier orange bi s_acctbal asc, s_suppkey", "SELECT * FROM supplier ORDER BY s_acctbal, s_suppkey")
say("sort_desc_multi", "funden customer orange bi c_nationkey desc, c_acctbal desc, c_custkey lime 50", "SELECT * FROM customer ORDER BY c_nationkey DESC, c_acctbal DESC, c_custkey LIMIT 50")
say("topk_desc", "funden part orange bi p_retailprice desc, p_partkey lime 10", "SELECT * FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10")
say("sort_offset", "funden part orange bi p_size, p_partkey lime 10 skopan 5", "SELECT * FROM part ORDER BY p_size, p_partkey LIMIT 10 OFFSET 5")
say("sort_nulls_first", "funden sparse orange bi note, event_id lime 25", f"SELECT * FROM {SPARSE_SQL} ORDER BY note NULLS FIRST, event_id LIMIT 25")
say("sort_nulls_last", "funden sparse orange bi note desc, event_id lime 1500", f"SELECT * FROM {SPARSE_SQL} ORDER BY note DESC NULLS LAST, event_id LIMIT 1500")

# Predicates.
for _name, _where, _sql in (
    ("filter_eq_str", 'o_orderstatus $bg "F"', "o_orderstatus = 'F'"),
    ("filter_eq_num", "o_custkey $bg 10", "o_custkey = 10"),
    ("filter_ne", 'o_orderstatus $kc "O"', "o_orderstatus <> 'O'"),
    ("filter_lt", "o_totalprice $lh 1500.5", "o_totalprice < 1500.5"),
    ("filter_gt", "o_totalprice $bh 300000", "o_totalprice > 300000"),
    ("filter_le", "o_orderkey $lhb 25", "o_orderkey <= 25"),
    ("filter_ge", "o_custkey $bhb 140", "o_custkey >= 140"),
    ("filter_contains", 'o_orderpriority $xau "HIGH"', "contains(o_orderpriority, 'HIGH')"),
    ("filter_in_str", 'o_orderstatus $tg ["F", "P"]', "o_orderstatus IN ('F', 'P')"),
    ("filter_in_num", "o_custkey $tg [1, 4, 9.5, 16]", "o_custkey IN (1, 4, 16)"),
    ("filter_in_one", 'o_orderstatus $tg "P"', "o_orderstatus = 'P'"),
    ("filter_not_in", 'o_orderstatus $ktg ["F", "P"]', "o_orderstatus NOT IN ('F', 'P')"),
    ("filter_and", 'o_orderstatus $bg "F" $vand o_totalprice $bh 200000', "o_orderstatus = 'F' AND o_totalprice > 200000"),
    ("filter_or", 'o_orderstatus $bg "P" $vor o_totalprice $bh 300000', "o_orderstatus = 'P' OR o_totalprice > 300000"),
    ("filter_left_assoc", 'o_orderstatus $bg "P" $vor o_orderstatus $bg "F" $vand o_totalprice $lh 50000', "(o_orderstatus = 'P' OR o_orderstatus = 'F') AND o_totalprice < 50000"),
    ("filter_and_not", 'o_custkey $lh 50 $vand $vnot o_orderstatus $bg "F"', "o_custkey < 50 AND NOT o_orderstatus = 'F'"),
    ("filter_str_range", 'o_orderpriority $bhb "2" $vand o_orderpriority $lh "4"', "o_orderpriority >= '2' AND o_orderpriority < '4'"),
    ("filter_mixed_type", 'o_orderstatus $bg 5 $vor o_custkey $bg "10" $vor o_custkey $bg 11', "o_custkey = 11"),
):
    say(_name, f"funden orders haar {_where}", f"SELECT * FROM orders WHERE {_sql}")
for _name, _where, _sql in (
    ("filter_exists", "note $tntt", "note IS NOT NULL"),
    ("filter_not_exists", "$vnot note $tntt", "note IS NULL"),
    ("filter_not", '$vnot note $bg "click"', "NOT coalesce(note = 'click', false)"),
    ("filter_not_gt", "$vnot value $bh 50", "NOT coalesce(value > 50, false)"),
    ("filter_ne_missing", 'note $kc "click"', "note <> 'click'"),
    ("filter_not_in_missing", 'note $ktg ["click", "error"]', "note NOT IN ('click', 'error')"),
    ("filter_not_member", '$vnot note $tg ["click", "error"]', "NOT coalesce(note IN ('click', 'error'), false)"),
    ("filter_not_contains", '$vnot note $xau "ign"', "NOT coalesce(contains(note, 'ign'), false)"),
    ("filter_unknown_field", "$vnot nothing $bg 1", "true"),
):
    say(_name, f"funden sparse haar {_where}", f"SELECT * FROM {SPARSE_SQL} WHERE {_sql}")

# Aggregates.
say("gb_count", "gomail orders gremb bi o_orderstatus pou o_orderkey", "SELECT o_orderstatus, count(*) AS pou_o_orderkey FROM orders GROUP BY 1")
say("gb_sum", "gomail lineitem gremb bi l_returnflag sep l_quantity", "SELECT l_returnflag, round(sum(l_quantity), 2) AS sep_l_quantity FROM lineitem GROUP BY 1", ("sep_l_quantity",))
say("gb_avg_star", "gomail sparse gremb bi note awr value", f"SELECT note, round(coalesce(sum(value), 0) / count(*), 2) AS awr_value FROM {SPARSE_SQL} GROUP BY 1", ("awr_value",))
say("gb_min", "gomail part gremb bi p_brand mie p_retailprice", "SELECT p_brand, min(p_retailprice) AS mie_p_retailprice FROM part GROUP BY 1")
say("gb_max", "gomail part gremb bi p_brand maf p_size", "SELECT p_brand, max(p_size)::DOUBLE AS maf_p_size FROM part GROUP BY 1")
say(
    "gb_multi",
    "gomail lineitem gremb bi l_linestatus pou l_tax, sep l_quantity, awr l_discount, mie l_tax, maf l_extendedprice",
    "SELECT l_linestatus, count(*) AS pou_l_tax, round(sum(l_quantity), 2) AS sep_l_quantity, round(avg(l_discount), 2) AS awr_l_discount, min(l_tax) AS mie_l_tax, max(l_extendedprice) AS maf_l_extendedprice FROM lineitem GROUP BY 1",
    ("sep_l_quantity", "awr_l_discount"),
)
say("gb_filtered", 'gomail orders haar o_orderstatus $bg "F" gremb bi o_orderpriority pou x', "SELECT o_orderpriority, count(*) AS pou_x FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
say("gb_numeric_key", "gomail customer gremb bi c_nationkey sep c_acctbal", "SELECT c_nationkey, round(sum(c_acctbal), 2) AS sep_c_acctbal FROM customer GROUP BY 1", ("sep_c_acctbal",))
say("gb_text_field", "gomail customer gremb bi c_mktsegment sep c_name, mie c_name", "SELECT c_mktsegment, 0.0::DOUBLE AS sep_c_name, 0.0::DOUBLE AS mie_c_name FROM customer GROUP BY 1")
say("gb_sort_limit", "gomail orders gremb bi o_custkey pou n orange bi pou_n desc, o_custkey lime 10", "SELECT o_custkey, count(*) AS pou_n FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
say("gb_null_key", "gomail sparse gremb bi note pou n", f"SELECT note, count(*) AS pou_n FROM {SPARSE_SQL} GROUP BY 1")
add("gb_drop_nulls", lambda s, d: R.grouped(sparse(s, d), "note", [Aggregate("pou", "n")], nulls="drop"), f"SELECT note, count(*) AS pou_n FROM {SPARSE_SQL} WHERE note IS NOT NULL GROUP BY 1")
add("gb_avg_present", lambda s, d: R.grouped(sparse(s, d), "note", [Aggregate("awr", "value")], average="present").withColumn("awr_value", F.round("awr_value", 2)), f"SELECT note, round(avg(value), 2) AS awr_value FROM {SPARSE_SQL} GROUP BY 1")
add(
    "agg_global",
    lambda s, d: R.grouped(read(s, d, "lineitem"), None, [Aggregate("pou", "n"), Aggregate("maf", "l_quantity"), Aggregate("mie", "l_quantity")]),
    "SELECT count(*) AS pou_n, max(l_quantity) AS maf_l_quantity, min(l_quantity) AS mie_l_quantity FROM lineitem",
)
add("agg_rollup", lambda s, d: R.rolled_up(read(s, d, "lineitem"), ["l_returnflag", "l_linestatus"], [Aggregate("pou", "n")]), "SELECT l_returnflag, l_linestatus, count(*) AS pou_n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
add("agg_cube", lambda s, d: R.rolled_up(read(s, d, "orders"), ["o_orderstatus", "o_orderpriority"], [Aggregate("pou", "n")], "cube"), "SELECT o_orderstatus, o_orderpriority, count(*) AS pou_n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
add("distinct_values", lambda s, d: R.distinct_values(read(s, d, "part"), "p_brand", "p_size"), "SELECT DISTINCT p_brand, p_size FROM part")
add("collection_count", lambda s, d: read(s, d, "orders").agg(F.count("*").alias("n")), "SELECT count(*) AS n FROM orders")

# Joins.
_FIRST = "SELECT * FROM (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1)"
_PREFIXED = "o_orderkey AS o_o_orderkey, o_custkey AS o_o_custkey, o_orderstatus AS o_o_orderstatus, o_totalprice AS o_o_totalprice, o_orderdate AS o_o_orderdate, o_orderpriority AS o_o_orderpriority"
say("lookup_first", "funden customer $rasoat o tu orders on c_custkey $bg orders.o_custkey", f"SELECT c.*, {_PREFIXED} FROM customer c LEFT JOIN ({_FIRST}) r ON c.c_custkey = r.o_custkey")
say(
    "lookup_named_fields",
    "funden nation $rasoat region local_field n_regionkey target_field r_regionkey",
    "SELECT n.*, r_regionkey AS region_r_regionkey, r_name AS region_r_name FROM nation n LEFT JOIN region ON n_regionkey = r_regionkey",
)
say(
    "lookup_filtered_sorted",
    'funden customer haar c_mktsegment $bg "BUILDING" $rasoat o from orders on c_custkey $bg o_custkey orange bi c_acctbal desc, c_custkey lime 15',
    f"SELECT c.*, {_PREFIXED} FROM (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_acctbal DESC, c_custkey LIMIT 15) c LEFT JOIN ({_FIRST}) r ON c.c_custkey = r.o_custkey",
)
say("lookup_no_target", "funden nation $rasoat x tu nowhere on n_regionkey $bg r", "SELECT * FROM nation")


LINE = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


def _line(alias: str) -> str:
    return ", ".join(f"{c} AS {alias}{c}" for c in LINE)


def _flat(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.replace(".", "_") for c in df.columns])


say(
    "lookup_first_line",
    "funden orders $rasoat l tu lineitem on o_orderkey $bg l_orderkey",
    f"SELECT o.*, {_line('l_')} FROM orders o LEFT JOIN (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(('l_linenumber', *(c for c in LINE[1:] if c != 'l_linenumber')))}) = 1) l ON o_orderkey = l_orderkey",
)
add(
    "lookup_ties",
    lambda s, d: _flat(R.lookup_first(read(s, d, "orders"), read(s, d, "lineitem"), "o_orderkey", "l_orderkey", "l", "l_orderkey")),
    f"SELECT o.*, {_line('l_')} FROM orders o LEFT JOIN (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(LINE[1:])}) = 1) l ON o_orderkey = l_orderkey",
)
add("lookup_inner_first", lambda s, d: _flat(R.lookup_first(read(s, d, "customer"), read(s, d, "orders"), "c_custkey", "o_custkey", "o", "o_orderkey", "inner")), f"SELECT c.*, {_PREFIXED} FROM customer c JOIN ({_FIRST}) r ON c.c_custkey = r.o_custkey")
add("lookup_all", lambda s, d: _flat(R.lookup_all(read(s, d, "supplier"), read(s, d, "nation"), "s_nationkey", "n_nationkey", "n")), "SELECT s.*, n_nationkey AS n_n_nationkey, n_name AS n_n_name, n_regionkey AS n_n_regionkey FROM supplier s LEFT JOIN nation ON s_nationkey = n_nationkey")
add("join_semi", lambda s, d: read(s, d, "customer").join(read(s, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi"), "SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
add("join_anti", lambda s, d: read(s, d, "customer").join(read(s, d, "orders").where("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti"), "SELECT * FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
add(
    "lookup_collected",
    lambda s, d: R.collected(read(s, d, "region"), read(s, d, "nation"), "r_regionkey", "n_regionkey", "nations").select("r_name", F.size("nations").cast("long").alias("n"), F.array_join(F.array_sort(F.transform("nations", lambda x: x["n_name"])), ",").alias("names")),
    "SELECT r_name, count(n_name) AS n, coalesce(string_agg(n_name, ',' ORDER BY n_name), '') AS names FROM region LEFT JOIN nation ON r_regionkey = n_regionkey GROUP BY r_name",
)


# Writes as dataflow.
def _changed(name: str, where: str | None, *changes: Change) -> Build:
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = sparse(spark, sf_dir) if name == "sparse" else read(spark, sf_dir, name)
        return C.updated(df, condition(df, parse(f"demlet {name} haar {where}").where) if where else None, changes)

    return build


add("update_set", _changed("customer", "c_acctbal $lh 0", Change("$quy", "c_mktsegment", "DEBT")), "SELECT * REPLACE (CASE WHEN c_acctbal < 0 THEN 'DEBT' ELSE c_mktsegment END AS c_mktsegment) FROM customer")
add(
    "update_multi_op",
    _changed("sparse", 'note $bg "click"', Change("$quy", "value", 0.5), Change("$quy", "seen", "yes"), Change("$don", "note", "hot")),
    f"SELECT event_id, user_id, CASE WHEN note = 'click' THEN 0.5 ELSE value END AS value, CASE WHEN note = 'click' THEN 'click,hot' ELSE note END AS note, CASE WHEN note = 'click' THEN 'yes' END AS seen FROM {SPARSE_SQL}",
)
add("push_tag", _changed("sparse", None, Change("$don", "note", "new"), Change("$don", "note", 3.0)), f"SELECT event_id, user_id, value, coalesce(note || ',', '') || 'new,3' AS note FROM {SPARSE_SQL}")
add(
    "pull_tag",
    _changed("sparse", "value $bhb 0", Change("$don", "note", "a"), Change("$don", "note", "b"), Change("$loi", "note", "a")),
    f"SELECT event_id, user_id, value, CASE WHEN value >= 0 THEN coalesce(note || ',', '') || 'b' ELSE note END AS note FROM {SPARSE_SQL}",
)


def _delete_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = sparse(spark, sf_dir)
    return C.deleted(df, condition(df, parse('demlet sparse haar note $bg "click"').where))


add("delete_where", _delete_where, f"SELECT * FROM {SPARSE_SQL} WHERE NOT coalesce(note = 'click', false)")


def _insert_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = spark.createDataFrame([(100, "ATLANTIS", "new"), (101, "MU", None)], "n_nationkey int, n_name string, state string")
    return C.inserted(read(spark, sf_dir, "nation"), new)


add("insert_batch", _insert_batch, "SELECT *, NULL::VARCHAR AS state FROM nation UNION ALL VALUES (100, 'ATLANTIS', NULL, 'new'), (101, 'MU', NULL, NULL)")


def _store_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert, update, delete and read back through the store."""
    x = Session(spark, scratch(spark, "store"), tables={})
    df = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("double").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    state = x.store.read().draft()
    x._made("customers", state).add(x.store.write(df))
    x.store.publish(state)
    for s in ('cochin customers haar balance $lh 0 $quy segment "DEBT" $don tags "late"', 'demlet customers haar segment $bg "BUILDING"', 'vietinfo customers {id: 900000, name: "New", balance: 1}'):
        result = x.execute(s)
        if not result.ok:
            raise RuntimeError(result.text())
    return x.sql("funden customers")


add(
    "store_round_trip",
    _store_round_trip,
    "SELECT c_custkey::DOUBLE AS id, c_name AS name, c_acctbal AS balance, CASE WHEN c_acctbal < 0 THEN 'DEBT' ELSE c_mktsegment END AS segment, CASE WHEN c_acctbal < 0 THEN 'late' END AS tags FROM customer WHERE c_acctbal < 0 OR c_mktsegment <> 'BUILDING' UNION ALL VALUES (900000.0, 'New', 1.0, NULL, NULL)",
)


def _jsonl_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write customers as JSON Lines and import them."""
    path = scratch(spark, "jsonl")
    read(spark, sf_dir, "customer").select(F.to_json(F.struct("*"))).write.text(path)
    return jsonl.read_file(spark, path)[0]


add("jsonl_import", _jsonl_import, "SELECT c_custkey::DOUBLE AS c_custkey, c_name, c_nationkey::DOUBLE AS c_nationkey, c_acctbal, c_mktsegment FROM customer")


def _variant_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict schemaless mode: a field of two types compares by type."""
    df = read(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "view", F.col("event_type").cast("variant")).otherwise(F.col("value").cast("variant")).alias("x"))
    return df.where(condition(df, parse('funden t haar x $bh 50 $vor x $bg "view"').where)).select("event_id")


add("variant_filter", _variant_filter, "SELECT event_id FROM events WHERE (event_type <> 'view' AND value > 50) OR event_type = 'view'")

def _jsonl_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field that is a number in some lines and a string in others keeps both types through the import."""
    path = scratch(spark, "mixed")
    value = F.when(F.col("event_type") == "view", F.lit('"view"')).otherwise(F.coalesce(F.col("value").cast("string"), F.lit("null")))
    read(spark, sf_dir, "events").select(F.concat(F.lit('{"event_id":'), F.col("event_id").cast("string"), F.lit(',"x":'), value, F.lit("}"))).write.text(path)
    df = jsonl.read_file(spark, path)[0]
    return df.where(condition(df, parse('funden t haar x $bh 50 $vor x $bg "view"').where)).select(F.col("event_id").cast("long").alias("event_id"))


add("jsonl_mixed_types", _jsonl_mixed, "SELECT event_id::BIGINT AS event_id FROM events WHERE (event_type <> 'view' AND value > 50) OR event_type = 'view'")


def _jsonl_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "\n".join(r[0] for r in read(spark, sf_dir, "nation").select(F.to_json(F.struct("*"))).collect())  # a body that the driver holds
    return jsonl.read_buffer(spark, text)[0]


add("jsonl_buffer", _jsonl_buffer, "SELECT n_name, n_nationkey::DOUBLE AS n_nationkey, n_regionkey::DOUBLE AS n_regionkey FROM nation")


def _mixed_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of two types orders by type, then by value."""
    df = read(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "view", F.col("event_type").cast("variant")).otherwise(F.col("value").cast("variant")).alias("x"))
    return Session(spark, tables={"t": (df, "event_id")}).sql("funden t orange bi x desc, event_id lime 600").select("event_id")


add("sort_mixed_types", _mixed_sort, "SELECT event_id FROM events ORDER BY (event_type = 'view' OR value IS NULL)::INT DESC, CASE WHEN event_type <> 'view' THEN value END DESC NULLS LAST, event_id LIMIT 600")


def _own_table(name: str, statement: str, df: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    add(name, lambda s, d: _flat(Session(s, tables={"t": (df(s, d), "id")}).sql(statement)), sql)


_own_table("flat_keys", 'funden t haar home.city $xau "A" orange bi home.city desc lime 10', lambda s, d: read(s, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("home.city")), "SELECT n_nationkey AS id, n_name AS home_city FROM nation WHERE contains(n_name, 'A') ORDER BY 2 DESC LIMIT 10")
_own_table("gb_bool_key", "gomail t gremb bi big pou n, maf o_totalprice", lambda s, d: read(s, d, "orders").withColumn("big", F.col("o_totalprice") > 100000), "SELECT o_totalprice > 100000 AS big, count(*) AS pou_n, max(o_totalprice) AS maf_o_totalprice FROM orders GROUP BY 1")

#: Statements one after another in a new store, each with the code of its error, or none.
STATEMENTS = (
    ("madeco shops", ""),
    ("madeco shops", "EXISTS"),
    ('vietinfo shops [{name: "A", size: 3}, {name: "B", size: 5}, {name: "C"}]', ""),
    ("madecoidu shops.name", ""),
    ("madecoidu shops.name", "EXISTS"),
    ("analyze shops", ""),
    ("exepanus funden shops haar name $bg \"B\"", ""),
    ("usf other", ""),
    ("skill shops", ""),
    ("skill", ""),
    ("ginan", ""),
    ("ginan", "TX_LIMIT"),
    ('cochin shops haar name $bg "A" $quy size 9', ""),
    ("tulaberk", ""),
    ("tulaberk", "NO_TX"),
    ("ginan", ""),
    ('cochin shops haar name $bg "B" $quy size 7', ""),
    ("cometi", ""),
    ("cometi", "NO_TX"),
    ('demlet shops haar name $bg "C"', ""),
    ("delecoidu shops.name", ""),
    ("delecoidu shops.name", "NOT_FOUND"),
    ("madeco gone", ""),
    ("delco gone", ""),
    ("delco gone", "NO_COLLECTION"),
)


def _statements(spark: SparkSession) -> tuple[Session, list[tuple[int, str]]]:
    x = Session(spark, scratch(spark, "statements"), tables={})
    return x, [(i, x.execute(s).code) for i, (s, _) in enumerate(STATEMENTS)]


add("catalog_statements", lambda s, d: s.createDataFrame(_statements(s)[1], "step int, code string"), "VALUES " + ", ".join(f"({i}, '{code}')" for i, (_, code) in enumerate(STATEMENTS)))
_ORACLES["catalog_statements"] = f"SELECT col0::INT AS step, col1 AS code FROM ({_ORACLES['catalog_statements']})"
add("tx_commit", lambda s, d: _statements(s)[0].sql("funden shops"), "SELECT * FROM (VALUES (1.0::DOUBLE, 'A', 3.0::DOUBLE), (2.0, 'B', 7.0)) t(id, name, size)")
add("stats_kept", lambda s, d: _statements(s)[0].statistics("shops").drop("distinct"), "SELECT * FROM (VALUES ('id', 3::BIGINT, 0::BIGINT, 1.0::DOUBLE, 3.0::DOUBLE, 2.0::DOUBLE), ('name', 3, 0, NULL, NULL, NULL), ('size', 2, 1, 3.0, 5.0, 4.0)) t(field, present, missing, low, high, mean)")


def _import_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = Session(spark, scratch(spark, "counts"), tables={})
    x.run(parse("ginan"))
    seen = x.load("t", text='{"a": 1}\n# note\n\n{"a": "x", "id": 40}\n{broken\n{"id": "none", "a": 2}')
    x.run(parse("cometi"))
    row = (seen.lines_read, seen.docs_inserted, seen.parse_errors, seen.insert_errors, x.sql('funden t haar a $bg "x"').count())
    return spark.createDataFrame([row], "lines_read int, docs_inserted int, parse_errors int, insert_errors int, strings long")


add("import_counts", _import_counts, "SELECT 6 AS lines_read, 2 AS docs_inserted, 1 AS parse_errors, 1 AS insert_errors, 1::BIGINT AS strings")


def _index_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An indexed field has Bloom filters in the files, which readers skip by."""
    x = Session(spark, scratch(spark, "index"), tables={})
    state = x.store.read().draft()
    df = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("double").alias("id"), F.col("c_name").alias("name"))
    x._made("customers", state).indexes.append("name")
    state.collections["customers"].add(x.store.write(df, ["name"]))
    x.store.publish(state)
    return x.sql('funden customers haar name $bg "Customer#000000042"')


add("index_lookup", _index_lookup, "SELECT c_custkey::DOUBLE AS id, c_name AS name FROM customer WHERE c_name = 'Customer#000000042'")


# Statistics.
add(
    "stats_minmaxavg",
    lambda s, d: stats.profile(read(s, d, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice"), exact=True).withColumn("mean", F.round("mean", 2)),
    " UNION ALL ".join(
        f"SELECT '{c}' AS field, count({c}) AS present, count(*) - count({c}) AS missing, count(DISTINCT {c}) AS \"distinct\", {low} AS low, {high} AS high, {mean} AS mean FROM part"
        for c, low, high, mean in [(c, f"min({c})::DOUBLE", f"max({c})::DOUBLE", f"round(avg({c}), 2)") if c != "p_brand" else (c, "NULL::DOUBLE", "NULL::DOUBLE", "NULL::DOUBLE") for c in ("p_partkey", "p_brand", "p_size", "p_retailprice")]
    ),
)
add(
    "stats_null_distinct",
    lambda s, d: stats.profile(sparse(s, d).select("note"), exact=True).select("field", "present", "missing", "distinct"),
    f"SELECT 'note' AS field, count(note) AS present, count(*) - count(note) AS missing, count(DISTINCT note) AS \"distinct\" FROM {SPARSE_SQL}",
)
add("stats_topk_exact", lambda s, d: stats.frequent(read(s, d, "lineitem"), "l_suppkey"), "SELECT l_suppkey AS value, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
add(
    "stats_equidepth_hist",
    lambda s, d: stats.histogram(read(s, d, "lineitem"), "l_extendedprice"),
    "SELECT b.bucket::INT AS bucket, v AS bound FROM (SELECT unnest(range(32)) AS bucket) b JOIN (SELECT l_extendedprice AS v, row_number() OVER (ORDER BY l_extendedprice) AS r, count(*) OVER () AS n FROM lineitem) x ON r = greatest((b.bucket + 1) * n // 32, 1)",
)
add("stats_selectivity", lambda s, d: stats.selectivity(read(s, d, "lineitem"), field("l_quantity") > 25).select(F.round("selectivity", 6).alias("selectivity")), "SELECT round(avg((l_quantity > 25)::INT), 6) AS selectivity FROM lineitem")
add("stats_sizes", lambda s, d: stats.sizes(read(s, d, "nation")).withColumn("row_bytes", F.round("row_bytes", 6)), "SELECT count(*) AS rows, round(avg(strlen(to_json(nation)::VARCHAR)), 6) AS row_bytes FROM nation")
add("stats_join_size", lambda s, d: stats.join_size(read(s, d, "customer"), read(s, d, "nation"), "c_nationkey", "n_nationkey", exact=True), "SELECT (SELECT count(*) FROM customer) * (SELECT count(*) FROM nation) / greatest((SELECT count(DISTINCT c_nationkey) FROM customer), (SELECT count(DISTINCT n_nationkey) FROM nation))::DOUBLE AS rows")

# Versions and log-structured tables, over the events of each user.
def _gone() -> Column:
    return F.col("event_type") == "error"


add("mvcc_latest", lambda s, d: versions.newest(read(s, d, "events").drop("ts"), "user_id", "event_id"), "SELECT * EXCLUDE ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
add(
    "mvcc_ties",
    lambda s, d: versions.newest(read(s, d, "events").drop("ts").withColumn("seq", F.expr("event_id div 100")), "user_id", "seq"),
    "SELECT * FROM (SELECT * EXCLUDE ts, (event_id // 100)::BIGINT AS seq FROM events) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY seq DESC, event_id) = 1",
)
add(
    "mvcc_asof",
    lambda s, d: versions.as_of(read(s, d, "events").drop("ts"), "user_id", "event_id", 600, _gone(), created_by="event_id", created="event_id", deleted=None),
    "SELECT * FROM (SELECT * EXCLUDE ts FROM events WHERE event_id <= 600 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) WHERE event_type <> 'error'",
)
add(
    "mvcc_visible",
    lambda s, d: versions.visible(read(s, d, "events").select("event_id", "user_id"), 500, me=3, active=[5, 7], created_by="user_id", created="event_id", deleted=None),
    "SELECT event_id, user_id FROM events WHERE user_id = 3 OR (event_id <= 500 AND user_id NOT IN (5, 7))",
)
add(
    "mvcc_vacuum_keep",
    lambda s, d: versions.vacuumed(read(s, d, "events").drop("ts"), "user_id", "event_id", 700),
    "SELECT * EXCLUDE (ts, a) FROM (SELECT *, max(event_id) FILTER (WHERE event_id <= 700) OVER (PARTITION BY user_id) AS a FROM events) WHERE a IS NULL OR event_id >= a",
)
add(
    "mvcc_vacuum_counts",
    lambda s, d: versions.vacuum_counts(read(s, d, "events"), "user_id", "event_id", 700),
    "SELECT count(*) AS scanned, count(*) FILTER (WHERE a IS NULL OR event_id >= a) AS kept, count(*) FILTER (WHERE event_id < a) AS dropped, count(DISTINCT user_id) AS keys FROM (SELECT *, max(event_id) FILTER (WHERE event_id <= 700) OVER (PARTITION BY user_id) AS a FROM events)",
)
add(
    "ww_conflicts",
    lambda s, d: versions.write_conflicts(read(s, d, "events").select("user_id", (F.col("event_id") - 50).alias("began"), F.col("event_id").alias("committed"), F.col("event_id").alias("tx")), "user_id", "began", "committed", "tx"),
    "SELECT user_id, w AS winner, event_id AS loser FROM (SELECT user_id, event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS w FROM events) WHERE w > event_id - 50",
)
add(
    "tx_conflicts",
    lambda s, d: versions.conflicts(read(s, d, "events").where("event_type = 'signup'"), read(s, d, "events"), "user_id", 900, "event_id"),
    "SELECT DISTINCT user_id FROM events WHERE event_type = 'signup' AND user_id IN (SELECT user_id FROM events WHERE event_id > 900)",
)
add(
    "mvcc_recovered",
    lambda s, d: versions.recovered(
        read(s, d, "events").select("event_id", "user_id", (F.col("event_id") % 97).alias("tx"), F.when(F.col("event_type") == "signup", "commit").when(F.col("event_type") == "error", "abort").otherwise("write").alias("kind")), "user_id", "event_id", "tx", "kind"
    ),
    "WITH l AS (SELECT event_id, user_id, event_id % 97 AS tx, CASE event_type WHEN 'signup' THEN 'commit' WHEN 'error' THEN 'abort' ELSE 'write' END AS kind FROM events) SELECT * FROM l WHERE kind = 'write' AND tx IN (SELECT tx FROM l WHERE kind = 'commit') QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1",
)
_MERGED = "SELECT * FROM (SELECT * EXCLUDE ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1) WHERE event_type <> 'error'"
add("lsm_merge", lambda s, d: versions.merged(read(s, d, "events").drop("ts"), "user_id", "event_id", _gone()), _MERGED)


def _lsm_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = read(spark, sf_dir, "events").drop("ts")
    upper = versions.compacted([log.where("event_id >= 400")], "user_id", "event_id", _gone(), bottom=False)
    return versions.compacted([upper, log.where("event_id < 400")], "user_id", "event_id", _gone())


add("lsm_compaction", _lsm_levels, _MERGED)
add("lsm_point_get", lambda s, d: versions.point_get(read(s, d, "events").drop("ts"), "user_id", 42, "event_id", _gone()), f"SELECT * FROM ({_MERGED}) WHERE user_id = 42")


# Streams, run to the end of what there is.
def _stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by hour and kind. A file may be one day out of order; that is the bound on lateness."""
    schema = read(spark, sf_dir, "events").schema
    stream = S.tables(spark, f"{sf_dir}/events.parque[t]", schema)
    counts = stream.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"))
    out = scratch(spark, "windows")

    def step(batch: DataFrame, number: int) -> None:
        batch.select(F.col("window.start").alias("start"), "event_type", "n").write.mode("overwrite").parquet(out)

    counts.writeStream.outputMode("complete").foreachBatch(step).option("checkpointLocation", scratch(spark, "progress")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


add("stream_windows", _stream_windows, "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")


def _stream_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = read(spark, sf_dir, "events").schema
    out = scratch(spark, "merge")
    S.merge_into(S.tables(spark, f"{sf_dir}/events.parque[t]", schema).drop("ts"), out, "user_id", "event_id", "event_type = 'error'", scratch(spark, "progress")).awaitTermination()
    return S.merged_table(spark, out, "user_id", "event_id", "event_type = 'error'")


add("stream_merge", _stream_merge, _MERGED)


def queries() -> dict[str, Build]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
