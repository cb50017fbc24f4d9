"""The registered queries: each operator over the given tables, with an SQL statement of the same result."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.rules import rules_filter
from .functions.types import auto_match, conform, dedupe_names
from .operators import combine
from .operators.apply import apply
from .operators.dimension import StoredDimension
from .operators.ranges import count_between
from .plans import runner
from .plans import spec as plan
from .sinks.partitions import PartitionedTable
from .sinks.writers import ParquetTable, all_messages, log_lines, messages, write_jdbc
from .sources import mail, metadata, sql
from .sources.cursor import Cursor
from .streaming import feed

TABLES = "region nation customer supplier part orders lineitem events documents conversations".split()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def query(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return keep


def source(name: str, text: str, oracle: str | None = None) -> None:
    """A query whose text runs as a SQL source over registered tables."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        for t in TABLES:
            if t in text:
                table(spark, d, t).createOrReplaceTempView(t)
        return sql.sql_source(spark, text)

    QUERIES[name], ORACLES[name] = run, oracle or text


# ---- SQL sources

source("sql_source_filter", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
source("sql_source_case", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 50000 THEN 'mid' ELSE 'low' END AS band FROM orders")
source("sql_source_daily_sales", "SELECT p_brand, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity, CAST(count(*) AS BIGINT) AS n_lines FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate >= TIMESTAMP '1995-01-01 00:00:00' GROUP BY p_brand")
source("sql_source_having", "SELECT o_custkey, CAST(count(DISTINCT o_orderpriority) AS BIGINT) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 10")
for _kind, _by in (("rollup", "ROLLUP (c_mktsegment, o_orderstatus)"), ("cube", "CUBE (c_mktsegment, o_orderstatus)"), ("grouping_sets", "GROUPING SETS ((c_mktsegment), (o_orderstatus), ())")):
    source(f"sql_source_{_kind}", f"SELECT c_mktsegment, o_orderstatus, CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY {_by}")
source("sql_source_window_rank", "SELECT o_orderkey, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS r FROM orders")
source("sql_source_window_frame", "SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS DOUBLE) AS s, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS previous FROM orders")
source("sql_source_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
source("sql_source_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")


@query("sql_source_range_join", "SELECT s_suppkey, CAST(count(*) AS BIGINT) AS n FROM supplier JOIN part ON p_retailprice BETWEEN s_acctbal - 10 AND s_acctbal + 10 GROUP BY s_suppkey")
def _(spark, d):
    """A join by range between two SQL sources that only counts: no pair is made."""
    for t in ("supplier", "part"):
        table(spark, d, t).createOrReplaceTempView(t)
    ends = sql.sql_source(spark, "SELECT s_suppkey, s_acctbal - 10 AS low, s_acctbal + 10 AS high FROM supplier")
    counted = count_between(ends, sql.sql_source(spark, "SELECT p_retailprice FROM part"), "low", "high", "p_retailprice")
    return counted.groupBy("s_suppkey").agg(F.sum("n").alias("n"))


source("sql_source_theta_join", "SELECT a.l_orderkey AS k, a.l_linenumber AS a, b.l_linenumber AS b FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_extendedprice < b.l_extendedprice")
source("sql_source_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey AS k FROM supplier")
source("sql_source_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey AS k FROM supplier")
source("sql_source_except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey AS k FROM orders")
source("sql_source_cte_subquery", "WITH a AS (SELECT o_custkey, avg(o_totalprice) AS m FROM orders GROUP BY o_custkey) SELECT o_orderkey FROM orders JOIN a USING (o_custkey) WHERE o_totalprice > m * 1.5 AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
source("sql_source_correlated", "SELECT o_orderkey FROM orders o WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")
source("sql_source_topk", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 50")
source("sql_source_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 100")
source("sql_source_distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
source("sql_source_scalar_functions", "SELECT c_custkey, upper(c_name) AS u, substr(c_name, 1, 4) AS s, length(c_mktsegment) AS n, CAST(floor(c_acctbal) AS BIGINT) AS f FROM customer",
       "SELECT c_custkey, upper(c_name) AS u, substr(c_name, 1, 4) AS s, length(c_mktsegment)::INT AS n, CAST(floor(c_acctbal) AS BIGINT) AS f FROM customer")
source("sql_source_dates", "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d FROM orders",
       "SELECT o_orderkey, year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, day(o_orderdate)::INT AS d FROM orders")
source("sql_source_json", "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM events",
       "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")


@query("infer_schema_orders", "SELECT ordinal_position::INT AS ordinal, column_name AS name, CASE data_type WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' WHEN 'BIGINT' THEN 'bigint' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(data_type) END AS type, true AS nullable FROM (SELECT row_number() OVER () AS ordinal_position, column_name, column_type AS data_type FROM (DESCRIBE orders))")
def _(spark, d):
    table(spark, d, "orders").createOrReplaceTempView("orders")
    return sql.infer_schema(spark, "SELECT * FROM orders;").select("ordinal", "name", "type", "nullable")


@query("list_tables_catalog", " UNION ALL ".join(f"SELECT '' AS schema, 'catalog_{t}' AS name, count(*) AS rows FROM {t}" for t in TABLES))
def _(spark, d):
    for t in TABLES:
        table(spark, d, t).createOrReplaceTempView(f"catalog_{t}")
    sizes = reduce(DataFrame.unionByName, [table(spark, d, t).agg(F.count(F.lit(1)).alias("rows")).withColumn("name", F.lit(f"catalog_{t}")) for t in TABLES])
    return sql.list_tables(spark, like="catalog_*").join(sizes, "name").select("schema", "name", "rows")


_LINEITEM = "l_orderkey bigint,l_partkey bigint,l_suppkey bigint,l_linenumber int,l_quantity double,l_extendedprice double,l_discount double,l_tax double,l_returnflag string,l_linestatus string,l_shipdate timestamp_ntz"


@query("list_columns_catalog", " UNION ALL ".join(
    f"SELECT {i} AS ordinal, '{n}' AS name, '{t}' AS type, true AS nullable, {str(n in ('l_orderkey', 'l_linenumber')).lower()} AS is_primary, count(*) AS rows, count({n}) AS filled FROM lineitem"
    for i, (n, t) in enumerate((x.split() for x in _LINEITEM.split(",")), 1)))
def _(spark, d):
    table(spark, d, "lineitem").createOrReplaceTempView("lineitem")
    columns = sql.list_columns(spark, "lineitem", keys=("l_orderkey", "l_linenumber"))
    return columns.join(sql.filled(table(spark, d, "lineitem")), "name").select("ordinal", "name", "type", "nullable", "is_primary", "rows", "filled")


# ---- map nodes with one input

def col(name, ref=None, kind="direct", **more):
    return {"name": name, "kind": kind} | ({"ref": ref} if ref else {}) | more


def mapped(df: DataFrame, columns: list[dict]) -> DataFrame:
    return combine.project(df.alias("A"), columns)


def map_query(name: str, of: str, columns: list[dict], oracle: str) -> None:
    QUERIES[name] = lambda spark, d: mapped(table(spark, d, of), columns)
    ORACLES[name] = oracle


map_query("map_direct", "customer", [col("name", "A.c_name"), col("id", "c_custkey", type="int64"), col("nation", "A.c_nationkey", type="string")],
          "SELECT c_name AS name, c_custkey AS id, c_nationkey::VARCHAR AS nation FROM customer")
map_query("map_concat_sep", "customer", [col("id", "A.c_custkey"), col("label", kind="concat", sep="-", args=["A.c_name", {"lit": "x"}, "A.c_nationkey"])],
          "SELECT c_custkey AS id, concat(c_name, '-x-', c_nationkey) AS label FROM customer")
map_query("map_concat_all", "customer", [col("id", "A.c_custkey"), col("full_name", kind="concat_all", args=["A.c_name", {"lit": " "}, "A.c_mktsegment"])],
          "SELECT c_custkey AS id, concat(c_name, ' ', c_mktsegment) AS full_name FROM customer")
map_query("map_upper_add", "supplier", [col("u", kind="upper", args=["A.s_name"]), col("s", kind="add", args=["A.s_suppkey", "A.s_nationkey"], type="int64")],
          "SELECT upper(s_name) AS u, (s_suppkey + s_nationkey)::BIGINT AS s FROM supplier")
map_query("map_expr", "lineitem", [col("k", "A.l_orderkey"), col("n", "A.l_linenumber"), col("net", kind="expr", sql="A.l_extendedprice * (1 - A.l_discount)", type="float64")],
          "SELECT l_orderkey AS k, l_linenumber AS n, l_extendedprice * (1 - l_discount) AS net FROM lineitem")
map_query("map_null_default", "part", [col("k", "A.p_partkey"), col("nothing", kind="mystery", type="int64")],
          "SELECT p_partkey AS k, NULL::BIGINT AS nothing FROM part")
map_query("map_try_cast", "customer", [col("k", "A.c_custkey"), col("n", "A.c_mktsegment", type="int64")],
          "SELECT c_custkey AS k, TRY_CAST(c_mktsegment AS BIGINT) AS n FROM customer")


@query("map_udf", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS bin FROM part")
def _(spark, d):
    @F.pandas_udf("string")
    def bin_of(size: pd.Series) -> pd.Series:
        return pd.cut(size, [-1, 9, 29, 1 << 30], labels=["small", "medium", "large"]).astype(str)

    return mapped(table(spark, d, "part"), [col("p_partkey", "A.p_partkey"), col("bin", kind="udf", function=bin_of, args=["A.p_size"])])


_MULTI = {"outputs": [{"name": "ids", "columns": [col("id", "A.o_orderkey")]}, {"name": "big", "columns": [col("id", "A.o_orderkey"), col("big", kind="expr", sql="A.o_totalprice > 150000")]}]}
QUERIES["map_multi_output_ids"] = lambda spark, d: plan.map_node({"A": table(spark, d, "orders")}, _MULTI)["ids"]
ORACLES["map_multi_output_ids"] = "SELECT o_orderkey AS id FROM orders"
QUERIES["map_multi_output_big"] = lambda spark, d: plan.map_node({"A": table(spark, d, "orders")}, _MULTI)["big"]
ORACLES["map_multi_output_big"] = "SELECT o_orderkey AS id, o_totalprice > 150000 AS big FROM orders"


@query("map_auto_match", "SELECT c_custkey AS C_CUSTKEY, c_name, NULL::VARCHAR AS other FROM customer")
def _(spark, d):
    c = table(spark, d, "customer")
    target = spark.createDataFrame([], "C_CUSTKEY long, c_name string, other string").schema
    return mapped(c, auto_match({"A": c}, target))


@query("map_conform", "SELECT c_name, c_nationkey::BIGINT AS c_nationkey, NULL::DOUBLE AS score FROM customer")
def _(spark, d):
    return conform(table(spark, d, "customer"), spark.createDataFrame([], "c_name string, c_nationkey long, score double").schema)


@query("map_dedupe_names", "SELECT c_custkey AS id, c_nationkey::BIGINT AS id2, c_name AS id3 FROM customer")
def _(spark, d):
    return dedupe_names(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("long").alias("id"), F.col("c_name").alias("id")))


@query("map_add_all_columns", "SELECT c_custkey AS id, c_name, c_nationkey, upper(c_mktsegment) AS c_mktsegment, c_custkey, c_acctbal FROM customer")
def _(spark, d):
    c = table(spark, d, "customer")
    columns = [col("id", "A.c_custkey"), col("c_name", "A.c_name"), col("c_nationkey", "A.c_nationkey"), col("C_MKTSEGMENT", kind="upper", args=["A.c_mktsegment"])]
    return mapped(c, combine.add_all_columns(c, "A", columns)).withColumnRenamed("C_MKTSEGMENT", "c_mktsegment")


# ---- map nodes with two inputs

_LAST = "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1"
_PICK = [col("id", "A.c_custkey"), col("name", "A.c_name"), col("order_id", "B.o_orderkey"), col("total", "B.o_totalprice")]


def _lookup(kind):
    def run(spark, d):
        c, o = table(spark, d, "customer"), table(spark, d, "orders")
        if kind == "right":  # the build side is the left one: the last order of each customer
            j = combine.lookup_join(o, c, ["o_custkey"], ["c_custkey"], "right", order_by=["o_orderdate", "o_orderkey"], names=("B", "A"))
        elif kind == "full":
            j = combine.lookup_join(c, o, ["c_custkey"], ["o_custkey"], "full", order_by=["o_orderdate", "o_orderkey"])
        else:
            j = combine.lookup_join(c, o, ["c_custkey"], ["o_custkey"], kind, order_by=["o_orderdate", "o_orderkey"])
        return combine.project(j, _PICK)

    return run


for _kind in ("inner", "left", "right", "full"):
    QUERIES[f"lookup_{_kind}_last"] = _lookup(_kind)
    _join = {"right": "LEFT"}.get(_kind, _kind.upper())
    ORACLES[f"lookup_{_kind}_last"] = f"SELECT c_custkey AS id, c_name AS name, o_orderkey AS order_id, o_totalprice AS total FROM customer {_join} JOIN ({_LAST}) ON c_custkey = o_custkey"
    QUERIES[f"join_{_kind}_all"] = lambda spark, d, k=_kind: combine.project(
        combine.lookup_join(table(spark, d, "customer"), table(spark, d, "orders"), ["c_custkey"], ["o_custkey"], k, match="all"), _PICK)
    ORACLES[f"join_{_kind}_all"] = f"SELECT c_custkey AS id, c_name AS name, o_orderkey AS order_id, o_totalprice AS total FROM customer {_kind.upper()} JOIN orders ON c_custkey = o_custkey"

for _kind in ("inner", "left", "right", "full"):  # names kept from when the queries above held part of the keys
    QUERIES[f"join_{_kind}_whole"], ORACLES[f"join_{_kind}_whole"] = QUERIES[f"join_{_kind}_all"], ORACLES[f"join_{_kind}_all"]
QUERIES["lookup_full_whole"], ORACLES["lookup_full_whole"] = QUERIES["lookup_full_last"], ORACLES["lookup_full_last"]


@query("join_cross", "SELECT s_name AS supplier, n_name AS nation FROM supplier CROSS JOIN nation")
def _(spark, d):
    j = combine.cross_join(table(spark, d, "supplier"), table(spark, d, "nation"))
    return combine.project(j, [col("supplier", "A.s_name"), col("nation", "B.n_name")])


@query("join_composite_key", "SELECT a.l_orderkey AS k, a.l_linenumber AS n, b.l_quantity AS q FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber + 1")
def _(spark, d):
    a = table(spark, d, "lineitem")
    b = a.select("l_orderkey", (F.col("l_linenumber") + 1).alias("next"), "l_quantity")
    j = combine.lookup_join(a, b, ["l_orderkey", "l_linenumber"], ["l_orderkey", "next"], "inner", match="all")
    return combine.project(j, [col("k", "A.l_orderkey"), col("n", "A.l_linenumber"), col("q", "B.l_quantity")])


@query("join_null_keys", "WITH a AS (SELECT c_custkey, nullif(c_nationkey % 5, 0) AS k FROM customer), b AS (SELECT nullif(n_nationkey % 5, 0) AS k, max(n_name) AS name FROM nation GROUP BY 1) SELECT c_custkey AS id, name FROM a JOIN b ON a.k IS NOT DISTINCT FROM b.k")
def _(spark, d):
    a = table(spark, d, "customer").select("c_custkey", F.expr("nullif(c_nationkey % 5, 0)").alias("k"))
    b = table(spark, d, "nation").select(F.expr("nullif(n_nationkey % 5, 0)").alias("k"), F.col("n_name").alias("name"))
    j = combine.lookup_join(a, b, ["k"], ["k"], "inner", order_by=["name"])
    return combine.project(j, [col("id", "A.c_custkey"), col("name", "B.name")])


@query("join_mixed_type_key", "SELECT c_custkey AS id, n_name AS nation FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def _(spark, d):
    n = table(spark, d, "nation").withColumn("n_nationkey", F.col("n_nationkey").cast("string"))
    j = combine.lookup_join(table(spark, d, "customer"), n, ["c_nationkey"], ["n_nationkey"], "left")
    return combine.project(j, [col("id", "A.c_custkey"), col("nation", "B.n_name")])


@query("join_unknown_kind", "SELECT c_custkey AS id, n_name AS nation FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def _(spark, d):
    j = combine.lookup_join(table(spark, d, "customer"), table(spark, d, "nation"), ["c_nationkey"], ["n_nationkey"], "sideways")
    return combine.project(j, [col("id", "A.c_custkey"), col("nation", "B.n_name")])


@query("join_expr_columns", "SELECT o_orderkey AS id, round(o_totalprice * 12, 2) AS yearly, concat(c_name, '/', o_orderstatus) AS label FROM orders JOIN customer ON o_custkey = c_custkey")
def _(spark, d):
    j = combine.lookup_join(table(spark, d, "orders"), table(spark, d, "customer"), ["o_custkey"], ["c_custkey"], "inner")
    return combine.project(j, [col("id", "A.o_orderkey"), col("yearly", kind="expr", sql="round(A.o_totalprice * 12, 2)"), col("label", kind="concat", sep="/", args=["B.c_name", "A.o_orderstatus"])])


@query("join_prefixed_names", "SELECT o_orderkey AS a_o_orderkey, c_name AS b_c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def _(spark, d):
    j = combine.lookup_join(table(spark, d, "orders"), table(spark, d, "customer"), ["o_custkey"], ["c_custkey"])
    return combine.project(j, [col("x", "A.o_orderkey"), col("y", "B.c_name")], prefix=True)


@query("union_lineage", "SELECT c_custkey AS customer, NULL::BIGINT AS supplier, c_acctbal AS bal FROM customer UNION ALL SELECT NULL, s_suppkey, NULL FROM supplier")
def _(spark, d):
    columns = [col("customer", "A.c_custkey", type="int64"), col("supplier", "B.s_suppkey", type="int64"), col("bal", "A.c_acctbal", type="float64")]
    return combine.union_by_lineage(table(spark, d, "customer"), table(spark, d, "supplier"), columns)


@query("union_by_name", "SELECT c_custkey AS k, c_name AS name, c_nationkey AS n FROM customer UNION ALL SELECT p_partkey, p_brand, NULL FROM part")
def _(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("n"))
    return combine.union_shared(c, table(spark, d, "part").select(F.col("p_brand").alias("name"), F.col("p_partkey").alias("k")))


# ---- rules

_RULES = {
    "eq": ("event_type", "click", "event_type = 'click'"), "neq": ("event_type", "click", "event_type <> 'click'"),
    "contains": ("event_type", "ic", "contains(event_type, 'ic')"), "startsWith": ("event_type", "p", "starts_with(event_type, 'p')"),
    "endsWith": ("event_type", "p", "ends_with(event_type, 'p')"), "gt": ("value", 50, "coalesce(value, 0) > 50"), "lt": ("value", 10, "coalesce(value, 0) < 10"),
    "regex": ("event_type", "^(view|err)", "regexp_matches(event_type, '^(view|err)')"), "exists": ("value", None, "value IS NOT NULL"),
    "notExists": ("missing.field", None, "true"), "in": ("user_id", [1, 2, 3, 4, 5], "user_id IN (1, 2, 3, 4, 5)"),
    "notIn": ("event_type", ["view", "click"], "event_type NOT IN ('view', 'click')"),
}


def rule_query(name: str, rules: list[dict], predicate: str) -> None:
    QUERIES[name] = lambda spark, d: rules_filter(table(spark, d, "events"), rules).select("event_id", "event_type")
    ORACLES[name] = f"SELECT event_id, event_type FROM events WHERE {predicate}"


for _op, (_field, _value, _sql) in _RULES.items():
    rule_query(f"rule_{_op}", [{"all": [{"field": _field, "op": _op, "value": _value}]}], _sql)
rule_query("rule_unknown", [{"all": [{"field": "value", "op": "near", "value": 1}]}], "false")
rule_query("rule_bad_regex", [{"all": [{"field": "event_type", "op": "regex", "value": "("}]}], "false")
rule_query("rule_nested_path", [{"all": [{"field": "props.k", "op": "gt", "value": 50}]}], "coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 0) > 50")
rule_query("rule_all_any", [{"all": [{"field": "value", "op": "gt", "value": 10}], "any": [{"field": "event_type", "op": "eq", "value": "click"}, {"field": "event_type", "op": "eq", "value": "view"}]}],
           "value > 10 AND event_type IN ('click', 'view')")
rule_query("rule_multi", [{"all": [{"field": "value", "op": "gt", "value": 10}]}, {"any": [{"field": "user_id", "op": "lt", "value": 20}]}], "value > 10 AND user_id < 20")
rule_query("rule_none", [], "true")
rule_query("rule_regex_letters", [{"all": [{"field": "event_type", "op": "regex", "value": r"^\p{L}+$"}]}], r"regexp_matches(event_type, '^\p{L}+$')")
rule_query("rule_regex_named", [{"all": [{"field": "event_type", "op": "regex", "value": "(?P<what>view|click)"}]}], "regexp_matches(event_type, 'view|click')")


@query("rule_variant_path", "SELECT event_id, event_type FROM events WHERE coalesce(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 0) > 50 AND json_extract_string(props, '$.k') NOT IN ('60', '61')")
def _(spark, d):
    """A path into VARIANT values: the rows that the same rules take from JSON text."""
    events = table(spark, d, "events").withColumn("props", F.try_parse_json("props"))
    rules = [{"all": [{"field": "props.k", "op": "gt", "value": 50}, {"field": "props.k", "op": "notIn", "value": [60, 61]}]}]
    return rules_filter(events, rules).select("event_id", "event_type")


rule_query("rule_below_zero", [{"all": [{"field": "value", "op": "gt", "value": -1}, {"field": "user_id", "op": "lt", "value": 40.5}]}], "coalesce(value, 0) > -1 AND coalesce(user_id, 0) < 40.5")


# ---- incremental reads, messages

QUERIES["poll_int"] = lambda spark, d: sql.poll_increment(table(spark, d, "events"), "event_id", "1000")
ORACLES["poll_int"] = "SELECT * FROM events WHERE event_id > 1000 ORDER BY event_id LIMIT 100"
QUERIES["poll_timestamp"] = lambda spark, d: sql.poll_increment(table(spark, d, "events"), "ts", "2024-01-02 00:00:00", "timestamp", ["event_id"])
ORACLES["poll_timestamp"] = "SELECT ts, event_id FROM events WHERE ts > TIMESTAMP '2024-01-02 00:00:00' ORDER BY ts LIMIT 100"
QUERIES["poll_ties"] = lambda spark, d: sql.poll_increment(table(spark, d, "events"), "user_id", "5", "int", ["event_id"], include_ties=True)
ORACLES["poll_ties"] = "SELECT user_id, event_id FROM events WHERE user_id > 5 AND user_id <= (SELECT max(user_id) FROM (SELECT user_id FROM events WHERE user_id > 5 ORDER BY user_id LIMIT 100))"
QUERIES["poll_where_columns"] = lambda spark, d: sql.poll_increment(table(spark, d, "events"), "event_id", "0", "int", ["value", "event_type"], "event_type = 'purchase'", 500)
ORACLES["poll_where_columns"] = "SELECT event_id, value, event_type FROM events WHERE event_id > 0 AND event_type = 'purchase' ORDER BY event_id LIMIT 500"
QUERIES["initial_watermark"] = lambda spark, d: sql.initial_watermark(table(spark, d, "events"), "ts")
ORACLES["initial_watermark"] = "SELECT max(ts) AS watermark FROM events"

_MAIL = "(SELECT doc_id AS uid, 'User' || (doc_id % 7) || '@Mail.example' AS f, 'team' || (doc_id % 3) || '@mail.example' AS t, 'cc' || (doc_id % 4) || '@mail.example' AS c, source || ' ' || lang AS subject, doc_id % 2 = 0 AS a FROM documents)"


def _messages(spark, d):
    i = F.col("doc_id")
    return table(spark, d, "documents").select(
        i.alias("uid"), F.array(F.concat(F.lit("User"), i % 7, F.lit("@Mail.example"))).alias("from"), F.array(F.concat(F.lit("team"), i % 3, F.lit("@mail.example"))).alias("to"),
        F.array(F.concat(F.lit("cc"), i % 4, F.lit("@mail.example"))).alias("cc"), F.concat_ws(" ", "source", "lang").alias("subject"), (i % 2 == 0).alias("has_attachment"))


for _name, _args, _sql in (
    ("from", {"from_address": "user3@mail.example"}, "lower(f) = 'user3@mail.example'"), ("to", {"to_address": "TEAM1@mail.example"}, "t = 'team1@mail.example'"),
    ("subject", {"subject": "^src1.*en$"}, "regexp_matches(subject, '^src1.*en$')"), ("cc", {"cc": ["CC1@mail.example", "cc2@mail.example"]}, "c IN ('cc1@mail.example', 'cc2@mail.example')"),
    ("attachment", {"has_attachment": True}, "a"), ("uid", {"last_uid": 100}, "uid > 100"),
):
    QUERIES[f"mail_filter_{_name}"] = lambda spark, d, a=_args: mail.mail_events(_messages(spark, d), **({"last_uid": -1} | a)).select("uid", "subject")
    ORACLES[f"mail_filter_{_name}"] = f"SELECT uid, subject FROM {_MAIL} WHERE {_sql}"


# ---- write modes

_CHANGES = "(SELECT c_custkey + 1000 AS c_custkey, c_name || '*' AS c_name, c_acctbal + 1 AS c_acctbal FROM customer)"


def _changes(c: DataFrame) -> DataFrame:
    return c.select((F.col("c_custkey") + 1000).alias("c_custkey"), F.concat("c_name", F.lit("*")).alias("c_name"), (F.col("c_acctbal") + 1).alias("c_acctbal"))


def apply_query(name, oracle, mode, keys=None, columns=None, change=_changes, **options):
    def run(spark, d):
        c = table(spark, d, "customer")
        return apply(c, change(c), mode, keys, columns, **options)

    QUERIES[f"apply_{name}"], ORACLES[f"apply_{name}"] = run, oracle


apply_query("insert", f"SELECT * FROM customer UNION ALL BY NAME SELECT * FROM {_CHANGES}", "insert")
apply_query("update", f"SELECT t.c_custkey, coalesce(s.c_name, t.c_name) AS c_name, t.c_nationkey, coalesce(s.c_acctbal, t.c_acctbal) AS c_acctbal, t.c_mktsegment FROM customer t LEFT JOIN {_CHANGES} s USING (c_custkey)", "update", ["c_custkey"])
_MERGED = "SELECT coalesce(t.c_custkey, s.c_custkey) AS c_custkey, coalesce(s.c_name, t.c_name) AS c_name, t.c_nationkey, coalesce(s.c_acctbal, t.c_acctbal) AS c_acctbal, t.c_mktsegment FROM customer t FULL JOIN {0} s ON t.c_custkey = s.c_custkey"
apply_query("merge", _MERGED.format(_CHANGES), "merge", ["c_custkey"])
apply_query("merge_dupkeys", _MERGED.format("(SELECT c_nationkey::BIGINT AS c_custkey, max_by(c_name, c_custkey) AS c_name, max_by(c_acctbal, c_custkey) AS c_acctbal FROM customer GROUP BY c_nationkey)"), "merge", ["c_custkey"], ["c_custkey", "c_name", "c_acctbal"],
            change=lambda c: c.select(F.col("c_nationkey").cast("long").alias("c_custkey"), "c_name", "c_acctbal", F.col("c_custkey").alias("seq")), order_by=["seq"])
apply_query("delete", f"SELECT * FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM {_CHANGES})", "delete", ["c_custkey"])
apply_query("truncate", "SELECT * FROM customer WHERE false", "truncate")


@query("write_parquet_merge", _MERGED.format(_CHANGES))
def _(spark, d):
    c = table(spark, d, "customer")
    target = ParquetTable(spark, f"{_folder(spark)}/target")
    target.apply(c, "insert")
    target.apply(_changes(c), "merge", ["c_custkey"])
    return target.read()


def _folder(spark: SparkSession) -> str:
    """A new folder under the shared checkpoint folder of the session, or, in local mode only, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-")
    return f"{base}/{uuid.uuid4().hex}"


@query("log_lines", "SELECT '» event_id: ' || event_id || ' | ts: ' || strftime(ts, '%Y-%m-%d %H:%M:%S') || ' | event_type: ' || coalesce(event_type, 'null') || ' «' AS value FROM events")
def _(spark, d):
    return log_lines(table(spark, d, "events").select("event_id", "ts", "event_type"))


@query("message_rows", "SELECT 'ops@mail.example' AS \"to\", '' AS cc, '' AS bcc, 'Customer ' || c_custkey AS subject, 'Dear ' || c_name || ', segment ' || c_mktsegment || '.' AS body, 'text/plain' AS content_type FROM customer")
def _(spark, d):
    return messages(table(spark, d, "customer"), "Customer {{.c_custkey}}", "Dear {{.CName}}, segment {{.c_mktsegment}}.", ["ops@mail.example"])


# ---- jobs

def _job(source_query, columns, sink, more=()):
    nodes = [{"id": "s", "type": "start"}, {"id": "i", "type": "db_input", "config": {"query": source_query}},
             {"id": "m", "type": "map", "config": {"outputs": [{"name": "out", "columns": columns}]}}, {"id": "o"} | sink, *more]
    flow = [{"from": "s", "to": "i", "type": "flow"}, {"from": "i", "to": "m", "type": "flow"}, {"from": "m", "to": "o", "type": "flow"}]
    return {"nodes": nodes, "connexions": [*flow, {"from": "i", "to": "m", "type": "data", "input": "A"}, {"from": "m", "to": "o", "type": "data"}]}


def _views(spark, d, *names):
    for n in names:
        table(spark, d, n).createOrReplaceTempView(n)


@query("pipeline_customer_etl", "SELECT c_custkey AS id, concat(c_name, ' ', c_mktsegment) AS full_name, c_acctbal AS balance FROM customer")
def customer_etl(spark, d):
    _views(spark, d, "customer")
    columns = [col("id", "A.c_custkey"), col("full_name", kind="concat_all", args=["A.c_name", {"lit": " "}, "A.c_mktsegment"]), col("balance", "A.c_acctbal")]
    spec = _job("SELECT c_custkey, c_name, c_mktsegment, c_acctbal FROM customer;", columns, {"type": "db_output", "config": {"table": "customers_clean", "mode": "insert"}})
    return plan.build(spark, spec).result("o")


_TWO = {
    "nodes": [
        {"id": "s", "type": "start"}, {"id": "orders", "type": "db_input", "config": {"query": "SELECT * FROM orders"}}, {"id": "customers", "type": "db_input", "config": {"query": "SELECT * FROM customer"}},
        {"id": "m", "type": "map", "config": {"join": {"type": "left", "left": "A", "right": "B", "leftKey": "o_custkey", "rightKey": "c_custkey"}, "outputs": [{"name": "out", "columns": [
            col("order_id", "A.o_orderkey"), col("yearly", kind="expr", sql="round(A.o_totalprice * 12, 2)"), col("customer", "B.c_name")]}]}},
        {"id": "o", "type": "db_output", "config": {"table": "public.receiver", "mode": "insert"}}, {"id": "lost", "type": "log", "config": {}},
    ],
    "connexions": [
        {"from": "s", "to": "orders", "type": "flow"}, {"from": "s", "to": "customers", "type": "flow"}, {"from": "orders", "to": "m", "type": "flow"}, {"from": "m", "to": "o", "type": "flow"},
        {"from": "customers", "to": "m", "type": "data", "input": "B"}, {"from": "orders", "to": "m", "type": "data", "input": "A"}, {"from": "m", "to": "o", "type": "data"},
    ],
}
_TWO_SQL = "SELECT o_orderkey AS order_id, round(o_totalprice * 12, 2) AS yearly, c_name AS customer FROM orders LEFT JOIN customer ON o_custkey = c_custkey"


@query("pipeline_two_source_join", _TWO_SQL)
def two_source_join(spark, d):
    _views(spark, d, "orders", "customer")
    return plan.build(spark, _TWO).result("o")


@query("pipeline_orphan", "SELECT 'lost' AS orphan, CAST(count(*) AS BIGINT) AS rows_out FROM orders")
def _(spark, d):
    _views(spark, d, "orders", "customer")
    job = plan.build(spark, _TWO)
    return job.result("o").agg(F.count(F.lit(1)).alias("rows_out")).select(F.lit(",".join(job.orphans)).alias("orphan"), "rows_out")


@query("pipeline_fanout", "SELECT 'log' AS sink, '» id: ' || c_custkey || ' «' AS line FROM customer UNION ALL SELECT 'table', c_custkey::VARCHAR FROM customer")
def _(spark, d):
    _views(spark, d, "customer")
    spec = _job("SELECT c_custkey FROM customer", [col("id", "A.c_custkey")], {"type": "db_output", "config": {"table": "t"}}, [{"id": "l", "type": "log", "config": {}}])
    spec["connexions"] += [{"from": "m", "to": "l", "type": "flow"}, {"from": "m", "to": "l", "type": "data"}]
    job = plan.build(spark, spec)
    lines = job.result("l").select(F.lit("log").alias("sink"), F.col("value").alias("line"))
    return lines.unionByName(job.result("o").select(F.lit("table").alias("sink"), F.col("id").cast("string").alias("line")))


@query("stage_counts", "SELECT node, n FROM (SELECT 'customers' AS node, count(*) AS n FROM customer UNION ALL SELECT 'm', count(*) FROM orders UNION ALL SELECT 'o', count(*) FROM orders UNION ALL SELECT 'orders', count(*) FROM orders)")
def _(spark, d):
    _views(spark, d, "orders", "customer")
    job = plan.build(spark, _TWO, observe=True)
    job.result("o").write.format("noop").mode("overwrite").save()
    return spark.createDataFrame(sorted(job.progress()), "node string, n long")


# ---- feeds

def _split_events(spark, d, parts=4):
    folder = _folder(spark)
    events = table(spark, d, "events")
    events.withColumn("part", F.col("event_id") % parts).repartition(parts, "part").drop("part").write.parquet(f"{folder}/in")
    return folder, feed.watch_folder(spark, f"{folder}/in", events.schema)


_PURCHASES = [{"all": [{"field": "event_type", "op": "eq", "value": "purchase"}, {"field": "value", "op": "gt", "value": 10}]}]


@query("stream_poll_rules", "SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase' AND value > 10")
def _(spark, d):
    folder, stream = _split_events(spark, d)
    job = lambda hit, n: hit.select("event_id", "user_id", "value").write.mode("overwrite").parquet(f"{folder}/out/poll={n}")
    feed.run_feed(stream, _PURCHASES, [(1, job)], f"{folder}/audit", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/out").drop("poll")


@query("stream_apply_merge", "SELECT user_id, max(event_id) AS event_id FROM events WHERE event_type = 'purchase' AND value > 10 GROUP BY user_id")
def _(spark, d):
    """Each poll merges its users into the table; only the partitions that hold them are read and written."""
    folder, stream = _split_events(spark, d, 3)
    target = PartitionedTable(spark, f"{folder}/target", ["part"])

    def job(hit, n):
        new = hit.groupBy("user_id").agg(F.max("event_id").alias("event_id")).withColumn("part", F.pmod("user_id", F.lit(16)).cast("int"))
        if target.exists():
            known = target.read().where(F.col("part").isin([r["part"] for r in new.select("part").distinct().collect()]))  # 16 at most
            new = new.unionByName(known.join(new.select("user_id"), "user_id", "left_semi").select(*new.columns)).groupBy("user_id", "part").agg(F.max("event_id").alias("event_id"))
        target.apply(new, "merge", ["part", "user_id"])

    feed.run_feed(stream, _PURCHASES, [(1, job)], f"{folder}/audit", f"{folder}/checkpoint").awaitTermination()
    return target.read().select("user_id", "event_id")


@query("stream_audit", "SELECT 'completed' AS status, CAST(count(*) AS BIGINT) AS events, count(*) FILTER (WHERE event_type = 'purchase' AND value > 10) AS matched FROM events")
def _(spark, d):
    folder, stream = _split_events(spark, d)
    feed.run_feed(stream, _PURCHASES, [], f"{folder}/audit", f"{folder}/checkpoint").awaitTermination()
    audit = feed.recent(feed.read_audit(spark, f"{folder}/audit"), 100)
    return audit.groupBy("status").agg(F.sum("events").alias("events"), F.sum("matched").alias("matched"))


@query("audit_recent", "SELECT poll, 'completed' AS status, count(*) AS events, count(*) FILTER (WHERE event_type = 'purchase' AND value > 10) AS matched FROM (SELECT *, event_id % 4 AS poll FROM events) WHERE poll >= 2 GROUP BY poll")
def _(spark, d):
    """The latest two of four polls."""
    folder, events = _folder(spark), table(spark, d, "events")
    for i in range(4):  # files come in the order of their writing
        events.where(F.col("event_id") % 4 == i).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    feed.run_feed(feed.watch_folder(spark, f"{folder}/in", events.schema), _PURCHASES, [], f"{folder}/audit", f"{folder}/checkpoint").awaitTermination()
    return feed.recent(feed.read_audit(spark, f"{folder}/audit"), 2).select("poll", "status", "events", "matched")


_EVENT_JOB = _job("SELECT * FROM events", [col("event_id", "A.event_id"), col("label", kind="concat", sep=":", args=["A.event_type", "A.user_id"])], {"type": "db_output", "config": {"table": "fired", "mode": "insert"}})


@query("stream_spec_job", "SELECT event_id, concat_ws(':', event_type, user_id) AS label FROM events WHERE event_type = 'purchase' AND value > 10")
def _(spark, d):
    folder, stream = _split_events(spark, d)
    job = feed.spec_job(_EVENT_JOB, "i", lambda rows, name, number: rows.write.mode("overwrite").parquet(f"{folder}/out/poll={number}"))
    feed.run_feed(stream, _PURCHASES, [(1, job)], f"{folder}/audit", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/out").drop("poll")


def _growing(spark, d, folder):
    """A table of part of the events, and a job that appends the rest of them while it runs for the first time."""
    events, path = table(spark, d, "events"), f"{folder}/growing"
    late = F.col("event_id") % 5 >= 3  # most of these lie past what the first poll has read
    events.where(~late).write.parquet(path)
    state = {"late": True}

    def grow() -> None:
        if state.pop("late", False):
            top = spark.read.parquet(path).agg(F.max("event_id")).first()[0]
            events.where(late).withColumn("event_id", F.col("event_id") + top).write.mode("append").parquet(path)

    return lambda: spark.read.schema(events.schema).parquet(path), grow, events


_GROWN = "SELECT event_id + CASE WHEN event_id % 5 >= 3 THEN (SELECT max(event_id) FROM events WHERE event_id % 5 < 3) ELSE 0 END AS event_id, user_id FROM events WHERE event_type = 'purchase' AND value > 10"


@query("stream_poll_table", "SELECT event_id, user_id FROM events WHERE event_type = 'purchase' AND value > 10")
def _(spark, d):
    """A table polled as a stream past its watermark until nothing is new, in four polls or so."""
    folder, events = _folder(spark), table(spark, d, "events")
    job = lambda hit, n: hit.select("event_id", "user_id").write.mode("overwrite").parquet(f"{folder}/out/poll={n}")
    first, count = events.agg(F.min("event_id"), F.count(F.lit(1))).first()
    feed.run_table_feed(spark, f"{folder}/checkpoint", read=lambda: events, column="event_id", kind="int", rules=_PURCHASES, jobs=[(1, job)],
                        state_path=folder, batch=count // 4 + 1, start=str(first - 1), available_now=True)
    return spark.read.parquet(f"{folder}/out").drop("poll")


@query("stream_growing_table", _GROWN)
def _(spark, d):
    """Rows that are appended while a poll's job runs come with the polls after it."""
    folder = _folder(spark)
    read, grow, events = _growing(spark, d, folder)

    def job(hit, n):
        grow()
        hit.select("event_id", "user_id").write.mode("overwrite").parquet(f"{folder}/out/poll={n}")

    first, count = events.agg(F.min("event_id"), F.count(F.lit(1))).first()
    feed.run_table_feed(spark, f"{folder}/checkpoint", read=read, column="event_id", kind="int", rules=_PURCHASES, jobs=[(1, job)], state_path=folder,
                        batch=count // 3 + 1, start=str(first - 1), available_now=True)
    return spark.read.parquet(f"{folder}/out").drop("poll")


@query("poll_table_growing", _GROWN)
def _(spark, d):
    """The same, poll by poll without a streaming query."""
    folder = _folder(spark)
    read, grow, events = _growing(spark, d, folder)

    def job(hit, n):
        grow()
        hit.select("event_id", "user_id").write.mode("overwrite").parquet(f"{folder}/out/poll={n}")

    first, count = events.agg(F.min("event_id"), F.count(F.lit(1))).first()
    while feed.poll_table(read, "event_id", "int", _PURCHASES, [(1, job)], folder, count // 3 + 1, str(first - 1)):
        pass
    return spark.read.parquet(f"{folder}/out").drop("poll")


@query("stream_composite_cursor", "SELECT user_id, event_id, (row_number() OVER (ORDER BY user_id, event_id) - 1) // (SELECT count(*) // 6 + 1 FROM events) AS poll FROM events WHERE user_id > 0")
def _(spark, d):
    """A watermark whose values repeat: with a key behind it, polls of a bounded number of rows lose no ties."""
    folder, events = _folder(spark), table(spark, d, "events")
    job = lambda hit, n: hit.select("user_id", "event_id", F.lit(n).cast("long").alias("poll")).write.mode("overwrite").parquet(f"{folder}/out/{n}")
    feed.run_table_feed(spark, f"{folder}/checkpoint", read=lambda: events, column="user_id", kind="int", key="event_id", rules=[], jobs=[(1, job)],
                        state_path=folder, batch=events.count() // 6 + 1, available_now=True)
    return spark.read.parquet(f"{folder}/out/*")


@query("poll_composite", "SELECT user_id, event_id FROM events WHERE user_id > 5 OR (user_id = 5 AND event_id > 700) ORDER BY user_id, event_id LIMIT 100")
def _(spark, d):
    return Cursor("user_id", "int", "event_id").poll(table(spark, d, "events"), '["5", "700"]', 100, ["event_id"])


@query("audit_idle_polls", "SELECT 0 AS poll, 'completed' AS status, count(*) AS events, 1 AS n FROM events UNION ALL SELECT 1, 'no_events', 0, 2")
def _(spark, d):
    """Each poll has an audit row, those without a new event too."""
    folder, events = _folder(spark), table(spark, d, "events")
    first, count = events.agg(F.min("event_id"), F.count(F.lit(1))).first()
    for _ in range(3):
        feed.poll_table(lambda: events, "event_id", "int", _PURCHASES, [], folder, count, str(first - 1))
    audit = feed.read_audit(spark, f"{folder}/audit")
    return audit.groupBy(F.col("poll").cast("int").alias("poll"), "status").agg(F.sum("events").alias("events"), F.count(F.lit(1)).cast("int").alias("n"))


@query("stream_from_now", "SELECT event_id FROM events WHERE event_id > (SELECT max(event_id) FROM events WHERE event_type = 'purchase') AND value > 10")
def _(spark, d):
    """A feed that starts at a watermark: events after the last purchase."""
    events = table(spark, d, "events")
    start = sql.initial_watermark(events.where("event_type = 'purchase'"), "event_id").first()[0]
    folder, stream = _split_events(spark, d)
    job = lambda hit, n: hit.select("event_id").write.mode("overwrite").parquet(f"{folder}/out/poll={n}")
    spark.createDataFrame([], "event_id long").write.parquet(f"{folder}/out/poll=-1")
    rules = [{"all": [{"field": "value", "op": "gt", "value": 10}]}]
    feed.run_feed(feed.after(stream, "event_id", start), rules, [(1, job)], f"{folder}/audit", f"{folder}/checkpoint").awaitTermination()
    return spark.read.schema("event_id long").parquet(f"{folder}/out").select("event_id")


# ---- databases: embedded ones of the driver, with the schema of the given tables and keys of their own

_DERBY = "org.apache.derby.iapi.jdbc.AutoloadedDriver"
_KINDS = {"bigint": "BIGINT", "int": "INT", "double": "DOUBLE", "string": "VARCHAR(200)", "timestamp_ntz": "TIMESTAMP"}
_KEYS = {"nation": ["n_nationkey"], "customer": ["c_custkey"], "orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber"], "conversations": ["conv_id", "turn"]}
_LINKS = {"customer": ("c_nationkey", "nation", "n_nationkey"), "orders": ("o_custkey", "customer", "c_custkey"), "lineitem": ("l_orderkey", "orders", "o_orderkey")}


def _database(spark, d, names=tuple(_KEYS), links=True) -> dict:
    """A connection to a new embedded database with empty tables like the given ones, keys included."""
    link = {"url": f"jdbc:derby:memory:{uuid.uuid4().hex};create=true", "driver": _DERBY, "type": "derby"}
    statements = []
    for t in names:
        parts = [f'"{f.name}" {_KINDS[f.dataType.simpleString()]}' + (" NOT NULL" if f.name in _KEYS[t] else "") for f in table(spark, d, t).schema.fields]
        parts.append(f'CONSTRAINT "pk_{t}" PRIMARY KEY (' + ", ".join(f'"{k}"' for k in _KEYS[t]) + ")")
        if links and t in _LINKS:
            own, other, key = _LINKS[t]
            parts.append(f'CONSTRAINT "fk_{t}" FOREIGN KEY ("{own}") REFERENCES "{other}" ("{key}") ON DELETE CASCADE')
        statements.append(f'CREATE TABLE "{t}" ({", ".join(parts)})')
    with metadata.jdbc_link(spark, sql.jdbc_options(link)) as c:
        for text in statements:
            statement = c.createStatement()
            statement.execute(text)
            statement.close()
    return link


def _loaded(spark, d, *names) -> dict:
    """Such a database with the rows of the tables in it; it lies in the driver, so in local mode only."""
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("an embedded database can only be filled in local mode; on a cluster name a server")
    link = _database(spark, d, names, links=False)
    for t in names:
        table(spark, d, t).write.format("jdbc").options(**sql.jdbc_options(link)).option("dbtable", f'"{t}"').mode("append").save()
    return link


@query("apply_merge_default_keys", _MERGED.format(_CHANGES))
def _(spark, d):
    """The keys are those that a database with this table names."""
    c = table(spark, d, "customer")
    keys = sql.default_keys(sql.list_columns(spark, "customer", _database(spark, d, ("nation", "customer"))))
    return apply(c, _changes(c), "merge", keys)


@query("database_tables", " UNION ALL ".join(f"SELECT 'APP' AS schema, '{t}' AS name, count(*) AS rows FROM {t}" for t in _KEYS))
def _(spark, d):
    sizes = reduce(DataFrame.unionByName, [table(spark, d, t).agg(F.count(F.lit(1)).alias("rows")).withColumn("name", F.lit(t)) for t in _KEYS])
    return sql.list_tables(spark, _database(spark, d)).join(sizes, "name").select("schema", "name", "rows")


@query("database_keys", " UNION ALL ".join(
    [f"SELECT '{t}' AS \"table\", '{k}' AS \"column\", {i} AS position, 'PRIMARY KEY' AS constraint_type, NULL AS refers_to, NULL AS delete_rule, count(*) AS rows, count({k}) AS filled FROM {t}" for t, ks in _KEYS.items() for i, k in enumerate(ks, 1)]
    + [f"SELECT '{t}', '{own}', 1, 'FOREIGN KEY', '{other}.{key}', 'CASCADE', count(*), count({own}) FROM {t}" for t, (own, other, key) in _LINKS.items()]))
def _(spark, d):
    """Every key that the database's driver tells of, with how many rows have it."""
    keys = sql.describe_schema(spark, _database(spark, d)).where("constraint_type IN ('PRIMARY KEY', 'FOREIGN KEY')")
    sizes = reduce(DataFrame.unionByName, [sql.filled(table(spark, d, t)).withColumn("table", F.lit(t)) for t in _KEYS])
    joined = keys.join(sizes.withColumnRenamed("name", "column"), ["table", "column"])
    return joined.select("table", "column", "position", "constraint_type", "refers_to", "delete_rule", "rows", "filled")


@query("database_query_schema", " UNION ALL ".join(
    f"SELECT {i} AS ordinal, '{n}' AS name, '{s}' AS source_type, '{t}' AS type, {p} AS precision, {length}::BIGINT AS length, {null} AS nullable, count(*) AS rows, count({n}) AS filled FROM orders"
    for i, (n, s, t, p, length, null) in enumerate((
        ("o_orderkey", "BIGINT", "bigint", 19, "NULL", "false"), ("o_orderpriority", "VARCHAR", "string", "NULL", 200, "true"),
        ("o_totalprice", "DOUBLE", "double", 15, "NULL", "true"), ("o_orderdate", "TIMESTAMP", "timestamp", "NULL", "NULL", "true")), 1)))
def _(spark, d):
    """What a query over the database would give, as its driver says, beside what the table holds."""
    text = 'SELECT "o_orderkey", "o_orderpriority", "o_totalprice", "o_orderdate" FROM "orders";'
    found = sql.infer_schema(spark, text, _database(spark, d, ("nation", "customer", "orders")))
    joined = found.join(sql.filled(table(spark, d, "orders")), "name")
    return joined.select("ordinal", "name", "source_type", "type", "precision", "length", "nullable", "rows", "filled")


@query("jdbc_merge_found_keys", _MERGED.format(_CHANGES))
def _(spark, d):
    """A merge over JDBC into a schema-qualified table, in small batches, by the primary key that it has."""
    link, c = _loaded(spark, d, "customer"), table(spark, d, "customer")
    write_jdbc(_changes(c), "APP.customer", link, "merge", batch=100)
    return sql.sql_source(spark, 'SELECT * FROM APP."customer"', link)


@query("jdbc_default_schema", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1 UNION ALL SELECT -1, max(c_name) FROM customer")
def _(spark, d):
    """Unqualified names are looked up in the schema that the connection names."""
    link = _loaded(spark, d, "nation")
    with metadata.jdbc_link(spark, sql.jdbc_options(link)) as c:
        for text in ("CREATE SCHEMA BACK", 'CREATE TABLE BACK."nation" ("n_nationkey" INT, "n_name" VARCHAR(200))'):
            c.createStatement().execute(text)
    last = table(spark, d, "customer").agg(F.lit(-1).alias("n_nationkey"), F.max("c_name").alias("n_name"))
    last.write.format("jdbc").options(**sql.jdbc_options(link)).option("dbtable", 'BACK."nation"').mode("append").save()
    text = 'SELECT "n_nationkey", "n_name" FROM "nation"'
    front = sql.sql_source(spark, f'{text} WHERE "n_regionkey" = 1', link | {"schema": "APP"})
    return front.unionByName(sql.sql_source(spark, text, link | {"schema": "BACK"}))


@query("jdbc_parallel_read", "SELECT count(*) AS rows, count(DISTINCT o_orderkey) AS keys, true AS even FROM orders")
def _(spark, d):
    """Orders by price in eight parts: none has more than twice the mean."""
    rows = sql.parallel_source(spark, 'SELECT * FROM "orders"', _loaded(spark, d, "orders"), "o_totalprice", 8)
    parts = rows.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_orderkey").alias("k"))
    return parts.agg(F.sum("n").alias("rows"), F.sum("k").alias("keys"), (F.max("n") <= 2 * F.sum("n") / 8).alias("even"))


@query("jdbc_two_connections", "SELECT o_orderkey AS id, c_name AS customer FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def _(spark, d):
    """One job that reads two databases and writes into one of them."""
    one, two = _loaded(spark, d, "orders"), _loaded(spark, d, "customer")
    spec = {
        "nodes": [
            {"id": "s", "type": "start"}, {"id": "a", "type": "db_input", "config": {"query": 'SELECT * FROM "orders"', "connection": one}},
            {"id": "b", "type": "db_input", "config": {"query": 'SELECT * FROM "customer"', "connection": two}},
            {"id": "m", "type": "map", "config": {"join": {"type": "left", "leftKey": "o_custkey", "rightKey": "c_custkey"}, "outputs": [{"name": "out", "columns": [col("id", "A.o_orderkey"), col("customer", "B.c_name")]}]}},
            {"id": "o", "type": "db_output", "config": {"table": "APP.named", "connection": two, "mode": "insert", "batch": 500}},
        ],
        "connexions": [dict(zip(("from", "to", "type"), c)) for c in (("s", "a", "flow"), ("a", "m", "flow"), ("m", "o", "flow"), ("a", "m", "data"), ("b", "m", "data"), ("m", "o", "data"))],
    }
    runner.run(spark, spec)
    return sql.sql_source(spark, "SELECT * FROM APP.named", two)


@query("job_progress", " UNION ALL ".join(
    f"SELECT '{n}' AS node, 'done' AS status, {c} AS rows" for n, c in (("0", "NULL"), ("i", "(SELECT count(*) FROM orders)"), ("m", "(SELECT count(*) FROM orders)"), ("o", "(SELECT count(*) FROM orders)"),
                                                                       ("i2", "(SELECT count(*) FROM customer)"), ("m2", "(SELECT count(*) FROM customer)"), ("o2", "(SELECT count(*) FROM customer)"))))
def _(spark, d):
    """The last state of each node of a job of two flows, from the table that it wrote while it ran."""
    _views(spark, d, "orders", "customer")
    folder = _folder(spark)
    runner.run(spark, _two_flows({"path": f"{folder}/a"}, {"path": f"{folder}/b"}), path=f"{folder}/progress")
    return runner.latest(spark.read.schema(runner.PROGRESS).parquet(f"{folder}/progress")).select("node", "status", "rows")


@query("job_two_flows", "SELECT 'a' AS sink, o_orderkey AS id FROM orders UNION ALL SELECT 'b', c_custkey FROM customer")
def _(spark, d):
    """What two flows that ran at once have written."""
    _views(spark, d, "orders", "customer")
    folder = _folder(spark)
    runner.run(spark, _two_flows({"path": f"{folder}/a"}, {"path": f"{folder}/b"}))
    return reduce(DataFrame.unionByName, [spark.read.parquet(f"{folder}/{n}").select(F.lit(n).alias("sink"), "id") for n in "ab"])


def _two_flows(a: dict, b: dict) -> dict:
    one = _job("SELECT o_orderkey FROM orders", [col("id", "A.o_orderkey")], {"type": "db_output", "config": {"table": "a"} | a})
    two = _job("SELECT c_custkey FROM customer", [col("id", "A.c_custkey")], {"type": "db_output", "config": {"table": "b"} | b})
    for n in two["nodes"]:
        n["id"] += "2"
    links = [c | {"from": c["from"] + "2", "to": c["to"] + "2"} for c in two["connexions"]]
    return {"nodes": one["nodes"] + two["nodes"], "connexions": one["connexions"] + links}


# ---- partition-wise writes, stored lookup sides, templates

_SOME = "(SELECT c_custkey, c_name || '*' AS c_name, c_nationkey FROM customer WHERE c_nationkey = 7)"


@query("write_partitions_merge", f"SELECT t.c_custkey, coalesce(s.c_name, t.c_name) AS c_name, t.c_acctbal, t.c_mktsegment, t.c_nationkey, least(1, (SELECT count(*) FROM {_SOME})) AS written FROM customer t LEFT JOIN {_SOME} s USING (c_custkey)")
def _(spark, d):
    """A merge that changes one of 25 partitions writes one."""
    c = table(spark, d, "customer")
    target = PartitionedTable(spark, f"{_folder(spark)}/target", ["c_nationkey"])
    target.apply(c, "insert")
    written = target.apply(c.where("c_nationkey = 7").select("c_custkey", F.concat("c_name", F.lit("*")).alias("c_name"), "c_nationkey"), "merge", ["c_custkey"])
    return target.read().withColumn("written", F.lit(written).cast("long"))


@query("write_partitions_delete", "SELECT * FROM orders WHERE o_orderstatus <> 'P' AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def _(spark, d):
    """Deletes by a partition column (its folder goes) and by a key that occurs in all partitions."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    target = PartitionedTable(spark, f"{_folder(spark)}/target", ["o_orderstatus"], o.schema)
    target.apply(o, "insert")
    target.apply(o.where("o_orderstatus = 'P'").select("o_orderstatus").distinct(), "delete", ["o_orderstatus"])
    target.apply(c.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey")), "delete", ["o_custkey"])
    return target.read().select(*o.columns)


def _dimension(spark, d) -> StoredDimension:
    """The last order of each customer, bucketed by customer."""
    kept = StoredDimension(spark, f"last_order_{uuid.uuid4().hex[:8]}", ["o_custkey"], 8)
    kept.save(table(spark, d, "orders"), ["o_orderdate", "o_orderkey"], f"{_folder(spark)}/dimension")
    return kept


@query("lookup_stored_dimension", ORACLES["lookup_left_last"])
def _(spark, d):
    return combine.project(_dimension(spark, d).lookup(table(spark, d, "customer"), ["c_custkey"], "left"), _PICK)


@query("stream_lookup_stored", f"SELECT event_id, o_orderkey AS order_id FROM events JOIN ({_LAST}) ON user_id = o_custkey WHERE event_type = 'purchase' AND value > 10")
def _(spark, d):
    """Each poll's events are looked up in a stored dimension."""
    kept, (folder, stream) = _dimension(spark, d), _split_events(spark, d)

    def job(hit, n):
        found = kept.lookup(hit, ["user_id"], "inner")
        combine.project(found, [col("event_id", "A.event_id"), col("order_id", "B.o_orderkey")]).write.mode("overwrite").parquet(f"{folder}/out/poll={n}")

    feed.run_feed(stream, _PURCHASES, [(1, job)], f"{folder}/audit", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/out").drop("poll")


def _letters(spark, d) -> DataFrame:
    """A customer with its nation (missing for some) and its large orders."""
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    o = table(spark, d, "orders").where("o_totalprice > 250000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sort_array(F.collect_list(F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status")))).alias("orders"))
    nation = n.where("n_nationkey % 5 > 0").select(F.col("n_nationkey").alias("c_nationkey"), F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")).alias("nation"))
    return c.join(nation, "c_nationkey", "left").join(o, "c_custkey", "left").select("c_custkey", "c_name", "c_acctbal", "nation", "orders")


_SUBJECT = "{{if gt .c_acctbal 5000}}Dear{{else}}Hello{{end}} {{.CName}}"
_BODY = "From {{.nation.name}}:{{range .orders}} {{.key}}{{if eq .status \"F\"}} (done){{end}}{{else}} no orders{{end}}."
_LETTERS = "(SELECT c_custkey, c_name, c_acctbal, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey % 5 > 0)"


@query("message_nested", f"SELECT 'a@b' AS \"to\", '' AS cc, '' AS bcc, (CASE WHEN c_acctbal > 5000 THEN 'Dear ' ELSE 'Hello ' END) || c_name AS subject, 'From ' || n_name || ':' || coalesce(t, ' no orders') || '.' AS body, 'text/plain' AS content_type FROM {_LETTERS} LEFT JOIN (SELECT o_custkey, string_agg(' ' || o_orderkey || CASE WHEN o_orderstatus = 'F' THEN ' (done)' ELSE '' END, '' ORDER BY o_orderkey) AS t FROM orders WHERE o_totalprice > 250000 GROUP BY o_custkey) ON o_custkey = c_custkey WHERE n_name IS NOT NULL")
def _(spark, d):
    """Templates with nested fields, conditions and a range; customers without a nation have no message."""
    return all_messages(_letters(spark, d), _SUBJECT, _BODY, ["a@b"])[0]


@query("message_rejected", f"SELECT c_custkey, '.nation.name: its parent is NULL' AS error FROM {_LETTERS} WHERE n_name IS NULL")
def _(spark, d):
    rejected = all_messages(_letters(spark, d), _SUBJECT, _BODY, ["a@b"])[1]
    return rejected.select(F.get_json_object("row", "$.c_custkey").cast("long").alias("c_custkey"), "error")


@query("pipeline_two_starts", "SELECT 'orders' AS flow, o_orderkey AS id FROM orders UNION ALL SELECT 'customers', c_custkey FROM customer")
def _(spark, d):
    """Two start nodes: independent flows of one job, each over a source of its own."""
    _views(spark, d, "orders", "customer")
    one = _job("SELECT o_orderkey FROM orders", [col("id", "A.o_orderkey")], {"type": "db_output", "config": {"table": "a"}})
    two = _job("SELECT c_custkey FROM customer", [col("id", "A.c_custkey")], {"type": "db_output", "config": {"table": "b"}})
    for n in two["nodes"]:
        n["id"] += "2"
    links = [c | {"from": c["from"] + "2", "to": c["to"] + "2"} for c in two["connexions"]]
    job = plan.build(spark, {"nodes": one["nodes"] + two["nodes"], "connexions": one["connexions"] + links})
    assert job.sinks == ["o", "o2"] and not job.orphans
    return job.result("o").select(F.lit("orders").alias("flow"), "id").unionByName(job.result("o2").select(F.lit("customers").alias("flow"), "id"))


def _constraints(spark, d):
    """An information schema of the given tables: columns from their schemas, one primary and one foreign key."""
    rows = [("main", t, f.name, i, f.dataType.simpleString(), "YES", None, None, None, None) for t in TABLES for i, f in enumerate(table(spark, d, t).schema.fields, 1)]
    kinds = "table_schema string, table_name string, column_name string, ordinal_position int, data_type string, is_nullable string, character_maximum_length long, numeric_precision int, numeric_scale int, column_default string"
    uses = [("main", "customer", "c_custkey", "pk_customer", 1, None), ("main", "orders", "o_custkey", "fk_orders", 1, 1)]
    return {
        "columns": spark.createDataFrame(rows, kinds),
        "key_column_usage": spark.createDataFrame(uses, "table_schema string, table_name string, column_name string, constraint_name string, ordinal_position int, position_in_unique_constraint int"),
        "table_constraints": spark.createDataFrame([("main", "customer", "pk_customer", "PRIMARY KEY"), ("main", "orders", "fk_orders", "FOREIGN KEY")], "table_schema string, table_name string, constraint_name string, constraint_type string"),
        "referential_constraints": spark.createDataFrame([("main", "fk_orders", "main", "pk_customer", "NO ACTION", "CASCADE")], "constraint_schema string, constraint_name string, unique_constraint_schema string, unique_constraint_name string, update_rule string, delete_rule string"),
    }


@query("describe_schema_profile", "SELECT 'o_custkey' AS \"column\", 'FOREIGN KEY' AS constraint_type, 'customer.c_custkey' AS refers_to, 'CASCADE' AS delete_rule, count(*) AS rows, count(o_custkey) AS filled FROM orders UNION ALL SELECT 'c_custkey', 'PRIMARY KEY', NULL, NULL, count(*), count(c_custkey) FROM customer")
def _(spark, d):
    """The keys of the schema, with how many rows their tables have and how many of them have the key."""
    keys = sql.describe_schema(spark, views=_constraints(spark, d)).where("constraint_type is not null")
    sizes = sql.filled(table(spark, d, "orders")).unionByName(sql.filled(table(spark, d, "customer")))
    return keys.join(sizes, keys["column"] == sizes["name"]).select("column", "constraint_type", "refers_to", "delete_rule", "rows", "filled")
