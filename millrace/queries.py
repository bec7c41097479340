"""The engine's queries: pipelines over the shared tables, and the same in SQL."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.operators import OPERATORS
from millrace.operators.columns import change_schema
from millrace.plans.relation import Relation
from millrace.plans.runner import output, run
from millrace.plans.spec import load
from millrace.sources import sinks

Node = dict


def source(table: str, sf: str) -> Node:
    return {"id": table, "type": "DataSource", "config": {"format": "parquet", "path": f"{sf}/{table}.parquet", "mode": "infer"}}


def node(name: str, kind: str, inputs, **config) -> Node:
    return {"id": name, "type": kind, "inputs": inputs if isinstance(inputs, (list, dict)) else [inputs], "config": config}


def rule(column: str, operation: str, value) -> dict:
    return {"column": column, "operation": operation, "value": value}


def metric(function: str, column: str, alias: str) -> dict:
    return {"function": function, "column": column, "as": alias}


def key(column: str, direction: str = "asc", nulls: str = "") -> dict:
    return {"column": column, "direction": direction, "nulls": nulls}


def col(name: str, kind: str, expr: str | None = None) -> dict:
    return {"name": name, "sql_type": kind} | ({"expr": expr} if expr else {})


#: name: (tables, nodes after the sources, the output to read, SQL)
PLANS: dict[str, tuple[list[str], list[Node], str, str]] = {}


def plan(name: str, tables: str, nodes: list[Node], sql: str, ref: str | None = None) -> None:
    PLANS[name] = (tables.split(), nodes, ref or nodes[-1]["id"], sql)


plan("filter_all", "lineitem", [node("f", "Filter", "lineitem", mode="all", rules=[rule("l_quantity", "gt", 40), rule("l_returnflag", "contains", "R")])], "SELECT * FROM lineitem WHERE l_quantity > 40 AND l_returnflag LIKE '%R%'")
plan("filter_any", "orders", [node("f", "Filter", "orders", mode="any", rules=[rule("o_orderstatus", "eq", "P"), rule("o_totalprice", "gt", 400000)])], "SELECT * FROM orders WHERE o_orderstatus = 'P' OR o_totalprice > 400000")
plan("filter_ne", "events", [node("f", "Filter", "events", rules=[rule("event_type", "ne", "view")])], "SELECT * FROM events WHERE event_type <> 'view'")
plan("filter_lt", "events", [node("f", "Filter", "events", rules=[rule("value", "lt", 10.5)])], "SELECT * FROM events WHERE value < 10.5")
plan("filter_null_value", "events", [node("f", "Filter", "events", rules=[rule("event_type", "eq", None)])], "SELECT * FROM events WHERE event_type = NULL")
plan("filter_startswith", "part", [node("f", "Filter", "part", rules=[rule("p_type", "startsWith", "S")])], "SELECT * FROM part WHERE p_type LIKE 'S%'")
plan("filter_endswith", "customer", [node("f", "Filter", "customer", rules=[rule("c_name", "endsWith", "7")])], "SELECT * FROM customer WHERE c_name LIKE '%7'")
plan("filter_like_wildcard", "customer", [node("f", "Filter", "customer", rules=[rule("c_mktsegment", "contains", "U_L")])], "SELECT * FROM customer WHERE c_mktsegment LIKE '%U_L%'")
plan("select_reorder", "customer", [node("s", "SelectColumns", "customer", columns=["C_NAME", "c_custkey", "c_nationkey"])], "SELECT c_name, c_custkey, c_nationkey FROM customer")
plan(
    "constant_column",
    "nation",
    [node("a", "ConstantColumn", "nation", column=col("label", "VARCHAR"), value="x"), node("b", "ConstantColumn", "a", column=col("one", "INTEGER"), value=1), node("c", "ConstantColumn", "b", column=col("day", "DATE"), value="2024-01-02"), node("d", "ConstantColumn", "c", column=col("none", "VARCHAR"), value=None), node("e", "CastColumns", "d", casts=[{"column": "day", "sql_type": "VARCHAR"}])],
    "SELECT *, 'x' AS label, 1 AS one, (DATE '2024-01-02')::VARCHAR AS day, NULL::VARCHAR AS none FROM nation",
)
plan("compute_template", "customer", [node("t", "ComputeColumn", "customer", columns=[col("told", "VARCHAR", "{{c_name}} in {{ C_MKTSEGMENT }}"), col("key", "BIGINT", "{{c_custkey}}")])], "SELECT *, concat(c_name, ' in ', c_mktsegment) AS told, c_custkey AS key FROM customer")
plan("compute_template_double", "supplier", [node("t", "ComputeColumn", "supplier", columns=[col("told", "VARCHAR", "{{s_name}}: {{s_acctbal}}")])], "SELECT *, concat(s_name, ': ', s_acctbal) AS told FROM supplier")
plan(
    "compute_template_null",
    "customer nation",
    [node("j", "Join", {"left": "customer", "right": "few"}, mode="left", keys=[{"left": "c_nationkey", "right": "n_nationkey"}]), node("t", "ComputeColumn", "j", columns=[col("told", "VARCHAR", "{{c_name}}/{{n_name}}")]), node("s", "SelectColumns", "t", columns=["c_custkey", "told"])],
    "SELECT c_custkey, concat(c_name, '/', n_name) AS told FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 5) ON c_nationkey = n_nationkey",
)
PLANS["compute_template_null"][1].insert(0, node("few", "Filter", "nation", rules=[rule("n_nationkey", "lt", 5)]))
plan("compute_raw", "lineitem", [node("c", "ComputeColumn", "lineitem", columns=[col("net", "DOUBLE", "l_extendedprice * (1 - l_discount)")]), node("s", "SelectColumns", "c", columns=["l_orderkey", "l_linenumber", "net"])], "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem")
plan("compute_case", "orders", [node("c", "ComputeColumn", "orders", columns=[col("size", "VARCHAR", "case when o_totalprice > 200000 then 'big' else lower(o_orderstatus) || '!' end"), col("part", "INTEGER", "year(o_orderdate)")])], "SELECT *, CASE WHEN o_totalprice > 200000 THEN 'big' ELSE lower(o_orderstatus) || '!' END AS size, year(o_orderdate)::INTEGER AS part FROM orders")
plan("compute_window", "orders", [node("c", "ComputeColumn", "orders", columns=[col("nth", "INTEGER", "row_number() over (partition by o_custkey order by o_orderkey)")])], "SELECT *, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey))::INTEGER AS nth FROM orders")
plan(
    "compute_dialect",
    "customer",
    [node("c", "ComputeColumn", "customer", columns=[col("at", "INTEGER", "strpos(c_name, '#')"), col("half", "BIGINT", "c_custkey // 2"), col("first", "VARCHAR", "regexp_replace(c_name, '0', 'x')"), col("both", "VARCHAR", "concat(c_mktsegment, NULL, '-', c_custkey)"), col("has", "BOOLEAN", "list_contains([1, 2, 3], c_nationkey)")])],
    "SELECT *, strpos(c_name, '#')::INTEGER AS at, c_custkey // 2 AS half, regexp_replace(c_name, '0', 'x') AS first, concat(c_mktsegment, NULL, '-', c_custkey) AS both, list_contains([1, 2, 3], c_nationkey) AS has FROM customer",
)
plan("rename_swap", "supplier", [node("r", "RenameColumns", "supplier", renames=[{"from": "s_suppkey", "to": "s_nationkey"}, {"from": "s_nationkey", "to": "s_suppkey"}])], "SELECT s_suppkey AS s_nationkey, s_name, s_nationkey AS s_suppkey, s_acctbal FROM supplier")
plan("cast_round", "lineitem", [node("c", "CastColumns", "lineitem", casts=[{"column": "l_extendedprice", "sql_type": "INTEGER"}, {"column": "l_quantity", "sql_type": "BIGINT"}])], "SELECT * REPLACE (l_extendedprice::INTEGER AS l_extendedprice, l_quantity::BIGINT AS l_quantity) FROM lineitem")
plan(
    "cast_decimal_round",
    "part",
    [node("a", "CastColumns", "part", casts=[{"column": "p_retailprice", "sql_type": "DECIMAL(12,1)"}]), node("b", "CastColumns", "a", casts=[{"column": "p_retailprice", "sql_type": "INTEGER"}])],
    "SELECT * REPLACE ((p_retailprice::DECIMAL(12,1))::INTEGER AS p_retailprice) FROM part",
)
plan("cast_string", "orders", [node("c", "CastColumns", "orders", casts=[{"column": "o_orderkey", "sql_type": "VARCHAR"}, {"column": "o_orderdate", "sql_type": "VARCHAR"}, {"column": "o_totalprice", "sql_type": "VARCHAR"}])], "SELECT * REPLACE (o_orderkey::VARCHAR AS o_orderkey, o_orderdate::VARCHAR AS o_orderdate, o_totalprice::VARCHAR AS o_totalprice) FROM orders")
plan("cast_text_number", "customer", [node("a", "ComputeColumn", "customer", columns=[col("t", "VARCHAR", "concat(' ', c_custkey, '.5')")]), node("c", "CastColumns", "a", casts=[{"column": "t", "sql_type": "INTEGER"}])], "SELECT *, concat(' ', c_custkey, '.5')::INTEGER AS t FROM customer")
plan("fill_replace", "orders", [node("f", "FillReplace", "orders", rules=[{"column": "o_orderstatus", "replace_from": "O", "replace_to": "OPEN", "fill_null_with": "?"}])], "SELECT * REPLACE (coalesce(CASE WHEN o_orderstatus = 'O' THEN 'OPEN' ELSE o_orderstatus END, '?') AS o_orderstatus) FROM orders")
plan(
    "fill_nulls",
    "customer nation",
    [node("few", "Filter", "nation", rules=[rule("n_regionkey", "lt", 2)]), node("j", "Join", {"left": "customer", "right": "few"}, mode="left", keys=[{"left": "c_nationkey", "right": "n_nationkey"}]), node("f", "FillReplace", "j", rules=[{"column": "n_name", "fill_null_with": "nowhere"}, {"column": "n_regionkey", "fill_null_with": -1}]), node("s", "SelectColumns", "f", columns=["c_custkey", "n_name", "n_regionkey"])],
    "SELECT c_custkey, coalesce(n_name, 'nowhere') AS n_name, coalesce(n_regionkey, -1) AS n_regionkey FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 2) ON c_nationkey = n_nationkey",
)
plan(
    "sort_nulls",
    "orders",
    [node("c", "ComputeColumn", "orders", columns=[col("k", "VARCHAR", "nullif(o_orderstatus, 'F')")]), node("s", "Sort", "c", keys=[key("k", "desc", "first"), key("o_orderkey")]), node("l", "Limit", "s", count=50)],
    "SELECT *, nullif(o_orderstatus, 'F') AS k FROM orders ORDER BY k DESC NULLS FIRST, o_orderkey LIMIT 50",
)
plan("sort_limit_offset", "orders", [node("s", "Sort", "orders", keys=[key("o_totalprice", "desc"), key("o_orderkey")]), node("l", "Limit", "s", count=20, offset=5)], "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5")
plan("limit_sample", "customer", [node("s", "Sort", "customer", keys=[key("c_acctbal"), key("c_custkey", "desc")]), node("l", "LimitSample", "s", count=15)], "SELECT * FROM customer ORDER BY c_acctbal, c_custkey DESC LIMIT 15")
plan("dedup_first", "orders", [node("d", "Deduplicate", "orders", columns=["o_custkey"], order_by=[key("o_orderdate"), key("o_orderkey")])], "SELECT DISTINCT ON (o_custkey) * FROM orders ORDER BY o_custkey, o_orderdate, o_orderkey")
plan("dedup_last", "orders", [node("d", "Deduplicate", "orders", columns=["o_custkey"], keep="last", order_by=[key("o_orderdate"), key("o_orderkey")])], "SELECT DISTINCT ON (o_custkey) * FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey DESC")
plan("agg_grouped", "events", [node("a", "Aggregate", "events", group_by=["event_type"], metrics=[metric("count", "*", "n"), metric("sum", "value", "total"), metric("avg", "value", "mean"), metric("min", "ts", "first"), metric("max", "value", "most")]), node("r", "ComputeColumn", "a", columns=[col("total2", "DOUBLE", "round(total, 2)"), col("mean4", "DOUBLE", "round(mean, 4)")]), node("s", "SelectColumns", "r", columns=["event_type", "n", "total2", "mean4", "first", "most"])], "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total2, round(avg(value), 4) AS mean4, min(ts) AS first, max(value) AS most FROM events GROUP BY 1")
plan("agg_global_int", "part", [node("a", "Aggregate", "part", group_by=[], metrics=[metric("sum", "p_size", "total"), metric("count", "p_name", "n")])], "SELECT sum(p_size)::INTEGER AS total, count(p_name) AS n FROM part")
plan("agg_count_col", "customer", [node("c", "ComputeColumn", "customer", columns=[col("seg", "VARCHAR", "nullif(c_mktsegment, 'BUILDING')")]), node("a", "Aggregate", "c", group_by=["c_nationkey"], metrics=[metric("count", "seg", "n"), metric("count", "*", "everyone")])], "SELECT c_nationkey, count(nullif(c_mktsegment, 'BUILDING')) AS n, count(*) AS everyone FROM customer GROUP BY 1")
plan("agg_null_group", "customer", [node("c", "ComputeColumn", "customer", columns=[col("seg", "VARCHAR", "nullif(c_mktsegment, 'BUILDING')")]), node("a", "Aggregate", "c", group_by=["seg"], metrics=[metric("min", "c_name", "first"), metric("max", "c_custkey", "last")])], "SELECT nullif(c_mktsegment, 'BUILDING') AS seg, min(c_name) AS first, max(c_custkey) AS last FROM customer GROUP BY 1")
plan("join_inner", "customer nation", [node("j", "Join", {"left": "customer", "right": "nation"}, mode="inner", keys=[{"left": "c_nationkey", "right": "n_nationkey"}])], "SELECT * FROM customer JOIN nation ON c_nationkey = n_nationkey")
plan("join_left", "customer orders", [node("few", "Filter", "orders", rules=[rule("o_totalprice", "gt", 300000)]), node("j", "Join", {"left": "customer", "right": "few"}, mode="left", keys=[{"left": "c_custkey", "right": "o_custkey"}]), node("t", "CastColumns", "j", casts=[{"column": "o_orderkey", "sql_type": "VARCHAR"}, {"column": "o_custkey", "sql_type": "VARCHAR"}])], "SELECT * REPLACE (o_orderkey::VARCHAR AS o_orderkey, o_custkey::VARCHAR AS o_custkey) FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) ON c_custkey = o_custkey")
plan(
    "join_multikey",
    "lineitem",
    [node("a", "SelectColumns", "lineitem", columns=["l_orderkey", "l_linenumber", "l_quantity"]), node("b", "Filter", "lineitem", rules=[rule("l_returnflag", "eq", "R")]), node("c", "SelectColumns", "b", columns=["l_linenumber", "l_orderkey", "l_tax"]), node("j", "Join", {"left": "a", "right": "c"}, mode="inner", keys=[{"left": "l_orderkey", "right": "l_orderkey"}, {"left": "l_linenumber", "right": "l_linenumber"}])],
    "SELECT a.l_orderkey, a.l_linenumber, a.l_quantity, b.l_linenumber AS l_linenumber_right, b.l_orderkey AS l_orderkey_right, b.l_tax FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber WHERE b.l_returnflag = 'R'",
)
plan(
    "join_collision_suffix",
    "nation",
    [node("a", "SelectColumns", "nation", columns=["n_nationkey", "n_name"]), node("b", "SelectColumns", "nation", columns=["n_nationkey", "n_name", "n_regionkey"]), node("j", "Join", {"left": "a", "right": "b"}, mode="inner", keys=[{"left": "n_nationkey", "right": "n_nationkey"}]), node("k", "Join", {"left": "j", "right": "a"}, mode="left", keys=[{"left": "n_regionkey", "right": "n_nationkey"}])],
    "SELECT a.n_nationkey, a.n_name, b.n_nationkey AS n_nationkey_right, b.n_name AS n_name_right, b.n_regionkey, c.n_nationkey AS n_nationkey_right_2, c.n_name AS n_name_right_2 FROM nation a JOIN nation b USING (n_nationkey) LEFT JOIN nation c ON b.n_regionkey = c.n_nationkey",
)
plan(
    "union_by_name",
    "customer supplier",
    [node("a", "SelectColumns", "customer", columns=["c_custkey", "c_name"]), node("b", "SelectColumns", "supplier", columns=["s_name", "s_suppkey"]), node("c", "RenameColumns", "b", renames=[{"from": "s_name", "to": "c_name"}, {"from": "s_suppkey", "to": "c_custkey"}]), node("u", "MergeUnion", ["a", "c"], mode="align_by_name")],
    "SELECT c_custkey, c_name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier",
)
plan("union_strict", "nation", [node("a", "Filter", "nation", rules=[rule("n_regionkey", "lt", 3)]), node("b", "Filter", "nation", rules=[rule("n_regionkey", "gt", 1)]), node("u", "MergeUnion", ["a", "b"], mode="strict_positional")], "SELECT * FROM nation WHERE n_regionkey < 3 UNION ALL SELECT * FROM nation WHERE n_regionkey > 1")
plan("union_three", "region", [node("a", "Filter", "region", rules=[rule("r_regionkey", "lt", 3)]), node("b", "Filter", "region", rules=[rule("r_name", "startsWith", "A")]), node("u", "MergeUnion", ["region", "a", "b"], mode="strict_positional")], "SELECT * FROM region UNION ALL SELECT * FROM region WHERE r_regionkey < 3 UNION ALL SELECT * FROM region WHERE r_name LIKE 'A%'")
_RULES = [rule("value", "gt", 100), rule("event_type", "eq", "click")]
plan("cond_if", "events", [node("c", "Conditional", "events", mode="all", rules=_RULES)], "SELECT * FROM events WHERE value > 100 AND event_type = 'click'", "c:if")
plan("cond_else", "events", [node("c", "Conditional", "events", mode="any", rules=_RULES)], "SELECT * FROM events WHERE NOT (value > 100 OR event_type = 'click')", "c:else")
plan("cond_null", "events", [node("k", "ComputeColumn", "events", columns=[col("kind", "VARCHAR", "nullif(event_type, 'view')")]), node("c", "Conditional", "k", rules=[rule("kind", "eq", "click")])], "SELECT *, nullif(event_type, 'view') AS kind FROM events WHERE NOT (nullif(event_type, 'view') = 'click')", "c:else")
_BRANCHES = [{"label": "Big", "rules": [rule("value", "gt", 250)]}, {"label": "buy", "mode": "any", "rules": [rule("event_type", "eq", "purchase"), rule("event_type", "eq", "signup")]}]
plan("switch_branch", "events", [node("s", "Switch", "events", branches=_BRANCHES)], "SELECT * FROM events WHERE event_type = 'purchase' OR event_type = 'signup'", "s:buy")
plan("switch_default", "events", [node("s", "Switch", "events", branches=_BRANCHES)], "SELECT * FROM events WHERE NOT (value > 250 OR event_type = 'purchase' OR event_type = 'signup')", "s:default")
plan("switch_match_all", "region", [node("s", "Switch", "region", branches=[{"label": "all", "rules": []}])], "SELECT * FROM region", "s:all")
plan("switch_empty_default", "region", [node("s", "Switch", "region", branches=[{"label": "all", "rules": []}])], "SELECT * FROM region WHERE false", "s:default")
plan("unnest", "embeddings", [node("u", "UnnestArray", "embeddings", array_column="embedding", output_column=col("x", "DOUBLE")), node("s", "SelectColumns", "u", columns=["vec_id", "label", "x"])], "SELECT vec_id, label, unnest(embedding)::DOUBLE AS x FROM embeddings")
plan("pivot_sum", "orders", [node("a", "SelectColumns", "orders", columns=["o_orderpriority", "o_orderstatus", "o_totalprice"]), node("i", "CastColumns", "a", casts=[{"column": "o_totalprice", "sql_type": "BIGINT"}]), node("p", "Pivot", "i", group_by=["o_orderpriority"], pivot_column="o_orderstatus", value_column="o_totalprice", agg_fn="sum", in_values=["F", "O"])], "SELECT o_orderpriority, (sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice::BIGINT END))::BIGINT AS \"F\", (sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice::BIGINT END))::BIGINT AS \"O\" FROM orders GROUP BY 1")
plan("pivot_count", "orders", [node("a", "SelectColumns", "orders", columns=["o_orderpriority", "o_orderstatus", "o_orderkey"]), node("p", "Pivot", "a", group_by=["o_orderpriority"], pivot_column="o_orderstatus", value_column="o_orderkey", agg_fn="count", in_values=["F", "O", "X"])], "SELECT o_orderpriority, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS \"F\", count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS \"O\", 0::BIGINT AS \"X\" FROM orders GROUP BY 1")
plan("pivot_extra_cols", "lineitem", [node("a", "SelectColumns", "lineitem", columns=["l_returnflag", "l_linestatus", "l_linenumber", "l_orderkey"]), node("p", "Pivot", "a", group_by=["l_returnflag"], pivot_column="l_linestatus", value_column="l_orderkey", agg_fn="count", in_values=["O", "F"])], "SELECT l_returnflag, count(CASE WHEN l_linestatus = 'O' THEN 1 END) AS \"O\", count(CASE WHEN l_linestatus = 'F' THEN 1 END) AS \"F\" FROM lineitem GROUP BY l_returnflag, l_linenumber")
plan("unpivot", "part", [node("c", "CastColumns", "part", casts=[{"column": "p_size", "sql_type": "DOUBLE"}]), node("u", "Unpivot", "c", passthrough=["p_partkey"], name_column=col("what", "VARCHAR"), value_column=col("amount", "DOUBLE"), in_columns=["p_size", "p_retailprice"])], "SELECT p_partkey, 'p_size' AS what, p_size::DOUBLE AS amount FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part")
plan("unpivot_nulls", "part", [node("c", "ComputeColumn", "part", columns=[col("small", "INTEGER", "case when p_size < 20 then p_size end")]), node("u", "Unpivot", "c", passthrough=[], name_column=col("what", "VARCHAR"), value_column=col("amount", "BIGINT"), in_columns=["small", "p_size"])], "SELECT 'small' AS what, p_size::BIGINT AS amount FROM part WHERE p_size < 20 UNION ALL SELECT 'p_size', p_size FROM part")
plan("cast_array_unnest", "labels", [node("c", "ComputeColumn", "labels", columns=[col("t", "VARCHAR", "concat('[', doc_id, ', ', toxic, ',NULL]')")]), node("a", "CastColumns", "c", casts=[{"column": "t", "sql_type": "BIGINT[]"}]), node("u", "UnnestArray", "a", array_column="t", output_column=col("x", "BIGINT")), node("s", "SelectColumns", "u", columns=["doc_id", "x"]), node("v", "CastColumns", "s", casts=[{"column": "x", "sql_type": "VARCHAR"}])], "SELECT doc_id, unnest(concat('[', doc_id, ', ', toxic, ',NULL]')::BIGINT[])::VARCHAR AS x FROM labels")
plan(
    "pipeline_flagship",
    "lineitem orders customer",
    [
        node("late", "Filter", "lineitem", rules=[rule("l_returnflag", "eq", "R"), rule("l_quantity", "gt", 10)]),
        node("lo", "Join", {"left": "late", "right": "orders"}, mode="inner", keys=[{"left": "l_orderkey", "right": "o_orderkey"}]),
        node("loc", "Join", {"left": "lo", "right": "customer"}, mode="inner", keys=[{"left": "o_custkey", "right": "c_custkey"}]),
        node("net", "ComputeColumn", "loc", columns=[col("net", "BIGINT", "l_extendedprice * (1 - l_discount)")]),
        node("sums", "Aggregate", "net", group_by=["c_mktsegment", "o_orderpriority"], metrics=[metric("sum", "net", "revenue"), metric("count", "*", "lines")]),
        node("top", "Sort", "sums", keys=[key("revenue", "desc"), key("c_mktsegment"), key("o_orderpriority")]),
        node("out", "Limit", "top", count=10),
    ],
    "SELECT c_mktsegment, o_orderpriority, (sum((l_extendedprice * (1 - l_discount))::BIGINT))::BIGINT AS revenue, count(*) AS lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_returnflag = 'R' AND l_quantity > 10 GROUP BY 1, 2 ORDER BY revenue DESC, 1, 2 LIMIT 10",
)
plan("pipeline_diamond", "events", [node("a", "Filter", "events", rules=[rule("value", "gt", 100)]), node("b", "Filter", "events", rules=[rule("value", "lt", 50)]), node("u", "MergeUnion", ["a", "b"], mode="strict_positional"), node("g", "Aggregate", "u", group_by=["event_type"], metrics=[metric("count", "*", "n")])], "SELECT event_type, count(*) AS n FROM events WHERE value > 100 OR value < 50 GROUP BY 1")
plan("pipeline_branch_sinks", "events", [node("c", "Conditional", "events", rules=[rule("value", "gt", 100)]), node("s", "Switch", "events", branches=_BRANCHES)], "SELECT * FROM events WHERE value > 250", "s:big")


_DAY = "CAST(o_orderdate AS DATE)"
plan("raw_strings", "customer", [node("c", "ComputeColumn", "customer", columns=[col("up", "VARCHAR", "upper(c_name)"), col("part", "VARCHAR", "substr(c_name, 1, 4)"), col("at", "BIGINT", "strpos(c_name, '#')"), col("first", "VARCHAR", "string_split(c_name, '#')[1]"), col("both", "VARCHAR", "concat(c_mktsegment, '-', c_name)"), col("like9", "BOOLEAN", "regexp_matches(c_name, '9+')")])], "SELECT *, upper(c_name) AS up, substr(c_name, 1, 4) AS part, strpos(c_name, '#') AS at, string_split(c_name, '#')[1] AS first, concat(c_mktsegment, '-', c_name) AS both, regexp_matches(c_name, '9+') AS like9 FROM customer")
plan("raw_groups", "customer", [node("c", "ComputeColumn", "customer", columns=[col("one", "VARCHAR", "regexp_replace(c_name, '([A-Z])([a-z]+)', '\\2$\\1')"), col("every", "VARCHAR", "regexp_replace(c_name, '([0-9])', '<\\1>', 'g')"), col("whole", "VARCHAR", "regexp_replace(c_name, 'CUST', '[\\0]', 'i')")])], "SELECT *, regexp_replace(c_name, '([A-Z])([a-z]+)', '\\2$\\1') AS one, regexp_replace(c_name, '([0-9])', '<\\1>', 'g') AS every, regexp_replace(c_name, 'CUST', '[\\0]', 'i') AS whole FROM customer")
plan("raw_dates", "orders", [node("c", "ComputeColumn", "orders", columns=[col("d", "DATE", _DAY), col("y", "BIGINT", "year(o_orderdate)"), col("w", "BIGINT", "week(o_orderdate)"), col("wd", "BIGINT", "dayofweek(o_orderdate)"), col("text", "VARCHAR", "strftime(o_orderdate, '%Y/%m/%d')"), col("month", "TIMESTAMP", "date_trunc('month', o_orderdate)"), col("age", "BIGINT", f"datediff('day', {_DAY}, DATE '2024-06-01')")])], f"SELECT *, {_DAY} AS d, year(o_orderdate) AS y, week(o_orderdate) AS w, dayofweek(o_orderdate) AS wd, strftime(o_orderdate, '%Y/%m/%d') AS text, date_trunc('month', o_orderdate)::TIMESTAMP AS month, datediff('day', {_DAY}, DATE '2024-06-01') AS age FROM orders")
plan("raw_math", "lineitem", [node("c", "ComputeColumn", "lineitem", columns=[col("whole", "BIGINT", "l_orderkey // 7"), col("rest", "BIGINT", "l_orderkey % 7"), col("up", "BIGINT", "ceil(l_discount)"), col("size", "DOUBLE", "abs(l_tax - l_discount)"), col("most", "DOUBLE", "greatest(l_tax, l_discount)")])], "SELECT *, l_orderkey // 7 AS whole, l_orderkey % 7 AS rest, ceil(l_discount)::BIGINT AS up, abs(l_tax - l_discount) AS size, greatest(l_tax, l_discount) AS most FROM lineitem")
plan("raw_conditions", "events", [node("c", "ComputeColumn", "events", columns=[col("none", "VARCHAR", "nullif(event_type, 'click')"), col("known", "VARCHAR", "coalesce(nullif(event_type, 'click'), 'other')"), col("band", "VARCHAR", "CASE WHEN value > 200 THEN 'high' WHEN value > 50 THEN 'mid' ELSE 'low' END"), col("n", "INTEGER", "CAST(user_id AS INTEGER)")])], "SELECT *, nullif(event_type, 'click') AS none, coalesce(nullif(event_type, 'click'), 'other') AS known, CASE WHEN value > 200 THEN 'high' WHEN value > 50 THEN 'mid' ELSE 'low' END AS band, user_id::INTEGER AS n FROM events")
plan("raw_json", "events", [node("c", "ComputeColumn", "events", columns=[col("k", "INTEGER", "CAST(json_extract(props, '$.k') AS INTEGER)")])], "SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
_GAPS = "nullif(o_orderstatus, 'F')"
plan("window_nulls", "orders", [node("c", "ComputeColumn", "orders", columns=[col("place", "BIGINT", f"row_number() over (partition by o_custkey order by {_GAPS}, o_orderkey desc)"), col("before", "BIGINT", f"lag(o_orderkey) over (partition by o_custkey order by {_GAPS} desc, o_orderkey)"), col("upto", "BIGINT", f"count(*) over (order by {_GAPS}, o_orderkey nulls first rows between unbounded preceding and current row)")])], f"SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY {_GAPS}, o_orderkey DESC) AS place, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY {_GAPS} DESC, o_orderkey) AS before, count(*) OVER (ORDER BY {_GAPS}, o_orderkey NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM orders")


def document(name: str, sf: str) -> dict:
    """The JSON document of a query."""
    tables, nodes, ref, _ = PLANS[name]
    return {"pipeline_id": name, "version": 1, "nodes": [source(t, sf) for t in tables] + nodes, "sinks": [{"node_id": ref, "target_table": f"{name}_out"}]}


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: output(spark, load(document(name, sf_dir)), PLANS[name][2])


def _scratch(spark: SparkSession) -> str:
    """A new folder beside what the cluster shares; of this machine where nothing is set, as in tests. It goes when the program ends."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.gettempdir()
    path = f"{shared.rstrip('/')}/millrace-files-{uuid.uuid4().hex}"
    atexit.register(lambda: _gone(spark, path))
    return path


def _gone(spark: SparkSession, path: str) -> None:
    try:
        sinks.remove(spark, path)
    except Exception:  # the session has ended; the folder's own policy applies
        return


def _read(spark: SparkSession, config: dict) -> DataFrame:
    nodes = [{"id": "file", "type": "DataSource", "config": config}]
    return output(spark, load({"pipeline_id": "files", "version": 1, "nodes": nodes, "sinks": [{"node_id": "file", "target_table": "out"}]}), "file")


def _declared(*columns: str) -> list[dict]:
    return [dict(zip(("name", "sql_type"), c.split(), strict=True)) for c in columns]


def _by_csv(table: str, of: list[str] | None = None, single: bool = False, **config) -> Callable[[SparkSession, str], DataFrame]:
    """A query that writes columns of a table as CSV and reads that back as a data source."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        path = f"{_scratch(spark)}/{table}" + (".csv" if single else "")
        sinks.to_file(df.select(*of) if of else df, path, "csv")
        return _read(spark, {"format": "csv", "path": path, "mode": "infer"} | config)

    return query


def _by_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{_scratch(spark)}/events"
    sinks.to_file(spark.read.parquet(f"{sf_dir}/events.parquet"), path, "parquet")
    return _read(spark, {"format": "parquet", "path": path, "mode": "declared", "columns": _declared("event_type VARCHAR", "event_id BIGINT", "value DOUBLE")})


def _run_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run from CSV to five sinks: rows as told, and rows found in each table afterwards."""
    folder, mark = _scratch(spark), uuid.uuid4().hex[:8]
    sinks.to_file(spark.read.parquet(f"{sf_dir}/customer.parquet"), f"{folder}/customer", "csv")
    targets = [None, ("csv", "all.csv"), ("csv", "all"), ("parquet", "all.parquet"), ("parquet", "parts")]
    nodes = [{"id": "src", "type": "DataSource", "config": {"format": "csv", "path": f"{folder}/customer", "mode": "infer"}}, node("rich", "Filter", "src", rules=[rule("c_acctbal", "gt", 5000)])]
    ends = [{"node_id": "rich" if k else "src", "target_table": f"t{k}_{mark}"} | ({"target": {"type": "file", "format": t[0], "path": f"{folder}/{t[1]}"}} if t else {}) for k, t in enumerate(targets)]
    told = run(spark, load({"pipeline_id": "five", "version": 1, "nodes": nodes, "sinks": ends}))
    return spark.createDataFrame([(k, r.format or "table", r.rows, spark.table(r.target_table).count()) for k, r in enumerate(told)], "sink int, format string, told long, found long")


def _table_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = f"copy_{uuid.uuid4().hex[:8]}"
    nodes = [source("orders", sf_dir), node("f", "Filter", "orders", rules=[rule("o_totalprice", "gt", 1000)]), node("c", "CastColumns", "f", casts=[{"column": "o_totalprice", "sql_type": "BIGINT"}])]
    run(spark, load({"pipeline_id": "copy", "version": 1, "nodes": nodes, "sinks": [{"node_id": "c", "target_table": name}]}))
    return spark.table(name)


def _join_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = (Relation.of(spark.read.parquet(f"{sf_dir}/{t}.parquet")) for t in ("customer", "nation"))
    chosen = [{"side": s, "column": c, "as": a} for s, c, a in (("right", "n_name", "country"), ("left", "C_NAME", "person"), ("left", "c_custkey", "id"))]
    return OPERATORS["Join"]([left, right], {"mode": "inner", "keys": [{"left": "c_nationkey", "right": "n_nationkey"}], "select": chosen}).df


def _schema_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = [{"op": "add_column", "name": "k", "sql_type": "INTEGER", "value": 7}, {"op": "drop_column", "name": "n_regionkey"}, {"op": "rename_column", "name": "n_name", "to": "country"}, {"op": "change_type", "name": "n_nationkey", "sql_type": "VARCHAR"}]
    return change_schema(Relation.of(spark.read.parquet(f"{sf_dir}/nation.parquet")), steps).df


def _literal_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.sources.files import literal_rows

    few = literal_rows(spark, [{"code": k, "label": v} for k, v in (("F", "done"), ("O", "open"), ("X", None))])
    orders = Relation.of(spark.read.parquet(f"{sf_dir}/orders.parquet"))
    return OPERATORS["Join"]([orders, few], {"mode": "left", "keys": [{"left": "o_orderstatus", "right": "code"}]}).df


#: name: (query, SQL), of what is no single output of a pipeline over the tables: files, sinks, and what only library calls offer.
CALLS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "csv_infer": (_by_csv("nation", single=True), "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation"),
    "csv_types": (_by_csv("orders"), "SELECT * FROM orders"),
    "csv_declared": (_by_csv("customer", mode="declared", columns=_declared("c_name VARCHAR", "c_custkey INTEGER", "c_acctbal BIGINT")), "SELECT c_name, c_custkey::INTEGER AS c_custkey, c_acctbal::BIGINT AS c_acctbal FROM customer"),
    "csv_checked": (_by_csv("nation", single=True, mode="declared_with_check", columns=_declared("N_NATIONKEY BIGINT", "n_name VARCHAR", "n_regionkey BIGINT")), "SELECT n_nationkey::BIGINT AS N_NATIONKEY, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation"),
    "csv_quoted": (_by_csv("documents", ["doc_id", "text", "lang"]), "SELECT doc_id, text, lang FROM documents"),
    "sink_csv_round_trip": (_by_csv("part"), "SELECT * FROM part"),
    "sink_parquet_round_trip": (_by_parquet, "SELECT event_type, event_id, value FROM events"),
    "sink_table_copy": (_table_copy, "SELECT * REPLACE (o_totalprice::BIGINT AS o_totalprice) FROM orders WHERE o_totalprice > 1000"),
    "run_five_sinks": (_run_sinks, "SELECT sink::INTEGER AS sink, format, CASE sink WHEN 0 THEN n ELSE rich END AS told, CASE sink WHEN 0 THEN n ELSE rich END AS found FROM (VALUES (0, 'table'), (1, 'csv'), (2, 'csv'), (3, 'parquet'), (4, 'parquet')) v(sink, format), (SELECT count(*) AS n, count(*) FILTER (c_acctbal > 5000) AS rich FROM customer)"),
    "join_select": (_join_select, "SELECT n_name AS country, c_name AS person, c_custkey AS id FROM customer JOIN nation ON c_nationkey = n_nationkey"),
    "schema_ops": (_schema_ops, "SELECT n_nationkey::VARCHAR AS n_nationkey, n_name AS country, 7 AS k FROM nation"),
    "literal_rows": (_literal_rows, "SELECT o.*, code, label FROM orders o LEFT JOIN (VALUES ('F', 'done'), ('O', 'open'), ('X', NULL)) v(code, label) ON o_orderstatus = code"),
}
QUERIES = {name: _query(name) for name in PLANS} | {name: q for name, (q, _) in CALLS.items()}
ORACLE_SQL = {name: p[3] for name, p in PLANS.items()} | {name: sql for name, (_, sql) in CALLS.items()}
