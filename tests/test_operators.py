"""Operators on small tables, with results worked out by hand."""

from __future__ import annotations

import pytest

from millrace.operators import OPERATORS
from millrace.operators.columns import change_schema


def rows(relation, *names):
    df = relation.df.select(*names) if names else relation.df
    return [tuple(r) for r in df.collect()]


def op(kind, inputs, **config):
    return OPERATORS[kind](inputs if isinstance(inputs, list) else [inputs], config)


def rule(column, operation, value):
    return {"column": column, "operation": operation, "value": value}


@pytest.fixture
def people(rel):
    return rel("id integer, name varchar", [(1, "John"), (2, "Doe"), (3, "Mary"), (4, "Jane"), (5, None)])


@pytest.mark.parametrize(
    ("condition", "ids"),
    [
        (rule("name", "eq", "John"), [1]), (rule("NAME", "ne", "John"), [2, 3, 4]), (rule("id", "gt", 3), [4, 5]), (rule("id", "lt", 2), [1]), (rule("name", "contains", "ar"), [3]),
        (rule("name", "startsWith", "J"), [1, 4]), (rule("name", "endsWith", "n"), [1]), (rule("name", "contains", "J_h"), [1]), (rule("name", "startsWith", "%y"), [3]), (rule("name", "eq", None), []),
    ],
)
def test_filter(people, condition, ids):
    assert [r[0] for r in rows(op("Filter", people, rules=[condition]), "id")] == ids


def test_filter_modes_and_errors(people):
    both = [rule("id", "gt", 1), rule("name", "startsWith", "J")]
    assert [r[0] for r in rows(op("Filter", people, mode="all", rules=both))] == [4]
    assert [r[0] for r in rows(op("Filter", people, mode="any", rules=both))] == [1, 2, 3, 4, 5]
    for bad in ([], [rule("x", "eq", 1)], [rule("id", "contains", "1")], [rule("name", "contains", 1)], [rule("name", "gt", 5)], [rule("id", "between", 1)], [rule("id", "eq", [1])]):
        with pytest.raises(ValueError):
            op("Filter", people, rules=bad)


def test_like_has_no_escape(rel):
    r = rel("t varchar", [("a\\b",), ("a%b",), ("ab",)])
    assert rows(op("Filter", r, rules=[rule("t", "contains", "\\")])) == [("a\\b",)]


def test_select(people):
    out = op("SelectColumns", people, columns=["NAME", "id"])
    assert out.names == ["name", "id"]
    with pytest.raises(ValueError, match="invalid columns selected: x, y"):
        op("SelectColumns", people, columns=["x", "id", "y"])
    with pytest.raises(ValueError, match="duplicate"):
        op("SelectColumns", people, columns=["id", "ID"])


def test_constant(people):
    out = op("ConstantColumn", people, column={"name": "c", "sql_type": "INTEGER"}, value=2.5)
    assert {r[0] for r in rows(out, "c")} == {2}
    assert {r[0] for r in rows(op("ConstantColumn", people, column={"name": "c", "sql_type": "DATE"}, value=None), "c")} == {None}
    with pytest.raises(ValueError, match="exists"):
        op("ConstantColumn", people, column={"name": "ID", "sql_type": "INTEGER"}, value=1)


def test_compute(rel):
    r = rel("id integer, first_name varchar, last_name varchar, col integer, d double", [(1, "John", "Doe", 3, 1e16), (2, "Mary", None, 5, 0.1)])
    out = op("ComputeColumn", r, columns=[{"name": "full", "sql_type": "varchar", "expr": "{{first_name}} {{ Last_Name }}!"}, {"name": "twice", "sql_type": "integer", "expr": "col * 2"}, {"name": "told", "sql_type": "varchar", "expr": "<{{d}}>"}, {"name": "same", "sql_type": "integer", "expr": "{{col}}"}])
    assert rows(out, "full", "twice", "told", "same") == [("John Doe!", 6, "<1e+16>", 3), ("Mary !", 10, "<0.1>", 5)]
    for bad in ("{{nope}}", "{{ }}", "nope + 1", "a1 + 1", "select 1", "1; 2"):
        with pytest.raises(ValueError):
            op("ComputeColumn", r, columns=[{"name": "a1", "sql_type": "integer", "expr": "1"}, {"name": "b1", "sql_type": "integer", "expr": bad}])


def test_rename(people):
    assert op("RenameColumns", people, renames=[{"from": "id", "to": "name"}, {"from": "NAME", "to": "id"}]).names == ["name", "id"]
    for bad in ([{"from": "id", "to": "ID"}], [{"from": "id", "to": "name"}], [{"from": "id", "to": "a"}, {"from": "id", "to": "b"}], [{"from": "id", "to": "a"}, {"from": "name", "to": "A"}], [{"from": "q", "to": "a"}]):
        with pytest.raises(ValueError):
            op("RenameColumns", people, renames=bad)


@pytest.mark.parametrize(
    ("kind", "value", "to", "out"),
    [
        ("double", 2.5, "INTEGER", 2), ("double", 3.5, "BIGINT", 4), ("double", -2.5, "INTEGER", -2), ("varchar", "2.5", "INTEGER", 3), ("varchar", "-2.5", "INTEGER", -3), ("varchar", " 5 ", "INTEGER", 5), ("varchar", "1e3", "INTEGER", 1000),
        ("integer", 7, "VARCHAR", "7"), ("double", 123456789.0, "VARCHAR", "123456789.0"), ("double", 1e-5, "VARCHAR", "1e-05"), ("float", 0.1, "VARCHAR", "0.1"), ("varchar", "[1, 2,NULL]", "INTEGER[]", [1, 2, None]), ("varchar", "[]", "INTEGER[]", []),
        ("varchar", "['a', b, \"c d\"]", "VARCHAR[]", ["a", "b", "c d"]), ("varchar", None, "INTEGER[]", None), ("varchar", "true", "BOOLEAN", True),
    ],
)
def test_cast(rel, kind, value, to, out):
    assert rows(op("CastColumns", rel(f"v {kind}", [(value,)]), casts=[{"column": "v", "sql_type": to}])) == [(out,)]


def test_cast_decimal_rounds_half_up(rel):
    half = op("CastColumns", rel("v double", [(2.5,), (-2.5,)]), casts=[{"column": "v", "sql_type": "DECIMAL(5,1)"}])
    assert rows(op("CastColumns", half, casts=[{"column": "v", "sql_type": "INTEGER"}])) == [(3,), (-3,)]


@pytest.mark.parametrize(("kind", "value", "to"), [("varchar", "abc", "INTEGER"), ("varchar", "", "INTEGER"), ("varchar", "99999999999", "INTEGER"), ("double", 1e12, "INTEGER"), ("varchar", "1,2", "INTEGER[]")])
def test_cast_fails(rel, kind, value, to):
    with pytest.raises(Exception):  # noqa: B017  of the engine
        rows(op("CastColumns", rel(f"v {kind}", [(value,)]), casts=[{"column": "v", "sql_type": to}]))


def test_cast_errors(people):
    for bad in ([{"column": "id", "sql_type": "INTEGER"}], [{"column": "id", "sql_type": "BIGINT"}, {"column": "ID", "sql_type": "VARCHAR"}], [{"column": "q", "sql_type": "BIGINT"}], []):
        with pytest.raises(ValueError):
            op("CastColumns", people, casts=bad)
    # INT and INTEGER are different texts.
    assert op("CastColumns", people, casts=[{"column": "id", "sql_type": "INT"}]).columns[0].sql_type == "INT"


def test_fill_replace(rel):
    r = rel("id integer, name varchar, status varchar", [(1, None, "N/A"), (2, "John", "ok"), (3, None, None)])
    out = op("FillReplace", r, rules=[{"column": "name", "fill_null_with": "unknown"}, {"column": "status", "replace_from": "N/A", "replace_to": "", "fill_null_with": "unknown"}])
    assert rows(out, "name", "status") == [("unknown", ""), ("John", "ok"), ("unknown", "unknown")]
    for bad in ([{"column": "name"}], [{"column": "name", "replace_from": "a"}], [{"column": "name", "replace_from": "a", "replace_to": None}], [{"column": "name", "fill_null_with": "a"}, {"column": "NAME", "fill_null_with": "b"}]):
        with pytest.raises(ValueError):
            op("FillReplace", r, rules=bad)


def test_sort(rel):
    r = rel("id integer, name varchar", [(3, "Bob"), (1, "Alice"), (2, "Alice"), (4, None)])
    assert [x[0] for x in rows(op("Sort", r, keys=[{"column": "name"}, {"column": "id", "direction": "desc"}]))] == [2, 1, 3, 4]
    assert [x[0] for x in rows(op("Sort", r, keys=[{"column": "name", "direction": "desc"}, {"column": "id"}]))] == [3, 1, 2, 4]
    assert [x[0] for x in rows(op("Sort", r, keys=[{"column": "name", "direction": "desc", "nulls": "first"}, {"column": "id"}]))] == [4, 3, 1, 2]
    with pytest.raises(ValueError):
        op("Sort", r, keys=[{"column": "id"}, {"column": "ID"}])


def test_limit(rel):
    r = op("Sort", rel("id integer", [(3,), (1,), (2,), (4,)]), keys=[{"column": "id"}])
    assert rows(op("Limit", r, count=2, offset=1)) == [(2,), (3,)]
    assert rows(op("LimitSample", r, count=9)) == [(1,), (2,), (3,), (4,)]
    for bad in ({"count": 0}, {"count": 1, "offset": -1}):
        with pytest.raises(ValueError):
            op("Limit", r, **bad)


def test_deduplicate(rel):
    r = rel("id integer, email varchar, name varchar", [(1, "a", "A1"), (3, "a", "A3"), (2, "b", "B2"), (4, "b", "B4"), (5, None, None), (6, None, "x")])
    by = [{"column": "id", "direction": "asc"}]
    assert sorted(x[0] for x in rows(op("Deduplicate", r, columns=["email"], order_by=by))) == [1, 2, 5]
    assert sorted(x[0] for x in rows(op("Deduplicate", r, columns=["EMAIL"], keep="last", order_by=by))) == [3, 4, 6]
    nulls = [{"column": "name", "nulls": "first"}]
    assert sorted(x[0] for x in rows(op("Deduplicate", r, columns=["email"], order_by=nulls))) == [1, 2, 5]
    assert sorted(x[0] for x in rows(op("Deduplicate", r, columns=["email"], keep="last", order_by=nulls))) == [3, 4, 6]
    with pytest.raises(ValueError):
        op("Deduplicate", r, columns=["email"], order_by=[])


def test_aggregate(rel):
    r = rel("region varchar, amount double", [("north", 10.0), ("north", 20.0), ("south", 5.0), (None, None)])
    metrics = [{"function": f, "column": "amount", "as": f[0] + "_" + f} for f in ("count", "sum", "avg", "min", "max")]
    out = op("Aggregate", r, group_by=["REGION"], metrics=[*metrics, {"function": "count", "column": "*", "as": "n"}])
    assert sorted(rows(out), key=str) == sorted([("north", 2, 30.0, 15.0, 10.0, 20.0, 2), ("south", 1, 5.0, 5.0, 5.0, 5.0, 1), (None, 0, None, None, None, None, 1)], key=str)
    assert [c.sql_type for c in out.columns] == ["varchar", "bigint", "double", "double", "double", "double", "bigint"]
    assert rows(op("Aggregate", rel("v integer", []), group_by=[], metrics=[{"function": "sum", "column": "v", "as": "s"}, {"function": "count", "column": "", "as": "n"}])) == [(None, 0)]
    for bad in ([{"function": "sum", "column": "region", "as": "s"}], [{"function": "median", "column": "amount", "as": "s"}], [{"function": "sum", "column": "amount", "as": "region"}], []):
        with pytest.raises(ValueError):
            op("Aggregate", r, group_by=["region"], metrics=bad)


def test_sum_overflows(rel):
    with pytest.raises(Exception):  # noqa: B017  of the engine
        rows(op("Aggregate", rel("v integer", [(2_000_000_000,), (2_000_000_000,)]), metrics=[{"function": "sum", "column": "v", "as": "s"}]))


def test_union(rel):
    a, b = rel("id integer, name varchar", [(1, "John"), (2, "Doe")]), rel("id integer, name varchar", [(2, "Doe"), (3, "Mary")])
    assert rows(op("MergeUnion", [a, b], mode="strict_positional")) == [(1, "John"), (2, "Doe"), (2, "Doe"), (3, "Mary")]
    c = rel("NAME varchar, id integer", [("Bob", 2)])
    assert rows(op("MergeUnion", [a, c], mode="align_by_name"))[-1] == (2, "Bob")
    for bad, mode in (([a, c], "strict_positional"), ([a], "strict_positional"), ([a, rel("id integer", [])], "align_by_name"), ([a, rel("id int, name varchar", [])], "strict_positional"), ([a, rel("id integer, other varchar", [])], "align_by_name")):
        with pytest.raises(ValueError):
            op("MergeUnion", bad, mode=mode)


def test_join(rel):
    orders, customers = rel("id integer, customer_id integer", [(1, 10), (2, 20), (3, 30), (4, None)]), rel("customer_id integer, name varchar", [(10, "Alice"), (20, "Bob"), (None, "x")])
    k = [{"left": "customer_id", "right": "CUSTOMER_ID"}]
    out = op("Join", [orders, customers], mode="inner", keys=k)
    assert out.names == ["id", "customer_id", "customer_id_right", "name"]
    assert sorted(rows(out)) == [(1, 10, 10, "Alice"), (2, 20, 20, "Bob")]
    assert sorted(rows(op("Join", [orders, customers], mode="left", keys=k), "id", "name"), key=str) == [(1, "Alice"), (2, "Bob"), (3, None), (4, None)]
    again = op("Join", [out, customers], mode="left", keys=k)
    assert again.names == ["id", "customer_id", "customer_id_right", "name", "customer_id_right_2", "name_right"]
    chosen = op("Join", [orders, customers], mode="inner", keys=k, select=[{"side": "right", "column": "name", "as": "who"}])
    assert sorted(rows(chosen)) == [("Alice",), ("Bob",)]
    for bad in ({"mode": "full", "keys": k}, {"mode": "inner", "keys": []}, {"mode": "inner", "keys": k + k}, {"mode": "inner", "keys": [{"left": "q", "right": "name"}]}):
        with pytest.raises(ValueError):
            op("Join", [orders, customers], **bad)


def test_conditional_and_switch(rel):
    r = rel("id integer, name varchar", [(1, "John"), (2, "John"), (3, "Doe"), (4, "Jane"), (5, None)])
    out = op("Conditional", r, mode="all", rules=[rule("id", "gt", 1), rule("name", "eq", "John")])
    assert [x[0] for x in rows(out["if"])] == [2] and [x[0] for x in rows(out["else"])] == [1, 3, 4]
    out = op("Conditional", r, rules=[])
    assert len(rows(out["if"])) == 5 and rows(out["else"]) == []
    out = op("Switch", r, branches=[{"label": " Late ", "rules": [rule("id", "gt", 1)]}, {"label": "john", "rules": [rule("name", "eq", "John")]}])
    assert [x[0] for x in rows(out["late"])] == [2, 3, 4, 5] and [x[0] for x in rows(out["john"])] == [1, 2] and rows(out["default"]) == []
    out = op("Switch", r, branches=[{"label": "a", "mode": "any", "rules": [rule("name", "eq", "John"), rule("name", "eq", "Doe")]}])
    assert [x[0] for x in rows(out["default"])] == [4]
    out = op("Switch", r, branches=[{"label": "all"}])
    assert len(rows(out["all"])) == 5 and rows(out["default"]) == []
    for bad in ([], [{"label": "default"}], [{"label": "a"}, {"label": "A "}]):
        with pytest.raises(ValueError):
            op("Switch", r, branches=bad)


def test_unnest(rel):
    r = rel("id integer, tags integer[]", [(1, [10, 20]), (2, []), (3, None), (4, [30, None])])
    assert rows(op("UnnestArray", r, array_column="tags", output_column={"name": "tag", "sql_type": "varchar"}), "id", "tag") == [(1, "10"), (1, "20"), (4, "30"), (4, None)]
    with pytest.raises(ValueError):
        op("UnnestArray", r, array_column="id", output_column={"name": "tag", "sql_type": "integer"})


def test_pivot(rel):
    r = rel("id integer, region varchar, amount integer", [(1, "north", 10), (1, "north", 5), (1, "south", 7), (2, "south", 3), (3, "west", 1)])
    common = {"group_by": ["id"], "pivot_column": "region", "value_column": "amount", "in_values": ["north", "south"]}
    assert sorted(rows(op("Pivot", r, **common))) == [(1, 15, 7), (2, None, 3), (3, None, None)]
    assert sorted(rows(op("Pivot", r, **common, agg_fn="count"))) == [(1, 2, 1), (2, 0, 1), (3, 0, 0)]
    extra = rel("id integer, k integer, region varchar, amount integer", [(1, 1, "north", 10), (1, 2, "north", 5)])
    assert sorted(rows(op("Pivot", extra, **common), "north")) == [(5,), (10,)]
    assert rows(op("Pivot", extra, **common, pivot_grouping="declared"), "north") == [(15,)]
    with pytest.raises(ValueError):
        op("Pivot", r, **(common | {"in_values": ["a", "A"]}))


def test_unpivot(rel):
    r = rel("id integer, north integer, south integer, other varchar", [(1, 10, 20, "a"), (2, None, 40, "b")])
    config = {"passthrough": ["id"], "name_column": {"name": "region", "sql_type": "varchar"}, "value_column": {"name": "amount", "sql_type": "bigint"}, "in_columns": ["north", "south"]}
    assert rows(op("Unpivot", r, **config)) == [(1, "north", 10), (1, "south", 20), (2, "south", 40)]
    for bad in ({"passthrough": ["north"]}, {"in_columns": []}, {"name_column": {"name": "id", "sql_type": "varchar"}}):
        with pytest.raises(ValueError):
            op("Unpivot", r, **(config | bad))


def test_change_schema(people):
    out = change_schema(people, [{"op": "add_column", "name": "x", "sql_type": "INTEGER", "value": 1}, {"op": "rename_column", "name": "name", "to": "who"}, {"op": "change_type", "name": "id", "sql_type": "VARCHAR"}, {"op": "drop_column", "name": "x"}])
    assert out.names == ["id", "who"] and rows(out)[0] == ("1", "John")
    with pytest.raises(ValueError):
        change_schema(people, [{"op": "drop_column", "name": "ID"}])


def test_empty_table_through_all(rel):
    r = rel("id integer, name varchar, tags integer[]", [])
    assert rows(op("Filter", r, rules=[rule("id", "gt", 1)])) == []
    assert rows(op("Deduplicate", r, columns=["id"], order_by=[{"column": "name"}])) == []
