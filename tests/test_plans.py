"""Validation, running, sources and sinks."""

from __future__ import annotations

import csv
import os

import pytest

from millrace.plans.errors import ValidationError, WorkflowError
from millrace.plans.runner import Run, run, table_name
from millrace.plans.spec import load, sink_ref
from millrace.plans.validate import parse_and_validate

CSV = {"format": "csv", "path": "x.csv", "mode": "infer"}


def node(name, kind, inputs, **config):
    return {"id": name, "type": kind, "inputs": inputs, "config": config}


def document(*nodes, sinks=None, path="x.csv", **more):
    source = {"id": "src", "type": "DataSource", "config": CSV | {"path": str(path)}}
    return {"pipeline_id": "p", "version": 1, "nodes": [source, *nodes], "sinks": sinks if sinks is not None else [{"node_id": (nodes[-1] if nodes else source)["id"], "target_table": "out"}]} | more


def issues(doc):
    with pytest.raises(ValidationError) as e:
        parse_and_validate(doc)
    return [(i.code, i.path) for i in e.value.issues]


def test_valid():
    spec = parse_and_validate(document(node("f", "Filter", ["src"], rules=[{"column": "a", "operation": "eq", "value": 1}])))
    assert spec.pipeline_id == "p" and len(spec.nodes) == 2


def test_invalid_json_and_shape():
    assert issues("{") == [("INVALID_JSON", "$")]
    assert issues({"pipeline_id": "p", "version": 1, "nodes": [], "sinks": [], "extra": 1}) == [("SCHEMA_INVALID", "$")]
    assert issues({"pipeline_id": " ", "version": 0, "nodes": [], "sinks": []}) == [("SCHEMA_REQUIRED", "$.pipeline_id"), ("SCHEMA_INVALID", "$.version"), ("SCHEMA_REQUIRED", "$.nodes")]
    assert ("SCHEMA_INVALID", "$.defaults.telemetry_format") in issues(document(defaults={"telemetry_format": "xml"}))


C = "$.nodes[1].config"


@pytest.mark.parametrize(
    ("kind", "config", "expected"),
    [
        ("Filter", {}, [("SCHEMA_REQUIRED", f"{C}.rules")]),
        ("Filter", {"mode": "some", "rules": [{"column": "", "operation": "like"}]}, [("SCHEMA_INVALID", f"{C}.mode"), ("SCHEMA_REQUIRED", f"{C}.rules[0].column"), ("SCHEMA_INVALID", f"{C}.rules[0].operation")]),
        ("Filter", {"what": 1}, [("SCHEMA_INVALID", C)]),
        ("SelectColumns", {"columns": ["a", " "]}, [("SCHEMA_REQUIRED", f"{C}.columns[1]")]),
        ("Sort", {"keys": [{"column": "", "direction": "up", "nulls": "x"}]}, [("SCHEMA_REQUIRED", f"{C}.keys[0].column"), ("SCHEMA_INVALID", f"{C}.keys[0].direction"), ("SCHEMA_INVALID", f"{C}.keys[0].nulls")]),
        ("Limit", {"count": 0, "offset": -1}, [("SCHEMA_INVALID", f"{C}.count"), ("SCHEMA_INVALID", f"{C}.offset")]),
        ("LimitSample", {"count": "x"}, [("SCHEMA_INVALID", C)]),
        ("ConstantColumn", {"value": 1}, [("SCHEMA_REQUIRED", f"{C}.column.name"), ("SCHEMA_REQUIRED", f"{C}.column.sql_type")]),
        ("ComputeColumn", {"columns": [{"name": "a", "sql_type": "", "expr": ""}]}, [("SCHEMA_REQUIRED", f"{C}.columns[0].sql_type"), ("SCHEMA_REQUIRED", f"{C}.columns[0].expr")]),
        ("RenameColumns", {"renames": [{}]}, [("SCHEMA_REQUIRED", f"{C}.renames[0].from"), ("SCHEMA_REQUIRED", f"{C}.renames[0].to")]),
        ("CastColumns", {"casts": []}, [("SCHEMA_REQUIRED", f"{C}.casts")]),
        ("FillReplace", {"rules": [{"column": ""}]}, [("SCHEMA_REQUIRED", f"{C}.rules[0].column")]),
        ("Deduplicate", {"keep": "all"}, [("SCHEMA_REQUIRED", f"{C}.columns"), ("SCHEMA_INVALID", f"{C}.keep"), ("SCHEMA_REQUIRED", f"{C}.order_by")]),
        ("Aggregate", {"metrics": [{"function": "median"}]}, [("SCHEMA_INVALID", f"{C}.metrics[0].function"), ("SCHEMA_REQUIRED", f"{C}.metrics[0].column"), ("SCHEMA_REQUIRED", f"{C}.metrics[0].as")]),
        ("UnnestArray", {}, [("SCHEMA_REQUIRED", f"{C}.array_column"), ("SCHEMA_REQUIRED", f"{C}.output_column.name"), ("SCHEMA_REQUIRED", f"{C}.output_column.sql_type")]),
        ("Pivot", {"agg_fn": "avg"}, [("SCHEMA_REQUIRED", f"{C}.group_by"), ("SCHEMA_REQUIRED", f"{C}.pivot_column"), ("SCHEMA_REQUIRED", f"{C}.value_column"), ("SCHEMA_INVALID", f"{C}.agg_fn"), ("SCHEMA_REQUIRED", f"{C}.in_values")]),
        ("Unpivot", {"in_columns": ["a"], "name_column": {"name": "n", "sql_type": "t"}}, [("SCHEMA_REQUIRED", f"{C}.value_column.name"), ("SCHEMA_REQUIRED", f"{C}.value_column.sql_type")]),
        ("Conditional", {"rules": [{"column": "a", "operation": "x"}]}, [("SCHEMA_INVALID", f"{C}.rules[0].operation")]),
        ("Switch", {"branches": [{"label": "Default"}, {"label": "a"}, {"label": " A", "mode": "x"}]}, [("SCHEMA_INVALID", f"{C}.branches[0].label"), ("SCHEMA_INVALID", f"{C}.branches[2].mode"), ("SCHEMA_INVALID", f"{C}.branches[2].label")]),
        ("Nope", {}, [("SCHEMA_INVALID", "$.nodes[1].type")]),
    ],
)
def test_configs(kind, config, expected):
    assert issues(document(node("n", kind, ["src"], **config))) == expected


def test_sources_and_inputs():
    bad = {"id": "s", "type": "DataSource", "inputs": [], "config": {"format": "parquet", "path": "", "mode": "declared", "options": {"header": True}, "columns": [{"name": "", "sql_type": ""}]}}
    assert issues({"pipeline_id": "p", "version": 1, "nodes": [bad], "sinks": [{"node_id": "s", "target_table": "t"}]}) == [("NODE_INPUTS_FORBIDDEN", "$.nodes[0].inputs"), ("SCHEMA_INVALID", "$.nodes[0].config.options.header"), ("SCHEMA_REQUIRED", "$.nodes[0].config.path"), ("SCHEMA_REQUIRED", "$.nodes[0].config.columns[0].name"), ("SCHEMA_REQUIRED", "$.nodes[0].config.columns[0].sql_type")]
    limit = {"count": 1}
    assert issues(document(node("a", "Limit", ["zz"], **limit))) == [("NODE_MISSING_DEPENDENCY", "$.nodes[1].inputs")]
    assert issues(document(node("a", "Limit", ["a"], **limit))) == [("NODE_SELF_DEPENDENCY", "$.nodes[1].inputs")]
    assert issues(document(node("a", "Limit", ["b"], **limit), node("b", "Limit", ["a"], **limit))) == [("GRAPH_CYCLE", "$.nodes")]
    assert issues(document(node("a", "MergeUnion", ["src", "src"], mode="align_by_name"))) == [("NODE_DUPLICATE_INPUT", "$.nodes[1].inputs[1]")]
    assert issues(document(node("a", "Join", ["src"], mode="inner", keys=[{"left": "a", "right": "b"}]))) == [("SCHEMA_INVALID", "$.nodes[1].inputs")]
    assert issues(document(node("a", "Join", {"left": "src", "right": "src"}, mode="inner", keys=[{"left": "a", "right": "b"}]))) == [("NODE_DUPLICATE_INPUT", "$.nodes[1].inputs")]
    assert issues(document(node("src", "Limit", ["src"], **limit)))[0] == ("NODE_DUPLICATE_ID", "$.nodes[1].id")
    assert issues({"pipeline_id": "p", "version": 1, "nodes": [{"id": "a", "type": "Limit", "inputs": ["a"]}], "sinks": [{"node_id": "a", "target_table": "t"}]}) == [("SCHEMA_REQUIRED", "$.nodes[0].config")]


def test_sinks():
    cond = node("c", "Conditional", ["src"])
    switch = node("s", "Switch", ["src"], branches=[{"label": "VIP"}])

    def with_sinks(*sinks):
        return document(cond, switch, sinks=[dict(zip(("node_id", "target_table", "target"), s, strict=False)) for s in sinks])

    assert parse_and_validate(with_sinks(("c:if", "a"), ("s:vip", "b"), ("s:default", "c")))
    assert issues(with_sinks(("c:maybe", "a"), ("s:x", "b"), ("src:if", "c"), ("zz", "d"), ("", "e"), ("a:b:c", "f"), ("c:", "g"))) == [("SINK_INVALID_LABEL", "$.sinks[0].node_id"), ("SINK_INVALID_LABEL", "$.sinks[1].node_id"), ("SINK_INVALID_LABEL", "$.sinks[2].node_id"), ("SINK_UNKNOWN_NODE", "$.sinks[3].node_id"), ("SCHEMA_REQUIRED", "$.sinks[4].node_id"), ("SCHEMA_INVALID", "$.sinks[5].node_id"), ("SCHEMA_INVALID", "$.sinks[6].node_id")]
    file = {"type": "file", "format": "csv", "path": "O.csv"}
    assert issues(with_sinks(("src", "a", file), ("src", "b", file | {"path": " o.csv "}), ("src", "", {"type": "db", "format": "x", "path": "", "mode": "append"}))) == [("SINK_DUPLICATE_TARGET_PATH", "$.sinks[1].target.path"), ("SCHEMA_REQUIRED", "$.sinks[2].target_table"), ("SCHEMA_INVALID", "$.sinks[2].target.type"), ("SCHEMA_REQUIRED", "$.sinks[2].target.path"), ("SCHEMA_INVALID", "$.sinks[2].target.format"), ("SCHEMA_INVALID", "$.sinks[2].target.mode")]
    assert sink_ref(" a : IF ") == ("a", "if")


@pytest.fixture
def people(tmp_path):
    path = tmp_path / "people.csv"
    path.write_text("id,name,age,country\n1,Ann,30,BR\n2,Bob,40,US\n3,Cid,50,BR\n")
    return path


@pytest.fixture
def ran(spark):
    def go(doc, **options):
        for v in spark.catalog.listTables():
            if v.isTemporary:
                spark.catalog.dropTempView(v.name)
        return {r.target_table: r for r in run(spark, parse_and_validate(doc), **options)}

    return go


def test_run_chain(ran, people, spark):
    doc = document(node("s", "Sort", ["src"], keys=[{"column": "age", "direction": "desc"}]), node("l", "Limit", ["s"], count=2), node("c", "ConstantColumn", ["l"], column={"name": "k", "sql_type": "VARCHAR"}, value="x"), path=people)
    out = ran(doc)
    assert out["out"].rows == 2 and out["out"].source_table == "wf_p_c"
    assert [tuple(r) for r in spark.table("out").collect()] == [(3, "Cid", 50, "BR", "x"), (2, "Bob", 40, "US", "x")]


def test_run_branches_and_files(ran, people, spark, tmp_path):
    cond = node("c", "Conditional", ["src"], rules=[{"column": "country", "operation": "eq", "value": "BR"}])
    target = {"type": "file", "format": "csv", "path": str(tmp_path / "br.csv")}
    parquet = {"type": "file", "format": "parquet", "path": str(tmp_path / "rest.parquet")}
    out = ran(document(cond, path=people, sinks=[{"node_id": "c:if", "target_table": "br", "target": target}, {"node_id": "c:ELSE", "target_table": "rest", "target": parquet}]))
    assert (out["br"].rows, out["rest"].rows) == (2, 1)
    assert list(csv.reader(open(target["path"]))) == [["id", "name", "age", "country"], ["1", "Ann", "30", "BR"], ["3", "Cid", "50", "BR"]]
    assert os.path.isfile(parquet["path"]) and spark.read.parquet(parquet["path"]).count() == 1


def test_diamond_shares(ran, people):
    a = node("a", "Filter", ["g"], rules=[{"column": "n", "operation": "gt", "value": 1}])
    b = node("b", "Filter", ["g"], rules=[{"column": "n", "operation": "lt", "value": 5}])
    g = node("g", "Aggregate", ["src"], group_by=["country"], metrics=[{"function": "count", "column": "*", "as": "n"}])
    assert ran(document(g, a, b, node("u", "MergeUnion", ["a", "b"], mode="strict_positional"), path=people))["out"].rows == 3


def fails(spark, doc, code, **options):
    with pytest.raises(WorkflowError) as e:
        run(spark, load(doc), **options)
    assert e.value.code == code, e.value
    return e.value


def test_run_errors(spark, people, ran):
    limit = node("l", "Limit", ["src"], count=1)
    fails(spark, document(limit, path=people, sinks=[{"node_id": "l", "target_table": "T"}, {"node_id": "src", "target_table": " t"}]), "DUPLICATE_SINK_TARGET")
    fails(spark, document(node("x", "Nope", ["src"]), path=people), "UNSUPPORTED_NODE_TYPE")
    fails(spark, document(node("A B", "Limit", ["src"], count=1), node("A_B", "Limit", ["src"], count=1), path=people), "TABLE_NAME_COLLISION")
    fails(spark, document(node("l", "Limit", ["zz"], count=1), path=people), "GRAPH_ORDER_FAILED")
    fails(spark, document(node("l", "Limit", ["src", "src"], count=1), path=people), "DEPENDENCY_SHAPE_FAILED")
    fails(spark, document(node("l", "Limit", ["src"], count="x"), path=people), "CONFIG_DECODE_FAILED")
    e = fails(spark, document(node("s", "SelectColumns", ["src"], columns=["zz"]), path=people), "DERIVE_FAILED")
    assert (e.stage, e.node_id, e.node_type) == ("derive", "s", "SelectColumns")
    fails(spark, document(limit, path="/nowhere/x.csv"), "MATERIALIZE_FAILED")
    cond = node("c", "Conditional", ["src"])
    fails(spark, document(cond, node("l", "Limit", ["c"], count=1), path=people), "DEPENDENCY_RESOLUTION_FAILED")
    fails(spark, document(cond, path=people, sinks=[{"node_id": "c", "target_table": "t"}]), "SINK_RESOLUTION_FAILED")
    ran(document(limit, path=people))
    fails(spark, document(limit, path=people), "SINK_MATERIALIZE_FAILED")
    spark.catalog.dropTempView("out")


def test_eager_fails_in_dead_branches(spark, people, ran):
    bad = node("bad", "CastColumns", ["src"], casts=[{"column": "name", "sql_type": "INTEGER"}])
    doc = document(bad, node("l", "Limit", ["src"], count=1), path=people)
    assert ran(doc)["out"].rows == 1
    spark.catalog.dropTempView("out")
    assert fails(spark, doc, "MATERIALIZE_FAILED", eager=True).node_id == "bad"


def test_table_name():
    assert table_name("My-Pipe", " A b!c", "X y") == "wf_my_pipe_a_b_c_x_y"


@pytest.mark.parametrize(
    ("text", "types"),
    [
        ("a\n1\n-2\n", ["BIGINT"]), ("a\n00123\n", ["VARCHAR"]), ("a\nt\nF\ntrue\n", ["BOOLEAN"]), ("a\n12:00:00\n", ["VARCHAR"]), ("a\n2024-01-02\n", ["DATE"]), ("a\n2024-01-02 03:04:05\n", ["TIMESTAMP"]), ("a\n2024-01-02T03:04:05Z\n", ["TIMESTAMPTZ"]),
        ("a\n9223372036854775808\n", ["DECIMAL(38,0)"]), ("a;b\n1;x\n2;y\n", ["BIGINT", "VARCHAR"]), ("a,b\n,x\n3,\n", ["BIGINT", "VARCHAR"]), ("a,b\nNULL,\n1,\n", ["VARCHAR", "VARCHAR"]), ("a\n1.5\n2\n", ["DOUBLE"]), ("a|b\n1|2\n3|4\n", ["BIGINT", "BIGINT"]),
    ],
)
def test_csv_types(spark, tmp_path, text, types):
    from millrace.sources.files import infer

    (tmp_path / "x.csv").write_text(text)
    assert [c.sql_type for c in infer(spark, "csv", str(tmp_path / "x.csv")).columns] == types


def test_csv_headers(spark, tmp_path):
    from millrace.sources.files import infer

    (tmp_path / "x.csv").write_text("a,a,b\n1,2,x\n")
    assert infer(spark, "csv", str(tmp_path / "x.csv")).names == ["a", "a_1", "b"]
    assert infer(spark, "csv", str(tmp_path / "x.csv"), header=False).names == ["column0", "column1", "column2"]


@pytest.mark.parametrize(
    ("text", "rows"),
    [
        ('id,t\n1,"one\ntwo"\n2,plain\n', [(1, "one\ntwo"), (2, "plain")]),
        ('id,t\n1,"a ""b"", c"\n2,""\n', [(1, 'a "b", c'), (2, None)]),
        ('id,t\n1,"x"",\n""y"\n2,"\n\n3,z"\n', [(1, 'x",\n"y'), (2, "\n\n3,z")]),
        ('id,t\n1,x"\n2,y\n', [(1, 'x"'), (2, "y")]),
        ('id;t\r\n1;"one\r\ntwo"\r\n', [(1, "one\r\ntwo")]),
    ],
)
def test_csv_line_breaks(spark, tmp_path, text, rows):
    from millrace.sources.files import infer

    (tmp_path / "x.csv").write_text(text, newline="")
    assert [tuple(r) for r in infer(spark, "csv", str(tmp_path / "x.csv")).df.collect()] == rows


def test_csv_line_break_in_header(spark, tmp_path):
    from millrace.sources.files import infer

    (tmp_path / "x.csv").write_text('"a\nb",c\n1,2\n')
    found = infer(spark, "csv", str(tmp_path / "x.csv"))
    assert found.names == ["a\nb", "c"] and [tuple(r) for r in found.df.collect()] == [(1, 2)]


@pytest.mark.parametrize("text", ["id,t\n2,plain\n3,x,extra\n", "id,t\n2,plain\n3\n", 'id,t\n1,"one\ntwo"\n3,x,extra\n'])
def test_csv_ragged_rows_fail(spark, tmp_path, text):
    from millrace.sources.files import infer

    (tmp_path / "x.csv").write_text(text)
    with pytest.raises(Exception, match="MALFORMED"):
        infer(spark, "csv", str(tmp_path / "x.csv"))


def test_csv_open_quote_fails(spark, tmp_path):
    from millrace.sources.files import infer

    (tmp_path / "x.csv").write_text('id,t\n1,"abc\n2,y\n3,z\n')
    with pytest.raises(ValueError, match="ends within quotes"):
        infer(spark, "csv", str(tmp_path / "x.csv"))


def test_declared(spark, people):
    from millrace.sources.files import read

    full = [{"name": "ID", "sql_type": "INT8"}, {"name": "name", "sql_type": "TEXT"}, {"name": "age", "sql_type": "BIGINT"}, {"name": "country", "sql_type": "VARCHAR"}]
    base = {"format": "csv", "path": str(people)}
    assert read(spark, base | {"mode": "declared_with_check", "columns": full}).df.count() == 3
    some = read(spark, base | {"mode": "declared", "columns": [{"name": "age", "sql_type": "DOUBLE"}, {"name": "id", "sql_type": "VARCHAR"}]})
    assert [tuple(r) for r in some.df.take(1)] == [(30.0, "1")]
    for columns, message in ((full[:2], "column count mismatch"), ([full[1], full[0], *full[2:]], "name mismatch"), ([full[0], full[1], {"name": "age", "sql_type": "VARCHAR"}, full[3]], "type mismatch")):
        with pytest.raises(ValueError, match=message):
            read(spark, base | {"mode": "declared_with_check", "columns": columns})
    with pytest.raises(ValueError):
        read(spark, {"format": "parquet", "path": "x", "mode": "infer", "options": {"header": True}})


def test_csv_sink_texts(spark, rel, tmp_path):
    from millrace.sources.sinks import to_file, to_table

    r = spark.sql("SELECT timestamp_ntz'2024-01-02 03:04:05' AS t, 1e16D AS d, '' AS e, CAST(NULL AS STRING) AS n, 'a,b' AS q")
    assert to_file(r, str(tmp_path / "o.csv"), "csv") == 1
    assert (tmp_path / "o.csv").read_text() == 't,d,e,n,q\n2024-01-02 03:04:05,1e+16,"",,"a,b"\n'
    assert to_file(r, str(tmp_path / "folder"), "parquet") == 1 and (tmp_path / "folder").is_dir()
    assert to_table(r, "kept_table") == 1
    with pytest.raises(Exception, match="already exists"):
        to_table(r, "kept_table")
    spark.sql("DROP TABLE kept_table")


def test_literal_rows_and_tables(spark):
    from millrace.plans.relation import Column
    from millrace.sources.files import literal_rows, table

    r = literal_rows(spark, [{"a": 1, "b": "x"}, {"b": "y", "a": 2}], [Column("a", "INTEGER"), Column("b", "VARCHAR")])
    r.df.createOrReplaceTempView("lit")
    assert [tuple(x) for x in table(spark, "lit", ["B"]).df.collect()] == [("x",), ("y",)]
    with pytest.raises(ValueError, match="lacks b"):
        literal_rows(spark, [{"a": 1, "b": 2}, {"a": 1}])


def test_lazy_plan_pushes_down(spark, tmp_path):
    spark.range(100).selectExpr("id", "id * 2 AS twice", "'x' AS unused").write.parquet(str(tmp_path / "t.parquet"))
    src = {"id": "src", "type": "DataSource", "config": {"format": "parquet", "path": str(tmp_path / "t.parquet"), "mode": "infer"}}
    doc = {"pipeline_id": "p", "version": 1, "nodes": [src, node("f", "Filter", ["src"], rules=[{"column": "id", "operation": "gt", "value": 5}]), node("a", "Aggregate", ["f"], group_by=[], metrics=[{"function": "sum", "column": "twice", "as": "s"}])], "sinks": [{"node_id": "a", "target_table": "t"}]}
    plan = Run(spark, load(doc)).relations()["a"].df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,5)" in plan and "unused" not in plan
