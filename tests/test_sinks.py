"""Sinks as copies and files, and the dialect's replacements, subscripts and windows against the engine that plans come from."""

from __future__ import annotations

import os

import pytest

from millrace.functions.dialect import to_spark
from millrace.plans.errors import WorkflowError
from millrace.plans.runner import run
from millrace.plans.spec import load
from millrace.sources import sinks

duckdb = pytest.importorskip("duckdb")


@pytest.fixture
def source(spark, tmp_path):
    spark.range(20).selectExpr("id", "CASE WHEN id = 7 THEN 'bad' ELSE CAST(id AS STRING) END AS t").repartition(3).write.parquet(str(tmp_path / "in"))
    return {"id": "s", "type": "DataSource", "config": {"format": "parquet", "path": str(tmp_path / "in"), "mode": "infer"}}


def document(nodes, sinks):
    return load({"pipeline_id": "p", "version": 1, "nodes": nodes, "sinks": sinks})


def test_failing_values_fail_table_sinks(spark, source):
    cast = {"id": "c", "type": "CastColumns", "inputs": ["s"], "config": {"casts": [{"column": "t", "sql_type": "INTEGER"}]}}
    with pytest.raises(WorkflowError) as e:
        run(spark, document([source, cast], [{"node_id": "s", "target_table": "whole"}, {"node_id": "c", "target_table": "cast"}]))
    assert e.value.code == "SINK_MATERIALIZE_FAILED" and e.value.node_id == "c"
    assert not spark.catalog.tableExists("whole") and not spark.catalog.tableExists("cast")


def test_tables_are_copies(spark, source, tmp_path):
    out = run(spark, document([source], [{"node_id": "s", "target_table": "copied"}]))
    spark.range(3).selectExpr("id", "'x' AS t").write.mode("overwrite").parquet(str(tmp_path / "in"))
    assert out[0].rows == spark.table("copied").count() == 20
    spark.catalog.dropTempView("copied")


@pytest.mark.parametrize("kind", ["csv", "parquet"])
def test_single_files_keep_order_and_replace(spark, tmp_path, kind):
    path = str(tmp_path / f"o.{kind}")
    df = spark.range(1000).repartition(8).orderBy("id")
    assert sinks.to_file(df, path, kind) == 1000 and sinks.to_file(df.filter("id < 500").orderBy("id"), path, kind) == 500
    rows = [int(x) for x in open(path).read().split()[1:]] if kind == "csv" else [r.id for r in spark.read.parquet(path).collect()]
    assert rows == list(range(500)) and [f for f in os.listdir(tmp_path) if not f.endswith(".crc")] == [f"o.{kind}"]


def test_folders_are_not_replaced_by_files(spark, tmp_path):
    path = tmp_path / "o.csv"
    path.mkdir()
    (path / "mine").write_text("x")
    with pytest.raises(OSError, match="folder"):
        sinks.to_file(spark.range(3), str(path), "csv")
    assert (path / "mine").read_text() == "x" and os.listdir(tmp_path) == ["o.csv"]


def test_texts_survive_csv(spark, tmp_path):
    from millrace.sources.files import infer_csv

    texts = ['say "hi"', '"', '""', "a\\", '\\"', " blanks ", "\t", "x\ny", 'q"\n"z', "a,b", "'", "", None, "#c", "é漢", '"a" | "b"\n', "end\\\n"]
    df = spark.createDataFrame([(k, t, "z") for k, t in enumerate(texts)], "id long, t string, z string")
    for path in ("one.csv", "many"):
        sinks.to_file(df.repartition(3), str(tmp_path / path), "csv")
        # Read back as the engine that plans come from does, an empty value is null, quoted or not.
        assert sorted(map(tuple, infer_csv(spark, str(tmp_path / path)).collect())) == [(k, t or None, "z") for k, t in enumerate(texts)]
        files = [tmp_path / path] if path == "one.csv" else list((tmp_path / path).glob("part-*"))
        rows = [r for f in files for r in duckdb.sql(f"SELECT * FROM read_csv('{f}', header = true, all_varchar = true, quote = '\"', escape = '\"')").fetchall()]
        assert sorted((int(k), t or "") for k, t, _ in rows) == [(k, t or "") for k, t in enumerate(texts)]


@pytest.mark.parametrize("expression", [
    r"regexp_replace(a, '(x)(y)', '\2\1')", r"regexp_replace(a, '(x)(y)', '<\0>', 'g')", r"regexp_replace(a, 'X', '$1', 'gi')", r"regexp_replace(a, '(.)', '\\\1')", "regexp_replace(a, '[0-9]', b)", r"regexp_replace(a, 'nope', 'z')", "regexp_replace(a, '', '-')",
    "string_split(a, '-')[1]", "string_split(a, '-')[-1]", "string_split(a, '-')[9]", "upper(string_split(a, '-')[n])", "list_value(n, 5, n * 2)[3]", "[n, 8][2]",
    "row_number() over (order by b, a)", "row_number() over (order by b desc, n)", "first_value(a) over (order by b nulls first, n rows between unbounded preceding and current row)", "sum(n) over (partition by b order by coalesce(n, 3), a)",
])
def test_expressions(spark, expression):
    rows = [("axy-1-xy", "p", 1), ("", None, 2), ("x$y", "q", 3), ("Xyx9", r"\1", 1), ("a\nxy", None, 3)]
    db = duckdb.connect()
    db.execute("CREATE TABLE t (a VARCHAR, b VARCHAR, n INTEGER)")
    db.executemany("INSERT INTO t VALUES (?, ?, ?)", rows)
    if expression.endswith(", b)"):  # groups beyond the pattern's are errors there
        rows = [r for r in rows if r[1] != r"\1"]
        db.execute(r"DELETE FROM t WHERE b = '\1'")
    want = sorted(db.execute(f"SELECT a, n, {expression} FROM t").fetchall(), key=repr)
    got = spark.createDataFrame(rows, "a string, b string, n int").selectExpr("a", "n", to_spark(expression)).collect()
    assert sorted(map(tuple, got), key=repr) == want
