"""The registry, its HTTP interface, the command line, workloads, streams, dialect and types."""

from __future__ import annotations

import io
import json
import threading
import urllib.error
import urllib.request

import pytest

from millrace import workloads
from millrace.api import server
from millrace.functions import dialect, types
from millrace.plans.errors import ValidationError
from millrace.registry import Conflict, NotFound, Registry
from millrace.session import s3_settings, spark_path
from millrace.telemetry import Telemetry

GOOD = {"pipeline_id": "p1", "version": 1, "nodes": [{"id": "s", "type": "DataSource", "config": {"format": "csv", "path": "x.csv", "mode": "infer"}}], "sinks": [{"node_id": "s", "target_table": "t"}]}


def test_pipeline_life(tmp_path):
    r = Registry(objects=str(tmp_path))
    made = r.create_pipeline({"pipeline_id": "p1"})
    assert made["status"] == "draft"
    with pytest.raises(Conflict):
        r.create_pipeline({"pipeline_id": "p1"})
    with pytest.raises(ValidationError):
        r.activate(made["id"])
    assert r.pipeline(made["id"])["status"] == "draft" and "SCHEMA_REQUIRED" in r.pipeline(made["id"])["validation_error"]
    r.update_pipeline(made["id"], GOOD)
    active = r.activate(made["id"])
    assert active["status"] == "active" and active["validation_error"] is None and active["activated_at"]
    assert r.update_pipeline(made["id"], name="new")["status"] == "draft"
    assert [p["id"] for p in r.pipelines(name="EW", status="draft")] == [made["id"]]
    r.delete_pipeline(made["id"])
    with pytest.raises(NotFound):
        r.pipeline(made["id"])
    for bad in ({"limit": 0}, {"limit": 101}, {"offset": -1}, {"status": "x"}):
        with pytest.raises(ValueError):
            r.pipelines(**bad)


def test_files(tmp_path):
    r = Registry(objects=str(tmp_path))
    made = r.upload_file(io.BytesIO(b"a\n1\n"), "x.csv", "csv", metadata={"k": 1})
    assert made["size_bytes"] == 4 and made["uri"] == "s3://inputs/x.csv" and made["metadata"] == {"k": 1}
    with pytest.raises(Conflict):
        r.register_file("x.csv", "csv")
    with pytest.raises(NotFound):
        r.register_file("nope.csv", "csv")
    for bad in ("../up.csv", ""):
        with pytest.raises(ValueError):
            r.register_file(bad, "csv")
    assert r.update_file(made["id"], name="n")["name"] == "n"
    r.delete_file(made["id"])
    assert (tmp_path / "inputs" / "x.csv").exists() and r.files() == []


@pytest.fixture
def http(tmp_path):
    s = server(Registry(objects=str(tmp_path)), port=0)
    threading.Thread(target=s.serve_forever, daemon=True).start()

    def call(method, path, body=None, raw=None, kind="application/json"):
        data = raw if raw is not None else None if body is None else json.dumps(body).encode()
        q = urllib.request.Request(f"http://127.0.0.1:{s.server_port}{path}", data, {"Content-Type": kind, "Origin": "http://localhost:3000"}, method=method)
        try:
            with urllib.request.urlopen(q) as r:
                got = r.read()
                return r.status, json.loads(got) if r.headers["Content-Type"] == "application/json" and got else got, r.headers
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read()), e.headers

    yield call
    s.shutdown()


def test_http(http):
    status, body, headers = http("GET", "/healthz")
    assert (status, body) == (200, {"status": "ok"}) and headers["X-Request-Id"] and headers["Access-Control-Allow-Origin"] == "http://localhost:3000"
    assert http("POST", "/pipelines", {"spec": GOOD})[0] == 201
    assert http("POST", "/pipelines", {"spec": GOOD})[0] == 409
    assert http("POST", "/pipelines/1/activate")[1]["status"] == "active"
    assert http("PATCH", "/pipelines/1", {"name": "x"})[1]["status"] == "draft"
    assert http("POST", "/pipelines/validate", GOOD)[1] == {"valid": True, "pipeline_id": "p1", "version": 1, "nodes": 1, "sinks": 1}
    status, body, _ = http("POST", "/pipelines/validate", {"pipeline_id": ""})
    assert status == 400 and not body["valid"] and body["issues"]
    assert http("GET", "/pipelines/0")[0] == 400 and http("GET", "/pipelines/99")[0] == 404 and http("GET", "/nope")[0] == 404
    assert http("POST", "/pipelines", raw=b"{")[0] == 400
    assert len(http("GET", "/pipelines?limit=5")[1]["items"]) == 1 and http("GET", "/pipelines?limit=x")[0] == 400
    form = b'--B\r\nContent-Disposition: form-data; name="file"; filename="y.csv"\r\n\r\na\n1\n\r\n--B\r\nContent-Disposition: form-data; name="format"\r\n\r\ncsv\r\n--B--\r\n'
    status, made, _ = http("POST", "/input-files/upload", raw=form, kind="multipart/form-data; boundary=B")
    assert status == 201 and made["format"] == "csv"
    url = http("GET", f"/input-files/{made['id']}/download")[1]["url"]
    assert http("GET", url)[1] == b"a\n1\n" and http("GET", url[:-2] + "zz")[0] == 404
    assert http("DELETE", f"/input-files/{made['id']}")[0] == 204 and http("DELETE", "/pipelines/1")[0] == 204
    assert "/pipelines/{id}/activate" in http("GET", "/swagger/doc.json")[1]["paths"]


def test_workloads(spark, tmp_path):
    from millrace.sources.people import generate

    generate(spark, 200, 42, str(tmp_path))
    out = io.StringIO()
    told = Telemetry("json", "debug", out)
    assert workloads.run(spark, workloads.SOURCES, str(tmp_path), told) and workloads.run(spark, workloads.TRANSFORMATIONS, str(tmp_path), told)
    events = [json.loads(x) for x in out.getvalue().splitlines()]
    assert {e["event"] for e in events} == {"run_start", "scenario_start", "scenario_plan", "scenario_table", "scenario_end", "run_end"}
    failed = [e for e in events if e["event"] == "scenario_end" and e["error"]]
    assert [e["scenario"] for e in failed] == ["csv_declared_with_check_mismatch"] and "type mismatch" in failed[0]["error"]


def test_people_are_stable(spark):
    from millrace.sources.people import people

    a, b = people(spark, 500, 1), people(spark, 500, 1).repartition(7)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect())) and {r.age for r in a.collect()} <= set(range(18, 71))


def test_command_line(tmp_path, capsys, spark):
    from millrace.__main__ import main

    (tmp_path / "people.csv").write_text("id\n1\n2\n")
    doc = GOOD | {"nodes": [{"id": "s", "type": "DataSource", "config": {"format": "csv", "path": str(tmp_path / "people.csv"), "mode": "infer"}}], "sinks": [{"node_id": "s", "target_table": "cli_out"}]}
    (tmp_path / "p.json").write_text(json.dumps(doc))
    assert main(["validate", "--file", str(tmp_path / "p.json")]) == 0 and main(["run", "--file", str(tmp_path / "p.json")]) == 0
    assert "SINK node_id=s target_table=cli_out rows=2" in capsys.readouterr().out
    (tmp_path / "bad.json").write_text("{")
    assert main(["validate", "--file", str(tmp_path / "bad.json")]) == 1 and main(["run", "--file", str(tmp_path / "none.json")]) == 1


def test_s3():
    assert s3_settings({}) == {} and spark_path("s3://b/k") == "s3a://b/k"
    got = s3_settings({"S3_ENDPOINT": "h:9000", "S3_ACCESS_KEY_ID": "a", "S3_SECRET_ACCESS_KEY": "b"})
    assert got["spark.hadoop.fs.s3a.endpoint"] == "h:9000" and got["spark.hadoop.fs.s3a.path.style.access"] == "true" and got["spark.hadoop.fs.s3a.connection.ssl.enabled"] == "false"
    with pytest.raises(ValueError):
        s3_settings({"S3_ENDPOINT": "h"})


@pytest.mark.parametrize(
    ("expression", "value"),
    [
        ("concat('a', NULL, 1)", "a1"), ("strpos('hello', 'l')", 3), ("7 // 2", 3), ("regexp_replace('a_b_', '_', 'X')", "aXb_"), ("regexp_replace('a_b_', '_', 'X', 'g')", "aXbX"), ("list_contains([1, 2], 2)", True), ("dayofweek(date'2024-01-07')", 0),
        ("strftime(timestamp'2024-01-02 03:04:05', '%Y/%m')", "2024/01"), ("datediff('day', date'2024-01-01', date'2024-01-03')", 2), ("log(100)", 2.0), ("string_split('a.b', '.')", ["a", "b"]), ("regexp_matches('abc', 'b.')", True), ("'it''s'", "it's"), ("week(date'2024-01-07')", 1), ("epoch(timestamp'1970-01-01 00:01:00')", 60),
    ],
)
def test_dialect(spark, expression, value):
    assert spark.sql(f"SELECT {dialect.to_spark(expression)} AS x").first().x == value


def test_types():
    assert types.normalize("double precision") == "DOUBLE" and types.normalize("timestamp with time zone") == "TIMESTAMPTZ" and types.normalize("Int_8") == "BIGINT"
    assert types.name_of(types.parse("INTEGER[]")) == "INTEGER[]" and types.name_of(types.parse("NUMERIC(10, 2)")) == "DECIMAL(10,2)"
    assert types.parse("DECIMAL").simpleString() == "decimal(18,3)"
    with pytest.raises(ValueError):
        types.parse("WHAT")


def test_streams(spark, tmp_path):
    from millrace import streaming

    spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id) AS ts, id % 3 AS k, id AS v FROM range(60)").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, k long, v long").parquet(str(tmp_path / "in"))
    kept = streaming.through(stream, [("Filter", {"rules": [{"column": "v", "operation": "gt", "value": 9}]}), ("ComputeColumn", {"columns": [{"name": "w", "sql_type": "BIGINT", "expr": "v * 2"}]})])
    streaming.to_files(kept, str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 50
    counts = streaming.windowed(stream, "ts", "30 minutes", ["k"], {"n": "count(*)", "total": "sum(v)"})
    counts.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start().awaitTermination(60)
    assert {tuple(r) for r in spark.sql("SELECT k, n FROM windows").collect()} == {(0, 10), (1, 10), (2, 10)}
    with pytest.raises(ValueError):
        streaming.through(stream, [("Sort", {})])
