"""Demonstration scenarios over the synthetic people, for sources and for transformations."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from millrace.plans.runner import Run
from millrace.plans.spec import load
from millrace.telemetry import Telemetry

PEOPLE = [{"name": "id", "sql_type": "BIGINT"}, {"name": "name", "sql_type": "VARCHAR"}, {"name": "age", "sql_type": "BIGINT"}, {"name": "country", "sql_type": "VARCHAR"}]
WRONG = [{**c, "sql_type": "VARCHAR"} if c["name"] == "age" else c for c in PEOPLE]


@dataclass(frozen=True)
class Scenario:
    name: str
    source: dict
    nodes: list[dict] = field(default_factory=list)
    refs: tuple[str, ...] = ("people",)
    fails: bool = False


def _source(kind: str, mode: str, columns: list[dict] | None = None) -> dict:
    return {"format": kind, "mode": mode} | ({"columns": columns} if columns else {})


def _node(name: str, kind: str, inputs, **config) -> dict:
    return {"id": name, "type": kind, "inputs": inputs, "config": config}


def _rule(column: str, operation: str, value) -> dict:
    return {"column": column, "operation": operation, "value": value}


SOURCES = [
    Scenario("csv_infer", _source("csv", "infer")),
    Scenario("csv_declared", _source("csv", "declared", PEOPLE)),
    Scenario("csv_declared_with_check", _source("csv", "declared_with_check", PEOPLE)),
    Scenario("parquet_infer", _source("parquet", "infer")),
    Scenario("parquet_declared_with_check", _source("parquet", "declared_with_check", PEOPLE)),
    Scenario("csv_declared_with_check_mismatch", _source("csv", "declared_with_check", WRONG), fails=True),
]
_CSV = _source("csv", "infer")
TRANSFORMATIONS = [
    Scenario("filter", _CSV, [_node("f", "Filter", ["people"], rules=[_rule("country", "eq", "BR")])], ("f",)),
    Scenario("constant_column", _CSV, [_node("c", "ConstantColumn", ["people"], column={"name": "origin", "sql_type": "VARCHAR"}, value="demo")], ("c",)),
    Scenario("compute_column", _CSV, [_node("c", "ComputeColumn", ["people"], columns=[{"name": "label", "sql_type": "VARCHAR", "expr": "{{name}} ({{country}})"}, {"name": "twice", "sql_type": "BIGINT", "expr": "age * 2"}])], ("c",)),
    Scenario("merge_union", _CSV, [_node("a", "Filter", ["people"], rules=[_rule("age", "lt", 30)]), _node("b", "Filter", ["people"], rules=[_rule("age", "gt", 60)]), _node("u", "MergeUnion", ["a", "b"], mode="strict_positional")], ("u",)),
    Scenario("join", _CSV, [_node("s", "SelectColumns", ["people"], columns=["id", "country"]), _node("j", "Join", {"left": "people", "right": "s"}, mode="inner", keys=[{"left": "id", "right": "id"}])], ("j",)),
    Scenario("conditional", _CSV, [_node("c", "Conditional", ["people"], mode="all", rules=[_rule("age", "gt", 40)])], ("c:if", "c:else")),
    Scenario("switch", _CSV, [_node("s", "Switch", ["people"], branches=[{"label": "br", "rules": [_rule("country", "eq", "BR")]}, {"label": "old", "rules": [_rule("age", "gt", 60)]}])], ("s:br", "s:old", "s:default")),
    Scenario("chain", _CSV, [_node("a", "Filter", ["people"], rules=[_rule("age", "gt", 20)]), _node("b", "Aggregate", ["a"], group_by=["country"], metrics=[{"function": "count", "column": "*", "as": "n"}]), _node("c", "Sort", ["b"], keys=[{"column": "n", "direction": "desc"}, {"column": "country"}])], ("c",)),
]


def run(spark: SparkSession, scenarios: list[Scenario], folder: str, told: Telemetry, preview: int = 5) -> bool:
    """Runs scenarios over a folder's people files; true if each went as expected."""
    began, good = time.time(), 0
    told.event("run_start", scenarios=len(scenarios), folder=folder)
    for s in scenarios:
        start = time.time()
        told.event("scenario_start", scenario=s.name)
        document = {
            "pipeline_id": s.name,
            "version": 1,
            "nodes": [{"id": "people", "type": "DataSource", "config": s.source | {"path": f"{folder}/people.{s.source['format']}"}}, *s.nodes],
            "sinks": [{"node_id": r, "target_table": f"t{k}"} for k, r in enumerate(s.refs)],
        }
        told.debug("scenario_plan", scenario=s.name, nodes=[n["type"] for n in document["nodes"]])
        error, rows = "", {}
        try:
            state = Run(spark, load(document), persist=False).relations()
            for r in s.refs:
                rows[r] = state[r].df.count()
                told.debug("scenario_table", scenario=s.name, ref=r, rows=[tuple(x) for x in state[r].df.take(preview)])
        except Exception as e:
            error = str(e).splitlines()[0]
        ok = bool(error) == s.fails
        good += ok
        told.event("scenario_end", scenario=s.name, status="ok" if ok else "failed", expected_failure=s.fails, rows=rows, error=error, duration_ms=round(1000 * (time.time() - start)))
    told.event("run_end", passed=good, failed=len(scenarios) - good, duration_ms=round(1000 * (time.time() - began)))
    return good == len(scenarios)
