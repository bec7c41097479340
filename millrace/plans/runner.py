"""Runs pipelines: nodes become one lazy plan, sinks its actions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from millrace.operators import OPERATORS
from millrace.session import spark_path
from millrace.sources import files, sinks  # noqa: F401  registers DataSource

from . import graph
from .errors import WorkflowError
from .relation import Relation
from .spec import CONFIGS, MISSING, Node, Spec, SpecError, decode, sink_ref
from .validate import inputs_of


@dataclass(frozen=True)
class SinkResult:
    node_id: str
    target_table: str
    target_path: str
    format: str
    source_table: str
    rows: int


def table_name(pipeline: str, node: str, label: str = "") -> str:
    """wf_<pipeline>_<node>, with _<label> for a branch; other characters than letters and digits become _."""

    def clean(text: str) -> str:
        return re.sub(r"[^a-zA-Z0-9_]+", "_", text.strip()).lower()

    return f"wf_{clean(pipeline)}_{clean(node)}" + (f"_{clean(label)}" if label else "")


def _materialize(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


class Run:
    """One run. eager: every node is computed as it is reached, also those that no sink reads, so a failing value is told of its node."""

    def __init__(self, spark: SparkSession, spec: Spec, eager: bool = False, persist: bool = True, pivot_grouping: str = "all"):
        self.spark, self.spec, self.eager, self.persist, self.pivot = spark, spec, eager, persist, pivot_grouping
        self.state: dict[str, Relation] = {}
        self.tables: dict[str, str] = {}
        self.kept: list[DataFrame] = []

    def _order(self) -> tuple[list[Node], dict[str, list[str]]]:
        inputs: dict[str, list[str]] = {}
        try:
            for n in self.spec.nodes:
                found, issues = inputs_of(n) if n.type in CONFIGS else ([], [])
                shape = [i for i in issues if "must be an" in i.message]
                if shape:
                    raise ValueError(f"node {n.id!r}: {shape[0].message}")
                inputs[n.id] = found
            return graph.order(list(self.spec.nodes), inputs), inputs
        except ValueError as e:
            raise WorkflowError("GRAPH_ORDER_FAILED", "topological_order", str(e), cause=e) from e

    def _reserve(self, node: Node, config: dict) -> dict[str, str]:
        labels = ["if", "else"] if node.type == "Conditional" else [*(str((b or {}).get("label") or "").strip() for b in config.get("branches") or []), "default"] if node.type == "Switch" else [""]
        names = {}
        for label in labels:
            name = table_name(self.spec.pipeline_id, node.id, label)
            if name in self.tables.values() or name in names.values():
                raise WorkflowError("TABLE_NAME_COLLISION", "table_name", f"table {name} is already taken", node.id, node.type)
            names[f"{node.id.strip().lower()}:{label.lower()}" if label else node.id.strip().lower()] = name
        return names

    def _node(self, node: Node, inputs: list[str]) -> None:
        def fail(code: str, stage: str, e: BaseException | str):
            message = str(e).splitlines()[0] if str(e) else type(e).__name__
            raise WorkflowError(code, stage, message, node.id, node.type, e if isinstance(e, BaseException) else None) from (e if isinstance(e, BaseException) else None)

        if node.type not in OPERATORS:
            fail("UNSUPPORTED_NODE_TYPE", "dispatch", f"unsupported node type {node.type!r}")
        try:
            config = decode(None if node.config is MISSING else node.config, CONFIGS[node.type]) or {}
            broken: SpecError | None = None
        except SpecError as e:
            config, broken = {}, e
        self.tables |= self._reserve(node, node.config if isinstance(node.config, dict) else {})
        least, most = (0, 0) if node.type == "DataSource" else (2, None) if node.type == "MergeUnion" else (2, 2) if node.type == "Join" else (1, 1)
        if len(inputs) < least or most is not None and len(inputs) > most:
            fail("DEPENDENCY_SHAPE_FAILED", "dispatch", f"{node.type} can't take {len(inputs)} input(s)")
        relations = []
        for name in inputs:
            if name.strip().lower() not in self.state:
                fail("DEPENDENCY_RESOLUTION_FAILED", "resolve_input", f"output {name!r} isn't available")
            relations.append(self.state[name.strip().lower()])
        if broken:
            fail("CONFIG_DECODE_FAILED", "decode_config", broken)
        if node.type == "Pivot" and self.pivot == "declared":
            config = config | {"pivot_grouping": "declared"}
        try:
            out = OPERATORS[node.type](self.spark if node.type == "DataSource" else relations, config)
            made = out if isinstance(out, dict) else {"": out}
        except ValueError as e:
            fail("DERIVE_FAILED", "derive", e)
        except Exception as e:
            fail("MATERIALIZE_FAILED", "materialize", e)
        for label, relation in made.items():
            try:
                relation.df.schema  # noqa: B018  analysis
                if self.eager:
                    _materialize(relation.df)
            except Exception as e:
                fail("MATERIALIZE_FAILED", "materialize", e)
            self.state[f"{node.id.strip().lower()}:{label}" if label else node.id.strip().lower()] = relation

    def _share(self, node: Node, uses: dict[str, int]) -> None:
        """Keeps what several nodes or sinks read, if it is the result of a shuffle or of parsing text."""
        ref = node.id.strip().lower()
        costly = node.type in ("Aggregate", "Join", "Deduplicate", "Pivot", "Sort") or node.type == "DataSource" and isinstance(node.config, dict) and node.config.get("format") == "csv"
        if self.persist and costly and uses.get(ref, 0) > 1 and ref in self.state:
            r = self.state[ref]
            kept = r.df.persist(StorageLevel.MEMORY_AND_DISK)
            self.kept.append(kept)
            self.state[ref] = Relation(kept, r.columns)

    def relations(self) -> dict[str, Relation]:
        """The relation of every output, lazily."""
        nodes, inputs = self._order()
        uses: dict[str, int] = {}
        for ref in [i for found in inputs.values() for i in found] + [s.node_id for s in self.spec.sinks]:
            uses[ref.strip().lower()] = uses.get(ref.strip().lower(), 0) + 1
        for node in nodes:
            self._node(node, inputs[node.id])
            self._share(node, uses)
        return self.state

    def run(self) -> list[SinkResult]:
        targets: set[str] = set()
        for s in self.spec.sinks:
            if s.target_table.strip().lower() in targets:
                raise WorkflowError("DUPLICATE_SINK_TARGET", "validate_sinks", f"several sinks have the target table {s.target_table!r}")
            targets.add(s.target_table.strip().lower())
        views: list[str] = []
        copies: list[str] = []
        try:
            self.relations()
            results = [self._sink(s, views, copies) for s in self.spec.sinks]
        except BaseException:
            for v in views:
                self.spark.catalog.dropTempView(v)
            for path in copies:
                sinks.remove(self.spark, path)
            raise
        finally:
            # Views stay after the run; they read the copies.
            for df in self.kept:
                df.unpersist()
        return results

    def _sink(self, sink, views: list[str], copies: list[str]) -> SinkResult:
        node, label = sink_ref(sink.node_id)
        ref = f"{node.lower()}:{label}" if label else node.lower()
        if ref not in self.state:
            raise WorkflowError("SINK_RESOLUTION_FAILED", "resolve_sink", f"output {sink.node_id!r} isn't available", node)
        relation, name = self.state[ref], sink.target_table.strip()
        target = {k: (v or "").strip() for k, v in (sink.target or {}).items()}
        stage, path = "materialize_sink", ""
        try:
            if self.spark.catalog.tableExists("`" + name.replace("`", "``") + "`"):
                raise ValueError(f"table {name} exists already")
            if target.get("format") == "parquet":  # the file itself is the copy
                stage = "export_sink"
                n = sinks.to_file(relation.df, target["path"], "parquet")
                path = spark_path(target["path"])
            else:
                path, n = sinks.to_copy(relation.df, name)
                copies.append(path)
                if target:
                    stage = "export_sink"
                    sinks.to_file(relation.df, target["path"], target["format"])
            stage = "materialize_sink"
            sinks.to_view(sinks.copied(self.spark, relation.df.schema, path), name)
            views.append(name)
        except Exception as e:
            raise WorkflowError("SINK_MATERIALIZE_FAILED", stage, str(e).splitlines()[0], node, cause=e) from e
        return SinkResult(sink.node_id, name, target.get("path", ""), target.get("format", ""), self.tables[ref], n)


def run(spark: SparkSession, spec: Spec, **options) -> list[SinkResult]:
    """Runs a pipeline; its target tables are views of the session afterwards, over copies or the files written."""
    if spark is None or spec is None:
        raise WorkflowError("INVALID_ARGUMENT", "arguments", "a session and a pipeline are required")
    return Run(spark, spec, **options).run()


def output(spark: SparkSession, spec: Spec, ref: str, **options) -> DataFrame:
    """One output of a pipeline as a lazy DataFrame."""
    node, label = sink_ref(ref)
    return Run(spark, spec, persist=False, **options).relations()[f"{node.lower()}:{label}" if label else node.lower()].df
