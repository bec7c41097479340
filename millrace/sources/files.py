"""Reading CSV and Parquet: inferred, declared, and declared with a check."""

from __future__ import annotations

import csv
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import types
from millrace.functions.expressions import quoted
from millrace.operators.base import chosen, listed, operator, required
from millrace.plans.relation import Column, Relation
from millrace.session import spark_path

#: Candidate types in order, with a pattern of what each takes (fixed values). Whole numbers with leading zeros stay text.
CANDIDATES: list[tuple[T.DataType, str]] = [
    (T.BooleanType(), r"(?i)(t|f|true|false)"),
    (T.LongType(), r"[+-]?(0|[1-9]\d*)"),
    (T.DecimalType(38, 0), r"[+-]?(0|[1-9]\d{0,37})"),
    (T.DoubleType(), r"[+-]?((0|[1-9]\d*)(\.\d*)?|\.\d+)([eE][+-]?\d+)?|(?i)[+-]?(inf|infinity|nan)"),
    (T.DateType(), r"\d{4}-\d{1,2}-\d{1,2}"),
    (T.TimestampNTZType(), r"\d{4}-\d{1,2}-\d{1,2}[ T]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?"),
    (T.TimestampType(), r"\d{4}-\d{1,2}-\d{1,2}[ T]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?( ?(Z|UTC|[+-]\d{2}(:?\d{2})?))"),
]


def delimiter(spark: SparkSession, path: str) -> str:
    """The delimiter of the first lines; a comma where they don't tell."""
    head = [r.value for r in spark.read.text(spark_path(path)).limit(20).collect()]
    try:
        return csv.Sniffer().sniff("\n".join(head), ",;|\t").delimiter
    except csv.Error:
        return ","


def _header(spark: SparkSession, path: str, sep: str) -> list[str]:
    first = spark.read.text(spark_path(path)).limit(1).collect()
    return next(csv.reader([first[0].value.removeprefix("﻿")], delimiter=sep), []) if first else []


def _one_line_each(spark: SparkSession, path: str, sep: str) -> bool:
    """Whether every row of a file is one line, found over all lines: quotes only open and close whole values within a line."""
    mark, stop = "\x01", re.escape(sep)
    # Values in quotes, and the parts of one at doubled quotes, become marks, which only delimiters and line ends may touch.
    marked = F.regexp_replace("value", '"[^"]*"', mark)
    odd = F.rlike(marked, F.lit(f'"|[^{stop}{mark}]{mark}|{mark}[^{stop}{mark}]'))
    return spark.read.text(spark_path(path)).filter(F.contains("value", F.lit('"')) & odd).isEmpty()


def _line_end(spark: SparkSession, path: str) -> dict[str, str]:
    """Options for line ends: where all lines end in \\r\\n that is said, as values would lose the \\r otherwise."""
    lines = spark.read.option("lineSep", "\n").text(spark_path(path))
    return {"lineSep": "\r\n"} if lines.filter(~F.endswith("value", F.lit("\r"))).isEmpty() else {}


def _closed(spark: SparkSession, path: str, raw: DataFrame) -> bool:
    """Whether no file ends within quotes, which would make one value of the rest: a last value of many lines needs a quote at the file's end."""
    file, at = F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at")
    ends = spark.read.text(spark_path(path)).select(file, F.struct(F.col("_metadata.file_block_start"), at).alias("at"), F.rtrim("value").alias("v")).filter("v != ''").groupBy("file").agg(F.max_by("v", "at").alias("end"))
    last = raw.select(file, at, quoted(raw.columns[-1]).alias("v")).groupBy("file").agg(F.max_by("v", "at").alias("v"))
    return last.join(ends, "file").filter(F.rlike("v", F.lit("[\r\n]")) & ~F.endswith("end", F.lit('"'))).isEmpty()


def _names(found: list[str]) -> list[str]:
    """Names of a header; repeated ones get _1, _2 and so on."""
    seen: dict[str, int] = {}
    out = []
    for k, name in enumerate(found):
        name = name or f"column{k}"
        n = seen.get(name.lower(), 0)
        seen[name.lower()] = n + 1
        out.append(f"{name}_{n}" if n else name)
    return out


def infer_csv(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """A CSV file with types by one pass over all values: for each column the first candidate that every value fits, else text.

    Quoted values may hold line breaks; files without any are read in splits. Rows
    with more or fewer values than the first fail, and so do quotes left open over
    lines. In files of mixed line ends a quoted \\r\\n may become \\n.
    """
    sep = delimiter(spark, path)
    split = _one_line_each(spark, path, sep)
    reader = spark.read.option("sep", sep).option("quote", '"').option("escape", '"').option("multiLine", not split).option("mode", "FAILFAST").option("enforceSchema", True)
    if split:
        first = _header(spark, path, sep)
    else:
        reader = reader.options(**_line_end(spark, path))
        first = [(v or "").removeprefix("\ufeff") for v in reader.csv(spark_path(path)).first() or []]
    names = _names(first) if header else [f"column{k}" for k in range(len(first))]
    if not names:
        raise ValueError(f"{path} has no columns")
    reader = reader.option("header", header)
    texts = T.StructType([T.StructField(n, T.StringType()) for n in names])
    raw = reader.schema(texts).csv(spark_path(path))
    if not split and not _closed(spark, path, raw):
        raise ValueError(f"{path} ends within quotes")
    misfits = []
    for n in names:
        value = F.trim(quoted(n))
        for k, (kind, pattern) in enumerate(CANDIDATES):
            fits = F.rlike(value, F.lit(f"^(?:{pattern})$")) & value.try_cast(kind).isNotNull()
            misfits.append(F.count_if(value.isNotNull() & ~fits).alias(f"{names.index(n)}_{k}"))
        misfits.append(F.count(value).alias(f"{names.index(n)}_n"))
    counts = raw.agg(*misfits).first()
    schema = T.StructType()
    for i, n in enumerate(names):
        kind = next((kind for k, (kind, _) in enumerate(CANDIDATES) if counts[f"{i}_n"] and not counts[f"{i}_{k}"]), T.StringType())
        schema.add(n, kind)
    typed = reader.schema(texts).csv(spark_path(path))
    return typed.select(*(quoted(f.name) if isinstance(f.dataType, T.StringType) else F.trim(quoted(f.name)).cast(f.dataType).alias(f.name) for f in schema.fields))


def infer(spark: SparkSession, kind: str, path: str, header: bool | None = None) -> Relation:
    if kind == "csv":
        return Relation.of(infer_csv(spark, path, True if header is None else header))
    if header is not None:
        raise ValueError("options.header is only supported for csv format")
    return Relation.of(spark.read.parquet(spark_path(path)))


def check(declared: list[Column], found: tuple[Column, ...]) -> None:
    """Declared columns against inferred ones: count, order, names in any case, types in normal form."""
    if len(declared) != len(found):
        raise ValueError(f"column count mismatch: declared {len(declared)}, found {len(found)}")
    for k, (a, b) in enumerate(zip(declared, found, strict=True)):
        if a.name.strip().lower() != b.name.lower():
            raise ValueError(f"name mismatch at column {k}: declared {a.name!r}, found {b.name!r}")
        if types.normalize(a.sql_type) != types.normalize(b.sql_type):
            raise ValueError(f"type mismatch at column {a.name!r}: declared {a.sql_type}, found {b.sql_type}")


@operator("DataSource")
def read(spark: SparkSession, config: dict) -> Relation:
    """A file as a relation. Declared columns are looked up by name among the inferred ones and cast; they may be fewer and in another order."""
    kind = chosen(config.get("format"), ("csv", "parquet"), None, "format")
    mode = chosen(config.get("mode"), ("infer", "declared", "declared_with_check"), None, "mode")
    base = infer(spark, kind, required(config.get("path"), "path"), (config.get("options") or {}).get("header"))
    if mode == "infer":
        return base
    declared = [Column(required(c.get("name"), "column name"), required(c.get("sql_type"), "column sql_type")) for c in listed(config.get("columns"), "column")]
    if mode == "declared_with_check":
        check(declared, base.columns)
    return base.project([(c, quoted(base.resolve(c.name).name), base.kind(base.resolve(c.name).name)) for c in declared])


def literal_rows(spark: SparkSession, rows: list[dict], columns: list[Column] | None = None) -> Relation:
    """Rows given as objects; each must have every column. Columns are those of the first row unless declared."""
    if not rows:
        raise ValueError("at least one row is required")
    names = [c.name for c in columns] if columns else list(rows[0])
    for k, row in enumerate(rows):
        if missing := [n for n in names if n not in row]:
            raise ValueError(f"row {k} lacks {', '.join(missing)}")
    values = [tuple(r[n] for n in names) for r in rows]
    if columns is None:
        return Relation.of(spark.createDataFrame(values, names))
    return Relation(spark.createDataFrame(values, T.StructType([T.StructField(c.name, types.parse(c.sql_type)) for c in columns])), tuple(columns))


def table(spark: SparkSession, name: str, columns: list[str] | None = None) -> Relation:
    """A catalog table or view, or some of its columns."""
    if not re.fullmatch(r"[\w.`]+", name.strip()):
        raise ValueError(f"bad table name {name!r}")
    base = Relation.of(spark.table(name))
    return base if columns is None else base.project([x for c in columns for x in base.own(base.resolve(c).name)])
