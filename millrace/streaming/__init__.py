"""Pipelines over streams: nodes that work row by row, and windowed counts with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from millrace.operators import OPERATORS
from millrace.plans.relation import Relation

#: Node types that a stream can go through.
ROW_WISE = ("Filter", "SelectColumns", "ConstantColumn", "ComputeColumn", "RenameColumns", "CastColumns", "FillReplace", "UnnestArray", "MergeUnion", "Conditional", "Switch")


def through(stream: DataFrame, steps: list[tuple[str, dict]]) -> DataFrame:
    """A stream through row-wise nodes (type, configuration) in turn."""
    relation = Relation.of(stream)
    for kind, config in steps:
        if kind not in ROW_WISE or kind in ("MergeUnion", "Conditional", "Switch"):
            raise ValueError(f"{kind} doesn't work on a single stream")
        relation = OPERATORS[kind]([relation], config)
    return relation.df


def windowed(stream: DataFrame, time: str, size: str, keys: list[str], metrics: dict[str, str], late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Metrics (alias: SQL aggregate) for each window and keys; rows later than the watermark are dropped."""
    window = F.window(time, size, slide) if slide else F.window(time, size)
    if isinstance(stream.schema[time].dataType, T.TimestampNTZType):  # watermarks need a time zone: the session's
        stream = stream.withColumn(time, F.col(time).cast(T.TimestampType()))
    out = stream.withWatermark(time, late).groupBy(window, *keys).agg(*(F.expr(e).alias(a) for a, e in metrics.items()))
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, *metrics)


def to_files(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends to Parquet files, each input row exactly once. once: ends with what is there."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
