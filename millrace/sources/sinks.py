"""Where results go: views, tables and files."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.expressions import quoted, to_text
from millrace.session import spark_path


#: Quotes within values are doubled, blanks around them stay, and empty texts differ from nulls.
CSV = {"header": True, "escape": '"', "emptyValue": '""', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def to_view(df: DataFrame, name: str) -> None:
    """A view that must not exist yet."""
    df.createTempView("`" + name.replace("`", "``") + "`")


def to_table(df: DataFrame, name: str) -> int:
    """A managed table that must not exist yet. Returns the number of rows."""
    return _counted(df, lambda d: d.write.mode("errorifexists").saveAsTable(name))


def _counted(df: DataFrame, write) -> int:
    seen = Observation(f"rows-{uuid.uuid4().hex}")
    write(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return int(seen.get["n"])


def _texts(df: DataFrame) -> DataFrame:
    """Columns whose CSV form differs between engines, as text."""
    kinds = (T.TimestampNTZType, T.TimestampType, T.DoubleType, T.FloatType)
    return df.select(*(to_text(quoted(f.name), f.dataType).alias(f.name) if isinstance(f.dataType, kinds) else quoted(f.name) for f in df.schema.fields))


def to_copy(df: DataFrame, name: str) -> tuple[str, int]:
    """A Parquet copy under the warehouse's folder, in which every value has been computed. Returns its path and the number of rows."""
    folder = df.sparkSession.conf.get("spark.sql.warehouse.dir").rstrip("/")
    path = f"{folder}/{re.sub(r'[^a-zA-Z0-9_]+', '_', name)}-{uuid.uuid4().hex}"
    return path, _counted(df, lambda d: d.write.parquet(path))


def copied(spark: SparkSession, schema: T.StructType, path: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def to_file(df: DataFrame, path: str, kind: str, single: bool | None = None) -> int:
    """Writes CSV with a header or Parquet, over what is there. Returns the number of rows.

    A path that ends in the format's extension becomes one file, written by one
    task after all others have computed their rows in parallel, in their order; any
    other (or single=False) a folder of files written in parallel, which is what
    large results need.
    """
    path = spark_path(path)
    single = path.lower().endswith(f".{kind}") if single is None else single
    spark, out = df.sparkSession, f"{path}.{uuid.uuid4().hex}.tmp" if single else path
    place = f"__at_{uuid.uuid4().hex}"

    def write(d: DataFrame) -> None:
        d = _texts(d) if kind == "csv" else d
        if single:
            d = d.withColumn(place, F.monotonically_increasing_id()).repartition(1).sortWithinPartitions(place).drop(place)
        w = d.write.mode("overwrite")
        w.options(**CSV).csv(out) if kind == "csv" else w.parquet(out)

    n = _counted(df, write)
    if single:
        _move_part(spark, out, path)
    return n


def remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _move_part(spark: SparkSession, folder: str, path: str) -> None:
    """Moves the one part file of a folder to a path, and deletes the folder. A file there is kept aside until the new one stands in its place; a folder that holds anything is refused."""
    jvm = spark.sparkContext._jvm
    source, target, aside = (jvm.org.apache.hadoop.fs.Path(x) for x in (folder, path, f"{folder}.old"))
    fs = source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        parts = [s.getPath() for s in fs.listStatus(source) if s.getPath().getName().startswith("part-")]
        old = fs.exists(target)
        if old and fs.getFileStatus(target).isDirectory() and len(fs.listStatus(target)):
            raise OSError(f"{path} is a folder that isn't empty")
        if old and not fs.rename(target, aside):
            raise OSError(f"can't replace {path}")
        if not fs.rename(parts[0], target):
            if old:
                fs.rename(aside, target)
            raise OSError(f"can't move to {path}")
        if old:
            fs.delete(aside, True)
    finally:
        fs.delete(source, True)
