"""Synthetic people: the data of the demonstration workloads."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sinks import to_file

#: What made-up people are called, and where they live.
FIRST = ["Ana", "Bruno", "Carla", "Diego", "Elena", "Felipe", "Gina", "Hugo", "Iris", "Joao"]
LAST = ["Silva", "Souza", "Costa", "Lima", "Rocha", "Alves", "Melo", "Dias", "Nunes", "Prado"]
COUNTRIES = ["BR", "US", "AR", "CL", "MX", "PT", "ES", "CO"]


def people(spark: SparkSession, rows: int, seed: int = 42) -> DataFrame:
    """id 1 to rows, name, age 18 to 70, country. A row depends on its id and the seed alone, so any number of tasks makes the same rows."""

    def pick(salt: int, n: int):
        return F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), F.col("id")), F.lit(n)).cast("int")

    def one(salt: int, values: list[str]):
        return F.array(*map(F.lit, values))[pick(salt, len(values))]

    return spark.range(1, rows + 1).select("id", F.concat(one(1, FIRST), F.lit(" "), one(2, LAST)).alias("name"), (18 + pick(3, 53)).cast("long").alias("age"), one(4, COUNTRIES).alias("country"))


def generate(spark: SparkSession, rows: int = 1000, seed: int = 42, folder: str = "data") -> list[str]:
    """Writes people.csv and people.parquet into a folder."""
    if rows <= 0:
        raise ValueError("rows must be greater than zero")
    os.makedirs(folder, exist_ok=True)
    df = people(spark, rows, seed)
    paths = [f"{folder}/people.csv", f"{folder}/people.parquet"]
    for path in paths:
        to_file(df, path, path.rsplit(".", 1)[1])
    return paths
