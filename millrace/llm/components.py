"""Connected components of links between ids, in shuffles of bounded skew.

Links are turned into stars by alternating two steps until nothing changes: each
id hooks the larger of its neighbours to its smallest one, then each id hooks its
smaller neighbours and itself to the smallest. Every round is written to the
shared folder, so no round's lineage reaches back over the one before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _hooked(edges: DataFrame, keys: list[str], larger: bool) -> DataFrame:
    """One step. edges: keys, u, v with u > v. Minima are pre-aggregated and joined back, so a hub is split as a skewed join's side."""
    both = edges.unionByName(edges.select(*keys, F.col("v").alias("u"), F.col("u").alias("v"))) if larger else edges
    least = both.groupBy(*keys, "u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    met = both.join(least, [*keys, "u"])
    if larger:
        out = met.filter("v > u").select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.filter("v <> m").select(*keys, F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(*keys, "u", F.col("m").alias("v")))
    return out.filter("u > v").distinct()


def components(links: DataFrame, keys: list[str] | None = None, rounds: int = 50) -> DataFrame:
    """keys, id, component (the smallest id reachable) for every id that has a link; links: keys, u, v.

    Each value of the keys has a graph of its own. Loops and repeated links count
    once; nulls are left out. An id without links has no row.
    """
    keys = keys or []
    edges = common.staged(links.filter("u <> v").select(*keys, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    mark = F.sum(F.xxhash64(*keys, "u", "v").cast("decimal(38,0)"))
    before = None
    for _ in range(rounds):
        edges = common.staged(_hooked(_hooked(edges, keys, True), keys, False), "stars")
        now = tuple(edges.agg(F.count(F.lit(1)), mark).first())
        if now == before or not now[0]:
            break
        before = now
    else:
        raise RuntimeError(f"no end after {rounds} rounds")
    own = edges.select(*keys, F.col("u").alias("id"), F.col("v").alias("component"))
    return own.unionByName(edges.select(*keys, F.col("v").alias("id"), F.col("v").alias("component")).distinct())
