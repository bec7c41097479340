"""Document fingerprints by one-permutation MinHash.

A document's word shingles are hashed once; the top bits of a hash choose a bin
and each bin keeps its smallest hash. An empty bin copies the bin that a fixed
sequence of trials, of its own for each bin, meets first among those with a value
(optimal densification). Of each bin the lowest bits are kept and packed; the
likeness of two fingerprints is their share of equal bins, corrected for the
share that so few bits have equal by chance.
"""

from __future__ import annotations

import base64
import hashlib
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, shingles

BINS, BITS, WORDS, TRIALS = 256, 4, 5, 64


@cache
def _donors(block: int) -> np.ndarray:
    """The bins that each bin tries, TRIALS rows at a time."""
    at = np.arange(block * TRIALS, (block + 1) * TRIALS, dtype=np.uint64)[:, None] * np.uint64(BINS) + np.arange(BINS, dtype=np.uint64)[None, :]
    return (shingles.mix(at + np.uint64(1) << np.uint64(20)) % np.uint64(BINS)).astype(np.int64)


def bins(hashes: np.ndarray) -> np.ndarray | None:
    """The lowest bits of every bin's smallest hash, empty bins filled; None without hashes."""
    if not len(hashes):
        return None
    shift = np.uint64(64 - BINS.bit_length() + 1)
    order = np.sort(hashes)
    first = np.searchsorted(order, np.arange(BINS, dtype=np.uint64) << shift)
    full = np.empty(BINS, bool)
    full[:-1] = first[:-1] < first[1:]
    full[-1] = first[-1] < len(order)
    low = np.zeros(BINS, np.uint8)
    low[full] = (order[first[full]] & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    empty = np.flatnonzero(~full)
    block = 0
    while len(empty):
        donors = _donors(block)[:, empty]
        hit = full[donors]
        row = hit.argmax(0)
        met = hit[row, np.arange(len(empty))]
        low[empty[met]] = low[donors[row[met], np.flatnonzero(met)]]
        empty, block = empty[~met], block + 1
    return low


def fingerprint(text: str | None) -> str:
    """Base64 of the packed bins; the empty string for a text without words."""
    low = bins(shingles.hashes(text or "", WORDS))
    return "" if low is None else base64.b64encode((low[0::2] | low[1::2] << 4).tobytes()).decode()


def likeness(a: str, b: str) -> float:
    """0 to 1, an estimate of the Jaccard similarity of the shingle sets; two empty fingerprints are alike, one is like no other."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    x = np.frombuffer(base64.b64decode(a), np.uint8) ^ np.frombuffer(base64.b64decode(b), np.uint8)
    same = (np.count_nonzero(x & 15 == 0) + np.count_nonzero(x >> 4 == 0)) / BINS
    chance = 1 / (1 << BITS)
    return float(min(1.0, max(0.0, (same - chance) / (1 - chance))))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of each row of documents (doc_id, text). Null texts are empty."""

    def run(it):
        for b in it:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t.as_py()) for t in b.column(1)], pa.string())], names=["doc_id", "fingerprint"])

    return common.lean(docs).select("doc_id", common.text_column(docs).alias("text")).mapInArrow(common.frugal(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def neighbours(docs: DataFrame, visit, schema: str, parts: int | None = None) -> DataFrame:
    """Applies visit(doc_id, text, next text) to each document and the next in ascending doc_id; after the last comes the first.

    Texts move once: ranges of doc_id are cut at approximate quantiles, and the
    first document of each range also goes to the range before. Null doc_ids come
    first, and equal ones in the order of their texts. visit is a generator
    function factory: visit() returns a function from those three to a row.
    """
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = common.lean(docs).select(F.col("doc_id").cast("long").alias("doc_id"), common.text_column(docs).alias("text"))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], 50 * parts)).first()[0]
    bounds = np.array(sorted(set(cuts or [])), np.int64)

    def ranges(ids: pd.Series) -> np.ndarray:
        known = ids.notna().to_numpy()
        return np.where(known, np.searchsorted(bounds, ids.fillna(0).astype("int64").to_numpy(), side="left"), 0)

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        return pd.Series(ranges(ids))

    # One row per range comes to the driver.
    found = rows.select("doc_id").groupBy(range_of("doc_id").alias("part")).agg(F.min("doc_id").alias("low"), F.max(F.col("doc_id").isNull()).alias("null"))
    firsts = [(r.part, None if r.null else r.low) for r in found.collect()]
    firsts.sort()
    before = {doc: firsts[k - 1][0] for k, (_, doc) in enumerate(firsts)}  # of the very first: the last range

    @F.pandas_udf("array<int>")
    def targets(ids: pd.Series) -> pd.Series:
        out = []
        for part, doc in zip(ranges(ids).tolist(), ids.astype("object").where(ids.notna(), None), strict=True):
            key = None if doc is None else int(doc)
            out.append([part, -1 - before[key]] if key in before else [part])
        return pd.Series(out)

    dealt = rows.withColumn("to", F.explode(targets("doc_id")))
    dealt = dealt.select(F.when(F.col("to") < 0, -1 - F.col("to")).otherwise(F.col("to")).alias("part"), (F.col("to") < 0).alias("ahead"), "doc_id", "text")
    dealt = dealt.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "ahead", "doc_id", "text")  # a range to each task

    def run(it):
        see = visit()
        held = None
        for b in it:
            out = []
            for part, ahead, doc, text in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if held and held[0] == part:
                    out.append(see(held[1], held[2], text))
                held = None if ahead else (part, doc, text)
            if out:
                yield from common.batches(iter(out), kinds)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kinds = to_arrow_schema(StructType.fromDDL(schema))
    return dealt.mapInArrow(common.frugal(run), schema)


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Each text beside its edited form, whose last half is replaced by the start of the next document."""
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def visit():
        last: tuple[str | None, str] = (None, "")

        def see(doc, text, following):
            nonlocal last
            own = last[1] if last[0] == text else fingerprint(text)
            last = (following, fingerprint(following))
            half = len(text) // 2
            edited = text[: len(text) - half] + following[:half]
            other = fingerprint(edited)
            return doc, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), own, other, likeness(own, other), likeness(own, last[1])

        return see

    return neighbours(docs, visit, schema)
