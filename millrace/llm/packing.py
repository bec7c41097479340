"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Documents are tokenised and cut once, in parallel, and staged. Pieces are then
packed in bulk-synchronous rounds over tables of runs: pieces of one length, known
by their ranks, and gaps of one room. In each round

* runs and gaps are range-sorted by size, and every range is swept for the runs'
  successors, the smallest gaps that hold them; what finds none carries over
  the boundaries of ranges;
* where several runs claim one gap, the longer piece and then the lower rank wins,
  and the rest take the next larger gap;
* the gaps that were filled shrink, all at once, after the round, and new
  sequences open for the longest pieces that no room is left for.

Runs number at most the capacity and hold any number of pieces, so the rounds cost
the same at every input size, and no key is hot: a length that a third of all
pieces share is one run. The rounds give placements (length, ranks, sequences,
offset), which one pass over the staged pieces applies.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common, tokens

PIECES = "doc_id long, piece int, start long, length long, ids binary, part int, local long"


def cut(ids: bytes, capacity: int) -> Iterator[tuple[int, bytes]]:
    """(start, ids) of the pieces of a document; only the first may be shorter than the capacity."""
    n = len(ids) // 4
    at = 0
    while at < n:
        end = at + ((n - at) % capacity or capacity)
        yield at, ids[4 * at : 4 * end]
        at = end


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """One row per piece, with its partition and its rank there among the pieces of its length."""

    def run(it):
        coder, end = tokens.encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        part, seen = TaskContext.get().partitionId(), defaultdict(int)

        def rows():
            for batch in it:
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    for k, (start, ids) in enumerate(cut(coder.ids(text.as_py()) + end, capacity)):
                        n = len(ids) // 4
                        yield doc, k, start, n, ids, part, seen[n]
                        seen[n] += 1

        kinds = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("part", pa.int32()), ("local", pa.int64())]
        yield from common.batches(rows(), pa.schema(kinds), size=lambda r: len(r[4]))

    return common.lean(docs).select(F.col("doc_id").cast("long"), common.text_column(docs).alias("text")).mapInArrow(common.frugal(run), PIECES)


#: Rows of a round: open sequences of a room, pieces of a length, gaps and placements of this round, placements of earlier ones, and the number of sequences.
GAP, PIECE, FRESH, NEW, PLACED, TOTAL = range(6)
#: size: room or length; first: a sequence, or a rank among pieces of the length; n: how many follow it. Of placements: `per` pieces in each of n sequences from `sequence` on, from `offset` on. Of gaps and pieces `per` is 1 in the band at work, else 0.
STATE = "kind int, size long, first long, n long, per long, sequence long, offset long"
Row = tuple[int, int, int, int, int, int, int]
#: The tables are small, so few ranges are enough; each has a task of its own.
RANGES, ROUNDS = 4, 8


def sweep(rows: Iterable[Row], capacity: int) -> Iterator[Row]:
    """Best fit of runs of pieces into gaps, both by size from the largest on, gaps before pieces of their size.

    A run's successor is the smallest gap met so far that has not been taken: where
    several runs have one successor, the longer pieces and then the lower ranks win
    it, and the rest go on to the next larger. A gap takes as many pieces of a run
    as it holds, which is what best fit does with equal pieces. Yields placements,
    what is left of the gaps taken (FRESH, out of reach until the next round), and
    all that found no partner.
    """
    open_: list[list[int]] = []
    for kind, size, first, n, *_ in rows:
        if kind == GAP:
            open_.append([size, first, n])
            continue
        while n and open_:
            gap = open_[-1]
            room, sequence, many = gap
            per = min(n, room // size)
            took = min(n // per, many)
            yield NEW, size, first, took, per, sequence, capacity - room
            yield FRESH, room - per * size, sequence, took, 0, 0, 0
            first, n = first + took * per, n - took * per
            gap[1], gap[2] = sequence + took, many - took
            if not gap[2]:
                open_.pop()
        if n:
            yield PIECE, size, first, n, 1, 0, 0
    yield from ((GAP, size, first, n, 1, 0, 0) for size, first, n in open_)


def opened(rows: list[Row], capacity: int) -> Iterator[Row]:
    """The end of a round, of rows in the sweep's order: new sequences for the longest pieces that no room is left for, then gaps and pieces as the next round meets them.

    Half the capacity holds one piece at most, so longer ones all open. Others open
    as many as their tokens need beyond the room left; where a round placed less
    than a quarter of what it left, sequences open for all of that.
    """
    left = [r for r in rows if r[0] == PIECE and r[4]]
    need = sum(r[1] * r[3] for r in left)
    put = sum(r[1] * r[3] * r[4] for r in rows if r[0] == NEW)
    least = min((r[1] for r in rows if r[4] and r[0] in (PIECE, NEW)), default=1)
    room = 0 if 4 * put <= need else sum(r[1] * r[3] for r in rows if r[0] == FRESH and r[1] >= least or r[0] == GAP and r[4])
    seeds = -(-(need - room) // capacity)
    sequences = max((r[2] for r in rows if r[0] == TOTAL), default=0)
    out: list[Row] = []
    for kind, size, first, n, per, *rest in rows:
        if kind in (GAP, FRESH):
            if size:
                out.append((GAP, size, first, n, 0, 0, 0))
        elif kind in (NEW, PLACED):
            out.append((PLACED, size, first, n, per, *rest))
        elif kind == PIECE:
            k = 0 if not per else n if 2 * size > capacity else min(n, max(0, seeds))
            seeds -= k
            if k:
                out.append((PLACED, size, first, k, 1, sequences, 0))
                if size < capacity:
                    out.append((GAP, capacity - size, sequences, k, 0, 0, 0))
                sequences += k
            if k < n:
                out.append((PIECE, size, first + k, n - k, 0, 0, 0))
    low = band(capacity, max((r[1] for r in out if r[0] == PIECE), default=0))
    yield TOTAL, 0, sequences, 0, 0, 0, 0
    yield from ((*r[:4], int(r[1] > low), *r[5:]) if r[0] <= PIECE else r for r in out)


def band(capacity: int, most: int) -> int:
    """What pieces and gaps of the band at work are larger than; `most`: the longest piece left. Bands go from a third of one to the next down."""
    while most <= capacity // 3:
        capacity //= 3
        if not capacity:
            break
    return capacity // 3


def _order(row: Row) -> tuple:
    return -row[1], row[0], row[2]


def place(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """The rounds of placements() on one machine and without ranges, over {length: how many}. Rows (length, first rank, how many, first sequence, offset), and the number of sequences."""
    low = band(capacity, max(counts, default=0))
    state = [(PIECE, n, 0, k, int(n > low), 0, 0) for n, k in counts.items() if k]
    while any(r[0] == PIECE for r in state):
        state = list(_ended(state, capacity))
    placed = [[size, first + j * n, n, sequence, offset + j * size] for kind, size, first, n, per, sequence, offset in state if kind == PLACED for j in range(per)]
    return np.array(sorted(placed), dtype=np.int64).reshape(-1, 5), max((r[2] for r in state if r[0] == TOTAL), default=0)


def _ended(rows: Iterable[Row], capacity: int) -> Iterator[Row]:
    """A sweep of all rows in the band, and the round's end."""
    rows = sorted(rows, key=_order)
    met = [r for r in rows if r[0] > PIECE or not r[4]]
    met += sweep((r for r in rows if r[0] <= PIECE and r[4]), capacity)
    return opened(sorted(met, key=_order), capacity)


def _batch(rows: Iterable[Row]) -> pa.RecordBatch:
    kinds = [("kind", pa.int32()), *((c, pa.int64()) for c in ("size", "first", "n", "per", "sequence", "offset"))]
    columns = list(zip(*rows, strict=True)) or [()] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, kinds, strict=True)], schema=pa.schema(kinds))


def _rows(it: Iterator[pa.RecordBatch], columns: int = 7) -> Iterator[tuple]:
    for b in it:
        yield from zip(*(b.column(k).to_pylist() for k in range(columns)), strict=True)


def round_(state: DataFrame, capacity: int) -> DataFrame:
    """One bulk-synchronous round over the runs and gaps of the band at work.

    Runs and gaps are dealt to ranges of size and sorted; each range is swept by
    itself. What finds no partner there carries over the boundaries: pieces of a
    range fit every gap of the ranges above, and a second sweep over those leftovers
    gives what one sweep over all ranges would. Then gaps are updated.
    """

    def local(it):
        out, part, held = [], None, []
        for *row, at in _rows(it, 8):
            if at != part:
                out += sweep(held, capacity)
                part, held = at, []
            (held if row[0] <= PIECE and row[4] else out).append(tuple(row))
        yield _batch([*out, *sweep(held, capacity)])

    def carried(it):
        rows = list(_rows(it))
        yield _batch(_ended(rows, capacity) if rows else ())

    at = F.floor(F.greatest(F.col("size") - 1, F.lit(0)) * RANGES / capacity).cast("int")
    dealt = state.withColumn("at", at).repartitionById(RANGES, F.col("at")).sortWithinPartitions("at", F.desc("size"), "kind", "first")
    return dealt.mapInArrow(local, STATE).repartition(1).mapInArrow(carried, STATE)


def placements(runs: DataFrame, capacity: int) -> DataFrame:
    """Rounds of best fit over runs (length, n): the staged placements, STATE's rows of the kind PLACED.

    Rows are runs, at most as many as there are lengths, and gaps and placements of
    one history, some thousands whatever the number of documents. A job makes ROUNDS
    rounds; some tens of rounds are enough, and those after the last change nothing.
    """
    low = band(capacity, runs.agg(F.max("length")).first()[0] or 0)
    zero = F.lit(0).cast("long")
    state = runs.select(F.lit(PIECE).alias("kind"), F.col("length").alias("size"), zero.alias("first"), "n", (F.col("length") > low).cast("long").alias("per"), zero.alias("sequence"), zero.alias("offset"))
    while not state.filter(F.col("kind") == PIECE).isEmpty():
        for _ in range(ROUNDS):
            state = round_(state, capacity)
        state = common.staged(state, "rounds")
    return state.filter(F.col("kind") == PLACED)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048, payload: dict[str, Column] | None = None) -> DataFrame:
    """Packs documents (doc_id, text) into sequences of at most `capacity` tokens.

    Returns one row per piece: doc_id, piece, start, length, what `payload` names
    (columns over the staged pieces; the ids themselves as `ids` by default),
    sequence_id and offset. A null or empty text is its end id alone. Null and
    repeated doc_ids are packed as rows of their own. Other columns are not read;
    no documents give no rows.
    """
    spark = docs.sparkSession
    payload = {"ids": F.col("ids")} if payload is None else payload
    stage = common.staged(pieces(docs, tokenizer, end_id, capacity), "pieces")
    runs = common.staged(stage.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "runs")
    lengths = common.staged(runs.groupBy("length").agg(F.sum("n").alias("n")), "lengths")
    placed = placements(lengths, capacity).select("size", "first", "n", "per", "sequence", "offset")
    # Some thousands of rows, whatever the number of documents.
    table = np.array([tuple(r) for r in placed.collect()], np.int64).reshape(-1, 6)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    held = spark.sparkContext.broadcast((table[:, 0] << 44 | table[:, 1], table))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rows = stage.select("doc_id", "piece", "start", "length", *(c.alias(n) for n, c in payload.items()), "part", "local")
    ranked = rows.join(offsets, ["part", "length"]).withColumn("rank", F.col("base") + F.col("local")).drop("part", "base", "local")
    order = ["doc_id", "piece", "start", "length", *payload, "rank"]
    fields = [f for f in ranked.select(*order[:-1]).schema.fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", sequence_id long, offset long"

    def run(it):
        keys, table = held.value
        for batch in it:
            n, rank = batch.column(3).to_numpy(), batch.column(batch.num_columns - 1).to_numpy()
            row = table[np.searchsorted(keys, n << 44 | rank, side="right") - 1]
            names = [*batch.schema.names[:-1], "sequence_id", "offset"]
            nth, each = np.divmod(rank - row[:, 1], row[:, 2])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(row[:, 4] + each), pa.array(row[:, 5] + nth * n)], names=names)

    return ranked.select(*order).mapInArrow(common.frugal(run), schema)


def sequences(packed: DataFrame) -> DataFrame:
    """The token ids of each sequence, from pack()'s rows with ids. A group holds one sequence, so at most the capacity. No pieces give no rows."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"))
