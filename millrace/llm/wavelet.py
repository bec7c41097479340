"""Token ids in a succinct binary format: one wavelet matrix per shard.

A shard keeps the ids of consecutive documents as bit-planes, highest bit first;
each plane is stably split by its bit before the next. With counts of ones for
every 2048 bits it answers, from the one file: the token at a place, how often a
token occurs before a place, and where its k-th occurrence is.

As lower planes stand in the order of the bits above, their bits are alike over
long stretches. Planes are compressed in chunks with a directory at the file's end,
so a shard takes less than its ids in as few whole bytes as they need, and a lookup
reads the directory, one row of counts and one chunk a plane. Each section has a
CRC-32 of its own.
"""

from __future__ import annotations

import io
import json
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import cache, cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, tokens

MAGIC, BLOCK, CHUNK = b"MLWM0002", 2048, 1 << 13
#: Place, length and CRC-32 of the directory, at the end before MAGIC.
END = struct.Struct("<QII")
SHARDS = "part int, shard int, path string, n_docs long, n_tokens long"
ROWS, SUMS = "doc_id long, start long, n_tokens long, ids binary", "doc_id long, start long, n_tokens long, ids_crc32 long"


class WaveletMatrix:
    def __init__(self, n: int, planes: list[tuple[np.ndarray, np.ndarray, int]]):
        """planes: for each bit the packed bits, the ones before each block, and the number of zeros."""
        self.n, self.planes = n, planes

    @classmethod
    def of(cls, values: np.ndarray) -> WaveletMatrix:
        return cls(len(values), list(cls.planes_of(values)))

    @staticmethod
    def planes_of(values: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """The planes one at a time."""
        n = len(values)
        width = max(1, int(values.max()).bit_length()) if n else 1
        now = values.astype(np.uint16 if width <= 16 else np.uint32)
        for shift in range(width - 1, -1, -1):
            ones = (now & now.dtype.type(1 << shift)) != 0
            packed = np.packbits(ones, bitorder="little")
            packed = np.concatenate([packed, np.zeros(-len(packed) % (BLOCK // 8), np.uint8)])
            sums = np.bitwise_count(packed.view(np.uint64)).reshape(-1, BLOCK // 64).sum(1, dtype=np.uint32)
            ranks = np.concatenate([np.zeros(1, np.uint32), np.cumsum(sums, dtype=np.uint32)])
            zeros = n - int(ranks[-1])
            split = np.empty_like(now)
            np.compress(~ones, now, out=split[:zeros])
            np.compress(ones, now, out=split[zeros:])
            now = split
            yield packed, ranks, zeros

    def _bit(self, plane, i: int) -> int:
        return int(plane[0][i >> 3]) >> (i & 7) & 1

    def _ones(self, plane, i: int) -> int:
        """Ones before place i."""
        block = i // BLOCK
        bits = int.from_bytes(plane[0][block * BLOCK // 8 : i // 8 + 1].tobytes(), "little")
        return int(plane[1][block]) + (bits & (1 << (i - block * BLOCK)) - 1).bit_count()

    def _find(self, plane, k: int, one: int) -> int:
        """The place of the k-th (from 0) one or zero."""
        edges = np.arange(len(plane[1]), dtype=np.int64) * BLOCK
        before = plane[1].astype(np.int64) if one else edges - plane[1].astype(np.int64)
        block = int(np.searchsorted(before, k, side="right")) - 1
        bits = np.unpackbits(plane[0][block * BLOCK // 8 : (block + 1) * BLOCK // 8], bitorder="little")
        return block * BLOCK + int(np.flatnonzero(bits == one)[k - before[block]])

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for plane in self.planes:
            one, ones = self._bit(plane, i), self._ones(plane, i)
            value, i = value << 1 | one, plane[2] + ones if one else i - ones
        return value

    def _range(self, value: int, end: int) -> tuple[int, int]:
        """Where the occurrences of a value before `end` stand after the last plane."""
        a, b = 0, end
        if value >> len(self.planes):
            return 0, 0
        for k, plane in enumerate(self.planes):
            oa, ob = self._ones(plane, a), self._ones(plane, b)
            a, b = (plane[2] + oa, plane[2] + ob) if value >> (len(self.planes) - 1 - k) & 1 else (a - oa, b - ob)
        return a, b

    def rank(self, value: int, end: int) -> int:
        """How often a value occurs before place `end`."""
        a, b = self._range(value, min(end, self.n))
        return b - a

    def count(self, value: int) -> int:
        return self.rank(value, self.n)

    def select(self, value: int, k: int) -> int:
        """The place of a value's k-th occurrence, from 0."""
        a, b = self._range(value, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        i = a + k
        for depth, plane in enumerate(reversed(self.planes)):
            one = value >> depth & 1
            i = self._find(plane, i - plane[2] if one else i, one)
        return i

    def values(self) -> np.ndarray:
        """All values, from the last plane up."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        now = np.zeros(self.n, kind)
        for depth, (packed, _, zeros) in enumerate(reversed(self.planes)):
            ones = np.unpackbits(packed, count=self.n, bitorder="little").view(bool)
            now[zeros:] |= kind(1 << depth)
            up = np.empty_like(now)
            np.place(up, ~ones, now[:zeros])
            np.place(up, ones, now[zeros:])
            now = up
        return now.astype(np.uint32)


def store(out, docs: list[int | None], sizes: list[int], ids: np.ndarray) -> None:
    """Writes a shard file to a stream, plane by plane: MAGIC, documents and sizes, counts and chunks of each plane, the directory, END, MAGIC."""
    at = 0

    def put(data: bytes) -> list[int]:
        nonlocal at
        out.write(data)
        at += len(data)
        return [at - len(data), len(data), zlib.crc32(data)]

    put(MAGIC)
    known = np.packbits(np.array([d is not None for d in docs], bool), bitorder="little")
    lists = put(zlib.compress(np.array([d or 0 for d in docs], "<i8").tobytes() + known.tobytes() + np.array(sizes, "<u8").tobytes(), 1))
    planes = []
    for packed, ranks, zeros in WaveletMatrix.planes_of(ids):
        planes.append({"zeros": zeros, "ranks": put(ranks.astype("<u4").tobytes()), "bytes": len(packed), "chunks": [put(zlib.compress(packed[k : k + CHUNK], 1)) for k in range(0, len(packed), CHUNK)]})
    head = put(zlib.compress(json.dumps({"tokens": len(ids), "docs": len(docs), "lists": lists, "planes": planes}).encode(), 1))
    put(END.pack(*head) + MAGIC)


def to_bytes(docs: list[int | None], sizes: list[int], ids: np.ndarray) -> bytes:
    out = io.BytesIO()
    store(out, docs, sizes, ids)
    return out.getvalue()


class _Plane:
    """The bits of a plane; chunks are read as they are asked for, and the last few kept."""

    def __init__(self, section: Callable[[list[int]], bytes], chunks: list[list[int]]):
        self.chunk = lru_cache(8)(lambda k: np.frombuffer(_unpacked(section(chunks[k])), np.uint8))

    def __getitem__(self, at):
        if not isinstance(at, slice):
            return self.chunk(at // CHUNK)[at % CHUNK]
        first, last = at.start // CHUNK, max(at.start, at.stop - 1) // CHUNK
        whole = np.concatenate([self.chunk(k) for k in range(first, last + 1)])
        return whole[at.start - first * CHUNK : at.stop - first * CHUNK]


def _unpacked(data: bytes) -> bytes:
    try:
        return zlib.decompress(data)
    except zlib.error as e:
        raise ValueError("not a whole shard file") from e


class Shard:
    """A shard file: doc_ids, starts (one more than documents) and the matrix.

    From bytes, everything is read and checked at once. opened() reads from a
    file's places only what lookups need.
    """

    def __init__(self, data: bytes | None = None, read: Callable[[int, int], bytes] | None = None, size: int = 0):
        self._read = read or (lambda at, n: data[at : at + n])
        size = len(data) if data is not None else size
        tail = self._read(max(0, size - END.size - 8), END.size + 8)
        if len(tail) < END.size + 8 or tail[END.size :] != MAGIC:
            raise ValueError("not a whole shard file")
        self.head = json.loads(_unpacked(self._section(END.unpack_from(tail))))
        if data is not None and data[:8] != MAGIC:
            raise ValueError("not a whole shard file")
        planes = []
        for p in self.head["planes"]:
            if data is None:
                planes.append((_Plane(self._section, p["chunks"]), _Ranks(self._section, p["ranks"]), p["zeros"]))
            else:
                bits = np.frombuffer(b"".join(_unpacked(self._section(c)) for c in p["chunks"]), np.uint8)
                planes.append((bits, np.frombuffer(self._section(p["ranks"]), "<u4"), p["zeros"]))
        self.matrix = WaveletMatrix(self.head["tokens"], planes)
        if data is not None:
            self._lists  # noqa: B018  checked with the rest

    @classmethod
    def opened(cls, path: str) -> Shard:
        fs, name = common.open_fs(path)
        f = fs.open_input_file(name)
        return cls(read=lambda at, n: f.read_at(n, at), size=f.size())

    def _section(self, where) -> bytes:
        at, n, crc = where
        data = self._read(at, n)
        if len(data) != n or zlib.crc32(data) != crc:
            raise ValueError("not a whole shard file")
        return data

    @cached_property
    def _lists(self) -> tuple[list[int | None], np.ndarray]:
        data, n = _unpacked(self._section(self.head["lists"])), self.head["docs"]
        known = np.unpackbits(np.frombuffer(data, np.uint8, -(-n // 8), 8 * n), count=n, bitorder="little")
        sizes = np.frombuffer(data, "<u8", n, 8 * n + -(-n // 8)).astype(np.int64)
        return [int(d) if k else None for d, k in zip(np.frombuffer(data, "<i8", n), known, strict=True)], np.concatenate([[0], np.cumsum(sizes)])

    @property
    def doc_ids(self) -> list[int | None]:
        return self._lists[0]

    @property
    def starts(self) -> np.ndarray:
        return self._lists[1]


class _Ranks:
    """Counts of ones before each block, read when first asked for."""

    def __init__(self, section: Callable[[list[int]], bytes], where: list[int]):
        self.load = cache(lambda: np.frombuffer(section(where), "<u4"))

    def __getitem__(self, at):
        return self.load()[at]

    def __len__(self) -> int:
        return len(self.load())

    def astype(self, kind):
        return self.load().astype(kind)


def write_shards(docs: DataFrame, tokenizer: str, end_id: int, folder: str, shard_tokens: int = 4_000_000) -> DataFrame:
    """Tokenises documents (doc_id, text) in ascending doc_id order and writes shard files into a shared folder.

    A shard closes once it has `shard_tokens` tokens, so memory is bounded by that
    and one document. Null doc_ids come first; rows with equal doc_ids stand in the
    order of their texts; a null text is empty. Returns the staged list of files.
    A retried task writes files of other names, and only files of tasks that
    succeeded are listed.
    """

    def run(it):
        fs, base = common.open_fs(folder)
        fs.create_dir(base, recursive=True)
        coder, end = tokens.encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        part, shard = TaskContext.get().partitionId(), 0
        ids, sizes, parts, total = [], [], [], 0

        def close():
            name = common.attempt_name(f"{part:08d}-{shard:06d}", ".wm")
            with fs.open_output_stream(f"{base}/{name}", compression=None) as out:
                store(out, ids, sizes, np.frombuffer(b"".join(parts), "<u4"))
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "shard": pa.array([shard], pa.int32()), "path": [f"{folder}/{name}"], "n_docs": [len(ids)], "n_tokens": [total]})

        for batch in it:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                parts.append(coder.ids(text.as_py()) + end)
                n = len(parts[-1]) // 4
                ids.append(doc)
                sizes.append(n)
                total += n
                if total >= shard_tokens:
                    yield close()
                    ids, sizes, parts, total, shard = [], [], [], 0, shard + 1
        if ids:
            yield close()

    rows = common.lean(docs).select(F.col("doc_id").cast("long"), common.text_column(docs).alias("text"))
    return common.staged(rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(common.frugal(run), SHARDS), "shards")


def read_shards(shards: DataFrame, sums: bool = False) -> DataFrame:
    """doc_id, start (tokens of all documents before), n_tokens, ids of each document, from the files. sums: instead of the ids their CRC-32, as ids_crc32.

    One row per row that was written, null and repeated doc_ids among them; no shards
    give no rows.
    """

    def run(it):
        kinds = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()) if sums else ("ids", pa.binary())])

        def rows(path: str, base: int):
            fs, name = common.open_fs(path)
            with fs.open_input_file(name) as f:
                shard = Shard(f.read())
            data = memoryview(shard.matrix.values().astype("<u4").tobytes())
            for doc, a, b in zip(shard.doc_ids, shard.starts[:-1].tolist(), shard.starts[1:].tolist(), strict=True):
                own = data[4 * a : 4 * b]
                yield doc, base + a, b - a, zlib.crc32(own) if sums else bytes(own)

        for batch in it:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield from common.batches(rows(path, base), kinds, size=None if sums else lambda r: len(r[3]))

    # Running sums of shards within their task, of tasks within some thousands, and of those: no task has a row per shard.
    before = [Window.unboundedPreceding, -1]
    some = F.floor(F.col("part") / 4096)

    def running(table: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
        return table.withColumn(name, F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(*before)), F.lit(0)))

    of_parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).withColumn("some", some)
    of_some = running(of_parts.groupBy("some").agg(F.sum("n").alias("n")), [], "some", "base_some").drop("n")
    of_parts = running(of_parts, ["some"], "part", "base_part").drop("n").join(of_some, "some")
    own = running(shards.withColumnRenamed("n_tokens", "n"), ["part"], "shard", "base_own")
    listed = own.join(of_parts, "part").select("path", (F.col("base_own") + F.col("base_part") + F.col("base_some")).alias("base"))
    spread = int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return listed.repartition(spread).mapInArrow(common.frugal(run), SUMS if sums else ROWS)
