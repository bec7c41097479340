"""WARC archives and capture histories.

Pages become records of gzip-compressed WARC files; equal payloads are stored once
and other captures revisit them. Each writing task also leaves a run of index
lines sorted by URL key and time, with a sparse index of its own. Capture
histories come of an external merge: runs are merged k ways by a loser tree, in
several passes where there are more runs than the tree may have leaves, and in
parallel over ranges of URL keys, to parts in global order.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import io
import json
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

EPOCH = datetime(2024, 1, 1, tzinfo=UTC)
SPARSE, MOST = 256, 4096
RUNS = "path string, lines long, bytes long, sparse binary"
CAPTURES = "url_key string, timestamp string, page_id long, url string, record_type string, payload_digest string, archive string, offset long, length long, part int, place long"


def url_key(url: str) -> str:
    """The reversed host, then port, path and query, in lower case but for path and query: one key for http and https, with or without www."""
    try:
        u = urlsplit(url.strip())
        host, port = (u.hostname or "").lower(), u.port
    except ValueError:
        return url.strip()
    if not host:
        return url.strip()
    host = host.removeprefix("www.")
    return ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "") + ")" + (u.path or "/") + (f"?{u.query}" if u.query else "")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def capture_time(page: int | None) -> datetime:
    """When a page counts as captured, as pages have no time: a second per page_id from a fixed day on."""
    return EPOCH + timedelta(seconds=(page or 0) % 10**9)


def record_id(page: int | None) -> str:
    return f"<urn:millrace:page:{'null' if page is None else page}>"


def record(page: int | None, url: str, payload: bytes, refers: int | None, revisit: bool, payload_digest: str) -> bytes:
    """One WARC/1.1 record as a gzip member."""
    block = b"" if revisit else payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page)}",
        f"WARC-Date: {capture_time(page).strftime('%Y-%m-%dT%H:%M:%SZ')}",
        f"WARC-Target-URI: {' '.join(url.split())}",
        f"WARC-Payload-Digest: sha1:{payload_digest}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: {record_id(refers)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: text/html", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n", 1, mtime=0)


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of one gzip member."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    return fields, rest[: int(fields["Content-Length"])]


def originals(pages: DataFrame, least: int = 0) -> DataFrame:
    """pages with payload_digest and refers_to: of equal payloads of at least `least` bytes the smallest page_id is the original, others refer to it.

    Only digests and ids are grouped; pages move once, to meet their original. Null
    htmls are empty, and null page_ids come last. Rows that share a page_id and a
    payload with the original are all responses.
    """
    rows = common.lean(pages).select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), common.text_column(pages, "html").alias("html"))
    rows = rows.withColumn("sha1", F.sha1(F.col("html").cast("binary")))
    first = rows.filter(F.octet_length("html") >= least).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return rows.join(first, "sha1", "left").withColumn("refers_to", F.when(F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))).drop("first", "sha1")


def write(pages: DataFrame, folder: str, least: int = 0, file_bytes: int = 64 << 20) -> DataFrame:
    """Writes pages (page_id, url, html) as WARC files with a sorted index run beside each. Returns the staged list of runs."""

    def run(it):
        fs, base = common.open_fs(folder)
        fs.create_dir(base, recursive=True)
        buffer, lines = io.BytesIO(), []

        def close():
            name = common.attempt_name("pages", "")
            with fs.open_output_stream(f"{base}/{name}.warc.gz", compression=None) as out:
                out.write(buffer.getbuffer())
            archive = f"{folder}/{name}.warc.gz"
            return _store(fs, f"{base}/{name}.run", f"{folder}/{name}.run", sorted((*x, archive, *y) for x, y in lines))

        for b in it:
            for page, url, html, refers in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                payload = html.encode("utf-8", "surrogatepass")
                sha, at = digest(payload), buffer.tell()
                buffer.write(record(page, url, payload, refers, refers is not None, sha))
                line = url_key(url), capture_time(page).strftime("%Y%m%d%H%M%S"), (page is not None, page or 0), url, "response" if refers is None else "revisit", sha
                lines.append((line, (at, buffer.tell() - at)))
                if buffer.tell() >= file_bytes:
                    yield close()
                    buffer, lines = io.BytesIO(), []
        if lines:
            yield close()

    return common.staged(originals(pages, least).select("page_id", "url", "html", "refers_to").mapInArrow(common.frugal(run), RUNS), "runs")


def _store(fs, name: str, path: str, lines) -> pa.RecordBatch:
    """Writes sorted index lines. Keys and offsets of lines at even distances are the run's sparse index, of at most MOST entries: the distance doubles as a run grows."""
    sparse, n, at, step = [], 0, 0, SPARSE
    with fs.open_output_stream(name, compression=None) as out:
        for line in lines:
            if n % step == 0:
                sparse.append((list(line[:3]), at))
                if len(sparse) > MOST:
                    sparse, step = sparse[::2], 2 * step
            data = json.dumps(line).encode() + b"\n"
            out.write(data)
            at += len(data)
            n += 1
    return pa.RecordBatch.from_pydict({"path": [path], "lines": [n], "bytes": [at], "sparse": pa.array([zlib.compress(json.dumps(sparse).encode(), 1)], pa.binary())})


class LoserTree:
    """Merges sorted iterators: each inner node holds the run that lost there, so the next item takes one comparison a level."""

    def __init__(self, runs: list[Iterator]):
        self.runs = runs
        self.size = size = 1 << max(0, len(runs) - 1).bit_length()
        self.heads = [next(r, None) for r in runs] + [None] * (size - len(runs))
        self.losers = [0] * size
        winners = [0] * size + list(range(size))
        for node in range(size - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._before(a, b) else (b, a)
        self.winner = winners[1] if size > 1 else 0

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or x is not None and (x, a) <= (y, b)

    def __iter__(self):
        while self.runs and self.heads[self.winner] is not None:
            best = self.winner
            yield self.heads[best]
            self.heads[best] = next(self.runs[best], None)
            node = (best + self.size) >> 1
            while node:
                if self._before(self.losers[node], best):
                    self.losers[node], best = best, self.losers[node]
                node >>= 1
            self.winner = best


def _lines(path: str, start: int, end: int | None, low: list | None, high: list | None) -> Iterator[list]:
    """A run's lines from offset `start` on whose keys are in [low, high)."""
    fs, name = common.open_fs(path)
    with fs.open_input_file(name) as f:
        f.seek(start)
        text = io.BufferedReader(f, 1 << 16) if end is None else io.BytesIO(f.read(end - start))
        for raw in text:
            line = json.loads(raw)
            if high is not None and line[:1] >= high:
                return
            if low is None or line[:1] >= low:
                yield line


def _merged(runs: list[tuple[str, list]], low: str | None, high: str | None) -> Iterator[list]:
    """Lines of several runs whose URL keys are in [low, high), in order."""
    a, b = None if low is None else [low], None if high is None else [high]
    parts = []
    for path, sparse in runs:
        keys = [s[0][:1] for s in sparse]
        first = 0 if a is None else max(0, bisect.bisect_left(keys, a) - 1)
        last = len(keys) if b is None else bisect.bisect_left(keys, b)
        if first < last:
            parts.append(_lines(path, sparse[first][1], sparse[last][1] if last < len(keys) else None, a, b))
    yield from LoserTree(parts)


def merge(spark: SparkSession, runs: DataFrame, folder: str, fan_in: int = 64, part_lines: int = 20_000) -> DataFrame:
    """Capture histories: all index lines in order of URL key, time and page_id, as `place` within `part` (parts in key order).

    Passes of `fan_in` runs each leave fewer, longer runs until one tree can hold
    them (they are grouped by a hash, about half of `fan_in` to a group). The last pass cuts URL keys into ranges of about `part_lines` lines by
    the runs' sparse indices; a task merges one range. A URL's history stays in
    one part. No runs give no rows. The driver sees paths and sparse keys of a
    bounded number of runs only.
    """
    listed = runs
    while listed.count() > fan_in:
        groups = listed.withColumn("g", F.pmod(F.xxhash64("path"), F.lit(-(-2 * listed.count() // fan_in))))

        def join(it):
            import collections

            fs, base = common.open_fs(folder)
            held = collections.defaultdict(list)
            for b in it:
                for path, sparse, g in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                    held[g].append((path, json.loads(zlib.decompress(sparse))))
            for group in held.values():
                name = common.attempt_name("merged", ".run")
                yield _store(fs, f"{base}/{name}", f"{folder}/{name}", _merged(group, None, None))

        listed = common.staged(groups.select("path", "sparse", "g").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "g").mapInArrow(common.frugal(join), RUNS), "merged")
    # At most fan_in rows, each with at most MOST keys.
    known = [(r.path, json.loads(zlib.decompress(bytes(r.sparse)))) for r in listed.select("path", "sparse").orderBy("path").collect()]
    keys = sorted(s[0][0] for _, sparse in known for s in sparse)
    parts = min(len(keys), -(-(listed.agg(F.sum("lines")).first()[0] or 0) // part_lines))
    cuts = sorted({keys[k * len(keys) // parts] for k in range(1, parts)})
    held = spark.sparkContext.broadcast(known)
    ranges = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(zip([None, *cuts], [*cuts, None], strict=True))], "part int, low string, high string")

    def run(it):
        kinds = pa.schema([("url_key", pa.string()), ("timestamp", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("part", pa.int32()), ("place", pa.int64())])
        for b in it:
            for part, low, high in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                rows = ((*x[:2], x[2][1] if x[2][0] else None, *x[3:], part, k) for k, x in enumerate(_merged(held.value, low, high)))
                yield from common.batches(rows, kinds)

    return ranges.repartition(len(cuts) + 1, "part").mapInArrow(common.frugal(run), CAPTURES)


def read(captures: DataFrame) -> DataFrame:
    """Records of captures, read from the archives at their offsets: page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload (of responses).

    Captures are dealt to tasks by archive and read in order of offset. A response
    whose payload does not have the digest it states fails the task. Null page_ids
    stay null, repeated ones have rows of their own; no captures give no rows.
    """
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"

    def page_of(text: str) -> int | None:
        name = text.rstrip(">").rpartition(":")[2]
        return None if name == "null" else int(name)

    def run(it):
        kinds = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])

        def rows():
            name, f = None, None
            for b in it:
                for archive, offset, length in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                    if archive != name:
                        fs, path = common.open_fs(archive)
                        name, f = archive, fs.open_input_file(path)
                    fields, block = parse(f.read_at(length, offset))
                    stated = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    revisit = fields["WARC-Type"] == "revisit"
                    if not revisit and digest(block) != stated:
                        raise ValueError(f"{archive}: the payload at {offset} isn't what its digest says")
                    size = int(fields["X-Payload-Length"]) if revisit else len(block)
                    yield page_of(fields["WARC-Record-ID"]), size, stated, fields["WARC-Type"], page_of(fields["WARC-Refers-To"]) if revisit else None, fields["WARC-Target-URI"], None if revisit else block

        yield from common.batches(rows(), kinds, size=lambda r: len(r[6] or b""))

    n = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = captures.select("archive", "offset", "length").repartition(n, "archive", F.floor(F.col("offset") / (8 << 20)))
    return spread.sortWithinPartitions("archive", "offset").mapInArrow(common.frugal(run), schema)


#: What op8 returns, in DuckDB's SQL: the SHA-1 in base 32, eight digits for every five bytes.
ORACLE = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT *, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(h, 1 + 10 * (i // 8), 10))::BIGINT >> (35 - 5 * (i % 8))) & 31))::INTEGER, 1)), '') AS payload_digest, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM d"""
