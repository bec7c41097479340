"""Media columns: payloads in archives, read by a data source of our own.

Archives are ZIP files. The source plans byte ranges of the archives from their
sizes alone; a task reads an archive's directory, takes the members whose local
header starts in its range, and streams them as Arrow batches. A member that
cannot be read is tried again by itself, from its offset, before the task fails.
"""

from __future__ import annotations

import io
import json
import struct
import time
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import common

FORMAT, UNIT, RATE = "millrace_media", 64, 16_000
MEDIA = "archive string, offset long, member string, meta string, media binary"
LISTED = "_listed"
FILES = "path string, members long, bytes long"


def to_wav(payload: bytes) -> bytes:
    """8-bit mono samples as a RIFF WAVE file (44 bytes of header; a pad byte after an odd length)."""
    n = len(payload)
    head = b"RIFF" + struct.pack("<I", 36 + n + n % 2) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", n)
    return head + payload + b"\0" * (n % 2)


def from_wav(data: bytes) -> bytes:
    """The samples of the data chunk."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at = 12
    while at + 8 <= len(data):
        kind, n = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if kind == b"data":
            if at + 8 + n > len(data):
                raise ValueError("the data chunk is cut off")
            return data[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    raise ValueError("no data chunk")


def padded(text: str) -> bytes:
    """UTF-8, with zero bytes up to a positive multiple of UNIT."""
    raw = text.encode("utf-8", "surrogatepass")
    return raw + b"\0" * (-len(raw) % UNIT if raw else UNIT)


def features(samples: bytes) -> str:
    """Mean, deviation, crossings of the middle, peak and a coarse spectrum of the samples, as text."""
    x = np.frombuffer(samples, np.uint8).astype(np.int32) - 128
    if not len(x):
        return "n=0"
    high = x >= 0
    frames = x[: len(x) // UNIT * UNIT].reshape(-1, UNIT)
    bands = np.abs(frames.reshape(len(frames), 8, -1).sum(2)).mean(0) if len(frames) else np.zeros(8)
    return f"n={len(x)};mean={x.mean():.4f};std={x.std():.4f};cross={np.count_nonzero(high[1:] != high[:-1])};peak={int(np.abs(x).max())};bands=" + ",".join(f"{b:.2f}" for b in bands)


def write_archives(docs: DataFrame, folder: str, archive_bytes: int = 64 << 20) -> DataFrame:
    """Stores each text of documents (doc_id, text) as a WAVE member of a ZIP archive in a shared folder.

    An archive closes at about `archive_bytes` of payload, which bounds memory. A
    null text is empty; null and repeated doc_ids have members of their own. Returns
    the list of archives that successful tasks wrote, which stands beside them; readers
    of the folder keep to that list.
    """

    def run(it):
        fs, base = common.open_fs(folder)
        fs.create_dir(base, recursive=True)
        buffer = archive = None
        held = members = 0

        def close():
            archive.close()
            name = common.attempt_name("media", ".zip")
            with fs.open_output_stream(f"{base}/{name}", compression=None) as out:
                out.write(buffer.getbuffer())
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "members": [members], "bytes": [buffer.getbuffer().nbytes]})

        for b in it:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if archive is None:
                    buffer, held, members = io.BytesIO(), 0, 0
                    archive = zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED, compresslevel=1)
                payload = padded(text.as_py())
                info = zipfile.ZipInfo(f"{members:08d}.wav")
                info.compress_type = zipfile.ZIP_DEFLATED
                info.comment = json.dumps({"doc_id": doc, "n_bytes": text.as_buffer().size}).encode()
                archive.writestr(info, to_wav(payload), compresslevel=1)
                members += 1
                held += len(payload)
                if held >= archive_bytes:
                    yield close()
                    archive = None
        if archive is not None:
            yield close()

    rows = common.lean(docs).select(F.col("doc_id").cast("long"), common.text_column(docs).alias("text"))
    rows.mapInArrow(common.frugal(run), FILES).write.parquet(f"{folder}/{LISTED}")
    return docs.sparkSession.read.schema(FILES).parquet(f"{folder}/{LISTED}")


class ByteRange(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


def archive_paths(folder: str) -> list[tuple[str, int]]:
    """Archives of a folder with their sizes; where the writer has left its list, only those on it."""
    import pyarrow.dataset as ds
    from pyarrow import fs as pafs

    fs, base = common.open_fs(folder)
    found = {f.path.rsplit("/", 1)[-1]: f.size for f in fs.get_file_info(pafs.FileSelector(base)) if f.is_file and f.path.endswith(".zip")}
    if fs.get_file_info(f"{base}/{LISTED}").type == pafs.FileType.Directory:
        listed = ds.dataset(f"{base}/{LISTED}", filesystem=fs, format="parquet").to_table(columns=["path"]) if found else pa.table({"path": []})
        found = {n: found[n] for n in (p.rsplit("/", 1)[-1] for p in listed.column(0).to_pylist())}
    return sorted((f"{folder}/{p}", n) for p, n in found.items())


class MediaReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]
        self.size = int(options.get("rangebytes", 16 << 20))
        self.attempts = int(options.get("attempts", 3))

    def partitions(self) -> list[InputPartition]:
        out = [ByteRange(path, at, at + self.size) for path, n in archive_paths(self.folder) for at in range(0, n, self.size)]
        return out or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        schema = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("member", pa.string()), ("meta", pa.string()), ("media", pa.binary())])
        yield from common.batches(self.members(partition), schema, limit=2_000, size=lambda r: len(r[4]), most=8 << 20)

    def members(self, p: ByteRange) -> Iterator[tuple]:
        fs, name = common.open_fs(p.path)
        with fs.open_input_file(name) as f:
            archive = zipfile.ZipFile(f)
            found = sorted((x for x in archive.infolist() if p.start <= x.header_offset < p.end), key=lambda x: x.header_offset)
            for info in found:
                yield p.path, info.header_offset, info.filename, info.comment.decode(), self.member(archive, p.path, info)

    def member(self, archive: zipfile.ZipFile, path: str, info: zipfile.ZipInfo) -> bytes:
        """The bytes of one member, checked against its CRC-32; each further attempt opens the archive anew."""
        for attempt in range(self.attempts):
            try:
                if not attempt:
                    return archive.read(info)
                time.sleep(0.1 * attempt)
                fs, name = common.open_fs(path)
                with fs.open_input_file(name) as f:
                    return zipfile.ZipFile(f).read(info)
            except Exception as e:
                if attempt + 1 == self.attempts:
                    raise OSError(f"{path}: the member at offset {info.header_offset} can't be read") from e
        raise AssertionError


class MediaSource(DataSource):
    """spark.read.format("millrace_media").load(folder); options rangeBytes, attempts."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return MEDIA

    def reader(self, schema) -> DataSourceReader:
        return MediaReader({k.lower(): v for k, v in dict(self.options).items()})


def read_archives(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """The members of a folder's archives: archive, offset, member, meta, media. A folder without archives gives no rows."""
    spark.dataSource.register(MediaSource)
    return spark.read.format(FORMAT).options(**options).load(folder)


def describe(members: DataFrame) -> DataFrame:
    """What each member holds, from its bytes: payload, size and features. One row per member: null and repeated doc_ids stay as they are, a null or empty text has one unit of zero bytes."""
    import hashlib
    import zlib

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(it):
        for b in it:
            out = []
            for meta, media in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                known, data = json.loads(meta), media.as_py()
                payload = from_wav(data)
                out.append((known["doc_id"], known["n_bytes"], len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), features(payload)))
            yield from common.batches(iter(out), kinds)

    kinds = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])
    return members.select("meta", "media").mapInArrow(common.frugal(run), schema)
