"""Media columns: archives of lossless images, written by tasks and read back by a Spark data source.

A payload (bytes, zero-padded to a multiple of 64) is an 8-bit grey PNG of 64
columns, a member of a tar archive. `write_archives` lets each task write one
archive of its rows into a folder that the cluster shares. `ArchiveSource`
(format ``media_archive``) plans byte ranges over all archives of the folder
without reading them: a range's task looks for the first member header at or
after its begin and owns the members whose header lies in the range. Members
come as Arrow batches bounded in bytes. A member that can't be read or decoded
is tried again on its own, from its offset; after the last try its row carries
the error instead of a payload.

Defined cases: null payload is empty (64 zero bytes when padded); a null id
stays null; repeated rows are members each; very long payloads are one batch
each; an empty table gives an empty folder and no rows.
"""

from __future__ import annotations

import struct
import time
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .storage import fresh_path, short_batches

BLOCK, WIDTH = 512, 64
MEMBERS = "id long, n_bytes long, archive string, offset long, media binary, payload binary, tries int, error string"
_MEMBERS = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("media", pa.binary()), ("payload", pa.binary()), ("tries", pa.int32()), ("error", pa.string())])
_SIGNATURE = b"\x89PNG\r\n\x1a\n"


def padded(raw: bytes) -> bytes:
    """raw and zeros up to a positive multiple of 64."""
    return raw + bytes(-len(raw) % WIDTH or (0 if raw else WIDTH))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(payload: bytes) -> bytes:
    """A grey PNG of 64 columns and 8 bits, each row unfiltered."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def decode_png(media: bytes) -> bytes:
    """The samples of `encode_png`'s images; every chunk's checksum is tested."""
    if media[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, data, shape = 8, b"", (0, 0)
    while at < len(media):
        (n,), kind = struct.unpack(">I", media[at : at + 4]), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + n]
        if len(body) < n or zlib.crc32(kind + body) != struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0]:
            raise ValueError(f"damaged chunk {kind!r}")
        if kind == b"IHDR":
            shape = struct.unpack(">II", body[:8])
        elif kind == b"IDAT":
            data += body
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(data), np.uint8).reshape(shape[1], shape[0] + 1)
    if lines[:, 0].any():
        raise ValueError("filtered rows are not written here")
    return lines[:, 1:].tobytes()


def tar_header(name: str, size: int) -> bytes:
    head = bytearray(BLOCK)
    for at, text in ((0, name.encode()), (100, b"0000644\0"), (108, b"0000000\0"), (116, b"0000000\0"), (124, b"%011o\0" % size), (136, b"00000000000\0"), (148, b" " * 8), (156, b"0"), (257, b"ustar\00000")):
        head[at : at + len(text)] = text
    head[148:156] = b"%06o\0 " % sum(head)
    return bytes(head)


def read_header(block: bytes) -> tuple[str, int] | None:
    """Name and size of a member, or None if the block is no member's header."""
    if len(block) < BLOCK or block[257:262] != b"ustar":
        return None
    try:
        told = int(block[148:154], 8)
        size = int(block[124:135], 8)
    except ValueError:
        return None
    return (block[:100].rstrip(b"\0").decode(), size) if sum(block) - sum(block[148:156]) + 256 == told else None


def open_folder(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Writes the columns id (long) and raw (binary) of rows into archives; archive, members and bytes of each, not yet run."""

    def write(batches):
        fs, root = open_folder(folder)
        fs.create_dir(root, recursive=True)
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        name, draft = f"{root}/part-{part:06d}.tar", f"{root}/_draft-{uuid.uuid4().hex}"
        members, size = 0, 0
        with fs.open_output_stream(draft) as out:
            for batch in batches:
                for key, raw in zip(batch["id"].to_pylist(), batch["raw"], strict=True):
                    raw = raw.as_py() or b""
                    media = encode_png(padded(raw))
                    out.write(tar_header(f"{'' if key is None else key}.{len(raw)}.png", len(media)))
                    out.write(media + bytes(-len(media) % BLOCK))
                    members += 1
                    size += BLOCK + len(media) + -len(media) % BLOCK
            out.write(bytes(2 * BLOCK))
        if members:
            fs.move(draft, name)  # a task that runs again replaces its own archive
        else:
            fs.delete_file(draft)
        yield pa.RecordBatch.from_pydict({"archive": [name], "members": [members], "bytes": [size]})

    return rows.select("id", "raw").mapInArrow(write, "archive string, members long, bytes long")


class ByteRange(InputPartition):
    def __init__(self, archive: str, begin: int, end: int) -> None:
        self.archive, self.begin, self.end = archive, begin, end


class ArchiveReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.folder = options["path"]
        self.range = int(options.get("rangebytes", 16 << 20))
        self.batch = int(options.get("batchbytes", 2 << 20))
        self.tries = int(options.get("tries", 3))
        self.pause = float(options.get("pauseseconds", 0.2))

    def partitions(self):
        fs, root = open_folder(self.folder)
        found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
        files = sorted((f.path, f.size) for f in found if f.path.endswith(".tar"))
        return [ByteRange(p, b, min(b + self.range, size)) for p, size in files for b in range(0, size, self.range)] or [ByteRange("", 0, 0)]

    def _member(self, fs, archive: str, offset: int, name: str, size: int):
        """One member's row; opened anew at its offset after a failure."""
        error = ""
        for k in range(1, self.tries + 1):
            try:
                with fs.open_input_file(archive) as f:
                    f.seek(offset + BLOCK)
                    media = f.read(size)
                key, n, _ = name.split(".")
                return (int(key) if key else None, int(n), archive, offset, media, decode_png(media), k, None), size
            except (OSError, ValueError, zlib.error) as e:
                error = f"{type(e).__name__}: {e}"
                time.sleep(self.pause * (k < self.tries))
        return (None, None, archive, offset, None, None, self.tries, error), 0

    def read(self, partition):
        if not partition.archive:
            return
        fs, _ = open_folder(self.folder)
        rows, held = [], 0
        with fs.open_input_file(partition.archive) as f:
            at = -(-partition.begin // BLOCK) * BLOCK
            inside, lost = at == 0, False
            while at < partition.end:
                f.seek(at)
                member = read_header(block := f.read(BLOCK))
                if not member:
                    if inside and not lost:
                        if not any(block):  # behind the last member
                            break
                        lost = True  # a damaged header: one error row, then on to the next valid one
                        rows.append((None, None, partition.archive, at, None, None, 1, "ValueError: not a valid header"))
                    at += BLOCK
                    continue
                inside, lost = True, False
                row, size = self._member(fs, partition.archive, at, *member)
                rows.append(row)
                held += size + len(row[5] or b"")
                at += BLOCK + -(-member[1] // BLOCK) * BLOCK
                if held >= self.batch:
                    yield self._batch(rows)
                    rows, held = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows, strict=True), _MEMBERS, strict=True)], schema=_MEMBERS)


class ArchiveSource(DataSource):
    """spark.read.format("media_archive").option("rangebytes", ...).load(folder)"""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema):
        return ArchiveReader(self.options)


def read_archives(spark: SparkSession, folder: str, **options) -> DataFrame:
    """MEMBERS of all archives of a folder."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("media_archive").options(**options).load(folder)


def look_of(payload: bytes) -> str:
    """A picture's features: mean, deviation, and in 64 bits the columns brighter than the mean."""
    x = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    mean = float(x.mean())
    bright = np.packbits(x.mean(0) > mean).tobytes().hex()
    return f"{mean:.4f}:{float(x.std()):.4f}:{bright}"


def features(members: DataFrame) -> DataFrame:
    """Adds the column feature, computed from the payload read back."""

    @F.arrow_udf("string")
    def look(payload: pa.Array) -> pa.Array:
        return pa.array([None if p is None else look_of(p) for p in payload.to_pylist()], pa.string())

    return members.withColumn("feature", look("payload"))


def text_media(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """The texts of docs stored as archives and read back: MEMBERS and feature. Writes when called."""
    spark = docs.sparkSession
    short_batches(spark)
    folder = folder or fresh_path(spark, "media")
    rows = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).cast("binary").alias("raw"))
    said = write_archives(rows, folder).agg(F.sum("members").alias("n")).first()
    if not said["n"]:
        open_folder(folder)[0].create_dir(open_folder(folder)[1], recursive=True)
    return features(read_archives(spark, folder))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of `text_media`."""
    return found.select(
        F.col("id").alias("doc_id"),
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, octet_length(payload) - 63, 64)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
