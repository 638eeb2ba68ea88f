"""Question and answer between chunks of documents and buckets of keys.

A chunk (CHUNK_BYTES of documents, about) asks about its distinct 64-bit keys.
The sorted keys are cut by value and travel as compressed blocks. A bucket sees
each key once a chunk, however often the corpus repeats it, so a key that a third
of all rows hold is a few bytes a chunk. Its answer is one value per key in the
order of the question, so no key travels back.

Chunks and buckets follow the bytes of the input, not a setting of the session.
Up to DIRECT chunks, each sends a block to every bucket. Beyond it, blocks go
over a stop on the way: chunks form parties and buckets form groups, both about
the square root of their number wide; a chunk sends one block a group, and a
task per party and group cuts them by bucket, one row for a whole party. So n
chunks make about 4 n sqrt(n) blocks both ways and not 2 n n. Results are the
same either way.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import durable, short_batches, tidily

#: Bytes of text of a chunk, about: its arrays fit beside a small executor's heap. Larger executors take larger ones.
CHUNK_BYTES = 5 << 20
#: Chunks up to which each sends a block straight to every bucket.
DIRECT = 256
#: Ranges of keys whose bounds the driver holds.
RANGES = 1024
#: A row is what one party of chunks (one chunk, where blocks go straight) has for one bucket: a run of sorted keys a chunk.
ASKED = "bucket int, party int, chunks array<int>, keys array<binary>, vals array<binary>"
ASKED_ARROW = pa.schema([("bucket", pa.int32()), ("party", pa.int32()), ("chunks", pa.list_(pa.int32())), ("keys", pa.list_(pa.binary())), ("vals", pa.list_(pa.binary()))])
#: party -1 marks the bucket's own figures.
ANSWER = "party int, bucket int, chunks array<int>, vals array<binary>, figures array<long>"
ANSWER_ARROW = pa.schema([("party", pa.int32()), ("bucket", pa.int32()), ("chunks", pa.list_(pa.int32())), ("vals", pa.list_(pa.binary())), ("figures", pa.list_(pa.int64()))])


def parts(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> int:
    """How many chunks the texts of docs make."""
    short_batches(docs.sparkSession)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(1, -(-total // chunk_bytes))


def pack(values: np.ndarray) -> bytes:
    """Compresses an array: its bytes by significance, so that planes of zeros vanish."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(block: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(block), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, -1).T).reshape(-1).view(dtype)


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=keys.dtype.type(0)))


def unpack_sorted(block: bytes) -> np.ndarray:
    return np.cumsum(unpack(block, np.uint64), dtype=np.uint64)


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
    return pa.Table.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)


@dataclass(frozen=True)
class Exchange:
    """Between so many chunks and as many buckets of even ranges; width: chunks of a party and buckets of a group."""

    chunks: int
    width: int

    @classmethod
    def of(cls, chunks: int, direct: int | None = None) -> Exchange:
        return cls(chunks, 1 if chunks <= (DIRECT if direct is None else direct) else math.isqrt(chunks - 1) + 1)

    def _edges(self, buckets) -> np.ndarray:
        return np.array([(b << 64) // self.chunks for b in buckets], np.uint64)

    def asked(self, chunk: int, keys: np.ndarray, vals: np.ndarray | None = None) -> pa.Table:
        """Rows of ASKED for one chunk's sorted distinct keys; its column bucket is a group, where buckets form groups."""
        cuts = [0, *np.searchsorted(keys, self._edges(range(self.width, self.chunks, self.width))), len(keys)]
        return _rows(
            [
                (g, chunk // self.width, [chunk], [pack_sorted(keys[i:j])], [pack(vals[i:j]) if vals is not None else None])
                for g, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))
                if j > i
            ],
            ASKED_ARROW,
        )

    def _deal(self, key, table: pa.Table) -> pa.Table:
        """Blocks of a party for a group, cut by bucket."""
        first, party = key[0].as_py() * self.width, key[1].as_py()
        buckets = range(first, min(first + self.width, self.chunks))
        edges = self._edges(buckets[1:])
        out: dict[int, list] = {b: [] for b in buckets}
        for (chunk,), (keys,), (vals,) in zip(*(table[c].to_pylist() for c in ("chunks", "keys", "vals")), strict=True):
            keys = unpack_sorted(keys)
            vals = unpack(vals, f"V{self._size(vals, len(keys))}") if vals is not None else None
            cuts = [0, *np.searchsorted(keys, edges), len(keys)]
            for b, i, j in zip(buckets, cuts[:-1], cuts[1:], strict=True):
                if j > i:
                    out[b].append((chunk, pack_sorted(keys[i:j]), pack(vals[i:j]) if vals is not None else None))
        return _rows([(b, party, *map(list, zip(*runs, strict=True))) for b, runs in out.items() if runs], ASKED_ARROW)

    @staticmethod
    def _size(block: bytes, n: int) -> int:
        return zstandard.frame_content_size(block) // n

    def _collect(self, key, table: pa.Table) -> pa.Table:
        """Answers of a group's buckets to a party, joined by chunk."""
        group = key[1].as_py()
        by_chunk: dict[int, list] = {}
        for _, chunks, vals in sorted(zip(*(table[c].to_pylist() for c in ("bucket", "chunks", "vals")), strict=True), key=lambda r: r[0]):
            for chunk, block in zip(chunks, vals, strict=True):
                by_chunk.setdefault(chunk, []).append(zstandard.ZstdDecompressor().decompress(block))
        return _rows([(c, group, [c], [self._joined(blocks, table["figures"][0][0].as_py())], None) for c, blocks in by_chunk.items()], ANSWER_ARROW)

    @staticmethod
    def _joined(blocks: list[bytes], size: int) -> bytes:
        planes = np.concatenate([np.frombuffer(b, np.uint8).reshape(size, -1) for b in blocks], axis=1)
        return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())

    def ask(self, questions: DataFrame, answer: Callable, vals: type | None = None) -> tuple[DataFrame, DataFrame]:
        """Answers (chunk, bucket, vals) to rows of ASKED, and the buckets' figures (figures).

        answer takes a bucket's runs (chunk, keys, values), in the order of chunks,
        and returns an array of one value per key for each and its figures, a list.
        """

        def settle(key, table):
            rows = list(zip(*(table[c].to_pylist() for c in ("party", "chunks", "keys", "vals")), strict=True))
            del table
            at = sorted((chunk, r, k) for r, row in enumerate(rows) for k, chunk in enumerate(row[1]))
            runs = [(chunk, unpack_sorted(rows[r][2][k]), unpack(rows[r][3][k], vals) if vals is not None else None) for chunk, r, k in at]
            said, figures = answer(runs)
            size = [said[0].itemsize]
            out: list[list] = [[None] * len(row[1]) for row in rows]
            for (_, r, k), values in zip(at, said, strict=True):
                out[r][k] = pack(values)
            bucket = key[0].as_py()
            told = [(row[0], bucket, row[1], blocks, size) for row, blocks in zip(rows, out, strict=True)]
            return _rows([*told, *([(-1, bucket, [], [], figures)] if figures else [])], ANSWER_ARROW)

        if self.width > 1:
            questions = questions.groupBy("bucket", "party").applyInArrow(tidily(self._deal), ASKED)
        told = questions.groupBy("bucket").applyInArrow(tidily(settle), ANSWER)
        said = told.where("party >= 0")
        if self.width > 1:
            said = said.groupBy("party", F.floor(F.col("bucket") / F.lit(self.width)).cast("int").alias("grp")).applyInArrow(tidily(self._collect), ANSWER)
        return said.select(F.col("party").alias("chunk"), "bucket", F.col("vals")[0].alias("vals")), told.where("party < 0").select("figures")


def answered(table: pa.Table, dtype) -> np.ndarray:
    """The answers of all buckets to a chunk, in the order of its sorted keys."""
    rows = sorted(zip(table["bucket"].to_pylist(), table["vals"].to_pylist(), strict=True))
    return np.concatenate([unpack(v, dtype) for _, v in rows]) if rows else np.zeros(0, dtype)


def by_hash(docs: DataFrame, chunks: int, key: str = "doc_id") -> DataFrame:
    """Adds the column chunk; all rows of a key share one."""
    return docs.withColumn("chunk", F.pmod(F.xxhash64(key), F.lit(chunks)).cast("int"))


def by_range(docs: DataFrame, chunks: int, key: str = "doc_id", broadcast_bytes: int = 8 << 20) -> DataFrame:
    """Adds the column chunk so that a smaller key is in no later chunk; nulls come first. Chunks hold about as many bytes of text.

    RANGES ranges of about as many rows each have their bounds and sizes on the
    driver, however many chunks there are. Within a range, a running sum over its
    keys cuts the chunks; the key that each begins with stays in a table of one row
    a range, which is broadcast up to broadcast_bytes and joined by a shuffle
    beyond. Rows of one key share a chunk.
    """
    shares = [i / RANGES for i in range(1, RANGES)]
    bounds = np.array(sorted(set(docs.select(F.percentile_approx(key, shares, 10_000)).first()[0] or [])), np.int64)

    @F.arrow_udf("int")
    def place(ids: pa.Array) -> pa.Array:
        at = np.searchsorted(bounds, ids.fill_null(0).to_numpy(zero_copy_only=False))
        return pa.array(np.where(ids.is_null().to_numpy(zero_copy_only=False), 0, at).astype(np.int32))

    sized = docs.select(place(F.col(key)).alias("at"), F.col(key).alias("first"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n"))
    sized = durable(sized.groupBy("at", "first").agg(F.sum("n").alias("n")))
    held = np.zeros(len(bounds) + 1, np.int64)
    for r in sized.groupBy("at").agg(F.sum("n").alias("n")).collect():
        held[r["at"]] = r["n"]
    begin = F.get(F.lit((np.cumsum(held) - held).tolist()), F.col("at"))
    upto = F.sum("n").over(Window.partitionBy("at").orderBy("first").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    share = max(1, int(held.sum())) / chunks
    cut = sized.withColumn("chunk", F.least(F.floor((begin + upto - F.col("n")) / F.lit(share)).cast("int"), F.lit(chunks - 1)))
    firsts = cut.groupBy("at", "chunk").agg(F.min("first").alias("first")).groupBy("at")
    range_, cuts = (c + "_" * max(map(len, docs.columns)) for c in ("at", "cuts"))  # no column of docs is named so
    edges = durable(firsts.agg(F.collect_list(F.struct("first", "chunk")).alias(cuts))).withColumnRenamed("at", range_)
    if 16 * (chunks + RANGES) <= broadcast_bytes:  # a long, an int and what a struct takes, for each
        edges = F.broadcast(edges)
    begun = F.filter(cuts, lambda e: e["first"] <= F.col(key))
    chunk = F.coalesce(F.array_max(F.transform(begun, lambda e: e["chunk"])), F.lit(0))
    return docs.withColumn(range_, place(F.col(key))).join(edges, range_, "left").withColumn("chunk", chunk).drop(range_, cuts)
