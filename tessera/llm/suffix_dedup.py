"""Exact removal of repeated byte strings with a family of suffix arrays.

Rule: in the UTF-8 bytes of all texts, each byte goes that lies in a string of
``length`` bytes which also starts earlier (smaller doc_id, or same document
and earlier start). Strings never cross documents and are judged on the input.

How it runs on Spark
* Documents are cut by doc_id range into chunks of about equal bytes, the
  batches of the index.
* A batch's suffixes are sampled: of each ``length`` bytes the suffix whose
  first ``gram`` bytes hash lowest (a minimizer) is kept, so equal strings keep
  the same suffixes, at about 3 in 100 positions. The sorted sample is the
  batch's suffix array; suffixes compare by fingerprints, as only equality over
  ``length`` bytes counts.
* Suffixes are dealt to buckets by fingerprint. A bucket keeps a logarithmic
  family of levels (`SuffixLevels`): batch after batch, in order, the new array is
  merge-scanned against the levels for suffixes met in an earlier batch and then
  joins them, two levels of equal rank merging into one of the next.
* A suffix whose whole neighbourhood is the same wherever it occurs is settled
  by that scan. Where neighbourhoods differ (the ends of a match), the strings
  at each start go through a second scan of the same kind.

A bucket gets a suffix once a batch at most, however often it repeats. Matching
is by 64-bit fingerprints.

Defined cases: null text is empty; null doc_id sorts first; rows of one doc_id
are ordered by text; repeated rows count as repeated documents; other columns
are ignored but for those named in carry; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import exchange as X
from . import textbytes as B
from .storage import tidily

KEPT, EARLIER, MIXED = 0, 1, 2


class SuffixLevels:
    """Sorted levels of (fingerprint, neighbourhood or 0 if mixed) of the batches so far; equal ranks merge."""

    def __init__(self) -> None:
        self.levels: list[tuple[int, tuple[np.ndarray, np.ndarray]]] = []

    def scan(self, keys: np.ndarray, around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each suffix of a new batch: KEPT, EARLIER or MIXED, as far as earlier batches tell; and its neighbourhood, 0 where it differs from theirs."""
        around = around.copy()
        out = np.where(around == 0, np.uint8(MIXED), np.uint8(KEPT))
        for _, (have, theirs) in self.levels:
            at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
            hit = have[at] == keys
            out[hit & (out == KEPT)] = EARLIER
            differs = hit & (theirs[at] != around)
            out[differs], around[differs] = MIXED, 0
        return out, around

    def add(self, keys: np.ndarray, around: np.ndarray) -> None:
        rank, new = 0, (keys, around)
        while self.levels and self.levels[-1][0] == rank:
            new, rank = self.merged(self.levels.pop()[1], new), rank + 1
        self.levels.append((rank, new))

    @staticmethod
    def merged(a, b):
        keys = np.concatenate([a[0], b[0]])
        order = np.argsort(keys, kind="stable")  # two sorted runs: one linear merge
        keys, around = keys[order], np.concatenate([a[1], b[1]])[order]
        fresh = np.ones(len(keys), bool)
        fresh[1:] = keys[1:] != keys[:-1]
        twin = np.flatnonzero(~fresh)
        around[twin - 1] = np.where(around[twin] == around[twin - 1], around[twin], 0)
        return keys[fresh], around[fresh]

    def mixed(self) -> np.ndarray:
        """Sorted fingerprints whose neighbourhoods differ somewhere."""
        return np.unique(np.concatenate([np.zeros(0, np.uint64), *(keys[around == 0] for _, (keys, around) in self.levels)]))


def _bucket(runs):
    """Batches in their order: each is scanned against the levels of those before it, then joins them."""
    levels, said = SuffixLevels(), []
    for _, keys, around in runs:
        verdict, around = levels.scan(keys, np.ones(len(keys), np.uint64) if around is None else around)
        levels.add(keys, around)
        said.append(verdict)
    mixed = levels.mixed()
    for (_, keys, _), verdict in zip(runs, said, strict=True) if len(mixed) else ():
        verdict[mixed[np.minimum(np.searchsorted(mixed, keys), len(mixed) - 1)] == keys] = MIXED
    return said, None


class Chunk:
    """One batch: its documents in order, as one byte buffer with slices of whole documents."""

    def __init__(self, table: pa.Table, length: int, gram: int) -> None:
        order = [("doc_id", "ascending"), ("text", "ascending")] if table.num_rows > 1 else []
        self.table = table.sort_by(order) if order else table
        if self.table["doc_id"].null_count:
            null = pa.compute.is_null(self.table["doc_id"])
            self.table = pa.concat_tables([self.table.filter(null), self.table.filter(pa.compute.invert(null))])
        self.data, self.offsets = B.buffer_of(self.table["text"])
        self.length, self.gram, self.width = length, gram, length - gram + 1

    def pieces(self):
        """Parts that are hashed at once, as the range they answer for and the offsets of what they read.

        A part is some whole documents, or a stretch of a long one with as much
        around it as strings and suffixes that start in the stretch reach.
        """
        for i, j in B.slices(self.offsets):
            begin, end = self.offsets[i], self.offsets[j]
            if j - i > 1 or end - begin <= B.SLICE:
                yield begin, end, self.offsets[i : j + 1]
                continue
            for own in range(begin, end, B.SLICE):
                upto = min(own + B.SLICE, end)
                yield own, upto, np.array([max(begin, own - self.width + 1), min(end, upto + self.length)])

    def slices(self):
        """Of each piece: its range, where its bytes begin, their hash sums, the lowest gram of each string, and the sampled suffixes of its range."""
        for own, upto, offsets in self.pieces():
            begin = offsets[0]
            sums = B.prefix_sums(self.data[begin : offsets[-1]])
            offsets = offsets - begin
            if offsets[-1] < self.length:
                continue
            grams = B.gram_hash(sums, self.gram)
            lowest = B.sliding(grams, self.width, np.minimum)
            ends = offsets[1:-1]
            for e in ends:
                lowest[max(0, e - self.length + 1) : e] = 0
            rim = np.zeros(self.width - 1, np.uint64)
            reach = B.sliding(np.concatenate([rim, lowest, rim]), self.width, np.maximum)
            at = np.flatnonzero((reach == grams) & (reach > 0))
            at = at[(begin + at >= own) & (begin + at < upto)]
            row = np.searchsorted(offsets, at, "right") - 1
            left = np.maximum(at - self.width + 1, offsets[row])
            right = np.minimum(at + self.length, offsets[row + 1])
            around = B.span_hash(sums, left, right) + ((at - left) * (2 * self.length) + right - at).astype(np.uint64)
            # mixed once more, as the lowest hashes would all fall into the first buckets
            yield (own, upto), begin, sums, lowest, B.mix(grams[at]), B.mix(around) | np.uint64(1), begin + left, begin + right

    def suffixes(self):
        """The sampled suffixes: fingerprints, neighbourhoods and their spans; sorted distinct fingerprints (0: mixed)."""
        found = [x[4:] for x in self.slices()]
        if not found:
            return (np.zeros(0, np.uint64),) * 6
        key, around, left, right = (np.concatenate(x) for x in zip(*found, strict=True))
        keys, first, back = np.unique(key, return_index=True, return_inverse=True)
        own = around[first]
        mixed = np.zeros(len(keys), bool)
        mixed[back[around != own[back]]] = True
        return keys, np.where(mixed, np.uint64(0), own), back, first, left, right

    def strings(self, mixed: np.ndarray):
        """Starts and hashes, piece by piece in order, of the strings whose lowest gram is of mixed neighbourhoods."""
        for (own, upto), begin, sums, lowest, *_ in self.slices() if len(mixed) else ():
            turn = np.flatnonzero(np.diff(lowest, prepend=np.uint64(0), append=np.uint64(0)))
            value = lowest[turn[:-1]]
            key = B.mix(value)
            at = np.minimum(np.searchsorted(mixed, key), len(mixed) - 1)
            hit = (mixed[at] == key) & (value > 0)
            n = np.diff(turn)[hit]
            start = np.repeat(turn[:-1][hit] - np.cumsum(n) + n, n) + np.arange(n.sum())
            start = start[(begin + start >= own) & (begin + start < upto)]
            if len(start):
                yield begin + start, B.span_hash(sums, start, start + self.length)

    def string_keys(self, mixed: np.ndarray) -> np.ndarray:
        """The sorted distinct hashes of `strings`."""
        keys = np.concatenate([np.zeros(0, np.uint64), *(np.unique(hashes) for _, hashes in self.strings(mixed))])
        keys.sort()
        fresh = np.ones(len(keys), bool)
        np.not_equal(keys[1:], keys[:-1], out=fresh[1:])
        return keys[fresh]

    def repeated_strings(self, mixed: np.ndarray, keys: np.ndarray, earlier: np.ndarray):
        """Starts, piece by piece, of the strings that start earlier: in an earlier batch, as told of each of string_keys, or in this one."""
        seen = earlier.copy()
        for start, hashes in self.strings(mixed):
            own, first, back = np.unique(hashes, return_index=True, return_inverse=True)
            at = np.searchsorted(keys, own)
            gone = seen[at][back] | (first[back] != np.arange(len(back)))
            seen[at] = True
            yield start[gone]

    def runs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Maximal runs of bytes that these spans cover, none over a document's end."""
        order = np.argsort(left, kind="stable")
        left, right = left[order], np.maximum.accumulate(right[order])
        row = np.searchsorted(self.offsets, left, "right")
        fresh = (left[1:] > right[:-1]) | (row[1:] != row[:-1])
        edge = np.ones(min(1, len(left)), bool)
        return left[np.concatenate([edge, fresh])], right[np.concatenate([fresh, edge])]


def find_repeats(docs: DataFrame, length: int = 100, gram: int = 32, chunks: int | None = None, carry: list[str] | None = None, direct: int | None = None, then: tuple[Callable[[pa.Table], pa.Table], T.StructType] | None = None) -> DataFrame:
    """doc_id, text, spans (array of start and end of each removed run of bytes), kept (the other bytes) and the columns carry of every row.

    then: a function of a chunk's rows of this form and the schema of what it makes
    of them. It runs in the task that has them; an Arrow UDF over the result would
    hold a second Python worker beside each task's.
    """
    if gram >= length:
        raise ValueError("gram must be below length")
    own = docs.select("doc_id", "text", *(carry or []))
    exchange = X.Exchange.of(chunks or X.parts(own), direct)
    placed = X.by_range(own, exchange.chunks)

    def ask_suffixes(key, table):
        keys, around, *_ = Chunk(table, length, gram).suffixes()
        return exchange.asked(key[0].as_py(), keys, around)

    def ask_strings(key, table, said):
        chunk = Chunk(table, length, gram)
        keys = chunk.suffixes()[0]
        return exchange.asked(key[0].as_py(), chunk.string_keys(keys[X.answered(said, np.uint8) == MIXED]))

    def settle(key, table, said):
        which = np.array(said["round"].to_pylist())
        chunk = Chunk(table, length, gram)
        keys, _, back, first, left, right = chunk.suffixes()
        verdict = X.answered(said.filter(pa.array(which == 1)), np.uint8)
        gone = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        if len(keys):
            told = verdict[back]
            repeat = (told == EARLIER) | ((told == KEPT) & (first[back] != np.arange(len(back))))
            repeat &= right - left >= length
            gone.append(chunk.runs(left[repeat], right[repeat]))
            mixed = keys[verdict == MIXED]
            del told, repeat, keys, back, first, left, right
            distinct = chunk.string_keys(mixed)
            earlier = X.answered(said.filter(pa.array(which == 2)), np.uint8) == EARLIER
            gone.extend(chunk.runs(start, start + length) for start in chunk.repeated_strings(mixed, distinct, earlier))
        left, right = chunk.runs(*(np.concatenate(x) for x in zip(*gone, strict=True)))
        cuts = np.searchsorted(left, chunk.offsets)
        spans, kept = [], []
        for i, j, a, b in zip(chunk.offsets[:-1], chunk.offsets[1:], cuts[:-1], cuts[1:], strict=True):
            spans.append((np.stack([left[a:b], right[a:b]], axis=1) - i).tolist())
            stays = zip([i, *right[a:b]], [*left[a:b], j], strict=True)
            kept.append(b"".join(chunk.data[x:y].tobytes() for x, y in stays))
        out = chunk.table.select(columns)
        out = out.append_column("spans", pa.array(spans, pa.list_(pa.list_(pa.int32())))).append_column("kept", pa.array(kept, pa.binary()))
        return then[0](out) if then else out

    columns = own.columns
    schema = T.StructType([*own.schema.fields, T.StructField("spans", T.ArrayType(T.ArrayType(T.IntegerType()))), T.StructField("kept", T.BinaryType())])
    first, _ = exchange.ask(placed.groupBy("chunk").applyInArrow(tidily(ask_suffixes), X.ASKED), _bucket, np.uint64)
    again = placed.groupBy("chunk").cogroup(first.groupBy("chunk")).applyInArrow(tidily(ask_strings, 2), X.ASKED)
    both = first.withColumn("round", F.lit(1)).unionByName(exchange.ask(again, _bucket)[0].withColumn("round", F.lit(2)))
    return placed.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInArrow(tidily(settle, 2), then[1] if then else schema)


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of `find_repeats`."""
    length = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return found.select(
        "doc_id",
        length.alias("n_bytes"),
        (length - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2(F.col("kept"), 256).alias("kept_sha256"),
    )


def brute_force(rows: list[tuple[int, str | None]], length: int = 100) -> list[tuple]:
    """The rule read literally, for tests: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    seen: set[bytes] = set()
    out = []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is None, r[1] or "")):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            piece = raw[i : i + length]
            if piece in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(piece)
        kept = bytes(x for x, g in zip(raw, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((doc, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out
