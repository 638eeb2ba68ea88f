"""Token counts of whole texts, huge documents in overlapping chunks that are spliced where nothing can cross.

A text of up to `size` bytes is encoded as it is. A longer one is cut every `size`
bytes; a chunk also holds the next `overlap` bytes, so both neighbours encode the
overlap, each with the offsets of its tokens. They are spliced at the first place
of the overlap that is proven stable: a merge makes a piece of the vocabulary, so
a place that no piece found in the text spans is an end of a token whatever
stands further away, and what lies left and right of it is encoded as in the
whole text. Both neighbours must have that place among their own tokens' ends. A
document of which any border fails is cut again with an overlap 16 times as wide,
until one chunk holds it.

On Spark: chunks go one row each to tasks by digest of the text and place, so a
huge document is spread over the cluster and its copies are encoded once; what
comes back is three numbers a chunk. Memory is bound by the chunk, but for a
document without any stable place (a run of one letter, say): the last resort
encodes it whole.

Defined cases: null or empty text: no bytes, no tokens; repeated rows count each
alike; a null doc_id is kept; other columns are ignored; an empty table gives no
rows.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import durable, short_batches

#: Bytes of a chunk, and of the first overlap.
SIZE, OVERLAP = 1 << 16, 1 << 8
WIDER = 16
#: Bytes of short texts that are encoded in one call.
_CALL = 1 << 20
_SPACE = "▁"  # the library writes a space as this letter


class Vocabulary:
    """A byte-fallback BPE model of the sentencepiece library that changes nothing of a text but its spaces."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(m.get_piece_size())
        merged = [i for i in ids if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))]
        self.pieces = {m.id_to_piece(i).encode() for i in merged}
        self.longest = max(map(len, self.pieces))
        self.bytes = np.array([1 if m.is_byte(i) else len(m.id_to_piece(i).encode()) for i in ids])
        letters = set("".join(m.id_to_piece(i) for i in merged))
        self.stop = next(chr(c) for c in range(1, 128) if chr(c) not in letters)  # no piece holds it, so none crosses it
        if m.normalize(f"A  Åﬁ {self.stop}") != f"{_SPACE}A{_SPACE * 2}Åﬁ{_SPACE}{self.stop}" or not any(map(m.is_byte, ids)):
            raise ValueError("a vocabulary with byte fallback and without normalisation is needed")
        self.lead = len(m.encode(self.stop))

    def stable(self, data: bytes, at: int) -> bool:
        """Is at the end of a character that no piece found in data spans?"""
        if at < len(data) and data[at] & 0xC0 == 0x80:
            return False
        most = self.longest
        return not any(data[i:j] in self.pieces for i in range(max(0, at - most + 1), at) for j in range(at + 1, min(len(data), i + most) + 1))

    def first_stable(self, data: bytes, start: int, stop: int) -> int:
        """The first stable place of [start, stop), or -1."""
        return next((at for at in range(start, min(stop, len(data))) if self.stable(data, at)), -1)

    def ends(self, data: bytes) -> np.ndarray:
        """Where each token of a stretch from inside a text ends."""
        ids = self.model.encode(self.stop + data.decode())[self.lead :]
        return np.cumsum(self.bytes[ids])


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def cuts(n: int, size: int, overlap: int) -> list[int]:
    """Where chunks of n bytes begin; the last one is not shorter than its overlap."""
    return [0, *(s for s in range(size, n, size) if s + overlap < n)]


def windows(data: bytes, size: int, overlap: int, margin: int):
    """(place, begin, end, window, lead) of each chunk: its part begin..end, what it sees of data, and how many bytes that is before begin."""
    starts = cuts(len(data), size, overlap)
    for k, begin in enumerate(starts):
        end = starts[k + 1] if k + 1 < len(starts) else len(data)
        first = max(0, begin - margin)
        while first and data[first] & 0xC0 == 0x80:
            first -= 1
        last = min(len(data), end + overlap + margin) if k + 1 < len(starts) else len(data)
        while last < len(data) and data[last] & 0xC0 == 0x80:
            last += 1
        yield k, begin, end, data[first:last], begin - first


def count_chunk(v: Vocabulary, window: bytes, lead: int, length: int, overlap: int, first: bool, last: bool) -> tuple[int, int, int]:
    """(left, right, tokens): the splices as bytes behind the chunk's two borders and the tokens between; -1 for a border without one."""
    ends = v.ends(window)
    left = 0 if first else v.first_stable(window, lead, lead + overlap) - lead
    right = len(window) - lead - length if last else v.first_stable(window, lead + length, lead + length + overlap) - lead - length
    if left < 0 or right < 0:
        return (left if left >= 0 else -1), (right if right >= 0 else -1), 0
    places = [0 if first else int(np.searchsorted(ends, lead + left)), int(np.searchsorted(ends, lead + length + right))]
    at = [lead + left if not first else None, lead + length + right]
    for p, k in zip(at, places, strict=True):
        if p is not None and (k >= len(ends) or ends[k] != p):  # not an end of its own tokens
            return -1, -1, 0
    return left, right, places[1] + 1 - (0 if first else places[0] + 1)


def count_tokens(docs: DataFrame, path: str, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row of docs (doc_id, text)."""
    short_batches(docs.sparkSession)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = F.octet_length("text")

    def count_short(batches):
        v = vocabulary(path)
        for batch in batches:
            texts, counts, i = batch["text"].to_pylist(), [], 0
            while i < len(texts):
                j, held = i, 0
                while j < len(texts) and (j == i or held + len(texts[j]) <= _CALL):
                    held += len(texts[j])
                    j += 1
                counts += [len(ids) for ids in v.model.encode(texts[i:j], num_threads=1)]
                i = j
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_bytes"], pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), n.cast("long").alias("n_bytes"), "text")
    short = rows.where(n <= size).mapInArrow(count_short, "doc_id long, n_bytes long, n_tokens long")
    long = rows.where(n > size).withColumn("digest", F.sha2("text", 256))
    counted = _count_long(long.select("digest", "text"), path, size, overlap)
    return short.unionByName(long.drop("text").join(counted, "digest").select("doc_id", "n_bytes", "n_tokens"))


_CHUNK = "digest string, place long, length long, lead long, first boolean, last boolean, window binary"


def _count_long(texts: DataFrame, path: str, size: int, overlap: int) -> DataFrame:
    """(digest, n_tokens) of texts that take several chunks."""
    done = None
    while True:
        spliced = durable(_splice(texts, path, size, overlap))
        good = spliced.where("aligned").select("digest", "n_tokens")
        done = good if done is None else done.unionByName(good)
        failed = spliced.where("not aligned").select("digest")
        if failed.isEmpty():
            return done
        texts, overlap = durable(texts.join(failed, "digest", "left_semi")), overlap * WIDER


def _splice(texts: DataFrame, path: str, size: int, overlap: int) -> DataFrame:
    """(digest, n_tokens, aligned): the sum over a text's chunks, and whether all its borders have one splice."""

    def cut(batches):
        margin, schema = vocabulary(path).longest, None
        for batch in batches:
            for digest, text in zip(batch["digest"].to_pylist(), batch["text"].to_pylist(), strict=True):
                data = (_SPACE + text.replace(" ", _SPACE)).encode()  # as the library begins a text
                n = len(cuts(len(data), size, overlap))
                for k, begin, end, window, lead in windows(data, size, overlap, margin):
                    row = {"digest": digest, "place": k, "length": end - begin, "lead": lead, "first": k == 0, "last": k == n - 1, "window": window}
                    out = pa.RecordBatch.from_pylist([row], schema)
                    schema = schema or out.schema
                    yield out

    def count(batches):
        v = vocabulary(path)
        for batch in batches:
            told = [count_chunk(v, r["window"], r["lead"], r["length"], overlap, r["first"], r["last"]) for r in batch.select(["window", "lead", "length", "first", "last"]).to_pylist()]
            left, right, tokens = (pa.array(x, pa.int64()) for x in zip(*told, strict=True)) if told else (pa.array([], pa.int64()),) * 3
            yield pa.RecordBatch.from_arrays([batch["digest"], batch["place"], batch["first"], batch["last"], left, right, tokens], ["digest", "place", "first", "last", "left", "right", "tokens"])

    chunks = texts.mapInArrow(cut, _CHUNK)
    once = chunks.groupBy("digest", "place").agg(*[F.any_value(c).alias(c) for c in ("length", "lead", "first", "last", "window")])  # copies once
    told = once.mapInArrow(count, "digest string, place long, first boolean, last boolean, left long, right long, tokens long")
    # a border k lies before chunk k: told by chunk k as its left one and by chunk k - 1 as its right one
    borders = F.array(F.struct(F.col("place").alias("k"), F.col("left").alias("at"), F.col("tokens")), F.struct((F.col("place") + 1).alias("k"), F.col("right").alias("at"), F.lit(0).cast("long").alias("tokens")))
    sides = told.select("digest", F.explode(borders).alias("b"), "first", "last", "place").select("digest", "b.*", (F.col("first") & (F.col("b.k") == 0)).alias("begin"), (F.col("last") & (F.col("b.k") > F.col("place"))).alias("finish"))
    each = sides.groupBy("digest", "k").agg(F.sum("tokens").alias("tokens"), (F.max(F.col("begin") | F.col("finish")) | ((F.min("at") == F.max("at")) & (F.min("at") >= 0) & (F.count("*") == 2))).alias("good"))
    return each.groupBy("digest").agg(F.sum("tokens").alias("n_tokens"), F.bool_and("good").alias("aligned"))


def digest(counted: DataFrame, limit: int = 4096) -> DataFrame:
    """The contract's columns."""
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
