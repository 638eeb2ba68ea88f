"""How far the word use of sources lies from that of other sources and of their language.

Terms are runs of letters A-Z (lower-cased) and of characters beyond ASCII. Each
lang keeps the terms of at least `least` of its documents. With V kept terms, a
source's count c of a term and N, the sum of its counts, give
p = 1 + floor(10^9 (c + 2) / (N + 2 V)); f(p, q) = floor((p - q)^2 / (p + q)).

A term of few documents must not be shuffled only to be dropped. So a first pass
adds document frequencies of (lang, term) into a count-min sketch a task; sketches
are merged cell by cell, saturating at `least`. A cell never holds less than any
of its terms has, so a term with a cell below `least` is impossible, and the
second pass drops it before anything is shuffled. The others are counted exactly,
by their text, and those still below `least` go. The merged sketch is one bit a
cell: depth x width / 8 bytes (1 MB) for the largest width, which is the bound of what
is sent to tasks. A sketch that is too small for a corpus lets more pass; results
stay the same.

Pairs: most terms of two sources of a lang are missing in one of them, where the
count is 0 and p is one number a source. So the sum over all kept terms is V times
f of both zeros, plus what each side's own terms add to that against the other's
zero (from a histogram of its counts), plus a correction for terms that both have,
the only part that joins terms.

Defined cases: null text, lang and source are empty texts; a source without terms
has N = 0 and zeros only; a lang without kept terms gives pairs of value 0;
repeated rows count each; doc_id is not used; other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import durable, short_batches

DEPTH = 4
#: Cells a row of the sketch: as many as the input has bytes of text for 64, within these bounds.
LEAST_WIDTH, MOST_WIDTH = 1 << 14, 1 << 21
#: Distinct terms that a task holds before it lets go of them.
HELD = 200_000
_BLOCKS = 32
_LETTERS = bytes((c + 32 if 65 <= c <= 90 else c) if 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: str) -> list[bytes]:
    """The terms of a text, in order."""
    return text.encode().translate(_LETTERS).split()


def cells_of(lang: str, terms: list[bytes], width: int) -> np.ndarray:
    """The sketch's cells, a row a hash, of terms in a lang."""
    seed = xxhash.xxh64_intdigest(lang.encode())
    h = np.fromiter((xxhash.xxh64_intdigest(t, seed) for t in terms), np.uint64, len(terms))
    step = (h >> np.uint64(32)) | np.uint64(1)
    return np.stack([((h + np.uint64(d) * step) % np.uint64(width)).astype(np.int64) + d * width for d in range(DEPTH)])


def _documents(batch):
    return zip(batch["lang"].to_pylist(), batch["source"].to_pylist(), batch["text"].to_pylist(), strict=True)


def sketch(docs: DataFrame, least: int, width: int) -> np.ndarray:
    """One bit a cell: can a term of the cell be in `least` documents of its lang? docs: lang, source, text without nulls."""

    def count(batches):
        cells, held, n = np.zeros(DEPTH * width, np.uint8), {}, 0

        def settle():
            for lang, df in held.items():
                at = cells_of(lang, list(df), width)
                often = np.minimum(np.fromiter(df.values(), np.int64, len(df)), least)
                for row in at:
                    total = np.bincount(row, often, 0)
                    there = np.flatnonzero(total)
                    cells[there] = np.minimum(cells[there] + total[there], least).astype(np.uint8)

        for batch in batches:
            for lang, _, text in _documents(batch):
                df = held.setdefault(lang, Counter())
                n -= len(df)
                df.update(set(terms_of(text)))
                n += len(df)
                if n > HELD:
                    settle()
                    held, n = {}, 0
        settle()
        for k, block in enumerate(np.split(cells, _BLOCKS)):
            if block.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zstandard.ZstdCompressor(level=1).compress(block.tobytes())], pa.binary())], ["block", "cells"])

    def merge(key: tuple[pa.Scalar, ...], tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(DEPTH * width // _BLOCKS, np.uint8)
        for table in tables:
            for raw in table["cells"].to_pylist():
                total = np.minimum(total.astype(np.uint16) + np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8), least).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([np.packbits(total >= least).tobytes()], pa.binary())], ["block", "cells"])

    found = {r["block"]: r["cells"] for r in docs.mapInArrow(count, "block int, cells binary").groupBy("block").applyInArrow(merge, "block int, cells binary").collect()}
    empty = bytes(DEPTH * width // _BLOCKS // 8)
    return np.frombuffer(b"".join(found.get(k, empty) for k in range(_BLOCKS)), np.uint8)


def possible(bits: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Which terms have no cell that rules them out."""
    return ((bits[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1).all(axis=0)


def survivors(docs: DataFrame, bits: np.ndarray, width: int) -> DataFrame:
    """(lang, source, term, n, df), summed up in tasks, of terms that the sketch does not rule out."""

    def count(batches):
        held, n = {}, 0

        def told():
            for (lang, source), (total, df) in held.items():
                terms = list(total)
                keep = np.flatnonzero(possible(bits, cells_of(lang, terms, width))) if terms else []
                for i in range(0, len(keep), 10_000):
                    chosen = [terms[k] for k in keep[i : i + 10_000]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(chosen), pa.string()), pa.array([source] * len(chosen), pa.string()), pa.array([t.decode() for t in chosen], pa.string()), pa.array([total[t] for t in chosen], pa.int64()), pa.array([df[t] for t in chosen], pa.int64())],
                        ["lang", "source", "term", "n", "df"],
                    )

        for batch in batches:
            for lang, source, text in _documents(batch):
                total, df = held.setdefault((lang, source), (Counter(), Counter()))
                own = terms_of(text)
                n -= len(total)
                total.update(own)  # of a list, as counts of a mapping are added by a slower loop
                df.update(set(own))
                n += len(total)
                if n > HELD:
                    yield from told()
                    held, n = {}, 0
        yield from told()

    sent = docs.mapInArrow(count, "lang string, source string, term string, n long, df long")
    return sent.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """p of a count; exact however large the counts are."""
    up = (n + 2).cast("decimal(20,0)") * F.lit(1_000_000_000).cast("decimal(10,0)")
    return F.lit(1).cast("long") + F.call_function("div", up, (total + terms * 2).cast("decimal(20,0)"))


def apart(p: Column, q: Column) -> Column:
    """f of two shares."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def divergence(docs: DataFrame, least: int = 10, top: int = 10, width: int | None = None) -> DataFrame:
    """(lang, source, part, item, value, rank): all pairs of sources of a lang, and each source's `top` terms against its lang."""
    if not 1 <= least <= 255:
        raise ValueError("least is 1 to 255")
    short_batches(docs.sparkSession)
    docs = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    if width is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        width = min(MOST_WIDTH, max(LEAST_WIDTH, 1 << (size // 64).bit_length()))
    counted = durable(survivors(docs, sketch(docs, least, width), width))
    kept = counted.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.sum("n").alias("whole")).where(F.col("df") >= least).select("lang", "term", "whole")
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("whole").alias("whole_total"))
    own = counted.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "whole")
    sums = own.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = F.lit(0).cast("long")
    groups = docs.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("total", zero).alias("total"), F.coalesce("terms", zero).alias("terms"), F.coalesce("whole_total", zero).alias("whole_total"))
    groups = durable(groups.withColumn("none", F.when(F.col("terms") > 0, share(zero, F.col("total"), F.col("terms"))).otherwise(zero)))  # a row a source
    shares = durable(own.join(groups, ["lang", "source"]).select("lang", "source", "term", "n", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), "none", share(F.col("whole"), F.col("whole_total"), F.col("terms")).alias("q")))

    a = groups.select("lang", F.col("source").alias("a"), "terms", F.col("none").alias("none_a"))
    pairs = a.join(groups.select("lang", F.col("source").alias("b"), F.col("none").alias("none_b")), "lang").where("a <> b")
    zeros = F.when(F.col("terms") > 0, apart(F.col("none_a"), F.col("none_b"))).otherwise(zero)
    pairs = pairs.withColumn("zeros", zeros)
    counts = shares.groupBy("lang", F.col("source").alias("a"), "p").agg(F.count("*").alias("often"))  # a histogram a source
    alone = counts.join(pairs, ["lang", "a"]).groupBy("lang", "a", "b").agg(F.sum(F.col("often") * (apart(F.col("p"), F.col("none_b")) - F.col("zeros"))).alias("alone"))
    left = shares.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("p"), F.col("none").alias("none_a"))
    right = shares.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("q"), F.col("none").alias("none_b"))
    p, q, u, v = (F.col(c) for c in ("p", "q", "none_a", "none_b"))
    both = left.join(right, ["lang", "term"]).where("a < b").groupBy("lang", "a", "b").agg(F.sum(apart(p, q) - apart(p, v) - apart(u, q) + apart(u, v)).alias("both"))
    flipped = lambda rows, value: rows.unionByName(rows.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), value))
    one_side = alone.select("lang", "a", "b", F.col("alone").alias("part")).unionByName(alone.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), F.col("alone").alias("part")))
    added = one_side.unionByName(flipped(both, "both").withColumnRenamed("both", "part")).groupBy("lang", "a", "b").agg(F.sum("part").alias("part"))
    told = pairs.join(added, ["lang", "a", "b"], "left").select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), (F.col("terms") * F.col("zeros") + F.coalesce("part", zero)).alias("value"))
    more = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return told.withColumn("rank", rank).unionByName(more.withColumn("rank", rank).where(F.col("rank") <= top))


_P = "1 + 1000000000::HUGEINT * ({0} + 2) // ({1} + 2 * {2})"
_F = "({0} - {1}) * ({0} - {1}) // ({0} + {1})"
ORACLE_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
words AS (SELECT d, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM docs),
kept AS MATERIALIZED (SELECT lang, term, CAST(count(*) AS HUGEINT) AS whole FROM words GROUP BY 1, 2 HAVING count(DISTINCT d) >= 10),
langs AS (SELECT lang, count(*) AS v, sum(whole) AS total FROM kept GROUP BY 1),
own AS MATERIALIZED (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM words JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
groups AS (SELECT lang, source, coalesce(total, 0) AS total FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN (SELECT lang, source, sum(n) AS total FROM own GROUP BY 1, 2) USING (lang, source)),
shares AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, coalesce(o.n, 0) AS n, {_P.format("coalesce(o.n, 0)", "g.total", "l.v")} AS p, {_P.format("k.whole", "l.total", "l.v")} AS q
  FROM groups g JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term),
sums AS (SELECT a.lang, a.source AS a, b.source AS b, sum({_F.format("a.p", "b.p")}) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.a = a.source AND s.b = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST({_F.format("p", "q")} AS BIGINT) AS value FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (FROM pairs UNION ALL FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
