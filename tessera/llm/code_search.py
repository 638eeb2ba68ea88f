"""Exact k nearest neighbours of binary codes by incremental multi-index hashing.

A code (words of 64 bits) is cut into segments of 16 bits. A code within Hamming distance
m * r + j of a query (m segments, r and j from 0) differs from it by r bits at
most in one of the first j + 1 segments, or by r - 1 in one of the others. So a search looks up, in
each segment's table, all values at radius 0, then 1 and so on, and stops as
soon as the k-th verified distance is covered.

On Spark: equal codes are one entry with its k + 1 smallest ids (a bound, as
ties go to smaller ids), so a code that a third of all rows share is one entry.
Entries are dealt by hash to shards of a bounded size, each with its own tables;
the stated query set is dealt in blocks to every shard; each shard's k best are
merged by a ranked window.

Defined cases: null or empty embeddings have no code and are left out; a shorter
code counts as followed by zeros; null ids are left out; equal distances go by id; repeated rows count as one id; a query
is not its own neighbour; fewer than k other rows: all of them; other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEGMENT = 16


def sign_code(embedding: str) -> Column:
    """Words of 64 bits; bit i of them all is set if component i is not negative (a NaN is not, a null counts as negative); null for a null or empty embedding."""

    def word(w: Column) -> Column:
        bits = F.transform(F.slice(embedding, w * 64 + 1, 64), lambda x, i: F.when(x >= 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
        return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))

    last = F.floor((F.size(embedding) - 1) / F.lit(64)).cast("int")
    return F.when(F.size(embedding) > 0, F.transform(F.sequence(F.lit(0), last), word))


def _masks(radius: int) -> np.ndarray:
    return np.array([sum(1 << b for b in c) for c in itertools.combinations(range(SEGMENT), radius)], np.int64)


class SegmentTables:
    """The segment tables of one shard's distinct codes (rows of words); weight: how many ids each code holds."""

    def __init__(self, codes: np.ndarray, weight: np.ndarray) -> None:
        self.codes, self.weight = codes, weight
        self.segments = codes.shape[1] * 64 // SEGMENT
        self.order, self.start = [], []
        for s in range(self.segments):
            value = self._segment(codes, s)
            order = np.argsort(value, kind="stable")
            self.order.append(order)
            self.start.append(np.searchsorted(value[order], np.arange((1 << SEGMENT) + 1)))
        self.masks: list[np.ndarray] = []

    @staticmethod
    def _segment(codes, s: int):
        word, shift = divmod(SEGMENT * s, 64)
        return ((codes[..., word] >> np.uint64(shift)) & np.uint64((1 << SEGMENT) - 1)).astype(np.int64)

    def _distance(self, at: np.ndarray, code: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.codes[at] ^ code).sum(axis=1, dtype=np.int64)

    def search(self, code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Entries that hold the k nearest ids, all of the last distance among them, and their distances."""
        found, m = np.zeros(len(self.codes), bool), self.segments
        tally = np.zeros(64 * self.codes.shape[1] + 1, np.int64)
        least = min(k, int(self.weight.sum()))
        for radius in range(SEGMENT + 1):
            if len(self.masks) == radius:
                self.masks.append(_masks(radius))
            for s in range(m):
                value = self._segment(code, s) ^ self.masks[radius]
                a, b = self.start[s][value], self.start[s][value + 1]
                n = b - a
                at = np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())
                near = self.order[s][at]
                near = near[~found[near]]
                found[near] = True
                np.add.at(tally, self._distance(near, code), self.weight[near])
                if tally[: m * radius + s + 1].sum() >= least:
                    at = np.flatnonzero(found)
                    distance = self._distance(at, code)
                    enough = int(np.searchsorted(np.cumsum(tally), least))
                    return at[distance <= enough], distance[distance <= enough]
        at = np.flatnonzero(found)
        return at, self._distance(at, code)


def _words(column) -> np.ndarray:
    """An Arrow column of equally long lists of words as rows of a matrix."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(lists), -1)


def top_k(rows: DataFrame, queries: Column, k: int = 10, shard_rows: int = 1 << 18, query_block: int = 1 << 14) -> DataFrame:
    """query_id, neighbour_id, distance, rank (from 1) for the rows (id, code) that queries selects, against all rows.

    A shard's entries go to each block of queries and a block's queries to each
    shard, so both are as large as a task takes; few queries make more blocks,
    up to the cluster's cores.
    """
    rows = rows.where("id is not null and code is not null").select("id", "code", queries.alias("asks"))
    words = rows.agg(F.max(F.size("code"))).first()[0] or 1
    rows = rows.withColumn("code", F.concat("code", F.array_repeat(F.lit(0).cast("long"), F.lit(words) - F.size("code")))).distinct()
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("code").orderBy("id"))).where(F.col("r") <= k + 1)
    entries = ranked.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids"))  # k + 1 ids at most
    asking = rows.where("asks").select("code", F.col("id").alias("query_id"))
    n, q = entries.count(), asking.count()
    shards, blocks = -(-n // shard_rows), max(-(-q // query_block), min(-(-q // 512), rows.sparkSession.sparkContext.defaultParallelism))
    if not n or not q:
        return asking.where("false").select("query_id", F.lit(0).cast("long").alias("neighbour_id"), F.lit(0).cast("long").alias("distance"), F.lit(0).cast("long").alias("rank"))
    deal = lambda n, salt: F.pmod(F.xxhash64("code", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    index = entries.select("code", F.size("ids").alias("held"), deal(shards, 1).alias("shard"), every(blocks).alias("block"))
    asked = asking.select("code").distinct().select(F.col("code").alias("query"), every(shards).alias("shard"), deal(blocks, 2).alias("block"))
    found_as = pa.schema([("query", pa.list_(pa.int64())), ("code", pa.list_(pa.int64())), ("distance", pa.int64())])

    def search(key, index, asked):
        if not index.num_rows or not asked.num_rows:
            return found_as.empty_table()
        codes = _words(index["code"])
        tables = SegmentTables(codes, index["held"].to_numpy().astype(np.int64))
        out = []
        for q in _words(asked["query"]):
            at, distance = tables.search(q, k + 1)
            keep = np.argsort(distance, kind="stable")
            out.append((np.broadcast_to(q, (len(at), words)), codes[at[keep]], distance[keep]))
        query, code, distance = (np.concatenate(x) for x in zip(*out, strict=True))
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1).view(np.int64)), words).cast(pa.list_(pa.int64())) for x in (query, code)]
        return pa.Table.from_arrays([*lists, pa.array(distance)], schema=found_as)

    near = index.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInArrow(search, "query array<long>, code array<long>, distance long")
    ids = near.join(entries, "code").select("query", "distance", F.explode("ids").alias("neighbour_id"))
    best = ids.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy("distance", "neighbour_id"))).where(F.col("r") <= k + 1)
    pairs = best.join(asking.withColumnRenamed("code", "query"), "query").where("neighbour_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "neighbour_id"))
    return pairs.select("query_id", "neighbour_id", "distance", rank.cast("long").alias("rank")).where(F.col("rank") <= k)


ORACLE_SQL = """
WITH codes AS (
  SELECT vec_id, CAST(array_to_string(list_transform(embedding, lambda x: CASE WHEN x >= 0 THEN '1' ELSE '0' END), '') AS BIT) AS code FROM embeddings),
pairs AS (
  SELECT q.vec_id AS query_id, d.vec_id AS neighbour_id, CAST(bit_count(xor(q.code, d.code)) AS BIGINT) AS distance
  FROM codes q JOIN codes d ON q.vec_id % 20 = 0 AND q.vec_id <> d.vec_id)
SELECT query_id, neighbour_id, distance, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS rank FROM pairs) WHERE rank <= 10
"""
