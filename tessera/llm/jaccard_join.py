"""Near-duplicate documents by a grouped prefix join over word shingles.

A document's set: its distinct ``words``-word shingles (A-Z lower-cased, words
are runs of bytes other than x20 and x09-x0D); with fewer words, the whole
sequence as one; without words, empty. Two documents link when
100 * intersection >= percent * union. Sets compare by 64-bit shingle hashes.

How it runs on Spark
* Chunks of documents ask, per distinct shingle, in how many documents of the
  whole table it occurs (`exchange`). Sets are ordered rarest first, so that a
  prefix of n - ceil(t n) + 1 shingles is enough to find every partner, and
  shingles that only one document holds need no posting at all.
* Equal sets are one class; classes of equal prefix and size are one group.
  Group pairs that share a prefix shingle are filtered by size and by the
  positions of that shingle, then expanded to members and verified.
* Big families of near copies are not expanded into all pairs: first each
  posting list is verified against two heads of like size, links are contracted
  to components, and after that only groups of different components are paired,
  filtered, expanded and verified. No link between two components is lost.
* How the sets of classes are sent depends on BROADCAST_IDS, the result does not.

Defined cases: null or empty text, or text without words: empty set, linked
with nothing, its own component. Rows of one doc_id count as documents of
their own and share the smaller of their components' ids only if they link; a
null doc_id is a component of null unless linked. Other columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from . import textbytes as B
from .components import components
from .storage import durable, swept, tidily

SETS = "doc_id long, n_shingles long, class binary, grp binary, posts array<struct<token:long,pos:int>>"
BROADCAST_IDS = 2_000_000
_ODD = np.array([pow(0xD6E8FEB86659FD93, i + 1, 1 << 64) for i in range(64)], np.uint64)


def shingle_sets(table: pa.Table, words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, offsets = B.buffer_of(table["text"])
    out: list[np.ndarray] = []
    for i, j in B.slices(offsets):
        piece = B.lowered(data[offsets[i] : offsets[j]])
        word, row = B.words_of(piece, offsets[i : j + 1] - offsets[i])
        n = len(word) - words + 1
        full = sum((word[k : n + k] * _ODD[k] for k in range(words)), np.zeros(max(n, 0), np.uint64)) if n > 0 else np.zeros(0, np.uint64)
        full = B.mix(full + np.uint64(words))
        cuts = B.runs_of(row, j - i)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b - a >= words:
                out.append(np.unique(full[a : b - words + 1]))
            elif b > a:
                out.append(B.mix((word[a:b] * _ODD[: b - a]).sum(keepdims=True) + np.uint64(b - a)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def _distinct(sets: list[np.ndarray], parts: int):
    """What a chunk asks about: its shingles' leading bits, enough of them that a bucket tells its shingles apart.

    Two shingles of equal leading bits are counted as one, which changes the order of prefixes alike everywhere.
    """
    bits = min(64, 33 + max(1, parts).bit_length())
    return np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]) & ~np.uint64((1 << (64 - bits)) - 1), return_inverse=True, return_counts=True)


def _count(runs):
    """A bucket's answer: the sum of the chunks' counts of each key."""
    _, back = np.unique(np.concatenate([r[1] for r in runs]), return_inverse=True)
    total = np.bincount(back, np.concatenate([r[2] for r in runs])).astype(np.uint32)[back]
    return np.split(total, np.cumsum([len(r[1]) for r in runs])[:-1]), None


def _fingerprint(tokens: np.ndarray, n: int) -> bytes:
    pair = [B.mix(tokens ^ np.uint64(salt)).sum(dtype=np.uint64) + np.uint64(n) for salt in (0x51ED270B7A1C3F55, 0xA24BAED4963EE407)]
    return np.array(pair, np.uint64).tobytes()


def prefix_sets(docs: DataFrame, words: int = 5, percent: int = 80, chunks: int | None = None, direct: int | None = None) -> DataFrame:
    """SETS of every row: class and group fingerprints and the prefix postings that other documents may share."""
    exchange = X.Exchange.of(chunks or X.parts(docs), direct)
    placed, n_parts = X.by_hash(docs.select("doc_id", "text"), exchange.chunks), exchange.chunks

    def ask(key, table):
        keys, _, counts = _distinct(shingle_sets(table, words), n_parts)
        return exchange.asked(key[0].as_py(), keys, counts.astype(np.uint32))

    def post(key, table, said):
        sets = shingle_sets(table, words)
        _, back, _ = _distinct(sets, n_parts)
        held = X.answered(said, np.uint32)
        rows, at = [], 0
        for doc, tokens in zip(table["doc_id"].to_pylist(), sets, strict=True):
            n = len(tokens)
            held_here = held[back[at : at + n]]
            at += n
            rarest = np.argsort(held_here, kind="stable")[: n - (percent * n + 99) // 100 + 1]
            shared = np.flatnonzero(held_here[rarest] > 1)
            posts = [{"token": t, "pos": p} for t, p in zip(tokens[rarest[shared]].view(np.int64).tolist(), shared.tolist(), strict=True)]
            rows.append((doc, n, _fingerprint(tokens, n), _fingerprint(tokens[rarest], n), posts))
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.struct([("token", pa.int64()), ("pos", pa.int32())]))]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "n_shingles", "class", "grp", "posts"])

    told, _ = exchange.ask(placed.groupBy("chunk").applyInArrow(tidily(ask), X.ASKED), _count, np.uint32)
    return placed.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(tidily(post, 2), SETS)


def _may_link(percent: int, first: bool):
    """Of two postings (n, pos; m, mpos): may their sets be similar enough, by sizes and positions?

    first: if no rarer shingle is common to both. That holds at the first common
    one of a pair that links, so a pair that fails it at all of its postings does not.
    """
    need = F.ceil(F.lit(percent) * (F.col("n") + F.col("m")) / F.lit(100.0 + percent) - 1e-9)
    before = F.lit(0) if first else F.least("pos", "mpos")
    most = before + 1 + F.least(F.col("n") - F.col("pos") - 1, F.col("m") - F.col("mpos") - 1)
    return (F.lit(100) * F.least("n", "m") >= F.lit(percent) * F.greatest("n", "m")) & (most >= need)


def _stars(posts: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) of two heads of each posting list and size tier with the others.

    One head is the set in which the shingle comes earliest: it has the fewest
    rarer shingles of its own, so it is nearest to the middle of its family.
    """
    early = F.struct("pos", "least", F.col("n").alias("m"))
    late = F.struct("least", "pos", F.col("n").alias("m"))
    heads = posts.groupBy("token", "tier").agg(F.min(early).alias("lo"), F.max(late).alias("hi")).where("lo.least <> hi.least")
    told = [F.struct(F.col(f"{h}.least").alias("head"), F.col(f"{h}.m").alias("m"), F.col(f"{h}.pos").alias("mpos")) for h in ("lo", "hi")]
    heads = heads.select("token", "tier", F.explode(F.array_distinct(F.array(*told))).alias("h")).select("token", "tier", "h.*")
    found = posts.join(heads, ["token", "tier"]).where(_may_link(percent, False) & (F.col("head") != F.col("least")))
    return found.select(F.least("head", "least").alias("u"), F.greatest("head", "least").alias("v"))


def group_pairs(posts: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (g, h) of groups of posts (grp, n, token, pos; a, b: least and greatest component) that may hold a link between components.

    A shingle of the smaller set counts only up to the place where sets of its own
    size can still link (the larger one's are all in its prefix), and only sets of
    a size in reach meet. So documents of one template that differ enough not to
    link are no candidates, although they share its shingles.
    """
    step = F.floor(F.log(F.col("n")) / F.lit(math.log(100 / percent) * (1 + 1e-9) + 1e-12))
    alike = F.ceil(F.lit(2.0 * percent) * F.col("n") / F.lit(100.0 + percent) - 1e-9)
    large = posts.select("token", step.alias("step"), F.col("grp").alias("h"), F.col("n").alias("m"), F.col("pos").alias("mpos"), F.col("a").alias("c"), F.col("b").alias("d"))
    small = posts.where(F.col("pos") <= F.col("n") - alike).select("token", F.explode(F.array(step, step + 1)).alias("step"), F.col("grp").alias("g"), "n", "pos", "a", "b")
    ordered = (F.col("n") < F.col("m")) | ((F.col("n") == F.col("m")) & (F.col("g") < F.col("h")))
    open_ = (F.least("a", "c") != F.greatest("b", "d")) & ordered
    return small.join(large, ["token", "step"]).where(open_ & _may_link(percent, True)).select("g", "h").distinct()


def _sets_of(docs: DataFrame, least: DataFrame, words: int) -> DataFrame:
    """(class, tokens) of the classes in least (class, doc_id): their sets, computed again from the texts of these documents."""
    ids = least.select(F.col("doc_id").alias("_id")).distinct()  # null is an id here: a class may have no other
    few = ids.count() <= BROADCAST_IDS  # 16 bytes each; beyond that the texts are shuffled
    texts = docs.select("doc_id", "text").join(F.broadcast(ids) if few else ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")

    def tokens(batches):
        for batch in batches:
            sets = shingle_sets(batch, words)
            yield pa.RecordBatch.from_arrays([pa.array([_fingerprint(x, len(x)) for x in sets], pa.binary()), pa.array([X.pack_sorted(x) if len(x) else None for x in sets], pa.binary())], ["class", "tokens"])

    made = texts.select("text").mapInArrow(swept(tokens), "class binary, tokens binary")
    return made.join(least.select("class"), "class", "left_semi").dropDuplicates(["class"])


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) of classes that link."""

    @F.arrow_udf("boolean")
    def linked(a: pa.Array, b: pa.Array) -> pa.Array:
        def one(x, y):
            x, y = X.unpack_sorted(x), X.unpack_sorted(y)
            both = len(np.intersect1d(x, y, assume_unique=True))
            return 100 * both >= percent * (len(x) + len(y) - both)

        return pa.array([one(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.bool_())

    left, right = sets.select(F.col("class").alias("u"), F.col("tokens").alias("a")), sets.select(F.col("class").alias("v"), F.col("tokens").alias("b"))
    return pairs.join(left, "u").join(right, "v").where(linked("a", "b")).select("u", "v")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, chunks: int | None = None, direct: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links) and class (fingerprint of the set) of every row."""
    rows = durable(prefix_sets(docs, words, percent, chunks, direct))
    held = rows.where(F.size("posts") > 0)
    members = durable(held.groupBy("class", "grp", F.col("n_shingles").alias("n")).agg(F.min("doc_id").alias("doc_id")))
    sets = durable(_sets_of(docs, members, words))
    # one posting per group, token and size tier; groups of one prefix and size hold equal postings
    heads_of = members.groupBy("grp").agg(F.min("class").alias("least"))
    posts = held.select("grp", F.col("n_shingles").alias("n"), F.explode("posts").alias("p")).select("grp", "n", "p.token", "p.pos").distinct()
    shared = posts.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token")
    posts = posts.join(shared, "token").join(heads_of, "grp").withColumn("tier", F.floor(F.log(F.col("n")) / F.lit(0.1)))
    posts = durable(posts)

    def ties(tied: DataFrame, key: str) -> DataFrame:
        return tied.select(F.col("node").alias(key), F.col("component").alias("tie"))

    # 1. stars: heads of each posting list against the others
    within = members.join(heads_of.withColumnRenamed("least", "u"), "grp").select("u", F.col("class").alias("v")).where("u <> v")
    links = durable(_verified(_stars(posts, percent).unionByName(within).distinct(), sets, percent))
    tied = components(links)

    # 2. what still spans two components: pairs of groups, filtered, then expanded to members
    named = members.join(ties(tied, "class"), "class", "left").withColumn("tie", F.coalesce("tie", "class"))
    spread = named.groupBy("grp").agg(F.min("tie").alias("a"), F.max("tie").alias("b"))
    tied_posts = posts.select("grp", "n", "token", "pos").join(spread, "grp")
    wide = tied_posts.groupBy("token").agg(F.min("a").alias("a"), F.max("b").alias("b")).where("a <> b").select("token")
    pairs = group_pairs(durable(tied_posts.join(wide, "token")), percent)
    side = lambda grp, node, tie: named.select(F.col("grp").alias(grp), F.col("class").alias(node), F.col("tie").alias(tie))
    within = spread.where("a <> b").select(F.col("grp").alias("g"), F.col("grp").alias("h"))
    spanned = pairs.unionByName(within).join(side("g", "x", "tie"), "g").join(side("h", "y", "other"), "h").where("tie <> other")
    more = durable(_verified(spanned.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct(), sets, percent))
    if not more.isEmpty():
        tied = components(tied.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more))

    whole = rows.where("n_shingles > 0").groupBy("class").agg(F.min("doc_id").alias("least"))
    whole = whole.join(tied.withColumnRenamed("node", "class"), "class", "left").withColumn("tie", F.coalesce("component", "class"))
    smallest = whole.groupBy("tie").agg(F.min("least").alias("component_id"))
    ids = whole.select("class", "tie").join(smallest, "tie").select("class", "component_id")
    empty = F.col("n_shingles") == 0
    found = rows.where(~empty).join(ids, "class").select("doc_id", "n_shingles", "component_id", "class")
    return found.unionByName(rows.where(empty).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "class"))


def brute_force(rows: list[tuple[int, str | None]], words: int = 5, percent: int = 80) -> list[tuple]:
    """The rule read literally, for tests: doc_id, n_shingles, component_id."""
    import re

    sets = []
    for _, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def top(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    holds: dict = {}
    for i, s in enumerate(sets):
        for x in s:
            holds.setdefault(x, []).append(i)
    pairs = {(a, b) for ids in holds.values() for k, a in enumerate(ids) for b in ids[k + 1 :]}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            parent[top(a)] = top(b)
    least: dict = {}
    for i, (doc, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), doc), doc)
    return [(doc, len(sets[i]), least[top(i)]) for i, (doc, _) in enumerate(rows)]
