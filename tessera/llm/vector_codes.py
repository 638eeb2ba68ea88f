"""Codes of vectors: one entry number a part, from codebooks fitted by Lloyd rounds with Yinyang bounds.

Each component x becomes floor(scale * x); a vector is cut into equal parts, and
each part's codebook starts as that part of the first `entries` vectors by id.
A round gives every part its nearest entry (squared Euclidean distance, ties to
the lower number) and then moves each entry to floor(mean) of its parts.

Yinyang: entries are clustered into groups. A part keeps one upper bound on the
distance to its entry and one lower bound a group on that to the group's other
entries; when entries move, bounds drift by as much. A group is scanned only if
its bound does not prove every entry of it farther than the part's own. Bounds are
rounded outwards, and whatever is scanned is compared as integers, so results
equal a full search.

On Spark: a round is one pass over the vectors, which carry their bounds as
binary columns; the same pass adds up each task's parts by entry, so what is
shuffled is one row an entry and task, and what the driver holds is the
codebooks, entries x components numbers. Passes end in the shared folder.

Defined cases: vectors that are null or hold a null, NaN or infinite component
are dropped; shorter vectors count as followed by zeros up to the longest, and
that up to a multiple of the parts; a null vec_id comes last among initial
entries, equal ids go by their vectors; fewer vectors than entries make that many
entries; repeated rows count each; components beyond LARGEST in size are an error, as
their squared errors would not fit 64 bits; other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import durable

#: The largest integer component.
LARGEST = 1 << 26
_DOWN, _UP = 1 - 1e-12, 1 + 1e-12


def integer_vectors(rows: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, label, v): the kept rows' integer components."""
    label = F.col("label") if "label" in rows.columns else F.lit(None).cast("int").alias("label")
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    return rows.where(F.col("embedding").isNotNull() & finite).select("vec_id", label, F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def grouped(book: np.ndarray, groups: int, rounds: int = 5) -> np.ndarray:
    """The group of each of a codebook's entries: a few rounds of k-means over the entries."""
    x = book.astype(float)
    centre = x[np.linspace(0, len(x) - 1, min(groups, len(x))).astype(int)]
    for _ in range(rounds):
        of = ((x[:, None] - centre[None]) ** 2).sum(2).argmin(1)
        centre = np.stack([x[of == g].mean(0) if (of == g).any() else centre[g] for g in range(len(centre))])
    return ((x[:, None] - centre[None]) ** 2).sum(2).argmin(1)


def squares(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows to entries."""
    most = int(max(np.abs(x).max(initial=0), np.abs(book).max(initial=0)))
    if 4 * most * most * x.shape[1] < 1 << 53:  # every product and sum is exact in floating point
        a, b = x.astype(float), book.astype(float)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None]).astype(np.int64)
    out = np.zeros((len(x), len(book)), np.int64)
    for k in range(x.shape[1]):
        out += (x[:, k, None] - book[None, :, k]) ** 2
    return out


def own_square(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    d = x - entries
    return (d * d).sum(1)


class Part:
    """One codebook, its groups, and how far its entries moved since the bounds were made."""

    def __init__(self, book: np.ndarray, group: np.ndarray, before: np.ndarray | None = None) -> None:
        self.book, self.group = book, group
        self.members = [np.flatnonzero(group == g) for g in range(group.max() + 1)]
        moved = np.sqrt(own_square(book, before).astype(float)) * _UP if before is not None else np.zeros(len(book))
        self.moved, self.drift = moved, np.array([moved[m].max(initial=0.0) for m in self.members])

    def assign(self, x: np.ndarray, own: np.ndarray, lower: np.ndarray, first: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """New entries, their squared distances, new lower bounds (a row a part, a column a group) and how many groups were scanned."""
        n = len(x)
        if first:
            own, lower = np.zeros(n, np.int64), np.full((n, len(self.members)), -1.0)
        else:
            lower = (lower - self.drift) * _DOWN - 1e-9
        best = own_square(x, self.book[own])  # tightens the upper bound at once: exact
        entry, upper = own.copy(), np.sqrt(best.astype(float)) * _UP + 1e-9
        open_ = lower <= upper[:, None]
        scanned = int(open_.sum())
        runner = lower.copy()
        for g, members in enumerate(self.members):
            at = np.flatnonzero(open_[:, g])
            if not len(at) or not len(members):
                continue
            d = squares(x[at], self.book[members])
            near = d.argmin(1)  # members rise, so the first is the lowest number
            least, which = d[np.arange(len(at)), near], members[near]
            better = (least < best[at]) | ((least == best[at]) & (which < entry[at]))
            # the lower bound of a group is over entries other than the part's own
            others = d.copy()
            mine = np.searchsorted(members, own[at])
            held = (mine < len(members)) & (members[np.minimum(mine, len(members) - 1)] == own[at])
            others[np.flatnonzero(held), mine[held]] = np.iinfo(np.int64).max
            runner[at, g] = np.sqrt(others.min(1).astype(float)) * _DOWN
            best[at[better]], entry[at[better]] = least[better], which[better]
        changed = np.flatnonzero(entry != own)
        if len(changed):
            # the entry that was left is now one of its group's others; the new entry leaves its own
            left = np.sqrt(own_square(x[changed], self.book[own[changed]]).astype(float)) * _DOWN
            g = self.group[own[changed]]
            runner[changed, g] = np.minimum(runner[changed, g], left)
            for g, members in enumerate(self.members):
                at = changed[self.group[entry[changed]] == g]
                if len(at):
                    d = squares(x[at], self.book[members])
                    d[np.arange(len(at)), np.searchsorted(members, entry[at])] = np.iinfo(np.int64).max
                    runner[at, g] = np.sqrt(d.min(1).astype(float)) * _DOWN
        return entry, best, runner, scanned


def _matrix(column, width: int, kind) -> np.ndarray:
    """An Arrow column of equally long binaries as a matrix."""
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, kind).reshape(len(column), width)


def _binaries(x: np.ndarray) -> pa.Array:
    x = np.ascontiguousarray(x)
    size = x.itemsize * x.shape[1]
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(size), len(x), [None, pa.py_buffer(x.tobytes())]).cast(pa.binary())


_STATE = "vec_id long, label {label}, v array<long>, own binary, lower binary, error long, book int, entry int, n long, sums array<long>, scanned long"


def _pass(rows: DataFrame, parts: list[Part], first: bool, label: str) -> DataFrame:
    """Rows with new state, and one row an entry of each book and task with its count and sums; both in the shared folder."""
    width, groups = parts[0].book.shape[1], [len(p.members) for p in parts]
    names = ["vec_id", "label", "v", "own", "lower", "error", "book", "entry", "n", "sums", "scanned"]

    def run(batches):
        n = [np.zeros(len(p.book), np.int64) for p in parts]
        sums = [np.zeros(p.book.shape, np.int64) for p in parts]
        scanned, kinds = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            size = batch.num_rows
            v = batch["v"].flatten().to_numpy(zero_copy_only=False).reshape(size, -1)
            own = _matrix(batch["own"], len(parts), "u1") if not first else None
            lower = _matrix(batch["lower"], sum(groups), "<f4") if not first else None
            new, bounds, error, at = [], [], np.zeros(size, np.int64), 0
            for k, p in enumerate(parts):
                x = v[:, k * width : (k + 1) * width]
                entry, best, low, seen = p.assign(x, own[:, k].astype(np.int64) if own is not None else None, lower[:, at : at + groups[k]].astype(float) if lower is not None else None, first)
                at += groups[k]
                scanned += seen
                n[k] += np.bincount(entry, minlength=len(p.book))
                order = np.argsort(entry, kind="stable")
                begin = np.flatnonzero(np.diff(entry[order], prepend=-1))
                sums[k][entry[order][begin]] += np.add.reduceat(x[order], begin, axis=0)
                error += best
                new.append(entry)
                bounds.append(low)
            low = np.concatenate(bounds, axis=1)
            low = np.nextafter(low.astype(np.float32), np.float32(-np.inf))
            kinds = batch.schema
            blank = [pa.nulls(size, t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.int64())]
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["label"], batch["v"], _binaries(np.stack(new, 1).astype("u1")), _binaries(low.astype("<f4")), pa.array(error), *blank], names)
        if kinds is not None:
            told = [(k, e, int(c), s.tolist()) for k in range(len(parts)) for e, (c, s) in enumerate(zip(n[k], sums[k], strict=True)) if c]
            book, entry, count, total = zip(*told, strict=True)
            empty = [pa.nulls(len(told), t) for t in (kinds.field("vec_id").type, kinds.field("label").type, kinds.field("v").type, pa.binary(), pa.binary(), pa.int64())]
            seen = pa.array([scanned] + [0] * (len(told) - 1), pa.int64())
            yield pa.RecordBatch.from_arrays([*empty, pa.array(book, pa.int32()), pa.array(entry, pa.int32()), pa.array(count, pa.int64()), pa.array(total, pa.list_(pa.int64())), seen], names)

    columns = ["vec_id", "label", "v"] + ([] if first else ["own", "lower"])
    return durable(rows.select(columns).mapInArrow(run, _STATE.format(label=label)))


def encode_vectors(rows: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, groups: int = 16, scale: int = 1024) -> tuple[DataFrame, list[np.ndarray], list[int]]:
    """(vec_id, label, code (binary, one byte a part), error), the final codebooks, and the groups scanned in each pass.

    rows: vec_id, embedding, label. entries is 256 at most.
    """
    if not 1 <= entries <= 256 or parts < 1:
        raise ValueError("a part has 1 to 256 entries")
    vectors = integer_vectors(rows, scale)
    known = vectors.agg(F.max(F.size("v")).alias("d"), F.max(F.aggregate("v", F.lit(0).cast("long"), lambda a, x: F.greatest(a, F.abs(x)))).alias("most")).first()
    label = vectors.schema["label"].dataType.simpleString()
    if known["d"] is None:
        return vectors.select("vec_id", "label", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error")), [], []
    if known["most"] > LARGEST:
        raise ValueError(f"components beyond {LARGEST} in size")
    width = max(1, -(-known["d"] // parts))
    vectors = vectors.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(parts * width) - F.size("v")))).withColumn("vec_id", F.col("vec_id").cast("long"))
    start = np.array([r["v"] for r in vectors.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).collect()], np.int64)
    books = [start[:, k * width : (k + 1) * width] for k in range(parts)]
    group = [grouped(b, groups) for b in books]
    now = [Part(b, g) for b, g in zip(books, group, strict=True)]
    state, scans = vectors, []
    for turn in range(rounds + 1):
        done = _pass(state, now, turn == 0, label)
        told = done.where("book is not null").groupBy("book", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(width)], F.sum("scanned").alias("scanned")).collect()  # a row an entry
        state = done.where("book is null")
        scans.append(sum(r["scanned"] for r in told))
        if turn < rounds:
            moved = [b.copy() for b in books]
            for r in told:
                moved[r["book"]][r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(width)]
            now = [Part(m, g, b) for m, g, b in zip(moved, group, books, strict=True)]
            books = moved
    return state.select("vec_id", "label", F.col("own").alias("code"), "error"), books, scans


def with_label_errors(coded: DataFrame) -> DataFrame:
    """Adds label_error, the error summed over equal labels. Sums of labels of over a thousandth of all rows (1,000 at most) are broadcast."""
    sums = durable(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")).withColumnRenamed("label", "_label"))
    total = sums.agg(F.sum("n")).first()[0] or 0
    same = F.col("label").eqNullSafe(F.col("_label"))
    often, rare = sums.where(F.col("n") * 1000 > total).drop("n"), sums.where(F.col("n") * 1000 <= total).drop("n")
    first = coded.join(F.broadcast(often), same, "left").drop("_label")
    if rare.isEmpty():
        return first
    done, rest = first.where("label_error is not null"), first.where("label_error is null").drop("label_error")
    return done.unionByName(rest.join(rare, same).drop("_label"))


def digest(rows: DataFrame) -> DataFrame:
    """The contract's columns."""
    coded, books, _ = encode_vectors(rows)
    sha = hashlib.sha256(",".join(str(x) for b in books for x in b.reshape(-1)).encode()).hexdigest()
    return with_label_errors(coded).select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(sha).alias("codebooks_sha256"))


def _assign_sql(turn: int) -> str:
    return f"""near{turn} AS (SELECT x.r, x.part, arg_min(b.entry, (x.xx - 2 * list_dot_product(x.p, b.c) + b.cc, b.entry)) AS entry, min(x.xx - 2 * list_dot_product(x.p, b.c) + b.cc) AS d
  FROM parts x JOIN book{turn} b ON x.part = b.part GROUP BY 1, 2)"""


def _update_sql(turn: int) -> str:
    return f"""sums{turn} AS (SELECT part, entry, pos, floor(sum(x) / count(*)) AS c FROM (SELECT n.part, n.entry, unnest(p.p) AS x, generate_subscripts(p.p, 1) AS pos FROM near{turn} n JOIN parts p ON p.r = n.r AND p.part = n.part) GROUP BY 1, 2, 3),
moved{turn} AS (SELECT part, entry, list(c ORDER BY pos) AS c FROM sums{turn} GROUP BY 1, 2),
book{turn + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.c, b.c) AS c, list_dot_product(coalesce(m.c, b.c), coalesce(m.c, b.c)) AS cc FROM book{turn} b LEFT JOIN moved{turn} m ON m.part = b.part AND m.entry = b.entry)"""


#: Doubles hold these integers exactly.
ORACLE_SQL = f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
numbered AS (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS r FROM kept),
parts AS MATERIALIZED (SELECT r, part, v[part * len(v) // 4 + 1 : (part + 1) * len(v) // 4] AS p, list_dot_product(p, p) AS xx FROM numbered, (SELECT unnest(range(4)) AS part)),
book0 AS MATERIALIZED (SELECT part, r - 1 AS entry, p AS c, xx AS cc FROM parts WHERE r <= 256),
{", ".join(f"{_assign_sql(t)}, {_update_sql(t)}" for t in range(4))}, {_assign_sql(4)},
told AS (SELECT string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, pos) AS t FROM (SELECT part, entry, unnest(c) AS x, generate_subscripts(c, 1) AS pos FROM book4)),
coded AS (SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM near4 GROUP BY 1)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(t) FROM told) AS codebooks_sha256 FROM coded JOIN numbered USING (r)
"""
