"""Packs documents into fixed windows of tokens, lexical neighbours together.

Texts are encoded once into the shared folder. Document frequencies and the mean
length of BM25 are counted once over all documents. Documents are dealt into
shards by content: a tree of splits, learned from a sample of their BM25 vectors,
sends lexical neighbours the same way. A shard is one task's inverted index of
about SHARD_IDS ids, so their number grows with the corpus and no setting of the
session changes them; a leaf that holds more (copies of one text) is several
shards, by hash. Neighbours are those of a document's shard. In a shard
* a document is its token ids and an end id; each full window of a long
  document is a sequence of its own, the rest is a tail;
* tails get a BM25 index over their ids. The longest unused tail is the seed of
  a sequence: the index scores all unused tails that share an id with it, over
  all ids of the seed; the best fill the window greedily; a neighbour that does not fit is cut and its rest stays
  unused; with no neighbour left the next longest tail follows;
* what remains at the end (less than a window) is cut into powers of two, so
  no sequence needs padding.

Defined cases: null or empty text: the end id alone; repeated rows are packed
each; a null doc_id is kept as null; very long texts fill windows of their own;
other columns are ignored; an empty table gives no rows. Strings of special
tokens inside a text get the id that the tokenizer gives them.
"""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as B
from .storage import fresh_path, short_batches, swept, tidily

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
#: Ids of tails that a shard holds, about; what one task's index takes.
SHARD_IDS = 3 << 18
#: Of the tree that deals documents: numbers of a vector, leaves at most (beyond them a leaf is several shards), sampled documents a leaf.
DIMS, LEAVES, SAMPLE = 48, 1024, 64
#: The word pattern of byte-level BPE without prefix space, a fixed value of that pre-tokenizer.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Runs that the faster library's pattern or merging may choke on.
_LONG = re.compile(r"\s{2000}|[^\s]{2000}")
#: Bytes of text whose distinct words are encoded together; the arrays hold some forty times as many.
TEXTS_AT_ONCE = 4 << 20
#: Of a byte: 0 space, 1 letter, 2 digit, 3 other. Beyond ASCII only letters from U+00C0 to U+017F are looked at this way.
_KIND = np.full(256, 3, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KIND[48:58] = 2
_SHORT = np.zeros(1 << 16, np.uint8)  # letters of a contraction after its apostrophe, by the two bytes that follow
for _first, _then in [*((x, None) for x in b"stmd"), (b"r"[0], b"e"[0]), (b"v"[0], b"e"[0]), (b"l"[0], b"l"[0])]:
    _SHORT[_first << 8 if _then is None else _first << 8 | _then : (_first + 1 << 8) if _then is None else (_first << 8 | _then) + 1] = 1 if _then is None else 2


def word_starts(d: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Where the words of _WORDS start in texts joined to one buffer, cut at cut; texts of ASCII and of letters from U+00C0 to U+017F."""
    kind = _KIND[d]
    new = np.ones(len(d) + 3, bool)
    new[1 : len(d)] = kind[1:] != kind[:-1]
    edge = np.zeros(len(d) + 3, bool)
    edge[cut] = True
    new |= edge
    run = np.flatnonzero(new[: len(d)] & ~edge[: len(d)] & (kind > 0))
    run = run[kind[run - 1] == 0]  # behind spaces: the last one is a piece of its own or belongs to the word
    new[run - 1] = True
    new[run[d[run - 1] == 32]] = False
    mark = np.flatnonzero((d == 39) & new[: len(d)])
    mark = mark[~edge[mark + 1]]
    after = np.append(d, np.zeros(3, np.uint8)).astype(np.uint16)
    second = np.where(edge[mark + 2], 0, after[mark + 2])
    size = _SHORT[after[mark + 1] << 8 | second]
    mark, size = mark[size > 0], size[size > 0]
    new[mark + 1] = False
    new[mark + 1 + size] = True
    return np.flatnonzero(new[: len(d)])


def _ranks(told: dict) -> dict[bytes, int] | None:
    """Token ids by bytes of a byte-level BPE whose ids rise as its merges do; None for any other tokenizer."""
    model, words = told["model"], told.get("pre_tokenizer") or {}
    vocab, merges = model.get("vocab"), [m if isinstance(m, list) else m.split(" ") for m in model.get("merges", [])]
    plain = not told.get("normalizer") and not model.get("dropout") and not model.get("ignore_merges")
    if model.get("type") != "BPE" or words.get("type") != "ByteLevel" or words.get("add_prefix_space") or not words.get("use_regex", True) or not plain:
        return None
    made = [vocab[a + b] for a, b in merges]
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]  # these bytes stand for themselves, the others from 256 on
    letters = {chr(b): b for b in printed} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(printed)))}
    if any(x >= y for x, y in zip(made, made[1:])) or len(made) + 256 != len(vocab):
        return None
    return {bytes(letters[c] for c in token): i for token, i in vocab.items()}


class Encoder:
    """Token ids of a tokenizers file.

    Where the file is a byte-level BPE of rising ids, tiktoken applies the same
    vocabulary to ordinary texts about five times as fast. Texts of ASCII and of
    letters up to U+017F are cut into words some hundred texts at a time, and each
    distinct word is encoded once (words compare by 64-bit hashes). Texts with strings of
    special tokens or with runs of thousands of characters without a word end go
    through tokenizers. Tests hold the ways against each other.
    """

    def __init__(self, path: str) -> None:
        from tiktoken import Encoding

        self.path = path
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.special = [t["content"] for t in told.get("added_tokens") or []]
        ranks = _ranks(told)
        self.dtype = np.uint16 if ranks and len(ranks) + len(self.special) < 1 << 16 else np.uint32
        self.fast = Encoding("same", pat_str=_WORDS, mergeable_ranks=ranks, special_tokens={}) if ranks else None

    @cached_property
    def tokenizer(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is None or any(s in text for s in self.special) or _LONG.search(text):
            return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
        return self.fast.encode_to_numpy(text).astype(self.dtype)

    def batch(self, column) -> list[np.ndarray]:
        """Of each text of an Arrow column (null: empty)."""
        texts = column.to_pylist()
        if self.fast is None:
            return [self(t or "") for t in texts]
        data, offsets = B.buffer_of(column)
        out: list[np.ndarray] = []
        for i, j in B.slices(offsets, TEXTS_AT_ONCE):
            d, cut = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            start = word_starts(d, cut)
            other = self._other(d, cut, start)
            by_word = self._by_word(d, start, np.append(start[1:], len(d)), np.searchsorted(cut, start, "right") - 1, other)
            out += [self(texts[i + k] or "") if other[k] else ids for k, ids in enumerate(by_word)]
        return out

    def _other(self, d: np.ndarray, cut: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Which texts can't be cut by word_starts."""
        odd = (d == 0xC2) | (d > 0xC5)
        odd[1:] |= (d[:-1] == 0xC3) & ((d[1:] == 0x97) | (d[1:] == 0xB7))
        at, raw = [np.flatnonzero(odd)], d.tobytes()
        for s in self.special:
            p = raw.find(s.encode())
            while p >= 0:
                at.append(np.array([p]))
                p = raw.find(s.encode(), p + 1)
        out = np.zeros(len(cut) - 1, bool)
        out[np.searchsorted(cut, np.concatenate(at), "right") - 1] = True
        long = start[np.diff(np.append(start, len(d))) > 2000]
        out[np.searchsorted(cut, long, "right") - 1] = True
        return out

    def _by_word(self, d: np.ndarray, start: np.ndarray, end: np.ndarray, text: np.ndarray, other: np.ndarray) -> list[np.ndarray]:
        use = ~other[text]
        start, end, text = start[use], end[use], text[use]
        if not len(start):
            return [np.zeros(0, self.dtype)] * len(other)
        keys = np.empty(len(start), np.uint64)
        for i, j in B.slices(np.append(start, end[-1])):  # sums over a part at a time, as they take many times the bytes
            keys[i:j] = B.long_hash(B.prefix_sums(d[start[i] : end[j - 1]]), start[i:j] - start[i], end[i:j] - start[i])
        _, first, back = np.unique(keys, return_index=True, return_inverse=True)
        a, b = start[first], end[first]
        blank = _KIND[d[b - 1]] == 0
        # a line for each word that is not all spaces: the line's end is an id of its own and in no word
        size = np.where(blank, 0, b - a + 1)
        upto = np.cumsum(size)
        lines = np.append(d, np.uint8(10))[np.minimum(np.repeat(a - upto + size, size) + np.arange(upto[-1]), len(d))]
        lines[upto[~blank] - 1] = 10
        ids = self.fast.encode_to_numpy(lines.tobytes().decode("utf-8", "replace")).astype(self.dtype)
        ends = np.flatnonzero(ids == self.fast.encode_single_token("\n"))
        spaces = [self.fast.encode_ordinary(d[i:j].tobytes().decode()) for i, j in zip(a[blank].tolist(), b[blank].tolist(), strict=True)]
        size, at = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        at[~blank] = np.append(0, ends[:-1] + 1) if len(ends) else 0
        size[~blank] = ends - at[~blank]
        size[blank] = list(map(len, spaces))
        at[blank] = len(ids) + np.cumsum(size[blank]) - size[blank]
        flat = np.concatenate([ids, np.fromiter(chain.from_iterable(spaces), self.dtype)])
        n = size[back]
        upto = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.repeat(at[back] - upto[:-1], n) + np.arange(upto[-1])]
        return np.split(ids, upto[np.searchsorted(text, np.arange(1, len(other)))])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary file."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return _encoders.setdefault(path, Encoder(path)) if path not in _encoders else _encoders[path]


@dataclass(frozen=True)
class Corpus:
    """Counts over the tails of all documents: how many, their mean length, and in how many each token id occurs."""

    n: int
    mean: float
    df: np.ndarray

    @classmethod
    def of(cls, tails) -> Corpus:
        ids = np.concatenate([np.zeros(0, np.int64), *(np.unique(t) for t in tails)]).astype(np.int64)
        return cls(len(tails), sum(map(len, tails)) / max(1, len(tails)), np.bincount(ids))

    @cached_property
    def idf(self) -> np.ndarray:
        return np.log1p((self.n - self.df + 0.5) / (self.df + 0.5))

    def weights(self, term: np.ndarray, tf: np.ndarray, size: np.ndarray | int, k1: float = 1.2, b: float = 0.75) -> np.ndarray:
        """BM25 of ids that occur tf times in tails of the given sizes."""
        return self.idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * size / max(1.0, self.mean)))


class LexicalIndex:
    """BM25 over the tails of a shard: postings by token id, weights computed once."""

    def __init__(self, tails: list[np.ndarray], corpus: Corpus | None = None) -> None:
        n = len(tails)
        sizes = np.array([len(t) for t in tails], np.int64)
        self.most = max((int(t.max(initial=0)) for t in tails), default=0)
        pair, tf = np.unique(np.concatenate([np.zeros(0, np.int64), *tails]).astype(np.int64) * n + np.repeat(np.arange(n), sizes), return_counts=True)
        self.n, self.term, self.doc = n, pair // max(n, 1), pair % max(n, 1)
        self.weight = (corpus or Corpus.of(tails)).weights(self.term, tf, sizes[self.doc])
        self._cut()

    def _cut(self) -> None:
        self.terms, start, self.df = np.unique(self.term, return_index=True, return_counts=True)
        self.cut = np.append(start, len(self.term))
        self.place = np.full(1 + max(int(self.terms.max(initial=-1)), self.most), -1)
        self.place[self.terms] = np.arange(len(self.terms))

    def forget(self, unused: np.ndarray) -> None:
        """Drops the postings of used tails; the weights of the others stay as they are."""
        keep = unused[self.doc]
        self.term, self.doc, self.weight = self.term[keep], self.doc[keep], self.weight[keep]
        self._cut()

    def neighbours(self, tail: np.ndarray, unused: np.ndarray, query_terms: int | None = None) -> np.ndarray:
        """Unused tails that share an id with the seed, best first by BM25 over all ids of the seed (or its rarest query_terms)."""
        at = self.place[np.unique(tail)]
        at = at[at >= 0]
        if query_terms is not None:
            at = at[self.df[at] > 1]
            at = at[np.argsort(self.df[at], kind="stable")[:query_terms]]
        if not len(at):
            return at
        spans = [slice(i, j) for i, j in zip(self.cut[at].tolist(), self.cut[at + 1].tolist(), strict=True)]
        score = np.bincount(np.concatenate([self.doc[s] for s in spans]), np.concatenate([self.weight[s] for s in spans]), self.n)
        found = np.flatnonzero((score > 0) & unused)
        return found[np.argsort(-score[found], kind="stable")]


def fill_windows(tails: list[np.ndarray], window: int, query_terms: int | None = None, corpus: Corpus | None = None):
    """Lists of (tail, from, to), each list one sequence: all of window ids, but powers of two at the end."""
    index = LexicalIndex(tails, corpus)
    size = np.array([len(t) for t in tails], np.int64)
    begin = np.zeros(len(tails), np.int64)
    unused = size > 0
    order, at = np.argsort(-size, kind="stable"), 0
    last: list[tuple[int, int, int]] = []
    total = int(size.sum())
    indexed = int(unused.sum())
    for _ in range(total // window):
        row: list[tuple[int, int, int]] = []
        room = window

        def take(i: int, row=row) -> None:
            nonlocal room
            n = min(room, int(size[i] - begin[i]))
            row.append((i, int(begin[i]), int(begin[i]) + n))
            begin[i] += n
            unused[i] = begin[i] < size[i]
            room -= n

        while not unused[order[at]]:
            at += 1
        seed = order[at]
        take(seed)
        if room:
            if 4 * (left := int(unused.sum())) < 3 * indexed:
                index.forget(unused)
                indexed = left
            near = index.neighbours(tails[seed], unused, query_terms)
            whole = near[size[near] - begin[near] <= room]
            for i in whole:
                if size[i] - begin[i] <= room:
                    take(i)
                    if not room:
                        break
            if room:
                for i in near:
                    if unused[i]:
                        take(i)
                        if not room:
                            break
        while room:
            while not unused[order[at]]:
                at += 1
            take(order[at])
        yield row
    rest = total % window
    last = [(i, int(begin[i]), int(size[i])) for i in order if unused[i]]
    while rest:
        room = 1 << (rest.bit_length() - 1)
        rest -= room
        row = []
        while room:
            i, a, b = last.pop(0)
            n = min(room, b - a)
            row.append((i, a, a + n))
            room -= n
            if a + n < b:
                last.insert(0, (i, a + n, b))
        yield row


@lru_cache(1)
def _axes(terms: int) -> np.ndarray:
    """Random directions, the same everywhere, one row per token id."""
    return np.random.default_rng(1).standard_normal((terms, DIMS), np.float32)


def vectors(tails: list[np.ndarray], corpus: Corpus) -> np.ndarray:
    """BM25 vectors of tails, projected to DIMS numbers and of length 1 (0 for an empty tail)."""
    axes, out = _axes(len(corpus.df)), np.zeros((len(tails), DIMS), np.float32)
    for i, tail in enumerate(tails):
        term, tf = np.unique(tail, return_counts=True)
        out[i] = corpus.weights(term, tf, len(tail)).astype(np.float32) @ axes[term]
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


class Deal:
    """A tree of splits of a weighted sample of vectors into leaves of about equal weight; a heavy leaf that can't be split is several shards."""

    def __init__(self, sample: np.ndarray, weight: np.ndarray, shards: int) -> None:
        self.axis, self.edge, self.child, self.leaf, self.shards = [], [], [], [], []
        order = np.lexsort(sample.T)
        self._grow(sample[order], weight[order], min(shards, LEAVES), shards / max(1.0, float(weight.sum())))
        self.axis, self.edge, self.child, self.leaf = np.array(self.axis), np.array(self.edge), np.array(self.child), np.array(self.leaf)
        self.first = np.cumsum([0, *self.shards])

    def _grow(self, x: np.ndarray, w: np.ndarray, leaves: int, per_weight: float) -> int:
        at = len(self.child)
        self.axis.append(np.zeros(DIMS, np.float32)), self.edge.append(0.0), self.child.append((at, at)), self.leaf.append(-1)
        if leaves > 1 and len(x) > 1:
            y = x - np.average(x, axis=0, weights=w)
            axis = np.linalg.eigh((y * w[:, None]).T @ y)[1][:, -1].astype(np.float32)
            order = np.argsort(x @ axis, kind="stable")
            on, held = (x @ axis)[order], np.cumsum(w[order])
            cuts = np.flatnonzero(np.diff(on) > 1e-5)
            if len(cuts):
                cut = cuts[np.argmin(np.abs(held[cuts] - held[-1] * (leaves // 2) / leaves))]
                left = int(np.clip(round(leaves * held[cut] / held[-1]), 1, leaves - 1))
                self.axis[at], self.edge[at] = axis, float(on[cut] + on[cut + 1]) / 2
                here = order[: cut + 1], order[cut + 1 :]
                self.child[at] = tuple(self._grow(x[i], w[i], n, per_weight) for i, n in zip(here, (left, leaves - left), strict=True))
                return at
        self.leaf[at] = len(self.shards)
        self.shards.append(max(1, round(float(w.sum()) * per_weight)))
        return at

    def __call__(self, x: np.ndarray, salt: np.ndarray) -> np.ndarray:
        """The shard of each vector; salt tells the shards of one leaf apart."""
        at = np.zeros(len(x), np.int64)
        while len(x) and (self.leaf[at] < 0).any():
            right = np.einsum("ij,ij->i", x, self.axis[at]) > self.edge[at]
            at = self.child[at, right.astype(np.int64)]  # a leaf is its own child
        leaf = self.leaf[at]
        return (self.first[leaf] + salt % np.array(self.shards)[leaf]).astype(np.int32)


def _tail(raw: bytes, dtype, window: int) -> np.ndarray:
    ids = np.frombuffer(raw, dtype)
    return ids[len(ids) // window * window :]


def count_corpus(encoded: DataFrame, dtype, window: int) -> Corpus:
    """Corpus of a table of ids, by one aggregate."""

    def count(batches):
        n, total, df = 0, 0, np.zeros(0, np.int64)
        for batch in batches:
            tails = [_tail(x, dtype, window) for x in batch["ids"].to_pylist()]
            n, total, more = n + len(tails), total + sum(map(len, tails)), Corpus.of(tails).df
            df = np.pad(df, (0, max(0, len(more) - len(df))))
            df[: len(more)] += more
        term = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append([-2, -1], term)), pa.array(np.append([n, total], df[term]).astype(np.int64))], ["term", "n"])

    told = encoded.select("ids").mapInArrow(swept(count), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    found = dict(zip(told["term"].to_pylist(), told["n"].to_pylist(), strict=True))
    n, total = found.pop(-2, 0), found.pop(-1, 0)
    df = np.zeros(max(found, default=-1) + 1, np.int64)
    df[list(found)] = list(found.values())
    return Corpus(n, total / max(1, n), df)


def deal(encoded: DataFrame, corpus: Corpus, dtype, window: int, shards: int) -> DataFrame:
    """Adds the column shard."""
    salt, wanted = F.xxhash64("doc_id", "ids"), SAMPLE * min(shards, LEAVES)
    share = min(1.0, wanted / max(1, corpus.n))

    def project(batches):
        for batch in batches:
            tails = [_tail(x, dtype, window) for x in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in vectors(tails, corpus)], pa.binary()), pa.array([max(1, len(t)) for t in tails], pa.int64())], ["v", "size"])

    if shards > 1:
        told = encoded.where(F.pmod(salt, F.lit(1 << 30)) < int(share * (1 << 30))).select("ids").mapInArrow(swept(project), "v binary, size long").toArrow()
        sample = np.frombuffer(b"".join(told["v"].to_pylist()), np.float32).reshape(-1, DIMS)
        tree = Deal(sample, told["size"].to_numpy().astype(np.float64), shards)
    else:
        tree = Deal(np.zeros((0, DIMS), np.float32), np.zeros(0), 1)

    @F.arrow_udf("int")
    def place(ids: pa.Array, salt: pa.Array) -> pa.Array:
        # other bits than those that chose the sample
        return pa.array(tree(vectors([_tail(x, dtype, window) for x in ids.to_pylist()], corpus), (salt.to_numpy(zero_copy_only=False) >> 31) & 0x7FFFFFFF))

    return encoded.withColumn("shard", place("ids", salt))


def pack(docs: DataFrame, tokenizer: str, window: int = 1024, end_id: int = 0, query_terms: int | None = None, shards: int | None = None) -> DataFrame:
    """PIECES: each row a run of one document's ids (little-endian unsigned 32 bits) and its place in a sequence. Encodes when called."""
    spark, dtype = docs.sparkSession, np.dtype(encoder(tokenizer).dtype)
    short_batches(spark)

    def encode_texts(batches):
        encode = encoder(tokenizer)
        for batch in batches:
            ids = [np.append(x, encode.dtype(end_id)).tobytes() for x in encode.batch(batch["text"])]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(ids, pa.binary())], ["doc_id", "ids"])

    path = fresh_path(spark, "token-ids")
    docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(swept(encode_texts), "doc_id long, ids binary").write.parquet(path)
    encoded = spark.read.parquet(path)
    corpus = count_corpus(encoded, dtype, window)
    placed = deal(encoded, corpus, dtype, window, shards or max(1, round(corpus.n * corpus.mean / SHARD_IDS)))

    def pack_shard(key, table):
        table = table.sort_by([("doc_id", "ascending"), ("ids", "ascending")])
        ids = [np.frombuffer(x, dtype) for x in table["ids"].to_pylist()]
        docs_here = table["doc_id"].to_pylist()
        base, sequence, rows = key[0].as_py() << 40, 0, []
        for d, x in enumerate(ids):
            for start in range(0, len(x) - window + 1, window):
                rows.append((d, start, start + window, base + sequence, 0))
                sequence += 1
        whole = [len(x) // window * window for x in ids]
        for filled in fill_windows([x[w:] for x, w in zip(ids, whole, strict=True)], window, query_terms, corpus):
            offset = 0
            for d, a, b in filled:
                rows.append((d, int(whole[d]) + a, int(whole[d]) + b, base + sequence, offset))
                offset += b - a
            sequence += 1
        return pa.table(
            {
                "doc_id": pa.array([docs_here[r[0]] for r in rows], pa.int64()),
                "start": pa.array([r[1] for r in rows], pa.int64()),
                "length": pa.array([r[2] - r[1] for r in rows], pa.int64()),
                "ids": pa.array([ids[r[0]][r[1] : r[2]].astype("<u4").tobytes() for r in rows], pa.binary()),
                "doc_tokens": pa.array([len(ids[r[0]]) for r in rows], pa.int64()),
                "sequence_id": pa.array([r[3] for r in rows], pa.int64()),
                "offset": pa.array([r[4] for r in rows], pa.int64()),
            }
        )

    return placed.groupBy("shard").applyInArrow(tidily(pack_shard), PIECES)


def digest(pieces: DataFrame) -> DataFrame:
    """The contract's columns of `pack`."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
