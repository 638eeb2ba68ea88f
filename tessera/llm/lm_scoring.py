"""Language-model scores by a weighted backoff automaton over words.

Tokens: A-Z lower-cased words (runs of bytes other than x20, x09-x0D), then one
end. An n-gram of the training rows is a state and an arc; the model is
interpolated Witten-Bell: with c(h) the count of a history, T(h) the number of
distinct tokens after it and h' the history without its first token,

    P(w | h) = (c(h w) + T(h) P(w | h')) / (c(h) + T(h)),
    P(w) = (c(w) + 1) / (N + V + 1).

In the automaton a seen n-gram h w is an arc of weight P(w | h); a missing one
is reached by the failure arc to h' of weight T(h) / (c(h) + T(h)). The state
after a token is the longest seen history. Texts are walked from left to right,
the state carried from token to token, many of them side by side.

How it runs on Spark: each chunk of documents asks for the counts of its
n-grams over the whole corpus (`exchange`), and once more for T of its
histories; from these it builds the part of the automaton which its texts can
reach (`Automaton`) and walks it. The whole model is in no single place, and what
is exchanged grows with the corpus.

Defined cases: null or empty text: the end token alone; a null in the training
flag: not learned from; repeated rows count each; a null doc_id is kept; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from . import textbytes as B
from .jaccard_join import _count as summed
from .storage import tidily

END = np.uint64(0xE9D1C7A5B3F18D27)
_SEED = np.uint64(0x9FB21C651E98DF25)
FIRST = np.uint32(1 << 31)
SCORES = "doc_id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


class Grams:
    """The tokens and n-grams of one chunk. keys[n][i]: the n-gram that ends at token i; there[n][i]: it lies in one text."""

    def __init__(self, table: pa.Table, order: int) -> None:
        data, offsets = B.buffer_of(table["text"])
        words, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for i, j in B.slices(offsets):
            w, r = B.words_of(B.lowered(data[offsets[i] : offsets[j]]), offsets[i : j + 1] - offsets[i])
            words.append(w)
            rows.append(r + i)
        word, row = np.concatenate(words), np.concatenate(rows)
        n = table.num_rows
        self.cut = B.runs_of(row, n) + np.arange(n + 1)
        self.token = np.full(len(word) + n, END, np.uint64)
        self.token[np.arange(len(word)) + row] = word
        self.size = np.diff(self.cut)
        place = np.arange(len(self.token)) - np.repeat(self.cut[:-1], self.size)
        train = np.array([bool(x) for x in table["train"].to_pylist()], bool)
        self.train = np.repeat(train, self.size)
        gram, self.keys, self.there = self.token, [], []
        for k in range(order):
            if k:
                gram = B.mix(np.concatenate([np.zeros(1, np.uint64), gram[:-1]]) * _SEED + self.token)
            self.keys.append((gram & ~np.uint64(3)) | np.uint64(k))
            self.there.append(place >= k)
        self.distinct, self.at, back = np.unique(np.concatenate([k[t] for k, t in zip(self.keys, self.there, strict=True)]), return_index=True, return_inverse=True)
        self.back = np.split(back, np.cumsum([t.sum() for t in self.there])[:-1])
        self.ends = np.concatenate([np.flatnonzero(t) for t in self.there])

    def counts(self) -> np.ndarray:
        return np.bincount(np.concatenate(self.back), np.concatenate([self.train[t] for t in self.there]), len(self.distinct)).astype(np.uint32)

    def histories(self, told: np.ndarray):
        """Sorted distinct histories, how many n-grams that follow each are told to be this chunk's to report, and a token that each ends at."""
        ends = np.concatenate([np.zeros(0, np.int64), *(np.flatnonzero(t) - 1 for t in self.there[1:])])
        before = np.concatenate([np.zeros(0, np.uint64), *(k[np.flatnonzero(t) - 1] for k, t in zip(self.keys, self.there[1:]))])
        history, first, back = np.unique(before, return_index=True, return_inverse=True)
        skip = int(self.there[0].sum())
        own = np.flatnonzero((told & FIRST) > 0)
        own = own[self.at[own] >= skip]
        return history, np.bincount(back[self.at[own] - skip], minlength=len(history)).astype(np.uint32), ends[first]


def _tally(runs):
    """A bucket's answer: each n-gram's training count, flagged for the first chunk that holds one; and its share of N and V."""
    keys = [r[1] for r in runs]
    known, back = np.unique(np.concatenate(keys), return_inverse=True)
    own = np.concatenate([r[2] for r in runs])
    total = np.bincount(back, own, len(known)).astype(np.uint32)
    chunk = np.repeat(np.arange(len(runs)), [len(k) for k in keys])
    first = np.full(len(known), -1)
    held = np.flatnonzero(own)[::-1]
    first[back[held]] = chunk[held]
    said = total[back] | np.where(first[back] == chunk, FIRST, np.uint32(0))
    single = (known & np.uint64(3)) == 0
    return np.split(said, np.cumsum([len(k) for k in keys])[:-1]), [int(total[single].sum()), int((total[single] > 0).sum())]


class Automaton:
    """The states and arcs that one chunk's texts can reach.

    A state is a seen history, state 0 the empty one; depth: its tokens; fail and
    failed: the state of its failure arc and the log10 of that arc's weight. An
    n-gram is an arc from its history by its last token: seen, weight (log10 of the
    probability) and target, the longest seen history after it.
    """

    def __init__(self, grams: Grams, told: np.ndarray, after: np.ndarray, tokens: float, types: float) -> None:
        order = len(grams.keys)
        count = (told & ~FIRST).astype(float)
        level, end = (grams.distinct & np.uint64(3)).astype(np.int64), grams.ends[grams.at]
        known, _, last = grams.histories(np.zeros(0, np.uint32))
        held = count[np.searchsorted(grams.distinct, known)]
        states, last, held, after = known[held > 0], last[held > 0], held[held > 0], after[held > 0]

        def state_of(keys: np.ndarray) -> np.ndarray:
            at = np.searchsorted(states, keys)
            return np.where(np.append(states, np.uint64(0))[at] == keys, at + 1, 0)

        self.depth = np.append(0, (states & np.uint64(3)).astype(np.int64) + 1)
        self.failed = np.append(0.0, np.log10(after / (held + after)))
        self.fail = np.zeros(len(states) + 1, np.int64)
        total, followed = np.append(0.0, held), np.append(0.0, after)
        chance = np.zeros(len(grams.distinct))
        self.target = np.zeros(len(grams.distinct), np.int64)
        for k in range(order):
            own = np.flatnonzero(level == k)
            at = end[own]
            if k:
                h = state_of(grams.keys[k - 1][at - 1])
                less = np.searchsorted(grams.distinct, grams.keys[k - 1][at])
                chance[own] = (count[own] + followed[h] * chance[less]) / np.maximum(total[h] + followed[h], 1)
                deeper = np.flatnonzero(self.depth == k + 1)
                self.fail[deeper] = state_of(grams.keys[k - 1][last[deeper - 1]])
            else:
                chance[own] = (count[own] + 1) / (tokens + types + 1)
            for j in range(min(k, order - 2) + 1):  # the longest history that is a state counts
                to = state_of(grams.keys[j][at])
                self.target[own] = np.where(to > 0, to, self.target[own])
        self.seen = (count > 0) | (level == 0)
        self.weight = np.log10(np.where(self.seen, chance, 1.0))

    def walk(self, grams: Grams, lane: int = 64) -> np.ndarray:
        """log10 of each token's probability, from left to right with the state carried along.

        Texts are walked side by side in lanes of so many tokens. A lane starts as
        many tokens early as a state remembers, so that its state is that of the text.
        """
        back = len(grams.keys) - 1
        text = np.repeat(np.arange(len(grams.size)), -(-grams.size // lane))
        nth = np.arange(len(text)) - np.searchsorted(text, text)
        begin = grams.cut[text] + lane * nth
        stop = np.minimum(begin + lane, grams.cut[text + 1])
        place, state = np.maximum(grams.cut[text], begin - back), np.zeros(len(text), np.int64)
        arcs = np.full((back + 1, len(grams.token)), -1)
        for k in range(back + 1):
            arcs[k, grams.there[k]] = grams.back[k]
        out = np.zeros(len(grams.token))
        lanes = np.arange(len(text))
        while len(lanes):
            at, s = place[lanes], state[lanes]
            gain = np.zeros(len(lanes))
            arc = arcs[self.depth[s], at]
            for _ in range(back):
                lost = np.flatnonzero(~self.seen[arc])
                gain[lost] += self.failed[s[lost]]
                s[lost] = self.fail[s[lost]]
                arc[lost] = arcs[self.depth[s[lost]], at[lost]]
            own = at >= begin[lanes]
            out[at[own]] = (gain + self.weight[arc])[own]
            state[lanes], place[lanes] = self.target[arc], at + 1
            lanes = lanes[place[lanes] < stop[lanes]]
        return out


def score_texts(docs: DataFrame, train: Column, order: int = 2, chunks: int | None = None, direct: int | None = None) -> DataFrame:
    """SCORES of every row; train says which rows the model learns from; order is the longest n-gram, 3 at most."""
    if not 1 <= order <= 3:
        raise ValueError("order is 1, 2 or 3")
    exchange = X.Exchange.of(chunks or X.parts(docs), direct)
    placed = X.by_hash(docs.select("doc_id", "text", F.coalesce(train, F.lit(False)).alias("train")), exchange.chunks)

    def ask_counts(key, table):
        grams = Grams(table, order)
        return exchange.asked(key[0].as_py(), grams.distinct, grams.counts())

    def ask_histories(key, table, said):
        grams = Grams(table, order)
        history, own, _ = grams.histories(X.answered(said, np.uint32))
        return exchange.asked(key[0].as_py(), history, own)

    def score(key, table, said):
        grams = Grams(table, order)
        which = np.array(said["round"].to_pylist())
        told, after = (X.answered(said.filter(pa.array(which == k)), np.uint32) for k in (1, 2))
        tokens, types = said["all_tokens"][0].as_py(), said["all_types"][0].as_py()
        each = Automaton(grams, told, after.astype(float), tokens, types).walk(grams)
        count = (told & ~FIRST)[grams.back[0]].astype(float)
        total = lambda x: np.add.reduceat(x, grams.cut[:-1])  # noqa: E731  every text has its end token
        return pa.table(
            {
                "doc_id": table["doc_id"].cast(pa.int64()),
                "train": table["train"],
                "n_tokens": pa.array(grams.size, pa.int64()),
                "n_known": pa.array(total((count > 0).astype(np.int64)), pa.int64()),
                "train_tokens": pa.array(np.full(table.num_rows, tokens), pa.int64()),
                "base_score": pa.array(total(np.log10((count + 1) / (tokens + types + 1))), pa.float64()),
                "score": pa.array(total(each), pa.float64()),
            }
        )

    counts, figures = exchange.ask(placed.groupBy("chunk").applyInArrow(tidily(ask_counts), X.ASKED), _tally, np.uint32)
    totals = figures.agg(F.sum(F.col("figures")[0]).alias("all_tokens"), F.sum(F.col("figures")[1]).alias("all_types"))  # one row
    asked = placed.groupBy("chunk").cogroup(counts.groupBy("chunk")).applyInArrow(tidily(ask_histories, 2), X.ASKED)
    after, _ = exchange.ask(asked, summed, np.uint32)
    both = counts.withColumn("round", F.lit(1)).unionByName(after.withColumn("round", F.lit(2))).join(F.broadcast(totals))
    return placed.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInArrow(tidily(score, 2), SCORES)


def held_out_scores(docs: DataFrame) -> DataFrame:
    """The contract's columns, learned from all folds but 2."""
    from .language_id import fold

    of = fold(F.col("doc_id"), 7)
    found = score_texts(docs, of != 2)
    return found.select("doc_id", F.coalesce(of == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def brute_force(rows: list[tuple[int, str | None, bool]], order: int = 2) -> list[tuple]:
    """The model read literally, for tests: doc_id, n_tokens, n_known, train_tokens, base_score, score."""
    import math
    import re
    from collections import Counter, defaultdict

    def tokens_of(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]

    count, after = Counter(), defaultdict(set)
    for _, text, train in rows:
        if train:
            t = tokens_of(text)
            for i in range(len(t)):
                for k in range(min(order, i + 1)):
                    count[tuple(t[i - k : i + 1])] += 1
                    if k:
                        after[tuple(t[i - k : i])].add(t[i])
    size = sum(c for g, c in count.items() if len(g) == 1)
    types = sum(1 for g in count if len(g) == 1)

    def p(w, h):
        if not h:
            return (count[(w,)] + 1) / (size + types + 1)
        if not count[h]:
            return p(w, h[1:])
        return (count[(*h, w)] + len(after[h]) * p(w, h[1:])) / (count[h] + len(after[h]))

    out = []
    for doc, text, _ in rows:
        t = tokens_of(text)
        score = sum(math.log10(p(w, tuple(t[max(0, i - order + 1) : i]))) for i, w in enumerate(t))
        base = sum(math.log10((count[(w,)] + 1) / (size + types + 1)) for w in t)
        out.append((doc, len(t), sum(count[(w,)] > 0 for w in t), size, base, score))
    return out
