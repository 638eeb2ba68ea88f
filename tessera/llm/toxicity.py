"""Toxic spans by a linear-chain conditional random field over words.

Learning, on at most ``sample`` labelled rows of each class (lowest hash of the
id; a documented bound):
1. A word (run of letters, A-Z lower-cased) has three features: itself, its first
   three bytes and its last three. Features whose share of toxic documents is
   ``least_ratio`` times their share of the others and exceeds it by ``least_z``
   standard errors are kept, words and affixes apart. A kept word in a toxic
   document is a token labelled toxic; other words of these features are labelled
   plain. So a word that was never labelled can still be tagged by its affixes.
2. A chain of two states (plain, toxic) with a weight per feature, one for all
   words without any, and four transitions is fitted to stretches around words
   with features. Each step of gradient ascent on the conditional likelihood is
   one Spark job that sums the partitions' gradients (forward-backward per batch).
3. The score of a document is one minus the product of its words' marginals of
   being plain, brought to the labels' scale by a logistic curve.

Scoring covers whole texts: between words with features the chain's step is a
fixed 2 x 2 matrix, so forward-backward jumps from one to the next with its
powers, many texts at once, and the marginals are those of the full chain. A
marginal of a word without features is not listed; it is tiny by construction.

Defined cases: null or empty text scores as a text without features; with no
toxic or no other label to learn from, every score is 0; of several labels of an
id the largest counts; repeated rows score alike; a null doc_id is not learned
from; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as B
from .storage import durable, short_batches

_LETTERS = np.zeros(256, bool)
_LETTERS[list(range(97, 123)) + list(range(128, 256))] = True
#: Bytes of the affixes of a word, and what tells their hashes apart; the bit that hashes of words have.
AFFIX, _HEAD, _TAIL, _WORD = 3, np.uint64(0x1F83D9ABFB41BD6B), np.uint64(0x5BE0CD19137E2179), np.uint64(1)
SPANS = "array<struct<start:int,end:int,marginal:double>>"


def letter_words(column):
    """Per slice of rows: first row, rows, and each word's features (three hashes), row in the slice and byte span in its text."""
    data, offsets = B.buffer_of(column)
    for i, j in B.slices(offsets):
        cut = offsets[i : j + 1] - offsets[i]
        d = B.lowered(data[offsets[i] : offsets[j]])
        inside = np.zeros(len(d) + 1, bool)
        inside[:-1] = _LETTERS[d]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        edge = cut[1:-1]
        begins[edge] = inside[edge]
        start = np.flatnonzero(begins)
        stop = ~inside
        stop[edge] = True
        stops = np.flatnonzero(stop)
        end = stops[np.searchsorted(stops, start, "right")]
        row = np.searchsorted(cut, start, "right") - 1
        sums = B.prefix_sums(d)
        head, tail = B.span_hash(sums, start, np.minimum(start + AFFIX, end)), B.span_hash(sums, np.maximum(end - AFFIX, start), end)
        yield i, j - i, np.stack([B.long_hash(sums, start, end) | _WORD, B.mix(head ^ _HEAD) & ~_WORD, B.mix(tail ^ _TAIL) & ~_WORD]), row, start - cut[row], end - cut[row]


@dataclass
class Tagger:
    """keys: sorted hashes of features; weight of each as toxic; plain: weight of a word without any; step[a, b]: from state a to b."""

    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))
    plain: float = 0.0
    step: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    scale: float = 1.0
    shift: float = -40.0

    def marginals(self, n: np.ndarray, cut: np.ndarray, at: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Of being toxic, for words at the positions at of texts of n words; text i has the words cut[i] to cut[i + 1], score is their weight."""
        enter = np.exp(self.step - self.step.max())
        values, right = np.linalg.eig(enter * np.array([1.0, np.exp(self.plain)]))  # a step to a word without features
        order = np.argsort(-values.real)
        right, ratio = right.real[:, order], values.real[order[1]] / values.real[order[0]]
        left = np.linalg.inv(right)

        def power(k):
            return np.stack([np.ones(len(k)), np.power(ratio, k)], 1)

        lift = np.stack([np.ones(len(at)), np.exp(np.clip(score, -500, 500))], 1)
        held = np.diff(cut)
        forward, backward = np.ones((len(at), 2)), np.ones((len(at), 2))
        for k in range(int(held.max(initial=0))):  # the k-th word of every text that has so many
            text = np.flatnonzero(held > k)
            j = cut[text] + k
            if k:
                state, gap = forward[j - 1], at[j] - at[j - 1] - 1
            else:
                state, gap = np.broadcast_to([1.0, np.exp(self.plain)], (len(j), 2)), np.maximum(at[j] - 1, 0)
            state = (((state @ right) * power(gap)) @ left) @ enter
            state[at[j] == 0] = 1.0
            state *= lift[j]
            forward[j] = state / state.sum(1, keepdims=True)
            j = cut[text + 1] - 1 - k
            if k:
                ahead, gap = (lift[j + 1] * backward[j + 1]) @ enter.T, at[j + 1] - at[j] - 1
            else:
                ahead, gap = np.ones((len(j), 2)), n[text] - at[j] - 1
            back = ((ahead @ left.T) * power(gap)) @ right.T
            backward[j] = back / back.sum(1, keepdims=True)
        both = forward * backward
        return both[:, 1] / both.sum(1)

    def scores(self, clean: np.ndarray) -> np.ndarray:
        """Of texts, from the log probability that none of their words is toxic."""
        return 1 / (1 + np.exp(-np.clip(self.scale * evidence(clean) + self.shift, -60, 60)))


def evidence(clean: np.ndarray) -> np.ndarray:
    """Log odds of any toxic word, from the log probability of none."""
    clean = np.minimum(clean, -1e-6)
    return np.log(-np.expm1(clean)) - clean


def gradient(theta: np.ndarray, size: np.ndarray, word: np.ndarray, toxic: np.ndarray, features: int) -> np.ndarray:
    """Of the log-likelihood of stretches, and that itself last.

    theta: weights of the features, of a word without any, and of the four steps.
    size: words of each stretch; word: three feature numbers or -1 of every word; toxic: its label.
    """
    first = np.cumsum(size) - size
    longest = int(size.max(initial=0))
    known = (word >= 0).any(axis=1)
    own = np.where(word >= 0, theta[np.maximum(word, 0)], 0.0).sum(axis=1)
    emit = np.exp(np.clip(np.where(known, own, theta[features]), -30, 30))
    step = np.exp(np.clip(theta[features + 1 :].reshape(2, 2), -30, 30))
    alpha, beta, scale = np.ones((len(word), 2)), np.ones((len(word), 2)), np.ones(len(word))
    for k in range(longest):
        j = first[size > k] + k
        new = alpha[j - 1] @ step if k else np.ones((len(j), 2))
        new[:, 1] *= emit[j]
        scale[j] = new.sum(1)
        alpha[j] = new / scale[j][:, None]
    for k in range(1, longest):
        j = (first + size - 1 - k)[size > k]
        ahead = beta[j + 1] * np.stack([np.ones(len(j)), emit[j + 1]], 1)
        beta[j] = ahead @ step.T / scale[j + 1][:, None]
    both = alpha * beta
    share = toxic - both[:, 1] / both.sum(1)
    out = np.zeros(len(theta) + 1)
    for column in word.T:
        out[:features] += np.bincount(column[column >= 0], share[column >= 0], features)
    out[features] = share[~known].sum()
    j = np.setdiff1d(np.arange(len(word)), first, assume_unique=True)
    joint = alpha[j - 1, :, None] * step * (beta[j] * np.stack([np.ones(len(j)), emit[j]], 1))[:, None, :]
    joint /= joint.sum((1, 2), keepdims=True)
    pair = 2 * toxic[j - 1] + toxic[j]
    out[features + 1 : -1] = np.bincount(pair, minlength=4) - joint.sum(0).reshape(-1)
    out[-1] = np.log(emit)[toxic == 1].sum() + np.log(step).reshape(-1)[pair].sum() - np.log(scale).sum()
    return out


def fit_chain(slope, size: int, rounds: int = 40, rate: float = 0.4) -> np.ndarray:
    """theta by gradient ascent with momentum and a step per weight (Adam); slope(theta) is the gradient of the mean."""
    theta, first, second = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, rounds + 1):
        g = slope(theta)
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g**2
        theta = theta + rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8) / (1 + t / 40)
    return theta


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift by a few Newton steps with a little ridge."""
    a = np.stack([x, np.ones_like(x)], 1)
    beta = np.array([0.5, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -40, 40)))
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag([1e-2, 1e-2])
        beta = beta + np.clip(np.linalg.solve(h, a.T @ (y - p) - 1e-2 * beta), -2, 2)
    return float(max(beta[0], 1e-3)), float(beta[1])


def _found(column, keys: np.ndarray):
    """Per slice of rows: first row, words of each row, and of the words with features: where each row's begin, positions, feature numbers (-1: none) and byte spans."""
    for i, n, hashes, row, start, end in letter_words(column):
        cut = B.runs_of(row, n)
        if len(keys):
            number = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
            number = np.where(keys[number] == hashes, number, -1)
        else:
            number = np.full(hashes.shape, -1)
        hit = np.flatnonzero((number >= 0).any(axis=0))
        yield i, np.diff(cut), np.searchsorted(hit, cut), hit - cut[row[hit]], number[:, hit].T, start[hit], end[hit]


def _stretches(n: int, at: np.ndarray, reach: int = 4, most: int = 60):
    """Ranges of words around those at the positions at, and which of these each holds."""
    i = 0
    while i < len(at):
        j = i
        while j + 1 < len(at) and at[j + 1] - at[j] <= 2 * reach and at[j + 1] - at[i] < most:
            j += 1
        yield max(0, at[i] - reach), min(n, at[j] + reach + 1), i, j + 1
        i = j + 1


def _clean(tagger: Tagger, n, cut, at, word) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of words, and each text's log probability of no toxic word."""
    p = tagger.marginals(n, cut, at, np.where(word >= 0, np.append(tagger.weight, 0.0)[word], 0.0).sum(axis=1))
    less = np.concatenate([[0.0], np.cumsum(np.log1p(-np.minimum(p, 1 - 1e-9)))])
    return p, less[cut[1:]] - less[cut[:-1]]


def _chosen(rows: DataFrame, most: int, least_z: float, least_ratio: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Sorted hashes of the features that tell toxic rows (text, toxic) from others, and which of them are words; None without both kinds of rows."""

    def count(batches):
        keys, toxic, n = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], np.zeros(2, np.int64)
        for batch in batches:
            label = np.array(batch["toxic"].to_pylist(), np.int64)
            n += np.bincount(label, minlength=2)
            for first, k, hashes, row, _, _ in letter_words(batch["text"]):
                for own in hashes:
                    pair = np.unique(np.stack([row.astype(np.uint64), own], 1), axis=0)
                    keys.append(pair[:, 1])
                    toxic.append(label[first : first + k][pair[:, 0].astype(int)])
        keys, back = np.unique(np.concatenate(keys), return_inverse=True)
        ones = np.bincount(back, np.concatenate(toxic), len(keys)).astype(np.int64)
        every = np.bincount(back, minlength=len(keys)).astype(np.int64)
        yield pa.RecordBatch.from_pydict({"feature": np.append(keys.view(np.int64), [0, 0]), "n": np.concatenate([every, n]), "ones": np.concatenate([ones, [-1, -2]])})

    counts = rows.select("text", "toxic").mapInArrow(count, "feature long, n long, ones long")
    sums = counts.groupBy("feature", F.when(F.col("ones") < 0, F.col("ones")).otherwise(0).alias("kind")).agg(F.sum("n").alias("n"), F.sum("ones").alias("ones"))
    sums = durable(sums.where("kind < 0 or (ones >= 3 and ones * 50 > n)"))
    size = {r["kind"]: r["n"] for r in sums.where("kind < 0").collect()}
    plain, toxic = size.get(-1, 0), size.get(-2, 0)
    if not plain or not toxic:
        return None
    both = (F.col("n") + 1.0) / (plain + toxic + 2)
    gap = F.col("ones") / float(toxic) - (F.col("n") - F.col("ones")) / float(plain)
    z = gap / F.sqrt(both * (1 - both) * (1 / toxic + 1 / plain))
    told = sums.where("kind = 0").where(F.col("ones") * plain >= least_ratio * toxic * (F.col("n") - F.col("ones"))).select("feature", z.alias("z")).where(F.col("z") >= least_z)
    top = told.orderBy(F.desc("z"), "feature").limit(most).collect()
    keys = np.sort(np.array([r["feature"] for r in top], np.int64).view(np.uint64))
    return keys, (keys & _WORD) > 0


def fit(docs: DataFrame, labels: DataFrame, sample: int = 10_000, features: int = 4000, least_z: float = 4.5, least_ratio: float = 5.0, rounds: int = 40) -> Tagger:
    """Learns from docs (doc_id, text) and labels (doc_id, toxic); sample bounds the labelled rows of each class, features what is kept of them."""
    short_batches(docs.sparkSession)
    told = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    few = [told.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for k in (0, 1)]
    rows = docs.select("doc_id", "text").join(F.broadcast(few[0].unionByName(few[1])), "doc_id")  # 2 * sample ids
    chosen = _chosen(rows, features, least_z, least_ratio)
    if chosen is None:
        return Tagger()
    keys, is_word = chosen
    k = len(keys)

    def locate(batches):
        for batch in batches:
            size, words, toxic, out = [], [], [], batch["toxic"].to_pylist()
            for i, n, cut, at, number, _, _ in _found(batch["text"], keys):
                label = (number[:, 0] >= 0) & is_word[number[:, 0]] if k else np.zeros(0, bool)
                for r in range(len(n)):
                    own = slice(cut[r], cut[r + 1])
                    for a, b, x, y in _stretches(int(n[r]), at[own]):
                        word, yes = np.full((b - a, 3), -1), np.zeros(b - a, int)
                        word[at[own][x:y] - a] = number[own][x:y]
                        yes[at[own][x:y] - a] = label[own][x:y] * out[i + r]
                        size.append(b - a)
                        words.append(word)
                        toxic.append(yes)
            word, yes = np.concatenate([np.zeros((0, 3), int), *words]), np.concatenate([np.zeros(0, int), *toxic])
            yield pa.RecordBatch.from_pydict({"n": [len(size)], "size": [np.array(size, np.int32).tobytes()], "word": [word.astype(np.int32).tobytes()], "toxic": [yes.astype(np.int8).tobytes()]})

    located = rows.select("text", "toxic").mapInArrow(locate, "n long, size binary, word binary, toxic binary")
    # bounded by the sample, so a few partitions hold it and a step of the fit is one stage without a shuffle
    stretches = durable(located.repartition(min(64, docs.sparkSession.sparkContext.defaultParallelism)))
    many = max(1, stretches.agg(F.sum("n")).first()[0] or 0)

    def slope(theta: np.ndarray) -> np.ndarray:
        def partial(batches):
            total = np.zeros(len(theta) + 1)
            for batch in batches:
                for size, word, toxic in zip(*(batch[c].to_pylist() for c in ("size", "word", "toxic")), strict=True):
                    if size:
                        total += gradient(theta, np.frombuffer(size, np.int32).astype(int), np.frombuffer(word, np.int32).astype(int).reshape(-1, 3), np.frombuffer(toxic, np.int8).astype(int), k)
            yield pa.RecordBatch.from_pydict({"g": [total.tobytes()]})

        parts = stretches.select("size", "word", "toxic").mapInArrow(partial, "g binary").collect()  # one row of so many weights a partition
        g = np.sum([np.frombuffer(r["g"]) for r in parts], axis=0)
        return g[:-1] / many - 1e-3 * theta / many**0.5

    theta = fit_chain(slope, k + 5, rounds)
    tagger = Tagger(keys, theta[:k], float(theta[k]), theta[k + 1 :].reshape(2, 2))

    def weigh(batches):
        for batch in batches:
            clean = [_clean(tagger, n, cut, at, word)[1] for _, n, cut, at, word, _, _ in _found(batch["text"], keys)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0), *clean])), batch["toxic"]], ["clean", "toxic"])

    points = rows.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(weigh, "clean double, toxic int").toArrow()  # 2 * sample rows
    order = np.lexsort([points["toxic"].to_numpy(), points["clean"].to_numpy()])
    tagger.scale, tagger.shift = _logistic(evidence(points["clean"].to_numpy()[order]), points["toxic"].to_numpy()[order].astype(float))
    return tagger


def tag(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """doc_id, score, and spans: byte offsets in the text and marginal of each word likelier toxic than not."""
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())])

    def score(batches):
        for batch in batches:
            points, spans, upto = [np.zeros(0)], [], [np.zeros(1, np.int32)]
            for _, n, cut, at, word, start, end in _found(batch["text"], tagger.keys):
                p, clean = _clean(tagger, n, cut, at, word)
                points.append(tagger.scores(clean) if len(tagger.keys) else np.zeros(len(n)))
                bad = np.flatnonzero(p >= 0.5)
                spans.append(pa.StructArray.from_arrays([pa.array(start[bad], pa.int32()), pa.array(end[bad], pa.int32()), pa.array(p[bad])], fields=list(span)))
                upto.append((upto[-1][-1] + np.searchsorted(bad, cut[1:])).astype(np.int32))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(upto)), pa.concat_arrays(spans) if spans else pa.array([], span))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(np.concatenate(points)), lists], ["doc_id", "score", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, score double, spans {SPANS}")


def held_out_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns, learned from all folds but 0."""
    from .language_id import fold

    learn = labels.where(fold(F.col("doc_id"), 5) != 0)
    found = tag(docs, fit(docs, learn))
    return found.select("doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("spans").cast("long").alias("n_spans"), "spans")
