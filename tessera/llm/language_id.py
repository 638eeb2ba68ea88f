"""Language identification by the nearest of several centroids per language.

A text is a vector of hashed byte n-grams (1 to 3 bytes, A-Z lower-cased), log
term frequency times inverse document frequency, of unit length. Document
frequencies cover every training document. Per language, spherical k-means on
at most ``sample`` training documents (drawn by a hash of id and text; a
documented bound) gives ``clusters`` centroids. A text gets the language of the
centroid of highest cosine. It is rejected if that cosine is below the
centroid's limit: ``slack`` times the lowest cosine of the centroid's sample.

Defined cases: null text or a text without a letter: language ``und``, score 0,
rejected; with nothing to learn from, every text is ``und``. Rows with null
lang are not learned from; repeated rows count each; a null doc_id is in no
fold (not held out, not learned from); other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes as B
from .storage import short_batches, swept

_LETTER = re.compile(r"[^\W\d_]")
_ROWS = 128
UNKNOWN = "und"


def gram_counts(texts, bins: int):
    """Batches of (first row, rows x bins counts) of hashed 1- to 3-byte grams."""
    data, offsets = B.buffer_of(texts)
    for i, j in B.slices(offsets):
        cut = offsets[i : j + 1] - offsets[i]
        d = B.lowered(data[offsets[i] : offsets[j]]).astype(np.uint32)
        two = d[:-1] * np.uint32(256) + d[1:]
        three = two[:-1] * np.uint32(256) + d[2:]
        grams = [(((g + np.uint32(n << 26)) * np.uint32(2654435761)) >> np.uint32(16)) % np.uint32(bins) for n, g in ((1, d), (2, two), (3, three))]
        for a in range(0, j - i, _ROWS):
            b = min(a + _ROWS, j - i)
            out = np.zeros((b - a, bins), np.float32)
            for r in range(a, b):
                s, e = cut[r], cut[r + 1]
                out[r - a] = np.bincount(np.concatenate([g[s : max(s, e - n)] for n, g in enumerate(grams)]), minlength=bins)
            yield i + a, out


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


@dataclass
class Model:
    """langs, centroids and limits go by centroid; idf by bin."""

    langs: list[str]
    centroids: np.ndarray
    limits: np.ndarray
    idf: np.ndarray
    sharpness: float = 40.0

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        return unit(np.log1p(counts) * self.idf)


def _cluster(x: np.ndarray, clusters: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from the point nearest the mean and then the points farthest from those chosen."""
    chosen = [int(np.argmax(x @ x.mean(0)))]
    while len(chosen) < min(clusters, len(x)):
        chosen.append(int(np.argmin((x @ x[chosen].T).max(1))))
    centre = x[chosen]
    for _ in range(rounds):
        nearest = (x @ centre.T).argmax(1)
        centre = unit(np.stack([x[nearest == k].sum(0) if (nearest == k).any() else centre[k] for k in range(len(centre))]))
    return centre


def fit(train: DataFrame, clusters: int = 3, sample: int = 600, bins: int = 4096, slack: float = 0.3) -> Model:
    """Learns from the columns text and lang of train; sample bounds the documents per language that k-means sees."""
    short_batches(train.sparkSession)
    key = F.xxhash64(*[c for c in ("doc_id", "text") if c in train.columns])
    train = train.where("text is not null and lang is not null").select("text", "lang", key.alias("draw"))

    def frequencies(batches):
        total, n = np.zeros(bins, np.int64), 0
        for batch in batches:
            for _, counts in gram_counts(batch["text"], bins):
                total += (counts > 0).sum(0)
                n += len(counts)
        yield pa.RecordBatch.from_arrays([pa.array([np.append(total, n)], pa.list_(pa.int64()))], ["df"])

    held = train.select("text").mapInArrow(swept(frequencies), "df array<long>").select(F.posexplode("df")).groupBy("pos").agg(F.sum("col").alias("n")).collect()
    df = np.zeros(bins + 1)
    for r in held:  # bins + 1 numbers
        df[r["pos"]] = r["n"]
    idf = np.log((1 + df[-1]) / (1 + df[:-1])).astype(np.float32) + np.float32(0.1)
    model = Model([], np.zeros((0, bins), np.float32), np.zeros(0, np.float32), idf)

    def centroids(key, table):
        x = np.concatenate([model.vectors(c) for _, c in gram_counts(table["text"], bins)])
        centre = _cluster(x, clusters)
        best = x @ centre.T
        nearest = best.argmax(1)
        floor = [float(best[nearest == k, k].min()) if (nearest == k).any() else 1.0 for k in range(len(centre))]
        return pa.table({"lang": pa.array([key[0].as_py()] * len(centre), pa.string()), "centre": pa.array([c.astype("<f4").tobytes() for c in centre], pa.binary()), "floor": pa.array(floor, pa.float64())})

    # about twice the sample by hash, however many rows and partitions there are, then exactly the sample
    sizes = {r["lang"]: r["count"] for r in train.groupBy("lang").count().collect()}  # one row a language
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, min(1.0, (2 * sample + 100) / n)).otherwise(share)
    drawn = F.pmod(F.col("draw"), F.lit(1 << 30)) <= share * float(1 << 30)
    ranked = train.where(drawn).withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "text"))).where(F.col("r") <= sample)
    found = sorted(ranked.select("lang", "text").groupBy("lang").applyInArrow(centroids, "lang string, centre binary, floor double").collect())  # clusters rows a language
    if found:
        model.langs = [r["lang"] for r in found]
        model.centroids = np.stack([np.frombuffer(r["centre"], "<f4") for r in found])
        model.limits = np.array([r["floor"] * slack for r in found], np.float32)
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred, score (0 to 1), similarity (cosine) and rejected in place of columns of these names."""
    langs = sorted(set(model.langs))
    of = np.array([langs.index(x) for x in model.langs], int)

    def score(batches):
        for batch in batches:
            texts = batch["text"]
            pred, points, near, out = [], [], [], []
            known = [x is not None and bool(_LETTER.search(x)) and bool(langs) for x in texts.to_pylist()]
            for first, counts in gram_counts(texts, len(model.idf)) if langs else ():
                cos = model.vectors(counts) @ model.centroids.T
                best = np.full((len(cos), len(langs)), -1.0)
                for k, lang in enumerate(of):
                    best[:, lang] = np.maximum(best[:, lang], cos[:, k])
                share = np.exp(model.sharpness * (best - best.max(1, keepdims=True)))
                share /= share.sum(1, keepdims=True)
                top = cos.argmax(1)
                for i in range(len(cos)):
                    lang, ok = of[top[i]], known[first + i]
                    pred.append(langs[lang] if ok else UNKNOWN)
                    points.append(float(share[i, lang]) if ok else 0.0)
                    near.append(float(cos[i, top[i]]) if ok else 0.0)
                    out.append(not ok or bool(cos[i, top[i]] < model.limits[top[i]]))
            n = batch.num_rows
            if not langs:
                pred, points, near, out = [UNKNOWN] * n, [0.0] * n, [0.0] * n, [True] * n
            rest = [(name, batch[name]) for name in batch.schema.names if name not in added]
            yield pa.RecordBatch.from_arrays([c for _, c in rest] + [pa.array(pred, pa.string()), pa.array(points, pa.float64()), pa.array(near, pa.float64()), pa.array(out, pa.bool_())], [x for x, _ in rest] + added)

    added = ["lang_pred", "score", "similarity", "rejected"]
    kept = docs.drop(*added)
    kinds = zip(added, (T.StringType(), T.DoubleType(), T.DoubleType(), T.BooleanType()), strict=True)
    schema = T.StructType([*kept.schema.fields, *(T.StructField(n, k) for n, k in kinds)])
    return kept.mapInArrow(swept(score), schema)


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key as text modulo folds."""
    return F.crc32(key.cast("string").cast("binary")) % folds


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(fold(F.col("doc_id"), 3) != 1)


def held_out_languages(docs: DataFrame) -> DataFrame:
    """The contract's columns, learned from the folds 0 and 2."""
    found = identify(docs.select("doc_id", "text"), fit(training_rows(docs)))
    return found.select("doc_id", F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "similarity", "rejected")
