"""Mixing documents to target weights of domains, with DataFrame expressions only.

1. A naive Bayes classifier over hashed words is counted on at most ``sample``
   rows of the labelled table (lowest hash of the id; a documented bound),
   smoothed by the words of all domains together. Every
   text gets a posterior p over the domains, its evidence tempered by the square
   root of its words, so that long texts keep a soft membership.
2. Each document gets a rate r >= 0, from 1, so that the expected tokens
   M_k = sum r n p_k of every domain match its target T_k. Projected gradient on
   the least squares 1/2 |M - T|^2, scaled by the Gram matrix G = sum n p p^T of
   the documents whose rate is not 0: r <- max(0, r - p . G^-1 (M - T)).
   One aggregate of K + K^2 numbers per step; r stays a column expression.

Defined cases: null or empty text: no tokens, posterior = shares of the labels,
and a rate like any other; of several labels of an id the least domain counts;
repeated rows count each; labels of unknown ids and null domains are ignored; a
domain without a target gets what is left over evenly; with nothing labelled,
posteriors are even; documents whose columns clash with added ones keep their
own in `mix` under the given names only (added columns come last and replace
them); an empty table gives no rows.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import durable

BINS = 1024


def let(value: Column, use) -> Column:
    """use(value), with value computed once even where Catalyst pushes a filter on it below the projection that made it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


@dataclass
class Mix:
    """What was fitted: log weights by domain and bin, log priors, the gradient steps, totals before and after."""

    domains: list[str]
    weights: list[list[float]]
    priors: list[float]
    steps: list[list[float]] = field(default_factory=list)
    targets: list[float] = field(default_factory=list)
    totals: list[float] = field(default_factory=list)

    def rates(self, posterior: Column) -> Column:
        """The documents' rates after all steps, as an expression of the posterior."""

        def step(r: Column, p: Column, pulls: list[float]) -> Column:
            return F.greatest(F.lit(0.0), r - sum((p[k] * g for k, g in enumerate(pulls)), F.lit(0.0)))

        return let(posterior, lambda p: reduce(lambda r, pulls: step(r, p, pulls), self.steps, F.lit(1.0)))


def solve(matrix: list[list[float]], right: list[float]) -> list[float]:
    """Gauss elimination with pivots, for a system as small as the number of domains."""
    rows = [[*row, b] for row, b in zip(matrix, right, strict=True)]
    n = len(rows)
    for i in range(n):
        best = max(range(i, n), key=lambda k: abs(rows[k][i]))
        rows[i], rows[best] = rows[best], rows[i]
        for k in range(n):
            if k != i and rows[i][i]:
                factor = rows[k][i] / rows[i][i]
                rows[k] = [x - factor * y for x, y in zip(rows[k], rows[i], strict=True)]
    return [row[n] / row[i] if row[i] else 0.0 for i, row in enumerate(rows)]


def words_of(text: str) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def _bin(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BINS)).cast("int")


def classify(docs: DataFrame, labelled: DataFrame, sample: int = 10_000) -> Mix:
    """Counts words by domain over the labelled rows (doc_id, domain); sample bounds how many are used."""
    told = labelled.where("doc_id is not null and domain is not null").groupBy("doc_id").agg(F.min("domain").alias("domain"))
    few = told.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    words = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").select("domain", F.explode_outer(words_of("text")).alias("word"))
    held = words.groupBy("domain", _bin(F.col("word")).alias("bin")).agg(F.count("word").alias("n")).collect()  # domains * BINS rows
    rows = few.groupBy("domain").count().collect()
    domains = sorted(r["domain"] for r in rows)
    every_word = [1.0] * BINS
    for r in held:
        if r["bin"] is not None:
            every_word[r["bin"]] += r["n"]
    # a domain of few words is taken to read like all of them: BINS words of the common distribution are added to each
    common = [n * BINS / sum(every_word) for n in every_word]
    counts = {d: list(common) for d in domains}
    for r in held:
        if r["domain"] in counts and r["bin"] is not None:
            counts[r["domain"]][r["bin"]] += r["n"]
    every = float(sum(r["count"] for r in rows)) or 1.0
    share = {r["domain"]: r["count"] / every for r in rows}
    sums = {d: sum(c) for d, c in counts.items()}
    logs = [[math.log(x / sums[d]) for x in counts[d]] for d in domains]
    middle = [sum(col) / len(col) for col in zip(*logs, strict=True)]
    return Mix(domains, [[x - m for x, m in zip(row, middle, strict=True)] for row in logs], [math.log(share[d]) for d in domains])


def posteriors(docs: DataFrame, mix: Mix) -> DataFrame:
    """docs with n_tokens (words) and posterior (array by domain)."""
    zero = F.array(*[F.lit(0.0)] * len(mix.domains))
    rows_of_bins = json.dumps([[mix.weights[k][b] for k in range(len(mix.domains))] for b in range(BINS)])
    tables = F.from_json(F.lit(rows_of_bins), "array<array<double>>")  # folded to one literal

    def logs(bins: Column) -> Column:
        sums = F.aggregate(bins, zero, lambda a, b: F.zip_with(a, F.get(tables, b), lambda x, y: x + y))
        soft = F.sqrt(F.greatest(F.size(bins), F.lit(1)).cast("double"))
        return let(sums, lambda s: F.array(*[F.lit(p) + F.get(s, F.lit(k)) / soft for k, p in enumerate(mix.priors)]))

    def shares(x: Column) -> Column:
        odds = let(F.array_max(x), lambda top: F.transform(x, lambda y: F.exp(y - top)))
        return let(odds, lambda o: let(F.aggregate(o, F.lit(0.0), lambda a, y: a + y), lambda total: F.transform(o, lambda y: y / total)))

    found = let(F.transform(words_of("text"), _bin), lambda b: F.struct(F.size(b).cast("long").alias("n_tokens"), let(logs(b), shares).alias("posterior")))
    name = "_found" + "_" * max([0, *(len(c) for c in docs.columns)])  # longer than any column of the input
    return docs.withColumn(name, found).withColumns({"n_tokens": F.col(f"{name}.n_tokens"), "posterior": F.col(f"{name}.posterior")}).drop(name)


def fit_rates(known: DataFrame, mix: Mix, weights: dict[str, float] | Callable, steps: int = 12, within: float = 1e-6) -> Mix:
    """Adds to mix the gradient steps that bring the domains' expected tokens to weights of all tokens; known has n_tokens and posterior.

    weights may be a function that makes them from the domains' present shares.
    """
    size, shares = len(mix.domains), []
    known = known.select("n_tokens", "posterior")
    p = [F.col("posterior")[k] for k in range(size)]
    for _ in range(steps + 1):
        rated = known.withColumn("r", mix.rates(F.col("posterior")))
        totals = [F.sum(F.col("r") * F.col("n_tokens") * x) for x in p]
        gram = [F.sum(F.when(F.col("r") > 0, F.col("n_tokens") * x * y).otherwise(0.0)) for x in p for y in p]
        sums = rated.select(F.sum("n_tokens"), *totals, *gram).first()
        if not sums[0]:
            break
        if not shares:
            wanted = weights({d: t / sums[0] for d, t in zip(mix.domains, sums[1:], strict=False)}) if callable(weights) else weights
            rest = max(0.0, 1 - sum(wanted.values())) / max(1, sum(d not in wanted for d in mix.domains))
            shares = [max(1e-9, wanted.get(d, rest)) for d in mix.domains]
        mix.targets = [s * sums[0] / sum(shares) for s in shares]
        mix.totals = [float(x) for x in sums[1 : size + 1]]
        gaps = [m - t for m, t in zip(mix.totals, mix.targets, strict=True)]
        if max(abs(g) / t for g, t in zip(gaps, mix.targets, strict=True)) < within or len(mix.steps) == steps:
            break
        matrix = [[float(sums[1 + size + size * i + k]) + (1e-9 * sums[0] if i == k else 0.0) for k in range(size)] for i in range(size)]
        mix.steps.append(solve(matrix, gaps))
    return mix


def labelled_domains(labels: DataFrame, toxic: bool = True) -> DataFrame:
    """(doc_id, domain) of the table labels: toxic (unless that is no domain of its own), else good or poor by quality."""
    domain = F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")
    return labels.select("doc_id", (F.when(F.col("toxic") == 1, "toxic").otherwise(domain) if toxic else domain).alias("domain"))


def mix_documents(docs: DataFrame, labelled: DataFrame, weights: dict[str, float] | Callable, sample: int = 10_000) -> tuple[DataFrame, Mix]:
    """docs with n_tokens, posterior and rate, and the fitted mix."""
    docs = docs.drop("n_tokens", "posterior", "rate")
    mix = classify(docs, labelled, sample)
    if not mix.domains:
        mix = Mix(["all"], [[0.0] * BINS], [0.0])
    known = durable(posteriors(docs.select("text"), mix).select("n_tokens", "posterior"))
    mix = fit_rates(known, mix, weights)
    return posteriors(docs, mix).withColumn("rate", mix.rates(F.col("posterior"))), mix


def keep_by_rate(mixed: DataFrame, whole: float = 1.0, key: str = "doc_id") -> DataFrame:
    """Rows that stay in a corpus where none is repeated: those of a rate of whole or more, and of the others rate / whole by hash."""
    draw = F.pmod(F.xxhash64(key, "text"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return mixed.where(F.col("rate") / F.lit(max(whole, 1e-9)) + draw >= 1)
