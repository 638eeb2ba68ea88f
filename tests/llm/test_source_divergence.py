"""Divergence of sources against the definitions read literally."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import source_divergence as D


def plain(rows, least, top):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))) for text, lang, source in rows]
    df, whole, own, sources = Counter(), Counter(), Counter(), defaultdict(set)
    for lang, source, terms in docs:
        sources[lang].add(source)
        df.update((lang, t) for t in set(terms))
        whole.update((lang, t) for t in terms)
        own.update((lang, source, t) for t in terms)
    f = lambda p, q: (p - q) ** 2 // (p + q)
    out = []
    for lang in sources:
        kept = [t for (x, t), n in df.items() if x == lang and n >= least]
        total = {s: sum(own[lang, s, t] for t in kept) for s in sources[lang]}
        v = len(kept)
        p = {(s, t): 1 + 10**9 * (own[lang, s, t] + 2) // (total[s] + 2 * v) for s in sources[lang] for t in kept}
        q = {t: 1 + 10**9 * (whole[lang, t] + 2) // (sum(total.values()) + 2 * v) for t in kept}
        for s in sources[lang]:
            pairs = sorted((-sum(f(p[s, t], p[o, t]) for t in kept), o.encode()) for o in sources[lang] if o != s)
            terms = sorted((-f(p[s, t], q[t]), t.encode()) for t in kept if own[lang, s, t] and p[s, t] > q[t])[:top]
            out += [(lang, s, part, o.decode(), -value, r + 1) for part, found in (("pair", pairs), ("term", terms)) for r, (value, o) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("width", [None, 64, 1 << 12])
def test_divergence_equals_its_definition(spark, width):
    draw = random.Random(2)
    words = [f"w{i}"[:1] + chr(97 + i % 26) + chr(97 + i // 26) for i in range(90)] + ["Süß", "ÄRGER", "ärger", "中文", "OAK", "oak"]
    rows = [(" ".join(draw.choices(words, weights=[1 / (k + 1) for k in range(len(words))], k=draw.randint(1, 40))), draw.choice(["de", "en", None]), draw.choice(["a", "b", "ü", "c"])) for _ in range(300)]
    rows += [("x9y-Z", "en", None), (None, "fr", "a"), ("", "fr", "b"), ("rare word", "it", "a"), ("...", "it", "z"), ("only", "nl", "one"), rows[0], rows[0]]
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], "text string, lang string, source string, term string, n int").repartition(3)
    got = D.divergence(frame, least=10, top=5, width=width)
    assert sorted(tuple(r) for r in got.select("lang", "source", "part", "item", "value", "rank").collect()) == plain(rows, 10, 5)


def test_the_sketch_never_underestimates_and_drops_rare_terms(spark):
    rows = [("common " + " ".join(chr(97 + (i * 7 + k) % 26) * (3 + (i * 11 + k) % 17) for k in range(9)), "en", "a") for i in range(60)]
    frame = spark.createDataFrame(rows, "text string, lang string, source string").repartition(4)
    width = 1 << 14
    bits = D.sketch(frame, 10, width)
    df = Counter(t for text, _, _ in rows for t in set(D.terms_of(text)))
    terms = list(df)
    passes = D.possible(bits, D.cells_of("en", terms, width))
    assert all(ok for t, ok in zip(terms, passes, strict=True) if df[t] >= 10)
    assert not any(ok for t, ok in zip(terms, passes, strict=True) if df[t] < 10)  # at this width no cell is shared
    assert D.possible(D.sketch(frame, 10, 64), D.cells_of("en", terms, 64)).mean() > np.mean(passes)
    assert {r["term"] for r in D.survivors(frame, bits, width).collect()} == {t.decode() for t in terms if df[t] >= 10}


def test_no_rows_and_no_terms(spark):
    schema = "text string, lang string, source string"
    assert D.divergence(spark.createDataFrame([], schema)).collect() == []
    got = D.divergence(spark.createDataFrame([("a b", "en", "x"), (None, "en", "y"), ("A", None, None)], schema)).collect()
    assert sorted(tuple(r) for r in got) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]


def test_long_terms_and_large_counts(spark):
    from pyspark.sql import functions as F

    rows = [("中" * 50_000, "zh", "a")] * 10 + [("b", "zh", "b")] * 10
    frame = spark.createDataFrame(rows, "text string, lang string, source string")
    assert sorted(tuple(r) for r in D.divergence(frame).collect()) == plain(rows, 10, 10)
    n = 9 * 10**15
    assert spark.range(1).select(D.share(F.lit(n), F.lit(3 * n), F.lit(5)).alias("p")).first()["p"] == 1 + 10**9 * (n + 2) // (3 * n + 10)
