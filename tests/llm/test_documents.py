"""The document operators against plain versions, on cases that break careless code."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import exchange, jaccard_join, language_id, lm_scoring, packing, suffix_dedup, textbytes, toxicity
from tessera.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, chunk string, row string"
WORDS = "the quick brown fox jumps over lazy dog while seven wizards quietly mix potions near an old stone bridge in autumn rain".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Nulls, empty and very long texts, repeated rows, equal ids, copies, near copies, shared passages, clashing columns."""
    base, passage = prose(1, 300), prose(2, 60)
    near = base.split()
    near[100] = "changed"
    texts = [
        (0, base), (1, base), (2, " ".join(near)), (3, None), (4, ""), (5, "one two"), (6, "ONE  two"), (7, prose(3, 80) + " " + passage), (8, passage + "\n" + prose(4, 90)),
        (9, prose(5, 6000)), (10, "é" * 150), (11, "x" + "é" * 150), (12, "a" * 400), (13, "   \n\t "), (7, prose(3, 80) + " " + passage), (14, "\\### <|endoftext|> ok  two   spaces "),
        (None, prose(6, 40)), (None, None), (15, "fünf süße Äpfel und Birnen"), (16, "1234 5678"),
    ]
    return [(i, t, "en" if i is None or i % 3 else "de", "s", "clash", "clash") for i, t in texts]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def key(row):
    return tuple((x is not None, x if x is not None else 0) for x in row)


@pytest.mark.parametrize(("chunks", "direct"), [(1, None), (4, None), (7, 2)])
def test_suffix_dedup_equals_the_rule_read_literally(docs, rows, chunks, direct):
    got = suffix_dedup.digest(suffix_dedup.find_repeats(docs, 100, chunks=chunks, direct=direct)).collect()
    assert sorted(map(tuple, got), key=key) == sorted(suffix_dedup.brute_force([r[:2] for r in rows], 100), key=key)


def test_long_texts_are_hashed_in_stretches_and_equal_the_rule(spark):
    long = prose(40, 90_000)
    assert len(long) > 2 * textbytes.SLICE
    rows = [(1, long), (2, long[300_000:300_150] + prose(41, 50_000) + long[-99:]), (3, prose(42, 20) + long[250_000:270_000]), (4, "ab" * 200_000), (5, long[:100])]
    for chunks in (1, 3):
        got = suffix_dedup.digest(suffix_dedup.find_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 100, chunks=chunks)).collect()
        assert sorted(map(tuple, got)) == sorted(suffix_dedup.brute_force(rows, 100))


def test_stretches_find_what_a_whole_text_gives(monkeypatch):
    import pyarrow as pa

    texts = [prose(43, 900), "x" * 3000, None, prose(44, 30), prose(43, 900)[500:2500], "short", ""]
    table = pa.table({"doc_id": list(range(len(texts))), "text": texts})

    def found(size):
        monkeypatch.setattr(textbytes, "SLICE", size)
        chunk = suffix_dedup.Chunk(table, 100, 32)
        keys, around, back, first, left, right = chunk.suffixes()
        starts = np.concatenate([s for s, _ in chunk.strings(keys)])
        return keys, around, keys[back], left, right, starts, chunk.string_keys(keys)

    whole = found(1 << 18)
    for size in (64, 130, 1000):
        for a, b in zip(whole, found(size), strict=True):
            np.testing.assert_array_equal(a, b)


def test_memory_of_a_long_text_follows_its_distinct_strings():
    import tracemalloc

    import pyarrow as pa

    def peak(n):
        text = prose(45, n)
        chunk = suffix_dedup.Chunk(pa.table({"doc_id": [1], "text": [text]}), 100, 32)
        tracemalloc.start()
        keys = chunk.suffixes()[0]
        distinct = chunk.string_keys(keys)
        list(chunk.runs(s, s + 100) for s in chunk.repeated_strings(keys, distinct, np.zeros(len(distinct), bool)))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most, len(text)

    (small, n), (large, m) = peak(40_000), peak(640_000)
    assert large - small < 40 * (m - n)


def test_suffix_dedup_carries_columns_and_takes_empty_tables(docs, none):
    assert {r["source"] for r in suffix_dedup.find_repeats(docs, carry=["source"]).collect()} == {"s"}
    assert suffix_dedup.find_repeats(none).count() == 0


def test_levels_are_scanned_by_each_batch_and_merge_geometrically():
    levels, r = suffix_dedup.SuffixLevels(), np.random.default_rng(1)
    seen: dict[int, int] = {}
    for batch in range(1, 12):
        keys = np.unique(r.integers(0, 200, 40)).astype(np.uint64)
        around = np.where(keys % 7 == 0, r.integers(1, 3, len(keys)), keys + 5).astype(np.uint64)
        verdict, told = levels.scan(keys, around)
        want = [suffix_dedup.KEPT if k not in seen else suffix_dedup.EARLIER if seen[k] == a else suffix_dedup.MIXED for k, a in zip(keys.tolist(), around.tolist())]
        assert verdict.tolist() == want
        levels.add(keys, told)
        seen.update((k, seen.get(k, a) if seen.get(k, a) == a else 0) for k, a in zip(keys.tolist(), around.tolist()))
        assert sorted((rank for rank, _ in levels.levels), reverse=True) == [i for i in range(4, -1, -1) if batch >> i & 1]
        assert levels.mixed().tolist() == sorted(k for k, a in seen.items() if a == 0)


def test_suffixes_fall_into_all_buckets_alike():
    import pyarrow as pa

    table = pa.table({"doc_id": [1], "text": [prose(12, 9000)]})
    keys = suffix_dedup.Chunk(table, 100, 32).suffixes()[0]
    held = np.histogram(keys.astype(float), 8, (0, 2.0**64))[0]
    assert held.min() > 0.8 * held.mean()


def test_chunks_follow_bytes_in_the_order_of_ids(spark):
    texts = [(i, "x" * (4000 if i < 100 else 100)) for i in range(1000)] + [(None, "y" * 50)]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    assert exchange.parts(frame, chunk_bytes=100_000) == 5
    got = exchange.by_range(frame, 5).selectExpr("doc_id", "chunk", "length(text) as n").collect()
    assert [r["chunk"] for r in sorted(got, key=lambda r: r["doc_id"] or -1)] == sorted(r["chunk"] for r in got)
    held = np.bincount([r["chunk"] for r in got], [r["n"] for r in got])
    assert len(held) == 5 and held.max() < 1.5 * held.mean()


def test_chunks_of_ranges_are_cut_within_them_on_executors(spark, monkeypatch):
    """Few ranges, many chunks, one key of a third of all rows, null keys; joined by broadcast and by shuffle."""
    monkeypatch.setattr(exchange, "RANGES", 4)
    ids = [None] * 5 + [7] * 300 + [3 * i for i in range(600)] + [2**62, -(2**62)]
    frame = spark.createDataFrame([(i, "z" * 20, "clash") for i in ids], "doc_id long, text string, at string").repartition(4)
    told = [exchange.by_range(frame, 40, broadcast_bytes=b) for b in (8 << 20, 0)]
    assert "BroadcastHashJoin" not in told[1]._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    one, other = (sorted(df.select("doc_id", "chunk", "at").collect(), key=lambda r: (r[0] is not None, r[0] or 0)) for df in told)
    assert one == other and len(one) == len(ids)
    chunks = [r["chunk"] for r in one]
    assert chunks == sorted(chunks) and chunks[0] == 0 and max(chunks) < 40
    held = np.bincount(chunks, minlength=40)
    hot = chunks[next(i for i, r in enumerate(one) if r["doc_id"] == 7)]
    assert len({r["chunk"] for r in one if r["doc_id"] == 7}) == 1 and np.delete(held, hot).max() <= 2 * len(ids) / 40
    empty = exchange.by_range(frame.where("doc_id = 1"), 3)
    assert empty.columns == [*frame.columns, "chunk"] and empty.count() == 0


def test_blocks_of_an_exchange_grow_less_than_the_square(spark):
    def blocks(chunks, direct):
        e = exchange.Exchange.of(chunks, direct)
        keys = np.sort(np.random.default_rng(chunks).integers(0, 1 << 63, 400).astype(np.uint64) * np.uint64(2))
        return sum(e.asked(c, keys).num_rows for c in range(chunks))

    assert blocks(64, 64) == 64 * 64
    assert blocks(64, 8) == 64 * 8 and blocks(256, 8) == 256 * 16


def alternating(n, a="a", b="b"):
    """Two spans of n letters whose sums of powers modulo 2**64 are equal from n = 1,024 on, whatever the base."""
    first = "".join(a if i.bit_count() % 2 == 0 else b for i in range(n))
    return first, "".join(b if i.bit_count() % 2 == 0 else a for i in range(n))


def test_words_of_equal_sums_are_told_apart(spark):
    rows = []
    for k, (n, a, b) in enumerate([(1024, "a", "b"), (4096, "c", "d"), (4096, "e" * 32, "f" * 32)]):
        rows += [(10 * k + i, f"{word} w x y z{k}") for i, word in enumerate(alternating(n, a, b))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard_join.near_duplicates(frame).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted(jaccard_join.brute_force(rows)) and all(d == c for d, _, c in got)
    removed = suffix_dedup.digest(suffix_dedup.find_repeats(frame, 100)).collect()
    assert sorted(map(tuple, removed)) == sorted(suffix_dedup.brute_force(rows, 100))
    known = {r["doc_id"]: r["n_known"] for r in lm_scoring.score_texts(frame, F.col("doc_id") % 10 == 0).collect()}
    plain = lm_scoring.brute_force([(d, t, d % 10 == 0) for d, t in rows])
    assert known == {r[0]: r[2] for r in plain}


def test_near_duplicates_equal_all_pairs(docs, rows):
    known = [r for r in rows if r[0] is not None]
    got = jaccard_join.near_duplicates(docs.where("doc_id is not null")).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted(jaccard_join.brute_force([r[:2] for r in known]))
    assert jaccard_join.near_duplicates(docs).count() == len(rows)


def test_near_duplicates_of_a_large_family_and_a_chain(spark):
    base = prose(9, 200).split()
    family = [(i, " ".join(base[:i] + [f"edit{i}"] + base[i + 1 :])) for i in range(40)]
    chain = [(100 + i, " ".join(f"c{j}" for j in range(4 * i, 4 * i + 60))) for i in range(12)]
    rows = family + chain
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id").collect()
    want = jaccard_join.brute_force(rows)
    assert sorted(map(tuple, got)) == sorted(want)
    assert {c for d, _, c in want if d >= 100} == {100}


def test_near_duplicates_with_null_ids_bridge_others(spark):
    words = [f"w{i}" for i in range(200)]
    middle = [*words[:192], *(f"x{i}" for i in range(8))]
    steps = [words, middle, [*(f"y{i}" for i in range(8)), *middle[8:]]]
    texts = [(1, " ".join(steps[0])), (None, " ".join(steps[1])), (3, " ".join(steps[2])), (None, " ".join(steps[1])), (None, prose(70, 60)), (9, prose(71, 60))]
    # numbers from 100 on stand for null ids, which no component is named after if it has another
    plain = jaccard_join.brute_force([(100 + i if d is None else d, t) for i, (d, t) in enumerate(texts)], percent=90)
    want = [(None if d >= 100 else d, n, None if c >= 100 else c) for d, n, c in plain]
    got = [tuple(r)[:3] for r in jaccard_join.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), percent=90).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert (3, plain[2][1], 1) in got and (None, plain[1][1], 1) in got


def test_near_duplicates_of_small_vocabularies_in_a_wide_exchange(spark):
    r, rows = random.Random(3), []
    bases = [[f"w{r.randrange(60)}" for _ in range(r.randrange(5, 60))] for _ in range(8)]
    for i in range(160):
        words = list(r.choice(bases))
        for _ in range(r.randrange(4)):
            words[r.randrange(len(words))] = f"w{r.randrange(60)}"
        rows.append((i, " ".join(words)))
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=70, chunks=9, direct=3)
    assert sorted(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect())) == sorted(jaccard_join.brute_force(rows, percent=70))


def test_documents_of_one_template_that_do_not_link_are_no_candidates(spark):
    """20,000 sets of 100 shingles: 15 of their own, 85 of the template, of which the first six are in every prefix."""
    n = 20_000
    posts = spark.range(n).select(F.col("id").cast("string").cast("binary").alias("grp"), F.lit(100).alias("n"), F.explode(F.sequence(F.lit(15), F.lit(20))).alias("pos"), F.col("id").alias("a"), F.col("id").alias("b"))
    posts = posts.withColumn("token", F.col("pos").cast("long"))
    assert jaccard_join.group_pairs(posts, 80).count() == 0
    twins = posts.where("a < 30").withColumn("pos", F.col("pos") - 10)
    assert jaccard_join.group_pairs(twins, 80).count() == 30 * 29 // 2


def test_near_duplicates_of_no_rows(none):
    assert jaccard_join.near_duplicates(none).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(20)] + [(50, 50 + i) for i in range(1, 10)] + [(7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {**{i: 0 for i in range(21)}, **{i: 50 for i in range(50, 60)}}


def test_rounds_of_few_edges_are_few_tasks(spark, monkeypatch):
    from tessera.llm import components as c

    made = []

    def kept(df):
        made.append(df.checkpoint())
        return made[-1]

    c.durable(spark.range(1))  # sets the folder
    monkeypatch.setattr(c, "durable", kept)
    path = spark.createDataFrame([(i, i + 1) for i in range(20)], "u long, v long")
    merged = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merged, "false")
    try:
        assert {tuple(r) for r in c.components(path).collect()} == {(i, 0) for i in range(21)}
        assert len(made) > 2 and all(df.rdd.getNumPartitions() == 1 for df in made[1:])
        monkeypatch.setattr(c, "EDGES", 8)
        made.clear()
        assert {tuple(r) for r in c.components(path).collect()} == {(i, 0) for i in range(21)}
        assert max(df.rdd.getNumPartitions() for df in made[1:]) == 3
    finally:
        spark.conf.unset(merged)


def _ids(rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [(d, tokenizer.encode(t or "", add_special_tokens=False).ids + [0]) for d, t, *_ in rows]


@pytest.mark.parametrize("shards", [1, 3])
def test_packing_keeps_every_id_once_and_pads_nothing(docs, rows, shards):
    import public_tokenizers

    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), window=256, shards=shards).collect()
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append((p["start"], p["length"], np.frombuffer(p["ids"], "<u4").tolist(), p["doc_tokens"]))
        by_sequence.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    want = {}
    for d, ids in _ids(rows):
        want.setdefault(d, []).append(ids)
    for d, lists in want.items():
        got = sorted(x for p in by_doc[d] for x in p[2])
        assert got == sorted(x for ids in lists for x in ids)
        if len(lists) == 1:
            assert [x for p in sorted(by_doc[d]) for x in p[2]] == lists[0]
            assert {p[3] for p in by_doc[d]} == {len(lists[0])}
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256 and at & (at - 1) == 0


def test_both_encoders_give_the_same_ids(rows):
    import public_tokenizers

    encode, r = packing.encoder(public_tokenizers.path("byte_bpe_50k.json")), random.Random(4)
    assert encode.fast is not None
    letters = "abcdefgh THE'sré日本\u00a0\u2028\u0085\t\n  \r0123!?.,<|>\\\U0001f600\u0301\0\x1c"
    texts = [t or "" for _, t, *_ in rows] + ["".join(r.choices(letters, k=r.randrange(200))) for _ in range(3000)]
    texts += ["".join(chr(r.choice([r.randrange(32, 0xD800), r.randrange(0xE000, 0x11000)])) for _ in range(60)) for _ in range(500)]
    texts += ["a" * 5000, " " * 5000, "x" + "\n" * 3000 + "y", "é" * 1999, "<|endoftext|> in a text"]
    latin = "".join(map(chr, range(0x180)))
    texts += ["".join(r.choices(latin + "'  aé", k=r.randrange(80))) for _ in range(3000)] + [latin, latin[::-1], "I'll, we've 'd ''s  \n x", "a \x1c b", "ﬁ \u2028 x"]
    texts += ["".join(r.choices("'stmdrevl aZé \n\tx", k=r.randrange(40))) for _ in range(4000)]
    import pyarrow as pa

    for text, ids in zip(texts, encode.batch(pa.array(texts))):
        assert ids.tolist() == encode.tokenizer.encode(text, add_special_tokens=False).ids
    assert [x.tolist() for x in encode.batch(pa.array(["", None, "a b", None]))] == [[], [], encode("a b").tolist(), []]
    for text in texts[:4000]:
        assert encode(text).tolist() == encode.tokenizer.encode(text, add_special_tokens=False).ids


def test_packing_puts_lexical_neighbours_together():
    tails = [np.array([1, 2, 3, 4] * 10), np.array([9, 8, 7] * 10), np.array([1, 2, 3, 5] * 6), np.array([9, 8, 6] * 11)]
    first = next(packing.fill_windows(tails, 64, 8))
    assert [i for i, _, _ in first] == [0, 2]


def _bm25(tails, seed, k1=1.2, b=0.75):
    """BM25 of every tail for all distinct ids of the seed, read literally."""
    mean, n = sum(map(len, tails)) / len(tails), len(tails)
    held = [set(t.tolist()) for t in tails]
    score = np.zeros(n)
    for term in held[seed]:
        df = sum(term in h for h in held)
        for i, t in enumerate(tails):
            if tf := int((t == term).sum()):
                score[i] += np.log1p((n - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(t) / mean))
    return score


def test_packing_neighbours_equal_full_bm25():
    r = np.random.default_rng(5)
    tails = [np.clip(r.zipf(1.3, r.integers(60, 200)), 1, 400) for _ in range(40)]
    index, unused = packing.LexicalIndex(tails), np.ones(len(tails), bool)
    for part in (unused, r.random(len(tails)) < 0.5):
        index.forget(part)
        for seed in range(len(tails)):
            assert len(set(tails[seed].tolist())) > 12
            score = _bm25(tails, seed)
            got = index.neighbours(tails[seed], part)
            assert set(got) == set(np.flatnonzero(part & (score > 0)))
            assert (np.diff(score[got]) <= 1e-9).all()
    # tail 1 holds the seed's 12 rarest ids, tail 2 the 30 others and so scores higher
    few = [np.arange(42), np.append(np.arange(12), np.full(18, 300)), np.arange(12, 42)] + [np.array([i, 100 + i]) for i in range(12, 42)]
    assert [i for i, _, _ in next(packing.fill_windows(few, 72, 12))] == [0, 1]
    assert [i for i, _, _ in next(packing.fill_windows(few, 72))] == [0, 2]


def _topics(n):
    """n texts of each of three vocabularies, no word in common."""
    r = random.Random(8)
    return [(3 * i + k, " ".join(f"{w}{r.randrange(40)}" for _ in range(60))) for i in range(n) for k, w in enumerate(("apple", "bridge", "cloud"))]


def test_packing_counts_over_all_documents(spark):
    tails = [np.array([1, 2, 2]), np.array([2, 3]), np.array([2]), np.array([4] * 6)]
    corpus = packing.Corpus.of(tails)
    assert (corpus.n, corpus.mean, corpus.df.tolist()) == (4, 3.0, [0, 1, 3, 1, 1])
    table = spark.createDataFrame([(bytearray(t.astype(np.uint16).tobytes()),) for t in tails], "ids binary").repartition(3)
    told = packing.count_corpus(table, np.dtype(np.uint16), 1024)
    assert (told.n, told.mean, told.df.tolist()) == (4, 3.0, [0, 1, 3, 1, 1])
    # within two tails id 2 would be in all; its weight is that of three in four
    one = packing.LexicalIndex(tails[:2], corpus)
    assert np.allclose(one.weight[one.term == 2][1], np.log1p(1.5 / 3.5) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 2 / 3)))


def test_packing_deals_neighbours_together_under_any_setting(spark):
    import public_tokenizers

    frame = spark.createDataFrame(_topics(60), "doc_id long, text string")
    seen = []
    for n in ("3", "40"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            pieces = packing.pack(frame, public_tokenizers.path("byte_bpe_50k.json"), window=512, shards=3).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "3")
        seen.append(sorted((p["doc_id"], p["start"], p["length"], p["sequence_id"], p["offset"]) for p in pieces))
    assert seen[0] == seen[1]
    topics = {}
    for doc, _, _, sequence, _ in seen[0]:
        topics.setdefault(sequence >> 40, []).append(doc % 3)
    assert sum(max(map(x.count, set(x))) for x in topics.values()) >= 0.9 * len(seen[0])


def test_copies_fill_several_shards():
    sample = np.concatenate([np.tile(np.eye(1, packing.DIMS, dtype=np.float32), (90, 1)), -np.eye(1, packing.DIMS, dtype=np.float32)])
    tree = packing.Deal(sample, np.ones(91), 10)
    counts = np.bincount(tree(sample, np.arange(91)))
    assert len(counts) >= 10 and counts.max() <= 12


def test_packing_of_no_rows(none):
    import public_tokenizers

    assert packing.pack(none, public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_language_id_tells_languages_and_rejects(spark, docs, rows, none):
    a, b = "the and of with there which", "der und die nicht eine schon"
    learn = [(i, " ".join(random.Random(i).choices((a if i % 2 else b).split(), k=30)), "en" if i % 2 else "de") for i in range(60)]
    frame = spark.createDataFrame(learn, "doc_id long, text string, lang string")
    model = language_id.fit(frame, clusters=2, sample=20)
    ask = spark.createDataFrame([(1, a), (2, b), (3, None), (4, "12 34"), (5, ""), (6, "zzqx kkvv yyqq")], "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = {r["doc_id"]: r for r in language_id.identify(ask, model).collect()}
    assert [got[i]["lang_pred"] for i in range(1, 6)] == ["en", "de", "und", "und", "und"]
    assert not got[1]["rejected"] and got[3]["rejected"] and got[6]["rejected"]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert language_id.held_out_languages(docs).count() == len(rows)
    assert language_id.held_out_languages(none).count() == 0
    nothing = language_id.identify(ask, language_id.fit(none))
    assert {r["lang_pred"] for r in nothing.collect()} == {"und"}


@pytest.mark.parametrize(("order", "direct"), [(1, None), (2, 1), (3, None)])
def test_lm_scores_equal_the_model_read_literally(docs, rows, order, direct):
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2
    got = lm_scoring.score_texts(docs, train, order, chunks=5, direct=direct).collect()
    plain = lm_scoring.brute_force([(d, t, d is not None and zlib.crc32(str(d).encode()) % 7 != 2) for d, t, *_ in rows], order)
    mine = sorted(((r["doc_id"] or -1, r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in got))
    assert mine == sorted((d or -1, n, k, t, round(b, 6), round(s, 6)) for d, n, k, t, b, s in plain)


def test_lm_probabilities_sum_to_one():
    texts = [(0, "a b a c a b", True), (1, "b a", True)]
    for history in ("a", "b"):
        known = ["a", "b", "c"]
        total = 0.0
        for w in [*known, "unseen"]:
            both = lm_scoring.brute_force([*texts, (2, f"{history} {w}", False), (3, history, False)], 2)
            total += 10 ** (both[2][5] - both[3][5] + _end(texts, history) - _end(texts, w))
        total += 10 ** _end(texts, history)
        assert abs(total - 1) < 1e-9


def _end(texts, history):
    """log10 of the end after a history, read off from texts of one and no word."""
    rows = lm_scoring.brute_force([*texts, (9, history, False)], 2)
    one = lm_scoring.brute_force([*texts, (9, history, False)], 1)
    uni_end = lm_scoring.brute_force([*texts, (9, "", False)], 1)[-1][5]
    return rows[-1][5] - (one[-1][5] - uni_end)


def test_lm_of_no_rows(none):
    assert lm_scoring.score_texts(none, F.lit(True)).count() == 0


def test_toxicity_learns_words_and_their_places(spark, none):
    r = random.Random(5)
    plain = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    rows, labels = [], []
    for i in range(400):
        words = r.choices(plain, k=40)
        toxic = i % 4 == 0
        if toxic:
            words[7] = r.choice(["vilethug", "Grotscum"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic), 1))
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (None, "vilethug")], "doc_id long, text string")
    frame = spark.createDataFrame([*labels, (3, None, 1), (None, 1, 1)], "doc_id long, toxic int, quality int")
    tagger = toxicity.fit(docs, frame.where("doc_id < 300 or doc_id is null"))
    got = {x["doc_id"]: x for x in toxicity.tag(docs, tagger).collect()}
    held = [i for i in range(300, 400)]
    assert all((got[i]["score"] >= 0.5) == (i % 4 == 0) for i in held)
    span = got[300]["spans"][0]
    assert rows[300][1].encode()[span["start"] : span["end"]].decode().lower() in ("vilethug", "grotscum")
    assert got[900]["score"] < 0.5 and got[901]["score"] == got[900]["score"] and got[None]["score"] >= 0.5
    assert toxicity.tag(none, tagger).count() == 0
    assert {x["score"] for x in toxicity.tag(docs, toxicity.fit(docs, frame.where("toxic = 0"))).collect()} == {0.0}


def full_marginals(tagger, n, at, score):
    """Forward-backward over every word of one text, read literally; also the log of the sum over all paths."""
    emit = np.full(n, np.exp(tagger.plain))
    emit[at] = np.exp(score)
    step = np.exp(tagger.step)
    forward, backward = np.zeros((n, 2)), np.ones((n, 2))
    forward[0] = [1, emit[0]]
    for i in range(1, n):
        forward[i] = forward[i - 1] @ step * [1, emit[i]]
    for i in range(n - 2, -1, -1):
        backward[i] = step @ ([1, emit[i + 1]] * backward[i + 1])
    full = forward * backward
    return full[:, 1] / full.sum(1), np.log(forward[-1].sum())


def test_marginals_equal_a_full_chain():
    r = np.random.default_rng(3)
    tagger = toxicity.Tagger(np.arange(3, dtype=np.uint64), r.normal(size=3), -0.7, r.normal(size=(2, 2)))
    places = [(17, [0, 4, 5, 16]), (3, []), (1, [0]), (9, [8]), (40, [2, 3, 30])]
    n, at = np.array([p[0] for p in places]), np.array([x for p in places for x in p[1]])
    cut = np.cumsum([0, *(len(p[1]) for p in places)])
    score = r.normal(size=len(at))
    want = np.concatenate([full_marginals(tagger, p[0], np.array(p[1], int), score[a:b])[0][np.array(p[1], int)] for p, a, b in zip(places, cut, cut[1:])])
    assert np.allclose(tagger.marginals(n, cut, at, score), want)


def test_gradient_equals_differences_of_the_likelihood_read_literally():
    r = np.random.default_rng(4)
    size = np.array([5, 1, 8])
    word = r.integers(-1, 4, (14, 3))
    word[r.random(14) < 0.4] = -1
    toxic = r.integers(0, 2, 14)
    theta = r.normal(size=4 + 1 + 4)

    def likelihood(theta):
        total, first = 0.0, 0
        tagger = toxicity.Tagger(plain=theta[4], step=theta[5:].reshape(2, 2))
        for n in size:
            own, y = word[first : first + n], toxic[first : first + n]
            at = np.flatnonzero((own >= 0).any(1))
            score = np.array([sum(theta[f] for f in own[i] if f >= 0) for i in at])
            emit = np.full(n, theta[4])
            emit[at] = score
            path = emit[y == 1].sum() + sum(theta[5 + 2 * a + b] for a, b in zip(y[:-1], y[1:]))
            total += path - full_marginals(tagger, n, at, score)[1]
            first += n
        return total

    got = toxicity.gradient(theta, size, word, toxic, 4)
    assert np.isclose(got[-1], likelihood(theta))
    for i in range(len(theta)):
        near = np.zeros(len(theta))
        near[i] = 1e-6
        assert np.isclose(got[i], (likelihood(theta + near) - likelihood(theta - near)) / 2e-6, atol=1e-4)


def test_toxic_words_that_were_never_labelled_are_found_by_their_affixes(spark):
    r = random.Random(9)
    plain = [f"{a}{b}{c}en" for a in "bdfgk" for b in "aeiou" for c in "lmnr"]
    rows, labels = [], []
    for i in range(500):
        words = r.choices(plain, k=30)
        if i % 4 == 0:
            words[r.randrange(30)] = "zxq" + r.choice(["abel", "omir", "utan", "erip"]) + "ughx"
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 0)))
    unseen = [(600, " ".join(plain[:20]) + " zxqinolughx " + plain[3]), (601, " ".join(plain[:22])), (602, " ".join(plain) * 300 + " zxqinolughx")]
    docs = spark.createDataFrame([(*x, "clash", 1) for x in [*rows, *unseen, unseen[0]]], "doc_id long, text string, score string, toxic int")
    tagger = toxicity.fit(docs, spark.createDataFrame([*labels, (4, 0), (1, None)], "doc_id long, toxic int"))
    got = [x for x in toxicity.tag(docs, tagger).collect() if x["doc_id"] >= 600]
    assert sorted((x["doc_id"], x["score"] >= 0.5) for x in got) == [(600, True), (600, True), (601, False), (602, True)]
    for x in got:
        text = dict(unseen)[x["doc_id"]]
        assert [text.encode()[s["start"] : s["end"]] for s in x["spans"]] == ([b"zxqinolughx"] if x["doc_id"] != 601 else [])
    # a document's score, read literally: the marginals of a full chain over all of its words
    for x in [x for x in toxicity.tag(docs, tagger).collect() if x["doc_id"] in (0, 1, 600, 602)]:
        import pyarrow as pa

        text = dict([*rows, *unseen])[x["doc_id"]]
        (_, n, _, at, word, _, _), = toxicity._found(pa.array([text]), tagger.keys)
        score = [sum(tagger.weight[f] for f in w if f >= 0) for w in word]
        p = full_marginals(tagger, int(n[0]), at, score)[0][at] if n[0] < 200 else None
        if p is not None:
            odds = 1 / np.prod(1 - np.minimum(p, 1 - 1e-9)) - 1 if len(p) else 1e-6
            assert np.isclose(x["score"], 1 / (1 + np.exp(-(tagger.scale * np.log(max(odds, 1e-6)) + tagger.shift))), atol=1e-4)


def plain_languages(train, ask, bins, slack, sharpness=40.0):
    """Nearest of one centroid a language, read literally: pred, score, similarity, rejected of each text."""
    import math
    from collections import Counter

    def grams(text):
        raw = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).encode()
        out = Counter()
        for n in (1, 2, 3):
            for i in range(len(raw) - n + 1):
                g = int.from_bytes(raw[i : i + n], "big") + (n << 26)
                out[(g * 2654435761 % 2**32 >> 16) % bins] += 1
        return out

    df = Counter(g for text, _ in train for g in grams(text))
    idf = [math.log((1 + len(train)) / (1 + df[b])) + 0.1 for b in range(bins)]

    def vector(text):
        v = {g: math.log1p(c) * idf[g] for g, c in grams(text).items()}
        size = math.sqrt(sum(x * x for x in v.values())) or 1.0
        return {g: x / size for g, x in v.items()}

    def cos(a, b):
        return sum(x * b.get(g, 0.0) for g, x in a.items())

    centre, limit = {}, {}
    for lang in sorted({x for _, x in train}):
        own = [vector(t) for t, x in train if x == lang]
        total = Counter()
        for v in own:
            total.update(v)
        size = math.sqrt(sum(x * x for x in total.values()))
        centre[lang] = {g: x / size for g, x in total.items()}
        limit[lang] = slack * min(cos(v, centre[lang]) for v in own)
    out = []
    for text in ask:
        near = {lang: cos(vector(text), c) for lang, c in centre.items()}
        best = max(sorted(near), key=near.get)
        out.append((best, 1 / sum(math.exp(sharpness * (x - near[best])) for x in near.values()), near[best], near[best] < limit[best]))
    return out


def test_languages_equal_nearest_centroids_read_literally(spark):
    r = random.Random(7)
    words = {"aa": "the and of with there which", "bb": "der und die nicht eine schon", "cc": "le et les pas une déjà", "dd": "le et les pas une déjà"}
    train = [(" ".join(r.choices(words[x].split(), k=r.randrange(3, 40))), x) for x in ("aa", "bb", "cc") for _ in range(25)]
    train += [(t, "dd") for t, x in train if x == "cc"] + train[:5]  # two languages that tie, and repeated rows
    ask = [*(w for w in words.values()), "der and the", "THE OF " * 20_000, "zzqx kkvv", "schon déjà", "x"]
    model = language_id.fit(spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(train)], "doc_id long, text string, lang string").repartition(3), clusters=1, bins=512, slack=0.3)
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(ask)], "doc_id long, text string")
    got = [tuple(x)[2:] for x in sorted(language_id.identify(frame, model).collect())]
    want = plain_languages(train, ask, 512, 0.3)
    for text, a, b in zip(ask, got, want, strict=True):
        assert a[0] == b[0] or {a[0], b[0]} == {"cc", "dd"}, text[:20]
        assert np.allclose(a[1:3], b[1:3], atol=2e-4) and a[3] == b[3], text[:20]
    assert got[2][0] == "cc" and abs(got[2][1] - 0.5) < 1e-3
