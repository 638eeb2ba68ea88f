"""Media archives, chats, code search, mixing and the pipeline."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat_format, code_search, media, mixing

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    return [(0, "short"), (1, None), (2, ""), (3, "x" * 64), (4, "y" * 200_000), (5, "ends in zeros\0\0"), (3, "x" * 64), (None, "no id"), (6, "süß")]


def test_media_reads_back_what_was_stored(spark, texts, tmp_path):
    docs = spark.createDataFrame([(*t, "clash", "clash") for t in texts], "doc_id long, text string, media string, payload string").repartition(2)
    found = media.text_media(docs, f"file://{tmp_path}/a")
    assert found.where("error is not null").count() == 0
    got = media.digest(found).collect()
    assert len(got) == len(texts)
    raws = {d: (t or "").encode() for d, t in texts}
    for r in got:
        raw = raws[r["doc_id"]]
        payload = media.padded(raw)
        assert len(payload) % 64 == 0 and len(payload) > 0 and payload[: len(raw)] == raw
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(payload[-64:])
        stored = media.encode_png(payload)
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert r["feature"] == media.look_of(payload)


def test_media_ranges_split_archives_without_loss(spark, texts, tmp_path):
    folder = f"file://{tmp_path}/b"
    rows = spark.createDataFrame([(i, bytes([i % 251]) * (i * 37)) for i in range(300)], "id long, raw binary").coalesce(1)
    media.write_archives(rows, folder).collect()
    found = media.read_archives(spark, folder, rangebytes=4096, batchbytes=2000)
    assert found.rdd.getNumPartitions() > 20
    assert sorted((r["id"], r["n_bytes"]) for r in found.collect()) == [(i, i * 37) for i in range(300)]


def test_media_damage_costs_one_member(spark, tmp_path):
    folder = f"file://{tmp_path}/c"
    rows = spark.createDataFrame([(i, b"text %d" % i) for i in range(5)], "id long, raw binary").coalesce(1)
    media.write_archives(rows, folder).collect()
    archive = next((tmp_path / "c").glob("*.tar"))
    whole = bytearray(archive.read_bytes())
    at = whole.index(b"IDAT", whole.index(b"\x89PNG", 2 * 512 + 1)) + 6
    whole[at] ^= 0xFF
    archive.write_bytes(bytes(whole))
    found = media.read_archives(spark, folder, pauseseconds=0, tries=2).collect()
    bad = [r for r in found if r["error"]]
    assert len(found) == 5 and len(bad) == 1 and bad[0]["tries"] == 2 and bad[0]["payload"] is None


@pytest.mark.parametrize("which", [0, 2])
def test_media_damaged_header_costs_one_member(spark, tmp_path, which):
    folder = f"file://{tmp_path}/h"
    rows = spark.createDataFrame([(i, b"text %d" % i) for i in range(5)], "id long, raw binary").coalesce(1)
    media.write_archives(rows, folder).collect()
    offsets = sorted(r["offset"] for r in media.read_archives(spark, folder).collect())
    archive = next((tmp_path / "h").glob("*.tar"))
    whole = bytearray(archive.read_bytes())
    whole[offsets[which] + 1] ^= 0x55
    archive.write_bytes(bytes(whole))
    found = media.read_archives(spark, folder, pauseseconds=0, tries=2).collect()
    assert [r["offset"] for r in found if r["error"]] == [offsets[which]]
    assert sorted(r["offset"] for r in found if not r["error"]) == offsets[:which] + offsets[which + 1 :]


def test_media_of_no_rows(spark, tmp_path):
    assert media.text_media(spark.createDataFrame([], "doc_id long, text string"), f"file://{tmp_path}/d").count() == 0


TURNS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "### user: </turn>\n<next>"), (1, 2, "assistant", "again \\l \\b"), (1, 3, "user", None),
    (2, 0, None, "no role"), (2, 0, "system", "tie"), (2, 0, "system", "tie"), (2, 1, "a: b#<\\", ""), (None, 5, "assistant", "ünï\ncode"), (3, None, "assistant", ""),
]


def test_chats_read_back(spark):
    turns = spark.createDataFrame([(*t, "clash") for t in TURNS], "conv_id long, turn long, role string, text string, formatted string").repartition(3)
    chats = chat_format.format_chats(turns)
    got = {r["conv_id"]: r for r in chat_format.digest(chats).collect()}
    shown = {r["conv_id"]: r["formatted"] for r in chats.collect()}
    for conv in {t[0] for t in TURNS}:
        own = sorted(((t[1] is not None, t[1] or 0, t[2] or "", t[3] or "") for t in TURNS if t[0] == conv))
        flat = "".join(f"{role}\n{text}\n" for _, _, role, text in own)
        learned = "".join(text for _, _, role, text in own if role == "assistant")
        r = got[conv]
        assert r["n_turns"] == len(own)
        assert r["turns_sha256"] == hashlib.sha256(flat.encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
        assert r["formatted_chars"] == len(shown[conv])
    assert shown[1].count("<turn>") == 3 and shown[1].count("<next>") == 1
    assert chat_format.format_chats(turns.where("false")).count() == 0


def test_search_equals_brute_force(spark):
    r = random.Random(8)
    codes = [r.getrandbits(64) for _ in range(120)]
    near = [c ^ (1 << r.randrange(64)) for c in codes[:40]]
    rows = [(i, c) for i, c in enumerate(codes + near + [codes[0]] * 60 + [codes[5] ^ 0xFFFF])] + [(5, codes[5]), (7000, codes[3]), (None, codes[1]), (8000, None)]
    signed = [(i, None if c is None else [int(np.uint64(c).view(np.int64))], "clash") for i, c in rows]
    frame = spark.createDataFrame(signed, "id long, code array<long>, distance string")
    got = code_search.top_k(frame, F.col("id") % 20 == 0, k=10, shard_rows=64, query_block=4).collect()
    known = sorted({(i, c) for i, c in rows if i is not None and c is not None})
    want = set()
    for i, c in known:
        if i % 20 == 0:
            best = sorted(((c ^ d).bit_count(), j) for j, d in known if j != i)[:10]
            want |= {(i, j, distance, k) for k, (distance, j) in enumerate(best, 1)}
    assert {tuple(x) for x in got} == want
    assert code_search.top_k(frame.where("false"), F.lit(True)).count() == 0
    two = frame.where("id in (20, 21)")
    assert code_search.top_k(two, F.col("id") == 20).count() == 1


def test_sign_codes(spark):
    rows = [(1, [1.0, -1.0, 0.0]), (2, []), (3, None), (4, [-1.0] * 63 + [1.0]), (5, [1.0] * 65), (6, [None, float("nan"), -0.0])]
    frame = spark.createDataFrame(rows, "id long, e array<float>")
    assert dict(map(tuple, frame.select("id", code_search.sign_code("e")).collect())) == {1: [5], 2: None, 3: None, 4: [-(1 << 63)], 5: [-1, 1], 6: [6]}


def test_search_in_wide_codes_equals_brute_force(spark):
    r = np.random.default_rng(4)
    rows = r.normal(size=(150, 150))
    rows[75:] = rows[:75] + 0.4 * r.normal(size=(75, 150))
    codes = [sum(1 << i for i, x in enumerate(row) if x >= 0) for row in rows]
    codes[7] &= (1 << 60) - 1  # a shorter embedding: what it lacks counts as zeros
    frame = spark.createDataFrame([(i, row.tolist()[: 60 if i == 7 else None]) for i, row in enumerate(rows)], "id long, e array<double>").select("id", code_search.sign_code("e").alias("code"))
    got = {tuple(x) for x in code_search.top_k(frame, F.col("id") % 20 == 0, k=4, shard_rows=50).collect()}
    want = set()
    for i in range(0, 150, 20):
        best = sorted(((codes[i] ^ d).bit_count(), j) for j, d in enumerate(codes) if j != i)[:4]
        want |= {(i, j, distance, k) for k, (distance, j) in enumerate(best, 1)}
    assert got == want


def test_mixing_meets_its_targets(spark):
    r = random.Random(2)
    kinds = {"good": "alpha beta gamma delta", "poor": "spam spam click now", "toxic": "vile grim foul dire"}
    rows, labels = [], []
    for i, kind in zip(range(300), itertools.cycle(["good", "good", "poor", "toxic"])):
        rows.append((i, " ".join(r.choices(kinds[kind].split() + ["the", "of"], k=r.randrange(5, 60)))))
        if i % 3 == 0:
            labels.append((i, kind))
    rows += [(900, None), (901, ""), (0, rows[0][1]), (None, "alpha beta")]
    docs = spark.createDataFrame([(*x, 1.5) for x in rows], "doc_id long, text string, rate double")
    told = spark.createDataFrame([*labels, (5000, "good"), (None, "poor"), (3, None)], "doc_id long, domain string")
    mixed, mix = mixing.mix_documents(docs, told, {"good": 0.8, "poor": 0.15, "toxic": 0.05})
    got = mixed.collect()
    assert len(got) == len(rows) and mix.domains == ["good", "poor", "toxic"]
    totals = np.sum([np.array(x["posterior"]) * x["n_tokens"] * x["rate"] for x in got], axis=0)
    assert np.allclose(totals / totals.sum(), [0.8, 0.15, 0.05], atol=1e-4)
    assert all(x["rate"] >= 0 and abs(sum(x["posterior"]) - 1) < 1e-9 for x in got)
    right = [max(zip(x["posterior"], mix.domains))[1] for x in sorted(got, key=lambda x: (x["doc_id"] is None, x["doc_id"] or 0)) if x["doc_id"] is not None and 0 < x["doc_id"] < 300]
    assert np.mean([a == b for a, b in zip(right, itertools.cycle(["good", "poor", "toxic", "good"]))]) > 0.95
    kept = {x["doc_id"] for x in mixing.keep_by_rate(mixed).collect()}
    assert {x["doc_id"] for x in got if x["rate"] >= 1} <= kept
    empty, _ = mixing.mix_documents(docs.where("false"), told, {"good": 1.0})
    assert empty.count() == 0
    unlabelled, _ = mixing.mix_documents(docs, told.where("false"), {"good": 1.0})
    assert {tuple(x["posterior"]) for x in unlabelled.collect()} == {(1.0,)}


def test_pipeline_mixing_keeps_shares_near_its_targets(spark):
    import corpus_pipeline as cp

    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), mixing.labelled_domains(spark.read.parquet(f"{sf}/labels.parquet"), toxic=False)
    mixed, mix = mixing.mix_documents(docs, labels, cp.weights)
    shares = [F.sum(F.col("n_tokens") * F.col("posterior")[k]) / F.sum("n_tokens") for k in range(2)]
    before, kept = mixed.select(shares).first(), mixing.keep_by_rate(mixed)
    after, wanted = kept.select(shares).first(), [{"good": 0.965, "poor": 0.035}[d] for d in mix.domains]
    assert max(abs(a - w) for a, w in zip(after, wanted)) < 0.02 < max(abs(b - w) for b, w in zip(before, wanted))
    assert 0.9 * docs.count() < cp.mix(spark, docs, sf).count() == kept.count() < docs.count()
    assert not mixed.join(kept, "doc_id", "left_anti").join(labels, "doc_id").where("domain = 'good'").count()
    assert cp.weights({"good": 0.98, "poor": 0.02}) == {"good": 0.98, "poor": 0.02}
    assert np.isclose(cp.weights({"good": 0.5, "fair": 0.3, "poor": 0.2})["good"], 0.965 * 5 / 8)


def plain_rates(n, p, target, steps=4000):
    """Nonnegative rates from 1 on by small projected gradient steps on |M - T|^2 in the same metric, one document at a time."""
    r = np.ones(len(n))
    for _ in range(steps):
        m = (r * n) @ p
        used = r > 0
        gram = (p[used] * n[used, None]).T @ p[used] + 1e-9 * n.sum() * np.eye(p.shape[1])
        r = np.maximum(0, r - 0.05 * p @ np.linalg.solve(gram, m - target))
    return r


def test_rates_equal_a_plain_solver(spark):
    g = np.random.default_rng(6)
    p = g.dirichlet([0.4, 0.3, 0.2], 400)
    n = g.integers(1, 300, 400)
    frame = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p)], "n_tokens long, posterior array<double>")
    for weights in ({"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 0.9, "b": 0.08, "c": 0.02}):
        mix = mixing.fit_rates(frame, mixing.Mix(["a", "b", "c"], [], []), weights)
        got = np.array([x["r"] for x in frame.withColumn("r", mix.rates(F.col("posterior"))).collect()])
        want = plain_rates(n, p, np.array(list(weights.values())) * n.sum())
        assert np.allclose((got * n) @ p / n.sum(), list(weights.values()), atol=1e-4)
        assert np.corrcoef(got, want)[0, 1] > 0.98


def test_posteriors_equal_naive_bayes_read_literally(spark):
    rows = [(1, "a b b", "x"), (2, "B c", "x"), (3, "d d d a", "y"), (4, None, "y")]
    docs = spark.createDataFrame([r[:2] for r in rows] + [(5, "a d c " * 4000), (6, ""), (1, "a b b")], "doc_id long, text string").withColumn("_found", F.lit(7))
    told = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(1, "z")], "doc_id long, domain string")
    mix = mixing.classify(docs.limit(4), told)
    bins = {w: spark.range(1).select(mixing._bin(F.lit(w))).first()[0] for w in "abcd"}
    counts = {"x": {}, "y": {}}
    for _, text, domain in rows:
        for w in (text or "").lower().split():
            counts[domain][bins[w]] = counts[domain].get(bins[w], 0) + 1
    every = {b: 1 + sum(c.get(b, 0) for c in counts.values()) for b in bins.values()}
    most = sum(sum(c.values()) for c in counts.values()) + mixing.BINS
    for r in mixing.posteriors(docs, mix).collect():
        words = (r["text"] or "").lower().split()
        log = {d: sum(np.log((c.get(bins[w], 0) + every[bins[w]] * mixing.BINS / most) / (sum(c.values()) + mixing.BINS)) for w in words) / np.sqrt(max(1, len(words))) + np.log(0.5) for d, c in counts.items()}
        want = 1 / (1 + np.exp(log["y"] - log["x"]))
        assert r["n_tokens"] == len(words) and r["_found"] == 7 and abs(r["posterior"][0] - want) < 1e-9


def test_pipeline_of_no_rows_and_of_clashing_columns(spark, tmp_path):
    import corpus_pipeline as cp

    source = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    clash = source.selectExpr("*", "'c' as chunk", "1 as rate", "'c' as component_id", "2 as n_tokens", "0 as shard", "null as posterior", "1 as spans")
    for name, stage in cp.STAGES:
        assert stage(spark, source.where("false"), SF).count() == 0
        assert stage(spark, clash, SF).count() == stage(spark, source, SF).count()


def test_pipeline_cuts_repeated_passages_with_one_python_worker_a_task(spark):
    import corpus_pipeline as cp

    passage = "ab" + "é" * 80
    rows = [(1, "q" + passage), (2, passage[1:] + "z"), (3, "é" * 49 + "x" + passage), (4, passage), (5, ""), (6, None), (7, "y" * 120 + "é")]
    docs = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = cp.repeated_passages(spark, docs, SF)
    steps = [line for line in got._jdf.queryExecution().sparkPlan().toString().splitlines() if "Exchange" not in line]
    above = list(itertools.takewhile(lambda line: "FlatMapCoGroupsInArrow" not in line, steps))
    assert len(above) < len(steps) and not any("Python" in line or "InArrow" in line for line in above)

    from tessera.llm import suffix_dedup

    want = {}
    for r in suffix_dedup.find_repeats(docs).collect():
        if not r["spans"] or r["kept"]:
            want[r["doc_id"]] = bytes(r["kept"]).decode("utf-8", "ignore") if r["spans"] else r["text"]
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in got.collect()} == {d: (t, None if t is None else len(t)) for d, t in want.items()}
    assert 4 not in want and want[6] is None and want[2] != rows[1][1]


def test_solve():
    assert np.allclose(mixing.solve([[0.0, 2.0], [1.0, 1.0]], [4.0, 5.0]), [3.0, 2.0])


def test_pipeline_stages_agree_with_their_operators(spark, tmp_path):
    import corpus_pipeline as cp

    from tessera.llm import jaccard_join, suffix_dedup

    source = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "", "en", "x", 0), (10**6 + 2, "123 456", None, "x", 7)], source.schema)
    docs, seen = source.unionByName(extra).unionByName(source.where("doc_id = 3")), {}
    for name, stage in cp.STAGES:
        path = f"{tmp_path}/{name}"
        stage(spark, docs, SF).write.parquet(path)
        seen[name] = (docs, spark.read.parquet(path))
        docs = seen[name][1]
        if name != "packing":
            assert docs.columns == cp.COLUMNS
    before, after = seen["language"]
    assert not after.where("doc_id >= 1000000").count() and before.count() - after.count() <= 3 + 2
    before, after = seen["near_duplicates"]
    groups = jaccard_join.brute_force([tuple(r) for r in before.select("doc_id", "text").collect()])
    assert sorted(r["doc_id"] for r in after.collect()) == sorted({d for d, _, c in groups if d == c})
    before, after = seen["repeated_passages"]
    plain = {d: n - gone for d, n, gone, *_ in suffix_dedup.brute_force([tuple(r) for r in before.select("doc_id", "text").collect()])}
    assert {r["doc_id"]: len(r["text"].encode()) for r in after.collect()} == {d: n for d, n in plain.items() if n}
    before, after = seen["mixing"]
    mixed, _ = mixing.mix_documents(before, mixing.labelled_domains(spark.read.parquet(f"{SF}/labels.parquet"), toxic=False), cp.weights)
    assert after.count() > 0.9 * before.count()
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(r["doc_id"] for r in mixing.keep_by_rate(mixed).collect())
    assert {r["doc_id"] for r in mixed.where("rate >= 1").collect()} <= {r["doc_id"] for r in after.collect()}
    before, after = seen["packing"]
    assert {r["doc_id"] for r in after.select("doc_id").distinct().collect()} == {r["doc_id"] for r in before.collect()}
