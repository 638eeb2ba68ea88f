"""Token counts of whole texts against the library itself, with huge documents cut small."""

import random

import public_tokenizers
import pytest
import sentencepiece

from tessera.llm import token_counts as T

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(5)
    words = ["Wort", "über", "naïve", "the", "running", "<s>", "</s>", "▁", "1234567", "中文字符", "🙂", "a\0b", "\n\n", "   ", "x" * 40]
    out = ["", None, " ", "  ", "a", "▁", "<s> <unk> </s> <0x0A>"]
    out += [" ".join(draw.choices(words, k=n)) for n in (3, 200, 900)]
    out += ["".join(draw.choices("abcdeABC 中文日本語🙂\n", k=5000)), "a" * 3000, "ab" * 1500, "日本" * 800, "🙂" * 700, " " * 2500, "x" * 1200 + " end " * 300]
    return out


def plain(text):
    return len(sentencepiece.SentencePieceProcessor(model_file=PATH).encode(text or ""))


@pytest.mark.parametrize(("size", "overlap"), [(T.SIZE, T.OVERLAP), (300, 8), (1000, 64)])
def test_counts_equal_the_library(spark, texts, size, overlap):
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(None, texts[9], "x"), (9, texts[9], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string").repartition(3)
    got = sorted(((r["doc_id"] if r["doc_id"] is not None else -1), r["n_bytes"], r["n_tokens"]) for r in T.count_tokens(docs, PATH, size, overlap).collect())
    assert got == sorted(((i if i is not None else -1), len((t or "").encode()), plain(t)) for i, t, _ in rows)


def test_a_stable_place_ends_a_token_wherever_the_text_is_cut(texts):
    v = T.vocabulary(PATH)
    text = texts[9].replace(" ", "▁")
    data = text.encode()
    whole = set(v.ends(data).tolist())
    places = [p for p in range(1, len(data)) if v.stable(data, p)]
    assert len(places) > 100 and set(places) <= whole
    for p in places[::37]:
        assert set((v.ends(data[p:]) + p).tolist()) == {e for e in whole if e > p}


def test_very_long_text_is_spread_over_chunks(spark):
    text = "The quick brown fox über 中文 " * 60_000  # 2.3 MB
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert T.count_tokens(docs, PATH).first()["n_tokens"] == plain(text)
    assert len(T.cuts(len(text.encode()), T.SIZE, T.OVERLAP)) > 30


def test_counts_of_no_rows_and_other_vocabularies(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert T.digest(T.count_tokens(none, PATH)).collect() == []
    with pytest.raises(Exception):  # noqa: B017
        T.Vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
