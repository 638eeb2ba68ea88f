"""Yinyang rounds against a full search read literally."""

import hashlib
import math

import numpy as np
import pytest

from tessera.llm import vector_codes as V

SF = "/root/testdata/sf0.001"


def plain(vectors, parts=4, entries=256, rounds=4):
    """codes, errors, books of integer vectors in order of their ids, all in Python's integers."""
    width = len(vectors[0]) // parts
    cut = [[tuple(v[k * width : (k + 1) * width]) for v in vectors] for k in range(parts)]
    books = [c[:entries] for c in cut]

    def nearest(k):
        return [min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(books[k])) for x in cut[k]]

    for _ in range(rounds):
        for k in range(parts):
            own = nearest(k)
            for e in range(len(books[k])):
                mine = [x for x, (_, o) in zip(cut[k], own) if o == e]
                if mine:
                    books[k][e] = tuple(sum(c) // len(mine) for c in zip(*mine))
    told = [nearest(k) for k in range(parts)]
    codes = ["".join(f"{told[k][i][1]:02x}" for k in range(parts)) for i in range(len(vectors))]
    return codes, [sum(told[k][i][0] for k in range(parts)) for i in range(len(vectors))], books


def whole(rows):
    return [[math.floor(1024 * float(np.float32(x))) for x in e] for _, e, _ in rows]


@pytest.mark.parametrize("scale", [1.0, 3000.0])
def test_codes_equal_a_full_search(spark, scale):
    draw = np.random.default_rng(3)
    centre = draw.normal(size=(30, 8)) * scale
    rows = [(i, (centre[i % 30] + draw.normal(size=8) * 0.2 * scale).astype(np.float32).tolist(), i % 3 or None) for i in range(420)]
    rows += [(1000 + i, rows[5][1], 7) for i in range(60)] + [(2000, [0.0] * 8, 1)]  # copies and ties
    bad = [(-1, None, 1), (-2, [1.0, None] * 4, 1), (-3, [float("nan")] * 8, 1), (-4, [float("inf")] + [0.0] * 7, None)]
    frame = spark.createDataFrame([(*r, "clash") for r in [*rows, *bad][::-1]], "vec_id long, embedding array<float>, label int, code string").repartition(3)
    codes, errors, books = plain(whole(rows))
    got = {r["vec_id"]: r for r in V.digest(frame).collect()}
    assert len(got) == len(rows)
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    by_label = {}
    for (_, _, label), e in zip(rows, errors):
        by_label[label] = by_label.get(label, 0) + e
    for (i, _, label), code, error in zip(rows, codes, errors):
        r = got[i]
        assert (r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) == (code, error, by_label[label], sha)


def test_bounds_spare_most_groups(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    n = rows.count()
    _, books, scans = V.encode_vectors(rows)
    groups = sum(len(set(V.grouped(b, 16))) for b in books)
    assert scans[0] == n * groups and all(s < scans[0] for s in scans[1:]) and scans[-1] < 0.8 * scans[0]


def test_few_short_and_no_vectors(spark):
    schema = "vec_id long, embedding array<double>, label string"
    rows = [(None, [1.0, 2.0, 3.0], "a"), (4, [], "a"), (4, [-0.5], None), (2, [1.0] * 5, None), (2, [1.0] * 5, None)]
    got = V.digest(spark.createDataFrame(rows, schema)).collect()
    padded = [[math.floor(1024 * x) for x in e + [0.0] * (8 - len(e))] for e in ([1.0] * 5, [1.0] * 5, [-0.5], [], [1.0, 2.0, 3.0])]
    padded[2:4] = sorted(padded[2:4])
    codes, errors, _ = plain(padded)
    assert sorted((r["vec_id"] if r["vec_id"] is not None else 9, r["code"], r["error"]) for r in got) == sorted(zip((2, 2, 4, 4, 9), codes, errors))
    assert V.digest(spark.createDataFrame([], schema)).collect() == []
    with pytest.raises(ValueError, match="beyond"):
        V.digest(spark.createDataFrame([(1, [1e9], "a")], schema))


def test_squares_are_exact_for_large_numbers():
    x = np.array([[V.LARGEST, -V.LARGEST]], np.int64)
    book = np.array([[-V.LARGEST, V.LARGEST], [V.LARGEST, -V.LARGEST + 1]], np.int64)
    assert V.squares(x, book).tolist() == [[8 * V.LARGEST**2, 1]]
