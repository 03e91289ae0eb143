"""Nearest codes over a codebook in blocks, sums by code and dead codes, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.operators import codebook, vq


def frames(spark, z, e, codes=None):
    v = spark.createDataFrame([(i, None if x is None else [float(y) for y in x]) for i, x in enumerate(z)], "vec_id bigint, z array<double>").repartition(3)
    return v, spark.createDataFrame([(int(c), [float(y) for y in x]) for c, x in zip(range(len(e)) if codes is None else codes, e, strict=True)], "code bigint, e array<double>").repartition(3)


def brute(z, e, codes):
    d = ((z[:, None] - e[None]) ** 2).sum(-1)
    return [min(codes[j] for j in np.flatnonzero(row == row.min())) for row in d], d.min(1)


@pytest.mark.parametrize("kind", ["spread", "clusters", "equal codes", "integers", "far from zero", "one hot cluster"])
def test_blocks_equal_brute_force(spark, kind):
    rng = np.random.default_rng(len(kind))
    n, dim = 150, 5
    e = rng.normal(size=(n, dim))
    if kind == "clusters":
        e = rng.normal(size=(6, dim))[rng.integers(0, 6, n)] * 20 + e * 0.1
    elif kind == "equal codes":
        e = e[rng.integers(0, 12, n)]
    elif kind == "integers":
        e = rng.integers(0, 3, (n, dim)).astype(float)
    elif kind == "far from zero":
        e = e * 1e-2 + 1e3
    elif kind == "one hot cluster":
        e[: n * 2 // 3] = e[:1] + 1e-4 * e[: n * 2 // 3]
    z = np.concatenate([e[rng.integers(0, n, 60)], e[rng.integers(0, n, 60)] + rng.normal(size=(60, dim)) * 0.3, rng.integers(0, 3, (30, dim))])
    codes = rng.permutation(10 * n)[:n] - 3 * n
    v, c = frames(spark, z, e, codes)
    book = codebook.store(c, codes=8)
    blocks = codebook.Blocks(book.path)
    assert len(blocks.files) >= n // 8 and all(len(blocks.block(i)[0]) <= 8 for i in range(len(blocks.files)))
    assert sorted(int(x) for i in range(len(blocks.files)) for x in blocks.block(i)[0]) == sorted(codes.tolist())
    want, d = brute(z, e, codes)
    got = {r.vec_id: (r.code, r.d) for r in vq.assign(v, book).collect()}
    assert [got[i][0] for i in range(len(z))] == want
    assert np.allclose([got[i][1] for i in range(len(z))], d, rtol=1e-9, atol=1e-12)


def test_blocks_far_away_are_not_read(spark):
    rng = np.random.default_rng(7)
    e = np.concatenate([rng.normal(size=(40, 3)) + 100 * k for k in range(10)])
    _, c = frames(spark, [], e)
    blocks = codebook.Blocks(codebook.store(c, codes=16).path)
    read = []
    whole = blocks.block
    blocks.block = lambda i: read.append(i) or whole(i)
    z = e[:40] + 0.01
    codes, _ = blocks.nearest(z)
    assert codes.tolist() == list(range(40)) and len(set(read)) < len(blocks.files) / 2


def test_blocks_beyond_what_is_held(spark, monkeypatch):
    monkeypatch.setattr(codebook, "HELD", 1000)
    rng = np.random.default_rng(8)
    e = rng.normal(size=(90, 4))
    _, c = frames(spark, [], e)
    blocks = codebook.Blocks(codebook.store(c, codes=8).path)
    z = rng.normal(size=(200, 4))
    want, _ = brute(z, e, list(range(90)))
    assert blocks.nearest(z)[0].tolist() == want and blocks.bytes <= 1000
    assert np.array_equal(blocks.vectors(np.array([5, 89, 5])), e[[5, 89, 5]])
    with pytest.raises(ValueError, match="lacks"):
        blocks.vectors(np.array([90]))


def test_small_codebooks_and_empty_tables(spark):
    v, c = frames(spark, [[1.0, 2.0], None], [[0.0, 0.0]], [9])
    assert {r.vec_id: r.code for r in vq.assign(v, c).collect()} == {0: 9, 1: None}
    assert vq.assign(v.limit(0), c).count() == 0
    with pytest.raises(ValueError, match="empty"):
        codebook.store(c.limit(0))


def test_sums_in_small_pieces(spark, monkeypatch):
    monkeypatch.setattr(vq, "SUMS", 300)
    rng = np.random.default_rng(9)
    z, e = rng.normal(size=(500, 3)), rng.normal(size=(60, 3))
    v, c = frames(spark, z, e)
    want, _ = brute(z, e, list(range(60)))
    for d in (vq.sums(vq.assign(v, c)), vq.nearest_sums(v, codebook.store(c, codes=8))):
        rows = d.collect()
        assert len(rows) == len({r.code for r in rows}) == len(set(want))
        for r in rows:
            k = np.array(want) == r.code
            assert r.n == k.sum() and np.allclose(r.s, z[k].sum(0))


def test_kmeans_over_blocks_equals_plain_rounds(spark, monkeypatch):
    monkeypatch.setattr(codebook.store, "__defaults__", (None, 8))
    rng = np.random.default_rng(10)
    z, e = rng.normal(size=(300, 3)), rng.normal(size=(40, 3))
    v, c = frames(spark, z, e)
    got = {r.code: list(r.e) for r in vq.kmeans(v, c, 3).collect()}
    for _ in range(3):
        a = np.array(brute(z, e, list(range(40)))[0])
        e = np.array([z[a == k].mean(0) if (a == k).any() else e[k] for k in range(40)])
    assert np.allclose([got[k] for k in range(40)], e)


def test_no_row_a_coordinate_and_no_nested_loop(spark):
    v, c = frames(spark, np.eye(3), np.eye(3))
    plan = vq.sums(vq.assign(v, c))._jdf.queryExecution().toString()
    assert "Generate" not in plan
    plan = vq.dead_by_window(c, vq.assign(v, c), F.floor(F.col("vec_id") / 2))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_dead_codes_over_stretches_of_the_bitmap(spark):
    codes = [1, 2, 8, 9, 32_768, 32_769, 70_000, 10**9]
    book = spark.createDataFrame([(c,) for c in codes], "code bigint")
    rng = np.random.default_rng(11)
    t = [(i, int(codes[j]) if j >= 0 else None) for i, j in enumerate(rng.integers(-1, len(codes), 60))] + [(600, None)]
    got = vq.dead_by_window(book, spark.createDataFrame(t, "vec_id bigint, code bigint"), F.floor(F.col("vec_id") / 6))
    used = {}
    for i, c in t:
        used.setdefault(i // 6, set()).add(c)
    assert sorted(map(tuple, got.collect())) == sorted((w, c) for w, u in used.items() for c in codes if c not in u)
