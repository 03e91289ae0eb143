"""Training steps of the quantiser as versions of a table, against a plain loop."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from tesserae.streaming import quantizer

DIM, CODES = 3, 9


def data(seed=0):
    rng = np.random.default_rng(seed)
    e = rng.normal(size=(CODES, DIM)) * 3
    e[7:] += 50  # never used
    z = rng.normal(size=(60, DIM))
    return z, e


def frames(spark, z, e):
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(z)], "vec_id bigint, z array<double>")
    return v, spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(e)], "code bigint, e array<double>")


def plain(z, e, batches, revive_every, decay=0.99, epsilon=1e-5, seed=42):
    """States and metrics after each batch of places in z."""
    e, n, s, usage, out = e.copy(), np.ones(len(e)), e.copy(), np.zeros(len(e), int), []
    for k, at in enumerate(batches):
        x = z[at]
        d = ((x[:, None] - e[None]) ** 2).sum(-1)
        code = d.argmin(1)
        mse = d.min(1).sum() / x.size
        count = np.bincount(code, minlength=len(e))
        total = np.zeros_like(s)
        np.add.at(total, code, x)
        n, s = decay * n + (1 - decay) * count, decay * s + (1 - decay) * total
        e = s / ((n + epsilon) / (n.sum() + len(e) * epsilon) * n.sum())[:, None]
        usage = usage + count
        revived = 0
        if revive_every and (k + 1) % revive_every == 0:
            gone = np.flatnonzero(usage == 0)
            order = sorted(at, key=lambda i: (hashlib.md5(f"{seed + k}:revive:{i}".encode()).hexdigest(), i))
            for r, c in enumerate(gone):
                e[c] = s[c] = z[order[r % len(order)]]
                n[c] = 1.0
            usage, revived = np.zeros(len(e), int), len(gone)
        p = count[count > 0] / count.sum()
        out.append((e.copy(), n.copy(), s.copy(), usage.copy(), (len(at), mse, np.exp(-(p * np.log(p)).sum()), (count > 0).mean(), revived)))
    return out


def same(state, want):
    rows = {r.code: r for r in state.collect()}
    assert sorted(rows) == list(range(CODES))
    for c, r in rows.items():
        assert np.allclose(r.e, want[0][c]) and np.isclose(r.ema_n, want[1][c]) and np.allclose(r.ema_sum, want[2][c]) and r.usage == want[3][c]


def test_steps_equal_a_plain_loop_and_repeat(spark, tmp_path):
    z, e = data()
    v, c = frames(spark, z, e)
    root = str(tmp_path / "q")
    batches = [np.arange(k * 20, k * 20 + 20) for k in range(3)]
    want = plain(z, e, batches, 2)
    quantizer.start(c, root)
    for k in range(3):
        m = quantizer.step(v.where(F.floor(F.col("vec_id") / 20) == k), root, k, revive=k == 1)
        r = m.first()
        n, mse, perplexity, usage, revived = want[k][4]
        assert (r.batch, r.n, r.num_revived) == (k, n, revived) and np.allclose([r.commitment_loss, r.loss, r.perplexity, r.codebook_usage], [mse, 0.25 * mse, perplexity, usage])
        same(quantizer.version(spark, root), want[k])
    assert want[1][4][4] >= 2
    # a batch that is committed isn't run again, and one that isn't starts from its own version
    assert quantizer.step(v, root, 1) is None and quantizer.latest(spark, root) == 3
    quantizer.delete(spark, f"{root}/v3")
    quantizer.step(v.where("vec_id >= 40"), root, 2)
    same(quantizer.version(spark, root), want[2])
    quantizer.start(c, root)
    assert quantizer.latest(spark, root) == 3 and not [x for x in quantizer.names(spark, root) if x.startswith("_making")]


def test_without_averages_and_without_vectors(spark, tmp_path):
    z, e = data(1)
    v, c = frames(spark, z, e)
    root = str(tmp_path / "q")
    quantizer.start(c, root)
    r = quantizer.step(v, root, 0, use_ema=False).first()
    assert r.codebook_loss == r.commitment_loss and np.isclose(r.loss, 1.25 * r.commitment_loss)
    assert {x.code: list(x.e) for x in quantizer.version(spark, root).collect()} == {i: x.tolist() for i, x in enumerate(e)}
    before = sorted(map(str, quantizer.version(spark, root).collect()))
    assert quantizer.step(v.limit(0), root, 1).first().n == 0
    assert sorted(map(str, quantizer.version(spark, root).collect())) == before


def test_a_stream_resumes_where_it_was_killed(spark, tmp_path):
    z, e = data(2)
    v, c = frames(spark, z, e)
    root, source, log = str(tmp_path / "q"), str(tmp_path / "in"), str(tmp_path / "log")
    quantizer.start(c, root)
    fails, seen = [2], []

    def run():
        def sink(m, n):
            seen.append((n, m.first().n))

        each = quantizer.micro_batches(root, 2, sink)

        def maybe(df, n):
            if n in fails:
                fails.remove(n)
                each(df, n)  # committed, but the stream doesn't know
                raise RuntimeError("killed")
            each(df, n)

        stream = spark.readStream.schema("vec_id bigint, z array<double>").option("maxFilesPerTrigger", 1).parquet(source)
        q = stream.writeStream.foreachBatch(maybe).option("checkpointLocation", log).trigger(availableNow=True).start()
        try:
            q.awaitTermination(120)
        except Exception:
            assert not fails

    for k in range(4):
        v.where(F.floor(F.col("vec_id") / 15) == k).coalesce(1).write.mode("append").parquet(source)
        run()
    run()
    assert quantizer.latest(spark, root) == 4 and sorted(seen) == [(k, 15) for k in range(4)]
    same(quantizer.version(spark, root), plain(z, e, [np.arange(k * 15, k * 15 + 15) for k in range(4)], 2)[3])
