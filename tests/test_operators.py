"""Properties and closed forms that the tables don't show."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.functions import scalars as S
from tesserae.operators import buckets as B
from tesserae.operators import infer, losses, metrics, sampler, shared, telemetry, vq
from tesserae.operators.ordering import group_row_numbers, rolling, rolling_mean, row_numbers
from tesserae.plans.oracles import ORACLES
from tesserae.plans.queries import QUERIES
from tesserae.sources import catalog, checkpoints, config


def items(spark, *counts):
    rows = [(i, b) for i, b in enumerate(b for b, n in enumerate(counts) for _ in range(n))]
    return spark.createDataFrame(rows, "image_id bigint, bucket_id int")


def batches(df):
    out = {}
    for r in df.orderBy("batch_no", "pos").collect():
        out.setdefault(r.batch_no, []).append((r.image_id, r.bucket_id))
    return out


def test_steps_formula(spark):
    n = lambda *c: B.steps(B.counts(items(spark, *c).withColumn("bucket", F.lit("x")), 4), 3).first().steps_per_epoch
    assert n(20, 17) == 3
    assert n(1, 1) == 0


def test_batches_hold_one_bucket_and_are_full(spark):
    p = batches(sampler.plan(items(spark, 20, 17), 4))
    assert len(p) == 9 and sorted(p) == list(range(9))
    assert all(len(b) == 4 and len({x[1] for x in b}) == 1 for b in p.values())
    assert len({x for b in p.values() for x in b}) == 36


def test_plan_repeats_and_epochs_differ(spark):
    i = items(spark, 20, 17)
    assert batches(sampler.plan(i, 4)) == batches(sampler.plan(i.repartition(3), 4))
    assert batches(sampler.plan(i, 4, epoch=1)) != batches(sampler.plan(i, 4))
    assert sum(map(len, batches(sampler.plan(i, 4, drop_last=False)).values())) == 37


def test_resume_skips_what_was_consumed(spark):
    s = sampler.shard(sampler.plan(items(spark, 20, 17), 4), 1)
    full, rest = batches(s), batches(sampler.resume(s, 0, 3))
    assert rest == {k: v for k, v in full.items() if k >= 3}


def test_ranks_are_equal_and_disjoint(spark):
    s = sampler.shard(sampler.plan(items(spark, 40, 34), 4), 2)
    a, b = batches(s.where("rank = 0")), batches(s.where("rank = 1"))
    assert len(a) == len(b)
    assert not {x for v in a.values() for x in v} & {x for v in b.values() for x in v}


def test_loader_keeps_batches_whole(spark):
    i = items(spark, 20, 17)
    d = sampler.load(sampler.plan(i, 4), i.withColumn("path", F.concat(F.lit("p"), "image_id")))
    parts = d.withColumn("p", F.spark_partition_id()).groupBy("batch_no").agg(F.count_distinct("p").alias("n"), F.count("path").alias("k")).collect()
    assert len(parts) == 9 and all((r.n, r.k) == (1, 4) for r in parts)


def test_empty_plan(spark):
    assert sampler.plan(items(spark), 4).count() == 0
    with pytest.raises(ValueError):
        sampler.first_per_bucket(items(spark, 3), 0, 2)


def test_row_numbers_and_rolling(spark):
    d = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k"), (F.col("id") % 3).alias("g"))
    assert [r.rn for r in row_numbers(d, "k").orderBy("k").collect()] == list(range(1, 1001))
    g = group_row_numbers(d, ["g"], "k").groupBy("g").agg(F.max("rn").alias("m"), F.count_distinct("rn").alias("n"), F.count("*").alias("c")).collect()
    assert all(r.m == r.n == r.c for r in g)
    s = spark.range(1, 301).select(F.col("id").alias("step"), F.col("id").cast("double").alias("v"))
    got = {r.step: r.m for r in rolling(s, "step", (-50, -1), block=64, m=F.avg("v")).collect()}
    assert len(got) == 300 and got[1] is None
    assert all(abs(got[k] - np.mean(range(max(1, k - 50), k))) < 1e-9 for k in range(2, 301))


def test_rolling_frames_longer_than_a_block(spark):
    s = spark.range(100).select(F.col("id").alias("step"), F.col("id").cast("double").alias("v"))
    got = {r.step: r.n for r in rolling(s, "step", (-25, -1), block=10, n=F.count("v")).collect()}
    assert got == {k: min(k, 25) for k in range(100)}


@pytest.mark.parametrize("frame", [(-50, -1), (-49, 0), (-5, -2), (-200, -1)])
def test_rolling_mean_adds_edges_and_whole_runs_in_order(spark, frame):
    x = [None if i % 7 == 3 or 100 <= i < 110 else i * 7919 % 1009 / 100 for i in range(400)]
    d = spark.createDataFrame(list(enumerate(x, 1)), "step bigint, v double").repartition(3)
    got = {r.step: r.m for r in rolling_mean(d, "step", "v", frame, "m", block=72).collect()}
    assert len(got) == 400
    for i in range(400):
        a, b, total = max(0, i + frame[0]), max(0, i + frame[1] + 1), 0.0
        j, n = a, sum(v is not None for v in x[a:b])
        while j < b:
            size = 16 if j % 16 == 0 and j + 16 <= b else 1
            part = 0.0
            for v in x[j : j + size]:
                part += v or 0.0
            total, j = total + part, j + size
        assert got[i + 1] == (total / n if n else None)


def test_spikes_right_at_the_threshold_fall_as_in_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rng = np.random.default_rng(3)
    cents = rng.integers(0, 1000, 6000).tolist()
    for i in range(57, 6000, 57):
        cents[i - 1] -= sum(cents[i - 50 : i]) % 10 - 10
        cents[i] = sum(cents[i - 50 : i]) // 10
    duck = duckdb.connect()
    duck.execute("CREATE TABLE c AS SELECT unnest(?::BIGINT[]) AS cents, generate_subscripts(?::BIGINT[], 1) AS i", [cents, cents])
    duck.sql("CREATE TABLE events AS SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_seconds(i // 60) AS ts, 'a' AS event_type, CASE WHEN i % 400 > 0 THEN cents / 100 END AS value FROM c")
    duck.sql(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    got = {(r.step, r.seconds, r.before) for r in QUERIES["step_spikes"](spark, str(tmp_path)).collect()}
    expected = set(duck.sql(ORACLES["step_spikes"]).fetchall())
    assert 0 < len(expected & {(i + 1, cents[i] / 100, round(cents[i] / 500, 6)) for i in range(57, 6000, 57)}) < len(range(57, 6000, 57))
    assert got == expected


def test_shared_folder_is_asked_for_on_a_cluster():
    class Fake:
        master = "spark://host:7077"
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: d)})
        getConf = staticmethod(lambda: Fake.conf)
        getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        shared.shared_dir(type("S", (), {"sparkContext": Fake, "conf": Fake.conf}))


def test_bucket_rules(spark):
    with pytest.raises(ValueError):
        B.Bucket("odd", 100, 64)
    two = (B.Bucket("first", 64, 64), B.Bucket("second", 32, 32))
    images = spark.createDataFrame([(0, 10, 10), (1, 0, 5), (2, None, 5)], "image_id bigint, width int, height int")
    assert [(r.image_id, r.bucket) for r in B.assign(images, two).collect()] == [(0, "first")]
    assert [(r.image_id, r.bucket) for r in B.assign_by_join(images, B.table(spark, two)).collect()] == [(0, "first")]


def test_scalars(spark):
    d = spark.createDataFrame([(0.5,), (1.5,), (2.5,)], "x double")
    assert [r[0] for r in d.select(S.half_even(F.col("x"))).collect()] == [0, 2, 2]
    t = spark.createDataFrame([(-3.0,), (59.9,), (61.0,), (3600.0,), (36061.0,)], "s double")
    assert [r[0] for r in t.select(S.format_duration(F.col("s"))).collect()] == ["00:00", "00:59", "01:01", "1:00:00", "10:01:01"]
    w = spark.range(1).select(S.warmup(F.col("id"), 0).alias("a"), S.warmup(F.col("id"), 1500).alias("b"), S.every(F.col("id"), 0).alias("c")).first()
    assert (w.a, w.b, w.c) == (1.0, 1 / 1500, False)
    p = spark.createDataFrame([([0.5, -0.25], [0.5, -0.25])], "x array<double>, y array<double>")
    assert abs(p.select(S.psnr(F.col("x"), F.col("y"))).first()[0] - 100) < 1e-9
    assert p.select(S.mean_abs_diff(F.col("x"), F.col("y"))).first()[0] == 0


def codes(spark, k=4, dim=2):
    return spark.createDataFrame([(i, [float(i)] * dim) for i in range(k)], "code bigint, e array<double>")


def test_codebook_statistics(spark):
    c = codes(spark)
    even = spark.createDataFrame([(i % 4,) for i in range(40)], "code bigint")
    one = spark.createDataFrame([(2,)] * 5, "code bigint")
    assert abs(vq.perplexity(vq.histogram(even, c)).first()[0] - 4) < 1e-9
    assert abs(vq.perplexity(vq.histogram(one, c)).first()[0] - 1) < 1e-9
    u = vq.usage(vq.histogram(one, c)).first()
    assert (u.used, u.usage, u.is_low) == (1, 0.25, True)


def test_assign_ties_go_to_the_least_code(spark):
    v = spark.createDataFrame([(0, [0.5, 0.5])], "vec_id bigint, z array<double>")
    assert vq.assign(v, codes(spark)).first().code == 0


def test_assign_of_null_vectors_and_empty_codebooks(spark):
    v = spark.createDataFrame([(0, [0.9, 0.9]), (1, None), (2, [2.2, 2.0])], "vec_id bigint, z array<double>")
    a = vq.assign(v, codes(spark))
    assert {r.vec_id: r.code for r in a.collect()} == {0: 1, 1: None, 2: 2}
    assert {r.code: (r.n, list(r.s)) for r in vq.sums(a).collect()} == {1: (1, [0.9, 0.9]), 2: (1, [2.2, 2.0])}
    assert vq.assign(v.where("vec_id = 1"), codes(spark)).first().code is None
    with pytest.raises(ValueError, match="empty"):
        vq.assign(v, codes(spark).limit(0))


def test_kmeans_start(spark):
    v = spark.createDataFrame([(i, [float(i % 5), 1.0]) for i in range(40)], "vec_id bigint, z array<double>")
    few = vq.kmeans_init(v.limit(3), codes(spark)).collect()
    assert {r.code: list(r.e) for r in few} == {i: [float(i)] * 2 for i in range(4)} and not any(r.started for r in few)
    zero = {tuple(r.e) for r in vq.kmeans_init(v, codes(spark), 0).collect()}
    many = vq.kmeans_init(v, codes(spark), 3).collect()
    assert zero <= {(float(i), 1.0) for i in range(5)} and len(many) == 4
    assert all(r.started and r.ema_n == 1 and r.ema_sum == r.e for r in many)


def test_revived_codes_start_anew(spark):
    book = codes(spark).withColumns({"ema_n": F.lit(9.0), "ema_sum": F.col("e"), "usage": F.lit(3).cast("bigint")})
    v = spark.createDataFrame([(7, [0.5, 0.25])], "vec_id bigint, z array<double>")
    got = {r.code: (list(r.e), r.ema_n, list(r.ema_sum), r.usage) for r in vq.revived(book, spark.createDataFrame([(2, 7)], "code bigint, vec_id bigint"), v).collect()}
    assert got[2] == ([0.5, 0.25], 1.0, [0.5, 0.25], 0) and got[1] == ([1.0, 1.0], 9.0, [1.0, 1.0], 0)


def test_images_to_tokens_and_back(spark):
    """An encoder that takes the mean of 2 x 2 patches, and a decoder that repeats it."""

    def encoder():
        return lambda x: np.stack([x.reshape(-1, 2, 2, 3, 2).mean((2, 4))] * 2, 1)

    def decoder():
        return lambda z: z[:, 0].repeat(2, 1).repeat(2, 2)

    image = np.kron([[0, 1, 2], [3, 2, 0]], np.ones((2, 2)))
    d = spark.createDataFrame([(0, image.ravel().tolist())], "image_id bigint, pixels array<double>")
    t = infer.encode(d, "pixels", encoder, [4, 6], codes(spark), 2, 3)
    assert t.first().codes == [[0, 1, 2], [3, 2, 0]]
    back = infer.decode(t, "codes", decoder, [2, 2, 3], codes(spark)).first().image
    assert np.array_equal(np.reshape(back, (4, 6)), image)


def test_ema_of_unvisited_codes(spark):
    c, v = codes(spark), spark.createDataFrame([(0, [1.0, 1.0])], "vec_id bigint, z array<double>")
    a = vq.assign(v, c)
    grown = vq.ema(c, a, start_size=0.0).where("code = 3").agg(F.max(F.array_max(F.transform("weight", F.abs)))).first()[0]
    calm = vq.ema(c, a, start_size=1.0).where("code = 3").agg(F.max(F.array_max(F.transform("weight", F.abs)))).first()[0]
    assert grown > 1000 and calm < 4


def test_kmeans_keeps_empty_clusters(spark):
    v = spark.createDataFrame([(0, [0.0, 0.2]), (1, [0.2, 0.0])], "vec_id bigint, z array<double>")
    got = {r.code: list(r.e) for r in vq.kmeans(v, codes(spark), 2).collect()}
    assert got[0] == [0.1, 0.1] and got[3] == [3.0, 3.0]


def test_revival_repeats_vectors_only_when_short(spark):
    v = spark.createDataFrame([(i, [0.0]) for i in range(3)], "vec_id bigint, z array<double>")
    few = vq.revive(codes(spark, 2), v).collect()
    many = vq.revive(codes(spark, 7), v).collect()
    assert len({r.vec_id for r in few}) == 2
    assert len(many) == 7 and {r.vec_id for r in many} == {0, 1, 2}


def test_revival_by_window(spark):
    book = spark.createDataFrame([(c,) for c in range(4)], "code long")
    t = spark.createDataFrame([(0, 0), (1, 0), (2, 3), (10, 1)], "vec_id long, code long")
    w = F.floor(F.col("vec_id") / 10)
    gone = vq.dead_by_window(book, t, w)
    assert {tuple(r) for r in gone.collect()} == {(0, 1), (0, 2), (1, 0), (1, 2), (1, 3)}
    got = {(r.window_no, r.code): r.vec_id for r in vq.revive_by_window(gone, t, w).collect()}
    assert set(got) == {(0, 1), (0, 2), (1, 0), (1, 2), (1, 3)}
    assert got[0, 1] != got[0, 2] and {got[0, 1], got[0, 2]} <= {0, 1, 2} and {got[1, c] for c in (0, 2, 3)} == {10}


def plain_frechet(x, y):
    """By the eigenvalues of the product of the covariances."""
    a, b = np.cov(x, rowvar=False), np.cov(y, rowvar=False)
    root = np.sqrt(np.maximum(np.linalg.eigvals(a @ b).real, 0)).sum()
    return ((x.mean(0) - y.mean(0)) ** 2).sum() + np.trace(a) + np.trace(b) - 2 * root


def test_evaluation_against_plain_numbers(spark):
    rng = np.random.default_rng(3)
    label = np.repeat([0, 1, 2], [40, 25, 19])
    x = rng.uniform(-1, 1, (84, 6))
    y = np.clip(x + rng.normal(0, 0.1, x.shape), -1, 1)
    p = spark.createDataFrame([(int(g), a.tolist(), b.tolist()) for g, a, b in zip(label, x, y, strict=True)], "label long, x array<double>, y array<double>").repartition(5)
    m = p.select("label", S.mean_abs_diff(F.col("x"), F.col("y")).alias("l1"), S.psnr(F.col("x"), F.col("y")).alias("psnr"), F.lit(0.5).alias("perceptual"))
    hist = spark.createDataFrame([(0, 5), (1, 0), (2, 0)], "code long, n long")
    got = {r.bucket: r for r in metrics.evaluate(m, p, hist).collect()}
    for g in (0, 1, 2, None):
        k = label >= 0 if g is None else label == g
        r = got[None if g is None else str(g)]
        mse = ((x[k] - y[k]) ** 2).mean(1) / 4
        assert r.num_images == k.sum() and abs(r.l1 - np.abs(x[k] - y[k]).mean()) < 1e-9 and abs(r.psnr - (10 * np.log10(1 / mse)).mean()) < 1e-9 and r.perceptual == 0.5
        assert r.rfid is None if g == 2 else abs(r.rfid - plain_frechet(x[k], y[k])) < 1e-8
        assert (r.usage, r.is_low) == ((1 / 3, True) if g is None else (None, None))
    lines = [tuple(r) for r in metrics.report(metrics.evaluate(m, p, hist)).collect()]
    assert [x[0] for x in lines] == ["0", "1", "2", "overall"] and lines[2][2] == "n/a (few)" and lines[3][5] == "0.3333 (low)" and lines[0][5] == ""
    with pytest.raises(ValueError, match="no images"):
        metrics.evaluate(m.limit(0), p.limit(0), hist)


def test_report_query_shows_the_real_distance(spark):
    from conftest import SF

    from tesserae.plans.queries import QUERIES

    rfid = {r.bucket or "overall": r.rfid for r in QUERIES["frechet"](spark, SF).collect()}
    rows = QUERIES["eval_report"](spark, SF).collect()
    assert len(rows) == len(rfid) and all(r.rfid == ("n/a (few)" if rfid[r.bucket] is None else f"{rfid[r.bucket]:.4f}") for r in rows)
    assert any(v for v in rfid.values()) and rows[-1].codebook == "1.0000"


def test_moments_of_wide_features_come_in_tiles(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 300))
    d = spark.createDataFrame([("ab"[i % 2], r.tolist()) for i, r in enumerate(x)] + [("a", None)], "g string, z array<double>").repartition(6)
    tiles = metrics.moment_tiles(d, ["z"], "g").collect()
    assert sorted((r.whole, r.g or "", r.i, r["j"], r.n) for r in tiles) == sorted((w, g, i, k, n) for w, g, n in ((False, "a", 30), (False, "b", 30), (True, "", 60)) for i, k in ((0, 0), (0, 1), (1, 1)))
    assert {(len(r.si), len(r.sj), len(r.m)) for r in tiles} == {(256, 256, 65536), (256, 44, 256 * 44), (44, 44, 44 * 44)}
    got = {(r.i, r["j"]): r["cov"] for r in metrics.covariance(d).collect()}
    want = np.cov(x, rowvar=False)
    assert len(got) == 90_000 and all(abs(got[i, k] - want[i, k]) < 1e-9 for i in range(300) for k in range(300))


def test_frechet_closed_forms():
    rng = np.random.default_rng(0)
    a, b = np.diag([1.0, 4.0, 9.0]), np.diag([4.0, 1.0, 1.0])
    m = rng.normal(size=(3, 3))
    s = m @ m.T
    zero = np.zeros(3)
    assert abs(metrics.frechet_distance(zero, s, zero, s)) < 1e-6
    assert abs(metrics.frechet_distance(zero, a, np.array([1.0, 2, 0]), b) - (5 + 1 + 1 + 4)) < 1e-9


def test_frechet_needs_enough_images(spark):
    rows = [(g, [float(i), float(i * i % 7)], [float(i), 1.0 + i % 3]) for g, n in (("a", 19), ("b", 20)) for i in range(n)]
    got = {r.bucket: r for r in metrics.frechet(spark.createDataFrame(rows, "label string, x array<double>, y array<double>")).collect()}
    assert got["a"].rfid is None and got["b"].rfid > 0 and got[None].num_images == 39


def test_losses_reject_unknown_kinds():
    for f in (lambda: losses.generator_term(F.lit(1.0), "other"), lambda: losses.discriminator_term(F.lit(1.0), F.lit(1.0), "other")):
        with pytest.raises(ValueError):
            f()


def test_clip_factor(spark):
    g = spark.createDataFrame([([3.0, 4.0],), ([0.3, 0.4],)], "g array<double>")
    assert [round(r[0], 4) for r in g.select(losses.clip_factor(F.col("g"))).collect()] == [0.2, 1.0]


def test_retention(spark):
    c = spark.createDataFrame([(s,) for s in range(1000, 13000, 1000)], "step bigint")
    steps = lambda *a: sorted(r.step for r in telemetry.retained(c, *a).collect())
    assert steps(2, 10000) == [10000, 11000, 12000]
    assert steps(0, 5000) == [5000, 10000]
    assert steps(3, 0) == [10000, 11000, 12000]
    assert steps(0, 0) == []


def png(w, h):
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0" * (w + 1) * h)) + chunk(b"IEND", b"")


def bmp(w, h):
    return b"BM" + struct.pack("<IHHI", 54, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, -h, 1, 24, 0, 0, 0, 0, 0, 0)


def jpeg(w, h):
    return b"\xff\xd8\xff\xe0" + struct.pack(">H", 16) + b"JFIF\0" + b"\0" * 9 + b"\xff\xc0" + struct.pack(">HBHHB", 11, 8, h, w, 1) + b"\1\x11\0"


def test_image_headers():
    assert catalog.image_size(png(7, 5)) == (7, 5)
    assert catalog.image_size(bmp(9, 4)) == (9, 4)
    assert catalog.image_size(jpeg(640, 480)) == (640, 480)
    vp8x = b"RIFF\0\0\0\0WEBPVP8X" + b"\0" * 8 + (99).to_bytes(3, "little") + (49).to_bytes(3, "little")
    assert catalog.image_size(vp8x) == (100, 50)
    vp8l = b"RIFF\0\0\0\0WEBPVP8L\0\0\0\0\x2f" + (31 | 15 << 14).to_bytes(4, "little")
    assert catalog.image_size(vp8l) == (32, 16)
    with pytest.raises(ValueError):
        catalog.image_size(b"none")


def test_headers_behind_long_segments(spark, tmp_path):
    long = b"\xff\xe2" + struct.pack(">H", 65535) + b"\0" * 65533
    whole = jpeg(640, 480)
    (tmp_path / "x.jpg").write_bytes(whole[:20] + long * 17 + whole[20:] + b"\xff\xd9")
    (tmp_path / "y.png").write_bytes(png(3, 4))
    got = {r.path[-5:]: (r.width, r.height) for r in catalog.load_catalog(spark, str(tmp_path)).collect()}
    assert got == {"x.jpg": (640, 480), "y.png": (3, 4)}
    with pytest.raises((ValueError, struct.error)):
        parts = [b"", b"\xff\xd8\xff"]
        catalog.read_size(lambda n: parts.pop())


def test_decoded_images_are_rgb(spark, tmp_path):
    head = b"BM" + struct.pack("<IHHI", 54 + 8, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 2, 1, 1, 24, 0, 8, 0, 0, 0, 0)
    (tmp_path / "x.bmp").write_bytes(head + bytes([0, 0, 255, 255, 0, 0, 0, 0]))  # red, blue as BGR
    r = catalog.images(spark, str(tmp_path)).first()
    assert (r.width, r.height, bytes(r.rgb)) == (2, 1, bytes([255, 0, 0, 0, 0, 255]))


def test_catalog_of_a_folder(spark, tmp_path):
    for name, data in {"a-b/x.PNG": png(64, 32), "a/x.bmp": bmp(30, 30), "a/n.txt": b"", "a/.hid.png": png(1, 1), "a/_u.png": png(1, 1)}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    rows = catalog.load_catalog(spark, str(tmp_path)).orderBy("image_id").collect()
    assert [(r.image_id, r.path.split("/")[-2:], r.width, r.height) for r in rows] == [(0, ["a", ".hid.png"], 1, 1), (1, ["a", "_u.png"], 1, 1), (2, ["a", "x.bmp"], 30, 30), (3, ["a-b", "x.PNG"], 64, 32)]
    (tmp_path / "empty").mkdir()
    with pytest.raises(FileNotFoundError):
        catalog.list_images(spark, str(tmp_path / "empty"))


def test_config_files(tmp_path):
    path = str(tmp_path / "c" / "config.json")
    c = config.cli_override(config.Config(), {"train.batch_size": 4, "train.seed": None, "train.resume_from": "x"})
    assert config.sync(c, path) and not config.sync(c, path)
    back = config.load(path)
    assert (back.train.batch_size, back.train.seed, back.train.resume_from, back.model.channel_mults) == (4, 42, "", (1, 1, 2, 2, 4))
    assert config.load(None, str(tmp_path / "none")) == config.Config()
    with pytest.raises(TypeError):
        config.Config.parse({"model": {"unknown": 1}})
    config.check_resume(json.loads(json.dumps(back.tree())), back)
    with pytest.raises(RuntimeError, match="codebook_size"):
        config.check_resume(back.tree(), config.cli_override(back, {"model.codebook_size": 8}))
    assert config.ranks({"RANK": "3", "WORLD_SIZE": "4"}) == (0, 3, 4)


def test_checkpoint_manifest(spark, tmp_path):
    m = str(tmp_path / "manifest")
    for s in (10, 30, 20):
        checkpoints.append(spark, m, s, 0, s * 8, f"step_{s}", config.Config())
    assert checkpoints.find_resume(spark, m).step == 30
    assert checkpoints.find_resume(spark, m, step=20).batch_offset == 160
    assert checkpoints.find_resume(spark, m, fresh=True) is None


def test_manifest_rows_appear_whole_and_carry_configurations(spark, tmp_path):
    m = tmp_path / "manifest"
    c = config.cli_override(config.Config(), {"model.codebook_size": 64, "train.seed": 7})
    checkpoints.append(spark, str(m), 10, 0, 80, "step_10", c)
    assert [p.name.split("-")[:2] for p in m.iterdir() if not p.name.startswith(".")] == [["checkpoint", "10"]]
    row = checkpoints.with_config(checkpoints.read(spark, str(m))).first().config.asDict(True)
    assert row == {**c.tree(), "model": {**c.tree()["model"], "channel_mults": list(c.model.channel_mults)}}


def test_configuration_types(tmp_path):
    assert config.Config.parse({"loss": {"lambda_adv": 1}}).loss.lambda_adv == 1
    for section, key, value in (("model", "codebook_size", "64"), ("model", "use_ema", 1), ("train", "seed", True), ("train", "seed", 1.5), ("data", "train_dir", None), ("model", "no_such", 1)):
        with pytest.raises(TypeError):
            config.Config.parse({section: {key: value}})
    path = tmp_path / "a" / "config.json"
    for c in (config.Config(), config.cli_override(config.Config(), {"train.seed": 7})):
        config.save(c, str(path))
        assert config.load(str(path)) == c
    assert [p.name for p in path.parent.iterdir()] == ["config.json"]


def test_command_line(tmp_path):
    path = str(tmp_path / "c.json")
    config.save(config.cli_override(config.Config(), {"model.use_ema": True, "train.seed": 7}), path)
    c, fresh, at = config.command_line(["--config", path, "--num-workers", "3", "--lambda-adv", "0.5", "--no-mixed-precision", "--dead-code-revival", "--codebook-init", "kmeans"])
    assert (fresh, at) == (False, path)
    assert (c.data.num_workers, c.train.num_workers, c.loss.lambda_adv, c.train.seed) == (3, 3, 0.5, 7)
    assert (c.model.use_ema, c.model.dead_code_revival, c.train.mixed_precision, c.train.grad_checkpointing) == (True, True, False, True)
    assert c.model.codebook_init == "kmeans"
    assert config.command_line(["--fresh"], path)[0].train.seed == 7
    assert config.command_line(["--fresh"]) == (config.Config(), True, None)
    for bad in (["--codebook-init", "zeros"], ["--mixed-precision"], ["--seed", "x"]):
        with pytest.raises(SystemExit):
            config.command_line(bad)


def test_images_side_by_side(spark):
    d = spark.createDataFrame([(2, [1.0] * 4, [-1.0] * 4), (1, [-1.0, 1.0, 0.0, 3.0], [1.0, -1.0, -3.0, 0.0]), (3, [], [])], "id bigint, x array<double>, y array<double>")
    got = {r.id: (r.width, r.pixels) for r in telemetry.image_grids(d, "id", 2).collect()}
    assert got == {1: (4, [0.0, 1.0, 1.0, 0.0, 0.5, 1.0, 0.0, 0.5]), 2: (4, [1.0, 1.0, 0.0, 0.0] * 2), 3: (4, [])}
    assert [r.id for r in telemetry.image_grids(d, "id", 2, most=2).collect()] == [1, 2]


def test_scalar_families(spark):
    t = spark.createDataFrame([(49, "a", 1.0, 2.0, None, 5.0), (50, "b", 3.0, 4.0, 0.5, 6.0)], "step bigint, bucket string, perplexity double, recon_loss double, vram double, lr double")
    got = {(r.tag, r.step, r.value) for r in telemetry.scalars(t, 50, ("perplexity",), ("lr",), ("recon_loss",), ("vram",)).collect()}
    assert got == {("train/perplexity", 49, 1.0), ("train/perplexity", 50, 3.0), ("system/vram", 50, 0.5), ("train/lr", 50, 6.0), ("train_bucket_b/recon_loss", 50, 4.0)}
    v = spark.createDataFrame([("a", 1, 0.5), (None, 1, 0.25)], "bucket string, n_batches bigint, recon_l1 double")
    assert {tuple(r) for r in telemetry.validation_scalars(v, 9).collect()} == {("val_bucket_a/recon_l1", 9, 0.5), ("val/recon_l1", 9, 0.25)}


def test_scalar_sink_replaces_steps(spark, tmp_path):
    path = str(tmp_path / "s")
    schema = "tag string, step bigint, value double"
    first = [(t, s, float(s)) for t in ("train/a", "val/b") for s in range(0, 40, 2)]
    telemetry.write_scalars(spark.createDataFrame(first, schema), path, span=10)
    untouched = sorted(p.name for p in (tmp_path / "s/tag=val%2Fb").rglob("*.parquet"))
    again = [("train/a", s, -1.0) for s in range(6, 13)] + [("train/a", 7, -3.0), ("train/c", 1, 5.0)]
    for _ in range(2):
        telemetry.write_scalars(spark.createDataFrame(again, schema), path, span=10)
        want = {(t, s): v for t, s, v in first} | {("train/a", s): -1.0 for s in range(6, 13)} | {("train/c", 1): 5.0}
        rows = spark.read.parquet(path).select("tag", "step", "value").collect()
        assert len(rows) == len(want) and {(r.tag, r.step): r.value for r in rows} == want
    assert untouched == sorted(p.name for p in (tmp_path / "s/tag=val%2Fb").rglob("*.parquet"))


def test_inference_boundary(spark):
    def make():
        return lambda x: x.reshape(len(x), -1) * 2

    d = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0],)], "z array<double>")
    assert list(infer.predict(d, "z", "out", make, [2, 2]).first().out) == [2.0, 4.0, 6.0, 8.0]
