"""Image files to model input: catalog source, resampling, crops, batches of one shape, token grids."""

import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.operators import buckets as B
from tesserae.operators import pixels, sampler
from tesserae.sources import catalog

NAMES = ("plain.png", "with space.png", "100%.jpg", "a#b.PNG", "what?.png", "plus+and%20.png", "é ü/ß.jpeg", "a+b/c d.bmp")


def draw(spark, path, width, height, kind, seed=0):
    """Writes an image of smooth waves by the JVM's writers and returns its pixels (h x w x 3) as drawn."""
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[:height, :width]
    p = np.stack([127 + 120 * np.sin(x / rng.uniform(5, 20) + c) * np.cos(y / rng.uniform(5, 20)) for c in range(3)], -1).astype(np.uint8)
    jvm = spark.sparkContext._jvm
    image = jvm.java.awt.image.BufferedImage(width, height, 1)
    packed = (p[..., 0].astype(int) << 16 | p[..., 1].astype(int) << 8 | p[..., 2]).ravel().tolist()
    a = spark.sparkContext._gateway.new_array(jvm.int, len(packed))
    for i, v in enumerate(packed):
        a[i] = v
    image.setRGB(0, 0, width, height, a, 0, width)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    assert jvm.javax.imageio.ImageIO.write(image, kind, jvm.java.io.File(str(path)))
    return p


def plain_resize(p, new_w, new_h):
    """Each output pixel as a sum over all input pixels, weights by the kernel's definition."""

    def kernel(x):
        x = abs(x)
        return 1.5 * x**3 - 2.5 * x**2 + 1 if x < 1 else -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2 if x < 2 else 0.0

    def along(n_in, n_out):
        scale = n_in / n_out
        wide = max(1.0, scale)
        w = np.array([[kernel((j + 0.5 - (i + 0.5) * scale) / wide) for j in range(n_in)] for i in range(n_out)])
        return w / w.sum(1, keepdims=True)

    h, w, c = p.shape
    columns, rows = along(w, new_w), along(h, new_h)
    out = np.zeros((new_h, new_w, c))
    for i in range(new_h):
        for j in range(new_w):
            out[i, j] = np.einsum("y,x,yxc->c", rows[i], columns[j], p)
    return out


@pytest.mark.parametrize("size", [(7, 5, 16, 12), (40, 31, 11, 9), (20, 20, 20, 20), (9, 50, 30, 13), (1, 1, 8, 8), (3, 200, 4, 5)])
def test_resampling_equals_double_loops(size):
    w, h, new_w, new_h = size
    p = np.random.default_rng(1).integers(0, 256, (h, w, 3)).astype(float)
    want = plain_resize(p, new_w, new_h)
    assert np.abs(pixels.resample(p, new_w, new_h, 0, 0, new_w, new_h, whole=False) - want).max() < 1e-6
    left, top = new_w // 3, new_h // 4
    crop = pixels.resample(p, new_w, new_h, left, top, new_w - left - 1, new_h - top, whole=False)
    assert np.abs(crop - want[top:, left : new_w - 1]).max() < 1e-6
    whole = pixels.resample(p, new_w, new_h, 0, 0, new_w, new_h)
    bytes_ = lambda x: np.clip(np.floor(x + 0.5), 0, 255)
    assert whole.dtype == np.uint8 and np.abs(whole - bytes_(plain_resize(bytes_(plain_resize(p, new_w, h)), new_w, new_h))).max() <= 1


def test_resampling_keeps_flat_and_equal_sizes():
    p = np.random.default_rng(2).integers(0, 256, (13, 17, 3)).astype(np.uint8)
    assert np.array_equal(pixels.resample(p, 17, 13, 0, 0, 17, 13), p)
    assert (pixels.resample(np.full((90, 70, 3), 201, np.uint8), 33, 44, 1, 2, 30, 40) == 201).all()


def test_catalog_takes_any_name(spark, tmp_path):
    sizes = {}
    for i, name in enumerate(NAMES):
        draw(spark, f"{tmp_path}/{name}", 8 + i, 6 + i, {"p": "png", "j": "jpg", "b": "bmp"}[name.lower().rsplit(".", 1)[1][0]])
        sizes[name] = (8 + i, 6 + i)
    below = len(f"file://{tmp_path}/")
    for d in (catalog.load_catalog(spark, str(tmp_path)), catalog.with_sizes(catalog.list_images(spark, str(tmp_path))), catalog.images(spark, str(tmp_path))):
        assert {r.path[below:]: (r.width, r.height) for r in d.collect()} == sizes
    binary = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path)).select("path")
    assert catalog.with_sizes(binary).count() == len(NAMES)


def test_catalog_opens_files_only_for_sizes(spark, tmp_path):
    (tmp_path / "deep/er").mkdir(parents=True)
    for name in ("x.png", "deep/y.png", "deep/er/z.PNG", "deep/er/n.txt", ".png"):
        (tmp_path / name).write_bytes(b"no image")
    for parts in (1, 2, 64):
        d = catalog.files(spark, str(tmp_path), "path", "length", parts=parts)
        assert sorted((r.path.rsplit("/", 1)[1], r.length) for r in d.collect()) == [("x.png", 8), ("y.png", 8), ("z.PNG", 8)]
    with pytest.raises(Exception, match="header"):
        catalog.files(spark, str(tmp_path), "path", "width").collect()
    with pytest.raises(Exception, match="colour"):
        spark.read.format("tesserae_images").schema("colour string").load(str(tmp_path)).collect()


def test_catalog_deals_out_folders(tmp_path):
    for i in range(20):
        (tmp_path / f"d{i}/e").mkdir(parents=True)
        (tmp_path / f"d{i}/e/x.png").write_bytes(b"")
        (tmp_path / f"d{i}/y.jpg").write_bytes(b"")
    for parts in (1, 5, 20, 30, 1000):
        r = catalog.ImageReader(["path"], str(tmp_path), parts)
        cut = r.partitions()
        got = [p for part in cut for b in r.read(part) for p in b.column(0).to_pylist()]
        assert len(got) == len(set(got)) == 40
        assert len([c for c in cut if c.folders]) <= parts


def test_locations_are_taken_literally():
    assert catalog.parts_of("s3a://bucket/a b#c?.png") == ("s3a", "bucket", "/a b#c?.png")
    assert catalog.parts_of("file:/x y") == catalog.parts_of("file:///x y") == catalog.parts_of("/x y") == ("file", "", "/x y")


TWO = (B.Bucket("1:1", 64, 64), B.Bucket("2:1", 96, 32))


def folder(spark, tmp_path):
    rng = random.Random(4)
    out = {}
    for i in range(14):
        w, h = (rng.randrange(50, 90), rng.randrange(50, 90)) if i % 2 else (rng.randrange(150, 200), rng.randrange(40, 60))
        out[f"i{i:02} x.png"] = draw(spark, f"{tmp_path}/i{i:02} x.png", w, h, "png", i)
    return out


def halving():
    """An encoder that only halves five times: means over 32 x 32, two channels. Made here so that it is sent by value."""

    def make():
        def encode(x):
            n, _, h, w = x.shape
            cells = x.reshape(n, 3, h // 32, 32, w // 32, 32).mean((3, 5))
            return np.stack([cells.sum(1), cells[:, 0]], 1)

        return encode

    return make


def test_files_to_tokens_in_plan_order(spark, tmp_path):
    drawn = folder(spark, tmp_path)
    listed = pixels.placed(catalog.load_catalog(spark, str(tmp_path)), TWO, seed=3, epoch=1)
    plan = sampler.plan(listed, 3, 3, 1)
    decoded = catalog.images(spark, str(tmp_path)).join(listed.drop("width", "height", "length"), "path")
    loaded = sampler.load(plan, pixels.fit(decoded).select("image_id", "path", "bw", "bh", "rgb"))
    book = spark.createDataFrame([(0, [0.0, 0.0]), (1, [0.5, 0.1]), (2, [-0.5, -0.2])], "code bigint, e array<double>")
    got = pixels.encode_batches(loaded, halving(), book).collect()
    assert len(got) == plan.count() == 12
    at = {r.image_id: r for r in listed.collect()}
    seen = {}
    for r in got:
        n = at[r.image_id]
        assert (len(r.codes), len(r.codes[0])) == (n.bh // 32, n.bw // 32)
        assert seen.setdefault(r.batch_no, r.bucket_id) == r.bucket_id
        p = drawn[n.path.rsplit("/", 1)[1]]
        p = np.clip(np.floor(plain_resize(p.astype(float), n.new_w, n.new_h) + 0.5), 0, 255)[n.top : n.top + n.bh, n.left : n.left + n.bw]
        x = pixels.to_floats(p[None, :, ::-1] if n.flip else p[None])
        z = halving()()(x)[0].transpose(1, 2, 0)
        d = ((z[:, :, None] - np.array([[0.0, 0.0], [0.5, 0.1], [-0.5, -0.2]])) ** 2).sum(-1)
        clear = np.partition(d, 1, -1)[..., 1] - d.min(-1) > 0.02
        assert (np.array(r.codes) == d.argmin(-1))[clear].all() and clear.any()
    assert set(seen.values()) == {0, 1}


def test_jpeg_files_and_the_centre(spark, tmp_path):
    p = draw(spark, f"{tmp_path}/a.jpg", 120, 80, "jpg")
    d = pixels.placed(catalog.images(spark, str(tmp_path)).withColumn("image_id", F.lit(1)), TWO, train=False)
    r = pixels.fit(d).first()
    assert not r.flip and (r.new_w, r.new_h, r.left, r.top) == (96, 64, 16, 0) and (r.bw, r.bh) == (64, 64)
    got = np.frombuffer(r.rgb, np.uint8).reshape(64, 64, 3).astype(float)
    assert np.abs(got - plain_resize(p.astype(float), 96, 64)[:, 16:80]).mean() < 6  # what the compression loses


def test_numbers_of_the_crop_are_in_range_and_repeat(spark):
    d = spark.createDataFrame([(i, 100 + 37 * i % 300, 80 + 53 * i % 300) for i in range(200)], "image_id long, width int, height int")
    a = pixels.placed(d, TWO, seed=1, epoch=2)
    assert a.where("`left` < 0 OR top < 0 OR `left` + bw > new_w OR top + bh > new_h").isEmpty()
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, pixels.placed(d.repartition(7), TWO, seed=1, epoch=2).collect()))
    assert 40 < a.where("flip").count() < 160 and pixels.placed(d, TWO, flip=False).where("flip").isEmpty()
    assert math.isclose(pixels.to_floats(np.array([[[[0, 255, 51]]]], np.uint8)).sum(), -0.6, abs_tol=1e-6)


def test_null_pixels_stay_null(spark):
    d = spark.createDataFrame([(1, 10, 10, None)], "image_id long, width int, height int, rgb binary")
    assert pixels.fit(pixels.placed(d, TWO)).first().rgb is None


def test_batches_of_two_shapes_are_refused(spark):
    d = spark.createDataFrame([(0, 0, 32, 32, bytearray(3072)), (0, 1, 64, 32, bytearray(6144))], "batch_no long, pos long, bw int, bh int, rgb binary").coalesce(1)
    with pytest.raises(Exception, match="shapes"):
        pixels.in_batches(d, halving(), "array<bigint>", "x").collect()
