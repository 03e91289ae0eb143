"""Keyed permutations and the plans made of them."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tesserae.functions import scalars as S
from tesserae.operators import sampler
from tesserae.operators.ordering import group_places


def images_of(spark, n, epoch=0, seed=1):
    a, b = S.rectangle(F.lit(n))
    d = spark.range(n).select(F.col("id").alias("x"), F.lit(n).cast("bigint").alias("n"), a.alias("a"), b.alias("b"), S.permutation_keys(seed, epoch).alias("k"))
    return {r.x: r.y for r in S.permute(d, "x", "n", "a", "b", "k", "y").collect()}


@pytest.mark.parametrize("n", [1, 2, 3, 5, 10, 24, 25, 26, 97, 1000, 1023, 4099])
def test_permutation_is_one(spark, n):
    assert sorted(images_of(spark, n).values()) == list(range(n))


def test_permutations_differ_and_are_even(spark):
    n, epochs = 12, 300
    a, b = S.rectangle(F.lit(n))
    d = spark.range(n).withColumnRenamed("id", "x").crossJoin(spark.range(epochs).withColumnRenamed("id", "epoch"))
    d = d.select("x", "epoch", F.lit(n).cast("bigint").alias("n"), a.alias("a"), b.alias("b"), S.permutation_keys(7, F.col("epoch")).alias("k"))
    rows = S.permute(d, "x", "n", "a", "b", "k", "y").collect()
    orders = {}
    for r in rows:
        orders.setdefault(r.epoch, {})[r.x] = r.y
    assert all(sorted(o.values()) == list(range(n)) for o in orders.values())
    assert len({tuple(o[x] for x in range(n)) for o in orders.values()}) == epochs
    # each x goes to each place about 25 times: chi-square with 121 degrees of freedom, 99.99 % below 186
    seen = Counter((r.x, r.y) for r in rows)
    assert sum((seen[x, y] - epochs / n) ** 2 / (epochs / n) for x in range(n) for y in range(n)) < 186
    # neighbours don't stay neighbours: about 2 / n of pairs do
    near = sum(abs(o[x] - o[x + 1]) == 1 for o in orders.values() for x in range(n - 1)) / (epochs * (n - 1))
    assert 0.1 < near < 0.24


def test_steps_beyond_the_last_raise(spark):
    d = spark.range(1).select(F.lit(5).cast("bigint").alias("v"), F.lit(0).cast("bigint").alias("n"), F.lit(3).cast("bigint").alias("a"), F.lit(2).cast("bigint").alias("b"), S.permutation_keys(1).alias("k"))
    with pytest.raises(Exception, match="come back"):
        d.select(S.walked(F.col("v"), F.col("n"), F.col("a"), F.col("b"), F.col("k"))).collect()


def test_places_have_no_gaps_and_dont_depend_on_cells(spark):
    d = spark.createDataFrame([(i, None if i % 5 == 4 else "ab"[i % 3 == 0]) for i in range(500)], "id bigint, g string").withColumn("g", F.coalesce("g", F.lit("none")))
    got = []
    for parts in ("1", "4", "13"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            got.append(sorted(map(tuple, group_places(d.repartition(int(parts)), ["g"], S.hash_number("x", F.col("id")), "id").select("id", "g", "n", "place").collect())))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got[0] == got[1] == got[2]
    by = {}
    for _, g, n, place in got[0]:
        by.setdefault((g, n), []).append(place)
    assert all(sorted(p) == list(range(n)) for (_, n), p in by.items()) and sum(n for _, n in by) == 500


def test_plans_of_epochs_come_from_one_index(spark, tmp_path):
    items = spark.createDataFrame([(i, i % 7 % 3) for i in range(400)], "image_id bigint, bucket_id int")
    sampler.index(items).write.parquet(str(tmp_path / "index"))
    stored = spark.read.parquet(str(tmp_path / "index"))
    for epoch in (0, 1):
        want = sorted(map(tuple, sampler.plan(items.repartition(9), 8, 5, epoch).collect()))
        d = sampler.planned(stored, 8, 5, epoch)
        assert sorted(map(tuple, d.collect())) == want
        sizes = Counter(b for b, *_ in want)
        assert set(sizes.values()) == {8} and sorted(sizes) == list(range(len(sizes)))
        plan = d._jdf.queryExecution().optimizedPlan().toString()
        assert "Sort" not in plan and "RepartitionByExpression" not in plan
    loose = sampler.planned(stored, 8, 5, drop_last=False).collect()
    assert sorted(r.image_id for r in loose) == list(range(400)) and len({r.batch_no for r in loose}) == sum(-(-n // 8) for n in Counter(i % 7 % 3 for i in range(400)).values())
    sharded = sampler.shard(sampler.plan(items, 8, 5, total=True), 3).select("rank", "local_no", "image_id").collect()
    assert sorted(map(tuple, sharded)) == sorted(map(tuple, sampler.shard(sampler.plan(items, 8, 5), 3).select("rank", "local_no", "image_id").collect()))
