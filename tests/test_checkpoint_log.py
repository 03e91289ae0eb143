"""Checkpoints with state: snapshots, sharing of tables, and removal in two phases."""

import pytest
from pyspark.sql import functions as F

from tesserae.sources import checkpoint_log as log


def table(spark, n, salt=0):
    return spark.range(n).select("id", (F.col("id") * 2 + salt).alias("v"), F.create_map(F.lit("k"), F.col("id")).alias("m"))


def steps(spark, root, at=None):
    return sorted(r.step for r in log.snapshot(spark, root, at).collect())


def rows(d):
    return sorted((r.id, r.v) for r in d.collect())


def test_sections_come_back_and_equal_ones_share_a_table(spark, tmp_path):
    root = str(tmp_path / "c")
    assert log.load(spark, root) is None and steps(spark, root) == []
    log.save(spark, root, 10, 0, 80, "{}", {"model": table(spark, 5), "optimiser": table(spark, 3, 1)})
    log.save(spark, root, 20, 0, 160, "{}", {"model": table(spark, 5).repartition(3), "optimiser": table(spark, 3, 2)})
    row, sections = log.load(spark, root)
    assert (row["step"], row["batch_offset"]) == (20, 160) and rows(sections["optimiser"]) == [(i, 2 * i + 2) for i in range(3)]
    row, sections = log.load(spark, root, 10)
    assert rows(sections["model"]) == [(i, 2 * i) for i in range(5)] and rows(sections["optimiser"]) == [(i, 2 * i + 1) for i in range(3)]
    assert len([x for x in log.names(spark, f"{root}/tables") if x != "_"]) == 3
    log.save(spark, root, 20, 1, 7, "{}", {"model": table(spark, 1)})
    assert log.load(spark, root)[0]["epoch"] == 1 and steps(spark, root) == [10, 20]


def test_contents_differ_by_rows_repeats_and_schema(spark):
    d = table(spark, 4)
    others = [table(spark, 4, 1), d.unionByName(d), d.limit(0), d.withColumnRenamed("v", "w"), d.withColumn("v", F.lit(None).cast("bigint"))]
    assert len({log.content_key(x) for x in [d, *others]}) == 6
    assert log.content_key(d.orderBy(F.desc("id"))) == log.content_key(d)


def test_retention_in_two_phases_survives_crashes(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "c")
    for s in range(1000, 9000, 1000):
        log.save(spark, root, s, 0, s, "{}", {"state": table(spark, 2, s), "shared": table(spark, 1)})
    assert log.retire(spark, root, 2, 4000) == [1000, 2000, 3000, 5000, 6000]
    assert steps(spark, root) == [4000, 7000, 8000] and steps(spark, root, 7) == list(range(1000, 9000, 1000))
    # between the phases nothing is deleted, and the marks can be set again
    assert log.retire(spark, root, 2, 4000) == []
    assert rows(spark.read.parquet(f"{root}/tables/{log.content_key(table(spark, 2, 1000))}")) == [(0, 1000), (1, 1002)]
    assert log.vacuum(spark, root) == []  # not old enough
    # a crash in the middle of the second phase
    calls = []

    def fails(s, path):
        calls.append(path)
        if len(calls) == 3:
            raise OSError("killed")
        real(s, path)

    real = log.delete
    monkeypatch.setattr(log, "delete", fails)
    with pytest.raises(OSError, match="killed"):
        log.vacuum(spark, root, 0)
    monkeypatch.setattr(log, "delete", real)
    assert len(log.vacuum(spark, root, 0)) == 3
    for s in (4000, 7000, 8000):
        row, sections = log.load(spark, root, s)
        assert rows(sections["state"]) == [(0, s), (1, s + 2)] and rows(sections["shared"]) == [(0, 0)]
    assert log.load(spark, root)[0]["step"] == 8000 and log.vacuum(spark, root, 0) == []
    assert len([x for x in log.names(spark, f"{root}/tables") if x != "_"]) == 4


def test_a_checkpoint_that_was_not_finished_is_not_seen(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "c")
    log.save(spark, root, 1, 0, 0, "{}", {"state": table(spark, 2)})

    def fails(*_):
        raise OSError("killed")

    with monkeypatch.context() as m:
        m.setattr(log, "_add", fails)
        with pytest.raises(OSError, match="killed"):
            log.save(spark, root, 2, 0, 0, "{}", {"state": table(spark, 3)})
    assert log.load(spark, root)[0]["step"] == 1
    assert log.vacuum(spark, root, 3600) == [] and len(log.vacuum(spark, root, 0)) == 1
    log.save(spark, root, 2, 0, 0, "{}", {"state": table(spark, 3)})
    assert steps(spark, root) == [1, 2] and log.load(spark, root)[1]["state"].count() == 3


def test_writers_take_different_numbers(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "c")
    log.save(spark, root, 1, 0, 0, "{}", {})
    seen, real = [], log._entries
    # the second writer reads the log before the first one's entry is there
    monkeypatch.setattr(log, "_entries", lambda s, r: seen.append(1) or ([] if len(seen) == 1 else real(s, r)))
    log._add(spark, root, [{"op": "add", "step": 2, "epoch": 0, "batch_offset": 0, "config_json": "{}", "sections": {}}])
    assert len(seen) == 2 and steps(spark, root) == [1, 2]
