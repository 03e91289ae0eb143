"""Checkpoints with their state, and retention that deletes: an append-only log over tables that are known by their content.

``save`` writes each section of a checkpoint (a table, such as a quantiser's state) to ``tables/<content hash>``, unless it is there, and
then adds an entry to the log; readers go by the log, so a checkpoint is there as a whole or not at all. Removal has two
phases: ``retire`` adds an entry that marks checkpoints as removed, ``vacuum`` later deletes tables that no live checkpoint
names. A crash before, between or within the phases loses no live checkpoint, and either phase can be repeated.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shared import age, create, delete, move, names
from ..operators.telemetry import resume_point, retained

ENTRY = "seq bigint, op string, step bigint, epoch bigint, batch_offset bigint, config_json string, sections map<string, string>"


def content_key(table: DataFrame) -> str:
    """A hash of a table's schema and rows, in any order and with repeats."""
    row = F.sha2(F.to_json(F.struct(*(F.col(f"`{c}`") for c in table.columns))).cast("binary"), 256)
    part = lambda i: F.sum(F.conv(F.substring("h", i, 15), 16, 10).cast("decimal(38,0)"))
    r = table.select(row.alias("h")).agg(F.count("*").alias("n"), part(1).alias("a"), part(16).alias("b"), part(31).alias("c"))
    return r.select(F.sha2(F.concat_ws(":", F.lit(table.schema.json()), "n", "a", "b", "c"), 256)).first()[0]


def _entries(spark: SparkSession, root: str) -> list[str]:
    return [x for x in names(spark, f"{root}/log") if x.endswith(".json") and not x.startswith(("_", "."))]


def _add(spark: SparkSession, root: str, rows: list[dict]) -> None:
    """One entry of the log, with the next number that nobody has; its rows are seen together."""
    made = f"{root}/log/_{uuid.uuid4().hex}"
    while True:
        seq = max((int(x.split(".")[0]) for x in _entries(spark, root)), default=-1) + 1
        create(spark, made, "".join(json.dumps({"seq": seq} | r) + "\n" for r in rows).encode())
        if move(spark, made, f"{root}/log/{seq:020}.json"):
            return
        delete(spark, made)


def save(spark: SparkSession, root: str, step: int, epoch: int, batch_offset: int, config_json: str, sections: dict[str, DataFrame]) -> None:
    """Adds a checkpoint; one of the same step is replaced. Sections that didn't change since another checkpoint take no room."""
    keys = {}
    for name, table in sections.items():
        key = keys[name] = content_key(table)
        if key not in names(spark, f"{root}/tables"):
            made = f"{root}/_making-{uuid.uuid4().hex}"
            table.write.parquet(made)
            create(spark, f"{root}/tables/_", b"")  # so that the folder is there
            if not move(spark, made, f"{root}/tables/{key}"):
                delete(spark, made)
    _add(spark, root, [{"op": "add", "step": step, "epoch": epoch, "batch_offset": batch_offset, "config_json": config_json, "sections": keys}])


def snapshot(spark: SparkSession, root: str, at: int | None = None) -> DataFrame:
    """Live checkpoints (step, epoch, batch_offset, config_json, sections: name to content), as of entry ``at`` of the log, else of the last."""
    if not _entries(spark, root):
        return spark.createDataFrame([], ENTRY).drop("seq", "op")
    d = spark.read.schema(ENTRY).json(f"{root}/log")
    d = d if at is None else d.where(F.col("seq") <= at)
    last = d.groupBy("step").agg(F.max_by(F.struct("op", "epoch", "batch_offset", "config_json", "sections"), "seq").alias("e"))
    return last.where("e.op = 'add'").select("step", "e.epoch", "e.batch_offset", "e.config_json", "e.sections")


def load(spark: SparkSession, root: str, step: int | None = None) -> tuple[dict, dict[str, DataFrame]] | None:
    """The row and the sections of a checkpoint (of the last one, if no step is given), or None."""
    r = resume_point(snapshot(spark, root), step).first()
    return None if r is None else (r.asDict(), {n: spark.read.parquet(f"{root}/tables/{k}") for n, k in r.sections.items()})


def retire(spark: SparkSession, root: str, keep_last: int = 5, milestone_every: int = 10_000) -> list[int]:
    """Marks all but the last checkpoints and the milestones as removed, in one entry, and tells which."""
    live = snapshot(spark, root)
    kept = retained(live.select("step"), keep_last, milestone_every).select("step")
    gone = sorted(r.step for r in live.select("step").join(kept, "step", "left_anti").collect())
    if gone:
        _add(spark, root, [{"op": "remove", "step": s} for s in gone])
    return gone


def vacuum(spark: SparkSession, root: str, older_than: float = 24 * 3600) -> list[str]:
    """Deletes what no live checkpoint names and is older than so many seconds (a checkpoint in the making isn't in the log yet), and tells what."""
    tables = [x for x in names(spark, f"{root}/tables") if not x.startswith(("_", "."))]
    named = {r.k for r in snapshot(spark, root).select(F.explode(F.map_values("sections")).alias("k")).distinct().collect()}
    now = time.time()
    paths = [f"tables/{x}" for x in tables if x not in named] + [x for x in names(spark, root) if x.startswith("_making-")]
    gone = [p for p in paths if now - age(spark, f"{root}/{p}") >= older_than]
    for p in gone:
        delete(spark, f"{root}/{p}")
    return gone
