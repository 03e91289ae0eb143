"""A vector quantiser in training: its codebook, moving averages and counters as a versioned table.

A version is a folder ``v<n>`` of (code, e, ema_n, ema_sum, usage) below a root; it is written aside and renamed, so a reader sees all of
it or nothing. A step reads version n, takes a batch and commits version n + 1: lookup in the codebook as it was, then the moving
averages, then revival. Batch n always starts from version n, so a batch that is run again after a failure gives
the same version, and one that is there already is left alone. No vector leaves its task but those that revive codes.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import vq
from ..operators.codebook import store
from ..operators.shared import checkpoint, delete, move, names

STATE = "code bigint, e array<double>, ema_n double, ema_sum array<double>, usage bigint"
METRICS = "batch bigint, n bigint, commitment_loss double, codebook_loss double, loss double, perplexity double, codebook_usage double, num_revived bigint"


def latest(spark: SparkSession, root: str) -> int:
    """The last version, -1 if there is none."""
    return max((int(m[1]) for x in names(spark, root) if (m := re.fullmatch(r"v(\d+)", x))), default=-1)


def version(spark: SparkSession, root: str, n: int | None = None) -> DataFrame:
    """The state of version n, else of the last."""
    n = latest(spark, root) if n is None else n
    return spark.read.schema(STATE).parquet(f"{root}/v{n}")


def _commit(state: DataFrame, root: str, n: int) -> None:
    spark = state.sparkSession
    made = f"{root}/_making-{uuid.uuid4().hex}"
    state.selectExpr(*(f"cast({c} as {k}) as {c}" for c, k in (x.split(" ") for x in STATE.split(", ")))).write.parquet(made)
    if not move(spark, made, f"{root}/v{n}"):
        delete(spark, made)


def start(codebook: DataFrame, root: str, size: float = 1.0) -> None:
    """Version 0 of a codebook (code, e), if there is none: each code's average is its vector, with ``size`` members."""
    if latest(codebook.sparkSession, root) < 0:
        _commit(codebook.select("code", "e", F.lit(float(size)).alias("ema_n"), F.col("e").alias("ema_sum"), F.lit(0).alias("usage")), root, 0)


def step(vectors: DataFrame, root: str, batch: int, revive: bool = False, decay: float = 0.99, epsilon: float = 1e-5, beta: float = 0.25, use_ema: bool = True, seed: int = 42, key: str = "vec_id") -> DataFrame | None:
    """Trains version ``batch`` on a batch (key, z) and commits the next; METRICS in one row, or None where the next version is there.

    revive: after the averages, codes without a use since the last such step take vectors of the batch, and all counters start anew. Without
    ``use_ema`` the codebook moves by revival only (its gradient is outside the engine) and the codebook's loss counts. Null vectors
    are left out; a batch without vectors commits the state as it is.
    """
    spark = vectors.sparkSession
    if latest(spark, root) > batch:
        return None
    state = version(spark, root, batch)
    v = vectors.where("z IS NOT NULL").select(key, F.col("z").cast("array<double>").alias("z"))
    book = store(state.select("code", "e"))
    tokens = checkpoint(vq.assign(v, book).select(key, "code", "d", F.size("z").alias("dim")))
    new = state
    if use_ema and not tokens.isEmpty():
        new = vq.smoothed(checkpoint(vq.moved(state, vq.nearest_sums(v, book), decay)), epsilon).withColumn("e", F.col("weight")).drop("weight")
    used = tokens.groupBy("code").agg(F.count("*").alias("__uses"))
    new = checkpoint(new.join(used, "code", "left").withColumn("usage", F.col("usage") + F.coalesce("__uses", F.lit(0))).drop("__uses"))
    revived = 0
    if revive:
        gone = new.where("usage = 0").select("code")
        plan = checkpoint(vq.revive(gone, v, seed=seed + batch, key=key))
        revived = plan.count()
        new = vq.revived(new, plan, v, key)
    _commit(new, root, batch + 1)
    book.delete(spark)
    hist = vq.histogram(tokens.select("code"), state.select("code"))
    mean = tokens.agg(F.count("*").alias("n"), (F.sum("d") / F.sum("dim")).alias("mse"))
    d = mean.crossJoin(vq.perplexity(hist)).crossJoin(vq.usage(hist).select("usage"))
    codebook_loss = F.lit(0.0) if use_ema else F.col("mse")
    return d.select(
        F.lit(batch).cast("bigint").alias("batch"), "n", F.col("mse").alias("commitment_loss"), codebook_loss.alias("codebook_loss"), (codebook_loss + beta * F.col("mse")).alias("loss"),
        "perplexity", F.col("usage").alias("codebook_usage"), F.lit(revived).cast("bigint").alias("num_revived"),
    )


def micro_batches(root: str, revive_every: int = 0, sink: Callable[[DataFrame, int], None] | None = None, **parameters) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: micro-batch n trains version n; ``sink`` gets the metrics of steps that weren't committed before."""

    def each(df: DataFrame, n: int) -> None:
        m = step(df, root, n, bool(revive_every) and (n + 1) % revive_every == 0, **parameters)
        if m is not None and sink:
            sink(m, n)

    return each
