"""Row numbers and rolling frames over a whole table without a single-partition window."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import checkpoint

#: Rows of a side that is broadcast.
FEW = 100_000
#: Rows of a run, whose sum enters rolling means as one.
RUN = 16


def row_numbers(df: DataFrame, *order: str, out: str = "rn", start: int = 1) -> DataFrame:
    """Adds a gapless number in the given order (columns whose values together differ).

    Rows are range-sorted; a row's number is its place in its range plus the rows of the
    ranges before, of which there is one count each.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    d = checkpoint(d.withColumns({"__rows_p": F.spark_partition_id(), "__rows_i": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    counts = d.groupBy("__rows_p").agg(F.count("*").alias("__rows_n"))
    before = counts.withColumn("__rows_b", F.sum("__rows_n").over(Window.orderBy("__rows_p")) - F.col("__rows_n")).select("__rows_p", "__rows_b")
    return d.join(F.broadcast(before), "__rows_p").withColumn(out, F.col("__rows_b") + F.col("__rows_i") + F.lit(start)).drop("__rows_p", "__rows_i", "__rows_b")


def group_row_numbers(df: DataFrame, groups: list[str], *order: str, out: str = "rn") -> DataFrame:
    """Adds a gapless number from 1 in each group: numbers of the whole table less the least of the group.

    A group with most of the rows is spread over many ranges. Each group gives one row to the
    join; up to ``FEW`` of them are broadcast, more are joined by a shuffle.
    """
    d = row_numbers(df, *groups, *order, out="__rows_rn")
    first = d.groupBy(*groups).agg(F.min("__rows_rn").alias("__rows_first"))
    if first.limit(FEW + 1).count() <= FEW:
        first = F.broadcast(first)
    return d.join(first, groups).withColumn(out, F.col("__rows_rn") - F.col("__rows_first") + 1).drop("__rows_rn", "__rows_first")


def group_places(df: DataFrame, groups: list[str], hashed: Column, key: str, out: str = "place", size: str = "n") -> DataFrame:
    """Adds a gapless number from 0 in each group, by (``hashed``, key), and the group's size.

    ``hashed`` is in [0, 2 ** 32) and evenly spread, so cells of equal width hold about as many rows of a group each, whatever the group's share: a
    number is the place in its cell plus the rows of the cells before. Nothing is sampled or sorted by range, and
    the number of cells changes no result. Rows of a null group are left out.
    """
    cells = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = df.withColumn("__h", hashed).withColumn("__cell", F.floor(F.col("__h") * cells / F.lit(float(1 << 32))))
    counts = d.groupBy(*groups, "__cell").agg(F.count("*").alias("__many"))
    before = Window.partitionBy(*groups).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*groups, "__cell", F.coalesce(F.sum("__many").over(before), F.lit(0)).alias("__before"), F.sum("__many").over(Window.partitionBy(*groups)).alias(size))
    d = d.withColumn("__in", F.row_number().over(Window.partitionBy(*groups, "__cell").orderBy("__h", key)) - 1)
    return d.join(counts, [*groups, "__cell"]).withColumn(out, F.col("__before") + F.col("__in")).drop("__h", "__cell", "__in", "__before")


def _blocks(df: DataFrame, step: str, frame: tuple[int, int], block: int) -> tuple[Column, DataFrame]:
    """A row's own block, and the rows with __block: their own one and those whose frames reach back to them."""
    halo = max(0, -frame[0])
    block = max(block, halo, 1)
    mine = F.floor(F.col(step) / block)
    return mine, df.withColumn("__block", F.explode(F.sequence(mine, F.floor((F.col(step) + halo) / block))))


def rolling(df: DataFrame, step: str, frame: tuple[int, int], block: int = 65_536, **aggregates: Column) -> DataFrame:
    """Aggregates over rows from frame[0] to frame[1] (both <= 0) around each row, by a gapless step.

    Steps are cut into blocks; each row also goes to the later blocks whose frames reach back to
    it (several, if the frame is longer than a block), so no window holds more than block rows and
    the halo.
    """
    mine, both = _blocks(df, step, frame, block)
    w = Window.partitionBy("__block").orderBy(step).rowsBetween(*frame)
    return both.withColumns({k: c.over(w) for k, c in aggregates.items()}).where(F.col("__block") == mine).drop("__block")


def rolling_sums(x: np.ndarray, frame: tuple[int, int], first: int = 0) -> np.ndarray:
    """Sums of x over the frame of each place; the places are numbered from first, which aligns the runs."""
    at = np.arange(first, first + len(x))
    start, end, total = np.maximum(at + frame[0], first), at + frame[1] + 1, np.zeros(len(x))
    skip = -first % RUN
    runs = x[skip : skip + (len(x) - skip) // RUN * RUN].reshape(-1, RUN) if len(x) > skip else x[:0].reshape(0, RUN)
    of_run = np.zeros(len(runs))
    for k in range(RUN):
        of_run = of_run + runs[:, k]
    last = np.zeros(len(x))
    last[skip + RUN - 1 :: RUN] = of_run
    for k in range(frame[0], frame[1] + 1):
        j = np.maximum(at + k, first)
        run = j // RUN * RUN
        whole = (run >= start) & (run + RUN <= end)
        total += np.where(at + k < first, 0.0, np.where(whole, last[j - first], x[j - first]))
    return total


def rolling_mean(df: DataFrame, step: str, value: str, frame: tuple[int, int], out: str, block: int = 65_536) -> DataFrame:
    """step, value and the mean of value over rows from frame[0] to frame[1] (both <= 0) around each row, by a gapless step from 1.

    Sums of doubles depend on the order of adding, which decides where a row lies right at a threshold. Here it is fixed: the
    rows up to the first whole run of ``RUN`` steps in the frame, the sums of its whole runs, the rows after them. DuckDB adds in that order too. Nulls
    are left out. Blocks are those of ``rolling``.
    """
    _, both = _blocks(df.select(step, value), step, frame, block)
    schema = df.select(step, value).withColumn(out, F.lit(None).cast("double")).schema
    width = max(block, -frame[0], 1)

    def means(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.select([step, value]).sort_by(step)
        x = pc.cast(rows.column(1), pa.float64())
        first = rows.column(0)[0].as_py() - 1
        n = rolling_sums(x.is_valid().to_numpy().astype(np.float64), frame, first)
        with np.errstate(all="ignore"):
            mean = rolling_sums(x.fill_null(0.0).to_numpy(), frame, first) / n
        rows = rows.append_column(out, pa.array(mean, mask=n == 0))
        return rows.filter(pc.greater_equal(rows.column(0), key[0].as_py() * width))

    return both.groupBy("__block").applyInArrow(means, schema)
