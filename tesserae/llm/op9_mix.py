"""Mixing sources to target weights by hash-random keys and distributed prefix sums.

Each document gets a key from a seeded hash of its id. A source's budget is its target,
rounded: whole epochs of the source, then its documents in key order up to the exact
remainder; the document at the cut gives only the words that are still missing.

The cut is found without moving text: (source, key, id, size) are range-sorted, each range
returns one sum for each source in it, the sums give offsets, and the one range in which a
source's budget ends returns the cut. So a source with a third of all rows is spread over many
ranges, and what a document gives follows from its own key and its source's cut. The driver
holds a row for each source (their number is checked) and a row for each range and source.

Targets: sources in code point order, null last, weigh 5, 2, 1, 5, 2, 1, ... and share all
words; a target stops at ``MOST`` times its source's words, and the excess goes to the others
by weight until none is above.

Edge cases: null and empty texts have size 0 and give nothing; rows equal in id and size share
what is left at a cut evenly (up to a word each); null ids are keyed as an empty id; an empty
table gives no rows; other columns are ignored by the plan and kept by ``mix``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import floor

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, checkpoint, partitions, read_table

WEIGHTS, MOST, SEED, MAX_SOURCES = (5, 2, 1), 3, 42, 1_000_000
_LEAST = -(2**63)


def words_of(text: str) -> Column:
    return F.array_remove(F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), SPACE), "")


def key_of(doc_id: Column, seed: int) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def water_fill(sizes: list[int], weights: list[float], most: float = MOST) -> list[float]:
    """Shares of sum(sizes) by weight, none above most times its size."""
    out = [0.0] * len(sizes)
    open_, left = [i for i, s in enumerate(sizes)], float(sum(sizes))
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if unit * weights[i] > most * sizes[i]]
        for i in full or open_:
            out[i] = float(most * sizes[i]) if full else unit * weights[i]
        if not full:
            break
        left -= sum(out[i] for i in full)
        gone = set(full)
        open_ = [i for i in open_ if i not in gone]
    return [round(x, 6) for x in out]


@dataclass(frozen=True)
class Source:
    name: str | None
    size: int
    target: float

    @property
    def epochs(self) -> int:
        return floor(self.target + 0.5) // self.size if self.size else 0

    @property
    def rest(self) -> int:
        return floor(self.target + 0.5) % self.size if self.size else 0


def targets(base: DataFrame, weights=WEIGHTS, most: float = MOST) -> list[Source]:
    totals = base.groupBy("source").agg(F.sum("size").alias("size"))
    rows = totals.limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    rows.sort(key=lambda r: (r.source is None, r.source or ""))
    t = water_fill([r.size for r in rows], [weights[i % len(weights)] for i in range(len(rows))], most)
    return [Source(r.source, r.size, x) for r, x in zip(rows, t, strict=True)]


def cuts(base: DataFrame, sources: list[Source]) -> dict[str | None, tuple[int, int, int, int]]:
    """Per source with a remainder: key, id and size of the rows at the cut, and the words that each of them gives."""
    spark = base.sparkSession
    rest = spark.sparkContext.broadcast({s.name: s.rest for s in sources if s.rest})
    order = ["source", "key", "id", "size"]
    d = base.where("size > 0").select("source", "key", F.coalesce("doc_id", F.lit(_LEAST)).alias("id"), "size")
    d = checkpoint(d.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for b in batches:
            for s, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total[s] = total.get(s, 0) + n
        p = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([p] * len(total), pa.int64()), pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["p", "source", "n"])

    at: dict = {}
    before: dict = {}
    for r in sorted(d.select("source", "size").mapInArrow(sums, "p long, source string, n long").collect(), key=lambda r: r.p):
        before[r.p, r.source] = at.get(r.source, 0)
        at[r.source] = at.get(r.source, 0) + r.n
    sent = spark.sparkContext.broadcast(before)

    def crossed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        want, p = rest.value, TaskContext.get().partitionId()
        run: dict = {s: n for (q, s), n in sent.value.items() if q == p}
        last, ties, out = None, 0, []

        def close():
            s, k, i, n = last
            if s in want and run[s] < want[s] <= run[s] + ties * n:
                out.append((s, k, i, n, (want[s] - run[s]) // ties))
            run[s] += ties * n

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True):
                if row != last:
                    if last:
                        close()
                    last, ties = row, 0
                ties += 1
        if last:
            close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k == 0 else pa.int64()) for k, c in enumerate(zip(*out, strict=True))], ["source", "key", "id", "size", "each"])

    rows = d.mapInArrow(crossed, "source string, key long, id long, size long, each long").collect()
    return {r.source: (r.key, r.id, r["size"], r.each) for r in rows}


def base_of(docs: DataFrame, seed: int = SEED) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.size(words_of("text")).cast("long").alias("size"), key_of(F.col("doc_id"), seed).alias("key"))


def plan(base: DataFrame, weights=WEIGHTS, most: float = MOST) -> DataFrame:
    """Per source: source, source_size, target, epochs, and the cut."""
    sources = targets(base, weights, most)
    cut = cuts(base, sources)
    rows = [(s.name, s.size, s.target, s.epochs, *cut.get(s.name, (_LEAST, _LEAST, 0, 0))) for s in sources]
    return base.sparkSession.createDataFrame(rows, "source string, source_size long, target double, epochs long, cut_key long, cut_id long, cut_size long, cut_each long")


def with_plan(d: DataFrame, p: DataFrame, source: str, doc_id: str, size: str, key: str) -> DataFrame:
    """Adds source_size, target, epochs and part (words of one more, partial or whole, take) to rows."""
    p = p.withColumnRenamed("source", "__source")
    if p.count() <= 100_000:
        p = F.broadcast(p)
    i = F.coalesce(F.col(doc_id), F.lit(_LEAST))
    k, n = F.col(key), F.col(size)
    sooner = (k < F.col("cut_key")) | ((k == F.col("cut_key")) & ((i < F.col("cut_id")) | ((i == F.col("cut_id")) & (n < F.col("cut_size")))))
    here = (k == F.col("cut_key")) & (i == F.col("cut_id")) & (n == F.col("cut_size"))
    part = F.when(F.col("cut_size") == 0, 0).when(sooner, n).when(here, F.col("cut_each")).otherwise(0).cast("long")
    return d.join(p, F.col(source).eqNullSafe(F.col("__source"))).withColumn("part", part).drop("__source", "cut_key", "cut_id", "cut_size", "cut_each")


def takes(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of docs."""
    base = checkpoint(base_of(docs, seed))
    out = with_plan(base, plan(base), "source", "doc_id", "size", "key")
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("epochs") + F.col("part")).alias("taken"))


def mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mixture itself, with the columns of docs: a row for each take; at a cut, the first words of the text joined by spaces."""
    base = checkpoint(base_of(docs, seed))
    d = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.col("doc_id").cast("long").alias("__id"), F.col("source").cast("string").alias("__of"), F.size(words_of("text")).cast("long").alias("__size"), key_of(F.col("doc_id"), seed).alias("__key"))
    d = with_plan(d, plan(base), "__of", "__id", "__size", "__key")
    n = F.col("epochs") + F.when(F.col("part") > 0, 1).otherwise(0)
    d = d.where((n > 0) & (F.col("__size") > 0)).withColumn("__take", F.explode(F.sequence(F.lit(1), n)))
    cut = (F.col("__take") > F.col("epochs")) & (F.col("part") < F.col("__size"))
    d = d.withColumn("text", F.col("doc.text").cast("string")).withColumn("cut", cut)
    text = F.when(F.col("cut"), F.array_join(F.slice(words_of("text"), F.lit(1), F.greatest(F.col("part"), F.lit(1)).cast("int")), " ")).otherwise(F.col("text"))
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(text.alias("text"))
        elif c == "n_chars":
            columns.append(F.when(F.col("cut"), F.length(text)).otherwise(F.col("doc.n_chars")).cast(docs.schema[c].dataType).alias(c))
        else:
            columns.append(F.col(f"doc.`{c}`").alias(c))
    return d.select(*columns)


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return takes(read_table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size,
             ('0x' || substr(md5('42:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source),
r AS (SELECT *, 3.0::DOUBLE * source_size / w AS ratio FROM s),
l AS (SELECT *, coalesce(sum(3 * source_size) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
             sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_from, sum(source_size) OVER () AS total FROM r),
u AS (SELECT max((total - full_before)::DOUBLE / w_from) AS unit FROM l WHERE (total - full_before)::DOUBLE / w_from <= ratio),
t AS (SELECT source, source_size, round(least(3.0::DOUBLE * source_size, coalesce(unit, 0) * w), 6) AS target FROM s, u),
b AS (SELECT *, floor(target + 0.5)::BIGINT AS budget FROM t),
p AS (SELECT d.*, b.source_size, b.target, b.budget // greatest(b.source_size, 1) AS epochs, b.budget % greatest(b.source_size, 1) AS rest,
             sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) - size AS before
      FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, (size * epochs + least(size, greatest(0, rest - before)))::BIGINT AS taken FROM p
"""
