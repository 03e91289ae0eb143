"""Sharding by a two-pass external shuffle.

Pass 1 scatters records into buckets of about ``BUCKET_BYTES`` (of whole rows, all columns) by a
seeded hash of the whole row. There may be many more buckets than shuffle partitions, of which
there are ``WIDTH`` at most: a partition is sorted by bucket outside memory. Pass 2 takes one
bucket after the other into memory, in a fixed order, shuffles it by Fisher-Yates with a generator
seeded by (seed, bucket), and writes it. Bucket counts (one number each, at most ``MAX_BUCKETS``; with
more bytes than that, buckets are larger) give offsets, so a record knows its place p in the whole
permutation: shard p mod n, slot p div n. The law is ``rows``: shard counts differ by one at most.

The order depends on the rows, the seed and the number of buckets, not on the number of tasks.
Hot sources, ids and texts are spread like all rows; only rows that are equal in every column
share a bucket (a table with a great many repeats of one whole row would fill it).

Edge cases: null texts count as empty (size 1), null ids are hashed like any value; a text of any
length is one row; repeated rows each get a slot; an empty table gives no rows; whole rows are kept
under the struct ``doc``, so no column name can clash with ``shard`` or ``slot``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh_path, read_table

SHARDS, SEED, BUCKET_BYTES = 8, 20240229, 32 << 20
WIDTH, MAX_BUCKETS = 10_000, 4_000_000


def fisher_yates(n: int, rng: np.random.Generator) -> np.ndarray:
    """A permutation of range(n): each place from the last swaps with one not after it."""
    order = list(range(n))
    for i, j in zip(range(n - 1, 0, -1), rng.integers(0, np.arange(n, 1, -1)).tolist(), strict=True):
        order[i], order[j] = order[j], order[i]
    return np.array(order, np.int64)


def row_bytes(docs: DataFrame) -> Column:
    """About the bytes of a row: its strings and bytes, nested columns as JSON, 8 for anything else."""
    total = F.lit(1)
    for f in docs.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
            c = F.octet_length(F.to_json(F.struct(c)))
        elif isinstance(f.dataType, (T.StringType, T.BinaryType)):
            c = F.octet_length(c)
        else:
            c = F.lit(8)
        total = total + F.coalesce(c, F.lit(0))
    return total


def _has_map(kind: T.DataType) -> bool:
    """Whether a type is or holds one that can't be hashed."""
    if isinstance(kind, T.ArrayType):
        return _has_map(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(_has_map(f.dataType) for f in kind.fields)
    return isinstance(kind, (T.MapType, T.VariantType))


def row_hash(docs: DataFrame, seed: int) -> Column:
    """A hash of all columns; those that are or hold maps or variants, which can't be hashed, as JSON."""
    return F.xxhash64(F.lit(seed), *(F.to_json(F.struct(F.col(f"`{f.name}`"))) if _has_map(f.dataType) else F.col(f"`{f.name}`") for f in docs.schema.fields))


def shuffled(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc (the whole row), shard, slot."""
    total = docs.agg(F.sum(row_bytes(docs))).first()[0] or 0
    n = int(min(1 + total // bucket_bytes, MAX_BUCKETS))
    h = row_hash(docs, seed)
    d = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.col("doc_id").alias("id"), h.alias("h"))
    d = d.withColumn("bucket", F.pmod("h", F.lit(n)))
    counts = d.groupBy("bucket").count().toPandas()
    size = np.zeros(n + 1, np.int64)
    size[counts["bucket"].to_numpy(np.int64) + 1] = counts["count"].to_numpy(np.int64)
    offset = docs.sparkSession.sparkContext.broadcast(np.cumsum(size))

    def permute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bucket = [], None

        def done():
            t = pa.Table.from_batches(held)
            order = fisher_yates(t.num_rows, np.random.default_rng([seed, bucket]))
            at = offset.value[bucket] + np.arange(t.num_rows)
            for lo in range(0, t.num_rows, 2000):
                part = t.take(pa.array(order[lo : lo + 2000])).combine_chunks()
                place = at[lo : lo + 2000]
                cols = [part.column(0).combine_chunks() if isinstance(part.column(0), pa.ChunkedArray) else part.column(0), pa.array((place % shards).astype(np.int32)), pa.array(place // shards)]
                cols[0] = cols[0].chunk(0) if isinstance(cols[0], pa.ChunkedArray) else cols[0]
                yield pa.RecordBatch.from_arrays(cols, ["doc", "shard", "slot"])

        for b in batches:
            of = b.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
            for lo, hi in zip(cuts, cuts[1:]):  # noqa: B905
                if lo == hi:
                    continue
                if of[lo] != bucket:
                    if held:
                        yield from done()
                    held, bucket = [], int(of[lo])
                held.append(pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo)], ["doc"]))
        if held:
            yield from done()

    scattered = d.repartition(min(n, WIDTH), "bucket").sortWithinPartitions("bucket", "id", "h").select("doc", "bucket")
    schema = T.StructType([scattered.schema["doc"], T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    return scattered.mapInArrow(permute, schema)


def write_shards(docs: DataFrame, out: str, **parameters) -> DataFrame:
    """Writes folder shard=k for each shard under ``out``, and gives the table read back."""
    shuffled(docs, **parameters).write.partitionBy("shard").option("compression", "zstd").parquet(out)
    spark = docs.sparkSession
    kind = T.StructType([T.StructField("doc", T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema])), T.StructField("slot", T.LongType()), T.StructField("shard", T.IntegerType())])
    return spark.read.schema(kind).parquet(out)


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = write_shards(read_table(spark, sf_dir, "documents"), fresh_path(spark, "shards"))
    text = F.coalesce("doc.text", F.lit(""))
    return written.select(
        F.col("doc.doc_id").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).cast("long").alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )

