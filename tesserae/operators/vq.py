"""Vector quantisation: nearest code, gather, codebook statistics, EMA, revival, k-means."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import hash_key
from .codebook import TILE, Stored, opened, store
from .ordering import checkpoint, row_numbers

#: Bytes of sums that a task keeps before it gives them on.
SUMS = 64 << 20


def assign(vectors: DataFrame, codebook: DataFrame | Stored, key: str = "vec_id") -> DataFrame:
    """Adds code and its squared distance d; of equal codes the least, for a null vector null. An empty codebook raises ValueError."""
    book = codebook if isinstance(codebook, Stored) else store(codebook)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = None
        for b in batches:
            blocks = blocks or opened(book.path)
            z, there = b.column("z"), b.column("z").is_valid().to_numpy(zero_copy_only=False)
            z = z.drop_null().flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(-1, blocks.dim)
            code, d = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows)
            code[there], d[there] = blocks.nearest(z)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(code, mask=~there), pa.array(d, mask=~there)], [*b.schema.names, "code", "d"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema)
    return vectors.mapInArrow(near, f"{fields}, code bigint, d double")


def tokenize(features: DataFrame, codebook: DataFrame, height: int, width: int, column: str = "z", out: str = "codes") -> DataFrame:
    """Adds the token grid (rows of codes) of encoder features, an array of channels x height x width; null features give null."""
    path = store(codebook).path

    @F.pandas_udf(T.ArrayType(T.ArrayType(T.LongType())))
    def grid(z: pd.Series) -> pd.Series:
        blocks = opened(path)
        one = lambda x: blocks.nearest(np.asarray(x, float).reshape(blocks.dim, -1).T)[0].reshape(height, width)
        return pd.Series([None if x is None else [list(r) for r in one(x)] for x in z])

    return features.withColumn(out, grid(F.col(column).cast("array<double>")))


def untokenize(grids: DataFrame, codebook: DataFrame, column: str = "codes", out: str = "z") -> DataFrame:
    """Adds decoder features (channels x height x width, flat) of token grids; a code that the codebook lacks raises."""
    path = store(codebook).path

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def gathered(c: pd.Series) -> pd.Series:
        blocks = opened(path)
        return pd.Series([None if x is None else blocks.vectors(np.asarray([list(r) for r in x], np.int64).ravel()).T.ravel() for x in c])

    return grids.withColumn(out, gathered(F.col(column).cast("array<array<bigint>>")))


def gather(tokens: DataFrame, codebook: DataFrame) -> DataFrame:
    """Code vectors of tokens, as column e; a code that the codebook lacks is dropped."""
    return tokens.join(codebook, "code")


def histogram(tokens: DataFrame, codebook: DataFrame) -> DataFrame:
    """code, n: uses of every code, 0 included."""
    used = tokens.groupBy("code").agg(F.count("*").alias("n"))
    return codebook.select("code").join(used, "code", "left").select("code", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


def perplexity(hist: DataFrame) -> DataFrame:
    """exp of the entropy of the used codes: from sums of n and n ln n, in one pass."""
    n = F.col("n").cast("double")
    total, x = F.sum(n), F.sum(F.when(n > 0, n * F.ln(n)).otherwise(0.0))
    return hist.agg(F.exp(F.ln(total) - x / total).alias("perplexity"))


def usage(hist: DataFrame, least: float = 0.5) -> DataFrame:
    used = F.sum((F.col("n") > 0).cast("bigint"))
    return hist.agg(used.alias("used"), (used / F.count("*")).alias("usage")).withColumn("is_low", F.col("usage") < least)


def usage_windows(tokens: DataFrame, window: Column) -> DataFrame:
    """Uses of a code between two revival checks."""
    return tokens.groupBy(window.alias("window_no"), "code").agg(F.count("*").alias("n"))


def dead(codebook: DataFrame, tokens: DataFrame) -> DataFrame:
    return codebook.join(tokens.select("code").distinct(), "code", "left_anti")


def revive(dead_codes: DataFrame, vectors: DataFrame, seed: int = 42, key: str = "vec_id") -> DataFrame:
    """code, key: which vector takes the place of each dead code; vectors repeat only if there are too few."""
    d = row_numbers(dead_codes.select("code"), "code", out="rn", start=0)
    k = d.count()
    v = vectors.select(key, hash_key(seed, "revive", F.col(key)).alias("__h")).orderBy("__h", key).limit(max(k, 1))
    v = row_numbers(v, "__h", key, out="vn", start=0)
    n = v.count()
    if not n:
        return d.select("code", F.lit(None).cast("bigint").alias(key)).limit(0)
    return d.withColumn("vn", F.col("rn") % n).join(v, "vn").select("code", key)


def dead_by_window(codebook: DataFrame, tokens: DataFrame, window: Column) -> DataFrame:
    """window_no, code: the codes that no token of a window uses.

    Used codes are a bitmap for each window and 32,768 numbers of codes; a window's dead codes are the codebook's in that
    stretch whose bit isn't set. Windows aren't joined with codes.
    """
    stretch, place = F.bitmap_bucket_number("code"), F.bitmap_bit_position("code")
    used = tokens.where("code IS NOT NULL").select(window.alias("window_no"), stretch.alias("stretch"), place.alias("place"))
    used = used.groupBy("window_no", "stretch").agg(F.bitmap_construct_agg("place").alias("used"))
    book = codebook.groupBy(stretch.alias("stretch")).agg(F.collect_list(F.struct("code", place.alias("place"))).alias("book"))
    # one array of the stretches that the codebook has, at most a 32,768th of its codes
    stretches = book.agg(F.collect_list("stretch")).scalar()
    each = tokens.select(window.alias("window_no")).distinct().select("window_no", F.explode(stretches).alias("stretch"))
    d = each.join(used, ["window_no", "stretch"], "left").join(book, "stretch")
    byte = lambda p: F.conv(F.hex(F.substring("used", (p / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    unset = lambda x: F.col("used").isNull() | (F.call_function("shiftright", byte(x["place"]), (x["place"] % 8).cast("int")).bitwiseAND(F.lit(1)) == 0)
    return d.select("window_no", F.explode(F.filter("book", unset)).alias("x")).select("window_no", "x.code")


def revive_by_window(dead_codes: DataFrame, vectors: DataFrame, window: Column, seed: int = 42, key: str = "vec_id") -> DataFrame:
    """window_no, code, key: ``revive`` within each window, all windows at once; a window is the span between two revival checks."""
    w = Window.partitionBy("window_no")
    v = vectors.select(window.alias("window_no"), key, hash_key(seed, "revive", F.col(key)).alias("__h"))
    n = v.groupBy("window_no").agg(F.count("*").alias("n"))
    v = v.withColumn("vn", F.row_number().over(w.orderBy("__h", key)) - 1).select("window_no", "vn", key)
    d = dead_codes.withColumn("rn", F.row_number().over(w.orderBy("code")) - 1).join(n, "window_no")
    return d.select("window_no", "code", (F.col("rn") % F.col("n")).alias("vn")).join(v, ["window_no", "vn"]).select("window_no", "code", key)


_SUM = "part int, code bigint, n bigint, s array<double>"


class _Sums:
    """Members and sum of vectors for each code seen."""

    def __init__(self):
        self.at: dict[int, int] = {}
        self.n, self.s = np.zeros(0, np.int64), None

    def add(self, codes: np.ndarray, n: np.ndarray, z: np.ndarray) -> None:
        """codes need no order; each brings n members and their sum."""
        if not len(codes):
            return
        order = np.argsort(codes, kind="stable")
        sorted_codes = codes[order]
        starts = np.flatnonzero(np.concatenate([[True], sorted_codes[1:] != sorted_codes[:-1]]))
        at = np.array([self.at.setdefault(c, len(self.at)) for c in sorted_codes[starts].tolist()])
        if len(self.at) > len(self.n):
            more = max(len(self.at), 2 * len(self.n)) - len(self.n)
            self.n = np.concatenate([self.n, np.zeros(more, np.int64)])
            self.s = np.concatenate([np.zeros((0, z.shape[1])) if self.s is None else self.s, np.zeros((more, z.shape[1]))])
        self.n[at] += np.add.reduceat(n[order], starts)
        self.s[at] += np.add.reduceat(z[order], starts)

    @property
    def bytes(self) -> int:
        return 0 if self.s is None else self.s.nbytes

    def out(self) -> Iterator[pa.RecordBatch]:
        part, codes = TaskContext.get().partitionId(), list(self.at)
        dim = 0 if self.s is None else self.s.shape[1]
        for i in range(0, len(codes), TILE):
            k = min(len(codes), i + TILE)
            s = pa.ListArray.from_arrays(pa.array(np.arange(k - i + 1) * dim, pa.int32()), pa.array(self.s[i:k].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(k - i, part, np.int32)), pa.array(codes[i:k], pa.int64()), pa.array(self.n[i:k]), s], ["part", "code", "n", "s"])
        self.__init__()


def _reduced(partial: DataFrame) -> DataFrame:
    """code, n, s (array): the tasks' sums of each code, added up in the order of the tasks; a code has at most a row a task and ``SUMS``."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = _Sums()
        for b in batches:
            if not b.num_rows:
                continue
            codes = b.column(1).to_numpy()
            kept.add(codes, b.column(2).to_numpy(), b.column(3).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1))
            if kept.bytes > SUMS:
                # rows come by code, and codes in order: only the last one may go on
                last, at = kept.at.popitem()
                n, s = kept.n[at : at + 1].copy(), kept.s[at : at + 1].copy()
                yield from kept.out()
                kept.add(np.array([last]), n, s)
        yield from kept.out()

    return partial.repartition("code").sortWithinPartitions("code", "part").mapInArrow(added, _SUM).drop("part")


def sums(assigned: DataFrame) -> DataFrame:
    """code, n, s: members of each code and the sum of their vectors (array). Tasks add up whole vectors, then tasks by code what those found. Rows without a code are left out."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = _Sums()
        for b in batches:
            if b.num_rows:
                kept.add(b.column(0).to_numpy(), np.ones(b.num_rows, np.int64), b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1))
            if kept.bytes > SUMS:
                yield from kept.out()
        yield from kept.out()

    return _reduced(assigned.where("code IS NOT NULL").select("code", F.col("z").cast("array<double>")).mapInArrow(added, _SUM))


def nearest_sums(vectors: DataFrame, book: Stored) -> DataFrame:
    """``sums(assign(...))`` in one pass: assigned vectors don't leave the task."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, blocks = _Sums(), None
        for b in batches:
            blocks = blocks or opened(book.path)
            z = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, blocks.dim)
            kept.add(blocks.nearest(z)[0], np.ones(len(z), np.int64), z)
            if kept.bytes > SUMS:
                yield from kept.out()
        yield from kept.out()

    return _reduced(vectors.where("z IS NOT NULL").select(F.col("z").cast("array<double>").alias("z")).mapInArrow(added, _SUM))


def smoothed(state: DataFrame, epsilon: float = 1e-5) -> DataFrame:
    """Adds weight: ema_sum over the Laplace-smoothed ema_n of all codes, whose total and number are one row's scalar."""
    all_codes = state.agg(F.struct(F.sum("ema_n").alias("total"), F.count("*").alias("k"))).scalar()
    d = state.withColumn("__all", all_codes)
    size = (F.col("ema_n") + epsilon) / (F.col("__all.total") + F.col("__all.k") * epsilon) * F.col("__all.total")
    return d.withColumn("__size", size).withColumn("weight", F.transform("ema_sum", lambda x: x / F.col("__size"))).drop("__all", "__size")


def moved(state: DataFrame, found: DataFrame, decay: float = 0.99) -> DataFrame:
    """State (code, ema_n, ema_sum and others) after a moving-average step towards ``sums``; a code without members keeps its part."""
    d = state.join(found, "code", "left")
    zero = F.transform("ema_sum", lambda _: F.lit(0.0))
    mean = F.zip_with("ema_sum", F.coalesce("s", zero), lambda v, s: decay * v + (1 - decay) * s)
    return d.withColumns({"ema_sum": mean, "ema_n": decay * F.col("ema_n") + (1 - decay) * F.coalesce("n", F.lit(0))}).drop("n", "s")


def ema(codebook: DataFrame, assigned: DataFrame, decay: float = 0.99, epsilon: float = 1e-5, start_size: float = 1.0) -> DataFrame:
    """code, ema_n, ema_sum, weight (arrays) after one moving-average step of all codes, with Laplace-smoothed sizes."""
    state = codebook.select("code", F.lit(float(start_size)).alias("ema_n"), F.col("e").alias("ema_sum"))
    return smoothed(moved(state, sums(assigned), decay), epsilon)


def kmeans(vectors: DataFrame, codebook: DataFrame, iterations: int) -> DataFrame:
    """code, e after a fixed number of Lloyd rounds; an empty cluster keeps its centre. Lineage is cut each round, and a round's blocks go with it."""
    c, n = codebook.select("code", "e"), None
    for _ in range(iterations):
        book = store(c, n)
        new = nearest_sums(vectors, book).select("code", F.transform("s", lambda x: x / F.col("n")).alias("new"))
        c, n = checkpoint(c.join(new, "code", "left").select("code", F.coalesce("new", "e").alias("e"))), book.n
        book.delete(vectors.sparkSession)
    return c


def kmeans_init(vectors: DataFrame, codebook: DataFrame, iterations: int = 15, seed: int = 42, key: str = "vec_id") -> DataFrame:
    """code, e, ema_n, ema_sum, started: a codebook started from vectors (those of the first batches of a plan, say).

    Codes in ascending order take the vectors of the least hash of seed and key; then follow ``iterations`` Lloyd
    rounds. Moving averages start at one member, the centre itself. With fewer vectors than codes the codebook stays
    as it is (started is false).
    """
    k = codebook.count()
    v = vectors.where("z IS NOT NULL").select(key, "z")
    first = v.select(key, "z", hash_key(seed, "kmeans", F.col(key)).alias("__h")).orderBy("__h", key).limit(k)
    enough = first.count() >= k
    c = codebook.select("code", "e")
    if enough:
        codes = row_numbers(c.select("code"), "code", out="__n")
        c = codes.join(row_numbers(first, "__h", key, out="__n").select("__n", F.col("z").alias("e")), "__n").select("code", "e")
        c = kmeans(v, c, iterations)
    return c.select("code", "e", F.lit(1.0).alias("ema_n"), F.col("e").alias("ema_sum"), F.lit(enough).alias("started"))


def revived(codebook: DataFrame, plan: DataFrame, vectors: DataFrame, key: str = "vec_id") -> DataFrame:
    """The codebook (code, e, and where it has them ema_n, ema_sum, usage) after a revival ``plan`` (code, key).

    A revived code takes its vector, also as its moving average, with one member; the usage counter of every
    code starts anew.
    """
    new = plan.join(vectors.select(key, F.col("z").alias("__new")), key).select("code", "__new")
    d = codebook.join(new, "code", "left")
    set_to = {"e": F.col("__new"), "ema_sum": F.col("__new"), "ema_n": F.when(F.col("__new").isNotNull(), F.lit(1.0))}
    columns = [F.coalesce(set_to[c], F.col(c)).alias(c) if c in set_to else F.lit(0).cast("bigint").alias(c) if c == "usage" else F.col(c) for c in codebook.columns]
    return d.select(*columns)
