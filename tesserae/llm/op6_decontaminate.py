"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items become lower-case word tokens (runs of letters, digits and
underscores). Running Karp-Rabin hashes of ``SEED`` tokens join each document with the items
it shares a seed with. For each such pair, the longest common runs are marked one after the
other, never overlapping in either text, until none of ``SEED`` tokens is left; the item's
coverage is the share of its tokens under tiles. As tiles may stand in any order, reordered
passages count in full. A document is contaminated if an item is covered to ``COVERAGE``.

1. A bitmap of the items' seeds (``BITS_A_SEED`` bits each, 2 ** ``MOST_BITS`` at most: 64 MB; it only saves
   work, so a larger benchmark costs more candidates, never a match; a text without a seed of the benchmark
   passes it with a chance of a few per thousand) is built by tasks and sent to all.
2. One pass over the documents, whatever the size of the benchmark, keeps the texts with a seed
   in the bitmap, equal texts once, with those seeds.
3. An item is posted under its rarest seeds, as many as a text that covers it can't miss; texts join those, and pairs that share
   too few seeds in all are dropped, so that a common phrase alone pairs nothing. Only then are texts read: each pair is
   tiled, a text with one item at a time. A passage in a third of all documents costs each distinct text its own tiling,
   and no group is collected.
4. The contaminated texts, known by their SHA-256, are looked up where the documents lie: broadcast up to
   ``FEW`` of them, joined by a shuffle beyond that.

Edge cases: null, empty and blank texts, and items without tokens, match nothing; an item of fewer than
SEED tokens is a seed as a whole and must occur whole; texts of any length are searched whole (a pair's
common seeds must fit a task's memory: 16 bytes for each pair of places); of runs of one length, the first in the item
and then in the document is marked first; the result of ``leaks`` has one row for each contaminated doc_id
(repeated rows fold into one, null ids too), ``clean`` keeps or drops each row by its text; item_ids that repeat
count as items of their own and appear once; an empty table of either kind contaminates nothing; other columns
are ignored by ``leaks`` and kept by ``clean``, whatever their names.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, fresh_name, read_table
from .op2_minhash_dedup import run_hashes

SEED, COVERAGE, FEW = 5, 0.5, 200_000
BITS_A_SEED, MOST_BITS = 32, 29
_WORD = re.compile(r"\w+")
_B = np.uint64(0x5851F42D4C957F2D)


def tokens(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def rolling(ids: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes of the windows of n ids, modulo 2 ** 64."""
    if len(ids) < n:
        return np.zeros(0, np.uint64)
    u = ids.astype(np.uint64) + np.uint64(2)
    h = np.zeros(len(ids) - n + 1, np.uint64)
    for k in range(n):
        h = h * _B + u[k : len(ids) - n + 1 + k]
    return h


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


@lru_cache(1)
def _word_characters() -> np.ndarray:
    """Whether a code point belongs to words, for all code points."""
    out = np.zeros(0x110000, bool)
    out[[ord(c) for c in re.findall(r"\w", "".join(map(chr, range(0x110000))))]] = True
    return out


def numbers(text: str) -> np.ndarray:
    """A 64-bit hash of each token of a text, the same in every process."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    return run_hashes(codes, _word_characters()[codes])


def seeds(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all windows of n words, told apart by n."""
    return _mixed(rolling(words, n) + np.uint64(n))


def common_runs(doc: np.ndarray, item: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    """Maximal common runs of n ids or more: (-length, item place, doc place); negative ids are equal to nothing."""
    hd, hi = rolling(doc, n), rolling(item, n)
    order = np.argsort(hi, kind="stable")
    lo, hi_end = np.searchsorted(hi[order], hd, "left"), np.searchsorted(hi[order], hd, "right")
    many = hi_end - lo
    i = np.repeat(np.arange(len(hd)), many)
    j = order[np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)]
    same = np.ones(len(i), bool)
    for k in range(n):
        same &= (doc[i + k] == item[j + k]) & (doc[i + k] >= 0)
    i, j = i[same], j[same]
    if not len(i):
        return []
    o = np.lexsort((i, i - j))
    i, j = i[o], j[o]
    first = np.flatnonzero(np.concatenate([[True], (np.diff(i) != 1) | (np.diff(j) != 1)]))
    size = np.diff(np.append(first, len(i))) + n - 1
    return list(zip((-size).tolist(), j[first].tolist(), i[first].tolist(), strict=True))


def tiles(doc: np.ndarray, item: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    """Greedy tiling of two arrays of ids: (doc place, item place, length)."""
    runs = common_runs(doc, item, n)
    heapq.heapify(runs)
    in_doc, in_item, out = np.zeros(len(doc), bool), np.zeros(len(item), bool), []
    while runs:
        size, j, i = heapq.heappop(runs)
        taken = in_doc[i : i - size] | in_item[j : j - size]
        if not taken.any():
            in_doc[i : i - size] = in_item[j : j - size] = True
            out.append((i, j, -size))
            continue
        edge = np.flatnonzero(np.diff(~taken, prepend=False, append=False))
        for lo, hi in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if hi - lo >= n:
                heapq.heappush(runs, (lo - hi, j + lo, i + lo))
    return out


def covered(doc: list[str], item: list[str], seed: int = SEED) -> tuple[int, int]:
    """Tiles of an item in a document, and tokens of the item under them."""
    ids: dict[str, int] = {}
    a = np.array([ids.setdefault(w, len(ids)) for w in item], np.int64)
    b = np.array([ids.get(w, -1) for w in doc], np.int64)
    t = tiles(b, a, min(seed, len(a))) if len(a) else []
    return len(t), sum(x[2] for x in t)


_SHIFTS = (0, 5, 10, 15, 20, 25, 30, 35)


def _probe(h: np.ndarray, bits: int, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte and bit of hashes in a bitmap."""
    p = ((h >> np.uint64(shift)) * np.uint64(0x9E3779B97F4A7C15 + 2 * shift) >> np.uint64(64 - bits)) & np.uint64((1 << bits) - 1)
    return (p >> np.uint64(3)).astype(np.int64), np.uint8(1) << (p & np.uint64(7)).astype(np.uint8)


def in_bitmap(bitmap: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    """The hashes whose bits are all set."""
    for s in _SHIFTS:
        at, bit = _probe(h, bits, s)
        h = h[bitmap[at] & bit != 0]
    return h


def items_of(benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """item (a number of its own for each row), item_id, text, n (the seed's tokens), seeds (different ones), weights (places of each) and needed.

    Tiles that cover w tokens, n each at least, hold w / n places of seeds or more; so a text covers the item only if the seeds that both
    have take ``needed`` of the item's places.
    """

    def seeded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, found, weights, needed = [], [], [], []
            for t in b.column("text").to_pylist():
                w = numbers(t)
                n.append(min(SEED, len(w)))
                s, m = np.unique(seeds(w, n[-1]), return_counts=True) if len(w) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                found.append(s.view(np.int64))
                weights.append(m.astype(np.int32))
                # w >= coverage * len(item) has the tolerance of that product
                needed.append(max(1, math.ceil(math.ceil(coverage * len(w) - 1e-9) / n[-1])) if len(w) else 1)
            more = [pa.array(n, pa.int32()), pa.array(found, pa.list_(pa.int64())), pa.array(weights, pa.list_(pa.int32())), pa.array(needed, pa.int32())]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], [*b.schema.names, "n", "seeds", "weights", "needed"])

    b = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return checkpoint(b.mapInArrow(seeded, "item_id long, text string, n int, seeds array<long>, weights array<int>, needed int").where("n > 0").withColumn("item", F.monotonically_increasing_id()))


#: Bytes of a bitmap that are put together at once.
SEGMENT = 1 << 16


def bitmap_of(items: DataFrame, bits: int) -> np.ndarray:
    """The bitmap of all items' seeds, 2 ** bits / 8 bytes: each task gives the segments that it has set, which are put together segment by segment."""
    size = min(SEGMENT, 1 << (bits - 3))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(1 << (bits - 3), np.uint8)
        for b in batches:
            for s in _SHIFTS:
                np.bitwise_or.at(out, *_probe(b.column(0).flatten().to_numpy().view(np.uint64), bits, s))
        for k in np.flatnonzero(out.reshape(-1, size).any(1)).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([out[k * size : (k + 1) * size].tobytes()], pa.binary())], ["segment", "bitmap"])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, out = None, np.zeros(size, np.uint8)

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([of]), pa.array([out.tobytes()], pa.binary())], ["segment", "bitmap"])

        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if k != of:
                    if of is not None:
                        yield row()
                    of, out = k, np.zeros(size, np.uint8)
                out |= np.frombuffer(x.as_py(), np.uint8)
        if of is not None:
            yield row()

    kind = "segment long, bitmap binary"
    whole = np.zeros(1 << (bits - 3), np.uint8)
    for r in items.select("seeds").mapInArrow(put, kind).repartition("segment").sortWithinPartitions("segment").mapInArrow(together, kind).collect():
        whole[r.segment * size : (r.segment + 1) * size] = np.frombuffer(bytes(r.bitmap), np.uint8)
    return whole


def candidates(mine: DataFrame, items: DataFrame) -> DataFrame:
    """digest, item: texts (digest, seeds) and items that share enough seeds for the text to cover the item.

    An item is posted under its rarest seeds alone: the seeds left out, which most texts have, together take fewer places than
    ``needed``, so a text that covers the item has a posted one. What texts and items merely share by a common phrase is never paired;
    the pairs that are left are held against all their seeds, before any text is read.
    """
    each = mine.select("digest", F.explode("seeds").alias("h"))
    texts = each.groupBy("h").agg(F.count("*").alias("texts"))
    seeds_ = items.select("item", "needed", F.explode(F.arrays_zip("seeds", "weights")).alias("s")).select("item", "needed", F.col("s.seeds").alias("h"), F.col("s.weights").alias("w"))
    # most frequent first; seeds that no text has are rarest
    order = Window.partitionBy("item").orderBy(F.col("texts").desc_nulls_last(), "h").rowsBetween(Window.unboundedPreceding, 0)
    posted = seeds_.join(texts, "h", "left").withColumn("taken", F.sum("w").over(order)).where("taken >= needed AND texts IS NOT NULL")
    pairs = each.join(posted.select("item", "h"), "h").select("digest", "item").distinct()
    both = pairs.join(items.select("item", F.col("seeds").alias("theirs"), "needed", (F.aggregate("weights", F.lit(0), lambda a, w: a + w) - F.size("weights")).alias("again")), "item").join(mine.select("digest", "seeds"), "digest")
    return both.where(F.size(F.array_intersect("seeds", "theirs")) + F.col("again") >= F.col("needed")).select("digest", "item")


def digest_of(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """digest (of a text), item_ids, coverage (the most of any item), n_tiles and n_words of the texts that cover an item."""
    items = items_of(benchmark, coverage)
    size = items.agg(F.sum(F.size("seeds")), F.collect_set("n")).first()
    lengths = sorted(size[1] or [])
    bits = min(MOST_BITS, max(16, int(np.ceil(np.log2(BITS_A_SEED * (size[0] or 1))))))
    sent = docs.sparkSession.sparkContext.broadcast(bitmap_of(items, bits))

    def seeded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, found = [], []
            for k, t in enumerate(b.column(0)):
                w = numbers(t.as_py())
                h = np.concatenate([np.zeros(0, np.uint64), *(seeds(w, n) for n in lengths)])
                h = in_bitmap(sent.value, h, bits)
                if len(h):
                    rows.append(k)
                    found.append(np.unique(h).view(np.int64))
            if rows:
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array(found, pa.list_(pa.int64()))], ["text", "seeds"])

    t = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(seeded, "text string, seeds array<long>")
    t = checkpoint(t.groupBy(digest_of(F.col("text")).alias("digest")).agg(F.first("text").alias("doc"), F.first("seeds").alias("seeds")))
    pairs = checkpoint(candidates(t.select("digest", "seeds"), items))
    rows = pairs.join(items.select("item", "item_id", "text"), "item").join(t.select("digest", "doc"), "digest").select("digest", "doc", "item_id", "text")

    def tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, doc = None, []
        for b in batches:
            out = []
            for d, text, i, item in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), b.column(3), strict=True):
                if d != last:
                    last, doc = d, tokens(text.as_py())
                item = tokens(item.as_py())
                n, w = covered(doc, item)
                if w >= coverage * len(item):
                    out.append((d, i, w / len(item), n, w))
            if out:
                kinds = (pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["digest", "item_id", "coverage", "n_tiles", "n_words"])

    hits = rows.mapInArrow(tiled, "digest string, item_id long, coverage double, n_tiles long, n_words long")
    return checkpoint(hits.groupBy("digest").agg(
        F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max("coverage").alias("coverage"), F.sum("n_tiles").alias("n_tiles"), F.sum("n_words").alias("n_words")
    ))


def _near(found: DataFrame) -> DataFrame:
    return F.broadcast(found) if found.limit(FEW + 1).count() <= FEW else found


def _digest(docs: DataFrame) -> Column:
    return digest_of(F.coalesce(docs["text"].cast("string"), F.lit("")))


def leaks(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, item_ids, coverage (the most of any item), n_tiles and n_words of the contaminated documents."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _digest(docs).alias("digest"))
    hits = d.join(_near(contaminated(docs, benchmark, coverage)), "digest")
    return hits.groupBy("doc_id").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("item_ids"), F.max("coverage").alias("coverage"), F.sum("n_tiles").alias("n_tiles"), F.sum("n_words").alias("n_words")
    )


def clean(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The rows of docs that cover no item; they are not shuffled for it unless very many texts are contaminated."""
    name = fresh_name(docs, "__digest")
    found = contaminated(docs, benchmark, coverage).select(F.col("digest").alias(name))
    return docs.join(_near(found), _digest(docs) == F.col(name), "left_anti")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
