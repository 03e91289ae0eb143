"""Exact nearest codes over a codebook of any size.

A codebook is written to the shared folder in blocks of near codes, a file each. A task that looks for nearest codes
takes its vectors in tiles and reads the blocks that may hold a better code than the best so far: by the
triangle inequality, no code of a block is nearer than the distance to the block's centre less its radius, nor than the difference of
norms. Vectors aren't shuffled, no task holds more than ``HELD`` bytes of blocks, and the driver sees one count.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.stores import located
from .shared import delete, fresh_path

#: Codes in a block, blocks' centres to choose by, bytes of blocks in a task, vectors in a tile.
CODES, CENTRES, HELD, TILE = 4096, 1024, 256 << 20, 4096

_BLOCK = "codes array<bigint>, e binary, dim int, centre binary, radius double, low double, high double"
_SCHEMA = pa.schema([("codes", pa.list_(pa.int64())), ("e", pa.binary()), ("dim", pa.int32()), ("centre", pa.binary()), ("radius", pa.float64()), ("low", pa.float64()), ("high", pa.float64())])


@dataclass(frozen=True)
class Stored:
    """A codebook in blocks: where it is and how many codes it has."""

    path: str
    n: int

    def delete(self, spark) -> None:
        delete(spark, self.path)


def _rows(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def _packed(codes_in_a_block: int):
    """Rows of (group, code, e), by group and code, as blocks."""

    def block(codes: list[np.ndarray], e: list[np.ndarray]) -> pa.RecordBatch:
        c, x = np.concatenate(codes), np.concatenate(e)
        centre, norms = x.mean(0), np.sqrt((x * x).sum(1))
        row = {"codes": c, "e": x.tobytes(), "dim": x.shape[1], "centre": centre.tobytes(), "radius": np.sqrt(((x - centre) ** 2).sum(1)).max(), "low": norms.min(), "high": norms.max()}
        return pa.RecordBatch.from_pylist([row], _SCHEMA)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, codes, e, held = None, [], [], 0
        for b in batches:
            if not b.num_rows:
                continue
            group, code, x = b.column(0).to_numpy(), b.column(1).to_numpy(), _rows(b.column(2), b.num_rows)
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(group)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if held and group[i] != of:
                    yield block(codes, e)
                    codes, e, held = [], [], 0
                of = group[i]
                while i < j:
                    k = min(j, i + codes_in_a_block - held)
                    codes.append(code[i:k])
                    e.append(x[i:k])
                    held, i = held + k - i, k
                    if held == codes_in_a_block:
                        yield block(codes, e)
                        codes, e, held = [], [], 0
        if held:
            yield block(codes, e)

    return packed


def store(codebook: DataFrame, n: int | None = None, codes: int = CODES) -> Stored:
    """Writes a codebook (code, e) in blocks of ``codes``; an empty one raises ValueError.

    Up to ``CENTRES`` codes, those of the least hash, are centres; codes are grouped by their nearest centre, and a group of any
    share of the codes is dealt out to as many tasks as it fills blocks.
    """
    spark = codebook.sparkSession
    d = codebook.select(F.col("code").cast("long").alias("code"), F.col("e").cast("array<double>").alias("e"))
    n = d.count() if n is None else n
    if not n:
        raise ValueError("the codebook is empty")
    path = fresh_path(spark, "codebook")
    centres = min(CENTRES, -(-n // codes))
    if centres == 1:
        d = d.select(F.lit(0).alias("group"), "code", "e").coalesce(1)
    else:
        d.select("code", "e", F.xxhash64("code").alias("__h")).orderBy("__h", "code").limit(centres).select("code", "e").coalesce(1).write.parquet(f"{path}-centres")

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = _table(f"{path}-centres")
            p = _rows(t.column("e").combine_chunks(), t.num_rows)
            square = (p * p).sum(1)
            for b in batches:
                x = _rows(b.column(1), b.num_rows) if b.num_rows else np.zeros((0, p.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array((square - 2 * (x @ p.T)).argmin(1) if len(x) else np.zeros(0, np.int64), pa.int64()), *b.columns], ["centre", "code", "e"])

        d = d.mapInArrow(near, "centre bigint, code bigint, e array<double>")
        many = F.broadcast(d.groupBy("centre").agg(F.ceil(F.count("*") / codes).alias("parts")))
        d = d.join(many, "centre").select((F.col("centre") * n + F.pmod(F.xxhash64("code"), F.col("parts"))).alias("group"), "code", "e").repartition("group")
    d.sortWithinPartitions("group", "code").mapInArrow(_packed(codes), _BLOCK).write.option("maxRecordsPerFile", 1).parquet(path)
    if centres > 1:
        delete(spark, f"{path}-centres")
    return Stored(path, n)


def _files(path: str) -> tuple[fs.FileSystem, list[str]]:
    s, at = located(path)
    return s, sorted(f.path for f in s.get_file_info(fs.FileSelector(at)) if f.path.endswith(".parquet"))


def _table(path: str) -> pa.Table:
    s, files = _files(path)
    return pa.concat_tables([pq.ParquetFile(f, filesystem=s).read() for f in files])


class Blocks:
    """A stored codebook in a task."""

    def __init__(self, path: str):
        self.store, self.files = _files(path)
        about = [pq.ParquetFile(f, filesystem=self.store).read(["dim", "centre", "radius", "low", "high"]).to_pylist() for f in self.files]
        self.files = [f for f, a in zip(self.files, about, strict=True) if a]
        about = [a[0] for a in about if a]
        self.dim = about[0]["dim"]
        self.centres = np.stack([np.frombuffer(a["centre"]) for a in about])
        self.radius, self.low, self.high = (np.array([a[k] for a in about]) for k in ("radius", "low", "high"))
        self.held: OrderedDict[int, tuple] = OrderedDict()
        self.bytes = 0

    def block(self, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes, vectors and their squared norms; the latest used blocks stay."""
        if i in self.held:
            self.held.move_to_end(i)
            return self.held[i]
        row = pq.ParquetFile(self.files[i], filesystem=self.store).read(["codes", "e"]).to_pylist()[0]
        e = np.frombuffer(row["e"]).reshape(-1, self.dim)
        self.held[i] = (np.array(row["codes"], np.int64), e, (e * e).sum(1))
        self.bytes += e.nbytes
        while self.bytes > HELD and len(self.held) > 1:
            self.bytes -= self.held.popitem(last=False)[1][1].nbytes
        return self.held[i]

    @staticmethod
    def within(z: np.ndarray, norms: np.ndarray, e: np.ndarray, square: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of the nearest vector of e, of equally near ones the first, and its squared distance, summed by coordinates."""
        rough = square - 2 * (z @ e.T)
        at = rough.argmin(1)
        least = rough[np.arange(len(z)), at]
        d = ((z - e[at]) ** 2).sum(1)
        # products round: whatever is within that of the least is measured by coordinates
        several = np.count_nonzero(rough <= (least + 1e-11 * (norms**2 + square.max() + 1))[:, None], axis=1) > 1
        for i in np.flatnonzero(several):
            some = np.flatnonzero(rough[i] <= least[i] + 1e-11 * (norms[i] ** 2 + square.max() + 1))
            exact = ((z[i] - e[some]) ** 2).sum(1)
            at[i], d[i] = some[exact.argmin()], exact.min()
        return at, d

    def nearest(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest code of each row of z, of equally near ones the least, and its squared distance."""
        codes, best = np.full(len(z), np.iinfo(np.int64).max), np.full(len(z), np.inf)
        for start in range(0, len(z), TILE):
            self._tile(z[start : start + TILE], codes[start : start + TILE], best[start : start + TILE])
        return codes, best

    def _tile(self, z: np.ndarray, codes: np.ndarray, best: np.ndarray) -> None:
        norms = np.sqrt((z * z).sum(1))
        if len(self.files) == 1:
            c, e, square = self.block(0)
            at, best[:] = self.within(z, norms, e, square)
            codes[:] = c[at]
            return
        far = np.sqrt(np.maximum((norms**2)[:, None] - 2 * (z @ self.centres.T) + (self.centres**2).sum(1), 0))
        bound = np.maximum.reduce([far - self.radius, norms[:, None] - self.high, self.low - norms[:, None], np.zeros_like(far)])
        # a little less, as the bound is rounded
        bound = np.maximum(bound - 1e-7 * (1 + norms[:, None] + self.high), 0) ** 2
        for i in np.argsort(far.mean(0), kind="stable"):
            rows = np.flatnonzero(bound[:, i] <= best)
            if len(rows):
                c, e, square = self.block(int(i))
                at, d = self.within(z[rows], norms[rows], e, square)
                better = (d < best[rows]) | ((d == best[rows]) & (c[at] < codes[rows]))
                codes[rows[better]], best[rows[better]] = c[at[better]], d[better]

    def vectors(self, codes: np.ndarray) -> np.ndarray:
        """The vectors of codes; one that the codebook lacks raises ValueError."""
        out, found = np.empty((len(codes), self.dim)), np.zeros(len(codes), bool)
        for i in range(len(self.files)):
            c, e, _ = self.block(i)
            at = np.minimum(np.searchsorted(c, codes), len(c) - 1)
            here = c[at] == codes
            out[here], found = e[at[here]], found | here
        if not found.all():
            raise ValueError("a token that the codebook lacks")
        return out


@lru_cache(2)
def opened(path: str) -> Blocks:
    """Once a worker."""
    return Blocks(path)
