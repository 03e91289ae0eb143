"""Image catalogs: listing, suffix filter, path order, sizes from file headers."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.ordering import row_numbers
from ..operators.shared import checkpoint
from .stores import located, parts_of, store_of

# The image suffixes.
SUFFIXES = ("jpg", "jpeg", "png", "webp", "bmp")
#: Bytes of a file that are read first; more follow until its header is found.
HEAD = 1 << 15
#: Files that a task takes at once.
FILES = 1000
KINDS = {"path": pa.string(), "length": pa.int64(), "width": pa.int32(), "height": pa.int32()}


def is_image(path: Column) -> Column:
    """By the suffix of the file name, whatever its case; a name that is only a suffix is none."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1)).isin(*SUFFIXES)


def ordered(paths: DataFrame, path: str = "path", out: str = "image_id", start: int = 0) -> DataFrame:
    """Numbers paths by their parts (a/x before a-b/x), over as many tasks as there are partitions."""
    return row_numbers(paths.withColumn("__parts", F.split(path, "/")), "__parts", out=out, start=start).drop("__parts")


def _name(path: str) -> re.Match | None:
    return re.search(r"[^/]\.([^./]+)$", path)


class Listed(InputPartition):
    """Folders to be listed to the end, and files that are known."""

    def __init__(self, folders: list[str], files: list[tuple[str, int]]):
        self.folders, self.files = folders, files


class ImageReader(DataSourceReader):
    """Lists in tasks: the driver only goes down until there are enough folders to deal out. Files are opened where width or height is asked for."""

    def __init__(self, columns: list[str], root: str, parts: int):
        self.columns, self.root, self.parts = columns, root, parts

    def _found(self, selector: fs.FileSelector) -> Iterator[fs.FileInfo]:
        yield from sorted(located(self.root)[0].get_file_info(selector), key=lambda f: f.path)

    def partitions(self) -> list[Listed]:
        folders, files = [located(self.root)[1]], []
        while folders and len(folders) < self.parts:
            below = []
            for folder in folders:
                for f in self._found(fs.FileSelector(folder)):
                    if f.type == fs.FileType.Directory:
                        below.append(f.path)
                    elif (m := _name(f.path)) and m[1].lower() in SUFFIXES:
                        files.append((f.path, f.size))
            folders = below
        n = max(1, min(len(folders), self.parts))
        dealt = [Listed(folders[i::n], []) for i in range(n) if folders]
        return dealt + [Listed([], files[i : i + FILES]) for i in range(0, len(files), FILES)] or [Listed([], [])]

    def read(self, partition: Listed) -> Iterator[pa.RecordBatch]:
        scheme, authority, _ = parts_of(self.root)
        store, prefix = store_of(scheme, authority)
        below = ((f.path, f.size) for d in partition.folders for f in self._found(fs.FileSelector(d, recursive=True)) if f.type == fs.FileType.File and (m := _name(f.path)) and m[1].lower() in SUFFIXES)
        rows = chain(partition.files, below)
        while some := list(islice(rows, FILES)):
            got = {"path": [f"{scheme}://{authority}{p.removeprefix(prefix)}" for p, _ in some], "length": [n for _, n in some]}
            if {"width", "height"} & set(self.columns):
                sizes = [size_of(store, p) for p, _ in some]
                got |= {"width": [w for w, _ in sizes], "height": [h for _, h in sizes]}
            yield pa.RecordBatch.from_arrays([pa.array(got[c], KINDS[c]) for c in self.columns], self.columns)


class ImageFiles(DataSource):
    """Image files below a folder: path, length, width, height. Ask for some of them by ``schema()``; names that begin with a dot or underscore are files like others."""

    @classmethod
    def name(cls) -> str:
        return "tesserae_images"

    def schema(self) -> str:
        return "path string, length bigint, width int, height int"

    def reader(self, schema: T.StructType) -> ImageReader:
        if odd := set(schema.names) - set(KINDS):
            raise ValueError(f"image files have no {sorted(odd)}")
        return ImageReader(schema.names, self.options["path"], int(self.options.get("parts", 64)))


def files(spark: SparkSession, root: str, *columns: str, parts: int = 64) -> DataFrame:
    """The given ones of path, length, width, height of the image files below root; contents aren't read for the first two."""
    spark.dataSource.register(ImageFiles)
    kinds = {"path": "string", "length": "bigint", "width": "int", "height": "int"}
    return spark.read.format("tesserae_images").schema(", ".join(f"{c} {kinds[c]}" for c in columns)).option("parts", parts).load(root)


def list_images(spark: SparkSession, root: str) -> DataFrame:
    """path, length of the image files below root; contents aren't read. Raises if there are none."""
    found = files(spark, root, "path", "length")
    if found.isEmpty():
        raise FileNotFoundError(f"no images under {root}")
    return found


def image_size(head: bytes) -> tuple[int, int]:
    """(width, height) from the first bytes of a PNG, JPEG, BMP or WebP file."""
    if head[:8] == b"\x89PNG\r\n\x1a\n":
        return struct.unpack(">II", head[16:24])
    if head[:2] == b"BM":
        w, h = struct.unpack("<ii", head[18:26]) if struct.unpack("<I", head[14:18])[0] != 12 else struct.unpack("<HH", head[18:22])
        return w, abs(h)
    if head[:4] == b"RIFF" and head[8:12] == b"WEBP":
        kind = head[12:16]
        if kind == b"VP8X":
            return 1 + int.from_bytes(head[24:27], "little"), 1 + int.from_bytes(head[27:30], "little")
        if kind == b"VP8L":
            bits = int.from_bytes(head[21:25], "little")
            return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
        if kind == b"VP8 ":
            w, h = struct.unpack("<HH", head[26:30])
            return w & 0x3FFF, h & 0x3FFF
    if head[:2] == b"\xff\xd8":
        at = 2
        while at + 9 <= len(head):
            if head[at] != 0xFF:
                break
            mark = head[at + 1]
            if mark == 0xFF:
                at += 1
            elif 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", head[at + 5 : at + 9])
                return w, h
            elif 0xD0 <= mark <= 0xD9 or mark == 1:
                at += 2
            else:
                at += 2 + struct.unpack(">H", head[at + 2 : at + 4])[0]
    raise ValueError("no image header that is known")


def read_size(read) -> tuple[int, int]:
    """(width, height) from ``read(n)``, the next bytes of a file: as many as its header needs, to the end if it must be."""
    head = read(HEAD)
    while True:
        try:
            return image_size(head)
        except (ValueError, struct.error):
            more = read(len(head)) if head else b""
            if not more:
                raise
            head += more


def size_of(store: fs.FileSystem, at: str) -> tuple[int, int]:
    with store.open_input_stream(at, compression=None) as f:
        return read_size(f.read)


def with_sizes(files: DataFrame) -> DataFrame:
    """Adds width and height to files of path, reading no more of each than its header needs; a corrupt file fails the job."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = [size_of(*located(p)) for p in b.column("path").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([w for w, _ in sizes], pa.int32()), pa.array([h for _, h in sizes], pa.int32())], [*b.schema.names, "width", "height"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)
    return files.mapInArrow(read, f"{kinds}, width int, height int")


def load_catalog(spark: SparkSession, root: str) -> DataFrame:
    """image_id (place in path order), path, length, width, height. Sizes are read once, in the tasks that list; raises if there are no images."""
    found = checkpoint(files(spark, root, "path", "length", "width", "height"))
    if found.isEmpty():
        raise FileNotFoundError(f"no images under {root}")
    return ordered(found)


def images(spark: SparkSession, root: str) -> DataFrame:
    """path (as the catalog has it), width, height, rgb of decoded images (JVM readers: JPEG, PNG, BMP; no WebP): three bytes a pixel, row by row, whatever the file's mode.

    Files that the readers can't decode fail here, as they are dropped silently otherwise. Spark's own listing is
    used, which skips names that begin with a dot or underscore.
    """
    d = spark.read.format("image").option("recursiveFileLookup", "true").option("dropInvalid", "false").load(root).select("image.*")

    @F.pandas_udf(T.BinaryType())
    def rgb(data: pd.Series, channels: pd.Series, origin: pd.Series) -> pd.Series:
        out = []
        for x, n, name in zip(data, channels, origin, strict=True):
            if n not in (1, 3, 4):
                raise ValueError(f"{name} can't be decoded")
            p = np.frombuffer(x, np.uint8).reshape(-1, n)
            out.append((p[:, 2::-1] if n > 1 else np.repeat(p, 3, 1)).tobytes())  # the readers give BGR
        return pd.Series(out)

    # origins are escaped, and "+" stands for itself in them
    path = F.url_decode(F.replace("origin", F.lit("+"), F.lit("%2B")))
    path = F.regexp_replace(path, r"^([A-Za-z][A-Za-z0-9+.-]*):/(?!/)", "$1:///")
    return d.select(path.alias("path"), "width", "height", rgb("data", "nChannels", "origin").alias("rgb"))
