"""WARC archives: a deterministic sharded writer, and a reader.

1. Digests and sizes come first, without payloads. Of equal payloads of at least ``MIN_BYTES``
   the least page_id stays a response; the others become revisit records. The digests that occur
   again are broadcast up to ``FEW`` of them, and joined by a shuffle beyond that.
2. A pass over the pages makes each record (a gzip member with regenerated headers: no clock,
   host or random id enters) and keeps its compressed size only. These rows are range-sorted by
   page_id, digest and MD5 of the URL; sums of the ranges (one number each) give offsets, so that
   every record knows the compressed bytes before it. Its file is that number divided by
   ``roll_bytes`` (raised where there would be more than ``MAX_FILES`` files): files are the same
   however Spark splits the range. A second pass makes the records again and deals them to their
   files by the places at which files begin (56 bytes each): response payloads are shuffled once,
   compressed, and payloads of revisits not at all.
3. Each file is written by one task under a temporary name that carries the attempt, and
   listed with its size and SHA-256 in a manifest. After the manifest is stored, tasks
   rename the listed files to their final names (a rename that was done already is
   recognised), and ``MANIFEST.parquet`` is written last: a folder without it isn't complete.

Files are reached by ``pyarrow.fs`` at the URI of the shared folder. Ids stay 64-bit integers
all the way.

Edge cases: null html is an empty payload, null url an empty URI; equal page_ids are ordered
by digest and URL; a null page_id sorts first, is written, and is never the target of a
revisit, nor a revisit itself; rows that repeat the least page_id of a payload are responses
too; a payload of any length is one record in one piece; an empty table gives an empty manifest;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, fresh_path, partitions, read_table

MIN_BYTES, ROLL_BYTES, MAX_FILES, LEVEL, DATE = 100, 64 << 20, 1_000_000, 4, "2024-01-01T00:00:00Z"
#: Repeated digests that are broadcast; tasks that write files.
FEW, WRITERS = 200_000, 20_000
_SPACE_ID = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI or of a plain local path."""
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def _member(data: bytes, level: int = LEVEL) -> bytes:
    """A gzip member with no time or name in its header."""
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE_ID, f'{page_id}:{digest}')}>"


def record(kind: str, page_id: int | None, url: str | None, digest: str, size: int, payload: bytes, first: int | None = None) -> bytes:
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {DATE}", "WARC-Target-URI: " + re.sub(r"[\r\n]+", " ", url or ""),
        f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Block-Digest: sha256:{hashlib.sha256(payload).hexdigest()}", f"X-Payload-Length: {size}", f"X-Page-ID: {'' if page_id is None else page_id}",
    ]
    if first is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(first, digest)}", f"X-Refers-To-Page-ID: {first}"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}", "", ""]
    return "\r\n".join(lines).encode() + payload + b"\r\n\r\n"


def _packer(keep: bool):
    """Records of rows page_id, url, size, digest, first, html (null for revisits); with their members, or with the members' sizes only."""
    kind, name = (pa.binary(), "member") if keep else (pa.int64(), "bytes")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                members, urls = [], []
                for i, u, n, d, first, html in zip(*(part.column(c).to_pylist() for c in range(5)), part.column(5), strict=True):
                    data = html.as_py()
                    m = _member(record("response", i, u, d, n, data) if data is not None else record("revisit", i, u, d, n, b"", first))
                    members.append(m if keep else len(m))
                    urls.append(hashlib.md5((u or "").encode("utf-8", "surrogatepass")).digest())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(3), pa.array(urls, pa.binary()), pa.array(members, kind)], ["page_id", "digest", "url", name])

    return packed


def marked(pages: DataFrame) -> DataFrame:
    """page_id, url, size, digest, first (the response's page_id, of revisits), html (null for revisits)."""
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    p = p.select("page_id", "url", F.octet_length("html").cast("long").alias("size"), F.sha2("html", 256).alias("digest"), "html")
    again = p.where((F.col("size") >= MIN_BYTES) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    again = checkpoint(again.where("n > 1").drop("n"))
    if again.limit(FEW + 1).count() <= FEW:
        again = F.broadcast(again)
    d = p.join(again, "digest", "left").withColumn("first", F.when(F.col("page_id") > F.col("first"), F.col("first")))
    return d.select("page_id", "url", "size", "digest", "first", F.when(F.col("first").isNull(), F.col("html")).alias("html"))


_PLACE = ["page_id", "digest", "url"]


def listing(rows: DataFrame) -> DataFrame:
    """page_id, digest, url (its MD5), bytes (of the compressed record) of ``marked`` rows, range-sorted."""
    small = checkpoint(rows.mapInArrow(_packer(False), "page_id long, digest string, url binary, bytes long"))
    return checkpoint(small.repartitionByRange(partitions(rows.sparkSession), *_PLACE).sortWithinPartitions(*_PLACE))


def with_files(listed: DataFrame, roll_bytes: int) -> DataFrame:
    """Adds file_no to a listing: the compressed bytes of all records before, divided by roll_bytes."""

    def sums(batches):
        total = 0
        for b in batches:
            total += sum(b.column(0).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([total], pa.int64())], ["p", "total"])

    start, at = {}, 0
    for r in sorted(listed.select("bytes").mapInArrow(sums, "p long, total long").collect()):
        start[r.p], at = at, at + r.total
    roll_bytes = max(roll_bytes, -(-at // MAX_FILES))

    def numbered(batches):
        before = start.get(TaskContext.get().partitionId(), 0)
        for b in batches:
            no = []
            for n in b.column("bytes").to_pylist():
                no.append(before // roll_bytes)
                before += n
            yield pa.RecordBatch.from_arrays([pa.array(no, pa.int64()), *b.columns], ["file_no", *b.schema.names])

    return listed.mapInArrow(numbered, "file_no long, page_id long, digest string, url binary, bytes long")


def _place(page_id: int | None, digest: str, url: bytes) -> tuple:
    return (page_id is not None, page_id or 0, digest, url)


def write_archive(pages: DataFrame, out: str, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes and commits the archive in folder ``out`` (a URI that executors reach); returns its manifest."""
    spark = pages.sparkSession
    all_rows = marked(pages)
    filed = with_files(listing(all_rows), roll_bytes)
    begin = filed.groupBy("file_no").agg(F.min(F.struct(*_PLACE)).alias("k")).collect()
    begin = sorted((_place(r.k.page_id, r.k.digest, bytes(r.k.url)), r.file_no) for r in begin)
    starts = spark.sparkContext.broadcast(([k for k, _ in begin], [n for _, n in begin]))

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, numbers = starts.value
        for b in _packer(True)(batches):
            at = [numbers[max(0, bisect_right(keys, _place(*k)) - 1)] for k in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), *b.columns], ["file_no", *b.schema.names])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by file, page, digest and URL."""
        store, root = _opened(out)
        store.create_dir(f"{root}/_temporary", recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        no, sink, rows, digest, name = None, None, 0, None, ""

        def closed():
            sink.close()
            return pa.RecordBatch.from_arrays([pa.array([no], pa.int64()), pa.array([name]), pa.array([rows], pa.int64()), pa.array([store.get_file_info(f"{root}/{name}").size], pa.int64()), pa.array([digest.hexdigest()])], ["file_no", "temporary", "records", "bytes", "sha256"])

        for b in batches:
            for k, m in zip(b.column("file_no").to_pylist(), b.column("member"), strict=True):
                if k != no:
                    if sink:
                        yield closed()
                    no, rows, digest, name = k, 0, hashlib.sha256(), f"_temporary/part-{k:08d}-{attempt}-{uuid.uuid4().hex}"
                    sink = store.open_output_stream(f"{root}/{name}")
                data = m.as_py()
                sink.write(data)
                digest.update(data)
                rows += 1
        if sink:
            yield closed()

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _opened(out)
        for b in batches:
            for t, name, size in zip(*(b.column(c).to_pylist() for c in ("temporary", "name", "bytes")), strict=True):
                if store.get_file_info(f"{root}/{t}").type == fs.FileType.File:
                    store.move(f"{root}/{t}", f"{root}/{name}")
                if store.get_file_info(f"{root}/{name}").size != size:
                    raise OSError(f"{name} was not committed")
            yield b.drop_columns(["temporary"])

    rows = all_rows.mapInArrow(numbered, "file_no long, page_id long, digest string, url binary, member binary")
    tasks = min(WRITERS, max(partitions(spark), len(begin)))
    listed = rows.repartition(tasks, "file_no").sortWithinPartitions("file_no", *_PLACE).mapInArrow(write, "file_no long, temporary string, records long, bytes long, sha256 string")
    listed = listed.withColumn("name", F.format_string("part-%08d.warc.gz", "file_no"))
    listed.write.parquet(f"{out}/_manifest")
    listed = spark.read.parquet(f"{out}/_manifest")
    done = listed.mapInArrow(rename, "file_no long, records long, bytes long, sha256 string, name string")
    done.write.parquet(f"{out}/MANIFEST.parquet")
    return spark.read.parquet(f"{out}/MANIFEST.parquet")


def records_of(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each gzip member of a stream of bytes."""
    z, data = zlib.decompressobj(31), []
    for c in chunks:
        while c:
            data.append(z.decompress(c))
            c = z.unused_data
            if not z.eof:
                break
            head, _, rest = b"".join(data).partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            h = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
            yield h, rest[: int(h["content-length"])]
            z, data = zlib.decompressobj(31), []
    if data:
        raise ValueError("the last record is cut off")


def read_archive(spark: SparkSession, out: str, payload: bool = False) -> DataFrame:
    """A row for each record of the files that the manifest lists, digests checked against their headers."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _opened(out)
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        whole = lambda x: int(x) if x else None
        for b in batches:
            for name in b.column(0).to_pylist():
                rows = []
                with store.open_input_stream(f"{root}/{name}", compression=None) as f:
                    for h, block in records_of(iter(lambda: f.read(1 << 20), b"")):  # noqa: B023
                        digest, kind = hashlib.sha256(block).hexdigest(), h["warc-type"]
                        if f"sha256:{digest}" != h["warc-block-digest"]:
                            raise ValueError(f"{name}: a block digest is wrong")
                        full = kind == "response"
                        rows.append((whole(h["x-page-id"]), h["warc-target-uri"], len(block) if full else int(h["x-payload-length"]), digest if full else h["warc-payload-digest"].partition(":")[2], kind, whole(h.get("x-refers-to-page-id")), block if payload else None))
                        if len(rows) == 500:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    listed = spark.read.parquet(f"{out}/MANIFEST.parquet").select("name").repartition(partitions(spark))
    return listed.mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def op5_warc(spark: SparkSession, sf_dir: str, roll_bytes: int = 4 << 20) -> DataFrame:
    out = fresh_path(spark, "warc")
    write_archive(read_table(spark, sf_dir, "pages"), out, roll_bytes)
    return read_archive(spark, out).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html))::BIGINT AS n, sha256(html) AS h FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM d)
SELECT page_id, n AS payload_bytes, h AS payload_digest, CASE WHEN n >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id > first THEN first END AS refers_to FROM f
"""
