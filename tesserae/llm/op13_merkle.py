"""Merkle manifest of a dataset: a node store in level-partitioned Parquet, with proofs that are merged from it.

Leaves are range-sorted by (group, id) and numbered without a single-partition window. ``grow`` reads one stored level in
runs of 2 ** ``RUN`` consecutive nodes, streams each run through as many levels in one task, and stores every node
under (level, group, place); only the runs' tops are read again, so 10 ** 11 leaves take four passes, each
1,024 times smaller than the last. A group of any share of the rows is cut into runs like the others. The groups' subroots
are the leaves of one more such tree. ``prove`` goes down the same passes: the stored nodes of a run, sorted by
coordinate, meet the siblings above the run (one row a run), and each node takes its siblings from both. So a
proof comes from what was stored and is checked by folding, not by building anew.

Nothing whole passes through a task, a group or the driver: a task holds one run (2,047 digests), the driver one
root. Texts are hashed where they are read; what is shuffled has some hundred bytes a row.

Edge cases: a null field is hashed as ``-``, an empty one as ``0:``, a null id stands before the others and is never tampered with;
equal ids are ordered by leaf, and rows equal in every field get consecutive places; a lone leaf is its group's subroot and a
lone subroot the root, with an empty list of siblings; a null group is first; texts are hashed whole; an empty table gives no rows
and no store; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import FEW, row_numbers
from .common import CRC_TABLE_SQL, checkpoint, crc_sql, fresh_path, read_table

#: Levels that one pass builds: a run has 2 ** RUN nodes.
RUN = 10
#: Nodes in an Arrow batch that a task gives back.
ROWS = 8192

NODE = "level int, key string, at long, n long, digest binary"


def _field(c: Column) -> Column:
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: list[Column]) -> Column:
    """SHA-256 (hex) of fields, each with its length, so that no two lists of fields run together."""
    return F.sha2(F.concat(*map(_field, fields)).cast("binary"), 256)


def levels_above(n: int) -> int:
    """Levels between n leaves and their root."""
    return (n - 1).bit_length()


def _levels(n: Column) -> Column:
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0)


def parent(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def number(leaves: DataFrame) -> DataFrame:
    """Adds at (place in its group, from 0) and n (leaves of the group) to rows of key, id, digest."""
    d = row_numbers(leaves.withColumn("__copy", F.monotonically_increasing_id()), "key", "id", "digest", "__copy", out="__rn").drop("__copy")
    groups = d.groupBy("key").agg(F.min("__rn").alias("__first"), F.count("*").alias("n"))
    if groups.limit(FEW + 1).count() <= FEW:
        groups = F.broadcast(groups)
    return d.join(groups, "key").withColumn("at", F.col("__rn") - F.col("__first")).drop("__rn", "__first")


def _in_runs(df: DataFrame, *order: str) -> DataFrame:
    return df.repartition("key", "run").sortWithinPartitions("key", "run", *order)


def _built(low: int):
    """Levels low + 1 to low + RUN of the runs of level ``low``."""

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        of, n, nodes = None, 0, []

        def close() -> None:
            level, row = low, nodes
            while level < min(low + RUN, levels_above(n)):
                row, level = [parent(row[j : j + 2]) for j in range(0, len(row), 2)], level + 1
                start = of[1] << (low + RUN - level)
                out.extend((level, of[0], start + j, n, bytes.fromhex(h)) for j, h in enumerate(row))

        def batch() -> pa.RecordBatch:
            kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.binary())
            b = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["level", "key", "at", "n", "digest"])
            out.clear()
            return b

        for b in batches:
            for key, run, many, digest in zip(*(b.column(c).to_pylist() for c in ("key", "run", "n", "digest")), strict=True):
                if (key, run) != of:
                    if of:
                        close()
                    if len(out) >= ROWS:
                        yield batch()
                    of, n, nodes = (key, run), many, []
                nodes.append(digest.hex())
        if of:
            close()
        if out:
            yield batch()

    return built


def grow(leaves: DataFrame, most: int) -> str:
    """Stores all levels of the trees over leaves (key, at, n, digest; ``most``: leaves of the largest) and returns the store's folder.

    Level 0 and what each pass built are folders of their own, with a folder a level, sorted by coordinate.
    """
    spark = leaves.sparkSession
    store = fresh_path(spark, "merkle")
    leaves.select(F.lit(0).alias("level"), "key", "at", "n", F.unhex("digest").alias("digest")).sortWithinPartitions("key", "at").write.partitionBy("level").parquet(f"{store}/leaves")
    for low in range(0, levels_above(most), RUN):
        d = stored(spark, store, low).where(F.col("n") > (1 << low)).select("key", F.shiftright("at", RUN).alias("run"), "at", "n", "digest")
        up = _in_runs(d, "at").mapInArrow(_built(low), NODE)
        up.sortWithinPartitions("level", "key", "at").write.partitionBy("level").parquet(f"{store}/above-{low}")
    return store


def stored(spark: SparkSession, store: str, level: int) -> DataFrame:
    """The nodes of one level: level, key, at, n, digest."""
    folder = "leaves" if level == 0 else f"above-{(level - 1) // RUN * RUN}"
    return spark.read.schema(NODE).parquet(f"{store}/{folder}").where(F.col("level") == level)


def _merged(low: int, each):
    """For each run of level ``low``, in which nodes of all its levels and one row of what is above it lie by coordinate, what ``each`` makes of a node."""

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, held, nodes, above, out = None, [], {}, None, []

        def close() -> None:
            if above is None:
                raise ValueError(f"nothing is known above run {of}")
            top = levels_above(above["n"])
            for node in held:
                siblings = []
                for level in range(low, min(low + RUN, top)):
                    place = (node["at"] >> (level - low)) ^ 1
                    if place < -(-above["n"] >> level):
                        siblings.append(nodes[level, place])
                out.append(each(node, "".join(siblings) + above["siblings"], above))

        for b in batches:
            for row in b.to_pylist():
                if (row["key"], row["run"]) != of:
                    if of:
                        close()
                    if len(out) >= ROWS:
                        yield pa.RecordBatch.from_pylist(out, _SCHEMAS[each])
                        out = []
                    of, held, nodes, above = (row["key"], row["run"]), [], {}, None
                if row["level"] < 0:
                    above = row
                else:
                    nodes[row["level"], row["at"]] = row["digest"].hex()
                    if row["level"] == low:
                        held.append(row)
        if of:
            close()
        if out:
            yield pa.RecordBatch.from_pylist(out, _SCHEMAS[each])

    return merged


def _siblings(node: dict, siblings: str, above: dict) -> dict:
    return {"key": node["key"], "at": node["at"], "n": above["n"], "subroot": above["subroot"], "place": above["place"], "places": above["places"], "siblings": siblings}


def steps(at: int, n: int) -> Iterator[str]:
    """For each level from a leaf to the root: whether the sibling is to the left, to the right or missing."""
    for level in range(levels_above(n)):
        here = at >> level
        yield "left" if here & 1 else "right" if here + 1 < -(-n >> level) else "none"


def fold(digest: str, at: int, n: int, place: int, places: int, siblings: str) -> str:
    """The root over a leaf: up its group's tree, then up the tree of groups, with the siblings of its proof."""
    used = 0
    for a, m in ((at, n), (place, places)):
        for step in steps(a, m):
            if step == "none":
                digest = parent([digest])
                continue
            other = siblings[used : used + 64]
            used += 64
            digest = parent([other, digest] if step == "left" else [digest, other])
    if used != len(siblings):
        raise ValueError("a proof of another length than its place needs")
    return digest


def _proof(node: dict, siblings: str, above: dict) -> dict:
    own = node["digest"].hex()
    folded = fold(own if node["tampered"] is None else node["tampered"].hex(), node["at"], above["n"], above["place"], above["places"], siblings)
    return {"doc_id": node["id"], "leaf": own, "subroot": above["subroot"], "proof_sha256": parent([siblings]), "folded_root": folded}


_SCHEMAS = {
    _siblings: pa.schema([("key", pa.string()), ("at", pa.int64()), ("n", pa.int64()), ("subroot", pa.string()), ("place", pa.int64()), ("places", pa.int64()), ("siblings", pa.string())]),
    _proof: pa.schema([("doc_id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("proof_sha256", pa.string()), ("folded_root", pa.string())]),
}
_ABOVE = "key string, at long, n long, subroot string, place long, places long, siblings string"


def _pass_down(low: int, nodes: DataFrame, inner: DataFrame | None, above: DataFrame, each, kind: str) -> DataFrame:
    """nodes: level ``low``; inner: the levels between it and the tops of its runs; above: a row a run, its place as ``at``."""
    d = nodes.withColumns({"level": F.lit(low), "run": F.shiftright("at", RUN)})
    up = above.select("key", F.col("at").alias("run"), F.lit(-1).alias("level"), "n", "subroot", "place", "places", "siblings")
    d = d.unionByName(up, allowMissingColumns=True)
    if inner is not None:
        d = d.unionByName(inner, allowMissingColumns=True)
    return _in_runs(d, "level", "at").mapInArrow(_merged(low, each), kind)


def _inner(spark: SparkSession, store: str, low: int, most: int) -> DataFrame | None:
    out = None
    for level in range(low + 1, min(low + RUN, levels_above(most))):
        d = stored(spark, store, level).where(F.col("n") > (1 << level)).select("key", "at", "level", F.expr(f"shiftright(at, {low + RUN - level})").alias("run"), "digest")
        out = d if out is None else out.unionByName(d)
    return out


def prove(store: str, leaves: DataFrame, most: int, tops: DataFrame, each=_siblings, kind: str = _ABOVE) -> DataFrame:
    """For each of leaves (key, at, digest and what ``each`` reads besides) the siblings from itself to the root, given tops (_ABOVE: a row for each tree, its place 0)."""
    spark = leaves.sparkSession
    passes = max(1, -(-levels_above(most) // RUN))
    # a tree joins on the way down, above the last pass that it has
    last = F.greatest(F.lit(1), F.ceil(_levels(F.col("n")) / RUN))
    tops = tops.withColumn("__last", last)
    above = None
    for p in range(passes - 1, -1, -1):
        start = tops.where(F.col("__last") == p + 1).drop("__last")
        above = start if above is None else above.unionByName(start)
        low = p * RUN
        if p == 0:
            return _pass_down(low, leaves, _inner(spark, store, low, most), above, each, kind)
        nodes = stored(spark, store, low).where(F.col("n") > (1 << low)).select("key", "at", "digest")
        above = checkpoint(_pass_down(low, nodes, _inner(spark, store, low, most), above, _siblings, _ABOVE))


def subroots(store: str, leaves: DataFrame, most: int) -> DataFrame:
    """key, n, digest (hex) of the top of each tree."""
    spark = leaves.sparkSession
    out = leaves.where("n = 1").select("key", "n", "digest")
    for low in range(0, levels_above(most), RUN):
        top = spark.read.schema(NODE).parquet(f"{store}/above-{low}").where((F.col("at") == 0) & (F.col("level") == _levels(F.col("n"))))
        out = out.unionByName(top.select("key", "n", F.lower(F.hex("digest")).alias("digest")))
    return out


def manifest(leaves: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of leaves (id, lang, digest and tampered, hex: what folds in its place, or null)."""
    spark = leaves.sparkSession
    # null before every string, by the bytes of the others
    keyed = leaves.select(F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("")).alias("key"), "id", "digest", "tampered")
    d = checkpoint(number(checkpoint(keyed)))
    most = d.agg(F.max("n")).first()[0]
    if most is None:
        return spark.createDataFrame([], "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    store = grow(d, most)
    roots = checkpoint(row_numbers(subroots(store, d, most), "key", out="place", start=0))
    trees = roots.count()
    upper = roots.select(F.lit("").alias("key"), F.col("place").alias("at"), F.lit(trees).cast("long").alias("n"), "digest")
    upper_store = grow(upper, trees)
    root = subroots(upper_store, upper, trees).first()["digest"]
    top = spark.createDataFrame([("", 0, trees, root, 0, 1, "")], _ABOVE)
    proven = prove(upper_store, upper.select("key", "at", F.unhex("digest").alias("digest")), trees, top).select("at", "siblings")
    tops = roots.join(proven, roots["place"] == proven["at"]).select("key", F.lit(0).cast("long").alias("at"), "n", F.col("digest").alias("subroot"), "place", F.lit(trees).cast("long").alias("places"), "siblings")
    tops = checkpoint(tops)
    rows = d.select("key", "at", F.unhex("digest").alias("digest"), "id", F.unhex("tampered").alias("tampered"))
    out = prove(store, rows, most, tops, _proof, "doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string")
    return out.select("doc_id", "leaf", "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == F.lit(root)).alias("verified"))


def leaves_of(docs: DataFrame) -> DataFrame:
    """Leaves of documents; the tampered ones (ids whose decimal CRC-32 seven divides) have one more character counted."""
    fields = lambda n: [F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text")]
    n = F.col("n_chars").cast("long")
    changed = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & n.isNotNull()
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.col("lang").cast("string").alias("lang"), leaf_digest(fields(n)).alias("digest"), F.when(changed, leaf_digest(fields(n + 1))).alias("tampered"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(leaves_of(read_table(spark, sf_dir, "documents")))


_FIELD = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
_LEAF = lambda n: f"sha256({' || '.join(map(_FIELD, ('doc_id', 'source', 'lang', n, 'text')))})"

# crc is the byte table of CRC-32; up and over are the nodes of the groups' trees and of the tree of groups.
ORACLE = f"""
WITH RECURSIVE crc AS ({CRC_TABLE_SQL}),
d AS (
  SELECT doc_id, coalesce('=' || lang, '') AS key, {_LEAF('n_chars')} AS leaf, {_LEAF('(n_chars + 1)')} AS other, n_chars,
    {crc_sql('doc_id::VARCHAR')} AS crc
  FROM documents, crc),
l AS (
  SELECT *, row_number() OVER () AS r, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY key) AS n,
    CASE WHEN crc % 7 = 0 AND n_chars IS NOT NULL THEN other ELSE leaf END AS start FROM d),
up AS (
  SELECT key, 0 AS level, i, leaf AS h FROM l
  UNION ALL
  SELECT key, level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER (PARTITION BY key) AS n FROM up) WHERE n > 1 GROUP BY key, level, i // 2),
sub AS (SELECT key, arg_max(h, level) AS h, max(level) AS top, row_number() OVER (ORDER BY key) - 1 AS i FROM up GROUP BY key),
over_ AS (
  SELECT 0 AS level, i, h FROM sub
  UNION ALL
  SELECT level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER () AS n FROM over_) WHERE n > 1 GROUP BY level, i // 2),
root AS (SELECT arg_max(h, level) AS root, max(level) AS top FROM over_),
s AS (
  SELECT l.r, x.level AS level, l.i >> x.level AS here, o.h AS h
  FROM l JOIN sub USING (key), LATERAL (SELECT unnest(range(sub.top)) AS level) x LEFT JOIN up o ON o.key = l.key AND o.level = x.level AND o.i = xor(l.i >> x.level, 1)
  UNION ALL
  SELECT l.r, 1000 + x.level, sub.i >> x.level, o.h
  FROM l JOIN sub USING (key), root, LATERAL (SELECT unnest(range(root.top)) AS level) x LEFT JOIN over_ o ON o.level = x.level AND o.i = xor(sub.i >> x.level, 1)),
p AS (SELECT r, coalesce(string_agg(h, '' ORDER BY level), '') AS siblings, list(CASE WHEN h IS NULL THEN '-' WHEN here % 2 = 1 THEN 'L' || h ELSE 'R' || h END ORDER BY level) AS steps FROM s GROUP BY r),
f AS (
  SELECT l.*, sub.h AS subroot, root, sha256(coalesce(siblings, '')) AS proof_sha256,
    list_reduce(list_concat([start], coalesce(steps, [])), lambda a, x: sha256(CASE x[1] WHEN 'L' THEN x[2:] || a WHEN 'R' THEN a || x[2:] ELSE a END)) AS folded_root
  FROM l JOIN sub USING (key) CROSS JOIN root LEFT JOIN p USING (r))
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM f
"""
