"""Near-duplicate classes: MinHash coordinates in an inverted join, confirmed on full sets.

1. Each text becomes its set of distinct 5-word shingles (64-bit hashes) and a signature of
   ``COORDINATES`` minima. Texts with the same set form a class, so exact copies never meet in pairs.
2. A pair above the similarity ``percent`` has at least t equal coordinates but for a chance below
   ``MISS`` (``matches``: 16 of 32 at 0.85). So it shares one of the first 33 - t coordinates: classes are
   posted under these (coordinate, value) pairs only (the prefix), and no pair from t matches up is lost.
3. In each list, equal coordinates are counted over whole signatures, and pairs from t up are kept;
   what goes on are not the pairs but edges that tie the same members together, a row for
   each member at most. Lists of more than ``BLOCK`` members are cut into blocks, which first meet
   themselves and ``PIVOTS`` members of the list. What is now tied together is skipped: only members
   outside a list's largest component go on, in blocks, to meet all members. Where that would take
   more than ``LINEAR`` rows a member, the list is first refined: its members are posted again
   under each later (coordinate, value) pair, which a pair of t matches shares as well. Texts play no part here.
4. The components of these edges are clusters, and a link can't leave its cluster. Each member's text
   joins its cluster once, and full sets are compared by matrix products: a link needs
   100 * intersection >= percent * union. Clusters of more than ``BLOCK`` members are cut and
   skipped like lists. Components come from alternating large-star and small-star rounds, which keep
   hubs small.

Edge cases: null, empty and blank texts have no shingles and are linked with nothing; a text
of fewer than 5 words is one shingle; texts of any length enter whole; rows that repeat a doc_id
count as one document, which has the links of all its texts (n_shingles is the row's own); a null doc_id
is never linked (component_id null, kept true); of equal texts, the smallest doc_id is kept; an empty
table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, read_table, text_bytes

WORDS, COORDINATES, PERCENT, MISS = 5, 32, 85, 1e-6
#: Members and shingles of a block.
BLOCK, BLOCK_SHINGLES = 1024, 1_000_000
#: Members of a list or cluster that all its blocks meet first; rows a member that blocks may take before a list is refined.
PIVOTS, LINEAR = 32, 16

_BASE = 0x9E3779B97F4A7C15 | 1
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)
_A = np.random.default_rng(20240229).integers(1, 2**63, COORDINATES, np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def matches(percent: int = PERCENT, miss: float = MISS) -> int:
    """The most equal coordinates that a pair of this similarity has but for a chance of ``miss``; 1 at least."""
    j, t, below = percent / 100, 0, 0.0
    while t < COORDINATES and below + (p := comb(COORDINATES, t) * j**t * (1 - j) ** (COORDINATES - t)) <= miss:
        below, t = below + p, t + 1
    return max(t, 1)


def _series(base: int, size: int) -> np.ndarray:
    out = np.full(size, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _grow(n: int) -> None:
    global _powers, _inverse
    if len(_powers) < n:
        size = 1 << (n - 1).bit_length()
        _powers = _series(_BASE, size)
        _inverse = _series(pow(_BASE, -1, 1 << 64), size)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def run_hashes(codes: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of codes that lie inside, without a loop over runs."""
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    start, end = edge[::2], edge[1::2]
    _grow(len(codes) + 1)
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * _powers[: len(codes)], out=total[1:])
    return _mix((total[end] - total[start]) * _inverse[start] + (end - start).astype(np.uint64))


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word of lower-cased bytes."""
    b = np.frombuffer(text, np.uint8)
    return run_hashes(b, ~_SPACE[b])


def shingles(text: bytes, n: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the text's n-word shingles, or of all its words if they are fewer."""
    w = word_hashes(text.lower())
    if not len(w):
        return w
    n = min(n, len(w))
    h = np.full(len(w) - n + 1, n, np.uint64)
    for k in range(n):
        h = _mix(h * np.uint64(0x2545F4914F6CDD1D) + w[k : len(w) - n + 1 + k])
    return np.unique(h)


def signature(s: np.ndarray) -> np.ndarray:
    out = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 2048):
        h = s[i : i + 2048, None] * _A
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        out = np.minimum(out, h.min(0))
    return out


_SIG = [f"s{i}" for i in range(COORDINATES)]


def key_of(s: np.ndarray) -> bytes | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, n, keys, sig = b.column(0), [], [], []
        for x in b.column(1):
            s = shingles(x.as_py())
            n.append(len(s))
            keys.append(key_of(s))
            sig.append(signature(s).view(np.int64))
        m = np.array(sig, np.int64).reshape(-1, COORDINATES)
        yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(keys, pa.binary()), *(pa.array(m[:, i]) for i in range(COORDINATES))], ["doc_id", "n_shingles", "key", *_SIG])


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, key (of the set; null if empty) and the coordinates s0, s1, ..."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    return d.mapInArrow(_signed, "doc_id long, n_shingles long, key binary, " + ", ".join(f"{c} long" for c in _SIG))


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the key of the shingle set to rows doc_id, text."""
    for b in batches:
        keys = [key_of(shingles(x.as_py())) for x in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary()), b.column(1)], ["doc_id", "key", "text"])


def roots(linked: np.ndarray) -> np.ndarray:
    """The least index that hangs together with each, of a symmetric matrix of links."""
    root = np.full(len(linked), -1, np.int64)
    for i in range(len(linked)):
        if root[i] < 0:
            front = np.zeros(len(linked), bool)
            front[i] = True
            while front.any():
                root[front] = i
                front = linked[front].any(0) & (root < 0)
    return root


def equal_coordinates(sig: np.ndarray) -> np.ndarray:
    """How many coordinates each two rows share."""
    out = np.zeros((len(sig), len(sig)), np.uint8)
    for c in range(sig.shape[1]):
        out += sig[:, c, None] == sig[None, :, c]
    return out


def components_within(sets: list[np.ndarray], percent: int = PERCENT) -> np.ndarray:
    """The least index that hangs together with each set by links between the sets."""
    size = np.array([len(x) for x in sets], np.int64)
    value, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), size)
    shared = count > 1
    place = np.cumsum(shared) - 1
    keep = shared[code]
    row, col = row[keep], place[code[keep]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    inter = np.zeros((len(sets), len(sets)), np.float32)
    step = 2048
    for lo in range(0, int(shared.sum()), step):
        i, j = np.searchsorted(col, [lo, lo + step])
        m = np.zeros((len(sets), step), np.float32)
        m[row[i:j], col[i:j] - lo] = 1
        inter += m @ m.T
    return roots(100 * inter.astype(np.int64) >= percent * (size[:, None] + size[None, :] - inter.astype(np.int64)))


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole groups, of rows sorted by their first three columns (list, i, j)."""
    held = []
    for b in batches:
        if not b.num_rows:
            continue
        if held:
            first = held[0].slice(0, 1)
            same = np.ones(b.num_rows, bool)
            for k in range(3):
                same &= b.column(k).to_numpy() == first.column(k).to_numpy()[0]
            n = int(same.sum())
            if n:
                held.append(b.slice(0, n))
            if n == b.num_rows:
                continue
            yield pa.Table.from_batches(held)
            held, b = [], b.slice(n)
        keys = [b.column(k).to_numpy() for k in range(3)]
        cut = np.flatnonzero(np.any([np.diff(k) != 0 for k in keys], axis=0)) + 1 if b.num_rows > 1 else np.zeros(0, int)
        edges = [0, *cut.tolist(), b.num_rows]
        for lo, hi in zip(edges[:-2], edges[1:-1], strict=True):
            yield pa.Table.from_batches([b.slice(lo, hi - lo)])
        held = [b.slice(edges[-2])]
    if held:
        yield pa.Table.from_batches(held)


def _tied(ids: np.ndarray, root: np.ndarray) -> tuple[list[int], list[int]]:
    """Edges from each member to its root."""
    at = np.flatnonzero(root != np.arange(len(root)))
    return ids[at].tolist(), ids[root[at]].tolist()


def _emitted(pairs: Iterator[tuple[list[int], list[int]]]) -> Iterator[pa.RecordBatch]:
    u, v = [], []
    for a, b in pairs:
        u += a
        v += b
        if len(u) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])
            u, v = [], []
    if u:
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def _counter(percent: int):
    """Groups of rows list, i, j, name, n, sig: edges that tie together members with enough equal coordinates and sizes that allow a link."""
    least = matches(percent)

    def linked(sig_a, sig_b, n_a, n_b):
        return ((sig_a == sig_b).sum(1) >= least) & (100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b))

    def whole(key, name, n, sig):
        """Edges of rows that hold whole groups; pairs all at once, since most lists are pairs."""
        cuts = np.flatnonzero((np.diff(key, axis=0) != 0).any(1)) + 1
        start, end = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(key)]])
        two = start[end - start == 2]
        two = two[linked(sig[two], sig[two + 1], n[two], n[two + 1])]
        yield name[two + 1].tolist(), name[two].tolist()
        for lo, hi in zip(start[end - start > 2].tolist(), end[end - start > 2].tolist(), strict=True):
            m = n[lo:hi]
            near = equal_coordinates(sig[lo:hi]) >= least
            near &= 100 * np.minimum.outer(m, m) >= percent * np.maximum.outer(m, m)
            yield _tied(name[lo:hi], roots(near))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            held = None
            for b in batches:
                if not b.num_rows:
                    continue
                key = np.column_stack([b.column(k).to_numpy() for k in range(3)])
                rows = [key, b.column("name").to_numpy(), b.column("n").to_numpy(), b.column("sig").flatten().to_numpy().reshape(-1, COORDINATES)]
                if held:
                    rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
                key = rows[0]
                last = np.flatnonzero((key != key[-1]).any(1))
                at = int(last[-1]) + 1 if len(last) else 0
                if at:
                    yield from whole(*(x[:at] for x in rows))
                held = [x[at:] for x in rows]
            if held:
                yield from whole(*held)

        yield from _emitted(each())

    return counted


def _confirmer(percent: int):
    """Groups of rows list, i, j, name, text: edges that tie together members whose full sets are linked."""

    def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            for t in _grouped(batches):
                if t.num_rows > 1:
                    sets = [shingles(x.as_py()) for x in t.column("text")]
                    yield _tied(t.column("name").to_numpy(), components_within(sets, percent))

        yield from _emitted(each())

    return confirmed


def star_components(edges: DataFrame) -> DataFrame:
    """node, component (the least node reachable) for the nodes of the edges u, v."""
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e, before = checkpoint(e), None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = checkpoint(large.distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        e = checkpoint(small.where("u <> v").distinct())


def cut(members: DataFrame, by_shingles: bool) -> DataFrame:
    """Of list, cid, n and others: adds m (members), blocks and at (a member's own block) to lists of several members."""
    size = members.groupBy("list").agg(F.count("*").alias("m"), F.sum("n").alias("w")).where("m > 1")
    d = members.join(size, "list").withColumn("blocks", _blocks("m", "w", by_shingles))
    return d.withColumn("at", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")).drop("w")


def _blocks(m: str, w: str, by_shingles: bool):
    k = F.ceil(F.col(m) / BLOCK)
    return (F.greatest(k, F.ceil(F.col(w) / BLOCK_SHINGLES)) if by_shingles else k).cast("int")


def first_meetings(lists: DataFrame) -> DataFrame:
    """list, i, j, cid: each block of a list with itself and with the list's pivots, which tie its blocks together."""
    members = lists.select("list", F.col("at").alias("i"), F.col("at").alias("j"), "cid")
    long = lists.where("blocks > 1")
    pivots = long.groupBy("list", "blocks").agg(F.array(*(F.min_by("cid", F.xxhash64(F.lit(k), "cid")) for k in range(PIVOTS))).alias("ids"))
    pivots = pivots.select("list", "ids", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"))
    pivots = pivots.select("list", "i", F.explode(F.array_distinct("ids")).alias("cid"))
    return members.unionByName(pivots.select("list", "i", F.col("i").alias("j"), "cid"))


def outside(lists: DataFrame, known: DataFrame, by_shingles: bool) -> DataFrame:
    """list, cid, n, component, main, a, b, rows of the members of long lists that hang together only in part.

    main is the list's largest known component; a and b are the numbers of blocks of its members outside and inside
    that, and rows is how many rows all meetings of the two take.
    """
    mine = lists.where("blocks > 1").join(known.withColumnRenamed("node", "cid"), "cid", "left").select("list", "cid", "n", F.coalesce("component", "cid").alias("component"))
    parts = mine.groupBy("list", "component").agg(F.count("*").alias("k"), F.sum("n").alias("kn"))
    whole = parts.groupBy("list").agg(F.max(F.struct("k", "component", "kn")).alias("main"), F.sum("k").alias("m"), F.sum("kn").alias("w")).where("m > main.k")
    whole = whole.select("list", F.col("main.component").alias("main"), "m", (F.col("m") - F.col("main.k")).alias("ka"), (F.col("w") - F.col("main.kn")).alias("wa"), F.col("main.k").alias("kb"), F.col("main.kn").alias("wb"))
    whole = whole.select("list", "main", "m", "ka", "kb", _blocks("ka", "wa", by_shingles).alias("a"), _blocks("kb", "wb", by_shingles).alias("b"))
    whole = whole.withColumn("rows", F.col("ka") * (F.col("a") + F.col("b")) + F.col("kb") * F.col("a")).drop("ka", "kb")
    return mine.join(whole, "list")


def second_meetings(d: DataFrame) -> DataFrame:
    """list, i, j, cid of ``outside`` rows: those outside their list's main component, by blocks, with all members.

    Members that are known to hang together need no comparison; every other two of a list meet in some group.
    """
    out, h = F.col("component") != F.col("main"), F.xxhash64(F.lit("second"), "cid")
    d = d.withColumn("out", out).withColumn("at", F.when(F.col("out"), F.pmod(h, F.col("a"))).otherwise(F.col("a") + F.pmod(h, F.col("b"))).cast("int"))
    d = d.withColumn("with", F.explode(F.sequence(F.lit(0), F.when(F.col("out"), F.col("a") + F.col("b")).otherwise(F.col("a")) - 1)))
    return d.select("list", F.least("at", "with").alias("i"), F.greatest("at", "with").alias("j"), "cid")


def _met(meetings: DataFrame, carried: DataFrame, kernel, names: DataFrame | None = None) -> DataFrame:
    """Edges u, v that a kernel finds between members that meet; carried: cid and what the kernel needs of it; names: components that stand for members."""
    d = meetings.join(carried, "cid").withColumn("name", F.col("cid"))
    if names is not None:
        d = d.join(names.withColumnRenamed("node", "cid"), "cid", "left").withColumn("name", F.coalesce("component", "cid")).drop("component")
    key = ["list", "i", "j"]
    d = d.select(*key, "name", *(c for c in carried.columns if c != "cid"))
    return d.repartition(*key).sortWithinPartitions(*key, "name").mapInArrow(kernel, "u long, v long")


def _joined(known: DataFrame, more: DataFrame) -> DataFrame:
    """Components of known ones and of further edges between them."""
    more = checkpoint(more.where("u <> v").distinct())
    if more.isEmpty():
        return known
    joined = star_components(more).select(F.col("node").alias("of"), F.col("component").alias("least"))
    alone = joined.join(known, F.col("of") == F.col("node"), "left_anti").select(F.col("of").alias("node"), F.col("least").alias("component"))
    return checkpoint(known.join(joined, F.col("component") == F.col("of"), "left").select("node", F.coalesce("least", "component").alias("component")).unionByName(alone))


def clusters(classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """node, component: classes (cid, n, and the coordinates) that pairs of enough equal coordinates tie together."""
    least = matches(percent)
    sig = classes.select("cid", "n", F.array(*_SIG).alias("sig"))
    carried = sig.select("cid", "n", F.transform("sig", lambda x: F.shiftright(F.shiftleft(x, 32), 32).cast("int")).alias("sig"))
    kernel, known = _counter(percent), None
    posts = classes.select("cid", "n", F.posexplode(F.array(*_SIG[: COORDINATES - least + 1])).alias("c", "v")).select(F.xxhash64("c", "v").alias("list"), "c", "cid", "n")
    for depth in range(1, least + 1):
        if known is not None:  # refined lists that hang together already are skipped
            named = posts.join(known.withColumnRenamed("node", "cid"), "cid", "left").groupBy("list").agg(F.min(F.coalesce("component", "cid")).alias("p"), F.max(F.coalesce("component", "cid")).alias("q"))
            posts = checkpoint(posts.join(named.where("p <> q").select("list"), "list"))
        held = checkpoint(cut(posts, False))
        edges = _met(first_meetings(held), carried, kernel, known)
        known = star_components(edges) if known is None else _joined(known, edges)
        if held.where("blocks > 1").isEmpty():
            break
        rest = checkpoint(outside(held, known, False))
        direct = F.lit(True) if depth == least else F.col("rows") <= LINEAR * F.col("m")
        known = _joined(known, _met(second_meetings(rest.where(direct)), carried, kernel, known))
        again = rest.where(~direct).select("list", "cid").join(held.where("blocks > 1").select("list", "cid", "c"), ["list", "cid"])
        if again.isEmpty():
            break
        # the next shared coordinate of a pair of least matches
        later = F.slice(F.transform("sig", lambda x, k: F.struct(k.alias("c"), x.alias("v"))), F.col("c") + 2, F.lit(COORDINATES - least + depth) - F.col("c"))
        posts = again.join(sig, "cid").select("list", "cid", "n", F.explode(later).alias("x")).select(F.xxhash64("list", "x.c", "x.v").alias("list"), F.col("x.c").alias("c"), "cid", "n")
    return known


def components(docs: DataFrame, classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """node, component: what the links between classes (rep, key, cid, n, coordinates) keep together; without classes that have none."""
    found = clusters(classes, percent)
    lists = cut(found.select(F.col("component").alias("list"), F.col("node").alias("cid")).join(classes.select("cid", "n"), "cid"), True)
    lists = checkpoint(lists)
    wanted = classes.join(lists.select("cid"), "cid", "left_semi").select("cid", "key", F.col("rep").alias("doc_id"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    texts = rows.mapInArrow(_keyed, "doc_id long, key binary, text binary").join(wanted, ["doc_id", "key"]).groupBy("cid").agg(F.first("text").alias("text"))
    texts = checkpoint(texts)
    kernel = _confirmer(percent)
    known = star_components(_met(first_meetings(lists), texts, kernel))
    if lists.where("blocks > 1").isEmpty():
        return known
    return _joined(known, _met(second_meetings(outside(lists, known, True)), texts, kernel, known))


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs."""
    signed = checkpoint(signatures(docs))
    known = signed.where("key IS NOT NULL AND doc_id IS NOT NULL")
    classes = known.groupBy("key").agg(F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n"), *(F.min(c).alias(c) for c in _SIG))
    classes = checkpoint(classes.withColumn("cid", F.monotonically_increasing_id()))
    found = components(docs, classes, percent)
    several = known.groupBy("doc_id").agg(F.min("key").alias("key"), F.max("key").alias("other")).where("key <> other").select("doc_id")
    several = known.join(several, "doc_id", "left_semi").select("doc_id", "key").join(classes.select("key", "cid"), "key")
    several = several.join(found.withColumnRenamed("node", "cid"), "cid", "left").select("doc_id", F.coalesce("component", "cid").alias("u"))
    found = _joined(found, several.join(several.groupBy("doc_id").agg(F.min("u").alias("v")), "doc_id").select("u", "v"))
    named = classes.select("key", "rep", "cid").join(found.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    least = named.groupBy("component").agg(F.min("rep").alias("least"))
    named = named.join(least, "component").select("key", "least")
    out = signed.select("doc_id", "n_shingles", "key").join(named, "key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
g AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
c AS (SELECT doc_id AS node, doc_id AS seen FROM n UNION SELECT g.a, c.seen FROM c JOIN g ON g.b = c.node),
m AS (SELECT node, min(seen) AS component FROM c GROUP BY node)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component, w.doc_id) AS component_id, w.doc_id = coalesce(component, w.doc_id) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.node = w.doc_id
"""
