"""Language-model scores: masked pseudo-likelihood by a bidirectional window network.

Every token (word) is predicted from two words on each side, never from itself, by a small
network trained in numpy: embeddings of the neighbours' classes, a hidden tanh layer, and a
softmax over word classes in two steps (group, then class in the group, so the cost grows with the
square root of their number). A word's probability is its class's times its share of the class in the
corpus. Half of the classes are single frequent words, so these are predicted as such; the other
words go by their ending. The number of classes grows as the cube root of the distinct
words (``side``). A document's score is the sum of the log probabilities of all its words.

Each word of the corpus enters with its own count. The ``CACHED`` most frequent are held in each task; all
others are joined, by word, to the checkpointed table of counts and summed by document.

What is gathered covers all documents: words are counted over the whole corpus (counts are
combined in each task before they are shuffled), and every word of every document is a training
target exactly once: round r of ``ROUNDS`` takes the places of residue class r. Texts are turned into
classes once and dealt, by a hash of their classes, to shards of about ``SHARD_WORDS`` words
(``SHARDS`` of them at most), in a checkpointed table that training and scoring read. In each round, every shard
is trained on by itself, in the order of those hashes, from the current weights; the weights are averaged,
weighted by windows, in a tree of fan-in ``FAN``, so the driver sees at most FAN sets of weights (45
numbers a class) whatever the number of shards, and starts the next round from their mean. So the
scores depend on the corpus and not on how Spark splits the input, up to rounding in sums.

Edge cases: null, empty and blank texts have 0 words, log_prob 0.0 and a null mean; a text of any
length is scored whole; repeated rows and null ids score like any row; equally frequent words are taken in
byte order; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, read_table, text_bytes

CACHED, SHARD_WORDS, SHARDS = 200_000, 1_000_000, 200_000
SIDE, DIM, HIDDEN, ROUNDS, FAN, BATCH = 2, 12, 32, 4, 32, 2048
LEAST, MOST = 16, 250


def side(distinct: int) -> int:
    """Groups, and classes in each group, for so many distinct words: twice the sixth root, an even number."""
    return min(MOST, max(LEAST, 2 * round(distinct ** (1 / 6))))


def _shapes(g: int) -> tuple[tuple[str, tuple[int, ...]], ...]:
    return (("e", (g * g + 1, DIM)), ("w", (2 * SIDE * DIM, HIDDEN)), ("b", (HIDDEN,)), ("u", (g, HIDDEN)), ("a", (g,)), ("v", (g, g, HIDDEN)), ("c", (g, g)))


def start_weights(seed: int = 7, g: int = LEAST) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return np.concatenate([np.zeros(s, np.float32).ravel() if name in "abc" else rng.normal(0, 0.1, s).astype(np.float32).ravel() for name, s in _shapes(g)])


def side_of(flat: np.ndarray) -> int:
    """The side of a network with so many weights."""
    fixed, square = DIM + 2 * SIDE * DIM * HIDDEN + HIDDEN, DIM + HIDDEN + 1
    return round((-(HIDDEN + 1) + ((HIDDEN + 1) ** 2 + 4 * square * (len(flat) - fixed)) ** 0.5) / (2 * square))


def _views(flat: np.ndarray, g: int) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, s in _shapes(g):
        n = math.prod(s)
        out[name], at = flat[at : at + n].reshape(s), at + n
    return out


def _tanh(h: np.ndarray) -> np.ndarray:
    """In place of h, by exp, which takes a third of np.tanh's time."""
    h *= 2
    np.minimum(h, 80, out=h)
    np.exp(h, out=h)
    h += 1
    np.divide(-2, h, out=h)
    h += 1
    return h


def _hidden(p: dict[str, np.ndarray], ctx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = np.take(p["e"], ctx, 0).reshape(len(ctx), -1)
    h = x @ p["w"]
    h += p["b"]
    return x, _tanh(h)


def _tiles(y: np.ndarray, g: int, size: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """The rows by the group of their class (class mod g), in tiles of one group, filled up with the number of rows; and the group of each tile."""
    of = (y % g).astype(np.uint8)
    order = np.argsort(of, kind="stable")
    many = np.bincount(of, minlength=g)
    tiles = -(-many // size)
    out = np.full(max(1, int(tiles.sum())) * size, len(y))
    out[np.arange(len(y)) + np.repeat((np.cumsum(tiles) - tiles) * size - (np.cumsum(many) - many), many)] = order
    return out.reshape(-1, size), np.repeat(np.arange(g), tiles) if len(y) else np.zeros(1, np.int64)


def _softmax(z: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Probabilities times total, in place of z; classes lie along the last axis but one, where sums are fast."""
    z -= z.max(-2, keepdims=True)
    np.exp(z, out=z)
    z *= (total / z.sum(-2))[..., None, :]
    return z


def _log_softmax(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The log probability of y; z (class, row) is changed."""
    z -= z.max(0)
    t = z[y, np.arange(len(y))]
    np.exp(z, out=z)
    return t - np.log(z.sum(0))


def _groups_of(p: dict[str, np.ndarray], h: np.ndarray) -> np.ndarray:
    """Logits of the groups (group, row)."""
    z = p["u"] @ h.T
    z += p["a"][:, None]
    return z


def _members(p: dict[str, np.ndarray], h: np.ndarray, y: np.ndarray, g: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Within groups: tiles of rows, their groups, hidden values, weights and members of the group, logits (tile, member, row)."""
    rows, of = _tiles(y, g)
    m = np.take(np.append(h, np.zeros((1, HIDDEN), h.dtype), 0), rows, 0)
    v = p["v"][of]
    z = v @ m.transpose(0, 2, 1)
    z += p["c"][of][..., None]
    return rows, of, m, v, np.append(y // g, 0)[rows], z


def _sorted_members(p: dict[str, np.ndarray], h: np.ndarray, y: np.ndarray, g: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows in the order of their groups, and logits (member, row) in that order; for many rows, where it takes less time than tiles."""
    of = (y % g).astype(np.uint8)
    order = np.argsort(of, kind="stable")
    ends = np.cumsum(np.bincount(of, minlength=g)).tolist()
    m, z = np.take(h, order, 0), np.empty((g, len(y)), h.dtype)
    for k, (a, b) in enumerate(zip([0, *ends], ends)):
        if a < b:
            np.matmul(p["v"][k], m[a:b].T, out=z[:, a:b])
            z[:, a:b] += p["c"][k][:, None]
    return order, z


def log_probs(flat: np.ndarray, ctx: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Log probability of class y given the classes beside it."""
    g = side_of(flat)
    p, out = _views(flat, g), np.empty(len(y), np.float64)
    for i in range(0, len(y), 8192):
        k = y[i : i + 8192].astype(np.int64)
        _, h = _hidden(p, ctx[i : i + 8192])
        order, z = _sorted_members(p, h, k, g)
        out[i + order] = _log_softmax(z, (k // g)[order])
        out[i : i + len(k)] += _log_softmax(_groups_of(p, h), k % g)
    return out


def gradient(flat: np.ndarray, ctx: np.ndarray, y: np.ndarray, g: int) -> np.ndarray:
    """Gradient of the mean negative log probability."""
    p, n, y = _views(flat, g), len(y), y.astype(np.int64)
    x, h = _hidden(p, ctx)
    out = np.zeros_like(flat)
    o = _views(out, g)
    one = h.dtype.type(1 / n)
    d = _softmax(_groups_of(p, h), one)
    d[y % g, np.arange(n)] -= one
    o["u"][:], o["a"][:] = d @ h, d.sum(1)
    dh = d.T @ p["u"]
    rows, of, m, v, k, z = _members(p, h, y, g)
    real = (rows < n) * one
    d = _softmax(z, real)
    d[np.arange(len(rows))[:, None], k, np.arange(rows.shape[1])] -= real
    mine = (np.arange(g)[:, None] == of).astype(h.dtype)
    o["v"][:] = (mine @ (d @ m).reshape(len(of), -1)).reshape(o["v"].shape)
    o["c"][:] = mine @ d.sum(2)
    inner = np.empty((n + 1, HIDDEN), h.dtype)
    inner[rows] = d.transpose(0, 2, 1) @ v
    dh += inner[:-1]
    dh *= 1 - h * h
    o["w"][:], o["b"][:] = x.T @ dh, dh.sum(0)
    dx = (p["w"] @ dh.T).reshape(-1, DIM, n).transpose(1, 0, 2).astype(np.float64, order="C").reshape(DIM, -1)
    at = ctx.T.ravel().astype(np.intp)
    for c in range(DIM):
        o["e"][:, c] = np.bincount(at, dx[c], len(o["e"]))
    return out


def contexts(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """ids has SIDE pads (the number of classes) before and after each document; at are places in it."""
    out = np.empty((len(at), 2 * SIDE), ids.dtype)
    for i, k in enumerate(k for k in range(-SIDE, SIDE + 1) if k):
        out[:, i] = ids[at + k]
    return out


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts (binary), one after another, and how many each text has."""
    parts = pc.ascii_split_whitespace(pa.Array.from_buffers(pa.string(), len(texts), texts.buffers(), offset=texts.offset))
    words = parts.flatten()
    words = pa.Array.from_buffers(pa.binary(), len(words), words.buffers(), offset=words.offset)
    full = pc.greater(pc.binary_length(words), 0)
    before = np.append(0, np.cumsum(full.to_numpy(zero_copy_only=False)))
    ends = before[np.cumsum(np.append(0, pc.list_value_length(parts).to_numpy()))]
    return words.filter(full), np.diff(ends)


def _pieces(b: pa.RecordBatch, column: int, most: int) -> Iterator[tuple[int, pa.Array]]:
    """Slices of a column of a batch, of bounded bytes but for single texts: (first row, texts)."""
    texts = b.column(column)
    size = pc.binary_length(texts).to_numpy().astype(np.int64)
    cut = np.flatnonzero(np.diff((np.cumsum(size) - size) // most, prepend=-1))
    for first, end in zip(cut, np.append(cut, len(texts))[1:], strict=True):
        yield int(first), texts.slice(first, end - first)


class Vocabulary:
    """Class of a word, and its log share of that class."""

    def __init__(self, counts: list[tuple[bytes, int]], of_ending: dict[int, int], classes: int, words: int = 0):
        """counts: the cached words, most frequent first; of_ending: words by ending, over the whole corpus; words: how many there are in all."""
        self.size, self.frequent, self.words = classes, classes // 2, words
        self.endings = classes - self.frequent
        left = {self.frequent + k: n for k, n in of_ending.items()}
        for w, n in counts[: self.frequent]:
            left[self.ending_class(w)] -= n
        self.total = np.zeros(classes)
        for k, n in left.items():
            self.total[k] = np.log(max(1, n))
        self.cached = pa.array([w for w, _ in counts], pa.binary())
        self.class_of = np.array([i if i < self.frequent else self.ending_class(w) for i, (w, _) in enumerate(counts)], np.uint16)
        self.share = np.array([0.0 if i < self.frequent else np.log(n) for i, (_, n) in enumerate(counts)]) - self.total[self.class_of]

    @property
    def known(self) -> dict[bytes, tuple[int, float]]:
        return dict(zip(self.cached.to_pylist(), zip(self.class_of.tolist(), self.share.tolist(), strict=True), strict=True))

    def ending_class(self, word: bytes) -> int:
        return self.frequent + zlib.crc32(word[-2:]) % self.endings

    def encode(self, texts: pa.Array) -> list[pa.Array]:
        """For each text SIDE pads and its classes (as uint16), the sum of the log shares, and the words that aren't cached, whose log counts are still to be added."""
        words, n = _words(texts)
        at = pc.fill_null(pc.index_in(words, value_set=self.cached), -1).to_numpy()
        new = np.flatnonzero(at < 0)
        rest = words.take(pa.array(new))
        ids, share = np.append(self.class_of, 0)[at].astype(np.uint16), np.append(self.share, 0.0)[at]
        ids[new] = [self.ending_class(w) for w in rest.to_pylist()]
        share[new] = -self.total[ids[new]]
        of, ends = np.repeat(np.arange(len(n)), n), np.append(0, np.cumsum(n))
        padded = np.full(len(words) + SIDE * len(n), self.size, np.uint16)
        padded[np.arange(len(words)) + SIDE * (of + 1)] = ids
        offsets = (2 * (ends + SIDE * np.arange(len(n) + 1))).astype(np.int32)
        many = np.append(0, np.cumsum(np.bincount(of[new], minlength=len(n)))).astype(np.int32)
        return [
            pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(padded)]),
            pa.array(np.bincount(of, share, len(n)).astype(np.float64)),
            pa.ListArray.from_arrays(pa.array(many), rest),
        ]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for _, texts in _pieces(b, 1, 32 << 20):
            c = pc.value_counts(_words(texts)[0])
            yield pa.RecordBatch.from_arrays([c.field("values"), c.field("counts")], ["word", "n"])


def most_frequent(words: DataFrame, k: int) -> list:
    """The k words of the largest n, ties by word. Sizes of (at most 1,008) bands of n come first, so that tasks return few rows in vain."""
    band = F.floor(F.log2("n") * 16).cast("int")
    size, last = 0, 0
    for r in sorted(words.groupBy(band.alias("band")).count().collect(), reverse=True):
        last, size = r.band, size + r["count"]
        if size >= k:
            break
    above = words.where(band > last).collect()
    above.sort(key=lambda r: (-r.n, bytes(r.word)))
    return above + words.where(band == last).orderBy(F.desc("n"), "word").limit(max(0, k - len(above))).collect()


def word_counts(texts: DataFrame) -> DataFrame:
    """word, n: all words of the corpus, checkpointed."""
    return checkpoint(texts.mapInArrow(_counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))


def vocabulary(texts: DataFrame, counts: DataFrame | None = None) -> Vocabulary:
    counts = counts or word_counts(texts)
    n, total = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    classes = side(n) ** 2
    ending = F.crc32(F.expr("substring(word, -2, 2)")) % (classes - classes // 2)
    ends = counts.groupBy(ending.cast("int").alias("ending")).agg(F.sum("n").alias("n")).collect()
    return Vocabulary([(bytes(r.word), r.n) for r in most_frequent(counts, CACHED)], {r.ending: r.n for r in ends}, classes, total)


def encoded(texts: DataFrame, vocab: Vocabulary) -> DataFrame:
    """doc_id, ids (SIDE pads and the classes of the words, as uint16), share (their summed log shares, without the log counts of rest), rest (words that aren't cached), shard, row (a number of its own for each row); checkpointed, a shard in one partition, by hashes of ids."""
    words = texts.sparkSession.sparkContext.broadcast(vocab)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, part in _pieces(b, 1, 16 << 20):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(part)), *words.value.encode(part)], ["doc_id", "ids", "share", "rest"])

    d = texts.select("doc_id", "text").mapInArrow(coded, "doc_id long, ids binary, share double, rest array<binary>")
    n = max(1, min(SHARDS, vocab.words // SHARD_WORDS))
    d = d.withColumn("hash", F.xxhash64("ids")).withColumn("shard", F.pmod("hash", F.lit(n)).cast("int"))
    d = d.repartition(n, "shard").sortWithinPartitions("shard", "hash", "ids").drop("hash")
    return checkpoint(d.withColumn("row", F.monotonically_increasing_id()))


def rest_shares(codes: DataFrame, counts: DataFrame) -> DataFrame:
    """row, more: the summed log counts of a row's words that aren't cached; words that occur once add log 1 and need no join."""
    said = codes.select("row", F.explode("rest").alias("word")).join(counts.where("n > 1"), "word")
    return said.groupBy("row").agg(F.sum(F.log("n")).alias("more"))


def _stream(parts: list[bytes], classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes of encoded texts one after another, padded, and the places of words."""
    ids = np.concatenate([np.frombuffer(b"".join(parts), np.uint16), np.full(SIDE, classes, np.uint16)])
    return ids, np.flatnonzero(ids < classes)


def _groups(b: pa.RecordBatch, most: int = 2 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Slices of a batch of bounded bytes: (first row, texts)."""
    first, texts, size = 0, [], 0
    for i, t in enumerate(b.column(1)):
        t = t.as_py()
        if texts and size + len(t) > most:
            yield first, texts
            first, texts, size = i, [], 0
        texts.append(t)
        size += len(t)
    if texts:
        yield first, texts


def train(texts: DataFrame, vocab: Vocabulary, rounds: int = ROUNDS, rate: float = 0.05) -> np.ndarray:
    return fit(encoded(texts, vocab), vocab.size, rounds, rate)


def targets(at: np.ndarray, r: int, rounds: int) -> np.ndarray:
    """The places that round r trains on; the rounds share all places out."""
    return at[at % rounds == r]


def _shards(batches: Iterator[pa.RecordBatch], most: int = 2 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of ids of one shard, of bounded bytes, whatever the batches: (shard, ids)."""
    shard, held, size = None, [], 0
    for b in batches:
        for k, x in zip(b.column("shard").to_pylist(), b.column("ids"), strict=True):
            x = x.as_py()
            if held and (k != shard or size + len(x) > most):
                yield shard, held
                held, size = [], 0
            shard = k
            held.append(x)
            size += len(x)
    if held:
        yield shard, held


def fit(codes: DataFrame, classes: int, rounds: int = ROUNDS, rate: float = 0.05) -> np.ndarray:
    """Weights trained on the shards of encoded texts."""
    spark = codes.sparkSession
    codes = codes.select("shard", "ids")
    g = round(classes**0.5)
    flat = start_weights(g=g)
    for r in range(rounds):
        sent = spark.sparkContext.broadcast(flat)

        def local(batches: Iterator[pa.RecordBatch], sent=sent, r=r) -> Iterator[pa.RecordBatch]:
            shard, w, squares, n = None, None, None, 0

            def done():
                return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([n], pa.int64()), pa.array([w], pa.list_(pa.float32()))], ["p", "n", "w"])

            for k, part in _shards(batches):
                if k != shard:
                    if n:
                        yield done()
                    shard, w, squares, n = k, sent.value.copy(), np.full(len(sent.value), 1e-4, np.float32), 0
                ids, at = _stream(part, classes)
                at = targets(at, r, rounds)
                near = np.column_stack([contexts(ids, at), ids[at]])
                order = np.arange(len(at))
                np.random.default_rng(len(at)).shuffle(order)
                for i in range(0, len(at), BATCH):
                    to = np.take(near, order[i : i + BATCH], 0)
                    d = gradient(w, to[:, :-1], to[:, -1], g)
                    squares += d * d
                    d /= np.sqrt(squares)
                    w -= np.float32(rate / (1 + 2 * r)) * d
                    n += len(to)
            if n:
                yield done()

        def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n, first = None, 0, None
            for b in batches:
                for p, k, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                    x = w.values.to_numpy().astype(np.float64) * k
                    total, n, first = x if total is None else total + x, n + k, p if first is None else first
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([first], pa.int32()), pa.array([n], pa.int64()), pa.array([(total / n).astype(np.float32)], pa.list_(pa.float32()))], ["p", "n", "w"])

        kind = "p int, n long, w array<float>"
        parts = checkpoint(codes.mapInArrow(local, kind))
        count = parts.count()
        while count > FAN:
            count = (count + FAN - 1) // FAN
            parts = checkpoint(parts.repartition(count, F.col("p") % count).sortWithinPartitions("p").mapInArrow(average, kind))
        got = sorted(parts.collect(), key=lambda x: x.p)
        if got:
            n = sum(x.n for x in got)
            flat = (sum(np.array(x.w, np.float64) * x.n for x in got) / n).astype(np.float32)
    return flat


def score(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, log_prob (sum over all words), mean_log_prob."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    counts = word_counts(texts)
    vocab = vocabulary(texts, counts)
    codes, classes = encoded(texts, vocab), vocab.size
    sent = docs.sparkSession.sparkContext.broadcast(fit(codes, classes))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, total = [], []
            for first, part in _groups(b):
                ids, at = _stream(part, classes)
                n = [len(x) // 2 - SIDE for x in part]
                lp = np.concatenate([[0.0], np.cumsum(log_probs(sent.value, contexts(ids, at), ids[at]))])
                ends = np.cumsum([0, *n])
                total += (lp[ends[1:]] - lp[ends[:-1]] + b.column(2).slice(first, len(part)).to_numpy()).tolist()
                size += n
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(total, pa.float64()), b.column(3)], ["doc_id", "n_words", "part", "row"])

    parts = codes.select("doc_id", "ids", "share", "row").mapInArrow(scored, "doc_id long, n_words long, part double, row long")
    whole = parts.join(rest_shares(codes, counts), "row", "left").withColumn("log_prob", F.col("part") + F.coalesce("more", F.lit(0.0)))
    return whole.select("doc_id", "n_words", "log_prob", F.when(F.col("n_words") > 0, F.col("log_prob") / F.col("n_words")).alias("mean_log_prob"))


def held_out(docs: DataFrame, one_in: int = 10) -> tuple[float, float, int]:
    """Mean log probability of a word's class in texts that the network wasn't trained on (one in so many, by hash, equal texts together), the same by the classes' frequencies in the others, and how many words.

    A word's share of its class adds the same to both, so the difference is what the words beside it tell.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    vocab = vocabulary(texts)
    codes, classes = encoded(texts, vocab), vocab.size
    held = F.pmod(F.xxhash64("ids", F.lit(one_in)), F.lit(one_in)) == 0

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(classes + 1, np.int64)
        for b in batches:
            for x in b.column(0):
                n += np.bincount(np.frombuffer(x.as_py(), np.uint16), minlength=classes + 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(classes)), pa.array(n[:classes])], ["class", "n"])

    counts = np.ones(classes)
    for r in codes.where(~held).select("ids").mapInArrow(seen, "class long, n long").groupBy("class").agg(F.sum("n").alias("n")).collect():
        counts[r["class"]] += r.n
    sent = docs.sparkSession.sparkContext.broadcast((fit(codes.where(~held), classes), np.log(counts / counts.sum())))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, plain = sent.value
        total, n = np.zeros(2), 0
        for b in batches:
            for _, part in _groups(b):
                ids, at = _stream(part, classes)
                total += (log_probs(flat, contexts(ids, at), ids[at]).sum(), plain[ids[at]].sum())
                n += len(at)
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*total, n)], ["net", "plain", "n"])

    r = codes.where(held).select("doc_id", "ids").mapInArrow(judged, "net double, plain double, n long").agg(F.sum("net"), F.sum("plain"), F.sum("n")).first()
    return r[0] / r[2], r[1] / r[2], r[2]


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read_table(spark, sf_dir, "documents"))
