"""The training-data operators on small fixtures: edge cases, brute force, SQL, round trips."""

import itertools
import math
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF, same
from pyspark.sql import functions as F

import corpus_pipeline
from tesserae.llm import op1_quality_rules as op1
from tesserae.llm import op2_minhash_dedup as op2
from tesserae.llm import op3_quality_classifier as op3
from tesserae.llm import op4_token_counts as op4
from tesserae.llm import op5_warc as op5
from tesserae.llm import op6_decontaminate as op6
from tesserae.llm import op7_shards as op7
from tesserae.llm import op8_licenses as op8
from tesserae.llm import op9_mix as op9
from tesserae.llm import op10_lm_score as op10
from tesserae.llm import registry

LONG = " ".join(f"word{i % 977}x{i}" for i in range(25_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, slot string, score double, kept string, size string, key string, word string, file_no int, target string, h int"


def docs_of(spark, rows, schema=SCHEMA):
    """Rows of (doc_id, text, source), with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 1, "s", 0.5, "k", "z", "y", "w", 3, "t", 4) for i, t, s in rows], schema)


EDGE = [
    (1, None, "a"), (2, "", "a"), (3, "   \n\t", None), (4, "one", None), (5, "one", "b"), (5, "one", "b"), (None, "one two three four five six", "b"),
    (None, None, None), (6, "Ünï cödé   x y  z", "é"), (7, LONG, "b"), (8, "A b C d e F", "b"), (9, "a B c D E f", "c"), (10, "the the the " * 300, "c"),
]


def edge(spark):
    return docs_of(spark, EDGE)


def empty(spark):
    return docs_of(spark, [])


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, duck, name):
    same(registry.QUERIES[name](spark, SF).toPandas(), duck.sql(registry.ORACLES[name]).df())



def test_registry_has_all_queries():
    assert [re.match(r"op(\d+)_", k)[1] for k in registry.QUERIES if k != "pipeline"] == [str(i) for i in range(1, 14)]


# 1


def plain_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    win = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = {x for x in win if win.count(x) > 1} if len(win) < 2000 else {x for x in win if False}
    covered = {i + k for i, x in enumerate(win) if x in many for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in op1.SYMBOLS for c in text), len(lines) - len(set(lines)), len(covered)


def test_op1_measures(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab \n#!\x0b é") for _ in range(rng.randrange(200))) for _ in range(60)]
    rows = [*EDGE, *((100 + i, t, "r") for i, t in enumerate(texts))]
    led = op1.ledger(docs_of(spark, rows))
    got = sorted((r.doc_id or -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in led.collect())
    assert got == sorted((i or -1, *plain_measures(t)) for i, t, _ in rows)
    assert op1.ledger(empty(spark)).count() == 0


def test_op1_policies_and_ablation(spark):
    led = spark.createDataFrame([(i, b) for i, b in enumerate([0, 0, 1, 2, 3, 4, 6])], "doc_id long, fail_bits long")
    assert [r.kept for r in op1.apply_policy(led, "base", 1).orderBy("doc_id").collect()] == [True, True, False, False, False, True, False]
    got = {r.rule: tuple(r[1:]) for r in op1.ablation(led, "base", 1).collect()}
    assert got == {"few_words": (2, 1, 4), "repeated_windows": (3, 2, 5)}


# 2


def plain_sets(rows):
    out = {}
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        out[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    return out


def plain_components(sets, percent=85):
    par = {i: i for i in sets}

    def root(i):
        while par[i] != i:
            i = par[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        n = len(sets[a] & sets[b])
        if n and 100 * n >= percent * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            par[y] = x
    return {i: root(i) for i in sets}


def near_copies(n, size, edits, seed):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
    out = []
    for _ in range(n):
        w = base[:]
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(size)] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def op2_result(docs, **parameters):
    return {r.doc_id: r.component_id for r in op2.near_duplicates(docs, **parameters).collect()}


@pytest.mark.parametrize("percent, block", [(85, 1024), (85, 16), (60, 1024)])
def test_op2_against_brute_force(spark, monkeypatch, percent, block):
    monkeypatch.setattr(op2, "BLOCK", block)
    texts = near_copies(90, 60, 3, 1) + near_copies(30, 200, 6, 2) + near_copies(20, 12, 1, 3) + [LONG, LONG.upper(), "short", "SHORT", "a b c d e"]
    rows = [(1000 - i, t, "s") for i, t in enumerate(texts)]
    rows += [(2000 + i, t, "s") for i, t in enumerate(texts[::7])]
    sets = plain_sets(rows)
    want = plain_components(sets, percent)
    got = op2.near_duplicates(docs_of(spark, rows), percent).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)


def test_op2_threshold_follows_the_similarity():
    for percent in (50, 80, 85, 95):
        t, j = op2.matches(percent), percent / 100
        below = lambda t, j=j: sum(math.comb(op2.COORDINATES, k) * j**k * (1 - j) ** (op2.COORDINATES - k) for k in range(t))
        assert below(t) <= op2.MISS < below(t + 1)
    assert op2.matches(1) == 1


def test_op2_counts_equal_coordinates_in_pairs_and_groups():
    rng = np.random.default_rng(4)
    sig = rng.integers(0, 2, (60, op2.COORDINATES)).astype(np.int32)
    n, least = rng.integers(80, 120, 60), op2.matches(85)
    want = [[(sig[i] == sig[k]).sum() >= least and 100 * min(n[i], n[k]) >= 85 * max(n[i], n[k]) for k in range(60)] for i in range(60)]
    groups = [(0, 2), (2, 4), (4, 5), (5, 30), (30, 60)]
    key = np.repeat(np.arange(len(groups)), [b - a for a, b in groups])
    whole = pa.RecordBatch.from_arrays([pa.array(key), pa.array(key * 0), pa.array(key * 0), pa.array(np.arange(60)), pa.array(n), pa.array(list(sig), pa.list_(pa.int32()))], ["list", "i", "j", "name", "n", "sig"])
    for step in (60, 7, 1):
        edges = [e for b in op2._counter(85)(whole.slice(i, step) for i in range(0, 60, step)) for e in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        root = lambda i: root(dict(edges)[i]) if i in dict(edges) else i
        for a, b in groups:
            linked = np.array([r[a:b] for r in want[a:b]]) | np.eye(b - a, dtype=bool)
            assert [root(i) for i in range(a, b)] == (a + op2.roots(linked)).tolist()


def hot_list(spark, sizes):
    """A list 7 in blocks of 16, and components of these sizes, known for all members but the single ones."""
    ids = iter(range(10_000))
    parts = [[next(ids) for _ in range(n)] for n in sizes]
    hot = op2.cut(spark.createDataFrame([(7, i, 10) for p in parts for i in p], "list long, cid long, n long"), False)
    known = spark.createDataFrame([(i, p[0]) for p in parts if len(p) > 1 for i in p], "node long, component long")
    return parts, hot, known


@pytest.mark.parametrize("sizes", [[60, 20, 3, 1, 1], [1] * 40, [2] * 30])
def test_op2_members_of_different_components_meet(spark, monkeypatch, sizes):
    monkeypatch.setattr(op2, "BLOCK", 16)
    parts, hot, known = hot_list(spark, sizes)
    out = op2.outside(hot, known, False)
    groups = {}
    for r in op2.second_meetings(out).collect():
        groups.setdefault((r.i, r.j), []).append(r.cid)
    assert all(len(g) == len(set(g)) for g in groups.values())
    met = {frozenset(x) for g in groups.values() for x in itertools.combinations(g, 2)}
    for p, q in itertools.combinations(parts, 2):
        assert all(frozenset((x, y)) in met for x in p for y in q)
    assert out.first().rows == sum(map(len, groups.values()))


@pytest.mark.parametrize("pivots", [1, 4])
def test_op2_chain_through_blocks(spark, monkeypatch, pivots):
    """A chain of links, which pivots alone cannot tie, beside texts that share a passage only."""
    monkeypatch.setattr(op2, "BLOCK", 4)
    monkeypatch.setattr(op2, "PIVOTS", pivots)
    words = [f"w{i}" for i in range(400)]
    rows = [(i + 1, " ".join(words[5 * i : 5 * i + 150]), "s") for i in range(40)]
    rows += [(100 + i, " ".join(words[:100] + [f"x{i}y{k}" for k in range(100)]), "s") for i in range(20)]
    assert op2_result(docs_of(spark, rows)) == plain_components(plain_sets(rows))


def test_op2_refines_long_lists(spark, monkeypatch):
    """Texts that share a passage and little else: refined lists find the copies among them."""
    monkeypatch.setattr(op2, "BLOCK", 4)
    monkeypatch.setattr(op2, "LINEAR", 1)
    monkeypatch.setattr(op2, "PIVOTS", 1)
    depths, cut = [], op2.cut
    monkeypatch.setattr(op2, "cut", lambda m, w: (depths.append(w), cut(m, w))[1])
    rng = random.Random(6)
    shared = [f"s{i}" for i in range(30)]
    rows = []
    for i in range(60):
        own = [f"x{i}y{k}" for k in range(60)]
        rows.append((i, " ".join(shared + own), "s"))
        if i % 4 == 0:
            own[rng.randrange(60)] = "changed"
            rows.append((100 + i, " ".join(shared + own), "s"))
    got = op2_result(docs_of(spark, rows))
    assert got == plain_components(plain_sets(rows)) and sum(k != v for k, v in got.items()) == 15
    assert depths.count(False) > 1


def test_op2_rows_that_repeat_an_id(spark):
    t, u = (" ".join(f"{c}{i}" for i in range(80)) for c in "tu")
    rows = [(1, t, "s"), (1, u, "s"), (2, t + " z", "s"), (3, u + " z", "s"), (4, "alone", "s"), (9, u, "s"), (9, "other words", "s"), (8, "other words", "s")]
    for n in (1, 4):
        got = op2.near_duplicates(docs_of(spark, rows).repartition(n)).collect()
        assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 1), (3, 1), (4, 4), (8, 1), (9, 1)} and len(got) == len(rows)


def test_op2_edges(spark):
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in op2.near_duplicates(edge(spark)).collect()}
    assert {(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (None, 2, None, True), (None, 0, None, True), (8, 2, 8, True), (9, 2, 8, False)} <= got
    assert op2.near_duplicates(empty(spark)).count() == 0


def test_components_within_blocks():
    s = [np.arange(100, dtype=np.uint64), np.arange(5, 105, dtype=np.uint64), np.arange(10, 110, dtype=np.uint64), np.arange(500, 600, dtype=np.uint64)]
    assert op2.components_within(s).tolist() == [0, 0, 0, 3]


def test_star_components_of_a_chain(spark):
    e = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(101, 100), (100, 101), (7, 7)], "u long, v long")
    got = {r.node: r.component for r in op2.star_components(e).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert op2.star_components(e.where("u > 1000")).count() == 0


# 3


def test_op3_held_out_accuracy(spark):
    got = op3.op3_quality_classifier(spark, SF.replace("0.001", "0.01"))
    y = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/labels.parquet")
    right = got.where("held_out").join(y, "doc_id").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0]
    assert right > 0.97
    r = got.first()
    assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_op3_edges(spark):
    labels = spark.createDataFrame([(1, 1), (4, 1), (5, 0), (5, 1), (7, 1), (10, 0), (None, 1), (8, None), (9, 5)], "doc_id long, quality int")
    for d, y in ((edge(spark), labels), (edge(spark), labels.where("quality = 1")), (edge(spark), labels.limit(0))):
        got = op3.classify(d, y).collect()
        assert len(got) == len(EDGE) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert op3.classify(empty(spark), labels).count() == 0
    assert op3.accepted(edge(spark), labels).columns == edge(spark).columns


def test_op3_labels_of_held_out_rows_do_not_matter(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    y = spark.read.parquet(f"{SF}/labels.parquet")
    other = y.withColumn("quality", F.when(op3.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r.doc_id: r.score for r in op3.classify(d, x).collect()} for x in (y, other))
    assert a == b


def plain_discriminant(rows, labels):
    """Scores by direct formulas: rows (doc_id, text), labels (doc_id, quality)."""
    own, ridge, out = 0.7, 0.02, []
    x = {k: np.array(op3.statistics((t or "").encode())) for k, (_, t) in enumerate(rows)}
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    y = {}
    for i, q in labels:
        if i is not None and q in (0, 1) and not held(i):
            y[i] = min(q, y.get(i, 1))
    groups = [[x[k] for k, (i, _) in enumerate(rows) if y.get(i) == c] for c in (0, 1)]
    mean = [sum(g) / len(g) for g in groups]
    cov = [sum(np.outer(v - m, v - m) for v in g) / len(g) for g, m in zip(groups, mean, strict=True)]
    pooled = sum(len(g) * np.diag(c) for g, c in zip(groups, cov, strict=True)) / sum(map(len, groups))
    shrunk = [own * c + (1 - own) * np.diag(np.diag(c)) + np.diag(ridge * pooled + 1e-4) for c in cov]
    prior = [np.log((len(g) + 1) / (sum(map(len, groups)) + 2)) for g in groups]
    density = lambda v, c: prior[c] - 0.5 * (v - mean[c]) @ np.linalg.solve(shrunk[c], v - mean[c]) - 0.5 * np.linalg.slogdet(shrunk[c])[1]
    ratio = lambda v: np.sign(density(v, 1) - density(v, 0)) * np.log1p(abs(density(v, 1) - density(v, 0)))
    r = np.array([round(ratio(v) * 20) / 20 for c in (0, 1) for v in groups[c]])
    q = np.array([c for c in (0, 1) for _ in groups[c]], float)
    loss = lambda t: np.logaddexp(0, -(2 * q - 1) * (t[0] * r + t[1])).sum() + 0.5 * ((t[0] - 1) ** 2 + t[1] ** 2)
    t, step = np.array([1.0, 0.0]), 1.0
    while step > 1e-7:  # a plain search
        best = min(((loss(t + step * np.array(d)), i) for i, d in enumerate([(1, 0), (-1, 0), (0, 1), (0, -1)])), key=lambda z: z[0])
        if best[0] < loss(t):
            t = t + step * np.array([(1, 0), (-1, 0), (0, 1), (0, -1)][best[1]])
        else:
            step /= 2
    for k in range(len(rows)):
        out.append((rows[k][0], bool(held(rows[k][0])), 1 / (1 + np.exp(-np.clip(t[0] * ratio(x[k]) + t[1], -40, 40)))))
    return out


def test_op3_against_brute_force(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    y = [tuple(r) for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality").collect()]
    texts = [(r.doc_id, r.text) for r in d.collect()]
    top = 2**60
    rows = [*texts, (top + 1, texts[0][1]), (top + 3, texts[1][1]), (None, texts[2][1]), (-top - 1, None), (texts[5][0], texts[7][1])]
    y += [(texts[8][0], 0), (texts[8][0], 1), (None, 1), (texts[9][0], None), (top + 1, 1)]
    got = op3.classify(docs_of(spark, [(i, t, "s") for i, t in rows]).coalesce(1), spark.createDataFrame(y, "doc_id long, quality int")).collect()
    want = plain_discriminant(rows, y)
    assert [(r.doc_id, r.held_out) for r in got] == [x[:2] for x in want]
    assert max(abs(r.score - x[2]) for r, x in zip(got, want, strict=True)) < 1e-4
    assert [r.predicted for r in got] == [int(r.score >= 0.7) for r in got]


def test_op3_takes_a_bounded_number_of_labels(spark):
    y = spark.range(20_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    n = op3.known_labels(y).count()
    assert n == y.where(~op3.held_out()).count() and abs(op3.known_labels(y, 3000).count() - 3000) < 300


# 4


def test_op4_equals_the_public_tokenizer(spark):
    from tokenizers import Tokenizer, models, pre_tokenizers

    v = op4.load_vocabulary(op4.VOCABULARY)
    t = Tokenizer(models.Unigram(v, 0, True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    size = lambda x: len(t.encode(x or "", add_special_tokens=False).ids)
    d = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in d.collect()}
    assert {r.doc_id: r.n_tokens for r in op4.token_counts(d).collect()} == {k: size(x) for k, x in texts.items()}
    got = sorted((r.doc_id or -1, r.n_tokens) for r in op4.token_counts(edge(spark)).collect())
    assert got == sorted((i or -1, size(x)) for i, x, _ in EDGE)


def test_op4_ties_and_unknowns_against_the_public_tokenizer():
    from tokenizers import Tokenizer, models, pre_tokenizers

    rng = random.Random(5)
    for k in range(30):
        letters = "ab▁c"
        pieces = {"".join(rng.choice(letters) for _ in range(rng.randrange(1, 4))) for _ in range(12)}
        v = [("<unk>", 0.0), *((p, -float(rng.randrange(1, 4))) for p in sorted(pieces))] + [(f"<0x{i:02X}>", -9.0) for i in range(256) if k % 2]
        t = Tokenizer(models.Unigram(v, 0, bool(k % 2)))
        t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
        c = op4.Counter(v)
        for _ in range(60):
            x = "".join(rng.choice("aabbc dé☃") for _ in range(rng.randrange(20)))
            assert c.text(x) == len(t.encode(x, add_special_tokens=False).ids), (v, x)
    assert op4.Counter([("a", -1.0)]).text("") == 0


# 5


def test_op5_round_trip_is_deterministic(spark, tmp_path):
    big = "<p>" + "x" * 200
    rows = [(5, "u5", big), (2, "u2", big), (9, None, big), (1, "a", "tiny"), (3, "b", "tiny"), (None, "n", big), (7, "c", None), (9, "z", big), (9, "z", big), (4, "d\r\nX: y", "é" * 90)]
    pages = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, file_no int, member string")
    files = []
    for k, n in enumerate((1, 5)):
        out = str(tmp_path / str(k))
        listed = op5.write_archive(pages.repartition(n), out, roll_bytes=300)
        files.append({r.name: r.sha256 for r in listed.collect()})
        got = op5.read_archive(spark, out, payload=True).collect()
        assert sorted((r.page_id or 0, r.record_type, r.refers_to) for r in got) == sorted([(0, "response", None), (1, "response", None), (2, "response", None), (3, "response", None), (4, "response", None), (5, "revisit", 2), (7, "response", None), *[(9, "revisit", 2)] * 3], key=lambda x: (x[0], x[1], x[2]))
        assert {bytes(r.payload).decode() for r in got if r.record_type == "response"} == {big, "tiny", "", "é" * 90}
        assert not list((tmp_path / str(k) / "_temporary").glob("part-*"))
    assert files[0] == files[1] and len(files[0]) > 2
    out = str(tmp_path / "none")
    assert op5.write_archive(pages.limit(0), out).count() == 0 and op5.read_archive(spark, out).count() == 0


def test_op5_keeps_large_ids(spark, tmp_path, monkeypatch):
    big, other, long = "<p>" + "x" * 200, "<p>" + "y" * 200, "<p>" + "z y " * 400_000
    top = 2**62
    rows = [(top + 1, big), (top + 3, big), (None, big), (-top - 1, other), (-top + 3, other), (None, other), (2**60 + 1, long), (2**60 + 3, long)]
    pages = spark.createDataFrame([(i, f"u{k}", h, 1) for k, (i, h) in enumerate(rows)], "page_id long, url string, html string, first int")
    want = {(top + 1, "response", None), (top + 3, "revisit", top + 1), (None, "response", None), (-top - 1, "response", None), (-top + 3, "revisit", -top - 1), (2**60 + 1, "response", None), (2**60 + 3, "revisit", 2**60 + 1)}
    for few in (0, op5.FEW):
        monkeypatch.setattr(op5, "FEW", few)
        out = str(tmp_path / str(few))
        op5.write_archive(pages, out, roll_bytes=400)
        got = op5.read_archive(spark, out, payload=True).collect()
        assert len(got) == len(rows) and {(r.page_id, r.record_type, r.refers_to) for r in got} == want
        assert {bytes(r.payload).decode() for r in got if r.record_type == "response"} == {big, other, long}
    heads = [h for p in sorted((tmp_path / str(few)).glob("part-*")) for h, _ in op5.records_of(iter([p.read_bytes()]))]
    assert [h["x-page-id"] for h in heads] == ["", "", *map(str, (-top - 1, -top + 3, 2**60 + 1, 2**60 + 3, top + 1, top + 3))]
    assert [h["x-refers-to-page-id"] for h in heads if h["warc-type"] == "revisit"] == [str(-top - 1), str(2**60 + 1), str(top + 1)]
    ids = {h["x-page-id"]: h["warc-record-id"] for h in heads}
    assert all(h["warc-refers-to"] == ids[h["x-refers-to-page-id"]] for h in heads if h["warc-type"] == "revisit")


def test_op5_number_of_files_is_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(op5, "MAX_FILES", 3)
    pages = spark.createDataFrame([(i, "u", f"page {i} " * 50) for i in range(40)], "page_id long, url string, html string")
    assert 2 <= op5.write_archive(pages, str(tmp_path / "a"), roll_bytes=1).count() <= 4
    assert op5.read_archive(spark, str(tmp_path / "a")).count() == 40


def test_op5_cut_archives_are_told():
    m = op5._member(op5.record("response", 1, "u", "d", 3, b"abc"))
    assert [b for _, b in op5.records_of(iter([m[:10], m[10:] + m, m]))] == [b"abc"] * 3
    with pytest.raises(ValueError):
        list(op5.records_of(iter([m[:-9]])))


# 6


def plain_tiling(doc, item, n):
    marked_d, marked_i, total = set(), set(), 0
    while True:
        best = None
        for j in range(len(item)):
            for i in range(len(doc)):
                k = 0
                while i + k < len(doc) and j + k < len(item) and doc[i + k] == item[j + k] and i + k not in marked_d and j + k not in marked_i:
                    k += 1
                if k >= n and (best is None or k > best[2]):
                    best = (i, j, k)
        if best is None:
            return total
        i, j, k = best
        marked_d.update(range(i, i + k))
        marked_i.update(range(j, j + k))
        total += k


def test_op6_tiling_against_brute_force():
    rng = random.Random(11)
    for _ in range(150):
        item = [rng.choice("abcd") for _ in range(rng.randrange(3, 14))]
        doc = [rng.choice("abcd") for _ in range(rng.randrange(0, 30))]
        assert op6.covered(doc, item, 3)[1] == plain_tiling(doc, item, min(3, len(item))), (item, doc)


def test_op6_finds_reordered_passages(spark):
    w = [f"t{i}" for i in range(30)]
    bench = spark.createDataFrame([(1, " ".join(w), 1), (2, "", 1), (3, None, 1), (4, "tiny item", 1), (None, "lost words of a null item here", 1)], "item_id long, text string, coverage int")
    moved = " ".join([*w[20:], "and", *w[:10], "then", *w[10:20]]).upper()
    rows = [(1, f"before {moved}, after", "s"), (2, " ".join(w[:12]), "s"), (3, "a tiny item", "s"), (4, "clean text of its own", "s"), (3, "tiny ITEM", "s"), *EDGE[:3]]
    d = docs_of(spark, [(r[0] if k < 5 else 50 + k, *r[1:]) for k, r in enumerate(rows)])
    got = {r.doc_id: (r.item_ids, r.coverage) for r in op6.leaks(d, bench).collect()}
    assert got == {1: ([1], 1.0), 3: ([4], 1.0)}
    assert {r.doc_id for r in op6.clean(d, bench).collect()} == {2, 4, 55, 56, 57}
    assert op6.leaks(empty(spark), bench).count() == 0 and op6.leaks(d, bench.limit(0)).count() == 0


def test_op6_many_items_and_a_full_bitmap(spark, monkeypatch):
    bench = spark.createDataFrame([(i, f"item {i} has words of its own number {i}") for i in range(400)], "item_id long, text string")
    d = docs_of(spark, [(i, f"x item {i} has words of its own number {i} y", "s") for i in range(40)] + [(99, "has other words than the items have", "s")])
    for few, most in ((op6.FEW, op6.MOST_BITS), (0, 4)):  # joined by a shuffle; nearly every seed passes so small a bitmap
        monkeypatch.setattr(op6, "FEW", few)
        monkeypatch.setattr(op6, "MOST_BITS", most)
        got = {r.doc_id: r.item_ids for r in op6.leaks(d, bench).collect()}
        assert set(got) == set(range(40)) and all(i in got[i] for i in got)
        assert [r.doc_id for r in op6.clean(d, bench).collect()] == [99]


def test_op6_query_against_brute_force(spark):
    """The query over its whole tables: every document that shares 5 words in a row with an item, tiled by plain loops."""
    words = lambda t: re.findall(r"\w+", (t or "").lower())
    grams = lambda w, n: {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    items = [(r.item_id, words(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        doc = words(r.text)
        have = {n: grams(doc, n) for n in range(1, 6)}
        for i, item in items:
            n = min(5, len(item))
            if item and grams(item, n) & have[n] and plain_tiling(doc, item, n) >= 0.5 * len(item):
                want.setdefault(r.doc_id, set()).add(i)
    got = {r.doc_id: set(r.item_ids) for r in op6.op6_decontaminate(spark, SF).collect()}
    assert got == want and got


def test_op6_repeated_words_and_long_texts(spark):
    """Many places of an item against many of a document, repeated rows, equal texts under several ids."""
    bench = spark.createDataFrame([(1, "go " * 300), (1, "the whole of another item here"), (2, "ends in this")], "item_id long, text string")
    rows = [(1, "go " * 5000, "s"), (2, LONG + " ends in this", "s"), (3, LONG, "s"), (None, "x ends in this", "s"), (4, "x ends in this", "s"), (4, "x ends in this", "s"), (4, "another item here the whole of another item here", "s"), *[(100 + k, t, "s") for k, (_, t, _) in enumerate(EDGE)]]
    got = {r.doc_id: (r.item_ids, r.coverage) for r in op6.leaks(docs_of(spark, rows), bench).collect()}
    assert got == {1: ([1], 1.0), 2: ([2], 1.0), None: ([2], 1.0), 4: ([1, 2], 1.0)}
    assert op6.clean(docs_of(spark, rows), bench).count() == 1 + len(EDGE)


# 7


def test_op7_is_a_shuffle(spark, tmp_path):
    rows = [*EDGE, *((100 + i, f"text {i % 50} " * (i % 9), "s") for i in range(400))]
    d = docs_of(spark, rows)
    got = op7.write_shards(d, str(tmp_path / "a"), shards=8, bucket_bytes=20_000).collect()
    assert sorted((r.doc.doc_id or -1, r.doc.text or "") for r in got) == sorted((i or -1, t or "") for i, t, _ in rows)
    for s in range(8):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots))) and abs(len(slots) - len(rows) / 8) < 1
    again = op7.shuffled(d.repartition(7), bucket_bytes=20_000).collect()
    key = lambda x: sorted((r.shard, r.slot, r.doc.doc_id or -1) for r in x)
    assert key(got) == key(again) != key(op7.shuffled(d, seed=1, bucket_bytes=20_000).collect())
    assert op7.shuffled(empty(spark)).count() == 0
    assert op7.shuffled(d).first().doc.shard == 1


def plain_shuffle(rows, n_buckets, seed, shards):
    """rows: (bucket, order key, id): (id, shard, slot) by a swap at a time."""
    out, start = [], 0
    for b in range(n_buckets):
        mine = [i for _, _, i in sorted(r for r in rows if r[0] == b)]
        rng = np.random.default_rng([seed, b])
        draws = rng.integers(0, np.arange(len(mine), 1, -1)).tolist()
        for k in range(len(mine) - 1, 0, -1):
            j = draws[len(mine) - 1 - k]
            mine[k], mine[j] = mine[j], mine[k]
        out += [(i, (start + p) % shards, (start + p) // shards) for p, i in enumerate(mine)]
        start += len(mine)
    return sorted(out)


@pytest.mark.parametrize("bytes_, width", [(32 << 20, 10_000), (3000, 10_000), (3000, 3)])
def test_op7_against_brute_force(spark, monkeypatch, bytes_, width):
    monkeypatch.setattr(op7, "WIDTH", width)
    d = docs_of(spark, [(i, f"text {i % 50} " * (i % 9), f"s{i % 3}") for i in range(400)])
    total = sum(1 + sum(len(str(v).encode()) if isinstance(v, str) else 8 for v in r) for r in d.collect())
    assert d.agg(F.sum(op7.row_bytes(d))).first()[0] == total
    n = 1 + total // bytes_
    h = d.select("doc_id", op7.row_hash(d, op7.SEED).alias("h")).collect()
    assert len({r.h for r in h}) == 400
    want = plain_shuffle([(r.h % n, (r.doc_id, r.h), r.doc_id) for r in h], n, op7.SEED, 8)
    got = sorted((r.doc.doc_id, r.shard, r.slot) for r in op7.shuffled(d, bucket_bytes=bytes_).collect())
    assert got == want and (n > 10 or bytes_ > 3000)


def test_op7_query(spark):
    """The query over its whole table: sizes, checksums, the law, slots without gaps."""
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = op7.op7_shards(spark, SF).collect()
    assert {r.doc_id: (r["size"], r.text_crc32, r.law, r.grown_shard) for r in got} == {i: (len(t) + 1, zlib.crc32(t), "rows", None) for i, t in docs.items()}
    for s in range(8):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots))) and abs(len(slots) - len(docs) / 8) < 1


def test_op7_hot_rows_and_nested_columns(spark):
    d = spark.createDataFrame([(7, "same", {"a": i}, [i], (i, "x")) for i in range(300)] + [(None, None, None, None, None)] * 3, "doc_id long, text string, m map<string,int>, a array<int>, s struct<p:int,q:string>")
    got = op7.shuffled(d, bucket_bytes=400)
    assert got.count() == 303 and sorted((r.shard, r.slot) for r in got.collect()) == sorted((p % 8, p // 8) for p in range(303))
    sizes = d.groupBy(F.pmod(op7.row_hash(d, op7.SEED), F.lit(20))).count()
    assert sizes.agg(F.max("count")).first()[0] < 40


def test_op7_fisher_yates_is_fair():
    n = np.zeros((4, 4))
    for k in range(4000):
        n[np.arange(4), op7.fisher_yates(4, np.random.default_rng(k))] += 1
    assert abs(n / 4000 - 0.25).max() < 0.03
    assert op7.fisher_yates(0, np.random.default_rng(0)).tolist() == [] and op7.fisher_yates(1, np.random.default_rng(0)).tolist() == [0]


# 8


def plain_scan(text, templates):
    """All units and all windows against all templates, by sets."""
    toks = lambda x: re.findall(r"[^\W_]+", x.lower())
    grams = lambda w: {(w[k], w[k + 1]) for k in range(len(w) - 1)}
    spans, words, para, n_para = [], [], None, 0
    for line in text.split("\n") + [""]:
        w = toks(line)
        if w:
            para = (len(words), 0) if para is None else para
            spans.append((len(words), len(words) + len(w)))
            words += w
            para = (para[0], para[1] + 1)
        elif not line.strip() and para:
            if para[1] > 1:
                spans.append((para[0], len(words)))
            para, n_para = None, n_para + 1
    if n_para > 1:
        spans.append((0, len(words)))
    found = []
    for lo, hi in spans:
        best = None
        for name, t in templates:
            a, b = grams(words[lo:hi]), grams(toks(t))
            d = 2 * len(a & b) / (len(a) + len(b)) if a and b else 0
            if d >= op8.THRESHOLD and (best is None or d > best[1]):
                best = (len(a & b), d, name, lo, hi - 1)
        found += [best] if best else []
    for name, t in templates:
        b, n = grams(toks(t)), len(toks(t))
        for lo in range(max(1, len(words) - n + 1)):
            a = grams(words[lo : lo + n])
            d = 2 * len(a & b) / (len(a) + len(b)) if a and b else 0
            if d >= op8.THRESHOLD:
                found.append((len(a & b), d, name, lo, min(lo + n, len(words)) - 1))
    kept = []
    for x in sorted(found, key=lambda x: (-x[0], -x[1], x[3], x[2], x[4])):
        if not any(x[3] < y[4] and y[3] < x[4] for y in kept):
            kept.append(x)
    return [(x[2], x[1]) for x in sorted(kept, key=lambda x: (x[3], x[4], x[2]))]


def test_op8_against_brute_force():
    rng = random.Random(2)
    some = [x for x in op8.default_templates() if len(x[1]) < 400][::9] + [(k, v) for k, v in op8.license_texts().items() if k in ("BSD-2-Clause", "BSD-3-Clause", "MIT")]
    some.sort()
    s = op8.Scanner(some)
    found = 0
    for _ in range(120):
        text = []
        for _ in range(rng.randrange(1, 4)):
            w = rng.choice(some)[1].split(" ")
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = "changed"
            around = [" ".join(rng.choice(("some", "prose", "of", "the", "license")) for _ in range(rng.randrange(6))) for _ in range(2)]
            text += [around[0], " ".join(w), around[1], rng.choice(("\n", "\n\n", " ", " - \n"))]
        text = " ".join(text)
        got = s.text(text)
        assert got == plain_scan(text, some), text
        found += len(got)
    assert found > 150


def test_op8_bounds_prune():
    """Prose that shares words with licences is compared with few templates, if with any."""
    s = op8.Scanner()
    prose = "the work is licensed to the reader and the software is provided with the terms of the sale under the following conditions"
    assert len(s.hits(op8.bigrams(prose))) == 0 and s.text(prose) == [] and s.text(prose * 50) == []
    assert len(s.hits(op8.bigrams(op8.license_texts()["MIT"]))) < len(s.templates) / 20


@pytest.mark.parametrize("name", sorted(op8.license_texts()))
def test_op8_full_texts_are_told_apart(name):
    text = op8.license_texts()[name]
    s = op8.Scanner()
    assert {k for k, _ in s.text(text)} == {k for k, _ in s.text(f"prose of its own\n\n{text}\n\nx = 1, code\n")} == {name}


@pytest.mark.parametrize("text, want", [
    ("# Copyright 2020 Jane Doe. Licensed under the MIT License. All rights reserved.", ["MIT"]),
    ("prose. Released under the ISC License. prose", ["ISC"]),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License.", ["CC-BY-4.0"]),
    ("// SPDX-License-Identifier: BSD-3-Clause", ["BSD-3-Clause"]),
    ("x\n# SPDX-License-Identifier: LGPL-3.0-or-later\ny", ["LGPL-3.0"]),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", []),
    ("/* This program is free software: you can redistribute it and/or modify it\n * under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version. */", ["GPL-3.0"]),
    ("Anyone may read the licence of this work under the terms that the house has set.", []),
])
def test_op8_notices(text, want):
    assert sorted({k for k, _ in op8.Scanner().text(text)}) == want


def test_op8_units_and_edges(spark):
    mit = op8.license_texts()["MIT"].split()
    wrapped = "\n".join(" ".join(mit[i : i + 9]) for i in range(0, len(mit), 9))
    rows = [(20, f"prose\n\n{wrapped}\n\nprose", "s"), (21, "x\nLicensed under CC BY-NC 4.0.", "s"), (22, "Released under the MIT License.\nReleased under the MIT License.", "s"), (23, f"{LONG}\nReleased under the MIT License.", "s"), *EDGE]
    got = {r.doc_id: r for r in op8.scan(docs_of(spark, rows)).collect()}
    assert got[20].licenses == ["MIT"] and got[21].licenses == ["CC-BY-NC-4.0"] and got[22].n_matches == 2 and got[23].licenses == ["MIT"]
    assert all(not got[i].licenses and got[i].best == 0 for i in range(1, 11))
    assert op8.scan(empty(spark)).count() == 0


def test_op8_query_against_brute_force(spark):
    """The query over its whole table: the same licences as a plain search of all lines for the notices' names."""
    got = {r.doc_id: r.licenses for r in op8.op8_licenses(spark, SF).collect()}
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    notices = {" ".join(re.findall(r"[^\W_]+", t.lower())): k for k, t in op8.default_templates() if len(t) < 120}
    assert set(got) == set(docs)
    for i, t in docs.items():
        assert got[i] == sorted({notices[x] for line in t.split("\n") if (x := " ".join(re.findall(r"[^\W_]+", line.lower()))) in notices}), i


# 9


def test_op9_water_fill():
    assert op9.water_fill([10, 10, 10], [5, 2, 1]) == [18.75, 7.5, 3.75]
    got = op9.water_fill([1, 100, 100], [5, 2, 1])
    assert got == [3.0, 132.0, 66.0]
    assert op9.water_fill([], []) == [] and op9.water_fill([0, 0], [5, 2]) == [0.0, 0.0]


def test_op9_takes_meet_targets(spark):
    rng = random.Random(8)
    rows = [*EDGE[:6], *((100 + i, "w " * rng.randrange(40), rng.choice("aaaaabbc") if i % 10 else None) for i in range(500))]
    d = docs_of(spark, rows)
    got = op9.takes(d).collect()
    assert len(got) == len(rows) and all(r.taken <= 3 * r["size"] for r in got)
    total = sum(r["size"] for r in got)
    by = {}
    for r in got:
        t = by.setdefault((r.source_size, r.target), [0, 0])
        t[0] += r.taken
    assert abs(sum(t for _, t in by) - total) < 1e-3
    assert all(abs(v[0] - t) <= 2 for (_, t), v in by.items())
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, op9.takes(d.repartition(3)).collect()), key=str)
    assert op9.takes(empty(spark)).count() == 0


def test_op9_mixture_holds_the_words_taken(spark):
    d = docs_of(spark, [(i, " ".join(f"w{k}" for k in range(i % 13)), "abc"[i % 3]) for i in range(200)])
    want = {r.doc_id: r.taken for r in op9.takes(d).collect() if r.taken}
    m = op9.mix(d)
    assert m.columns == d.columns
    got = {}
    for r in m.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(r.text.split())
    assert got == want
    assert op9.mix(empty(spark)).count() == 0 and op9.mix(edge(spark)).count() > 0


# 10


def plain_log_prob(flat, g, ctx, y):
    """Log probability of class y beside the classes ctx, by loops over the network's weights."""
    at, p = 0, {}
    for name, shape in op10._shapes(g):
        n = int(np.prod(shape))
        p[name], at = np.asarray(flat[at : at + n], float).reshape(shape), at + n
    assert at == len(flat)
    x = [v for c in ctx for v in p["e"][c]]
    h = [np.tanh(p["b"][j] + sum(x[i] * p["w"][i][j] for i in range(len(x)))) for j in range(op10.HIDDEN)]
    outer = [p["a"][k] + sum(h[j] * p["u"][k][j] for j in range(op10.HIDDEN)) for k in range(g)]
    inner = [p["c"][y % g][k] + sum(h[j] * p["v"][y % g][k][j] for j in range(op10.HIDDEN)) for k in range(g)]
    return outer[y % g] - np.log(sum(np.exp(outer))) + inner[y // g] - np.log(sum(np.exp(inner)))


@pytest.mark.parametrize("g", [3, 16])
def test_op10_gradient(g):
    rng = np.random.default_rng(1)
    w = op10.start_weights(g=g).astype(np.float64) * 3
    assert op10.side_of(w) == g
    for n in (1, 200):
        ctx, y = rng.integers(0, g * g + 1, (n, 4)), rng.integers(0, g * g, n)
        assert np.allclose(op10.log_probs(w, ctx, y)[:5], [plain_log_prob(w, g, c, k) for c, k in zip(ctx[:5], y[:5], strict=True)])
        d = op10.gradient(w, ctx, y, g)
        for i in [*rng.integers(0, len(w), 25).tolist(), int(np.abs(d).argmax())]:
            e = np.zeros_like(w)
            e[i] = 1e-5
            n = -(op10.log_probs(w + e, ctx, y).mean() - op10.log_probs(w - e, ctx, y).mean()) / 2e-5
            assert abs(n - d[i]) < 1e-6
    total = sum(np.exp(op10.log_probs(w, ctx[:5], np.full(5, k))) for k in range(g * g))
    assert np.allclose(total, 1)


def plain_model(docs, cached):
    """Classes and log shares of words by plain counting: (class of each word, log share)."""
    counts = {}
    for t in docs:
        for w in t:
            counts[w] = counts.get(w, 0) + 1
    g = op10.side(len(counts))
    half = g * g // 2
    order = sorted(counts, key=lambda w: (-counts[w], w))
    of = {w: i if i < half else half + zlib.crc32(w[-2:]) % (g * g - half) for i, w in enumerate(order)}
    total = {}
    for w, n in counts.items():
        total[of[w]] = total.get(of[w], 0) + n
    return g, of, {w: np.log(n / total[of[w]]) for w, n in counts.items()}


@pytest.mark.parametrize("cached", [70, 200_000])
def test_op10_against_brute_force(spark, monkeypatch, cached):
    """The query's log_prob and mean of every document, by a forward pass over its trained weights."""
    monkeypatch.setattr(op10, "CACHED", max(cached, op10.LEAST**2 // 2))
    weights, fit = [], op10.fit
    monkeypatch.setattr(op10, "fit", lambda *a, **k: (weights.append(fit(*a, **k)), weights[-1])[1])
    d = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 40")
    d = d.unionByName(d.limit(2).withColumn("doc_id", F.lit(None).cast("long"))).unionByName(d.limit(1).withColumn("text", F.lit(None).cast("string")))
    rows = [(r.doc_id, (r.text or "").encode().split()) for r in d.collect()]
    got = sorted(((r.doc_id or -1, r.n_words, r.log_prob, r.mean_log_prob) for r in op10.score(d).collect()), key=lambda r: r[:2])
    g, of, share = plain_model([t for _, t in rows], cached)
    want, rng = [], random.Random(1)
    for i, t in sorted(rows, key=lambda r: (r[0] or -1, len(r[1]))):
        ids = [g * g] * 2 + [of[w] for w in t] + [g * g] * 2
        ctx = [[ids[k], ids[k + 1], ids[k + 3], ids[k + 4]] for k in range(len(t))]
        lp = op10.log_probs(weights[0], np.array(ctx), np.array(ids[2:-2])) if t else np.zeros(0)
        for k in rng.sample(range(len(t)), min(2, len(t))):
            assert abs(lp[k] - plain_log_prob(weights[0], g, ctx[k], ids[k + 2])) < 1e-3
        total = sum(lp) + sum(share[w] for w in t)
        want.append((i or -1, len(t), total, total / len(t) if t else None))
    assert [r[:2] for r in got] == [r[:2] for r in want]
    for a, b in zip(got, want, strict=True):
        assert abs(a[2] - b[2]) <= 1e-4 * max(1, a[1]) and (a[3] is None) == (b[3] is None)
        assert a[3] is None or abs(a[3] - b[3]) < 1e-4


def test_op10_does_not_depend_on_the_splits(spark, monkeypatch):
    monkeypatch.setattr(op10, "SHARD_WORDS", 2000)
    monkeypatch.setattr(op10, "FAN", 2)
    d = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    a, b = ({r.doc_id: r.log_prob for r in op10.score(d.repartition(n)).collect()} for n in (1, 7))
    assert a.keys() == b.keys() and max(abs(a[i] - b[i]) for i in a) < 1e-6


def test_op10_learns_and_edges(spark):
    d = docs_of(spark, [(i, "the cat sat on the mat and the dog sat on the rug " * 20, "s") for i in range(40)] + [(100, "rug the on sat dog the and mat the on sat cat the " * 20, "s")])
    got = {r.doc_id: r.mean_log_prob for r in op10.score(d).collect()}
    assert got[0] > got[100]
    rows = op10.score(edge(spark)).collect()
    assert len(rows) == len(EDGE)
    assert all((r.log_prob, r.mean_log_prob) == (0.0, None) for r in rows if not r.n_words) and sum(not r.n_words for r in rows) == 4
    assert op10.score(empty(spark)).count() == 0


def test_op10_every_word_is_a_target_once(spark, monkeypatch):
    monkeypatch.setattr(op10, "SHARD_WORDS", 20)
    rows = [(i, " ".join(f"w{(i * 7 + j) % 90}" for j in range(i % 5 + 1)), "s") for i in range(60)]
    texts = docs_of(spark, rows).select("doc_id", F.col("text").cast("binary").alias("text"))
    vocab = op10.vocabulary(texts)
    codes = op10.encoded(texts, vocab)
    assert codes.select("shard").distinct().count() > 3 and vocab.words == sum(len(t.split()) for _, t, _ in rows)
    ids, at = op10._stream([bytes(r.ids) for r in codes.collect()], vocab.size)
    assert len(at) == vocab.words
    taken = np.concatenate([op10.targets(at, r, op10.ROUNDS) for r in range(op10.ROUNDS)])
    assert sorted(taken.tolist()) == at.tolist()
    seen = []
    checkpoint = op10.checkpoint
    monkeypatch.setattr(op10, "checkpoint", lambda df: (seen.append(sum(r.n for r in df.select("n").collect())), checkpoint(df))[1])
    op10.fit(codes, vocab.size)
    assert len(seen) == op10.ROUNDS and sum(seen) == len(at)


def test_op10_classes_follow_the_vocabulary(spark):
    assert op10.side(100) == op10.LEAST < op10.side(2_000_000) < op10.side(50_000_000)
    d = docs_of(spark, [(i, " ".join(f"v{i * 2500 + j}" for j in range(2500)), "s") for i in range(250)])
    v = op10.vocabulary(d.select("doc_id", F.col("text").cast("binary").alias("text")))
    assert v.size == op10.side(625_000) ** 2 > op10.LEAST**2 and max(c for c, _ in v.known.values()) >= op10.LEAST**2
    assert len({c for c, _ in v.known.values()}) <= v.size


# pipeline


def test_pipeline_stages(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    columns = d.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "near-duplicates", "decontamination", "mixture", "sharding"]
    stage = dict(corpus_pipeline.STAGES)
    labels, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    ids = lambda x: {r.doc_id for r in x.select("doc_id").collect()}
    good = stage["quality classifier"](spark, d, SF)
    assert good.columns == columns and ids(good) == ids(op3.classify(d, labels).where("predicted = 1"))
    one = stage["near-duplicates"](spark, d, SF)
    want = plain_components(plain_sets([(r.doc_id, r.text) for r in d.collect()]), 80)
    assert one.columns == columns and ids(one) == {i for i, c in want.items() if i == c}
    clean = stage["decontamination"](spark, d, SF)
    assert clean.columns == columns and ids(clean) == ids(d) - ids(op6.leaks(d, bench))
    assert stage["mixture"](spark, d, SF).columns == columns
    assert stage["sharding"](spark, d, SF).count() == d.count()


def test_pipeline_runs(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.count() > 50 and {"doc_id", "text", "shard", "slot"} <= set(got.columns)
    shared = op7.fresh_path(spark, "x").rsplit("/", 1)[0]
    assert [p for p in os.listdir(shared) if p.startswith("stage-")] == [got.inputFiles()[0].rsplit("/", 2)[-2]]


def test_pipeline_stages_take_edges(spark, tmp_path):
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    for d in (edge(spark), empty(spark)):
        for _, f in corpus_pipeline.STAGES:
            assert f(spark, d, str(tmp_path)).count() <= 3 * len(EDGE)


def test_pipeline_results_on_edges(spark, tmp_path):
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    stage, d = dict(corpus_pipeline.STAGES), edge(spark)
    ids = lambda name: sorted(r.doc_id or -1 for r in stage[name](spark, d, str(tmp_path)).select("doc_id").collect())
    everyone = sorted(i or -1 for i, _, _ in EDGE)
    assert ids("sharding") == ids("decontamination") == everyone
    # 4 and both rows of 5 are one group, and so are 8 and 9 (they differ in case)
    assert ids("near-duplicates") == sorted(i or -1 for i, _, _ in EDGE if i not in (5, 9))
    wordless = {i or -1 for i, t, _ in EDGE if not (t or "").split()} - {-1}
    assert not wordless & set(ids("mixture"))
    for name, f in corpus_pipeline.STAGES:
        none = f(spark, empty(spark), str(tmp_path))
        assert none.count() == 0 and set(d.columns) <= set(none.columns), name
