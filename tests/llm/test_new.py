"""Secret scan, conversation repair and Merkle manifest: edge cases and brute force."""

import hashlib
import random
import re
import string
import time
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF
from pyspark.sql import functions as F

import corpus_pipeline
from tesserae.llm import op6_decontaminate as op6
from tesserae.llm import op7_shards as op7
from tesserae.llm import op8_licenses as op8
from tesserae.llm import op10_lm_score as op10
from tesserae.llm import op11_secrets as op11
from tesserae.llm import op12_conversations as op12
from tesserae.llm import op13_merkle as op13

LONG = " ".join(f"word{i % 977}x{i}" for i in range(25_000))
DOCS = "doc_id long, text string, lang string, source string, n_chars long, hash string, key string, at int, n string, digest string, live int, kind string, found string, level int"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, n, "h", "k", 1, "n", "d", 2, "k", "f", 3) for i, t, lang, s, n in rows], DOCS)


# 11


def plain_spans(text):
    """Base and wide spans with values, by patterns over the whole text one after the other."""
    keyword = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    out = []
    for m in re.finditer(rf"""(?:{keyword})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[1]) >= 6:
            out.append((m.start(), 0, m.end(), m[1]))
    for k, (pattern, least) in enumerate((("AKIA[A-Z0-9]+", 20), ("[0-9a-f]+", 24)), 1):
        out += [(m.start(), k, m.end(), m[0]) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    wide = [(m.start(), 4, m.end(), m[0]) for m in re.finditer("[A-Za-z0-9+/_=-]+", text) if len(m[0]) >= 24 and re.search(r"[0-9]", m[0]) and re.search("[a-z]", m[0]) and re.search("[A-Z]", m[0])]
    wide += [(m.start(), 3, m.end(), m[0]) for m in op11.PRIVATE.finditer(text)]
    return sorted(out), sorted(w for w in wide if all(b[2] <= w[0] or w[2] <= b[0] for b in out))


def plain_secrets(rows):
    spans = [(i, plain_spans(t or ""), lang, s) for i, t, lang, s, _ in rows]
    owners, repos = defaultdict(set), defaultdict(set)
    for _, (base, wide), lang, s in spans:
        for x in base + wide:
            owners[x[3]].add(s)
            repos[x[3]].add((lang, s))
    live = {v: len(owners[v]) < op11.OWNERS and len(repos[v]) < op11.REPOSITORIES for v in owners}
    out = []
    for i, (base, wide), _, _ in spans:
        said = lambda xs: ",".join(f"{op11.KINDS[k]}:{s}:{e}" for s, k, e, _ in sorted(xs))
        kept = base + [x for x in wide if live[x[3]]]
        out.append((-1 if i is None else i, *(sum(x[1] == k for x in base) for k in range(3)), hashlib.sha256(said(base).encode()).hexdigest(), said(kept), sum(live[x[3]] for x in kept), sum(not live[x[3]] for x in kept)))
    return sorted(out)


def secret_rows():
    rng = random.Random(11)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(n)) for n in (23, 24, 40)]
    mixed = ["aB3" + "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(30)) for _ in range(4)]
    key = "-----BEGIN RSA PRIVATE KEY-----\nMIIabc\n-----END RSA PRIVATE KEY-----"
    rows = [
        (1, None, "en", "a", 0), (2, "", None, None, 0), (3, "token=abcde token=abcdef", "en", "a", 1), (3, "token=abcde token=abcdef", "en", "a", 1), (None, "SeCrEt: 'x.y=z-1'", "en", None, 1),
        (4, "paſſword=abcdef toKen=abcdefg", "en", "a", 1), (5, "😀 é password = \"hunter22\" " + hexes[1], "fr", "b", 1), (6, hexes[0] + " " + hexes[0] + "g", "en", "a", 1), (7, f"x{hexes[2]}G", "en", "b", 1),
        (8, "AKIA" + "A" * 15 + " AKIA" + "B" * 16 + " AKIAAKIA" + "C" * 12, "en", "a", 1), (9, f"api_key:{mixed[0]} {mixed[1]}", "en", "a", 1), (10, key + " " + mixed[1], "en", "a", 1), (11, LONG + " passwd=" + hexes[2] + LONG, "en", "b", 1),
        (12, "token=api_key=abcdefgh secret=a:password=longvalue apikey='q", "en", "c", 1), *((20 + i, f"see {mixed[2]} here", "en", f"owner{i}", 1) for i in range(3)), *((30 + i, f"see {mixed[3]} here", f"l{i}", "one", 1) for i in range(8)),
    ]
    alphabet = ["token", "SECRET", "=", ":", " ", '"', "AKIA", "Z9", "é", "😀", "ab", "12", *hexes, *mixed, "-", "\n"]
    return rows + [(100 + i, "".join(rng.choice(alphabet) for _ in range(rng.randrange(30))), rng.choice(["en", "fr", None]), rng.choice(["a", "b", "c", "d", None]), 1) for i in range(150)]


def test_op11_equals_brute_force(spark):
    rows = secret_rows()
    got = op11.find(docs_of(spark, rows), F.struct("lang", "source"), F.col("source"))
    want = plain_secrets(rows)
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got.collect()) == want
    assert op11.find(docs_of(spark, []), F.col("lang"), F.col("source")).count() == 0


def test_op11_separates_copied_examples(spark):
    value = "aB3" + "x" * 30
    d = docs_of(spark, [(i, f"a {value} b", "en", f"s{i % 2}", 1) for i in range(6)])
    assert {r.spans for r in op11.find(d, F.col("source"), F.col("source")).collect()} == {f"token:2:{2 + len(value)}"}
    d = docs_of(spark, [(i, f"a {value} b", "en", f"s{i % 3}", 1) for i in range(6)])
    assert {r.spans for r in op11.find(d, F.col("source"), F.col("source")).collect()} == {""}
    # a base span stays, and is told to be an example
    d = docs_of(spark, [(i, f"token={value}", "en", f"s{i}", 1) for i in range(3)])
    assert {(r.spans, r.n_live, r.n_example) for r in op11.find(d, F.col("source"), F.col("source")).collect()} == {(f"assign:0:{6 + len(value)}", 0, 1)}


# 12


def plain_repair(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, hash) of damaged rows (turn, role, text) by whole strings for each state."""
    white = " \t\n\x0b\x0c\r"
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:64], hashlib.md5(r[2].encode()).hexdigest()))
    there = {r[0] for r in rows if r[0] is not None}
    seen, kinds = set(), []
    for _, role, text in rows:
        t = text.rstrip(white)
        kinds.append("blank" if not t else "duplicate" if (role, text) in seen else "truncated" if t[-1] not in ".!?" else "")
        seen.add((role, text))
    first = [r[1][:1] for r in rows]
    counts = [sum(k == x for k in kinds) for x in ("blank", "duplicate", "truncated")] + [sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:], strict=False))]
    # a state is what may follow: (s or u), u, a, u; best: cost, audit, lines
    after = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}

    def filled(best):
        for _ in range(3):
            for q, (c, a, lines) in list(best.items()):
                for role in ("user", "assistant"):
                    if (q, role[0]) in after:
                        to, new = after[q, role[0]], (c + 3, a + "I", [*lines, f"{role}:"])
                        best[to] = min(best.get(to, new), new, key=lambda x: x[:2])
        return best

    best = filled({0: (0, "", [])})
    for (_, role, text), kind in zip(rows, kinds, strict=True):
        nxt = {}

        def put(q, new):
            nxt[q] = min(nxt.get(q, new), new, key=lambda x: x[:2])  # noqa: B023

        for q, (c, a, lines) in best.items():
            put(q, (c + 4, a + "D", lines))
            if kind in ("blank", "duplicate"):
                continue
            more = 3 * (kind == "truncated")
            if (q, role[:1]) in after:
                put(after[q, role[:1]], (c + more, a + "K", [*lines, f"{role}:{text}"]))
            for new in ("user", "assistant"):
                if (q, new[0]) in after:
                    put(after[q, new[0]], (c + 3 + more, a + "R", [*lines, f"{new}:{text}"]))
        best = filled(nxt)
    cost, audit, lines = min((best[q] for q in (0, 3) if q in best), key=lambda x: x[:2])
    assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))
    return (max(there) - min(there) + 1 - len(there) if there else 0, *counts, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def plain_damage(rows):
    out = []
    for c, t, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        n = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if n == 1 else re.sub("[.!?]", "", text) if n == 2 else text
        out += [(c, t, "user" if n == 4 else role, text)] * (0 if n == 0 else 2 if n == 3 else 1)
    return out


CONVERSATIONS = "conv_id long, turn long, role string, text string, c0 string, p string, cost string, audit int"


def conversations_of(spark, rows):
    return spark.createDataFrame([(*r, "c", "p", "q", 1) for r in rows], CONVERSATIONS)


def conversation_rows():
    rng = random.Random(12)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "Used", "ambassador"]
    texts = ["Hi.", "Yes!", "no end", "", " \t", "Why? ", "é😀.", None, "a.\nb", "x" * 70 + "1.", "x" * 70 + "2."]
    rows = [(c, rng.choice([None, *range(8)]) if rng.random() < 0.3 else i, rng.choice(roles[: rng.choice([2, 3, 10])]), rng.choice(texts)) for c in range(120) for i in range(rng.randrange(9))]
    rows += [(None, i, ("user", "assistant")[i % 2], f"t{i}.") for i in range(6)] + [(900, 0, "user", "again.")] * 30 + [(901, None, None, None)] * 3
    return rows


def check_conversations(spark, rows):
    damaged = defaultdict(list)
    for c, t, role, text in plain_damage(rows):
        damaged[c].append((t, role, text))
    want = {c: plain_repair(damaged[c]) for c in {r[0] for r in rows}}
    got = op12.repair_damaged(conversations_of(spark, rows)).collect()
    assert len(got) == len(want)
    assert {r.conv_id: tuple(r[1:]) for r in got} == want
    return want


def test_op12_equals_brute_force(spark):
    want = check_conversations(spark, conversation_rows())
    assert len({w[6] for w in want.values()}) > 40
    assert op12.repair_damaged(conversations_of(spark, [])).count() == 0


def test_op12_conversation_without_rows_after_damage(spark):
    c = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    (r,) = op12.repair_damaged(conversations_of(spark, [(c, 0, "user", "Hi.")])).collect()
    assert tuple(r) == (c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_op12_conversation_over_many_partitions(spark, monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(op12, "PIECE", 200)
    kinds = ["user", "assistant", "user", "assistant", "system", "tool"]
    rows = [(7, i, rng.choice(kinds), rng.choice(["Hi.", "no end", f"own {i}.", f"own {i}!", "", LONG[:500]])) for i in range(400)]
    rows += [(c, i, kinds[i % 2], f"t{i}.") for c in (1, 2, 9) for i in range(5)] + [(8, 3, "user", "same.")] * 200
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        d = op12.turns(op12.damage(conversations_of(spark, rows)))
        assert (1, 7) in op12.spanning(d) and d.where("c1 = 7").select("p").distinct().count() >= 3
        check_conversations(spark, rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_op12_macros_are_prefix_free_and_ordered():
    assert op12.MACROS == sorted(op12.MACROS)
    assert not any(a != b and b.startswith(a) for a in op12.MACROS for b in op12.MACROS)


# 13


def plain_tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        x = levels[-1]
        levels.append([hashlib.sha256("".join(x[i : i + 2]).encode()).hexdigest() for i in range(0, len(x), 2)])
    return levels


def plain_proof(levels, i):
    return [(x[i >> k ^ 1] if i >> k ^ 1 < len(x) else None, i >> k & 1) for k, x in enumerate(levels[:-1])]


def plain_manifest(rows):
    said = lambda *xs: hashlib.sha256("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in xs).encode()).hexdigest()
    by = defaultdict(list)
    for i, t, lang, s, n in rows:
        leaf = said(i, s, lang, n, t)
        changed = i is not None and n is not None and zlib.crc32(str(i).encode()) % 7 == 0
        by[lang].append((i, leaf, said(i, s, lang, n + 1, t) if changed else leaf))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        by[lang].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[lang] = plain_tree([x[1] for x in by[lang]])
    upper = plain_tree([trees[lang][-1][0] for lang in langs])
    out = []
    for k, lang in enumerate(langs):
        for at, (i, leaf, start) in enumerate(by[lang]):
            proof = plain_proof(trees[lang], at) + plain_proof(upper, k)
            h = start
            for sibling, right in proof:
                h = hashlib.sha256((sibling + h if right and sibling else h + (sibling or "")).encode()).hexdigest()
            said_proof = hashlib.sha256("".join(x for x, _ in proof if x).encode()).hexdigest()
            out.append((-(10**9) if i is None else i, leaf, trees[lang][-1][0], upper[-1][0], said_proof, h, h == upper[-1][0]))
    return sorted(out)


def merkle_rows():
    rows = [(i, f"text {i}", ("en", "de", None, "", "z", "é", "Z")[0 if i < 150 else i % 7], f"s{i % 3}", i) for i in range(260)]
    return [*rows, (5, "text 5", "en", "s2", 5), (5, "other", "en", None, None), (None, None, None, None, None), (None, "x", "en", "s", 3), (-7, "", "xx", "", 0), (900, LONG, "en", "s", 2**62)] + [(77, "copy", "fr", "s", 4)] * 20


@pytest.mark.parametrize("run", [2, 3, 10])
def test_op13_equals_brute_force(spark, monkeypatch, run):
    monkeypatch.setattr(op13, "RUN", run)
    rows = merkle_rows()
    got = op13.manifest(op13.leaves_of(docs_of(spark, rows))).collect()
    assert sorted((-(10**9) if r[0] is None else r[0], *r[1:]) for r in got) == plain_manifest(rows)
    assert {r.verified for r in got} == {True, False}


def test_op13_small_tables(spark):
    assert op13.manifest(op13.leaves_of(docs_of(spark, []))).count() == 0
    for rows in ([(1, "a", "en", "s", 1)], [(1, "a", "en", "s", 1), (2, "b", "de", "s", 1)], [(i, "a", "en", "s", 1) for i in range(3)]):
        got = [tuple(r) for r in op13.manifest(op13.leaves_of(docs_of(spark, rows))).collect()]
        assert sorted(got) == plain_manifest(rows)


def test_op13_finds_a_changed_node(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(op13, "RUN", 2)
    leaves = op13.number(op13.leaves_of(docs_of(spark, [(i, f"t{i}", "en", "s", 1) for i in range(20)])).select(F.lit("=en").alias("key"), "id", "digest"))
    store = op13.grow(leaves, 20)
    assert [op13.stored(spark, store, k).count() for k in range(6)] == [20, 10, 5, 3, 2, 1]
    siblings = "".join(h for h, _ in plain_proof(plain_tree([r.digest for r in leaves.orderBy("at").collect()]), 19) if h)
    root = op13.subroots(store, leaves, 20).first().digest
    own = leaves.where("at = 19").first().digest
    assert op13.fold(own, 19, 20, 0, 1, siblings) == root != op13.fold(own, 19, 20, 0, 1, siblings[::-1])
    with pytest.raises(ValueError):
        op13.fold(own, 19, 20, 0, 1, siblings[64:])


# names and types in other operators


def test_op6_common_phrases_pair_nothing(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice(string.ascii_lowercase) for _ in range(6))
    phrase = "all rights reserved by the owner"
    texts = [(i, " ".join([*(word() for _ in range(30)), phrase, *(word() for _ in range(30))]), "en", "s", 1) for i in range(120)]
    items = [(i, " ".join([*(word() for _ in range(12)), phrase, *(word() for _ in range(12))])) for i in range(40)]
    texts.append((500, "x " + items[7][1] + " y", "en", "s", 1))
    half = items[9][1].split()
    texts.append((501, " ".join(half[20:] + ["q"] + half[8:19]), "en", "s", 1))
    bench = spark.createDataFrame(items, "item_id long, text string")
    known = op6.items_of(bench)
    found = spark.createDataFrame([(str(i), [int(x) for x in op6.seeds(op6.numbers(t), 5).view("int64")]) for i, t, *_ in texts], "digest string, seeds array<long>")
    # the whole benchmark's seeds pass for each text: only the two that cover an item are paired
    assert sorted(r.digest for r in op6.candidates(found, known).collect()) == ["500", "501"]
    assert {r.doc_id: r.item_ids for r in op6.leaks(docs_of(spark, texts), bench).collect()} == {500: [7], 501: [9]}


@pytest.mark.parametrize("coverage", [0.2, 0.5, 0.8, 1.0])
def test_op6_candidates_lose_nothing(spark, coverage):
    rng = random.Random(int(coverage * 10))
    words = [f"w{i}" for i in range(9)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, text(rng.choice([2, 4, 5, 6, 9, 14, 30]))) for i in range(25)]
    docs = []
    for i in range(60):
        w = text(rng.randrange(30)).split()
        for _ in range(rng.randrange(4)):
            x = rng.choice(items)[1].split()
            a = rng.randrange(len(x))
            w += x[a : a + rng.randrange(1, 20)] + text(rng.randrange(3)).split()
        docs.append((i, " ".join(w), "en", "s", 1))
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {}
    for i, t, *_ in docs:
        for k, x in items:
            x = op6.tokens(x)
            if op6.covered(op6.tokens(t), x)[1] >= coverage * len(x):
                want.setdefault(i, set()).add(k)
    assert {r.doc_id: set(r.item_ids) for r in op6.leaks(docs_of(spark, docs), bench, coverage).collect()} == want and want


def test_op6_bitmap_in_segments(spark, monkeypatch):
    monkeypatch.setattr(op6, "SEGMENT", 16)
    items = op6.items_of(spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(12))) for i in range(30)], "item_id long, text string").repartition(5))
    bitmap = op6.bitmap_of(items, 14)
    found = [x for r in items.collect() for x in r.seeds]
    assert len(op6.in_bitmap(bitmap, np.array(found, np.int64).view(np.uint64), 14)) == len(found)
    assert np.unpackbits(bitmap).sum() <= len(found) * 8


#: Names that the library uses inside.
INNER = "__gone __digest __of __source __take cut doc key digest __text h id bucket slot_ __row __n item seeds n w size rank cum taken needed __h row hash ids share rest"


def test_pipeline_takes_inner_names_and_nested_maps(spark, tmp_path):
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    d = spark.read.parquet(f"{SF}/documents.parquet").limit(60).select("*", *(F.col("doc_id").alias(c) for c in INNER.split()))
    maps = F.create_map(F.lit("k"), F.col("doc_id"))
    d = d.withColumns({"in_array": F.array(maps), "in_struct": F.struct(maps.alias("m")), "plain": maps, "deep": F.array(F.struct(F.array(maps).alias("x")))})
    d.write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert set(d.columns) <= set(out.columns)
    rows = out.collect()
    assert rows and all(r["__gone"] == r["doc_id"] == r["in_array"][0]["k"] == r["deep"][0]["x"][0]["k"] for r in rows)


def test_op7_maps_anywhere(spark):
    maps = F.create_map(F.lit("k"), F.col("doc_id"))
    d = docs_of(spark, [(i, "t", "en", "s", 1) for i in range(40)]).withColumns({"a": F.array(maps), "b": F.struct(F.array(maps).alias("m")), "c": F.when(F.col("doc_id") > 5, maps)})
    got = op7.shuffled(d).select("doc.doc_id", "shard", "slot").collect()
    assert sorted(r.doc_id for r in got) == list(range(40)) and len({(r.shard, r.slot) for r in got}) == 40
    assert op7.row_hash(d, 1) is not None and d.select(op7.row_hash(d, 1).alias("h")).distinct().count() == 40


def test_op10_beats_word_frequencies_on_texts_it_has_not_seen(spark):
    net, plain, n = op10.held_out(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    assert n > 10_000 and net > plain + 0.3


def test_op8_finds_every_repeat_inside_longer_lines():
    notice = op8.license_texts()["Apache-2.0"]
    s = op8.Scanner()
    short = next(t for k, t in op8.default_templates() if k == "Apache-2.0" and 15 < len(t.split()) < 200)
    line = " ".join(short.split())
    one = s.text(f"words before {line} words after")
    assert [k for k, _ in one] == ["Apache-2.0"]
    for gap in ("", "and in another place again "):
        assert [k for k, _ in s.text(f"words before {line} {gap}{line} {gap}{line} words after")] == ["Apache-2.0"] * 3
    flat = " ".join(notice.split())
    assert [k for k, _ in s.text(f"x {flat} y {flat} z")].count("Apache-2.0") == 2
    began = time.time()
    assert len(s.text("Released under the MIT License.\n" * 12_000)) == 12_000 and time.time() - began < 20


def test_op10_encodes_whole_columns_and_as_single_words_would_be():
    """Odd texts as bytes.split() cuts them, in any slices; and in less than two thirds of the time of a loop over words."""
    rng = np.random.default_rng(5)
    odd = [b"", b"  ", b"\x1c a\x1db\x85\xa0c\x0b\x0cd ", b"\xff\xfe x", bytes(range(256)), "\u2003é\u3000".encode(), b" a " * 50]
    texts = odd + [b" ".join(b"w%d" % k for k in rng.zipf(1.3, 400) % 100_000) for _ in range(500)]
    counts = {}
    for t in texts:
        for w in t.split():
            counts[w] = counts.get(w, 0) + 1
    column = pa.RecordBatch.from_arrays([pa.array(range(len(texts) + 3)), pa.array([b"not this"] * 3 + texts, pa.binary())], ["doc_id", "text"]).slice(3)
    got = {}
    for b in op10._counted(iter([column, column.slice(0, 0)])):
        for w, n in zip(*b.to_pydict().values(), strict=True):
            got[w] = got.get(w, 0) + n
    assert got == counts
    top = sorted(counts, key=lambda w: (-counts[w], w))[:2000]
    of_ending = {}
    for w, n in counts.items():
        k = zlib.crc32(w[-2:]) % 128
        of_ending[k] = of_ending.get(k, 0) + n
    v = op10.Vocabulary([(w, counts[w]) for w in top], of_ending, 256)
    known = v.known

    def plainly(t):
        ids, share, rest = [256] * op10.SIDE, 0.0, []
        for w in t.split():
            x = known.get(w)
            if x is None:
                x = (v.ending_class(w), -v.total[v.ending_class(w)])
                rest.append(w)
            ids.append(x[0])
            share += x[1]
        return np.array(ids, np.uint16).tobytes(), share, rest

    def seconds(f):
        took = []
        for _ in range(5):
            start = time.process_time()
            f()
            took.append(time.process_time() - start)
        return min(took)

    want = [plainly(t) for t in texts]
    for most in (1, 3000, 16 << 20):
        out = [r for _, x in op10._pieces(column, 1, most) for r in zip(*(c.to_pylist() for c in v.encode(x)), strict=True)]
        assert [(a, c) for a, _, c in out] == [(a, c) for a, _, c in want]
        assert np.allclose([b for _, b, _ in out], [b for _, b, _ in want])
    assert seconds(lambda: v.encode(column.column(1))) < seconds(lambda: [plainly(t) for t in texts]) / 1.5
