"""Secret scan: candidates judged by how many repositories and owners hold the same value.

``scan`` reads each whole text once and keeps, of every candidate, its span and a 128-bit hash of its value
(values don't leave the task). ``ownership`` counts the distinct repositories and owners of each hash over the
whole corpus; a value that ``OWNERS`` owners or ``REPOSITORIES`` repositories hold is a copied example, any other
looks like a live credential of its owner. ``find`` gives each document its spans: those of the base patterns, which
always stay, and those of the wider patterns (``private`` keys, mixed ``token`` runs) whose value looks live and that
overlap no base span.

Only candidates are shuffled, never texts. A value that is copied millions of times is reduced to its distinct
(repository, owner) pairs before it is counted, and its candidates meet the verdict in a join whose hot keys Spark
splits; a document's own spans meet again by a row number, so that ids that repeat don't mix.

Edge cases: a null text is empty; null repositories and null owners count as one each; every row gives one
row, repeated rows and null ids included (a row that is repeated has the same owner and adds none); equal starts are
ordered by kind; texts of any length are read whole; an empty table gives no rows; columns other than those named are
ignored, whatever their names. A base match whose value is too short is dropped but still hides what it covers.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, read_table

#: Kinds of spans in their order at equal starts; the first three are the base.
KINDS = ("assign", "access", "hex", "private", "token")
BASE = 3

# The base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_VALUE = 6

#: Every hex match and every token lies in such a run.
RUN = re.compile(r"[A-Za-z0-9+/_=-]{24,}")
CLASSES = tuple(re.compile(c) for c in ("[0-9]", "[a-z]", "[A-Z]"))
PRIVATE = re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----[^-]*-----END (?:[A-Z]+ )*PRIVATE KEY-----")
#: In lower case; a text without any of them has no assignment.
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Distinct owners, and distinct repositories, from which a value is a copied example.
OWNERS, REPOSITORIES = 3, 8

FOUND = "array<struct<start: bigint, kind: int, stop: bigint, hash: binary>>"


def candidates(text: str) -> list[tuple[int, int, int, str]]:
    """(start, place of the kind in KINDS, end, value) of a text, by start and kind; places are code points."""
    out = []
    low = text.lower()
    if any(x in low for x in NAMES):
        out += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    wide = []
    for run in RUN.finditer(text):
        out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text, run.start(), run.end())]
        if all(c.search(run[0]) for c in CLASSES):
            wide.append((run.start(), 4, run.end(), run[0]))
    if "-----BEGIN" in text:
        wide += [(m.start(), 3, m.end(), m[0]) for m in PRIVATE.finditer(text)]
    if wide:
        # base spans may overlap each other: what they cover, as separate stretches in order
        covered: list[list[int]] = []
        for s, _, e, _ in sorted(out):
            if covered and s <= covered[-1][1]:
                covered[-1][1] = max(covered[-1][1], e)
            else:
                covered.append([s, e])
        at = 0
        for x in sorted(wide):
            while at < len(covered) and covered[at][1] <= x[0]:
                at += 1
            if at == len(covered) or covered[at][0] >= x[2]:
                out.append(x)
    return sorted(out)


def scan(docs: DataFrame, repository: Column, owner: Column, text: str = "text") -> DataFrame:
    """doc_id, repository, owner, counts of the base kinds, base_sha256 and found (all candidates of the row)."""

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, shas, found = ([], [], []), [], []
            for t in b.column(3):
                c = candidates(t.as_py())
                base = [x for x in c if x[1] < BASE]
                for k in range(BASE):
                    counts[k].append(sum(x[1] == k for x in base))
                shas.append(hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in base).encode()).hexdigest())
                found.append([{"start": s, "kind": k, "stop": e, "hash": hashlib.blake2b(v.encode(), digest_size=16).digest()} for s, k, e, v in c])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("stop", pa.int64()), ("hash", pa.binary())]))
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:3], *(pa.array(c, pa.int64()) for c in counts), pa.array(shas, pa.string()), pa.array(found, kind)],
                ["doc_id", "repository", "owner", "n_assign", "n_access", "n_hex", "base_sha256", "found"],
            )

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), repository.cast("string").alias("repository"), owner.cast("string").alias("owner"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return d.mapInArrow(scanned, f"doc_id long, repository string, owner string, n_assign long, n_access long, n_hex long, base_sha256 string, found {FOUND}")


def ownership(spans: DataFrame, owners: int = OWNERS, repositories: int = REPOSITORIES) -> DataFrame:
    """hash, n_owners, n_repositories, live: of each candidate value (hash, repository, owner; any number of rows)."""
    held = spans.select("hash", F.struct("repository", "owner").alias("r"), F.struct("owner").alias("o")).distinct()
    counts = held.groupBy("hash").agg(F.count_distinct("o").alias("n_owners"), F.count_distinct("r").alias("n_repositories"))
    return counts.withColumn("live", (F.col("n_owners") < owners) & (F.col("n_repositories") < repositories))


def find(docs: DataFrame, repository: Column, owner: Column, text: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example of each row of docs."""
    keys = ["__row", "doc_id", "n_assign", "n_access", "n_hex", "base_sha256"]
    d = checkpoint(scan(docs, repository, owner, text).withColumn("__row", F.monotonically_increasing_id()))
    each = d.where(F.size("found") > 0).select(*keys, "repository", "owner", F.inline("found"))
    judged = each.join(ownership(each).select("hash", "live"), "hash").where((F.col("kind") < BASE) | F.col("live"))
    written = F.transform(F.array_sort("x"), lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1), x["start"].cast("string"), x["stop"].cast("string")))
    some = judged.groupBy(*keys).agg(F.collect_list(F.struct("start", "kind", "stop")).alias("x"), F.count_if("live").alias("n_live"), F.count_if(~F.col("live")).alias("n_example"))
    columns = [*keys[1:], "spans", "n_live", "n_example"]
    # a row whose candidates are all wide and copied has no span left
    kept = d.select(*keys, F.size("found").alias("__found")).where("__found > 0").join(some.select("__row", F.array_join(written, ",").alias("spans"), "n_live", "n_example"), "__row", "left")
    kept = kept.select(*keys[1:], F.coalesce("spans", F.lit("")).alias("spans"), *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in columns[-2:]))
    return kept.unionByName(d.where(F.size("found") == 0).select(*keys[1:], F.lit("").alias("spans"), *(F.lit(0).cast("long").alias(c) for c in columns[-2:])))


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owners are sources; a source's documents in one language stand for one repository, as the table has none."""
    return find(read_table(spark, sf_dir, "documents"), F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit(""))), F.col("source"))


_ASSIGN_SQL = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?"""
_PRIVATE_SQL = r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----[^-]*-----END (?:[A-Z]+ )*PRIVATE KEY-----"

# A match starts after what was split off before it and the matches before it.
ORACLE = rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, source, concat(coalesce(source, ''), '/', coalesce(lang, '')) AS repo, coalesce(text, '') AS text FROM documents),
p(kind, pattern) AS (VALUES (0, '{_ASSIGN_SQL}[A-Za-z0-9+/_.=-]+'), (1, 'AKIA[A-Z0-9]+'), (2, '[0-9a-f]+'), (3, '{_PRIVATE_SQL}'), (4, '[A-Za-z0-9+/_=-]+')),
m AS (
  SELECT r, doc_id, source, repo, kind, regexp_extract_all(text, pattern) AS ms, string_split_regex(text, pattern) AS ps FROM t, p),
l AS (SELECT *, list_transform(ms, lambda x: length(x)) AS ml, list_transform(ps, lambda x: length(x)) AS pl FROM m WHERE len(ms) > 0),
u AS (SELECT r, doc_id, source, repo, kind, unnest(ms) AS v, unnest(ml) AS n, unnest(pl[1:len(ml)]) AS gap, generate_subscripts(ms, 1) AS i FROM l),
s AS (
  SELECT r, doc_id, source, repo, kind, n, CASE kind WHEN 0 THEN regexp_replace(v, '^{_ASSIGN_SQL}', '') ELSE v END AS v,
    (sum(gap + n) OVER (PARTITION BY r, kind ORDER BY i))::BIGINT - n AS s FROM u),
a AS (
  SELECT r, doc_id, source, repo, kind, s, s + n AS e, v FROM s
  WHERE CASE kind WHEN 0 THEN length(v) >= 6 WHEN 1 THEN n >= 20 WHEN 2 THEN n >= 24 WHEN 4 THEN n >= 24 AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]') ELSE true END),
c AS (SELECT * FROM a WHERE kind < 3 OR NOT EXISTS (SELECT 1 FROM a b WHERE b.r = a.r AND b.kind < 3 AND b.s < a.e AND a.s < b.e)),
o AS (SELECT v, count(DISTINCT coalesce('x' || source, '')) < 3 AND count(DISTINCT concat(coalesce('x' || source, ''), repo)) < 8 AS live FROM c GROUP BY v),
j AS (SELECT r, kind, s, e, live, ['assign', 'access', 'hex', 'private', 'token'][kind + 1] || ':' || s || ':' || e AS w FROM c JOIN o USING (v) WHERE kind < 3 OR live),
g AS (
  SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    string_agg(w, ',' ORDER BY s, kind) FILTER (kind < 3) AS base, string_agg(w, ',' ORDER BY s, kind) AS spans,
    count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_example
  FROM j GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
FROM t LEFT JOIN g USING (r)
"""
