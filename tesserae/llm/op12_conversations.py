"""Repair of conversations: the cheapest edits that give a conversation its structure, by rank-compressed dynamic programming.

A well-formed conversation is empty, or has an optional system turn and then user and assistant turns in pairs. A step
of the program takes one turn with one *macro*: up to two inserted turns and what happens to the turn itself. Macros are
written as in the audit (``IK``: insert, keep), and none is the beginning of another, so of two audits over the same turns
the less is the one whose first differing macro is less. So no audit is carried along: a state keeps its cost, the *rank* of its
audit among those of its layer, and which state it came from; ranks of the next layer follow from (rank, macro).
The audit and the repaired text are reconstructed afterwards from the parents.

A conversation of any share of the rows is cut into blocks by range partitions of (conversation, turn). For each
block at a partition's edge, a first pass finds cost and rank from every state before it to every state after it (at most
two blocks a partition, 16 pairs each); they are composed in the same order, and a second pass
reconstructs every block by itself. Only the hash of a repaired conversation has to be taken in order: of conversations that
span partitions the repaired text streams, in pieces, through one task each. Rows equal in all columns
are counted before anything is sorted; repeats of a text are found by aggregation, not in a window. A task holds
the rows of one conversation in one partition.

Edge cases: nulls are one space, in the role and text as in what is hashed to damage a row; a null conversation is one
conversation; null turns come first; rows of one turn are ordered by role, the text's first 64 characters and its MD5; an
empty or unknown role can't be kept; texts go through whole; a conversation without rows after damage has
zeros, an empty audit and the hash of the empty text; an empty table gives no rows; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CRC_TABLE_SQL, checkpoint, crc_sql, read_table

WHITE = " \t\n\x0b\x0c\r"
ENDS = ".!?"
#: What edits cost; a truncated turn that isn't deleted costs TRUNCATED more.
INSERT, DELETE, REROLE, TRUNCATED = 3, 4, 3, 3

# States: nothing yet, after the system turn, after a user's turn, after an assistant's turn.
START, SYSTEM, USER, ASSISTANT = range(4)
FINAL = (START, ASSISTANT)
#: The turn that may be written in a state, and the state after it.
NEXT = {START: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
#: A third insert would lead where the first did.
MOST_INSERTS = 2
#: Macros in the order of their letters; an insert before a deletion is never least.
MACROS = sorted(["D", *("I" * k + x for k in range(MOST_INSERTS + 1) for x in "KR")])
#: Bytes of repaired text in a row.
PIECE = 1 << 20


def inserts(state: int, k: int) -> tuple[int, list[str]]:
    """The state after k inserts, and their roles."""
    roles = []
    for _ in range(k):
        role, state = NEXT[state]
        roles.append(role)
    return state, roles


def moves(initial: str, forced: bool) -> list[list[tuple[int, int, int]]]:
    """For each state (macro, state after, cost) of a turn with this initial; forced: it must go."""
    out = []
    for state in range(4):
        of = [(MACROS.index("D"), state, DELETE)]
        for k in range(0 if forced else MOST_INSERTS + 1):
            at, _ = inserts(state, k)
            if initial == "s" and at == START:
                of.append((MACROS.index("I" * k + "K"), SYSTEM, k * INSERT))
            elif initial and initial == NEXT[at][0][0]:
                of.append((MACROS.index("I" * k + "K"), NEXT[at][1], k * INSERT))
            of.append((MACROS.index("I" * k + "R"), NEXT[at][1], k * INSERT + REROLE))
        out.append(of)
    return out


_MOVES = {(i, f): moves(i, f) for i in ("s", "u", "a", "") for f in (False, True)}
Turn = tuple[str, bool, bool, int]  # initial, must go, is truncated, rows that must go after it


class Layers:
    """Best (cost, rank) from each entry to each state after the turns so far, and the steps that lead there."""

    def __init__(self, entries: tuple[int, ...]):
        self.best = {(e, e): (0, 0) for e in entries}
        self.steps: list[dict[tuple[int, int], tuple[int, int]]] = []
        self.cost_of_more = 0

    def add(self, turn: Turn, keep_steps: bool = True) -> None:
        initial, forced, truncated, more = turn
        table = _MOVES[initial if initial in ("s", "u", "a") else "", forced]
        extra = TRUNCATED if truncated else 0
        found: dict[tuple[int, int], tuple[int, int, int, int]] = {}
        for (entry, state), (cost, rank) in self.best.items():
            for macro, to, price in table[state]:
                new = (cost + price + (extra if macro else 0), rank, macro, state)
                if (entry, to) not in found or new < found[entry, to]:
                    found[entry, to] = new
        order = {x: i for i, x in enumerate(sorted({v[1:3] for v in found.values()}))}
        self.best = {k: (v[0], order[v[1:3]]) for k, v in found.items()}
        if keep_steps:
            self.steps.append({k: v[2:] for k, v in found.items()})
        self.cost_of_more += more * DELETE

    def end(self, entry: int) -> tuple[int, int, int]:
        """(state, inserts at the end, cost) of the cheapest and least way from ``entry`` to a final state."""
        ways = [(cost + k * INSERT, rank, k, state) for (e, state), (cost, rank) in self.best.items() if e == entry for k in range(MOST_INSERTS + 1) if inserts(state, k)[0] in FINAL]
        cost, _, k, state = min(ways)
        return state, k, cost + self.cost_of_more

    def path(self, entry: int, state: int) -> list[tuple[int, int]]:
        """(macro, state before it) of each turn on the way to ``state``."""
        out = []
        for step in reversed(self.steps):
            macro, before = step[entry, state]
            out.append((macro, before))
            state = before
        return out[::-1]


assert MACROS[0] == "D"


def compose(blocks: list[list[tuple[int, int, int, int]]]) -> tuple[list[tuple[int, int]], int]:
    """Of a conversation's blocks (entry, state, cost, rank) in order: the states before and after each, and the inserts at the end."""
    best, back = {START: (0, 0)}, []
    for block in blocks:
        found: dict[int, tuple[int, int, int, int]] = {}
        for entry, state, cost, rank in block:
            if entry in best:
                new = (best[entry][0] + cost, best[entry][1], rank, entry)
                if state not in found or new < found[state]:
                    found[state] = new
        order = {x: i for i, x in enumerate(sorted({v[1:3] for v in found.values()}))}
        best = {s: (v[0], order[v[1:3]]) for s, v in found.items()}
        back.append({s: v[3] for s, v in found.items()})
    _, _, k, state = min((cost + k * INSERT, rank, k, s) for s, (cost, rank) in best.items() for k in range(MOST_INSERTS + 1) if inserts(s, k)[0] in FINAL)
    ways = []
    for step in reversed(back):
        ways.append((step[state], state))
        state = step[state]
    return ways[::-1], k


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the faults that each row's hash gives it: dropped, emptied, unfinished, repeated, of the wrong role."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    n = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    d = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), n.alias("__n")).where("__n != 0")
    d = d.select(
        "conv_id", "turn", F.when(F.col("__n") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("__n") == 1, "").when(F.col("__n") == 2, F.regexp_replace("text", r"[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("__n") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("__again"),
    )
    return d.drop("__again")


def _key(name: str, c: Column) -> list[Column]:
    """Two columns without nulls, in the order of a number with nulls first."""
    return [c.isNotNull().cast("int").alias(f"{name}0"), F.coalesce(c.cast("long"), F.lit(0).cast("long")).alias(f"{name}1")]


ORDER = ["c0", "c1", "t0", "t1", "role", "head", "digest"]


def turns(rows: DataFrame) -> DataFrame:
    """Different rows of (conv_id, turn, role, text) in the order of their conversations, over range partitions (p): with copies and faults."""
    digest = F.md5(F.col("text").cast("binary"))
    d = rows.select(*_key("c", F.col("conv_id")), *_key("t", F.col("turn")), "role", "text", F.substring("text", 1, 64).alias("head"), digest.alias("digest"))
    d = d.groupBy(*ORDER).agg(F.any_value("text").alias("text"), F.count("*").alias("copies"))
    first = rows.select(*_key("c", F.col("conv_id")), *_key("t", F.col("turn")), "role", F.substring("text", 1, 64).alias("head"), digest.alias("digest"))
    first = first.groupBy("c0", "c1", "role", "head", "digest").agg(F.min(F.struct("t0", "t1")).alias("t")).select("c0", "c1", "t.t0", "t.t1", "role", "head", "digest", F.lit(True).alias("first"))
    d = d.join(first, ORDER, "left")
    last = F.right(F.rtrim("text", F.lit(WHITE)), F.lit(1))
    blank = last == ""
    duplicate = ~blank & F.col("first").isNull()
    d = d.select(*ORDER, "text", "copies", blank.alias("blank"), duplicate.alias("duplicate"), (~blank & ~duplicate & ~last.isin(*ENDS)).alias("truncated"))
    return checkpoint(d.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).withColumn("p", F.spark_partition_id()))


def _turn(role: str, blank: bool, duplicate: bool, truncated: bool, copies: int) -> Turn:
    return role[:1], blank or duplicate, truncated, copies - 1


_NARROW = ["p", "c0", "c1", "role", "blank", "duplicate", "truncated", "copies"]
_EDGE = "p int, c0 int, c1 long, entry array<int>, state array<int>, cost array<long>, rank array<int>"
_EDGE_SCHEMA = pa.schema(
    [("p", pa.int32()), ("c0", pa.int32()), ("c1", pa.int64()), ("entry", pa.list_(pa.int32())), ("state", pa.list_(pa.int32())), ("cost", pa.list_(pa.int64())), ("rank", pa.list_(pa.int32()))]
)


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block the cheapest ways through it from every state to every state."""
    of, layers, out = None, None, []

    def row() -> dict:
        ways = sorted((*k, *v) for k, v in layers.best.items())
        return dict(zip(("p", "c0", "c1"), of, strict=True)) | {n: [w[i] for w in ways] for i, n in enumerate(("entry", "state", "cost", "rank"))}

    for b in batches:
        for p, c0, c1, role, blank, duplicate, truncated, copies in zip(*(b.column(c).to_pylist() for c in _NARROW), strict=True):
            if (p, c0, c1) != of:
                if of:
                    out.append(row())
                of, layers = (p, c0, c1), Layers((START, SYSTEM, USER, ASSISTANT))
            layers.add(_turn(role, blank, duplicate, truncated, copies), False)
    if of:
        yield pa.RecordBatch.from_pylist([*out, row()], _EDGE_SCHEMA)


def spanning(d: DataFrame) -> list[tuple[int, int]]:
    """Conversations in several partitions: they are the first or last of each, so the driver gets a row a partition."""
    ends = d.groupBy("p").agg(F.min(F.struct("c0", "c1")).alias("a"), F.max(F.struct("c0", "c1")).alias("b")).collect()
    n = Counter(x for r in ends for x in {tuple(r["a"]), tuple(r["b"])})
    return [x for x, k in n.items() if k > 1]


def ways_of(edges: list) -> dict[tuple[int, int, int], tuple[int, int, int | None]]:
    """(partition, conversation) of each block of a conversation in several partitions: its states before and after, and the inserts after it where it is the last."""
    by: dict[tuple[int, int], list] = {}
    for r in sorted(edges, key=lambda r: r["p"]):
        by.setdefault((r["c0"], r["c1"]), []).append(r)
    out = {}
    for conv, rows in by.items():
        ways, k = compose([list(zip(r["entry"], r["state"], r["cost"], r["rank"], strict=True)) for r in rows])
        for i, (r, (entry, state)) in enumerate(zip(rows, ways, strict=True)):
            out[r["p"], *conv] = (entry, state, k if i == len(rows) - 1 else None)
    return out


_COUNTS = ("blank", "duplicate", "truncated", "illegal", "cost", "turns")
_BLOCK = pa.schema(
    [("c0", pa.int32()), ("c1", pa.int64()), ("p", pa.int32()), ("piece", pa.int32()), *((c, pa.int64()) for c in _COUNTS), ("low", pa.int64()), ("high", pa.int64()), ("initials", pa.string()), ("audit", pa.string()), ("sha", pa.string()), ("text", pa.binary())]
)
_BLOCK_SQL = "c0 int, c1 long, p int, piece int, blank long, duplicate long, truncated long, illegal long, cost long, turns long, low long, high long, initials string, audit string, sha string, text binary"
_LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}


def edited(rows: list[tuple], layers: Layers, entry: int, state: int, k: int | None) -> tuple[str, Iterator[bytes]]:
    """The audit of a block and its repaired turns; k: inserts at its end, None where the conversation goes on."""
    path = layers.path(entry, state)
    audit = "".join(MACROS[macro] + "D" * (row[7] - 1) for (macro, _), row in zip(path, rows, strict=True)) + "I" * (k or 0)

    def repaired() -> Iterator[bytes]:
        for (macro, before), row in zip(path, rows, strict=True):
            name = MACROS[macro]
            at, roles = inserts(before, name.count("I"))
            yield from (f"{r}:".encode() for r in roles)
            if name[-1] != "D":
                yield f"{row[2] if name[-1] == 'K' else NEXT[at][0]}:{row[3]}".encode()
        yield from (f"{r}:".encode() for r in inserts(state, k or 0)[1])

    return audit, repaired()


def _repair(sent):
    """Each block's counts, audit and either its hash (a whole conversation) or its repaired text in pieces."""

    def block(p: int, conv: tuple[int, int], rows: list[tuple]) -> Iterator[dict]:
        entry, state, k = sent.value.get((p, *conv), (START, None, None))
        layers = Layers((entry,))
        for r in rows:
            layers.add(_turn(r[2], r[4], r[5], r[6], r[7]))
        whole = state is None
        if whole:
            state, k, cost = layers.end(entry)
        else:
            cost = layers.best[entry, state][0] + layers.cost_of_more + (k or 0) * INSERT
        audit, repaired = edited(rows, layers, entry, state, k)
        there = [r[1] for r in rows if r[0]]
        out = {"c0": conv[0], "c1": conv[1], "p": p, "piece": 0, "cost": cost, "audit": audit, "low": min(there, default=None), "high": max(there, default=None), "turns": len(set(there))}
        out |= {"blank": sum(r[7] for r in rows if r[4]), "duplicate": sum(r[7] if r[5] else r[7] - 1 for r in rows if not r[4]), "truncated": sum(r[6] for r in rows)}
        initials = [r[2][:1] for r in rows]
        out["illegal"] = sum(r[7] - 1 for r in rows) + sum(x not in _LEGAL for x in zip(initials, initials[1:], strict=False))
        out["initials"] = "".join(c or "-" for c in (initials[0], initials[-1]))
        if whole:
            yield out | {"sha": hashlib.sha256(b"\n".join(repaired)).hexdigest()}
            return
        held, size, piece = [], 0, 0
        for line in repaired:
            # each line ends in a newline; the last one's is taken off at the end
            held.append(line + b"\n")
            size += len(line) + 1
            if size >= PIECE:
                yield (out if not piece else {**dict.fromkeys(_COUNTS, 0), "c0": conv[0], "c1": conv[1], "p": p, "piece": piece}) | {"text": b"".join(held)}
                held, size, piece = [], 0, piece + 1
        if held or not piece:
            yield (out if not piece else {**dict.fromkeys(_COUNTS, 0), "c0": conv[0], "c1": conv[1], "p": p, "piece": piece}) | {"text": b"".join(held)}

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, rows, out, size = None, [], [], 0
        for b in batches:
            for p, c0, c1, *row in zip(*(b.column(c).to_pylist() for c in ("p", "c0", "c1", "t0", "t1", "role", "text", "blank", "duplicate", "truncated", "copies")), strict=True):
                if (p, c0, c1) != of:
                    for x in block(of[0], of[1:], rows) if of else ():
                        out.append(x)
                        size += len(x.get("text") or b"") + len(x.get("audit") or "") + 200
                        if size >= 4 * PIECE:
                            yield pa.RecordBatch.from_pylist(out, _BLOCK)
                            out, size = [], 0
                    of, rows = (p, c0, c1), []
                rows.append(tuple(row))
        out += block(of[0], of[1:], rows) if of else []
        if out:
            yield pa.RecordBatch.from_pylist(out, _BLOCK)

    return repair


_REPAIRED = "c0 int, c1 long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of a conversation, in order, as one row; the text of a conversation in several blocks streams through its hash."""
    of, total, audits, sha, pending, out = None, {}, [], None, b"", []

    def close() -> dict:
        digest = total.get("sha")
        if digest is None:
            sha.update(pending[:-1])
            digest = sha.hexdigest()
        gaps = total["high"] - total["low"] + 1 - total["turns"] if total["low"] is not None else 0
        return {"c0": of[0], "c1": of[1], "gaps": gaps, **{c: total[c] for c in _COUNTS[:5]}, "audit": "".join(audits), "repaired_sha256": digest}

    names = [x.split(" ") for x in _REPAIRED.split(", ")]
    kinds = pa.schema([(n, {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}[k]) for n, k in names])
    for b in batches:
        for r in b.to_pylist():
            if (r["c0"], r["c1"]) != of:
                if of:
                    out.append(close())
                of, total, audits, sha, pending = (r["c0"], r["c1"]), dict(r), [r["audit"]], hashlib.sha256(), r["text"] or b""
                if len(out) >= 4096:
                    yield pa.RecordBatch.from_pylist(out, kinds)
                    out = []
                continue
            if r["text"]:
                sha.update(pending)
                pending = r["text"]
            if r["piece"]:
                continue
            same_turn = total["high"] is not None and total["high"] == r["low"]
            for c in _COUNTS:
                total[c] += r[c]
            total["turns"] -= same_turn
            total["illegal"] += (total["initials"][1], r["initials"][0]) not in _LEGAL
            total["low"] = r["low"] if total["low"] is None else total["low"]
            total["high"] = total["high"] if r["high"] is None else r["high"]
            total["initials"] = r["initials"]
            audits.append(r["audit"])
    if of:
        out.append(close())
    if out:
        yield pa.RecordBatch.from_pylist(out, kinds)


def repair(rows: DataFrame) -> DataFrame:
    """A row for each conversation of (conv_id, turn, role, text): gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    spark = rows.sparkSession
    d = turns(rows)
    ways = {}
    if of := spanning(d):
        # at most two blocks a partition
        cut = d.select(*_NARROW).join(F.broadcast(spark.createDataFrame(of, "c0 int, c1 long")), ["c0", "c1"])
        ways = ways_of(cut.select(*_NARROW).mapInArrow(_edges, _EDGE).collect())
    sent = spark.sparkContext.broadcast(ways)
    d = d.select("p", "c0", "c1", "t0", "t1", "role", "text", "blank", "duplicate", "truncated", "copies").mapInArrow(_repair(sent), _BLOCK_SQL)
    d = d.repartition("c0", "c1").sortWithinPartitions("c0", "c1", "p", "piece").mapInArrow(_joined, _REPAIRED)
    return d.select(F.when(F.col("c0") == 1, F.col("c1")).alias("conv_id"), *(x.split(" ")[0] for x in _REPAIRED.split(", ")[2:]))


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """``repair`` after ``damage``, with a row for every original conversation."""
    d = repair(damage(conversations)).select(*_key("c", F.col("conv_id")), "*").drop("conv_id")
    every = conversations.select(*_key("c", F.col("conv_id"))).distinct()
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return every.join(d, ["c0", "c1"], "left").select(
        F.when(F.col("c0") == 1, F.col("c1")).alias("conv_id"), *map(zero, ("gaps", *_COUNTS[:5])), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_damaged(read_table(spark, sf_dir, "conversations"))


_SPACE = r"[\x20\x09-\x0D]"
# ways carries whole audits and repaired texts, so it needs no ranks.
ORACLE = rf"""
WITH RECURSIVE crc AS ({CRC_TABLE_SQL}),
h AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc_sql("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS n
  FROM conversations, crc),
d AS (
  SELECT conv_id, turn, CASE n WHEN 4 THEN 'user' ELSE role END AS role, CASE n WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM h, LATERAL (SELECT unnest(range(CASE n WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS k) x),
o AS (
  SELECT *, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS c,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, left(text, 64), md5(text)) AS i,
    regexp_replace(text, '{_SPACE}+$', '') AS trimmed
  FROM d),
e AS (SELECT *, row_number() OVER (PARTITION BY c, role, text ORDER BY i) AS seen FROM o),
r AS (
  SELECT *, trimmed = '' AS blank, trimmed <> '' AND seen > 1 AS duplicate, trimmed <> '' AND seen = 1 AND right(trimmed, 1) NOT IN ('.', '!', '?') AS truncated,
    lag(role) OVER (PARTITION BY c ORDER BY i) AS prior, count(*) OVER (PARTITION BY c) AS n
  FROM e),
ins(q, k, q2, price, lines) AS (VALUES
  (0, 0, 0, 0, []), (1, 0, 1, 0, []), (2, 0, 2, 0, []), (3, 0, 3, 0, []),
  (0, 1, 2, 3, ['user:']), (1, 1, 2, 3, ['user:']), (2, 1, 3, 3, ['assistant:']), (3, 1, 2, 3, ['user:']),
  (0, 2, 3, 6, ['user:', 'assistant:']), (1, 2, 3, 6, ['user:', 'assistant:']), (2, 2, 2, 6, ['assistant:', 'user:']), (3, 2, 3, 6, ['user:', 'assistant:'])),
keep(initial, q2, q3) AS (VALUES ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3)),
rerole(role, q2, q3) AS (VALUES ('user', 0, 2), ('user', 1, 2), ('user', 3, 2), ('assistant', 2, 3)),
mv AS (
  SELECT NULL::VARCHAR AS initial, NULL::VARCHAR AS role, q, repeat('I', k) || 'D' AS code, q2 AS q3, price + 4 AS price, lines, true AS gone FROM ins
  UNION ALL SELECT initial, NULL::VARCHAR, q, repeat('I', k) || 'K', q3, price, lines, false FROM ins JOIN keep USING (q2)
  UNION ALL SELECT NULL::VARCHAR, role, q, repeat('I', k) || 'R', q3, price + 3, lines, false FROM ins JOIN rerole USING (q2)),
ways AS (
  SELECT DISTINCT c, 0::BIGINT AS i, 0 AS q, {{'cost': 0::BIGINT, 'audit': '', 'lines': []::VARCHAR[]}} AS w FROM r
  UNION ALL
  SELECT r.c, r.i, mv.q3, min({{
      'cost': w.cost + mv.price + CASE WHEN r.truncated AND NOT mv.gone THEN 3 ELSE 0 END, 'audit': w.audit || mv.code,
      'lines': list_concat(w.lines, mv.lines, CASE WHEN mv.gone THEN [] ELSE [coalesce(mv.role, r.role) || ':' || r.text] END)}})
  FROM ways JOIN r ON r.c = ways.c AND r.i = ways.i + 1 JOIN mv ON mv.q = ways.q AND (mv.initial IS NULL OR mv.initial = r.role[1]) AND (mv.gone OR NOT (r.blank OR r.duplicate))
  GROUP BY r.c, r.i, mv.q3),
ends AS (
  SELECT ways.c, min({{'cost': w.cost + ins.price, 'audit': w.audit || repeat('I', k), 'lines': list_concat(w.lines, ins.lines)}}) AS w
  FROM ways JOIN (SELECT c, max(i) AS n FROM r GROUP BY c) m ON m.c = ways.c AND m.n = ways.i JOIN ins USING (q) WHERE ins.q2 IN (0, 3) GROUP BY ways.c),
f AS (
  SELECT c, any_value(conv_id) AS conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
    count(*) FILTER (truncated) AS truncated, count(*) FILTER (i > 1 AND coalesce(prior[1], '') || coalesce(role[1], '') NOT IN ('su', 'ua', 'au')) AS illegal
  FROM r GROUP BY c)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(w.cost, 0) AS cost, coalesce(w.audit, '') AS audit, sha256(coalesce(array_to_string(w.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN ends ON ends.c = f.c
"""
