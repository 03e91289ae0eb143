"""Quality rules: a bitmask ledger, built with DataFrame expressions alone.

``ledger`` evaluates each rule once a document and stores measurements and one long of
failure bits. A policy is a named, versioned mask over those bits: ``apply_policy`` needs
no second look at the text, and ``ablation`` gives the effect of taking out any rule by
bitwise aggregation over the distinct bit patterns (at most 2 ** rules, whatever the
number of documents).

Nothing here shuffles documents: measurements are array expressions inside each row, so
a hot source or a very long text stays in its own row. A 3-word window is known by its
64-bit hash (a collision within one text of 20,000 words has a chance of about 1e-11).

Edge cases: null and empty texts have no words, all counts are 0 and they fail
``few_words``; a text of any length is measured whole; a rule fails only beyond its bound (equal values
pass); every input row gives one output row, repeated rows and null ids included; an empty table gives no
rows; columns other than ``doc_id`` and ``text`` are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, read_table

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A failure condition in SQL over the measurements; its bit is its place in the list."""

    name: str
    fails: str


#: Append only: stored ledgers refer to the places.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("many_symbols", "10 * n_symbols > 2 * n_words"),
    Rule("repeated_lines", "100 * n_dup_lines > 60 * n_lines"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 15 * n_words"),
    Rule("exclamations", "2 * n_exclaims > n_words"),
    Rule("few_distinct_words", "100 * n_distinct_words < 5 * n_words"),
)
BASE = ("few_words", "repeated_windows")

#: (name, version) to the rules that reject.
POLICIES = {
    ("base", 1): BASE,
    ("default", 1): tuple(r.name for r in RULES),
}


def mask_of(names, rules=RULES) -> int:
    bit = {r.name: 1 << i for i, r in enumerate(rules)}
    return sum(bit[n] for n in names)


def _count(text: Column, char: str) -> Column:
    """Occurrences of an ASCII character, by the bytes that go with it."""
    return (F.octet_length(text) - F.octet_length(F.replace(text, F.lit(char), F.lit("")))).cast("long")


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements of each text."""
    text = F.col("__text")
    d = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text"))
    d = d.withColumns({"__words": F.array_remove(F.split(text, SPACE), ""), "__lines": F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0)})
    words = F.col("__words")
    window = lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))
    d = d.select(
        "doc_id",
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        _count(text, "!").alias("n_exclaims"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct("__words")).cast("long").alias("n_distinct_words"),
        F.slice(F.transform(words, window), F.lit(1), F.greatest(F.size(words) - 2, F.lit(0))).alias("__windows"),
    )
    h = F.col("__windows")
    placed = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p")))
    # most texts repeat no window and need no sort
    d = d.withColumn("__sorted", F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(placed)))
    s = F.col("__sorted")
    same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
    d = d.withColumn("__again", F.filter(s, lambda x, i: same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1))))
    starts = F.sort_array(F.transform("__again", lambda x: x["p"]))
    seen = F.aggregate(
        starts,
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")),
        lambda a: a["n"].cast("long"),
    )
    return d.withColumn("n_repeat_words", F.coalesce(seen, F.lit(0).cast("long"))).drop("__windows", "__sorted", "__again")


def ledger(docs: DataFrame, rules=RULES) -> DataFrame:
    """doc_id, measurements, and ``fail_bits``: bit i is set where rules[i] fails."""
    bits = F.lit(0).cast("long")
    for i, r in enumerate(rules):
        bits = bits.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return measure(docs).withColumn("fail_bits", bits)


def apply_policy(led: DataFrame, name: str, version: int, out: str = "kept") -> DataFrame:
    """Adds a boolean: whether no rule of the policy fails."""
    return led.withColumn(out, F.col("fail_bits").bitwiseAND(F.lit(mask_of(POLICIES[name, version]))) == 0)


def ablation(led: DataFrame, name: str, version: int, rules=RULES) -> DataFrame:
    """Per rule of the policy: documents that fail it, that only it rejects, and that are kept without it."""
    mask = mask_of(POLICIES[name, version])
    patterns = led.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    each = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, r in enumerate(rules) if mask >> i & 1])).alias("r")
    x = patterns.select("bits", "n", each).select("bits", "n", "r.*")
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    count = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return x.groupBy("rule").agg(
        count(hit).alias("n_failed"), count(F.col("bits") == F.col("bit")).alias("n_only"), count(F.col("bits").bitwiseAND(F.bitwise_not("bit")) == 0).alias("n_kept_without")
    )


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = ledger(read_table(spark, sf_dir, "documents"))
    base = mask_of(BASE)
    return apply_policy(led, "default", 1).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("fail_bits").bitwiseAND(F.lit(base)) != 0).alias("base_failed"), "kept", "fail_bits",
    )


ORACLE = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM t),
p AS (SELECT r, unnest(range(1, len(words) - 1)) AS p, words FROM w WHERE len(words) >= 3),
g AS (SELECT r, p, count(*) OVER (PARTITION BY r, words[p], words[p + 1], words[p + 2]) AS n FROM p),
c AS (SELECT r, count(DISTINCT q) AS n_repeat FROM (SELECT r, unnest([p, p + 1, p + 2]) AS q FROM g WHERE n > 1) GROUP BY r),
m AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, len(array_to_string(words, ''))::BIGINT AS word_chars,
         len(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         len(regexp_replace(text, '[^!]', '', 'g'))::BIGINT AS n_exclaims,
         len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         len(list_distinct(words))::BIGINT AS n_distinct, coalesce(n_repeat, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN c USING (r)),
b AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > 2 * n_words THEN 4 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 60 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 15 * n_words THEN 32 ELSE 0 END
    + CASE WHEN 2 * n_exclaims > n_words THEN 64 ELSE 0 END + CASE WHEN 100 * n_distinct < 5 * n_words THEN 128 ELSE 0 END)::BIGINT AS fail_bits
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM b
"""
