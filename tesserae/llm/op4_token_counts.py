"""Token counts under a unigram vocabulary: Viterbi that carries only scores and counts.

Aho-Corasick enumerates every vocabulary piece that ends at each place; dynamic programming
keeps the best score and its number of pieces for each place, never a back pointer.
Ties go as in the public unigram tokenizers: at one end, the candidate that starts first
stays unless a later one scores strictly more; a character that is no piece itself may be
unknown, at the least score of the vocabulary minus 10, and counts one token for each of
its bytes if the vocabulary has all byte pieces (else neighbouring unknowns count as one).

Space is written U+2581, one is put before a text that has none, and a new word starts at
each, as the public Metaspace rule with split=True has it: words are independent, counts of short words
can be kept (at most ``CACHE`` a task), and a run of n spaces counts n pieces though the vocabulary
has pieces for such runs. The whole text is counted, whatever its length.

The vocabulary is a file on every executor: ``spark.tesserae.vocabulary`` where it is set, else
``VOCABULARY``, or the operator's parameter.

Edge cases: null and empty texts have 0 tokens; a text is taken as it is (no Unicode
normalisation); each input row gives a row, repeated rows and null ids included; ties of scores go by the
rule above; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

#: Path on every executor, where the session doesn't name another.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SPACE, PENALTY, CACHE, CACHED_CHARS = "▁", 10.0, 300_000, 24


def load_vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, log probability by Zipf's law from the piece's stored rank), in id order."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(p.id_to_piece(i), -math.log(2.0 - p.get_score(i))) for i in range(p.get_piece_size())]


class Counter:
    """Counts the pieces of the best segmentation."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        names = {p for p, _ in vocabulary}
        self.single = {p for p in names if len(p) == 1}
        self.bytes = all(f"<0x{i:02X}>" in names for i in range(256))
        self.unknown = min(s for _, s in vocabulary) - PENALTY
        self.kept: dict[str, int] = {}

    def word(self, w: str) -> int:
        return self.known_word(w) if self.single.issuperset(w) else self.any_word(w)

    def known_word(self, w: str) -> int:
        """Of a word whose characters are all pieces: each place is the end of one, and nothing is unknown."""
        best, num = [-math.inf] * (len(w) + 1), [0] * (len(w) + 1)
        best[0] = 0.0
        for end, (size, score) in self.automaton.iter(w):
            start, end = end + 1 - size, end + 1
            s = best[start] + score
            if s > best[end]:
                best[end], num[end] = s, num[start] + 1
        return num[-1]

    def any_word(self, w: str) -> int:
        n = len(w)
        single, unknown, by_bytes = self.single, self.unknown, self.bytes
        best: list[float] = [0.0] * (n + 1)
        num = [0] * (n + 1)
        known = [True] * (n + 1)  # whether the last piece is one of the vocabulary
        at, has = 1, False

        def close(e: int, has: bool) -> None:
            if w[e - 1] not in single:
                s = best[e - 1] + unknown
                if not has or s > best[e]:
                    best[e] = s
                    num[e] = num[e - 1] + (len(w[e - 1].encode("utf-8", "surrogatepass")) if by_bytes else int(known[e - 1] or e == 1))
                    known[e] = False

        for end, (size, score) in self.automaton.iter(w):
            e = end + 1
            while at < e:
                close(at, has)
                at, has = at + 1, False
            s = best[e - size] + score
            if not has or s > best[e]:
                best[e], num[e], known[e], has = s, num[e - size] + 1, True, True
        while at <= n:
            close(at, has)
            at, has = at + 1, False
        return num[n]

    def text(self, t: str) -> int:
        if not t:
            return 0
        total, kept = 0, self.kept
        parts = (t if t[0] in (" ", SPACE) else " " + t).replace(SPACE, " ").split(" ")
        for i in range(1, len(parts)):
            w = parts[i]
            k = kept.get(w)
            if k is None:
                k = self.word(SPACE + w)
                if len(w) <= CACHED_CHARS:
                    if len(kept) >= CACHE:
                        kept.clear()
                    kept[w] = k
            total += k
        return total


@lru_cache(1)
def _counter(path: str) -> Counter:
    return Counter(load_vocabulary(path))


def token_counts(docs: DataFrame, path: str = VOCABULARY, text: str = "text") -> DataFrame:
    """doc_id and n_tokens of each row."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(path).text
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([count(x.as_py()) for x in b.column(1)], pa.int64())], ["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).mapInArrow(counted, "doc_id long, n_tokens long")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"), spark.conf.get("spark.tesserae.vocabulary", VOCABULARY))
