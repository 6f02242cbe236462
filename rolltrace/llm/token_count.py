"""Token counts by a count-only Viterbi pass over a unigram vocabulary.

An Aho-Corasick automaton gives every vocabulary match that ends at a character; the
dynamic programme keeps per position the best score and the piece count of the path that
has it, never the path. The rules are those of the public unigram tokenizer: scores are
added from the left, a later candidate replaces the best only if strictly greater
and starts are tried in order, so of equal paths the one whose last piece is longest stays; a
character without a piece of its own costs the least score minus 10 and, with byte
fallback, counts one per UTF-8 byte (without, a run of such characters counts one).

No vocabulary file of the box is a unigram model, so the query takes the pieces of the 32k
sentence-piece file with their scores as a unigram vocabulary. Blanks become U+2581,
one more leads the text. In general a text is run as one piece, so that sums round as the
tokenizer's do. Where all scores are whole numbers sums are exact wherever they start; if besides no
piece crosses from another character into U+2581 or over a line end, paths break there, and
the segments between are counted once and remembered. Both are checked when loading, for the vocabulary only.

Defined cases: null and empty texts have no tokens and score 0; any text is counted whole,
in memory linear in its length; null ids are carried and repeated rows come back each; empty table, empty
result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, row_slices, text_of

SPACE_MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Segments a worker remembers, and the longest it remembers.
KEPT, KEPT_LENGTH = 500_000, 40

_SEGMENTS = re.compile(f"\n|{SPACE_MARK}*[^{SPACE_MARK}\n]+|{SPACE_MARK}+").findall


class Unigram:
    """``pieces`` are (piece, score); ``byte_fallback`` counts unknown characters by bytes."""

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool = True):
        import ahocorasick

        self.byte_fallback = byte_fallback
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.matches = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.matches.add_word(piece, (len(piece), score))
        self.matches.make_automaton()
        inner = re.compile(f"[^{SPACE_MARK}]{SPACE_MARK}|.\n|\n.", re.S)
        exact = all(float(s).is_integer() for _, s in pieces)
        self.breaks = exact and byte_fallback and not any(inner.search(p) for p, _ in pieces)
        self.known: dict[str, tuple[float, int]] = {}

    def viterbi(self, text: str) -> tuple[float, int]:
        """Best score and its piece count."""
        size = len(text)
        best, count, open_run = [0.0] * (size + 1), [0] * (size + 1), [False] * (size + 1)
        at = 0

        def unknown(end: int, reached: bool, single: bool) -> None:
            """The last candidate of position ``end``: its own character as unknown."""
            if single:
                return
            score = self.unknown + best[end - 1]
            if not reached or score > best[end]:
                best[end] = score
                if self.byte_fallback:
                    count[end] = count[end - 1] + len(text[end - 1].encode())
                else:
                    count[end] = count[end - 1] + (not open_run[end - 1])
                open_run[end] = True

        reached = single = False
        for last, (length, gain) in self.matches.iter(text):
            end = last + 1
            while at < end:  # positions before this one are complete
                if at:
                    unknown(at, reached, single)
                at, reached, single = at + 1, False, False
            score = gain + best[end - length]
            if not reached or score > best[end]:
                best[end], count[end], open_run[end] = score, count[end - length] + 1, False
            reached, single = True, single or length == 1
        while at <= size:
            if at:
                unknown(at, reached, single)
            at, reached, single = at + 1, False, False
        return best[size], count[size]

    def count(self, text: str) -> tuple[float, int]:
        if not text:
            return 0.0, 0
        marked = SPACE_MARK + text.replace(" ", SPACE_MARK)
        if not self.breaks:
            return self.viterbi(marked)
        score, n, known = 0.0, 0, self.known
        for segment in _SEGMENTS(marked):
            found = known.get(segment)
            if found is None:
                found = self.viterbi(segment)
                if len(segment) <= KEPT_LENGTH:
                    if len(known) >= KEPT:
                        known.clear()
                    known[segment] = found
            score += found[0]
            n += found[1]
        return score, n


def sentence_pieces(path: str) -> list[tuple[str, float]]:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


@lru_cache(maxsize=2)
def loaded(path: str) -> Unigram:
    return Unigram(sentence_pieces(path))


def token_count(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, score per row of ``docs``; ``path`` is the model file on every executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = loaded(path)
        for batch in row_slices(batches):
            found = [model.count(x) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([n for _, n in found], pa.int64()), pa.array([s for s, _ in found], pa.float64())],
                ["doc_id", "n_tokens", "score"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, score double")


def op7_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_count(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
